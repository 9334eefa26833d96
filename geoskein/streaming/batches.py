"""Skeletons of polygons that arrive as a stream. The kernel keeps no state between polygons, so a micro-batch is enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from geoskein.operators.skeleton import skeletonize


def write_skeletons(vertices: DataFrame, path: str, checkpoint: str, interval: float, **options) -> StreamingQuery:
    """Start a query that appends the partitioned lines of every micro-batch of whole polygons to Parquet at path.

    vertices: a streaming vertex table (poly_id, ring, i, x, y[, z]); all vertices of a polygon must come in one batch. A
    batch replayed after a failure replaces its own folder.
    """

    def batch(df: DataFrame, number: int) -> None:
        skeletonize(df, interval, **options).lines().write.mode("overwrite").parquet(f"{path}/batch={number}")

    return vertices.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
