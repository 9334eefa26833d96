"""Vertex tables derived from the driver's tables, which hold no geometry of their own.

A vertex table has a line's key, the position i from 0 and coordinates as doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, x, y): events of each user in order of time; x is seconds since 2024-01-01, y the value."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    whole = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60
    micros = whole.cast("long") * 1000000 + F.expr("cast(extract(SECOND FROM ts) * 1000000 AS long)")
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", i.cast("long").alias("i"), (micros / F.lit(1e6)).alias("x"), F.col("value").alias("y"))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ring, i, x, y): parts of each brand around their mean, one ring a brand, closed by its first vertex."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ring"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), "p_partkey")
    w = W.partitionBy("ring")
    p = p.withColumns({"dx": F.col("x") - F.avg("x").over(w), "dy": F.col("y") - F.avg("y").over(w)})
    p = p.withColumn("i", F.row_number().over(w.orderBy(F.atan2("dy", "dx"), "p_partkey")) - 1)
    n = F.count(F.lit(1)).over(w)
    p = p.withColumn("at", F.when(F.col("i") == 0, F.array(F.lit(0).cast("long"), n)).otherwise(F.array(F.col("i").cast("long"))))
    return p.select("ring", F.explode("at").alias("i"), "x", "y")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, i, x, y): an order's items by number, quantity and price."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    return rows.select("l_orderkey", "i", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


def points3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x, y, z): the first three components of each embedding."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")])


#: A small T-shaped ring whose centre line is known.
T_RING = [(0.0, 0.0), (10.0, 0.3), (10.2, 2.1), (6.1, 2.0), (5.9, 7.2), (4.2, 7.0), (4.0, 1.9), (-0.2, 2.2), (0.0, 0.0)]
T_INTERVAL = 0.9


def t_ring(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("T", k, x, y) for k, (x, y) in enumerate(T_RING)], "ring string, i long, x double, y double")


#: The same derivations in SQL, for oracles.
SQL = {
    "traj": """traj AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS x, value AS y FROM events)""",
    "star": """star0 AS (SELECT p_brand AS ring, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_partkey,
        p_size - avg(CAST(p_size AS DOUBLE)) OVER (PARTITION BY p_brand) AS dx, p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand) AS dy FROM part),
        star1 AS (SELECT ring, x, y, row_number() OVER (PARTITION BY ring ORDER BY atan2(dy, dx), p_partkey) - 1 AS i, count(*) OVER (PARTITION BY ring) AS n FROM star0),
        star AS (SELECT ring, i, x, y FROM star1 UNION ALL SELECT ring, n, x, y FROM star1 WHERE i = 0)""",
    "oline": """oline AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i,
        l_quantity AS x, l_extendedprice AS y FROM lineitem)""",
    "pt": "pt AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)",
    "tring": "tring AS (SELECT * FROM (VALUES " + ", ".join(f"('T', {k}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for k, (x, y) in enumerate(T_RING)) + ") v(ring, i, x, y))",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
