"""Operators over edge tables (lo, hi, cost): degrees, components, paths, removals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoskein.kernel import nearest as K
from geoskein.sources.scratch import materialise


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """(a, b) of every edge in either direction."""
    one = edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"), *more)
    return one.unionByName(edges.select(F.col("hi").alias("a"), F.col("lo").alias("b"), *more))


def describe(degree: Column) -> Column:
    return F.when(degree == 1, "stub").when(degree == 2, "binode").when(degree == 3, "hub").when(degree > 3, "hyperhub").otherwise("unrecognized")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, kind); a loop counts twice at its node."""
    d = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return d.withColumn("kind", describe(F.col("degree")))


def describe_edges(edges: DataFrame) -> DataFrame:
    """Edges with the degrees of their ends and what those make of them."""
    d = degrees(edges).select("node", "degree")
    e = edges.join(d.select(F.col("node").alias("lo"), F.col("degree").alias("d_lo")), "lo").join(d.select(F.col("node").alias("hi"), F.col("degree").alias("d_hi")), "hi")
    low, high = F.least("d_lo", "d_hi"), F.greatest(F.least("d_lo", F.lit(3)), F.least("d_hi", F.lit(3)))
    kind = (
        F.when((low == 1) & (high == 1), "isolated").when((low == 2) & (high == 2), "link").when((low >= 3), "interior")
        .when((low == 1) & (high == 2), "tip").when((low == 1) & (high == 3), "marginal").when((low == 2) & (high == 3), "spoke").otherwise("unknown")
    )
    return e.withColumn("kind", kind)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each.

    Labels shrink by neighbours, by what a label's own node has learned and by following labels, so that a chain of n
    nodes takes about log n rounds.
    """
    both = materialise(both_ways(edges).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        said = lower.groupBy(F.col("old").alias("of")).agg(F.min("component").alias("said"))
        hooked = lower.join(said, F.col("old") == F.col("of")).select("node", "old", F.least("component", "said").alias("mid"))
        up = lower.select(F.col("node").alias("up"), F.col("component").alias("further"))
        new = materialise(hooked.join(up, F.col("mid") == F.col("up"), "left").select("node", "old", F.least("mid", F.coalesce("further", "mid")).alias("component")), "labels")
        if not new.filter("component != old").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: float | None = None) -> DataFrame:
    """(source, node, cost): least cost from each source, itself at 0; costs must not be negative; beyond `limit` nothing.

    Each round relaxes all edges of what improved in the one before.
    """
    both = both_ways(edges, "cost").groupBy("a", "b").agg(F.min("cost").alias("cost"))
    best = materialise(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")), "paths")
    while True:
        step = best.filter("fresh").select("source", F.col("node").alias("a"), F.col("cost").alias("so_far")).join(both, "a")
        reach = step.groupBy("source", F.col("b").alias("node")).agg(F.min(F.col("so_far") + F.col("cost")).alias("reached"))
        if limit is not None:
            reach = reach.filter(F.col("reached") <= limit)
        j = best.join(reach, ["source", "node"], "full")
        fresh = F.col("cost").isNull() | (F.col("reached") < F.col("cost"))
        best = materialise(j.select("source", "node", F.when(F.coalesce(fresh, F.lit(False)), F.col("reached")).otherwise(F.col("cost")).alias("cost"), F.coalesce(fresh, F.lit(False)).alias("fresh")), "paths")
        if not best.filter("fresh").limit(1).count():
            return best.select("source", "node", "cost")


def without_nodes(edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Edges that touch no forbidden node."""
    f = forbidden.select("node").distinct()
    return edges.join(f.withColumnRenamed("node", "lo"), "lo", "left_anti").join(f.withColumnRenamed("node", "hi"), "hi", "left_anti")


def prune(lines: DataFrame, group: str, cost: str, cutoff: float, target: int | None = None) -> DataFrame:
    """Lines with `pruned`: those with a cost below the cutoff, the smallest first.

    target < 0 prunes -target lines of a group at most; target > 0 leaves that many at least; 0 is an error. A null
    cost is never pruned.
    """
    if target == 0:
        raise ValueError("a target of 0 means nothing")
    w = W.partitionBy(group)
    place = F.row_number().over(w.orderBy(F.col(cost).asc_nulls_last(), "line_id"))
    may = F.coalesce(F.col(cost) < cutoff, F.lit(False))
    if target is not None and target < 0:
        may = may & (place <= -target)
    if target is not None and target > 0:
        may = may & (place <= F.count(F.lit(1)).over(w) - target)
    return lines.withColumn("pruned", may)


def nearest(points: DataFrame, others: DataFrame, group: str) -> DataFrame:
    """The nearest other of each point within its group, ties to the smaller id. points: (group, id, x, y).

    A group is one task's work and no pairs leave it. Points without coordinates count for nothing.
    """
    names = [group, "id", "other", "distance"]

    def run(own: pd.DataFrame, their: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(their):
            return pd.DataFrame(columns=names)
        other, d2 = K.nearest(own.x.to_numpy(float), own.y.to_numpy(float), their.ox.to_numpy(float), their.oy.to_numpy(float), their.other.to_numpy())
        return pd.DataFrame({group: own.a_group, "id": own["id"], "other": other, "distance": np.sqrt(d2)})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    given = f"`{group}` is not null and x is not null and y is not null"
    a = points.filter(given).select(F.col(group).alias("a_group"), "id", "x", "y")
    # other names: sides of one origin lose columns of one name
    b = others.filter(given).select(F.col(group).alias("b_group"), F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    schema = f"`{group}` {kinds[group]}, id {kinds['id']}, other {dict(others.dtypes)['id']}, distance double"
    return a.groupBy("a_group").cogroup(b.groupBy("b_group")).applyInPandas(run, schema)


def farthest_pair(points: DataFrame, group: str, parts: int = 64) -> DataFrame:
    """The two most distant points of each group, ties to the smaller ids.

    Both are corners of the group's convex hull, which is that of the hulls of its parts; no pairs leave a task. Points
    without coordinates count for nothing.
    """
    kinds = dict(points.dtypes)
    schema = f"`{group}` {kinds[group]}, id {kinds['id']}, x double, y double"

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        # the first two ids stay, for groups whose points are all at one place
        keep = np.union1d(K.hull(pdf.x.to_numpy(float), pdf.y.to_numpy(float)), np.arange(min(2, len(pdf))))
        return pdf.loc[keep, [group, "id", "x", "y"]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame(columns=[group, "a", "b", "distance"])
        a, b, d2 = K.farthest(pdf.x.to_numpy(float), pdf.y.to_numpy(float), pdf["id"].to_numpy())
        return pd.DataFrame({group: pdf[group].iloc[:1], "a": a, "b": b, "distance": d2**0.5})

    rows = points.select(group, "id", "x", "y").filter(f"`{group}` is not null and x is not null and y is not null")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy(group, "part").applyInPandas(corners, schema)
    return rows.groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, a {kinds['id']}, b {kinds['id']}, distance double")
