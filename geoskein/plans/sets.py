"""Registered queries over arrays and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoskein.functions import arrays as A
from geoskein.plans.registry import query
from geoskein.sources.derived import table

ARR = """WITH arr AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS b FROM lineitem GROUP BY l_orderkey)"""


def _arrays(spark, sf_dir):
    """An order's line numbers a and quantities b, in one order."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    return g.select("l_orderkey", F.transform("r", lambda x: x["l_linenumber"].cast("long")).alias("a"), F.transform("r", lambda x: x["q"]).alias("b"))


def _text(c):
    return F.array_join(c, ",")


@query("set_union", ARR + " SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u FROM arr")
def set_union(spark, sf_dir):
    return _arrays(spark, sf_dir).select("l_orderkey", _text(A.union_sorted("a", "b")).alias("u"))


@query("set_intersect", ARR + " SELECT l_orderkey, coalesce(array_to_string(list_sort(list_intersect(list_distinct(a), list_distinct(b))), ','), '') AS u FROM arr")
def set_intersect(spark, sf_dir):
    return _arrays(spark, sf_dir).select("l_orderkey", _text(F.array_sort(F.array_intersect("a", "b"))).alias("u"))


@query("set_except", ARR + " SELECT l_orderkey, coalesce(array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))), ','), '') AS u FROM arr")
def set_except(spark, sf_dir):
    return _arrays(spark, sf_dir).select("l_orderkey", _text(F.array_sort(F.array_except("a", "b"))).alias("u"))


@query("set_subset", ARR + " SELECT l_orderkey, len(list_filter(a, lambda x: NOT list_contains([1,2,3,4], x))) = 0 AS of_four, list_has_all(b, a) AS of_b FROM arr")
def set_subset(spark, sf_dir):
    four = F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 4)])
    return _arrays(spark, sf_dir).select("l_orderkey", A.is_subset(F.col("a"), four).alias("of_four"), A.is_subset(F.col("a"), F.col("b")).alias("of_b"))


@query("unique_count", ARR + " SELECT l_orderkey, len(list_distinct(b)) AS n, array_to_string(list_sort(list_distinct(b)), ',') AS u FROM arr")
def unique_count(spark, sf_dir):
    return _arrays(spark, sf_dir).select("l_orderkey", A.unique_count("b").cast("long").alias("n"), _text(A.unique_sorted("b")).alias("u"))


@query("unique_test", "SELECT count(*) = count(DISTINCT l_orderkey) AS orderkey_unique, (SELECT count(*) = count(DISTINCT p_partkey) FROM part) AS partkey_unique FROM lineitem")
def unique_test(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").agg((F.count(F.lit(1)) == F.countDistinct("l_orderkey")).alias("orderkey_unique"))
    return a.crossJoin(table(spark, sf_dir, "part").agg((F.count(F.lit(1)) == F.countDistinct("p_partkey")).alias("partkey_unique")))  # one row by one row


@query("slide_pairwise", ARR + " SELECT l_orderkey, unnest(list_transform(generate_series(1, len(b) - 1), lambda k: b[k] * 100 + b[k + 1])) AS pair FROM arr WHERE len(b) > 1")
def slide_pairwise(spark, sf_dir):
    p = _arrays(spark, sf_dir).select("l_orderkey", F.explode(A.slide_pairwise("b")).alias("p"))
    return p.select("l_orderkey", (F.col("p.first") * 100 + F.col("p.second")).alias("pair"))


@query("moving_mean2", ARR + " SELECT l_orderkey, unnest(list_transform(generate_series(1, len(b) - 1), lambda k: (b[k] + b[k + 1]) / 2)) AS mean FROM arr WHERE len(b) > 1")
def moving_mean2(spark, sf_dir):
    return _arrays(spark, sf_dir).select("l_orderkey", F.explode(A.moving_mean2("b")).alias("mean"))


@query("upper_pairs", ARR + " SELECT l_orderkey, len(b) * (len(b) - 1) // 2 AS pairs, CAST(coalesce((SELECT sum(i * 10 + j) FROM range(0, len(b)) p(i), range(0, len(b)) q(j) WHERE i < j), 0) AS BIGINT) AS code FROM arr")
def upper_pairs(spark, sf_dir):
    p = A.upper_pairs(F.size("b"))
    code = F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x["i"] * 10 + x["j"])
    return _arrays(spark, sf_dir).select("l_orderkey", F.size(p).cast("long").alias("pairs"), code.alias("code"))


@query("unravel_index", "SELECT l_orderkey, l_orderkey // 7 AS irow, l_orderkey % 7 AS icol FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def unravel_index(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().withColumn("at", A.unravel2d(F.col("l_orderkey"), F.lit(7)))
    return k.select("l_orderkey", F.col("at.row").alias("irow"), F.col("at.column").alias("icol"))


@query("last_indices", ARR + " SELECT l_orderkey, array_to_string(list_transform(generate_series(1, len(b)), lambda k: CAST(list_sum(b[1:k]) - 1 AS BIGINT)), ',') AS last FROM arr")
def last_indices(spark, sf_dir):
    return _arrays(spark, sf_dir).select("l_orderkey", _text(A.counts_to_last_index(F.col("b"))).alias("last"))


@query("bin_counts", "SELECT l_quantity AS bin, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_quantity) AS place FROM lineitem GROUP BY l_quantity")
def bin_counts(spark, sf_dir):
    """Values by how often they occur; the counts are few, one for each quantity."""
    from pyspark.sql import Window as W

    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "bin")).cast("long"))


@query("stacked_items", """SELECT l_orderkey, array_to_string(list_transform(generate_series(1, len(a)), lambda k: a[k] || ':' || b[k] || ':' || a[k]), ',') AS items FROM
  (SELECT l_orderkey, list(CAST(l_linenumber AS BIGINT) ORDER BY l_linenumber, l_partkey) AS a, list(l_partkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem GROUP BY l_orderkey)""")
def stacked_items(spark, sf_dir):
    """An order's line numbers and parts side by side, and beside them the numbers again."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("a"), F.col("l_partkey").alias("b"))))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(pairs.alias("p")).select("l_orderkey", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    o = o.withColumn("two", A.stacked(["a", "b"])).withColumn("three", A.stacked(["two", "a"], [True, False]))
    return o.select("l_orderkey", F.array_join(F.transform("three", lambda x: F.array_join(x.cast("array<string>"), ":")), ",").alias("items"))
