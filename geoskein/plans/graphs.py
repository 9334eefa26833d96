"""Registered queries over graphs, made of suppliers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoskein.operators import graph as G
from geoskein.operators import lines as L
from geoskein.plans.registry import query
from geoskein.sources import derived as D

CHAIN = "e AS (SELECT * FROM (SELECT s_suppkey AS lo, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS hi FROM supplier) WHERE hi IS NOT NULL)"
NATION = """ne AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, min(c) AS cost FROM (SELECT s_nationkey AS a, lead(s_nationkey) OVER (ORDER BY s_suppkey) AS b,
  abs(s_acctbal - lead(s_acctbal) OVER (ORDER BY s_suppkey)) AS c FROM supplier) WHERE b IS NOT NULL AND a <> b GROUP BY ALL)"""
BOTH = "bo AS (SELECT lo AS a, hi AS b FROM {e} UNION ALL SELECT hi, lo FROM {e}), deg AS (SELECT a AS node, count(*) AS degree FROM bo GROUP BY a)"


def chains(spark, sf_dir):
    """Suppliers of a nation, each joined to the next."""
    s = D.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("lo"), F.lead("s_suppkey").over(W.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("hi")).filter("hi IS NOT NULL")


def nation_graph(spark, sf_dir):
    """Nations of suppliers that follow each other, at the difference of their balances."""
    s = D.table(spark, sf_dir, "supplier")
    t = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_nationkey").cast("long").alias("b"), F.col("s_acctbal").alias("c2"))
    j = s.select("s_suppkey", F.col("s_nationkey").cast("long").alias("a"), "s_acctbal").join(t, "s_suppkey").filter("a != b")
    return j.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.abs(F.col("s_acctbal") - F.col("c2"))).alias("cost"))


@query("node_degree", "WITH " + NATION + ", " + BOTH.format(e="ne") + " SELECT node, degree, CASE degree WHEN 1 THEN 'stub' WHEN 2 THEN 'binode' WHEN 3 THEN 'hub' ELSE 'hyperhub' END AS kind FROM deg")
def node_degree(spark, sf_dir):
    return G.degrees(nation_graph(spark, sf_dir))


@query("describe_edges", "WITH " + NATION + ", " + BOTH.format(e="ne") + """ SELECT lo, hi, CASE WHEN least(p, q) = 1 AND greatest(p, q) = 1 THEN 'isolated' WHEN p = 2 AND q = 2 THEN 'link'
  WHEN least(p, q) >= 3 THEN 'interior' WHEN least(p, q) = 1 AND greatest(p, q) = 2 THEN 'tip' WHEN least(p, q) = 1 THEN 'marginal' ELSE 'spoke' END AS kind
  FROM (SELECT lo, hi, x.degree AS p, y.degree AS q FROM ne JOIN deg x ON x.node = lo JOIN deg y ON y.node = hi)""")
def describe_edges(spark, sf_dir):
    return G.describe_edges(nation_graph(spark, sf_dir)).select("lo", "hi", "kind")


@query("components", "WITH " + CHAIN + """ SELECT n AS node, min(s2.s_suppkey) AS component FROM (SELECT lo AS n FROM e UNION SELECT hi FROM e)
  JOIN supplier s1 ON s1.s_suppkey = n JOIN supplier s2 ON s2.s_nationkey = s1.s_nationkey GROUP BY n""")
def components(spark, sf_dir):
    return G.components(chains(spark, sf_dir))


PATHS = "WITH RECURSIVE " + NATION + """, d AS (SELECT lo AS a, hi AS b, cost FROM ne UNION ALL SELECT hi, lo, cost FROM ne), nodes AS (SELECT DISTINCT a AS node FROM d),
  r(round, source, node, cost) AS (SELECT 0, node, node, 0.0::DOUBLE FROM nodes UNION ALL
    SELECT round + 1, source, node, min(cost) FROM (SELECT r.round, r.source, r.node, r.cost FROM r UNION ALL SELECT r.round, r.source, d.b, r.cost + d.cost FROM r JOIN d ON d.a = r.node) WHERE round < 24 GROUP BY ALL),
  sp AS (SELECT source, node, min(cost) AS cost FROM r WHERE round = 24 GROUP BY ALL)"""
PATHS = PATHS.replace("SELECT round + 1, source, node, min(cost) FROM (SELECT r.round, r.source, r.node, r.cost FROM r UNION ALL SELECT r.round, r.source, d.b, r.cost + d.cost FROM r JOIN d ON d.a = r.node) WHERE round < 24 GROUP BY ALL",
                      "SELECT r.round + 1, r.source, m.b, min(r.cost + m.cost) FROM r JOIN (SELECT a, b, cost FROM d UNION ALL SELECT node, node, 0.0 FROM nodes) m ON m.a = r.node WHERE r.round < 24 GROUP BY r.round, r.source, m.b")


@query("shortest_paths", PATHS + " SELECT source, node, round(cost, 4) AS cost FROM sp")
def shortest_paths(spark, sf_dir):
    e = nation_graph(spark, sf_dir)
    p = G.shortest_paths(e, G.degrees(e).select("node"))
    return p.select("source", "node", F.round("cost", 4).alias("cost"))


@query("longest_shortest_path", PATHS + " SELECT source, node, round(cost, 4) AS cost, row_number() OVER (ORDER BY cost DESC, source, node) AS place FROM sp WHERE source < node QUALIFY place <= 10")
def longest_shortest_path(spark, sf_dir):
    """Candidate trunks: least-cost paths, the longest first."""
    e = nation_graph(spark, sf_dir)
    p = G.shortest_paths(e, G.degrees(e).select("node")).filter("source < node")
    top = p.orderBy(F.desc("cost"), "source", "node").limit(10)
    return top.select("source", "node", F.round("cost", 4).alias("cost"), F.row_number().over(W.orderBy(F.desc("cost"), "source", "node")).cast("long").alias("place"))


@query("forbidden_edges", "WITH " + NATION + ", " + BOTH.format(e="ne") + " SELECT lo, hi, round(cost, 4) AS cost FROM ne WHERE lo NOT IN (SELECT node FROM deg WHERE degree > 4) AND hi NOT IN (SELECT node FROM deg WHERE degree > 4)")
def forbidden_edges(spark, sf_dir):
    e = nation_graph(spark, sf_dir)
    return G.without_nodes(e, G.degrees(e).filter("degree > 4")).select("lo", "hi", F.round("cost", 4).alias("cost"))


@query("prune_rank", """SELECT s_nationkey AS grp, s_suppkey AS line_id, s_acctbal < 4000 AND row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) <= 2 AS pruned FROM supplier""")
def prune_rank(spark, sf_dir):
    s = D.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("line_id"), "s_acctbal")
    return G.prune(s, "grp", "s_acctbal", 4000.0, target=-2).select("grp", "line_id", "pruned")


@query("prune_to_target", """SELECT s_nationkey AS grp, s_suppkey AS line_id, s_acctbal < 4000 AND row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) <= count(*) OVER (PARTITION BY s_nationkey) - 3 AS pruned FROM supplier""")
def prune_to_target(spark, sf_dir):
    s = D.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("line_id"), "s_acctbal")
    return G.prune(s, "grp", "s_acctbal", 4000.0, target=3).select("grp", "line_id", "pruned")


def _points(spark, sf_dir):
    """Every point by its label."""
    return D.points3d(spark, sf_dir).select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), "x", "y")


@query("nearest_stub", D.with_sql("pt") + """ SELECT grp, id, arg_min(other, struct_pack(d, other)) AS other, round(sqrt(min(d)), 6) AS distance FROM
  (SELECT a.label AS grp, a.vec_id AS id, b.vec_id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM pt a JOIN pt b ON a.label = b.label
   WHERE a.vec_id < (SELECT (max(vec_id) + 1) // 2 FROM pt) AND b.vec_id >= (SELECT (max(vec_id) + 1) // 2 FROM pt)) GROUP BY grp, id""")
def nearest_stub(spark, sf_dir):
    """The nearest of the later half of all points for each of the earlier half, by ids."""
    p = _points(spark, sf_dir)
    half = p.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0] // 2
    return G.nearest(p.filter(F.col("id") < half), p.filter(F.col("id") >= half), "grp").select("grp", "id", "other", F.round("distance", 6).alias("distance"))


@query("farthest_pair", D.with_sql("pt") + """ SELECT a.label AS grp, a.vec_id AS a, b.vec_id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance
  FROM pt a JOIN pt b ON a.label = b.label AND a.vec_id < b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) DESC, a.vec_id, b.vec_id) = 1""")
def farthest_pair(spark, sf_dir):
    return G.farthest_pair(_points(spark, sf_dir), "grp").select("grp", "a", "b", F.round("distance", 6).alias("distance"))
