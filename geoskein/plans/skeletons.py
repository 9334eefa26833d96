"""Registered queries of the skeleton pipeline, on the star rings of part and on the small T ring."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoskein.operators import skeleton as K
from geoskein.plans.registry import query
from geoskein.sources import derived as D


def _t(spark):
    return D.t_ring(spark).select(F.col("ring").alias("poly_id"), F.lit(0).alias("ring"), "i", "x", "y")


def _stars(spark, sf_dir):
    """Star rings brought to the unit square, so that one interval fits all."""
    s = D.stars(spark, sf_dir)
    return s.select(F.col("ring").alias("poly_id"), F.lit(0).alias("ring"), "i", (F.col("x") / 50).alias("x"), ((F.col("y") - 900) / 1100).alias("y"))


SAMPLES = D.with_sql("tring") + """, seg AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS sl FROM (SELECT i, x, y, lead(x) OVER (ORDER BY i) AS nx, lead(y) OVER (ORDER BY i) AS ny FROM tring) WHERE nx IS NOT NULL),
  cum AS (SELECT *, sum(sl) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum FROM seg),
  d AS (SELECT k, k * 0.9::DOUBLE AS d FROM range(0, 1000) q(k) WHERE k * 0.9::DOUBLE < (SELECT max(cum) FROM cum)),
  hit AS (SELECT d.k, d.d, min(c.i) AS i FROM d JOIN cum c ON c.cum >= d.d GROUP BY ALL),
  samp AS (SELECT h.k AS samp_idx, h.i AS segment, c.nx + (c.nx - c.x) / c.sl * (h.d - c.cum) AS x, c.ny + (c.ny - c.y) / c.sl * (h.d - c.cum) AS y FROM hit h JOIN cum c ON c.i = h.i)"""


@query("boundary_samples", SAMPLES + " SELECT samp_idx, segment, round(x, 6) AS x, round(y, 6) AS y FROM samp")
def boundary_samples(spark, sf_dir):
    s = K.boundary_samples(_t(spark), D.T_INTERVAL)
    return s.select("samp_idx", "segment", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("proxy_ring", SAMPLES + """, e AS (SELECT samp_idx, x, y, coalesce(lag(segment) OVER (ORDER BY samp_idx), -1) <> segment OR coalesce(lead(segment) OVER (ORDER BY samp_idx), -1) <> segment AS edge FROM samp),
  n AS (SELECT row_number() OVER (ORDER BY samp_idx) - 1 AS i, x, y FROM e WHERE edge) SELECT i, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT * FROM n UNION ALL SELECT (SELECT count(*) FROM n), x, y FROM n WHERE i = 0)""")
def proxy_ring(spark, sf_dir):
    p = K.proxy_rings(K.boundary_samples(_t(spark), D.T_INTERVAL))
    return p.select("i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


TRI = SAMPLES.replace("WITH tring", "WITH box AS (SELECT 1), tring") + """, loc AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, 1.15 * greatest(max(x) - min(x), max(y) - min(y)) AS reach, count(*) AS n FROM samp),
  pts AS (SELECT samp_idx AS id, x, y FROM samp UNION ALL SELECT n, x0 - reach, (y0 + y1) / 2 FROM loc UNION ALL SELECT n + 1, x1 + reach, (y0 + y1) / 2 FROM loc
    UNION ALL SELECT n + 2, (x0 + x1) / 2, y0 - reach FROM loc UNION ALL SELECT n + 3, (x0 + x1) / 2, y1 + reach FROM loc),
  t0 AS (SELECT a.id AS a, b.id AS b, c.id AS c, a.x AS ax, a.y AS ay, b.x - a.x AS bx, b.y - a.y AS by_, c.x - a.x AS cx, c.y - a.y AS cy FROM pts a JOIN pts b ON a.id < b.id JOIN pts c ON b.id < c.id),
  t1 AS (SELECT *, 2 * (bx * cy - by_ * cx) AS d FROM t0), t2 AS (SELECT a, b, c, ax + (cy * (bx * bx + by_ * by_) - by_ * (cx * cx + cy * cy)) / d AS ux, ay + (bx * (cx * cx + cy * cy) - cx * (bx * bx + by_ * by_)) / d AS uy, ax, ay FROM t1 WHERE abs(d) > 1e-9),
  t3 AS (SELECT *, (ux - ax) * (ux - ax) + (uy - ay) * (uy - ay) AS r2 FROM t2),
  tri AS (SELECT a, b, c, ux, uy FROM t3 WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE (p.x - ux) * (p.x - ux) + (p.y - uy) * (p.y - uy) < r2 * (1 - 1e-9)))"""


@query("voronoi_vertices", TRI + " SELECT round(ux, 5) AS x, round(uy, 5) AS y FROM tri")
def voronoi_vertices(spark, sf_dir):
    v = K.skeletonize(_t(spark), D.T_INTERVAL, graph_only=True, outputs=["vor_vertex"]).vertices()
    return v.select(F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


RIDGES = TRI + """, side AS (SELECT a AS p, b AS q, ux, uy FROM tri UNION ALL SELECT b, c, ux, uy FROM tri UNION ALL SELECT a, c, ux, uy FROM tri),
  ridge AS (SELECT p, q, count(*) AS cells, sqrt((max(ux) - min(ux)) * (max(ux) - min(ux)) + (max(uy) - min(uy)) * (max(uy) - min(uy))) AS l FROM side GROUP BY p, q)"""


@query("voronoi_ridges", RIDGES + " SELECT p AS samp1, q AS samp2, cells = 2 AS finite, CASE WHEN cells = 2 THEN round(l, 4) END AS length FROM ridge")
def voronoi_ridges(spark, sf_dir):
    k = K.skeletonize(_t(spark), D.T_INTERVAL, graph_only=True)
    v = k.vertices().select("vor_idx", "x", "y")
    one, two = (v.select(F.col("vor_idx").alias(n), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}")) for n in ("from_vor", "to_vor"))
    e = k.ridges().join(one, "from_vor", "left").join(two, "to_vor", "left")
    l = F.sqrt((F.col("x_to_vor") - F.col("x_from_vor")) * (F.col("x_to_vor") - F.col("x_from_vor")) + (F.col("y_to_vor") - F.col("y_from_vor")) * (F.col("y_to_vor") - F.col("y_from_vor")))
    finite = (F.col("from_vor") >= 0) & (F.col("to_vor") >= 0)
    return e.select("samp1", "samp2", finite.alias("finite"), F.when(finite, F.round(l, 4)).alias("length"))


@query("peripheral_pairs", RIDGES + " SELECT p AS samp1, q AS samp2, CASE WHEN q - p = 1 OR (p = 0 AND q = (SELECT n - 1 FROM loc)) THEN 'peripheral' ELSE 'nonperipheral' END AS kind FROM ridge WHERE p < (SELECT n FROM loc) AND q < (SELECT n FROM loc)")
def peripheral_pairs(spark, sf_dir):
    k = K.skeletonize(_t(spark), D.T_INTERVAL, graph_only=True)
    n = k.samples().count()
    return k.ridges().filter((F.col("samp1") < n) & (F.col("samp2") < n)).select("samp1", "samp2", "kind")


@query("binary_tree", """WITH RECURSIVE t(generation, x0, y0, x1, y1, h) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 8.0::DOUBLE, pi() / 2
  UNION ALL SELECT generation + 1, x1, y1, x1 + 8.0 * power(0.6, generation + 1) * cos(h + s * radians(35)), y1 + 8.0 * power(0.6, generation + 1) * sin(h + s * radians(35)), h + s * radians(35) FROM t, (VALUES (1), (-1)) q(s) WHERE generation < 6)
  SELECT generation, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM t""")
def binary_tree(spark, sf_dir):
    t = K.binary_tree(spark, 8.0, 0.6, 35.0, 6)
    return t.select("generation", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("tree_lines", """WITH RECURSIVE t(generation, x0, y0, x1, y1, h) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 8.0::DOUBLE, pi() / 2
  UNION ALL SELECT generation + 1, x1, y1, x1 + 8.0 * power(0.5, generation + 1) * cos(h + s * radians(40)), y1 + 8.0 * power(0.5, generation + 1) * sin(h + s * radians(40)), h + s * radians(40) FROM t, (VALUES (1), (-1)) q(s) WHERE generation < 4)
  SELECT generation, i, round(x0 + (x1 - x0) * i / 4.0, 6) AS x, round(y0 + (y1 - y0) * i / 4.0, 6) AS y FROM t, (SELECT CAST(range AS INTEGER) AS i FROM range(0, 5))""")
def tree_lines(spark, sf_dir):
    """The tree's segments as lines, without noise, which SQL can't repeat."""
    t = K.tree_lines(K.binary_tree(spark, 8.0, 0.5, 40.0, 4), 5)
    return t.select("generation", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("preflight", D.with_sql("star") + """, seg AS (SELECT ring, sqrt(power((lead(x) OVER w - x) / 50, 2) + power((lead(y) OVER w - y) / 1100, 2)) AS l FROM star WINDOW w AS (PARTITION BY ring ORDER BY i))
  SELECT ring AS poly_id, round(sum(l), 6) AS perimeter, CAST(ceil(sum(l) / 0.05) AS BIGINT) AS est_samples FROM seg GROUP BY ring""")
def preflight(spark, sf_dir):
    return K.preflight(_stars(spark, sf_dir), 0.05).select("poly_id", F.round("perimeter", 6).alias("perimeter"), "est_samples")


def _line_columns(lines):
    return lines.select("poly_id", "kind", "from_vor", "to_vor", F.size("vor_idxs").alias("vertices"), *[F.round(c, 6).alias(c) for c in ("length2d", "untailed_length2d", "norm_length")])


def _rough_circles(spark, sf_dir):
    """A ring for each brand: its n parts around a circle at radius n / 20 + size / 50, so about 0.3 apart for any n."""
    from pyspark.sql import Window as W

    p = D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("poly_id"), "p_partkey", (F.col("p_size") / 50).alias("r"))
    w = W.partitionBy("poly_id")
    p = p.withColumn("i", (F.row_number().over(w.orderBy("p_partkey")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))
    angle = F.col("i") * (2 * math.pi) / F.col("n")
    p = p.withColumn("r", F.col("r") + F.col("n") / 20)
    p = p.select("poly_id", F.lit(0).alias("ring"), "i", "n", (F.col("r") * F.cos(angle)).alias("x"), (F.col("r") * F.sin(angle)).alias("y"))
    return p.drop("n").unionByName(p.filter("i = 0").withColumn("i", F.col("n")).drop("n"))


@query("skeleton_lines")
def skeleton_lines(spark, sf_dir):
    return _line_columns(K.skeletonize(_rough_circles(spark, sf_dir), 0.1, tails=False, outputs=["line"]).lines())


@query("skeleton_nodes")
def skeleton_nodes(spark, sf_dir):
    return K.skeletonize(_rough_circles(spark, sf_dir), 0.1, outputs=["node"]).nodes("nonbinode")


@query("skeleton_pruned")
def skeleton_pruned(spark, sf_dir):
    return _line_columns(K.skeletonize(_rough_circles(spark, sf_dir), 0.1, min_normalized_length=1.1, outputs=["line"]).lines())


@query("skeleton_tails")
def skeleton_tails(spark, sf_dir):
    return _line_columns(K.skeletonize(_t(spark), 0.2, min_normalized_length=3.0).lines())


@query("skeleton_branch_first")
def skeleton_branch_first(spark, sf_dir):
    return _line_columns(K.skeletonize(_t(spark), 0.2, mode="PREFER_BRANCH").lines("trunk", "branch"))


@query("graph_only")
def graph_only(spark, sf_dir):
    e = K.skeletonize(_t(spark), 0.2, graph_only=True).graph_edges()
    return e.select("poly_id", "kind", "from_vor", "to_vor", F.round("length2d", 6).alias("length2d"))
