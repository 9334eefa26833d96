"""Registered queries over lines, rings and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoskein.functions import codec as C
from geoskein.operators import lines as L
from geoskein.plans.registry import query
from geoskein.sources import derived as D

SEG = """seg AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS sl FROM
  (SELECT {k} AS k, i, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY i)) WHERE nx IS NOT NULL),
  cum AS (SELECT *, sum(sl) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum FROM seg)"""
TRAJ = D.with_sql("traj") + ", " + SEG.format(k="user_id", t="traj")
OLINE = D.with_sql("oline") + ", " + SEG.format(k="l_orderkey", t="oline")
STAR = D.with_sql("star") + ", " + SEG.format(k="ring", t="star")


def r(c, digits: int = 6):
    return F.round(c, digits)


@query("line_length", TRAJ + """ SELECT t.user_id, t.vertices, round(coalesce(s.l, 0), 3) AS length, round(minx, 3) AS minx, round(maxx, 3) AS maxx, round(miny, 3) AS miny, round(maxy, 3) AS maxy
  FROM (SELECT user_id, count(*) AS vertices, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM traj GROUP BY user_id) t
  LEFT JOIN (SELECT k, sum(sl) AS l FROM seg GROUP BY k) s ON s.k = t.user_id""")
def line_length(spark, sf_dir):
    t = D.trajectories(spark, sf_dir)
    out = L.length(t, "user_id").join(L.envelope(t, "user_id"), "user_id")
    return out.select("user_id", "vertices", *[r(F.col(c), 3).alias(c) for c in ("length", "minx", "maxx", "miny", "maxy")])


@query("line_envelope", D.with_sql("oline") + " SELECT l_orderkey, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM oline GROUP BY l_orderkey")
def line_envelope(spark, sf_dir):
    return L.envelope(D.order_lines(spark, sf_dir), "l_orderkey").select("l_orderkey", "minx", "miny", "maxx", "maxy")


@query("line_endpoints", D.with_sql("oline") + " SELECT l_orderkey, arg_min(x, i) AS start_x, arg_min(y, i) AS start_y, arg_max(x, i) AS end_x, arg_max(y, i) AS end_y FROM oline GROUP BY l_orderkey")
def line_endpoints(spark, sf_dir):
    return L.endpoints(D.order_lines(spark, sf_dir), "l_orderkey").select("l_orderkey", "start_x", "start_y", "end_x", "end_y")


@query("line_components_sum", OLINE + " SELECT k AS l_orderkey, round(sum(nx - x), 6) AS sum_dx, round(sum(ny - y), 4) AS sum_dy, round(sum(CASE WHEN sl > 0 THEN (nx - x) / sl END), 6) AS sum_ux FROM seg GROUP BY k")
def line_components_sum(spark, sf_dir):
    s = L.segments(D.order_lines(spark, sf_dir), "l_orderkey")
    return s.groupBy("l_orderkey").agg(r(F.sum("dx")).alias("sum_dx"), r(F.sum("dy"), 4).alias("sum_dy"), r(F.sum(F.try_divide("dx", "segment_length"))).alias("sum_ux"))


@query("line_cumulative", OLINE + " SELECT k AS l_orderkey, i, round(sl, 4) AS segment_length, round(cum, 4) AS cum FROM cum")
def line_cumulative(spark, sf_dir):
    s = L.segments(D.order_lines(spark, sf_dir), "l_orderkey")
    return s.select("l_orderkey", "i", r(F.col("segment_length"), 4).alias("segment_length"), r(F.col("cum"), 4).alias("cum"))


@query("line_flip", D.with_sql("oline") + " SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY i DESC) - 1 AS i, x, y FROM oline")
def line_flip(spark, sf_dir):
    return L.flip(D.order_lines(spark, sf_dir), "l_orderkey").select("l_orderkey", "i", "x", "y")


INTERP = """ , tot AS (SELECT k, max(cum) AS total FROM cum GROUP BY k), d AS ({d}),
  hit AS (SELECT d.k, d.d, d.at, min(c.i) AS i FROM d JOIN cum c ON c.k = d.k AND c.cum >= d.at GROUP BY ALL)
  SELECT h.k AS user_id, round(h.d, 6) AS d, h.i AS segment, round(c.x + (c.nx - c.x) + CASE WHEN c.sl > 0 THEN (c.nx - c.x) / c.sl ELSE 0 END * (h.at - c.cum), 3) AS x,
  round(c.y + (c.ny - c.y) + CASE WHEN c.sl > 0 THEN (c.ny - c.y) / c.sl ELSE 0 END * (h.at - c.cum), 3) AS y FROM hit h JOIN cum c ON c.k = h.k AND c.i = h.i"""


def _rounded(p):
    return p.select("user_id", r(F.col("d")).alias("d"), "segment", r(F.col("x"), 3).alias("x"), r(F.col("y"), 3).alias("y"))


@query("line_interpolate", TRAJ + INTERP.format(d="SELECT k, v AS d, v AS at FROM tot, (VALUES (0.0::DOUBLE), (1000.0::DOUBLE), (250000.5::DOUBLE)) q(v) WHERE v <= total"))
def line_interpolate(spark, sf_dir):
    t = D.trajectories(spark, sf_dir)
    total = L.length(t, "user_id").select("user_id", "length")
    d = total.select("user_id", "length", F.explode(F.array(*[F.lit(v) for v in (0.0, 1000.0, 250000.5)])).alias("d")).filter("d <= length").select("user_id", "d")
    return _rounded(L.interpolate(t, d, "user_id"))


@query("line_interpolate_normalized", TRAJ + INTERP.format(d="SELECT k, v AS d, v * total AS at FROM tot, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) q(v)"))
def line_interpolate_normalized(spark, sf_dir):
    t = D.trajectories(spark, sf_dir)
    d = t.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.9)])).alias("d"))
    return _rounded(L.interpolate(t, d, "user_id", normalized=True))


@query("line_sample_regularly", TRAJ + INTERP.format(d="SELECT k, n * 100000.0::DOUBLE AS d, n * 100000.0::DOUBLE AS at FROM tot, range(0, 10000) q(n) WHERE n * 100000.0::DOUBLE < total"))
def line_sample_regularly(spark, sf_dir):
    return _rounded(L.sample_regularly(D.trajectories(spark, sf_dir), "user_id", 100000.0))


@query("line_sample_vertices", OLINE + """, tot AS (SELECT k, max(cum) AS total FROM cum GROUP BY k)
  SELECT k AS l_orderkey, count(*) AS samples, round(sum(d), 3) AS sum_d FROM
  (SELECT k, n * 5000.0::DOUBLE AS d FROM tot, range(0, 1000) q(n) WHERE n * 5000.0::DOUBLE < total UNION ALL SELECT k, cum FROM cum) GROUP BY k""")
def line_sample_vertices(spark, sf_dir):
    d = L.sample_distances(D.order_lines(spark, sf_dir), "l_orderkey", 5000.0, vertices=True)
    return d.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("samples"), r(F.sum("d"), 3).alias("sum_d"))


@query("line_unit_components", OLINE + " SELECT k AS l_orderkey, i, round(CASE WHEN sl > 0 THEN (nx - x) / sl END, 6) AS ux, round(CASE WHEN sl > 0 THEN (ny - y) / sl END, 6) AS uy FROM seg")
def line_unit_components(spark, sf_dir):
    u = L.unit_components(D.order_lines(spark, sf_dir), "l_orderkey")
    return u.select("l_orderkey", "i", r(F.col("ux")).alias("ux"), r(F.col("uy")).alias("uy"))


def _neighbours(spark, sf_dir, axes):
    p = D.points3d(spark, sf_dir)
    q = p.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    d = L.distance({c: F.col(c) for c in axes}, {c: F.col(f"q{c}") for c in axes})
    return p.join(q, "vec_id").select("vec_id", r(d).alias("distance"))


@query("point_distance_2d", D.with_sql("pt") + " SELECT a.vec_id, round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 6) AS distance FROM pt a JOIN pt b ON b.vec_id = a.vec_id + 1")
def point_distance_2d(spark, sf_dir):
    return _neighbours(spark, sf_dir, "xy")


@query("point_distance_3d", D.with_sql("pt") + " SELECT a.vec_id, round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)), 6) AS distance FROM pt a JOIN pt b ON b.vec_id = a.vec_id + 1")
def point_distance_3d(spark, sf_dir):
    return _neighbours(spark, sf_dir, "xyz")


@query("point_translate", D.with_sql("pt") + " SELECT vec_id, round(x - 1.5, 6) AS x, round(y + 2.0, 6) AS y, round(z, 6) AS z FROM pt")
def point_translate(spark, sf_dir):
    t = L.translate(L.translate(D.points3d(spark, sf_dir), {"x": 1.5}, negative=True), {"y": 2.0})
    return t.select("vec_id", *[r(F.col(c)).alias(c) for c in "xyz"])


@query("point_drop_z", D.with_sql("pt") + " SELECT DISTINCT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM pt")
def point_drop_z(spark, sf_dir):
    return D.points3d(spark, sf_dir).drop("z").select("vec_id", r(F.col("x")).alias("x"), r(F.col("y")).alias("y")).distinct()


AREA = """, c AS (SELECT ring, i, x - avg(x) OVER (PARTITION BY ring) AS x, y - avg(y) OVER (PARTITION BY ring) AS y FROM star),
  n AS (SELECT ring, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM c WINDOW w AS (PARTITION BY ring ORDER BY i)), area AS (SELECT ring, 0.5 * sum(x * ny - nx * y) AS a FROM n GROUP BY ring)"""


@query("ring_signed_area", D.with_sql("star") + AREA + " SELECT ring, round(a, 3) AS signed_area FROM area")
def ring_signed_area(spark, sf_dir):
    return L.signed_area(D.stars(spark, sf_dir), "ring").select("ring", r(F.col("signed_area"), 3).alias("signed_area"))


@query("ring_perimeter", STAR + " SELECT k AS ring, round(sum(sl), 3) AS perimeter, count(*) + 1 AS vertices FROM seg GROUP BY k")
def ring_perimeter(spark, sf_dir):
    return L.length(D.stars(spark, sf_dir), "ring").select("ring", r(F.col("length"), 3).alias("perimeter"), "vertices")


def _holed(spark, sf_dir):
    """Each star ring with itself at a third of its size as a hole."""
    s = D.stars(spark, sf_dir).withColumnRenamed("ring", "poly_id").withColumn("ring", F.lit(0))
    mean = s.filter("i > 0").groupBy("poly_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    hole = s.join(mean, "poly_id").select("poly_id", "i", (F.col("mx") + (F.col("x") - F.col("mx")) / 3).alias("x"), (F.col("my") + (F.col("y") - F.col("my")) / 3).alias("y"), F.lit(1).alias("ring"))
    return s.select("poly_id", "i", "x", "y", "ring").unionByName(hole)


@query("polygon_area", D.with_sql("star") + AREA + " SELECT ring AS poly_id, round(abs(a) - abs(a) / 9, 2) AS area, round(abs(a) + abs(a) / 9, 2) AS area_ring_sum FROM area")
def polygon_area(spark, sf_dir):
    return L.polygon_area(_holed(spark, sf_dir), "poly_id").select("poly_id", r(F.col("area"), 2).alias("area"), r(F.col("area_ring_sum"), 2).alias("area_ring_sum"))


GRID = "grid AS (SELECT a * 40 + b AS point, a * 1.337 + 0.731 AS px, 900.0 + b * 29.417 AS py FROM range(0, 40) p(a), range(0, 40) q(b))"


def _grid(spark):
    """As the SQL's decimals, each rounded to a double once: a sum of rounded products can fall on the other side of a border."""
    at = lambda k, step, first: (k * step + first) / F.lit(1000.0)
    return spark.range(1600).select(F.col("id").alias("point"), at(F.floor(F.col("id") / 40), 1337, 731).alias("px"), at(F.col("id") % 40, 29417, 900000).alias("py"))


PNPOLY = """, crossing AS (SELECT g.point, s.k AS ring, count(*) AS n FROM grid g JOIN seg s ON (s.y > g.py) <> (s.ny > g.py) AND (s.nx - s.x) / (s.ny - s.y) * (g.py - s.y) + s.x > g.px GROUP BY ALL),
  inside AS (SELECT point, ring FROM crossing WHERE n % 2 = 1)"""


@query("point_in_ring", STAR + ", " + GRID + PNPOLY + " SELECT point, ring FROM inside")
def point_in_ring(spark, sf_dir):
    return L.points_in_rings(_grid(spark), D.stars(spark, sf_dir), "ring", "point")


HOLED = D.with_sql("star") + """, mean AS (SELECT ring, avg(x) AS mx, avg(y) AS my FROM star WHERE i > 0 GROUP BY ring),
  rings AS (SELECT ring || '/0' AS rk, i, x, y FROM star UNION ALL SELECT s.ring || '/1', i, mx + (x - mx) / 3, my + (y - my) / 3 FROM star s JOIN mean m USING (ring)), """ + SEG.format(k="rk", t="rings") + ", " + GRID


@query("polygon_contains", HOLED + PNPOLY + """ SELECT a.point, left(a.ring, length(a.ring) - 2) AS poly_id FROM inside a WHERE right(a.ring, 2) = '/0'
  AND NOT EXISTS (SELECT 1 FROM inside b WHERE b.point = a.point AND b.ring = left(a.ring, length(a.ring) - 2) || '/1')""")
def polygon_contains(spark, sf_dir):
    return L.polygon_contains(_grid(spark), _holed(spark, sf_dir), "poly_id", "point")


@query("multi_collect", D.with_sql("oline") + " SELECT l_orderkey, count(*) AS members, round(arg_min(x, i), 6) AS first_x, round(arg_max(y, i), 6) AS last_y FROM oline GROUP BY l_orderkey")
def multi_collect(spark, sf_dir):
    m = L.collect(D.order_lines(spark, sf_dir), "l_orderkey")
    return m.select("l_orderkey", F.size("line").cast("long").alias("members"), r(F.col("line")[0]["x"]).alias("first_x"), r(F.element_at("line", -1)["y"]).alias("last_y"))


@query("multi_explode", D.with_sql("oline") + " SELECT l_orderkey, i, x, y FROM oline")
def multi_explode(spark, sf_dir):
    return L.explode(L.collect(D.order_lines(spark, sf_dir), "l_orderkey"), "l_orderkey").select("l_orderkey", "i", "x", "y")


@query("multi_edit", D.with_sql("oline") + """ SELECT l_orderkey, count(*) AS members, round(arg_max(x, i), 6) AS first_of_reversed, count(*) FILTER (x > 25) AS over_25,
  least(count(*), 2) AS slice_len, count(*) + 1 AS appended FROM oline GROUP BY l_orderkey""")
def multi_edit(spark, sf_dir):
    """List algebra of multi-part geometries: reverse, filter, slice, insert."""
    m = L.collect(D.order_lines(spark, sf_dir), "l_orderkey")
    return m.select(
        "l_orderkey", F.size("line").cast("long").alias("members"), r(F.reverse("line")[0]["x"]).alias("first_of_reversed"),
        F.size(F.filter("line", lambda p: p["x"] > 25)).cast("long").alias("over_25"), F.size(F.slice("line", 1, 2)).cast("long").alias("slice_len"),
        F.size(F.array_insert("line", 1, F.col("line")[0])).cast("long").alias("appended"),
    )


@query("geom_wkb", OLINE + """ SELECT o.l_orderkey, upper(left(h, 18)) AS head, CAST(9 + 16 * n AS BIGINT) AS bytes, round(coalesce(l, 0), 4) AS length FROM
  (SELECT l_orderkey, count(*) AS n, '0102000000' || lpad(printf('%02x', count(*)), 2, '0') || '000000' AS h FROM oline GROUP BY l_orderkey) o LEFT JOIN (SELECT k, sum(sl) AS l FROM seg GROUP BY k) s ON s.k = o.l_orderkey""")
def geom_wkb(spark, sf_dir):
    """Lines written as WKB and measured again from it."""
    from geoskein.functions import codec as C

    m = L.collect(D.order_lines(spark, sf_dir), "l_orderkey").select("l_orderkey", C.line_wkb(F.col("line")).alias("wkb"))
    return m.select("l_orderkey", F.substring(F.hex("wkb"), 1, 18).alias("head"), F.length("wkb").cast("long").alias("bytes"), r(C.wkb_length(F.col("wkb")), 4).alias("length"))


@query("schema_infer", """SELECT 'l_orderkey' AS field, count(l_orderkey) AS n, count(*) - count(l_orderkey) AS nulls, CAST(min(l_orderkey) AS DOUBLE) AS least, CAST(max(l_orderkey) AS DOUBLE) AS most, CAST(NULL AS BIGINT) AS width FROM lineitem
  UNION ALL SELECT 'l_linenumber', count(l_linenumber), count(*) - count(l_linenumber), min(l_linenumber), max(l_linenumber), NULL FROM lineitem
  UNION ALL SELECT 'l_quantity', count(l_quantity), count(*) - count(l_quantity), min(l_quantity), max(l_quantity), NULL FROM lineitem
  UNION ALL SELECT 'l_returnflag', count(l_returnflag), count(*) - count(l_returnflag), NULL, NULL, max(length(l_returnflag)) FROM lineitem""")
def schema_infer(spark, sf_dir):
    from geoskein.plans import schema as M

    return M.profile(D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")).drop("low", "high")


def _dealt(df):
    """Over a given number of partitions, which a small file of few row groups doesn't have and which aren't coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns[:1])


@query("point_codec", """SELECT s_suppkey, 'Point Z' AS kind, 'Point Z (' || s_suppkey || ' ' || s_nationkey || ' 7)' AS wkt, CAST(s_suppkey AS DOUBLE) AS x, CAST(s_nationkey AS DOUBLE) AS y, 7.0::DOUBLE AS z,
  '01E9030000' AS head, '0101000080' AS extended_head FROM supplier""")
def point_codec(spark, sf_dir):
    """Points to WKB from coordinates, from text and in the extended form, and back."""
    s = _dealt(D.table(spark, sf_dir, "supplier")).select("s_suppkey", F.col("s_suppkey").cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    s = s.withColumn("wkb", C.wkb_of("Point", F.array("x", "y", F.lit(7.0))))
    s = s.withColumn("again", C.wkb_of_wkt(F.concat(F.lit("point z("), F.col("x"), F.lit(" "), F.col("y"), F.lit(" 7.0)")))).withColumn("ext", C.ewkb(F.col("wkb")))
    p = F.element_at(C.wkb_vertices(F.when(F.col("wkb") == F.col("again"), C.ewkb(F.col("ext"), False))), 1)
    s = s.withColumn("p", p)
    head = lambda c: F.substring(F.hex(c), 1, 10)
    return s.select("s_suppkey", C.wkb_type(F.col("ext")).alias("kind"), C.wkt_of_wkb(F.col("ext")).alias("wkt"), "p.x", "p.y", "p.z", head("wkb").alias("head"), head("ext").alias("extended_head"))


@query("polygon_codec", """SELECT p_partkey, 'Polygon' AS kind, 'Polygon ((0 0, ' || n || ' 0, ' || n || ' ' || n || ', 0 0), (1 1, 2 1, 2 2, 1 1))' AS wkt, CAST(8 AS BIGINT) AS vertices, CAST(2 AS BIGINT) AS rings, round(n * n / 2.0 - 0.5, 3) AS area
  FROM (SELECT p_partkey, p_size + 4 AS n FROM part)""")
def polygon_codec(spark, sf_dir):
    """Polygons with a hole read from text, by way of the extended form, and their areas from the vertices."""
    n = (F.col("p_size") + 4).cast("string")
    text = F.concat(F.lit("POLYGON((0 0,"), n, F.lit(" 0,"), n, F.lit(" "), n, F.lit(",0 0),(1 1,2 1,2 2,1 1))"))
    # the table is of few bytes and much work: dealt out before the texts are read, each of them once
    part = _dealt(D.table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    p = part.select("p_partkey", C.ewkb(C.wkb_of_wkt(text)).alias("g"))
    p = p.select("p_partkey", C.wkb_type(F.col("g")).alias("kind"), C.wkt_of_wkb(F.col("g")).alias("wkt"), C.wkb_vertices(F.col("g")).alias("v"))
    rings = F.size(F.array_distinct(F.transform("v", lambda q: q["ring"])))
    return p.select("p_partkey", "kind", "wkt", F.size("v").cast("long").alias("vertices"), rings.cast("long").alias("rings"), F.round(L.listed_polygon_area(F.col("v")), 3).alias("area"))


@query("multi_codec", """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'MultiPoint' WHEN 1 THEN 'MultiLineString' ELSE 'MultiPolygon' END AS kind,
  CASE n_nationkey % 3 WHEN 0 THEN 'MultiPoint ((0 0), (' || n_nationkey || ' 1))' WHEN 1 THEN 'MultiLineString ((0 0, ' || n_nationkey || ' 1), (2 2, 3 3))'
    ELSE 'MultiPolygon (((0 0, ' || n_nationkey || ' 0, 0 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))' END AS wkt,
  CAST(2 AS BIGINT) AS parts, CAST(CASE n_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END AS BIGINT) AS vertices FROM nation""")
def multi_codec(spark, sf_dir):
    """Geometries of several parts read from text in its variants, by way of the extended form."""
    k = F.col("n_nationkey").cast("string")
    point, line = F.concat(F.lit("MULTIPOINT(0 0, "), k, F.lit(" 1)")), F.concat(F.lit("multilinestring ((0 0,"), k, F.lit(" 1),(2 2,3 3))"))
    polygon = F.concat(F.lit("MultiPolygon(((0 0,"), k, F.lit(" 0,0 1,0 0)),((5 5,6 5,6 6,5 5)))"))
    turn = F.col("n_nationkey") % 3
    n = D.table(spark, sf_dir, "nation").select("n_nationkey", C.ewkb(C.wkb_of_wkt(F.when(turn == 0, point).when(turn == 1, line).otherwise(polygon))).alias("g"))
    n = n.select("n_nationkey", C.wkb_type(F.col("g")).alias("kind"), C.wkt_of_wkb(F.col("g")).alias("wkt"), C.wkb_vertices(F.col("g")).alias("v"))
    return n.select("n_nationkey", "kind", "wkt", F.size(F.array_distinct(F.transform("v", lambda q: q["part"]))).cast("long").alias("parts"), F.size("v").cast("long").alias("vertices"))
