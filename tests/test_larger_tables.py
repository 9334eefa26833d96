"""What went wrong on other rows or on larger tables than those of the other tests."""

import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoskein.functions import codec as C
from geoskein.kernel import skeleton as S
from geoskein.kernel import voronoi as V
from geoskein.operators import lines as L
from geoskein.plans import geometry as P


def rectangle(poly_id, ring, low, high):
    corners = [(low, 0.0), (high, 0.0), (high, 3000.0), (low, 3000.0), (low, 0.0)]
    return [(poly_id, ring, i, x, y) for i, (x, y) in enumerate(corners)]


def test_grid_is_that_of_the_sql(spark):
    want = duckdb.sql("WITH " + P.GRID + " SELECT point, px::DOUBLE AS px, py::DOUBLE AS py FROM grid").fetchall()
    assert sorted(tuple(r) for r in P._grid(spark).collect()) == sorted(want)


def test_points_on_a_border_in_ring(spark):
    borders = sorted({(a * 1337 + 731) / 1000 for a in range(40)})
    v = spark.createDataFrame([r for k, x in enumerate(borders) for r in rectangle(str(k), 0, -5.0, x)], "k string, ring int, i long, x double, y double").drop("ring")
    got = {(r.point, r.k) for r in L.points_in_rings(P._grid(spark), v, "k", "point").collect()}
    # a border counts only where it lies beyond the point
    assert got == {(a * 40 + b, str(k)) for k in range(40) for a in range(k) for b in range(40)}


def test_points_on_the_border_of_a_hole(spark):
    holes = [(a * 1337 + 731) / 1000 for a in range(40)]
    rows = [r for k, x in enumerate(holes) for r in rectangle(str(k), 0, -5.0, 60.0) + rectangle(str(k), 1, -1.0, x)]
    v = spark.createDataFrame(rows, "poly_id string, ring int, i long, x double, y double")
    got = {(r.point, r.poly_id) for r in L.polygon_contains(P._grid(spark), v, "poly_id", "point").collect()}
    assert got == {(a * 40 + b, str(k)) for k in range(40) for a in range(k, 40) for b in range(40)}


def rough_circle(n, hole=True):
    r = np.random.default_rng(n).integers(1, 51, n) / 50 + n / 20
    a = np.arange(n) * 2 * np.pi / n
    p = np.stack([r * np.cos(a), r * np.sin(a)], axis=1)
    out = [np.vstack([p, p[:1]])]
    if hole:
        q = np.array([[0.0, 0.0], [3.0, 0.5], [1.0, 4.0], [0.0, 0.0]]) * n / 1500 + [n / 40, 0.0]
        out.append(q)
    return out


def counted(monkeypatch, name):
    calls, own = [], getattr(S.Partition, name)
    monkeypatch.setattr(S.Partition, name, lambda self, *a: (calls.append(a), own(self, *a))[1])
    return calls


@pytest.mark.parametrize("n", [30, 90, 200])
def test_trunk_is_the_longest_of_all_shortest_paths(n):
    rings = rough_circle(n)
    out = S.skeletonize(rings, S.Options(0.1, tails=False))
    p = S.Partition(out.graph, out.edges, out.loops)
    assert len(p.edges) > len(p.degree) - 1  # with rings
    stubs = p.stubs()
    _, a, b = min((-best[v], u, v) for u in stubs for best in [p.tree(u)[0]] for v in stubs if v > u and v in best)
    trunk = out.partition.lines[0]
    assert trunk.kind == "trunk" and (trunk.chain[0], trunk.chain[-1]) == (a, b)


def test_trunk_looks_from_few_ends(monkeypatch):
    """with any ring it looked from every stub, so that time grew with the square of a polygon's vertices."""
    n = 300
    xy = [(float(k), 0.0) for k in range(n)] + [(float(k), 0.5) for k in range(n)] + [(100.5, 0.001)]
    pairs = [(k, k + 1) for k in range(n - 1)] + [(k, n + k) for k in range(n)] + [(100, 2 * n), (2 * n, 101)]
    g = S.Graph(np.array(xy), np.array(pairs))
    p = S.Partition(g, [S.Edge([a, b], g.length([a, b])) for a, b in pairs], [])
    trees = counted(monkeypatch, "tree")
    assert p.trunk() and len(trees) < 20
    assert p.lines[0].chain == [n, *range(n), 2 * n - 1]


def test_a_region_is_looked_at_once_for_nodes(monkeypatch):
    """each branch was followed by a look at all regions."""
    looks = counted(monkeypatch, "candidates")
    out = S.skeletonize(rough_circle(600), S.Options(0.1, tails=False))
    assert len(looks) <= out.partition.count


def test_points_meet_edges_of_their_height_only():
    """every point met every edge. The same points are inside as by the plain rule."""
    rings = rough_circle(300)
    points = np.random.default_rng(0).uniform(-18, 18, size=(3000, 2))
    points[:300] = rings[0][:300] + [0.25, 0.0]  # at the heights of vertices
    old = np.zeros(len(points), bool)
    for k, r in enumerate(rings):
        x0, y0, x1, y1 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
        px, py = points[:, :1], points[:, 1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            odd = (((y0 > py) != (y1 > py)) & ((x1 - x0) / (y1 - y0) * (py - y0) + x0 > px)).sum(axis=1) % 2 == 1
        old = odd if k == 0 else old & ~odd
    assert (V.inside_rings(points, rings) == old).all()
    before, V.PAIRS = V.PAIRS, 100
    try:
        assert (V.inside_rings(points, rings) == old).all()
    finally:
        V.PAIRS = before


def test_polygon_codec_reads_each_text_once(spark, tmp_path):
    """texts were read three times, by tasks as few as the file's row groups, and vertices met in joins and windows."""
    plan = P.polygon_codec(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and "Window" not in plan
    assert P.polygon_codec(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_area_of_listed_vertices(spark):
    rings = {"a": [rectangle("a", 0, 0.0, 9.0), rectangle("a", 1, 1.0, 2.5)], "b": [rectangle("b", 0, 5.0, 5.25)], "c": [[("c", 0, 0, 1.0, 1.0)]]}
    v = spark.createDataFrame([q for k in rings for r in rings[k] for q in r], "poly_id string, ring int, i long, x double, y double")
    want = {r.poly_id: r.area for r in L.polygon_area(v, "poly_id").collect()}
    rows = spark.createDataFrame([(k, [(q[1], q[3], q[4]) for r in own for q in r]) for k, own in rings.items()], "k string, v array<struct<ring:int,x:double,y:double>>")
    got = {r.k: r.area for r in rows.select("k", L.listed_polygon_area(F.col("v")).alias("area")).collect()}
    assert got["a"] == pytest.approx(want["a"], rel=1e-12) == 22500 and got["b"] == pytest.approx(want["b"], rel=1e-12) and got["c"] == 0


def test_wkb_of_batches(spark):
    """F8: lines were written and measured one by one."""
    r = np.random.default_rng(5)
    lines = [r.normal(size=(n, 2)) * 1e3 for n in (0, 1, 2, 3, 13, 255, 257, 300, 1000)]
    rows = [(k, [tuple(map(float, p)) for p in line]) for k, line in enumerate(lines)]
    for axes, wide in ((("x", "y"), rows), (("x", "y", "z"), [(k, [(*p, 7.0) for p in line]) for k, line in rows])):
        df = spark.createDataFrame(wide, "k int, line array<struct<" + ",".join(f"{a}:double" for a in axes) + ">>").coalesce(1)
        got = df.select("k", C.line_wkb(F.col("line")).alias("wkb")).withColumn("length", C.wkb_length(F.col("wkb"))).collect()
        for k, wkb, length in got:
            want = C.to_wkb({"type": "LineString", "z": len(axes) == 3 and len(wide[k][1]) > 0, "coords": wide[k][1]})
            assert bytes(wkb) == want and length == pytest.approx(sum(math.dist(a[:2], b[:2]) for a, b in zip(wide[k][1], wide[k][1][1:])), rel=1e-14)
    square = [[(0.0, 0.0), (3.0, 0.0), (3.0, 4.0), (0.0, 0.0)]]
    big = b"\x00" + struct.pack(">II4d", 2, 2, 0.0, 0.0, 3.0, 4.0)
    line_z = {"type": "LineString", "z": True, "coords": [(0.0, 0.0, 1.0), (3.0, 4.0, 9.0)]}
    mixed = [C.to_wkb({"type": "Polygon", "z": False, "coords": square}), big, C.to_wkb(line_z, True), C.to_wkb(line_z), C.to_wkb({"type": "Point", "z": False, "coords": (1.0, 2.0)})]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(mixed)], "k int, b binary").coalesce(1)
    assert [x.l for x in df.select("k", C.wkb_length(F.col("b")).alias("l")).orderBy("k").collect()] == [12.0, 5.0, 5.0, 5.0, 0.0]
