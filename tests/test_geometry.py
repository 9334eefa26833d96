import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoskein.functions import arrays as A
from geoskein.functions import codec as C
from geoskein.kernel import skeleton as S
from geoskein.kernel import voronoi as V
from geoskein.operators import graph as G
from geoskein.operators import lines as L
from geoskein.operators import skeleton as K
from geoskein.plans import schema as M
from geoskein.sources.derived import T_RING

T_ARRAY = np.array(T_RING)


def vertex_rows(spark, lines):
    return spark.createDataFrame([(k, i, float(x), float(y)) for k, pts in lines.items() for i, (x, y) in enumerate(pts)], "k string, i long, x double, y double")


def test_distance_and_lengths(spark):
    v = vertex_rows(spark, {"a": [(0, 0), (3, 4), (3, 10)], "b": [(1, 1)]})
    got = {r.k: (r.vertices, r.length) for r in L.length(v, "k").collect()}
    assert got == {"a": (3, 11.0), "b": (1, 0.0)}
    with pytest.raises(TypeError):
        L.distance({"x": F.lit(0)}, {"x": F.lit(0), "y": F.lit(0)})


def test_interpolation_and_sampling(spark):
    v = vertex_rows(spark, {"a": [(0, 0), (10, 0), (10, 5)]})
    d = spark.createDataFrame([("a", x) for x in (0.0, 4.0, 10.0, 15.0)], "k string, d double")
    got = {r.d: (r.segment, r.x, r.y) for r in L.interpolate(v, d, "k").collect()}
    assert got == {0.0: (0, 0, 0), 4.0: (0, 4, 0), 10.0: (0, 10, 0), 15.0: (1, 10, 5)}
    assert sorted(r.d for r in L.sample_normalized(v, "k", 0.4).collect()) == [0.0, 0.4, 0.8]
    assert sorted(r.d for r in L.sample_distances(v, "k", 5.0).collect()) == [0.0, 5.0, 10.0]
    assert sorted(r.d for r in L.sample_distances(v, "k", 10.0, vertices=True).collect()) == [0.0, 10.0, 10.0, 15.0]
    with pytest.raises(Exception, match="off the line"):
        L.interpolate(v, spark.createDataFrame([("a", 16.0)], "k string, d double"), "k").collect()


def test_areas(spark):
    square = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    v = vertex_rows(spark, {"s": square, "r": square[::-1]})
    assert {r.k: r.signed_area for r in L.signed_area(v, "k").collect()} == {"s": 1.0, "r": -1.0}


def test_array_helpers(spark):
    df = spark.createDataFrame([([0, 1, 2, 3], [0, 100, 20])], "a array<long>, c array<long>")
    r = df.select(A.slide_pairwise("a").alias("p"), A.counts_to_last_index(F.col("c")).alias("l"), A.upper_pairs(F.lit(3)).alias("u"), A.moving_mean2("a").alias("m")).first()
    assert [(x.first, x.second) for x in r.p] == [(0, 1), (1, 2), (2, 3)] and r.l == [-1, 99, 119]
    assert [(x.i, x.j) for x in r.u] == [(0, 1), (0, 2), (1, 2)] and r.m == [0.5, 1.5, 2.5]


GEOMETRIES = [
    {"type": "Point", "z": False, "coords": (1.0, 2.5)}, {"type": "LineString", "z": True, "coords": [(0.0, 0.0, 1.0), (1.0, 2.0, 3.0)]},
    {"type": "Polygon", "z": False, "coords": [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]},
    {"type": "MultiPoint", "z": False, "coords": [(1.0, 2.0), (3.0, 0.1)]}, {"type": "MultiLineString", "z": False, "coords": [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]]},
    {"type": "MultiPolygon", "z": True, "coords": [[[(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (0.0, 0.0, 0.0)]]]},
]


@pytest.mark.parametrize("g", GEOMETRIES, ids=lambda g: g["type"])
def test_codecs_round_trip(g):
    assert C.from_wkb(C.to_wkb(g)) == g and C.from_wkb(C.to_wkb(g, extended=True)) == g and C.from_wkt(C.to_wkt(g)) == g
    if g["type"].startswith("Multi") and len(g["coords"]) == 1:
        assert C.coerce(C.coerce(g, False), True) == g


def test_codec_texts():
    assert C.to_wkt(GEOMETRIES[0]) == "Point (1 2.5)" and C.to_wkb(GEOMETRIES[0]).hex()[:10] == "0101000000"
    with pytest.raises(TypeError):
        C.from_wkb(b"\x01\x63\x00\x00\x00")


def test_schema_algebra(spark):
    from pyspark.sql import types as T

    a = T.StructType([M.field("n", T.ShortType(), False), M.field("s", T.StringType(), True, 5)])
    b = T.StructType([M.field("n", T.LongType()), M.field("d", T.DateType())])
    with pytest.raises(TypeError):
        M.union(a, b)
    u = M.union(a, b, promoting=True)
    assert u.names == ["n", "s", "d"] and u["n"].dataType == T.LongType() and u["n"].nullable
    assert M.intersection(a, b, promoting=True).names == ["n"] and M.difference(a, b).names == ["s"] and M.symmetric_difference(a, b).names == ["s", "d"]
    assert M.order_by(u, ["d", "n", "s"]).names == ["d", "n", "s"]
    with pytest.raises(ValueError):
        M.order_by(u, ["x"], ignore_missing=True)
    df = spark.createDataFrame([(1, "ab", None), (300, "abcd", None)], "n long, s string, z string")
    schema, empty = M.infer(df)
    assert schema["n"].dataType == T.ShortType() and M.width(schema["s"]) == 4 and empty == ["z"] and not schema["n"].nullable
    assert M.read_settings("'''x = 1'''\na = [1, 2]  # c\n# b = 2\nc = 'q'\n") == {"a": [1, 2], "c": "q"}
    assert M.validate_option("min_relief_5%", ("NONE", "MIN_RELIEF_#")) == "MIN_RELIEF_5%"


def test_voronoi_ridges_are_equidistant():
    p = np.random.default_rng(4).random((300, 2))
    d = V.voronoi(p)
    fin = d.ridges[(d.ridges[:, 2:] >= 0).all(axis=1)]
    for s1, s2, a, b in fin[::7].tolist():
        for v in (a, b):
            x = np.linalg.norm(d.vertices[v] - p[[s1, s2]], axis=1)
            assert x[0] == pytest.approx(x[1], abs=1e-6)
            assert np.linalg.norm(p - d.vertices[v], axis=1).min() >= x[0] - 1e-6
    assert len(d.triangles) == 2 * len(p) - 2 - len({k for r in d.ridges[(d.ridges[:, 2:] < 0).any(axis=1)] for k in r[:2]})


def test_grid_has_hyperhubs_cracked_to_hubs():
    x, y = np.meshgrid(np.arange(5.0), np.arange(5.0))
    d = V.voronoi(np.stack([x.ravel(), y.ravel()], axis=1))
    assert len(d.vertices) == 16
    g = S.Graph(d.vertices, d.ridges[(d.ridges[:, 2:] >= 0).all(axis=1)][:, 2:])
    assert max(map(len, g.near.values())) <= 3


@pytest.mark.parametrize("mode", S.MODES)
def test_partition_invariants(mode):
    out = S.skeletonize([T_ARRAY], S.Options(0.2, mode=mode))
    assert out.status == "ok" and [x.kind for x in out.partition.lines][0] == "trunk"
    total = sum(e.length for e in out.edges) + sum(e.length for e in out.loops)
    assert sum(x.length for x in out.partition.lines) == pytest.approx(total)
    assert len([x for x in out.partition.lines if x.kind == "branch"]) == len(out.partition.stubs()) - 2
    assert not any(out.partition.free.values())
    for x in out.partition.lines:
        assert x.kind != "branch" or out.partition.degree[x.stem] == 3


def test_skeleton_of_a_ring_has_a_loop_around_its_hole():
    square, hole = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float), np.array([[4, 4], [4, 6], [6, 6], [6, 4], [4, 4]], float)
    out = S.skeletonize([square, hole], S.Options(0.4, min_normalized_length=3))
    kinds = {x.kind for x in out.partition.lines}
    assert out.status == "ok" and kinds & {"bridge", "loop"}


def holed(holes):
    """A rough disc with holes."""
    r = np.random.default_rng(3)
    angle = np.arange(60) * 2 * math.pi / 60
    size = 10 + 2 * r.random(60)
    disc = np.stack([size * np.cos(angle), size * np.sin(angle)], axis=1)
    at = [(x, y) for x in (-4.0, 0.3, 4.2) for y in (-4.1, 0.0, 4.0)][:holes]
    ring = np.array([[0, 0], [0, 1.3], [1.1, 1.2], [1.2, 0], [0, 0]])
    return [np.vstack([disc, disc[:1]]), *[ring * (0.6 + 0.2 * k) + p for k, p in enumerate(at)]]


def test_modes_differ():
    made, lengths = {}, {}
    for mode in S.MODES:
        out = S.skeletonize(holed(6), S.Options(0.3, mode=mode))
        made[mode] = sorted((x.kind, x.chain) for x in out.partition.lines)
        lengths[mode] = {k: sum(x.length for x in out.partition.lines if x.kind == k) for k in ("branch", "bridge")}
        assert out.status == "ok" and sum(x.length for x in out.partition.lines) == pytest.approx(sum(e.length for e in [*out.edges, *out.loops]))
    assert made["MAX_BRIDGE"] == made["MAX_BRIDGE_MAX_BRANCH"]
    assert len({str(x) for x in made.values()}) == 5
    assert min(lengths[m]["bridge"] for m in S.MODES[:3]) > max(lengths[m]["bridge"] for m in S.MODES[3:])
    longest = lambda mode, kind: max(len(c) for k, c in made[mode] if k == kind)
    assert longest("MAX_BRANCH", "branch") >= longest("PREFER_BRANCH", "branch")


@pytest.mark.parametrize("mode", S.MODES)
def test_pruned_by_the_lengths_that_are_reported(mode):
    """What pruning leaves is at the cutoff or above, and what it takes is below or hung on what it took."""
    for holes, cut in ((0, 1.1), (3, 1.15)):
        rings = holed(holes)
        whole = S.skeletonize(rings, S.Options(0.3, mode=mode)).partition
        some = S.skeletonize(rings, S.Options(0.3, mode=mode, min_normalized_length=cut)).partition
        left = [x for x in some.lines if x.kind == "branch"]
        assert left and all(some.norm_length(x) >= cut for x in left)
        assert {v for x in left for v in x.tails} == {x.stub for x in left if some.tail_of(x.stub) is not None}
        if not holes:
            chains = {tuple(x.chain) for x in left}
            gone = [x for x in whole.lines if x.kind == "branch" and tuple(x.chain) not in chains]
            lost = {v for x in gone for v in x.chain}
            assert all(whole.norm_length(x) < cut or x.stem in lost for x in gone)


def test_trunk_of_a_tree_is_its_longest_path():
    for seed in range(4):
        r = np.random.default_rng(seed)
        angle, size = np.arange(40) * 2 * math.pi / 40, 5 + 3 * r.random(40)
        disc = np.stack([size * np.cos(angle), size * np.sin(angle)], axis=1)
        p = S.skeletonize([np.vstack([disc, disc[:1]])], S.Options(0.3)).partition
        whole = S.Partition(p.g, p.edges, p.loops)
        assert p.lines[0].length == pytest.approx(max(d for a in whole.stubs() for v, d in whole.tree(a)[0].items() if v in whole.stubs()))


def test_limits_of_kinds():
    rings = holed(4)
    kinds = lambda **o: {x.kind for x in S.skeletonize(rings, S.Options(0.3, **o)).partition.lines}
    assert kinds() == {"trunk", "branch", "bridge"}
    assert kinds(shortest_branch=-1) == {"trunk", "bridge"} and kinds(shortest_bridge=-1) == {"trunk", "branch"}
    assert kinds(mode="PREFER_BRANCH", shortest_branch=-1) == {"trunk", "bridge"}
    few = S.skeletonize(rings, S.Options(0.3, max_branch_count=2)).partition.lines
    assert sum(x.kind == "branch" for x in few) == 2
    long = S.skeletonize(rings, S.Options(0.3, shortest_branch=2.0)).partition.lines
    assert all(x.length >= 2 for x in long if x.kind == "branch")


def test_cross_by_hand():
    """A plus of arms of width 2: the trunk runs through two of them, each other is a branch from the centre."""
    plus = np.array([(-1, -1), (-1, -9), (1, -9), (1, -1), (7, -1), (7, 1), (1, 1), (1, 6), (-1, 6), (-1, 1), (-8, 1), (-8, -1), (-1, -1)], float)
    lines = S.skeletonize([plus], S.Options(0.05, min_normalized_length=4.0)).partition.lines
    ends = {"N": (0, 6), "S": (0, -9), "E": (7, 0), "W": (-8, 0)}
    # the four arms meet in one point, cracked into nodes that lines of no length join
    assert sorted(x.kind for x in lines if x.length > 0.1) == ["branch", "branch", "trunk"]
    p = S.skeletonize([plus], S.Options(0.05, min_normalized_length=4.0)).partition
    trunk = next(x for x in p.lines if x.kind == "trunk")
    # corner tips run at 45 degrees from one unit before an arm's end: sqrt(2) there for 1 along the arm
    assert trunk.length == pytest.approx(9 + 8 - 2 + 2 * math.sqrt(2), abs=0.3)
    got = sorted(x.length for x in p.lines if x.kind == "branch")
    assert got == pytest.approx([6 - 1 + math.sqrt(2), 7 - 1 + math.sqrt(2)], abs=0.3)
    assert all(np.hypot(*p.g.xy[x.stem]) < 0.6 for x in p.lines if x.kind == "branch") and len(ends) == 4
    for x in p.lines:
        if x.kind == "branch":
            # the inner corners are sqrt(2) from the centre
            assert 2 * p.half_width[p.g.origin[x.stem]] == pytest.approx(2 * math.sqrt(2), abs=0.15)


def test_trunk_modes():
    plus = np.array([(-1, -1, 0), (-1, -9, 0), (1, -9, 0), (1, -1, 3), (7, -1, 9), (7, 1, 9), (1, 1, 3), (1, 6, 4), (-1, 6, 4), (-1, 1, 3), (-8, 1, 2), (-8, -1, 2), (-1, -1, 0)], float)
    at = lambda mode, **o: sorted(tuple(np.round(np.array(p.g.xy[v])).astype(int) + 0) for p in [S.skeletonize([plus], S.Options(0.1, trunk_mode=mode, **o)).partition] for v in (p.lines[0].chain[0], p.lines[0].chain[-1]))
    arm = lambda xy: "N" if xy[1] >= 5 else "S" if xy[1] <= -8 else "E" if xy[0] >= 6 else "W" if xy[0] <= -7 else "?"
    arms = lambda *a, **o: {arm(xy) for xy in at(*a, **o)}
    assert arms("DEFAULT") == {"S", "W"} and arms("euclidean") == {"N", "S"} or arms("EUCLIDEAN") == {"E", "W"}
    assert arms("NEAR_0_6") == {"N", "S"} and arms("NEAR_7_0_AND_0_6.5") == {"E", "N"}
    assert arms("HIGH_LOW") == {"E", "S"} and arms("MIN_RELIEF_8") == {"E", "S"} and arms("MIN_RELIEF_95%") == {"E", "S"}
    assert arms("MIN_EUCLIDEAN_14.9") in ({"N", "S"}, {"E", "W"}) and "E" in arms("EUCLIDEAN3D")
    for mode in ("EUCLIDEAN4D", "NEAR_1", "", "MIN_RELIEF_x"):
        with pytest.raises(ValueError, match="unknown trunk mode"):
            S.check(S.Options(0.1, trunk_mode=mode))
    with pytest.raises(ValueError, match="one trunk"):
        S.check(S.Options(0.1, trunk_mode="HIGH_LOW", max_trunk_count=2))
    assert S.skeletonize([plus], S.Options(0.1, trunk_mode="MIN_EUCLIDEAN_99")).status == "no path meets the trunk mode"
    assert S.isolation_flags("cut_NAIVE") == {"cut": True, "naive": True}
    with pytest.raises(ValueError):
        S.isolation_flags("CUT_ME")


def test_bad_polygons_have_a_status(spark):
    good = [(0, i, x, y, 1.0) for i, (x, y) in enumerate(T_RING)]
    bad = {
        "one": [(0, 0, 1.0, 1.0, 0.0)], "nan": [(0, i, float("nan") if i == 3 else x, y, 1.0) for i, (x, y) in enumerate(T_RING)], "open": good[:-1], "flat": [(0, i, 1.0, 1.0, 0.0) for i in range(5)],
        "hole": [*good, (1, 0, 2.0, 1.0, 0.0)], "null": [(0, i, None if i == 2 else x, y, 1.0) for i, (x, y) in enumerate(T_RING)],
    }
    rows = [(k, *r) for k, own in (bad | {"good": good}).items() for r in own]
    v = spark.createDataFrame(rows, "poly_id string, ring int, i long, x double, y double, z double")
    out = K.skeletonize(v, 0.2, min_normalized_length=3.0)
    status = {r.poly_id: r.status for r in out.status().collect()}
    assert status.pop("good") == "ok" and len(status) == len(bad) and all(s.startswith("failed: ") for s in status.values())
    assert {r.poly_id for r in out.lines().collect()} == {"good"}
    low = K.skeletonize(v.drop("z"), 0.2, trunk_mode="HIGH_LOW").status().collect()
    assert all(r.status.startswith("failed: ") for r in low)
    with pytest.raises(ValueError, match="unknown trunk mode"):
        K.skeletonize(v, 0.2, trunk_mode="EUCLIDEAN4D")


def test_line_measures(spark):
    rows = [("p", 0, i, x, y, 2.0 * x) for i, (x, y) in enumerate(T_RING)]
    out = K.skeletonize(spark.createDataFrame(rows, "poly_id string, ring int, i long, x double, y double, z double"), 0.2, min_normalized_length=3.0)
    lines, got = {(r.from_vor, r.to_vor): r for r in out.lines().collect()}, out.measures().collect()
    node = {r.vor_idx: (r.x, r.y) for r in out.nodes().collect()}
    assert len(got) == len(lines) == 2
    for m in got:
        r = lines[m.from_vor, m.to_vor]
        first = next(k for k in range(2) if (r.xs[k], r.ys[k]) == node[r.from_vor])
        xy = list(zip(r.xs, r.ys))[first : first + len(r.vor_idxs)]
        steps = [math.dist(a, b) for a, b in zip(xy, xy[1:])]
        widths = [(a + b) / 2 for a, b in zip(r.widths, r.widths[1:])]
        assert sum(steps) == pytest.approx(r.untailed_length2d) and m.vertex_count == len(r.vor_idxs) == m.segment_count + 1
        assert list(m.segment_widths) == pytest.approx(widths) and m.area == pytest.approx(sum(a * b for a, b in zip(steps, widths)))
        assert m.mean_width == pytest.approx(m.area / r.untailed_length2d) and m.delta_z == pytest.approx(r.zs[-1] - r.zs[0])
        assert m.length3d == pytest.approx(sum(math.hypot(s, a - b) for s, a, b in zip(steps, r.zs, r.zs[1:])))
        if m.kind == "branch":
            assert (m.stem_x, m.stem_y) == node[m.from_vor] and (m.stub_x, m.stub_y) == node[m.to_vor]
            assert r.length2d > r.untailed_length2d and r.norm_length == pytest.approx(2 * r.length2d / r.stem_width)


def test_pruning_and_moves():
    whole = S.skeletonize([T_ARRAY], S.Options(0.2, tails=False)).partition.lines
    none = S.skeletonize([T_ARRAY], S.Options(0.2, tails=False, min_normalized_length=0.0)).partition.lines
    some = S.skeletonize([T_ARRAY], S.Options(0.2, tails=False, min_normalized_length=3.0)).partition.lines
    assert [x.chain for x in whole] == [x.chain for x in none] and len(some) == 2
    moved = S.skeletonize([T_ARRAY + 1000.0], S.Options(0.2, tails=False, min_normalized_length=3.0)).partition.lines
    assert [x.length for x in moved] == pytest.approx([x.length for x in some], rel=1e-3)


def test_many_polygons(spark):
    rows = [(f"p{k}", 0, i, x + 20.0 * k, y) for k in range(4) for i, (x, y) in enumerate(T_RING)] + [("tiny", 0, i, x / 1e3, y / 1e3) for i, (x, y) in enumerate(T_RING)]
    v = spark.createDataFrame(rows, "poly_id string, ring int, i long, x double, y double")
    out = K.skeletonize(v, 0.2, min_normalized_length=3.0)
    status = {r.poly_id: r.status for r in out.status().collect()}
    assert status.pop("tiny") == "too few samples" and set(status.values()) == {"ok"}
    assert {r.poly_id: r["count"] for r in out.lines().groupBy("poly_id").count().collect()} == {f"p{k}": 2 for k in range(4)}
    assert out.nodes("branch_stub").count() == 4 and out.nodes("next_trunk").count() == 8
    refused = K.skeletonize(v, 0.2, max_samples=10)
    assert refused.status().filter("status = 'too many samples'").count() == 4


def test_tree_and_components(spark):
    assert K.binary_tree(spark, 8.0, 0.6, 30.0, 5).count() == 2**6 - 1
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 5.0), (7, 8, 1.0)], "lo long, hi long, cost double")
    assert {r.node: r.component for r in G.components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    p = {r.node: r.cost for r in G.shortest_paths(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert p == {1: 0.0, 2: 1.0, 3: 3.0}
    with pytest.raises(ValueError):
        G.prune(e, "lo", "cost", 1.0, target=0)
    assert K.max_node_count(18e6) == int(0.9 * math.sqrt(1e6))


def test_shapefile(spark, tmp_path):
    from geoskein.sources import shapefile as sf

    rows = [(1.5, 2.5, 7, "one"), (3.0, 4.0, 8, "été")]
    sf.write_points(str(tmp_path / "pts.shp"), rows)
    spark.dataSource.register(sf.ShapefileSource)
    got = spark.read.format("shapefile").load(str(tmp_path / "pts.shp")).collect()
    assert [(*C.from_wkb(bytes(r.geometry))["coords"], r.id, r.name) for r in got] == rows


def test_stream_of_polygons(spark, tmp_path):
    from geoskein.streaming.batches import write_skeletons

    rows = [("p", 0, i, x, y) for i, (x, y) in enumerate(T_RING)]
    schema = "poly_id string, ring int, i long, x double, y double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    write_skeletons(stream, str(tmp_path / "out"), str(tmp_path / "state"), 0.2, min_normalized_length=3.0).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_interpolation_off_lines_raises_and_ties(spark):
    v = vertex_rows(spark, {"a": [(0, 0), (0, 0), (4, 0), (4, 0), (4, 3)], "b": [(1, 1)]})
    d = spark.createDataFrame([("a", x) for x in (0.0, 4.0, 4.0, 7.0, 1.5)], "k string, d double")
    got = sorted((r.d, r.segment, r.x, r.y) for r in L.interpolate(v, d, "k").collect())
    assert got == [(0.0, 0, 0, 0), (1.5, 1, 1.5, 0), (4.0, 1, 4, 0), (4.0, 1, 4, 0), (7.0, 3, 4, 3)]
    for key, at in (("b", 0.0), ("b", 1.0), ("a", -0.5), ("a", 7.5)):
        with pytest.raises(Exception, match="off the line"):
            L.interpolate(v, spark.createDataFrame([(key, at)], "k string, d double"), "k").collect()
    got = sorted((r.d, r.x) for r in L.interpolate(v.filter("k = 'a'"), spark.createDataFrame([("a", 0.5), ("a", 1.0)], "k string, d double"), "k", normalized=True).collect())
    assert got == [(0.5, 3.5), (1.0, 4.0)]


def test_points_in_rings_of_all_sizes(spark):
    r = np.random.default_rng(8)
    rings = {}
    for k in range(12):
        angle, size, mid = np.arange(9) * 2 * math.pi / 9, 10.0 ** (k % 5 - 2) * (1 + r.random(9)), r.normal(0, 8, 2)
        ring = np.stack([mid[0] + size * np.cos(angle), mid[1] + size * np.sin(angle)], axis=1)
        rings[f"r{k}"] = np.vstack([ring, ring[:1]])
    rings["flat"] = np.array([[0, 0], [0, 0], [0, 0], [0, 0]])
    points = np.concatenate([r.normal(0, 9, (150, 2)), *[p.mean(axis=0) + r.normal(0, 0.02, (4, 2)) for p in rings.values()]])
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "p long, px double, py double")
    got = {(x.p, x.k) for x in L.points_in_rings(p, vertex_rows(spark, rings), "k", "p").collect()}
    want = {(int(i), k) for k, ring in rings.items() for i in np.flatnonzero(V.inside_rings(points, [ring]))}
    assert got == want and len({k for _, k in want}) > 8
    plan = L.points_in_rings(p, vertex_rows(spark, rings), "k", "p")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_codec_columns(spark):
    texts = [C.to_wkt(g) for g in GEOMETRIES] + [None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("g", C.wkb_of_wkt(F.col("t")))
    rows = df.select("k", "g", C.ewkb(F.col("g")).alias("e"), C.wkt_of_wkb(F.col("g")).alias("t"), C.wkb_type(F.col("g")).alias("kind"), C.wkb_vertices(F.col("g")).alias("v")).orderBy("k").collect()
    for r, g in zip(rows, GEOMETRIES):
        assert bytes(r.g) == C.to_wkb(g) and bytes(r.e) == C.to_wkb(g, extended=True) and r.t == C.to_wkt(g) and r.kind == g["type"] + " Z" * g["z"]
        assert len(r.v) == str(g["coords"]).count("(") - (0 if isinstance(g["coords"], list) else 0)
    assert rows[-1][1:] == (None,) * 5
    nested = spark.createDataFrame([([[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]],)], "c array<array<array<double>>>")
    assert bytes(nested.select(C.wkb_of("Polygon", F.col("c")).alias("g")).first().g) == C.to_wkb({"type": "Polygon", "z": False, "coords": [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]})
    with pytest.raises(Exception, match="supported geometry"):
        df.select(C.wkb_of_wkt(F.lit("blob (1 2)"))).collect()


def test_schema_bounds_and_missing_columns(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(2**63 - 1, 2**53 + 1, 1), (-(2**63), 0, 2)], "a long, b long, c long")
    schema, _ = M.infer(df)
    assert [f.dataType for f in schema] == [T.LongType(), T.LongType(), T.ByteType()]
    assert M.infer(spark.createDataFrame([(2**31 - 1,)], "a long"))[0]["a"].dataType == T.IntegerType() and M.infer(spark.createDataFrame([(2**31,)], "a long"))[0]["a"].dataType == T.LongType()
    want = T.StructType([M.field("c", T.IntegerType()), M.field("d", T.StringType())])
    assert [tuple(r) for r in M.apply(df, want).collect()] == [(1, None), (2, None)]
    with pytest.raises(ValueError, match="no columns"):
        M.apply(df, T.StructType([M.field("d", T.StringType(), False)]))
    assert M.extend(want, [M.field("e", T.DateType())]).names == ["c", "d", "e"]
    with pytest.raises(ValueError, match="already"):
        M.extend(want, [M.field("c", T.DateType())])


def test_voronoi_options():
    r = np.random.default_rng(2)
    p = r.random((60, 2)) + 5
    base = V.voronoi(p)
    for translate in V.TRANSLATIONS:
        d = V.voronoi(p, translate=translate)
        assert (d.ridges[:, :2] == base.ridges[:, :2]).all() and np.allclose(d.vertices, base.vertices, atol=1e-6)
    twice = np.vstack([p, p[[3, 9]]])
    assert V.used(p) is None and V.used(twice).tolist() == list(range(60))
    again = V.voronoi(twice)
    assert (again.ridges == base.ridges).all() and len(again.points) == 62
    with pytest.raises(ValueError, match="equal points"):
        V.voronoi(twice, merge="ERROR")
    for bad in ({"translate": "MODE"}, {"merge": "KEEP"}):
        with pytest.raises(ValueError):
            V.voronoi(p, **bad)


def test_noisy_tree(spark):
    tree = K.binary_tree(spark, 8.0, 0.5, 30.0, 3)
    plain, noisy, other = (sorted(map(tuple, K.tree_lines(tree, 6, offset, seed).collect())) for offset, seed in ((0.0, 0), (0.1, 0), (0.1, 1)))
    assert len(plain) == 15 * 6 and noisy != other and noisy == sorted(map(tuple, K.tree_lines(tree, 6, 0.1, 0).collect()))
    for a, b in zip(plain, noisy):
        size = math.dist(a[1:3], a[3:5])
        moved = max(abs(a[6] - b[6]), abs(a[7] - b[7]))
        assert a[:6] == b[:6] and moved <= 0.1 * size + 1e-12 and (a[5] not in (0, 5) or moved < 1e-12)


def test_stacked(spark):
    df = spark.createDataFrame([([1, 2], [3, 4]), ([], []), ([1], [2, 3])], "a array<int>, b array<int>")
    got = [r.s for r in df.filter("size(a) = size(b)").select(A.stacked(["a", "b"]).alias("s")).collect()]
    assert got == [[[1, 3], [2, 4]], []]
    with pytest.raises(Exception, match="several lengths"):
        df.select(A.stacked(["a", "b"])).collect()
