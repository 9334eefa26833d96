"""Graph queries over whole tables, against loops."""

import heapq
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from geoskein.operators import graph as G


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    rows = [(k, int(r.integers(0, 12)), float(r.integers(-999, 9999))) for k in range(1, 201)]
    # a nation of late suppliers only
    rows += [(201, 40, 5.0), (202, 3, 6.5), (203, 41, 8.0), (204, 40, 1.0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(os.path.join(folder, "supplier.parquet"))
    edges = {}
    for (_, a, x), (_, b, y) in zip(rows, rows[1:]):
        if a != b:
            e = min(a, b), max(a, b)
            edges[e] = min(abs(x - y), edges.get(e, float("inf")))
    return folder, edges


def cheapest(edges):
    near = defaultdict(list)
    for (a, b), c in edges.items():
        near[a].append((b, c))
        near[b].append((a, c))
    out = {}
    for source in near:
        queue = [(0.0, source)]
        while queue:
            cost, node = heapq.heappop(queue)
            if (source, node) in out:
                continue
            out[source, node] = cost
            for b, c in near[node]:
                heapq.heappush(queue, (cost + c, b))
    return out


def test_nation_graph_of_suppliers(spark, suppliers):
    folder, edges = suppliers
    run = lambda name: entry.queries()[name](spark, folder).collect()
    degree = Counter(n for e in edges for n in e)
    assert {r.node: r.degree for r in run("node_degree")} == degree and 40 in degree and 41 in degree
    assert {(r.lo, r.hi) for r in run("describe_edges")} == set(edges)
    paths = cheapest(edges)
    got = {(r.source, r.node): r.cost for r in run("shortest_paths")}
    assert got == pytest.approx({k: round(c, 4) for k, c in paths.items()})
    longest = sorted((-c, a, b) for (a, b), c in paths.items() if a < b)[:10]
    assert [r.cost for r in sorted(run("longest_shortest_path"), key=lambda r: r.place)] == pytest.approx([-c for c, _, _ in longest])
    assert {(r.lo, r.hi) for r in run("forbidden_edges")} == {e for e in edges if degree[e[0]] <= 4 and degree[e[1]] <= 4}


def test_nearest_and_farthest_of_points(spark, tmp_path):
    r = np.random.default_rng(6)
    # a grid with many ties, two far clusters, one place, and a cloud
    at = [(k % 25, k // 25 % 17) for k in range(600)], r.normal(0, 1, (600, 2)) + np.where(np.arange(600)[:, None] < 400, 0, 1e4), [(1.5, 2.5)] * 7, r.normal(0, 9, (500, 2))
    rows = [(0, label, [float(np.float32(x)), float(np.float32(y)), 0.0]) for label, own in enumerate(at) for x, y in own]
    rows = [(int(k), *row[1:]) for k, row in zip(r.permutation(len(rows)), rows)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    half = len(rows) // 2
    near, pairs = {}, {}
    for label in range(len(at)):
        own = sorted((i, *e[:2]) for i, g, e in rows if g == label)
        d2 = lambda a, b: (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])
        for a in own:
            if a[0] < half:
                near[label, a[0]] = min((d2(a, b), b[0]) for b in own if b[0] >= half)
        pairs[label] = min((-d2(a, b), a[0], b[0]) for k, a in enumerate(own) for b in own[k + 1 :])
    got = {(x.grp, x.id): (x.distance, x.other) for x in entry.queries()["nearest_stub"](spark, str(tmp_path)).collect()}
    assert got == {k: (pytest.approx(d**0.5, abs=1e-6), i) for k, (d, i) in near.items()}
    got = {x.grp: (x.distance, x.a, x.b) for x in entry.queries()["farthest_pair"](spark, str(tmp_path)).collect()}
    assert got == {k: (pytest.approx((-d) ** 0.5, abs=1e-6), a, b) for k, (d, a, b) in pairs.items()}


def test_no_pairs_leave_a_task(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 4.0)], "grp int, id long, x double, y double")
    for df in (G.nearest(p, p, "grp"), G.farthest_pair(p, "grp")):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x) for x in G.farthest_pair(p, "grp").collect()] == [(1, 1, 2, 5.0)]


def test_components_of_a_chain(spark):
    chain = spark.range(1, 60).selectExpr("id AS lo", "id + 1 AS hi").unionByName(spark.createDataFrame([(100, 101), (7, 7)], "lo long, hi long"))
    got = {r.node: r.component for r in G.components(chain).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100}
