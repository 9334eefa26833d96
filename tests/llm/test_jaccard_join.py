import itertools
import re

import numpy as np
import pytest

from geoskein.llm import jaccard_join as jj

SPACE = re.compile(r"[ \t-\r]+")


def plain_sets(rows, width):
    out = []
    for _, text in rows:
        w = [x for x in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        out.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute(rows, width=4, p=85, q=100):
    sets = plain_sets(rows, width)
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = {}
    for k, (key, _) in enumerate(rows):
        r = root(k)
        ids = [x for x in (least.get(r), key) if x is not None]
        least[r] = min(ids) if ids else None
    return sorted(((key, len(sets[k]), least[root(k)]) for k, (key, _) in enumerate(rows)), key=str)


def corpus(seed, docs=160):
    r = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(400)]
    shared = r.choice(vocab, 60).tolist()
    rows, made = [], []
    for k in range(docs):
        if made and r.random() < 0.6:
            words = list(made[int(r.integers(len(made)))])
            for _ in range(int(r.integers(0, 6))):
                at = int(r.integers(len(words)))
                words[at : at + int(r.integers(0, 2))] = [str(r.choice(vocab))] * int(r.integers(0, 2))
        else:
            words = r.choice(vocab, int(r.integers(1, 160))).tolist()
            if r.random() < 0.4:
                words += shared
        made.append(words or ["x"])
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jj, "HOT_SETS", 3)
    if seed:  # regions are divided, again and again, and laid out in blocks
        monkeypatch.setattr(jj, "LEAF", 3)
        monkeypatch.setattr(jj, "PIVOTS", 4)
        monkeypatch.setattr(jj, "DENSE", 3.0)
    rows = corpus(seed)
    rows += [(900, None), (901, ""), (902, "One two"), (903, "one TWO"), (904, "a\x1cb c d e"), (905, "É é x y"), (906, "big " * 5000), (907, "big " * 4000), (None, rows[0][1]), (None, "null alone here"), (3, rows[3][1]), (3, "other text of one id")]
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, n int, sid string")
    got = jj.joined(docs).collect()
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=str) == brute(rows)


def test_other_width_and_cut(spark):
    rows = corpus(7, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.joined(docs, width=5, cut=(80, 100)).collect()
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=str) == brute(rows, 5, 80, 100)
    assert jj.joined(docs.limit(0)).count() == 0
    far = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jj.joined(far).collect()} == {(1, 1), (2, 2)}


def test_prefixes_are_long_enough():
    for n in range(1, 400):
        small, large = jj.prefix_sizes(n)
        assert large == n - -(-85 * n // 100) + 1 and small == n - -(-170 * n // 185) + 1


def test_grids_bound_the_difference():
    r = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**64, int(r.integers(1, 900)), dtype=np.uint64))
        b = np.unique(np.concatenate([r.choice(a, int(r.integers(0, len(a) + 1)), replace=False), r.integers(0, 2**64, int(r.integers(0, 300)), dtype=np.uint64)]))
        if len(b):
            assert jj.grid_distance(jj.grid(a), jj.grid(b)) <= len(np.setxor1d(a, b))


def plain_links(rows, width=4, p=85, q=100):
    """Of every row: how many different sets its set is linked with."""
    sets = [frozenset(s) for s in plain_sets(rows, width)]
    distinct = {s for s in sets if s}
    degree = {s: sum(t != s and q * len(s & t) >= p * len(s | t) for t in distinct) for s in distinct}
    return sorted(((key, degree.get(s, 0)) for (key, _), s in zip(rows, sets)), key=str)


@pytest.mark.parametrize(("blocks", "leaf", "dense"), [(3_000, 256, 1.5), (7, 10, 1.5), (50, 4, 9.0)])
def test_links_equal_brute_force(spark, blocks, leaf, dense, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SETS", blocks)
    monkeypatch.setattr(jj, "LEAF", leaf)
    monkeypatch.setattr(jj, "DENSE", dense)
    monkeypatch.setattr(jj, "BLOCK_COLUMNS", 64)
    r = np.random.default_rng(9)
    base = [f"v{k}" for k in range(120)]
    # mutually linked texts, a group where only some are, and copies
    rows = [(1000 + k, " ".join([*base, f"end{k}"])) for k in range(30)]
    rows += [(2000 + k, " ".join(f"u{j}" if r.random() < 0.99 else f"z{k}_{j}" for j in range(150))) for k in range(30)]
    rows += [*corpus(0), (3000, rows[0][1]), (None, rows[1][1]), (3001, None), (3002, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((g.doc_id, g.n_links) for g in jj.joined(docs).collect()), key=str)
    assert got == plain_links(rows) and dict(got)[1000] == 29


def test_cells_judge_each_pair_once():
    """Links between sets laid out by voronoi(), counted over all cells, are those of all pairs."""
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(6)]
    sets = []
    for k in range(150):
        own = base[k % 6]
        sets.append(np.unique(np.concatenate([own[r.random(len(own)) > 0.02 * (k % 13)], r.integers(0, 2**63, k % 9 * (1 + k % 2)).astype(np.uint64)])))
    sid = r.permutation(len(sets))
    d = jj._distances(sets, sets)
    linked = d <= 0.15 + 1e-12
    cells = jj.voronoi(d[:, [0, 1, 2, 7, 13]], 0.15)
    times = np.zeros_like(linked, int)
    for c in {c for x in cells for c, _ in x}:
        rows = [(k, s) for k, x in enumerate(cells) for cc, s in x if cc == c]
        pdf = jj.pd.DataFrame({"i": 0, "j": 0, "side": 0, "sid": [sid[k] for k, _ in rows], "raw": [sets[k].tobytes() for k, _ in rows], "lower": None, "own": [int(s == 1) for _, s in rows], "far": [int(s == 2) for _, s in rows], "depth": 1})
        links, _ = jj.judged(pdf, (85, 100))
        for (k, _), n in zip(rows, links):
            times[k, 0] += n
    assert (times[:, 0] == linked.sum(axis=1) - 1).all() and len({c for x in cells for c, _ in x}) > 2


def test_shared_counts():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 90, int(r.integers(0, 40))).astype(np.uint64)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = ~np.eye(30, dtype=bool)
    assert (jj.shared_counts(sets)[off] == want[off]).all() and (jj.shared_counts(sets, 11) == want[:11, 11:]).all()
    assert (jj.shared_counts(sets[:2], 1) == want[:1, 1:2]).all() and jj.shared_counts([]).shape == (0, 0)


def test_runs_hold_whole_groups():
    rows = jj.pd.DataFrame({"g": np.repeat(np.arange(40), np.random.default_rng(1).integers(1, 12, 40)), "x": 1})
    parts = list(jj._whole_groups((rows[k : k + 7] for k in range(0, len(rows), 7)), ["g"], len, 20))
    assert jj.pd.concat(parts).g.tolist() == rows.g.tolist() and len(parts) > 3
    assert sum(p.g.nunique() for p in parts) == 40


def test_sets_travel_once_with_a_dense_region(spark, monkeypatch):
    """A region that division doesn't help and that fits one block is one leaf; what is divided gets its own sets alone."""
    monkeypatch.setattr(jj, "LEAF", 10)
    monkeypatch.setattr(jj, "DENSE", 0.0)
    times, given, judged, divided = [], [], jj._judged, jj._divided

    def spy_judged(leaves, sets, cut):
        times.extend(r["count"] for r in leaves.groupBy("region", "sid").count().collect())
        return judged(leaves, sets, cut)

    def spy_divided(rows, sizes, sets, cut):
        given.append((rows.select("sid").distinct().count(), sets.select("sid").distinct().count()))
        return divided(rows, sizes, sets, cut)

    monkeypatch.setattr(jj, "_judged", spy_judged)
    monkeypatch.setattr(jj, "_divided", spy_divided)
    rows = [(k, " ".join([*(f"own{k}_{j}" for j in range(2 * k)), *(f"v{j}" for j in range(2 * k, 200))])) for k in range(40)]
    rows += [(1000 + k, " ".join([*(f"p{k // 2}_{j}" for j in range(90)), f"end{k}"])) for k in range(16)]
    got = jj.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((g.doc_id, g.n_links) for g in got), key=str) == plain_links(rows)
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=str) == brute(rows)
    assert set(times) == {1}
    assert given and all(inside == sent for inside, sent in given)


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in found.split("\n") if "/shuffle_" in x}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = files(), spark.conf.get(key, None)
    found = jj.materialise(spark.range(1000).repartition(5, "id").groupBy((jj.F.col("id") % 7).alias("k")).count(), "free")
    assert not files() - before and spark.conf.get(key, None) == conf
    assert sorted((r.k, r["count"]) for r in found.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
