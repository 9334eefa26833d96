import re
from collections import Counter, defaultdict

from geoskein.llm import line_templates as lt

SPACE = re.compile(r"[ \t-\r]+")


def plain(rows, depth=3, similar=0.7, min_docs=2):
    """Dropped (row, line) by loops."""
    lines = []
    for r, (key, text) in enumerate(rows):
        for k, raw in enumerate((text or "").split("\n")):
            words = [w for w in SPACE.split(raw) if w]
            if words:
                lines.append((r, key, k, tuple("<*>" if re.search("[0-9]", w) else w for w in words)))
    leaves = defaultdict(Counter)
    for *_, w in lines:
        leaves[len(w), w[:depth]][w] += 1
    template = {}
    for leaf, own in leaves.items():
        total = sum(own.values())
        kept = []
        for k in range(leaf[0]):
            c = Counter()
            for w, n in own.items():
                c[w[k]] += n
            word, n = max(c.items(), key=lambda x: (x[1], x[0]))
            kept.append(word if 2 * n >= total else None)
        for w in own:
            fits = len(own) > 1 and sum(a == b for a, b in zip(w, kept)) >= similar * len(w)
            template[w] = ("leaf", leaf) if fits else ("own", w)
    docs = defaultdict(set)
    for _, key, _, w in lines:
        docs[template[w]].add(key)
    return {(r, k) for r, _, k, w in lines if len(docs[template[w]]) >= min_docs}


def test_equals_loops(spark):
    rows = [
        (1, "Page 1 of 20 pages today\nown words here\n\n  \nshared line"), (2, "Page 7 of 31 pages today\nshared  line\nlast one"), (3, None), (4, ""),
        (5, "user alice logged in from the old host\nx"), (6, "user bob logged in from the old host\ny"), (7, "user carol logged in from the old host"),
        (8, "word " * 4000 + "end"), (9, "a b c d\na b c e"), (10, "same same\nsame same"), (None, "null id line"), (None, "null id line"),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, n int")
    want = plain(rows)
    got = lt.without_templates(docs).collect()
    assert len(got) == len(rows)
    expected = Counter()
    for r, (key, text) in enumerate(rows):
        lines = (text or "").split("\n")
        rest = [x for k, x in enumerate(lines) if (r, k) not in want]
        expected[key, "\n".join(rest), len(lines), len(lines) - len(rest)] += 1
    assert Counter((g.doc_id, g.text, g.n_lines, g.n_dropped) for g in got) == expected
    assert (0, 0) in want and (1, 1) in want and (9, 0) not in want
    assert lt.without_templates(docs.limit(0)).count() == 0
    # without Python anywhere
    plan = lt.without_templates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_leaf_may_hold_several_families(spark):
    names = "alice bob carol dave erin".split()
    families = ["for all users {} must check in at the north gate", "for all users {} may not take part in our games", "for all users {} was seen by some guards last week"]
    rows = [(3 * k + f, families[f].format(name)) for k, name in enumerate(names) for f in range(3)]
    rows += [(100, "for all users one two three four five six seven"), (101, "for all users aa bb cc dd ee ff gg"), (102, "own line\nfor all users")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.text) for r in lt.without_templates(docs, split=True).collect()}
    assert all(got[k] == (1, "") for k in range(15)) and [got[k][0] for k in (100, 101, 102)] == [0, 0, 0]
    # more lines of other kinds change nothing
    more = docs.unionByName(docs.filter("doc_id = 100").selectExpr("explode(sequence(200, 240)) AS doc_id", "concat('for all users ', array_join(transform(sequence(1, 7), x -> concat(char(97 + x), char(97 + doc_id % 26), char(97 + doc_id div 26))), ' ')) AS text").selectExpr("cast(doc_id AS long) AS doc_id", "text"))
    again = {r.doc_id: r.n_dropped for r in lt.without_templates(more, split=True).collect()}
    assert all(again[k] == 1 for k in range(15))
    assert lt.without_templates(docs.limit(0), split=True).count() == 0
