"""Line deduplication by a tree of line templates of fixed depth, in DataFrame functions alone.

A line's words holding digits are variable fields and read `<*>`. The tree's first level is the number of words,
the next DEPTH levels are the leading words. Within a leaf, a position keeps the word that at least half of the
leaf's lines have there, and is `<*>` otherwise. A line that agrees with its leaf on at least SIMILAR of its
words takes the leaf's template; another keeps itself, its fields masked, as its template. Lines whose template
occurs in at least MIN_DOCS documents are dropped from all of them.

With split, a leaf may hold several templates: what doesn't fit is parted by its words at one position, that where most
lines have a word that not all have, each part has a template as the leaf had, and so on until all lines are placed
or no part has a word in common that isn't common to all of it.

Leaves are found from hashes alone, two of 64 bits for each line and leaf, and what can't be dropped ends there: a leaf
with one distinct line, in one document. Words are laid out for leaves with several distinct lines, and
counted by position with partial sums, so that no leaf is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoskein.llm.common import SPACES, materialise

DEPTH = 3
SIMILAR = 0.7
MIN_DOCS = 2
FIELD = "<*>"
#: Leaves that may be broadcast (under 40 bytes each); more are joined.
BROADCAST_LEAVES = 500_000


def masked(line: Column) -> Column:
    """Words joined by one space, those with ASCII digits as FIELD; empty for a blank line."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for mark in ("  ", "\t", "\n", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(line, F.lit(mark))
    words = F.when(odd, F.trim(F.regexp_replace(line, SPACES, " "))).otherwise(line)
    return F.when(words.rlike("[0-9]"), F.regexp_replace(words, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(words)


def _key(*columns: Column) -> Column:
    """128 bits that stand for the columns."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """(id, line, masked, n, leaf, own) of every line that isn't blank."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")).alias("line", "raw"))
    lines = lines.filter(F.col("raw").rlike(r"[^\x20\x09-\x0D]")).select("id", "line", masked(F.col("raw")).alias("masked"))
    many = (F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "), F.lit(""))) + 1).cast("int")
    return lines.select("id", "line", "masked", many.alias("n"), _key(many, F.substring_index("masked", " ", depth)).alias("leaf"), _key(F.col("masked")).alias("own"))


def _fitting(each: DataFrame, by: str, similar: float) -> DataFrame:
    """(by, own, fits) of distinct lines (by, own, n, masked, times, of): whether they agree with what most lines of
    their group have at each place. A group's words are one row of as many as its lines have."""
    cells = each.select(by, "of", "times", F.posexplode(F.split("masked", " ")).alias("at", "word"))
    counted = cells.groupBy(by, "at", "word").agg(F.sum("times").alias("times"), F.max("of").alias("of")).filter("2 * times >= of")
    kept = counted.groupBy(by, "at").agg(F.max_by("word", F.struct("times", "word")).alias("word"))
    kept = kept.groupBy(by).agg(F.collect_list(F.struct("at", "word")).alias("kept"))
    # words are laid out below the join, once for each line
    words = each.select(*dict.fromkeys(["leaf", by, "own", "n"]), F.split("masked", " ").alias("words"))
    same = F.size(F.filter("kept", lambda x: F.get("words", x["at"]) == x["word"]))
    return words.join(kept, by).select(*dict.fromkeys(["leaf", by, "own"]), (same >= F.lit(similar) * F.col("n")).alias("fits"))


def _placed_by_parts(rest: DataFrame, similar: float) -> DataFrame | None:
    """(leaf, own, part) of the lines that fit a part of what is left of their leaves (leaf, own, n, masked, times)."""
    found = None
    now = rest.withColumn("part", _key(F.col("leaf"), F.lit("rest")))
    while True:
        many = now.groupBy("part").agg(F.count(F.lit(1)).alias("lines"), F.sum("times").alias("of")).filter("lines > 1")
        now = materialise(now.drop("lines", "of").join(many, "part"), "parts")
        if not now.limit(1).count():
            return found
        fit = materialise(_fitting(now, "part", similar).filter("fits").select("leaf", "own", "part"), "fit")
        found = fit if found is None else found.unionByName(fit)
        cells = now.select("part", "lines", F.posexplode(F.split("masked", " ")).alias("at", "word"))
        counted = cells.groupBy("part", "at", "word").agg(F.count(F.lit(1)).alias("k"), F.max("lines").alias("lines")).filter("k > 1 and k < lines")
        best = counted.groupBy("part").agg(F.max_by("at", F.struct("k", -F.col("at"))).alias("at"))
        left = now.join(fit, ["leaf", "own", "part"], "left_anti").join(best, "part")
        now = left.withColumn("part", _key(F.col("part"), F.col("at"), F.element_at(F.split("masked", " "), F.col("at") + 1))).drop("at")


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS, split: bool = False) -> DataFrame:
    """(id, line, template, docs) of the lines whose template is in min_docs documents at least; lines are numbered from 0,
    templates known by 128 bits.

    docs counts distinct ids, a null id as one more. Lines are what line feeds part. Blank lines have no template.
    """
    if min_docs < 2:
        raise ValueError("a template of one document is none that recurs")
    lines = _lines(docs, id_col, text_col, depth)
    small = materialise(lines.select("id", "line", "leaf", "own"), "lines")
    several = (F.min("id") != F.max("id")) | (F.count("id") > 0) & (F.count("id") < F.count(F.lit(1)))
    leaves = small.groupBy("leaf").agg((F.min("own") != F.max("own")).alias("wide"), F.count(F.lit(1)).alias("of"), F.coalesce(several, F.lit(False)).alias("several"))
    leaves = materialise(leaves.filter("several").drop("several"), "wide")
    sent = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves
    # the distinct lines of leaves with several, and how often each occurs
    each = lines.join(sent.filter("wide"), "leaf").groupBy("leaf", "own", "n", "masked").agg(F.count(F.lit(1)).alias("times"), F.max("of").alias("of"))
    each = materialise(each, "leaves")
    fit = materialise(_fitting(each, "leaf", similar), "fit")
    parts = _placed_by_parts(each.join(fit.filter("fits"), ["leaf", "own"], "left_anti").select("leaf", "own", "n", "masked", "times"), similar) if split else None
    # a leaf's template is known by the leaf, a part's by the part, a line of its own by the line
    named = fit.filter("fits").select("leaf", "own", F.col("leaf").alias("of"))
    named = named if parts is None else named.unionByName(parts.withColumnRenamed("part", "of"))
    placed = small.join(sent.select("leaf"), "leaf").join(named, ["leaf", "own"], "left")
    placed = placed.select("id", "line", F.coalesce("of", "own").alias("template"), F.col("of").isNotNull().alias("group"))
    spread = placed.select("template", "group", "id").distinct().groupBy("template", "group").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    return placed.join(spread, ["template", "group"]).select("id", "line", "template", "docs")


def without_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text, n_lines, n_dropped) for every row: its text without the lines of recurring templates.

    The rest keeps its order and blank lines. Null text counts as empty; rows repeated with one id lose the lines
    dropped in any of them at the same place; a null id is one document. Other columns are ignored.
    """
    gone = shared_lines(docs, id_col, text_col, **options).groupBy(F.col("id").alias("gone_id")).agg(F.collect_set("line").alias("gone"))
    rows = docs.select(F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n").alias("lines"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")), "left")
    by_place = F.map_from_arrays(F.col("gone"), F.transform("gone", lambda x: F.lit(True)))
    rows = rows.withColumn("gone", F.when(F.col("gone").isNotNull(), by_place))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, k: ~F.coalesce(F.element_at("gone", k), F.lit(False))))
    return rows.select(F.col("id").alias(id_col), F.array_join(left, "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(left)).cast("long").alias("n_dropped"))


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text_sha256): without_templates() with a digest for its text."""
    return without_templates(docs, **options).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL = r"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
cut AS (SELECT doc_id, k - 1 AS line, lines[k] AS raw FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS k FROM raw)),
words AS (SELECT doc_id, line, string_split_regex(regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS w FROM cut),
m AS (SELECT doc_id, line, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM words),
l AS (SELECT doc_id, line, w, len(w) AS n, w[1:3] AS lead FROM m WHERE NOT (len(w) = 1 AND w[1] = '')),
each AS (SELECT n, lead, w, count(*) AS times FROM l GROUP BY ALL),
wide AS (SELECT n, lead, sum(times) AS of_leaf FROM each GROUP BY ALL HAVING count(*) > 1),
cells AS (SELECT n, lead, w, times, of_leaf, k, w[k] AS word FROM (SELECT e.*, x.of_leaf, unnest(generate_series(1, n)) AS k FROM each e JOIN wide x USING (n, lead))),
counted AS (SELECT n, lead, k, word, sum(times) AS t, max(of_leaf) AS of_leaf FROM cells GROUP BY ALL HAVING 2 * sum(times) >= max(of_leaf)),
best AS (SELECT n, lead, k, word FROM counted QUALIFY row_number() OVER (PARTITION BY n, lead, k ORDER BY t DESC, word DESC) = 1),
fit AS (SELECT c.n, c.lead, c.w FROM cells c LEFT JOIN best b USING (n, lead, k) GROUP BY ALL HAVING sum(CASE WHEN c.word = b.word THEN 1 ELSE 0 END) >= 0.7 * c.n),
placed AS (SELECT l.doc_id, l.line, f.w IS NOT NULL AS shared, l.n, l.lead, CASE WHEN f.w IS NULL THEN l.w END AS own
           FROM l LEFT JOIN fit f ON l.n = f.n AND l.lead = f.lead AND l.w = f.w),
spread AS (SELECT shared, n, lead, own, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) AS docs FROM placed GROUP BY ALL),
gone AS (SELECT DISTINCT p.doc_id, p.line FROM placed p JOIN spread s ON p.shared = s.shared AND p.n = s.n AND p.lead = s.lead AND p.own IS NOT DISTINCT FROM s.own WHERE s.docs >= 2),
per AS (SELECT doc_id, list(line) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT r.doc_id, r.lines, CASE WHEN p.gone IS NULL THEN r.lines ELSE list_filter(r.lines, lambda x, k: NOT list_contains(p.gone, k - 1)) END AS rest
         FROM raw r LEFT JOIN per p ON r.doc_id IS NOT DISTINCT FROM p.doc_id)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(rest) AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string(rest, chr(10)), '')) AS text_sha256
FROM kept
"""
