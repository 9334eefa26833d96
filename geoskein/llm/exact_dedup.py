"""Exact deduplication that a hot text cannot overload.

Texts are deduplicated where they lie (map-side combining of the aggregation), the survivors are merged in
groups of (digest, salt), and the winners of the salts are combined globally. The grouping key holds the whole
normalised text beside its digest at every stage, so equal digests of different texts never merge.

Only hot digests are salted: those with over max(hot_rows, total / 1000) rows, hence at most 1,000 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoskein.llm.common import materialise

SALTS = 32


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space, null as empty text."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for mark in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(mark), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def _hot_digests(digests: DataFrame, hot_rows: int) -> list[str]:
    total = digests.count()
    found = digests.groupBy("digest").count().filter(F.col("count") > max(hot_rows, total / 1000))
    return [r.digest for r in found.select("digest").collect()]


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, norm, digest)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"))
    return rows.withColumn("digest", F.sha2(F.col("norm").cast("binary"), 256))


def _members(docs: DataFrame, id_col: str, text_col: str, hot_rows: int) -> DataFrame:
    """(id, digest, copies, keep_id, group_size): a row for each id and text, with how many rows have both."""
    rows = _digested(docs, id_col, text_col)
    ids = materialise(rows.select("id", "digest"), "digests")
    hot = _hot_digests(ids, hot_rows)
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    merged = rows.withColumn("salt", salt).groupBy("digest", "salt", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # the salts of a hot text are combined by its whole content; a text that isn't hot has one salt and is complete
    alone = F.sum(F.when(is_hot, 0).otherwise(1))
    winners = merged.groupBy("digest", F.when(is_hot, F.col("norm")).alias("content")).agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.greatest(alone, F.lit(1)).alias("texts"))
    # one text per digest: a SHA-256 collision would show as two winners, and the join below must not mix them
    winners = winners.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.sum("texts").alias("texts"))
    checked = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.concat(F.lit("two texts share the digest "), F.col("digest"))))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    winners = winners.select("digest", "keep_id", checked.cast("long").alias("group_size"), F.explode(salts).alias("salt"))
    members = ids.withColumn("salt", salt).groupBy("digest", "salt", "id").agg(F.count(F.lit(1)).alias("copies"))
    return members.join(winners, ["digest", "salt"]).drop("salt")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 1000) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Of rows with equal normalised text the smallest id stays. Null text counts as empty; a null id is larger than
    any other; of rows repeated with the same id and text exactly one is kept. Other columns are ignored. An empty
    table gives an empty result.
    """
    rows = _members(docs, id_col, text_col, hot_rows).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 1000) -> DataFrame:
    """The rows of docs, all columns, that stay: one for each distinct normalised text, that of the smallest id.

    Of rows repeated with one id and text, the first by their other columns as JSON text stays. Columns may have any
    names and types.
    """
    stays = _members(docs, id_col, text_col, hot_rows).filter(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("keep"), F.col("digest").alias("sha"), "copies")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col(f"`{id_col}`").alias("id"), F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256).alias("own"))
    kept = rows.join(stays, F.col("id").eqNullSafe(F.col("keep")) & (F.col("own") == F.col("sha")))
    place = F.row_number().over(W.partitionBy("keep", "sha").orderBy(F.to_json("row")))
    repeated = kept.filter("copies > 1").withColumn("place", place).filter("place = 1")
    return kept.filter("copies = 1").select("row").unionByName(repeated.select("row")).select("row.*")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
