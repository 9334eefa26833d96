"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted by k-means on a bounded sample. Every valid vector is then
filed under its nearest centroid with its code. A query looks into the lists of its best centroids, scores their
codes by tables of partial inner products (asymmetric: the query itself isn't quantised), and the best codes of
each block are scored exactly on the original vectors. A block holds several whole lists or a part of a long one,
about BLOCK_ROWS vectors, so that no task grows with the share of one list.

Nothing nearer is missed, whatever the rows: beside its best lists a query looks into each whose bound (inner product
with the centroid, plus the query's norm times the farthest residual) reaches the answers that a bounded sample already
gives it; and in a block each vector whose code's bound (its approximate score, plus the query's norm times the error of
its code) reaches the last answer of the shortlist is scored exactly too.

Equal vectors of a block stand for one entry with their smallest ids, as many as an answer can hold; copies
can't push other vectors off a shortlist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoskein.llm.common import materialise

#: Vectors that centroids and codebooks are fitted on at most.
TRAIN_ROWS = 20_000
#: Coarse centroids at most; the square root of the number of vectors below that.
MAX_LISTS = 4096
#: Share of the lists that a query looks into at least, and the fewest.
PROBE_SHARE, MIN_PROBES = 0.75, 8
PARTS, CODES = 16, 64
#: Distinct vectors of a block that are scored exactly for a query, as a multiple of the answers asked for.
SHORTLIST = 20
BLOCK_ROWS = 10_000
#: Queries that meet a block at a time.
QUERY_ROWS = 2_000
#: Vectors of the sample whose scores tell what a query's answers reach at least.
SEEN_ROWS = 4_096


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids of the rows, by Lloyd's steps from distinct rows; empty ones restart at the worst-placed rows."""
    distinct = np.unique(x, axis=0)
    r = np.random.default_rng(seed)
    if len(distinct) <= k:
        return distinct
    c = distinct[r.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near, far = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c)
        if empty := np.flatnonzero(n == 0).tolist():
            c[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    at, far = np.empty(len(x), np.int64), np.empty(len(x))
    half = (c * c).sum(axis=1)
    for k in range(0, len(x), rows):
        part = x[k : k + rows]
        d = half - 2 * part @ c.T
        at[k : k + rows] = d.argmin(axis=1)
        far[k : k + rows] = d.min(axis=1) + (part * part).sum(axis=1)
    return at, far


class Index:
    def __init__(self, ids: np.ndarray, sample: np.ndarray, total: int, dim: int):
        lists = int(min(MAX_LISTS, max(1, round(total**0.5)), max(1, len(sample))))
        self.dim = dim
        seen = np.random.default_rng(0).permutation(len(sample))[:SEEN_ROWS]
        self.seen_ids, self.seen = ids[seen], sample[seen]
        self.coarse = kmeans(sample, lists, seed=1) if len(sample) else np.zeros((1, dim))
        self.cuts = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
        rest = sample - self.coarse[nearest(sample, self.coarse)[0]] if len(sample) else np.zeros((1, dim))
        self.books = [kmeans(np.ascontiguousarray(rest[:, a:b]), CODES, seed=2 + k) for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))]
        self.probes = min(len(self.coarse), max(MIN_PROBES, round(PROBE_SHARE * len(self.coarse))))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, error of the code, length of the residual) of each vector."""
        at, _ = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.stack([nearest(np.ascontiguousarray(rest[:, a:b]), book)[0] for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1)
        lost = rest - np.concatenate([book[c] for book, c in zip(self.books, codes.T)], axis=1)
        return at, codes.astype(np.uint8), np.sqrt((lost * lost).sum(axis=1)), np.sqrt((rest * rest).sum(axis=1))

    def lists_of(self, qids: np.ndarray, q: np.ndarray, reach: np.ndarray, top: int) -> list[np.ndarray]:
        """The lists that each query looks into: its best ones, and all that may hold one of its `top` nearest. reach: the
        longest residual of each list."""
        out = []
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            score = part @ self.coarse.T
            first = np.argsort(-score, axis=1, kind="stable")[:, : self.probes]
            known = part @ self.seen.T
            known[self.seen_ids[None, :] == qids[a : a + 256, None]] = -np.inf
            least = np.partition(known, -top, axis=1)[:, -top] if len(self.seen) >= top else np.full(len(part), -np.inf)
            norm = np.sqrt((part * part).sum(axis=1))[:, None]
            room = norm * (reach * (1 + 1e-9) + 1e-10 * np.sqrt((self.coarse * self.coarse).sum(axis=1)))
            into = ~(score + room < least[:, None] - 1e-10 * np.abs(least)[:, None])
            np.put_along_axis(into, first, True, axis=1)
            # in the order of their scores
            out += [k[into[n, k]] for n, k in enumerate(np.argsort(-score, axis=1, kind="stable"))]
        return out

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Partial inner products (queries, codes) of each part."""
        return [q[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]

    def search(self, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, codes: np.ndarray, lost: np.ndarray, qids: np.ndarray, q: np.ndarray, probed: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, ids, exact scores): at least each query's `top` best of the lists it looks into in one block.

        probed: the lists that each query looks into; lost: the errors of the codes.
        """
        order = np.argsort(ids, kind="stable")
        ids, x, lists, codes, lost = ids[order], x[order], lists[order], codes[order], lost[order]
        repeated = set(ids[1:][ids[1:] == ids[:-1]].tolist())
        _, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
        by_age = np.argsort(first)  # vectors by their smallest id
        place = np.empty(len(first), np.int64)
        place[by_age] = np.arange(len(first))
        same, first = place[same.reshape(-1)], first[by_age]
        by_vector = np.argsort(same, kind="stable")  # within a vector by id
        rank = np.arange(len(ids)) - np.searchsorted(same[by_vector], np.arange(len(first)))[same[by_vector]]
        held = by_vector[rank <= top]  # one more than an answer holds, as a query isn't its own answer
        begins = np.searchsorted(same[held], np.arange(len(first) + 1))
        distinct, own, of_list = x[first], codes[first], lists[first]
        here = np.unique(of_list)
        column = np.searchsorted(here, of_list)
        short = min(SHORTLIST * top, len(distinct))
        size = np.sqrt((distinct * distinct).sum(axis=1))
        # with what rounding to single precision may take off: a sum of PARTS + 1 terms
        room = lost[first] * (1 + 1e-5) + 1e-5 * (size + 2 * np.sqrt((self.coarse * self.coarse).sum(axis=1))[of_list])
        out = []
        for at in range(0, len(qids), 128):
            part = q[at : at + 128]
            looks = np.stack([np.isin(here, p) for p in probed[at : at + 128]])
            approx = (part @ self.coarse[here].T).astype(np.float32)[:, column]
            for table, code in zip(self.tables(part), own.T):
                approx += table.astype(np.float32)[:, code]
            lost_all = ~np.isfinite(approx).all()  # beyond single precision nothing is left out by its bound
            looked = looks[:, column]
            approx[~looked] = -np.inf
            picks = np.argpartition(-approx, short - 1, axis=1)[:, :short]
            norm = np.sqrt((part * part).sum(axis=1))
            near = None
            for k, pick in enumerate(picks):
                if qids[at + k] in repeated:  # several rows of its own, none of them an answer
                    other = np.flatnonzero(ids != qids[at + k])
                    exact = (x[other] * part[k]).sum(axis=1)
                    best = np.argsort(-exact, kind="stable")[:top]
                    out.append((np.full(len(best), qids[at + k]), ids[other[best]], exact[best]))
                    continue
                pick = np.sort(pick[looked[k, pick]])
                exact = (distinct[pick] * part[k]).sum(axis=1)
                if len(pick) < looked[k].sum():
                    least = np.partition(exact, -top - 1)[-top - 1] if len(exact) > top else -np.inf
                    more = looked[k] & (lost_all | ~(approx[k] + norm[k] * room < least))
                    more[pick] = False
                    more = np.flatnonzero(more)
                    if len(more):
                        near = part @ distinct.T if near is None else near
                        more = more[~(near[k, more] + 1e-10 * norm[k] * size[more] < least)]
                        pick = np.sort(np.concatenate([pick, more]))
                        exact = (distinct[pick] * part[k]).sum(axis=1)
                # of equal scores those with the smallest ids come first: one more than `top` vectors are enough
                best = np.argsort(-exact, kind="stable")[: top + 1]
                n = begins[pick[best] + 1] - begins[pick[best]]
                found = ids[held[np.repeat(begins[pick[best]] - np.cumsum(n) + n, n) + np.arange(n.sum())]]
                ok = found != qids[at + k]
                out.append((np.full(ok.sum(), qids[at + k]), found[ok], np.repeat(exact[best], n)[ok]))
        return tuple(np.concatenate(c) for c in zip(*out))


def blocks_of(sizes: dict[int, int], rows: int) -> tuple[dict[int, tuple[int, int]], int]:
    """(first block, blocks) of each list, and the number of blocks: short lists share one, long ones have several."""
    at, held, out = 0, 0, {}
    for k, n in sorted(sizes.items()):
        if held and held + n > rows:
            at, held = at + 1, 0
        many = -(-n // rows)
        out[k] = (at, many)
        at, held = (at + many, 0) if many > 1 else (at, held + n)
    return out, at + 1


def _valid(rows: DataFrame, id_col: str, vec_col: str, dim: int | None) -> DataFrame:
    v = F.col(vec_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    out = rows.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(fine)
    return (out.filter(F.size(v) == dim) if dim else out).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` largest inner products for each row that is_query selects.

    is_query: a condition on the id column. A query's candidates are all rows with another id. Vectors that are
    null, zero, of another length than the most frequent one, or hold null or non-finite components take no part,
    nor do null ids; of rows repeated with one id each counts. Ties go to smaller ids. Empty in, empty out.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    dims = _valid(rows, id_col, vec_col, None).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], schema)
    dim, total = dims[0]["dim"], dims[0]["count"]
    valid = _valid(rows, id_col, vec_col, dim)
    # by a threshold on the ids' hashes, so that no partition sends more than its share
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = (valid if total <= TRAIN_ROWS else valid.filter(share < TRAIN_ROWS / total)).limit(TRAIN_ROWS).collect()
    sample.sort(key=lambda r: r.id)
    index = Index(np.array([r.id for r in sample], np.int64), np.array([r.v for r in sample]).reshape(len(sample), dim), total, dim)
    del sample
    shared = spark.sparkContext.broadcast(index)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf.v.tolist()).reshape(len(pdf), dim)
            at, codes, lost, far = shared.value.encode(x)
            yield pd.DataFrame({"id": pdf.id, "v": pdf.v, "list": at, "code": [c.tobytes() for c in codes], "lost": lost, "far": far})

    filed = materialise(valid.mapInPandas(file, "id long, v array<double>, list long, code binary, lost double, far double"), "filed")
    found = filed.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("far")).collect()  # a row for each list: MAX_LISTS at most
    blocks, _ = blocks_of({r["list"]: r["rows"] for r in found}, BLOCK_ROWS)
    reach = np.zeros(len(index.coarse))
    for r in found:
        reach[r["list"]] = r["far"]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            q = np.array(pdf.v.tolist()).reshape(len(pdf), dim)
            out = []
            for i, v, row in zip(pdf.id, pdf.v, own.lists_of(pdf.id.to_numpy(), q, reach, top)):
                into: dict[int, list[int]] = {}
                for k in row.tolist():
                    first, many = blocks.get(k, (0, 0))
                    for b in range(first, first + many):
                        into.setdefault(b, []).append(k)
                out += [(i, v, p, b) for b, p in into.items()]
            yield pd.DataFrame(out, columns=["id", "v", "probed", "block"])

    where = spark.createDataFrame([(k, *b) for k, b in blocks.items()], "list long, first long, many long")
    base = filed.drop("far").join(F.broadcast(where), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("many")))
    # queries of a block come in bounded groups too, each beside a copy of the block
    selected = filed.select("id", "v").filter(is_query(F.col("id")))
    groups = max(1, -(-selected.count() // QUERY_ROWS))
    queries = selected.mapInPandas(probe, "id long, v array<double>, probed array<long>, block long").withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)))
    base = base.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def match(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = np.array(left.v.tolist()), np.array(right.v.tolist())
        codes = np.frombuffer(b"".join(left.code), np.uint8).reshape(len(left), -1)
        found = shared.value.search(left.id.to_numpy(), x, left["list"].to_numpy(), codes, left.lost.to_numpy(), right.id.to_numpy(), q, list(right.probed), top)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    keys = ["block", "g"]
    hits = base.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(match, "query_id long, vec_id long, score double")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
