"""Exact Jaccard self-join of word-shingle sets by Voronoi regions, with its components and each set's number of links.

1 - Jaccard is a metric, and sets are linked when they are within e of one another.

  1. Ground regions. Nearly all documents of a corpus are at distance 1 from all others, where no pivot separates
     anything. Sets that can be linked share a shingle within the first few of each in one global order (prefix filter;
     shingles that are frequent in the prefixes come last in it). Of the sets with such a shingle the one with the fewest
     rare shingles is the shingle's pivot, and a pivot's region holds all sets that share one of its shingles. A pair is
     judged in the region of its smallest common pivot alone. Counts of a set's shingles in the cells of a fixed grid
     bound distances from below, and what has no partner by that bound leaves the region.
  2. A region of more than LEAF sets is divided. PIVOTS of its sets are drawn, all distances to them are computed,
     and each set goes to the Voronoi cell of its nearest one; a set that is NEAR none goes to one further cell. Let c be
     the pivot of x, and y be linked with x. By the triangle inequality d(y, c) <= d(y, c') + 2e with c' the pivot of y,
     and d(y, c) <= NEAR + e if y is near none. Sets within these windows are replicated to the cell of c, and
     so each pair is judged in one cell: in the one that holds both as their own, else in that of the set near a pivot, else
     in that of the smaller set. Cells that are still large are divided in turn, with new pivots.
  3. A region where division doesn't help (all its sets are near to each other, or none is near a pivot) is laid out in
     blocks by the distance to one pivot; only blocks whose distances differ by e at most meet. What fits one block is a leaf.
  4. Within a leaf, or two blocks, shared shingles are counted by products of matrices in one task. A task gives for each
     set the number of its links and one edge of a spanning forest of the links, no pairs.

Equal sets are one node, so copies cost nothing. Links and components are tables; nothing but counts, and frequent
shingles up to a fixed number, reaches the driver. A set is known by a 64-bit hash of its shingles; two sets with one hash
would raise an error, not merge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoskein.llm import common
from geoskein.llm.common import trimmed
from geoskein.operators.graph import components

WIDTH = 4
#: Linked when CUT[1] * intersection >= CUT[0] * union.
CUT = (85, 100)
#: A shingle in the prefixes of so many sets is frequent; at most so many of them, the most frequent, come last in
#: the global order, by a table of 2^HOT_BITS bits. This touches costs alone, not results.
HOT_SETS, MOST_HOT, HOT_BITS, SALTS = 100, 200_000, 22, 64
#: Sets of a region that one task judges whole; pivots of a larger one; sets nearer than this may make a cell.
LEAF, PIVOTS, NEAR = 256, 16, 0.5
#: A division must leave fewer than DENSE rows for each set, and no cell with more than MOST of the sets.
DENSE, MOST = 1.5, 0.8
#: Sets, and shingles, of a block; columns of a matrix; pairs and shingles that a task looks at together.
BLOCK_SETS, BLOCK_SHINGLES, BLOCK_COLUMNS = 3_000, 2_000_000, 1_024
CHUNK_PAIRS, CHUNK_BYTES = 200_000, 24_000_000
#: Shingles in a cell of a set's grid at most, and least cells of a grid; ids that may be broadcast.
CELL_LOAD, LEAST_BITS, BROADCAST_IDS = 8, 6, 1_000_000
_CACHE, _SEEN, _COUNTED = 300_000, 200_000, 2_000_000
#: Stands for a null id where texts are looked up.
NO_ID = -(1 << 63)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


#: The shingles are shuffled once and are most of the disk: they don't wait for the driver's garbage collection.
materialise = partial(common.materialise, free=True)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def forget() -> None:
    """The hashes that this worker keeps go; it may wait long for its next task."""
    _HASHES.clear()


def _mixed(w: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` word hashes, at each word but the last ones."""
    h = np.full(max(0, len(w) - width + 1), width, np.uint64)
    for k in range(width):
        h = (h ^ w[k : len(h) + k]) * _MIX[k % len(_MIX)]
        h ^= h >> np.uint64(29)
    return h


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Of each text the sorted 64-bit hashes of the distinct runs of `width` words; of all words where there are fewer;
    none without words."""
    words = [t.lower().split() for t in texts]
    flat = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), np.uint64, sum(map(len, words)))
    h, out, at = _mixed(flat, width), [], 0
    for own in words:
        n = len(own)
        out.append(_distinct(h[at : at + n - width + 1] if n >= width else _mixed(flat[at : at + n], n)) if n else np.empty(0, np.uint64))
        at += n
    return out


def prefix_sizes(n: int, cut: tuple[int, int] = CUT) -> tuple[int, int]:
    """How many first shingles of a set of n must be looked at where it is the smaller of two, and where the larger.

    Linked sets a <= b share at least cut/(1+cut)*(|a|+|b|) shingles, hence 2*cut/(1+cut)*|a| and cut*|b|.
    """
    p, q = cut
    return n + (-2 * p * n // (p + q)) + 1, n + (-p * n // q) + 1


def grid(s: np.ndarray) -> np.ndarray:
    """Shingles counted by their leading bits, in a power of two of cells; 255 in a cell stands for any count."""
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1, len(s)) / CELL_LOAD))))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).clip(max=255).astype(np.uint8)


def grid_distance(a: np.ndarray, b: np.ndarray) -> int:
    """At most the size of the symmetric difference of two sets, from their grids. The finer grid is folded."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    if (a == 255).any() or (b == 255).any():
        return 0
    while len(a) > len(b):
        a = a[::2] + a[1::2]
    while len(b) > len(a):
        b = b[::2] + b[1::2]
    return int(np.abs(a - b).sum())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def _sid(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _slices(texts: list[bytes], width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """shingle_sets() of runs of texts of bounded size, each with the number of its first text."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held > CHUNK_BYTES // 8 or k == len(texts) - 1:
            yield start, shingle_sets([bytes(x) for x in texts[start : k + 1]], width)
            start, held = k + 1, 0


def _facts(texts: DataFrame, width: int, cut: tuple[int, int]) -> DataFrame:
    """A row (id, n, sid, check, grid) for each document, and rows (h, times) of shingles that came several times in
    the prefixes that a task met together. Of a set that a task has met before the grid is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, held, many = set(), [], 0
        columns = ["id", "n", "sid", "check", "grid", "h", "times"]
        kinds = {c: "Int64" for c in columns if c != "grid"}

        def repeated() -> pd.DataFrame:
            h, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held.clear()
            return pd.DataFrame({"h": h[times > 1].view(np.int64), "times": times[times > 1]}).assign(grid=None).reindex(columns=columns).astype(kinds)

        for pdf in batches:
            out, ids = [], pdf["id"].tolist()
            for start, sets in _slices(pdf.text.tolist(), width):
                for key, s in zip(ids[start:], sets):
                    raw = s.tobytes()
                    sid = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                    new = len(s) > 0 and sid not in seen
                    out.append((key, len(s), sid, xxhash.xxh64_intdigest(raw) - (1 << 63), grid(s).tobytes() if new else None))
                    if new:
                        if len(seen) > _SEEN:
                            seen.clear()
                        seen.add(sid)
                        held.append(s[: prefix_sizes(len(s), cut)[1]].copy())
                        many += len(held[-1])
            yield pd.DataFrame([(*x, None, None) for x in out], columns=columns).astype(kinds)
            if many > _COUNTED:
                many = 0
                yield repeated()
        yield repeated()
        forget()

    return texts.mapInPandas(trimmed(run), "id long, n long, sid long, check long, grid binary, h long, times long")


def _frequent(facts: DataFrame) -> np.ndarray:
    """A bit for each value of the last HOT_BITS of a shingle: whether a frequent one has it."""
    times = materialise(facts.filter(F.col("h").isNotNull()).groupBy("h").agg(F.sum("times").alias("times")).filter(F.col("times") >= HOT_SETS), "frequent")
    many, least = times.count(), HOT_SETS
    if many > MOST_HOT:
        least = times.agg(F.percentile_approx("times", 1 - MOST_HOT / many / 2, 10_000)).first()[0] + 1
    mask = (1 << HOT_BITS) - 1
    cells = times.filter(F.col("times") >= least).select(F.col("h").bitwiseAND(mask).cast("int").alias("cell")).distinct().limit(MOST_HOT)
    hot = np.zeros(1 << HOT_BITS, bool)
    hot[[r.cell for r in cells.collect()]] = True
    return hot


def _postings(texts: DataFrame, width: int, cut: tuple[int, int], hot: np.ndarray) -> DataFrame:
    """(h, sid, small, own, salt): each set under the shingles of its prefix, at times repeatedly; small where it may be
    the smaller of two there. salt: 0, or one of SALTS by the set where the shingle counts as frequent.

    own: how many shingles of the prefix aren't frequent. Of near copies, the one with the fewest has changed least; it is
    in the lists of nearly all others, and the nearest to them.
    """
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(hot))
    size = len(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late, seen = np.unpackbits(shared.value)[:size].astype(bool), set()
        for pdf in batches:
            for _, sets in _slices(pdf.text.tolist(), width):
                parts: list[tuple] = []
                for s in sets:
                    sid = _sid(s)
                    if not len(s) or sid in seen:
                        continue
                    if len(seen) > _SEEN:
                        seen.clear()
                    seen.add(sid)
                    small, large = prefix_sizes(len(s), cut)
                    is_hot = late[(s & np.uint64(size - 1)).astype(np.int64)]
                    order = np.argsort(is_hot, kind="stable")[:large] if is_hot[:large].any() else np.arange(large)
                    last = is_hot[order]
                    parts.append((s[order].view(np.int64), np.full(large, sid), np.arange(large) < small, np.full(large, large - last.sum(), np.int32), last.astype(np.int32) * (1 + sid % SALTS)))
                if parts:
                    yield pd.DataFrame(dict(zip(("h", "sid", "small", "own", "salt"), map(np.concatenate, zip(*parts)))))
        forget()

    return texts.mapInPandas(trimmed(run), "h long, sid long, small boolean, own int, salt int")


def _pivots(postings: DataFrame) -> DataFrame:
    """(sid, pivots): the pivots of a set's shingles, sorted, where another set has the shingle.

    One exchange by shingle and salt finds the shingles that several sets have. A shingle without salt is in HOT_SETS sets and
    one more for each run of postings that a task counts together, at most; the salts of others are joined by their heads.
    """
    once = postings.repartition("h", "salt").groupBy("h", "salt", "sid").agg(F.max("small").alias("small"), F.max("own").alias("own"))
    w = W.partitionBy("h", "salt")
    listed = once.select("h", "salt", "sid", F.count(F.lit(1)).over(w).alias("k"), F.max("small").over(w).alias("some"), F.min(F.struct("own", "sid")).over(w).alias("least"))
    listed = materialise(listed.filter("salt > 0 or k > 1 and some"), "lists")
    salted = listed.filter("salt > 0")
    heads = salted.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max("some").alias("some"), F.min("least").alias("least")).filter("k > 1 and some")
    pairs = listed.filter("salt = 0").select("sid", F.col("least.sid").alias("pivot"))
    pairs = pairs.unionByName(salted.select("h", "sid").join(heads.select("h", F.col("least.sid").alias("pivot")), "h").select("sid", "pivot"))
    return pairs.groupBy("sid").agg(F.array_sort(F.collect_set("pivot")).alias("pivots"))


def _sent(wanted: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return F.broadcast if wanted.count() <= BROADCAST_IDS else lambda df: df


def _sets(texts: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(sid, raw) of the wanted (id, sid); several rows of a set where its id has several. Up to BROADCAST_IDS ids are sent
    to the texts; more of them are joined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, sets in _slices(pdf.text.tolist(), width):
                raw = [s.tobytes() for s in sets]
                yield pd.DataFrame({"sid": [xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw], "raw": raw})

    sent = _sent(wanted)
    rows = texts.join(sent(wanted.select("id").distinct()), "id", "left_semi").mapInPandas(trimmed(run), "sid long, raw binary")
    # an id may have several rows: wanted sets alone stay
    return rows.join(sent(wanted.select("sid")), "sid", "left_semi")


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], weight: Callable[[pd.DataFrame], int], most: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by the keys in runs that hold whole groups; runs are cut once they weigh more than most."""
    held, weighs = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        weighs += weight(pdf)
        if weighs > most:
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf.reset_index(drop=True)
            at = rows[keys].to_numpy()
            last = len(rows) - int(np.argmax((at[::-1] != at[-1]).any(axis=1))) if (at != at[-1]).any() else 0
            if last:
                yield rows[:last].reset_index(drop=True)
            held = [rows[last:].reset_index(drop=True)]
            weighs = weight(held[0])
    if held:
        yield pd.concat(held, ignore_index=True)


def _bounds(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the groups of sorted rows begin, and their end."""
    at = rows[keys].to_numpy()
    return np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, [len(rows)]])


def _partnered(members: DataFrame, cut: tuple[int, int]) -> DataFrame:
    """(region, sid, lower) of the members (region, sid, n, grid, lower) that may have a link to be judged there: sizes and
    grids allow it, and the two have no lower pivot in common."""
    p, q = cut

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, ["region"], len, 20_000):
            ends = _bounds(rows, ["region"])
            n, grids, lower = rows.n.to_numpy(), [np.frombuffer(g, np.uint8) for g in rows.grid], rows.lower.tolist()
            fine, full = np.array([len(g) > 1 << LEAST_BITS for g in grids]), np.array([(g == 255).any() for g in grids])
            cells = np.array([g.reshape(1 << LEAST_BITS, -1).sum(axis=1, dtype=np.int32) for g in grids])
            stays, low = np.zeros(len(rows), bool), [None if x is None or not len(x) else frozenset(np.asarray(x).tolist()) for x in lower]
            for i, j in _pairs(ends):
                ok = q * np.minimum(n[i], n[j]) >= p * np.maximum(n[i], n[j])
                i, j = i[ok], j[ok]
                apart, both = np.where(full[i] | full[j], 0, np.abs(cells[i] - cells[j]).sum(axis=1, dtype=np.int64)), n[i] + n[j]
                # of sets with d elements apart, (both - d) / 2 are shared and (both + d) / 2 are in either
                ok = q * (both - apart) >= p * (both + apart)
                for k in np.flatnonzero(ok & (fine[i] | fine[j])):
                    d = grid_distance(grids[i[k]], grids[j[k]])
                    ok[k] = q * (both[k] - d) >= p * (both[k] + d)
                for a, b in zip(i[ok].tolist(), j[ok].tolist()):
                    if not (stays[a] and stays[b]) and (low[a] is None or low[b] is None or low[a].isdisjoint(low[b])):
                        stays[a] = stays[b] = True
            yield rows.loc[stays, ["region", "sid", "lower"]]

    return members.repartition("region").sortWithinPartitions("region").mapInPandas(trimmed(run), "region long, sid long, lower array<long>")


def _pairs(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups, some at a time: each row with those after it."""
    size = np.diff(ends)
    end = np.repeat(ends[1:], size)
    row = np.arange(len(end))
    many = end - row - 1
    done = np.cumsum(many)
    start = 0
    while start < len(row):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + CHUNK_PAIRS)))
        k = many[start:stop]
        i = np.repeat(row[start:stop], k)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        start = stop


def shared_counts(items: list[np.ndarray], first: int | None = None) -> np.ndarray:
    """How many items each two of some sets of distinct items have in common; with first, those before it (rows)
    with those from it on (columns)."""
    many = len(items)
    rows, columns = (many, many) if first is None else (first, many - first)
    shared = np.zeros((rows, columns), np.float32)
    if not many:
        return shared
    if many == 2:
        k = len(np.intersect1d(items[0], items[1], assume_unique=True))
        if first is None:
            shared[:] = [[len(items[0]), k], [k, len(items[1])]]
        else:
            shared[:] = k
        return shared
    owner = np.repeat(np.arange(many), [len(x) for x in items])
    flat = np.concatenate(items)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, bool)
    begins = np.flatnonzero(new)
    times = np.diff(np.append(begins, len(flat)))
    # what only one set holds is shared with none
    common = np.repeat(times > 1, times)
    column, owner = (np.cumsum(new & common) - 1)[common], owner[common]
    for start in range(0, int((times > 1).sum()), BLOCK_COLUMNS):
        a, b = np.searchsorted(column, (start, start + BLOCK_COLUMNS))
        has = np.zeros((many, int(column[b - 1]) - start + 1), np.float32)
        has[owner[a:b], column[a:b] - start] = 1
        shared += has @ has.T if first is None else has[:first] @ has[first:].T
    return shared


def judged(rows: pd.DataFrame, cut: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(links, to) of the sets of a leaf, or of two blocks that meet (side 0 and 1): how many links of each are
    judged here, and another of its forest (its own place where it is a root).

    A pair is judged here unless the two have a lower pivot in common, and if each division has put it here.
    """
    p, q = cut
    rectangle = rows.i.iloc[0] != rows.j.iloc[0]
    first = int((rows.side == 0).sum()) if rectangle else None
    sets = [np.frombuffer(r, np.uint64) for r in rows.raw]
    n = np.array([len(s) for s in sets], np.float64)
    many = len(n)
    a, b = (slice(0, first), slice(first, many)) if rectangle else (slice(0, many), slice(0, many))
    linked = np.zeros((len(n[a]), len(n[b])), bool)
    if not linked.size:
        return np.zeros(many, np.int64), np.arange(many)
    shared = shared_counts(sets, first)
    for k in range(0, len(linked), 512):
        linked[k : k + 512] = q * shared[k : k + 512] >= p * (n[a][k : k + 512, None] + n[b][None, :] - shared[k : k + 512])
    del shared
    if not rectangle:
        np.fill_diagonal(linked, False)
    lower = [np.empty(0, np.int64) if x is None else np.asarray(x, np.int64) for x in rows.lower]
    if sum(len(x) > 0 for x in lower) > 1:
        linked &= shared_counts(lower, first) == 0
    sid, own, far = rows.sid.to_numpy(), rows.own.to_numpy(), rows.far.to_numpy()
    for level in range(int(rows.depth.iloc[0])):
        o, f = (own >> level) & 1 > 0, (far >> level) & 1 > 0
        smaller = sid[a][:, None] < sid[b][None, :]
        here = o[a][:, None] & (o[b] | f[b])[None, :] | (o[a] | f[a])[:, None] & o[b][None, :]
        linked &= here | o[a][:, None] & smaller | o[b][None, :] & ~smaller
    links = np.zeros(many, np.int64)
    links[a] += linked.sum(axis=1)
    if rectangle:
        links[b] += linked.sum(axis=0)
    return links, _forest(linked, rectangle, many)


def _forest(linked: np.ndarray, rectangle: bool, many: int) -> np.ndarray:
    to, first = np.arange(many), len(linked)
    fresh = np.ones(many, bool)
    across = np.ascontiguousarray(linked.T) if rectangle else None
    for root in range(many):
        if not fresh[root]:
            continue
        fresh[root], queue = False, [root]
        while queue:
            u = queue.pop()
            if not rectangle:
                found = np.flatnonzero(linked[u] & fresh)
            elif u < first:
                found = first + np.flatnonzero(linked[u] & fresh[first:])
            else:
                found = np.flatnonzero(across[u - first] & fresh[:first])
            if len(found):
                fresh[found], to[found] = False, u
                queue.extend(found.tolist())
    return to


def _judged(leaves: DataFrame, sets: DataFrame, cut: tuple[int, int]) -> DataFrame:
    """(sid, links, to) for every set of a leaf (region, i, j, side, sid, lower, own, far, depth) that has a link there."""
    keys = ["region", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, keys, lambda pdf: int(pdf.raw.map(len).sum()), CHUNK_BYTES):
            ends = _bounds(rows, keys)
            found = []
            for k, end in zip(ends, ends[1:]):
                own = rows[k:end].drop_duplicates("sid")
                if len(own) > 1:
                    links, to = judged(own, cut)
                    sid = own.sid.to_numpy()
                    some = np.flatnonzero(links)
                    found.append(pd.DataFrame({"sid": sid[some], "links": links[some], "to": sid[to[some]]}))
            if found:
                yield pd.concat(found, ignore_index=True)

    rows = leaves.join(sets, "sid")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "side").mapInPandas(trimmed(run), "sid long, links long, to long")


def _distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    shared = np.array([[len(np.intersect1d(s, v, assume_unique=True)) for v in pivots] for s in sets], np.float64).reshape(len(sets), len(pivots))
    size = np.array([len(s) for s in sets], np.float64)[:, None] + np.array([len(v) for v in pivots], np.float64)
    return 1 - shared / (size - shared)


def voronoi(d: np.ndarray, far: float) -> list[list[tuple[int, int]]]:
    """Of each set, by its distances to pivots, the cells that it is in: (cell, 1) for its own, (cell, 0) where it is a
    replica, (cell, 2) where it is a replica and near no pivot. Cell -1 is that of sets near none. far: the threshold."""
    home, least = d.argmin(axis=1), d.min(axis=1)
    near = least <= NEAR
    window = np.where(near[:, None], np.minimum(least[:, None] + 2 * far, NEAR + far), NEAR + far) + 1e-9
    out = []
    for k in range(len(d)):
        own = int(home[k]) if near[k] else -1
        state = 0 if near[k] else 2
        out.append([(own, 1)] + [(int(c), state) for c in np.flatnonzero(d[k] <= window[k]) if c != own])
    return out


def _divided(rows: DataFrame, sizes: DataFrame, sets: DataFrame, cut: tuple[int, int]) -> DataFrame:
    """The rows (region, sid, ...) of large regions with `d0`, the distance to one pivot, and `cells` as voronoi() gives them,
    each as 4 * (cell + 1) + its other number.

    A region's sets are dealt to parts of some LEAF sets each, and its pivots go to every part.
    """
    far, keys = 1 - cut[0] / cut[1], ["region", "part"]
    share = F.pmod(F.xxhash64("region", "sid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    parts = F.ceil(F.col("k") / LEAF).cast("int")
    drawn = rows.join(sizes.select("region", "k"), "region").filter(share < F.lit(4.0 * PIVOTS) / F.col("k"))
    drawn = drawn.groupBy("region", parts.alias("parts")).agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("region", "sid"), "sid"))), 1, PIVOTS).alias("drawn"))
    pivots = drawn.select("region", "drawn", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("region", "part", F.explode("drawn.sid").alias("sid"))
    members = rows.join(sizes.select("region", parts.alias("parts")), "region").select("region", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part"), "sid")
    both = pivots.withColumn("member", F.lit(0)).unionByName(members.withColumn("member", F.lit(1))).join(sets, "sid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run_ in _whole_groups(batches, keys, lambda pdf: int(pdf.raw.map(len).sum()), CHUNK_BYTES):
            ends = _bounds(run_, keys)
            for a, b in zip(ends, ends[1:]):
                own = run_[a:b].drop_duplicates(["member", "sid"])
                raw = [np.frombuffer(r, np.uint64) for r in own.raw]
                m = int((own.member == 0).sum())
                d = _distances(raw[m:], raw[:m]) if m else np.ones((len(raw), 1))
                if len(d):
                    cells = [[4 * (c + 1) + state for c, state in x] for x in voronoi(d, far)]
                    yield pd.DataFrame({"region": own.region[m:].to_numpy(), "sid": own.sid[m:].to_numpy(), "d0": d[:, 0], "cells": cells})

    placed = both.repartition(*keys).sortWithinPartitions(*keys, "member", "sid").mapInPandas(trimmed(run), "region long, sid long, d0 double, cells array<int>")
    return rows.join(placed, ["region", "sid"])


def _blocks(rows: DataFrame, sizes: DataFrame, cut: tuple[int, int]) -> DataFrame:
    """Leaves of dense regions: rows (region, sid, n, d0, ...) in blocks by d0, each two that can hold links as a leaf. What
    fits one block is one leaf, where each set comes once and not with every block that it meets."""
    width = (1 - cut[0] / cut[1]) / 2
    fits = sizes.select("region", ((F.col("k") <= BLOCK_SETS) & (F.col("total") <= BLOCK_SHINGLES)).alias("fits"))
    rows = rows.join(fits, "region").withColumn("bin", F.when(F.col("fits"), 0).otherwise(F.floor(F.col("d0") / width)).cast("long"))
    each = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("long")
    bins = rows.groupBy("region", "bin").agg(each.alias("many"))
    code = lambda part: F.col("bin") * (1 << 31) + part
    rows = rows.join(bins, ["region", "bin"]).withColumn("block", code(F.pmod(F.xxhash64("sid"), F.col("many"))))
    listed = bins.select("region", F.col("bin").alias("other_bin"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("many") - 1), code)).alias("other"))
    # distances that differ by e at most are two bins apart at most; a third makes up for rounding
    met = rows.join(listed, "region").filter(F.abs(F.col("bin") - F.col("other_bin")) <= 3)
    return met.select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "sid", "lower", "own", "far", "depth")


_LEAF_COLUMNS = ["region", "i", "j", "side", "sid", "lower", "own", "far", "depth"]


def _links(rows: DataFrame, sets: DataFrame, cut: tuple[int, int]) -> DataFrame:
    """(sid, links, to) of all regions (region, sid, n, lower), as judged() gives them, leaf by leaf."""
    now = rows.withColumns({"own": F.lit(0).cast("long"), "far": F.lit(0).cast("long"), "depth": F.lit(0)})
    out = None
    level = 0
    while True:
        sizes = materialise(now.groupBy("region").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.max(F.col("own").bitwiseAND(1 << max(0, level - 1)) if level else F.lit(1)).alias("owned")).filter("k > 1 and owned > 0"), "sizes")
        large = (F.col("k") > LEAF) | (F.col("total") > BLOCK_SHINGLES)
        whole = now.join(sizes.filter(~large).select("region"), "region").withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long"), "side": F.lit(0)})
        leaves = whole.select(_LEAF_COLUMNS)
        sizes = sizes.filter(large)
        if not sizes.limit(1).count():
            found = materialise(_judged(leaves, sets, cut), "links")
            return found if out is None else out.unionByName(found)
        inside = materialise(now.join(sizes.select("region"), "region", "left_semi"), "inside")
        wanted = inside.select("sid").distinct()
        held = materialise(sets.join(_sent(wanted)(wanted), "sid", "left_semi"), "sets")
        split = materialise(_divided(inside, sizes, held, cut), "divided")
        cells = split.select("region", "sid", F.explode("cells").alias("cell")).groupBy("region", F.shiftright("cell", 2).alias("c")).agg(F.count(F.lit(1)).alias("rows"))
        cells = cells.groupBy("region").agg(F.sum("rows").alias("rows"), F.max("rows").alias("most")).join(sizes, "region")
        helps = materialise(cells.filter((F.col("rows") <= DENSE * F.col("k")) & (F.col("most") <= MOST * F.col("k"))).select("region"), "helps")
        leaves = leaves.unionByName(_blocks(split.join(helps, "region", "left_anti"), sizes, cut))
        found = materialise(_judged(leaves, sets, cut), "links")
        out = found if out is None else out.unionByName(found)
        bit = 1 << level
        mark = lambda column, state: F.when(F.col("cell").bitwiseAND(3) == state, F.col(column).bitwiseOR(F.lit(bit).cast("long"))).otherwise(F.col(column)).alias(column)  # noqa: B023, E731
        now = split.join(helps, "region").select("*", F.explode("cells").alias("cell"))
        now = now.select(F.xxhash64("region", F.shiftright("cell", 2)).alias("region"), "sid", "n", "lower", mark("own", 1), mark("far", 2), F.lit(level + 1).alias("depth"))
        now = materialise(now, "cells")
        # only what is divided further is carried to the next level
        sets = held
        level += 1


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, cut: tuple[int, int] = CUT) -> DataFrame:
    """(id, n_shingles, component_id, class_id, n_links) for every row.

    component_id: the smallest id reachable by links; class_id: the smallest id with an equal set; n_links: how many
    other sets its set is linked with. A document without words, or with null text, has no shingles and is linked with
    nothing. Null ids are larger than all others; repeated rows each have their row. Other columns are ignored. Empty in,
    empty out.
    """
    texts = _texts(docs, id_col, text_col)
    facts = materialise(_facts(texts, width, cut), "facts")
    owned = facts.filter(F.col("n").isNotNull()).select("id", "n", "sid", "check", "grid")
    nodes = owned.filter("n > 0").groupBy("sid").agg(F.min("id").alias("class_id"), F.min("check").alias("x"), F.max("check").alias("y"), F.max("n").alias("n"), F.max("grid").alias("grid"))
    nodes = nodes.select("sid", "n", "grid", F.when(F.col("x") == F.col("y"), F.col("class_id")).otherwise(F.raise_error(F.lit("two sets share a hash"))).alias("class_id"))
    nodes = materialise(nodes, "nodes")
    of = _pivots(_postings(texts, width, cut, _frequent(facts)))
    of = materialise(of.join(nodes, "sid"), "members")
    members = of.select("sid", "n", "grid", "class_id", "pivots", F.explode("pivots").alias("region"))
    members = members.withColumn("lower", F.filter("pivots", lambda x: x < F.col("region"))).drop("pivots")
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    large = materialise(sizes.filter(F.col("k") > LEAF), "large")
    few = members.join(sizes.filter(F.col("k") <= LEAF).select("region"), "region", "left_semi")
    stay = _partnered(few.select("region", "sid", "n", "grid", "lower"), cut)
    many = members.join(large.select("region"), "region", "left_semi").select("region", "sid", "lower")
    rows = materialise(stay.unionByName(many).join(nodes.select("sid", "n", "class_id"), "sid"), "regions")
    wanted = rows.groupBy("sid").agg(F.coalesce(F.first("class_id"), F.lit(NO_ID)).alias("id"))
    sets = materialise(_sets(texts.withColumn("id", F.coalesce("id", F.lit(NO_ID))), width, wanted), "sets")
    links = _links(rows.select("region", "sid", "n", "lower"), sets, cut)
    labels = components(links.filter("to != sid").select(F.col("sid").alias("lo"), F.col("to").alias("hi")))
    degree = links.groupBy("sid").agg(F.sum("links").alias("n_links"))
    nodes = nodes.select("sid", "class_id")
    labelled = nodes.join(labels.withColumnRenamed("node", "sid"), "sid")
    smallest = labelled.groupBy("component").agg(F.min("class_id").alias("component_id"))
    part = labelled.join(smallest, "component").select("sid", "component_id").join(degree, "sid", "left")
    named = nodes.join(part, "sid", "left").withColumnRenamed("sid", "of")
    out = owned.join(named, (F.col("sid") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "class_id", "id").alias("component_id"),
        F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
