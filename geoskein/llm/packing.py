"""Best-fit packing of token sequences with certified bin counts.

Documents are tokenised once; only (item, length) rows are packed. Each partition packs its items by best-fit
decreasing and compares its bin count with the largest of several dual-feasible-function lower bounds. Equal
means optimal, and the partition is certified. Partitions with a gap exchange the items of their open bins
(certified ones only their loosest bin), and best-fit decreasing runs again on the new groups, while that
saves bins. Each row tells how far its partition is from its bound.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoskein.llm.common import materialise, trimmed

SIZE = 1024
END = 2
#: Items in a group: what one task packs at a time.
GROUP_ITEMS = 50_000
#: Repacking goes on while a round saves at least this share of the bins that it repacks.
LEAST_SAVING = 0.001
CACHE = 700_000
#: Characters whose units are learned together.
LEARN_CHARS = 3_000_000
#: Fixed value: the pattern by which byte-level BPE files of this kind split texts before merging.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile(r"\s\s|[\x1c-\x1f]")


def ranks(vocab: dict[str, int], merges: list) -> dict[bytes, int]:
    """Bytes to id of the single bytes and of what each merge makes. The ids of merges rise in the order of the merges."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    ids = [vocab[m] for m in made]
    if ids != sorted(ids):
        raise ValueError("the ids of this vocabulary don't follow its merges")
    return {bytes(byte_of[c] for c in t): vocab[t] for t in [*byte_of, *made]}


class Tokens:
    """Ids of texts by a byte-level BPE tokenizer file. Where encode_special_tokens is set, as in the tokenizers library,
    strings of special tokens are ordinary text; else texts are cut at the file's added tokens, which have their own ids.

    The words of a text are encoded on their own, each with the space before it, and remembered: a pre-token never
    reaches from a character that isn't white space over the next white space, and where no two white spaces meet,
    a space always belongs to the word after it. So the ids are those of the whole text. The merges of the file run
    in tiktoken, which gives the same ids in less time.
    """

    def __init__(self, path: str, encode_special_tokens: bool = True):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        added = [t for t in file.get("added_tokens") or [] if not (encode_special_tokens and t["special"])]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip or match whole words only aren't supported")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added if t["content"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        merged = ranks(model["vocab"], model["merges"])
        self.sizes = np.zeros(max(merged.values()) + 1, np.int64)
        self.sizes[list(merged.values())] = [len(t) for t in merged]
        self.whole = tiktoken.Encoding("file", pat_str=PRETOKEN, mergeable_ranks=merged, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def learn(self, units: set[str]) -> None:
        """Remember the ids of units, each with a space before it. They are encoded in one text and told apart by their bytes."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(units.difference(self.known))
        if new:
            ids = array("I", self.whole(" " + " ".join(new)))
            ends = np.cumsum([len(u) + 1 if u.isascii() else len(u.encode()) + 1 for u in new])
            at = 4 * (np.searchsorted(np.cumsum(self.sizes[np.frombuffer(ids, np.uint32)]), ends) + 1)
            packed, start = ids.tobytes(), 0
            for u, end in zip(new, at.tolist(), strict=True):
                self.known[u] = packed[start:end]
                start = end

    def packed_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit numbers."""
        if not self.cut:
            return self._packed(texts)
        found = [self.cut.split(t) if any(a in t for a in self.added) else [t] for t in texts]
        # every second part is an added token; empty parts have no ids
        made = iter(self._packed([part for own in found for part in own[::2]]))
        return [b"".join(self.added[part] if k % 2 else next(made) for k, part in enumerate(own)) for own in found]

    def _packed(self, texts: list[str]) -> list[bytes]:
        """packed_batch() of texts without added tokens. Texts with neighbouring white spaces are encoded whole."""
        plain = [bool(t) and not (_ODD.search(t) or t[0].isspace() or t[-1].isspace()) for t in texts]
        units = [t.split(" ") if fine else None for t, fine in zip(texts, plain, strict=True)]
        self.learn({u for own in units if own for u in own[1:]})
        get, out = self.known.__getitem__, []
        for t, own in zip(texts, units, strict=True):
            if own:
                out.append(array("I", self.whole(own[0])).tobytes() + b"".join(map(get, own[1:])))
            else:
                out.append(array("I", self.whole(t)).tobytes())
        return out


_LOADED: dict[tuple[str, bool], Tokens] = {}


def tokens(path: str, encode_special_tokens: bool = True) -> Tokens:
    if (path, encode_special_tokens) not in _LOADED:
        _LOADED[path, encode_special_tokens] = Tokens(path, encode_special_tokens)
    return _LOADED[path, encode_special_tokens]


def cuts(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole up to size tokens, else the first piece takes what is over."""
    over = n % size
    return ([(0, over)] if over else []) + [(at, size) for at in range(over, n, size)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False, encode_special_tokens: bool = True) -> DataFrame:
    """(id, item, piece, start, length, ids_crc32[, ids]): the pieces of every document, an end token after each.

    Null and empty texts give one piece of the end token alone. A null id stays null. `item` numbers the pieces
    within the whole table; other columns are ignored.
    """
    from pyspark import TaskContext

    end = array("I", [END]).tobytes()

    def packed(own, column):
        held, chars = [], 0
        for text in column:
            held.append(text.as_py() or "")
            chars += len(held[-1])
            if chars > LEARN_CHARS:
                yield from own.packed_batch(held)
                held, chars = [], 0
        yield from own.packed_batch(held)

    def cut(batches):
        own, item = tokens(tokenizer, encode_special_tokens), TaskContext.get().partitionId() << 36
        for batch in batches:
            names = ["id", "item", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            cols = [[] for _ in names]
            for key, ids in zip(batch.column(0).to_pylist(), packed(own, batch.column(1)), strict=True):
                ids += end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = [key, item, k, start, length, zlib.crc32(part)]
                    if with_ids:
                        row.append(np.frombuffer(part, np.uint32).astype(np.int32))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    item += 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names)

    schema = "id long, item long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(trimmed(cut), schema)


def lower_bound(lengths: np.ndarray, size: int = SIZE) -> int:
    """The most bins that any of three families of dual-feasible functions proves necessary.

    With counts h of the lengths x: the sum of x; for each e up to size/2 the function that maps x > size-e to size,
    x < e to 0 and others to x; and for each such e the rounding of x to steps of e from below, with x over size/2
    taken as the complement of its rounded complement.
    """
    if not len(lengths):
        return 0
    h = np.bincount(lengths, minlength=size + 1)
    x = np.flatnonzero(h)
    n = h[x]
    best = -(-int((n * x).sum()) // size)
    for e in x[x <= size // 2].tolist():
        clipped = np.where(x > size - e, size, np.where(x < e, 0, x))
        best = max(best, -(-int((n * clipped).sum()) // size))
        steps = size // e
        rounded = np.where(2 * x > size, 2 * (steps - (size - x) // e), np.where(2 * x == size, steps, 2 * (x // e)))
        best = max(best, -(-int((n * rounded).sum()) // (2 * steps)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and the room left in each bin. Items are taken longest first, in the order given."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0
    for k, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_rooms >> length
        if fitting:
            r = length + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = size, len(room)
            room.append(size)
        bins[k], offsets[k] = b, size - r
        r -= length
        room[b] = r
        if r:
            if not by_room[r]:
                open_rooms |= 1 << r
            by_room[r].append(b)
    return bins, offsets, np.array(room, np.int64)


def _packed(items: DataFrame, groups: int, number: int, size: int) -> DataFrame:
    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        lengths = pdf.length.to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, size)
        gap = len(room) - lower_bound(lengths, size)
        loosest = int(room.argmax())
        moves = (room[bins] > 0) & ((gap > 0) | (bins == loosest))
        return pd.DataFrame({"item": pdf.item, "length": lengths, "sequence_id": (number << 54) + (int(key[0]) << 20) + bins, "offset": offsets, "moves": moves, "gap": gap})

    rows = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(groups)).alias("g"))
    return rows.groupBy("g").applyInPandas(one, "item long, length long, sequence_id long, offset long, moves boolean, gap long")


def pack(items: DataFrame, size: int = SIZE, group_items: int = GROUP_ITEMS, least_saving: float = LEAST_SAVING) -> DataFrame:
    """(item, sequence_id, offset, gap) for rows (item, length), lengths from 1 to size, item distinct. Empty in, empty out.

    gap: by how many the bins of the partition that packed the item last exceed its lower bound; 0 certifies them.
    """
    groups = -(-max(1, items.count()) // group_items)
    now = materialise(_packed(items, groups, 0, size), "packed")
    settled = None
    for number in count(1):
        moving = now.filter("moves")
        n, before = moving.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
        if not n or (groups == 1 and number > 1) or before < 2:
            break
        groups = -(-n // group_items)
        again = materialise(_packed(moving, groups, number, size), "repacked")
        after = again.agg(F.countDistinct("sequence_id")).first()[0]
        if after >= before:
            break
        fixed = now.filter("not moves")
        settled = fixed if settled is None else settled.unionByName(fixed)
        now = again
        if before - after < least_saving * before:
            break
    out = now if settled is None else settled.unionByName(now)
    return out.select("item", "sequence_id", "offset", "gap")


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, encode_special_tokens: bool = True) -> DataFrame:
    """Every piece with its place: (id, piece, start, length, ids_crc32, sequence_id, offset, gap[, ids]); gap as pack() has it."""
    own = materialise(pieces(docs, tokenizer, id_col, text_col, with_ids=with_ids, encode_special_tokens=encode_special_tokens), "pieces")
    placed = pack(own.select("item", "length"))
    return own.join(placed, "item").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap", *["ids"] * with_ids)
