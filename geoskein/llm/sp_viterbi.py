"""SentencePiece encoding by one Viterbi pass over a trie of distinct words, and decoding.

A marked word is a run of U+2581 signs with what follows up to the next such sign or line feed; a line feed stands
alone. No piece of the vocabularies used reaches over those borders (checked on loading), so the best
segmentation of a text is that of its marked words in turn. The distinct words of a batch are sorted, which lays
them out as a trie in depth-first order: a word keeps the forward scores of the prefix it shares with the one
before and only computes the rest.

Segmentations have the largest sum of piece scores; of equal ones, that whose last piece is longest, and so on
backwards. A character that no piece covers costs the least score less 10 and is written as byte pieces.
A literal U+2581 is written as byte pieces too, so that decoding gives back every text exactly.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Stands for a literal U+2581 inside the encoder: a lone surrogate, which no text and no piece holds.
_LITERAL = "\udc81"
_CHUNKS = re.compile(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
UNKNOWN_PENALTY = 10.0
CACHE = 300_000


class Vocabulary:
    def __init__(self, pieces: list[str], scores: list[float], bytes_at: dict[int, int], controls: set[int]):
        """bytes_at: the id of each byte's piece; controls: ids that stand for no text."""
        self.ids: dict[str, tuple[int, float]] = {}
        for k, (piece, score) in enumerate(zip(pieces, scores, strict=True)):
            if k in controls or k in bytes_at.values():
                continue
            if MARK in piece.lstrip(MARK) or ("\n" in piece and piece != "\n"):
                raise ValueError(f"piece {piece!r} reaches over the border of a marked word")
            self.ids.setdefault(piece, (k, score))
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min((s for _, s in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.bytes_at = bytes_at
        self.text_of = [b"" if k in controls else piece.replace(MARK, " ").encode() for k, piece in enumerate(pieces)]
        for b, k in bytes_at.items():
            self.text_of[k] = bytes([b])
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        return cls(
            [m.id_to_piece(k) for k in range(n)], [m.get_score(k) for k in range(n)],
            {int(m.id_to_piece(k)[1:-1], 16): k for k in range(n) if m.is_byte(k)}, {k for k in range(n) if m.is_control(k) or m.is_unknown(k)},
        )

    def segment_all(self, words: list[str]) -> None:
        """Remember the packed ids of every word, walking their trie depth-first."""
        ids, longest, unknown = self.ids, self.longest, self.unknown
        best, last = [0.0], [(0, -1)]
        before = ""
        for word in sorted(set(words)):
            keep = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                keep += 1
            del best[keep + 1 :], last[keep + 1 :]
            for end in range(keep + 1, len(word) + 1):
                top, at = best[end - 1] + unknown, (end - 1, -1)
                # from the longest piece on: a later, shorter one must be better, not equal; any beats an unknown of equal score
                found = False
                for start in range(max(0, end - longest), end):
                    piece = ids.get(word[start:end])
                    if piece is not None and ((score := best[start] + piece[1]) > top or (score == top and not found)):
                        top, at, found = score, (start, piece[0]), True
                best.append(top)
                last.append(at)
            before = word
            out: list[list[int]] = []
            end = len(word)
            while end:
                start, k = last[end]
                if k < 0:
                    raw = word[start:end]
                    out.append([self.bytes_at[b] for b in (MARK if raw == _LITERAL else raw).encode("utf-8", "surrogatepass")])
                else:
                    out.append([k])
                end = start
            self.known[word] = array("I", [k for part in reversed(out) for k in part]).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed unsigned 32-bit ids of each text; none for an empty text."""
        if len(self.known) > CACHE:
            self.known.clear()
        chunks = [_CHUNKS.findall(MARK + t.replace(MARK, _LITERAL).replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        new = {c for words in chunks for c in words if c not in known}
        if new:
            self.segment_all(list(new))
        return [b"".join(map(known.__getitem__, words)) for words in chunks]

    def decode(self, ids: bytes | list[int]) -> str:
        """The text of ids; the one space that encoding puts first is taken off."""
        made = b"".join(map(self.text_of.__getitem__, memoryview(ids).cast("I") if isinstance(ids, bytes) else ids))
        return made.decode("utf-8", "replace").removeprefix(" ")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.load(path)
    return _LOADED[path]


def _mapped(docs: DataFrame, model: str, id_col: str, text_col: str, make, schema: str, batch_chars: int = 4_000_000) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for pdf in batches:
            sizes = pdf.text.str.len().to_numpy().cumsum() // batch_chars if len(pdf) else []
            for _, part in pdf.groupby(sizes, sort=True):
                yield make(v, part["id"], part.text.tolist())

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row. Null and empty texts have no ids; repeated rows and null ids are encoded like others."""

    def make(v: Vocabulary, ids: pd.Series, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"id": ids.to_numpy(), "ids": [np.frombuffer(b, np.int32) for b in v.encode_batch(texts)]})

    return _mapped(docs, model, id_col, text_col, make, "id long, ids array<int>")


def decoded(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded rows; null ids give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "text": [v.decode(() if x is None else x.tolist()) for x in pdf["ids"]]})

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, "id long, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, text_crc32, round_trip): each text encoded and decoded in one pass.

    round_trip says whether decoding gave the text back; text_crc32 is of the decoded text in UTF-8.
    """

    def make(v: Vocabulary, ids: pd.Series, texts: list[str]) -> pd.DataFrame:
        packed = v.encode_batch(texts)
        back = [v.decode(b) for b in packed]
        return pd.DataFrame({
            "id": ids.to_numpy(), "n_ids": [len(b) // 4 for b in packed], "ids_crc32": [zlib.crc32(b) for b in packed],
            "text_crc32": [zlib.crc32(t.encode()) for t in back], "round_trip": [a == b for a, b in zip(texts, back, strict=True)],
        })

    return _mapped(docs, model, id_col, text_col, make, "id long, n_ids long, ids_crc32 long, text_crc32 long, round_trip boolean")
