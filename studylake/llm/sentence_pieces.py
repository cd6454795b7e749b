"""SentencePiece encoding and decoding with a distinct-chunk table.

Where no piece has a whitespace marker after another character, a merge cannot cross a marker, so a
text is the sequence of its marked words, and each distinct one is segmented once per table and joined
back by position. The vocabulary is checked when a model is loaded; with one that has crossing pieces,
texts are encoded whole. The library itself segments each word.

Row-local: Arrow UDFs, no shuffle, memory bounded by a batch and the table. Defined cases: null and
empty texts have no piece, only the end id; texts of any length are encoded whole; marker characters
and control characters in a text are treated as the library treats them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm.chunks import ChunkTable
from studylake.llm.shingles import slices

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    """A loaded model with its table."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=model)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.end = self.library.eos_id()
        self.apart = all(MARK not in p.lstrip(MARK) for p in names) and self.library.encode("a b  c", out_type=str)[0].startswith(MARK)
        self.apart &= self.library.decode(self.library.encode("  a  ")) == "  a  " and self.library.normalize(" Å ﬁ") == f"{MARK}{MARK}Å{MARK}ﬁ"
        self.table = ChunkTable(self._segment, 100_000)
        # bytes of each piece; None where only the library knows
        self.bytes: list[bytes | None] = [
            None if self.library.is_unknown(i) else b"" if self.library.is_control(i) else bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(names)
        ]

    def _segment(self, chunks: list[str]) -> Iterable[bytes]:
        """The library puts one marker in front of a text. A lone marker is no text of its own for it: its
        ids are read off in front of a line feed."""
        lone = self.library.encode("\n", num_threads=1)[:-1]
        rest = iter(self.library.encode([c[1:] for c in chunks if c != MARK], num_threads=1))
        return [array("i", lone if c == MARK else next(rest)).tobytes() for c in chunks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text, the end id last."""
        end = np.int32(self.end).tobytes()
        if not self.apart:
            return [np.asarray(ids, "<i4").tobytes() + end for ids in self.library.encode([t or "" for t in texts], num_threads=1)]
        return [ids + end for ids in self.table.encode(texts, self._words)]

    @staticmethod
    def _words(text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or marked.endswith(MARK) or "\x00" in text:
            return WORDS.findall(marked)
        return marked.replace(MARK, "\x00" + MARK)[1:].split("\x00")

    def decode(self, ids: np.ndarray) -> str:
        try:
            joined = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()
        except (TypeError, UnicodeDecodeError):
            return self.library.decode(ids.tolist())
        return joined[1:] if joined.startswith(" ") else joined


@lru_cache(2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def encode(text: Column, model: str) -> Column:
    """Ids of ``text`` as array<int>, with an end id."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        packed = pieces(model).encode(texts.to_pylist())
        offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    return ids(text)


def decode(ids: Column, model: str) -> Column:
    """Text of each id array, as the library decodes it; null for a null array."""

    @F.arrow_udf("string")
    def texts(arrays: pa.Array) -> pa.Array:
        p = pieces(model)
        return pa.array([None if a is None else p.decode(a) for a in _each(arrays)], pa.string())

    return texts(ids)


def _each(arrays: pa.Array) -> Iterable[np.ndarray | None]:
    values, offsets, valid = arrays.values.to_numpy(zero_copy_only=False), arrays.offsets.to_numpy(), arrays.is_valid().to_numpy(zero_copy_only=False)
    return (values[offsets[i] : offsets[i + 1]] if valid[i] else None for i in range(len(arrays)))


def both_ways(model: str):
    """Ids of each text and the text they decode to, in small batches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in (part for whole in batches for part in slices(whole, "text", 2 << 20)):
            packed = p.encode(batch.column("text").to_pylist())
            offsets = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            decoded = pa.array([p.decode(np.frombuffer(x, "<i4")) for x in packed], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded], names=["doc_id", "ids", "decoded"])

    return rows


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Encodes and decodes ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = docs.select("doc_id", "text").mapInArrow(both_ways(model), "doc_id long, ids array<int>, decoded string")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
