"""Token ids in binary shards with a minimal perfect hash index.

Documents are dealt by ranges of doc_id, in ascending order, into shards of about ``shard_bytes`` of text. A shard
file is: magic, id width in bytes, numbers of documents and ids, the task and place that wrote it (they order the shards),
the raw little-endian ids of its documents one after the other, then per document whether it has a key, its key and its
number of ids. Ids take two bytes where the vocabulary allows it. Files are written and read by Spark's own sources, so they
go to any store Spark knows, and a lost task leaves no half shard. A line feed ends each file.

The index maps keys to documents. Keys are dealt by hash into buckets of about ``bucket_keys``; each bucket has a minimal perfect
hash of levels: a key that is alone on its place in a level's bit array is settled there, the others go to the next level, and a
key's slot is the rank of its bit. A slot stores a fingerprint of its key, the document's number in global order, the shard and
the offset of its first id there, and how many documents have the key. A look-up reads a few bits and one slot.

Defined cases: null and empty texts are the end id alone; documents without a key come first and are not in the index;
documents that share a key follow each other, in the order of a hash of their text; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.stage import stage_path
from studylake.llm.chunks import ChunkTable
from studylake.llm.common import small_batches, store
from studylake.llm.shingles import slices

MAGIC = b"TOKSHRD1"
HEAD = "<8sIQQII"
RUN = re.compile(r"\s\s")
BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")
UNSURE = "\x00\x1c\x1d\x1e\x1f\x85\u180e"  # white space to Python or to the tokenizer only, and the cutting mark
WORD = re.compile(r" ?\S+")
LINES = 200  # words encoded as one text
MARK_ALONE = re.compile(r"[.,](?<![^\W\d_].)[ \n]")  # a mark that does not follow a letter


class Encoder:
    """A byte-level tokenizer with its chunk table. Its pre-tokens never continue over a space between two
    other characters, so texts are cut there and each distinct chunk is encoded once. Chunks are numbered and their
    ids put together for whole groups of texts, without a Python step per chunk; new words go to the library by the line."""

    def __init__(self, file: str, width: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs in parallel
        self.library, self.width, self.kind = Tokenizer.from_file(file), width, "H" if width == 2 else "I"
        self.apart = self.library.normalizer is None and type(self.library.pre_tokenizer).__name__ == "ByteLevel"
        self.table = ChunkTable(self._segment, 200_000)
        feed = self.library.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if self.apart and len(feed) == 1 else None

    def _segment(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of each chunk. Words are encoded as lines of a text: a line feed between them is a pre-token and an id of
        its own, which stands nowhere else."""
        out: list[bytes] = [b""] * len(chunks)
        words = [i for i, c in enumerate(chunks) if WORD.fullmatch(c)] if self.feed is not None else []
        alone = set(range(len(chunks))).difference(words)
        for i in range(0, len(words), LINES * 100):
            lines = [words[j : j + LINES] for j in range(i, min(i + LINES * 100, len(words)), LINES)]
            for of, e in zip(lines, self.library.encode_batch_fast(["\n".join(map(chunks.__getitem__, x)) for x in lines], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, f"<u{self.width}")
                ends, data = (np.flatnonzero(ids == self.feed) * self.width).tolist(), ids.tobytes()
                if len(ends) != len(of) - 1:
                    alone.update(of)
                    continue
                for k, a, b in zip(of, [0, *(x + self.width for x in ends)], [*ends, len(data)], strict=True):
                    out[k] = data[a:b]
        rest = sorted(alone)
        for i in range(0, len(rest), LINES * 100):
            part = rest[i : i + LINES * 100]
            for k, e in zip(part, self.library.encode_batch_fast([chunks[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = array(self.kind, e.ids).tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; callers pass a few megabytes at a time."""
        cut = [(i, marked) for i, t in enumerate(texts) if t and (marked := self._marked(t)) is not None]
        whole = [i for i in set(range(len(texts))).difference(i for i, _ in cut) if texts[i]]
        out = [b""] * len(texts)
        for i, ids in zip(whole, self._segment([texts[i] for i in whole]), strict=True):
            out[i] = ids
        if cut:
            chunks = pc.split_pattern(pa.array(["\x00".join(m for _, m in cut)], pa.large_string()), "\x00").flatten().dictionary_encode()
            found = self.table.get(chunks.dictionary.to_pylist())
            ids = np.frombuffer(b"".join(found), f"<u{self.width}")
            sizes = np.array([len(x) for x in found], np.int64) // self.width
            at, of = np.cumsum(sizes) - sizes, chunks.indices.to_numpy()
            each = sizes[of]
            ends = np.cumsum(each)
            ids = ids[np.repeat(at[of] - (ends - each), each) + np.arange(ends[-1])]
            last = ends[np.cumsum([m.count("\x00") + 1 for _, m in cut]) - 1].tolist()
            for (i, _), a, b in zip(cut, [0, *last], last, strict=False):
                out[i] = ids[a:b].tobytes()
        return out

    def _marked(self, text: str) -> str | None:
        """``text`` with a mark between its chunks; none if it must stay whole."""
        if not self.apart or any(c in text for c in UNSURE):
            return None
        if text[0] == " " or text[-1] == " " or RUN.search(text):
            return "\x00".join(BEFORE_WORD.split(text))
        if not MARK_ALONE.search(text):  # a mark between a letter and white space is a pre-token of its own
            text = text.replace(". ", "\x00. ").replace(", ", "\x00, ").replace(".\n", "\x00.\n")
        return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ")


@lru_cache(2)
def encoder(file: str, width: int) -> Encoder:
    return Encoder(file, width)


@lru_cache(2)
def id_width(file: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(file).get_vocab_size() < 1 << 16 else 4


def pack_rows(file: str, width: int, end_id: int, shard_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, place = end_id.to_bytes(width, "little"), 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = 0
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = batch.column("text").to_pylist()
            for key, packed in zip(batch.column("doc_id").to_pylist(), encoder(file, width).encode(texts), strict=True):
                keys.append(key)
                ids.append(packed + end)
                size += len(packed) + width
                if size >= shard_bytes:
                    yield shard(keys, ids, place)
                    keys, ids, size, place = [], [], 0, place + 1
        if keys:
            yield shard(keys, ids, place)

    def shard(keys: list[int | None], ids: list[bytes], place: int) -> pa.RecordBatch:
        counts = np.array([len(x) // width for x in ids], "<u8")
        head = struct.pack(HEAD, MAGIC, width, len(keys), int(counts.sum()), TaskContext.get().partitionId(), place)
        table = np.array([k is not None for k in keys], np.uint8).tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + counts.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([b"".join([head, *ids, table])], pa.binary())], names=["data"])

    return rows


class Shard(NamedTuple):
    task: int
    place: int
    keyed: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


def read_shard(data: bytes) -> Shard:
    magic, width, docs, n, task, place = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a shard")
    at = struct.calcsize(HEAD)
    ids = np.frombuffer(data, f"<u{width}", n, at)
    at += n * width
    keyed = np.frombuffer(data, np.uint8, docs, at)
    keys = np.frombuffer(data, "<i8", docs, at + docs)
    counts = np.frombuffer(data, "<u8", docs, at + 9 * docs)
    return Shard(task, place, keyed, keys, counts.astype(np.int64), ids)


def document_rows(digests: bool):
    """Per document of each shard file: its key and place, and a digest of its ids where asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                s = read_shard(content.as_buffer())
                n = len(s.keys)
                before = np.cumsum(s.counts) - s.counts
                crc = [zlib.crc32(s.ids[a : a + c].astype("<u4").tobytes()) for a, c in zip(before.tolist(), s.counts.tolist(), strict=True)] if digests else [0] * n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, s.task)), pa.array(np.full(n, s.place)), pa.array(np.arange(n)), pa.array(s.keys.astype(np.int64), mask=s.keyed == 0),
                     pa.array(before), pa.array(s.counts), pa.array(crc, pa.int64())],
                    names=["task", "place", "nth", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    return rows


DOCUMENTS = "task long, place long, nth long, doc_id long, before long, n_tokens long, ids_crc32 long"


class TokenFiles(NamedTuple):
    shards: str  # folder of shard files
    manifest: DataFrame  # task, place, first_doc, first_id
    index: DataFrame
    buckets: int


def write(docs: DataFrame, file: str, end_id: int = 0, shard_bytes: int = 16 << 20, bucket_keys: int = 1 << 16) -> TokenFiles:
    """Encodes ``docs`` (doc_id, text) with the tokenizer in ``file`` and writes shards, manifest and index."""
    spark, width = docs.sparkSession, id_width(file)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tie = F.xxhash64("text")
    dealt = docs.withColumn("tie", tie).repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    packed = dealt.mapInArrow(pack_rows(file, width, end_id, shard_bytes), "data binary")
    path = stage_path(spark)
    with small_batches(spark):
        packed.select(F.col("data").cast("string")).write.option("maxRecordsPerFile", 1).text(path)

    rows = store(documents(spark, path, digests=False)).df
    sizes = rows.groupBy("task", "place").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("ids"))
    earlier = Window.orderBy("task", "place").rowsBetween(Window.unboundedPreceding, -1)  # over shards, not documents
    manifest = store(sizes.select("task", "place", F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("first_doc"), F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first_id"))).df
    keyed = rows.filter("doc_id is not null").join(manifest, ["task", "place"]).select("doc_id", (F.col("first_doc") + F.col("nth")).alias("number"), "task", "place", "before")
    keys = store(keyed.groupBy("doc_id").agg(F.min(F.struct("number", "task", "place", "before")).alias("at"), F.count("*").alias("run")).select("doc_id", "at.*", "run")).df
    buckets = max(1, -(-keys.count() // bucket_keys))
    index = keys.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")).applyInPandas(index_bucket, INDEX)
    return TokenFiles(path, manifest, store(index).df, buckets)


def documents(spark, path: str, digests: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(document_rows(digests), DOCUMENTS)


INDEX = "bucket long, sizes array<long>, bits array<binary>, fingerprints binary, numbers binary, tasks binary, places binary, offsets binary, runs binary"
_ODD = [np.uint64(x) for x in np.random.default_rng(10).integers(1 << 62, size=256) * 2 + 1]


def key_hash(keys: np.ndarray, level: int) -> np.ndarray:
    h = (keys.astype(np.int64).view(np.uint64) + _ODD[level]) * _ODD[level + 64]
    h = (h ^ (h >> np.uint64(31))) * _ODD[level + 128]
    return h ^ (h >> np.uint64(32))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return key_hash(keys, 63).astype(np.uint32)


def build_levels(keys: np.ndarray) -> tuple[list[int], list[bytes], np.ndarray]:
    """Bit arrays of the levels (sizes, packed bits) and the slot of each key."""
    slots, rest = np.empty(len(keys), np.int64), np.arange(len(keys))
    sizes, bits, placed = [], [], 0
    while len(rest):
        m = 2 * len(rest) + 1
        place = (key_hash(keys[rest], len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(place, minlength=m) == 1
        rank = np.cumsum(alone) - 1
        settled = alone[place]
        slots[rest[settled]] = placed + rank[place[settled]]
        placed += int(settled.sum())
        sizes.append(m)
        bits.append(np.packbits(alone, bitorder="little").tobytes())
        rest = rest[~settled]
    return sizes, bits, slots


def find_slots(keys: np.ndarray, sizes: list[int], bits: list[bytes]) -> np.ndarray:
    """Slots of ``keys``; -1 where no level has the key's bit."""
    slots, rest, placed = np.full(len(keys), -1), np.arange(len(keys)), 0
    for level, (m, packed) in enumerate(zip(sizes, bits, strict=True)):
        alone = np.unpackbits(np.frombuffer(packed, np.uint8), count=m, bitorder="little")
        place = (key_hash(keys[rest], level) % np.uint64(m)).astype(np.int64)
        found = alone[place] == 1
        rank = np.cumsum(alone) - 1
        slots[rest[found]] = placed + rank[place[found]]
        placed += int(alone.sum())
        rest = rest[~found]
    return slots


COLUMNS = {"number": ("numbers", "<i8"), "task": ("tasks", "<i8"), "place": ("places", "<i8"), "before": ("offsets", "<i8"), "run": ("runs", "<i8")}


def index_bucket(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    keys = group["doc_id"].to_numpy()
    sizes, bits, slots = build_levels(keys)
    order = np.argsort(slots)
    row = {"bucket": key[0], "sizes": sizes, "bits": bits, "fingerprints": fingerprint(keys[order]).astype("<u4").tobytes()}
    row |= {name: group[c].to_numpy()[order].astype(kind).tobytes() for c, (name, kind) in COLUMNS.items()}
    return pd.DataFrame([row])


def find(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """Index entries of ``keys`` (doc_id): doc_id, number, task, place, before, run; keys that are not there give no row."""

    def probe(key: tuple, wanted: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", *COLUMNS]
        if wanted.empty or bucket.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        ids, b = wanted["doc_id"].to_numpy(), bucket.iloc[0]
        slots = find_slots(ids, list(b["sizes"]), list(b["bits"]))
        ids, slots = ids[slots >= 0], slots[slots >= 0]
        same = np.frombuffer(b["fingerprints"], "<u4")[slots] == fingerprint(ids)
        ids, slots = ids[same], slots[same]
        return pd.DataFrame({"doc_id": ids} | {c: np.frombuffer(b[name], kind)[slots] for c, (name, kind) in COLUMNS.items()})

    wanted = keys.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    wanted = wanted.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(files.buckets)).alias("bucket"))
    return wanted.cogroup(files.index.groupBy("bucket")).applyInPandas(probe, "doc_id long, number long, task long, place long, before long, run long")


def read_back(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """What the files have for ``keys``, and for documents without a key: doc_id, start (ids before it), n_tokens, ids_crc32."""
    rows = documents(keys.sparkSession, files.shards, digests=True).join(files.manifest, ["task", "place"])
    rows = rows.select("doc_id", (F.col("first_doc") + F.col("nth")).alias("number"), (F.col("first_id") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    found = find(files, keys).select("doc_id", F.explode(F.sequence("number", F.col("number") + F.col("run") - 1)).alias("number"))
    keyed = found.join(rows.drop("doc_id"), "number").select("doc_id", "start", "n_tokens", "ids_crc32")
    return keyed.unionByName(rows.filter("doc_id is null").select("doc_id", "start", "n_tokens", "ids_crc32"))
