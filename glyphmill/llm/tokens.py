"""Token-id files with keyed access: raw ids, and a minimal perfect hash from keys to offsets.

A shard is one file, little-endian throughout:

    magic       8 bytes, `GMIDS\\x00\\x01\\x00`
    counts      u64 x 6: bytes an id (2 or 4), documents, ids, distinct keys, null keys, hash levels
    levels      u64 a level: its bits (a multiple of 64)
    bits        the bit array of each level, u64 words
    ranks       u64 a word: the set bits before it, over all levels
    fingerprint u32 a slot: of the key that holds it
    record      u64 a slot: its first document; u64 a slot: its documents
    starts      u64 a document and one more: ids before it in the shard
    keys        i64 a document (0 under a null), in ascending order, nulls first
    payload     the ids of all documents, one after the other

The hash: at each level a key falls on one bit, and keys that are alone on theirs settle there;
the others go on to the next level.  The slot of a key is the number of set bits before its own:
constant time, about three bits a key.  A key that is not in the shard meets no set bit, or a
fingerprint that differs (but for one in 2^32 of such keys).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .chunks import encoder
from .common import LEAST, bucket_of, dealt_bucket, dealt_table, key_bounds, lean, mix64, parallelism, scratch, written

MAGIC = b"GMIDS\x00\x01\x00"
GAMMA = 2  # bits of a level for each key that reaches it
END_ID = 1
CACHED_PIECES = 1 << 18  # of a generation of a worker's cache (about 180 bytes each): nothing else is held there
SHARD_IDS = 1 << 23  # ids after which a shard ends


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1))


FINGERPRINT_SEED = 1 << 20


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, FINGERPRINT_SEED) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.first = np.cumsum([0, *sizes]) // 64
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint64)[:-1]]).astype("<u8") if len(words) else np.zeros(0, "<u8")

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(keys):
            bits = max(64, -(-GAMMA * len(keys) // 64) * 64)
            at = (_hash(keys, level) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits)[at] == 1
            words = np.zeros(bits // 64, "<u8")
            np.bitwise_or.at(words, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            sizes.append(bits)
            parts.append(words)
            keys, level = keys[~alone], level + 1
        return PerfectHash(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = (_hash(keys[left], level) % np.uint64(bits)).astype(np.int64)
            word, bit = self.first[level] + (at >> 6), (at & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[left[here]] = (self.ranks[word[here]] + np.bitwise_count(below)).astype(np.int64)
            left = left[~here]
        return out


def shard_bytes(keys: list[int | None], data: list[bytes], width: int) -> bytes:
    """A shard of documents in ascending order of key, nulls first; data: their ids of `width` bytes."""
    nulls = sum(k is None for k in keys)
    column = np.array([k or 0 for k in keys], "<i8")
    distinct, first, count = np.unique(column[nulls:], return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slot = index.slots(distinct)
    prints, record, records = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u8"), np.zeros(len(distinct), "<u8")
    prints[slot], record[slot], records[slot] = _fingerprints(distinct), first + nulls, count
    starts = np.concatenate([[0], np.cumsum([len(d) // width for d in data])]).astype("<u8")
    head = struct.pack("<8s6Q", MAGIC, width, len(keys), int(starts[-1]), len(distinct), nulls, len(index.sizes))
    return b"".join([head, np.array(index.sizes, "<u8").tobytes(), index.words.tobytes(), index.ranks.tobytes(), prints.tobytes(), record.tobytes(), records.tobytes(), starts.tobytes(), column.tobytes(), *data])


class Shard:
    """A shard, of which the index is read at once and ids as they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        """read: bytes from a place on, so many."""
        magic, self.width, self.n_docs, self.n_ids, n_keys, self.nulls, levels = struct.unpack("<8s6Q", read(0, 56))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(read(at, n * np.dtype(kind).itemsize), kind, n)
            at += out.nbytes
            return out

        sizes = take("<u8", levels).astype(np.int64).tolist()
        n_words = sum(sizes) // 64
        self.index = PerfectHash(sizes, take("<u8", n_words))
        self.index.ranks = take("<u8", n_words)
        self.prints, self.record, self.records = take("<u4", n_keys), take("<u8", n_keys), take("<u8", n_keys)
        self.starts, self.keys = take("<u8", self.n_docs + 1), take("<i8", self.n_docs)
        self._read, self._payload = read, at

    @staticmethod
    def of(data: bytes) -> Shard:
        view = memoryview(data)
        return Shard(lambda at, n: view[at : at + n])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; -1 and 0 where it is not here."""
        slot = self.index.slots(keys)
        if not len(self.prints):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        there = (slot >= 0) & (self.prints[slot] == _fingerprints(keys))
        return np.where(there, self.record[slot].astype(np.int64), -1), np.where(there, self.records[slot].astype(np.int64), 0)

    def document(self, i: int) -> np.ndarray:
        start, end = int(self.starts[i]), int(self.starts[i + 1])
        return np.frombuffer(self._read(self._payload + start * self.width, (end - start) * self.width), f"<u{self.width}")

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each document of a key, in constant time but for their length."""
        if key is None:
            return [self.document(i) for i in range(self.nulls)]
        first, n = (int(x[0]) for x in self.find(np.array([key], np.int64)))
        return [self.document(first + i) for i in range(n) if self.keys[first + i] == key]


def width_for(tokenizer: str, end_id: int) -> int:
    """Bytes that hold every id of a tokenizer: 2 or 4."""
    return 2 if max(encoder(tokenizer, CACHED_PIECES).most_id, end_id) < 1 << 16 else 4


def narrowed(data: bytes, width: int) -> bytes:
    """Unsigned 32-bit ids in `width` bytes each; an id that doesn't fit is an error."""
    ids = np.frombuffer(data, "<u4")
    if width < 4 and len(ids) and ids.max() >= 1 << (8 * width):
        raise ValueError(f"an id of {ids.max()} doesn't fit in {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def encode(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """doc_id, ids binary: the ids of each whole text, then end_id, in `width` bytes each."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer, CACHED_PIECES).batch
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                data = [narrowed(x + end, width) for x in encode_all([t or "" for t in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run, "pieces"), "doc_id bigint, ids binary")


MANIFEST = "bucket int, part int, file string, n_docs bigint, n_ids bigint, n_nulls bigint, low bigint, high bigint"


def write_shards(encoded: DataFrame, path: str, bounds: list[int], width: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes shards under path in ascending doc_id; gives the MANIFEST, a row a shard with its least and greatest key.

    The rows are dealt by ascending ranges of doc_id, one task a range; a task holds one shard in
    memory.  A file gets its name, which no other attempt of the task has, when it is whole; those
    that the manifest doesn't name are not read.  Documents of one doc_id stand side by side, by a
    hash of their ids; a doc_id of very many documents takes several ranges.
    """
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_nulls", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        bucket, part, n = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        data: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal keys, data, part, n
            attempt = uuid.uuid4().hex
            name = f"{bucket:06d}-{part:06d}-{attempt}.ids"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/_{attempt}") as out:
                out.write(shard_bytes(keys, data, width))
            store.move(f"{root}/_{attempt}", f"{root}/{name}")
            known = [k for k in keys if k is not None]
            row = bucket, part, name, len(keys), n, len(keys) - len(known), min(known, default=None), max(known, default=None)
            keys, data, part, n = [], [], part + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                data.append(ids)
                n += len(ids) // width
                if n >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    hashed = encoded.withColumn("__h", F.xxhash64("ids"))
    dealt = hashed.repartitionById(len(bounds) + 1, dealt_bucket(F.col("doc_id"), F.col("__h"), bounds)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__h", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(lean(run), MANIFEST)


def read_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files, through their index."""
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard.of(content.as_py())
                keys = shard.keys[shard.nulls :]
                distinct = np.unique(keys)
                first, n = shard.find(distinct)
                if n.sum() != len(keys):
                    raise ValueError(f"{name}: the index doesn't give all documents")
                at = np.concatenate([np.arange(shard.nulls), np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(keys))])
                crc = [zlib.crc32(shard.document(i).astype("<u4").tobytes()) for i in at.tolist()]
                doc_ids = pa.array(shard.keys[at], pa.int64(), mask=at < shard.nulls)
                starts = shard.starts.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(at), pa.string()), doc_ids, pa.array(starts[at]), pa.array(starts[at + 1] - starts[at]), pa.array(crc, pa.int64())], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(lean(each), "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    # ids before a shard: those of earlier ranges (one sum a range, on the driver), then those before it in its own
    totals = dict(manifest.groupBy("bucket").agg(F.sum("n_ids")).collect())
    ahead, before = 0, []
    for bucket in sorted(totals):
        before.append((bucket, ahead))
        ahead += totals[bucket]
    ranges = spark.createDataFrame(before, "bucket int, ahead bigint")
    own = F.coalesce(F.sum("n_ids").over(W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("bucket", "file", own.alias("own")).join(ranges, "bucket").select("file", (F.col("own") + F.col("ahead")).alias("ahead"))
    return rows.join(shards, "file").select("doc_id", (F.col("ahead") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(keys: DataFrame, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, ids array<bigint> of each document that has one of the keys (a column doc_id), from the files.

    A shard is opened only where its range holds a key, once, and of it the index and the ids
    found are read.  Repeated keys count once; a null key gives the documents without doc_id;
    keys that no document has give no rows.
    """
    spark = keys.sparkSession
    wanted = keys.select(F.col("doc_id").cast("bigint").alias("__key")).distinct()
    # by the greatest key of each range, one row a range on the driver, a key finds the first range that may have it
    tops = manifest.where(F.col("high").isNotNull()).groupBy("bucket").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("bucket").collect()
    first = F.when(F.col("__key") > LEAST, bucket_of(F.col("__key") - 1, [r["high"] for r in tops])).otherwise(0)  # ranges that end below it
    last = bucket_of(F.col("__key"), [r["low"] for r in tops])  # ranges that begin at or below it
    places = spark.createDataFrame([(i, r["bucket"]) for i, r in enumerate(tops)], "__place int, __bucket int")
    known = wanted.where(F.col("__key").isNotNull()).withColumn("__place", F.explode(F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>"))))
    near = known.join(places, "__place").join(manifest.select("bucket", "file", "low", "high"), F.col("__bucket") == F.col("bucket")).where("__key between low and high")
    nulls = wanted.where(F.col("__key").isNull()).join(manifest.where("n_nulls > 0").select("file", F.lit(True).alias("__nulls")), F.col("__nulls"))
    need = near.select("file", "__key").unionByName(nulls.select("file", "__key"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        name, source, shard = None, None, None
        for batch in batches:
            for file, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                    shard = Shard(lambda at, n, s=source: s.read_at(n, at))
                for ids in shard.get(key):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids.astype(np.int64).tolist()], pa.list_(pa.int64()))], schema=schema)
        if source is not None:
            source.close()

    return need.repartition("file").sortWithinPartitions("file").mapInArrow(lean(run), "doc_id bigint, ids array<bigint>")


def token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, width: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the ids of docs under path; the manifest of its shards, itself written.

    width: bytes an id, by default as many as the vocabulary needs; an id that doesn't fit is an
    error.  A null or empty text has end_id alone; null doc_ids stand first; of repeated doc_ids
    all documents are kept.  An empty table has no shards.
    """
    width = width or width_for(tokenizer, end_id)
    bounds = key_bounds(docs.select(F.col("doc_id").cast("bigint")), "doc_id", parallelism(docs.sparkSession))
    return written(write_shards(encode(docs, tokenizer, end_id, width), path, bounds, width, shard_ids), "shards")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as token-id files and read back."""
    import public_tokenizers

    path = scratch(spark, "token-ids")
    manifest = token_files(dealt_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_shards(spark, path, manifest)
