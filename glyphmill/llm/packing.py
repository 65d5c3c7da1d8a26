"""Best-fit packing: pieces of documents into sequences of a fixed number of tokens.

Best-fit decreasing takes the pieces from the longest down and puts each into the open sequence
with the tightest sufficient room, found in logarithmic time by a segment tree over the
remaining capacities.  Only the length of a piece matters, and there are at most `size` lengths:
so the counts of lengths alone come to the driver, which packs all pieces of a length together
exactly as one by one, and makes a plan of bounded size.  Each piece then looks up its place by
its rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .chunks import MAX_CACHE, encoder
from .common import dealt_table, lean, written

SIZE = 1024
END_ID = 2


class CapacityTree:
    """Which capacities of 0 to n some bin has left; the least of at least x in O(log n)."""

    def __init__(self, n: int) -> None:
        self.leaves = 1 << n.bit_length()
        self.any = np.zeros(2 * self.leaves, bool)

    def set(self, capacity: int, there: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = there
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The least capacity of at least `least` that is there."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:  # up to the first subtree on the right that has one
            if not i & 1 and self.any[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


@dataclass(frozen=True)
class Place:
    """Pieces [first, first + count) of one length: `each` to a bin from `bin` on, at `offset`."""

    length: int
    first: int
    count: int
    bin: int
    each: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], size: int) -> tuple[list[Place], int]:
    """The plan for so many pieces of each length, and the number of bins; lengths of 1 to size."""
    tree, open_bins = CapacityTree(size), defaultdict(list)  # room left: ranges (first bin, how many)
    places: list[Place] = []
    n_bins = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = size // length
                first, n = n_bins, -(-left // each)
                n_bins += n
                room = size
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
                each = room // length
            full = min(n, left // each)  # bins that take `each` pieces, one bin after the other
            if full:
                places.append(Place(length, done, full * each, first, each, size - room))
                done, left = done + full * each, left - full * each
                put(room - each * length, first, full)
            if full < n and left:
                places.append(Place(length, done, left, first + full, left, size - room))
                put(room - left * length, first + full, 1)
                done, left, full = done + left, 0, full + 1
            if full < n:
                put(room, first + full, n - full)
    return places, n_bins


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False, cached_pieces: int = MAX_CACHE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece (ids array<int> if asked for).

    A document's ids are those of its whole text and then end_id; a longer one is cut into pieces
    of `size`, of which the first may be shorter.  A null or empty text has end_id alone; each of
    repeated rows has its own pieces.  part and rank number the pieces of each length within
    their task.
    """
    names = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("rank", pa.int64())]
    schema = pa.schema(names + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer, cached_pieces).batch
        end, part = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                columns: list[list] = [[] for _ in schema]
                for doc_id, data in zip(batch.column(0).to_pylist(), encode_all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    data += end  # noqa: PLW2901
                    n = len(data) // 4
                    cut = n % size or size
                    start = 0
                    for piece, stop in enumerate(range(cut, n + 1, size)):
                        own = data[4 * start : 4 * stop]
                        row = (doc_id, piece, start, stop - start, zlib.crc32(own), part, seen[stop - start])
                        seen[stop - start] += 1
                        for column, value in zip(columns, row, strict=False):
                            column.append(value)
                        if with_ids:
                            columns[-1].append(np.frombuffer(own, "<u4").astype(np.int32))
                        start = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, rank bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run, "pieces"), kinds)


def pack(made: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must have been written (their ranks are read twice).

    Ties among pieces of equal length go by task and rank.  An empty table stays empty.
    """
    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = by_part.select(F.col("part").alias("__part"), F.col("length").alias("__length"), before.alias("__before"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    plan, _ = best_fit_decreasing(counts, size)
    # places by length and first rank; looked up by binary search
    of_length: dict[int, tuple[np.ndarray, ...]] = {}
    for length in counts:
        own = sorted((p for p in plan if p.length == length), key=lambda p: p.first)
        of_length[length] = tuple(np.array([getattr(p, k) for p in own], np.int64) for k in ("first", "bin", "each", "offset"))
    shipped = made.sparkSession.sparkContext.broadcast(of_length)  # at most a few rows for each length
    columns = [c for c in made.columns if c not in ("part", "rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shipped.value
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy() + batch.column("__before").to_numpy()
            bins, offsets = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                first, start, each, offset = places[int(length)]
                at = np.searchsorted(first, ranks[rows], "right") - 1
                nth = ranks[rows] - first[at]
                bins[rows] = start[at] + nth // each[at]
                offsets[rows] = offset[at] + nth % each[at] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(bins), pa.array(offsets)], names=[*columns, "sequence_id", "offset"])

    joined = made.join(ahead, (F.col("part") == F.col("__part")) & (F.col("length") == F.col("__length"))).drop("__part", "__length")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name in columns)
    return joined.mapInArrow(lean(run), f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False, cached_pieces: int = MAX_CACHE) -> DataFrame:
    """cached_pieces: of the text, with their ids, that a worker holds (twice as many, about 180 bytes each)."""
    return pack(written(pieces(docs, tokenizer, size, end_id, with_ids, cached_pieces), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from pieces packed with their ids; each of at most `size` tokens."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack_documents(dealt_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
