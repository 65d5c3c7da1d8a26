"""Mixing sources to target weights: blocks of words, multinomial counts a shard, permuted indexes.

The words of a source, document after document, are cut into blocks of a fixed length.  A mix has
output shards; each draws multinomial counts of blocks by source, without exceeding what a source
has left of its quota, so the counts of all shards add up to the quotas.  The n-th slot of a
source takes block P(n mod blocks) by a pseudorandom permutation P of its own for each pass over
the source, and slots meet blocks in a join by index.  No block is taken more often than there are
passes, two at most here.

The counts of a shard follow from the quotas alone, by halves of the shards down a tree, so each
task draws those of its own shards.  The one thing that comes to the driver is a row a source (at
most MAX_SOURCES, checked).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import WORD, dealt_bucket, dealt_table, key_bounds, lean, mix64, parallelism, small_table, written

MAX_SOURCES = 100_000
SPAN = 1 << 14  # slots that a task makes at once


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # of the sources by code point, null last, repeating
    share: float = 1.5  # of all words, to take
    passes: int = 2  # over a source, at most
    block: int = 64  # words of a block
    shard_blocks: int = 1 << 16  # blocks of an output shard, about
    seed: int = 7


@dataclass(frozen=True)
class Source:
    name: str | None
    rank: int
    size: int
    target: float
    blocks: int
    quota: int  # blocks to take


def targets(sizes: list[int], weights: list[float], share: float, passes: float) -> list[float]:
    """share of all sizes by weight; no target exceeds passes times its size, the excess goes to the others by weight."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in sorted(open_))
        for i in open_:
            out[i] = left * weights[i] / weight
        over = {i for i in open_ if out[i] > passes * sizes[i]}
        if not over:
            break
        for i in over:
            out[i] = float(passes * sizes[i])
        open_ -= over
    return out


def sources_of(sized: DataFrame, options: MixOptions) -> list[Source]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # strings compare by code point
    sizes = [int(r["size"]) for r in rows]
    weights = [options.weights[i % len(options.weights)] for i in range(len(rows))]
    out = []
    for i, (row, size, target) in enumerate(zip(rows, sizes, targets(sizes, weights, options.share, options.passes), strict=True)):
        blocks = -(-size // options.block)
        quota = min(options.passes * blocks, round(target * blocks / size)) if size else 0
        out.append(Source(row["source"], i, size, target, blocks, quota))
    return out


def n_shards(quotas: list[int], options: MixOptions) -> int:
    return max(1, math.ceil(sum(quotas) / options.shard_blocks))


def drawn(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial draws in proportion to what quotas have left, none beyond it."""
    left, out = left.copy(), np.zeros_like(left)
    while size:
        got = np.minimum(rng.multinomial(size, left / left.sum()), left)
        out += got
        left -= got
        size -= int(got.sum())  # what a quota could not give is drawn again
    return out


def shard_counts(quotas: list[int], shard: int, shards: int, options: MixOptions) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of a shard by source, and those of all shards before it.

    The shards are halved again and again; the draw for a half is seeded by its place alone, so
    each shard is drawn for itself in as many draws as halvings, and all add up to the quotas.
    """
    left, before, low, high = np.array(quotas, np.int64), np.zeros(len(quotas), np.int64), 0, shards
    total = int(left.sum())
    while high - low > 1:
        mid = (low + high) // 2
        half = drawn(left, total * mid // shards - total * low // shards, np.random.default_rng((options.seed, low, high)))
        if shard < mid:
            left, high = half, mid
        else:
            left, before, low = left - half, before + half, mid
    return left, before


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n): a Feistel network over the next square, walked until inside."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for turn in range(4):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (mix64(right + np.uint64((key + turn * 0x9E3779B97F4A7C15) % 2**64)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def mixture(spark: SparkSession, sources: list[Source], options: MixOptions) -> DataFrame:
    """rank, shard, slot, block: the block of a source that each slot of each shard takes."""
    quotas = [s.quota for s in sources]
    shards = n_shards(quotas, options)
    blocks, keys = [s.blocks for s in sources], [zlib.crc32(repr((options.seed, s.name)).encode()) for s in sources]
    ranks = [s.rank for s in sources]
    schema = pa.schema([("rank", pa.int32()), ("shard", pa.int32()), ("slot", pa.int64()), ("block", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, before = shard_counts(quotas, shard, shards, options)
                for i in np.flatnonzero(counts).tolist():
                    for at in range(0, int(counts[i]), SPAN):
                        slot = int(before[i]) + np.arange(at, min(at + SPAN, int(counts[i])))
                        passes, index = np.divmod(slot, blocks[i])
                        block = np.empty_like(slot)
                        for p in np.unique(passes):
                            own = passes == p
                            block[own] = permuted(index[own], blocks[i], keys[i] * 1_000_003 + int(p))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), ranks[i]), pa.int32()), pa.array(np.full(len(slot), shard), pa.int32()), pa.array(slot), pa.array(block)], schema=schema)

    if not sum(quotas):
        return spark.createDataFrame([], "rank int, shard int, slot bigint, block bigint")
    return spark.range(0, shards, 1, min(shards, 4 * parallelism(spark))).mapInArrow(lean(run), "rank int, shard int, slot bigint, block bigint")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def placed(sized: DataFrame, sources: list[Source]) -> DataFrame:
    """Adds rank and start, the words of a document's source before it.

    Documents of a source follow by doc_id, then by the hash h of their text, then by size; their
    sums go by ranges of doc_id, of which one of very many rows takes several, so that a large
    source is summed in many tasks.
    """
    spark = sized.sparkSession
    ranks = small_table(spark, [(s.name, s.rank) for s in sources], pa.schema([("__name", pa.string()), ("rank", pa.int32())]))
    bounds = key_bounds(sized.select("doc_id"), "doc_id", 4 * parallelism(spark))
    ranged = sized.join(ranks, F.col("source").eqNullSafe(F.col("__name"))).drop("__name").withColumn("__range", dealt_bucket(F.col("doc_id"), F.col("h"), bounds))
    sums = ranged.groupBy("rank", "__range").agg(F.sum("size").alias("sum"))
    ahead = sums.select(F.col("rank").alias("__rank"), F.col("__range").alias("__r"), F.coalesce(F.sum("sum").over(W.partitionBy("rank").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    own = F.coalesce(F.sum("size").over(W.partitionBy("rank", "__range").orderBy(F.col("doc_id").asc_nulls_first(), "h", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__own", own).join(ahead, (F.col("rank") == F.col("__rank")) & (F.col("__range") == F.col("__r"))).withColumn("start", F.col("__own") + F.col("__ahead")).drop("__own", "__ahead", "__rank", "__r", "__range")


def taken_blocks(at: DataFrame, mixed: DataFrame, block: int) -> DataFrame:
    """The rows of at that have words, once for each of their blocks that is taken: with block, times and words of it.

    Both sides are shuffled by block: the planner measures the mix by the few rows of its range of
    shards, and would collect all blocks in the driver to broadcast them.
    """
    times = mixed.groupBy(F.col("rank").alias("__rank"), F.col("block").alias("__block")).agg(F.count("*").alias("times")).hint("merge")
    last = F.floor((F.col("start") + F.col("size") - 1) / block).cast("bigint")
    wide = at.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block).cast("bigint"), last)))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    return wide.join(times, (F.col("rank") == F.col("__rank")) & (F.col("block") == F.col("__block"))).drop("__rank", "__block").withColumn("words", words)


def mix(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document.

    A null text has no words and nothing is taken of it; null sources are one source, the last;
    null doc_ids stand first in their source; repeated rows stand one after the other, each with
    words of its own.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    sized = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("h")), "sized")
    sources = sources_of(sized, options)
    at = written(placed(sized, sources), "placed")
    taken = taken_blocks(at, mixture(spark, sources, options), options.block).groupBy("rank", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    facts = small_table(spark, [(s.rank, s.size, s.target) for s in sources], pa.schema([("rank", pa.int32()), ("source_size", pa.int64()), ("target", pa.float64())]))
    named = at.join(facts, "rank")
    full = named.where("size > 0").join(taken, ["rank", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    return full.unionByName(named.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken")))


def mixed_documents(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """The mix as documents, with the columns of docs: what is taken of a document, once for each pass that takes it.

    A document of which a pass takes all stays as it is; else its text is the stretches taken,
    with one line end between them, and n_chars (where there is one) is theirs.
    """
    spark = docs.sparkSession
    names, schema = docs.columns, docs.schema
    text = F.col("text").cast("string")
    row = W.partitionBy("id", "source", "h").orderBy("size")
    # the columns of docs stand in one of their own, so that none can clash
    keyed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("h")).where("size > 0")
    sized = written(keyed.select(F.col("id").alias("doc_id"), "source", "size", "h"), "sized")
    sources = sources_of(sized, options)
    at = written(placed(sized, sources), "placed")
    chosen = taken_blocks(at, mixture(spark, sources, options), options.block)
    # blocks of a document, of which there are as many as it has words for
    chosen = chosen.groupBy("rank", "start").agg(F.collect_list(F.struct("block", "times")).alias("blocks"))
    nth = F.row_number().over(W.partitionBy("doc_id", "source", "h").orderBy("start"))
    chosen = at.where("size > 0").join(chosen, ["rank", "start"], "left").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("h").alias("__t"), "start", "blocks", nth.alias("__n"))
    both = keyed.withColumn("nth", F.row_number().over(row)).join(chosen, F.col("id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("h") == F.col("__t")) & (F.col("nth") == F.col("__n"))).where(F.col("blocks").isNotNull())
    need = both.select("row", "start", F.transform("blocks", lambda b: b["block"]).alias("block"), F.transform("blocks", lambda b: b["times"]).alias("times"))
    find, size = re.compile(WORD).finditer, options.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                fields = dict(zip(names, batch.column(0).flatten(), strict=True))
                index, texts = [], []
                for j, (full, start, blocks, times) in enumerate(zip(fields["text"].to_pylist(), *(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    spans = [m.span() for m in find(full)]
                    of = dict(zip(blocks, times, strict=True))
                    for turn in range(1, max(times) + 1):
                        runs: list[list[int]] = []
                        for b in sorted(b for b, n in of.items() if n >= turn):
                            low, high = max(b * size - start, 0), min((b + 1) * size - start, len(spans))
                            if runs and runs[-1][1] == low:
                                runs[-1][1] = high
                            else:
                                runs.append([low, high])
                        index.append(j)
                        texts.append(full if runs == [[0, len(spans)]] else "\n".join(full[spans[a][0] : spans[z - 1][1]] for a, z in runs))
                made = {n: c.take(pa.array(index, pa.int64())) for n, c in fields.items()}
                made["text"] = pa.array(texts, pa.string())
                if "n_chars" in made:
                    made["n_chars"] = pa.array(map(len, texts), pa.int64()).cast(fields["n_chars"].type)
                yield pa.RecordBatch.from_arrays([made[n] for n in names], names=names)

    return need.mapInArrow(lean(run), schema)


def op4_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of each document."""
    return mix(dealt_table(spark, sf_dir, "documents"))
