"""What the operators share: words, table reading, shared storage, bounds that deal rows out evenly."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space between words, U+0020 and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: The same as a regular expression for a word, and for what lies between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Used where the session sets no spark.checkpoint.dir, as in tests on one machine.
LOCAL_SHARED = "file:///tmp/checkpoints/glyphmill"


def words_of(text: str) -> list[bytes]:
    """The words of a text, in UTF-8; bytes.split() parts at exactly ASCII_SPACE."""
    return text.encode("utf-8", "surrogatepass").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    """Rows of the driver as a table.  They go through Arrow: lists of rows would start Python workers of a second kind, whose daemons stay in the executors."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema))


def dealt_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores where its files are too few to fill half of them, as with one small file."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; LOCAL_SHARED where it is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or LOCAL_SHARED).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM has ended first
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what written() wrote, which nothing may read any more."""
    _delete(df.sparkSession, df.scratch_path)


#: What a worker remembers from task to task and that grows with the texts: by name, how to forget it.
MEMOS: dict[str, Callable[[], None]] = {}


def forget_others(memo: str | None) -> None:
    """Forgets every memo but the one of this name."""
    for name, forget in MEMOS.items():
        if name != memo:
            forget()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], memo: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives freed memory back: workers live on, and share an executor's limit with its JVM.

    memo: of MEMOS, which run uses; those of the operators that the worker served before are forgotten first.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(memo)
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps what it likes
            pass

    return wrapped


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 512) -> DataFrame:
    """each() over slices of at most `rows` rows, so that memory stays bounded with long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = each(batch.slice(at, rows))
                if out is not None:
                    yield out

    return df.mapInArrow(lean(run), schema)


def _numbers(values: Sequence[float], kind: str) -> Column:
    """A constant array, as one literal however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def key_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """parts - 1 ascending values of a long column that deal its rows out about evenly (fewer where it has few).

    Null counts as the least value.  A value of many rows stands in the list as often as it fills
    parts, see dealt_bucket().
    """
    if parts < 2:
        return []
    known = F.coalesce(F.col(key), F.lit(LEAST))
    at = df.agg(F.percentile_approx(known, _numbers([i / parts for i in range(1, parts)], "double"), min(20 * parts, 10_000)).alias("at")).first()["at"]
    return sorted(at or [])


#: What a null key counts as.
LEAST = -(1 << 63)


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key (null: 0), by binary search in one constant array."""
    if not bounds:
        return F.lit(0)
    values = _numbers(bounds, "bigint")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    # beyond the end there is null, which is no step on
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step - 1) <= key, at + step).otherwise(at))


def dealt_bucket(key: Column, spread: Column, bounds: list[int]) -> Column:
    """The part of a row, 0 to len(bounds), ascending with the key.

    A key that stands in the bounds more than once has too many rows for one part: they are dealt
    over as many parts as it stands for, ascending with `spread`, a 64-bit hash of the row.
    """
    known = F.coalesce(key, F.lit(LEAST))
    upper = bucket_of(known, bounds)
    often = sorted({b for b, c in zip(bounds, bounds[1:], strict=False) if b == c})
    if not often:
        return upper
    lower = {b: bounds.index(b) for b in often}
    times = {b: bounds.count(b) for b in often}
    nth = bucket_of(known, often) - 1
    is_often = F.get(_numbers(often, "bigint"), nth) == known
    share = (spread / F.lit(2.0**64) + 0.5) * F.get(_numbers([times[b] for b in often], "int"), nth)
    return F.when(is_often, F.get(_numbers([lower[b] for b in often], "int"), nth) + 1 + F.least(F.floor(share).cast("int"), F.get(_numbers([times[b] for b in often], "int"), nth) - 1)).otherwise(upper)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle of whole tables."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as numbers in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
