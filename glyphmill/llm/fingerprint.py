"""Document fingerprints: one-permutation MinHash with optimal densification, in native expressions.

Each five-word shingle is hashed once; the high bits of the hash are its bin, the rest its value,
and the least value of a bin represents it.  An empty bin takes the value of the first non-empty
one along a pseudorandom walk over all bins that is its own (optimal densification; the walk is a
permutation, so it ends).  The low BITS bits of all BINS values are packed into 64-bit words.
The likeness of two fingerprints is the share of equal fields, corrected for those that are equal
by chance.

Texts of one to four words have one shingle of all their words.  Texts without words have none:
their fingerprint is all zeros and is like another of its kind only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import SPACES, dealt_bucket, key_bounds, mix64, parallelism, table

BINS = 256
BITS = 4
WORDS = BINS * BITS // 64
SHINGLE = 5
VALUE_BITS = 55  # below the 8 bits of the bin; the sign bit stays clear
WALK = 8  # steps of a walk that are tried one by one
EMPTY = (1 << VALUE_BITS) - 1


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _walks() -> list[tuple[int, int]]:
    """The odd stride and the offset of the walk of each bin."""
    h = mix64(np.arange(1, BINS + 1, dtype=np.uint64)).tolist()
    return [((x >> 20) % (BINS // 2) * 2 + 1, (x >> 40) % BINS) for x in h]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def shingle_hashes(text: Column) -> Column:
    """array<bigint>: a non-negative 63-bit hash of each shingle."""

    def of(ws: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(ws) - SHINGLE, F.lit(0))),
            lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(ws, i + k) for k in range(SHINGLE)]), 1),
        )

    return _let(words(text), lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(of(ws)))


def bins(hashes: Column) -> Column:
    """array<bigint> of BINS least values, null where a bin has none: sorted, then the first of each bin.

    One sentinel a bin, above all its values, makes the array dense.
    """
    sentinels = F.array(*[F.lit((b << VALUE_BITS) + EMPTY) for b in range(BINS)])

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, VALUE_BITS) != F.shiftright(F.get(s, i - 1), VALUE_BITS)))

    return F.transform(_let(F.sort_array(F.concat(hashes, sentinels)), firsts), lambda x: F.nullif(x.bitwiseAND(F.lit(EMPTY)), F.lit(EMPTY)))


def densify(values: Column) -> Column:
    """Empty bins filled: a few steps of the walk one by one, then the non-empty bin of the least step."""
    walks = _walks()
    steps = F.array(*[F.lit((stride * a + offset) % BINS) for stride, offset in walks for a in range(WALK)])
    offsets = F.array(*[F.lit(offset) for _, offset in walks])
    inverses = F.array(*[F.lit(pow(stride, -1, BINS)) for stride, _ in walks])

    def filled(both: Column) -> Column:
        v, full = both["v"], both["full"]

        def least(i: Column) -> Column:
            # the step at which bin j comes is (j - offset) / stride, in the ring of BINS; then j itself
            return F.array_min(F.transform(full, lambda j: ((j - F.get(offsets, i)) * F.get(inverses, i)).bitwiseAND(F.lit(BINS - 1)) * BINS + j)).bitwiseAND(F.lit(BINS - 1))

        return F.transform(v, lambda x, i: F.coalesce(x, *[F.get(v, F.get(steps, i * WALK + a)) for a in range(WALK)], F.get(v, least(i))))

    def full_bins(v: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(v, j).isNotNull())

    return _let(_let(values, lambda v: F.struct(v.alias("v"), full_bins(v).alias("full"))), filled)


def packed(values: Column) -> Column:
    """array<bigint>: the low BITS bits of all values, 64 bits a word, the first value highest.

    Values are mixed with their bin first: a copied value then meets others by chance in each bin anew.
    """
    n, low = 64 // BITS, F.lit((1 << BITS) - 1)

    def word(v: Column, w: Column) -> Column:
        return F.aggregate(F.slice(v, w * n + 1, F.lit(n)), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(low)))

    return _let(F.transform(values, lambda x, i: F.xxhash64(x, i)), lambda v: F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: word(v, w)))


def fingerprint(text: Column) -> Column:
    """array<bigint> of WORDS: the packed fingerprint of a text; null without words."""
    return _let(shingle_hashes(text), lambda h: F.when(F.size(h) > 0, packed(densify(bins(h)))))


def as_text(print_: Column) -> Column:
    """A packed fingerprint in hexadecimal, 16 digits a word; a null one is all zeros."""
    return F.coalesce(F.array_join(F.transform(print_, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), ""), F.lit("0" * (16 * WORDS)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated Jaccard similarity of the shingles of two texts from their packed fingerprints.

    Of fields that differ by nature, one in 2^BITS is equal by chance.
    """
    ones = F.lit(sum(1 << i for i in range(0, 64, BITS)))

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        any_bit = d
        for i in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(d, i))
        return F.bit_count(any_bit.bitwiseAND(ones))

    differing = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, n: acc + n)
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (1 - differing / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(corrected)


def with_next(docs: DataFrame, made: dict[str, Column], parts: int) -> DataFrame:
    """Adds next_<column> of the text and of each made column (of the text): those of the next row by descending doc_id, after the last of the first.

    Ties go by descending hash of the text, then by descending text; null doc_ids come last.  The
    rows are dealt by ranges of doc_id, of which one of very many rows takes several; the next row
    of a range's last is the first of the next range that has one, and only those first rows, one
    a range, are looked up.  What is made of a text is made once, before the rows are dealt.
    """
    h = F.xxhash64("text")
    bounds = key_bounds(docs.select("doc_id"), "doc_id", parts)
    ranged = docs.withColumns({"__h": h, "__range": dealt_bucket(F.col("doc_id"), h, bounds)})
    columns = ["text", *made]
    order = [F.col("doc_id").desc_nulls_last(), F.col("__h").desc(), F.col("text").desc()]
    led = ranged.withColumns(made).withColumn("__next", F.lead(F.struct(*columns)).over(W.partitionBy("__range").orderBy(*order)))
    # the first row of each range: by its greatest doc_id and hash, from slim rows, then by its text
    slim = ranged.groupBy("__range").agg(F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "__h")).alias("__top")).select("__range", F.col("__top.doc_id").alias("__d"), F.col("__top.__h").alias("__t"))
    tops = slim.collect()  # at most `parts`
    heads = ranged.join(F.broadcast(docs.sparkSession.createDataFrame(tops, "__range int, __d bigint, __t bigint")), "__range").where(F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")))
    heads = heads.groupBy("__range").agg(F.max("text").alias("text")).withColumns(made).select(F.col("__range").alias("__after"), F.struct(*columns).alias("__head"))
    ranges = sorted((r[0] for r in tops), reverse=True)
    after = docs.sparkSession.createDataFrame([(r, ranges[(i + 1) % len(ranges)]) for i, r in enumerate(ranges)], "__range int, __after int")
    out = led.join(F.broadcast(after.join(heads, "__after").select("__range", "__head")), "__range", "left")
    return out.select(*docs.columns, *made, *[F.coalesce(F.col(f"__next.{c}"), F.when(F.col("__next").isNull(), F.col(f"__head.{c}"))).alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the packed fingerprint of each document."""
    return plain(docs).withColumn("print", fingerprint(F.col("text")))


def plain(docs: DataFrame) -> DataFrame:
    """doc_id and text (null as empty) of each document."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def op8_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    led = with_next(plain(table(spark, sf_dir, "documents")), {"print": fingerprint(F.col("text"))}, parallelism(spark))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    made = led.select("doc_id", n.cast("bigint").alias("n_chars"), "print", "next_print", edited.alias("edited")).withColumn("edited_print", fingerprint(F.col("edited")))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
