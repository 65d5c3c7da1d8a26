"""Word-level tokenization as a relational plan: explode, join with a vocabulary, coalesce."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..core.normalizers import normalizer
from ..core.pretokenizers import pre_tokenizer

#: Fixed value: id 0 is the unknown token; the vocabulary follows from 1.
UNK_ID = 0


def pieces(df: DataFrame, key: str, text: str, normalize: dict | None, pre: dict) -> DataFrame:
    """key, pos, piece: one row a piece, natively."""
    column = pre_tokenizer(pre).column(normalizer(normalize).column(F.coalesce(F.col(text), F.lit(""))))
    return df.select(F.col(key), F.posexplode(column).alias("pos", "piece"))


def frequent(rows: DataFrame, n: int) -> DataFrame:
    """id, piece: the n most frequent pieces, ties by piece, ids from 1.

    The counts are summed in every task first, and only the n best of each task meet in the last
    one, so the single window runs over n rows.
    """
    top = rows.groupBy("piece").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "piece").limit(n)
    return top.select(F.row_number().over(W.orderBy(F.desc("n"), "piece")).alias("id"), "piece")


def encode(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds id to rows with a piece; vocabulary (id, piece) is bounded by what frequent() was asked for, and so is broadcast."""
    return rows.join(F.broadcast(vocabulary), "piece", "left").withColumn("id", F.coalesce("id", F.lit(UNK_ID)))


def decode(rows: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """key, text: ids back into texts, pieces in order of pos with a space between; ids without a piece are skipped."""
    named = rows.join(F.broadcast(vocabulary), "id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return named.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("text"))
