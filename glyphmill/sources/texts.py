"""Texts as DataFrames: one row a document, whatever the store; Spark's own readers do the reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are too few to fill half of them, as with one small file; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet with only the columns that are needed."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a line."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_vocab_lines(spark: SparkSession, path: str) -> DataFrame:
    """id, token of a vocab.txt, ids by line."""
    one = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\n$", ""), "\n").alias("lines"))
    return one.select(F.posexplode("lines").alias("id", "token"))


def write_encoded(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
