"""Documents and pages with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PROSE = "The first line of a text that says what it has to say, in words that differ.\nAnd then a second line, which is not like the first one at all.\nLast comes the third."
NEAR = PROSE + " " + " ".join(f"w{i}" for i in range(60))

#: Names that operators use or return themselves.
EXTRA = ["key", "node", "size", "start", "rank", "score", "label", "block", "part", "kept", "target", "__score", "__block", "__node", "__class", "__h", "__id", "__range", "row", "often", "class", "h"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in EXTRA]])


def _row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), *["x"] * len(EXTRA))


ROWS = [
    _row(1, PROSE), _row(2, PROSE, None, "b"), _row(3, NEAR, "de", None), _row(4, NEAR + " end", "fr", ""), _row(5, None), _row(6, ""), _row(7, " \n\t "), _row(8, "one two"),
    _row(9, LONG), _row(10, LONG, "xx", "b"), _row(11, "x" * 50_000), _row(None, PROSE + " no id"), _row(None, None, None, None), _row(12, "tie"), _row(12, "tie"), _row(12, "other"), _row(13, "é ü 中文 😀 \u2003 nbsp\u00a0x | # *"),
    _row(14, PROSE), _row(14, PROSE), _row(-5, "negative id here"),
]


def documents(spark):
    return spark.createDataFrame(ROWS, DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def save(df, path):
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)
