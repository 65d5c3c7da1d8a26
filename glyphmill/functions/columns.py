"""Column functions of a tokenizer.

Each is a native expression where every stage that it needs has an exact one, else one vectorized
Python function over the whole of it: one Arrow round trip, never one a stage.  The compiled
tokenizer reaches the workers as a broadcast and is built once in each.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..core.errors import TokenizerError
from ..core.models import WordLevel
from ..core.postprocess import budget
from ..core.text import to_alphabet
from ..core.tokenizer import Tokenizer

ENCODING = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("type_ids", T.ArrayType(T.IntegerType()))])
IDS = T.ArrayType(T.IntegerType())
STRINGS = T.ArrayType(T.StringType())


class TokenizerFunctions:
    """encode, decode and their kin as Columns.  Null texts give null."""

    def __init__(self, spark: SparkSession, tokenizer: Tokenizer) -> None:
        self.spark, self.tokenizer = spark, tokenizer
        self.shipped = spark.sparkContext.broadcast(tokenizer)

    def _udf(self, kind: T.DataType, one: Callable) -> Callable[..., Column]:
        shipped = self.shipped

        @F.pandas_udf(kind)
        def apply(*columns: pd.Series) -> pd.Series:
            tokenizer = shipped.value
            return pd.Series([None if any(v is None for v in row) else one(tokenizer, *row) for row in zip(*columns, strict=True)], dtype=object)

        return apply

    def _batched(self, kind: T.DataType, all_: Callable) -> Callable[..., Column]:
        """An Arrow function over whole batches."""
        shipped = self.shipped

        @F.arrow_udf(kind)
        def apply(column: pa.Array) -> pa.Array:
            return all_(shipped.value, column)

        return apply

    # --- stages ---

    def normalize(self, c: Column) -> Column:
        n = self.tokenizer.normalizer
        return n.column(c) if n.native else self._udf(T.StringType(), lambda t, s: t.normalizer(s))(c)

    def pre_tokenize(self, c: Column) -> Column:
        """The pieces of a text without added tokens, after normalization."""
        t = self.tokenizer
        if t.normalizer.native and t.pre_tokenizer.native:
            return F.filter(t.pre_tokenizer.column(t.normalizer.column(c)), lambda p: p != "")
        return self._udf(STRINGS, lambda t, s: [p.text for part in t.pieces(s) if isinstance(part, list) for p in part])(c)

    # --- encoding ---

    def encode(self, c: Column, add_special_tokens: bool = True, max_length: int | None = None, side: str = "right") -> Column:
        """Ids of a text; cut to max_length with its special tokens in place."""
        limit = None if max_length is None else budget(self.tokenizer.post, max_length, add_special_tokens)  # wrong limits are errors here, not in a task
        return self._batched(IDS, lambda t, texts: t.batch.encode(texts, add_special_tokens, limit, side))(c)

    def encode_with_offsets(self, c: Column, add_special_tokens: bool = True) -> Column:
        """ids and offsets (byte ranges of the original text; null for inserted tokens)."""

        return self._batched(ENCODING, lambda t, texts: t.batch.encode_with_offsets(texts, add_special_tokens))(c)

    def encode_pair(self, a: Column, b: Column, add_special_tokens: bool = True) -> Column:
        """ids and type_ids of two texts; the post-processor runs natively on the two arrays of ids."""
        self.tokenizer.post.pair_ids([], [], add_special_tokens)  # no pair form is an error here

        def bare(c: Column) -> Column:  # without the template of a single sequence
            return self._batched(IDS, lambda t, texts: t.batch.bare(texts))(c)

        ids, types = self.tokenizer.post.pair_column(bare(a), bare(b), add_special_tokens)
        return F.struct(ids.alias("ids"), types.alias("type_ids"))

    def tokenize(self, c: Column) -> Column:
        return self._batched(STRINGS, lambda t, texts: t.batch.tokenize(texts))(c)

    @staticmethod
    def truncate(ids: Column, n: int, side: str = "right") -> Column:
        return F.slice(ids, 1, n) if side == "right" else F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n))

    # --- decoding ---

    def decode(self, c: Column, skip_special_tokens: bool = False) -> Column:
        return self._batched(T.StringType(), lambda t, ids: t.batch.decode(ids, skip_special_tokens))(c.cast(IDS))

    def id_to_token(self, c: Column) -> Column:
        return self._udf(T.StringType(), lambda t, i: t.id_to_token(int(i)))(c)

    def token_to_id(self, c: Column) -> Column:
        return self._udf(T.IntegerType(), lambda t, s: t.token_to_id(s))(c)

    def with_ids(self, df: DataFrame, token: str, name: str = "id") -> DataFrame:
        """df with the id of each token string, by a join with the vocabulary, which is bounded when the tokenizer is loaded (4 Mi ids)."""
        ids = self.spark.createDataFrame(list(self.tokenizer.model.vocabulary.ids.items()), "__token string, __id int")
        unk = F.when(F.col(token).isNotNull(), F.lit(self.tokenizer.model.unk_id))
        return df.join(F.broadcast(ids), F.col(token) == F.col("__token"), "left").select(*df.columns, F.coalesce("__id", unk).alias(name))

    def with_tokens(self, df: DataFrame, i: str, name: str = "token") -> DataFrame:
        """df with the token string of each id, by a join with the vocabulary."""
        t = self.tokenizer
        tokens = self.spark.createDataFrame([(k, t.id_to_token(k)) for k in t.model.vocabulary.tokens], "__id int, __token string")
        return df.join(F.broadcast(tokens), F.col(i) == F.col("__id"), "left").select(*df.columns, F.col("__token").alias(name))

    # --- tables ---

    def vocabulary(self) -> DataFrame:
        """id, token, is_special."""
        t = self.tokenizer
        return self.spark.createDataFrame([(i, s, i in t.special_ids) for i, s in sorted(t.model.vocabulary.tokens.items())], "id int, token string, is_special boolean")

    def encode_rows(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, pos, id: one row a token, natively where the model is WordLevel and the stages before it are native.

        The vocabulary is broadcast: it is bounded when the tokenizer is loaded (4 Mi ids).
        """
        t = self.tokenizer
        if isinstance(t.model, WordLevel) and t.normalizer.native and t.pre_tokenizer.native and not t.splitter.tokens and not t.late_splitter.tokens:
            pieces = df.select(F.col(key), F.posexplode(self.pre_tokenize(F.col(text))).alias("pos", "__piece"))
            vocab = self.spark.createDataFrame(list(t.model.vocabulary.model_ids.items()), "__token string, __id int")
            joined = pieces.join(F.broadcast(vocab), F.col("__piece") == F.col("__token"), "left")
            return joined.select(key, "pos", F.coalesce("__id", F.lit(t.model.unk_id)).alias("id"))
        return df.select(F.col(key), F.posexplode(self.encode(F.col(text), False)).alias("pos", "id"))


    def encode_by_pieces(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, ids of each row, without special tokens: each distinct piece is encoded once in all of the table, then joined back.

        For models that are dear a piece: the pieces are cut natively, and the plan shuffles one row
        for each distinct piece of a row.  The normalizer and the pre-tokenizer must be native, and
        there may be no added tokens.  key is unique; null texts have null ids.
        """
        t = self.tokenizer
        if not (t.normalizer.native and t.pre_tokenizer.native) or t.splitter.tokens or t.late_splitter.tokens or t.fuses:
            raise TokenizerError("unsupportedComponent", "pieces are cut natively, and without added tokens, only")
        byte_level = t.model.byte_level

        def one(tok: Tokenizer, pieces: pa.Array) -> pa.Array:
            return pa.array([list(tok.model.ids(to_alphabet(p) if byte_level else p)) for p in pieces.to_pylist()], pa.list_(pa.int32()))

        cut = df.select(F.col(key).alias("__key"), F.posexplode(self.pre_tokenize(F.col(text))).alias("__pos", "__piece"))
        # a row of a text and piece has all its places, so that a frequent piece is joined once a text
        placed = cut.groupBy("__key", "__piece").agg(F.collect_list("__pos").alias("__places"))
        known = placed.select("__piece").distinct().select(F.col("__piece").alias("__p"), self._batched(IDS, one)(F.col("__piece")).alias("__ids"))
        joined = placed.join(known, F.col("__piece") == F.col("__p")).select("__key", F.transform("__places", lambda p: F.struct(p.alias("pos"), F.col("__ids").alias("ids"))).alias("__parts"))
        whole = joined.groupBy("__key").agg(F.flatten(F.transform(F.array_sort(F.flatten(F.collect_list("__parts"))), lambda x: x["ids"])).alias("__all"))
        none = F.when(F.col(text).isNotNull(), F.array().cast(IDS))
        return df.join(whole, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, F.coalesce("__all", none).alias("ids"))


def register(spark: SparkSession, tokenizer: Tokenizer, prefix: str = "") -> TokenizerFunctions:
    """Registers encode, decode, tokenize and normalize for SQL, and tokens(text) as a table function."""
    made = TokenizerFunctions(spark, tokenizer)
    shipped = made.shipped
    spark.udf.register(f"{prefix}encode", made._udf(IDS, lambda t, s: t.encode(s)))
    spark.udf.register(f"{prefix}decode", made._udf(T.StringType(), lambda t, ids: t.decode([int(i) for i in ids])))
    spark.udf.register(f"{prefix}tokenize", made._udf(STRINGS, lambda t, s: t.tokenize(s)))
    spark.udf.register(f"{prefix}normalize", made._udf(T.StringType(), lambda t, s: t.normalizer(s)))

    class Tokens:
        def eval(self, text: str):
            t = shipped.value
            for pos, i in enumerate(t.encode(text, False) if text is not None else ()):
                yield pos, t.id_to_token(i), i

    spark.udtf.register(f"{prefix}tokens", F.udtf(Tokens, returnType="pos int, token string, id int"))
    return made


__all__ = ["TokenizerError", "TokenizerFunctions", "register"]
