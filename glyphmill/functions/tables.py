"""Functions of conversations, replies and transcripts."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..core import chat, transcripts
from ..core.response import ResponseTemplate, parse_response as parse
from ..core.tokenizer import Tokenizer


def conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, messages: the turns of each conversation in order.  One shuffle, by conversation."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return df.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def _messages(row) -> list[dict]:
    return [{k: m[k] for k in m} if isinstance(m, dict) else m.asDict() for m in row]


def apply_chat_template(df: DataFrame, tokenizer: Tokenizer, key: str = "conv_id", max_length: int | None = None, **options) -> DataFrame:
    """key, prompt, ids of each conversation in df (key, messages)."""
    shipped = df.sparkSession.sparkContext.broadcast(tokenizer)
    chat.compiled(chat.select(tokenizer, options.get("template"), options.get("tools")))  # a bad template is an error here

    @F.pandas_udf("string")
    def render(messages: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else chat.render(shipped.value, _messages(row), **options) for row in messages], dtype=object)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(prompts: pa.Array) -> pa.Array:
        return shipped.value.batch.encode(prompts, False, limit, "right")

    # a prompt is rendered once, and encoded only where its ids are wanted
    limit = chat.limit(tokenizer, max_length)
    return df.select(key, render("messages").alias("prompt")).select(key, "prompt", encode("prompt").alias("ids"))


def assistant_mask(df: DataFrame, tokenizer: Tokenizer, key: str = "conv_id", **options) -> DataFrame:
    """key, ids, mask of each conversation: which ids the assistant wrote."""
    shipped = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.BooleanType()))]))
    def apply(messages: pd.Series) -> pd.DataFrame:
        made = [chat.apply_with_mask(shipped.value, _messages(row), **options) for row in messages]
        return pd.DataFrame({"ids": [m[0] for m in made], "mask": [m[1] for m in made]})

    return df.select(key, apply("messages").alias("__made")).select(key, "__made.ids", "__made.mask")


def parse_response(c: Column, template: dict, prefix: str = "", tools: list[dict] | None = None) -> Column:
    """The message of a generated text, as JSON with its keys in order."""
    source = json.dumps(template)
    ResponseTemplate(template)

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        compiled = ResponseTemplate(source)
        return pd.Series([None if t is None else json.dumps(parse(t, compiled, prefix, tools), ensure_ascii=False) for t in texts], dtype=object)

    return apply(c)


def basic_normalize(c: Column, remove_diacritics: bool = False, split_letters: bool = False) -> Column:
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else transcripts.basic_normalize(t, remove_diacritics, split_letters))

    return apply(c)


def english_normalize(c: Column, spellings: dict[str, str] | None = None) -> Column:
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else transcripts.english_normalize(t, spellings))

    return apply(c)
