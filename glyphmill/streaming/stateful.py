"""Keyed state over streams of tokens and of generated text.

Rows have a key, a sequence number and a token (or a piece of text); an end is a row whose token
is null.  Within a micro-batch rows go by sequence number; rows of a key must not come after a
later one in an earlier batch, as order is that of the stream.  After its end a key's state is
dropped, so a later row of it begins a new stream.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..core.response import ResponseParser, ResponseTemplate
from ..core.stream import TokenStreamDecoder
from ..core.tokenizer import Tokenizer

STATE = "data binary"


def stream_decode(tokens: DataFrame, tokenizer: Tokenizer, key: str = "stream_id", seq: str = "seq", token: str = "token", skip_special_tokens: bool = False) -> DataFrame:
    """key, seq, text: what each batch of a stream's tokens makes certain, under the last seq of the batch; nothing is emitted for batches that settle nothing."""
    shipped = tokens.sparkSession.sparkContext.broadcast(tokenizer)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decoder = TokenStreamDecoder(shipped.value, skip_special_tokens)
        if state.exists:
            decoder.restore(pickle.loads(state.get[0]))
        rows = pd.concat(list(batches)).sort_values("seq")
        out: list[str] = []
        ended = False
        for value in rows["token"]:
            if ended:
                decoder.reset()
                ended = False
            if pd.isna(value):
                out.append(decoder.finish())
                ended = True
            else:
                out.append(decoder.append(int(value)))
        if ended:
            state.remove()
        else:
            state.update((pickle.dumps(decoder.snapshot()),))
        text = "".join(out)
        if text:
            yield pd.DataFrame({"key": [keys[0]], "seq": [int(rows["seq"].max())], "text": [text]})

    named = tokens.select(F.col(key).alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(token).cast("double").alias("token"))
    kind = named.schema["key"].dataType.simpleString()
    return named.groupBy("key").applyInPandasWithState(step, f"key {kind}, seq bigint, text string", STATE, "append", GroupStateTimeout.NoTimeout)


def batch_decode(tokens: DataFrame, tokenizer: Tokenizer, key: str = "stream_id", seq: str = "seq", token: str = "token") -> DataFrame:
    """key, text: the same over a table, a row a stream."""
    shipped = tokens.sparkSession.sparkContext.broadcast(tokenizer)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(token).alias("t")))), lambda x: x["t"])
    grouped = tokens.where(F.col(token).isNotNull()).groupBy(F.col(key).alias("key")).agg(ordered.alias("ids"))

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        out = []
        for row in ids:
            decoder = TokenStreamDecoder(shipped.value)
            out.append("".join([*(decoder.append(int(i)) for i in row), decoder.finish()]))
        return pd.Series(out)

    return grouped.select("key", decode("ids").alias("text"))


def stream_parse(pieces: DataFrame, template: dict, key: str = "stream_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """key, seq, event: events of the response parser as JSON, and ["message", ...] at the end of a stream."""
    source = json.dumps(template)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        parser = ResponseParser(ResponseTemplate(source))
        if state.exists:
            parser.resume(pickle.loads(state.get[0]))
        out: list[tuple[int, str]] = []
        ended = False
        for n, part in zip(rows["seq"], rows["text"], strict=True):
            if part is None:
                message, events = parser.finalize()
                out += [(int(n), json.dumps(e, ensure_ascii=False)) for e in [*events, ("message", message)]]
                parser, ended = ResponseParser(ResponseTemplate(source)), True
            else:
                out += [(int(n), json.dumps(e, ensure_ascii=False)) for e in parser.feed(part)]
                ended = False
        if ended:
            state.remove()
        else:
            state.update((pickle.dumps(parser.state()),))
        if out:
            yield pd.DataFrame({"key": [keys[0]] * len(out), "seq": [n for n, _ in out], "event": [e for _, e in out]})

    named = pieces.select(F.col(key).alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(text).alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    return named.groupBy("key").applyInPandasWithState(step, f"key {kind}, seq bigint, event string", STATE, "append", GroupStateTimeout.NoTimeout)
