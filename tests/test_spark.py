from collections import Counter

import duckdb
import pytest

from glyphmill.core.tokenizer import Tokenizer
from glyphmill.functions import register
from glyphmill.plans import toys
from glyphmill.plans.queries import ORACLES, QUERIES
from glyphmill.streaming import stream_decode, stream_parse

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "part", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = Counter(map(tuple, df.collect()))
    if name in ORACLES:
        assert rows == Counter(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall())


def test_byte_level_of_documents_equals_brute_force(spark, con, tmp_path):
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    alphabet = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}
    texts = ["".join(map(chr, range(0x800))), "".join(map(chr, range(0x800, 0xD800, 61))), "".join(map(chr, range(0xE000, 0x110000, 977))), "a\r\n\tb\x00\x7f\xad\u2028", "", None]
    assert {b for t in texts if t for b in t.encode()} == set(range(0xF5)) - {0xC0, 0xC1}  # all bytes of UTF-8
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, QUERIES["norm_byte_level_documents"](spark, str(tmp_path)).collect()))
    assert got == {i: "".join(alphabet[b] for b in (t or "").encode()) for i, t in enumerate(texts)}


def test_transcript_english_covers_all_documents(spark, tmp_path):
    rows = [(1, "Café: it's 5 kg", "en"), (2, "Déjà vu", "fr"), (3, "colour", None), (None, "Größe", "de"), (4, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["transcript_english"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, None} and len(got) == len(rows)
    assert {r["doc_id"]: r["normalized"] for r in got}[3] == "colour"


def test_sql_functions(spark):
    t = Tokenizer(toys.byte_bpe())
    register(spark, t, "toy_")
    row = spark.sql("SELECT toy_encode('the thing') AS ids, toy_decode(toy_encode('é 😀')) AS back, toy_tokenize('the') AS t, toy_encode(CAST(NULL AS STRING)) AS none").first()
    assert row["ids"] == t.encode("the thing") and row["back"] == "é 😀" and row["t"] == ["the"] and row["none"] is None
    assert [tuple(r) for r in spark.sql("SELECT * FROM toy_tokens('the a')").collect()] == [(i, t.id_to_token(x), x) for i, x in enumerate(t.encode("the a"))]


def run_stream(spark, make, df, tmp_path, parts):
    df.repartition(1).write.partitionBy("batch").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(*[f"{tmp_path}/in/batch=*"])
    name = f"q{abs(hash(str(tmp_path)))}"
    query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_stream_decode(spark, tmp_path):
    t = Tokenizer(toys.byte_bpe())
    rows = []
    for key, text in ((1, "é 😀 the end"), (2, "中文 and more")):
        ids = t.encode(text)
        rows += [(key, i, x, i * 3 // len(ids)) for i, x in enumerate(ids)] + [(key, len(ids), None, 2)]
    df = spark.createDataFrame(rows, "stream_id int, seq long, token int, batch int")
    got = run_stream(spark, lambda s: stream_decode(s, t), df, tmp_path, 3)
    assert {k: "".join(r["text"] for r in sorted(got, key=lambda r: r["seq"]) if r["key"] == k) for k in (1, 2)} == {1: "é 😀 the end", 2: "中文 and more"}


def test_stream_parse(spark, tmp_path):
    import json

    template = {"start_anchor": "^", "fields": {"thinking": {"open": "<think>", "close": "</think>"}, "content": {}}}
    parts = ["<thi", "nk>a b</", "think>an", "swer"]
    df = spark.createDataFrame([(1, i, p, i // 2) for i, p in enumerate(parts)] + [(1, 4, None, 1)], "stream_id int, seq long, text string, batch int")
    events = [json.loads(r["event"]) for r in sorted(run_stream(spark, lambda s: stream_parse(s, template), df, tmp_path, 2), key=lambda r: r["seq"])]
    assert events[-1] == ["message", {"thinking": "a b", "content": "answer"}] and ["open", "thinking"] in events


def test_tiers_and_rows(spark):
    from glyphmill.operators import NATIVE, RELATIONAL, VECTORIZED, tiers

    words = Tokenizer({"normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "WordLevel", "vocab": {"<unk>": 0, "the": 1}, "unk_token": "<unk>"}})
    assert tiers(words) == {"normalize": NATIVE, "pre_tokenize": NATIVE, "encode": RELATIONAL, "post_process": NATIVE, "decode": VECTORIZED}
    assert tiers(Tokenizer(toys.unigram()))["normalize"] == VECTORIZED
    rows = register(spark, words, "w_").encode_rows(spark.createDataFrame([(1, "The end"), (2, ""), (3, None)], "k int, t string"), "k", "t")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 1), (1, 1, 0)]
    assert "Python" not in rows._jdf.queryExecution().toString()
