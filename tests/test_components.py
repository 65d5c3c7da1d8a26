import base64
import random
import re
import struct

import pytest
import regex

from glyphmill.core.config import parse_json, string_pairs
from glyphmill.core.decoders import decoder
from glyphmill.core.errors import JSONConfigError, TokenizerError
from glyphmill.core.normalizers import normalizer
from glyphmill.core.postprocess import post_processor
from glyphmill.core.pretokenizers import GPT2, Piece, pre_tokenizer
from glyphmill.core.text import byte_spans, from_alphabet, to_alphabet, translated
from glyphmill.core.tokenizer import Tokenizer

ATOMS = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "　", "a", "Z", "É", "é", "ß", "İ", "Σ", "ΑΣ", "ς", "1", "٣", "½", "'s", "'RE", "don't", "_", "-", "—", ".", "!?", "$", "中", "文字", "か", "カー", "ـ", "한", "😀", "👩‍🚀", "​", "﻿", "�", "\x00", "\x01", "▁"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randrange(12))) for _ in range(n)]


# --- configuration ---


@pytest.mark.parametrize(
    "source, value",
    [
        ('{"a":1,}', {"a": 1}), ("[1,2,]", [1, 2]), ('{"a":1,"a":2}', {"a": 2}), ("[1e3, -0.5, 99999999999999999999]", [1000.0, -0.5, 1e20]), ('"\\ud83d\\ude00"', "😀"),
        (b"\xef\xbb\xbf[true,null]", [True, None]), ("[1]".encode("utf-16"), [1]), ("[Infinity,-Infinity]", [float("inf"), float("-inf")]),
    ],
)
def test_json(source, value):
    assert parse_json(source) == value


@pytest.mark.parametrize("source", ["", "{", "[1 2]", "[01]", '{"a" 1}', '"\\x"', "[1]x", "[" * 600 + "]" * 600, b"\xff", '{a:1}', "[,]"])
def test_bad_json(source):
    with pytest.raises(JSONConfigError):
        parse_json(source)


def test_json_keeps_spellings_apart():
    assert len(parse_json('{"é":1,"é":2}')) == 2


def test_merges():
    assert string_pairs(["#version: 0.2", "a b"]) == string_pairs([["a", "b"]]) == [("a", "b")]
    for bad in (["a b", ["a", "b"]], ["a"], [["a"]], "a b", [[1, 2]]):
        with pytest.raises(TokenizerError):
            string_pairs(bad)


# --- normalizers ---

def by_rule(text, scheme, drop, offset):
    """The rules in words: spaces become marks; or white space goes, and with `always` each word has a mark before it."""
    if drop:
        words = [w for w in re.split(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text) if w]
        marked = [w if scheme == "never" or w.startswith("▁") or scheme == "first" and (k or offset) else f"▁{w}" for k, w in enumerate(words)]
        if scheme == "first" and text[:1].isspace() and marked and not words[0].startswith("▁"):
            marked[0] = words[0]  # the first word doesn't stand at the start
        return "".join(marked)
    text = text.replace(" ", "▁")
    wants = scheme == "always" or scheme == "first" and not offset
    return f"▁{text}" if text and wants and not text.startswith("▁") else text


@pytest.mark.parametrize("scheme", ["always", "never", "first"])
@pytest.mark.parametrize("drop", [False, True])
def test_metaspace_normalizer(scheme, drop):
    rng = random.Random(8)
    made = normalizer({"type": "MetaspaceNormalizer", "replacement": "▁", "prepend": scheme, "drop_whitespace": drop})
    for text in ["", *("".join(rng.choices(["house", "é", "▁", " ", "  ", "\t", "\u3000", "\u200b", "x."], k=rng.randrange(1, 7))) for _ in range(400))]:
        for offset in (0, 5):
            assert made(text, offset) == by_rule(text, scheme, drop, offset), (text, offset)


CASES = [
    ({"type": "Prepend", "prepend": "_"}, "a", "_a"), ({"type": "Prepend", "prepend": "_"}, "", ""), ({"type": "Lowercase"}, "ΑΣ İ", "ασ i̇"), ({"type": "StripAccents"}, "éé", "eé"),
    ({"type": "Strip"}, "　 a \x1c", "a \x1c"), ({"type": "Strip", "strip_left": False}, " a ", " a"), ({"type": "Nmt"}, "a\x01b​c ", "ab c "),
    ({"type": "Replace", "pattern": {"String": "a"}, "content": "$1\\"}, "ba", "b$1\\"), ({"type": "Replace", "pattern": {"Regex": "a{2,}"}, "content": "-"}, "aaab a", "-b a"),
    ({"type": "Replace", "pattern": {"String": ""}, "content": "-"}, "ab", "-a-b-"), ({"type": "Replace", "pattern": {"String": ""}, "content": "-"}, "", ""), ({"type": "Replace"}, "ab", "ab"),
    ({"type": "BertNormalizer"}, "Ré\x00 中\tA\x0b", "re  中  a"), ({"type": "BertNormalizer", "lowercase": False}, "Ré", "Ré"), ({"type": "NFKC"}, "ﬁ①", "fi1"), ({"type": "ByteLevel"}, "é ", "Ã©Ġ"),
    ({"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "StripAccents"}, {"type": "Lowercase"}]}, "É", "e"),
]


@pytest.mark.parametrize("config, text, want", CASES)
def test_normalizers(config, text, want):
    assert normalizer(config)(text) == want


@pytest.mark.parametrize("config", [c for c, *_ in CASES] + [{"type": "MetaspaceNormalizer", "replacement": "▁", "prepend": "first", "drop_whitespace": d} for d in (True, False)])
def test_traced_normalizers_give_the_same_text(config):
    n = normalizer(config)
    for t in texts(300):
        text, spans = n.apply(t, byte_spans(t), 0)
        assert text == n(t) and len(spans) == len(text)
        assert all(0 <= a <= b <= len(t.encode()) for a, b in spans) and spans == sorted(spans)


def test_native_normalizers_equal_python(spark):
    from pyspark.sql import functions as F

    rows = [t for t in texts(500) if "\x00" not in t] + ["", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    for config in [c for c, *_ in CASES] + [{"type": "MetaspaceNormalizer", "replacement": "▁", "prepend": s, "drop_whitespace": d} for s in ("always", "first", "never") for d in (True, False)] + [{"type": "BertNormalizer", "strip_accents": False}]:
        n = normalizer(config)
        if n.native and config != {"type": "Replace", "pattern": {"String": ""}, "content": "-"}:
            for r in df.select("i", n.column(F.col("t")).alias("got")).collect():
                assert r["got"] == n(rows[r["i"]]), (config, rows[r["i"]])


def test_precompiled():
    """A trie of two keys: A -> a, and the ligature ffi."""
    keys = {b"A": b"a", "ﬃ".encode(): b"ffi"}
    table, places = b"", {}
    for k, v in keys.items():
        places[k] = len(table)
        table += v + b"\0"
    units: dict[int, int] = {}
    used = {0}

    def fill(node: int, parts: list[tuple[bytes, bytes]]) -> None:
        labels = sorted({k[:1] for k, _ in parts})
        offset = next(o for o in range(1, 1 << 20) if all((node ^ o ^ (x[0] if x else 0)) not in used for x in labels))
        units[node] = units.get(node, 0) | offset << 10 | (0x100 if b"" in labels else 0)
        for x in labels:
            child = node ^ offset ^ (x[0] if x else 0)
            used.add(child)
            if x:
                units[child] = x[0]
        for x in labels:
            child = node ^ offset ^ (x[0] if x else 0)
            if x:
                fill(child, [(k[1:], full) for k, full in parts if k[:1] == x])
            else:
                units[child] = 0x80000000 | places[parts[0][1]]

    fill(0, [(k, k) for k in keys])
    array = [units.get(i, 0) for i in range(max(units) + 1)]
    data = struct.pack("<I", 4 * len(array)) + struct.pack(f"<{len(array)}I", *array) + table
    n = normalizer({"type": "Precompiled", "precompiled_charsmap": base64.b64encode(data).decode()})
    assert n("ABﬃx") == "aBffix"
    assert n.apply("Aﬃ", byte_spans("Aﬃ"), 0)[1] == [(0, 1), (1, 4), (1, 4), (1, 4)]


@pytest.mark.parametrize("config", [{"type": "Nope"}, {"type": "Sequence"}, {"type": "MetaspaceNormalizer", "replacement": "ab", "prepend": "first", "drop_whitespace": True}, {"type": "MetaspaceNormalizer", "replacement": "▁", "prepend": "x", "drop_whitespace": True}, {"type": "Precompiled", "precompiled_charsmap": "!!"}, {"type": "Precompiled"}])
def test_bad_normalizers(config):
    with pytest.raises(TokenizerError):
        normalizer(config)


# --- pre-tokenizers ---


def split(config, text, first=True):
    return [p.text for p in pre_tokenizer(config).split(Piece(text, None, first)) if p.text]


PRE = [
    ({"type": "BertPreTokenizer"}, "Hey, you!　x", ["Hey", ",", "you", "!", "x"]), ({"type": "Whitespace"}, "Hi, é_1  ok", ["Hi", ",", "é_1", "ok"]), ({"type": "WhitespaceSplit"}, " a\x1cb c", ["a\x1cb", "c"]),
    ({"type": "Punctuation"}, "a.b", ["a", ".", "b"]), ({"type": "Punctuation", "behavior": "MergedWithPrevious"}, "a..b", ["a.", ".", "b"]), ({"type": "Punctuation", "behavior": "MergedWithNext"}, "a..b", ["a", ".", ".b"]),
    ({"type": "Punctuation", "behavior": "Contiguous"}, "a..b", ["a", "..", "b"]), ({"type": "Punctuation", "behavior": "Removed"}, "a..b", ["a", "b"]), ({"type": "Digits"}, "a12٣b", ["a", "12٣", "b"]),
    ({"type": "Digits", "individual_digits": True}, "a12", ["a", "1", "2"]), ({"type": "Split", "pattern": {"Regex": r"\s"}, "behavior": "Removed", "invert": True}, "a b", [" "]),
    ({"type": "Split", "pattern": {"String": "."}, "behavior": "MergedWithPrevious"}, "a.b.", ["a.", "b."]), ({"type": "Metaspace", "replacement": "▁"}, "a  b", ["▁a", "▁", "▁b"]),
    ({"type": "Metaspace", "replacement": "▁", "prepend_scheme": "never"}, "a b", ["a", "▁b"]), ({"type": "Metaspace", "replacement": "▁", "split": False}, "a b", ["▁a▁b"]),
    ({"type": "ByteLevel", "add_prefix_space": True}, "é's", ["ĠÃ©", "'s"]), ({"type": "ByteLevel"}, "a  b", ["a", "Ġ", "Ġb"]), ({"type": "CharDelimiterSplit", "delimiter": "-"}, "a--b", ["a", "b"]),
    ({"type": "FixedLength", "length": 2}, "ab😀c", ["ab", "😀c"]), ({"type": "UnicodeScripts"}, "どこで生れ。Yes", ["どこで生れ", "。", "Yes"]), ({"type": "UnicodeScripts"}, "  ", []),
    ({"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Punctuation"}]}, "a b.c", ["a", "b", ".", "c"]),
]


@pytest.mark.parametrize("config, text, want", PRE)
def test_pre_tokenizers(config, text, want):
    assert split(config, text) == want


def test_metaspace_first_looks_at_the_original_offset():
    config = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "first"}
    assert split(config, "a b") == ["▁a", "▁b"] and split(config, "a b", False) == ["a", "▁b"]


def test_gpt2_pattern_is_lossless():
    pattern = regex.compile(GPT2.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    for t in texts(500):
        got = split({"type": "Split", "pattern": {"Regex": GPT2}}, t)
        assert "".join(got) == t and got == [m for m in regex.findall(pattern, t) if m]


def test_native_pre_tokenizers_equal_python(spark):
    from pyspark.sql import functions as F

    rows = [t for t in texts(400, 7) if "\x00" not in t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    for config in [c for c, *_ in PRE] + [{"type": "Split", "pattern": {"Regex": GPT2}}]:
        p = pre_tokenizer(config)
        if p.native:
            for r in df.select("i", F.filter(p.column(F.col("t")), lambda x: x != "").alias("got")).collect():
                assert r["got"] == split(config, rows[r["i"]]), (config, rows[r["i"]])


def test_patterns_are_translated():
    assert translated(r"\s[\s\w](?m:.)\h") == r"\p{White_Space}[\p{White_Space}\p{Alphabetic}\p{M}\p{N}\p{Pc}](?s:.)[0-9a-fA-F]"
    with pytest.raises(TokenizerError):
        translated("x" * 9000)


# --- the byte alphabet ---


def test_alphabet_round_trip():
    for t in texts(200):
        assert from_alphabet(to_alphabet(t)).decode() == t
    assert to_alphabet("Ā") != "Ā" and from_alphabet("Ā中") == "Ā中".encode() and len(set(to_alphabet("".join(map(chr, range(128)))))) == 128


# --- post-processors ---


def test_post_processors():
    bert = post_processor({"type": "BertProcessing", "cls": ["[CLS]", 101], "sep": ["[SEP]", 102]})
    assert bert.ids([5, 6]) == [101, 5, 6, 102] and bert.ids([5], False) == [5] and bert.pair_ids([5], [6]) == ([101, 5, 102, 6, 102], [0, 0, 0, 1, 1])
    roberta = post_processor({"type": "RobertaProcessing", "cls": ["<s>", 0], "sep": ["</s>", 2]})
    assert roberta.pair_ids([5], [6]) == ([0, 5, 2, 2, 6, 2], [0] * 6)
    template = post_processor({"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "[X]", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}], "pair": [{"Sequence": {"id": "B", "type_id": 1}}, {"Sequence": {"id": "A", "type_id": 0}}], "special_tokens": {"[X]": {"id": "[X]", "ids": [7, 8], "tokens": ["[X]", "[Y]"]}}})
    assert template.ids([5]) == [7, 8, 5] and template.pair_ids([5], [6, 6]) == ([6, 6, 5], [1, 1, 0])
    assert post_processor(None).pair_ids([1], [2]) == ([1, 2], [0, 1])
    chain = post_processor({"type": "Sequence", "processors": [{"type": "ByteLevel"}, {"type": "BertProcessing", "cls": ["c", 3], "sep": ["s", 4]}]})
    assert chain.ids([0]) == [3, 0, 4] and chain.pair_ids([0], [1])[0] == [3, 0, 4, 1, 4]
    twice = post_processor({"type": "Sequence", "processors": [{"type": "BertProcessing", "cls": ["c", 3], "sep": ["s", 4]}] * 2})
    assert twice.ids([0]) == [3, 3, 0, 4, 4]
    with pytest.raises(TokenizerError):
        twice.pair_ids([0], [1])


@pytest.mark.parametrize("config", [{"type": "X"}, {"type": "BertProcessing", "cls": ["c", 3]}, {"type": "TemplateProcessing", "single": [{"seq": "B"}], "pair": []}, {"type": "TemplateProcessing", "single": [{"seq": "A", "ids": [1]}], "pair": []}, {"type": "TemplateProcessing", "single": [{"ids": [-1]}], "pair": []}])
def test_bad_post_processors(config):
    with pytest.raises(TokenizerError):
        post_processor(config)


# --- decoders ---


@pytest.mark.parametrize(
    "config, tokens, want",
    [
        ({"type": "ByteLevel"}, ["Ã", "©", "Ġa", "Ã"], "é a�"), ({"type": "ByteLevel"}, ["a b"], "a b"), ({"type": "ByteFallback"}, ["<0xE2>", "<0x82>", "<0xAC>", "a", "<0xE2>", "<0x82>"], "€a��"),
        ({"type": "Metaspace", "replacement": "▁"}, ["▁a▁b", "▁c"], "ab c"), ({"type": "Metaspace", "replacement": "▁", "prepend_scheme": "never"}, ["▁a"], " a"), ({"type": "Metaspace"}, ["_a", "_b"], "a b"),
        ({"type": "WordPiece", "prefix": "##", "cleanup": True}, ["he", "##llo", "!", "do", "n't"], "hello! don't"), ({"type": "BPEDecoder"}, ["a</w>", "b</w>"], "a b"), ({"type": "Fuse"}, ["a", "b"], "ab"),
        ({"type": "CTC"}, ["<pad>", "h", "h", "<pad>", "h", "|", "|", "i"], "hh i"), ({"type": "Strip", "content": "a", "start": 1, "stop": 2}, ["aabaaa"], "aba"), ({"type": "Replace", "pattern": {"String": "a"}, "content": "b"}, ["aa"], "bb"),
        ({"type": "Sequence", "decoders": [{"type": "ByteFallback"}, {"type": "Fuse"}, {"type": "Strip", "content": " ", "start": 1, "stop": 0}]}, [" <", "<0x41>"], "<A"),
    ],
)
def test_decoders(spark, config, tokens, want):
    from pyspark.sql import functions as F

    d = decoder(config)
    assert d.text(tokens) == want
    if d.native:
        df = spark.createDataFrame([(tokens,)], "t array<string>")
        assert "".join(df.select(d.column(F.col("t")).alias("x")).first()["x"]) == want


def test_no_decoder_joins_with_spaces():
    t = Tokenizer({"model": {"type": "WordLevel", "vocab": {"<unk>": 0, "a": 1, "b": 2}, "unk_token": "<unk>"}})
    assert t.decode([1, 9, 2]) == "a b" and t.decode([]) == ""
