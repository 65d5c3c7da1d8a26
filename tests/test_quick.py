import json
import random

import pyarrow as pa
import pytest
import regex

from glyphmill.core import quick
from glyphmill.core.postprocess import budget
from glyphmill.core.pretokenizers import GPT2, Bert, Split, Whitespace, WhitespaceSplit
from glyphmill.core.text import compiled
from glyphmill.core.tokenizer import Tokenizer
from glyphmill.plans import toys

#: Published patterns of tokenizers.
KNOWN = {
    "gpt2": GPT2,
    "llama3": r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    "qwen2": r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
}
ATOMS = [*"aZ9 é\t\n\r\x0b\x1c\x1f\x85\xa0.,'!$_-|#<>ßÀ×÷ªº²½ʼ", "  ", " \n", "\r\n", "'s", "'LL", "the ", " and", "ing", "İ", "ſ", "ǅ", "\u0301", "e\u0301", "中", "字", "😀", "\u3000", "\u200b", "\u200d", "ﬁ", "Ⅷ", "٣", "<|end|>", "[SEP]", "▁", " ▁", "\0", "\x7f", "ʰ", "Ω", "ё"]


def made(n, seed, most=16):
    rng = random.Random(seed)
    return ["", *("".join(rng.choices(ATOMS, k=rng.randrange(most))) for _ in range(n))]


@pytest.mark.parametrize("pattern", [*KNOWN.values(), Whitespace.pattern.pattern, WhitespaceSplit.pattern.pattern, Bert.pattern.pattern, r"\p{Lu}+|\P{Lu}", r"[^\p{Lu}\S]+|[\p{Ll}\d]"])
def test_narrowed_patterns_match_the_same(pattern):
    slow = compiled(pattern)
    fast = quick.narrowed(slow.pattern)
    assert fast is not None
    for c in map(chr, range(quick.TOP)):
        for text in (c, f"a{c}", f" {c}b", f"{c}{c}", f"'{c}", f"1{c} "):
            assert fast.findall(text) == slow.findall(text), repr(text)
    for text in made(2000, 1):
        if not quick.WIDE(text):
            assert fast.findall(text) == slow.findall(text), repr(text)


def test_configured_patterns_are_narrowed():
    assert all(quick.finder(compiled(p)) is not compiled(p).findall for p in KNOWN.values())


def test_patterns_that_are_not_narrowed():
    assert all(quick.narrowed(p) is None for p in (r"(a)b", r"\X", r"[a&&b]", r"\p{Han}+", r"[[:alpha:]]", r"\N{DIGIT ONE}"))


def word_level(pre, post=None):
    return {"pre_tokenizer": pre, "post_processor": post, "model": {"type": "WordLevel", "vocab": {"<unk>": 0, "the": 1, "a": 2, "é": 3, "[CLS]": 4, "[SEP]": 5}, "unk_token": "<unk>"}}


CONFIGS = {
    **{name: getattr(toys, name)() for name in ("word_piece", "bpe", "byte_bpe", "unigram")},
    "whitespace": word_level({"type": "Whitespace"}, {"type": "BertProcessing", "cls": ["[CLS]", 4], "sep": ["[SEP]", 5]}),
    "whitespace_split": word_level({"type": "WhitespaceSplit"}) | {"added_tokens": [{"id": 9, "content": "ing", "special": True, "lstrip": True}]},
    "bert_template": word_level({"type": "BertPreTokenizer"}, {"type": "TemplateProcessing", "single": [{"ids": [4]}, {"seq": "A"}, {"ids": [5]}, {"seq": "A"}], "pair": [{"seq": "A", "type_id": 0}, {"seq": "B", "type_id": 1}]}),
    "fused": word_level({"type": "WhitespaceSplit"}) | {"model": {"type": "WordPiece", "vocab": {"[UNK]": 0, "a": 1, "the": 2, "##ing": 3}, "fuse_unk": True}},
    "no_cut": word_level(None),
    "metaspace": toys.unigram() | {"normalizer": None, "pre_tokenizer": {"type": "Metaspace", "prepend_scheme": "always"}},
    "byte_llama3": toys.byte_bpe() | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": KNOWN["llama3"]}, "behavior": "Isolated"}, {"type": "ByteLevel", "use_regex": False}]}},
    "split_removed": word_level({"type": "Split", "pattern": {"Regex": r"[.,\s]+"}, "behavior": "Removed"}),
    "split_inverted": word_level({"type": "Split", "pattern": {"Regex": r"\p{L}+"}, "behavior": "Removed", "invert": True}),
    "split_isolated": word_level({"type": "Split", "pattern": {"Regex": r"\p{L}+"}, "behavior": "Isolated"}),
    "byte_no_post": toys.byte_bpe() | {"post_processor": None},
}


@pytest.mark.parametrize("name", CONFIGS)
def test_batches_equal_single_texts(name):
    t = Tokenizer(CONFIGS[name])
    texts = [*made(1500, 2), "the " * 300, "x" * 1000, "é" * 500 + " the"]
    column = pa.array([*texts, None])
    for special in (True, False):
        assert t.batch.encode(column, special, None, "right").to_pylist() == [*(t.encode(x, special) for x in texts), None]
        got = t.batch.encode_with_offsets(column, special).to_pylist()
        assert got[-1] is None
        for x, g in zip(texts, got, strict=False):
            e = t.encode_with_offsets(x, special)
            assert g["ids"] == e.ids and [o and (o["start"], o["end"]) for o in g["offsets"]] == e.offsets, repr(x)
    for side in ("left", "right"):
        assert t.batch.encode(column, False, budget(t.post, 3, False), side).to_pylist()[:-1] == [t.encode(x, False, 3, side) for x in texts]
    assert t.batch.tokenize(column).to_pylist()[:-1] == [t.tokenize(x) for x in texts]
    assert t.batch.bare(column).to_pylist()[:-1] == [t._ids(x) for x in texts]
    ids = [t.encode(x) for x in texts]
    for skip in (False, True):
        assert t.batch.decode(pa.array([*ids, None, [10**6, -1]], pa.list_(pa.int32())), skip).to_pylist() == [*(t.decode(i, skip) for i in ids), None, t.decode([10**6, -1], skip)]


def test_offsets_take_the_short_way():
    assert Tokenizer(CONFIGS["whitespace_split"]).batch.spanned("the a") is not None and Tokenizer(CONFIGS["byte_no_post"]).batch.spanned("the a") is not None
    assert Tokenizer(CONFIGS["byte_bpe"]).batch.spanned("the a") is None  # its post-processor trims


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_real_vocabularies_equal_the_library(file):
    """Ids, tokens, offsets and decoded texts of whole vocabularies, against the tokenizers library."""
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    with open(P.path(file)) as f:
        data = json.load(f)
    ours, theirs = Tokenizer(data), tokenizers.Tokenizer.from_file(P.path(file))
    texts = [x for x in made(1500, 3) if "\0" not in x] + ["The quick brown fox, it's 12 o'clock; naïve façade coöperation über straße." * 3]
    want = theirs.encode_batch(texts, add_special_tokens=False)
    assert ours.batch.encode(pa.array(texts), False, None, "right").to_pylist() == [e.ids for e in want]
    assert ours.batch.tokenize(pa.array(texts)).to_pylist() == [e.tokens for e in want]
    if data.get("decoder"):
        assert ours.batch.decode(pa.array([e.ids for e in want], pa.list_(pa.int32())), False).to_pylist() == theirs.decode_batch([e.ids for e in want], skip_special_tokens=False)


def test_split_by_known_patterns_is_quick():
    for pattern in KNOWN.values():
        cut, _ = Split({"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated"}).quick()
        for text in made(500, 4):
            assert "".join(cut(text, True)) == text and cut(text, True) == [m.group() for m in regex.finditer(pattern, text)]
