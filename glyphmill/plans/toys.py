"""Small tokenizers, whole in themselves, for queries and tests: no vocabulary comes with the data."""

from __future__ import annotations

#: Frequent words and word parts of the four languages of the documents.
PARTS = "the of and to in is that for it on as be le la de les et des en un une du der die und den von zu das mit ein nicht el los que por con una".split()
ENDINGS = "er ing tion ed ly ment able heit keit ung ich ción ado os as es en an re th nd st ou on in at or ha ea wh".split()
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäçéèêëîïíñóôöœùûüúáß"
#: Merges in rank order; each product has one merge, and parts come before what is made of them.
MERGES = """t h|th e|i n|e r|a n|o n|r e|e n|a t|n d|e s|o r|t i|ti on|in g|a l|l e|o u|h a|e d|i t|i s|l y|e a|u n|d e|c h|i e|s t|an d|q u|w h|ei t|h eit|m ent|v i|a i|ç a""".replace("\n", "").split("|")


def _merges() -> list[tuple[str, str]]:
    out = []
    made = set(LETTERS)
    for m in MERGES:
        a, b = m.split(" ")
        if a in made and b in made:
            out.append((a, b))
            made.add(a + b)
    return out


def word_piece() -> dict:
    tokens = dict.fromkeys(["[UNK]", "[CLS]", "[SEP]", *LETTERS, *(f"##{c}" for c in LETTERS), *PARTS, *(f"##{e}" for e in ENDINGS), *".,;:!?#*$%&|<>'\"()0123456789"])
    vocab = {t: i for i, t in enumerate(tokens)}
    return {
        "added_tokens": [{"id": vocab[t], "content": t, "special": True} for t in ("[UNK]", "[CLS]", "[SEP]")],
        "normalizer": {"type": "BertNormalizer", "strip_accents": False},
        "pre_tokenizer": {"type": "BertPreTokenizer"},
        "post_processor": {"type": "BertProcessing", "cls": ["[CLS]", vocab["[CLS]"]], "sep": ["[SEP]", vocab["[SEP]"]]},
        "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True},
        "model": {"type": "WordPiece", "vocab": vocab, "unk_token": "[UNK]"},
    }


def bpe() -> dict:
    """Scalars of lower-cased words, merged."""
    tokens = dict.fromkeys(["<unk>", *LETTERS, *(a + b for a, b in _merges())])
    return {
        "normalizer": {"type": "Lowercase"},
        "pre_tokenizer": {"type": "WhitespaceSplit"},
        "decoder": {"type": "Fuse"},
        "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in _merges()], "unk_token": "<unk>"},
    }


def byte_bpe() -> dict:
    """All bytes, and merges of plain letters, also after a space."""
    from ..core.text import BYTE_TO_CHAR

    pairs = [(a, b) for a, b in _merges() if (a + b).isascii()] + [("Ġ", "th"), ("Ġ", "a"), ("Ġ", "in")]
    tokens = dict.fromkeys([*(BYTE_TO_CHAR[b] for b in range(256)), *(a + b for a, b in pairs)])
    vocab = {t: i for i, t in enumerate(tokens)}
    vocab["<|end|>"] = len(vocab)
    return {
        "added_tokens": [{"id": vocab["<|end|>"], "content": "<|end|>", "special": True}],
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
        "post_processor": {"type": "ByteLevel", "trim_offsets": True},
        "decoder": {"type": "ByteLevel"},
        "model": {"type": "BPE", "vocab": {t: i for t, i in vocab.items() if t != "<|end|>"}, "merges": [list(p) for p in pairs]},
    }


def unigram() -> dict:
    rows = [["<unk>", 0.0], *[[f"▁{p}", -2.0 - 0.1 * i] for i, p in enumerate(PARTS)], *[[e, -4.0 - 0.1 * i] for i, e in enumerate(ENDINGS)], ["▁", -5.0], *[[c, -6.0 - 0.01 * i] for i, c in enumerate(LETTERS)], *[[f"<0x{b:02X}>", -20.0] for b in range(256)]]
    return {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "first"},
        "decoder": {"type": "Sequence", "decoders": [{"type": "Replace", "pattern": {"String": "▁"}, "content": " "}, {"type": "ByteFallback"}, {"type": "Fuse"}, {"type": "Strip", "content": " ", "start": 1, "stop": 0}]},
        "model": {"type": "Unigram", "unk_id": 0, "vocab": rows, "byte_fallback": True},
    }


CHAT = "{% for m in messages %}<|{{ m.role }}|>\n{% if m.role == 'assistant' %}{% generation %}{{ m.content }}{% endgeneration %}{% else %}{{ m.content }}{% endif %}<|end|>\n{% endfor %}{% if add_generation_prompt %}<|assistant|>\n{% endif %}"
RESPONSE = {"start_anchor": "<|assistant|>\n", "defaults": {"role": "assistant"}, "fields": {"first": {"open": "^^", "close": "."}, "words": {"open": ",", "close_pattern": r"[.\n]", "repeats": True}, "content": {}}}
