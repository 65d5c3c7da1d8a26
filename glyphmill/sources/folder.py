"""Tokenizer folders: tokenizer.json with its companions, or split vocabulary files."""

from __future__ import annotations

import os

from ..core.config import flag, parse_json, string_map, string_pairs, token_text
from ..core.errors import TokenizerError

#: Configurations of model types that may come without one.
FALLBACKS = {
    "gpt2": {"tokenizer_class": "GPT2Tokenizer", "bos_token": "<|endoftext|>", "eos_token": "<|endoftext|>", "unk_token": "<|endoftext|>", "model_max_length": 1024},
    "t5": {"tokenizer_class": "T5Tokenizer", "eos_token": "</s>", "unk_token": "<unk>", "pad_token": "<pad>", "model_max_length": 512},
}
SPECIAL_KEYS = ("bos_token", "eos_token", "unk_token", "sep_token", "pad_token", "cls_token", "mask_token", "additional_special_tokens")
#: Pre-tokenization of the split-file classes.
QWEN2_PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
CLIP_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of split files by other names of class or model type.
SPLIT_CLASSES = {
    "Bert": "Bert", "DistilBert": "Bert", "Distilbert": "Bert", "MPNet": "MPNet", "GPT2": "GPT2", "Qwen2": "Qwen2", "Roberta": "Roberta", "CLIP": "CLIP",
    "bert": "Bert", "distilbert": "Bert", "mpnet": "MPNet", "gpt2": "GPT2", "qwen2": "Qwen2", "qwen3": "Qwen2", "roberta": "Roberta", "clip": "CLIP",
}
#: Special tokens that a class has where its configuration names none.
SPLIT_TOKENS = {
    "Bert": {"unk": "[UNK]", "cls": "[CLS]", "sep": "[SEP]", "pad": "[PAD]", "mask": "[MASK]"},
    "MPNet": {"unk": "[UNK]", "cls": "<s>", "sep": "</s>", "pad": "<pad>", "mask": "<mask>"},
    "GPT2": {"unk": "<|endoftext|>", "eos": "<|endoftext|>", "bos": "<|endoftext|>"},
    "Qwen2": {"unk": "<|endoftext|>", "eos": "<|endoftext|>", "pad": "<|endoftext|>"},
    "Roberta": {"bos": "<s>", "cls": "<s>", "eos": "</s>", "sep": "</s>", "unk": "<unk>", "pad": "<pad>", "mask": "<mask>"},
    "CLIP": {"bos": "<|startoftext|>", "unk": "<|endoftext|>", "eos": "<|endoftext|>", "pad": "<|endoftext|>"},
}
#: Classes whose mask, unless configured, takes the white space before it.
SPACED_MASKS = ("MPNet", "Roberta")


def _read(folder: str, name: str) -> bytes | None:
    path = os.path.join(folder, name)
    if not os.path.isfile(path):
        return None
    with open(path, "rb") as f:
        return f.read()


def _json(folder: str, name: str) -> dict | None:
    data = _read(folder, name)
    return None if data is None else parse_json(data)


def read_folder(folder: str) -> tuple[dict, dict]:
    """(tokenizer data, tokenizer configuration) of a folder on the driver."""
    config = _json(folder, "tokenizer_config.json")
    model = _json(folder, "config.json") or {}
    if config is None:
        config = dict(FALLBACKS.get(model.get("model_type"), {}))
    kind = model.get("model_type")
    named = config.get("tokenizer_class")
    if named is None and isinstance(kind, str):
        config["tokenizer_class"] = FALLBACKS.get(kind, {}).get("tokenizer_class") or f"{kind[:1].upper()}{kind[1:]}Tokenizer"
    for key, value in (_json(folder, "special_tokens_map.json") or {}).items():
        if config.get(key) is None and key not in config:
            config[key] = value
    template = _read(folder, "chat_template.jinja")
    if template is not None:
        config["chat_template"] = template.decode()
    elif (other := _json(folder, "chat_template.json")) and "chat_template" in other:
        config["chat_template"] = other["chat_template"]
    data = _json(folder, "tokenizer.json")
    if data is not None:
        return data, config
    return split_files(folder, config, str(kind if named is None else named))


def split_files(folder: str, config: dict, name: str) -> tuple[dict, dict]:
    """Tokenizer data and its configuration from vocab.txt, or vocab.json and merges.txt, for the classes that have such files."""
    kind = SPLIT_CLASSES.get(name.removesuffix("Fast").removesuffix("Tokenizer"))
    if kind is None:
        raise TokenizerError("unsupportedComponent", f"split files of {name}")
    config = config | {"tokenizer_class": f"{kind}Tokenizer"}
    for short, token in SPLIT_TOKENS[kind].items():
        key = f"{short}_token"
        if config.get(key) is None:
            config[key] = {"content": token, "lstrip": True, "normalized": False, "special": True} if short == "mask" and kind in SPACED_MASKS else token
    if config.get("never_split"):
        raise TokenizerError("unsupportedComponent", "never_split of split files: export tokenizer.json with added tokens")
    if kind in ("Bert", "MPNet"):
        if config.get("clean_up_tokenization_spaces") is None:
            config["clean_up_tokenization_spaces"] = True
        vocab = _lines_vocab(folder)
        return _word_piece(vocab, config, added_from_files(folder, config, vocab)), config
    vocab, merges = _json(folder, "vocab.json"), _read(folder, "merges.txt")
    if vocab is None or merges is None:
        raise TokenizerError("missingVocab", folder)
    string_map(vocab)
    pairs = string_pairs([m for m in merges.decode().split("\n") if m.strip()])
    return _bpe(kind, vocab, pairs, config, added_from_files(folder, config, vocab)), config


def _lines_vocab(folder: str) -> dict[str, int]:
    """One token a line; a token that stands on two lines is an error."""
    text = _read(folder, "vocab.txt")
    if text is None:
        raise TokenizerError("missingVocab", folder)
    lines = text.decode().replace("\r\n", "\n").removesuffix("\n").split("\n")
    vocab = {t: i for i, t in enumerate(lines)}
    if len(vocab) < len(lines):
        raise TokenizerError("malformedVocab", "vocab.txt has a token twice")
    return vocab


def _pair(config: dict, key: str, vocab: dict[str, int], added: list[dict]) -> list:
    """A special token with its id, of the vocabulary or of the added tokens."""
    token = token_text(config.get(key))
    i = vocab.get(token, next((a["id"] for a in added if a["content"] == token), None))
    if i is None:
        raise TokenizerError("missingVocab", str(token))
    return [token, i]


def _word_piece(vocab: dict[str, int], config: dict, added: list[dict]) -> dict:
    basic = flag(config, "do_basic_tokenize", True)
    return {
        "added_tokens": added,
        "normalizer": {
            "type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": basic and flag(config, "tokenize_chinese_chars", True),
            "strip_accents": config.get("strip_accents") if basic else False, "lowercase": basic and flag(config, "do_lower_case", True),
        },
        "pre_tokenizer": {"type": "BertPreTokenizer"},
        "post_processor": {"type": "BertProcessing", "cls": _pair(config, "cls_token", vocab, added), "sep": _pair(config, "sep_token", vocab, added)},
        "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True},
        "model": {"type": "WordPiece", "unk_token": token_text(config["unk_token"]), "vocab": vocab},
    }


def _bpe(kind: str, vocab: dict[str, int], pairs: list[tuple[str, str]], config: dict, added: list[dict]) -> dict:
    model = {"type": "BPE", "vocab": vocab, "merges": [list(p) for p in pairs]}
    space = flag(config, "add_prefix_space", False)
    whole = {"type": "ByteLevel", "add_prefix_space": space, "use_regex": True}
    data: dict = {"added_tokens": added, "normalizer": None, "pre_tokenizer": whole, "decoder": {"type": "ByteLevel"}, "post_processor": {"type": "ByteLevel", "trim_offsets": False}, "model": model}
    if kind == "Qwen2":
        data["normalizer"] = {"type": "NFC"}
        data["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": QWEN2_PATTERN}, "behavior": "Isolated"}, whole | {"use_regex": False}]}
    elif kind == "CLIP":
        model |= {"end_of_word_suffix": "</w>", "unk_token": token_text(config["unk_token"])}
        data["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
        data["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": CLIP_PATTERN}, "behavior": "Removed", "invert": True}, whole | {"add_prefix_space": False}]}
        ends = {"type": "Replace", "pattern": {"Regex": r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"}, "content": ""}
        data["decoder"] = {"type": "Sequence", "decoders": [{"type": "ByteLevel"}, {"type": "Replace", "pattern": {"String": "</w>"}, "content": " "}, ends]}
    if kind in ("Roberta", "CLIP"):
        ends = ("cls_token", "sep_token") if kind == "Roberta" else ("bos_token", "eos_token")
        cls, sep = (_pair(config, key, vocab, added) for key in ends)
        data["post_processor"] = {"type": "RobertaProcessing", "cls": cls, "sep": sep, "trim_offsets": kind == "Roberta", "add_prefix_space": kind == "Roberta" and space}
    elif kind == "GPT2" and flag(config, "add_bos_token", False):
        framed = [{"SpecialToken": {"id": token_text(config["bos_token"]), "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}]
        data["post_processor"] = {"type": "TemplateProcessing", "single": framed, "pair": framed}
    return data


def added_from_files(folder: str, config: dict, vocab: dict[str, int]) -> list[dict]:
    """Added tokens of added_tokens_decoder, added_tokens.json and the special attributes, in this order; conflicts are errors."""
    out: dict[str, dict] = {}
    by_id: dict[int, str] = {}

    def add(content: str, i: int, flags: dict) -> None:
        if by_id.get(i, content) != content or content in out and out[content]["id"] != i:
            raise TokenizerError("invalidConfiguration", f"added token {content!r} has two ids, or its id two tokens")
        if content not in out:
            by_id[i] = content
            out[content] = {"id": i, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": True, "special": False} | {k: v for k, v in flags.items() if v is not None}

    for key, row in (config.get("added_tokens_decoder") or {}).items():
        add(row["content"], int(key), {k: row.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized", "special")})
    for content, i in (_json(folder, "added_tokens.json") or {}).items():
        add(content, i, {})
    for key in SPECIAL_KEYS:
        value = config.get(key)
        for one in value if isinstance(value, list) else [value]:
            token = token_text(one)
            if token is None:
                continue
            flags = {k: one.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")} if isinstance(one, dict) else {}
            if token in out:
                out[token]["special"] = True
            elif token in vocab:
                add(token, vocab[token], {"normalized": False} | flags | {"special": True})
    return sorted(out.values(), key=lambda r: r["id"])
