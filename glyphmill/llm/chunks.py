"""Ids of whole texts by a tokenizer of the tokenizers library, through a cache of pieces.

A tokenizer first cuts a text into pieces by its published pattern and then merges inside each
piece, so the ids of a text are those of its pieces in order.  Pieces repeat far more often than
texts: texts of plain letters are cut here by the same pattern, and only pieces that are new go
through the library.  Texts with other characters, or with what may be a special token, are
encoded whole by the library.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

from .common import MEMOS

MAX_CACHE = 1 << 18  # pieces of a generation; there are two, and what is used goes from the old to the new

#: Letters of the Latin blocks up to U+024F that normalization and lower case keep one by one.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
SPACE = r"\t-\r "
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
OTHER = re.compile(rf"[^\x00-\x7f{LETTERS}]")
#: The published patterns of the two kinds of vocabulary, for such texts.
BYTE_PIECE = re.compile(rf"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACE}{LETTERS}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_PIECE = re.compile(rf"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[^{SPACE}{LETTERS}0-9]+")


#: The normalizers and pre-tokenizers that those patterns stand for (offsets don't matter here).
BYTE_KIND = (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
WORD_KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ]},
)


def _without_offsets(part: object) -> object:
    """A component without what concerns offsets only."""
    if isinstance(part, dict):
        return {k: _without_offsets(v) for k, v in part.items() if k != "trim_offsets"}
    return [_without_offsets(x) for x in part] if isinstance(part, list) else part


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The byte alphabet of the characters below U+0250: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x250)}


class Memo(dict):
    """Values by piece, made where they are missing; what two turns have not asked for is forgotten."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most = make, most
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        self[piece] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class ChunkEncoder:
    """batch(texts): little-endian unsigned 32-bit ids of each, without the special tokens of a template."""

    def __init__(self, path: str, max_cache: int = MAX_CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        whole = json.loads(self.tokenizer.to_str())
        kind = _without_offsets(whole["normalizer"]), _without_offsets(whole["pre_tokenizer"])
        self.lower = kind == WORD_KIND
        plain = whole["model"]["type"] == "BPE" and not whole["model"].get("dropout") and not any(t["normalized"] for t in whole["added_tokens"])
        self.cut = {True: (WORD_PIECE if self.lower else BYTE_PIECE).findall, False: None}[plain and (self.lower or kind == BYTE_KIND)]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in whole["added_tokens"]) or "(?!)")
        self.most_id = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.memo = Memo(self.piece, max_cache)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of one piece by the library's model, in the byte alphabet that it is in."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece.translate(_byte_letters()))]).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out = []
        for t in texts:
            if self.cut is None or OTHER.search(t) or self.special.search(t):
                out.append(self.whole(t))
            else:
                out.append(b"".join(map(self.memo.__getitem__, self.cut(t.lower() if self.lower else t))))
                self.memo.turn()
        return out


@functools.cache
def encoder(path: str, max_cache: int = MAX_CACHE) -> ChunkEncoder:
    """The encoder of this worker: its cache serves all tasks that the worker runs, until one of another operator comes."""
    return ChunkEncoder(path, max_cache)


MEMOS["pieces"] = encoder.cache_clear
