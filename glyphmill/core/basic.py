"""The basic tokenizer of plain vocabularies: words and punctuation marks, where no pipeline is configured."""

from __future__ import annotations

import unicodedata

import regex

from .text import is_punctuation

#: Words that are never split or put into lower case.
NEVER_SPLIT = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")
_GRAPHEMES = regex.compile(r"\X")
#: Spaces and tabs; line ends are no space here.
_SPACES = regex.compile(r"[\p{Zs}\t]+")


def basic_tokenize(text: str, lower: bool = True) -> list[str]:
    """The words of a text, each punctuation mark for itself; without accents and in lower case if asked for.

    A grapheme is a mark where its first scalar is one.
    """
    if lower and not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    out: list[str] = []
    for word in _SPACES.split(text):
        if word in NEVER_SPLIT:
            out.append(word)
            continue
        begun = False  # the last of out is a word that goes on
        for c in _GRAPHEMES.findall(word.lower() if lower else word):
            if is_punctuation(c[0]):
                out.append(c)
                begun = False
            elif begun:
                out[-1] += c
            else:
                out.append(c)
                begun = True
    return out
