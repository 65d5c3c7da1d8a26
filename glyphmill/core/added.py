"""Added tokens: matched in a text before anything else, with their flags."""

from __future__ import annotations

from dataclasses import dataclass

import regex

from .config import boolean
from .text import WHITE_SPACE, WORD_CLASS

_WORD = regex.compile(rf"[\p{{Alphabetic}}\p{{M}}\p{{Nd}}\p{{Pc}}‌‍]")
#: Mask tokens that a tokenizer class makes absorb the space before them, where the configuration names none.
MASK_BRACKET = "albert bigbird deberta fnet rembert".split()
MASK_ANGLE = "bart barthez blenderbot camembert cpm layoutxlm led longformer markuplm mbart mbart50 mpnet mvp nllb roberta xlmroberta xlnet".split()


@dataclass(frozen=True)
class AddedToken:
    content: str
    id: int
    lstrip: bool = False
    rstrip: bool = False
    single_word: bool = False
    normalized: bool = False
    special: bool = False


def class_mask(config: dict) -> str | None:
    name = config.get("tokenizer_class")
    if config.get("mask_token") is not None or not isinstance(name, str):
        return None
    key = name.lower().removesuffix("fast").removesuffix("tokenizer").replace("-", "").replace("_", "")
    return "[MASK]" if key in MASK_BRACKET else "<mask>" if key in MASK_ANGLE else None


def added_tokens(data: dict, config: dict) -> list[AddedToken]:
    """The added tokens, with the flags that added_tokens_decoder gives for the same id and content."""
    flags = {int(k): v for k, v in (config.get("added_tokens_decoder") or {}).items() if str(k).isdigit() and isinstance(v, dict)}
    mask, out = class_mask(config), []
    for row in data.get("added_tokens") or []:
        i, content = row.get("id"), row.get("content")
        if not isinstance(i, int) or isinstance(i, bool) or not isinstance(content, str):
            continue
        if content == mask:
            out.append(AddedToken(content, i, lstrip=True, special=True))
            continue
        over = flags.get(i, {}) if flags.get(i, {}).get("content") == content else {}
        out.append(AddedToken(content, i, **{k: bool(boolean(over.get(k), boolean(row.get(k), False))) for k in ("lstrip", "rstrip", "single_word", "normalized", "special")}))
    return out


class Splitter:
    """Finds the leftmost longest contents; flags are looked at afterwards, so a refused match still uses up its text."""

    def __init__(self, tokens: list[tuple[str, AddedToken]]) -> None:
        self.tokens: dict[str, AddedToken] = {}
        for content, token in tokens:
            if content:
                self.tokens[content] = token  # the last of equals holds
        self.pattern = regex.compile("|".join(regex.escape(c) for c in sorted(self.tokens, key=len, reverse=True))) if self.tokens else None

    def split(self, text: str) -> list[tuple[int, int, int | None]]:
        """(start, end, id of the token or None for text), in order."""
        out: list[tuple[int, int, int | None]] = []
        begin, n = 0, len(text)
        for m in self.pattern.finditer(text) if self.pattern else ():
            token = self.tokens[m.group()]
            start, end = m.span()
            if token.single_word and (start and _WORD.match(text[start - 1]) or end < n and _WORD.match(text[end])):
                continue
            if token.lstrip:
                while start > begin and text[start - 1] in WHITE_SPACE:
                    start -= 1
            start = max(start, begin)
            if begin < start:
                out.append((begin, start, None))
            if token.rstrip:
                while end < n and text[end] in WHITE_SPACE:
                    end += 1
            out.append((min(start, end), end, token.id))
            begin = end
        if begin < n:
            out.append((begin, n, None))
        return out


__all__ = ["AddedToken", "Splitter", "WORD_CLASS", "added_tokens"]
