"""Texts with their source ranges, Unicode classes, and regular expressions in their several dialects."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import regex

from .errors import TokenizerError

#: A text and, where offsets are wanted, the source range (in bytes) of each scalar.
Spans = list[tuple[int, int]] | None
MAX_PATTERN = 8192

#: The white space of Unicode, which leaves out U+001C to U+001F.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
WORD_CLASS = r"\p{Alphabetic}\p{M}\p{N}\p{Pc}"
JAVA_WORD_CLASS = r"\p{IsAlphabetic}\p{M}\p{N}\p{Pc}"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MARKER = "▁"


def byte_spans(text: str, start: int = 0) -> list[tuple[int, int]]:
    out = []
    for c in text:
        n = 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
        out.append((start, start + n))
        start += n
    return out


def is_punctuation(c: str) -> bool:
    return c in ASCII_PUNCTUATION or unicodedata.category(c)[0] == "P"


def map_scalars(text: str, spans: Spans, f: Callable[[str], str]) -> tuple[str, Spans]:
    """f of each scalar; what it gives has the source of the scalar."""
    if spans is None:
        return "".join(map(f, text)), None
    parts, out = [], []
    for c, span in zip(text, spans, strict=True):
        parts.append(new := f(c))
        out += [span] * len(new)
    return "".join(parts), out


def substitute(text: str, spans: Spans, pattern: regex.Pattern, by: str) -> tuple[str, Spans]:
    """Every match replaced by a literal; that has the source of the match's last scalar."""
    if spans is None:
        return pattern.sub(lambda _: by, text), None
    parts, out, last = [], [], 0
    for m in pattern.finditer(text):
        parts += [text[last : m.start()], by]
        if m.end() > m.start():
            at = spans[m.end() - 1]
        else:
            edge = spans[m.start()][0] if m.start() < len(spans) else spans[-1][1] if spans else 0
            at = (edge, edge)
        out += spans[last : m.start()] + [at] * len(by)
        last = m.end()
    return "".join([*parts, text[last:]]), out + spans[last:]


def prefixed(text: str, spans: Spans, by: str) -> tuple[str, Spans]:
    if spans is None:
        return by + text, None
    start = spans[0][0] if spans else 0
    return by + text, [(start, spans[0][1] if spans else start)] * len(by) + spans


# --- patterns ---

_CLASSES = {"s": r"\p{White_Space}", "S": r"\P{White_Space}", "d": r"\p{Nd}", "D": r"\P{Nd}", "h": "0-9a-fA-F"}


def translated(pattern: str, java: bool = False) -> str:
    """A pattern of the Oniguruma dialect for `regex` (or java.util.regex): Unicode classes spelled out, (?m) as dotall."""
    if len(pattern.encode()) > MAX_PATTERN:
        raise TokenizerError("invalidConfiguration", "the pattern is too long")
    word = JAVA_WORD_CLASS if java else WORD_CLASS
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            i += 2
            if e in _CLASSES:
                name = _CLASSES[e].replace("White_Space", "IsWhite_Space" if java else "White_Space")
                out.append(f"[{name}]" if e == "h" and not depth else name)
            elif e == "w":
                out.append(word if depth else f"[{word}]")
            elif e == "W":
                out.append(f"[^{word}]")
            elif e in "pP" and pattern[i : i + 2] == "{^":
                out.append(("\\P" if e == "p" else "\\p") + "{")
                i += 2
            else:
                out.append(c + e)
            continue
        if c == "[":
            depth += 1
        elif c == "]" and depth:
            depth -= 1
        elif c == "(" and not depth and (m := re.match(r"\(\?([imx]*)(?:-([imx]+))?([:)])", pattern[i:])):
            on, off = m[1].replace("m", "s"), (m[2] or "").replace("m", "s")
            out.append(f"(?{on}{'-' + off if off else ''}{m[3]}")
            i += m.end()
            continue
        out.append(c)
        i += 1
    return "".join(out)


@functools.lru_cache(256)
def compiled(pattern: str) -> regex.Pattern:
    try:
        return regex.compile(translated(pattern), regex.V1 | regex.MULTILINE)
    except regex.error as e:
        raise TokenizerError("invalidConfiguration", f"pattern {pattern!r}: {e}") from e


def java_pattern(pattern: str) -> str:
    return "(?dm)" + translated(pattern, java=True)


def pattern_of(config: dict) -> tuple[str | None, str | None]:
    """(literal, expression) of a pattern object."""
    value = config.get("pattern")
    if isinstance(value, str):
        return value, None
    if isinstance(value, dict):
        if isinstance(value.get("String"), str):
            return value["String"], None
        if isinstance(value.get("Regex"), str):
            return None, value["Regex"]
    return None, None


# --- the byte alphabet ---

#: Bytes that stand for themselves; the others follow from U+0100 on, in order.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_TO_CHAR = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
CHAR_TO_BYTE = {c: b for b, c in BYTE_TO_CHAR.items()}
#: For translate(): Latin-1 characters whose byte has another one in the alphabet, and those.
MOVED = "".join(chr(b) for b in range(256) if BYTE_TO_CHAR[b] != chr(b))
MOVED_TO = "".join(BYTE_TO_CHAR[ord(c)] for c in MOVED)
_TABLE = str.maketrans(MOVED, MOVED_TO)
_BACK = str.maketrans(MOVED_TO, MOVED)


def to_alphabet(text: str) -> str:
    return text.encode().decode("latin-1").translate(_TABLE)


def from_alphabet(token: str) -> bytes:
    """The bytes of an alphabet token; of one with any other scalar, its own UTF-8."""
    if all(c in CHAR_TO_BYTE for c in token):
        return token.translate(_BACK).encode("latin-1")
    return token.encode()


def alphabet_spans(text: str, spans: Spans) -> Spans:
    if spans is None:
        return None
    return [s for c, s in zip(text, spans, strict=True) for _ in range(len(c.encode()))]
