"""Configurations: a relaxed JSON reader, coercions, and a writer.

Read: UTF-8 (with or without a byte order mark) or UTF-16 with one; trailing commas; Infinity and
NaN; at most 512 levels; keys distinct by bytes, the last of equal ones holding.  Integers beyond
64 bits become floats; leading zeros are errors.
"""

from __future__ import annotations

import codecs
import json
import re
from typing import Any

from .errors import JSONConfigError, TokenizerError

MAX_DEPTH = 512
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_STRING = re.compile(r'[^"\\\x00-\x1f]*')
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def decoded(data: bytes) -> str:
    for mark, kind in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            data = data[len(mark) :]
            break
    else:
        kind = "utf-8"
    try:
        return data.decode(kind)
    except UnicodeDecodeError as e:
        raise JSONConfigError("invalidEncoding", str(e)) from e


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self, kind: str) -> JSONConfigError:
        return JSONConfigError(kind, f"at character {self.at}")

    def space(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def string(self) -> str:
        parts, self.at = [], self.at + 1
        while True:
            run = _STRING.match(self.text, self.at)
            parts.append(run.group())
            self.at = run.end()
            c = self.text[self.at : self.at + 1]
            if c == '"':
                self.at += 1
                out = "".join(parts)
                if any(0xD800 <= ord(x) < 0xE000 for x in out):
                    out = out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
                return out
            if c != "\\":
                raise self.fail("unexpectedEnd" if not c else "invalidString")
            e = self.text[self.at + 1 : self.at + 2]
            if e == "u":
                digits = self.text[self.at + 2 : self.at + 6]
                if not re.fullmatch("[0-9a-fA-F]{4}", digits):
                    raise self.fail("invalidEscape")
                parts.append(chr(int(digits, 16)))
                self.at += 6
            elif e in _ESCAPES:
                parts.append(_ESCAPES[e])
                self.at += 2
            else:
                raise self.fail("invalidEscape")

    def value(self, depth: int) -> Any:
        if depth > MAX_DEPTH:
            raise self.fail("tooDeep")
        c = self.space()
        if c == '"':
            return self.string()
        if c == "{":
            out: dict[str, Any] = {}
            self.at += 1
            while self.space() != "}":
                if self.text[self.at : self.at + 1] != '"':
                    raise self.fail("unexpectedCharacter")
                key = self.string()
                if self.space() != ":":
                    raise self.fail("unexpectedCharacter")
                self.at += 1
                out[key] = self.value(depth + 1)
                if self.space() == ",":
                    self.at += 1
                elif self.text[self.at : self.at + 1] != "}":
                    raise self.fail("unexpectedCharacter")
            self.at += 1
            return out
        if c == "[":
            items: list[Any] = []
            self.at += 1
            while self.space() != "]":
                items.append(self.value(depth + 1))
                if self.space() == ",":
                    self.at += 1
                elif self.text[self.at : self.at + 1] != "]":
                    raise self.fail("unexpectedCharacter")
            self.at += 1
            return items
        for word, meaning in _WORDS.items():
            if self.text.startswith(word, self.at):
                self.at += len(word)
                return meaning
        number = _NUMBER.match(self.text, self.at)
        if not number:
            raise self.fail("unexpectedEnd" if not c else "unexpectedCharacter")
        self.at = number.end()
        if self.text[self.at : self.at + 1].isdigit():
            raise self.fail("invalidNumber")
        if number[1] or number[2]:
            return float(number.group())
        whole = int(number.group())
        return whole if -(2**63) <= whole < 2**63 else float(whole)


def _depth(value: Any) -> int:
    level, depth = [value], 0
    while level := [x for v in level if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v) or [None]]:
        depth += 1
    return depth


def parse_json(data: bytes | str) -> Any:
    text = decoded(data) if isinstance(data, bytes) else data.removeprefix("\ufeff")
    if "\\u" not in text:  # pairs of surrogates are put together by our own reader
        try:  # the standard reader is far faster, and refuses what we relax
            out = json.loads(text, parse_int=lambda s: n if -(2**63) <= (n := int(s)) < 2**63 else float(s))
            if _depth(out) <= MAX_DEPTH:
                return out
        except (ValueError, RecursionError):
            pass
    reader = _Reader(text)
    out = reader.value(1)
    if reader.space():
        raise reader.fail("trailingContent")
    return out


def to_json(config: Any) -> str:
    return json.dumps(config, ensure_ascii=False)


def boolean(value: Any, default: bool | None = None) -> bool | None:
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value == 1
    if isinstance(value, str):
        return value.lower() in ("true", "t", "1")
    return default


def flag(config: dict, key: str, default: bool) -> bool:
    value = boolean(config.get(key), default)
    return default if value is None else value


def required(config: dict, key: str, kind: type | tuple[type, ...] = object) -> Any:
    value = config.get(key)
    if value is None or not isinstance(value, kind):
        raise TokenizerError("invalidConfiguration", f"{config.get('type', 'component')} needs {key}")
    return value


def token_text(value: Any) -> str | None:
    """A special token given as a string or as an object with content."""
    if isinstance(value, dict):
        value = value.get("content")
    return value if isinstance(value, str) else None


def string_map(value: Any) -> dict[str, int]:
    if not isinstance(value, dict) or not all(isinstance(i, int) and not isinstance(i, bool) and i >= 0 for i in value.values()):
        raise TokenizerError("invalidConfiguration", "a vocabulary maps strings to ids")
    return value


def string_pairs(value: Any) -> list[tuple[str, str]]:
    """Merges as `a b` strings or as pairs, one format for all; a `#version` line is skipped."""
    if not isinstance(value, list):
        raise TokenizerError("invalidConfiguration", "merges are a list")
    out: list[tuple[str, str]] = []
    if value and isinstance(value[0], str) and value[0].startswith("#version"):
        value = value[1:]
    kinds = {isinstance(m, str) for m in value}
    if len(kinds) > 1:
        raise TokenizerError("invalidConfiguration", "merges of mixed formats")
    for merge in value:
        parts = merge.split(" ") if isinstance(merge, str) else merge
        if not isinstance(parts, list) or len(parts) != 2 or not all(isinstance(p, str) for p in parts):
            raise TokenizerError("invalidConfiguration", f"merge {merge!r}")
        out.append((parts[0], parts[1]))
    return out


def scored_tokens(value: Any) -> list[tuple[str, float]]:
    out = []
    if not isinstance(value, list):
        raise TokenizerError("invalidConfiguration", "a scored vocabulary is a list")
    for row in value:
        if not isinstance(row, list) or len(row) != 2 or not isinstance(row[0], str) or isinstance(row[1], bool) or not isinstance(row[1], int | float) or row[1] - row[1] != 0:
            raise TokenizerError("invalidConfiguration", f"scored token {row!r}")
        out.append((row[0], float(row[1])))
    return out
