"""Normalizers.  apply(text, spans, offset) gives the normalized text and its source ranges.

spans is None where offsets aren't wanted; offset is where the section stands in the original
text.  column(c) is the same as a native expression, for those that have one.
"""

from __future__ import annotations

import base64
import struct
import re
import unicodedata
from collections.abc import Callable

import regex
from pyspark.sql import Column, functions as F

from .config import flag, required
from .errors import TokenizerError
from .quick import WIDE, narrowed
from .text import MARKER, MOVED, MOVED_TO, WHITE_SPACE, Spans, alphabet_spans, compiled, java_pattern, map_scalars, pattern_of, prefixed, substitute, to_alphabet

SPACE_RUN = regex.compile(r"\p{White_Space}+")


class Normalizer:
    native = False

    def __init__(self, config: dict) -> None:
        self.config = config

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        return text, spans

    def column(self, c: Column) -> Column:
        raise TokenizerError("unsupportedComponent", f"{self.config.get('type')} has no native form")

    def __call__(self, text: str, offset: int = 0) -> str:
        return self.apply(text, None, offset)[0]


class Identity(Normalizer):
    native = True

    def column(self, c: Column) -> Column:
        return c


class Sequence(Normalizer):
    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.parts = [normalizer(x) for x in required(config, "normalizers", list)]
        self.native = all(p.native for p in self.parts)

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        for part in self.parts:
            text, spans = part.apply(text, spans, offset)
        return text, spans

    def column(self, c: Column) -> Column:
        for part in self.parts:
            c = part.column(c)
        return c


class Prepend(Normalizer):
    native = True

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        return prefixed(text, spans, self.config.get("prepend") or "") if text else (text, spans)

    def column(self, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(self.config.get("prepend") or ""), c)).otherwise(c)


class Replace(Normalizer):
    native = True

    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.literal, self.expression = pattern_of(config)
        self.content = config.get("content")
        if self.literal is not None:
            self.pattern = regex.compile(regex.escape(self.literal)) if self.literal else regex.compile("")
        elif self.expression is not None:
            self.pattern = compiled(self.expression)
        else:
            self.content = None  # no pattern: nothing to do

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        return substitute(text, spans, self.pattern, self.content) if self.content is not None and text else (text, spans)

    def column(self, c: Column) -> Column:
        if self.content is None:
            return c
        by = F.lit(self.content.replace("\\", "\\\\").replace("$", "\\$"))
        if self.literal:
            return F.replace(c, F.lit(self.literal), F.lit(self.content))
        return F.when(c != "", F.regexp_replace(c, F.lit(java_pattern(self.expression or "")), by)).otherwise(c)


class Lowercase(Normalizer):
    native = True

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        if spans is None and "Σ" not in text:
            return text.lower(), None
        return map_scalars(text, spans, str.lower)  # scalar by scalar: no final sigma

    def column(self, c: Column) -> Column:
        return F.array_join(F.transform(F.split(c, ""), F.lower), "")


#: Scalars of Unicode 10 and later that normalization would change or move (decompositions, combining classes).
LATER = (
    (0x898, 0x89F), (0x8CA, 0x8D3), (0xC3C, 0xC3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0x32FF, 0x32FF), (0xA7F2, 0xA7F4), (0xA82C, 0xA82C),
    (0xAB69, 0xAB69), (0x10781, 0x107BA), (0x10D24, 0x10D27), (0x10D69, 0x10D6D), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11938, 0x11938), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1DF00, 0x1DF2A), (0x1E030, 0x1E06D), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
    (0x1F16C, 0x1F16C), (0x1FBF0, 0x1FBF9),
)
_LATER = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER) + "])")


class Unicode(Normalizer):
    """NFC, NFD, NFKC or NFKD of the scalars that Unicode 9 knows.

    Later ones pass as they are, and what stands on either side of one is normalized for itself.
    """

    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.form = config["type"]

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        if unicodedata.is_normalized(self.form, text):
            return text, spans
        parts, out, at = [], [], 0
        for k, part in enumerate(_LATER.split(text)):
            own = spans and spans[at : at + len(part)]
            new, own = (part, own) if k % 2 else self._stretch(part, own)
            parts.append(new)
            out += own or ()
            at += len(part)
        return "".join(parts), None if spans is None else out

    def _stretch(self, text: str, spans: Spans) -> tuple[str, Spans]:
        if spans is None:
            return unicodedata.normalize(self.form, text), None
        parts, out, start = [], [], 0
        for i in range(1, len(text) + 1):  # a stretch ends before a starter that doesn't compose with it
            if i == len(text) or unicodedata.combining(text[i]) == 0 and unicodedata.normalize(self.form, text[start : i + 1]) == unicodedata.normalize(self.form, text[start:i]) + unicodedata.normalize(self.form, text[i]):
                new = unicodedata.normalize(self.form, text[start:i])
                own = spans[start:i]
                parts.append(new)
                if len(new) == len(own):
                    out += own
                else:
                    out += [(own[0][0], own[-1][1])] * len(new)
                start = i
        return "".join(parts), out


def _is_cjk(c: str) -> bool:
    n = ord(c)
    return any(a <= n <= b for a, b in CJK)


#: The ideographs that are set apart by spaces.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


class Bert(Normalizer):
    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.clean, self.cjk, self.lower = (flag(config, k, True) for k in ("clean_text", "handle_chinese_chars", "lowercase"))
        self.accents = flag(config, "strip_accents", self.lower)
        self.native = not self.accents

    @staticmethod
    def _clean(c: str) -> str:
        if c in "\t\n\r ":
            return " "
        if c in "\0�" or unicodedata.category(c) in ("Cc", "Cf", "Co"):
            return ""
        return " " if c in WHITE_SPACE else c

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        if spans is None:
            return self._plain(text), None
        if self.clean:
            text, spans = map_scalars(text, spans, self._clean)
        if self.cjk:
            text, spans = map_scalars(text, spans, lambda c: f" {c} " if _is_cjk(c) else c)
        if self.accents:
            text, spans = Unicode({"type": "NFD"}).apply(text, spans, offset)
            text, spans = map_scalars(text, spans, lambda c: "" if unicodedata.category(c) == "Mn" else c)
        if self.lower:
            text, spans = map_scalars(text, spans, str.lower)
        return text, spans

    def _plain(self, text: str) -> str:
        """The same without offsets, where most texts have nothing to clean."""
        if self.clean:
            wide = WIDE(text)
            text = (SPACE_ONE if wide else SPACE_ONE_LATIN).sub(" ", (DROPPED if wide else DROPPED_LATIN).sub("", text))
        if self.cjk and not text.isascii():
            text = IDEOGRAPH.sub(r" \g<0> ", text)
        if self.accents and not text.isascii():
            text = MN.sub("", unicodedata.normalize("NFD", text))
        return LOWER.apply(text, None, 0)[0] if self.lower else text

    def column(self, c: Column) -> Column:
        if self.clean:
            c = F.regexp_replace(F.regexp_replace(c, r"[\p{Cc}\p{Cf}\p{Co}\x{FFFD}&&[^\t\n\r]]", ""), r"\p{IsWhite_Space}", " ")
        if self.cjk:
            c = F.regexp_replace(c, "([" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK) + "])", " $1 ")
        return Lowercase(self.config).column(c) if self.lower else c


DROPPED = regex.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\p{Cf}\p{Co}\ufffd]")
SPACE_ONE = regex.compile(r"[^\P{White_Space} ]")  # a space is one already
DROPPED_LATIN, SPACE_ONE_LATIN = narrowed(DROPPED.pattern), narrowed(SPACE_ONE.pattern)
IDEOGRAPH = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK) + "]")
MN = regex.compile(r"\p{Mn}")
LOWER = Lowercase({})


class Precompiled(Normalizer):
    """A compiled table of SentencePiece: a double-array trie over UTF-8, then NUL-terminated replacements."""

    def __init__(self, config: dict) -> None:
        super().__init__(config)
        try:
            data = base64.b64decode(required(config, "precompiled_charsmap", str), validate=True)
            (size,) = struct.unpack_from("<I", data)
            if size % 4 or 4 + size > len(data):
                raise ValueError("the size of the trie")
            self.units = struct.unpack_from(f"<{size // 4}I", data, 4)
            self.table = data[4 + size :]
            self.table.decode()
        except (ValueError, struct.error) as e:
            raise TokenizerError("invalidConfiguration", f"precompiled_charsmap: {e}") from e

    def _first(self, key: bytes) -> str | None:
        """The replacement of the first (shortest) prefix of the key that the trie has."""
        node = 0
        unit = self.units[node] if self.units else 0
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for b in key:
            if not b:
                return None
            node ^= b
            if node >= len(self.units):
                return None
            unit = self.units[node]
            if unit & 0x800000FF != b:
                return None
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1 and node < len(self.units):
                start = self.units[node] & 0x7FFFFFFF
                end = self.table.find(b"\0", start)
                return self.table[start : end if end >= 0 else len(self.table)].decode("utf-8", "replace")
        return None

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        parts, out, at = [], [], 0
        for cluster in regex.findall(r"\X", text):
            new = self._first(cluster.encode()) if len(cluster.encode()) < 6 else None
            if new is not None:
                parts.append(new)
                if spans is not None:
                    out += [(spans[at][0], spans[at + len(cluster) - 1][1])] * len(new)
            else:
                for i, c in enumerate(cluster):
                    one = self._first(c.encode())
                    parts.append(one := c if one is None else one)
                    if spans is not None:
                        out += [spans[at + i]] * len(one)
            at += len(cluster)
        return "".join(parts), None if spans is None else out


class StripAccents(Normalizer):
    native = True

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        return map_scalars(text, spans, lambda c: "" if unicodedata.category(c)[0] == "M" else c)

    def column(self, c: Column) -> Column:
        return F.regexp_replace(c, r"\p{M}", "")


class Strip(Normalizer):
    native = True

    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.left, self.right = flag(config, "strip_left", True), flag(config, "strip_right", True)

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        start = len(text) - len(text.lstrip(WHITE_SPACE)) if self.left else 0
        end = len(text.rstrip(WHITE_SPACE)) if self.right else len(text)
        end = max(start, end)
        return text[start:end], spans and spans[start:end]

    def column(self, c: Column) -> Column:
        c = F.regexp_replace(c, r"\A\p{IsWhite_Space}+", "") if self.left else c
        return F.regexp_replace(c, r"\p{IsWhite_Space}+\z", "") if self.right else c


#: Fixed values of the Nmt normalizer: scalars that go, and those that become a space.
NMT_DROP = "".join(map(chr, [*range(0x1, 0x9), 0xB, *range(0xE, 0x20), 0x7F, 0x8F, 0x9F]))
NMT_SPACE = "".join(map(chr, [0x9, 0xA, 0xC, 0xD, 0x1680, *range(0x200B, 0x2010), 0x2028, 0x2029, 0x2581, 0xFEFF, 0xFFFD]))


class Nmt(Normalizer):
    native = True

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        return map_scalars(text, spans, lambda c: "" if c in NMT_DROP else " " if c in NMT_SPACE else c)

    def column(self, c: Column) -> Column:
        return F.translate(c, NMT_SPACE + NMT_DROP, " " * len(NMT_SPACE))


class ByteLevel(Normalizer):
    native = True

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        return to_alphabet(text), alphabet_spans(text, spans)

    def column(self, c: Column) -> Column:
        return byte_level(c)


def byte_level(c: Column) -> Column:
    """Each byte of the UTF-8 as its scalar of the byte alphabet."""
    return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), MOVED, MOVED_TO)


class Metaspace(Normalizer):
    """MetaspaceNormalizer: the replacement for each space, and at the front by its scheme."""

    native = True

    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.by = required(config, "replacement", str)
        self.scheme = required(config, "prepend", str)
        self.drop = config.get("drop_whitespace")
        if len(self.by) != 1 or self.scheme not in ("always", "first", "never") or not isinstance(self.drop, bool):
            raise TokenizerError("invalidConfiguration", "MetaspaceNormalizer")

    def _prepends(self, offset: int) -> bool:
        return self.scheme == "always" or self.scheme == "first" and offset == 0

    def apply(self, text: str, spans: Spans, offset: int) -> tuple[str, Spans]:
        if self.drop:
            parts, out = [], []
            for m in regex.finditer(r"\P{White_Space}+", text):
                word, own = m.group(), spans and spans[m.start() : m.end()]
                # always: a marker at each word; first: at a word that opens the original text
                if (self.scheme == "always" or self._prepends(offset) and m.start() == 0) and not word.startswith(self.by):
                    word, own = prefixed(word, own, self.by)
                parts.append(word)
                out += own or []
            return "".join(parts), None if spans is None else out
        text = text.replace(" ", self.by)
        if text and self._prepends(offset) and not text.startswith(self.by):
            return prefixed(text, spans, self.by)
        return text, spans

    def column(self, c: Column) -> Column:
        if self.drop:
            words = F.regexp_extract_all(c, F.lit(r"\P{IsWhite_Space}+"), F.lit(0))
            marked = lambda w: F.when(w.startswith(self.by), w).otherwise(F.concat(F.lit(self.by), w))
            if self.scheme == "always":
                return F.array_join(F.transform(words, marked), "")
            joined = F.array_join(words, "")
            opens = c.rlike(r"\A\P{IsWhite_Space}")
            return F.when(opens, marked(joined)).otherwise(joined) if self.scheme == "first" else joined
        c = F.replace(c, F.lit(" "), F.lit(self.by))
        if self.scheme == "never":
            return c
        return F.when((c != "") & ~c.startswith(self.by), F.concat(F.lit(self.by), c)).otherwise(c)


KINDS: dict[str, Callable[[dict], Normalizer]] = {
    "Sequence": Sequence, "Prepend": Prepend, "Replace": Replace, "Lowercase": Lowercase, "NFC": Unicode, "NFD": Unicode, "NFKC": Unicode, "NFKD": Unicode,
    "Bert": Bert, "BertNormalizer": Bert, "Precompiled": Precompiled, "StripAccents": StripAccents, "Strip": Strip, "Nmt": Nmt, "ByteLevel": ByteLevel, "MetaspaceNormalizer": Metaspace,
}


def normalizer(config: dict | None) -> Normalizer:
    if config is None:
        return Identity({})
    kind = config.get("type")
    if kind not in KINDS:
        raise TokenizerError("unsupportedComponent", f"normalizer {kind!r}")
    return KINDS[kind](config)


__all__ = ["MARKER", "Normalizer", "byte_level", "normalizer"]
