"""Pre-tokenizers: a piece of text into ordered, non-empty pieces.

split(piece) works on Piece objects, which carry source ranges where offsets are wanted and know
whether they stand at the start of the original text.  column(c) gives array<string> natively,
for those that have such a form.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, functions as F

from .config import boolean, flag, required
from .errors import TokenizerError
from .normalizers import byte_level
from .quick import finder, not_white
from .text import ASCII_PUNCTUATION, JAVA_WORD_CLASS, MARKER, WORD_CLASS, Spans, alphabet_spans, compiled, is_punctuation, java_pattern, pattern_of, prefixed, to_alphabet

#: Fixed value: the published pattern of the byte-level tokenizers.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BEHAVIORS = ("Removed", "Isolated", "MergedWithPrevious", "MergedWithNext", "Contiguous")
#: A scalar that no text has, to mark cuts in the native forms.
CUT = "\ufdd0"


@dataclass(slots=True)
class Piece:
    text: str
    spans: Spans
    first: bool  # at offset 0 of the original text
    byte_level: bool = False  # its text is in the byte alphabet
    start: int = 0  # in scalars of the section, to tell what is still at its front

    def cut(self, a: int, b: int) -> Piece:
        return Piece(self.text[a:b], self.spans and self.spans[a:b], self.first and a == 0, self.byte_level)


Quick = tuple[Callable[[str, bool], list[str]], Callable[[str], list[Piece]]]


def partition(text: str, matches: Iterable[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """Matches and the gaps between them, in order."""
    out, last = [], 0
    for a, b in matches:
        if a > last:
            out.append((last, a, False))
        out.append((a, b, True))
        last = b
    if last < len(text):
        out.append((last, len(text), False))
    return out


def behave(parts: list[tuple[int, int, bool]], behavior: str) -> list[tuple[int, int]]:
    """The pieces that a delimiter behavior makes of a partition; empty ones go."""
    if behavior == "Removed":
        out = [(a, b) for a, b, m in parts if not m]
    elif behavior == "Isolated":
        out = [(a, b) for a, b, _ in parts]
    elif behavior == "Contiguous":
        out, last = [], None
        for a, b, m in parts:
            if m == last and out:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            last = m
    else:
        out, before = [], False
        forward = behavior == "MergedWithPrevious"
        for a, b, m in parts if forward else reversed(parts):
            if m and not before and out:
                out[-1] = (out[-1][0], b) if forward else (a, out[-1][1])
            else:
                out.append((a, b))
            before = m
        if not forward:
            out.reverse()
    return [(a, b) for a, b in out if b > a]


class PreTokenizer:
    native = False
    cuts_in_place = False  # placed() tells where the strings are that quick() cuts a text into

    def __init__(self, config: dict) -> None:
        self.config = config

    def ranges(self, piece: Piece) -> list[tuple[int, int]]:
        return [(0, len(piece.text))]

    def split(self, piece: Piece) -> list[Piece]:
        return [piece.cut(a, b) for a, b in self.ranges(piece)]

    def quick(self) -> Quick | None:
        """Where offsets aren't wanted: cut(text, first) into strings, and rest(string) into its pieces, whatever stands around it."""
        return lambda text, first: [text[a:b] for a, b in self.ranges(Piece(text, None, first))], lambda raw: [Piece(raw, None, False)]

    def column(self, c: Column) -> Column:
        raise TokenizerError("unsupportedComponent", f"{self.config.get('type')} has no native form")


class Sequence(PreTokenizer):
    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.parts = [pre_tokenizer(x) for x in required(config, "pretokenizers", list)]
        self.native = all(p.native for p in self.parts)

    def split(self, piece: Piece) -> list[Piece]:
        pieces = [piece]
        for part in self.parts:
            pieces = [p for x in pieces for p in part.split(x) if p.text]
        return pieces

    def quick(self) -> Quick | None:
        first = self.parts[0].quick() if self.parts else None
        if first is None or any(isinstance(p, Metaspace | Sequence) for p in self.parts[1:]):
            return None
        cut, inner = first

        def rest(raw: str) -> list[Piece]:
            pieces = inner(raw)
            for part in self.parts[1:]:
                pieces = [p for x in pieces for p in part.split(x) if p.text]
            return pieces

        return cut, rest

    def column(self, c: Column) -> Column:
        pieces = F.array(c)
        for part in self.parts:
            pieces = F.filter(F.flatten(F.transform(pieces, part.column)), lambda p: p != "")
        return pieces


class Matching(PreTokenizer):
    """Pieces are the matches of a pattern."""

    native = True
    pattern: regex.Pattern
    java: str

    def ranges(self, piece: Piece) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(piece.text)]

    cuts_in_place = True

    def quick(self) -> Quick | None:
        find = finder(self.pattern)
        return lambda text, first: find(text), lambda raw: [Piece(raw, None, False)]

    def placed(self, text: str) -> tuple[list[str], np.ndarray]:
        """The pieces of a text and where they start."""
        pieces = self.quick()[0](text, True)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.concatenate([[0], ends[:-1]])
        if len(pieces) == 0 or ends[-1] == len(text):
            return pieces, starts[: len(pieces)]
        black = not_white(text)  # what pieces leave out is white space, or the places are looked for
        if len(black) == ends[-1]:
            return pieces, black[starts]
        found = [m.span() for m in self.pattern.finditer(text)]
        return [text[a:b] for a, b in found], np.fromiter((a for a, _ in found), np.int64, len(found))

    def column(self, c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(self.java), F.lit(0))


class Whitespace(Matching):
    pattern = regex.compile(rf"[{WORD_CLASS}\u200c\u200d]+|[^{WORD_CLASS}\u200c\u200d\p{{White_Space}}]+")
    java = rf"[{JAVA_WORD_CLASS}\x{{200C}}\x{{200D}}]+|[^{JAVA_WORD_CLASS}\x{{200C}}\x{{200D}}\p{{IsWhite_Space}}]+"


class WhitespaceSplit(Matching):
    pattern = regex.compile(r"\P{White_Space}+")
    java = r"\P{IsWhite_Space}+"

    def quick(self) -> Quick | None:
        find, odd = self.pattern.findall, re.compile("[\x1c-\x1f]").search  # white space to split() alone
        return lambda text, first: find(text) if odd(text) else text.split(), lambda raw: [Piece(raw, None, False)]


class Bert(Matching):
    """White space goes, each punctuation mark stands alone."""

    pattern = regex.compile(r"[\p{P}$+<=>^`|~]|[^\p{P}$+<=>^`|~\p{White_Space}]+")
    java = r"[\p{P}$+<=>^`|~]|[^\p{P}$+<=>^`|~\p{IsWhite_Space}]+"


class Delimited(PreTokenizer):
    """Cuts at matches by a delimiter behavior.  Subclasses give matches() and the Java pattern."""

    behavior, invert = "Isolated", False
    java: str | None = None

    @property
    def native(self) -> bool:  # type: ignore[override]
        return self.java is not None and self.behavior in ("Isolated", "Removed", "Contiguous")

    def matches(self, text: str) -> Iterable[tuple[int, int]]:
        raise NotImplementedError

    def ranges(self, piece: Piece) -> list[tuple[int, int]]:
        parts = partition(piece.text, self.matches(piece.text))
        if self.invert:
            parts = [(a, b, not m) for a, b, m in parts]
        return behave(parts, self.behavior)

    def column(self, c: Column) -> Column:
        pattern = self.java
        if self.behavior == "Contiguous":
            pattern = f"(?:{pattern})+"
        if self.behavior == "Removed" and self.invert:
            return F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda p: p != "")
        marked = F.regexp_replace(c, F.lit(f"({pattern})"), F.lit(CUT if self.behavior == "Removed" else f"{CUT}$1{CUT}"))
        return F.filter(F.split(marked, CUT), lambda p: p != "")


class Punctuation(Delimited):
    java = r"[\p{P}$+<=>^`|~]"

    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.behavior = config.get("behavior") if config.get("behavior") in BEHAVIORS else "Isolated"

    def matches(self, text: str) -> Iterable[tuple[int, int]]:
        return ((i, i + 1) for i, c in enumerate(text) if is_punctuation(c))


class Digits(Delimited):
    java = r"\p{N}"

    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.behavior = "Isolated" if flag(config, "individual_digits", False) else "Contiguous"

    def matches(self, text: str) -> Iterable[tuple[int, int]]:
        return ((i, i + 1) for i, c in enumerate(text) if unicodedata.category(c)[0] == "N")


class Split(Delimited):
    def __init__(self, config: dict) -> None:
        super().__init__(config)
        literal, expression = pattern_of(config)
        self.behavior = config.get("behavior") if config.get("behavior") in BEHAVIORS else "Isolated"
        self.invert = flag(config, "invert", False)
        if literal:
            self.pattern, self.java = regex.compile(regex.escape(literal)), "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        elif expression:
            self.pattern, self.java = compiled(expression), java_pattern(expression)
        else:
            self.pattern = None
        if self.invert and self.behavior != "Removed":
            self.java = None

    def matches(self, text: str) -> Iterable[tuple[int, int]]:
        return (m.span() for m in self.pattern.finditer(text) if m.end() > m.start()) if self.pattern else ()

    def quick(self) -> Quick | None:
        general, rest = super().quick()
        if self.pattern is None or self.invert != (self.behavior == "Removed") or self.behavior not in ("Isolated", "Removed"):
            return general, rest
        find, alone = finder(self.pattern), self.invert

        def cut(text: str, first: bool) -> list[str]:
            found = find(text)
            # all of a text is in matches, or only matches are wanted
            return [x for x in found if x] if alone else found if sum(map(len, found)) == len(text) and "" not in found else general(text, first)

        return cut, rest


class Metaspace(PreTokenizer):
    native = True

    def __init__(self, config: dict) -> None:
        super().__init__(config)
        replacement = config.get("replacement")
        replacement = replacement if isinstance(replacement, str) else " "
        self.by = config["str_rep"] if isinstance(config.get("str_rep"), str) else replacement
        self.cuts = flag(config, "split", True)
        scheme = config.get("prepend_scheme")
        if isinstance(scheme, str):
            self.scheme = scheme if scheme in ("first", "never") else "always"
        else:
            self.scheme = "always" if boolean(config.get("add_prefix_space"), True) else "never"

    def split(self, piece: Piece) -> list[Piece]:
        text, spans = piece.text.replace(" ", self.by), piece.spans
        if spans is not None and len(self.by) != 1:
            spans = [s for c, s in zip(piece.text, spans, strict=True) for _ in range(len(self.by) if c == " " else 1)]
        if (self.scheme == "always" or self.scheme == "first" and piece.first) and not text.startswith(self.by):
            text, spans = prefixed(text, spans, self.by)
        whole = Piece(text, spans, piece.first, piece.byte_level)
        if not self.cuts:
            return [whole]
        at = [m.span() for m in regex.finditer(regex.escape(self.by), text)] if self.by else []
        return [whole.cut(a, b) for a, b in behave(partition(text, at), "MergedWithNext")]

    def quick(self) -> Quick | None:
        if not self.cuts or not self.by:
            return None
        mark = regex.escape(self.by)
        find = regex.compile(f"(?s)(?:{mark})?(?:(?!{mark}).)+|{mark}").findall
        if len(self.by) == 1:

            def find(text: str) -> list[str]:  # noqa: F811
                head, *tail = text.split(self.by)
                return [head, *[self.by + x for x in tail]] if head else [self.by + x for x in tail]

        def cut(text: str, first: bool) -> list[str]:
            text = text.replace(" ", self.by)
            if (self.scheme == "always" or self.scheme == "first" and first) and not text.startswith(self.by):
                text = self.by + text
            return find(text)

        return cut, lambda raw: [Piece(raw, None, False)]

    def column(self, c: Column) -> Column:
        c = F.replace(c, F.lit(" "), F.lit(self.by))
        if self.scheme != "never":  # natively a text is one section, at the start
            c = F.when(c.startswith(self.by), c).otherwise(F.concat(F.lit(self.by), c))
        quoted = "\\Q" + self.by + "\\E"
        return F.regexp_extract_all(c, F.lit(f"(?s)(?:{quoted})?(?:(?!{quoted}).)+|{quoted}"), F.lit(0)) if self.cuts else F.array(c)


class ByteLevel(PreTokenizer):
    native = True

    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.prefix, self.cuts = flag(config, "add_prefix_space", False), flag(config, "use_regex", True)

    def split(self, piece: Piece) -> list[Piece]:
        if piece.byte_level:
            piece = Piece(piece.text, piece.spans, piece.first)
        if self.prefix and not piece.text.startswith(" "):
            piece = Piece(*prefixed(piece.text, piece.spans, " "), piece.first)
        pieces = [piece.cut(*m.span()) for m in compiled(GPT2).finditer(piece.text)] if self.cuts else [piece]
        return [Piece(to_alphabet(p.text), alphabet_spans(p.text, p.spans), p.first, True) for p in pieces]

    def quick(self) -> Quick | None:
        if self.prefix or not self.cuts:
            return None
        find = finder(compiled(GPT2))
        return lambda text, first: find(text), lambda raw: [Piece(to_alphabet(raw), None, False, True)]

    @property
    def cuts_in_place(self) -> bool:  # type: ignore[override]
        return self.cuts and not self.prefix

    placed = Matching.placed
    pattern = compiled(GPT2)

    def column(self, c: Column) -> Column:
        c = F.when(c.startswith(" "), c).otherwise(F.concat(F.lit(" "), c)) if self.prefix else c
        if not self.cuts:
            return F.array(byte_level(c))
        # all pieces go to the byte alphabet in one string, with marks between them
        pieces = F.array_join(F.regexp_extract_all(c, F.lit(java_pattern(GPT2)), F.lit(0)), CUT)
        return F.filter(F.split(byte_level(pieces), to_alphabet(CUT)), lambda p: p != "")


class CharDelimiter(Delimited):
    behavior = "Removed"

    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.delimiter = required(config, "delimiter", str)
        if len(self.delimiter) != 1:
            raise TokenizerError("invalidConfiguration", "delimiter is one scalar")
        self.java = "\\Q" + self.delimiter + "\\E"

    def matches(self, text: str) -> Iterable[tuple[int, int]]:
        return ((i, i + 1) for i, c in enumerate(text) if c == self.delimiter)


class FixedLength(PreTokenizer):
    native = True

    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.length = config.get("length", 5)
        if not isinstance(self.length, int) or self.length < 1:
            raise TokenizerError("invalidConfiguration", "length is positive")

    def ranges(self, piece: Piece) -> list[tuple[int, int]]:
        n = len(piece.text)
        return [(i, min(n, i + self.length)) for i in range(0, n, self.length)]

    def column(self, c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{self.length}}}"), F.lit(0))


#: Names of scripts.
SCRIPTS = """Latin Greek Cyrillic Armenian Hebrew Arabic Syriac Thaana Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Thai
Lao Tibetan Myanmar Georgian Hangul Ethiopic Cherokee Canadian_Aboriginal Ogham Runic Khmer Mongolian Hiragana Katakana Bopomofo Han Yi Old_Italic Gothic
Deseret Inherited Tagalog Hanunoo Buhid Tagbanwa Limbu Tai_Le Linear_B Ugaritic Shavian Osmanya Cypriot Braille Buginese Coptic New_Tai_Lue Glagolitic
Tifinagh Syloti_Nagri Old_Persian Kharoshthi Balinese Cuneiform Phoenician Phags_Pa Nko Sundanese Lepcha Ol_Chiki Vai Saurashtra Kayah_Li Rejang Cham
Tai_Tham Tai_Viet Avestan Egyptian_Hieroglyphs Samaritan Lisu Bamum Javanese Meetei_Mayek Batak Brahmi Mandaic Common""".split()


@functools.lru_cache(65536)
def script_of(c: str) -> str | None:
    """The script of a scalar for cutting: kana count as Han; None joins its neighbours."""
    if c == " ":
        return None
    if c == "ー":
        return "Han"
    for name in SCRIPTS:
        if regex.match(rf"\p{{Script={name}}}", c):
            return "Han" if name in ("Hiragana", "Katakana") else name
    return None


class UnicodeScripts(PreTokenizer):
    def ranges(self, piece: Piece) -> list[tuple[int, int]]:
        cuts, last = [], ""
        for i, c in enumerate(piece.text):
            script = script_of(c)
            if script is not None:
                if script != last:
                    cuts.append(i)
                last = script
        return list(zip(cuts, [*cuts[1:], len(piece.text)], strict=True)) if cuts else []


KINDS: dict[str, Callable[[dict], PreTokenizer]] = {
    "Sequence": Sequence, "BertPreTokenizer": Bert, "Whitespace": Whitespace, "WhitespaceSplit": WhitespaceSplit, "Punctuation": Punctuation, "Digits": Digits, "Split": Split,
    "Metaspace": Metaspace, "ByteLevel": ByteLevel, "CharDelimiterSplit": CharDelimiter, "FixedLength": FixedLength, "UnicodeScripts": UnicodeScripts,
}


def pre_tokenizer(config: dict | None) -> PreTokenizer:
    if config is None:
        return PreTokenizer({})
    kind = config.get("type")
    if kind not in KINDS:
        raise TokenizerError("unsupportedComponent", f"pre-tokenizer {kind!r}")
    return KINDS[kind](config)


__all__ = ["ASCII_PUNCTUATION", "GPT2", "MARKER", "Piece", "PreTokenizer", "pre_tokenizer"]
