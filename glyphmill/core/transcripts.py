"""Normal forms of transcripts, for scoring speech recognition: a basic one, and one for English with numbers in digits."""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction

import regex

from .config import parse_json
from .errors import TokenizerError

#: Letters that no decomposition spells in ASCII, and how they are spelled.
SPELLED = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}
#: Words of hesitation, and what contractions and titles stand for, in the order in which they are replaced.
HESITATIONS = "hmm mm mhm mmm uh um".split()
WHOLE_WORDS = {
    "won't": "will not", "can't": "can not", "let's": "let us", "ain't": "aint", "y'all": "you all", "wanna": "want to", "gotta": "got to", "gonna": "going to", "i'ma": "i am going to",
    "imma": "i am going to", "woulda": "would have", "coulda": "could have", "shoulda": "should have", "ma'am": "madam", "mr": "mister ", "mrs": "missus ", "st": "saint ", "dr": "doctor ",
    "prof": "professor ", "capt": "captain ", "gov": "governor ", "ald": "alderman ", "gen": "general ", "sen": "senator ", "rep": "representative ", "pres": "president ", "rev": "reverend ",
    "hon": "honorable ", "asst": "assistant ", "assoc": "associate ", "lt": "lieutenant ", "col": "colonel ", "jr": "junior ", "sr": "senior ", "esq": "esquire ",
}
WORD_ENDS = {
    "'d been": " had been", "'s been": " has been", "'d gone": " had gone", "'s gone": " has gone", "'d done": " had done", "'s got": " has got", "n't": " not", "'re": " are",
    "'s": " is", "'d": " would", "'ll": " will", "'t": " not", "'ve": " have", "'m": " am",
}
_CONTRACTIONS = [(re.compile(rf"\b{re.escape(a)}\b"), b) for a, b in WHOLE_WORDS.items()] + [(re.compile(rf"{re.escape(a)}\b"), b) for a, b in WORD_ENDS.items()]


def without_brackets(text: str) -> str:
    return re.sub(r"\(([^)]+?)\)", "", re.sub(r"[<\[][^>\]]*[>\]]", "", text))


def without_symbols(text: str, diacritics: bool, keep: str = "") -> str:
    """Marks, symbols and punctuation as spaces; with `diacritics` gone, letters are decomposed and lose theirs."""
    if not diacritics:
        return "".join(" " if unicodedata.category(c)[0] in "MSP" else c for c in unicodedata.normalize("NFKC", text))
    out = []
    for c in unicodedata.normalize("NFKD", text):
        kind = unicodedata.category(c)
        if c in SPELLED:
            out.append(SPELLED[c])
        elif c in keep or kind != "Mn":
            out.append(" " if kind[0] in "MSP" and c not in keep else c)
    return "".join(out)


def basic_normalize(text: str, remove_diacritics: bool = False, split_letters: bool = False) -> str:
    text = without_symbols(without_brackets(text.lower()), remove_diacritics).lower()
    if split_letters:
        text = " ".join(regex.findall(r"\X", text))
    return re.sub(r"\s+", " ", text)


# --- numbers ---

#: Number words.
ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
POWERS = {"hundred": 2, "thousand": 3, "million": 6, "billion": 9, "trillion": 12, "quadrillion": 15, "quintillion": 18, "sextillion": 21, "septillion": 24, "octillion": 27, "nonillion": 30, "decillion": 33}
ORDINALS = {"zeroth": (0, "th"), "first": (1, "st"), "second": (2, "nd"), "third": (3, "rd"), "fifth": (5, "th"), "twelfth": (12, "th")}
SIGNS = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
MONEY = {"pound": "£", "euro": "€", "dollar": "$", "cent": "¢"}

Number = int | str  # digits that are joined, such as "007", are a string


def _words() -> dict[str, tuple]:
    """word: (kind, value, suffix)."""
    out: dict[str, tuple] = {w: ("zero", 0, "") for w in ("o", "oh", "zero")}
    for n, w in enumerate(ONES, 1):
        out[w] = ("one", n, "")
        out[w + ("es" if w == "six" else "s")] = ("one", n, "s")
        if n > 3 and n not in (5, 12):
            out[w + ("h" if w.endswith("t") else "th")] = ("one", n, "th")
    out |= {w: ("one", n, s) for w, (n, s) in ORDINALS.items()}
    for n, w in enumerate(TENS, 2):
        out |= {w: ("ten", 10 * n, ""), w[:-1] + "ies": ("ten", 10 * n, "s"), w[:-1] + "ieth": ("ten", 10 * n, "th")}
    for w, n in POWERS.items():
        out |= {w + s: ("power", 10**n, s) for s in ("", "s", "th")}
    out |= {w: ("sign", s, "") for w, s in SIGNS.items()}
    out |= {w + p: ("money", s, "") for w, s in MONEY.items() for p in ("", "s")}
    return out | {"per": ("per", 0, ""), "percent": ("percent", 0, ""), "and": ("and", 0, ""), "point": ("point", 0, ""), "double": ("times", 2, ""), "triple": ("times", 3, "")}


WORDS = _words()
_DIGITS = re.compile(r"\d+(\.\d+)?")
_DIGIT_WORDS = {w for w, (kind, _, suffix) in WORDS.items() if kind in ("zero", "one", "ten") and not suffix}


def _kind(word: str | None) -> str:
    """The kind of a word without a suffix."""
    kind, _, suffix = WORDS.get(word, ("", 0, ""))
    return "" if suffix else kind


class _Reader:
    """Reads words from left to right; `value` is the number so far, `sign` what is to stand before it."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.value: Number | None = None
        self.sign = ""

    def emit(self, *words: object) -> None:
        for w in words:
            if w is not None:
                self.out.append(self.sign + str(w))
                self.sign = ""
        self.value = None

    def joined(self, n: int, before: str | None) -> Number:
        """The value with a number of one word after it: added where it fills zeros, else its digits behind."""
        value = self.value
        if value is None:
            return n
        room = 10 if n < 10 else 100
        if n >= 20:
            return value + n if isinstance(value, int) and value % 100 == 0 else f"{value}{n}"
        if isinstance(value, str) or _kind(before) == "one":
            return f"{str(value)[:-1]}{n}" if _kind(before) == "ten" and n < 10 else f"{value}{n}"
        return value + n if value % room == 0 else f"{value}{n}"

    def scaled(self, power: int) -> Number | None:
        """The value times a power of ten, of which thousands that were read before stay; None if that is no whole number."""
        value = self.value
        if value is None:
            return power
        if isinstance(value, str) or value == 0:
            try:
                product = Fraction(value) * power
            except ValueError:
                return None
            return product.numerator if product.denominator == 1 else None
        return value // 1000 * 1000 + value % 1000 * power

    def read(self, words: list[str]) -> list[str]:
        skip = False
        for before, word, after in zip([None, *words], words, [*words[1:], None], strict=False):
            if skip:
                skip = False
                continue
            numeric = after is not None and (_DIGITS.fullmatch(after) is not None or after in WORDS)
            signed = word[0] in "-+£€$¢"
            digits = word[1:] if signed else word
            if _DIGITS.fullmatch(digits):
                if isinstance(self.value, str) and self.value.endswith("."):
                    self.value += word
                    continue
                if self.value is not None:
                    self.emit(self.value)
                self.sign = word[0] if signed else self.sign
                whole = Fraction(digits)
                self.value = whole.numerator if whole.denominator == 1 else digits
                continue
            kind, n, suffix = WORDS.get(word, ("", 0, ""))
            if kind == "zero":
                self.value = f"{self.value or ''}0"
            elif kind in ("one", "ten"):
                joined = self.joined(n, before)
                if suffix:
                    self.emit(f"{joined}{suffix}")
                else:
                    self.value = joined
            elif kind == "power":
                scaled = self.scaled(n)
                if scaled is None:
                    self.emit(self.value)
                    scaled = n
                if suffix:
                    self.emit(f"{scaled}{suffix}")
                else:
                    self.value = scaled
            elif kind == "sign" and numeric:
                if self.value is not None:
                    self.emit(self.value)
                self.sign = n
            elif kind == "money" and self.value is not None:
                self.sign = n
                self.emit(self.value)
            elif kind == "percent" and self.value is not None:
                self.emit(f"{self.value}%")
            elif kind == "per" and self.value is not None and after == "cent":
                self.emit(f"{self.value}%")
                skip = True
            elif kind == "and" and numeric and _kind(before) == "power":
                pass  # "hundred and five"
            elif kind == "times" and _kind(after) in ("one", "zero"):
                self.value = f"{self.value or ''}{str(WORDS[after][1]) * n}"
                skip = True
            elif kind == "point" and numeric:
                if after in _DIGIT_WORDS or _DIGITS.fullmatch(after):
                    self.value = f"{self.value or ''}."
            else:
                self.emit(self.value, word)
        self.emit(self.value)
        return self.out


def numbers_in_digits(text: str) -> str:
    """Number words, money and ordinals in digits; single ones stay words."""
    parts = re.split(r"\band\s+a\s+half\b", text)
    joined = []
    for i, part in enumerate(parts):
        if part.strip():
            joined.append(part)
            if i < len(parts) - 1:
                last = part.split()[-1]
                joined.append("point five" if last in _DIGIT_WORDS or _kind(last) == "power" else "and a half")
    text = " ".join(joined)
    text = re.sub(r"([0-9])([a-z])", r"\1 \2", re.sub(r"([a-z])([0-9])", r"\1 \2", text))
    text = re.sub(r"([0-9])\s+(st|nd|rd|th|s)\b", r"\1\2", text)
    text = " ".join(_Reader().read(text.split()))
    text = re.sub(r"([€£$])([0-9]+) (?:and )?¢([0-9]{1,2})\b", lambda m: f"{m[1]}{m[2]}.{int(m[3]):02d}", text)
    text = re.sub(r"[€£$]0\.([0-9]{1,2})\b", lambda m: f"¢{int(m[1])}", text)
    return re.sub(r"\b1(s?)\b", r"one\1", text)


def read_spellings(path: str) -> dict[str, str]:
    """A map of spellings from a JSON file of strings by strings."""
    with open(path, "rb") as f:
        return string_values(parse_json(f.read()))


def string_values(data: object) -> dict[str, str]:
    if not isinstance(data, dict) or not all(isinstance(v, str) for v in data.values()):
        raise TokenizerError("invalidConfiguration", "spellings are a map of strings by strings")
    return dict(data)


def english_normalize(text: str, spellings: dict[str, str] | None = None) -> str:
    """The normal form of an English transcript; spellings maps words to those that they count as."""
    text = without_brackets(text.lower())
    text = re.sub(rf"\b({'|'.join(HESITATIONS)})\b", "", text)
    text = re.sub(r"\s+'", "'", text)
    for pattern, by in _CONTRACTIONS:
        text = pattern.sub(by, text)
    text = re.sub(r"(\d),(\d)", r"\1\2", text)
    text = re.sub(r"\.([^0-9]|$)", r" \1", text)
    text = numbers_in_digits(without_symbols(text, True, ".%$¢€£"))
    text = " ".join((spellings or {}).get(w, w) for w in text.split())
    text = re.sub(r"([^0-9])%", r"\1 ", re.sub(r"[.$¢€£]([^0-9])", r" \1", text))
    return re.sub(r"\s+", " ", text)
