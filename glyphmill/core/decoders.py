"""Decoders: token strings into text.  Each maps a list of strings to one; column() does the same natively."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column, functions as F

from .config import boolean, flag, required
from .errors import TokenizerError
from .normalizers import Replace as ReplaceNormalizer
from .text import CHAR_TO_BYTE, MOVED, MOVED_TO, from_alphabet

#: Artifacts of spaced tokens, in the order in which they go.
CLEANUP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))
WORD_CLEANUP = (*CLEANUP[:7], (" do not", " don't"), *CLEANUP[7:])


def clean_up(text: str, rules: tuple[tuple[str, str], ...] = CLEANUP) -> str:
    for a, b in rules:
        text = text.replace(a, b)
    return text


def clean_up_column(c: Column, rules: tuple[tuple[str, str], ...] = CLEANUP) -> Column:
    for a, b in rules:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


class Decoder:
    native = True

    def __init__(self, config: dict) -> None:
        self.config = config

    def decode(self, tokens: list[str]) -> list[str]:
        raise NotImplementedError

    def column(self, tokens: Column) -> Column:
        raise TokenizerError("unsupportedComponent", f"{self.config.get('type')} has no native form")

    def text(self, tokens: list[str]) -> str:
        return "".join(self.decode(tokens))


class Sequence(Decoder):
    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.parts = [decoder(x) for x in required(config, "decoders", list)]
        self.native = all(p.native for p in self.parts)

    def decode(self, tokens: list[str]) -> list[str]:
        for part in self.parts:
            tokens = part.decode(tokens)
        return tokens

    def column(self, tokens: Column) -> Column:
        for part in self.parts:
            tokens = part.column(tokens)
        return tokens


class ByteLevel(Decoder):
    def decode(self, tokens: list[str]) -> list[str]:
        return [b"".join(map(from_alphabet, tokens)).decode("utf-8", "replace")]

    def column(self, tokens: Column) -> Column:
        alphabet = "".join(f"\\x{{{ord(c):X}}}" for c in CHAR_TO_BYTE)

        def data(t: Column) -> Column:
            return F.when(t.rlike(f"^[{alphabet}]*$"), F.hex(F.encode(F.translate(t, MOVED_TO, MOVED), "ISO-8859-1"))).otherwise(F.hex(F.encode(t, "UTF-8")))

        # where all tokens are in the alphabet they go back in one string
        whole = F.array_join(tokens, "")
        plain = F.encode(F.translate(whole, MOVED_TO, MOVED), "ISO-8859-1")
        mixed = F.unhex(F.array_join(F.transform(tokens, data), ""))
        return F.array(F.make_valid_utf8(F.when(whole.rlike(f"^[{alphabet}]*$"), plain).otherwise(mixed).cast("string")))


class Replace(Decoder):
    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.inner = ReplaceNormalizer(config)

    def decode(self, tokens: list[str]) -> list[str]:
        return [self.inner(t) for t in tokens]

    def column(self, tokens: Column) -> Column:
        return F.transform(tokens, self.inner.column)


class ByteFallback(Decoder):
    native = False

    def decode(self, tokens: list[str]) -> list[str]:
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            if run:
                try:
                    out.append(run.decode())
                except UnicodeDecodeError:
                    out.extend("�" * len(run))
                run.clear()

        for t in tokens:
            if re.fullmatch("<0x[0-9A-Fa-f]{2}>", t):
                run.append(int(t[3:5], 16))
            else:
                flush()
                out.append(t)
        flush()
        return out


class Fuse(Decoder):
    def decode(self, tokens: list[str]) -> list[str]:
        return ["".join(tokens)]

    def column(self, tokens: Column) -> Column:
        return F.array(F.array_join(tokens, ""))


class Strip(Decoder):
    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.content = required(config, "content", str)[:1]
        self.start, self.stop = required(config, "start", int), required(config, "stop", int)

    def decode(self, tokens: list[str]) -> list[str]:
        c = regex.escape(self.content)
        return [regex.sub(rf"\A(?:{c}){{0,{self.start}}}", "", regex.sub(rf"(?:{c}){{0,{self.stop}}}\Z", "", t, count=1) if self.stop else t) for t in tokens] if c else tokens

    def column(self, tokens: Column) -> Column:
        c = "\\Q" + self.content + "\\E"
        front = lambda t: F.regexp_replace(t, rf"\A(?:{c}){{0,{self.start}}}", "")
        back = lambda t: F.regexp_replace(t, rf"(?:{c}){{1,{self.stop}}}\z", "") if self.stop else t
        return F.transform(tokens, lambda t: front(back(t)))


class Metaspace(Decoder):
    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.by = config["replacement"] if isinstance(config.get("replacement"), str) else "_"
        scheme = config.get("prepend_scheme")
        self.strips = scheme != "never" if isinstance(scheme, str) else bool(boolean(config.get("add_prefix_space"), True))

    def decode(self, tokens: list[str]) -> list[str]:
        return [t.replace(self.by, "" if i == 0 and self.strips else " ") for i, t in enumerate(tokens)]

    def column(self, tokens: Column) -> Column:
        return F.transform(tokens, lambda t, i: F.replace(t, F.lit(self.by), F.when((i == 0) & F.lit(self.strips), "").otherwise(" ")))


class WordPiece(Decoder):
    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.prefix, self.cleans = required(config, "prefix", str), flag(config, "cleanup", False)

    def decode(self, tokens: list[str]) -> list[str]:
        out = [t if i == 0 else t[len(self.prefix) :] if self.prefix and t.startswith(self.prefix) else " " + t for i, t in enumerate(tokens)]
        return [clean_up(t, WORD_CLEANUP) for t in out] if self.cleans else out

    def column(self, tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            new = F.when(i == 0, t).when(F.lit(bool(self.prefix)) & t.startswith(self.prefix), F.substr(t, F.lit(len(self.prefix) + 1))).otherwise(F.concat(F.lit(" "), t))
            return clean_up_column(new, WORD_CLEANUP) if self.cleans else new

        return F.transform(tokens, one)


class BPE(Decoder):
    def decode(self, tokens: list[str]) -> list[str]:
        suffix = self.config["suffix"] if isinstance(self.config.get("suffix"), str) else "</w>"
        return [t.replace(suffix, "" if i == len(tokens) - 1 else " ") if suffix else t for i, t in enumerate(tokens)]

    def column(self, tokens: Column) -> Column:
        suffix = self.config["suffix"] if isinstance(self.config.get("suffix"), str) else "</w>"
        return F.transform(tokens, lambda t, i: F.replace(t, F.lit(suffix), F.when(i == F.size(tokens) - 1, "").otherwise(" ")))


class CTC(Decoder):
    def __init__(self, config: dict) -> None:
        super().__init__(config)
        self.pad = config.get("pad_token") or "<pad>"
        self.delimiter = config.get("word_delimiter_token") or "|"
        self.cleans = flag(config, "cleanup", True)

    def decode(self, tokens: list[str]) -> list[str]:
        kept = [t.replace(self.pad, "") for i, t in enumerate(tokens) if not i or t != tokens[i - 1]]
        if self.cleans:
            kept = [clean_up(t, WORD_CLEANUP).replace(self.delimiter, " ") for t in kept]
        return [t for t in kept if t]

    def column(self, tokens: Column) -> Column:
        def one(t: Column) -> Column:
            t = F.replace(t, F.lit(self.pad), F.lit(""))
            return F.replace(clean_up_column(t, WORD_CLEANUP), F.lit(self.delimiter), F.lit(" ")) if self.cleans else t

        return F.filter(F.transform(F.filter(tokens, lambda t, i: (i == 0) | (t != F.get(tokens, i - 1))), one), lambda t: t != "")


KINDS = {
    "Sequence": Sequence, "ByteLevel": ByteLevel, "Replace": Replace, "ByteFallback": ByteFallback, "Fuse": Fuse, "Strip": Strip, "Metaspace": Metaspace, "WordPiece": WordPiece, "BPEDecoder": BPE, "CTC": CTC,
}


def decoder(config: dict | None) -> Decoder | None:
    if config is None:
        return None
    kind = config.get("type")
    if kind not in KINDS:
        raise TokenizerError("unsupportedComponent", f"decoder {kind!r}")
    return KINDS[kind](config)
