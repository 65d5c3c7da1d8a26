"""Streaming decode: text out of tokens as they come, never more than what no later token can change."""

from __future__ import annotations

import re

from . import decoders as D
from .decoders import CLEANUP, WORD_CLEANUP, clean_up
from .errors import TokenizerError
from .text import from_alphabet
from .tokenizer import Tokenizer

_BYTE = re.compile("<0x[0-9A-Fa-f]{2}>")


def complete_utf8(data: bytes) -> int:
    """How much of data can be decoded now: all but a last sequence that may still be completed."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if lead & 0xC0 == 0x80:
            continue
        need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
        if need > back:
            rest = data[len(data) - back :]
            try:  # a sequence that is already wrong is not held
                rest.decode()
            except UnicodeDecodeError as e:
                return len(data) - back if e.reason == "unexpected end of data" else len(data)
        return len(data)
    return len(data)


class _Cleaner:
    """The clean-up of spaced punctuation, held back at the end while a rule may still match."""

    def __init__(self, rules: tuple[tuple[str, str], ...]) -> None:
        self.rules, self.held = rules, ""
        self.reach = sum(len(a) for a, _ in rules)

    def add(self, text: str) -> str:
        self.held += text
        limit = len(self.held) - self.reach
        # rules begin with a space, and hold another one only after an apostrophe or in " do not"
        cut = self.held.rfind(" ", 0, max(0, limit))
        while cut > 0 and (self.held[max(0, cut - 2) : cut] == " '" or self.held[max(0, cut - 3) : cut] == " do" or self.held[cut - 1] == " "):
            cut = self.held.rfind(" ", 0, cut)
        if cut <= 0:
            return ""
        done, self.held = self.held[:cut], self.held[cut:]
        return clean_up(done, self.rules)

    def end(self) -> str:
        done, self.held = self.held, ""
        return clean_up(done, self.rules)


class TokenStreamDecoder:
    """append(id) gives the text that has become certain, finish() the rest; together they are decode() of all ids."""

    def __init__(self, tokenizer: Tokenizer, skip_special_tokens: bool = False) -> None:
        self.tokenizer, self.skip = tokenizer, skip_special_tokens
        self.mode = self._mode()
        self.reset()

    def _mode(self) -> str:
        decoder = self.tokenizer.decoder
        if decoder is None:
            return "joined"
        if isinstance(decoder, D.ByteLevel):
            return "bytes"
        if isinstance(decoder, D.WordPiece | D.Metaspace | D.Replace):
            return "tokens"
        if isinstance(decoder, D.Sequence) and self._fallback_parts(decoder):
            return "fallback"
        return "buffered"

    @staticmethod
    def _fallback_parts(decoder: D.Sequence) -> bool:
        """Replace, ByteFallback, Fuse, and a Strip of the front alone."""
        kinds = [type(p) for p in decoder.parts]
        strip = decoder.parts[-1]
        return kinds[:3] == [D.Replace, D.ByteFallback, D.Fuse] and (len(kinds) == 3 or len(kinds) == 4 and isinstance(strip, D.Strip) and strip.stop == 0)

    @property
    def is_incremental(self) -> bool:
        return self.mode != "buffered"

    @property
    def held(self) -> bool:
        """Whether text waits for later tokens."""
        return bool(self.pending or self.run or self.buffer or (self.cleaner and self.cleaner.held))

    def reset(self) -> None:
        self.pending, self.run, self.buffer, self.front = b"", [], [], ""
        self.first, self.finished = True, False
        self.cleaner = _Cleaner(CLEANUP) if self.tokenizer.cleans else None

    def append(self, token: int) -> str:
        if self.finished:
            raise TokenizerError("invalidConfiguration", "the stream has finished")
        if self.skip and token in self.tokenizer.special_ids:
            return ""
        word = self.tokenizer.id_to_token(token)
        if word is None:
            return ""
        if self.mode == "buffered":
            self.buffer.append(token)
            return ""
        out = getattr(self, f"_{self.mode}")(word)
        return self.cleaner.add(out) if self.cleaner else out

    def _joined(self, word: str) -> str:
        first, self.first = self.first, False
        return word if first else " " + word

    def _bytes(self, word: str) -> str:
        data = self.pending + from_alphabet(word)
        n = complete_utf8(data)
        self.pending = data[n:]
        return data[:n].decode("utf-8", "replace")

    def _tokens(self, word: str) -> str:
        decoder, first = self.tokenizer.decoder, self.first
        self.first = False
        return decoder.decode([word])[0] if first else decoder.decode(["", word])[1]

    def _fallback(self, word: str) -> str:
        parts = self.tokenizer.decoder.parts
        (word,) = parts[0].decode([word])
        if _BYTE.fullmatch(word):
            self.run.append(word)  # a run of bytes is valid or not as a whole
            return ""
        out = "".join(parts[1].decode(self.run)) + word
        self.run = []
        return self._stripped(out)

    def _stripped(self, text: str, last: bool = False) -> str:
        """The front strip, which looks at the first copies of its scalar only."""
        strip = self.tokenizer.decoder.parts[-1]
        if not self.first or not isinstance(strip, D.Strip):
            return text
        self.front += text
        if len(self.front) <= strip.start and not self.front.strip(strip.content) and not last:
            return ""
        self.first, text, self.front = False, self.front, ""
        return strip.decode([text])[0]

    def finish(self) -> str:
        if self.finished:
            raise TokenizerError("invalidConfiguration", "the stream has finished")
        self.finished = True
        if self.mode == "buffered":
            ids, self.buffer = self.buffer, []
            return self.tokenizer.decode(ids)
        out = ""
        if self.mode == "bytes":
            out, self.pending = self.pending.decode("utf-8", "replace"), b""
        elif self.mode == "fallback":
            run, self.run = self.run, []
            out = self._stripped("".join(self.tokenizer.decoder.parts[1].decode(run)), True)
        return self.cleaner.add(out) + self.cleaner.end() if self.cleaner else out

    # state of a stream between batches

    def snapshot(self) -> tuple:
        return self.pending, list(self.run), list(self.buffer), self.front, self.first, self.finished, self.cleaner.held if self.cleaner else ""

    def restore(self, state: tuple) -> None:
        self.pending, run, buffer, self.front, self.first, self.finished, held = state
        self.run, self.buffer = list(run), list(buffer)
        if self.cleaner:
            self.cleaner.held = held


__all__ = ["TokenStreamDecoder", "WORD_CLEANUP", "complete_utf8"]
