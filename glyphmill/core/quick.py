"""Many texts at once: ids, offsets and decoded texts as Arrow arrays, without a Python object a token.

A pre-tokenizer's cut is made by a pattern of the standard library where a text has only
characters below U+0250, whose classes are spelled out; the strings that it gives repeat far more
often than texts, and each is remembered with its packed ids (and local offsets).
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

import numpy as np
import pyarrow as pa
import regex

if TYPE_CHECKING:
    from .tokenizer import Tokenizer

#: Patterns are narrowed to the characters below this one.
TOP = 0x250
WIDE = re.compile(f"[^\\x00-\\u{TOP - 1:04x}]").search
LONGEST = 256  # of the strings that are remembered
MEMO = 1 << 17  # of them, in each of two generations
MARK = -7  # an id that no tokenizer has


def _spelled(name: str) -> str:
    """A class by its ranges below TOP, for use inside brackets."""
    one = regex.compile(name)
    members = [c for c in range(TOP) if one.fullmatch(chr(c))]
    out, i = [], 0
    while i < len(members):
        j = i
        while j + 1 < len(members) and members[j + 1] == members[j] + 1:
            j += 1
        out.append(f"\\u{members[i]:04x}-\\u{members[j]:04x}")
        i = j + 1
    return "".join(out)


@functools.cache
def narrowed(pattern: str) -> re.Pattern | None:
    """The same pattern for texts below TOP; None where it says what the standard library can't."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            m = re.match(r"\\[pP]\{[^}]*\}|\\[sSdDwW]", pattern[i:])
            if m is None and pattern[i + 1] in "XRhHvNLlmMKGbBAZz0123456789":
                return None
            if m is None:
                out.append(pattern[i : i + 2])
                i += 2
                continue
            ranges = _spelled(m.group())
            if not ranges and not inside:
                return None
            out.append(ranges if inside else f"[{ranges}]")
            i += m.end()
            continue
        if c == "[" and inside or c in "&-~|" and inside and pattern[i : i + 2] == 2 * c:
            return None
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    try:
        made = re.compile("".join(out), re.MULTILINE)  # as all configured patterns are
    except re.error:
        return None
    return None if made.groups else made


def finder(pattern: regex.Pattern) -> Callable[[str], list[str]]:
    """The matches of a pattern in a text, as strings."""
    quick = narrowed(pattern.pattern) if not pattern.groups and pattern.flags & ~(regex.UNICODE | regex.V0 | regex.V1 | regex.MULTILINE) == 0 else None
    if quick is None:
        return (lambda text: [m.group() for m in pattern.finditer(text)]) if pattern.groups else pattern.findall
    fast, slow = quick.findall, pattern.findall
    return lambda text: slow(text) if WIDE(text) else fast(text)


class Memo(dict):
    """Values by string, made where they are missing; what two turns have not asked for is forgotten."""

    def __init__(self, make: Callable[[str], Any]) -> None:
        self.make = make
        self.old: dict[str, Any] = {}

    def __missing__(self, raw: str) -> Any:
        value = self.old.get(raw)
        if value is None:
            value = self.make(raw)
        if len(raw) <= LONGEST:
            self[raw] = value
        return value

    def turn(self) -> None:
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()


@functools.cache
def _white() -> np.ndarray:
    from .text import WHITE_SPACE

    out = np.zeros(0x3002, bool)
    out[list(map(ord, WHITE_SPACE))] = True
    return out


def not_white(text: str) -> np.ndarray:
    """Where the scalars stand that are no white space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.flatnonzero(~_white()[np.minimum(codes, 0x3001)])


def byte_places(text: str) -> np.ndarray:
    """The place in UTF-8 of each scalar, and the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])


def lists(parts: list[bytes | None], kind: str = "<i4") -> tuple[pa.Array, np.ndarray]:
    """Offsets (null where a part is None) and values of a list array from packed numbers."""
    size = np.dtype(kind).itemsize
    ends = np.cumsum([0, *(len(p) // size if p is not None else 0 for p in parts)], dtype=np.int32)
    mask = np.array([p is None for p in parts] + [False])
    return pa.array(ends, pa.int32(), mask=mask if mask.any() else None), np.frombuffer(b"".join(p for p in parts if p is not None), kind)


class Batch:
    """A tokenizer over columns of texts."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.memo = Memo(self._make)
        self.spans = Memo(self._make_spans)
        self.contents = list(tokenizer.splitter.tokens)

    def _make(self, raw: str) -> bytes:
        t = self.tokenizer
        return array("i", [i for p in t.quick[1](raw) if p.text for i in t.model.ids(t._model_text(p)[0])]).tobytes()

    def _has_added(self, text: str) -> bool:
        if len(self.contents) > 16:
            return bool(self.tokenizer.splitter.pattern.search(text))
        return any(c in text for c in self.contents)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers, without those of the post-processor."""
        t = self.tokenizer
        if t.quick is None or self._has_added(text):
            return array("i", t._ids(text)).tobytes()
        section = t.normalizer.apply(text, None, 0)[0]
        if not section:
            return b""
        out = b"".join(map(self.memo.__getitem__, t.quick[0](section, True)))
        self.memo.turn()
        return self._fused(out) if t.fuses else out

    def _fused(self, data: bytes) -> bytes:
        ids = np.frombuffer(data, "<i4")
        unk = self.tokenizer.model.unk_id
        if unk is None or len(ids) < 2:
            return data
        return ids[np.concatenate([[True], (ids[1:] != unk) | (ids[:-1] != unk)])].tobytes()

    def frame(self, add_special_tokens: bool) -> tuple[list[int], list[int]] | None:
        """The ids that the post-processor puts before and after those of a text; None where it does more."""
        from .postprocess import Strings

        if isinstance(self.tokenizer.post, Strings):
            return None
        made = self.tokenizer.post.ids([MARK], add_special_tokens)
        if made.count(MARK) != 1 or self.tokenizer.post.ids([], add_special_tokens) != [i for i in made if i != MARK]:
            return None
        at = made.index(MARK)
        return made[:at], made[at + 1 :]

    def encode(self, texts: pa.Array, add_special_tokens: bool, limit: int | None, side: str) -> pa.Array:
        """Lists of ids; limit: of those of the text itself."""
        frame = self.frame(add_special_tokens)
        parts: list[bytes | None] = []
        for text in texts.to_pylist():
            if text is None:
                parts.append(None)
                continue
            data = self.packed(text)
            if limit is not None and len(data) > 4 * limit:
                data = data[: 4 * limit] if side == "right" else data[len(data) - 4 * limit :]
            if frame is None:
                data = array("i", self.tokenizer.post.ids(np.frombuffer(data, "<i4").tolist(), add_special_tokens)).tobytes()
            elif frame[0] or frame[1]:
                data = array("i", frame[0]).tobytes() + data + array("i", frame[1]).tobytes()
            parts.append(data)
        offsets, values = lists(parts)
        return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))

    def bare(self, texts: pa.Array) -> pa.Array:
        """Lists of the ids of the texts themselves, without what a post-processor does."""
        offsets, values = lists([None if t is None else self.packed(t) for t in texts.to_pylist()])
        return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))

    @functools.cached_property
    def _spellings(self) -> pa.Array:
        t = self.tokenizer
        return pa.array([t.id_to_token(i) or "" for i in range(max(t.model.vocabulary.tokens, default=-1) + 1)], pa.string())

    def tokenize(self, texts: pa.Array) -> pa.Array:
        offsets, values = lists([None if t is None else self.packed(t) for t in texts.to_pylist()])
        return pa.ListArray.from_arrays(offsets, self._spellings.take(pa.array(values, pa.int32())))

    # --- offsets ---

    @functools.cached_property
    def plain_spans(self) -> bool:
        """Whether offsets follow from those of the strings that a text is cut into."""
        from .postprocess import Sequence

        t = self.tokenizer
        plain_post = t.post.trims is None and not isinstance(t.post, Sequence) and self.frame(True) is not None
        return t.quick is not None and not t.has_normalizer and t.pre_tokenizer.cuts_in_place and plain_post

    def _make_spans(self, raw: str) -> tuple[bytes, bytes, bytes]:
        """Ids, starts and ends (in bytes) of the tokens of a string."""
        t = self.tokenizer
        from .pretokenizers import Piece
        from .text import byte_spans

        ids, starts, ends = array("i"), array("i"), array("i")
        for p in t.pre_tokenizer.split(Piece(raw, byte_spans(raw), False)):
            body, spans = t._model_text(p)
            for i, a, b in t.model.encode(body):
                ids.append(i)
                starts.append(spans[a][0] if b > a else -1)
                ends.append(spans[b - 1][1] if b > a else -1)
        return ids.tobytes(), starts.tobytes(), ends.tobytes()

    def spanned(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids, starts and ends of a text without special tokens; None where it must go the long way."""
        t = self.tokenizer
        if not self.plain_spans or self._has_added(text):
            return None
        pieces, first = t.pre_tokenizer.placed(text)
        found = list(map(self.spans.__getitem__, pieces))
        self.spans.turn()
        ids, starts, ends = (np.frombuffer(b"".join(f), "<i4") for f in zip(*found, strict=True)) if found else [np.zeros(0, "<i4")] * 3
        if not text.isascii():
            first = byte_places(text)[first]
        base = np.repeat(first, [len(f[0]) // 4 for f in found])
        if (starts < 0).any():
            return None
        starts, ends = starts + base, ends + base
        if t.fuses and len(ids) > 1 and (unk := t.model.unk_id) is not None:
            keep = np.concatenate([[True], (ids[1:] != unk) | (ids[:-1] != unk)])
            ids, starts, ends = ids[keep], starts[keep], ends[keep]
        return ids, starts, ends

    def encode_with_offsets(self, texts: pa.Array, add_special_tokens: bool) -> pa.Array:
        """Structs of ids, offsets and type_ids (null)."""
        front, back = self.frame(add_special_tokens) or ([], [])
        parts: list[list[np.ndarray | bytes | None]] = [[], [], [], []]  # ids, starts, ends, whether there is an offset
        for text in texts.to_pylist():
            if text is None:
                for p in parts:
                    p.append(None)
                continue
            made = self.spanned(text)
            if made is None:
                e = self.tokenizer.encode_with_offsets(text, add_special_tokens)
                columns = [e.ids, [o[0] if o else 0 for o in e.offsets], [o[1] if o else 0 for o in e.offsets], [o is not None for o in e.offsets]]
            else:
                there = np.ones(len(made[0]), np.int32)
                columns = [*made, there]
                if front or back:
                    columns = [np.concatenate([front, made[0], back]), *(np.pad(x, (len(front), len(back))) for x in (made[1], made[2], there))]
            for p, c in zip(parts, columns, strict=True):
                p.append(np.asarray(c).astype("<i4").tobytes())
        offsets, ids = lists(parts[0])
        starts, ends, there = (lists(p)[1] for p in parts[1:])
        spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"], mask=pa.array(there == 0))
        n = len(texts)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, spans), pa.nulls(n, pa.list_(pa.int32()))], ["ids", "offsets", "type_ids"], mask=pa.array([t is None for t in texts.to_pylist()], pa.bool_()))

    # --- decoding ---

    @functools.cached_property
    def _bytes(self) -> list[bytes] | None:
        """What each id adds, where a text is just that in order."""
        from .decoders import ByteLevel
        from .text import from_alphabet

        t = self.tokenizer
        if type(t.decoder) is not ByteLevel or t.cleans:
            return None
        return [from_alphabet(s) if (s := t.id_to_token(i)) is not None else b"" for i in range(max(t.model.vocabulary.tokens, default=-1) + 1)]

    @functools.cached_property
    def _bytes_without_specials(self) -> list[bytes]:
        return [b"" if i in self.tokenizer.special_ids else x for i, x in enumerate(self._bytes)]

    def decode(self, ids: pa.Array, skip_special_tokens: bool) -> pa.Array:
        t = self.tokenizer
        table = None if self._bytes is None else self._bytes_without_specials if skip_special_tokens else self._bytes
        out: list[str | None] = []
        for row in ids:
            if not row.is_valid:
                out.append(None)
                continue
            numbers = row.values.to_numpy(zero_copy_only=False)
            if table is None or len(numbers) and not (numbers.min() >= 0 and numbers.max() < len(table)):
                out.append(t.decode([int(i) for i in numbers.tolist()], skip_special_tokens))
            else:
                out.append(b"".join(map(table.__getitem__, numbers.tolist())).decode("utf-8", "replace"))
        return pa.array(out, pa.string())
