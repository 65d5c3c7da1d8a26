"""Post-processors: special tokens around sequences, as plans of items that are applied to arrays.

A plan is a list of items: ("A", type), ("B", type) or (ids, type).  It runs on Python lists, on
tokens with offsets, and as native expressions over array columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .config import flag, required
from .errors import TokenizerError

Item = tuple[str | tuple[int, ...], int]
#: id, source range (None for inserted tokens), spelling before any rewriting (None: that of the id)
Aligned = tuple[int, tuple[int, int] | None, str | None]


class PostProcessor:
    """single and pair are plans; adds says whether special tokens are inserted; trims whether offsets lose spaces."""

    adds = False
    trims: bool | None = None  # with add_prefix_space, where it trims

    def __init__(self, single: list[Item] | None = None, pair: list[Item] | None = None) -> None:
        self.single = [("A", 0)] if single is None else single
        self.pair = [("A", 0), ("B", 1)] if pair is None else pair

    def bind(self, token_to_id: Callable[[str], int | None]) -> None:
        """Resolves special tokens that are given by their spelling only."""

    @staticmethod
    def _run(plan: list[Item], a: list, b: list, special: bool, make: Callable[[int], object]) -> tuple[list, list[int]]:
        out, types = [], []
        for item, kind in plan:
            new = a if item == "A" else b if item == "B" else [make(i) for i in item] if special else []
            out += new
            types += [kind] * len(new)
        return out, types

    def ids(self, ids: list[int], special: bool = True) -> list[int]:
        return self._run(self.single, ids, [], special, int)[0]

    def pair_ids(self, a: list[int], b: list[int], special: bool = True) -> tuple[list[int], list[int]]:
        return self._run(self.pair, a, b, special, int)

    def aligned(self, tokens: list[Aligned], text: str, special: bool, spelling: Callable[[int], str | None]) -> list[Aligned]:
        tokens = trimmed(tokens, text, self.trims, spelling) if self.trims is not None else tokens
        return self._run(self.single, tokens, [], special, lambda i: (i, None, None))[0]

    def column(self, ids: Column, special: bool = True) -> Column:
        return self._column(self.single, ids, None, special)

    def pair_column(self, a: Column, b: Column, special: bool = True) -> tuple[Column, Column]:
        """ids, type ids."""
        parts = [(a if i == "A" else b if i == "B" else F.array(*[F.lit(x) for x in i]), t) for i, t in self.pair if special or isinstance(i, str)]
        return self._column(self.pair, a, b, special), F.concat(*[_filled(p, t) for p, t in parts])

    @staticmethod
    def _column(plan: list[Item], a: Column, b: Column | None, special: bool) -> Column:
        parts = [a if i == "A" else b if i == "B" else F.array(*[F.lit(x) for x in i]) for i, _ in plan if special or isinstance(i, str)]
        return F.concat(*parts) if parts else F.array().cast("array<int>")


def _filled(array: Column, value: int) -> Column:
    return F.transform(array, lambda _: F.lit(value))


def trimmed(tokens: list[Aligned], text: str, prefix_space: bool, spelling: Callable[[int], str | None]) -> list[Aligned]:
    """Offsets without the spaces that a token's spelling begins or ends with, counted in scalars."""
    starts = [0]
    for c in text:
        starts.append(starts[-1] + len(c.encode()))
    place = {b: i for i, b in enumerate(starts)}
    out: list[Aligned] = []
    for n, (i, span, own) in enumerate(tokens):
        word = own if own is not None else spelling(i)
        if span is None or word is None:
            out.append((i, span, own))
            continue
        a, b = place[span[0]], place[span[1]]
        is_space = lambda c: c == "Ġ" or c.isspace() and c not in "\x1c\x1d\x1e\x1f"
        lead = next((k for k, c in enumerate(word) if not is_space(c)), len(word))
        trail = next((k for k, c in enumerate(reversed(word)) if not is_space(c)), len(word))
        if prefix_space and lead == 1 and (n == 0 or a == 0):
            lead = 0
        start = min(a + lead, b)
        out.append((i, (starts[start], starts[max(start, b - trail)]), own))
    return out


class Template(PostProcessor):
    adds = True

    def __init__(self, config: dict) -> None:
        self.specials = {k: v for k, v in (config.get("special_tokens") or {}).items()}
        super().__init__(*[[self._item(x) for x in required(config, k, list)] for k in ("single", "pair")])
        if any(i == "B" for i, _ in self.single):
            raise TokenizerError("invalidConfiguration", "the single template names sequence B")
        self.bind(lambda _: None)

    def _item(self, piece: dict) -> tuple[object, int]:
        bad = TokenizerError("invalidConfiguration", f"template piece {piece!r}")
        if not isinstance(piece, dict):
            raise bad
        if "seq" in piece or "ids" in piece:
            kind = piece.get("type_id", 0)
            if ("seq" in piece) == ("ids" in piece) or not _unsigned(kind):
                raise bad
            if "seq" in piece:
                if piece["seq"] not in ("A", "B"):
                    raise bad
                return piece["seq"], kind
            if not isinstance(piece["ids"], list) or not all(map(_unsigned, piece["ids"])):
                raise bad
            return tuple(piece["ids"]), kind
        if isinstance(name := (piece.get("SpecialToken") or {}).get("id"), str):
            declared = (self.specials.get(name) or {}).get("ids")
            return (tuple(declared) if isinstance(declared, list) else {"token": name}), piece["SpecialToken"].get("type_id") or 0
        sequence = piece.get("Sequence") or {}
        return (sequence["id"] if sequence.get("id") in ("A", "B") else ()), sequence.get("type_id") or 0

    def bind(self, token_to_id: Callable[[str], int | None]) -> None:
        self._open = getattr(self, "_open", None) or (self.single, self.pair)
        resolve = lambda i: i if not isinstance(i, dict) else () if (x := token_to_id(i["token"])) is None else (x,)
        self.single, self.pair = ([(resolve(i), t) for i, t in plan] for plan in self._open)


def _unsigned(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 2**32


def _token_id(config: dict, key: str) -> int:
    value = required(config, key, list)
    if len(value) != 2 or not isinstance(value[1], int):
        raise TokenizerError("invalidConfiguration", f"{key} is a token and its id")
    return value[1]


class Bert(PostProcessor):
    adds = True

    def __init__(self, config: dict) -> None:
        cls, sep = _token_id(config, "cls"), _token_id(config, "sep")
        super().__init__([((cls,), 0), ("A", 0), ((sep,), 0)], [((cls,), 0), ("A", 0), ((sep,), 0), ("B", 1), ((sep,), 1)])


class Roberta(PostProcessor):
    adds = True

    def __init__(self, config: dict) -> None:
        cls, sep = _token_id(config, "cls"), _token_id(config, "sep")
        super().__init__([((cls,), 0), ("A", 0), ((sep,), 0)], [((cls,), 0), ("A", 0), ((sep, sep), 0), ("B", 0), ((sep,), 0)])
        if flag(config, "trim_offsets", flag(config, "trim_offset", True)):
            self.trims = flag(config, "add_prefix_space", True)


class ByteLevel(PostProcessor):
    def __init__(self, config: dict) -> None:
        super().__init__()
        if flag(config, "trim_offsets", True):
            self.trims = flag(config, "add_prefix_space", True)


class Sequence(PostProcessor):
    """A chain.  Single plans nest; of the pair plans exactly one may insert tokens."""

    def __init__(self, config: dict) -> None:
        self.parts = [post_processor(x) for x in required(config, "processors", list)]
        super().__init__()
        self._compose()

    def _compose(self) -> None:
        single: list[Item] = [("A", 0)]
        for part in self.parts:
            single = [x for item, t in part.single for x in (single if item == "A" else [(item, t)])]
        self.single = single
        adding = [p for p in self.parts if p.adds]
        self.pair = adding[0].pair if len(adding) == 1 else None if adding else [("A", 0), ("B", 1)]  # type: ignore[assignment]
        self.adds = bool(adding)

    def bind(self, token_to_id: Callable[[str], int | None]) -> None:
        for part in self.parts:
            part.bind(token_to_id)
        self._compose()

    def pair_ids(self, a: list[int], b: list[int], special: bool = True) -> tuple[list[int], list[int]]:
        if self.pair is None:
            raise TokenizerError("unsupportedComponent", "a pair form of several processors that add tokens")
        return super().pair_ids(a, b, special)

    def aligned(self, tokens: list[Aligned], text: str, special: bool, spelling: Callable[[int], str | None]) -> list[Aligned]:
        for part in self.parts:
            tokens = part.aligned(tokens, text, special, spelling)
        return tokens


class Strings(PostProcessor):
    """A function of token strings in place of a plan: ids go there and back, and strings without an id are dropped.

    For processors that know spellings only: add a subclass with tokens() to KINDS.
    """

    adds = True

    def __init__(self, config: dict | None = None) -> None:
        super().__init__()
        self.config = config or {}
        self.token_to_id: Callable[[str], int | None] = lambda _: None
        self.id_to_token: Callable[[int], str | None] = lambda _: None

    def bind_strings(self, token_to_id: Callable[[str], int | None], id_to_token: Callable[[int], str | None]) -> None:
        self.token_to_id, self.id_to_token = token_to_id, id_to_token

    def tokens(self, a: list[str], b: list[str] | None, special: bool) -> list[str]:
        return [*a, *(b or ())]

    def _there_and_back(self, a: list[int], b: list[int] | None, special: bool) -> list[int]:
        spelled = [[self.id_to_token(i) or "" for i in x] if x is not None else None for x in (a, b)]
        return [i for t in self.tokens(spelled[0], spelled[1], special) if (i := self.token_to_id(t)) is not None]

    def ids(self, ids: list[int], special: bool = True) -> list[int]:
        return self._there_and_back(ids, None, special)

    def pair_ids(self, a: list[int], b: list[int], special: bool = True) -> tuple[list[int], list[int]]:
        out = self._there_and_back(a, b, special)
        return out, [0] * len(out)

    def column(self, ids: Column, special: bool = True) -> Column:
        raise TokenizerError("unsupportedComponent", "a processor of strings has no native form")


KINDS = {"TemplateProcessing": Template, "BertProcessing": Bert, "RobertaProcessing": Roberta, "ByteLevel": ByteLevel, "Sequence": Sequence}


def post_processor(config: dict | None) -> PostProcessor:
    if config is None:
        return PostProcessor()
    kind = config.get("type")
    if kind not in KINDS:
        raise TokenizerError("unsupportedComponent", f"post-processor {kind!r}")
    return KINDS[kind](config)


def budget(post: PostProcessor, max_length: int, special: bool) -> int:
    """Tokens of the sequence itself that fit."""
    overhead = len(post.ids([], special))
    copies = len(post.ids([0], special)) - overhead
    if max_length < 0 or max_length < overhead:
        raise TokenizerError("invalidConfiguration", f"max_length is below the {overhead} special tokens")
    return (max_length - overhead) // copies if copies else 0


def truncated(tokens: list, n: int, side: str = "right") -> list:
    return tokens[:n] if side == "right" else tokens[max(0, len(tokens) - n) :]
