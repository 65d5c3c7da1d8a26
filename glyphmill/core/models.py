"""Models: a piece into ids.  All checks are made when a model is built; encoding never fails."""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass, field

from .config import boolean, flag, required, scored_tokens, string_map, string_pairs, token_text
from .errors import TokenizerError
from .text import from_alphabet, to_alphabet

#: A token of a piece: its id and the scalars of the piece that it covers.
Token = tuple[int, int, int]
MAX_IDS = 4 << 20
HEAP_FROM = 96  # symbols from which merging goes by a heap


class Vocabulary:
    """Spellings and ids: model rows first, then added tokens, the last spelling of an id and the last id of a spelling holding."""

    def __init__(self, model: list[tuple[str, int]], added: dict[str, int]) -> None:
        self.model_ids: dict[str, int] = {}
        self.tokens: dict[int, str] = {}
        for token, i in model:
            self.model_ids[token] = i
            self.tokens[i] = token
        for token, i in added.items():
            self.tokens[i] = token
        self.ids = {**self.model_ids, **added}
        top = max(self.tokens, default=-1) + 1
        if top > MAX_IDS or top > max(1 << 18, 64 * len(self.tokens)):
            raise TokenizerError("invalidConfiguration", "ids are too sparse")
        # an id that an added token took over no longer belongs to its model row
        self.model_ids = {t: i for t, i in self.model_ids.items() if self.tokens[i] == t}


@dataclass
class Model:
    vocabulary: Vocabulary
    unk_token: str | None = None
    fuses: bool = False  # runs of unknown tokens become one, outside the model
    byte_level: bool = False

    def encode(self, piece: str) -> list[Token]:
        raise NotImplementedError

    @property
    def unk_id(self) -> int | None:
        return None if self.unk_token is None else self.vocabulary.ids.get(self.unk_token)

    def token_to_id(self, token: str) -> int | None:
        return self.vocabulary.ids.get(token, self.unk_id)

    def id_to_token(self, i: int) -> str | None:
        return self.vocabulary.tokens.get(i)

    def ids(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece, remembered for the pieces that come often."""
        memo = self.__dict__.setdefault("_memo", {})
        out = memo.get(piece)
        if out is None:
            out = tuple(t[0] for t in self.encode(piece))
            if len(piece) <= 64:
                if len(memo) > 1 << 17:
                    memo.clear()
                memo[piece] = out
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}


@dataclass
class WordLevel(Model):
    def encode(self, piece: str) -> list[Token]:
        i = self.vocabulary.model_ids.get(piece, self.unk_id)
        return [] if i is None else [(i, 0, len(piece))]


@dataclass
class WordPiece(Model):
    prefix: str = "##"
    limit: int = 100

    def encode(self, piece: str) -> list[Token]:
        ids, unk, n = self.vocabulary.model_ids, self.unk_id, len(piece)
        if n > self.limit:
            return [] if unk is None else [(unk, 0, n)]
        whole = ids.get(piece)
        if whole is not None:
            return [(whole, 0, n)]
        out: list[Token] = []
        start = 0
        while start < n:
            for end in range(n, start, -1):
                i = ids.get(piece[start:end] if not start else self.prefix + piece[start:end])
                if i is not None:
                    out.append((i, start, end))
                    start = end
                    break
            else:
                return [] if unk is None else [(unk, 0, n)]
        return out


@dataclass
class BPE(Model):
    merges: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)  # (left, right): (rank, merged)
    prefix: str = ""
    suffix: str = ""
    fuse_unk: bool = False
    byte_fallback: bool = False
    ignore_merges: bool = False

    def _symbols(self, piece: str) -> list[list[int]]:
        ids, unk, n = self.vocabulary.model_ids, self.unk_id, len(piece)
        out: list[list[int]] = []
        pending: list[int] | None = None
        for k, c in enumerate(piece):
            name = (self.prefix if k else "") + c + (self.suffix if k == n - 1 else "")
            i = ids.get(name)
            if i is not None:
                if pending:
                    out.append(pending)
                    pending = None
                out.append([i, k, k + 1])
                continue
            if self.byte_fallback:
                parts = [ids.get(f"<0x{b:02X}>") for b in name.encode()]
                if None not in parts:
                    if pending:
                        out.append(pending)
                        pending = None
                    out += [[p, k, k + 1] for p in parts]
                    continue
            if unk is not None:
                if pending and self.fuse_unk:
                    pending[2] = k + 1
                else:
                    if pending:
                        out.append(pending)
                    pending = [unk, k, k + 1]
        return [*out, pending] if pending else out

    def encode(self, piece: str) -> list[Token]:
        if not piece:
            return []
        if self.ignore_merges and (whole := self.vocabulary.model_ids.get(piece)) is not None:
            return [(whole, 0, len(piece))]
        symbols = self._symbols(piece)
        return [tuple(s) for s in (self._heap(symbols) if len(symbols) > HEAP_FROM else self._linear(symbols))]

    def _linear(self, symbols: list[list[int]]) -> list[list[int]]:
        """Merges the pair of lowest rank, the leftmost of equals, until there is none."""
        get, far = self.merges.get, (1 << 62, 0)
        found = [get((a[0], b[0]), far) for a, b in zip(symbols, symbols[1:], strict=False)]
        while found:
            best = min(found)
            if best is far or best[0] == far[0]:
                break
            k = found.index(best)
            symbols[k : k + 2] = [[best[1], symbols[k][1], symbols[k + 1][2]]]
            del found[k]
            if k:
                found[k - 1] = get((symbols[k - 1][0], symbols[k][0]), far)
            if k < len(found):
                found[k] = get((symbols[k][0], symbols[k + 1][0]), far)
        return symbols

    def _heap(self, symbols: list[list[int]]) -> list[list[int]]:
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        gone = [False] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (m := self.merges.get((symbols[a][0], symbols[b][0]))):
                heapq.heappush(heap, (m[0], a, m[1], symbols[a][0], symbols[b][0]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, merged, x, y = heapq.heappop(heap)
            b = right[a]
            if gone[a] or b < 0 or symbols[a][0] != x or symbols[b][0] != y:
                continue
            symbols[a] = [merged, symbols[a][1], symbols[b][2]]
            gone[b], right[a] = True, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s, g in zip(symbols, gone, strict=True) if not g]


@dataclass
class Unigram(Model):
    scores: dict[str, tuple[int, float]] = field(default_factory=dict)  # piece: (id, score), the highest id of equals
    unk_score: float = 0.0
    unk: int = 0
    byte_fallback: bool = False

    @functools.cached_property
    def _prefixes(self) -> set[str]:
        return {p[:i] for p in self.scores for i in range(1, len(p) + 1)}

    def encode(self, piece: str) -> list[Token]:
        n = len(piece)
        if not n:
            return []
        best: list[tuple[float, int, int] | None] = [None] * (n + 1)  # score, start, id of what ends here
        best[0] = (0.0, 0, -1)
        for start in range(n):
            here = best[start]
            if here is None:
                continue
            single = False
            for end in range(start + 1, n + 1):
                part = piece[start:end]
                if part not in self._prefixes:
                    break
                found = self.scores.get(part)
                if found:
                    score = here[0] + found[1]
                    if best[end] is None or score > best[end][0]:
                        best[end] = (score, start, found[0])
                    single |= end == start + 1
            if not single:
                score = here[0] + self.unk_score
                if best[start + 1] is None or score > best[start + 1][0]:
                    best[start + 1] = (score, start, self.unk)
        path: list[Token] = []
        end = n
        while end:
            _, start, i = best[end]
            if i == self.unk and path and path[-1][0] == self.unk:
                path[-1] = (self.unk, start, path[-1][2])  # unknown runs are one
            else:
                path.append((i, start, end))
            end = start
        out: list[Token] = []
        for i, a, b in reversed(path):
            if i == self.unk:
                found = self.scores.get(piece[a:b])
                parts = [self.vocabulary.model_ids.get(f"<0x{x:02X}>") for x in piece[a:b].encode()] if self.byte_fallback and not found else [None]
                if found:
                    out.append((found[0], a, b))
                elif None not in parts:
                    at = a
                    for c in piece[a:b]:
                        for x in c.encode():
                            out.append((self.vocabulary.model_ids[f"<0x{x:02X}>"], at, at + 1))
                        at += 1
                else:
                    out.append((self.unk, a, b))
            else:
                out.append((i, a, b))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_memo", "_prefixes")}


def _unknown(model: dict, vocabulary: Vocabulary, name: str | None) -> str | None:
    if name is not None and name not in vocabulary.model_ids:
        raise TokenizerError("invalidConfiguration", f"unk_token {name!r} is not in the vocabulary")
    return name


def _bpe(model: dict, added: dict[str, int], config: dict) -> BPE:
    ids = string_map(required(model, "vocab"))
    merges = string_pairs(required(model, "merges"))
    dropout = model.get("dropout")
    if dropout is not None:
        if isinstance(dropout, bool) or not isinstance(dropout, int | float) or not 0 <= dropout <= 1:
            raise TokenizerError("invalidConfiguration", "dropout is between 0 and 1")
        if dropout:
            raise TokenizerError("unsupportedComponent", "BPE dropout")
    vocabulary = Vocabulary(list(ids.items()), added)
    prefix = model.get("continuing_subword_prefix") or ""
    table: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, (a, b) in enumerate(merges):
        made = a + b[len(prefix) :] if prefix and b.startswith(prefix) else a + b
        try:
            table[ids[a], ids[b]] = rank, ids[made]
        except KeyError as e:
            raise TokenizerError("invalidConfiguration", f"merge {a!r} {b!r} is outside the vocabulary") from e
    unk = model.get("unk_token")
    return BPE(
        vocabulary, _unknown(model, vocabulary, unk if isinstance(unk, str) else None), False, bool(boolean(model.get("byte_level"), False)), table, prefix, model.get("end_of_word_suffix") or "",
        flag(model, "fuse_unk", False), flag(model, "byte_fallback", False), flag(model, "ignore_merges", False),
    )


def _unigram(model: dict, added: dict[str, int], config: dict) -> Unigram:
    rows = scored_tokens(required(model, "vocab"))
    unk = required(model, "unk_id", int)
    if isinstance(unk, bool) or not 0 <= unk < len(rows):
        raise TokenizerError("invalidConfiguration", "unk_id is outside the vocabulary")
    vocabulary = Vocabulary([(t, i) for i, (t, _) in enumerate(rows)], added)
    scores = {t: (i, s) for i, (t, s) in enumerate(rows) if t}
    return Unigram(vocabulary, rows[unk][0], False, False, scores, min(s for _, s in rows) - 10.0, unk, flag(model, "byte_fallback", False))


def _word_piece(model: dict, added: dict[str, int], config: dict) -> WordPiece:
    vocabulary = Vocabulary(list(string_map(required(model, "vocab")).items()), added)
    limit = model.get("max_input_chars_per_word", 100)
    if not isinstance(limit, int) or limit < 0:
        raise TokenizerError("invalidConfiguration", "max_input_chars_per_word")
    prefix = model.get("continuing_subword_prefix")
    return WordPiece(vocabulary, _unknown(model, vocabulary, model.get("unk_token") or "[UNK]"), flag(model, "fuse_unk", False), False, "##" if prefix is None else prefix, limit)


def _word_level(model: dict, added: dict[str, int], config: dict) -> WordLevel:
    vocabulary = Vocabulary(list(string_map(required(model, "vocab")).items()), added)
    unk = model.get("unk_token") or token_text(config.get("unk_token"))
    if unk is None:
        raise TokenizerError("invalidConfiguration", "WordLevel needs unk_token")
    return WordLevel(vocabulary, _unknown(model, vocabulary, unk))


KINDS = {"BPE": _bpe, "Unigram": _unigram, "WordPiece": _word_piece, "WordLevel": _word_level}
#: The models of known classes (without `Tokenizer` and `Fast`), for files that don't name their model.
CLASS_MODELS = {
    "WordPiece": "Bert DistilBert Distilbert".split(),
    "Unigram": "T5 XLMRoberta Xlm-Roberta".split(),
    "BPE": "CodeGen CodeLlama Cohere Falcon GPT2 Gemma Llama PreTrained Qwen2 Roberta TokenizersBackend Whisper".split(),
}


def model(data: dict, added: dict[str, int], config: dict, strict: bool = True) -> Model:
    """The model of tokenizer data: by its type, else by the class of the tokenizer, else an error, or BPE where strict is off."""
    spec = data.get("model")
    if not isinstance(spec, dict):
        raise TokenizerError("invalidConfiguration", "no model")
    kind = spec.get("type")
    if kind is None:
        name = str(config.get("tokenizer_class") or "").removesuffix("Fast").removesuffix("Tokenizer")
        kind = next((k for k, names in CLASS_MODELS.items() if name in names), None if strict else "BPE")
    if kind not in KINDS:
        raise TokenizerError("unsupportedComponent", f"model {kind!r}")
    return KINDS[kind](spec, added, config)


__all__ = ["BPE", "Model", "Token", "Unigram", "WordLevel", "WordPiece", "from_alphabet", "model", "to_alphabet"]
