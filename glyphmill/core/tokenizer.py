"""The compiled tokenizer: built and checked on the driver, shipped to the executors."""

from __future__ import annotations

import functools
import hashlib
import pickle
from dataclasses import dataclass
from typing import Any

import regex

from . import models
from .added import Splitter, added_tokens
from .config import boolean, flag, token_text
from .decoders import clean_up, decoder
from .errors import TokenizerError
from .models import BPE, Unigram
from .normalizers import Metaspace as MetaspaceNormalizer
from .normalizers import normalizer
from .postprocess import Aligned, Strings, budget, post_processor, truncated
from .pretokenizers import ByteLevel, Piece, pre_tokenizer
from .quick import Batch
from .text import Spans, byte_spans, to_alphabet

SPECIALS = ("bos", "eos", "unk", "sep", "pad", "cls", "mask")
#: Special tokens of classes that their configuration may leave out.
ROBERTA = {"bos_token": "<s>", "eos_token": "</s>", "unk_token": "<unk>", "sep_token": "</s>", "pad_token": "<pad>", "cls_token": "<s>", "mask_token": "<mask>"}
GPT2 = {"bos_token": "<|endoftext|>", "eos_token": "<|endoftext|>", "unk_token": "<|endoftext|>"}
CLASS_DEFAULTS = {"RobertaTokenizer": ROBERTA, "XLMRobertaTokenizer": ROBERTA, "GPT2Tokenizer": GPT2}
#: Classes that build their post-processor from add_bos_token and add_eos_token.
LLAMA_CLASSES = ("LlamaTokenizer", "CodeLlamaTokenizer", "GemmaTokenizer")


MEMO = 1 << 17  # strings with their ids that a worker remembers


@dataclass(frozen=True)
class Encoding:
    """ids, and where asked for the source ranges in bytes (None for inserted tokens) and the type ids."""

    ids: list[int]
    offsets: list[tuple[int, int] | None] | None = None
    text: str = ""
    text_pair: str | None = None
    type_ids: list[int] | None = None

    def __post_init__(self) -> None:
        for name in ("offsets", "type_ids"):
            if (value := getattr(self, name)) is not None and len(value) != len(self.ids):
                raise TokenizerError("invalidConfiguration", f"{name} don't go with ids")
        if self.offsets:
            bounds = {0}
            at = 0
            for c in self.text:
                at += len(c.encode())
                bounds.add(at)
            for span in self.offsets:
                if span is not None and (span[0] > span[1] or not bounds.issuperset(span)):
                    raise TokenizerError("invalidConfiguration", "an offset is inside a scalar")

    def utf16_ranges(self, whole_graphemes: bool = False) -> list[tuple[int, int] | None]:
        """The source ranges in UTF-16 units; widened to whole grapheme clusters if asked for."""
        units, at, n = {0: 0}, 0, 0
        for c in self.text:
            at, n = at + len(c.encode()), n + (2 if c > "￿" else 1)
            units[at] = n
        clusters, at = [], 0
        for g in regex.findall(r"\X", self.text) if whole_graphemes else ():
            size = len(g.encode("utf-16-le")) // 2
            clusters.append((at, at + size))
            at += size
        out: list[tuple[int, int] | None] = []
        for span in self.offsets or []:
            if span is None:
                out.append(None)
                continue
            a, b = units[span[0]], units[span[1]]
            if a < b:
                a = max((x for x, _ in clusters if x <= a), default=a)
                b = min((y for _, y in clusters if y >= b), default=b)
            out.append((a, b))
        return out


#: The last tokenizers that reached this worker, which remember what they have encoded from one job to the next.
_REVIVED: dict[str, Tokenizer] = {}
REVIVED = 4


def _revived(digest: str, data: dict, config: dict) -> Tokenizer:
    made = _REVIVED.pop(digest, None) or Tokenizer(data, config, False)
    _REVIVED[digest] = made
    if len(_REVIVED) > REVIVED:
        del _REVIVED[next(iter(_REVIVED))]
    return made


class Tokenizer:
    """encode, decode and their kin for one text; the column functions in glyphmill.functions apply them to tables."""

    def __init__(self, data: dict, config: dict | None = None, strict: bool = True) -> None:
        config = dict(config or {})
        name = str(config.get("tokenizer_class") or "").removesuffix("Fast")
        for key, value in CLASS_DEFAULTS.get(name, {}).items():
            config.setdefault(key, value)  # an explicit null stays
        self.config = config
        self.normalizer = normalizer(data.get("normalizer"))
        self.has_normalizer = data.get("normalizer") is not None
        tokens = added_tokens(data, config)
        self.model = models.model(data, {t.content: t.id for t in tokens}, config, strict)
        plain, late, self.spellings = [], [], {}
        for t in tokens:
            match = self.normalizer(t.content) if t.normalized and self.has_normalizer else t.content
            (late if t.normalized and self.has_normalizer else plain).append((match, t))
            if match != t.content and name not in LLAMA_CLASSES:
                self.spellings[t.id] = match
        self.splitter, self.late_splitter = Splitter(plain), Splitter(late)
        self.special_ids = frozenset(t.id for t in tokens if t.special)
        self.pre_tokenizer = pre_tokenizer(data.get("pre_tokenizer"))
        if self.model.byte_level and not isinstance(self.model, BPE):
            raise TokenizerError("unsupportedComponent", "byte_level is for BPE")
        post = data.get("post_processor")
        self.post = post_processor(self._llama(config, post) if name in LLAMA_CLASSES else post)
        self.post.bind(self.model.token_to_id if self.model.unk_token is None else self._known)
        if isinstance(self.post, Strings):
            self.post.bind_strings(self.model.vocabulary.ids.get, self.id_to_token)
        self.decoder = decoder(data.get("decoder"))
        self.fuses = self.model.fuses and not isinstance(self.model, BPE | Unigram)
        cleans = flag(config, "clean_up_tokenization_spaces", False)
        if isinstance(self.model, BPE):
            forced = boolean(config.get("clean_up_tokenization_spaces_for_bpe_even_though_it_will_corrupt_output"))
            cleans = cleans and (forced if forced is not None else name in ("LukeTokenizer", "MLukeTokenizer"))
        self.cleans = cleans
        self.quick = None if self.late_splitter.tokens else self.pre_tokenizer.quick()
        self.memo: dict[str, tuple[int, ...]] = {}
        self.data = data
        self.batch = Batch(self)

    def __reduce__(self):
        return _revived, (self.digest, self.data, self.config)

    @functools.cached_property
    def digest(self) -> str:
        return hashlib.sha256(pickle.dumps((self.data, self.config))).hexdigest()

    def _known(self, token: str) -> int | None:
        return self.model.token_to_id(token)

    def _llama(self, config: dict, post: dict | None) -> dict | None:
        """The template of the classes that add a beginning (by default) and an end (by request)."""
        bos, eos = (token_text(config.get(f"{k}_token")) for k in ("bos", "eos"))
        front = flag(config, "add_bos_token", True) and bos
        back = flag(config, "add_eos_token", False) and eos
        if flag(config, "add_bos_token", True) and not bos or flag(config, "add_eos_token", False) and not eos:
            if post is not None:
                return post
        one = lambda t, k: [{"SpecialToken": {"id": t, "type_id": k}}] if t else []
        part = lambda s, k: [*one(front, k), {"Sequence": {"id": s, "type_id": k}}, *one(back, k)]
        return {"type": "TemplateProcessing", "single": part("A", 0), "pair": [*part("A", 0), *part("B", 1)], "special_tokens": {}}

    @classmethod
    def from_config(cls, data: dict, config: dict | None = None, strict: bool = True) -> Tokenizer:
        return cls(data, config, strict)

    @classmethod
    def load(cls, folder: str, strict: bool = True) -> Tokenizer:
        from ..sources.folder import read_folder

        return cls(*read_folder(folder), strict)

    # --- properties ---

    def special_token(self, kind: str) -> str | None:
        return token_text(self.config.get(f"{kind}_token"))

    def special_id(self, kind: str) -> int | None:
        token = self.special_token(kind)
        return None if token is None else self.token_to_id(token)

    @property
    def unk_token(self) -> str | None:
        return self.model.unk_token

    @property
    def has_chat_template(self) -> bool:
        return self.config.get("chat_template") is not None

    # --- encoding ---

    def pieces(self, text: str, with_spans: bool = False) -> list[int | list[Piece]]:
        """Ids of added tokens, and the pieces of the sections of text between them."""
        out: list[Any] = []
        spans: Spans = byte_spans(text) if with_spans else None
        at = 0
        for start, end, token in self.splitter.split(text):
            if token is not None:
                out.append((token, spans and ((spans[start][0], spans[end - 1][1]) if end > start else (spans[start][0],) * 2 if start < len(spans) else (spans[-1][1],) * 2)))
                at = end
                continue
            section, own = self.normalizer.apply(text[start:end], spans and spans[start:end], len(text[:start].encode()) if start else 0)
            begins = start == 0
            for a, b, late in self.late_splitter.split(section):
                if late is not None:
                    out.append((late, own and ((own[a][0], own[b - 1][1]) if b > a else None)))
                    continue
                piece = Piece(section[a:b], own and own[a:b], begins and a == 0)
                out.append([p for p in self.pre_tokenizer.split(piece) if p.text])
        return out

    def _tokens(self, text: str) -> list[Aligned]:
        out: list[Aligned] = []
        for part in self.pieces(text, True):
            if isinstance(part, tuple):
                out.append((part[0], part[1], None))
                continue
            first = len(out)
            for p in part:
                body, spans = self._model_text(p)
                for i, a, b in self.model.encode(body):
                    own = body[a:b]
                    span = (spans[a][0], spans[b - 1][1]) if b > a else None
                    if span and own and not isinstance(self.model, BPE):
                        own = None
                    out.append((i, span, own if isinstance(self.model, BPE) and i == self.model.vocabulary.ids.get(own) else None))
            if self.fuses:
                out[first:] = [t for k, t in enumerate(out[first:]) if t[0] != self.model.unk_id or not k or out[first + k - 1][0] != self.model.unk_id]
        return out

    def _model_text(self, piece: Piece) -> tuple[str, Spans]:
        if self.model.byte_level and not piece.byte_level:
            wide = None if piece.spans is None else [s for c, s in zip(piece.text, piece.spans, strict=True) for _ in c.encode()]
            return to_alphabet(piece.text), wide
        return piece.text, piece.spans

    def _quick_ids(self, text: str) -> list[int]:
        """Ids of a text by the strings that its sections are cut into, each of which is remembered with its ids."""
        cut, rest = self.quick
        memo, out = self.memo, []
        for start, end, token in self.splitter.split(text) if self.splitter.pattern else ((0, len(text), None),):
            if token is not None:
                out.append(token)
                continue
            section = text if end - start == len(text) else text[start:end]
            section = self.normalizer.apply(section, None, 0 if start == 0 else 1)[0]
            first = len(out)
            for raw in cut(section, start == 0) if section else ():
                ids = memo.get(raw)
                if ids is None:
                    ids = tuple(i for p in rest(raw) if p.text for i in self.model.ids(self._model_text(p)[0]))
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[raw] = ids
                out += ids
            if self.fuses:
                unk = self.model.unk_id
                out[first:] = [i for k, i in enumerate(out[first:]) if i != unk or not k or out[first + k - 1] != unk]
        return out

    def _ids(self, text: str) -> list[int]:
        if self.quick is not None:
            return self._quick_ids(text)
        out: list[int] = []
        for part in self.pieces(text):
            if isinstance(part, tuple):
                out.append(part[0])
                continue
            first = len(out)
            for p in part:
                out += self.model.ids(self._model_text(p)[0])
            if self.fuses:
                unk = self.model.unk_id
                out[first:] = [i for k, i in enumerate(out[first:]) if i != unk or not k or out[first + k - 1] != unk]
        return out

    def tokenize(self, text: str) -> list[str]:
        """Token strings, without special tokens of the post-processor."""
        return [t if (t := self.id_to_token(i)) is not None else "" for i in self._ids(text)]

    def encode(self, text: str, add_special_tokens: bool = True, max_length: int | None = None, side: str = "right") -> list[int]:
        ids = self._ids(text)
        if max_length is not None:
            ids = truncated(ids, budget(self.post, max_length, add_special_tokens), side)
        return self.post.ids(ids, add_special_tokens)

    def encode_with_offsets(self, text: str, add_special_tokens: bool = True, max_length: int | None = None, side: str = "right") -> Encoding:
        tokens = self._tokens(text)
        if max_length is not None:
            tokens = truncated(tokens, budget(self.post, max_length, add_special_tokens), side)
        tokens = self.post.aligned(tokens, text, add_special_tokens, self.id_to_token)
        return Encoding([t[0] for t in tokens], [t[1] for t in tokens], text)

    def encode_pair(self, text: str, pair: str, add_special_tokens: bool = True) -> Encoding:
        ids, types = self.post.pair_ids(self._ids(text), self._ids(pair), add_special_tokens)
        return Encoding(ids, None, text, pair, types)

    # --- decoding ---

    def token_to_id(self, token: str) -> int | None:
        return self.model.token_to_id(token)

    def id_to_token(self, i: int) -> str | None:
        return self.spellings.get(i, self.model.id_to_token(i))

    def decode(self, ids: list[int], skip_special_tokens: bool = False) -> str:
        tokens = [t for i in ids if not (skip_special_tokens and i in self.special_ids) and (t := self.id_to_token(i)) is not None]
        text = " ".join(tokens) if self.decoder is None else self.decoder.text(tokens)
        return clean_up(text) if self.cleans else text


__all__ = ["ByteLevel", "Encoding", "MetaspaceNormalizer", "Tokenizer"]
