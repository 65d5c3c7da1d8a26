"""Quality rules: base counts, then the divergence of a document from its language.

A document's histogram of character classes and its histogram of common words are compared with
those of its language by the Jensen-Shannon distance (the square root of the divergence in bits,
0 to 1).  The references are those of the whole corpus: the summed histograms of all documents of
a language that pass the base rules, less those of the document that is judged, so that none is
its own witness.  A document of no language, or of one that has too little text besides it, is
compared with the reference that its words are nearest to.  The distance of the characters is judged only where the
document is long enough for its histogram to mean something.  That of the common words is judged
at every length: the fewer words, the more of it is chance, by about a constant over their number
in the square, and the limit widens by that.  Under some 40 words junk lies no farther from its
language than prose does, so there hardly anything is rejected by it.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ASCII_SPACE, dealt_table, map_batches, words_of, written

#: The characters that count as symbols in the base rules.
SYMBOLS = "#*$%&|<>"

#: Common function words of languages, one group a language.
COMMON_WORDS = """
the of and to in is that for it was on are as with be by this from at or an not have which
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es wird
de la le et les des en un une du dans est que qui pour au par sur pas plus avec il elle
que los las del por con una para se al lo como más su sus pero le ya este entre cuando
di il che per con non si da dei nel alla sono della gli anche come
o os uma não na no mais do dos das ao pelo pela seu sua
het een van op te dat niet zijn voor met aan er
""".split()

#: Classes of characters.
LOWER, UPPER, ACCENTED_LOWER, ACCENTED_UPPER, LETTER, DIGIT, SPACE, LINE, STOP, PUNCTUATION, SYMBOL, MARK, OTHER = range(13)
N_CLASSES = 13


@dataclass(frozen=True)
class RuleOptions:
    """Base limits, then the guards and limits of the two distances."""

    min_words: int = 10
    max_repeat_percent: int = 20
    min_chars: int = 250  # guard: shorter documents aren't judged by their characters
    max_char_distance: float = 0.3
    max_word_distance: float = 0.25  # of documents of full_words and more
    full_words: int = 200  # documents of fewer words have a wider limit
    word_noise: float = 4.0  # how much wider: in the square of the distance, this over the words
    min_support: int = 2000  # guard: words that a language must have besides the document
    broadcast_languages: int = 256  # of most characters, whose references are broadcast; those of all others are joined


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    by_kind = {"Ll": ACCENTED_LOWER, "Lu": ACCENTED_UPPER, "Lt": ACCENTED_UPPER, "Lo": LETTER, "Lm": LETTER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE, "Zl": LINE, "Zp": LINE}
    by_first = {"P": PUNCTUATION, "S": SYMBOL, "M": MARK}
    for code in range(0x20000):  # beyond lie ideographs, private and unassigned ones
        kind = unicodedata.category(chr(code))
        kinds[code] = by_kind.get(kind, by_first.get(kind[0], OTHER))
    kinds[0x20000:0x32000] = LETTER
    kinds[ord("a") : ord("z") + 1] = LOWER
    kinds[ord("A") : ord("Z") + 1] = UPPER
    for c in ASCII_SPACE:
        kinds[ord(c)] = LINE if c in "\n\r" else SPACE
    for c in ".,":
        kinds[ord(c)] = STOP
    for c in SYMBOLS:
        kinds[ord(c)] = SYMBOL
    return kinds


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more; exact, without hashing."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    kinds = len(ids)
    windows, most = codes[: n - width + 1], kinds
    for i in range(1, width):
        if most * kinds >= 2**62:
            seen, windows = np.unique(windows, return_inverse=True)
            most = len(seen)
        windows = windows * kinds + codes[i : n - width + 1 + i]
        most *= kinds
    _, at, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[at] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, ASCII_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def base_failed(counts: tuple[int, int, int, int, int], options: RuleOptions) -> bool:
    return counts[0] < options.min_words or 100 * counts[4] > options.max_repeat_percent * counts[0]


def histograms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts by character class; counts of COMMON_WORDS (in lower case, without edge punctuation), the rest last."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    by_class = np.bincount(_classes()[codes], minlength=N_CLASSES)
    place = _places()
    found, n = np.zeros(len(place) + 1, np.int64), 0
    for word, count in Counter(text.lower().split()).items():
        n += count
        at = place.get(word) if word in place else place.get(word.strip(".,;:!?"))
        if at is not None:
            found[at] += count
    found[-1] = n - found[:-1].sum()
    return by_class, found


@functools.cache
def _places() -> dict[str, int]:
    return {w: i for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}


def js_distance(a: np.ndarray, b: np.ndarray) -> float:
    """The Jensen-Shannon distance of two histograms of counts; 0 where one is empty."""
    if not a.sum() or not b.sum():
        return 0.0
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, parts / 2)))


Histograms = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class References:
    """References of languages: those of most text by name, all others as a table (lang, reference), if there are any."""

    by_name: dict[str, Histograms]
    others: DataFrame | None = None


def _parted(values: np.ndarray) -> Histograms:
    return values[:N_CLASSES], values[N_CLASSES:]


def language_references(docs: DataFrame, options: RuleOptions = RuleOptions()) -> References:
    """Summed histograms by language of all documents that pass the base rules.

    Each batch sums by language before the shuffle; at most options.broadcast_languages rows come
    to the driver.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[str | None, Histograms] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang is None or base_failed(base_counts(text or ""), options):
                continue
            old, new = sums.get(lang, (0, 0)), histograms(text)
            sums[lang] = old[0] + new[0], old[1] + new[1]
        return pa.RecordBatch.from_pydict(
            {"lang": list(sums), "hist": [np.concatenate(x).tolist() for x in sums.values()]},
            schema=pa.schema([("lang", pa.string()), ("hist", pa.list_(pa.int64()))]),
        )

    width = N_CLASSES + len(_places()) + 1
    parts = map_batches(docs.select(F.col("text").cast("string"), F.col("lang").cast("string")), each, "lang string, hist array<bigint>")
    # sums by position; the width is fixed, so this is a plain aggregate with partial sums
    sums = [F.sum(F.col("hist")[i]).alias(f"h{i}") for i in range(width)]
    by_lang = written(parts.groupBy("lang").agg(*sums), "languages")
    chars = functools.reduce(lambda a, b: a + b, [F.col(f"h{i}") for i in range(N_CLASSES)])
    first = by_lang.orderBy(chars.desc(), "lang").limit(options.broadcast_languages + 1).collect()
    by_name = {r["lang"]: _parted(np.array(r[1:], np.float64)) for r in first[: options.broadcast_languages]}
    others = None
    if len(first) > options.broadcast_languages:
        others = by_lang.where(~F.col("lang").isin(*by_name)).select("lang", F.array(*[f"h{i}" for i in range(width)]).alias("reference"))
    return References(by_name, others)


def word_limit(n: int, options: RuleOptions) -> float:
    """The greatest distance of the common words that a document of n words may have."""
    if n >= options.full_words:
        return options.max_word_distance
    return math.sqrt(options.max_word_distance**2 + options.word_noise * (1 / max(1, n) - 1 / options.full_words))


def verdict(text: str, lang: str | None, references: dict[str, Histograms], options: RuleOptions, counted: bool = False) -> tuple[bool, float, float]:
    """Kept by the method, the distance of the characters (0 where its guard holds), that of the common words.

    counted: the text is part of the reference of its language.  Without any reference that has
    enough text besides it, the distances are 0.
    """
    by_class, common = histograms(text)
    chars = words = 0.0
    ref = references.get(lang) if lang is not None else None
    if ref is not None and counted:
        ref = ref[0] - by_class, ref[1] - common
    if ref is None or ref[1].sum() < options.min_support:
        known = [r for name, r in references.items() if name != lang and r[1].sum() >= options.min_support]
        ref = min(known, key=lambda r: js_distance(common, r[1]), default=None)
    if ref is not None:
        chars = js_distance(by_class, ref[0]) if by_class.sum() >= options.min_chars else 0.0
        words = js_distance(common, ref[1])
    return chars <= options.max_char_distance and words <= word_limit(int(common.sum()), options), chars, words


COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double"


def _by_reference(docs: DataFrame, references: References, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run() over row (the columns of docs), text, lang and reference: the last is null but for languages of which it is not broadcast."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    none = rows.withColumn("reference", F.lit(None).cast("array<bigint>"))
    if references.others is None:
        return run(none)
    known = F.coalesce(F.col("lang").isin(*references.by_name), F.lit(True))
    rare = rows.where(~known).join(references.others.withColumnRenamed("lang", "__lang"), F.col("lang") == F.col("__lang"), "left").drop("__lang")
    return run(none.where(known)).unionByName(run(rare))


def _verdicts(batch: pa.RecordBatch, by_name: dict[str, Histograms], options: RuleOptions) -> Iterator[tuple[tuple[int, int, int, int, int], bool, tuple[bool, float, float]]]:
    """The base counts, whether they fail, and the verdict of each row of (row, text, lang, reference)."""
    for text, lang, own in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
        counts = base_counts(text or "")
        failed = base_failed(counts, options)
        known = by_name if own is None else by_name | {lang: _parted(np.array(own, np.float64))}
        yield counts, failed, verdict(text or "", lang, known, options, not failed)


def judge(docs: DataFrame, references: References, options: RuleOptions = RuleOptions()) -> DataFrame:
    """One row a document, in one pass: doc_id, the base counts and the verdict.

    references: of docs itself, from language_references().  A null or empty text has no words and
    fails the base rules; a null or unknown language, or one with too little text besides the
    document, is compared with the nearest reference; repeated rows are judged each for itself; a
    corpus in which no document passes the base rules has no references, and distances of 0.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])
    by_name = references.by_name

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).flatten()[0].to_pylist()
        rows = [(i, *counts, failed, kept and not failed, chars, words) for i, (counts, failed, (kept, chars, words)) in zip(ids, _verdicts(batch, by_name, options), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return _by_reference(slim, references, lambda rows: map_batches(rows.withColumn("row", F.struct("row.doc_id")), each, f"doc_id bigint, {COUNTS}"))


def keep_good(docs: DataFrame, options: RuleOptions = RuleOptions()) -> DataFrame:
    """The documents that the rules keep, with all their columns, in one pass after that for the references."""
    references = language_references(docs, options)
    by_name, names, schema = references.by_name, docs.columns, docs.schema

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = pa.array([kept and not failed for _, failed, (kept, _, _) in _verdicts(batch, by_name, options)], pa.bool_())
        return pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.column(0).flatten()], names=names)

    return _by_reference(docs, references, lambda rows: map_batches(rows, each, schema))


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the base rules and the references of its language."""
    docs = dealt_table(spark, sf_dir, "documents")
    return judge(docs, language_references(docs))
