"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space.

A document is a bag of terms of two groups: the shapes of its words with marks of repetition, and
its words themselves.  Each group is a distribution over hashed terms, of which the square roots
are weighted by inverse document frequency and scaled to the group's share.  A truncated singular
value decomposition of the labelled sample gives the latent space.  The latent vectors of the
sample are broadcast; every document is compared with all of them by exact cosine products, in
blocks, and the labels of the nearest vote with their similarity as weight.

The sample is the one bounded thing: at most `sample` labelled documents (half of each label, or
more of one where the other has fewer), those of least hash of doc_id, so that it is the same for
each run and for any order of rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import MEMOS, dealt_table, fresh, lean, small_table, table, words_of


@dataclass(frozen=True)
class QualityOptions:
    sample: int = 4096  # labelled documents to learn from, at most
    terms: int = 4096  # hashed terms, half of each group
    dimensions: int = 48
    neighbours: int = 15
    words_share: float = 0.35  # of the words group in a vector; the shapes have the rest
    seed: int = 11


_SHAPES = [(re.compile(p), r) for p, r in ((r"[A-ZÀ-ÖØ-Þ]+", "X"), (r"[^\W\d_A-ZÀ-ÖØ-ÞX]+", "x"), (r"\d+", "0"), (r"(.)\1+", r"\1"))]
_MEMO: dict[bytes, tuple[int, int]] = {}
MEMOS["quality"] = _MEMO.clear
#: Code points of a word that is a term as it is, and of the pieces of longer ones.
LONGEST, GRAM = 64, 3


def _word_terms(word: bytes, half: int) -> tuple[int, int]:
    """The terms of a word: its shape, and the word in lower case without what is no letter at its ends; both of all of it."""
    text = shape = word.decode("utf-8", "replace")
    for pattern, by in _SHAPES:
        shape = pattern.sub(by, shape)
    return zlib.crc32(b"s" + shape.encode()) % half, half + zlib.crc32(b"w" + text.lower().strip(".,;:!?#*$%&|<>\"'()").encode()) % half


def _units(words: list[bytes]) -> Iterator[tuple[bytes, float]]:
    """Distinct words and how often each counts.

    A word of more than LONGEST code points, as in texts without ASCII spaces, is parted at other
    white space; parts that are still longer give all their overlapping pieces of GRAM code points,
    which count so much that a part weighs as its length over GRAM.
    """
    for word, n in Counter(words).items():
        if len(word) <= LONGEST or len(text := word.decode("utf-8", "replace")) <= LONGEST:
            yield word, n
            continue
        for part, m in Counter(text.split()).items():
            if len(part) <= LONGEST:
                yield part.encode(), n * m
            else:
                for gram, k in Counter(map("".join, zip(*(part[i:] for i in range(GRAM)), strict=False))).items():
                    yield gram.encode(), n * m * k / GRAM


def features(text: str, options: QualityOptions) -> tuple[np.ndarray, np.ndarray]:
    """Terms (ascending) and their weights before inverse document frequency; empty without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    half = options.terms // 2
    shapes: Counter[int] = Counter()
    plain: Counter[int] = Counter()
    for word, n in _units(words):
        terms = _MEMO.get(word)
        if terms is None:
            if len(_MEMO) > 1 << 16:
                _MEMO.clear()
            terms = _MEMO[word] = _word_terms(word, half)
        shapes[terms[0]] += n
        plain[terms[1]] += n
    n = len(words)
    again = sum(map(bytes.__eq__, words, words[1:]))
    windows = max(0, n - 4)
    repeated = windows - len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)))
    lines = [x for x in text.split("\n") if x]
    # marks of repetition count as shapes; each is on in proportion to how much repeats
    for name, count in ((b"again", again), (b"window", repeated), (b"line", (len(lines) - len(set(lines))) * n // max(1, len(lines)))):
        if count:
            shapes[zlib.crc32(b"r" + name) % half] += count
    out_t, out_w = [], []
    for counts, share in ((shapes, 1 - options.words_share), (plain, options.words_share)):
        terms = np.fromiter(counts, np.int64, len(counts))
        weight = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
        out_t.append(terms)
        out_w.append(weight / np.linalg.norm(weight) * np.sqrt(share))
    terms, weights = np.concatenate(out_t), np.concatenate(out_w)
    order = np.argsort(terms)
    return terms[order], weights[order]


@dataclass(frozen=True)
class QualityModel:
    options: QualityOptions
    idf: np.ndarray  # by term
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, of length 1 or 0
    labels: np.ndarray  # 0 or 1
    prior: float  # the score of a document that is like none

    def latent(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Latent vectors of documents, of length 1 (0 where nothing is known of one)."""
        out = np.zeros((len(rows), self.basis.shape[1]), np.float32)
        for i, (terms, weights) in enumerate(rows):
            if len(terms):
                out[i] = (weights * self.idf[terms]).astype(np.float32) @ self.basis[terms]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]], block: int = 256) -> np.ndarray:
        """0 to 1, by exact cosine products with all labelled vectors, a block of documents at a time."""
        latent, out = self.latent(rows), np.full(len(rows), self.prior)
        k = min(self.options.neighbours, len(self.labels))
        if not k:
            return out
        for at in range(0, len(rows), block):
            near = latent[at : at + block] @ self.vectors.T
            least = np.partition(near, near.shape[1] - k, axis=1)[:, -k][:, None]
            weight = np.where(near >= least, np.maximum(near, 0), 0).astype(np.float64)  # ties at the k-th all vote
            total = weight.sum(axis=1)
            votes = np.divide(weight @ self.labels, total, out=np.full(len(near), self.prior), where=total > 0)
            out[at : at + block] = np.clip(votes, 0, 1)
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], options: QualityOptions) -> QualityModel:
    """From (terms, weights, label) of labelled documents; without any, all scores are 0.5."""
    labels = np.array([r[2] for r in rows], np.float64)
    n = len(rows)
    df = np.zeros(options.terms)
    for terms, _, _ in rows:
        df[terms] += 1
    idf = np.log((1 + n) / (1 + df)) + 0.1
    dense = np.zeros((n, options.terms), np.float32)
    for i, (terms, weights, _) in enumerate(rows):
        dense[i, terms] = weights * idf[terms]
    rank = max(1, min(options.dimensions, n))
    rng = np.random.default_rng(options.seed)
    basis = rng.standard_normal((options.terms, rank + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration of the randomized decomposition
        basis, _ = np.linalg.qr(dense.T @ (dense @ basis)) if n else (basis, None)
    if n:
        _, _, right = np.linalg.svd(dense @ basis, full_matrices=False)
        basis = basis @ right[:rank].T
    model = QualityModel(options, idf, basis.astype(np.float32), np.zeros((0, rank), np.float32), labels, float(labels.mean()) if n else 0.5)
    return QualityModel(options, idf, model.basis, model.latent([(t, w) for t, w, _ in rows]), labels, model.prior)


def learn(docs: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions(), allowed: Column | None = None) -> QualityModel:
    """A model from the documents that labels (doc_id, quality) marks, of which `allowed` may say where it holds.

    Labels that contradict each other count by their majority (ties: 1); null labels don't count.
    Of documents of one doc_id, that of the least terms counts.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if allowed is None else allowed))
    one = marked.groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("label"), F.xxhash64("doc_id").alias("h"))
    pools = [one.where(F.col("label") == v).orderBy("h", "doc_id").limit(options.sample).collect() for v in (0, 1)]
    half = options.sample // 2
    take = [min(len(p), max(half, options.sample - len(q))) for p, q in (pools, pools[::-1])]
    chosen = [r for p, n in zip(pools, take, strict=True) for r in p[:n]]
    spark = docs.sparkSession
    wanted = small_table(spark, [(r["doc_id"], r["label"]) for r in chosen], pa.schema([("__id", pa.int64()), ("__label", pa.int32())]))  # at most options.sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t or "", options) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.tolist() for t, _ in made], pa.list_(pa.int64())), pa.array([w.tolist() for _, w in made], pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "terms", "weights", "label"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__label")
    got = rows.mapInArrow(lean(run, "quality"), "doc_id bigint, terms array<bigint>, weights array<double>, label int").groupBy("doc_id").agg(F.min(F.struct("terms", "weights", "label")).alias("least")).select("doc_id", "least.*").collect()
    got.sort(key=lambda r: r["doc_id"])
    return fit([(np.array(r["terms"], np.int64), np.array(r["weights"]), r["label"]) for r in got], options)


def score(docs: DataFrame, model: QualityModel, name: str = "__score", rows: int = 512) -> DataFrame:
    """All columns of docs and the score, under a name that docs does not have.  A null or empty text has the score of a document that is like none."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # sample x dimensions and terms x dimensions numbers
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                scores = model.scores([features(t or "", model.options) for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return docs.mapInArrow(lean(run, "quality"), ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{name}` double"]))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def op5_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels that aren't held out."""
    docs = dealt_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = learn(docs, table(spark, sf_dir, "labels"), allowed=~held_out(F.col("doc_id").cast("bigint")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions()) -> DataFrame:
    """The documents that the classifier, learned from labels, does not reject (score of 0.5 or more), with all their columns.

    A document without words is like none and has the prior as its score.
    """
    name = fresh(docs, "score")
    model = learn(docs, labels, options, ~held_out(F.col("doc_id").cast("bigint")))
    return score(docs, model, name).where(F.col(name) >= 0.5).drop(name)
