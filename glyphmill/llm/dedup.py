"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification, components.

DartMinHash (Christiani, 2020) throws hashed darts at the plane of weight by rank.  The darts of an
element come from its own hash alone, as a Poisson process over dyadic regions; a document of
total weight W looks at ranks below t / W, where about t darts land under the weights of its
elements.  Each dart has a hashed coordinate of the signature, and the earliest (least rank) of a
coordinate is kept.  Two documents agree on a coordinate with the probability of their weighted
Jaccard similarity, and a signature of k coordinates takes O(n + k log k) darts, not n * k.

Documents are weighted sets of five-word shingles: a shingle weighs as often as it occurs.  With
weights="set" all weigh one, so that this is the plain Jaccard similarity.

Equal texts (equal words in order) are one node.  A band of equal coordinates makes two nodes
candidates.  In a bucket of a band all are compared with its hub, the member that meets most
others over all bands, so a large group of copies costs one comparison a member.  Members of
buckets that are still in different components are then joined by the rare ones of their shingles
(a prefix filter: two that are similar enough share one, whatever else they have), which loses no
link.  Links are verified on the whole shingles; classes are the connected components of verified
links.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import SPACES, WORD, dealt_table, lean, map_batches, mix64, release, unit, words_of, written


@dataclass(frozen=True)
class DedupOptions:
    """A pair of similarity s becomes a candidate with probability 1 - (1 - s**rows)**bands: 0.99998 at 0.8."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 28
    rows: int = 5
    weights: str = "count"  # or "set"


# --- signatures ---


@functools.cache
def _poisson(area: float) -> np.ndarray:
    """Cumulated probabilities of 0, 1, ... darts in a region."""
    last = int(area + 12 * math.sqrt(area) + 20)
    logs = np.array([n * math.log(area) - area - math.lgamma(n + 1) for n in range(last)])
    return np.cumsum(np.exp(logs))


LOWEST = 0  # log2 of the end of the first region of ranks
_GOLD, _COLUMN, _HEIGHT, _PLACE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _darts(elements: np.ndarray, weights: np.ndarray, ranks: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ranks of the darts under the weights, of ranks below `ranks`."""
    hashes, found = [], []
    top = float(weights.max())
    column, left, right = 0, 0.0, 1.0
    while left < top:
        own = weights > left
        these, bound = (elements, weights) if own.all() else (elements[own], weights[own])
        row, low, high = 0, 0.0, 2.0**LOWEST
        while low < ranks:
            with np.errstate(over="ignore"):
                region = mix64(these + _COLUMN * np.uint64(column * 64 + row + 1))
                n = np.searchsorted(_poisson((right - left) * (high - low)), unit(region), "right")
                at = np.repeat(np.arange(len(these)), n)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix64(region[at] + _GOLD * (nth + 1).astype(np.uint64))
                rank = low + (high - low) * unit(mix64(dart ^ _HEIGHT))
                keep = rank < ranks
                if top != 1 or column:
                    keep &= left + (right - left) * unit(mix64(dart ^ _PLACE)) < bound[at]
            hashes.append(dart[keep])
            found.append(rank[keep])
            row, low, high = row + 1, high, 2 * high
        column, left, right = column + 1, right, 2 * right
    return np.concatenate(hashes), np.concatenate(found)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The k coordinates (hashes of darts) of a weighted set; all 0 for an empty one."""
    out = np.zeros(k, np.uint64)
    if not len(elements):
        return out
    ranks = (k * math.log(k) + 3 * k) / float(weights.sum())
    while True:
        dart, rank = _darts(elements, weights, ranks)
        order = np.argsort(-rank)
        at = (dart % np.uint64(k)).astype(np.int64)[order]
        out[at] = dart[order]  # the last write, the earliest dart, stays
        if np.bincount(at, minlength=k).all():
            return out
        ranks *= 2


def shingles(text: str, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the word windows of a text, ascending, and how often each occurs.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    last = len(words) - width + 1
    rolled = np.full(last, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            rolled = mix64(rolled * _GOLD + codes[i : i + last])
    return np.unique(rolled, return_counts=True)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, different between bands."""
    parts = signature[: bands * rows].reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix64(key * _GOLD + parts[:, i])
    return key


# --- nodes: equal texts are one ---


def node_of(text: Column) -> Column:
    """A digest of the words of a text in order; null without words."""
    plain = F.regexp_replace(text, SPACES, " ")
    return F.when(text.rlike(WORD), F.unhex(F.md5(F.encode(F.btrim(plain, F.lit(" ")), "UTF-8"))))


def signed(docs: DataFrame, options: DedupOptions) -> DataFrame:
    """node, keys, size: the band keys and number of shingles of each distinct text that has words."""
    k = options.bands * options.rows
    schema = pa.schema([("node", pa.binary()), ("keys", pa.list_(pa.int64())), ("size", pa.int32())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[bytes, str] = {}  # copies in one batch are signed once
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(node, text)
        keys, sizes = [], []
        for text in seen.values():
            elements, counts = shingles(text, options.shingle)
            weights = np.ones(len(elements)) if options.weights == "set" else counts.astype(np.float64)
            keys.append(band_keys(dart_minhash(elements, weights, k), options.bands, options.rows).astype(np.int64))
            sizes.append(int(weights.sum()))
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], schema=schema)

    text = F.col("text").cast("string")
    nodes = docs.select(node_of(text).alias("node"), text.alias("text")).where(F.col("node").isNotNull())
    return map_batches(nodes, each, "node binary, keys array<bigint>, size int").groupBy("node").agg(F.first("keys").alias("keys"), F.first("size").alias("size"))


# --- verification ---


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ascending hashes, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def shingle_sets(docs: DataFrame, wanted: DataFrame, options: DedupOptions) -> DataFrame:
    """node, set binary: the hashes (and counts) of the shingles of the wanted nodes, and of few others.

    A Bloom filter of a bounded size passes the documents; the joins that follow are exact.
    """
    from .urls import blocks_for, bloom_blocks, bloom_hit, bloom_place

    n_blocks = blocks_for(wanted.count())
    blocks = bloom_blocks(wanted.select(F.hex("node").alias("key")), n_blocks)
    text = F.col("text").cast("string")
    nodes = docs.select(node_of(text).alias("node"), text.alias("text")).where(F.col("node").isNotNull())
    key = F.hex("node")
    passed = nodes.join(F.broadcast(blocks), bloom_place(key, n_blocks) == F.col("__block")).where(bloom_hit(key)).select("node", "text")
    schema = pa.schema([("node", pa.binary()), ("set", pa.binary())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([_packed(t, options) for t in seen.values()], pa.binary())], schema=schema)

    return map_batches(passed, each, "node binary, set binary").groupBy("node").agg(F.first("set").alias("set"))


def _packed(text: str, options: DedupOptions) -> bytes:
    """The 64-bit shingle hashes of a text, ascending; then how often each occurs, if that counts."""
    elements, counts = shingles(text, options.shingle)
    if options.weights == "set":
        return elements.astype("<u8").tobytes()
    return elements.astype("<u8").tobytes() + counts.astype("<u4").tobytes()


def _unpacked(data: bytes, options: DedupOptions) -> tuple[np.ndarray, np.ndarray]:
    if options.weights == "set":
        values = np.frombuffer(data, "<u8")
        return values, np.ones(len(values), np.int64)
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n).astype(np.int64)


def verified(pairs: DataFrame, sets: DataFrame, options: DedupOptions) -> DataFrame:
    """a, b of the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = b"", None
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column("b").to_pylist(), batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                if b != last:  # pairs of one hub come together
                    last, own = b, _unpacked(y, options)
                keep.append(similar(_unpacked(x, options), own) >= options.similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(lean(run), "a binary, b binary")


# --- members of a bucket that its hub does not link ---


def tokens_of(members: DataFrame, sets: DataFrame, options: DedupOptions) -> DataFrame:
    """node, size, root, token: the shingles of the members, one for each time that it counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("set").to_pylist()):
                elements, counts = _unpacked(data, options)
                tokens = elements
                if counts.max(initial=1) > 1:  # the n-th time that a shingle occurs is a token of its own
                    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    repeated = np.repeat(elements, counts)
                    with np.errstate(over="ignore"):
                        tokens = np.where(nth == 0, repeated, mix64(repeated + _GOLD * nth.astype(np.uint64)))
                one = pa.array(np.full(len(tokens), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(one) for c in ("node", "size", "root")], pa.array(tokens.astype(np.int64))], names=["node", "size", "root", "token"])

    return members.join(sets, "node").select("node", "size", "root", "set").mapInArrow(lean(run), "node binary, size int, root binary, token bigint")


def rare_pairs(members: DataFrame, sets: DataFrame, options: DedupOptions) -> DataFrame:
    """a, b: distinct pairs of members (node, size, root) of different roots that may be similar enough; none that is gets lost.

    Of n tokens in any order that all documents share, two that are similar enough have one in
    common among their first n - ceil(similarity * n) + 1.  The order is from the rarest token on,
    so tokens that many members have seldom count, and those that one alone has match nothing.
    How far in the first common one stands bounds what two can share, which leaves few pairs.
    """
    tokens = tokens_of(members, sets, options)
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = tokens.join(often, "token")
    own = W.partitionBy("node")
    place = F.row_number().over(own.orderBy("n", "token")) + F.col("size") - F.count("*").over(own)  # after those that it has alone
    first = written(shared.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * options.similarity - 1e-6) + 1).select("token", "node", "size", "root", "place"), "rare")
    mixed = first.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    left = first.join(mixed, "token")
    right = left.select("token", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"), F.col("place").alias("place_b"))
    # after the first token in common, which stands at these places, no more can be shared than either has left
    most = 1 + F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    fit = most >= (F.col("size") + F.col("size_b")) * (options.similarity / (1 + options.similarity)) - 1e-6
    return left.join(right, (left["token"] == right["token"]) & (F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b")) & fit).select(F.col("node").alias("a"), "b").distinct()


# --- components ---


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root of all nodes of links (a, b): the least node of each connected component.

    Alternating large and small stars, by aggregates and joins; each round is written.  A star of
    any size costs its links.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(roots.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, written(small, "links")
        release(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# --- the operator ---


def _hubs(rows: DataFrame) -> DataFrame:
    """a, b, n: each member of each bucket with its hub, of rows (key, node, size) in buckets of two or more; once a pair."""
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"))
    scores = rows.join(buckets, "key").groupBy("node").agg(F.sum("n").alias("score"))
    ranked = rows.join(scores, "node").select("key", "node", "size", "score")
    hub = ranked.groupBy("key").agg(F.max(F.struct("score", "node", "size")).alias("hub"))
    return ranked.join(hub, "key").select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("hub.node").alias("b"), F.col("hub.size").alias("size_b"))


def _possible(pairs: DataFrame, options: DedupOptions) -> DataFrame:
    """Distinct pairs whose sizes allow the similarity."""
    fit = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * options.similarity
    return pairs.where((F.col("a") != F.col("b")) & fit).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """node, root of the texts that are linked with others; texts that are not there stand alone."""
    nodes = written(signed(docs, options), "signed")
    rows = nodes.select(F.explode("keys").alias("key"), "node", "size")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = written(rows.join(shared, "key"), "buckets")
    pairs = written(_possible(_hubs(rows), options), "pairs")
    sets = written(shingle_sets(docs, rows.select("node").distinct(), options), "sets")
    links = written(verified(pairs, sets, options), "verified")
    roots = components(links)
    # buckets whose members are still in different components: those members are compared by their rare shingles
    named = rows.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    apart = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("key")
    members = written(named.join(apart, "key").select("node", "size", "root").distinct(), "apart")
    if members.isEmpty():
        return roots
    tested = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = written(rare_pairs(members, sets, options).join(tested, ["a", "b"], "left_anti"), "rest")
    more = written(verified(rest, sets, options), "verified")
    if more.isEmpty():
        return roots
    return components(links.unionByName(more))


def classes(docs: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """doc_id, class_id: one row a document; class_id is the least doc_id of its class.

    A null text and a text without words have no shingles: each such document is a class of its
    own.  A null doc_id stays null and never names a class unless all of its class are null.
    Repeated rows fall in one class and each has its row.  An empty table has none.
    """
    roots = near_duplicates(docs, options)
    node = node_of(F.col("text").cast("string"))
    # documents without words meet nothing: each has a key of its own, shorter or longer than a digest
    alone = F.encode(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null in "), F.spark_partition_id().cast("string")))), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(node, alone).alias("node"), node.isNotNull().alias("worded"))
    # the least doc_id of each text, then of each class; texts and classes of very many members are summed in each task first
    texts = written(rows.where("worded").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "texts")
    linked = written(texts.join(roots, "node").select("node", "root", "least"), "linked")
    named = linked.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("often"))
    of_text = spread_join(linked.select("node", "root"), named, "root", "node", linked.count()).select("node", "class_id")
    known = texts.join(of_text, "node", "left").select("node", F.coalesce("class_id", "least").alias("class_id"), F.col("n").alias("often"))
    total = texts.agg(F.sum("n")).first()[0] or 0
    return spread_join(rows, written(known, "known"), "node", "doc_id", total).select("doc_id", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


#: A key of more than one in so many rows is joined in as many tasks.
SPREAD = 1024


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """left (of `total` rows) with the row that right has of its key, if any.

    right has each key once, with `often`, the rows of left that have it.  Keys of more than one
    in SPREAD rows, of which there are fewer than SPREAD, are broadcast; their rows in left are
    dealt by a hash of `by`, and those in right are repeated for each deal.
    """
    is_hot = F.col("often") * SPREAD > total
    hot = right.where(is_hot).select(F.col(key).alias("__hot"))
    deals = 64
    salted = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__deal", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(deals)).cast("int"))).drop("__hot")
    wide = right.withColumn("__deal", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(deals - 1))).otherwise(F.array(F.lit(0))))).drop("often")
    return salted.join(wide, [key, "__deal"], "left").drop("__deal")


def keep_one(docs: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """One document of each class, that of the least doc_id (then the least text), with all its columns.

    Documents without words stay.  Documents that a Bloom filter of a bounded size knows to have
    neither copies nor links stay where they are; only the others are grouped.
    """
    from .urls import blocks_for, bloom_blocks, bloom_hit, bloom_place

    roots = near_duplicates(docs, options)
    node = node_of(F.col("text").cast("string"))
    copies = docs.select(node.alias("node")).where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    wanted = written(roots.select("node").unionByName(copies.select("node")).distinct(), "wanted")
    n_blocks = blocks_for(wanted.count())
    blocks = bloom_blocks(wanted.select(F.hex("node").alias("key")), n_blocks)
    # the columns of docs stand in one of their own, so that none can clash
    whole = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), node.alias("node"))
    tagged = whole.join(F.broadcast(blocks), bloom_place(F.hex("node"), n_blocks) == F.col("__block"), "left")
    hit = F.col("node").isNotNull() & F.coalesce(bloom_hit(F.hex("node")), F.lit(False))
    grouped = tagged.where(hit).join(roots.select(F.col("node").alias("member"), "root"), F.col("node") == F.col("member"), "left")
    first = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col("row.text"))
    kept = grouped.groupBy(F.coalesce("root", "node").alias("class")).agg(F.min_by("row", first).alias("row")).select("row.*")
    return tagged.where(~hit).select("row.*").unionByName(kept)


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its class of near duplicates."""
    return classes(dealt_table(spark, sf_dir, "documents"))
