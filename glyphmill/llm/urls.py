"""URL filters: a blocked Bloom filter over listed keys, then an exact hash join.

A list has keys of a host and the start of a path, such as `example.com/en/7` or `net/`; a key
fits its host and all subdomains, where the path of the URL starts with that of the key.  Each URL
has one candidate key for each suffix of its host and each listed length of a path.  The filter
passes candidates that may be listed, and a join with the list itself removes false positives, so
the verdicts are exact whatever the size of the filter.

The filter is a table of blocks of 256 bits; a key sets one bit in each of the eight 32-bit lanes
of one block, so a probe reads one block.  At most `max_blocks` blocks are broadcast (8 bytes a
lane: 64 MB at the default), for whatever length of list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

LANES = 8
#: Odd multipliers that pick the bit of each lane.
SALTS = (0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)

#: The rules of the query: key and action.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Names of unwanted hosts of the query, under each of the ends; they are blocked where no rule fits.
UNWANTED = ("cheap-pills", "spam-farm", "casino-win", "free-bets", "ads-track", "adult-x")
ENDS = ("example.com", "example.org", "example.net")
LISTED = tuple(f"{name}.{end}/" for name in UNWANTED for end in ENDS)


def canonical_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters in lower case) and path of a URL; both empty for a null or where there is no `://`."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def bloom_place(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _lane_bits(key: Column) -> list[Column]:
    """The bit of each lane, from a second hash of the key."""
    h = F.xxhash64(key, F.lit("lanes")).bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright((h * F.lit(s)).bitwiseAND(F.lit(0x7FFFFFFF)), 26).cast("int")) for s in SALTS]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """__block, __l0 to __l7: the blocks that have a key; at most n_blocks rows."""
    bits = _lane_bits(F.col("key"))
    keyed = listed.where(F.col("key").isNotNull()).select(bloom_place(F.col("key"), n_blocks).alias("__block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    return keyed.groupBy("__block").agg(*[F.bit_or(f"b{i}").alias(f"__l{i}") for i in range(LANES)])


def bloom_hit(key: Column) -> Column:
    """Whether the block __l0 to __l7 has all bits of the key."""
    hit = F.lit(True)
    for i, bit in enumerate(_lane_bits(key)):
        hit = hit & (F.col(f"__l{i}").bitwiseAND(bit) != 0)
    return hit


def blocks_for(n_keys: int, bits_a_key: int = 16, max_blocks: int = 1 << 20) -> int:
    """Blocks for so many keys; bounded, beyond which only more candidates reach the join."""
    return max(1, min(max_blocks, -(-n_keys * bits_a_key // (32 * LANES))))


def filter_urls(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", max_blocks: int = 1 << 20) -> DataFrame:
    """key, host, path, listed_key, action, rank: the listed key that fits each URL best.

    pages: any columns; only `key` and `url` are used, and each row counts for itself.
    listed: key, action and rank; the greatest rank wins, then the longest key, then the action
    that sorts last.  Null keys fit nothing.  Where no key fits, the last three are null; empty
    tables give no rows, or rows without a listed key.
    """
    listed = listed.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.struct("rank", "action")).alias("is"))
    shape = listed.agg(F.count("*").alias("n"), F.collect_set(F.length(F.regexp_extract("key", r"(?s)^[^/]*(.*)$", 1))).alias("lengths")).first()
    lengths, n_blocks = sorted(shape["lengths"]), blocks_for(shape["n"], max_blocks=max_blocks)
    host, path = canonical_parts(F.col(url).cast("string"))
    urls = pages.select(F.col(key).alias("__key"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cut = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    # a listed path longer than the URL's own can't start it
    fitting = F.filter(cut, lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    # repeated URLs are judged once, however many rows have them
    candidates = urls.groupBy("host", "path").agg(F.first(F.lit(0)).alias("__one")).select("host", "path", F.explode(keys).alias("__candidate"))
    # a broadcast of a proven bound: max_blocks rows of nine longs
    probed = candidates.join(F.broadcast(bloom_blocks(listed, n_blocks)), bloom_place(F.col("__candidate"), n_blocks) == F.col("__block"))
    exact = probed.where(bloom_hit(F.col("__candidate"))).select("host", "path", "__candidate").join(listed, F.col("__candidate") == F.col("key"))
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.col("is.rank").alias("rank"), F.length("key").alias("n"), F.col("is.action").alias("action"), F.col("key").alias("key"))).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select(F.col("__key").alias(key), "host", "path", F.col("best.key").alias("listed_key"), F.col("best.action").alias("action"), F.col("best.rank").alias("rank"))


def op6_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules, and against the listed hosts where no rule fits."""
    listed = spark.createDataFrame([(k, a, 1) for k, a in RULES] + [(k, "block", 0) for k in LISTED], "key string, action string, rank int")
    found = filter_urls(table(spark, sf_dir, "pages"), listed)
    return found.select("page_id", "host", "path", F.when(F.col("rank") == 1, F.col("listed_key")).alias("rule"), F.coalesce("action", F.lit("allow")).alias("verdict"))


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
listed(key, action, rank) AS (VALUES %s),
cut AS (SELECT key, action, rank, regexp_extract(key, '^[^/]*') AS khost, regexp_extract(key, '^[^/]*(.*)$', 1) AS kpath FROM listed),
fits AS (
  SELECT DISTINCT host, path, key, action, rank FROM (SELECT DISTINCT host, path FROM split) JOIN cut
    ON (host = khost OR ends_with(host, '.' || khost)) AND starts_with(path, kpath)),
best AS (SELECT host, path, arg_max(struct_pack(key := key, action := action, rank := rank), rank * 10000 + length(key)) AS b FROM fits GROUP BY host, path)
SELECT page_id, split.host, split.path, CASE WHEN b.rank = 1 THEN b.key END AS rule, coalesce(b.action, 'allow') AS verdict
FROM split LEFT JOIN best ON split.host = best.host AND split.path = best.path
""" % ", ".join([f"('{k}', '{a}', 1)" for k, a in RULES] + [f"('{k}', 'block', 0)" for k in LISTED])
