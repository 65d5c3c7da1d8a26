"""Not-modified revisits of web archives: an as-of join with the latest earlier full response.

A revisit record says that a server had nothing new (status 304): its headers replace some of the
stored response's, and the body stays as it was.  Each revisit is joined with the latest full
response to the same canonical URL before it, the validators of both are compared (entity tags by
the weak comparison; else the last-modified dates), and where they agree the stored response is
served anew with the permitted headers merged.

The as-of join goes by buckets of time: inside a bucket of a URL a window finds the latest
response; what a bucket has not seen comes from the last response of the buckets before it, one
row a bucket.  So a URL with a third of all records is worked on in as many tasks as there are
buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import bucket_of, key_bounds, parallelism, table

#: Headers that a 304 must not replace, in lower case (they describe the stored body or one connection).
KEPT_HEADERS = (
    "content-encoding", "content-length", "content-md5", "content-range", "content-type", "connection", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "content-location",
)


def canonical_url(url: Column) -> Column:
    """Without scheme, `www.` or `m.`, a default port, fragment, query of tracking, or a slash at the end; host in lower case."""
    rest = F.regexp_replace(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1)), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def merged_headers(stored: Column, new: Column) -> Column:
    """The stored headers, of which those that a 304 may bring are replaced by its own; names in lower case."""

    def lowered(m: Column) -> Column:
        return F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))

    fresh = F.map_filter(lowered(new), lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(lowered(stored), lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)


def resolve_revisits(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Each revisit with the response that it renews.

    records: record_id long, kind string (`response` or `revisit`; others are ignored), url string,
    ts timestamp or long, etag, last_modified string, headers map<string,string>, body string.
    Returns record_id, url, ts, response_id, status, headers, body, one row a revisit, where status
    is `resolved`, `changed` (the validators differ), `unchecked` (no validator in common) or
    `missing` (no earlier response); headers and body are null unless resolved.

    A response at the time of the revisit itself counts as earlier; of responses at one time the
    one of the greatest record_id counts (null is the least; of one record_id, one by a hash of the
    whole record).  Records without url or ts match nothing: such revisits are missing.  Repeated
    revisits, and those whose record_id is null or repeated, are resolved each for itself.
    """
    named = records.where(F.col("kind").isin("response", "revisit")).withColumn("__url", canonical_url(F.col("url"))).withColumn("__ts", F.col("ts").cast("bigint"))
    bounds = key_bounds(named.select("__ts"), "__ts", parts or parallelism(records.sparkSession))
    dealt = named.withColumn("__bucket", bucket_of(F.col("__ts"), bounds))
    good = F.col("__url").isNotNull() & F.col("__ts").isNotNull()
    # a response is named by hashes of all of it, as ids may be null or repeated; a revisit is carried whole
    whole = [F.col("record_id"), F.col("__url"), F.col("__ts"), F.col("etag"), F.col("last_modified"), F.array_sort(F.map_entries("headers")), F.col("body")]
    names = [F.xxhash64(F.lit(salt), *[F.struct(c.isNull(), c) for c in whole]) for salt in ("first", "second")]
    is_response, is_revisit = F.col("kind") == "response", F.col("kind") == "revisit"
    own = [F.when(is_revisit, F.col(c)).alias(c) for c in ("url", "ts", "headers")]
    slim = dealt.where(good).select("record_id", "kind", "__url", "__ts", "__bucket", "etag", "last_modified", *own, *[F.when(is_response, n).alias(f"__h{i}") for i, n in enumerate(names)])
    answer = F.when(is_response, F.struct("record_id", "__h0", "__h1", "etag", "last_modified"))
    order = [F.col("__ts"), is_revisit, F.col("record_id"), F.col("__h0"), F.col("__h1")]
    inside = slim.withColumn("__own", F.last(answer, True).over(W.partitionBy("__url", "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    ends = slim.groupBy("__url", "__bucket").agg(F.max(F.when(is_response, F.struct("__ts", "record_id", "__h0", "__h1", "etag", "last_modified"))).alias("__end"))
    ahead = ends.select(F.col("__url").alias("__u"), F.col("__bucket").alias("__b"), F.last("__end", True).over(W.partitionBy("__url").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    revisits = inside.where(is_revisit).join(ahead, (F.col("__url") == F.col("__u")) & (F.col("__bucket") == F.col("__b")))
    before = F.when(F.col("__before").isNotNull(), F.struct(*[F.col(f"__before.{c}").alias(c) for c in ("record_id", "__h0", "__h1", "etag", "last_modified")]))
    found = revisits.withColumn("__found", F.coalesce("__own", before))
    tags = F.col("etag").isNotNull() & F.col("__found.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("__found.last_modified").isNotNull()
    status = (
        F.when(F.col("__found").isNull(), "missing")
        .when(tags, F.when(_tag(F.col("etag")) == _tag(F.col("__found.etag")), "resolved").otherwise("changed"))
        .when(dates, F.when(F.col("last_modified") == F.col("__found.last_modified"), "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    wanted = [F.when(status == "resolved", F.col(f"__found.__h{i}")).alias(f"__w{i}") for i in range(2)]
    decided = found.select("record_id", "url", "ts", F.col("headers").alias("__new"), F.col("__found.record_id").alias("response_id"), status.alias("status"), *wanted)
    lost = dealt.where(is_revisit & ~good).select("record_id", "url", "ts", F.col("headers").alias("__new"), F.lit("missing").alias("status"))
    counted = decided.unionByName(lost, allowMissingColumns=True)
    # equal rows are stored once; dealt by more than the join's key, so that the join has shuffles of its own that can be split
    stored = named.where(is_response & good).select(F.col("__ts").alias("__at"), *[n.alias(f"__h{i}") for i, n in enumerate(names)], F.col("headers").alias("__old"), F.col("body").alias("__body")).dropDuplicates(["__at", "__h0", "__h1"])
    both = counted.join(stored, (F.col("__w0") == F.col("__h0")) & (F.col("__w1") == F.col("__h1")), "left")
    done = F.col("status") == "resolved"
    return both.select("record_id", "url", "ts", "response_id", "status", F.when(done, merged_headers(F.col("__old"), F.col("__new"))).alias("headers"), F.when(done, F.col("__body")).alias("body"))


def page_records(pages: DataFrame) -> DataFrame:
    """The pages as an archive: a full response of each, and a later revisit of its URL, by rules of page_id alone.

    The response of page p is record 2p at second 100p, with the digest of its body as entity tag
    (each fifth has none) and a last-modified date; its revisit is record 2p + 1 at second
    100p + 5050, under the other scheme, whose weak tag repeats that of the response but for each
    seventh, which has another.
    """
    p = F.col("page_id").cast("bigint")
    etag = F.when(p % 5 != 0, F.md5(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    date = F.concat(F.lit("day "), (p % 11).cast("string"))
    response = pages.select(
        (2 * p).alias("record_id"), F.lit("response").alias("kind"), F.col("url"), (100 * p).alias("ts"), etag.alias("etag"), date.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), (100 * p).cast("string"), F.lit("Age"), F.lit("0")).alias("headers"), F.coalesce("html", F.lit("")).alias("body"),
    )
    other = F.when(F.col("url").startswith("https://"), F.concat(F.lit("http://"), F.substr("url", F.lit(9)))).otherwise(F.regexp_replace("url", "^http://", "https://"))
    revisit = pages.select(
        (2 * p + 1).alias("record_id"), F.lit("revisit").alias("kind"), other.alias("url"), (100 * p + 5050).alias("ts"), F.concat(F.lit("W/"), F.when(p % 7 == 0, F.lit("other")).otherwise(etag)).alias("etag"), date.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("date"), (100 * p + 5050).cast("string"), F.lit("x-cache"), F.lit("hit")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return response.unionByName(revisit)


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive of responses and revisits: each revisit with what it renews."""
    found = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "url", "ts", "response_id", "status", headers.alias("headers"), F.length("body").cast("bigint").alias("body_chars"), F.md5(F.encode("body", "UTF-8")).alias("body_md5"))


OP7_SQL = r"""
WITH p AS (SELECT page_id::BIGINT AS p, url, coalesce(html, '') AS body, CASE WHEN page_id % 5 <> 0 THEN md5(coalesce(html, '')) END AS tag, 'day ' || (page_id % 11)::VARCHAR AS day FROM pages),
parts AS (SELECT *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM p),
canon AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS query FROM parts),
named AS (SELECT *, base || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS c FROM canon),
hits AS (
  SELECT v.p AS p, r.p AS rp, r.tag AS rtag, r.day AS rday, r.body AS rbody FROM named v JOIN named r ON v.c = r.c AND r.p * 100 <= v.p * 100 + 5050),
best AS (SELECT p, max(rp) AS rp FROM hits GROUP BY p),
found AS (SELECT named.p, named.url, CASE WHEN named.p % 7 = 0 THEN 'other' ELSE named.tag END AS vtag, named.day AS vday, h.rp, h.rtag, h.rday, h.rbody
  FROM named LEFT JOIN (SELECT hits.* FROM hits JOIN best USING (p, rp)) h ON named.p = h.p),
judged AS (SELECT *, CASE WHEN rp IS NULL THEN 'missing' WHEN vtag IS NOT NULL AND rtag IS NOT NULL THEN CASE WHEN vtag = rtag THEN 'resolved' ELSE 'changed' END
  WHEN vday = rday THEN 'resolved' ELSE 'changed' END AS status FROM found)
SELECT 2 * p + 1 AS record_id, CASE WHEN starts_with(url, 'https://') THEN 'http://' || substr(url, 9) ELSE regexp_replace(url, '^http://', 'https://') END AS url, 100 * p + 5050 AS ts, 2 * rp AS response_id, status,
  CASE WHEN status = 'resolved' THEN 'age=0;content-type=text/html;date=' || (100 * p + 5050)::VARCHAR || ';x-cache=hit' END AS headers,
  CASE WHEN status = 'resolved' THEN length(rbody) END AS body_chars, CASE WHEN status = 'resolved' THEN md5(rbody) END AS body_md5
FROM judged
"""
