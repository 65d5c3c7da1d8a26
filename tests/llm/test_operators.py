import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import chunks, dedup, fingerprint, html, mixing, packing, quality, rules, tokens, urls, warc
from glyphmill.llm.common import bucket_of, dealt_bucket, key_bounds, lean, small_table, words_of
from glyphmill.llm.queries import oracle_sql, queries

from .fixtures import DOCS, LONG, NEAR, PROSE, ROWS, SF, documents, no_documents, save

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def sets(text, n=5):
    w = words_of(text or "")
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return save(documents(spark), tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return save(no_documents(spark), tmp_path_factory.mktemp("empty"))


# --- words shared by all ---


def test_words_are_parted_by_ascii_space_only():
    assert words_of("a\u00a0b c\x1cd\x0be\u2003f") == ["a\u00a0b".encode(), b"c\x1cd", "e\u2003f".encode()]


def test_a_worker_remembers_for_one_operator():
    """Workers serve one operator after the other: what one remembers is not held while another runs."""
    quality._MEMO.clear()
    quality.features("one two", quality.QualityOptions())
    encoder = chunks.encoder(BYTE)
    encoder.batch(["one two"])
    assert list(lean(iter, "quality")([])) == [] and len(quality._MEMO) == 2
    assert chunks.encoder.cache_info().currsize == 0
    encoder = chunks.encoder(BYTE)
    list(lean(iter, "pieces")([]))
    assert chunks.encoder(BYTE) is encoder and not quality._MEMO
    quality.features("one two", quality.QualityOptions())
    list(lean(iter)([]))
    assert not quality._MEMO and chunks.encoder.cache_info().currsize == 0


def test_small_tables_need_no_python_workers(spark, monkeypatch):
    """Lists of rows would pass through Python workers of a second kind, whose daemons stay in the executors."""
    schema = pa.schema([("name", pa.string()), ("rank", pa.int32()), ("size", pa.int64()), ("target", pa.float64())])
    rows = [("b", 1, 1 << 40, 0.5), (None, 2, 0, 1.5), ("b", 1, 1 << 40, 0.5)]
    made = small_table(spark, rows, schema)
    assert sorted(map(tuple, made.collect()), key=str) == sorted(rows, key=str) and small_table(spark, [], schema).collect() == []
    assert [f.dataType.simpleString() for f in made.schema] == ["string", "int", "bigint", "double"]
    assert "Python" not in made._jdf.queryExecution().toRdd().toDebugString()
    given, create = [], type(spark).createDataFrame
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: given.append(type(data)) or create(self, data, *a, **b))
    quality.learn(docs, labels)
    mixing.mix(docs).count()
    mixing.mixed_documents(docs).count()
    assert len(given) == 4 and set(given) == {pa.Table}


def test_bucket_of_is_ascending(spark):
    import bisect

    for bounds in ([], [0], [0, 4, 9], [-2, -2, 3, 3, 3, 8], list(range(-1000, 1000, 7))):
        rows = spark.range(-12, 12).select("id", bucket_of(F.col("id"), bounds).alias("b")).collect()
        assert [r["b"] for r in rows] == [bisect.bisect_right(bounds, r["id"]) for r in rows]
    assert spark.sql("select cast(null as bigint) id").select(bucket_of(F.col("id"), [0])).first()[0] == 0


def test_dealt_bucket_splits_hot_keys(spark):
    ids = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("h"))
    bounds = key_bounds(ids, "k", 30)
    rows = ids.select("k", "h", dealt_bucket(F.col("k"), F.col("h"), bounds).alias("b")).collect()
    rows.sort(key=lambda r: (r["k"] is not None, r["k"] or 0, r["h"]))
    got = [r["b"] for r in rows]
    assert got == sorted(got) and min(got) >= 0 and max(got) <= 29 and max(Counter(got).values()) < 250


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_dart_minhash_estimates_jaccard(similarity):
    rng, found, true = np.random.default_rng(5), [], []
    for _ in range(30):
        n = 200
        common = int(2 * n * similarity / (1 + similarity))
        base = rng.integers(1, 2**63, 2 * n - common, dtype=np.uint64)
        a, b = (dedup.dart_minhash(x, np.ones(n), 140) for x in (base[:n], base[n - common :]))
        found.append((a == b).mean())
        true.append(common / (2 * n - common))
    assert abs(np.mean(found) - np.mean(true)) < 0.03


def test_dart_minhash_estimates_weighted_jaccard():
    rng, found, true = np.random.default_rng(6), [], []
    for _ in range(40):
        e = rng.integers(1, 2**63, 100, dtype=np.uint64)
        w = rng.integers(1, 9, 100).astype(float)
        v = np.maximum(1, w + rng.integers(-3, 4, 100))
        found.append((dedup.dart_minhash(e, w, 140) == dedup.dart_minhash(e, v, 140)).mean())
        true.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(found) - np.mean(true)) < 0.03


def counted(text, n=5):
    w = words_of(text or "")
    return Counter([tuple(w)] if 0 < len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


def components(texts, weights="count"):
    """The classes by brute force: all pairs, by the weighted or the plain Jaccard similarity."""
    ids, up = list(texts), {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    made = {i: counted(t) if weights == "count" else Counter(set(counted(t))) for i, t in texts.items()}
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if made[a] and made[b] and not made[a].keys().isdisjoint(made[b]) and (made[a] & made[b]).total() >= 0.8 * (made[a] | made[b]).total():
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_op1_equals_brute_force(spark):
    got = {r["doc_id"]: r["class_id"] for r in dedup.op1_dart_minhash(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == components(texts)


@pytest.mark.parametrize("weights", ["count", "set"])
def test_op1_weighs_repeated_shingles(spark, weights):
    """Texts that repeat their lines another number of times are alike as sets, but not by how often shingles occur."""
    rng = random.Random(3)
    rows = []
    for i in range(12):
        line = " ".join(f"w{i}x{j}" for j in range(40))
        rows += [(10 * i + k, "\n".join([line] * n + [f"tail {rng.randrange(9)} of it"])) for k, n in enumerate((1, 2, 3, 9, 10, 30))]
    got = {r["doc_id"]: r["class_id"] for r in dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), dedup.DedupOptions(weights=weights)).collect()}
    assert got == components(dict(rows), weights)
    assert (got[3] == got[4]) and (got[1] == got[5]) == (weights == "set")


def test_rare_pairs_lose_no_link(spark):
    """The prefix filter gives every pair that is similar enough, and nothing of one root."""
    rng = random.Random(4)
    texts = {}
    for i in range(150):
        base = [f"b{i % 5}x{j}" for j in range(60)]
        for j in rng.sample(range(60), rng.randrange(7)):
            base[j] = rng.choice("pqrs")
        texts[i] = " ".join(base * rng.choice((1, 1, 2)))
    options = dedup.DedupOptions()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    nodes = dedup.signed(docs, options)
    sets_ = dedup.shingle_sets(docs, nodes.select("node"), options)
    got = {tuple(sorted((bytes(r["a"]), bytes(r["b"])))) for r in dedup.rare_pairs(nodes.select("node", "size", F.col("node").alias("root")), sets_, options).collect()}
    want = set()
    of = {hashlib.md5(t.encode()).digest(): counted(t) for t in texts.values()}
    for a in of:
        for b in of:
            if a < b and (of[a] & of[b]).total() >= 0.8 * (of[a] | of[b]).total():
                want.add((a, b))
    assert want and want <= got and len(got) < len(of) * (len(of) - 1) // 2
    one = nodes.select("node", "size", F.lit(b"r").alias("root"))
    assert dedup.rare_pairs(one, sets_, options).count() == 0


def test_op1_finds_links_that_no_hub_has(spark):
    """Near copies of one base with many edits each: few are near the hub, some pairs are near each other."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(150), 1 + i % 6):
            words[j] = f"e{i}x{j}"
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(words[:-1] + ["tail"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dedup.classes(docs).collect()}
    assert got == components(dict(rows))


def test_op1_odd_cases(spark, odd, empty):
    rows = dedup.op1_dart_minhash(spark, odd).collect()
    assert len(rows) == len(ROWS)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r["class_id"])
    assert by[1] == by[2] == [1] and by[14] == [1, 1] and by[4] == by[3] == [3] and by[10] == [9]
    assert by[5] == [5] and by[6] == [6] and by[7] == [7] and sorted(by[12]) == [12, 12, 12]
    assert dedup.op1_dart_minhash(spark, empty).count() == 0
    kept = dedup.keep_one(documents(spark))
    assert kept.columns == DOCS.names
    left = Counter(r["doc_id"] for r in kept.collect())
    assert left[1] == 1 and not left[2] and not left[14] and left[3] == 1 and not left[4] and left[5] == left[6] == 1 and left[12] == 2
    assert dedup.keep_one(no_documents(spark)).count() == 0


# --- 2: quality rules ---


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_equal_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(2)
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(200)] + [t for _, t, *_ in ROWS if t is not None and len(t) < 1000]
    for t in texts:
        assert rules.base_counts(t) == brute_counts(t)


def test_js_distance():
    a, b = np.array([1.0, 1, 0]), np.array([0.0, 0, 5])
    assert rules.js_distance(a, a) == 0 and rules.js_distance(a, b) == pytest.approx(1)
    assert rules.js_distance(a, np.zeros(3)) == 0


def test_op2_keeps_prose_and_drops_junk(spark, odd, empty):
    rows = {r["doc_id"]: r for r in rules.op2_divergence_rules(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [rows[i] for i, q in labels.items() if q == 1 and not rows[i]["base_failed"]]
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in rows.values())
    assert np.mean([r["kept"] for r in good]) > 0.98
    bad = [rows[i] for i, q in labels.items() if q == 0 and rows[i]["n_words"] > 200]
    assert not any(r["kept"] for r in bad)
    made = rules.op2_divergence_rules(spark, odd).collect()
    assert len(made) == len(ROWS)
    assert not next(r for r in made if r["doc_id"] == 5)["kept"]
    assert rules.op2_divergence_rules(spark, empty).count() == 0
    assert rules.keep_good(documents(spark)).columns == DOCS.names and rules.keep_good(no_documents(spark)).count() == 0


def test_op2_judges_short_documents_by_common_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    references = rules.language_references(docs)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in rules.judge(docs, references).collect() if not r["base_failed"] and 40 <= r["n_words"] < 200]
    assert np.mean([r["kept"] for r in rows if labels.get(r["doc_id"]) == 1]) > 0.97
    assert sum(r["kept"] for r in rows if labels.get(r["doc_id"]) == 0) <= 1
    rng = random.Random(5)
    options = rules.RuleOptions()
    prose = " ".join(r["text"] for r in docs.where("lang = 'en'").orderBy("doc_id").limit(200).collect() if labels.get(r["doc_id"]) == 1).split()
    for n in (60, 80, 100, 120, 150, 199, 200, 400):  # word salad in letters like those of prose: only the common words tell
        salad = ["".join(rng.sample(w, len(w))) + "q" for w in rng.sample(prose, n)]
        kept, chars, words = rules.verdict(" ".join(salad), "en", references.by_name, options)
        assert not kept and chars <= options.max_char_distance and words > rules.word_limit(n, options)
        assert rules.verdict(" ".join(prose[:n]), "en", references.by_name, options)[0]
    limits = [rules.word_limit(n, options) for n in range(1, 300)]
    assert limits == sorted(limits, reverse=True) and limits[-1] == options.max_word_distance


def _prose(rng, words, n):
    return " ".join(rng.choices(words, k=n))


def test_op2_verdicts_equal_brute_force(spark):
    """Distances and verdicts of the whole query, by the formulas in plain loops."""
    import unicodedata

    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    options, places = rules.RuleOptions(), list(dict.fromkeys(rules.COMMON_WORDS))

    def kind(c):
        if c in rules.SYMBOLS or c in ".,":
            return "symbol" if c in rules.SYMBOLS else "stop"
        if c in " \t\x0b\x0c\n\r":
            return "line" if c in "\n\r" else "space"
        k = unicodedata.category(c)
        by = {"Ll": "lower" if c < "\x80" else "accented lower", "Lu": "upper" if c < "\x80" else "accented upper", "Lt": "accented upper", "Lo": "letter", "Lm": "letter", "Nd": "digit", "Nl": "digit", "No": "digit", "Zs": "space", "Zl": "line", "Zp": "line"}
        return by.get(k, {"P": "punctuation", "S": "symbol", "M": "mark"}.get(k[0], "other"))

    def counts(text):
        words = Counter()
        for w in text.lower().split():
            words[w if w in places else w.strip(".,;:!?") if w.strip(".,;:!?") in places else None] += 1
        return Counter(map(kind, text)), words

    def distance(a, b):
        n, m, total = sum(a.values()), sum(b.values()), 0.0
        for k in {*a, *b} if n and m else ():
            p, q = a[k] / n, b[k] / m
            total += sum(x * math.log2(2 * x / (p + q)) for x in (p, q) if x)
        return math.sqrt(max(0.0, total / 2))

    passed = {i: not rules.base_failed(rules.base_counts(t), options) for i, t, _ in docs}
    sums = defaultdict(lambda: (Counter(), Counter()))
    for i, t, lang in docs:
        if passed[i]:
            for s, c in zip(sums[lang], counts(t), strict=True):
                s.update(c)
    got = {r["doc_id"]: r for r in rules.op2_divergence_rules(spark, SF).collect()}
    for i, t, lang in docs:
        own = counts(t)
        ref = [s - c if passed[i] else s for s, c in zip(sums[lang], own, strict=True)]
        assert ref[1].total() >= options.min_support
        chars, words = distance(own[0], ref[0]) if len(t) >= options.min_chars else 0.0, distance(own[1], ref[1])
        assert got[i]["char_distance"] == pytest.approx(chars, abs=1e-6) and got[i]["word_distance"] == pytest.approx(words, abs=1e-6)
        assert got[i]["kept"] == (passed[i] and chars <= options.max_char_distance and words <= rules.word_limit(own[1].total(), options))


def test_op2_judges_none_by_itself(spark):
    """Junk that is alone in its language is not its own reference; clean text of a small or no language has the nearest one."""
    rng = random.Random(2)
    english, german = [["the", "of", "and", "to", "in", "is", "that", "house", "garden", "river"], ["der", "die", "und", "das", "ist", "nicht", "haus", "garten", "fluss", "wald"]]
    junk = " ".join("".join(rng.choices("bcdfgh#*%0123", k=9)) for _ in range(400))
    rows = [(i, _prose(rng, english, 300), "en") for i in range(20)] + [(100 + i, _prose(rng, german, 300), "de") for i in range(20)]
    rows += [(200, junk, "xx"), (201, junk[::-1], "en"), (202, _prose(rng, german, 300), None), (203, _prose(rng, german, 300), "yy"), (204, _prose(rng, english, 300), "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for options in (rules.RuleOptions(), rules.RuleOptions(broadcast_languages=2), rules.RuleOptions(broadcast_languages=1)):
        got = {r["doc_id"]: r["kept"] for r in rules.judge(docs, rules.language_references(docs, options), options).collect()}
        assert {i for i, kept in got.items() if not kept} - ({202, 203} if options.broadcast_languages == 1 else set()) == {200, 201} and len(got) == len(rows)
        assert {r["doc_id"] for r in rules.keep_good(docs, options).collect()} == {i for i, kept in got.items() if kept}


def test_op2_references_of_any_number_of_languages(spark):
    """Beyond those broadcast, references are joined: the verdicts are the same."""
    rng = random.Random(6)
    rows = []
    for lang in range(30):
        words = [f"l{lang}w{j}" for j in range(20)] + ["the", "de", "und"][lang % 3 : lang % 3 + 1] * 5
        rows += [(100 * lang + i, _prose(rng, words, 400), f"l{lang}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = []
    for n in (100, 4):
        options = rules.RuleOptions(broadcast_languages=n, max_repeat_percent=100)
        references = rules.language_references(docs, options)
        assert len(references.by_name) == min(n, 30) and (references.others is None) == (n == 100)
        got.append(sorted(map(tuple, rules.judge(docs, references, options).collect())))
    assert got[0] == got[1] and len(got[0]) == len(rows)


# --- 3: packing ---


def test_best_fit_decreasing_equals_one_by_one():
    rng = random.Random(4)
    for size, n in ((64, 400), (1024, 600), (5, 40)):
        lengths = [rng.choice([rng.randint(1, size), size, rng.randint(1, max(1, size // 6))]) for _ in range(n)]
        plan, bins = packing.best_fit_decreasing(dict(Counter(lengths)), size)
        rooms = []
        for x in sorted(lengths, reverse=True):
            i = bisect.bisect_left(rooms, x)
            left = (rooms.pop(i) if i < len(rooms) else size) - x
            bisect.insort(rooms, left)
        assert bins == len(rooms)
        spans = defaultdict(list)
        for p in plan:
            for r in range(p.count):
                spans[p.bin + r // p.each].append((p.offset + r % p.each * p.length, p.length))
        for s in spans.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= size


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    left = Counter()
    for doc_id, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cut, start = len(ids) % 1024 or 1024, 0
        for piece, stop in enumerate(range(cut, len(ids) + 1, 1024)):
            left[doc_id, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
            start = stop
    assert left == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(spans) <= math.ceil(sum(n for s in spans.values() for _, n in s) / 1024) * 1.02 + 1


def test_op3(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(packing.op3_best_fit_packing(spark, SF).collect(), docs)
    check_packing(packing.op3_best_fit_packing(spark, odd).collect(), [(r[0], r[1]) for r in ROWS])
    assert packing.op3_best_fit_packing(spark, empty).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    docs = documents(spark).where("doc_id < 9")
    rows = packing.pack_documents(docs, BYTE, with_ids=True).collect()
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(packing.pack_documents(docs, BYTE, with_ids=True)).collect()}
    assert sum(map(len, made.values())) == sum(r["length"] for r in rows) and max(map(len, made.values())) <= 1024


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_pieces_equal_whole_texts(path):
    rng = random.Random(1)
    atoms = ["a", "The", " ", "  ", "\n", " \n", "'s", "'", "É", "İ", "e\u0301", " \u0301", "12", "½", "<|endoftext|>", "\u3000", "\xa0", "\x1c", "\t", "don't", "中文", "😀", ".", "!!!", "|", "_"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(14))) for _ in range(3000)]
    encoder = chunks.ChunkEncoder(path)
    assert encoder.batch(texts) == [encoder.whole(t) for t in texts]


# --- 4: mixing ---


def test_targets_share_the_excess():
    sizes, weights = [100, 1000, 1000], [5, 2, 1]
    got = mixing.targets(sizes, weights, 1.5, 2)
    assert got[0] == 200 and got[1] == pytest.approx(2 * (3150 - 200) / 3) and sum(got) == pytest.approx(3150)
    assert mixing.targets([], [], 1.5, 2) == [] and mixing.targets([0, 10], [5, 2], 1.5, 2) == [0, 15]


def test_shard_counts_add_up_to_the_quotas():
    options, quotas = mixing.MixOptions(shard_blocks=500), [1000, 0, 37, 5000]
    n = mixing.n_shards(quotas, options)
    made = [mixing.shard_counts(quotas, i, n, options) for i in range(n)]
    assert n == 13 and sum(c for c, _ in made).tolist() == quotas and all(abs(int(c.sum()) - 6037 / 13) <= 1 for c, _ in made)
    before = np.zeros(4, np.int64)
    for counts, ahead in made:  # each shard knows those before it without drawing them
        assert ahead.tolist() == before.tolist() and (counts >= 0).all()
        before += counts
    assert np.std([c[0] for c, _ in made]) > 1  # drawn, not dealt out evenly


def test_shards_are_not_bounded(spark):
    options = mixing.MixOptions(shard_blocks=2, block=1)
    sources = [mixing.Source("a", 0, 9000, 9000.0, 9000, 9000), mixing.Source(None, 1, 300, 600.0, 300, 600)]
    rows = mixing.mixture(spark, sources, options).collect()
    assert max(r["shard"] for r in rows) == 4799 and Counter((r["rank"], r["block"]) for r in rows) == Counter({(0, i): 1 for i in range(9000)} | {(1, i): 2 for i in range(300)})


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000])
def test_permutations(n):
    got = mixing.permuted(np.arange(n), n, 12345)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 1000 or np.corrcoef(got, np.arange(n))[0, 1] < 0.2


def test_op4(spark, odd, empty):
    first, second = (sorted(map(tuple, mixing.op4_multinomial_mix(spark, SF).collect())) for _ in range(2))
    assert first == second
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = defaultdict(list)
    for doc_id, size, source_size, target, taken in first:
        assert size == len(words_of(docs[doc_id]["text"] or "")) and 0 <= taken <= 2 * size
        by[docs[doc_id]["source"]].append((size, source_size, target, taken))
    for rows in by.values():
        assert sum(r[0] for r in rows) == rows[0][1]
        assert abs(sum(r[3] for r in rows) - rows[0][2]) <= 129
    rows = mixing.op4_multinomial_mix(spark, odd).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.op4_multinomial_mix(spark, empty).count() == 0


def test_mixed_documents_hold_what_the_mix_takes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got, seen = mixing.mixed_documents(docs), Counter()
    assert got.columns == docs.columns
    for r in got.collect():
        seen[r["doc_id"]] += len(words_of(r["text"]))
        assert r["n_chars"] == len(r["text"]) and all(part in texts[r["doc_id"]] for part in r["text"].split("\n"))
    assert {i: n for i, n in taken.items() if n} == dict(seen)
    odd_rows = mixing.mixed_documents(documents(spark)).collect()
    total = sum(r["taken"] for r in mixing.mix(documents(spark)).collect())
    assert sum(len(words_of(r["text"])) for r in odd_rows) == total
    assert mixing.mixed_documents(no_documents(spark)).count() == 0


def test_blocks_of_a_mix_are_not_broadcast(spark):
    """The planner takes the blocks of a mix for a few bytes: they must not go through the driver, however many they are."""
    docs, key = spark.read.parquet(f"{SF}/documents.parquet"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "1k")  # less than any table of documents here
    try:
        for made in (mixing.mix(docs), mixing.mixed_documents(docs)):
            assert made.collect()
            plan = made._jdf.queryExecution().executedPlan().toString()
            joins = [line for line in plan.splitlines() if "Join [" in line and "__block#" in line]
            assert joins and not any("Broadcast" in line for line in joins)
    finally:
        spark.conf.unset(key)


# --- 5: quality classifier ---


def test_op5_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in quality.op5_neighbour_votes(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in rows.items())
    held = [i for i in labels if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) > 0.95


def _plain_features(text, options):
    """The features of a text by loops over its words."""
    import re as std

    out, words, half = np.zeros(options.terms), re.findall(r"[^\x20\x09-\x0D]+", text or ""), options.terms // 2
    if not words:
        return out
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    lines = [x for x in text.split("\n") if x]
    marks = {b"again": sum(a == b for a, b in zip(words, words[1:], strict=False)), b"window": len(windows) - len(set(windows)), b"line": (len(lines) - len(set(lines))) * len(words) // max(1, len(lines))}
    for name, n in marks.items():
        out[zlib.crc32(b"r" + name) % half] += n
    for w in words:
        shape = std.sub(r"[A-ZÀ-ÖØ-Þ]+", "X", w)
        shape = std.sub(r"[^\W\d_A-ZÀ-ÖØ-ÞX]+", "x", shape)
        shape = std.sub(r"(.)\1+", r"\1", std.sub(r"\d+", "0", shape))
        out[zlib.crc32(("s" + shape).encode()) % half] += 1
        out[half + zlib.crc32(("w" + w.lower().strip(".,;:!?#*$%&|<>\"'()")).encode()) % half] += 1
    for part, share in ((slice(0, half), 1 - options.words_share), (slice(half, None), options.words_share)):
        out[part] = np.sqrt(out[part] / out[part].sum() * share)
    return out


def test_op5_equals_brute_force(spark):
    """The whole query against dense features, a full decomposition and a sort of all similarities."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    options = quality.QualityOptions()
    known = sorted(i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 3 != 1)
    raw = {i: _plain_features(t, options) for i, t in docs.items()}
    sample = np.array([raw[i] for i in known])
    idf = np.log((1 + len(known)) / (1 + (sample > 0).sum(axis=0))) + 0.1
    _, _, right = np.linalg.svd(sample * idf, full_matrices=False)
    basis = right[: min(options.dimensions, len(known))].T

    def latent(x):
        v = (x * idf) @ basis
        return v / max(np.linalg.norm(v), 1e-12)

    vectors, marks = np.array([latent(x) for x in sample]), np.array([labels[i] for i in known], float)
    got = {r["doc_id"]: r["score"] for r in quality.op5_neighbour_votes(spark, SF).collect()}
    errors = []
    for i, x in raw.items():
        near = vectors @ latent(x)
        best = np.argsort(-near)[: options.neighbours]
        weight = np.maximum(near[best], 0)
        errors.append(abs(got[i] - (weight @ marks[best] / weight.sum() if weight.sum() else marks.mean())))
    # the decomposition of the query is a randomized one: few neighbours at the edge of the k change
    assert got.keys() == raw.keys() and np.median(errors) < 0.01 and np.mean(np.array(errors) > 0.1) < 0.03


def test_op5_odd_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (None, 1), (9, None), (77, 0), (12, 1)], "doc_id long, quality int")
    model = quality.learn(documents(spark), labels)
    got = quality.score(documents(spark), model, "own").collect()
    assert len(got) == len(ROWS) and all(0 <= r["own"] <= 1 for r in got)
    none = quality.learn(documents(spark), labels.limit(0))
    assert {r["own"] for r in quality.score(documents(spark), none, "own").collect()} == {0.5}
    assert quality.keep_good(no_documents(spark), labels).count() == 0
    assert quality.keep_good(documents(spark), labels).columns == DOCS.names


def test_op5_takes_terms_from_all_of_long_words():
    def terms(text):
        found, weights = quality.features(text, quality.QualityOptions())
        return dict(zip(found.tolist(), weights.tolist(), strict=True))

    rng = random.Random(4)
    han = "".join(chr(0x4E00 + rng.randrange(500)) for _ in range(400))
    for head, tail, other in ((han, han[::-1], "、".join(han[:90])), ("x" * 70, "A1" * 300, "b/" * 300), (("ab\u3000cd\u00a0" * 20), "ef gh", "\u3000".join(["good"] * 40))):
        assert terms(head) != terms(head + tail) != terms(head + other) != terms(head)
    assert terms("\u3000".join(["one", "two"] * 40)) == terms("\u00a0".join(["two", "one"] * 40))
    assert terms("a.1" * 20 + "b") != terms("a.1" * 20 + "2")  # shapes that differ at their end only
    start = "".join(rng.choice("abcdefgh") for _ in range(80))
    assert len(terms(start + "".join(map(chr, range(0x3041, 0x3091))))) > len(terms(start)) + 40
    big = "".join(chr(0x4E00 + i % 20000) for i in range(100_000))
    assert terms(big) and len(quality._MEMO) <= (1 << 16) + 1 and max(map(len, quality._MEMO)) <= 4 * quality.LONGEST


def test_scores_are_exact_nearest_neighbours():
    rng = np.random.default_rng(3)
    options = quality.QualityOptions(terms=64, dimensions=8, neighbours=5)
    rows = [(np.sort(rng.choice(64, 6, replace=False)), rng.random(6), int(rng.integers(2))) for _ in range(60)]
    model = quality.fit(rows, options)
    latent = model.latent([(t, w) for t, w, _ in rows[:20]])
    for i, s in enumerate(model.scores([(t, w) for t, w, _ in rows[:20]])):
        near = latent[i] @ model.vectors.T
        best = np.flatnonzero(near >= np.sort(near)[-5])
        weight = np.maximum(near[best], 0).astype(float)
        assert s == pytest.approx((weight * model.labels[best]).sum() / weight.sum(), abs=1e-4)


# --- 6: URL filters ---


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    from pyspark.sql import functions as F

    listed = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    n = urls.blocks_for(2000)
    blocks = urls.bloom_blocks(listed, n)
    probe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    hit = probe.join(blocks, urls.bloom_place(F.col("key"), n) == F.col("__block")).where(urls.bloom_hit(F.col("key")))
    keys = {r["key"] for r in hit.collect()}
    assert {f"k{i}" for i in range(2000)} <= keys and len(keys) < 2000 + 18000 * 0.02


def test_url_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "example.com/en/": ("", "", None), "http://": ("", "", None), "HTTP://A.Example.COM/en/7?x": ("a.example.com", "/en/7", "example.com/en/7"),
        "x://com/en/": ("com", "/en/", "com/en/"), "x://xcom/en/": ("xcom", "/en/", None), "http://b.net/de/8#f": ("b.net", "/de/8", "net/de/"), "http://example.net/de/80": ("example.net", "/de/80", "example.net/de/8"),
        "http://a.org?q=/es/": ("a.org", "", None), "http://ex.org/es/x://y": ("ex.org", "/es/x://y", "org/es/"), "http://É.com/en/": ("É.com", "/en/", "com/en/"), "http://a.com/EN/": ("a.com", "/EN/", None),
    }
    listed = spark.createDataFrame([(k, a, 1) for k, a in urls.RULES] + [(None, "block", 1)], "key string, action string, rank int")
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(cases)] + [(0, None, "x", "x")], "page_id long, url string, key string, host string")
    rows = urls.filter_urls(pages, listed).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        want = list(cases.values())[r["page_id"]]
        assert (r["host"], r["path"], r["listed_key"]) == want
    assert urls.filter_urls(pages.limit(0), listed).count() == 0
    assert {r["listed_key"] for r in urls.filter_urls(pages, listed.limit(0)).collect()} == {None}


def test_url_filter_on_odd_rows(spark):
    """Many rows without URL or of one URL, a very long one, repeated rows and columns of the operator's own names."""
    long = "http://a.Example.COM/en/7" + "x/" * 50_000 + "?q"
    rows = [(i, None) for i in range(60)] + [(i, "http://hot.org/es/1") for i in range(60)] + [(1, long), (1, long), (None, "HTTP://x.net/de/"), (2, "no scheme"), (3, "://"), (4, "http://EXAMPLE.net/de/8#f"), (5, "http://org/es"), (6, "http://é.org/es/ü")]
    pages = spark.createDataFrame([(i, u, "x", "x", "x", 1, "x") for i, u in rows], "page_id long, url string, host string, path string, key string, rank int, __candidate string")
    listed = spark.createDataFrame([(k, a, 1) for k, a in urls.RULES] + [("org/", "allow", 0), (None, "block", 2), ("com/en/", "allow", 0)], "key string, action string, rank int")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = []
        for k, act, rank in [(k, act, 1) for k, act in urls.RULES] + [("org/", "allow", 0), ("com/en/", "allow", 0)]:
            khost, _, kpath = k.partition("/")
            if (host == khost or host.endswith(f".{khost}")) and path.startswith(f"/{kpath}"):
                fits.append((rank, len(k), act, k))
        best = max(fits, default=(None, None, None, None))
        return host, path, best[3], best[2], best[0]

    got = Counter((r["page_id"], r["host"], r["path"], r["listed_key"], r["action"], r["rank"]) for r in urls.filter_urls(pages, listed).collect())
    assert got == Counter((i, *brute(u)) for i, u in rows)
    assert urls.filter_urls(pages.limit(0), listed).count() == 0 and {r["action"] for r in urls.filter_urls(pages, listed.limit(0)).collect()} == {None}


# --- 7: revisits ---


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.A.com/x/", 10, '"e1"', None, {"Content-Type": "text/html", "Date": "d1", "Age": "1"}, "one"),
        (2, "response", "https://a.com/x?utm_source=q#f", 20, 'W/"e2"', "m", {"date": "d2"}, "two"),
        (3, "revisit", "http://a.com/x", 15, 'W/"e1"', None, {"CONTENT-TYPE": "bad", "date": "new", "ETag": "e"}, None),
        (4, "revisit", "http://a.com/x", 25, '"e1"', None, {}, None), (5, "revisit", "http://a.com/x", 20, '"e2"', None, None, None), (6, "revisit", "http://a.com/x", 5, '"e1"', None, {}, None),
        (7, "revisit", "http://a.com/x", 30, None, "m", {}, None), (8, "revisit", "http://a.com/x", 30, None, None, {}, None), (9, "revisit", None, 30, "e", None, {}, None), (10, "revisit", "http://b.com", None, "e", None, {}, None),
        (11, "metadata", "http://a.com/x", 1, None, None, {}, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, body string")
    for parts in (1, 3, 8):
        got = {r["record_id"]: r for r in warc.resolve_revisits(records, parts).collect()}
        assert {i: (r["status"], r["response_id"]) for i, r in got.items()} == {3: ("resolved", 1), 4: ("changed", 2), 5: ("resolved", 2), 6: ("missing", None), 7: ("resolved", 2), 8: ("unchecked", 2), 9: ("missing", None), 10: ("missing", None)}
        assert got[3]["headers"] == {"content-type": "text/html", "age": "1", "date": "new", "etag": "e"} and got[3]["body"] == "one" and got[4]["body"] is None
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def test_revisits_of_ties_and_long_bodies(spark):
    """Of responses at one time the greatest record counts, a response at the revisit's own time is earlier, one hot URL is no matter."""
    body = "b" * 2_000_000
    rows = [
        (1, "response", "http://t.com/", 10, '"a"', None, {"x": "1"}, "one"), (2, "response", "https://www.t.com", 10, '"b"', None, {"x": "2"}, body), (3, "revisit", "http://t.com", 10, 'W/"b"', None, {"X": "3", "content-length": "9"}, None),
        (4, "revisit", "http://t.com", 9, '"b"', None, None, None), (5, "revisit", "http://t.com", 99, '"c"', None, {}, None), (6, "revisit", "http://t.com#x", 99, None, "d", {}, None), (7, "other", "http://t.com", 11, '"z"', None, {}, "z"),
        *[(100 + i, "revisit", "http://t.com?utm_source=x", 20 + i, '"b"', None, {}, None) for i in range(40)],
    ]
    schema = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, body string, status string, response_id string, __url string, __ts string, __bucket string, __h0 string"
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame([(*r, *["x"] * 6) for r in rows], schema), 5).collect()}
    assert got.keys() == {3, 4, 5, 6, *range(100, 140)}
    assert got[3]["response_id"] == 2 and got[3]["body"] == body and got[3]["headers"] == {"x": "3"} and got[4]["status"] == "missing"
    assert got[5]["status"] == "changed" and got[5]["body"] is None and got[6]["status"] == "unchecked" and all(got[i]["response_id"] == 2 and got[i]["status"] == "resolved" for i in range(100, 140))


def test_revisits_with_null_and_repeated_ids(spark):
    rows = [
        (None, "response", "http://a.com/x", 10, '"e1"', None, {"age": "1"}, "one"), (None, "response", "http://b.com/", 10, '"e2"', None, {"age": "2"}, "two"),
        (1, "response", "http://c.com/", 10, '"e3"', None, {"age": "3"}, "three"), (1, "response", "http://d.com/", 10, '"e4"', None, None, "four"), (1, "response", "http://d.com/", 10, '"e4"', None, None, "four"),
        (2, "response", "http://f.com/", 10, '"e5"', None, {}, None), (2, "response", "http://f.com/", 10, '"e5"', None, {}, "five"),
        (None, "revisit", "http://a.com/x", 20, '"e1"', None, {"date": "n1"}, None), (None, "revisit", "http://b.com/", 20, '"e2"', None, {"date": "n2"}, None), (None, "revisit", "http://e.com/", 20, '"e2"', None, {}, None),
        (7, "revisit", "http://c.com/", 20, '"e3"', None, {"date": "n3"}, None), (7, "revisit", "http://d.com/", 21, '"e4"', None, {}, None), (7, "revisit", "http://d.com/", 21, '"e4"', None, {}, None),
        (8, "revisit", None, 20, '"e3"', None, {}, None), (8, "revisit", None, 20, '"e3"', None, {}, None), (None, "revisit", "http://a.com/x", None, '"e1"', None, {}, None), (9, "revisit", "http://f.com/", 20, '"e5"', None, {}, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, body string")
    want = Counter([
        (None, "http://a.com/x", 20, None, "resolved", "n1", "one"), (None, "http://b.com/", 20, None, "resolved", "n2", "two"), (None, "http://e.com/", 20, None, "missing", None, None),
        (7, "http://c.com/", 20, 1, "resolved", "n3", "three"), *[(7, "http://d.com/", 21, 1, "resolved", None, "four")] * 2,
        *[(8, None, 20, None, "missing", None, None)] * 2, (None, "http://a.com/x", None, None, "missing", None, None),
    ])
    for parts in (1, 3):
        got = [(r["record_id"], r["url"], r["ts"], r["response_id"], r["status"], (r["headers"] or {}).get("date"), r["body"]) for r in warc.resolve_revisits(records, parts).collect()]
        tie = [r for r in got if r[0] == 9]
        assert len(tie) == 1 and tie[0][3:5] == (2, "resolved") and tie[0][6] in (None, "five")
        assert Counter(r for r in got if r[0] != 9) == want


# --- 8: fingerprints ---


def brute_oph(hashes):
    values = [None] * fingerprint.BINS
    for h in hashes:
        b, v = h >> fingerprint.VALUE_BITS, h & fingerprint.EMPTY
        values[b] = v if values[b] is None else min(v, values[b])
    out = list(values)
    for i, (stride, offset) in enumerate(fingerprint._walks()):
        for a in range(fingerprint.BINS):
            if out[i] is None and values[(stride * a + offset) % fingerprint.BINS] is not None:
                out[i] = values[(stride * a + offset) % fingerprint.BINS]
    return out


def test_bins_and_densification_equal_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, [rng.randrange(2**63) for _ in range(n)]) for i, n in enumerate([1, 2, 5, 40, 250, 2000])]
    df = spark.createDataFrame(rows, "i int, h array<bigint>")
    for r in df.select("i", fingerprint.densify(fingerprint.bins(F.col("h"))).alias("v")).collect():
        assert r["v"] == brute_oph(rows[r["i"]][1])


def by_hash(text):
    """The hash that ties of doc_id go by."""
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).astype(np.int64).item()


def test_op8(spark, odd, empty):
    for rows, found in ((fingerprint.op8_oph_fingerprints(spark, SF).collect(), [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]), (fingerprint.op8_oph_fingerprints(spark, odd).collect(), [(r[0], r[1] or "") for r in ROWS])):
        docs = sorted(found, key=lambda d: (d[0] is not None, d[0] or 0, by_hash(d[1]), d[1]), reverse=True)
        left = [tuple(r[k] for k in ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")) for r in rows]
        errors = []
        for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
            cut = len(t) // 3
            edited = t[: len(t) - cut] + after[:cut]
            row = next(r for r in left if r[:3] == (i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
            left.remove(row)
            errors += [row[3] - jaccard(sets(t), sets(edited)), row[4] - jaccard(sets(t), sets(after))] if t.split() else []
            assert 0 <= row[3] <= 1 and 0 <= row[4] <= 1
        assert not left and abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.05
    by = defaultdict(set)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in fingerprint.op8_oph_fingerprints(spark, SF).collect():
        by[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    assert fingerprint.op8_oph_fingerprints(spark, empty).count() == 0


# --- 9: token files ---


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 5000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        index = tokens.PerfectHash.build(keys)
        assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_shards_give_every_document_by_key():
    keys = [None, None, -3, 1, 1, 9]
    data = [np.array(x, "<u2").tobytes() for x in ([1], [2, 2], [3], [], [4, 4], [5] * 9)]
    shard = tokens.Shard.of(tokens.shard_bytes(keys, data, 2))
    assert [x.tolist() for x in shard.get(None)] == [[1], [2, 2]] and [x.tolist() for x in shard.get(1)] == [[], [4, 4]] and [x.tolist() for x in shard.get(9)] == [[5] * 9]
    assert all(shard.get(k) == [] for k in (0, 2, 8, 10, 2**40))
    assert tokens.Shard.of(tokens.shard_bytes([], [], 4)).get(1) == []


def check_tokens(rows, docs):
    import xxhash
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    want, start = [], 0
    for doc_id, ids in sorted(((i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in docs), key=lambda d: (d[0] is not None, d[0] or 0, np.uint64(xxhash.xxh64_intdigest(np.array(d[1], "<u2").tobytes(), seed=42)).astype(np.int64).item())):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_op9(spark, odd, empty):
    check_tokens(tokens.op9_token_files(spark, SF).collect(), [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    check_tokens(tokens.op9_token_files(spark, odd).collect(), [(r[0], r[1]) for r in ROWS])
    assert tokens.op9_token_files(spark, empty).count() == 0


def test_lookup_reads_documents_by_key_from_the_files(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    docs = documents(spark)
    path = f"file://{tmp_path}/ids"
    manifest = tokens.token_files(docs, WORD, path, shard_ids=2000)
    assert manifest.count() > 3 and sum(r["n_docs"] for r in manifest.collect()) == len(ROWS)
    keys = spark.createDataFrame([(k,) for k in (None, -5, 1, 1, 8, 12, 14, 99, -(1 << 63))], "doc_id bigint")
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in tokens.lookup(keys, path, manifest).collect())
    assert got == Counter((r[0], (*t.encode(r[1] or "", add_special_tokens=False).ids, 1)) for r in ROWS if r[0] in (None, -5, 1, 8, 12, 14))
    assert tokens.lookup(keys.limit(0), path, manifest).count() == 0


def test_ids_that_do_not_fit_are_an_error():
    assert tokens.narrowed(np.array([65535, 1], "<u4").tobytes(), 2) == np.array([65535, 1], "<u2").tobytes()
    with pytest.raises(ValueError, match="70000"):
        tokens.narrowed(np.array([70000], "<u4").tobytes(), 2)
    assert tokens.width_for(WORD, 1) == 2 and tokens.width_for(WORD, 70_000) == 4


def test_only_tokenizers_of_known_parts_are_cut_here(tmp_path):
    import json

    with open(WORD) as file:
        config = json.load(file)
    config["normalizer"] = {"type": "NFC"}
    (tmp_path / "nfc.json").write_text(json.dumps(config))
    encoder = chunks.ChunkEncoder(str(tmp_path / "nfc.json"))
    texts = ["The End of ABC 12", "É x"]
    assert encoder.cut is None and encoder.batch(texts) == [encoder.whole(t) for t in texts]
    assert chunks.ChunkEncoder(WORD).cut and chunks.ChunkEncoder(BYTE).cut


# --- 10: main text ---


def test_main_text():
    page = """<!DOCTYPE html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div>
    <div id="page"><h1>Title &amp; more</h1><div class="post-body"><p>A first   paragraph that is long enough,<br>with a <a href=y>link</a> and <b>bold</b> text.<p>Short.
    <ul><li>one<li>two</ul><form>Your name<input></form><script>var x = "<p>no</p>";</script></div>
    <div class="comments"><p>A reader comment that is long, longer than anything else that this page has to say to those who read it.</p></div></div>
    <aside>Related things</aside><footer>&copy; me</footer>"""
    assert html.main_text(page) == "Title & more\nA first paragraph that is long enough, with a link and bold text.\nShort.\none\ntwo"
    assert html.main_text("") == html.main_text("<p>") == html.main_text("<script>x</script>") == ""
    assert html.main_text("<article><p>a</p><p>b") == "a\nb" and html.main_text("plain &lt;text&gt;") == "plain <text>"
    assert html.main_text("<p>" * 3000 + "deep" + "<div>" * 3000) == "deep"


def test_main_text_keeps_all_parts_of_a_split_body():
    def said(n, word):
        return " ".join([word] * n) + " ends here."

    def p(n, word):
        return f"<p>{said(n, word)}</p>"

    big, small, lead = said(160, "large"), said(40, "little"), said(30, "lead")
    nav = "<nav><a href=x>Home</a></nav>"
    both = f"{big}\n{small}"
    for inside in ("section", "div", "article"):
        body = f"<{inside}>{p(160, 'large')}</{inside}><{inside}>{p(40, 'little')}</{inside}>"
        for around in ("main", "div", "article"):
            assert html.main_text(f"<body>{nav}<{around} id=content>{body}</{around}><footer>me</footer>") == both, (inside, around)
    # shares of 0.8 at each of two levels; two articles of 60 and 40; a lead and a heading before an article
    assert html.main_text(f"<body>{nav}<main><div><div>{p(160, 'large')}</div><div>{p(40, 'little')}</div></div><div>{p(30, 'lead')}</div></main>") == f"{both}\n{lead}"
    assert html.main_text(f"<body>{nav}<main><article>{p(60, 'one')}</article><article>{p(40, 'two')}</article></main>") == f"{said(60, 'one')}\n{said(40, 'two')}"
    assert html.main_text(f"<body>{nav}<main><p>{lead}</p><article>{p(160, 'large')}</article></main>") == f"{lead}\n{big}"
    assert html.main_text(f"<body>{nav}<main><h1>Title</h1><article>{p(160, 'large')}</article></main>") == f"Title\n{big}"


def _soup(rng):
    """A page without any hint in tags or names, and its main text."""
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 9)))
    said = lambda n: " ".join(word() for _ in range(n)) + "."
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
    title = said(5)
    body = [said(rng.randint(25, 80)) for _ in range(rng.randint(3, 12))]
    body[1:1] = [said(2)]  # a short one between
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    page = f"<html><body><div><ul>{links(8)}</ul></div><div><div>{word()}</div><div><a href=x>{word()}</a></div></div><div><h1>{title}</h1>{paragraphs}</div><div><ul>{links(6)}</ul></div><div><span><a href=x>{word()}</a></span></div></body></html>"
    return page, "\n".join([title, *body])


def test_ratios_choose_the_main_text(monkeypatch):
    import random

    pages = [_soup(random.Random(i)) for i in range(100)]
    assert [html.main_text(p) for p, _ in pages] == [t for _, t in pages]
    # without the ratios the menus come too, or the text is lost
    rng = np.random.default_rng(1)
    for smooth in (lambda x, _: np.ones_like(x), lambda x, _: rng.random(len(x)), lambda x, _: x.max() - x):
        monkeypatch.setattr(html, "smooth", smooth)
        assert sum(html.main_text(p) != t for p, t in pages) > 90


def test_main_text_of_names_that_hold_the_page():
    text = "<p>This is what the page has to say, in a good many words.</p><p>And a second paragraph of it.</p>"
    want = "This is what the page has to say, in a good many words.\nAnd a second paragraph of it."
    for page in ('<div class="social-policy">%s</div>', '<main><article class="related-work">%s</article></main>', '<div class="comments">%s</div>', '<div class="sidebar-layout"><article>%s</article></div>', "<head><title>t</title>%s", "<table><tr><td>%s</td></tr></table>"):
        assert html.main_text(page % text) == want, page
    widget = "<article><p>A widget beside the text, which is not what the page is about.</p></article>"
    assert html.main_text(f'<div class="sidebar">{widget}</div><article>{text}</article><div class="comments">{widget}</div>') == want
    for part in ("comments", "commentList", "comment-list", "ad-slot", "site_footer", "cookieBanner", "page__sidebar--dark"):
        assert html.main_text(f'<body><div>{text}</div><div class="{part}"><p>Something that others have said of it, at a length that is as good.</p></div>') == want, part


def test_main_text_of_malformed_markup():
    for page, want in (("<p>a<![foo[x]]>b", "ab"), ("<p>a<![ 1]>b", "ab"), ("<p>a<![CDATA[x]]>b", "ab"), ("<p>a&#" + "1" * 5000 + ";b", "a\ufffdb"), ("<!foo><p>x</p>", "x"), ("<p>a<!-- <p>b", "a"), ("<p>a</b></q></zz>", "a"), ("<p>a<", "a<"), ("</p></p>a", "a")):
        assert html.main_text(page) == want, page


def test_main_text_is_linear_in_depth():
    import time

    for page in ("<div>" * 100_000 + "deep", "<div><p>x</p>" * 30_000, "<li><div>" * 30_000 + "x" + "</b></q>" * 30_000, "<article>" * 50_000 + "x", "<b class=ad>" * 30_000 + "x"):
        start = time.process_time()
        html.main_text(page)
        assert time.process_time() - start < 10


def test_op10_on_pages(spark):
    import html as std

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html.op10_ratio_extraction(spark, SF).collect()}
    for r in pages.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(std.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in blocks if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>x" * 20000, "x"), (2, "u", "<p>t", "x")], "page_id long, url string, html string, text string")
    assert {(r["page_id"], r["n_chars"]) for r in html.extract(odd).collect()} == {(1, 0), (None, 0), (2, 39999), (2, 1)}
    assert html.extract(odd.limit(0)).count() == 0


# --- all ---


def test_queries_with_sql_agree_with_it(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, SF)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, df.collect())) == Counter(want), name


def test_each_operator_has_a_query():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries()] == [str(n) for n in range(1, 11)]


def test_texts_of_the_fixture_are_near():
    assert jaccard(sets(NEAR), sets(NEAR + " end")) > 0.8 and len(LONG) > 200_000 and PROSE
