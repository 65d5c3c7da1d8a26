from collections import Counter

import corpus_pipeline
from glyphmill.llm.common import words_of

from .fixtures import DOCS, SF, documents, no_documents


def test_stages_hand_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
    assert 200 > sizes[0] >= sizes[1] >= sizes[2] > 100
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in packed).keys() == Counter(r["doc_id"] for r in docs.collect()).keys()


def test_odd_documents_pass_each_stage(spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, documents(spark), SF)
        assert name == "packing" or out.columns == DOCS.names
        out.count()
        assert stage(spark, no_documents(spark), SF).count() == 0
    assert words_of("")== []


def test_run_equals_brute_force(spark):
    """run() as registered, against each stage's decisions made in plain Python on what the one before it kept."""
    import numpy as np
    from tokenizers import Tokenizer

    from glyphmill.llm import mixing, quality, rules

    from .test_operators import BYTE, components

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r["doc_id"]: docs[r["doc_id"]] for r in quality.op5_neighbour_votes(spark, SF).collect() if r["predicted"] == 1}
    options, sums = rules.RuleOptions(), {}
    passed = {i for i, r in kept.items() if not rules.base_failed(rules.base_counts(r["text"]), options)}
    for i in passed:
        old, new = sums.get(kept[i]["lang"], (0, 0)), rules.histograms(kept[i]["text"])
        sums[kept[i]["lang"]] = old[0] + new[0], old[1] + new[1]
    sums = {lang: (a.astype(float), b.astype(float)) for lang, (a, b) in sums.items()}
    kept = {i: kept[i] for i in passed if rules.verdict(kept[i]["text"], kept[i]["lang"], sums, options, True)[0]}
    classes = components({i: kept[i]["text"] for i in sorted(kept)})
    kept = {i: r for i, r in kept.items() if classes[i] == i}
    assert 100 < len(kept) < len(docs)
    survivors = spark.createDataFrame(list(kept.values()), spark.read.parquet(f"{SF}/documents.parquet").schema)
    mixed = [(r["doc_id"], r["text"]) for r in mixing.mixed_documents(survivors).collect()]
    assert {i for i, _ in mixed} <= kept.keys() and all(part in kept[i]["text"] for i, t in mixed for part in t.split("\n"))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _ in mixed)
    tokenizer = Tokenizer.from_file(BYTE)
    wanted = sorted((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in mixed)
    assert sum(n for _, n in wanted) == sum(r["length"] for r in rows)
    ends = sorted((r["doc_id"], r["start"] + r["length"]) for r in rows)
    assert not Counter(wanted) - Counter(ends)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():  # gapless from 0, at most 1024
        offsets = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [o for o, _ in sorted(parts)] == offsets[:-1].tolist() and offsets[-1] <= 1024
