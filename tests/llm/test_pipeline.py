"""The pipeline's stages against brute-force versions of their decisions."""

import numpy as np
from conftest import SMALL

import corpus_pipeline as C
from chronofit.llm import bpe, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    from test_operators import contract_words, shingle_set, union_find

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, None, "s", 0), (10_001, "123 456", "en", "s", 7), (10_002, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = C.language_id(spark, docs, SMALL)
    assert kept.columns == COLUMNS
    have = {r.doc_id for r in kept.collect()}
    assert have == {i for i, t in rows.items() if any(map(str.isalpha, t or ""))}
    near = C.near_dedup(spark, kept, SMALL)
    sets = {i: shingle_set(rows[i]) for i in have}
    names = sorted(have)
    edges = [(a, b) for x, a in enumerate(names) for b in names[:x] if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    comp = union_find(edges, names)
    left = {r.doc_id for r in near.collect()}
    assert near.columns == COLUMNS and left == {i for i in names if comp[i] == i} and len(left) < len(names)
    clean = C.decontamination(spark, near, SMALL)
    wins = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = contract_words(r.text)
        wins |= {tuple(w[k : k + 13]) for k in range(len(w) - 12)} if len(w) >= 13 else {tuple(w)} if w else set()
    sizes = {len(w) for w in wins}
    bad = set()
    for i in left:
        w, hit = contract_words(rows[i]), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            bad.add(i)
    assert {r.doc_id for r in clean.collect()} == left - bad
    masked = C.pii_masking(spark, clean, SMALL)
    assert masked.columns == COLUMNS
    for r in masked.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.base_spans(rows[r.doc_id]):
            assert r.text == rows[r.doc_id] or "[" in r.text
    ranks, pattern = bpe.vocabulary(spark)
    enc = bpe.encoding(ranks, pattern)
    for r in C.byte_bpe(spark, masked, SMALL).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text)


def test_run(spark):
    out = C.run(spark, SMALL)
    assert out.columns[:5] == COLUMNS and 0 < out.count() < spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "decontamination", "pii_masking", "byte_bpe"]


def test_stages_keep_columns_nulls_and_repeated_rows(spark, tmp_path):
    clash = {"lang_pred": "a", "score": 1.5, "n_words": -1, "n_hit": -2, "items": "b", "contaminated": True, "words": "w", "node": 7, "h": 8, "uid": "u", "key": "k"}
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the cat and the dog are in the house now", "en", "s", 1), (1, "the cat and the dog are in the house now", "en", "s", 1), (None, "the cat and the dog", "en", None, None),
            (3, None, None, None, None), (4, "", "en", "s", 0), (5, "\u4e2d\u6587" * 5, None, "s", 10), (6, "der hund und die katze und das haus", "de", "s", 1), (7, "mail a@b.co", "en", "s", 9)]
    docs = spark.createDataFrame(rows, schema).withColumns({k: F.lit(v) for k, v in clash.items()})
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        got = docs.collect()
        assert all({k: r[k] for k in clash} == clash for r in got), name
        assert sorted(str(r.doc_id) for r in got) == ["1", "1", "6", "7", "None"], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert stage(spark, docs.limit(0), SMALL).isEmpty(), name
    assert {r.text for r in docs.where("doc_id = 7").collect()} == {"mail [EMAIL]"}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert C.language_id(spark, none, SMALL).count() == none.count()
    assert C.byte_bpe(spark, docs.limit(0), SMALL).isEmpty()
