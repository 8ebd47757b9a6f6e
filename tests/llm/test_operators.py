"""The ten corpus operators against brute-force versions on small tables with nulls, empty texts, ties, copies and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, same
from pyspark.sql import functions as F

from chronofit.llm import bpe, common, decontam, embeddings, html, langid, minhash, paragraphs, pii, queries, shingles, suffix, warc
from chronofit.llm.tagger import Tagger

SQL = queries.oracle_sql()
DOCS = "doc_id long, text string, node string, comp string, h long"


def documents(spark, rows):
    """Columns beside id and text have names that the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS).repartition(4)


def vocabulary(spark):
    return bpe.vocabulary(spark)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    same(queries.queries()[name](spark, SMALL), duck.execute(SQL[name]).fetchdf())


def union_find(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    g = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(500, 500 + k) for k in range(1, 40)] + [(g.randrange(100), g.randrange(100)) for _ in range(60)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.comp for r in common.components(common.Scratch(spark, "t"), df).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == union_find(real, {x for e in real for x in e})
    assert common.components(common.Scratch(spark, "t"), df.limit(0)).isEmpty()


# byte-level BPE


def test_bpe_round_trip_and_long_texts(spark):
    ranks, pattern = vocabulary(spark)
    enc = bpe.encoding(ranks, pattern)
    g = random.Random(2)
    long = " ".join(g.choice(["été", "word", "12345", "a.b", "\n\n", "don't"]) for _ in range(60_000))
    texts = [None, "", "plain words", "<|endoftext|>", "\u0000\t  \r\n x", "日本語 🙂", "a" * 150_000, " " * 120_000 + "x", long]
    df = documents(spark, enumerate(texts))
    got = {r.doc_id: r for r in bpe.round_trip(df.withColumn("ids", F.lit(1)), ranks, pattern).collect()}
    for i, t in enumerate(texts):
        want = enc.encode_ordinary(t or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_tokens == len(want)
        assert bytes(got[i].decoded) == (t or "").encode()
        assert (got[i].node, got[i].h) == ("x", 1)
    assert len(list(bpe.safe_parts(long))) > 1 and "".join(bpe.safe_parts(long)) == long
    few = bpe.encode(df.where("doc_id < 3"), ranks, pattern)
    assert all(r.a == list(np.frombuffer(r.ids, "<u4")) for r in few.select("ids", bpe.id_array(F.col("ids")).alias("a")).collect())
    assert bpe.round_trip(df.limit(0), ranks, pattern).isEmpty()


def test_op1_digests(spark):
    ranks, pattern = vocabulary(spark)
    enc = bpe.encoding(ranks, pattern)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op1_byte_bpe(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = enc.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


# shingle sets, MinHash and paragraphs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_super_minhash_equals_the_walk_element_by_element():
    g = np.random.default_rng(3)
    sizes, m = [0, 1, 3, 40, 200], 24
    sets = [np.unique(g.integers(0, 1 << 63, n).astype(np.uint64)) for n in sizes]
    offsets = np.cumsum([0, *(len(s) for s in sets)])
    got = shingles.super_minhash(np.concatenate(sets), offsets, m)
    for row, s in zip(got, sets, strict=True):
        want = [int(shingles.EMPTY)] * m
        for e in s:
            p = list(range(m))
            for j in range(m):
                x = int(shingles.mix(np.array([(int(e) + int(shingles._STEP) * (j + 1)) & (1 << 64) - 1], np.uint64))[0])
                k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j << 32 | x >> 32)
        assert row.tolist() == want
    a, b = g.integers(0, 1 << 63, 300).astype(np.uint64), g.integers(0, 1 << 63, 100).astype(np.uint64)
    pair = [np.unique(a), np.unique(np.concatenate([a[:250], b]))]
    s = shingles.super_minhash(np.concatenate(pair), np.cumsum([0, *(len(x) for x in pair)]), 1024)
    assert abs((s[0] == s[1]).mean() - len(np.intersect1d(*pair)) / len(np.union1d(*pair))) < 0.06


def near_corpus(g, n=120):
    vocab = [f"w{i}É" for i in range(400)]
    rows, base = [], [[g.choice(vocab) for _ in range(g.randrange(3, 120))] for _ in range(12)]
    for i in range(n):
        w = list(g.choice(base))
        for _ in range(g.choice((0, 0, 1, 1, 2, 4))):
            w[g.randrange(len(w))] = g.choice(vocab).upper()
        rows.append((i, " ".join(w)))
    return [*rows, (900, None), (901, ""), (902, " \t"), (903, "two words"), (904, "two  WORDS"), (None, rows[0][1]), (5, rows[5][1])]


@pytest.mark.parametrize(("over", "under"), [(4, 5), (85, 100)])
def test_minhash_finds_every_link(spark, over, under):
    rows = near_corpus(random.Random(over))
    sets = [(i, shingle_set(t)) for i, t in rows]
    ids = {i for i, _ in rows if i is not None}
    edges = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[:x] if a and b and None not in (i, j) and i != j and under * len(a & b) >= over * len(a | b)]
    comp = union_find(edges, ids)
    # tiny chunks: bands are dealt over many tiles
    got = minhash.near_duplicates(documents(spark, rows), over=over, under=under, chunk=7).collect()
    assert sorted((str(r.id), r.n_shingles, r.component_id, r.kept) for r in got) == sorted((str(i), len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets)
    assert minhash.near_duplicates(documents(spark, rows).limit(0)).isEmpty()


def cut_line(line, reach=paragraphs.REACH):
    """Paragraphs of one line, border by border."""
    w = WORD.findall(line)
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x).encode() for x in w]
    key = [(not i or w[i - 1][-1] not in ".!?", -min(63, len(low[i])), low[i][:7].ljust(7, b"\0")) for i in range(len(w))]
    cuts = [i for i in range(reach, len(w) - reach) if all(key[i] < key[j] for j in range(i - reach, i + reach + 1) if j != i)]
    return [w[i:j] for i, j in zip([0, *cuts], [*cuts, len(w)], strict=True)] if w else []


@pytest.mark.parametrize("chunk", [256, 3])
def test_paragraphs_against_brute_force(spark, chunk, monkeypatch):
    import chronofit.llm.nearsets as nearsets

    monkeypatch.setattr(paragraphs, "linked", lambda *a: nearsets.linked(*a, chunk=chunk))
    g = random.Random(12)
    word = lambda: "".join(g.choice("abcdefgé") for _ in range(g.randrange(3, 7))) + g.choice(["", "", "", "."])
    text = lambda n: [word() for _ in range(n)]
    runs = [text(60) for _ in range(6)]
    rows = [(i, "\n".join(" ".join([*text(g.randrange(150)), *(g.choice(runs) if g.random() < 0.7 else []), *text(g.randrange(150))]) for _ in range(g.randrange(4)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\n"), (103, "x " * 40), (104, "X " * 50), (105, "One two\nthree"), (106, "three\none  TWO"), (7, rows[7][1])]
    rows += [(107 + k, " ".join(w if x != 3 * k + 12 else f"zz{k}" for x, w in enumerate(runs[0]))) for k in range(14)]
    docs = documents(spark, rows).withColumn("uid", F.lit(1)).withColumn("removed", F.lit(2))
    found = paragraphs.near_duplicates(docs)
    units = [(i, n, " ".join(p)) for i, t in rows for n, p in enumerate(p for x in (t or "").split("\n") for p in cut_line(x))]
    sets = [shingle_set(p) for _, _, p in units]
    comp = union_find([(x, y) for x in range(len(units)) for y in range(x) if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])], range(len(units)))
    groups: dict = {}
    for x, u in enumerate(units):
        groups.setdefault(comp[x], []).append(u)
    removed, repeated, size = {}, {}, Counter()
    for m in groups.values():
        for i, n, p in m:
            size[i] = max(size[i], n + 1)
            if len(m) > 1:
                repeated.setdefault(i, {})[n] = len(p.split())
            if (i, n) != min(m)[:2]:
                removed.setdefault(i, set()).add(n)
    rest = found.collect()
    assert len(rest) == len(rows)
    for r in rest:
        mine, passages = repeated.get(r.id, {}), 0
        for n in mine:
            if n - 1 not in mine:
                z = n
                while z in mine:
                    z += 1
                passages += sum(mine[x] for x in range(n, z)) >= 50
        assert (r.n_paragraphs, r.n_repeated, r.n_passages, r.removed) == (size[r.id], len(mine), passages, sorted(removed.get(r.id, ()))) and r.n_removed == len(r.removed)
    assert sum(r.n_passages for r in rest) > 10
    left = paragraphs.without_paragraphs(docs, found)
    assert left.columns == docs.columns
    left = {r.doc_id: r.text for r in left.collect()}
    for i, t in rows:
        keep = [w for n, (j, _, p) in enumerate(u for u in dict.fromkeys(units) if u[0] == i) if n not in removed.get(i, ()) for w in p.split()]
        assert left[i] == t if i not in removed else WORD.findall(left[i]) == keep
    assert paragraphs.near_duplicates(docs.limit(0)).isEmpty()


def test_nodes_without_a_band_or_a_copy_go_before_the_texts_are_read(spark, monkeypatch):
    import chronofit.llm.nearsets as nearsets

    seen = []

    def linked(scratch, bands, sets_of, *a):
        def watched(wanted):
            out = sets_of(wanted)
            seen.extend(p.name for p in Path(scratch.root.removeprefix("file:")).iterdir())
            return out

        return nearsets.linked(scratch, bands, watched, *a)

    monkeypatch.setattr(paragraphs, "linked", linked)
    own = [(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(50)]
    found = {r.id: r.n_removed for r in paragraphs.near_duplicates(documents(spark, [*own, (90, own[3][1]), (91, own[4][1] + " more")])).collect()}
    assert {k for k, v in found.items() if v} == {90, 91}
    names = [x.split("-", 1)[1] for x in seen]
    assert "held" in names and "nodes" not in names


def test_only_sets_of_candidates_meet_the_nodes(spark):
    rows = [(i, f"a{i} b c d e f{i % 7}") for i in range(3000)] + [(5, "twice"), (None, "none")]
    nodes = spark.createDataFrame([(5,), (77,), (-4,)], "node long")
    got = minhash.full_sets(spark.createDataFrame(rows, "id long, text string"), nodes)
    assert sorted(r.node for r in got.collect()) == [5, 5, 77]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan[plan.index("MapInArrow") :] and "text" not in plan[: plan.index("MapInArrow")]
    bits = common.bit_filter(nodes).value
    at = np.array([r.at for r in spark.range(3000).select(common.bit_of(F.col("id")).alias("at")).collect()])
    ok = common.set_bits(bits, at)
    assert ok[5] and ok[77] and ok.sum() < 10


def test_texts_arent_shuffled_for_the_sets_of_their_paragraphs(spark):
    g = random.Random(9)
    rows = [(i, "\n".join(" ".join(f"w{g.randrange(300)}" for _ in range(g.randrange(60))) for _ in range(3))) for i in range(80)]
    rows += [(None, "no id one two three four"), (7, rows[7][1]), (900, None), (901, "")]
    texts = documents(spark, rows).select(F.col("doc_id").alias("id"), "text").withColumn("uid", paragraphs._uid(F.col("id"), F.col("text"))).select("id", "uid", "text")
    texts = common.Scratch(spark, "t").save(texts)
    names = {(r.id, r.text): r.uid for r in texts.collect()}
    units = [(i, names[i, t], n, " ".join(p)) for i, t in dict.fromkeys(rows) for n, p in enumerate(p for x in (t or "").split("\n") for p in cut_line(x))]
    wanted = [(k, *u[:3]) for k, u in enumerate(units) if k % 3 == 0 or u[0] in (None, 7)]
    places = common.Scratch(spark, "t").save(spark.createDataFrame([*wanted, (-1, 5, 123, 0)], "node long, id long, uid long, no int"))
    got = paragraphs.paragraph_sets(texts, places, 5, paragraphs.REACH)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("MapInArrow") :]
    found = {r.node: np.frombuffer(r.elements, np.uint64) for r in got.collect()}
    assert got.count() == len(found) == len(wanted)
    for k, *_ in wanted:
        alone = shingles.text_sets(pa.array([units[k][3]], pa.large_string()), 5, shingles.space_words(), shingles.lower_ascii())[0]
        assert len(found[k]) == len(shingle_set(units[k][3])) and (found[k] == alone).all()


def test_bands_that_stand_alone_are_shuffled_once(spark):
    from chronofit.llm import nearsets

    n = 20_000
    bands = spark.range(n).select((F.col("id") * 7 - n).alias("h"), F.col("id").alias("node"))
    bands = bands.union(bands.where("node < 40").withColumn("node", F.col("node") + n))
    sets = spark.range(2 * n).select(F.col("id").alias("node"), F.lit(np.arange(9, dtype=np.uint64).tobytes()).alias("elements"))

    def written():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}

    before, most = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {r.node: r.comp for r in nearsets.linked(common.Scratch(spark, "t"), bands, lambda x: sets.join(x, "node", "left_semi"), 4, 5).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert got == {n * k + i: i for i in range(40) for k in (0, 1)}
    # the sets of this test are dealt by node: 2 n rows of its own
    assert sum(v for k, v in written().items() if k not in before) < 3.5 * n


def test_sets_are_dealt_out_once_for_a_member_and_its_hub(spark):
    from chronofit.llm import nearsets

    scratch = common.Scratch(spark, "t")
    full = np.arange(20, dtype=np.uint64)
    sets = scratch.save(spark.createDataFrame([(i, full[i % 3 :].tobytes()) for i in range(50)] + [(99, full[9:].tobytes())], "node long, elements binary"))
    star = scratch.save(spark.createDataFrame([(i, i % 5) for i in range(5, 50)] + [(99, 0)], "node long, hub long"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        links = nearsets._hub_links(star, sets, 4, 5)
        assert links._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 1
        assert sorted((r.u, r.v) for r in links.collect()) == [(i, i % 5) for i in range(5, 50)]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_paragraphs_dont_depend_on_what_stands_before():
    g = random.Random(6)
    lines = [" ".join(f"w{g.randrange(10**4)}" + g.choice(["", "", "."]) for _ in range(g.randrange(60))) for _ in range(400)]
    *_, doc, starts, ends = paragraphs.cut(pa.array(lines, pa.large_string()))
    assert np.bincount(doc, minlength=400).tolist() == [len(cut_line(x)) for x in lines]
    for i, x in enumerate(lines):
        alone = paragraphs.cut(pa.array([x], pa.large_string()))
        at = sum(map(len, lines[:i]))
        assert (alone[3] + at).tolist() == starts[doc == i].tolist() and (alone[4] + at).tolist() == ends[doc == i].tolist()


def test_passage_inside_longer_lines_is_found(spark):
    g = random.Random(5)
    text = lambda n: [f"w{g.randrange(10**6)}" for _ in range(n)]
    runs = [text(51) for _ in range(40)]
    rows = [(2 * i + j, " ".join([*text(g.randrange(60, 130)), *r, *text(g.randrange(60, 130))])) for i, r in enumerate(runs) for j in (0, 1)]
    docs = documents(spark, rows)
    found = paragraphs.near_duplicates(docs)
    n = {r.id: r.n_removed for r in found.collect()}
    assert not any(n[i] for i in range(0, 80, 2)) and sum(n[i] > 0 for i in range(1, 80, 2)) >= 34
    left = {r.doc_id: r.text.split() for r in paragraphs.without_paragraphs(docs, found).collect()}
    # a paragraph at the border of a run may hold a few words beside it: similarity 0.8 allows one of five
    assert all(len(set(rows[2 * i + 1][1].split()) - set(r) - set(left[2 * i + 1])) <= 5 for i, r in enumerate(runs))


def test_short_lines_are_paragraphs(spark):
    docs = documents(spark, [(1, "All rights reserved"), (2, "all  Rights reserved\nyes"), (3, "Yes"), (4, "no")])
    got = {r.id: (r.n_paragraphs, r.n_repeated, r.removed) for r in paragraphs.near_duplicates(docs).collect()}
    assert got == {1: (1, 1, []), 2: (2, 2, [0]), 3: (1, 1, [0]), 4: (1, 0, [])}


def test_a_band_with_many_sets_is_compared_in_tiles(spark):
    """Chains in one band: the hub links to some, the tiles must find the rest."""
    from chronofit.llm import nearsets

    g = random.Random(3)
    base = [g.randrange(1 << 62) for _ in range(40)]
    sets = [sorted({*base[i % 30 :], *(g.randrange(1 << 62) for _ in range(i % 30))}) for i in range(90)]
    df = spark.createDataFrame([(i, np.array(s, np.uint64).tobytes()) for i, s in enumerate(sets)], "node long, elements binary")
    bands = spark.createDataFrame([(1 + i % 2, i) for i in range(90)] + [(1, i) for i in range(1, 20, 2)], "h long, node long")
    same_band = lambda a, b: a % 2 == b % 2 or {a % 2, b % 2} == {0, 1} and (a if a % 2 else b) < 20
    edges = [(a, b) for a in range(90) for b in range(a) if same_band(a, b) and 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})]
    want = union_find(edges, range(90))
    for chunk in (256, 7):
        got = {r.node: r.comp for r in nearsets.linked(common.Scratch(spark, "t"), bands, lambda n: df.join(n, "node"), 4, 5, chunk).collect()}
        assert {i: got.get(i, i) for i in range(90)} == want


# embeddings


@pytest.mark.parametrize("chunk", [8192, 9])
def test_embeddings_against_brute_force(spark, chunk):
    g = np.random.default_rng(7)
    base = g.normal(size=(12, 20))
    x = [(base[i % 12] + g.normal(size=20) * g.choice([0.0, 0.3, 0.5])).astype(np.float32).tolist() for i in range(150)]
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(200, None), (201, []), (202, [0.0] * 20), (203, [float("nan")] + [1.0] * 19), (204, [None] + [1.0] * 19), (205, [float("inf")] * 20), (206, x[3]), (207, [2 * v for v in x[4]]), (None, x[5]), (208, x[6][:10]), (209, [-v for v in x[7]])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, w int").repartition(3)
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= 0.9}
    comp, n = union_find(links, {i for i, _ in rows if i is not None}), Counter(x for e in links for x in e)
    got = embeddings.near_duplicates(df, chunk=chunk).collect()
    assert sorted((str(r.id), r.n_links, r.component_id, r.kept) for r in got) == sorted((str(i), n[i], comp.get(i), i is None or comp[i] == i) for i, _ in rows)
    assert embeddings.near_duplicates(df.limit(0)).isEmpty()


def test_rotation_is_orthogonal_and_row_wise():
    x = np.random.default_rng(1).normal(size=(9, 37))
    r = embeddings.rotate(x)
    assert np.allclose(r @ r.T, x @ x.T) and (r[4] == embeddings.rotate(x[4:5])[0]).all()


# repeats


def brute_repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        left = bytes(c for c, d in zip(b, gone, strict=True) if not d)
        out.append((str(i), len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "rolling", "period", "most"), [(40, 5, 7, 4096), (40, 12, 30, 1), (60, 4, 12, 3), (41, 3, 10_000, 4096), (30, 6, 1, 50)])
def test_repeats_against_brute_force(spark, length, rolling, period, most):
    g = random.Random(5)
    base = ["".join(g.choice("abcdé \n") for _ in range(300)) for _ in range(6)]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(g.randrange(6)):
            a = g.randrange(250)
            parts.append(g.choice(base)[a : a + g.randrange(10, 120)] + "".join(g.choice("xyz ") for _ in range(g.randrange(20))))
        rows.append((k, "".join(parts)))
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 100), (204, "\0" * 90 + "b" + "\0" * 90), (3, rows[3][1]), (None, rows[5][1])]
    got = suffix.remove_repeats(documents(spark, rows), length=length, rolling=rolling, period=period, rows=most)
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_repeats(rows, length)


def test_suffix_array_of_a_dictionary():
    g = random.Random(7)
    phrases = [bytes(g.choice(b"\0ab") for _ in range(g.randrange(1, 30))) for _ in range(40)]
    rank, base = suffix.suffix_ranks(phrases)
    suffixes = [p[k:] for p in phrases for k in range(len(p))]
    order = {s: i for i, s in enumerate(sorted(set(suffixes)))}
    assert (rank - 1).tolist() == [order[s] for s in suffixes] and base.tolist() == np.cumsum([0, *map(len, phrases)]).tolist()
    r, size, common = suffix._order([*phrases, b""])
    names = sorted({*phrases, b""})
    assert [names[x] for x in r] == [*phrases, b""] and size.tolist() == [len(x) for x in names]
    assert common.tolist()[1:] == [next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(names, names[1:])]


def test_corpus_order_finds_all_equal_windows():
    g = random.Random(8)
    for _ in range(60):
        length = g.randrange(5, 12)
        runs = [(g.randrange(3), bytes(g.choice(b"ab") for _ in range(g.randrange(1, 6))), g.randrange(length)) for _ in range(12)]
        h, m, context, phrase = [], [], [], []
        for bucket, extra, size in runs:
            c = bytes(g.choice(b"ab") for _ in range(length - 1)) + extra
            h.append(bucket), m.append(len(extra)), context.append(c), phrase.append(min(length, len(extra) + size))
        # phrases end with a trigger that all windows hold: no phrase suffix is a prefix of another
        context = [c[: p - 1] + b"T" + c[p:] for c, p in zip(context, phrase, strict=True)]
        of, k = suffix.repeated_windows(*(np.array(x) for x in (h, m, phrase)), context, length)
        seen = Counter((h[i], context[i][x : x + length]) for i in range(12) for x in range(m[i]))
        assert sorted(zip(of.tolist(), k.tolist(), strict=True)) == [(i, x) for i in range(12) for x in range(m[i]) if seen[h[i], context[i][x : x + length]] > 1]


def test_repeats_production_length(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op5_suffix(spark, SMALL).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(docs, 200)
    assert suffix.remove_repeats(documents(spark, [(1, "x")]).limit(0)).isEmpty()


def test_repetitive_texts_have_few_rows(spark):
    g = random.Random(8)
    period = "".join(g.choice("abcdefgh ") for _ in range(700))
    for unit, most in (("a", 10), ("abc", 30), (period, 2000)):
        text = unit * (1_000_000 // len(unit))
        df = spark.createDataFrame([(1, text)], "uid long, text string")
        rows = suffix._runs(df, suffix.LENGTH, suffix.ROLLING, suffix.PERIOD).selectExpr("count(*) AS n", "sum(shiftright(series, 32) * m) AS windows").first()
        assert rows.n < most and rows.windows == len(text) - suffix.LENGTH + 1, unit[:5]
    texts = ["a" * 700, "abc" * 150 + "x" + "abc" * 90, period[:230] * 3 + "q" + period[:230], "ab" * 99, "a" * 199, period + "zz" + period[100:400], "b" * 150 + "a" * 260]
    docs = list(enumerate(texts))
    got = suffix.remove_repeats(documents(spark, docs), length=200).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(docs, 200)


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to make it better for all of you.</p></div><article><h1>Head &amp; line</h1><p>First&nbsp;paragraph with <b>bold</b>
words.<script>var a="<p>no</p>";</script><p>Second one, &lt;quoted&gt; &#233; and long enough to be a paragraph of text.</p><form><p>Sign up</p><input></form><section id="comments"><p>A reader wrote this comment here today.</p></section></article>
<aside><p>Related things that you might like to read next on this site.</p></aside><footer>&copy; Site</footer></body></html>"""


def test_html(spark):
    want = "Head & line First paragraph with bold words. Second one, <quoted> é and long enough to be a paragraph of text."
    assert html.main_text(PAGE) == want and html.main_text(PAGE[: PAGE.index("</article>")]) == want
    plain_page = "<div><p>A plain page without an article element, but with a paragraph that is long enough.</p></div><div id=footer>imprint</div>"
    assert html.main_text(plain_page).startswith("A plain page") and "imprint" not in html.main_text(plain_page)
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "u", "", "t"), (3, "u", "<p", "t"), (3, "u", "<nav><p>only a menu</p></nav>", "t")], "page_id long, url string, html string, text string")
    got = sorted((str(r.id), r.text) for r in html.extract(df).collect())
    assert got == [("1", want), ("2", ""), ("3", ""), ("3", ""), ("None", "")]
    assert html.main_text("<p>" + "x " * 200_000 + "</p>").count("x") == 200_000


def test_names_speak_for_themselves_alone():
    body = "<h1>Head</h1><p>This is the text of the page, long enough to be taken for an article by anyone.</p>"
    want = "Head This is the text of the page, long enough to be taken for an article by anyone."
    for wrap in ("<div class='layout has-sidebar'>{}</div>", "<div id='main' class='with-comments'>{}</div>", "<article class='post comments-open'>{}</article>", "<form id=aspnetForm><main>{}</main></form>", "<div class='related'><article>{}</article></div>"):
        assert html.main_text(f"<html><body>{wrap.format(body)}</body></html>") == want, wrap
    for tag in ("<p data-id='comment-5'>", "<p data-hidden='false'>", "<p title='hidden gem' id=p1>"):
        assert html.main_text("<article>" + body.replace("<p>", tag) + "</article>") == want, tag
    for bad in ("<div class=sidebar-left>{}</div>", "<div id='siteFooter'>{}</div>", "<div style='display: none'>{}</div>", "<section class='comments'>{}</section>", "<div role=dialog>{}</div>", "<p hidden>{}</p>"):
        assert html.main_text(f"<article>{body}{bad.format('No part of it, however long this sentence goes on and on.')}</article>") == want, bad
    assert html.main_text("<article><header><h1>Head</h1></header><p>One <math><mi>x</mi></math> and <object>two</object>.</p></article>") == "Head One x and two."
    assert html.main_text("<article><p>One long enough paragraph of the text.</p><iframe src=x><p>And the rest of the page.</p></article>").endswith("rest of the page.")


def test_the_cut_turns_blocks_that_stand_among_others():
    text = "<p>A paragraph of some length that nobody would take for anything but the text of the page, whatever its end.</p>"
    page = f"<div><div>{text}<p>So</p>{text}<ul><li>and</li></ul>{text}</div><div><ul><li><a href=x>Link</a></li><li>So</li><li><a href=y>Other</a></li></ul></div></div>"
    found = html.blocks(page)
    u, keep = html.labelled(found)
    assert [b.text for b, k in zip(found, keep) if k and b.text in ("So", "and", "Link", "Other")] == ["So", "and"]
    assert sum((u > 0) != np.array(keep)) >= 1


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    t = time.time()
    deep = html.main_text("<div>" * 20_000 + "<p>A text that stands very deep, but is as long as others.</p>" + "</div>" * 20_000)
    html.main_text("<p>x y z</p><div><li>ab" * 5_000)
    html.main_text("</b></div>" * 100_000)
    assert deep.startswith("A text") and time.time() - t < 20


def test_classifier_is_fitted_on_marked_pages(spark):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    w = html.fit(df)
    assert w.shape == html.prior().shape and not np.allclose(w, html.prior()) and (w == html.fit(df.repartition(5))).all()
    assert (html.fit(df.limit(0)) == html.prior()).all() and (html.fit(df.withColumn("html", F.lit(None).cast("string"))) == html.prior()).all()
    x = np.random.default_rng(1).normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] > 0).astype(float)
    got = html.logistic(x, y, np.zeros(3), 1.0)
    grad = x.T @ (1 / (1 + np.exp(-x @ got)) - y) + got
    assert np.abs(grad).max() < 1e-6


def test_pages_without_marks_and_adverts_inside_articles(spark):
    """With the prior's and with fitted weights: text in divs, cells, lists and lines comes out; adverts and comments of an article, and a page of labels alone, don't."""
    fitted = html.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))
    assert np.abs(fitted - html.prior()).max() <= html.SPREAD**2
    a, b = ("The %s text of this page goes on for a while, as texts do, and it ends with a full stop, as it should at last." % x for x in ("first", "second"))
    menu = "<div><a href=/>Home</a> <a href=/more>More of it</a></div>"
    cases = {
        f"<body>{menu}<div>{a}</div><div>{b}</div></body>": f"{a} {b}",
        f"<body><table><tr><td>{a} {b}</td></tr></table></body>": f"{a} {b}",
        f"<body><h1>Title</h1>{a}<br>{b}<br><br>{a}</body>": f"Title {a} {b} {a}",
        f"<body>{menu}<h2>Title</h2><div>{a}</div><ul><li>one item of the list</li><li>another item</li></ul><div>{b}</div><div id=footer>Site</div></body>": f"Title {a} one item of the list another item {b}",
        f"<article><p>{a}</p><p class='ad'>{b}</p><div class=ad><p>{b}</p></div><p>{b}</p><div class=comments><p>{a}</p><p>{b}</p></div></article>": f"{a} {b}",
        f"<div><div>{a}</div><article><p>{b}</p></article></div>": b,
        "<p>Home</p><p>About us</p><p>Copyright 2020</p>": "",
        f"<article><p>{a} <a href=\"x>foo</a> bar.</p><p>{b}</p></article>": f"{a} foo bar. {b}",
        f"<article><p don't>{a}</p><!--><p class=x\"y>{b}</p></article>": f"{a} {b}",
    }
    for page, want in cases.items():
        assert html.main_text(page) == want and html.main_text(page, fitted) == want, page


def test_tags_and_elements_that_never_close_take_time_in_proportion():
    import time

    t = time.time()
    for piece in ('<a "', '<a x="', "<a x='><a x=\"", "<title>", "<!--", "<a x=  =", '<p x="<', "<br>", "<textarea><a x='"):
        html.blocks(piece * 40_000)
    assert time.time() - t < 20


def test_minimum_cut_is_the_least_labelling():
    g = random.Random(4)
    for _ in range(200):
        n = g.randrange(1, 9)
        u = [g.randrange(-8, 9) / 2 for _ in range(n)]
        edges = {(i, j): g.randrange(1, 6) / 2 for i in range(n) for j in range(i + 1, n) if g.random() < 0.5}
        cost = lambda x: sum(abs(a) for a, b in zip(u, x, strict=True) if (a > 0) != b and a) + sum(c for (i, j), c in edges.items() if x[i] != x[j])  # noqa: B023, E731
        best = min(cost([k >> i & 1 == 1 for i in range(n)]) for k in range(1 << n))
        assert cost(html.minimum_cut(u, edges)) == pytest.approx(best)


def test_op6_gives_the_article(spark):
    import html as std

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries.op6_html(spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        a = re.sub(r"<(p|/p|br|h1|/h1)>", "\0", re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1])
        parts = (" ".join(std.unescape(s).split()) for s in re.sub(r"<[^>]*>", "", a).split("\0"))
        assert r.text == " ".join(p for p in parts if p) and r.n_chars == len(r.text)


# language ID


def test_language_id(spark):
    got = queries.op7_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert len(test) > 20 and sum(r.lang == r.lang_pred for r in test) / len(test) > 0.95 and all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    rows = [(1, "der die das und ist ein nicht", "de"), (3, "der hund und die katze", "de"), (4, "the dog and the cat is not", "en"), (5, None, "en"), (6, "", None), (8, "12 ½ ²!", "en"), (None, "the cat", None), (9, "der das " * 50_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    r = {x.id: x for x in langid.identify(df).collect()}
    assert r[9].lang_pred == "de" and r[None].lang_pred == "en" and not r[None].held_out
    assert all((r[i].lang_pred, r[i].score) == ("und", 0.0) for i in (5, 6, 8))
    assert {x.lang_pred for x in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).isEmpty()


def test_language_id_against_brute_force(spark):
    g = random.Random(2)
    words = {"aa": ["der", "das", "und"], "bb": ["the", "and", "hat"], "cc": ["le", "et", "des"]}
    rows = [(i, " ".join(g.choice(words[x] + ["zu", "1"]) for _ in range(g.randrange(1, 30))), x) for i in range(80) for x in [g.choice(["aa", "bb", "cc"])]]
    rows += [(100, "x", None), (101, "Der DER der", None), (102, "et the", None), (102, "et the", None), (103, "ж", None), (104, "ab", "dd"), (105, "ba", "dd")]

    def grams(t):
        t = " " + re.sub(r"[^\w]+|[\d_]+", " ", t.lower()).strip() + " "
        return Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i : i + n] != " " and " " not in t[i + 1 : i + n - 1] and not (t[i] == " " == t[i + n - 1]))

    def code(x):
        k = 0
        for c in x:
            k = k << 21 | ord(c)
        return k

    def top(c):
        return [x for x, _ in sorted(c.items(), key=lambda y: (-y[1], code(y[0])))][: langid.PROFILE]

    import zlib

    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    total: dict = {}
    for i, t, x in rows:
        if x and not out[i]:
            total.setdefault(x, Counter()).update(grams(t))
    profiles = {x: {y: k for k, y in enumerate(top(c))} for x, c in total.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = []
    for i, t, _ in rows:
        own, size = top(grams(t)), langid.PROFILE
        away = {x: sum(min(abs(p[y] - k), size) if y in p else size for k, y in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        want.append((i, out[i], best, round(1 - away[best] / (size * len(own)), 12)))
    got = [(r.id, r.held_out, r.lang_pred, round(r.score, 12)) for r in langid.identify(df).collect()]
    assert sorted(got) == sorted(want)


# PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns(spark):
    g = random.Random(6)
    bits = ["a", "b.c", "@", ".", "é", " ", "-", "+", "1", "4539578763621486", "127.0.0.1", "300.1.1.1", "(555) ", "a@b.co", "x@y", "+1 (743) 555-3824", "0001.2.3.4", "4.0.", "--", "@@"]
    for _ in range(3000):
        t = "".join(g.choice(bits) for _ in range(g.randrange(14)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("a" * 200_000, "1" * 200_000, "1" * 100_000 + "@", "+" * 100_000, "1.2." * 50_000):
        pii.base_spans(t)
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        assert pii.base_spans(r.text) == plain_spans(r.text)


def test_tagger_gradient_and_learning():
    g = np.random.default_rng(2)
    model = Tagger(3, embed=4, hidden=3)
    ids, tags = g.integers(1, 98, (4, 7)), g.integers(0, 3, (4, 7))
    _, grad = model.loss(ids, tags)
    for name in grad:
        flat = model.p[name].reshape(-1)
        for k in g.integers(0, flat.size, 3):
            old = float(flat[k])
            flat[k] = old + 5e-3
            up = model.loss(ids, tags)[0]
            flat[k] = old - 5e-3
            down = model.loss(ids, tags)[0]
            flat[k] = old
            assert grad[name].reshape(-1)[k] == pytest.approx((up - down) / 1e-2, rel=0.05, abs=5e-3)
    assert model.fit(ids, tags, 60, rate=0.05)[-1] < 0.5 * model.loss(ids, tags)[0] + 2


def test_only_stretches_without_doubt_are_left_out():
    """The best path over the whole sequence is that over the doubtful stretches, with tag 0 elsewhere."""
    g = np.random.default_rng(4)
    for n in range(60):
        model = Tagger(5, embed=4, hidden=3)
        model.p["T"] = g.normal(size=(5, 5)).astype(np.float32)
        e = g.normal(size=(80, 5)).astype(np.float32)
        e[:, 0] += 1.5 + n / 30
        e[0, 0] = e[-1, 0] = 50
        doubt, tags = model.doubtful(e), model.viterbi(e)
        assert not tags[~doubt].any()
    assert not model.doubtful(e).all()


def test_windows_cover_every_character():
    model = Tagger(9)
    text = "".join(chr(97 + int(x)) for x in np.random.default_rng(1).integers(0, 26, 3000))
    ids = pii.char_ids(text)
    e = pii._emissions(model, ids)
    assert e.shape == (3000, 9)
    for p in (0, 5, 240, 241, 1500, 2999):
        w = int(np.clip((p - 16) // pii.STEP, 0, 13))
        part = np.zeros(pii.WINDOW, np.uint8)
        own = ids[w * pii.STEP : w * pii.STEP + pii.WINDOW]
        part[: len(own)] = own
        assert np.allclose(model.emissions(part[None])[p - w * pii.STEP, 0], e[p], atol=1e-4)


def test_pii_find_and_mask(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    rows = [(1, "call +1 (743) 555-3824 now"), (2, None), (3, ""), (4, "mail bob.42@mail8.example.com or 10.0.0.255"), (4, "é +1 (743) 555-3824, x"), (None, "nothing here"), (5, "word " * 40_000 + "4539578763621486")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, base string")
    found = pii.find(df, model).collect()
    for r in found:
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    assert sum(r.n_phone for r in found) == 2 and sum(r.n_card for r in found) == 1
    assert {r.text for r in pii.mask(df, model).where("doc_id = 1").collect()} == {"call [PHONE] now"}
    assert pii.masked("a@b.co 10.0.0.1", [(0, 0, 6), (1, 7, 15)]) == "[EMAIL] [IP]"
    # spans that the patterns can't see, in texts that the tagger hasn't seen
    g, hit, total = np.random.default_rng(9), Counter(), Counter()
    held = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(160).collect()]
    for n, t in enumerate(held):
        k = n % 4
        v = pii.variant(k, pii._MODELS[k], g)
        while k == 2 and not pii.luhn(re.sub(r"\D", "", v)):
            v = pii.variant(k, pii._MODELS[k], g)
        at = t.find(" ") + 1
        base, every = pii.all_spans(model, [t[:at] + v + " " + t[at:]])
        total[k] += 1
        hit[k] += any(s[0] == k and s[1] < at + len(v) and at < s[2] for s in set(every[0]) - set(base[0]))
    assert sum(hit.values()) / sum(total.values()) > 0.5, (hit, total)
    # and nothing where there is nothing
    clean = [t for t in held if not pii.base_spans(t)]
    assert len(clean) > 100 and sum(bool(x) for x in pii.tagged_spans(model, clean)) <= 1
    assert pii.find(df.limit(0), model).isEmpty()
    assert not pii.tagged_spans(pii.train(docs.limit(0)), ["a@b.co 10.0.0.1"])[0]


# WARC


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    big = "<html>" + "x" * 300 + "é</html>"
    rows = [(5, "http://a/\r\nx", big), (2, "http://b", big), (9, None, big), (1, "http://c", "short"), (3, "http://d", "short"), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "y" * 500_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    plan = warc.planned(df)
    warc.write(plan, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read(spark, f"file://{tmp_path}/w").collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw, r = (h or "").encode(), got[i]
        again = h == big and i != 2
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if again else ("response", None))
        assert (r.payload is None) if again else (bytes(r.payload) == raw)
    assert got[5].url == "http://a/%0D%0Ax" and got[9].url is None
    only = warc.read(spark, f"file://{tmp_path}/w").where("record_type = 'revisit' and refers_to = 2")
    assert only.count() == 3 and warc.read(spark, f"file://{tmp_path}/w", payload=False).where("page_id = 7").first().payload is None
    reader = warc._Reader({"path": f"file://{tmp_path}/w", "payload": "false"})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"x")])) == [warc.EqualTo(("payload",), b"x")]
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 3
    plainfile = tmp_path / "p.warc"
    plainfile.write_bytes(b"".join(warc.record(i, "u", b"z" * i, hashlib.sha256(b"z" * i).hexdigest(), None, i, "d") for i in (0, 3, 20_000)))
    assert sorted(r.payload_bytes for r in warc.read(spark, f"file://{tmp_path}", verify=True).where("payload_bytes >= 0").collect()) == [0, 3, 20_000]
    assert warc.round_trip(df.limit(0)).isEmpty()


def test_warc_detects_a_changed_payload(spark, tmp_path):
    (tmp_path / "p.warc").write_bytes(warc.record(1, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None, 3, "d"))
    with pytest.raises(Exception, match="differs"):
        warc.read(spark, f"file://{tmp_path}", verify=True).collect()


# decontamination

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contract_words(t):
    return TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontamination_against_brute_force(spark, block):
    g = random.Random(8)
    vocab = ["the", "of", "É", "été", "a1", "word", "x", "y", "z"]
    words = lambda n: [g.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(g.choice((1, 2, 4, 13, 14, 30))))) for i in range(14)] + [(50, None), (51, "?!"), (52, "the of"), (None, "zz yy xx"), (53, "the of")]
    rows = [(i, ", ".join(words(g.randrange(60)) + (g.choice(items)[1] or "").upper().split() + words(g.randrange(60)))) for i in range(50)]
    rows += [(90, None), (91, ""), (92, "..."), (93, "zz yy xx"), (3, rows[3][1]), (None, rows[4][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    got = decontam.contamination(documents(spark, rows), bench, block=block).collect()
    want = []
    for i, t in rows:
        w, hit, found = contract_words(t), set(), set()
        for item, it in items:
            v = contract_words(it)
            n = min(13, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1 if v else 0):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    if item is not None:
                        found.add(str(item))
        want.append((str(i), len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert sorted((str(r.id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == sorted(want)
    clean = decontam.contamination(documents(spark, rows), bench.limit(0)).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in clean)
    assert decontam.contamination(documents(spark, rows).limit(0), bench).isEmpty()
