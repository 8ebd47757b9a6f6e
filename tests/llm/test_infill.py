"""Fill-in-middle against a plain list of units, on texts with many pieces, sentinels, nulls and clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chronofit.llm import infill

ALPHABET = ["a", "bc", "Zebra", " ", "\n", "é", "ß", "日本", "🙂", "1", "<", "P", ">", "\u0000"]


def some_text(g, n):
    return "".join(g.choice(ALPHABET) for _ in range(n)).replace("<P>", "<p>")


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_every_rank_is_reached(monkeypatch, piece):
    monkeypatch.setattr(infill, "PIECE", piece)
    g = random.Random(piece)
    for n in (0, 1, 2, 40, 3000):
        text = some_text(g, n)
        units = infill.UNIT.findall(text)
        found = infill.SkipList(text)
        assert found.n == len(units)
        at = 0
        for rank in range(len(units) + 1):
            assert found.place(rank) == at
            at += len(units[rank]) if rank < len(units) else 0
    assert len(infill.SkipList(some_text(g, 20_000)).lanes) > 2


def by_hand(doc_id, text):
    text = text or ""
    u = infill.UNIT.findall(text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_transform_and_restore(spark):
    g = random.Random(3)
    texts = [None, "", "x", "<P>", "a <M> b", "<<S>>", "< P>", "a" * 300_000, " " * 70_000, some_text(g, 400_000), "same text", "same text"]
    texts += [some_text(g, g.randrange(60)) for _ in range(300)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(10, texts[10], "x", 1)]  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, units long").repartition(5)
    made = infill.transform(df)
    assert sorted(made.columns) == sorted(["doc_id", "text", "units", "n", "form", "prefix_chars", "middle_chars", "output"])
    got = infill.restore(made).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, texts[r.doc_id])
        assert r.restored == (texts[r.doc_id] or "") and r.units == 1
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(df.limit(0)).isEmpty()
    null_id = infill.transform(df.where("doc_id = 10").limit(1).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(null_id) == 1


def test_parts_that_look_like_sentinels():
    for text in ("a<", "<P", "P>S>M>", "<<<", "S><"):
        for k in range(200):
            _, form, _, _, out = infill.reordered(k, text)
            assert infill.original(out, form) == text
