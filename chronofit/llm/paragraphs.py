"""Near-duplicate passages: lines cut at content-defined borders, MinHash banding, exact Jaccard, components, removal.

A passage may stand anywhere in a line, so lines are cut into paragraphs of some 20 words at borders that
depend on the words around them alone: copies are cut alike wherever they stand. These paragraphs are banded
by MinHash, those that collide are verified on their full shingle sets, and components decide what goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import FILTER_BITS, Scratch, bit_filter, fresh, id_and_text, set_bits
from .nearsets import linked

#: A paragraph begins at the word that is least of the REACH words on either side: 19 words on average.
REACH = 9
#: Six bands of one rank: a pair at a similarity of 0.8 shares no band with a chance of 6e-5, at 0.9 of 1e-6.
BANDS, ROWS = 6, 1
#: Words of a run of repeated paragraphs that count as a passage.
PASSAGE = 50
_ENDS = np.frombuffer(b".!?", np.uint8)


def word_ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62-bit ranks of words: the longer first, then by their first seven bytes, A-Z lower-cased."""
    size = ends - starts
    out = (np.uint64(63) - np.minimum(size, 63).astype(S.U)) << S.U(56)
    low = S.lower_ascii()[data].astype(S.U)
    for j in range(7):
        out |= np.where(size > j, low[np.minimum(starts + j, len(data) - 1)], S.U(0)) << S.U(8 * (6 - j))
    return out


def cut(column: pa.Array, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paragraphs of each text of a string column: hashes of all words, paragraph of each word, text of each paragraph, its start and end byte.

    A line's first word begins a paragraph, and so does a word that comes before all others within `reach` words,
    words after a sentence end first, then by word_ranks(); a tie begins none. Only words with `reach` words of
    their line on either side count, so a line of up to 2 * reach words is one paragraph, and each paragraph of a
    longer one has `reach` words or more.
    """
    data, offsets = S.string_buffers(column)
    starts, ends, of = S.words(data, offsets, S.space_words())
    h = S.span_hashes(data, starts, ends, S.lower_ascii())
    n = len(h)
    if not n:
        z = np.zeros(0, np.int64)
        return h, z, z, z, z
    line = np.concatenate([[0], np.cumsum(data == 10)])[starts]
    first = np.ones(n, dtype=bool)
    first[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    group = np.cumsum(first) - 1
    key = word_ranks(data, starts, ends)
    after = np.zeros(n, dtype=bool)
    after[1:] = np.isin(data[ends[:-1] - 1], _ENDS)
    key[~after | first] |= S.U(1 << 63)  # what ends before the line is no part of it
    border = np.zeros(n, dtype=bool)
    if n > 2 * reach:
        mid = key[reach : n - reach]
        least = (group[reach : n - reach] == group[: n - 2 * reach]) & (group[reach : n - reach] == group[2 * reach :])
        for j in (*range(reach), *range(reach + 1, 2 * reach + 1)):
            least &= mid < key[j : j + n - 2 * reach]
        border[reach : n - reach] = least
    begins = np.flatnonzero(first | border)
    part = np.cumsum(first | border) - 1
    return h, part, of[begins], starts[begins], ends[np.append(begins[1:], n) - 1]


def _numbers(text_of: np.ndarray) -> np.ndarray:
    """0, 1, ... within each text."""
    return (np.arange(len(text_of)) - np.searchsorted(text_of, text_of, side="left")).astype(np.int32)


def _sets(h: np.ndarray, part: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    g, of = S.shingles(h, part, n, k)
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    return g[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=n))]).astype(np.int64)


_FOUND = "id long, uid long, no int, words int, k1 long, k2 long, bands array<long>"


def paragraph_bands(texts: DataFrame, over: int, under: int, bands: int, rows: int, k: int, reach: int) -> DataFrame:
    """(id, uid, text) -> a row for each paragraph. k1 and k2 are a 128-bit digest of its shingle set, so copies are one node from here on.

    bands is empty where a set is too small to link to any but its like, and everywhere where none are asked for.
    """

    def run(batches):
        for whole in batches:
            for b in S.pieces(whole, "text"):
                h, part, doc, *_ = cut(b.column(2), reach)
                sets, offsets = _sets(h, part, len(doc), k)
                digest = S.set_keys(sets, offsets).view(np.int64)
                sizes = np.diff(offsets)
                can = (sizes * under >= over * (sizes + 1)) & (bands > 0)
                some = sets[np.repeat(can, sizes)]
                keys = S.band_keys(S.super_minhash(some, np.concatenate([[0], np.cumsum(sizes[can])]), bands * rows), bands, rows).view(np.int64) if bands else np.zeros(0, np.int64)
                at = np.concatenate([[0], np.cumsum(can * bands)]).astype(np.int32)
                d = pa.array(doc)
                words = pa.array(np.bincount(part, minlength=len(doc)).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(d), b.column(1).take(d), pa.array(_numbers(doc)), words, pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists],
                    names=["id", "uid", "no", "words", "k1", "k2", "bands"],
                )

    return texts.mapInArrow(run, _FOUND)


def paragraph_sets(texts: DataFrame, places: DataFrame, k: int, reach: int) -> DataFrame:
    """(id, uid, text) and places (node, id, uid, no) -> (node, elements): the set of the paragraph at each place.

    Only the sets of paragraphs whose place has its bit in a filter of fixed size are shuffled, never a text. Rows
    that are repeated have their sets merged on the way.
    """
    bits = bit_filter(places, F.pmod(F.pmod("uid", F.lit(FILTER_BITS)) + F.col("no"), F.lit(FILTER_BITS)))

    def run(batches):
        for whole in batches:
            for b in S.pieces(whole, "text"):
                h, part, doc, *_ = cut(b.column(2), reach)
                no = _numbers(doc)
                hit = set_bits(bits.value, (b.column(1).to_numpy()[doc] % FILTER_BITS + no) % FILTER_BITS)
                use = hit[part]
                sets, offsets = _sets(h[use], (np.cumsum(hit) - 1)[part[use]], int(hit.sum()), k)
                elements = pa.BinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets * 8), pa.py_buffer(sets)]).cast(pa.binary())
                d = pa.array(doc[hit])
                yield pa.RecordBatch.from_arrays([b.column(0).take(d), b.column(1).take(d), pa.array(no[hit]), elements], names=["id", "uid", "no", "elements"])

    found = texts.mapInArrow(run, "id long, uid long, no int, elements binary")
    both = found.withColumn("node", F.lit(None).cast("long")).unionByName(places, allowMissingColumns=True)
    met = both.groupBy("id", "uid", "no").agg(F.max("node").alias("node"), F.first("elements", ignorenulls=True).alias("elements"))
    return met.where("node is not null and elements is not null").select("node", "elements")


def _uid(id_: F.Column, text: F.Column):
    return F.xxhash64(id_.cast("long"), text.cast("string"))


def _with_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the row's two names, id (nulls meet) and uid; the left's stay."""
    r = right.withColumnRenamed("id", "_id").withColumnRenamed("uid", "_uid")
    return left.join(r, left.id.eqNullSafe(r._id) & (left.uid == r._uid), how).drop("_id", "_uid")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", over: int = 4, under: int = 5, bands: int = BANDS, rows: int = ROWS, k: int = 5, reach: int = REACH, passage: int = PASSAGE) -> DataFrame:
    """A row for each input row: (id, uid, n_passages, n_paragraphs, n_repeated, n_removed, removed).

    Lines are cut by cut(); every paragraph that has a word is in, however short. Paragraphs link when their k-word
    shingle sets have under * intersection >= over * union (4 and 5: 0.8), words being runs without ASCII white
    space, lower-cased in A-Z; one of under k words has one shingle, so it links to its copies alone. Of each
    component the first paragraph stays, by id (null ids last), then by number. n_repeated counts the paragraphs of
    components of two or more, n_passages the runs of such paragraphs, one after the other, that have `passage`
    words or more; removed lists the numbers of those to remove, ascending.

    A null, empty or wordless text has no paragraphs. id and uid, a hash of id and text, name a row; repeated rows
    count as copies of each other, and lose the same paragraphs.
    """
    scratch = Scratch(docs.sparkSession, "paragraphs")
    texts = id_and_text(docs, id_col, text_col)
    texts = texts.select("id", _uid(F.col("id"), F.col("text")).alias("uid"), "text")
    banded = paragraph_bands(texts, over, under, bands, rows, k, reach)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "uid", "no")
    nodes = banded.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("bands").alias("bands"))
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    scratch.sweep()

    held: list[DataFrame] = []

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Each node's set, from the text where it stands first. The nodes that stand once and share no band, which are most, go here."""
        some = nodes.join(wanted.withColumn("wanted", F.lit(True)), "node", "left").where("wanted or n > 1")
        held.append(scratch.save(some.select("node", "k1", "k2", "n", "first", "wanted"), "held"))
        scratch.drop(nodes)
        scratch.sweep()
        return paragraph_sets(texts, held[0].where("wanted").select("node", "first.id", "first.uid", "first.no"), k, reach)

    comp = linked(scratch, nodes.select(F.explode("bands").alias("h"), "node"), sets_of, over, under)
    of = held[0].join(comp, "node", "left").select("k1", "k2", F.coalesce("comp", "node").alias("comp"), "n", "first")
    of = scratch.save(of, "of")
    scratch.drop(held[0], comp)
    scratch.sweep()
    kept = of.groupBy("comp").agg(F.sum("n").alias("total"), F.min("first").alias("keep")).where("total > 1")
    marks = of.join(kept, "comp").select("k1", "k2", F.col("keep.id").alias("keep_id"), F.col("keep.uid").alias("keep_uid"), F.col("keep.no").alias("keep_no"))
    found = scratch.save(paragraph_bands(texts, over, under, 0, rows, k, reach).drop("bands"), "paragraphs")  # made again rather than kept all the time
    hit = found.select("id", "uid", "no", "words", "k1", "k2").join(marks, ["k1", "k2"])
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("uid") == F.col("keep_uid")) & (F.col("no") == F.col("keep_no"))
    per = hit.groupBy("id", "uid").agg(
        F.sort_array(F.collect_set(F.when(~stays, F.col("no")))).alias("removed"), F.array_sort(F.collect_set(F.struct("no", "words"))).alias("repeated")
    )
    whole = found.groupBy("id", "uid").agg((F.max("no") + 1).cast("long").alias("n_paragraphs"))
    out = _with_rows(_with_rows(texts.select("id", "uid"), whole, "left"), per, "left")
    # runs of numbers that follow each other: a passage counts once, where its words first reach `passage`
    run = F.aggregate(
        "repeated", F.struct(F.lit(-2).alias("no"), F.lit(0).alias("words"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            x["no"].alias("no"), _run_words(s, x).alias("words"),
            (s["n"] + F.when((_run_words(s, x) >= passage) & (_run_words(s, x) - x["words"] < passage), 1).otherwise(0)).alias("n"),
        ),
    )["n"]
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "id", "uid", zero(run).alias("n_passages"), zero("n_paragraphs").alias("n_paragraphs"), zero(F.when(F.col("repeated").isNotNull(), F.size("repeated"))).alias("n_repeated"),
        F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"),
    )


def _run_words(s, x):
    return F.when(x["no"] == s["no"] + 1, s["words"]).otherwise(0) + x["words"]


def without_paragraphs(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """The documents with the paragraphs that near_duplicates() lists taken out of their texts; all columns stay, and so does white space between paragraphs."""
    order, (uid, gone, rid) = docs.columns, fresh(docs, "uid", "removed", "rid")
    listed = removed.where("n_removed > 0").select(F.col("id").alias(rid), F.col("uid").alias(uid), F.col("removed").alias(gone)).dropDuplicates([rid, uid])

    @F.pandas_udf("string")
    def left(text, numbers):
        out = []
        for t, no in zip(text, numbers, strict=True):
            if t is None or no is None:
                out.append(t)
                continue
            *_, starts, ends = cut(pa.array([t], pa.large_string()), reach)
            raw, at, parts = t.encode(), 0, []
            for i in no:
                parts.append(raw[at : starts[i]])
                at = ends[i]
            out.append(b"".join([*parts, raw[at:]]).decode())
        return text.__class__(out, dtype=object)

    text, own = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    out = docs.join(listed, own.eqNullSafe(listed[rid]) & (_uid(own, text) == listed[uid]), "left")
    return out.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(left(text, F.col(gone)))).select(*(F.col(f"`{c}`") for c in order))
