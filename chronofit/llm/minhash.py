"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import Scratch, bit_filter, bit_of, components, id_and_text, set_bits
from .nearsets import CHUNK, linked

#: 30 bands of 6: a pair at a similarity of 0.85 shares no band with a chance of 7e-7.
BANDS, ROWS = 30, 6


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = 5) -> DataFrame:
    """(id, text) -> (id, n_shingles, key binary, bands array<long>); bands are null for an empty set."""
    m = bands * rows

    def run(batches):
        member, fold = S.space_words(), S.lower_ascii()
        for whole in batches:
            for b in S.pieces(whole, "text"):
                sets, offsets = S.text_sets(b.column(1), k, member, fold)
                keys = S.band_keys(S.super_minhash(sets, offsets, m), bands, rows).view("int64")
                digest = S.set_keys(sets, offsets)
                size = offsets[1:] - offsets[:-1]
                lists = pa.ListArray.from_arrays(pa.array(range(0, (len(keys) + 1) * bands, bands), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(size, pa.int64()), pa.array([x.tobytes() for x in digest], pa.binary()), lists],
                    names=["id", "n_shingles", "key", "bands"],
                )

    out = docs.mapInArrow(run, "id long, n_shingles long, key binary, bands array<long>")
    return out.withColumn("bands", F.when(F.col("n_shingles") > 0, F.col("bands")))


def full_sets(docs: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(id, text) -> (node, elements binary): the distinct shingles of each text whose id is one of `nodes` (node).

    Texts stay where they are: a filter takes out nearly all that aren't wanted, and only sets meet the nodes.
    """
    bits = bit_filter(nodes.select("node"))

    def run(batches):
        member, fold = S.space_words(), S.lower_ascii()
        for whole in batches:
            some = whole.filter(pa.array(set_bits(bits.value, whole.column(2).to_numpy())))
            for b in S.pieces(some, "text"):
                sets, offsets = S.text_sets(b.column(1), k, member, fold)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([sets[i:j].tobytes() for i, j in zip(offsets, offsets[1:], strict=False)], pa.binary())],
                    names=["node", "elements"],
                )

    return docs.select("id", "text", bit_of(F.col("id")).alias("at")).mapInArrow(run, "node long, elements binary").join(nodes, "node", "left_semi")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    over: int = 4, under: int = 5, bands: int = BANDS, rows: int = ROWS, k: int = 5, chunk: int = CHUNK,
) -> DataFrame:
    """Link texts whose k-word shingle sets have under * intersection >= over * union (4 and 5: 0.8).

    Returns a row for each input row: id, n_shingles, component_id (least id reachable by links, its own
    included), kept (it is that id). Texts are lower-cased in A-Z; words are runs without ASCII white space.

    A null, empty or wordless text has no shingles and no links. A null id links with nothing, its
    component_id is null and it is kept. Rows that share an id are one document: they share its component.
    Equal sets are merged first, by a 128-bit digest, so copies never meet in a band.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = id_and_text(docs, id_col, text_col)
    sig = scratch.save(signatures(texts, bands, rows, k), "signatures")
    some = sig.where("n_shingles > 0 and id is not null")
    classes = scratch.save(some.groupBy("key").agg(F.min("id").alias("rep")), "classes")
    member = some.select("id", "key").join(classes, "key")
    reps = some.join(classes.select("key", F.col("rep").alias("id")), ["key", "id"])
    found = linked(
        scratch, reps.select(F.explode("bands").alias("h"), F.col("id").alias("node")),
        # where rows share an id, each text's set stands for the node
        lambda nodes: full_sets(texts, nodes, k), over, under, chunk,
    )
    unique = some.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if unique:  # ids are unique: copies hang on their class alone and needn't go through the graph
        of = member.join(found, member.rep == found.node, "left").select("id", F.coalesce("comp", "rep").alias("comp"))
    else:
        copies = member.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
        tied = found.select(F.col("node").alias("u"), F.col("comp").alias("v"))
        of = components(scratch, tied.union(copies)).select(F.col("node").alias("id"), "comp")
    done = sig.select("id", "n_shingles").join(of, "id", "left")
    comp_id = F.coalesce("comp", "id")
    return done.select("id", "n_shingles", comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept"))
