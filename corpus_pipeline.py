"""The corpus pipeline: language ID, near-dedup, decontamination, PII masking and byte-level BPE, in that order.

Each stage works on all rows that the one before it kept, and returns the columns of `documents`; the last adds
the token columns. No stage is expressible in SQL from end to end, as profiles and tagger are learnt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofit.llm import bpe, decontam, langid, minhash, pii
from chronofit.llm.common import Scratch, fresh, table


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]



#: Least score (1 is no n-gram out of place, 0 is none in place) of a text that counts as being in a known language.
LEAST_SCORE = 0.02


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: drops documents without any language.

    These are null texts, those without a letter, and those whose out-of-place distance to every profile is that of a
    text which shares next to no n-gram with it (a score under LEAST_SCORE), as in a script that no labelled row has.
    Where no row can be learnt from, only null and letterless texts go. Repeated rows are judged alike; an empty table
    stays empty; columns of any names stay.
    """
    profiles = langid.fit(docs)
    if not profiles:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    pred, score = fresh(docs, "lang_pred", "score")
    found = langid.predict(docs, profiles, pred_col=pred, score_col=score)
    return found.where((F.col(pred) != langid.UND) & (F.col(score) >= LEAST_SCORE)).select(*_all(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of documents at a 5-word shingle similarity of 0.8 or more, that with the least id stays.

    Null, empty and wordless texts link with nothing and stay, as do null ids. Rows that share an id are one document
    and stay or go together. An empty table stays empty.
    """
    found = minhash.near_duplicates(docs, over=4, under=5, rows=5)
    gone = found.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_all(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: drops contaminated documents.

    Null and wordless texts aren't contaminated; rows are judged by their text alone, so repeated rows alike. An empty
    table, or an empty benchmark, leaves things as they are. Columns of any names stay.
    """
    made = ("n_words", "n_hit", "n_items", "items", "contaminated")
    names = dict(zip(made, fresh(docs, *made), strict=True))
    found = decontam.marked(docs, table(spark, sf_dir, "benchmark"), names=names)
    return found.where(~F.col(names["contaminated"])).select(*_all(docs))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: all documents stay; spans are replaced by their kind, and n_chars follows the text.

    A null text stays null, with null n_chars. Repeated rows are masked alike; an empty table stays empty.
    """
    return pii.mask(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*_all(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: adds n_tokens, ids (packed) and decoded_sha256, the digest of the ids' own bytes.

    A null text has no tokens. Columns of these three names, and of the name decoded, are replaced.
    """
    ranks, pattern = bpe.vocabulary(spark)
    done = bpe.round_trip(docs, ranks, pattern)
    return done.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_masking", pii_masking),
    ("byte_bpe", byte_bpe),
]

#: Profiles and tagger are learnt, so no SQL gives these rows; the tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
