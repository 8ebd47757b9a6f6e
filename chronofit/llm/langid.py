"""Language ID by rank-order profiles: out-of-place distance between n-gram rankings."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, small_batches, with_arrow

#: Most frequent n-grams in a profile, and the longest n-gram.
PROFILE, LONGEST = 300, 3
#: Labelled documents per language that the profiles are fitted on, on average; the only bounded sample here.
FIT_DOCS = 2000
#: Languages that a model holds at most: those with the most labelled rows, ties by name. A bound of the fit, as FIT_DOCS.
LANGUAGES = 1000
UND = "und"
_NOT_LETTERS = re.compile(r"[^\w]+|[\d_]+")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, all but letters folded to single blanks, a blank at either end."""
    folded = _NOT_LETTERS.sub(" ", (text or "").lower())
    return np.frombuffer(f" {folded.strip()} ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)


def ngrams(code: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to `longest` code points and their counts. Three code points fit in 63 bits; blanks alone don't count."""
    keys = [code[code != 32]]
    for n in range(2, longest + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        k = code[:m].copy()
        for j in range(1, n):
            k = (k << 21) | code[j : m + j]
        # a blank inside joins two words: only those at an end belong to a word
        ok = np.ones(m, dtype=bool)
        for j in range(1, n - 1):
            ok &= code[j : m + j] != 32
        ok &= (code[:m] != 32) | (code[n - 1 : m + n - 1] != 32)
        keys.append(k[ok])
    return np.unique(np.concatenate(keys), return_counts=True)


def ranking(code: np.ndarray, size: int, longest: int) -> np.ndarray:
    """The `size` most frequent n-grams, the most frequent first; ties by the n-gram itself."""
    keys, counts = ngrams(code, longest)
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:size]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, longest: int = LONGEST, fit_docs: int = FIT_DOCS) -> dict[str, list[int]]:
    """Profiles by language, learnt from text and language of the rows that aren't held out.

    Of each language about `fit_docs` rows, chosen by a hash of the id, are counted, or all where it has fewer.
    The counts of n-grams are summed by Spark; only each language's `size` most frequent reach the driver.
    """
    small_batches(docs.sparkSession)
    seen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = seen.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    limits = F.create_map(*(F.lit(x) for r in per for x in (r["lang"], math.ceil(fit_docs / r["n"] * (1 << 20))))) if per else F.create_map().cast("map<string,bigint>")
    chosen = seen.where(F.pmod(F.xxhash64(F.lit("profile"), "id"), F.lit(1 << 20)) < limits[F.col("lang")]).select("lang", "text")

    def count(batches):
        def flush(lang: str, codes: list[np.ndarray]) -> pa.RecordBatch:
            keys, counts = ngrams(np.concatenate(codes), longest)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            held: dict[str, int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                code = letters(text)
                by.setdefault(lang, []).append(code)
                held[lang] = held.get(lang, 0) + len(code)
                if held[lang] > 200_000:
                    yield flush(lang, by.pop(lang))
                    held.pop(lang)
            for lang, codes in by.items():
                yield flush(lang, codes)

    total = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # Spark keeps `size` rows a language before it shuffles
    top = total.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").select("lang", "gram").collect()
    profiles: dict[str, list[int]] = {}
    for r in top:
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def predictor(profiles: dict[str, list[int]], size: int = PROFILE, longest: int = LONGEST):
    """A function from a text to (language, score) by the least out-of-place distance."""
    names = sorted(profiles)
    grams = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.int64)
    place = np.full((len(names), len(grams) + 1), -1, dtype=np.int64)
    for i, name in enumerate(names):
        place[i, np.searchsorted(grams, np.array(profiles[name], dtype=np.int64))] = np.arange(len(profiles[name]))

    def one(text: str | None) -> tuple[str, float]:
        if not len(grams) or not has_letter(text):
            return UND, 0.0
        own = ranking(letters(text), size, longest)
        at = np.searchsorted(grams, own)
        at[at == len(grams)] = 0
        theirs = place[:, np.where(grams[at] == own, at, len(grams))]
        away = np.where(theirs < 0, size, np.minimum(np.abs(theirs - np.arange(len(own))), size)).sum(axis=1)
        best = int(away.argmin())
        return names[best], float(1 - away[best] / (size * len(own)))

    return one


def predict(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = PROFILE, longest: int = LONGEST, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add pred_col and score_col (lang_pred and score), from the whole text alone.

    The distance to a language is the sum, over the text's ranked n-grams, of how far each is out of place in the
    language's ranking, or `size` where it is missing. lang_pred has the least, by name at ties; score is one
    minus that distance over the greatest possible one. A text that is null or has no letter, or any text where
    there are no profiles, is "und" with score 0. Repeated rows are treated alike; columns of the two names are
    replaced, all others stay.
    """

    def make(columns):
        one = predictor(profiles, size, longest)
        found = [one(x) for x in columns[0].to_pylist()]
        return [x for x, _ in found], [y for _, y in found]

    return with_arrow(docs, [text_col], [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())], make)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score), a row for each input row; null ids aren't held out."""
    frame = id_and_text(docs, id_col, text_col)
    found = predict(frame, fit(docs, id_col, text_col, lang_col))
    return found.select("id", held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
