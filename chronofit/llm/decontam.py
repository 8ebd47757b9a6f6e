"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

Shingles are ordered by how rare they are in the documents. As a window must be contained whole, one prefix
token, its rarest shingle, is enough to find it: where that token stands in a document, its offset fixes the
window's place, the document's borders rule some places out, and the words themselves decide.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles as S
from .common import fresh, id_and_text, small_batches, with_arrow

#: Words in a window, words in a shingle, (window, item) pairs in a block that is sent to all tasks.
WINDOW, SHINGLE, BLOCK = 13, 5, 100_000
_MASK = (1 << 20) - 1


def word_bytes() -> np.ndarray:
    """Bytes of a word, after A-Z are lower-cased: digits, a-z and all of non-ASCII."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x41:0x5B] = t[0x80:] = True
    return t


def split_words(text: str | None, member: np.ndarray, fold: np.ndarray) -> list[bytes]:
    data, offsets = S.string_buffers(pa.array([text or ""]))
    starts, ends, _ = S.words(data, offsets, member)
    low = fold[data].tobytes()
    return [low[a:b] for a, b in zip(starts, ends, strict=True)]


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, text) -> distinct (item string, words binary): the item's windows, words joined by a blank."""

    def run(batches):
        member, fold = word_bytes(), S.lower_ascii()
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = split_words(text, member, fold)
                found = {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(list(found), pa.binary())], names=["item", "words"])

    return items.mapInArrow(run, "item string, words binary").distinct()


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    h = hashes[: max(0, len(hashes) - k + 1)].copy()
    for j in range(1, k):
        h = S.mix(h * S._K + hashes[j : j + len(h)])
    return h


class _Index:
    """The windows of one block: their tokens and, once ranked, the prefix tokens by shingle length."""

    def __init__(self, pairs: pa.Table, shingle: int):
        items: dict[bytes, list] = defaultdict(list)
        for item, w in zip(pairs.column(0).to_pylist(), pairs.column(1).to_pylist(), strict=True):
            items[w].append(item)
        self.words = sorted(items)
        self.items = [[x for x in items[w] if x is not None] for w in self.words]
        self.size = [w.count(b" ") + 1 for w in self.words]
        self.tokens = []  # of each window: (k, hashes by offset)
        by_k: dict[int, list[np.ndarray]] = defaultdict(list)
        for w, n in zip(self.words, self.size, strict=True):
            data = np.frombuffer(w, np.uint8)
            at = np.concatenate([[-1], np.flatnonzero(data == 32), [len(data)]])
            k = min(shingle, n)
            h = _grams(S.span_hashes(data, at[:-1] + 1, at[1:]), k)
            self.tokens.append((k, h))
            by_k[k].append(h)
        self.table = {k: np.unique(np.concatenate(v)) for k, v in by_k.items()}
        self.first = dict(zip(self.table, np.cumsum([0, *(len(t) for t in self.table.values())]), strict=False))
        self.n_tokens = sum(len(t) for t in self.table.values())
        self.prefix: dict[int, list] | None = None

    def rank(self, count: np.ndarray) -> None:
        """Choose each window's rarest token; ties by the token's hash, then by the first offset."""
        self.prefix = {k: [[] for _ in t] for k, t in self.table.items()}
        for i, (k, h) in enumerate(self.tokens):
            at = np.searchsorted(self.table[k], h)
            c = count[self.first[k] + at]
            o = int(np.lexsort((np.arange(len(h)), h, c))[0])
            self.prefix[k][at[o]].append((i, o))
        used = {k: np.array([bool(x) for x in v]) for k, v in self.prefix.items()}
        self.prefix = {k: [x for x in v if x] for k, v in self.prefix.items()}
        self.table = {k: t[used[k]] for k, t in self.table.items()}

    def found(self, hashes: np.ndarray, of: np.ndarray):
        """For each shingle length: positions whose token is in the table, and the tokens' numbers there."""
        for k, t in self.table.items():
            if len(hashes) < k or not len(t):
                continue
            h = _grams(hashes, k)
            seen = np.zeros(_MASK + 1, dtype=bool)
            seen[(t & S.U(_MASK)).astype(np.int64)] = True
            pos = np.flatnonzero(seen[(h & S.U(_MASK)).astype(np.int64)] & (of[: len(h)] == of[k - 1 :]))
            at = np.searchsorted(t, h[pos])
            at[at == len(t)] = 0
            ok = t[at] == h[pos]
            yield k, pos[ok], at[ok]


def _token_counts(texts: DataFrame, shared) -> DataFrame:
    def run(batches):
        index, member, fold = shared.value, word_bytes(), S.lower_ascii()
        total = np.zeros(index.n_tokens, np.int64)
        for whole in batches:
            for b in S.pieces(whole, "text"):
                data, offsets = S.string_buffers(b.column(1))
                starts, ends, of = S.words(data, offsets, member)
                for k, _, at in index.found(S.span_hashes(data, starts, ends, fold), of):
                    total += np.bincount(index.first[k] + at, minlength=index.n_tokens)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["token", "n"])

    return texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


#: Columns that carry the state from block to block, and what they end as.
_KINDS = [T.LongType(), T.BinaryType(), T.ArrayType(T.StringType()), T.LongType()]
_NAMES = ["n_words", "n_hit", "n_items", "items", "contaminated"]


def _match(frame: DataFrame, text_col: str, state: list[str], shared) -> DataFrame:
    """Add one block's finds to the state columns."""

    def make(columns):
        index, member, fold = shared.value, word_bytes(), S.lower_ascii()
        text, _, spans_in, items_in = columns
        whole = pa.RecordBatch.from_arrays([text, spans_in, items_in], names=["text", "spans", "items"])
        words, spans_out, items_out = [], [], []
        for b in S.pieces(whole, "text"):
            data, offsets = S.string_buffers(b.column(0))
            starts, ends, of = S.words(data, offsets, member)
            counts = np.bincount(of, minlength=len(offsets) - 1)
            first = np.cumsum(counts) - counts
            spans = [[np.frombuffer(x or b"", np.int64)] for x in b.column(1).to_pylist()]
            items = [set(x or ()) for x in b.column(2).to_pylist()]
            low = fold[data]
            for k, pos, at in index.found(S.span_hashes(data, starts, ends, fold), of):
                for p, t in zip(pos.tolist(), at.tolist(), strict=True):
                    d = int(of[p])
                    for w, o in index.prefix[k][t]:
                        a = p - o
                        if a < first[d] or a + index.size[w] > first[d] + counts[d]:
                            continue
                        if b" ".join(low[starts[x] : ends[x]].tobytes() for x in range(a, a + index.size[w])) == index.words[w]:
                            spans[d].append(np.array([a - first[d], a - first[d] + index.size[w]], np.int64))
                            items[d].update(index.items[w])
            words += counts.tolist()
            spans_out += [np.concatenate(x).tobytes() for x in spans]
            items_out += [sorted(x) for x in items]
        return words, spans_out, items_out, [covered(x) for x in spans_out]

    return with_arrow(frame, [text_col, *state[:3]], [T.StructField(n, k) for n, k in zip(state, _KINDS, strict=True)], make)


def covered(spans: bytes) -> int:
    """Words inside any of the half-open spans."""
    x = np.frombuffer(spans, np.int64).reshape(-1, 2)
    if not len(x):
        return 0
    x = x[np.argsort(x[:, 0], kind="stable")]
    end = np.maximum.accumulate(x[:, 1])
    before = np.concatenate([[0], end[:-1]])
    return int(np.maximum(0, x[:, 1] - np.maximum(x[:, 0], before)).sum())


def marked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK, names: dict[str, str] | None = None) -> DataFrame:
    """docs with n_words, n_hit, n_items, items and contaminated, or what `names` calls them; columns of these names are replaced, all others stay.

    A word is hit inside any occurrence of a window of `window` consecutive item words, or of all words of a
    shorter item; items are those whose windows occur, sorted as strings; contaminated: n_hit > 0 and
    20 * n_hit >= n_words. A null or wordless text has no words, a null or wordless item no windows, and items
    without an id hit words but aren't listed. Repeated rows and an empty benchmark need no rule.

    The (window, item) pairs are dealt by hash into blocks of about `block`; each block is sent to all tasks and
    the documents are run past it, so what is sent doesn't grow with the benchmark, and nothing is shuffled but
    the counts of the block's own tokens.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = {n: (names or {}).get(n, n) for n in _NAMES}
    text = F.col(f"`{text_col}`").cast("string")
    pairs = windows(benchmark.select(F.col(f"`{item_col}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")), window)
    blocks = max(1, -(-pairs.count() // block))
    words, spans, items, hit = held = fresh(docs, "words", "spans", "items", "hit")
    state = docs.withColumns({words: F.lit(0).cast("long"), spans: F.lit(b""), items: F.array().cast("array<string>"), hit: F.lit(0).cast("long")})
    for k in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == k).toArrow()
        index = _Index(part, shingle)
        counts = np.zeros(index.n_tokens, np.int64)
        if index.n_tokens:
            seen = _token_counts(docs.select(F.lit(0).alias("id"), text.alias("text")), spark.sparkContext.broadcast(index)).toArrow()
            counts[seen.column(0).to_numpy()] = seen.column(1).to_numpy()
        index.rank(counts)
        state = _match(state, text_col, held, spark.sparkContext.broadcast(index))
    made = [F.col(words), F.col(hit), F.size(items).cast("long"), F.col(items), (F.col(hit) > 0) & (20 * F.col(hit) >= F.col(words))]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names.values()]
    return state.select(*kept, *(m.alias(names[n]) for n, m in zip(_NAMES, made, strict=True)))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated), a row for each input row; see marked()."""
    found = marked(id_and_text(docs, id_col, text_col), benchmark, "text", **options)
    return found.select("id", "n_words", "n_hit", "n_items", "items", "contaminated")
