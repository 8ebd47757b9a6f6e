"""Exact removal of long repeated substrings by prefix-free parsing.

A rolling hash picks triggers (a fixed share of all places), and a text becomes phrases that run from one trigger
to the next: the dictionary holds each distinct phrase once, the parse is the sequence of phrases. Corpus order
comes from both: two windows whose phrase suffixes differ are in the order of these suffixes, those with the
same phrase suffix in the order of what follows it in the parse. As no phrase suffix that ends with a trigger is
a prefix of another, equal windows stand side by side in that order.

The order is built where windows can be equal at all. A window belongs to the first trigger in it, and with the
window it fixes some of the trigger's surroundings: those on the right where the trigger lies in the window's
first half, those on the left otherwise. Surroundings that stand once in the corpus have no repeats; those that
stand more often are buckets (equal runs of windows at equal distances in a text are one row), and each bucket's suffix array is made from the suffix array of its phrases and the
order of their continuations. A phrase that the parse holds twice with its continuation needs no look at its
bytes, so a copy is never looked at twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import Scratch, id_and_text

#: Bytes of a window and of the rolling hash; one place in PERIOD is a trigger.
LENGTH, ROLLING, PERIOD = 200, 12, 40
#: Rows of one bucket that a task orders together; a larger bucket is split by what its windows have further in common.
ROWS = 4096
_PIECE = 256 << 10
_REVERSED = np.arange(255, -1, -1)


class Parse:
    """Runs of window starts that share a bucket, for the texts of one piece.

    Of each run: text `of`, first window start `lo`, number of starts `m`, place of the trigger's end `end`
    (where the phrase ends), start `at` and size `width` of the surroundings that all its windows hold. A run
    without a trigger is a single window, which is its own surroundings.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, rolling: int, period: int):
        n = len(data)
        z = np.zeros(0, np.int64)
        self.data, self.offsets, self.length = data, offsets, length
        self.of = self.lo = self.m = self.end = self.at = self.width = z
        if n < length:
            return
        p, q = S.powers(n + 1)
        total = np.zeros(n + 1, S.U)
        np.cumsum(S.byte_values()[data] * p[:n], out=total[1:])
        h = S.mix((total[rolling:] - total[:-rolling]) * q[: n - rolling + 1])
        triggers = np.flatnonzero(h % S.U(period) == 0)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        starts = np.flatnonzero(np.arange(n) + length <= ends)
        if not len(starts):
            return
        of = np.searchsorted(offsets, starts, side="right") - 1
        far = n + length
        nearest = np.append(triggers, far)[np.searchsorted(triggers, starts)]
        before = nearest - starts  # bytes of the window that stand before its first trigger
        without = before > length - rolling
        half = (length - rolling) // 2
        kind = np.where(without, 2, (before > half).astype(np.int64))
        new = np.ones(len(starts), dtype=bool)
        new[1:] = without[1:] | (nearest[1:] != nearest[:-1]) | (kind[1:] != kind[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        self.of, self.lo, self.m = of[first], starts[first], np.diff(np.append(first, len(starts)))
        kind, t = kind[first], nearest[first]
        self.end = np.where(kind == 2, self.lo + length, t + rolling)
        # a window that starts `d` before the trigger holds length - d bytes from the trigger on: the least is that of d = half
        self.at = np.where(kind == 2, self.lo, np.where(kind == 1, t - half, t))
        self.width = np.where(kind == 2, length, np.where(kind == 1, half + rolling, length - half))

    def buckets(self) -> np.ndarray:
        return S.span_hashes(self.data, self.at, self.at + self.width)

    def entries(self) -> np.ndarray:
        """Fingerprint of each run: all bytes of its windows, and where its phrase ends in them."""
        h = S.span_hashes(self.data, self.lo, self.lo + self.m + self.length - 1, _REVERSED)
        return S.mix(h ^ S.mix((self.end - self.lo + 1).astype(S.U) * S._K))


    def series(self) -> tuple[np.ndarray, ...]:
        """Equal runs of a text at equal distances as one: numbers of the first runs, their buckets and fingerprints, how often each stands, and the distance.

        A text of period p, however long, has at most some p series instead of a run or more for each period.
        """
        h, e = self.buckets(), self.entries()
        order = np.lexsort((self.lo, e, h, self.of))
        h, e, of, lo = h[order], e[order], self.of[order], self.lo[order]
        n = len(order)
        same = np.zeros(n, dtype=bool)
        same[1:] = (of[1:] == of[:-1]) & (h[1:] == h[:-1]) & (e[1:] == e[:-1])
        step = np.where(same, np.diff(lo, prepend=0), 0)
        new = ~same
        new[1:] |= same[:-1] & (step[1:] != step[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, n))
        return order[first], h[first], e[first], times, np.where(times > 1, step[np.minimum(first + 1, n - 1)], 0) if n else times


def _counts(texts: DataFrame, *how: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for b in S.pieces(whole, "text", _PIECE):
                h, n = np.unique(Parse(*S.string_buffers(b.column(0)), *how).buckets(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _runs(texts: DataFrame, *how: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for b in S.pieces(whole, "text", _PIECE):
                p = Parse(*S.string_buffers(b.column(1)), *how)
                k, h, e, times, step = p.series()
                cols = [
                    pa.array(h.view(np.int64)), pa.array(e.view(np.int64)), b.column(0).take(pa.array(p.of[k])), pa.array((p.lo[k] - p.offsets[p.of[k]]).astype(np.int32)),
                    pa.array(p.m[k].astype(np.int16)), pa.array((p.end[k] - p.lo[k]).astype(np.int16)), pa.array(times << 32 | step),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "e", "uid", "lo", "m", "phrase", "series"])

    return texts.select("uid", "text").mapInArrow(run, "h long, e long, uid long, lo int, m short, phrase short, series long")


def _order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each string among the distinct ones in byte order, and the length of the common prefix of each rank with the one before."""
    width = -(-max((len(x) for x in strings), default=1) // 8) * 8 or 8
    size = np.array([len(x) for x in strings], np.int64)
    rows = np.zeros((len(strings), width), np.uint8)
    rows[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    words = rows.view(">u8").astype(S.U)
    order = np.lexsort((size, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1))))
    a, b = rows[order[1:]], rows[order[:-1]]
    apart = a != b
    common = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(size[order[1:]], size[order[:-1]]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (common < size[order[1:]]) | (common < size[order[:-1]])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, size[order[new]], np.concatenate([[0], common])[new]


def suffix_ranks(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a dictionary by prefix doubling: of every place of every phrase, one after the other, the rank of the suffix from there to the phrase's end.

    Equal suffixes have equal ranks. The second array says where each phrase's places begin.
    """
    size = np.array([len(x) for x in phrases], np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(phrases), np.uint8).astype(np.int64)
    rank = data + 1
    stop = np.repeat(base[1:], size)  # where each place's phrase ends
    places = np.arange(len(data))
    k, longest = 1, int(size.max(initial=0))
    while k < longest:
        ahead = np.minimum(places + k, len(data) - 1)
        second = np.where(places + k < stop, rank[ahead], 0)
        both = rank * (int(rank.max(initial=0)) + 2) + second
        rank = np.unique(both, return_inverse=True)[1].reshape(-1) + 1
        k *= 2
    return rank, base


class _Least:
    """Least value of any stretch of an array, by a table of powers of two."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while len(self.rows[-1]) > (half := 1 << (len(self.rows) - 1)):
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of x[a:b], a < b."""
        level = np.log2(np.maximum(1, b - a)).astype(np.int64)
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][a[at]], self.rows[k][b[at] - (1 << int(k))])
        return out


def repeated_windows(h: np.ndarray, m: np.ndarray, phrase: np.ndarray, context: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, number) of the windows that stand at least twice among some distinct runs, from the corpus order of their bucket.

    context: the bytes of all windows of a run; the first `phrase` of them are of its phrase, the rest is what
    follows in the parse. Runs in different buckets (h) never hold equal windows.
    """
    rank, base = suffix_ranks([c[:p] for c, p in zip(context, phrase.tolist(), strict=True)])
    follow, size, common = _order([c[p:] for c, p in zip(context, phrase.tolist(), strict=True)])
    of = np.repeat(np.arange(len(m)), m)
    k = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
    suffix = rank[base[of] + k]
    order = np.lexsort((follow[of], suffix, h[of]))
    of, k, suffix = of[order], k[order], suffix[order]
    same = np.flatnonzero((suffix[1:] == suffix[:-1]) & (h[of[1:]] == h[of[:-1]]))  # neighbours with the same phrase suffix
    a, b = follow[of[same]], follow[of[same + 1]]
    shared = np.where(a == b, size[a], 0)
    apart = np.flatnonzero(a < b)
    if len(apart):
        shared[apart] = _Least(common).between(a[apart] + 1, b[apart] + 1)
    equal = same[phrase[of[same]] - k[same] + shared >= length]
    hit = np.zeros(len(of), dtype=bool)
    hit[equal] = hit[equal + 1] = True
    return of[hit], k[hit]


def _compare(variants: DataFrame, length: int) -> DataFrame:
    """Variants of a bucket side by side: (h, e, hits), hits the repeated windows' numbers as 16-bit integers.

    The rows come sorted by bucket; a bucket that goes on in the next batch is carried over to it.
    """
    names = ["h", "e", "n", "m", "phrase", "context"]

    def judge(t: pa.Table) -> pa.RecordBatch:
        h, e, n, m, phrase = (t.column(x).to_numpy() for x in names[:5])
        of, k = repeated_windows(h, m.astype(np.int64), phrase.astype(np.int64), t.column("context").to_pylist(), length)
        keep = n[of] == 1
        order = np.argsort(of[keep], kind="stable")
        of, k = of[keep][order], k[keep][order].astype("<i2")
        at, first = np.unique(of, return_index=True)
        hits = [x.tobytes() for x in np.split(k, first[1:])] if len(at) else []
        return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(e[at]), pa.array(hits, pa.binary())], names=["h", "e", "hits"])

    def run(batches):
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
            if cut:
                yield judge(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and len(held):
            yield judge(held)

    return variants.repartition("h").sortWithinPartitions("h").select(*names).mapInArrow(run, "h long, e long, hits binary")


def _split(variants: DataFrame, length: int) -> DataFrame:
    """Single windows of the runs of very large buckets: a window's whole bytes are its bucket, however many runs there are."""

    def run(batches):
        for b in batches:
            h, e, n, m = (b.column(i).to_numpy() for i in range(4))
            context = b.column(4).to_pylist()
            base = np.cumsum([0, *(len(x) for x in context)])[:-1]
            of = np.repeat(np.arange(len(m)), m)
            k = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
            data, at = np.frombuffer(b"".join(context), np.uint8), base[of] + k
            w = [S.span_hashes(data, at, at + length, fold).view(np.int64) for fold in (None, _REVERSED)]
            yield pa.RecordBatch.from_arrays([pa.array(w[0]), pa.array(w[1]), pa.array(h[of]), pa.array(e[of]), pa.array(n[of]), pa.array(k.astype(np.int16))], names=["w", "v", "h", "e", "n", "k"])

    w = variants.select("h", "e", "n", "m", "context").mapInArrow(run, "w long, v long, h long, e long, n long, k short")
    again = w.groupBy("w", "v").agg(F.sum("n").alias("t")).where("t > 1").select("w", "v")
    hits = w.where("n = 1").join(again, ["w", "v"]).groupBy("h", "e").agg(F.sort_array(F.collect_set("k")).alias("ks"))

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array(x, "<i2").tobytes() for x in b.column(2).to_pylist()], pa.binary())], names=["h", "e", "hits"])

    return hits.mapInArrow(pack, "h long, e long, hits binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, rolling: int = ROLLING, period: int = PERIOD, rows: int = ROWS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary, kept_sha256), a row for each input row.

    Every byte goes that a `length`-byte string covers which also starts anywhere else, in the same text or in
    another; occurrences may overlap and are judged on the input. kept is what is left of a text that lost
    something, and null where nothing went and the text is its own result. A null text is empty, and a text
    shorter than `length` loses nothing; repeated rows are copies of each other. Ids play no part, so null and
    repeated ids are as good as others.
    """
    if not 0 < rolling <= length // 2 or not 0 < length < 1 << 14:
        raise ValueError("the rolling hash must fit twice into the window, and the window into 16 bits")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    how = (length, rolling, period)
    # rows are numbered once and for all in a written table: equal rows stay apart, and no hash can mix two up
    texts = id_and_text(docs, id_col, text_col).select("id", F.monotonically_increasing_id().alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    texts = scratch.save(texts, "texts", "zstd")
    repeated = scratch.save(_counts(texts, *how).where("n > 1").select("h"), "buckets")
    scratch.sweep()
    runs = scratch.save(_runs(texts, *how).join(repeated, "h", "left_semi"), "runs", "zstd")
    scratch.drop(repeated)
    scratch.sweep()
    place = F.struct("uid", "lo")
    dictionary = runs.groupBy("h", "e").agg(F.sum(F.shiftright("series", 32)).alias("n"), F.min(place).alias("first"), F.first("m").alias("m"), F.first("phrase").alias("phrase"))
    dictionary = scratch.save(dictionary, "dictionary", "zstd")
    scratch.sweep()
    per = dictionary.groupBy("h").agg(F.count("*").alias("v")).where("v > 1")
    # the bytes of each variant, from the first place where it stands
    wanted = dictionary.join(per, "h").groupBy("first.uid").agg(F.collect_list(F.struct("h", "e", "n", F.col("first.lo").alias("lo"), "m", "phrase", "v")).alias("w"))

    def bytes_of(batches):
        for b in batches:
            for text, w in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw, w = text.encode("utf-8", "surrogatepass"), w.values
                parts = [raw[a : a + k + length - 1] for a, k in zip(w.field("lo").to_pylist(), w.field("m").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(w.field(x) for x in ("h", "e", "n", "m", "phrase", "v")), pa.array(parts, pa.binary())], names=["h", "e", "n", "m", "phrase", "v", "context"])

    kinds = "h long, e long, n long, m short, phrase short, v long, context binary"
    each = scratch.save(texts.select("uid", "text").join(wanted, "uid").select("text", "w").mapInArrow(bytes_of, kinds), "variants")
    scratch.sweep()
    hits = _compare(each.where(F.col("v") <= rows), length).unionByName(_split(each.where(F.col("v") > rows), length))
    hits = scratch.save(hits, "hits")
    scratch.drop(each)
    twice = dictionary.where("n > 1").select("h", "e", "m", F.lit(None).cast("binary").alias("hits"))
    gone = scratch.save(runs.select("h", "e", "uid", "lo", "series").join(twice.unionByName(hits, allowMissingColumns=True), ["h", "e"]).groupBy("uid").agg(F.collect_list(F.struct("lo", "m", "series", "hits")).alias("runs")), "gone")
    scratch.drop(runs, dictionary, hits)
    scratch.sweep()

    def finish(batches):
        for b in batches:
            out = []
            runs = b.column(2)
            flat = runs.flatten()
            lo, m, series = flat.field("lo").to_numpy().astype(np.int64), flat.field("m").fill_null(0).to_numpy().astype(np.int64), flat.field("series").to_numpy()
            times, step = series >> 32, series & 0xFFFFFFFF
            ends = np.cumsum(runs.value_lengths().fill_null(0).to_numpy())
            hits = flat.field("hits")
            single = hits.is_valid().to_numpy(zero_copy_only=False)
            for i, text, z, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if not n:
                    out.append((i, len(raw), 0, 0, None, hashlib.sha256(raw).hexdigest()))
                    continue
                own = np.arange(z - n, z)
                some, whole = own[single[own]], own[~single[own]]
                at = [np.frombuffer(hits[int(k)].as_buffer(), "<i2").astype(np.int64) + lo[k] for k in some]
                edge = np.zeros(len(raw) + 1, np.int64)  # all windows of a run that stands twice go at once
                t = times[whole]
                start = np.repeat(lo[whole], t) + np.repeat(step[whole], t) * (np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t))
                np.add.at(edge, start, 1)
                np.add.at(edge, start + np.repeat(m[whole], t) + length - 1, -1)
                if at:
                    at = np.concatenate(at)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((i, len(raw), int(gone.sum()), spans, left, hashlib.sha256(left).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return texts.join(gone, "uid", "left").select("id", "text", "runs").mapInArrow(finish, schema)
