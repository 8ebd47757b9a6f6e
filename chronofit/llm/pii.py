"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds spans to theirs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, small_batches, with_arrow
from .tagger import Tagger, char_ids

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base detector. Each is found where the plain pattern would be, without its repeated scans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")

#: Characters of a window and its step; each character takes the window in which it stands most inside.
WINDOW, STEP = 256, 224
#: Characters of a training window, and how often each is rewritten.
SAMPLE, REWRITES = 96, 3
#: Documents (on average) and windows, at most, that the tagger is trained on; the only bounded sample here.
FIT_DOCS, FIT_WINDOWS = 20_000, 3000
#: Training batches, their size, and Adam's first rate.
STEPS, BATCH, RATE = 170, 256, 0.04
_N_TAGS = 1 + 2 * len(KINDS)
_AT_ONCE = 2000  # windows that run together: the calls of a step then cost little beside its numbers


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start; leftmost non-overlapping per kind, failing matches dropped."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = re.sub("[ -]", "", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def tag_sequence(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """0 outside, 1 + 2k where a span of kind k begins, 2 + 2k inside it; later kinds give way to earlier ones."""
    tags = np.zeros(n, np.int64)
    for k, a, b in sorted(spans, reverse=True):
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def training_windows(docs: DataFrame, id_col: str, text_col: str, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows with their labelled spans, from a bounded sample of documents chosen by hash: half of them hold a span where there are enough."""
    texts = id_and_text(docs, id_col, text_col).where("id is not null and text is not null")
    share = F.pmod(F.xxhash64(F.lit("tagger"), "id"), F.lit(1 << 30)) < int(min(1.0, fit_docs / max(1, docs.count())) * (1 << 30))

    def run(batches):
        for b in batches:
            ids, at, w, t = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = base_spans(text)
                for p in range(0, max(1, len(text) - SAMPLE // 2), SAMPLE):
                    own = [(k, a - p, z - p) for k, a, z in spans if a >= p and z <= p + SAMPLE]
                    if any(a < p + SAMPLE and z > p for _, a, z in spans) and not own:
                        continue  # holds a part of a span only
                    ids.append(i)
                    at.append(p)
                    w.append(text[p : p + SAMPLE])
                    t.append(",".join(f"{k}:{a}:{z}" for k, a, z in own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(w, pa.string()), pa.array(t, pa.string())], names=["id", "at", "w", "t"])

    found = texts.where(share).mapInArrow(run, "id long, at long, w string, t string")
    order = [F.xxhash64("id", "at"), F.col("id"), F.col("at")]
    some = found.where("t <> ''").orderBy(*order).limit(fit_windows // 2).collect() + found.where("t = ''").orderBy(*order).limit(fit_windows - fit_windows // 2).collect()
    return [(r["w"], [tuple(map(int, x.split(":"))) for x in r["t"].split(",")] if r["t"] else []) for r in some]


def variant(kind: int, span: str, g: np.random.Generator) -> str:
    """A span of a kind written otherwise, so that the patterns miss it, with new digits and letters."""
    digits = lambda n: "".join(str(x) for x in g.integers(0, 10, n))
    pick = lambda *x: x[int(g.integers(len(x)))]
    if kind == 0:
        local, _, domain = span.partition("@")
        at, dot = pick(("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "))
        return "".join(chr(97 + int(x)) for x in g.integers(0, 26, 4)) + local[-6:] + at + domain.replace(".", dot)
    if kind == 1:
        return pick("[.]", " . ", "(.)").join(str(x) for x in g.integers(0, 256, 4))
    if kind == 2:
        return pick(".", "/", "_", " - ", "  ").join(digits(4) for _ in range(4))
    a, b, c = digits(3), digits(3), digits(4)
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 ({a}) {b}-{c}", f"001 {a} {b} {c}", f"({a}) {b} {c}")


def decoy(g: np.random.Generator) -> str:
    """Digits that are no personal data: numbers, dates, times, prices, versions, codes and hexadecimal strings."""
    n = lambda low, high: int(g.integers(low, high))
    return (
        str(n(0, 10 ** n(1, 13))), f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(0, 24)}:{n(0, 60):02}:{n(0, 60):02}",
        f"{n(1, 1000)},{n(0, 1000):03}.{n(0, 100):02}", f"v{n(0, 20)}.{n(0, 20)}.{n(0, 100)}", f"{chr(65 + n(0, 26))}{n(10, 99)}-{n(1000, 99999)}", "".join("0123456789abcdef"[int(x)] for x in g.integers(0, 16, 40)),
        f"{n(1, 100)}%", f"+{n(1, 100)}", f"{n(1, 100)} - {n(100, 1000)}", f"({n(1, 100)})",
    )[n(0, 12)]


_MODELS = ("ada.l@mail.example.com", "10.0.0.1", "4539578763621486", "+1 (743) 555-3824")  # stand in for kinds that the sample lacks


def examples(windows: list[tuple[str, list]], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags of the windows, each as it is and rewritten: spans become variants, and windows without one get a variant or a decoy at a blank."""
    g = np.random.default_rng(seed)
    rows: list[tuple[str, list]] = []
    for text, spans in windows:
        rows.append((text, spans))
        for _ in range(REWRITES):
            out, made, at = "", [], 0
            for k, a, z in sorted(spans, key=lambda s: s[1]):
                if a >= at:
                    new = variant(k, text[a:z], g)
                    out += text[at:a]
                    made.append((k, len(out), len(out) + len(new)))
                    out, at = out + new, z
            out += text[at:]
            if not spans:
                blanks = [i for i, c in enumerate(text) if c == " "]
                p = blanks[int(g.integers(len(blanks)))] + 1 if blanks else 0
                k = int(g.integers(2 * len(KINDS)))
                new = variant(k, _MODELS[k], g) if k < len(KINDS) else decoy(g)
                out, made = f"{text[:p]}{new} {text[p:]}", [(k, p, p + len(new))] if k < len(KINDS) else []
            rows.append((out[:SAMPLE], [s for s in made if s[2] <= SAMPLE]) if all(s[2] <= SAMPLE or s[1] >= SAMPLE for s in made) else (text, spans))
    ids, tags = np.zeros((len(rows), SAMPLE), np.uint8), np.zeros((len(rows), SAMPLE), np.int64)
    for i, (text, spans) in enumerate(rows):
        ids[i, : len(text)] = char_ids(text)
        tags[i, : len(text)] = tag_sequence(len(text), spans)
    return ids, tags


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS, **sample: int) -> Tagger:
    """Train the tagger on labelled spans: those of the patterns, and the same written so that the patterns miss them.

    An empty table, or one without texts, gives an untrained tagger that finds nothing.
    """
    small_batches(docs.sparkSession)
    windows = training_windows(docs, id_col, text_col, **sample)
    model = Tagger(_N_TAGS)
    if windows:
        ids, tags = examples(windows)
        model.fit(ids, tags, -(-steps // -(-len(ids) // BATCH)), BATCH, RATE)
    else:
        model.p["o"][0] = 50
    return model


_NUMBER = re.compile("[0-9]+")


def plausible(kind: int, s: str) -> bool:
    """What a tagged span must hold at least to be reported."""
    numbers = _NUMBER.findall(s)
    digits = "".join(numbers)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]+)+", s))
    if kind == 1:
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers) and not any(c.isalpha() for c in s)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in s)
    return 10 <= len(digits) <= 15 and len(numbers) > 1 and not any(c.isalpha() for c in s)


#: Without one of these no text is plausible() as any kind.
_NEEDED = re.compile(r"@|\[at\]|\(at\)|[0-9](?:[^0-9]*[0-9]){3}")


def _emissions(model: Tagger, ids: np.ndarray) -> np.ndarray:
    """Emissions of every character of a text or of several, end to end, each from the window in which it stands most inside."""
    n, edge = len(ids), (WINDOW - STEP) // 2
    windows = max(1, -(-(n - edge) // STEP))
    padded = np.zeros((windows - 1) * STEP + WINDOW, np.uint8)
    padded[: min(n, len(padded))] = ids[: len(padded)]
    out = np.empty((windows * STEP + 2 * edge, _N_TAGS), np.float32)
    for lo in range(0, windows, _AT_ONCE):
        starts = np.arange(lo, min(windows, lo + _AT_ONCE)) * STEP
        rows = np.lib.stride_tricks.sliding_window_view(padded[starts[0] : starts[-1] + WINDOW], WINDOW)[::STEP]
        e = model.emissions(rows).transpose(1, 0, 2)
        if not lo:
            out[:edge] = e[0, :edge]
        out[starts[0] + edge : starts[-1] + edge + STEP].reshape(len(e), STEP, _N_TAGS)[:] = e[:, edge : edge + STEP]
    out[windows * STEP + edge :] = e[-1, edge + STEP :]
    return out[:n]


def tagged_spans(model: Tagger, texts: list[str], margin: float = 0.5) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger finds in each whole text.

    Every character of every text passes the network, in overlapping windows. Each takes the emissions of the window
    in which it stands most inside, and one decoding over the reconciled emissions follows, which leaves out only
    stretches where the tagger's scores rule out any other path than "outside". A span counts if its mean emission
    beats that of "outside" by `margin`, and if it is plausible(); stretches that hold no such text aren't decoded.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    gap = np.zeros(WINDOW // 2, np.uint8)
    ids, base, at = [], [], 0
    for t in texts:
        ids += [char_ids(t), gap]
        base.append(at)
        at += len(ids[-2]) + len(gap)
    if not texts:
        return out
    e = _emissions(model, np.concatenate(ids))
    real = np.zeros(at, dtype=bool)
    for b, t in zip(base, texts, strict=True):
        real[b : b + len(t)] = True
    hot = np.flatnonzero(model.doubtful(e) & real)
    if not len(hot):
        return out
    cuts = np.flatnonzero(np.diff(hot) > 2)  # two steps in a row outside part the paths before from those after
    begin = np.array(base)
    for a, z in zip(hot[np.concatenate([[0], cuts + 1])].tolist(), hot[np.concatenate([cuts, [len(hot) - 1]])].tolist(), strict=True):
        d = int(np.searchsorted(begin, a, side="right")) - 1
        lo, hi = max(base[d], a - 1), min(base[d] + len(texts[d]), z + 2)
        em = e[lo:hi]
        if hi <= lo or not _NEEDED.search(texts[d], lo - base[d], hi - base[d]):
            continue  # whatever the path, none of its spans would be reported
        tags = model.viterbi(em)
        k = 0
        while k < len(tags):
            if not tags[k]:
                k += 1
                continue
            kind, stop = (tags[k] - 1) // 2, k + 1
            while stop < len(tags) and tags[stop] == 2 + 2 * kind:
                stop += 1
            gain = (em[k:stop][:, [1 + 2 * kind, 2 + 2 * kind]].max(axis=1) - em[k:stop, 0]).mean()
            p, q = lo - base[d] + k, lo - base[d] + stop
            if gain >= margin and plausible(int(kind), texts[d][p:q]):
                out[d].append((int(kind), p, q))
            k = stop
    return out


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def all_spans(model: Tagger, texts: list[str]) -> tuple[list, list]:
    """The patterns' spans of each text, and these with the tagger's that overlap none of them nor each other."""
    base = [base_spans(x) for x in texts]
    every = []
    for have, more in zip(base, tagged_spans(model, texts), strict=True):
        taken, kept = [(a, z) for _, a, z in have], list(have)
        for k, a, z in sorted(more, key=lambda s: s[1]):
            if all(z <= x or y <= a for x, y in taken):
                taken.append((a, z))
                kept.append((k, a, z))
        every.append(sorted(kept))
    return base, every


def find(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base string, spans string, n_email, n_ip, n_card, n_phone) of every whole text, a row for each input row.

    base lists the patterns' spans as kind:start:end by kind, then start, in code points; the counts are theirs.
    spans also holds those tagger spans that overlap no pattern span of any kind and no earlier tagger span. A
    null or empty text has none; repeated rows are treated alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 10,000 numbers, whatever the input

    def make(columns):
        texts = [x or "" for x in columns[0].to_pylist()]
        base, every = all_spans(shared.value, texts)
        counts = [[sum(s[0] == k for s in x) for x in base] for k in range(len(KINDS))]
        return [spans_text(x) for x in base], [spans_text(x) for x in every], *counts

    fields = [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS)]
    return with_arrow(id_and_text(docs, id_col, text_col), ["text"], fields, make).drop("text")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Tagger, text_col: str = "text") -> DataFrame:
    """docs with every span of find() replaced in the text by its kind in brackets; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(columns):
        texts = columns[0].to_pylist()
        _, every = all_spans(shared.value, [x or "" for x in texts])
        return [[x if x is None else masked(x, s) for x, s in zip(texts, every, strict=True)]]

    order = docs.columns
    return with_arrow(docs, [text_col], [T.StructField(text_col, T.StringType())], make).select(*(F.col(f"`{c}`") for c in order))
