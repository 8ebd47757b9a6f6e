"""Secrets in texts: fixed patterns, and strings that a tokenizer's vocabulary can't shorten, as only random ones are."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoding
from .common import id_and_text, with_arrow

#: In the order in which spans of one start are listed; the last is that of the token-efficiency test.
KINDS = ("assign", "access", "hex", "random")
# Fixed patterns of the base detector; letters of other scripts never stand for ASCII ones.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Characters of a run that is put to the test, at least.
SHORTEST = 20
#: Characters per token under which a run counts as random. Random letters and digits lie near 1.25 (99 % under 1.7), words of prose and code mostly over 2.
RATIO = 1.75
#: Runs are tokenized in stretches of so many characters.
STRETCH = 1024
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}+={0,2}" % SHORTEST)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Hexadecimal digits of MD5, SHA-1 (and RIPEMD-160), SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_INTEGRITY = re.compile(r"sha(?:256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)")
_PARTS = re.compile(r"[-_/+=]+")
# What a name, number or code is made of: digits; a word in one or two cases, or several with inner capitals, and a short number; at most three characters.
_NAME_PART = re.compile(r"[0-9]+|(?:[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*)[0-9]{0,4}|[A-Za-z0-9]{1,3}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns by start, then kind; leftmost non-overlapping per kind, failing matches dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def known(text: str, start: int, end: int) -> bool:
    """Is the run text[start:end] a digest, a UUID, embedded data, or a name made of words and numbers?"""
    run = text[start:end]
    if _UUID.fullmatch(run) or _INTEGRITY.fullmatch(run) or text.endswith("base64,", max(0, start - 7), start):
        return True
    parts = [p for p in _PARTS.split(run) if p]
    if _DIGEST.fullmatch(parts[-1] if parts else "") and len(parts[-1]) in _DIGEST_LENGTHS and all(_NAME_PART.fullmatch(p) for p in parts[:-1]):
        return True  # alone or after a name such as that of its function
    return all(_NAME_PART.fullmatch(p) for p in parts)


def random_spans(text: str, n_tokens: Callable[[str], int], ratio: float = RATIO) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of runs of key characters with fewer than `ratio` characters a token that aren't known()."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        if known(text, a, b):
            continue
        tokens = sum(n_tokens(text[i : min(b, i + STRETCH)]) for i in range(a, b, STRETCH))
        if b - a < ratio * tokens:
            yield 3, a, b


def all_spans(text: str, n_tokens: Callable[[str], int], ratio: float = RATIO) -> tuple[list, list]:
    """The patterns' spans, and these with the random ones that overlap none of them, both by start, then kind."""
    base = base_spans(text)
    every, i, reach = list(base), 0, 0
    for k, a, b in random_spans(text, n_tokens, ratio):
        while i < len(base) and base[i][1] < b:  # reach: where the spans that begin before this run's end are over
            reach = max(reach, base[i][2])
            i += 1
        if reach <= a:
            every.append((k, a, b))
    return base, sorted(every, key=lambda s: (s[1], s[0]))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """(id, base, spans, n_assign, n_access, n_hex, secrets) of every whole text, a row for each input row.

    base lists the patterns' spans as kind:start:end by start, then kind, in code points, ends exclusive, and the counts
    are theirs; spans lists these and the random strings; secrets holds the texts of all spans. A null or empty text has
    none; repeated rows are treated alike; an empty table gives none; further columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file, whatever the input

    def make(columns):
        enc = encoding(shared.value, pattern)
        texts = [x or "" for x in columns[0].to_pylist()]
        found = [all_spans(x, lambda s: len(enc.encode_ordinary(s)), ratio) for x in texts]
        counts = [[sum(s[0] == k for s in b) for b, _ in found] for k in range(3)]
        return [spans_text(b) for b, _ in found], [spans_text(e) for _, e in found], *counts, [[x[a:z] for _, a, z in e] for x, (_, e) in zip(texts, found, strict=True)]

    fields = [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("secrets", T.ArrayType(T.StringType()))]
    return with_arrow(id_and_text(docs, id_col, text_col), ["text"], fields, make).drop("text")


def redact(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """docs with every stretch that spans of find() cover replaced by [SECRET]; a null text stays null, other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def clean(text: str | None, enc) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for _, a, b in all_spans(text, lambda s: len(enc.encode_ordinary(s)), ratio)[1]:
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def make(columns):
        enc = encoding(shared.value, pattern)
        return [[clean(x, enc) for x in columns[0].to_pylist()]]

    order = docs.columns
    return with_arrow(docs, [text_col], [T.StructField(text_col, T.StringType())], make).select(*(F.col(f"`{c}`") for c in order))
