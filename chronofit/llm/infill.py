"""Fill-in-middle: cut texts at two ranks of their units, found by an indexable skip list, and reorder the parts."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_arrow

#: A unit of a text, matched from left to right.
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
#: Sentinels of prefix, suffix and middle; a text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One unit in so many, on average, is a node of the lowest express lane, and of each lane one in so many is in the next.
SPARSE, THIN = 32, 4
#: Code points that are looked at together while the lanes are built.
PIECE = 1 << 20


def _heights(ranks: np.ndarray) -> np.ndarray:
    """A node's pseudo-random 64 bits, from its rank alone, so a text always has the same lanes."""
    x = ranks.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SkipList:
    """The units of a text under express lanes; a link of a lane carries its width in units and in code points.

    The bottom lane is the text itself, so what is kept is a small part of it. `n` is the number of units.
    """

    def __init__(self, text: str):
        self.text = text
        ranks, places, self.n = [], [], 0
        for at in range(0, len(text), PIECE):
            code = np.frombuffer(text[at : at + PIECE + 1].encode("utf-32-le", "surrogatepass"), "<u4")
            letter = ((code | 32) - np.uint32(97)) < 26
            last = np.ones(min(PIECE, len(code)), bool)  # does a unit end with this code point?
            m = min(len(last), len(code) - 1)
            last[:m] = ~(letter[:m] & letter[1 : m + 1])
            ends = np.flatnonzero(last) + 1
            rank = self.n + 1 + np.arange(len(ends))
            node = _heights(rank) % np.uint64(SPARSE) == 0
            ranks.append(rank[node])
            places.append(ends[node] + at)
            self.n += len(ends)
        # of each lane, from the lowest: the widths of its links in units and in code points, and where its nodes (the first is the head) stand one lane below
        self.lanes: list[tuple[list[int], list[int], list[int]]] = []
        rank = np.concatenate(ranks) if ranks else np.zeros(0, np.int64)
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        below, bits = np.arange(len(rank)), _heights(rank) // np.uint64(SPARSE)
        while len(rank):
            self.lanes.append((np.diff(rank, prepend=0).tolist(), np.diff(place, prepend=0).tolist(), [0, *(below + 1).tolist()]))
            up = bits % np.uint64(THIN) == 0
            below, rank, place, bits = np.flatnonzero(up), rank[up], place[up], bits[up] // np.uint64(THIN)

    def place(self, rank: int) -> int:
        """The code points that the first `rank` units take, 0 <= rank <= n."""
        left, at, node = rank, 0, 0
        for units, chars, down in reversed(self.lanes):
            while node < len(units) and units[node] <= left:
                left -= units[node]
                at += chars[node]
                node += 1
            node = down[node]
        for _ in range(left):
            at = UNIT.match(self.text, at).end()
        return at


def _numbers(doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the sha256 of `1:` and the id; a null id counts as no digits."""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(d[i : i + 4], "big") for i in (0, 4, 8, 12)]


def reordered(doc_id: int | None, text: str, plain_from: int = 90, spm_under: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and of middle (None where plain), and the output of one text."""
    units = SkipList(text)
    h = _numbers(doc_id)
    if not text or h[2] % 100 >= plain_from or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return units.n, "plain", None, None, text
    a, b = (units.place(r) for r in sorted(x % (units.n + 1) for x in h[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_under:
        return units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def original(output: str, form: str) -> str:
    """The text that an output was made of. A sentinel can't arise where parts meet, as none begins with the end of another."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_from: int = 90, spm_under: int = 20) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output: each text cut at two of its unit borders and reordered.

    n counts the units. Ranks, form and the share that stays plain (100 - plain_from in 100) follow from the id alone;
    of the others, spm_under in 100 put the suffix first. A text that is null (taken as empty), empty or holds a
    sentinel stays plain. Rows are judged one by one, so repeated rows come out alike and an empty table stays empty; a
    null id counts as one without digits. Columns of the five names are replaced, all others stay. Besides the text
    and its output, a task holds some 60 bytes for every 24 units of the longest text.
    """

    def make(columns):
        rows = [reordered(i, t or "", plain_from, spm_under) for i, t in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(5)]

    long, text = T.LongType(), T.StringType()
    fields = [T.StructField(name, kind) for name, kind in (("n", long), ("form", text), ("prefix_chars", long), ("middle_chars", long), ("output", text))]
    return with_arrow(df, [id_col, text_col], fields, make)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "restored") -> DataFrame:
    """Add text_col: the exact text that each output was made of, from output and form alone; a null output gives an empty text."""

    def make(columns):
        return [[original(o or "", f or "plain") for o, f in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)]]

    return with_arrow(df, [output_col, form_col], [T.StructField(text_col, T.StringType())], make)
