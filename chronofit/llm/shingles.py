"""Numpy kernels over the bytes of an Arrow string column: word hashes, shingle sets, SuperMinHash signatures.

All of them work on one Arrow batch; their memory follows the batch (or its longest text), not the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U(0x9E3779B97F4A7C15)
_K = U(0xD6E8FEB86659FD93)
#: A value of its own for each byte; a rule, not a table.
_BYTE = None


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit moves every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_values() -> np.ndarray:
    global _BYTE
    if _BYTE is None:
        _BYTE = mix(np.arange(1, 257, dtype=U) * _STEP)
    return _BYTE


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_words() -> np.ndarray:
    """Bytes that belong to a word: all but space and \\x09 to \\x0D."""
    t = np.ones(256, dtype=bool)
    t[0x20] = False
    t[0x09:0x0E] = False
    return t


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("") if not pa.types.is_binary(column.type) else column.fill_null(b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word: maximal runs of member bytes that don't cross a text's border."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = member[data]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i < n, kept for the next batch while they are small."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < n:
        size = max(n, 1 << 19)
        p, q = np.full(size, U(_BASE)), np.full(size, U(_INVERSE))
        p[0] = q[0] = 1
        made = np.cumprod(p), np.cumprod(q)
        if size > 1 << 21:
            return made[0][:n], made[1][:n]
        _POWERS = made
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span of bytes; fold maps bytes first (say, to lower case)."""
    if not len(starts):
        return np.zeros(0, U)
    values = byte_values() if fold is None else byte_values()[fold]
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U) * _K)


def shingles(hashes: np.ndarray, text_of: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each k-word shingle; a text of fewer words, but not none, has its whole sequence as one."""
    counts = np.bincount(text_of, minlength=n_texts)
    out, of = [], []
    if len(hashes) >= k:
        m = len(hashes) - k + 1
        h = hashes[:m].copy()
        for j in range(1, k):
            h = mix(h * _K + hashes[j : j + m])
        same = text_of[:m] == text_of[k - 1 :]
        out.append(h[same])
        of.append(text_of[:m][same])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.cumsum(counts) - counts
        h = np.full(len(short), U(0x5851F42D4C957F2D))
        for j in range(k - 1):
            more = counts[short] > j
            h[more] = mix(h[more] * _K + hashes[first[short[more]] + j])
        out.append(h)
        of.append(short)
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out, of = np.concatenate(out), np.concatenate(of)
    if len(short):
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def distinct(hashes: np.ndarray, text_of: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text once, ascending: hashes in the order of texts, and offsets by text."""
    counts = np.bincount(text_of, minlength=n_texts)
    ends = np.cumsum(counts)
    parts = [np.unique(hashes[e - c : e]) for c, e in zip(counts, ends, strict=True)]
    offsets = np.zeros(n_texts + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U)), offsets


def set_keys(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each set, as an (n, 2) array; equal sets have equal digests."""
    out = np.zeros((len(offsets) - 1, 2), U)
    sizes = np.diff(offsets).astype(U)
    for c, seed in enumerate((U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A35))):
        total = np.zeros(len(sets) + 1, U)
        np.cumsum(mix(sets ^ seed), out=total[1:])
        out[:, c] = mix(total[offsets[1:]] - total[offsets[:-1]] + sizes * seed)
    return out


EMPTY = U(0xFFFFFFFFFFFFFFFF)


def super_minhash(sets: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, (texts, m) of unsigned 64-bit: the element's rank j in the high half, its draw in the low.

    Each element walks a random permutation of the m slots; at its j-th slot it offers j + r, r in [0, 1).
    As an offer of rank j + 1 beats none of rank j, all elements of all texts of the batch are walked rank by
    rank, and a text stops as soon as its slots are full: later ranks can't change it. A text without elements
    keeps EMPTY.
    """
    n = len(offsets) - 1
    sig = np.full(n * m, EMPTY, U)
    of = np.repeat(np.arange(n), np.diff(offsets))
    el = sets
    perm: np.ndarray | None = None
    for j in range(m):
        if not len(el):
            break
        x = mix(el + U(int(_STEP) * (j + 1) & (1 << 64) - 1))
        k = j + (((x & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)
        value = (U(j) << U(32)) | (x >> U(32))
        if j == 0:
            slot = k
        else:
            if perm is None:  # after rank 0 only: the first swap is made up for here
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(el), 1))
                rows = np.arange(len(el))
                perm[rows, first] = 0
                perm[:, 0] = first
            rows = np.arange(len(el))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, of * m + slot, value)
        open_ = (sig.reshape(n, m) == EMPTY).any(axis=1)
        keep = open_[of]
        if not keep.all():
            el, of, k = el[keep], of[keep], k[keep]
            if perm is not None:
                perm = perm[keep]
        if j == 0:
            first = k
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U) * _STEP), (len(sig), bands)).copy()
    for j in range(rows):
        h = mix(h * _K + parts[:, :, j])
    return h


def text_sets(column: pa.Array, k: int, member: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a string column."""
    data, offsets = string_buffers(column)
    starts, ends, of = words(data, offsets, member)
    h, of = shingles(span_hashes(data, starts, ends, fold), of, len(offsets) - 1, k)
    return distinct(h, of, len(offsets) - 1)


def pieces(batch: pa.RecordBatch, column: str, most: int = 512 << 10):
    """Slices of a batch of about `most` bytes of text, one text at least, to bound the kernels' memory."""
    col = batch.column(batch.schema.get_field_index(column))
    _, offsets = string_buffers(col)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)
