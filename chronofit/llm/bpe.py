"""Byte-level BPE: whole texts to token ids and back to raw bytes, by a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_arrow

#: Texts of more code points than this are cut at safe boundaries before the pattern runs over them.
SPLIT_AT = 1 << 16
#: A blank after anything but white space always starts a match of the pattern: no match goes on from the one to the other.
_SAFE = re.compile(r"(?<=\S) ")
_MADE: dict = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes, pattern: str):
    """The encoding of a rank file, made once in each Python process."""
    import tiktoken

    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _MADE:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}
        _MADE[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _MADE[key]


def safe_parts(text: str, size: int = SPLIT_AT):
    """Cut a text where a match of the pattern ends whatever stands around, each part of `size` code points or a little more."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc, text: str) -> np.ndarray:
    if len(text) <= SPLIT_AT:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in safe_parts(text)])


def encode(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """Add ids_col, the token ids as little-endian unsigned 32-bit integers in a binary, and count_col, their number.

    The ids are those of the tiktoken library without special tokens, whose strings are ordinary text. Texts are
    encoded whole; a null is an empty text, with no tokens. Columns of the two names are replaced, others stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file, whatever the input

    def make(columns):
        enc = encoding(shared.value, pattern)
        ids = [encode_text(enc, x or "") for x in columns[0].to_pylist()]
        return [len(x) for x in ids], [x.tobytes() for x in ids]

    return with_arrow(df, [text_col], [T.StructField(count_col, T.LongType()), T.StructField(ids_col, T.BinaryType())], make)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add bytes_col: the raw bytes of the ids, never decoded to text on the way; null ids give empty bytes.

    An id that the rank file doesn't have fails the task.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make(columns):
        enc = encoding(shared.value, pattern)
        return [[enc.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in columns[0].to_pylist()]]

    return with_arrow(df, [ids_col], [T.StructField(bytes_col, T.BinaryType())], make)


def round_trip(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """encode() then decode() in one pass: adds n_tokens, ids and decoded."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make(columns):
        enc = encoding(shared.value, pattern)
        ids = [encode_text(enc, x or "") for x in columns[0].to_pylist()]
        return [len(x) for x in ids], [x.tobytes() for x in ids], [enc.decode_bytes(x.tolist()) for x in ids]

    return with_arrow(df, [text_col], [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())], make)


def id_array(ids: Column) -> Column:
    """Packed ids as array<long>."""
    hexed = F.hex(ids)
    at = F.sequence(F.lit(0), (F.length(hexed) / 8 - 1).cast("int"))
    byte = lambda i, k: F.substring(hexed, i * 8 + 1 + 2 * k, F.lit(2))
    return F.when(F.length(ids) > 0, F.transform(at, lambda i: F.conv(F.concat(*(byte(i, k) for k in (3, 2, 1, 0))), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))


def vocabulary(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """Rank file and pattern of an installed public vocabulary."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN
