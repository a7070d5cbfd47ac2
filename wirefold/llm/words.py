"""Word and shingle hashes of whole texts, for the operators that compare documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Base of the word polynomial and its inverse modulo 2^64; texts are hashed in parts of so many bytes.
_BASE = 0xD1342543DE82EF93
_INVERSE = pow(_BASE, -1, 1 << 64)
PART = 1 << 22
#: Lower-cases A-Z, and makes the other ASCII white space blanks.
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


_byte = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, remembered."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def _part_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    np.not_equal(b, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_byte[b] * _power(_BASE, len(b)), out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _power(_INVERSE, len(b) + 1)[starts])


def word_hashes(text: str | None, fold: bytes = LOWER) -> np.ndarray:
    """64-bit hash of each word of the text, in order. ``fold`` maps every byte of its UTF-8 form
    and makes blanks of all that is no word. A word's hash is a polynomial of hashed bytes, which
    prefix sums give for all words of a text at once."""
    raw = (text or "").encode().translate(fold)
    out, at = [], 0
    while len(raw) - at > PART and (cut := raw.find(b" ", at + PART)) >= 0:
        out.append(_part_hashes(raw[at:cut]))
        at = cut
    out.append(_part_hashes(raw[at:]))
    return out[0] if len(out) == 1 else np.concatenate(out)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` words, by position."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= np.uint64(_STEP)
        out += hashes[j:j + n]
    return _mixed(out)


def low_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """One bit for each value of a long column, at its low ``bits`` bits. The bits are OR-ed on the
    executors; at most 2^bits of them (2^(bits - 5) rows) reach the driver, whatever the input."""
    slot = F.expr(f"{column} & {(1 << bits) - 1}")
    rows = (df.select(slot.alias("slot")).groupBy(F.expr("slot >> 5").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[rows.word.to_numpy(np.int64)] = rows.bits.to_numpy(np.int64).astype(np.uint32)
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit values may have been put into the bitmap."""
    slot = values & np.uint64(len(bits) * 32 - 1)
    return (bits[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
