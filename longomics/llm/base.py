"""Shared pieces: tables, stable document keys, Arrow batch helpers, vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# ASCII other than letters and digits.
MARKS = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

# Odd base and its inverse modulo 2**64 for the rolling word hash, and one odd factor per shingle place.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, grown by doubling and kept per worker."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                out = np.full(size, base, dtype=np.uint64)
                out[0] = 1
                _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text makes a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True,
                border: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of bytes outside ``border`` in order, and each run's row. Words end at row ends."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = LOWER[raw] if lower else raw
    inside = ~border[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begin = inside & (cut[:-1] | np.concatenate(([True], ~inside[:-1])))
    end = inside & (cut[1:] | np.concatenate((~inside[1:], [True])))
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64)))
        words = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return words, np.searchsorted(offsets, first, side="right") - 1


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of a row, or of all its words when there are fewer, with rows."""
    n = len(words)
    per_row = np.bincount(rows, minlength=n_rows)
    place = np.arange(n) - (np.cumsum(per_row) - per_row)[rows] if n else np.zeros(0, np.int64)
    left = per_row[rows] - place
    take = (left >= width) | (place == 0)
    at = np.flatnonzero(take)
    out = np.zeros(len(at), dtype=np.uint64)
    span = np.minimum(left[at], width)
    with np.errstate(over="ignore"):
        for k in range(width):
            ok = span > k
            out[ok] += (words[at[ok] + k] ^ np.uint64(k + 1)) * _PLACE[k]
        out += span.astype(np.uint64)
    return mix(out), rows[at]


def unique_per_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, rows ascending and values ascending inside a row."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]


def held_out(modulus: int, remainder: int, key: str = "doc_id"):
    """True where crc32 of the id as text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))
