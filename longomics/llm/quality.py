"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every whole text are taken from its bytes in one pass. Standardised statistics pass through ``features``
random cosines, which approximate a Gaussian kernel; every partition of the labelled rows sums its own normal
equations and the sums are added by row of the matrix, so only (features + 1) squared numbers reach the driver. Ridge
scores are put into a fixed number of bins over all training rows and calibrated by pooling adjacent violators.

Defined cases: a null text counts as empty and its statistics are 0; labels without a quality are not learnt from,
repeated ones count again; without any label every score is 0.5; repeated documents give repeated results; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut
from .base import SPACE, chunks, shingle_hashes, text_bytes, unique_per_row, word_hashes

CHUNK = 4 << 20
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?",
    "shout": b"!", "bar": b"|<>", "sign": b"#$%&*=+@^~_\\/", "quote": b"\"'()[]{}-", "line": b"\n\r"}
NAMES = ["log_words", "log_bytes", "word_length", "longest_word", "distinct_words", "distinct_pairs", "words_a_line",
         "other", *_CLASSES]
_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _k, _members in enumerate(_CLASSES.values()):
    _OF[list(_members)] = _k


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(NAMES)) statistics of the texts in ``raw``."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = len(_CLASSES) + 1
    counts = np.bincount(row * kinds + _OF[raw], minlength=n * kinds).reshape(n, kinds)
    share = counts / np.maximum(size, 1)[:, None]
    solid = np.bincount(row, weights=~SPACE[raw], minlength=n)
    words, at = word_hashes(raw, offsets)
    n_words = np.bincount(at, minlength=n).astype(float)
    some = np.maximum(n_words, 1)
    lines = counts[:, list(_CLASSES).index("line")] + 1
    pairs, pair_at = shingle_hashes(words, at, n, 2)
    distinct = np.bincount(unique_per_row(words, at)[1], minlength=n)
    distinct_pairs = np.bincount(unique_per_row(pairs, pair_at)[1], minlength=n)
    longest = np.zeros(n)
    if len(raw):
        gap = SPACE[raw].copy()
        ends = np.flatnonzero(np.concatenate((gap, [True])) | np.isin(np.arange(len(raw) + 1), offsets))
        runs = np.diff(np.concatenate(([-1], ends)))
        np.maximum.at(longest, np.minimum(np.searchsorted(offsets, np.maximum(ends - 1, 0), side="right") - 1, n - 1), runs)
    out[:, 0], out[:, 1] = np.log1p(n_words), np.log1p(size)
    out[:, 2] = np.minimum(solid / some, 40)
    out[:, 3] = np.log1p(longest)
    out[:, 4], out[:, 5] = distinct / some, distinct_pairs / some
    out[:, 6] = np.log1p(n_words / lines)
    out[:, 7] = share[:, -1]
    out[:, 8:] = share[:, :-1]
    return out


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``stats``, one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            parts = [statistics(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in chunks(offsets, CHUNK)]
            flat = np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(NAMES)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=[key, "stats"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Model:
    """Centre and scale of the statistics, cosines, ridge weights, calibration knots."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int):
        draw = np.random.default_rng(seed)
        self.centre, self.scale = centre, np.where(scale > 1e-9, scale, 1.0)
        self.slope = draw.normal(0, 1 / width, (len(NAMES), features))
        self.shift = draw.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def lift(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.centre) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(x @ self.slope + self.shift), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.value), 0, 1)


def _normal_equations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            z, y = model.lift(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            part = np.hstack([z.T @ z, (z.T @ y)[:, None]])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])
    return run


def _add(table: pa.Table) -> pa.Table:
    sums = np.sum(table["sums"].to_pylist(), axis=0)
    return pa.table({"i": table["i"][:1], "sums": pa.array([sums], pa.list_(pa.float64()))})


def pool_adjacent(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing weighted means."""
    blocks: list[list[float]] = []
    for v, c in zip(values, counts):
        blocks.append([v, c, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, c2, m2 = blocks.pop()
            v1, c1, m1 = blocks.pop()
            blocks.append([(v1 * c1 + v2 * c2) / (c1 + c2), c1 + c2, m1 + m2])
    return np.concatenate([np.full(int(m), v) for v, _, m in blocks])


def fit(stats: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", label: str = "quality",
        features: int = 192, width: float = 3.0, ridge: float = 1e-3, bins: int = 512, seed: int = 11) -> Model:
    """Model from the rows of ``labels`` with a label whose ``key`` satisfies ``train``."""
    wanted = labels.where(train & F.col(label).isNotNull()).select(key, F.col(label).cast("double").alias("_y"))
    rows = cut(stats.join(wanted, key).select("stats", "_y"))
    moments = rows.select(F.count(F.lit(1)).alias("n"), *[f(F.col("stats")[k]).alias(f"{name}{k}")
                          for k in range(len(NAMES)) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), features, width, seed)
    model = Model(np.array([moments[f"m{k}"] for k in range(len(NAMES))]), np.array([moments[f"s{k}"] for k in range(len(NAMES))]),
                  features, width, seed)
    summed = rows.mapInArrow(_normal_equations(model), "i int, sums array<double>") \
        .groupBy("i").applyInArrow(_add, "i int, sums array<double>").orderBy("i").toPandas()
    total = np.stack(summed["sums"].to_list())
    left = total[:, :-1] + ridge * moments["n"] * np.diag([1.0] * features + [0.0]) / features
    model.weights = np.linalg.solve(left + 1e-9 * np.eye(len(left)), total[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(bins), np.zeros(bins, np.int64)
        for batch in batches:
            if len(batch):
                at = np.clip(((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * bins).astype(int), 0, bins - 1)
                sums += np.bincount(at, weights=batch.column(1).to_numpy(zero_copy_only=False), minlength=bins)
                counts += np.bincount(at, minlength=bins)
        keep = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array(sums[keep]), pa.array(counts[keep])], names=["bin", "y", "n"])

    curve = rows.mapInArrow(binned, "bin int, y double, n long").groupBy("bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n")) \
        .orderBy("bin").toPandas()
    model.at = (curve["bin"].to_numpy() + 0.5) * 2 / bins - 0.5
    model.value = pool_adjacent((curve["y"] / curve["n"]).to_numpy(), curve["n"].to_numpy())
    return model


def score(stats: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(1))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    return stats.select(key, "stats").mapInArrow(run, f"`{key}` {stats.schema[key].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, score, predicted for every row of ``docs``; texts are read once, their statistics written once."""
    stats = cut(describe(docs, key, text))
    return score(stats, fit(stats, labels, train, key, label), key)
