"""Co-expression network of all pairs of genes, without a table of pairs.

The adjacency is kept as the scaled sample vectors that give it. Blocks of genes meet in a product without a shuffle, so
the tables grow with the genes while the time grows with their square. Overlaps are computed exactly wherever a bound
doesn't rule out that a pair reaches the limit, and for all pairs inside the groups that such pairs join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import ordered
from .moments import GENE
from ..llm.graph import components
from ..runtime import cut

DIGITS = 12
# Numbers in a block, parts of a side of a product, genes in a side of a tile, rows and columns at a time.
BLOCK, SIDES, TILE, STEP = 1 << 18, 24, 1024, (256, 1024)


@dataclass
class Network:
    """``genes``: (gene_id, n, x), vectors of the genes that vary; ``blocks``: (blk, n, z, label, low, high)."""

    genes: DataFrame
    blocks: DataFrame
    power: float
    count: int
    samples: int

    @property
    def error(self) -> float:
        """How far a weight in single precision may be off."""
        return 0.5 * max(self.power, 1) * 1.2e-7 * (self.samples + 8) + 1e-6


def weights(z: np.ndarray, other: np.ndarray, power: float) -> np.ndarray:
    t = z @ other.T
    t += 1
    t *= 0.5
    np.clip(t, 0, 1, out=t)
    if power < 1 or power != int(power):
        return t ** power
    out, left = None, int(power)
    while left:
        if left & 1:
            out = t if out is None else out * t
        left >>= 1
        t = t * t if left else t
    return out


def network(genes: DataFrame, power: float, size: int | None = None) -> Network:
    """The network of ``genes`` (gene_id, n, x), numbered from 0."""
    found = genes.agg(F.count(F.lit(1)).alias("count"), F.max(F.size("x")).alias("samples")).first()
    count, samples = found["count"], max(found["samples"] or 1, 1)
    size = size or block_size(count, samples, BLOCK)
    return Network(genes, pack(genes.select("n", "x", F.lit(0).cast("long").alias("label")), F.col("n"), size), power, count, samples)


def block_size(count: int, samples: int, most: int) -> int:
    """Genes of a block: at least ``SIDES`` blocks, so that all tasks have work, of at most ``BLOCK`` numbers."""
    return max(1, min(most, BLOCK // samples, max(64, -(-count // SIDES))))


def pack(rows: DataFrame, at: Column, size: int) -> DataFrame:
    """Blocks of ``size`` genes (n, x, label) by their places ``at``: numbers, scaled vectors and labels as bytes.

    A gene with a sample that has no number has no edge and is left out.
    """
    def body(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "n"])
        m = np.vstack(pdf["x"].to_numpy()).astype(np.float64)
        z = (m - m.mean(1, keepdims=True)) / (m.std(1, keepdims=True) * np.sqrt(m.shape[1]))
        ok = np.isfinite(z).all(1)
        n, label = (pdf[c].to_numpy(np.int64)[ok] for c in ("n", "label"))
        some = len(n) > 0
        return pd.DataFrame({"blk": [key[0]], "n": [n.tobytes()], "z": [z[ok].tobytes()], "label": [label.tobytes()],
                             "low": [label[0]], "high": [label[-1]]} if some else
                            {c: [] for c in ("blk", "n", "z", "label", "low", "high")})

    return dealt(rows.select("n", "x", "label", F.floor(at / size).cast("int").alias("blk")).groupBy("blk").applyInPandas(
        body, "blk int, n binary, z binary, label binary, low long, high long"))


def dealt(blocks: DataFrame) -> DataFrame:
    return cut(blocks.repartitionByRange(SIDES, "blk").sortWithinPartitions("blk"))


def tiles(blocks: DataFrame, on: Column | None = None) -> DataFrame:
    """Every pair of blocks once: columns a_* and b_*. Each part of a side is read by all parts of the other."""
    a, b = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")
    once = F.col("a_blk") <= F.col("b_blk")
    return a.join(b.hint("shuffle_replicate_nl"), once if on is None else once & on)


def opened(row: dict, side: str, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(row[f"{side}_n"], np.int64)
    return n, np.frombuffer(row[f"{side}_z"]).reshape(len(n), -1).astype(kind)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def steps(row: dict, power: float) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Rows, columns and single-precision weights of a tile, part by part; a gene has no weight with itself."""
    (_, a), (_, b) = opened(row, "a", np.float32), opened(row, "b", np.float32)
    for i in range(0, len(a), STEP[0]):
        for j in range(0, len(b), STEP[1]):
            w = weights(a[i:i + STEP[0]], b[j:j + STEP[1]], power)
            if row["a_blk"] == row["b_blk"]:
                own = np.arange(max(i, j), min(i + len(w), j + w.shape[1]))
                w[own - i, own - j] = 0
            yield slice(i, i + len(w)), slice(j, j + w.shape[1]), w


def bounded(net: Network) -> DataFrame:
    """Blocks with each gene's strength from below, k, and the norm of its weights from above, q; ``least``, ``most`` and
    ``top`` hold for a block: its least k, its largest q and its largest weight."""
    power, error, count = net.power, net.error, net.count

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for row in rows_of(batches):
            a, b = (held.setdefault(row[f"{s}_blk"], [row["a_blk"], row["b_blk"], *np.zeros((2, len(row[f"{s}_n"]) // 8)), 0.0]) for s in "ab")
            for i, j, w in steps(row, power):
                square, across, down = w * w, np.ones(w.shape[1], w.dtype), np.ones(len(w), w.dtype)
                a[2][i] += w @ across
                a[3][i] += square @ across
                if a is not b:
                    b[2][j] += down @ w
                    b[3][j] += down @ square
                top = float(w.max())
                a[4], b[4] = max(a[4], top), max(b[4], top)
        got = list(held.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), *[pa.array([h[c] for h in got], pa.int32()) for c in (0, 1)],
             *[pa.array([h[c].tobytes() for h in got], pa.binary()) for c in (2, 3)], pa.array([h[4] for h in got], pa.float64())],
            names=["blk", "i", "j", "k", "q", "top"])

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        k, q = (np.sum([np.frombuffer(x) for x in pdf[c]], axis=0) for c in ("k", "q"))
        # Single precision: a sum of at most 1,024 numbers is off by 6.2e-5 at most, a weight by ``error``.
        low = k * (1 - 1.3e-4) - count * error
        high = np.sqrt(q * (1 + 1.3e-4) + 2.1 * error * k + 2 * count * error ** 2)
        return pd.DataFrame({"blk": [key[0]], "k": [low.tobytes()], "q": [high.tobytes()], "least": [low.min()],
                             "most": [high.max()], "top": [min(1.0, pdf["top"].max() + error)]})

    parts = tiles(net.blocks.select("blk", "n", "z")).mapInArrow(add, "blk int, i int, j int, k binary, q binary, top double")
    sums = parts.groupBy("blk").applyInPandas(total, "blk int, k binary, q binary, least double, most double, top double")
    return dealt(net.blocks.select("blk", "n", "z").join(sums, "blk"))


def reaching(net: Network, limit: float) -> DataFrame:
    """(n) of the genes that may have an overlap of ``limit`` with another one: what two genes share is at most the
    product of the norms of their weights."""
    power, error = net.power, net.error

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for row in rows_of(batches):
            (ka, qa), (kb, qb) = ((np.frombuffer(row[f"{s}_k"]), np.frombuffer(row[f"{s}_q"])) for s in "ab")
            na, nb = (np.frombuffer(row[f"{s}_n"], np.int64) for s in "ab")
            for i, j, w in steps(row, power):
                w = np.minimum(w + error, 1)
                may = qa[i, None] * qb[None, j] + w >= limit * (np.minimum(ka[i, None], kb[None, j]) + 1 - w)
                may &= na[i, None] != nb[None, j]
                found.update(na[i][may.any(1)].tolist(), nb[j][may.any(0)].tolist())
        yield pa.RecordBatch.from_pydict({"n": pa.array(sorted(found), pa.int64())})

    w = F.least("a_top", "b_top")
    may = F.col("a_most") * F.col("b_most") + w >= F.lit(limit) * (F.least("a_least", "b_least") + 1 - w)
    return cut(tiles(bounded(net), may).mapInArrow(look, "n long").distinct())


class Tile:
    """What the genes of two blocks share, added up while all genes pass by."""

    def __init__(self, row: dict, power: float):
        self.power, self.same = power, row["a_blk"] == row["b_blk"]
        (self.na, self.za), (self.nb, self.zb) = opened(row, "a"), opened(row, "b")
        self.la, self.lb = (np.frombuffer(row[f"{s}_label"], np.int64) for s in "ab")
        self.shared, self.ka, self.kb = np.zeros((len(self.na), len(self.nb))), np.zeros(len(self.na)), np.zeros(len(self.nb))

    def part(self, n: np.ndarray, z: np.ndarray, nu: np.ndarray, zu: np.ndarray) -> np.ndarray:
        w = weights(z, zu, self.power)
        at = np.searchsorted(nu, n).clip(max=len(nu) - 1)
        own = np.flatnonzero(nu[at] == n)
        w[own, at[own]] = 0
        return w

    def meet(self, nu: np.ndarray, zu: np.ndarray) -> None:
        for at in range(0, len(nu), STEP[1]):
            u = nu[at:at + STEP[1]], zu[at:at + STEP[1]]
            wa = self.part(self.na, self.za, *u)
            wb = wa if self.same else self.part(self.nb, self.zb, *u)
            self.shared += wa @ wb.T
            self.ka += wa.sum(1)
            self.kb += wb.sum(1)

    def found(self, limit: float) -> pa.RecordBatch:
        w = weights(self.za, self.zb, self.power)
        s = np.round((self.shared + w) / (np.minimum(self.ka[:, None], self.kb[None]) + 1 - w), DIGITS)
        i, j = np.nonzero((s > limit) & (self.la[:, None] == self.lb[None]) & (self.na[:, None] < self.nb[None]))
        return pa.RecordBatch.from_arrays([pa.array(self.na[i]), pa.array(self.nb[j]), pa.array(s[i, j])], names=["a", "b", "s"])


def pairs(net: Network, labels: DataFrame, limit: float) -> DataFrame:
    """(a, b, s): the pairs of the genes in ``labels`` (n, label) with one label and an overlap above ``limit``, a < b."""
    rows = cut(ordered.row_numbers(net.genes.join(labels, "n").select("n", "x", "label"), [], ["label", "n"], "at"))
    blocks = pack(rows, F.col("at") - 1, block_size(rows.count(), net.samples, TILE))

    power = net.power

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = now = None
        for row in rows_of(batches):
            if now != (now := (row["a_blk"], row["b_blk"])):
                if tile:
                    yield tile.found(limit)
                tile = Tile(row, power)
            tile.meet(*opened(row, "u"))
        if tile:
            yield tile.found(limit)

    every = net.blocks.select(F.col("n").alias("u_n"), F.col("z").alias("u_z")).coalesce(1)
    met = tiles(blocks, F.col("a_high") >= F.col("b_low")).join(every.hint("shuffle_replicate_nl"), F.lit(True))
    return cut(met.mapInArrow(meet, "a long, b long, s double"))


def overlap(net: Network, limit: float) -> DataFrame:
    """(a, b, s) by gene: all pairs inside the groups that pairs with an overlap of ``limit`` join, where it is above zero."""
    zero = F.lit(0).cast("long").alias("label")
    if limit > 0:
        live = reaching(net, limit).select("n", zero)
        near = pairs(net, live, np.nextafter(limit, 0))
        labels = components(near.select("a", "b")).select(F.col("node").alias("n"), F.col("component").alias("label"))
    else:
        labels = net.genes.select("n", zero)
    name = lambda at: net.genes.where(F.col(GENE).isNotNull()).select(F.col("n").alias(f"_{at}"), F.col(GENE).alias(at))
    found = pairs(net, labels, 0.0).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "s")
    return found.join(name("a"), "_a").join(name("b"), "_b").select("a", "b", "s")
