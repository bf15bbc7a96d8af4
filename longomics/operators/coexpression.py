"""Co-expression modules: adjacency of all pairs, topological overlap, average linkage by contraction.

All pairs count; ``network`` holds them without a table of pairs. With ``neighbours`` a gene keeps that many edges as
rows, and the overlap grows with genes x neighbours^2. An overlap without a row is zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import network, ordered
from .moments import GENE, SAMPLE
from ..runtime import cut, settle

DIGITS = 12
ROWS, SPAN, CELLS, PENDING = 2, 128, 1 << 23, 1 << 19


def gene_blocks(values: DataFrame, size: int) -> DataFrame:
    """(gene_id, x, n, blk): sample vectors of the genes that vary, numbered from 0 and dealt to blocks in gene order."""
    g = values.groupBy(GENE).agg(F.sort_array(F.collect_list(F.struct(SAMPLE, "value"))).alias("c"), F.stddev_pop("value").alias("s"))
    numbered = ordered.row_numbers(g.where("s > 1e-12").select(GENE, F.col("c.value").alias("x")), [], [GENE], "n")
    at = (F.col("n") - 1).cast("long")
    return numbered.select(GENE, "x", at.alias("n"), F.floor(at / size).cast("int").alias("blk"))


class Nearest:
    """The ``k`` strongest columns of every row so far, ties to the smaller number, while tiles of columns pass by.

    Single precision rules pairs out by the row's k-th strength with a margin for its error; the rest is computed in
    double precision pair by pair, so that a strength does not depend on the tile or the side.
    """

    def __init__(self, z: np.ndarray, numbers: np.ndarray, k: int, power: int):
        self.z, self.flat, self.numbers, self.k, self.power = z, z.astype(np.float32), numbers, k, power
        self.margin = 1e-5 + 1.2e-7 * z.shape[1]
        self.least = np.full(len(z), -np.inf, np.float32)
        self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def strength(self, r: np.ndarray) -> np.ndarray:
        return np.round(np.clip((1 + r) / 2, 0, 1) ** self.power, DIGITS)

    def reach(self, w: np.ndarray) -> np.ndarray:
        """What the single-precision r of a pair as strong as ``w`` is at least."""
        return (2 * np.maximum(w - 10.0 ** -DIGITS, 0) ** (1 / self.power) - 1 - self.margin).astype(np.float32)

    def meet(self, z: np.ndarray, numbers: np.ndarray) -> None:
        r = self.flat @ z.astype(np.float32).T
        if np.isneginf(self.least).all() and len(z) > self.k:
            # The row itself may be among the strongest, so one more is looked at.
            top = np.partition(np.nan_to_num(r, nan=-2.0), len(z) - 1 - self.k, axis=1)[:, len(z) - 1 - self.k]
            self.least = self.reach(self.strength(top.astype(np.float64) - self.margin))
        i, j = np.divmod(np.flatnonzero(r >= self.least[:, None]), len(z))
        other = self.numbers[i] != numbers[j]
        i, j = i[other], j[other]
        step = max(1, (1 << 23) // z.shape[1])
        exact = [np.einsum("ij,ij->i", self.z[i[at:at + step]], z[j[at:at + step]]) for at in range(0, len(i), step)]
        w = self.strength(np.concatenate(exact)) if exact else np.zeros(0)
        self.waiting.append((i[w > 0], numbers[j[w > 0]], w[w > 0]))
        if sum(len(x[0]) for x in self.waiting) > PENDING:
            self.merge()

    def merge(self) -> None:
        i, o, w = (np.concatenate(x) for x in zip(self.held, *self.waiting))
        order = np.lexsort((o, -w, i))
        i, o, w = i[order], o[order], w[order]
        begin = np.searchsorted(i, np.arange(len(self.z) + 1))
        keep = np.arange(len(i)) - begin[i] < self.k
        full = np.flatnonzero(np.diff(begin) >= self.k)
        self.least[full] = np.maximum(self.least[full], self.reach(w[begin[full] + self.k - 1]))
        self.held, self.waiting = (i[keep], o[keep], w[keep]), []


def adjacency(values: DataFrame, power: int = 6, neighbours: int | None = None, size: int | None = None) -> DataFrame | network.Network:
    """The network of all pairs, w = ((1 + r) / 2)^power (signed network), or as edges (a, b, w), a < b, of pairs that are
    among each other's ``neighbours`` strongest, ties to the smaller gene.

    For the edges a block of genes is one row with its scaled vectors. A task lets the
    blocks of a span pass by the genes of ``ROWS`` blocks and hands on the best of each of those genes in the span;
    a span has at most ``SPAN`` blocks and about ``CELLS`` numbers, however many genes there are.
    """
    if neighbours is None:
        return network.network(cut(gene_blocks(values, 1).drop("blk")), power, size)
    size = size or 1024
    blocks = cut(gene_blocks(values, size))
    found = blocks.agg(F.max("blk").alias("last"), F.max(F.size("x")).alias("samples")).first()
    last, samples = found["last"] or 0, max(found["samples"] or 1, 1)
    span = max(1, min(SPAN, CELLS // (size * samples)))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.vstack(pdf.sort_values("n")["x"].to_numpy()).astype(np.float64)
        z = (m - m.mean(1, keepdims=True)) / (m.std(1, keepdims=True) * np.sqrt(m.shape[1]))
        return pd.DataFrame({"blk": [key[0]], "genes": [len(z)], "z": [z.tobytes()]})

    packed = cut(blocks.groupBy("blk").applyInPandas(pack, "blk int, genes int, z binary"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    rows, spans = F.floor(F.col("blk") / ROWS).cast("int"), F.floor(F.col("blk") / span).cast("int")
    spread = packed.select(rows.alias("p"), every(last // span).alias("q"), F.lit(True).alias("row"), "*").unionByName(
        packed.select(every(last // ROWS).alias("p"), spans.alias("q"), F.lit(False).alias("row"), "*"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        def blocks_of(part: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
            return [(np.frombuffer(z).reshape(genes, -1), blk * size + np.arange(genes, dtype=np.int64))
                    for blk, genes, z in part.sort_values("blk")[["blk", "genes", "z"]].itertuples(index=False)]

        own = blocks_of(pdf[pdf["row"]])
        numbers = np.concatenate([n for _, n in own])
        nearest = Nearest(np.vstack([z for z, _ in own]), numbers, neighbours, power)
        for z, n in blocks_of(pdf[~pdf["row"]]):
            nearest.meet(z, n)
        nearest.merge()
        i, o, w = nearest.held
        return pd.DataFrame({"g": numbers[i], "o": o, "w": w})

    near = spread.groupBy("p", "q").applyInPandas(meet, "g long, o long, w double")
    order = Window.partitionBy("g").orderBy(F.desc("w"), "o")
    kept = cut(near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= neighbours).drop("_k"))
    back = kept.select(F.col("o").alias("g"), F.col("g").alias("o"))
    edges = kept.where("g < o").join(back, ["g", "o"], "left_semi")
    name = lambda n, out: blocks.where(F.col(GENE).isNotNull()).select(F.col("n").alias(n), F.col(GENE).alias(out))
    return edges.join(name("g", "a"), "g").join(name("o", "b"), "o").select("a", "b", "w")


def topological_overlap(edges: DataFrame | network.Network, limit: float = 0.0) -> DataFrame:
    """(a, b, s), a < b: (shared strength + w) / (smaller total strength + 1 - w), of pairs where it is above zero.

    A network gives the pairs inside the groups which overlaps of ``limit`` join; no clusters whose mean overlap is at
    least ``limit`` lie in different groups. With an edge table the pairs around a gene are its edges, squared.
    """
    if isinstance(edges, network.Network):
        return network.overlap(edges, limit)
    both = cut(edges.select(F.col("a").alias("g"), F.col("b").alias("u"), "w").unionByName(
        edges.select(F.col("b").alias("g"), F.col("a").alias("u"), "w")))
    total = both.groupBy("g").agg(F.sum("w").alias("k"))
    one, two = both.select("u", F.col("g").alias("a"), F.col("w").alias("w1")), both.select("u", F.col("g").alias("b"), F.col("w").alias("w2"))
    shared = one.join(two, "u").where("a < b").select("a", "b", (F.col("w1") * F.col("w2")).alias("l"), F.lit(0.0).alias("w"))
    pairs = shared.unionByName(edges.select("a", "b", F.lit(0.0).alias("l"), "w")).groupBy("a", "b").agg(F.sum("l").alias("l"), F.sum("w").alias("w"))
    joined = pairs.join(total.select(F.col("g").alias("a"), F.col("k").alias("ka")), "a").join(
        total.select(F.col("g").alias("b"), F.col("k").alias("kb")), "b")
    s = (F.col("l") + F.col("w")) / (F.least("ka", "kb") + 1 - F.col("w"))
    return joined.select("a", "b", F.round(s, DIGITS).alias("s"))


def average_linkage(similarity: DataFrame, genes: DataFrame, height: float = 0.9) -> DataFrame:
    """(gene_id, module): average-linkage tree of 1 - s, cut at ``height``; a module is named by its smallest gene.

    A round merges every pair of clusters that are nearest to each other, all over the table at once. Average linkage
    never brings a merged cluster nearer to a third one than its parts were, so this is the tree that merging one pair
    at a time gives, and a cluster without a neighbour within the height is finished and leaves the table.
    """
    limit = 1.0 - height
    labels = settle(genes.select(GENE, F.col(GENE).alias("module")).distinct())
    links = settle(similarity.where("s > 0").select("a", "b", "s", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    pair = Window.partitionBy("x.a", "x.b")
    while True:
        mean = F.round(F.col("s") / (F.col("na") * F.col("nb")), DIGITS)
        rated = links.withColumn("x", F.struct((-mean).alias("d"), "a", "b", "na", "nb"))
        ends = rated.select("x", F.explode(F.array("a", "b")).alias("g"))
        nearest = ends.groupBy("g").agg(F.min("x").alias("x")).where(F.col("x.d") <= -limit)
        mutual = nearest.withColumn("c", F.count(F.lit(1)).over(pair)).withColumn("met", F.col("c") == 2)
        own = F.when(F.col("g") == F.col("x.a"), F.col("x.na")).otherwise(F.col("x.nb"))
        state = settle(mutual.select("g", "met", F.when(F.col("met"), F.col("x.a")).otherwise(F.col("g")).alias("m"),
                                     F.when(F.col("met"), F.col("x.na") + F.col("x.nb")).otherwise(own).alias("n")))
        if state.where("met").isEmpty():
            return labels
        moved = state.where("g <> m").select(F.col("g").alias("module"), F.col("m").alias("_m"))
        labels = settle(labels.join(moved, "module", "left").select(GENE, F.coalesce("_m", "module").alias("module")))
        side = lambda end: state.select(F.col("g").alias(end), F.struct("m", "n").alias(f"_{end}"))
        renamed = links.select("a", "b", "s").join(side("a"), "a").join(side("b"), "b").where("_a.m <> _b.m")
        links = settle(renamed.groupBy(F.least("_a", "_b").alias("p"), F.greatest("_a", "_b").alias("q")).agg(F.sum("s").alias("s")).select(
            F.col("p.m").alias("a"), F.col("q.m").alias("b"), "s", F.col("p.n").alias("na"), F.col("q.n").alias("nb")))


def modules(values: DataFrame, power: int = 6, neighbours: int | None = None, height: float = 0.9, min_size: int = 30) -> DataFrame:
    """(gene_id, module, n_genes) of the modules with at least ``min_size`` genes."""
    edges = adjacency(values, power, neighbours)
    # Means are rounded, so the limit of a single pair lies a little below.
    overlap = topological_overlap(edges if neighbours is None else cut(edges), 1.0 - height - 1e-9)
    labels = average_linkage(overlap, values.select(GENE), height)
    size = labels.groupBy("module").agg(F.count(F.lit(1)).alias("n_genes")).where(F.col("n_genes") >= min_size)
    return labels.join(size, "module")
