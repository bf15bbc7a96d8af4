"""Sample-space structure of many datasets at once: block subspace iteration and blocks of coordinates.

The matrix of gene-scaled values is cut into tiles of at most GENE_BLOCK x SAMPLE_BLOCK cells. A round multiplies a thin
basis of every dataset by its tiles and back: two joins on block numbers and two sums of block vectors, all datasets in
one frame. Orthogonal columns come from sums of k x k numbers per dataset. Nothing has a row or task per dataset that
grows with its samples, and one algorithm serves all sizes: a dataset with fewer samples than columns is exact after the
first round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from . import ordered
from .moments import DS, GENE, SAMPLE, gene_moments
from ..runtime import cut, settle

SAMPLE_BLOCK, GENE_BLOCK = 512, 1024
COMPONENTS, GUARD, ROUNDS, TOLERANCE = 30, 10, 24, 1e-6
# Partial products held by a task before they are handed on.
HELD = 64


def sample_index(values: DataFrame) -> DataFrame:
    """0-based position of each sample in its dataset, by sample id."""
    listed = values.select(DS, SAMPLE).distinct()
    return (ordered.row_numbers(listed, [DS], [SAMPLE], "i")
            .select(DS, SAMPLE, (F.col("i") - 1).cast("int").alias("i")))


def key_type(df: DataFrame) -> str:
    return df.schema[DS].dataType.simpleString()


def sum_vectors(df: DataFrame, by: list[str], column: str = "v") -> DataFrame:
    return (df.groupBy(*by).agg(Summarizer.sum(array_to_vector(column)).alias("_s"))
            .select(*by, vector_to_array("_s").alias(column)))


def gene_scales(values: DataFrame) -> DataFrame:
    """Scale of every gene and its place: block and row in the block. Genes without spread have scale 1."""
    stats = gene_moments(values, "value").select(DS, GENE, F.when(F.col("var_pop") > 1e-30, F.sqrt("var_pop")).otherwise(1.0).alias("scale"),
                                                 (F.col("var_pop") > 1e-30).alias("varies"))
    blocks = stats.groupBy(DS).agg(F.ceil(F.count(F.lit(1)) / (GENE_BLOCK * 0.75)).alias("_n"))
    dealt = stats.join(blocks, DS).withColumn("gb", F.pmod(F.xxhash64(GENE), F.col("_n")).cast("int"))
    place = F.row_number().over(Window.partitionBy(DS, "gb").orderBy(GENE)) - 1
    # A block that the hash fills beyond its size goes on in further blocks.
    return (dealt.withColumn("_p", place)
            .select(DS, GENE, "scale", "varies", (F.col("gb") + F.col("_n") * F.floor(F.col("_p") / GENE_BLOCK)).cast("int").alias("gb"),
                    (F.col("_p") % GENE_BLOCK).alias("g")))


def tiles(values: DataFrame, index: DataFrame, genes: DataFrame) -> DataFrame:
    """(dataset, sb, gb) with the tile's cells: rows of the two blocks and the scaled value."""
    cells = (values.join(genes, [DS, GENE]).join(index, [DS, SAMPLE])
             .select(DS, F.floor(F.col("i") / SAMPLE_BLOCK).cast("int").alias("sb"), "gb", (F.col("i") % SAMPLE_BLOCK).alias("s"), "g",
                     (F.col("value") / F.col("scale")).alias("z")))
    return cells.groupBy(DS, "sb", "gb").agg(F.collect_list("s").alias("s"), F.collect_list("g").alias("g"), F.collect_list("z").alias("z"))


def multiply(tiled: DataFrame, blocks: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Blocks of the product of the tiles (or their transpose) with a thin matrix, keyed by dataset and ``end``."""
    size_in, size_out = (SAMPLE_BLOCK, GENE_BLOCK) if start == "sb" else (GENE_BLOCK, SAMPLE_BLOCK)

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({DS: [k[0] for k in held], end: [k[1] for k in held], "v": [m.ravel() for m in held.values()]})
            held.clear()
            return out

        for pdf in batches:
            for ds, at, s, g, z, v in zip(pdf[DS], pdf[end], pdf["s"], pdf["g"], pdf["z"], pdf["v"]):
                m = np.zeros((size_out, size_in))
                m[(g, s) if start == "sb" else (s, g)] = z
                part = m @ np.asarray(v).reshape(size_in, width)
                held[ds, at] = held[ds, at] + part if (ds, at) in held else part
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    met = tiled.join(blocks.select(DS, start, "v"), [DS, start])
    return sum_vectors(met.select(DS, end, "s", "g", "z", "v").mapInPandas(product, f"{DS} {key_type(tiled)}, {end} int, v array<double>"), [DS, end])


def _sums(blocks: DataFrame, width: int) -> DataFrame:
    """Per dataset: column sums, sums of products of ``v`` with itself and with ``q``."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for ds, q, v in zip(pdf[DS], pdf["q"], pdf["v"]):
                v, q = np.asarray(v).reshape(-1, width), np.asarray(q).reshape(-1, width)
                part = np.concatenate((v.sum(0), (v.T @ v).ravel(), (q.T @ v).ravel()))
                held[ds] = held[ds] + part if ds in held else part
        if held:
            yield pd.DataFrame({DS: list(held), "v": list(held.values())})

    return sum_vectors(blocks.select(DS, "q", "v").mapInPandas(partial, f"{DS} {key_type(blocks)}, v array<double>"), [DS])


def _solve(sums: DataFrame, sizes: DataFrame, width: int, components: int) -> DataFrame:
    """Per dataset, from k x k sums: the step that centres and orthogonalises, the leading values and their error."""
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ds, n, v in zip(pdf[DS], pdf["n"], pdf["v"]):
                v = np.asarray(v)
                mean = v[:width] / n
                square = v[width:width + width * width].reshape(width, width) - n * np.outer(mean, mean)
                own = v[width + width * width:].reshape(width, width)
                val, vec = np.linalg.eigh((own + own.T) / 2.0)
                val, vec = val[::-1], vec[:, ::-1]
                lead = slice(0, min(components, n, width))
                error = np.einsum("ij,ik,kj->j", vec, square, vec) - val * val
                scale = max(float(np.abs(val).max()), 1e-300)
                d, u = np.linalg.eigh((square + square.T) / 2.0)
                step = u * np.where(d > max(d.max(), 0.0) * 1e-14, 1.0 / np.sqrt(np.where(d > 0, d, 1.0)), 0.0)
                rows.append((ds, n, mean, step.ravel(), vec.ravel(), np.clip(val, 0.0, None), float(np.sqrt(np.clip(error[lead], 0.0, None).max(initial=0.0))) / scale))
            yield pd.DataFrame(rows, columns=[DS, "n", "mean", "step", "vec", "val", "error"])

    return sums.join(sizes, DS).select(DS, "n", "v").mapInPandas(
        solve, f"{DS} {key_type(sums)}, n int, mean array<double>, step array<double>, vec array<double>, val array<double>, error double")


def _rotate(blocks: DataFrame, solved: DataFrame, width: int) -> DataFrame:
    """Centred, orthogonal columns from the columns ``v``; rows beyond a dataset's samples stay zero."""
    def rotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sb, n, mean, step, v in zip(pdf["sb"], pdf["n"], pdf["mean"], pdf["step"], pdf["v"]):
                q = (np.asarray(v).reshape(-1, width) - np.asarray(mean)) @ np.asarray(step).reshape(width, width)
                q[max(n - sb * SAMPLE_BLOCK, 0):] = 0.0
                out.append(q.ravel())
            yield pd.DataFrame({DS: pdf[DS], "sb": pdf["sb"], "v": out})

    met = blocks.select(DS, "sb", "v").join(solved.select(DS, "n", "mean", "step"), DS)
    return met.mapInPandas(rotate, f"{DS} {key_type(blocks)}, sb int, v array<double>")


def _start(sizes: DataFrame, width: int, seed: int) -> DataFrame:
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sb, n in zip(pdf["sb"], pdf["n"]):
                v = np.random.default_rng([seed, sb]).standard_normal((SAMPLE_BLOCK, width))
                v[max(n - sb * SAMPLE_BLOCK, 0):] = 0.0
                out.append(v.ravel())
            yield pd.DataFrame({DS: pdf[DS], "sb": pdf["sb"], "v": out})

    blocks = sizes.select(DS, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SAMPLE_BLOCK).cast("int"))).alias("sb"))
    return blocks.mapInPandas(draw, f"{DS} {key_type(sizes)}, sb int, v array<double>")


def components(values: DataFrame, index: DataFrame, n_components: int = COMPONENTS, guard: int = GUARD, rounds: int = ROUNDS,
               tolerance: float = TOLERANCE, seed: int = 7) -> DataFrame:
    """(dataset, sample, i, scores, ratios) of the leading ``n_components`` of long values (absent cells are zero).

    Iterates ``n_components + guard`` columns until the residual of every leading pair is below ``tolerance`` of the
    largest value, or for ``rounds``. The driver sees one number a round.
    """
    width = n_components + guard
    genes = cut(gene_scales(values))
    tiled = cut(tiles(values, index, genes))
    sizes = cut(index.groupBy(DS).agg(F.count(F.lit(1)).cast("int").alias("n")))
    basis = _start(sizes, width, seed)
    solved = _solve(_sums(basis.withColumn("q", F.col("v")), width), sizes, width, n_components)
    basis = settle(_rotate(basis, solved, width))
    for k in range(rounds):
        turned = multiply(tiled, multiply(tiled, basis, "sb", "gb", width), "gb", "sb", width)
        turned = settle(turned.join(basis.withColumnRenamed("v", "q"), [DS, "sb"]))
        solved = settle(_solve(_sums(turned, width), sizes, width, n_components))
        worst = solved.agg(F.max("error").alias("e")).first()["e"]
        if worst is None or worst <= tolerance or k == rounds - 1:
            break
        basis = settle(_rotate(turned, solved, width))
    return _scores(turned.select(DS, "sb", F.col("q").alias("v")), solved, index, genes, width, n_components)


def _scores(basis: DataFrame, solved: DataFrame, index: DataFrame, genes: DataFrame, width: int, n_components: int) -> DataFrame:
    """Rows of scores. A component's sign makes its largest entry positive (ties: the first sample)."""
    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ds, sb, n, vec, val, v in zip(pdf[DS], pdf["sb"], pdf["n"], pdf["vec"], pdf["val"], pdf["v"]):
                rows = min(SAMPLE_BLOCK, n - sb * SAMPLE_BLOCK)
                lead = min(n_components, n)
                x = (np.asarray(v).reshape(-1, width)[:rows] @ np.asarray(vec).reshape(width, width)[:, :lead]) * np.sqrt(np.asarray(val)[:lead])
                yield pd.DataFrame({DS: [ds] * rows, "i": np.arange(rows, dtype=np.int32) + sb * SAMPLE_BLOCK, "scores": list(x)})

    met = basis.join(solved.select(DS, "n", "vec", "val"), DS)
    raw = cut(met.mapInPandas(project, f"{DS} {key_type(basis)}, i int, scores array<double>"))
    sign = (raw.select(DS, "i", F.posexplode("scores").alias("k", "s")).groupBy(DS, "k")
            .agg(F.max_by(F.signum("s"), F.struct(F.abs("s"), -F.col("i"))).alias("sign")))
    signs = sign.groupBy(DS).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "sign"))), lambda e: e["sign"]).alias("signs"))
    total = genes.groupBy(DS).agg(F.count_if("varies").cast("double").alias("informative"))
    lead = F.slice("val", 1, F.least(F.lit(n_components), F.col("n")))
    share = F.when(F.col("informative") > 0, F.transform(lead, lambda e: e / (F.col("n") * F.col("informative")))).otherwise(lead)
    ratios = solved.join(total, DS).select(DS, share.alias("ratios"))
    turned = F.zip_with("scores", "signs", lambda s, g: F.when(g < 0, -s).otherwise(s))
    return (raw.join(signs, DS).join(ratios, DS).join(index, [DS, "i"])
            .select(DS, SAMPLE, "i", turned.alias("scores"), "ratios"))


def point_blocks(pcs: DataFrame, size: int, dims: int | None = None) -> DataFrame:
    """Samples in blocks of ``size``: (dataset, block, i, x), x the coordinates one sample after the other."""
    x = F.col("scores") if dims is None else F.slice("scores", 1, dims)
    rows = pcs.select(DS, F.floor(F.col("i") / size).cast("int").alias("block"), F.struct("i", x.alias("x")).alias("p"))
    packed = rows.groupBy(DS, "block").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return packed.select(DS, "block", F.transform("p", lambda e: e["i"]).alias("i"), F.flatten(F.transform("p", lambda e: e["x"])).alias("x"))
