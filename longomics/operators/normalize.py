"""Normalisations of a long count table and batch corrections across studies."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import ordered
from .moments import DS, GENE, SAMPLE, densify, sample_totals, zero_blocks
from ..runtime import cut


def log2p1(counts: DataFrame, value: str = "count") -> DataFrame:
    return counts.select(DS, GENE, SAMPLE, F.log2(F.col(value) + 1.0).alias("value"))


def cpm(counts: DataFrame, log: bool = False) -> DataFrame:
    """Counts per million of the sample's library, optionally log2(CPM + 1)."""
    libs = sample_totals(counts).select(DS, SAMPLE, "library_size")
    per_million = F.col("count") / F.col("library_size") * 1e6
    value = F.log2(per_million + 1.0) if log else per_million
    return counts.join(libs, [DS, SAMPLE]).select(DS, GENE, SAMPLE, value.alias("value"))


def quantile_normalise(counts: DataFrame) -> DataFrame:
    """log2(count + 1), ordinal rank per sample (ties by gene), replaced by the mean at that rank.

    The result has every cell, and a window holds one sample's genes, whose number does not grow with the samples.
    """
    dense = densify(counts).select(DS, GENE, SAMPLE, F.log2(F.col("count") + 1.0).alias("v"))
    ranked = dense.withColumn("_rank", F.row_number().over(Window.partitionBy(DS, SAMPLE).orderBy("v", GENE)))
    means = ranked.groupBy(DS, "_rank").agg(F.avg("v").alias("value"))
    return ranked.join(means, [DS, "_rank"]).select(DS, GENE, SAMPLE, "value")


def quantile_normalise_interpolated(counts: DataFrame) -> DataFrame:
    """Average rank per sample, read off the mean sorted curve by linear interpolation.

    The mean at ordinal position k comes from the tie table without expanding ties: the curve is
    the average over samples of each sample's k-th smallest value, assembled from (value, rank
    range) runs by a difference table and one prefix sum.
    """
    listed = counts.select(DS, SAMPLE).distinct()
    cells = counts.where("count <> 0").select(DS, SAMPLE, GENE, F.col("count").cast("double").alias("v"))
    n_genes = counts.select(DS, GENE).distinct().groupBy(DS).agg(F.count(F.lit(1)).alias("_genes"))
    zeros = zero_blocks(cells, listed, n_genes).select(DS, SAMPLE, F.lit(0.0).alias("v"), "_n")
    weighted = cells.select(DS, SAMPLE, "v", F.lit(1).cast("long").alias("_n")).unionByName(zeros)
    ties = ordered.tie_ranks(weighted, [DS, SAMPLE], "v", weight=F.col("_n"))
    sample_sizes = listed.groupBy(DS).agg(F.count(F.lit(1)).alias("_ns"))
    steps = ties.select(DS, F.explode(F.array(
        F.struct(F.col("rank_min").alias("pos"), F.col("v").alias("d")),
        F.struct((F.col("rank_max") + 1).alias("pos"), (-F.col("v")).alias("d")))).alias("s"))
    deltas = steps.groupBy(DS, "s.pos").agg(F.sum("s.d").alias("d"))
    needed = ties.select(DS, F.explode(F.array(F.floor("rank_avg"), F.ceil("rank_avg"))).alias("pos")).distinct()
    points = (deltas.unionByName(needed.withColumn("d", F.lit(0.0)))
              .groupBy(DS, "pos").agg(F.sum("d").alias("d")))
    curve = ordered.scan(ordered.block_order(points, [DS], ["pos"]), [DS], ["pos"], {"sum_at": ("sum", "d")})
    curve = curve.join(sample_sizes, DS).select(DS, "pos", (F.col("sum_at") / F.col("_ns")).alias("m"))
    lo = curve.select(DS, F.col("pos").alias("_lo"), F.col("m").alias("m_lo"))
    hi = curve.select(DS, F.col("pos").alias("_hi"), F.col("m").alias("m_hi"))
    mapped = (ties.withColumn("_lo", F.floor("rank_avg")).withColumn("_hi", F.ceil("rank_avg"))
              .join(lo, [DS, "_lo"]).join(hi, [DS, "_hi"])
              .select(DS, SAMPLE, "v", (F.col("m_lo") + (F.col("m_hi") - F.col("m_lo"))
                                        * (F.col("rank_avg") - F.col("_lo"))).alias("value")))
    dense = densify(counts).select(DS, GENE, SAMPLE, F.col("count").cast("double").alias("v"))
    return dense.join(mapped, [DS, SAMPLE, "v"]).select(DS, GENE, SAMPLE, "value")


def median_centre(counts: DataFrame, study: str = "study") -> DataFrame:
    """Shift each study's per-gene log2 median to the gene's overall median; back-transform, clip 0.

    ``counts`` is dense in (gene, sample) and carries the study column. Both medians are read at their positions in
    windows over one gene's samples: the cells are made and shuffled by gene once, and no group holds a map of values.
    """
    logged = counts.where(F.col(DS).isNotNull() & F.col(GENE).isNotNull()).withColumn("_l", F.log2(F.col("count") + 1.0))
    both = _median(_median(logged, [DS, GENE], "_all"), [DS, GENE, study], "_own").where(F.col(study).isNotNull())
    return both.select(DS, GENE, SAMPLE, study, F.greatest(
        F.pow(F.lit(2.0), F.col("_l") + (F.col("_all") - F.col("_own"))) - 1.0, F.lit(0.0)).alias("value"))


def _median(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """Rows with the median of ``_l`` in their group; nulls do not count."""
    group = Window.partitionBy(*by)
    ordered_rows = group.orderBy(F.col("_l").asc_nulls_last())
    whole = ordered_rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.withColumns({"_r": F.row_number().over(ordered_rows) * 2, "_n": F.count("_l").over(whole)})
    middle = F.when(F.col("_r").between(F.col("_n"), F.col("_n") + 2), F.col("_l"))
    return placed.withColumn(out, F.avg(middle).over(group)).drop("_r", "_n")


def size_factors(counts: DataFrame) -> DataFrame:
    """Median over genes of count / geometric mean of the gene's non-zero counts, zeros included.

    All zeros of a sample are one weighted row.
    """
    positive = counts.where("count > 0")
    reference = positive.groupBy(DS, GENE).agg(F.exp(F.avg(F.ln("count"))).alias("_geo"))
    n_genes = reference.groupBy(DS).agg(F.count(F.lit(1)).alias("_genes"))
    zeros = zero_blocks(positive, counts, n_genes).select(DS, SAMPLE, F.lit(0.0).alias("ratio"), "_n")
    ratios = (positive.join(reference, [DS, GENE])
              .select(DS, SAMPLE, (F.col("count") / F.col("_geo")).alias("ratio"), F.lit(1).cast("long").alias("_n")).unionByName(zeros))
    return (ordered.quantiles(ratios, [DS, SAMPLE], "ratio", {"size_factor": 0.5}, weight=F.col("_n"))
            .select(DS, SAMPLE, "size_factor"))


def median_ratio(counts: DataFrame) -> DataFrame:
    factors = size_factors(counts)
    usable = F.when(F.col("size_factor") > 0, F.col("size_factor")).otherwise(1.0)
    return (counts.join(factors, [DS, SAMPLE])
            .select(DS, GENE, SAMPLE, (F.col("count") / usable).alias("value")))


def posterior(n: pd.Series, g: pd.Series, d: pd.Series, g_bar: pd.Series, t2: pd.Series, a_prior: pd.Series,
              b_prior: pd.Series, iterations: int, tol: float) -> pd.DataFrame:
    """Posterior location ``gs`` and scale ``ds`` of each row; a row that has settled moves no more."""
    n, g, d, g_bar, t2, a_prior, b_prior = (c.to_numpy(dtype=float) for c in (n, g, d, g_bar, t2, a_prior, b_prior))
    gs, ds, open_ = g.copy(), d.copy(), np.arange(len(g))
    with np.errstate(all="ignore"):
        for _ in range(iterations):
            if not len(open_):
                break
            k, g0, d0 = n[open_], g[open_], d[open_]
            old_g, old_d = gs[open_], ds[open_]
            new_g = (k * t2[open_] * g0 + old_d * g_bar[open_]) / (k * t2[open_] + old_d + 1e-300)
            # Sum of squares about a moving location: sum (z - g*)^2 = (n - 1) d + n (g - g*)^2.
            sums = (k - 1) * d0 + k * (g0 - new_g) * (g0 - new_g)
            new_d = (0.5 * sums + b_prior[open_]) / (k / 2.0 + a_prior[open_] - 1.0)
            gs[open_], ds[open_] = new_g, new_d
            open_ = open_[~(np.maximum(np.abs(new_g - old_g), np.abs(new_d - old_d)) < tol)]
    return pd.DataFrame({"gs": gs, "ds": ds})


def combat(counts: DataFrame, batch: str = "study", iterations: int = 100, tol: float = 1e-4) -> DataFrame:
    """Parametric empirical-Bayes batch adjustment (Johnson, Li and Rabinovic 2007).

    Location and scale per (gene, batch), hyper-priors per batch, then the coupled posterior means
    iterated for a batch of (gene, batch) rows at a time: the iteration of a gene needs only that gene's
    batch mean, spread and count, never its values.
    """
    cells = counts.withColumn("v", F.col("count").cast("double"))
    per_batch = cut(cells.groupBy(DS, GENE, batch).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("vp")))
    gene = per_batch.groupBy(DS, GENE).agg(
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        (F.sum(F.col("n") * F.col("vp")) / F.sum("n")).alias("pooled"))
    std = (per_batch.join(gene, [DS, GENE])
           .withColumn("sd", F.when(F.col("pooled") > 0, F.sqrt("pooled")).otherwise(1.0))
           .withColumn("g", (F.col("m") - F.col("grand")) / F.col("sd"))
           .withColumn("d", F.when(F.col("n") > 1, F.col("vp") * F.col("n") / (F.col("n") - 1))
                       .otherwise(0.0) / (F.col("sd") * F.col("sd"))))
    prior = std.groupBy(DS, batch).agg(
        F.avg("g").alias("g_bar"), F.coalesce(F.var_samp("g"), F.lit(0.0)).alias("t2"),
        F.avg("d").alias("d_bar"), F.coalesce(F.var_samp("d"), F.lit(0.0)).alias("s2"))
    s2 = F.when(F.col("s2") > 1e-12, F.col("s2")).otherwise(1e-12)
    prior = prior.select(DS, batch, "g_bar", "t2",
                         ((2 * s2 + F.col("d_bar") ** 2) / s2).alias("a_prior"),
                         ((F.col("d_bar") * s2 + F.col("d_bar") ** 3) / s2).alias("b_prior"))
    joined = std.join(prior, [DS, batch])
    inputs = ["n", "g", "d", "g_bar", "t2", "a_prior", "b_prior"]
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in inputs])
    fit = F.pandas_udf(lambda *columns: posterior(*columns, iterations, tol), "gs double, ds double")
    solved = joined.withColumn("fit", fit(*[F.col(c).cast("double") for c in inputs]))
    fitted = solved.withColumn("fit", F.when(known, F.col("fit")))
    fitted = fitted.select(DS, GENE, batch, "grand", "sd", "fit.gs", "fit.ds")
    z = (F.col("v") - F.col("grand")) / F.col("sd")
    adjusted = (z - F.col("gs")) / F.sqrt(F.greatest("ds", F.lit(1e-12))) * F.col("sd") + F.col("grand")
    return (cells.join(fitted, [DS, GENE, batch])
            .select(DS, GENE, SAMPLE, batch, adjusted.alias("value")))


def batch_correct(counts: DataFrame, method: str, study: str = "study") -> DataFrame:
    """none | combat | median_centre | quantile | median_ratio on dense, study-labelled counts."""
    if method == "combat":
        return combat(counts, study)
    if method == "median_centre":
        return median_centre(counts, study)
    plain = {"quantile": quantile_normalise_interpolated, "median_ratio": median_ratio}
    if method in plain:
        labels = counts.select(DS, SAMPLE, study).distinct()
        return plain[method](counts.select(DS, GENE, SAMPLE, "count")).join(labels, [DS, SAMPLE])
    if method == "none":
        return counts.select(DS, GENE, SAMPLE, study, F.col("count").cast("double").alias("value"))
    raise ValueError(f"unknown batch correction {method!r}")
