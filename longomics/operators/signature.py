"""Ratio features, ratio-pair search and weighted signature scores."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import ordered
from .moments import DS, GENE, SAMPLE
from ..runtime import cut, small

BLOCK_GENES = 128


def apply_ratios(values: DataFrame, pairs: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """(a + pc) / (b + pc) per sample for (gene_a, gene_b) pairs over dense values."""
    v = values.select(DS, GENE, SAMPLE, "value")
    a = v.select(DS, F.col(GENE).alias("gene_a"), SAMPLE, F.col("value").alias("va"))
    b = v.select(DS, F.col(GENE).alias("gene_b"), SAMPLE, F.col("value").alias("vb"))
    p = small(pairs.select("gene_a", "gene_b"))
    return (a.join(p, "gene_a").join(b, [DS, "gene_b", SAMPLE])
            .select(DS, SAMPLE, "gene_a", "gene_b", ((F.col("va") + pseudocount) / (F.col("vb") + pseudocount)).alias("ratio")))


def gene_vectors(values: DataFrame, min_variance: float = 1e-6, candidates: DataFrame | None = None) -> DataFrame:
    """Per gene: dense values and labels in sample order, after the variance filter (ddof 1)."""
    v = values if candidates is None else values.join(candidates.select(GENE).distinct(), GENE, "left_semi")
    cells = F.sort_array(F.collect_list(F.struct(SAMPLE, "value", "y")))
    g = v.groupBy(DS, GENE).agg(F.var_samp("value").alias("_v"), cells.alias("c")).where(F.col("_v") > min_variance)
    return g.select(DS, GENE, F.col("c.value").alias("x"), F.col("c.y").alias("y"))


def search_ratios(values: DataFrame, top_k: int = 50, min_auc: float = 0.7, pseudocount: float = 1.0,
                  min_variance: float = 1e-6, candidates: DataFrame | None = None) -> DataFrame:
    """Best gene pairs a < b by AUC of (a + pc) / (b + pc), direction flipped below one half.

    Genes are packed into blocks; a block meets every other block through an equi-join on block-pair
    keys, each meeting is one even task of vectorised rank sums, and only a meeting's own top k
    leaves it (the overall top k is contained in their union). ``values`` is dense with labels y.
    """
    vec = cut(ordered.row_numbers(gene_vectors(values, min_variance, candidates), [DS], [GENE], "_pos"))
    vec = vec.withColumn("blk", F.floor((F.col("_pos") - 1) / BLOCK_GENES).cast("int")).drop("_pos")
    n = vec.groupBy(DS).agg((F.max("blk") + 1).alias("nb"))
    spread = (vec.join(n, DS).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
              .select(DS, F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "blk", GENE, "x", "y"))
    key, gene = (values.schema[c].dataType.simpleString() for c in (DS, GENE))
    schema = f"{DS} {key}, gene_a {gene}, gene_b {gene}, auc double, direction string, mean_ratio_reference double, mean_ratio_baseline double"

    def meet(pair: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(GENE, kind="stable")
        y = np.asarray(pdf["y"].iloc[0]).astype(bool)
        left, right = pdf[pdf["blk"] == pair[1]], pdf[pdf["blk"] == pair[2]]
        xa, xb = np.vstack(left["x"].to_numpy()) + pseudocount, np.vstack(right["x"].to_numpy()) + pseudocount
        ga, gb = left[GENE].to_numpy(), right[GENE].to_numpy()
        n1, n0 = int(y.sum()), int((~y).sum())
        found = []
        if n1 == 0 or n0 == 0:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        for i in range(len(ga)):
            use = np.flatnonzero(gb > ga[i])
            if len(use) == 0:
                continue
            r = xa[i][None, :] / xb[use]
            wins = np.zeros(len(use))
            rs, bs = r[:, y], np.sort(r[:, ~y], axis=1)
            for k in range(len(use)):
                wins[k] = (np.searchsorted(bs[k], rs[k], "left").sum() + np.searchsorted(bs[k], rs[k], "right").sum()) / 2.0
            a = wins / (n1 * n0)
            flip = a < 0.5
            a = np.where(flip, 1.0 - a, a)
            ok = (r.std(axis=1) >= 1e-10) & (a >= min_auc)
            for k in np.flatnonzero(ok):
                found.append((pair[0], ga[i], gb[use[k]], a[k], "higher_in_baseline" if flip[k] else "higher_in_reference",
                              rs[k].mean(), r[k][~y].mean()))
        out = pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])
        return out.sort_values(["auc", "gene_a", "gene_b"], ascending=[False, True, True]).head(top_k)

    best = spread.groupBy(DS, "p", "q").applyInPandas(meet, schema)
    ranked = ordered.row_numbers(best.withColumn("_a", F.round("auc", 12)), [DS], ["-_a", "gene_a", "gene_b"], "rank")
    return ranked.where(F.col("rank") <= top_k).drop("_a")


def normalisation(values: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean and population sd of each panel gene over dense values."""
    return (values.join(small(panel.select(GENE).distinct()), GENE, "left_semi").groupBy(GENE)
            .agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd")))


def score_signature(signature: DataFrame, values: DataFrame, intercept: float = 0.0) -> DataFrame:
    """Sum of w (x - mu) / sd + intercept per sample; sd at or below 1e-12 counts as 1.

    ``signature``: gene_id, weight, mu, sd. Samples lacking a panel gene are refused.
    """
    sig = signature.select(GENE, "weight", "mu", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0).alias("sd"))
    n = sig.count()
    scored = (values.join(small(sig), GENE).groupBy(DS, SAMPLE)
              .agg((F.sum(F.col("weight") * (F.col("value") - F.col("mu")) / F.col("sd")) + intercept).alias("signature_score"),
                   F.count(F.lit(1)).alias("_k")))
    complete = F.when(F.col("_k") == n, F.col("signature_score")).otherwise(
        F.raise_error(F.lit("sample lacks panel genes")).cast("double"))
    return scored.select(DS, SAMPLE, complete.alias("signature_score"))


def stratify(score: Column, cutoffs: dict[str, float]) -> Column:
    """low / high by one threshold, low / medium / high by two."""
    if "threshold" in cutoffs:
        return F.when(score < cutoffs["threshold"], "low").otherwise("high")
    if not cutoffs["low"] < cutoffs["high"]:
        raise ValueError("cutoffs['low'] must be below cutoffs['high']")
    return F.when(score < cutoffs["low"], "low").when(score < cutoffs["high"], "medium").otherwise("high")


def sample_vectors(values: DataFrame, genes: list) -> DataFrame:
    """Dense (dataset, sample, y, features array) over a panel given in order."""
    cols = [F.coalesce(F.max(F.when(F.col(GENE) == g, F.col("value"))), F.lit(0.0)) for g in genes]
    return (values.where(F.col(GENE).isin(genes)).groupBy(DS, SAMPLE)
            .agg(F.max("y").alias("y"), F.array(*cols).alias("x")))
