"""Per-gene two-group tests, direction patterns, over-representation and expression preparation."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from . import normalize, ordered
from .moments import DS, GENE, SAMPLE, dense_variance
from ..functions.tails import fisher_greater, normal_two_sided, t_two_sided
from ..runtime import small

P_FLOOR = 1e-300


def prepare_expression(counts: DataFrame, samples: DataFrame, min_count: float = 10.0,
                       genes: DataFrame | None = None, group: str = "condition",
                       baseline: str | None = None, reference: str | None = None) -> DataFrame:
    """Mean-count filter, optional gene list (only when 10 or more of it are present), log2 CPM,
    alignment to the metadata and 0/1 labels. Returns (dataset, gene, sample, value, y); absent
    cells are zeros. Labels follow the explicit groups, else alphabetical order of exactly two."""
    if (baseline is None) != (reference is None):
        raise ValueError("give both baseline and reference, or neither")
    n = counts.select(DS, SAMPLE).distinct().groupBy(DS).agg(F.count(F.lit(1)).alias("n"))
    keep = (counts.groupBy(DS, GENE).agg(F.sum("count").alias("t")).join(n, DS)
            .where(F.col("t") / F.col("n") >= min_count).select(DS, GENE))
    if genes is not None:
        listed = keep.join(genes.select(GENE).distinct(), GENE, "left_semi")
        enough = listed.groupBy(DS).agg(F.count(F.lit(1)).alias("k")).where("k >= 10").select(DS)
        keep = listed.join(enough, DS, "left_semi").unionByName(keep.join(enough, DS, "left_anti"))
    filtered = counts.join(keep, [DS, GENE], "left_semi")
    labels = binary_labels(samples, group, baseline, reference)
    return normalize.cpm(filtered, log=True).join(labels, [DS, SAMPLE])


def binary_labels(samples: DataFrame, group: str = "condition", baseline: str | None = None,
                  reference: str | None = None) -> DataFrame:
    g = F.col(group)
    if baseline is not None:
        if baseline == reference:
            raise ValueError("baseline and reference must differ")
        return samples.where(g.isin(baseline, reference)).select(DS, SAMPLE, (g == reference).cast("int").alias("y"))
    ends = samples.groupBy(DS).agg(F.min(g).alias("lo"), F.max(g).alias("hi"), F.count_distinct(g).alias("k"))
    checked = samples.join(ends, DS).withColumn("k", F.when(F.col("k") == 2, F.col("k")).otherwise(
        F.raise_error(F.concat(F.lit("expected 2 groups, got "), F.col("k").cast("string"))).cast("bigint")))
    return checked.where("k = 2").select(DS, SAMPLE, (g == F.col("hi")).cast("int").alias("y"))


def group_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(DS).agg(F.count_if(F.col("y") == 1).alias("n_ref"), F.count_if(F.col("y") == 0).alias("n_base"))


def group_moments(values: DataFrame, labels: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Per gene and group: non-zero count, mean and population variance over the dense group."""
    some = F.col("value") != 0

    def part(y: int) -> list[Column]:
        mine = some & (F.col("y") == y)
        v = F.when(mine, F.col("value"))
        return [F.count(v).alias(f"_k{y}"), F.coalesce(F.avg(v), F.lit(0.0)).alias(f"_m{y}"),
                F.coalesce(F.var_pop(v), F.lit(0.0)).alias(f"_v{y}")]

    agg = values.groupBy(DS, *extra_keys, GENE).agg(*part(1), *part(0))
    return agg.join(group_sizes(labels), DS)


def welch(values: DataFrame, labels: DataFrame, min_nonzero: int = 3) -> DataFrame:
    """Welch t per gene from one aggregate; constant or too sparse genes get p = 1 and change 0."""
    m = group_moments(values, labels)
    n1, n0, k1, k0 = (F.col(c) for c in ("n_ref", "n_base", "_k1", "_k0"))
    m1, m0 = F.col("_m1") * k1 / n1, F.col("_m0") * k0 / n0
    v1 = dense_variance(n1, k1, F.col("_m1"), F.col("_v1"), 1)
    v0 = dense_variance(n0, k0, F.col("_m0"), F.col("_v0"), 1)
    stats = m.select(DS, GENE, "n_ref", "n_base", m1.alias("mean_ref"), m0.alias("mean_base"),
                     v1.alias("v1"), v0.alias("v0"), (k1 + k0).alias("nonzero"))
    tiny = 1e-28
    skipped = (F.col("nonzero") < min_nonzero) | ((F.col("v1") <= tiny) & (F.col("v0") <= tiny))
    a, b = F.col("v1") / n1, F.col("v0") / n0
    change = F.col("mean_ref") - F.col("mean_base")
    t = F.when(~skipped, change / F.sqrt(a + b))
    df = F.when(~skipped, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)))
    out = stats.select(DS, GENE, F.when(skipped, 0.0).otherwise(change).alias("log2fc"), "mean_ref", "mean_base",
                       F.sqrt(F.greatest("v0", F.lit(0.0))).alias("std_base"), "n_ref", "n_base",
                       skipped.alias("skipped"), t.alias("t"), df.alias("df"))
    p = F.coalesce(F.nanvl(t_two_sided("t", "df"), F.lit(1.0)), F.lit(1.0))
    out = out.withColumn("p_value", p)
    return out.withColumn("neg_log10p", -F.log10(F.greatest("p_value", F.lit(P_FLOOR))))


@lru_cache(maxsize=256)
def exact_u_counts(n1: int, n2: int) -> tuple[float, ...]:
    """Null distribution of the Mann-Whitney U as probabilities, by the standard recursion."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    for i in range(1, n1 + 1):
        up = n2 + i
        for u in range(n1 * n2, up - 1, -1):
            ways[u] -= ways[u - up]
        for u in range(i, n1 * n2 + 1):
            ways[u] += ways[u - i]
    return tuple(ways / ways.sum())


@F.pandas_udf(DoubleType())
def exact_u_two_sided(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    out = []
    for x, a, b in zip(u, n1, n2):
        if pd.isna(x):
            out.append(None)
            continue
        probs = np.asarray(exact_u_counts(int(a), int(b)))
        hi = max(x, a * b - x)
        out.append(min(1.0, 2.0 * float(probs[int(hi):].sum())))
    return pd.Series(out, dtype=float)


def mann_whitney(values: DataFrame, labels: DataFrame, min_nonzero: int = 3) -> DataFrame:
    """Two-sided Mann-Whitney per gene: exact when a group has at most 8 samples and no ties occur,
    else normal with tie and continuity correction. Ranks run over distinct values of one gene, so
    a gene's zeros are a single weighted row; windows are bounded by the samples of a dataset."""
    sizes = group_sizes(labels)
    d = values.where("value <> 0").groupBy(DS, GENE, "value").agg(
        F.count_if(F.col("y") == 1).alias("r"), F.count_if(F.col("y") == 0).alias("b"))
    present = d.groupBy(DS, GENE).agg(F.sum("r").alias("r"), F.sum("b").alias("b")).join(sizes, DS)
    zeros = present.select(DS, GENE, F.lit(0.0).alias("value"), (F.col("n_ref") - F.col("r")).alias("r"),
                           (F.col("n_base") - F.col("b")).alias("b")).where("r + b > 0")
    full = d.unionByName(zeros)
    w = Window.partitionBy(DS, GENE).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    tie = F.col("r") + F.col("b")
    ranked = full.withColumn("rank", F.sum(tie).over(w) - (tie - 1) / 2.0)
    u = ranked.groupBy(DS, GENE).agg(F.sum(F.col("r") * F.col("rank")).alias("rank_sum"),
                                     F.sum(tie * tie * tie - tie).alias("ties"),
                                     F.sum(F.when(F.col("value") != 0, tie).otherwise(0)).alias("nonzero"),
                                     F.count(F.lit(1)).alias("levels")).join(sizes, DS)
    n1, n0 = F.col("n_ref"), F.col("n_base")
    u1 = F.col("rank_sum") - n1 * (n1 + 1) / 2.0
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    exact = (F.least(n1, n0) <= 8) & (F.col("ties") == 0)
    z = (F.greatest(u1, n1 * n0 - u1) - n1 * n0 / 2.0 - 0.5) / sd
    skipped = (F.col("nonzero") < min_nonzero) | (F.col("levels") == 1)
    out = u.select(DS, GENE, u1.alias("u"), "n_ref", "n_base", skipped.alias("skipped"),
                   F.when(~skipped & ~exact & (sd > 0), z).alias("z"), F.when(~skipped & exact, u1).alias("ue"))
    p = F.coalesce(exact_u_two_sided("ue", "n_ref", "n_base"), F.nanvl(normal_two_sided(F.greatest("z", F.lit(0.0))), F.lit(None).cast("double")), F.lit(1.0))
    out = out.withColumn("p_value", F.least(p, F.lit(1.0)))
    means = group_moments(values, labels)
    m1, m0 = F.col("_m1") * F.col("_k1") / F.col("n_ref"), F.col("_m0") * F.col("_k0") / F.col("n_base")
    v0 = dense_variance(F.col("n_base"), F.col("_k0"), F.col("_m0"), F.col("_v0"), 1)
    means = means.select(DS, GENE, m1.alias("mean_ref"), m0.alias("mean_base"), F.sqrt(v0).alias("std_base"))
    return out.join(means, [DS, GENE]).select(
        DS, GENE, F.when(F.col("skipped"), 0.0).otherwise(F.col("mean_ref") - F.col("mean_base")).alias("log2fc"),
        "mean_ref", "mean_base", "std_base", "n_ref", "n_base", "skipped", "u", "p_value",
        (-F.log10(F.greatest("p_value", F.lit(P_FLOOR)))).alias("neg_log10p"))


def per_gene_de(values: DataFrame, labels: DataFrame, test: str = "welch", min_nonzero: int = 3) -> DataFrame:
    """``values``: (dataset, gene, sample, value, y) with absent zeros; ``labels``: (dataset, sample, y)."""
    if test not in ("welch", "mann_whitney"):
        raise ValueError("test must be 'welch' or 'mann_whitney'")
    return welch(values, labels, min_nonzero) if test == "welch" else mann_whitney(values, labels, min_nonzero)


def direction_pattern(de: DataFrame, p_threshold: float = 0.05, fc_threshold: float = 0.0) -> DataFrame:
    """Genes with p below and |log2fc| at or above the thresholds, with baseline mean and sd."""
    kept = de.where((F.col("p_value") < p_threshold) & (F.abs("log2fc") >= fc_threshold))
    return kept.select(DS, GENE, F.when(F.col("log2fc") > 0, "up").otherwise("down").alias("direction"), "log2fc",
                       F.col("neg_log10p").alias("confidence"), F.col("mean_base").alias("base_mean"),
                       F.col("std_base").alias("base_std"))


def concordance(pattern: DataFrame, values: DataFrame, samples: DataFrame, weighted: bool = True) -> DataFrame:
    """Per sample: sum w tanh(z) sign / sum w over the pattern genes measured in the dataset.

    Absent cells count as zeros: each gene's zero contribution is summed once per dataset and
    corrected per sample by its non-zero cells.
    """
    sd = F.greatest("base_std", F.lit(1e-10))
    sign = F.when(F.col("direction") == "up", 1.0).otherwise(-1.0)
    measured = values.select(DS, GENE).distinct()
    p = pattern.join(measured, [DS, GENE], "left_semi").select(
        DS, GENE, (F.col("confidence") if weighted else F.lit(1.0)).alias("w"), sign.alias("sign"), "base_mean", sd.alias("sd"))
    total = p.groupBy(DS).agg(F.sum("w").alias("_tw"))
    p = p.join(total, DS).withColumn("w", F.when(F.col("_tw") < 1e-10, 1.0).otherwise(F.col("w")))
    term = lambda v: F.col("w") * F.col("sign") * F.tanh((v - F.col("base_mean")) / F.col("sd"))
    p = p.withColumn("at_zero", term(F.lit(0.0)))
    base = p.groupBy(DS).agg(F.sum("at_zero").alias("zero_sum"), F.sum("w").alias("weight"))
    shift = (values.select(DS, GENE, SAMPLE, "value").join(small(p), [DS, GENE])
             .groupBy(DS, SAMPLE).agg(F.sum(term(F.col("value")) - F.col("at_zero")).alias("shift")))
    return (samples.select(DS, SAMPLE).join(base, DS).join(shift, [DS, SAMPLE], "left")
            .select(DS, SAMPLE, ((F.col("zero_sum") + F.coalesce("shift", F.lit(0.0))) / F.col("weight")).alias("concordance")))


def over_representation(query: DataFrame, gene_sets: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """One-sided Fisher exact test per pathway, odds ratio and BH adjustment.

    Universe: background or all set genes, plus the query. Pathways with fewer than 2 universe
    genes or no overlap are left out.
    """
    q = query.select(GENE).distinct().withColumn("in_query", F.lit(1))
    pool = (background if background is not None else gene_sets).select(GENE).distinct()
    universe = pool.unionByName(q.select(GENE)).distinct()
    sizes = universe.join(q, GENE, "left").agg(F.count(F.lit(1)).alias("n_universe"), F.count("in_query").alias("n_query"))
    members = gene_sets.select("pathway", GENE).distinct()
    if background is not None:
        members = members.join(universe, GENE, "left_semi")
    c = members.join(q, GENE, "left").groupBy("pathway").agg(
        F.count(F.lit(1)).alias("gene_set_size"), F.count("in_query").alias("overlap_count"))
    c = c.where("gene_set_size >= 2 AND overlap_count > 0").crossJoin(F.broadcast(sizes))
    a = F.col("overlap_count")
    b, d_ = F.col("n_query") - a, F.col("gene_set_size") - a
    rest = F.col("n_universe") - F.col("n_query") - F.col("gene_set_size") + a
    c = c.select("pathway", "overlap_count", "gene_set_size", "n_query", "n_universe",
                 ((a * rest) / F.greatest(b * d_, F.lit(1))).alias("odds_ratio"))
    c = c.withColumn("p_value", fisher_greater("overlap_count", "n_universe", "gene_set_size", "n_query"))
    return ordered.benjamini_hochberg(c, [], "p_value", "adjusted_p_value")


def consensus_ranking(scores: DataFrame, genes: DataFrame, n_methods: int) -> DataFrame:
    """Average-rank consensus over selectors: 0.7 normalised mean rank + 0.3 selection share.

    ``scores``: (method, gene_id, score, selected); a gene without a score in a method counts 0,
    which is one weighted tie and never a row per gene and method.
    """
    listed = genes.select(GENE).distinct()
    n = listed.agg(F.count(F.lit(1)).alias("n_genes"))
    own = scores.join(listed, GENE, "left_semi").select("method", GENE, F.coalesce("score", F.lit(0.0)).alias("score"), "selected")
    counted = own.groupBy("method").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n))
    filler = counted.select("method", F.lit(0.0).alias("score"), (F.col("n_genes") - F.col("k")).alias("w")).where("w > 0")
    weighted = own.select("method", "score", F.lit(1).cast("bigint").alias("w")).unionByName(filler)
    ranks = ordered.tie_ranks(weighted, ["method"], "score", F.col("w"), descending=True)
    mine = own.join(ranks.select("method", "score", "rank_avg"), ["method", "score"])
    zero = ranks.where("score = 0").select("method", F.col("rank_avg").alias("zero_rank"))
    zero_total = zero.agg(F.coalesce(F.sum("zero_rank"), F.lit(0.0)).alias("zero_sum"))
    per_gene = (mine.join(zero, "method", "left").groupBy(GENE).agg(
        F.sum(F.col("rank_avg") - F.coalesce("zero_rank", F.lit(0.0))).alias("shift"),
        F.count_if("selected").alias("n_methods_selected")))
    full = (listed.join(per_gene, GENE, "left").crossJoin(F.broadcast(zero_total))
            .select(GENE, ((F.col("zero_sum") + F.coalesce("shift", F.lit(0.0))) / n_methods).alias("mean_rank"),
                    F.coalesce("n_methods_selected", F.lit(0)).alias("n_methods_selected")))
    top = full.agg(F.max("mean_rank").alias("max_rank"))
    scored = full.crossJoin(F.broadcast(top)).select(
        GENE, "mean_rank", "n_methods_selected",
        ((F.col("max_rank") - F.col("mean_rank")) / F.col("max_rank") * 0.7
         + F.col("n_methods_selected") / F.lit(float(n_methods)) * 0.3).alias("consensus_score"))
    return rerank(scored, "consensus_score")


def rerank(df: DataFrame, score: str) -> DataFrame:
    """consensus_rank by descending score, ties by gene id."""
    keyed = df.withColumn("_s", F.round(score, 12))
    return ordered.row_numbers(keyed, [], ["-_s", GENE], "consensus_rank").drop("_s")


def calibrate(ranking: DataFrame, de: DataFrame, alpha: float = 0.05, significant: float = 1.0,
              nonsignificant: float = 0.5) -> DataFrame:
    """Weight the consensus score by single-gene significance and rank again."""
    joined = ranking.drop("consensus_rank").join(de.select(GENE, "p_value"), GENE, "left")
    p = F.coalesce("p_value", F.lit(1.0))
    w = F.when(p < alpha, significant).otherwise(nonsignificant)
    out = joined.withColumn("p_value", p).withColumn("weight", w).withColumn(
        "consensus_score_calibrated", F.col("consensus_score") * w)
    return rerank(out, "consensus_score_calibrated")

