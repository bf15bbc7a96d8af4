"""Consensus of several differential-expression methods on one long table.

Rows are (contrast_id, method, gene_id, log2fc, p_value, padj[, stat, se]). One shuffle on
(contrast, gene) yields votes, directions, combined statistics and meta effects together; ranks and
adjustments use ordered block scans, so a contrast may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from . import ordered
from ..functions.tails import EPS, chi2_even_upper, chi2_upper, normal_quantile_upper
from ..runtime import cut

KEY = ["contrast_id", "gene_id"]


def apply_filters(de: DataFrame, filters: Mapping[str, float] | None) -> DataFrame:
    """Per-method filters before voting: padj below, absolute change above (both strict)."""
    out = de
    if filters and "padj" in filters:
        out = out.where(F.col("padj") < filters["padj"])
    if filters and "lfc" in filters:
        out = out.where(F.abs("log2fc") > filters["lfc"])
    return out


def _up() -> Column:
    return F.coalesce(F.col("log2fc") > 0, F.lit(False))


def _method_list(condition: Column | None = None) -> Column:
    picked = F.col("method") if condition is None else F.when(condition, F.col("method"))
    return F.array_join(F.sort_array(F.collect_list(picked)), ",")


def direction_aggregates() -> list[Column]:
    return [F.count_if(_up()).alias("n_up"), F.count_if(~_up()).alias("n_down"),
            _method_list(_up()).alias("methods_up"), _method_list(~_up()).alias("methods_down")]


def with_direction(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """direction (ties up), agreement of the majority and the consistency flag."""
    up, down = F.col("n_up"), F.col("n_down")
    agreement = F.greatest(up, down) / (up + down)
    return df.withColumns({"direction": F.when(up >= down, "up").otherwise("down"),
                           "direction_agreement": agreement, "is_consistent": agreement >= threshold})


def direction_table(de: DataFrame, threshold: float = 1.0) -> DataFrame:
    return with_direction(de.groupBy(*KEY).agg(*direction_aggregates()), threshold)


def clamped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))


def method_correlation(de: DataFrame, p: str = "p_value") -> DataFrame:
    """Pairwise correlations of -2 ln p between methods over the genes of a contrast, any number of methods."""
    x = de.where(F.col(p).isNotNull()).groupBy(*KEY, "method").agg(F.first(-2.0 * F.ln(clamped(F.col(p)))).alias("x"))
    other = x.select(*KEY, F.col("method").alias("other"), F.col("x").alias("y"))
    pairs = x.join(other, list(KEY)).where(F.col("method") < F.col("other")).groupBy("contrast_id", "method", "other").agg(F.corr("x", "y").alias("r"))
    listed = pairs.groupBy("contrast_id").agg(F.collect_list(F.struct(F.col("method").alias("a"), F.col("other").alias("b"), "r")).alias("pairs"))
    return de.select("contrast_id").distinct().join(listed, "contrast_id", "left").withColumn(
        "pairs", F.coalesce("pairs", F.array().cast("array<struct<a:string,b:string,r:double>>")))


def combined_pvalues(de: DataFrame, method: str = "fisher", use_padj: bool = False,
                     parity: bool = False, simple_brown: bool = False) -> DataFrame:
    """Fisher or Brown combination per gene, adjusted within the contrast, with per-method values.

    Brown (1975): the statistic has mean 2k and variance 4k + 8 sum r over method pairs, so it is
    scaled by variance / (2 mean) and compared with 2 mean^2 / variance degrees of freedom.
    ``simple_brown=True`` uses variance 4k + 4 sum r and mean^2 / variance degrees instead;
    ``parity=True`` makes Brown fall back to Fisher's statistic.
    """
    if method not in ("fisher", "brown"):
        raise ValueError(f"unknown method {method!r}")
    source = "padj" if use_padj else "p_value"
    p = F.col(source)
    known = p.isNotNull()
    grouped = de.groupBy(*KEY).agg(
        (-2.0 * F.sum(F.when(known, F.ln(clamped(p))))).alias("_stat"),
        F.count_if(known).alias("_k"), F.count(F.lit(1)).alias("n_methods"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", p.alias("p"))))).alias("p_by_method"),
        _method_list(known).alias("methods_detected"), *direction_aggregates(), *meta_aggregates(de))
    stat, k = F.col("_stat"), F.col("_k")
    if method == "fisher" or parity:
        combined = chi2_even_upper(stat, k)
    else:
        grouped = grouped.join(method_correlation(de, source), "contrast_id")
        present = F.map_filter("p_by_method", lambda _, v: v.isNotNull())
        usable = F.filter("pairs", lambda q: F.map_contains_key(present, q["a"]) & F.map_contains_key(present, q["b"])
                          & q["r"].isNotNull() & ~F.isnan(q["r"]))
        cov = F.aggregate(usable, F.lit(0.0), lambda acc, q: acc + q["r"])
        weight, factor = (4.0, 1.0) if simple_brown else (8.0, 2.0)
        mean, var = 2.0 * k, 4.0 * k + weight * cov
        usable_var = (var > 0) & (k > 1)
        grouped = grouped.withColumns({
            "_scaled": F.when(usable_var, stat / (var / (2.0 * mean))).otherwise(stat),
            "_df": F.when(usable_var, factor * mean * mean / var).otherwise(2.0 * k)})
        combined = chi2_upper("_scaled", "_df")
    scored = with_meta(grouped.withColumn("combined_pvalue", F.when(k > 0, combined)))
    scored = cut(scored.select(*[c for c in scored.columns if not c.startswith("_") and c != "pairs"]))
    return ordered.benjamini_hochberg(scored, ["contrast_id"], "combined_pvalue", "combined_padj")


def _widest(de: DataFrame) -> int:
    """Number of methods in the data."""
    return max(1, de.select("method").distinct().count())


def meta_aggregates(de: DataFrame) -> list[Column]:
    """Inverse-variance sums; the standard error comes from se, else |lfc/stat|, else the p-value."""
    lfc = F.col("log2fc")
    if "se" in de.columns:
        se = F.col("se")
    else:
        z = normal_quantile_upper(F.when(F.col("p_value") > 0, F.col("p_value") / 2.0))
        from_p = F.when(z != 0, F.abs(lfc / z))
        se = from_p
        if "stat" in de.columns:
            stat = F.col("stat")
            se = F.when(stat.isNotNull() & ~F.isnan(stat), F.when(stat != 0, F.abs(lfc / stat))).otherwise(from_p)
    valid = se.isNotNull() & ~F.isnan(se)
    w = F.when(valid & (se > 0), 1.0 / (se * se))
    return [F.sum(w).alias("_w"), F.sum(w * lfc).alias("_wl"), F.avg(lfc).alias("_ml"),
            F.stddev_pop(lfc).alias("_sl"), F.count(lfc).alias("_nl")]


def with_meta(df: DataFrame) -> DataFrame:
    some = F.col("_w").isNotNull()
    return df.withColumns({
        "meta_lfc": F.when(some, F.col("_wl") / F.col("_w")).otherwise(F.col("_ml")),
        "meta_lfc_se": F.when(some, F.sqrt(1.0 / F.col("_w"))).otherwise(F.col("_sl") / F.sqrt("_nl"))})


def meta_lfc(de: DataFrame) -> DataFrame:
    out = with_meta(de.groupBy(*KEY).agg(*meta_aggregates(de)))
    return out.select(*KEY, "meta_lfc", "meta_lfc_se")


def method_statistics(de: DataFrame, consensus: DataFrame) -> DataFrame:
    """Per method: genes tested and genes that reached the consensus."""
    hit = consensus.select(*KEY, F.lit(1).alias("hit"))
    return de.join(hit, KEY, "left").groupBy("contrast_id", "method").agg(
        F.count(F.lit(1)).alias("n_genes"), F.count("hit").alias("n_in_consensus"))


def pvalue_ensemble(de: DataFrame, method: str = "fisher", significance: float = 0.05,
                    check_direction: bool = True, direction_threshold: float = 1.0,
                    use_padj: bool = False, parity: bool = False) -> dict[str, DataFrame]:
    """combined, consensus and method_statistics frames of a p-value combination."""
    combined = cut(with_direction(combined_pvalues(de, method, use_padj, parity), direction_threshold))
    consensus = combined.where(F.col("combined_padj") < significance)
    if check_direction:
        consensus = consensus.where("is_consistent")
    return {"combined": combined, "consensus": consensus, "method_statistics": method_statistics(de, consensus)}


def rank_aggregation(de: DataFrame, use_padj: bool = False) -> DataFrame:
    """Smallest normalised rank r/n over k lists scored as 1 - (1 - r/n)^k, adjusted per contrast.

    Ranks break ties by gene id; n counts the genes of the contrast over all methods.
    """
    p = "padj" if use_padj else "p_value"
    listed = de.select("contrast_id", "method", "gene_id", "log2fc",
                       F.coalesce(F.nanvl(F.col(p), F.lit(2.0)), F.lit(2.0)).alias("_p"))
    ranked = ordered.row_numbers(listed, ["contrast_id", "method"], ["_p", "gene_id"], "rank")
    genes = ranked.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_methods"), F.avg("rank").alias("mean_rank"), F.min("rank").alias("min_rank"),
        F.max("rank").alias("max_rank"), _method_list().alias("methods_detected"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "rank")))).alias("rank_by_method"),
        *direction_aggregates())
    genes = cut(genes)
    n = genes.groupBy("contrast_id").agg(F.count(F.lit(1)).alias("_n"))
    scored = genes.join(n, "contrast_id").withColumn(
        "rra_score", 1.0 - F.pow(1.0 - F.col("min_rank") / F.col("_n"), F.col("n_methods"))).drop("_n")
    return ordered.benjamini_hochberg(cut(scored), ["contrast_id"], "rra_score", "rra_pvalue")


def rank_ensemble(de: DataFrame, significance: float = 0.05, check_direction: bool = True,
                  direction_threshold: float = 1.0, use_padj: bool = False) -> dict[str, DataFrame]:
    ranked = cut(with_direction(rank_aggregation(de, use_padj), direction_threshold))
    consensus = ranked.where(F.col("rra_pvalue") < significance)
    if check_direction:
        consensus = consensus.where("is_consistent")
    return {"ranked": ranked, "consensus": consensus, "method_statistics": method_statistics(de, consensus)}


def voting_ensemble(de: DataFrame, min_methods: int = 2, filters: Mapping[str, float] | None = None,
                    check_direction: bool = True, direction_threshold: float = 1.0) -> DataFrame:
    votes = with_direction(apply_filters(de, filters).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_votes"), _method_list().alias("methods_detected"), *direction_aggregates()),
        direction_threshold)
    kept = votes.where(F.col("n_votes") >= min_methods)
    if check_direction:
        return kept.where("is_consistent")
    return kept.withColumns({"is_consistent": F.lit(True), "direction_agreement": F.lit(1.0)})


def weighted_ensemble(de: DataFrame, weights: Mapping[str, float] | None = None, min_score: float = 1.5,
                      filters: Mapping[str, float] | None = None, check_direction: bool = True,
                      direction_threshold: float = 1.0, n_methods: int | None = None) -> DataFrame:
    """Votes weighted by method; weights are scaled to sum to the number of methods.

    ``n_methods`` defaults to the distinct methods of ``de``; methods without a weight count 1.
    """
    if weights:
        n = n_methods or _widest(de)
        total = sum(weights.values())
        table = F.create_map(*[F.lit(v) for m, w in weights.items() for v in (m, w / total * n)])
        weight = F.coalesce(F.element_at(table, F.col("method")), F.lit(1.0))
    else:
        weight = F.lit(1.0)
    scored = with_direction(apply_filters(de, filters).withColumn("w", weight).groupBy(*KEY).agg(
        F.sum("w").alias("weighted_score"), F.count(F.lit(1)).alias("n_methods"),
        _method_list().alias("methods_detected"), *direction_aggregates()), direction_threshold)
    kept = scored.where(F.col("weighted_score") >= min_score - 1e-12)
    if check_direction:
        return kept.where("is_consistent")
    return kept.withColumns({"is_consistent": F.lit(True), "direction_agreement": F.lit(1.0)})


# Order in which the results are read, best first, with the gene as the last key. For ``sinks.save_ordered``.
RESULT_ORDER = {
    "fisher": ["contrast_id", "combined_p", "gene_id"], "brown": ["contrast_id", "combined_p", "gene_id"],
    "rank": ["contrast_id", "rra_score", "gene_id"], "voting": ["contrast_id", "-n_votes", "gene_id"],
    "weighted": ["contrast_id", "-weighted_score", "gene_id"],
}


def compare_ensembles(de: DataFrame, significance: float = 0.05, min_methods: int = 2,
                      filters: Mapping[str, float] | None = None) -> DataFrame:
    """Consensus sizes of the five ensemble kinds per contrast."""
    de = cut(de)
    found = {
        "fisher": pvalue_ensemble(de, "fisher", significance)["consensus"],
        "brown": pvalue_ensemble(de, "brown", significance)["consensus"],
        "rra": rank_ensemble(de, significance)["consensus"],
        "voting": voting_ensemble(de, min_methods, filters),
        "weighted": weighted_ensemble(de, None, float(min_methods), filters),
    }
    stacked = None
    for name, frame in found.items():
        part = frame.select("contrast_id", F.lit(name).alias("ensemble"), "direction")
        stacked = part if stacked is None else stacked.unionByName(part)
    sizes = stacked.groupBy("contrast_id", "ensemble").agg(
        F.count(F.lit(1)).alias("n_consensus"), F.count_if(F.col("direction") == "up").alias("n_up"),
        F.count_if(F.col("direction") == "down").alias("n_down"))
    every = de.select("contrast_id").distinct().withColumn("ensemble", F.explode(F.array(*[F.lit(n) for n in found])))
    return every.join(sizes, ["contrast_id", "ensemble"], "left").fillna(0, ["n_consensus", "n_up", "n_down"])
