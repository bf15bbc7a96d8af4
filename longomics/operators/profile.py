"""Dataset profile: 32-feature description of every dataset of a long count table at once.

The cells are read by three map-side-combined aggregates (by gene, by sample, by count value);
everything after that works on those small frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import ordered
from .moments import DS, matrix_summaries
from ..runtime import cut

# Percentiles of the expression distribution.
PERCENTILES = [5, 10, 25, 50, 75, 90, 95]

# The feature vector's names in order.
FEATURES = [
    "log2_n_samples", "log2_n_genes", "n_groups", "min_group_size", "sample_balance",
    "library_size_cv", "log2_library_size_range", "log2_library_size_mean", "library_size_iqr_norm",
    "detection_rate", "reliable_detection_rate", "genes_per_sample_cv",
    "expression_mean", "expression_variance", "expression_skewness", "expression_iqr",
    "bcv", "common_dispersion", "dispersion_trend_slope", "overdispersion_ratio", "dispersion_iqr",
    "sparsity", "zero_inflation_index", "dropout_rate",
    "low_count_proportion", "medium_count_proportion", "high_count_proportion", "dynamic_range",
    "mean_var_slope", "mean_var_r_squared", "poisson_fit_score", "quality_score",
]


def ladder(value: Column, *bands: tuple[float, str], top: str) -> Column:
    """First band whose upper bound exceeds ``value``, else ``top``."""
    out = None
    for bound, label in bands:
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    return out.otherwise(top)


def group_profile(samples: DataFrame, group: str = "condition") -> DataFrame:
    sizes = samples.groupBy(DS, group).agg(F.count(F.lit(1)).alias("n"))
    g = sizes.groupBy(DS).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sort_array(F.collect_list(F.struct(F.col(group).alias("k"), "n"))).alias("_sizes"),
        F.min("n").alias("min_group_size"), F.max("n").alias("max_group_size"),
        F.avg("n").alias("mean_group_size"))
    balance = F.col("min_group_size") / F.col("max_group_size")
    return g.select(
        DS, "n_groups", F.col("_sizes.n").alias("group_sizes"), "min_group_size", "max_group_size",
        "mean_group_size", balance.alias("sample_balance"),
        (F.col("min_group_size") >= 2).alias("has_replicates"),
        (F.col("min_group_size") >= 3).alias("has_sufficient_replicates"),
        F.when((F.col("n_groups") <= 2) & (balance >= 0.8), "simple")
        .when((F.col("n_groups") <= 4) & (balance >= 0.5), "moderate")
        .otherwise("complex").alias("design_complexity"))


def gene_profile(genes: DataFrame) -> DataFrame:
    """One pass over genes with dispersions: detection, sparsity, mean-variance and dispersion trends."""
    mean, var, valid = F.col("mean"), F.col("var"), F.col("valid")
    fit = (mean > 1) & (var > 0)
    x, y = F.when(fit, F.log10(mean)), F.when(fit, F.log10(var))
    tx = F.when(valid, F.log10(mean + 1.0))
    ty = F.when(valid, F.log10(F.col("dispersion") + 0.001))
    return genes.groupBy(DS).agg(
        F.count(F.lit(1)).alias("n_genes"), F.max("n_samples").alias("n_samples"),
        F.count_if(F.col("total") > 0).alias("n_expressed_genes"),
        F.count_if(mean >= 10).alias("n_reliably_expressed"),
        F.count_if(mean >= 100).alias("n_highly_expressed"),
        F.sum("zeros").alias("n_zeros"),
        F.sum(F.exp(-mean) * F.col("n_samples")).alias("_expected_zeros"),
        F.count_if(fit).alias("_n_fit"),
        F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_intercept"),
        F.regr_r2(y, x).alias("_r2"),
        F.regr_slope(ty, tx).alias("trended_dispersion_slope"),
        F.regr_intercept(ty, tx).alias("trended_dispersion_intercept"))


def gene_dispersions(genes: DataFrame) -> DataFrame:
    """All genes, with dispersion, ``valid`` and var/mean ratio filled in for the expressed ones.

    Dispersion is by the method of moments. Expressed means mean >= 5, relaxed to >= 1 when fewer
    than 50 such genes; datasets with fewer than 10 get none. Genes without excess variance get 0
    before clipping, unless fewer than 10 genes have any.
    """
    mean, var = F.col("mean"), F.col("var")
    over = var > mean
    masks = genes.groupBy(DS).agg(
        F.count_if(mean >= 5).alias("n5"), F.count_if(mean >= 1).alias("n1"),
        F.count_if((mean >= 5) & over).alias("v5"), F.count_if((mean >= 1) & over).alias("v1"))
    strict = F.col("n5") >= 50
    masks = masks.select(DS, F.when(strict, 5.0).otherwise(1.0).alias("_floor"),
                         F.when(strict, F.col("n5")).otherwise(F.col("n1")).alias("_kept"),
                         (F.when(strict, F.col("v5")).otherwise(F.col("v1")) < 10).alias("_use_all"))
    kept = (mean >= F.col("_floor")) & (F.col("_kept") >= 10)
    valid = over | F.col("_use_all")
    raw = F.when(valid, (var - mean) / (mean * mean)).otherwise(0.0)
    return genes.join(masks, DS).select(
        *genes.columns, (kept & valid).alias("valid"),
        F.when(kept, F.least(F.greatest(raw, F.lit(0.001)), F.lit(10.0))).alias("dispersion"),
        F.when(kept, var / mean).alias("ratio"))


# Shift of the power sums of log2(count + 1): keeps them small, so one pass suffices.
LOG_CENTRE = 4.0


def stack_distributions(libs: DataFrame, hist: DataFrame, genes: DataFrame) -> DataFrame:
    """(dataset, metric, value, w) of library sizes, detected genes, counts, dispersions and ratios."""
    def entry(metric: str, value: str) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.col(value).cast("double").alias("value"))

    one = F.lit(1).cast("bigint").alias("w")
    a = libs.select(DS, F.explode(F.array(entry("library", "library_size"), entry("detected", "detected_genes"))).alias("e"), one)
    b = genes.select(DS, F.explode(F.array(entry("dispersion", "dispersion"), entry("ratio", "ratio"))).alias("e"), one)
    c = hist.select(DS, entry("count", "count").alias("e"), F.col("n").alias("w"))
    rows = a.unionByName(b).unionByName(c).select(DS, "e.metric", "e.value", "w")
    return rows.where("value IS NOT NULL AND (metric <> 'ratio' OR value > 0)")


def distribution_stats(libs: DataFrame, hist: DataFrame, genes: DataFrame) -> DataFrame:
    """Percentiles, moments, count bands and the 10% trimmed dispersion mean, all from one ordered
    pass over the distinct values of every metric."""
    n, v = F.col("_n"), F.col("value")
    d = F.log2(v + 1.0) - LOG_CENTRE
    trim = F.floor(F.col("_total") * F.lit(0.1))
    inside = F.greatest(F.lit(0), F.least(F.col("_cum"), F.col("_total") - trim) - F.greatest(F.col("_cum") - n, trim))
    band = lambda lo, hi: F.sum(F.when((v >= lo) & (v < hi), n).otherwise(0))
    extra = [
        F.sum(n * v).alias("_s1"), F.sum(n * v * v).alias("_s2"), F.min(v).alias("_lo"), F.max(v).alias("_hi"),
        F.sum(inside * v).alias("_trim_sum"), F.sum(inside).alias("_trim_n"),
        band(1, 10).alias("_low"), band(10, 100).alias("_medium"), band(100, 1000).alias("_high"),
        band(1000, float("inf")).alias("_very_high"),
        *[F.sum(n * F.pow(d, F.lit(float(k)))).alias(f"_p{k}") for k in (1, 2, 3, 4)]]
    stats = ordered.order_stats(stack_distributions(libs, hist, genes), [DS, "metric"], "value",
                                {f"q{p}": p / 100.0 for p in PERCENTILES}, F.col("w"), extra=extra)

    def pick(metric: str, value: Column) -> Column:
        return F.max(F.when(F.col("metric") == metric, value))

    def at(metric: str, p: int, transform=lambda c: c) -> Column:
        return pick(metric, ordered.interpolate(f"q{p}", transform))

    def log(c: Column) -> Column:
        return F.log2(c + 1.0)

    size = F.col("n_values")
    mean = F.col("_s1") / size
    sd = F.sqrt(F.greatest(F.col("_s2") / size - mean * mean, F.lit(0.0)))
    m1, m2, m3, m4 = (F.col(f"_p{k}") / size for k in (1, 2, 3, 4))
    var = m2 - m1 * m1
    skew = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    kurt = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    return stats.groupBy(DS).agg(
        pick("library", mean).alias("library_size_mean"), pick("library", sd).alias("library_size_std"),
        pick("library", F.col("_lo")).alias("library_size_min"), pick("library", F.col("_hi")).alias("library_size_max"),
        at("library", 50).alias("library_size_median"),
        (at("library", 75) - at("library", 25)).alias("library_size_iqr"),
        pick("detected", mean).alias("genes_per_sample_mean"), pick("detected", sd).alias("genes_per_sample_std"),
        pick("count", mean).alias("count_mean"), at("count", 50).alias("count_median"),
        pick("count", F.col("_hi")).alias("count_max"),
        *[pick("count", F.col(c)).alias(c) for c in ("_low", "_medium", "_high", "_very_high")],
        pick("count", F.when(size > 1, F.log2(F.col("_hi") / F.col("_lo"))).otherwise(0.0)).alias("dynamic_range"),
        pick("count", m1 + LOG_CENTRE).alias("expression_mean"), pick("count", var).alias("expression_variance"),
        pick("count", F.sqrt(var)).alias("expression_std"),
        pick("count", F.when(var > 0, skew / F.pow(var, 1.5))).alias("expression_skewness"),
        pick("count", F.when(var > 0, kurt / (var * var) - 3.0)).alias("expression_kurtosis"),
        pick("count", log(F.col("_hi")) - log(F.col("_lo"))).alias("expression_range"),
        at("count", 50, log).alias("expression_median"),
        (at("count", 75, log) - at("count", 25, log)).alias("expression_iqr"),
        *[at("count", p, log).alias(f"expression_p{p}") for p in PERCENTILES],
        pick("dispersion", mean).alias("dispersion_mean"), pick("dispersion", sd).alias("dispersion_std"),
        at("dispersion", 50).alias("dispersion_median"),
        (at("dispersion", 75) - at("dispersion", 25)).alias("dispersion_iqr"),
        pick("dispersion", F.col("_trim_sum") / F.col("_trim_n")).alias("common_dispersion"),
        at("ratio", 50).alias("overdispersion_ratio"))


def zero_if_null(df: DataFrame, *names: str) -> DataFrame:
    return df.fillna(0.0, list(names))


def full_profile(counts: DataFrame, samples: DataFrame | None = None, group: str = "condition",
                 quality: DataFrame | None = None) -> DataFrame:
    """One row per dataset. ``quality`` may bring dataset-level quality_score, has_outliers,
    outlier_severity, has_batch_effect and batch_confounded from the quality-control operators."""
    parts = matrix_summaries(counts)
    libs, hist = parts["libraries"], parts["histogram"]
    genes = cut(gene_dispersions(parts["genes"]))
    design = libs.select(DS, F.lit("all").alias(group)) if samples is None else samples
    out = (gene_profile(genes).join(group_profile(design, group), DS)
           .join(distribution_stats(libs, hist, genes), DS))
    # One row per dataset: pinning it keeps the derived columns out of the aggregates' generated code.
    out = cut(out)
    cells = F.col("n_genes") * F.col("n_samples")
    out = out.select(
        "*",
        F.when(F.col("library_size_mean") > 0, F.col("library_size_std") / F.col("library_size_mean"))
        .otherwise(0.0).alias("library_size_cv"),
        F.when(F.col("library_size_min") > 0, F.col("library_size_max") / F.col("library_size_min"))
        .otherwise(F.lit(float("inf"))).alias("library_size_range"),
        (F.col("n_expressed_genes") / F.col("n_genes")).alias("detection_rate"),
        (F.col("n_reliably_expressed") / F.col("n_genes")).alias("reliable_detection_rate"),
        F.when(F.col("genes_per_sample_mean") > 0, F.col("genes_per_sample_std") / F.col("genes_per_sample_mean"))
        .otherwise(0.0).alias("genes_per_sample_cv"),
        (F.col("n_zeros") / cells).alias("sparsity"),
        F.when(F.col("_expected_zeros") > 0, (F.col("n_zeros") - F.col("_expected_zeros")) / F.col("_expected_zeros"))
        .otherwise(0.0).alias("zero_inflation_index"),
        (1.0 - F.col("genes_per_sample_mean") / F.col("n_genes")).alias("dropout_rate"),
        (F.col("_low") / cells).alias("low_count_proportion"),
        (F.col("_medium") / cells).alias("medium_count_proportion"),
        (F.col("_high") / cells).alias("high_count_proportion"),
        (F.col("_very_high") / cells).alias("very_high_count_proportion"),
        F.sqrt("common_dispersion").alias("bcv"),
        *[F.when(F.col("_n_fit") >= 50, F.col(f"_{c}")).otherwise(0.0).alias(n) for c, n in
          [("slope", "mean_var_slope"), ("intercept", "mean_var_intercept"), ("r2", "mean_var_r_squared")]])
    slope, r2 = F.col("mean_var_slope"), F.col("mean_var_r_squared")
    fitted = F.col("_n_fit") >= 50
    out = out.select(
        "*",
        F.when(fitted, F.exp(-F.abs(slope - 1.0))).otherwise(0.0).alias("poisson_fit_score"),
        F.when(fitted, F.when(slope.between(1.3, 2.2), r2).otherwise(r2 * 0.8)).otherwise(0.0).alias("nb_fit_score"),
        (F.col("zero_inflation_index") > 0.5).alias("is_zero_inflated"))
    if quality is not None:
        out = out.join(quality, DS, "left")
    # Defaults when no quality assessment is joined in.
    defaults = {"quality_score": F.lit(100.0), "has_outliers": F.lit(False), "outlier_severity": F.lit("none"),
                "has_batch_effect": F.lit(False), "batch_confounded": F.lit(False)}
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in out.columns else value)
    out = zero_if_null(out, "bcv", "common_dispersion", "overdispersion_ratio", "dispersion_mean",
                       "dispersion_median", "dispersion_std", "dispersion_iqr",
                       "trended_dispersion_slope", "trended_dispersion_intercept")
    out = with_categories(out)
    return out.select(*[c for c in out.columns if not c.startswith("_")],
                      feature_vector(out).alias("feature_vector"))


def with_categories(p: DataFrame) -> DataFrame:
    c = F.col
    return p.withColumns({
        "library_size_category": ladder(c("library_size_cv"), (0.1, "low"), (0.3, "moderate"), (0.5, "high"), top="very_high"),
        "sequencing_depth_category": ladder(c("library_size_median") / 1e6, (5, "shallow"), (30, "standard"), top="deep"),
        "bcv_category": ladder(c("bcv"), (0.2, "low"), (0.4, "moderate"), top="high"),
        "overdispersion_category": ladder(c("overdispersion_ratio"), (2, "low"), (10, "moderate"), top="high"),
        "sparsity_category": ladder(c("sparsity"), (0.3, "low"), (0.6, "moderate"), top="high"),
        "dynamic_range_category": ladder(c("dynamic_range"), (10, "low"), (20, "moderate"), top="high"),
    })


def feature_vector(p: DataFrame) -> Column:
    """The 32 features in the order of ``FEATURES``; NaN -> 0, +-infinity -> +-10."""
    c = F.col
    source = {
        "log2_n_samples": F.log2(c("n_samples") + 1.0), "log2_n_genes": F.log2(c("n_genes") + 1.0),
        "log2_library_size_range": F.when(c("library_size_range") == float("inf"), 10.0)
        .otherwise(F.log2(c("library_size_range") + 1.0)),
        "log2_library_size_mean": F.log2(c("library_size_mean") + 1.0),
        "library_size_iqr_norm": c("library_size_iqr") / (c("library_size_mean") + 1.0),
        "dispersion_trend_slope": c("trended_dispersion_slope"),
        "overdispersion_ratio": F.log2(c("overdispersion_ratio") + 1.0),
        "zero_inflation_index": F.least(F.greatest(c("zero_inflation_index"), F.lit(-5.0)), F.lit(5.0)),
        "dynamic_range": F.log2(c("dynamic_range") + 1.0),
        "quality_score": c("quality_score") / 100.0,
    }

    def finite(value: Column) -> Column:
        value = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
        return (F.when(value == float("inf"), 10.0).when(value == float("-inf"), -10.0)
                .otherwise(value).cast("float"))

    return F.array(*[finite(source.get(name, c(name))) for name in FEATURES])


def key_characteristics(counts: DataFrame) -> DataFrame:
    """Quick description: sizes, library spread, sparsity, median-dispersion BCV, count range."""
    parts = matrix_summaries(counts)
    genes, hist = cut(parts["genes"]), parts["histogram"]
    libs = parts["libraries"].groupBy(DS).agg(
        F.avg("library_size").alias("library_size_mean"),
        F.coalesce(F.stddev_pop("library_size") / F.avg("library_size"), F.lit(0.0)).alias("library_size_cv"),
        F.when(F.min("library_size") > 0, F.max("library_size") / F.min("library_size"))
        .otherwise(F.lit(float("inf"))).alias("library_size_range"))
    mean, var = F.col("mean"), F.col("var")
    disp = genes.where((mean >= 5) & (var > mean)).select(
        DS, F.lit("d").alias("metric"),
        F.least(F.greatest((var - mean) / (mean * mean), F.lit(0.001)), F.lit(10.0)).alias("value"), F.lit(1).alias("w"))
    medians = ordered.order_stats(
        disp.unionByName(hist.select(DS, F.lit("c").alias("metric"), F.col("count").alias("value"), F.col("n").alias("w"))),
        [DS, "metric"], "value", {"m": 0.5}, F.col("w"),
        extra=(F.min("value").alias("_lo"), F.max("value").alias("_hi")))
    m = F.col("metric")
    medians = medians.groupBy(DS).agg(
        F.sqrt(F.max(F.when(m == "d", ordered.interpolate("m")))).alias("_bcv"),
        F.max(F.when(m == "c", ordered.interpolate("m"))).alias("median_count"),
        F.max(F.when(m == "c", F.log2(F.col("_hi") / F.col("_lo")))).alias("dynamic_range"))
    base = genes.groupBy(DS).agg(
        F.count(F.lit(1)).alias("n_genes"), F.max("n_samples").alias("n_samples"),
        (F.sum("zeros") / F.sum("n_samples")).alias("sparsity"),
        (F.count_if(mean > 0) / F.count(F.lit(1))).alias("detection_rate"))
    return base.join(libs, DS).join(medians, DS, "left").select(
        DS, "n_genes", "n_samples", "library_size_mean", "library_size_cv", "library_size_range", "sparsity",
        F.coalesce("_bcv", F.lit(0.3)).alias("bcv"), F.coalesce("median_count", F.lit(0.0)).alias("median_count"),
        F.coalesce("dynamic_range", F.lit(0.0)).alias("dynamic_range"), "detection_rate")
