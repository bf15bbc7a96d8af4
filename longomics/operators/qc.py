"""Quality components of count matrices, one row per dataset each, and their weighted overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ordered
from .moments import DS, SAMPLE, sample_totals

# Component weights of the overall score.
WEIGHTS = {"library_quality": 0.15, "gene_detection": 0.20, "outlier_detection": 0.15,
           "variance_structure": 0.15, "batch_effects": 0.20, "biological_signal": 0.15}

# Name parts that mark a metadata column as batch-like or condition-like.
BATCH_WORDS = ["batch", "plate", "run", "lane", "date", "flow", "chip", "slide", "array", "seq_run",
               "library_prep", "extraction"]
CONDITION_WORDS = ["condition", "treatment", "group", "status", "disease", "genotype", "phenotype",
                   "sample_type", "cell_type", "tissue"]


def status(score: Column, good: float = 70, warning: float = 50) -> Column:
    return F.when(score > good, "good").when(score > warning, "warning").otherwise("poor")


def flags(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[
        F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in pairs]))


def floor0(score: Column) -> Column:
    return F.greatest(F.lit(0.0), score)


def library_quality(counts: DataFrame) -> DataFrame:
    lib = F.col("library_size")
    a = sample_totals(counts).groupBy(DS).agg(
        F.avg(lib).alias("mean_size"), F.stddev_samp(lib).alias("_sd"),
        F.min(lib).alias("min_size"), F.max(lib).alias("max_size"))
    mean, lo, hi = F.col("mean_size"), F.col("min_size"), F.col("max_size")
    a = a.withColumn("cv", F.when(mean > 0, F.col("_sd") / mean).otherwise(0.0))
    ratio = F.when(lo > 0, hi / lo).otherwise(F.lit(float("inf")))
    raw = (100.0 - F.least(F.lit(30.0), F.col("cv") * 50)
           - F.when(lo > 0, F.least(F.lit(20.0), (hi / lo - 1) * 10)).otherwise(20.0))
    return a.select(DS, "mean_size", "cv", "min_size", "max_size", ratio.alias("size_range"),
                    floor0(raw).alias("score"), status(raw).alias("status"),
                    flags((F.col("cv") > 0.5, "high_library_variation"),
                          (lo < mean * 0.3, "very_small_libraries"),
                          (hi > mean * 3, "very_large_libraries")).alias("flags"))


def gene_detection(genes: DataFrame) -> DataFrame:
    """From per-gene moments: zero share and genes in the quartile classes of mean expression."""
    q = ordered.quantiles(genes, [DS], "mean", {"q1": 0.25, "q3": 0.75})
    mean = F.col("mean")
    a = genes.join(q, DS).groupBy(DS).agg(
        F.count(F.lit(1)).alias("n_genes"),
        (F.avg(F.col("zeros") / F.col("n_samples")) * 100).alias("zero_inflation_pct"),
        F.count_if(mean > F.col("q3")).alias("n_highly_expressed"),
        F.count_if((mean > F.col("q1")) & (mean <= F.col("q3"))).alias("n_medium_expressed"),
        F.count_if(mean <= F.col("q1")).alias("n_low_expressed"))
    pct = F.col("zero_inflation_pct")
    raw = (100.0 - F.least(F.lit(40.0), pct * 0.5)
           - F.when(F.col("n_highly_expressed") < F.col("n_genes") * 0.05, 10.0).otherwise(0.0))
    return a.select(DS, (1.0 - pct / 100).alias("mean_detection_rate"), pct, "n_highly_expressed",
                    "n_medium_expressed", "n_low_expressed", floor0(raw).alias("score"),
                    status(raw).alias("status"),
                    flags((pct > 70, "very_high_zero_inflation"),
                          ((pct > 50) & (pct <= 70), "high_zero_inflation")).alias("flags"))


def biological_signal(genes: DataFrame) -> DataFrame:
    """Share of genes above the median mean whose coefficient of variation exceeds its median."""
    g = genes.select(DS, "mean", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(0.0).alias("cv"))
    stacked = (g.select(DS, F.lit("mean").alias("metric"), F.col("mean").alias("value"))
               .unionByName(g.where("cv > 0").select(DS, F.lit("cv").alias("metric"), F.col("cv").alias("value"))))
    med = ordered.quantiles(stacked, [DS, "metric"], "value", {"m": 0.5})
    med = med.groupBy(DS).agg(F.max(F.when(F.col("metric") == "mean", F.col("m"))).alias("_mm"),
                              F.coalesce(F.max(F.when(F.col("metric") == "cv", F.col("m"))), F.lit(0.0)).alias("median_cv"))
    a = g.join(med, DS).groupBy(DS).agg(
        F.count_if((F.col("mean") > F.col("_mm")) & (F.col("cv") > F.col("median_cv"))).alias("n_signal_genes"),
        F.count(F.lit(1)).alias("_n"), F.max("median_cv").alias("median_cv"))
    strength = F.col("n_signal_genes") / F.col("_n") * 100
    score = F.least(F.lit(100.0), strength * 2)
    return a.select(DS, strength.alias("signal_strength"), "n_signal_genes", "median_cv", score.alias("score"),
                    status(score).alias("status"),
                    flags((strength < 10, "low_signal"), (strength > 30, "strong_signal")).alias("flags"))


def variance_structure(components: DataFrame) -> DataFrame:
    """From (dataset, component, variance_ratio): leading shares and components for 90%."""
    running = Window.partitionBy(DS).orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    c = components.withColumn("cum", F.sum("variance_ratio").over(running) * 100)
    ratio = F.col("variance_ratio")
    a = c.groupBy(DS).agg(
        (F.max(F.when(F.col("component") == 1, ratio)) * 100).alias("pc1_variance"),
        F.coalesce(F.max(F.when(F.col("component") == 2, ratio)) * 100, F.lit(0.0)).alias("pc2_variance"),
        F.coalesce(F.min(F.when(F.col("cum") >= 90, F.col("component"))), F.max("component")).alias("n_components_90pct"))
    pc1, n90 = F.col("pc1_variance"), F.col("n_components_90pct")
    score = (100.0 - F.when(pc1 > 50, 20.0).otherwise(0.0) - F.when(pc1 > 70, 20.0).otherwise(0.0)
             - F.when(n90 < 2, 15.0).otherwise(0.0))
    return a.select(DS, "pc1_variance", "pc2_variance", "n_components_90pct", score.alias("score"),
                    status(score).alias("status"),
                    flags((pc1 > 50, "dominant_first_component"), (n90 < 3, "few_components")).alias("flags"))


def f_statistic(values: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """One-way F of ``value`` by ``group`` inside each ``by`` key, in two aggregates.

    Null when fewer than two groups, no residual degrees of freedom or no within-group variance.
    """
    per_group = values.groupBy(*by, group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    n, m = F.col("n"), F.col("m")
    total = per_group.groupBy(*by).agg((F.sum(n * m) / F.sum(n)).alias("grand"))
    a = per_group.join(total, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_values"),
        F.sum(n * (m - F.col("grand")) * (m - F.col("grand"))).alias("between"),
        F.sum(n * F.col("v")).alias("within"))
    dfb, dfw = F.col("n_groups") - 1, F.col("n_values") - F.col("n_groups")
    return a.select(*by, "n_groups", "n_values",
                    F.when((F.col("within") > 0) & (dfw > 0) & (dfb > 0),
                           (F.col("between") / dfb) / (F.col("within") / dfw)).alias("f"))


def confounding(samples: DataFrame, batch: str, condition: str) -> DataFrame:
    """True when some condition occurs in a single batch (two or more of each present)."""
    per = samples.groupBy(DS, condition).agg(F.count_distinct(batch).alias("nb"))
    totals = samples.groupBy(DS).agg(F.count_distinct(batch).alias("batches"))
    return (per.groupBy(DS).agg(F.min("nb").alias("least"), F.count(F.lit(1)).alias("conditions"))
            .join(totals, DS)
            .select(DS, ((F.col("batches") >= 2) & (F.col("conditions") >= 2) & (F.col("least") == 1)).alias("confounded")))


def column_kind(name: str) -> str:
    low = name.lower()
    if any(w in low for w in BATCH_WORDS):
        return "batch"
    return "condition" if any(w in low for w in CONDITION_WORDS) else "other"


def batch_effects(coords: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """Batch decision per dataset from first-component coordinates (dataset, sample, pc1).

    The metadata columns are unpivoted, so all F statistics come from one aggregate.
    """
    kinds = {c: column_kind(c) for c in columns}
    others = [c for c in columns if kinds[c] == "other"]
    if "batch" not in kinds.values() and "condition" not in kinds.values() and others:
        kinds[others[0]] = "condition"
        if len(others) > 1:
            kinds[others[1]] = "batch"
    long = samples.select(DS, SAMPLE, F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.lit(kinds[c]).alias("kind"), F.lit(i).alias("position"),
                 F.col(c).cast("string").alias("level")) for i, c in enumerate(columns)])).alias("e"))
    long = long.select(DS, SAMPLE, "e.*").join(coords.select(DS, SAMPLE, "pc1"), [DS, SAMPLE])
    f = f_statistic(long, [DS, "variable", "kind", "position"], "pc1", "level")
    f = f.where((F.col("n_groups") > 1) & (F.col("n_groups") < F.col("n_values")) & F.col("f").isNotNull())
    best = F.struct("f", (-F.col("position")).alias("o"), "variable")
    top = f.groupBy(DS).agg(F.max(F.when(F.col("kind") == "batch", best)).alias("b"),
                            F.max(F.when(F.col("kind") == "condition", best)).alias("c"))
    # Confounding is decided for the winning pair: contingency over (batch column, condition column).
    wide = long.where("kind = 'batch'").select(DS, SAMPLE, F.col("variable").alias("bv"), F.col("level").alias("bl")).join(
        long.where("kind = 'condition'").select(DS, SAMPLE, F.col("variable").alias("cv"), F.col("level").alias("cl")), [DS, SAMPLE])
    per = wide.groupBy(DS, "bv", "cv", "cl").agg(F.count_distinct("bl").alias("nb"))
    nb = wide.groupBy(DS, "bv", "cv").agg(F.count_distinct("bl").alias("n_b"))
    conf = (per.groupBy(DS, "bv", "cv").agg(F.min("nb").alias("least"), F.count(F.lit(1)).alias("n_c"))
            .join(nb, [DS, "bv", "cv"])
            .select(DS, F.col("bv").alias("batch_variable"), F.col("cv").alias("condition_variable"),
                    ((F.col("n_b") >= 2) & (F.col("n_c") >= 2) & (F.col("least") == 1)).alias("confounded")))
    a = (samples.select(DS).distinct().join(top, DS, "left")
         .select(DS, F.col("b.variable").alias("batch_variable"), F.col("b.f").alias("batch_strength"),
                 F.col("c.variable").alias("condition_variable"), F.col("c.f").alias("condition_strength"))
         .join(conf, [DS, "batch_variable", "condition_variable"], "left")
         .withColumn("confounded", F.coalesce("confounded", F.lit(False))))
    bs, cs = F.coalesce("batch_strength", F.lit(0.0)), F.coalesce("condition_strength", F.lit(0.0))
    detected = (bs > 5) & ((cs == 0) | (bs > cs))
    score = (100.0 - F.when(detected, F.least(F.lit(40.0), bs * 3)).otherwise(0.0)
             - F.when(F.col("confounded"), 20.0).otherwise(0.0))
    advice = (F.when(F.col("confounded"), "confounded_design").when(~detected, "none")
              .when(bs > 10, "strong").when(bs > 5, "moderate").otherwise("weak"))
    return a.select(DS, detected.alias("batch_detected"), "batch_variable", "batch_strength",
                    "condition_variable", "condition_strength", "confounded",
                    floor0(score).alias("score"), status(score, 80, 60).alias("status"),
                    advice.alias("recommendation"),
                    flags((detected, "batch_effect"), (~(bs > 5) & (bs > 2), "moderate_batch_effect"),
                          (cs > 2, "biological_signal"), (F.col("confounded"), "confounded")).alias("flags"))


def outlier_score(n_outliers: Column, n_samples: Column) -> Column:
    return 100.0 - F.least(F.lit(50.0), n_outliers / n_samples * 100 * 5)


def overall(components: dict[str, DataFrame]) -> DataFrame:
    """Weighted score over the given components (dataset, score); missing ones add nothing."""
    stacked = None
    for name, frame in components.items():
        part = frame.select(DS, (F.col("score") * WEIGHTS[name]).alias("part"))
        stacked = part if stacked is None else stacked.unionByName(part)
    total = stacked.groupBy(DS).agg(F.sum("part").alias("score"))
    s = F.col("score")
    return total.select(DS, "score", F.when(s >= 80, "good").when(s >= 60, "acceptable").otherwise("poor").alias("status"))

