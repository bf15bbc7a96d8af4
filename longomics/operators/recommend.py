"""Rule-based scoring of differential-expression methods from a dataset profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Candidate methods, base scores, fewest replicates each accepts.
METHODS = ["DESeq2", "edgeR", "limma-voom", "Wilcoxon", "edgeR_robust"]
BASE = {"DESeq2": 70.0, "edgeR": 70.0, "limma-voom": 70.0, "Wilcoxon": 50.0, "edgeR_robust": 60.0}
MIN_REPLICATES = {"DESeq2": 2, "edgeR": 2, "limma-voom": 3, "Wilcoxon": 8, "edgeR_robust": 2}


def _rules() -> list[tuple[Column, dict[str, float | Column]]]:
    """Fixed values: (condition on the profile, points per method)."""
    c = F.col
    n, bcv, sev = c("min_group_size"), c("bcv"), c("outlier_severity")
    out, low = c("has_outliers"), c("low_count_proportion")
    mild, moderate = out & (sev == "mild"), out & (sev == "moderate")
    severe = out & ~sev.isin("mild", "moderate")
    every = {m: -10.0 for m in METHODS}
    return [
        (n < 3, {"DESeq2": 20, "edgeR": 10, "limma-voom": -20, "Wilcoxon": -30}),
        ((n >= 3) & (n < 8), {"DESeq2": 15, "edgeR": 15, "limma-voom": 10, "Wilcoxon": -20}),
        ((n >= 8) & (n < 20), {"DESeq2": 10, "edgeR": 10, "limma-voom": 15, "Wilcoxon": 15}),
        (n >= 20, {"DESeq2": 5, "edgeR": 5, "limma-voom": 20, "Wilcoxon": 25}),
        (bcv < 0.2, {"DESeq2": 5, "limma-voom": 10}),
        ((bcv >= 0.2) & (bcv < 0.4), {"DESeq2": 10, "edgeR": 10, "limma-voom": 5}),
        (bcv >= 0.4, {"DESeq2": 5, "edgeR": 15, "limma-voom": -5, "edgeR_robust": 10}),
        (mild, {"DESeq2": 5, "edgeR_robust": 10}),
        (moderate, {"DESeq2": 5, "edgeR": -5, "limma-voom": -5, "edgeR_robust": 20}),
        (severe, {"edgeR": -10, "edgeR_robust": 25}),
        (severe & (n < 10), {"limma-voom": -10}),
        (low > 0.3, {"DESeq2": 5, "edgeR": 10, "edgeR_robust": 5}),
        (c("sparsity") > 0.6, {"DESeq2": 5, "edgeR": 5}),
        (c("library_size_cv") > 0.3, {"DESeq2": 5, "edgeR": 5}),
        (c("library_size_range") > 5, {"DESeq2": 5}),
        (c("has_batch_effect"), {"DESeq2": 10, "limma-voom": 5, "Wilcoxon": -10}),
        (c("has_batch_effect") & c("batch_confounded"), every),
        (c("design_complexity") == "complex", {"DESeq2": 5, "limma-voom": 15, "Wilcoxon": -15}),
    ]


def method_scores(profile: DataFrame) -> DataFrame:
    """(dataset, method, score): rule points clamped to 0-100, then -30 below the replicate minimum."""
    rules = _rules()
    entries = []
    for method in METHODS:
        score = F.lit(BASE[method])
        for condition, points in rules:
            if method in points:
                score = score + F.when(condition, float(points[method])).otherwise(0.0)
        score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
        short = F.col("min_group_size") < MIN_REPLICATES[method]
        score = F.when(short, F.greatest(F.lit(0.0), score - 30.0)).otherwise(score)
        entries.append(F.struct(F.lit(METHODS.index(method)).alias("position"),
                                F.lit(method).alias("method"), score.alias("score")))
    exploded = profile.select("dataset_id", F.explode(F.array(*entries)).alias("e"))
    return exploded.select("dataset_id", "e.position", "e.method", "e.score")


def warnings_of() -> Column:
    c = F.col
    batch = c("has_batch_effect")
    return F.array_compact(F.array(
        F.when(c("min_group_size") < 3, "low_replication"),
        F.when(c("bcv") > 0.5, "high_biological_variation"),
        F.when(c("has_outliers"), F.concat(F.lit("outliers_"), c("outlier_severity"))),
        F.when(batch, "batch_effect"),
        F.when(batch & c("batch_confounded"), "batch_confounded"),
        F.when(c("sparsity") > 0.7, "high_sparsity"),
        F.when(c("library_size_range") > 10, "library_size_variation")))


def recommend(profile: DataFrame) -> DataFrame:
    """Primary, alternative and third method with scores, warnings and decision factors."""
    ranked = method_scores(profile).groupBy("dataset_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "position", "method"))).alias("r"))

    def pick(i: int) -> list[Column]:
        label = ["primary", "alternative", "third"][i]
        return [F.col("r")[i]["method"].alias(label), (-F.col("r")[i]["s"]).alias(f"{label}_score")]

    factors = ["min_group_size", "n_groups", "bcv", "bcv_category", "library_size_cv",
               "low_count_proportion", "sparsity", "has_outliers", "has_batch_effect", "design_complexity"]
    return (ranked.select("dataset_id", *pick(0), *pick(1), *pick(2))
            .join(profile.select("dataset_id", warnings_of().alias("warnings"), *factors), "dataset_id"))
