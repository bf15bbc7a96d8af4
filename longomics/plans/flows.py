"""Multi-operator flows: quality report, count-to-recommendation, pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import moments, normalize, outliers, profile, qc, recommend
from ..operators.moments import DS
from ..runtime import cut


def log_values(counts: DataFrame, normalisation: str = "log2") -> DataFrame:
    """Values for sample-space work: log2 | cpm | quantile | none."""
    if normalisation == "none":
        return counts.select(DS, "gene_id", "sample_id", F.col("count").cast("double").alias("value"))
    if normalisation == "cpm":
        return normalize.cpm(counts, log=True)
    if normalisation == "quantile":
        return normalize.quantile_normalise(counts)
    return normalize.log2p1(counts)


def quality_components(counts: DataFrame, samples: DataFrame, columns: list[str],
                       normalisation: str = "log2") -> dict[str, DataFrame]:
    genes = cut(moments.matrix_summaries(counts)["genes"])
    pcs = outliers.principal_components(cut(log_values(counts, normalisation)))
    basic = outliers.basic_outliers(pcs, counts)
    flagged = basic.groupBy(DS).agg(F.count_if("outlier").alias("n_outliers"), F.count(F.lit(1)).alias("n"))
    score = qc.outlier_score(F.col("n_outliers"), F.col("n"))
    return {
        "library_quality": qc.library_quality(counts),
        "gene_detection": qc.gene_detection(genes),
        "outlier_detection": flagged.select(DS, "n_outliers", score.alias("score")),
        "variance_structure": qc.variance_structure(outliers.variance_ratios(pcs)),
        "batch_effects": qc.batch_effects(outliers.coordinates(pcs, 1), samples, columns),
        "biological_signal": qc.biological_signal(genes),
    }


def quality_report(counts: DataFrame, samples: DataFrame, columns: list[str],
                   normalisation: str = "log2") -> DataFrame:
    """One row per dataset: every component score and the weighted overall score and status."""
    parts = {k: cut(v) for k, v in quality_components(counts, samples, columns, normalisation).items()}
    out = qc.overall(parts).withColumnsRenamed({"score": "quality_score", "status": "quality_status"})
    for name, frame in parts.items():
        out = out.join(frame.select(DS, F.round("score", 6).alias(f"{name}_score")), DS, "left")
    batch = parts["batch_effects"].select(DS, F.col("batch_detected").alias("has_batch_effect"),
                                          F.col("confounded").alias("batch_confounded"))
    n = parts["outlier_detection"].select(DS, "n_outliers")
    return (out.withColumn("quality_score", F.round("quality_score", 6))
            .join(batch, DS, "left").join(n, DS, "left"))


def outlier_severity(votes: DataFrame) -> DataFrame:
    """Dataset-level outlier presence and severity by share of consensus outliers."""
    share = F.count_if("is_outlier") / F.count(F.lit(1))
    return votes.groupBy(DS).agg(
        (F.count_if("is_outlier") > 0).alias("has_outliers"),
        F.when(share == 0, "none").when(share <= 0.05, "mild").when(share <= 0.15, "moderate")
        .otherwise("severe").alias("outlier_severity"))


def assess_and_recommend(counts: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """Quality and outlier results joined into the profile before the rules score the methods."""
    report = quality_report(counts, samples, columns)
    votes = outliers.consensus_outliers(counts, log_values(counts))
    quality = (report.select(DS, "quality_score", "has_batch_effect", "batch_confounded")
               .join(outlier_severity(votes), DS, "left"))
    return recommend.recommend(profile.full_profile(counts, samples, quality=cut(quality)))
