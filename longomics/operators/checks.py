"""Integrity checks as one-row-per-dataset reports, with an optional raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .moments import DS, GENE, SAMPLE

# Fewest validated genes accepted, recommended and ideal.
TRUTH_LEVELS = (10, 20, 50)


def count_matrix_report(cells: DataFrame, min_genes: int = 1, min_samples: int = 1) -> DataFrame:
    """Dimensions and violations of long cells: negatives, nulls, NaN, infinities, duplicates, empties."""
    v = F.col("count").cast("double")
    bad_null = F.col("count").isNull() | F.isnan(v)
    base = cells.groupBy(DS).agg(
        F.count_if(v < 0).alias("n_negative"), F.count_if(bad_null).alias("n_missing"),
        F.count_if(v.isin(float("inf"), float("-inf"))).alias("n_infinite"))
    dup = (cells.groupBy(DS, GENE, SAMPLE).agg(F.count(F.lit(1)).alias("k"))
           .groupBy(DS).agg(F.count_if(F.col("k") > 1).alias("n_duplicate_cells")))
    genes = cells.groupBy(DS, GENE).agg(F.sum("count").alias("t")).groupBy(DS).agg(
        F.count(F.lit(1)).alias("n_genes"), F.count_if(F.col("t") == 0).alias("n_zero_genes"))
    samples = cells.groupBy(DS, SAMPLE).agg(F.sum("count").alias("t")).groupBy(DS).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("t") == 0).alias("n_zero_samples"))
    out = base.join(dup, DS).join(genes, DS).join(samples, DS)
    ok = ((F.col("n_genes") >= min_genes) & (F.col("n_samples") >= min_samples) & (F.col("n_negative") == 0)
          & (F.col("n_missing") == 0) & (F.col("n_infinite") == 0) & (F.col("n_duplicate_cells") == 0))
    return out.withColumn("valid", ok)


def require_valid(report: DataFrame) -> None:
    """Raise ValueError naming one failing dataset."""
    bad = report.where(~F.col("valid")).limit(1).collect()
    if bad:
        raise ValueError(f"invalid input: {bad[0].asDict()}")


def integrity_report(cells: DataFrame, samples: DataFrame, feature_type: str = "gene",
                     raw_counts: bool = True) -> DataFrame:
    """Sample overlap, zero features, missing, negative and out-of-range values per dataset."""
    v = F.col("count").cast("double")
    missing = F.col("count").isNull() | F.isnan(v)
    a = cells.groupBy(DS).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(missing).alias("n_missing"),
        F.count_if(v < 0).alias("n_negative"), F.count_if((v < 0) | (~missing & (v > 1))).alias("n_out_of_range"))
    z = cells.groupBy(DS, GENE).agg(F.sum("count").alias("t")).groupBy(DS).agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(F.coalesce("t", F.lit(0)) == 0).alias("n_zero_features"))
    s = sample_overlap(cells, samples)
    out = a.join(z, DS).join(s, DS)
    pct = 100.0 * F.col("n_zero_features") / F.col("n_features")
    probe = feature_type == "probe"
    warn_zero = (pct > 20) if probe else F.col("n_zero_features") > 0
    warnings = F.array_compact(F.array(
        F.when(F.col("n_lack_metadata") > 0, "samples_without_metadata"), F.when(F.col("n_lack_data") > 0, "metadata_without_data"),
        F.when(warn_zero, "zero_features"), F.when(F.col("n_missing") > 0, "missing_values"),
        F.when(F.lit(raw_counts) & (F.col("n_negative") > 0), "negative_values"),
        F.when(F.lit(probe and not raw_counts) & (F.col("n_out_of_range") > 0), "outside_beta_range")))
    return out.select("*", (F.col("n_shared") > 0).alias("valid"), warnings.alias("warnings"))


def sample_overlap(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Shared samples and the samples missing on either side."""
    a = cells.select(DS, SAMPLE).distinct().withColumn("in_data", F.lit(1))
    b = samples.select(DS, SAMPLE).distinct().withColumn("in_meta", F.lit(1))
    return a.join(b, [DS, SAMPLE], "full").groupBy(DS).agg(
        F.count_if(F.col("in_data").isNotNull() & F.col("in_meta").isNotNull()).alias("n_shared"),
        F.count_if(F.col("in_meta").isNull()).alias("n_lack_metadata"),
        F.count_if(F.col("in_data").isNull()).alias("n_lack_data"))


def missing_metadata(cells: DataFrame, samples: DataFrame) -> DataFrame:
    return cells.select(DS, SAMPLE).distinct().join(samples.select(DS, SAMPLE), [DS, SAMPLE], "left_anti")


def missing_data(cells: DataFrame, samples: DataFrame) -> DataFrame:
    return samples.select(DS, SAMPLE).join(cells.select(DS, SAMPLE), [DS, SAMPLE], "left_anti")


def metadata_report(samples: DataFrame, group: str, min_groups: int = 2, min_per_group: int = 2) -> DataFrame:
    dup = samples.groupBy(DS, SAMPLE).agg(F.count(F.lit(1)).alias("k")).groupBy(DS).agg(
        F.count_if(F.col("k") > 1).alias("n_duplicate_samples"), F.sum("k").alias("n_samples"))
    g = samples.where(F.col(group).isNotNull()).groupBy(DS, group).agg(F.count(F.lit(1)).alias("k")).groupBy(DS).agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("k").alias("smallest_group"), F.count_if(F.col("k") < min_per_group).alias("n_small_groups"))
    return dup.join(g, DS, "left").withColumn("valid", (F.col("n_duplicate_samples") == 0) & (F.col("n_groups") >= min_groups)
                                              & (F.col("n_small_groups") == 0))


def sample_sheet_report(sheet: DataFrame, by: str = DS) -> DataFrame:
    """``sheet``: sample_id, condition, batch, read_type."""
    dup = sheet.groupBy(by, SAMPLE).agg(F.count(F.lit(1)).alias("k")).groupBy(by).agg(
        F.count_if(F.col("k") > 1).alias("n_duplicate_samples"), F.sum("k").alias("n_samples"))
    filled = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c)))
    a = sheet.groupBy(by).agg(
        (F.count_distinct("read_type") > 1).alias("mixed_reads"),
        (F.count_if(F.col("read_type") == "paired") * 2 > F.count(F.lit(1))).alias("mostly_paired"),
        filled("condition").alias("n_conditions"), filled("batch").alias("n_batches"))
    return dup.join(a, by).withColumn("valid", F.col("n_duplicate_samples") == 0)


def de_report(de: DataFrame, by: list[str]) -> DataFrame:
    lfc, p = F.col("log2fc"), F.col("p_value")
    return de.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_genes"), F.count_if(lfc.isNull() | F.isnan(lfc)).alias("n_missing_lfc"),
        F.count_if(p.isNull() | F.isnan(p)).alias("n_missing_p"),
        F.count_if(lfc.isin(float("inf"), float("-inf"))).alias("n_infinite_lfc"))


def truth_report(truth: DataFrame) -> DataFrame:
    least, advised, ideal = TRUTH_LEVELS
    a = truth.agg(F.count(F.lit(1)).alias("n_genes"), F.count_distinct("gene_id").alias("n_distinct"))
    n = F.col("n_genes")
    return a.withColumn("level", F.when(n < least, "too_few").when(n < advised, "borderline").when(n < ideal, "good").otherwise("excellent"))
