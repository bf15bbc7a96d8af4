"""Transcript quantities to gene level, and per-sample quantification statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import small


def to_genes(quant: DataFrame, tx2gene: DataFrame) -> DataFrame:
    """Attach genes; unmapped transcripts drop out."""
    return quant.join(small(tx2gene.select("tx_id", "gene_id")), "tx_id")


def aggregate_to_gene(quant: DataFrame, tx2gene: DataFrame) -> DataFrame:
    """One pass per (sample, gene): summed reads (rounded half-even), summed TPM, mean effective length."""
    return to_genes(quant, tx2gene).groupBy("sample_id", "gene_id").agg(
        F.bround(F.sum("num_reads"), 0).cast("bigint").alias("count"), F.sum("tpm").alias("tpm"),
        F.avg("eff_length").alias("mean_eff_length"))


def count_summary(counts: DataFrame) -> DataFrame:
    """Genes, samples, total, mean per sample and genes with any read."""
    genes = counts.groupBy("gene_id").agg(F.sum("count").alias("t"))
    g = genes.agg(F.count(F.lit(1)).alias("n_genes"), F.sum("t").cast("double").alias("total_counts"),
                  F.count_if(F.col("t") > 0).alias("detected_genes"))
    n = counts.select("sample_id").distinct().agg(F.count(F.lit(1)).alias("n_samples"))
    return g.crossJoin(F.broadcast(n)).withColumn("mean_per_sample", F.col("total_counts") / F.col("n_samples"))


def quant_stats(quant: DataFrame, run_info: DataFrame) -> DataFrame:
    """Per sample: reads processed and mapped with rate, summed counts and transcripts."""
    q = quant.groupBy("sample_id").agg(F.sum("num_reads").alias("total_counts"), F.count(F.lit(1)).alias("n_transcripts"))
    return (q.join(run_info, "sample_id", "full")
            .fillna(0, ["total_counts", "n_transcripts", "n_processed", "n_mapped", "n_unique"])
            .fillna(0.0, ["mapping_rate"]).fillna("unknown", ["tool_version"]))


def report_aggregates(stats: DataFrame) -> DataFrame:
    """Mean mapping rate, total reads and the library CV in percent (ddof 1)."""
    return stats.agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("mapping_rate").alias("mean_mapping_rate"),
        F.sum("n_processed").alias("total_reads"),
        F.when(F.avg("total_counts") > 0, F.stddev_samp("total_counts") / F.avg("total_counts") * 100).alias("library_cv_pct"))
