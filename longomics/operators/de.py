"""Differential-expression result tables: tool detection, standard columns, significance, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import files

# Accepted spellings per tool, in order of preference.
ALIASES = {
    "deseq2": {
        "log2_fold_change": ["log2FoldChange", "log2FC", "lfc", "logFC"],
        "p_value": ["pvalue", "pval", "PValue", "p.value"],
        "adjusted_p_value": ["padj", "FDR", "adj.P.Val", "qvalue", "q.value"],
        "base_mean": ["baseMean", "AveExpr", "logCPM", "meanExpr"],
        "statistic": ["stat", "t", "LR", "F", "z"],
        "se": ["lfcSE", "SE", "se"],
    },
    "edger": {
        "log2_fold_change": ["logFC", "log2FoldChange", "lfc"],
        "p_value": ["PValue", "pvalue", "pval", "p.value"],
        "adjusted_p_value": ["FDR", "padj", "adj.P.Val", "qvalue"],
        "base_mean": ["logCPM", "AveExpr", "baseMean"],
        "statistic": ["LR", "F", "stat", "t"],
    },
    "limma": {
        "log2_fold_change": ["logFC", "log2FoldChange", "lfc"],
        "p_value": ["P.Value", "pvalue", "PValue", "pval"],
        "adjusted_p_value": ["adj.P.Val", "padj", "FDR", "qvalue"],
        "base_mean": ["AveExpr", "logCPM", "baseMean"],
        "statistic": ["t", "B", "stat", "F"],
        "b_statistic": ["B"],
    },
    "wilcoxon": {
        "log2_fold_change": ["logFC", "log2FoldChange", "lfc"],
        "p_value": ["pvalue", "PValue", "pval", "p.value"],
        "adjusted_p_value": ["padj", "FDR", "adj.P.Val", "qvalue"],
        "base_mean": ["AveExpr", "logCPM", "baseMean"],
        "statistic": ["W", "stat"],
    },
}
GENE_COLUMNS = ["gene_id", "GeneID", "gene", "Gene", "ID", "id"]
REQUIRED = ["log2_fold_change", "p_value", "adjusted_p_value"]
TOP_BY = {"padj": "adjusted_p_value", "pvalue": "p_value", "lfc": "log2_fold_change", "base_mean": "base_mean"}


def detect_tool(columns: list[str]) -> str:
    """Tool by column signature; deseq2 when nothing matches."""
    have = set(columns)
    if {"baseMean", "lfcSE"} <= have:
        return "deseq2"
    if "logCPM" in have and have & {"LR", "F"}:
        return "edger"
    if {"AveExpr", "B"} <= have:
        return "limma"
    return "wilcoxon" if {"logFC", "pvalue"} <= have else "deseq2"


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def standardise(df: DataFrame, tool: str | None = None, gene_column: str | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """gene_id plus the standard columns found by alias; raises when a required one is missing.

    Without a gene column a per-row identifier is made from the row's position-free unique id.
    """
    aliases = ALIASES.get(tool or detect_tool(df.columns), ALIASES["deseq2"])
    gene = gene_column or next((c for c in GENE_COLUMNS if c in df.columns), None)
    gene_col = (_named(gene) if gene else
                F.concat(F.lit("Gene_"), F.monotonically_increasing_id().cast("string")))
    found = {name: next((c for c in names if c in df.columns), None) for name, names in aliases.items()}
    missing = [c for c in REQUIRED if not found.get(c)]
    if missing:
        raise ValueError(f"could not find required columns {missing}; available: {df.columns}")
    cols = [_named(c).try_cast("double").alias(n) for n, c in found.items() if c]
    return df.select(gene_col.alias("gene_id"), *[_named(c) for c in keep or []], *cols)


def significance(df: DataFrame, fdr: float = 0.05, lfc: float = 0.0) -> DataFrame:
    """is_significant (strict in both) and direction, unchanged when not significant."""
    change = F.col("log2_fold_change")
    sig = F.coalesce((F.col("adjusted_p_value") < fdr) & (F.abs(change) > lfc), F.lit(False))
    return df.withColumns({
        "is_significant": sig,
        "direction": F.when(sig & (change > 0), "up").when(sig & (change < 0), "down").otherwise("unchanged")})


def filter_by_threshold(df: DataFrame, fdr: float, lfc: float = 0.0) -> DataFrame:
    if not 0 <= fdr <= 1 or not 0 <= lfc <= 10:
        raise ValueError("fdr must lie in [0, 1] and lfc in [0, 10]")
    return significance(df, fdr, lfc)


# Order of the written output; a missing adjusted p-value stands last.
OUTPUT_ORDER = ["adjusted_p_value", "gene_id"]


def output_order(df: DataFrame) -> DataFrame:
    """Missing adjusted p-values as infinity, for :func:`sinks.save_ordered` by ``OUTPUT_ORDER``."""
    return df.withColumn("adjusted_p_value", F.coalesce("adjusted_p_value", F.lit(float("inf"))))


def detect_tools(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(file, tool) for every result file below ``path``, told by its own header line."""
    headers = files.file_headers(spark, path)
    names = F.transform(F.split("header", sep), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    has = lambda *wanted: F.size(F.array_intersect(names, F.array(*[F.lit(w) for w in wanted])))
    tool = (F.when(has("baseMean", "lfcSE") == 2, "deseq2").when((has("logCPM") == 1) & (has("LR", "F") > 0), "edger")
            .when(has("AveExpr", "B") == 2, "limma").when(has("logFC", "pvalue") == 2, "wilcoxon").otherwise("deseq2"))
    return headers.select("file", tool.alias("tool"))


def tool_output(df: DataFrame, tool: str, fdr: float = 0.05, lfc: float = 0.0) -> DataFrame:
    """Raw tool table to the common output: linear base mean, aliases, significance. ``OUTPUT_ORDER`` is the written order."""
    logged = tool in ("limma", "edger")
    std = significance(standardise(df, tool), fdr, lfc)
    if logged and "base_mean" in std.columns:
        std = std.withColumn("base_mean", F.pow(F.lit(2.0), F.col("base_mean")))
    return std


def summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    sig, d = F.col("is_significant"), F.col("direction")
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_tested"), F.count_if(sig).alias("n_significant"),
        F.count_if(sig & (d == "up")).alias("n_up"), F.count_if(sig & (d == "down")).alias("n_down"))


def top_genes(df: DataFrame, n: int = 50, by: str = "padj", significant_only: bool = False,
              ties: tuple[str, ...] = ("gene_id",)) -> DataFrame:
    """The n best rows: smallest padj or p-value, largest absolute change or base mean."""
    by = {v: k for k, v in TOP_BY.items()}.get(by, by)
    if by not in TOP_BY:
        raise ValueError(f"by must be one of {sorted(TOP_BY)}")
    column = F.col(TOP_BY[by])
    order = {"lfc": F.abs(column).desc_nulls_last(), "base_mean": column.desc_nulls_last()}.get(
        by, column.asc_nulls_last())
    rows = df.where("is_significant") if significant_only else df
    return rows.orderBy(order, *ties).limit(n)


def prefilter(counts: DataFrame, min_count: int = 10, min_samples: int = 2) -> DataFrame:
    """Keep genes with ``min_count`` or more in at least ``min_samples`` samples."""
    keep = (counts.groupBy("dataset_id", "gene_id").agg(F.count_if(F.col("count") >= min_count).alias("n"))
            .where(F.col("n") >= min_samples))
    return counts.join(keep, ["dataset_id", "gene_id"], "left_semi")


def filter_genes(counts: DataFrame, min_total: int = 10, min_samples: int = 2, min_count: int = 1) -> DataFrame:
    """Keep genes with enough total count that occur in enough samples."""
    keep = (counts.groupBy("dataset_id", "gene_id")
            .agg(F.sum("count").alias("t"), F.count_if(F.col("count") >= min_count).alias("n"))
            .where((F.col("t") >= min_total) & (F.col("n") >= min_samples)))
    return counts.join(keep, ["dataset_id", "gene_id"], "left_semi")


def significant_genes(df: DataFrame, alpha: float, lfc: float) -> DataFrame:
    """Rows passing padj (or p-value where the table has no padj) and absolute change."""
    if not 0 < alpha < 1 or not 0 <= lfc <= 5:
        raise ValueError("alpha must lie in (0, 1) and lfc in [0, 5]")
    p = "padj" if "padj" in df.columns else "p_value"
    return (df.where((F.col(p) < alpha) & (F.abs("log2fc") > lfc))
            .withColumn("direction", F.when(F.col("log2fc") > 0, "up").otherwise("down")))
