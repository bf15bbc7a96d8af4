"""Pooling many studies: id harmonisation, sample-id conflicts, merging, metadata, hold-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import normalize
from .moments import GENE, SAMPLE, fill_genes

STUDY = "study"


def convert_ids(counts: DataFrame, mapping: DataFrame, aggregate: str = "mean", drop_unmapped: bool = True) -> DataFrame:
    """Replace gene ids through (from_id, to_id) and fold duplicates by mean | sum | max | first.

    ``first`` keeps the value of the smallest source id.
    """
    keys = [c for c in counts.columns if c not in (GENE, "count")]
    m = mapping.select(F.col("from_id").alias(GENE), "to_id")
    joined = counts.join(m, GENE, "inner" if drop_unmapped else "left")
    value = {"mean": F.avg("count"), "sum": F.sum("count"), "max": F.max("count"), "first": F.min_by("count", GENE)}
    agg = value.get(aggregate, value["mean"])
    return joined.groupBy(*keys, "to_id").agg(agg.alias("count")).withColumnRenamed("to_id", GENE)


def resolve_sample_conflicts(counts: DataFrame) -> DataFrame:
    """Prefix every sample id by its study ('-' -> '_', '__' joined) when any id occurs in two studies."""
    clash = (counts.select(STUDY, SAMPLE).distinct().groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("k"))
             .agg(F.coalesce(F.max("k") > 1, F.lit(False)).alias("_clash")))
    prefixed = F.concat(F.replace(F.col(STUDY).cast("string"), F.lit("-"), F.lit("_")), F.lit("__"), F.col(SAMPLE).cast("string"))
    return (counts.crossJoin(F.broadcast(clash))
            .withColumn(SAMPLE, F.when(F.col("_clash"), prefixed).otherwise(F.col(SAMPLE).cast("string"))).drop("_clash"))


def gene_overlap(counts: DataFrame) -> DataFrame:
    """Common and total genes over all studies."""
    per_gene = counts.select(STUDY, GENE).distinct().groupBy(GENE).agg(F.count(F.lit(1)).alias("k"))
    n = counts.select(STUDY).distinct().agg(F.count(F.lit(1)).alias("n_studies"))
    return per_gene.crossJoin(F.broadcast(n)).agg(
        F.max("n_studies").alias("n_studies"), F.count_if(F.col("k") == F.col("n_studies")).alias("n_common"),
        F.count(F.lit(1)).alias("n_total"))


def common_genes(counts: DataFrame) -> DataFrame:
    n = counts.select(STUDY).distinct().agg(F.count(F.lit(1)).alias("n"))
    return (counts.select(STUDY, GENE).distinct().groupBy(GENE).agg(F.count(F.lit(1)).alias("k"))
            .crossJoin(F.broadcast(n)).where("k = n").select(GENE))


def merge_studies(counts: DataFrame, method: str = "inner", min_common_genes: int = 100) -> DataFrame:
    """Dense merged cells (study, gene, sample, count) over common (inner) or all (outer) genes.

    Fewer common genes than the minimum are refused for both methods. Missing cells become zeros.
    """
    if method not in ("inner", "outer"):
        raise ValueError("method must be 'inner' or 'outer'")
    found = gene_overlap(counts).first()
    if found["n_common"] < min_common_genes:
        raise ValueError(f"only {found['n_common']} common genes (minimum {min_common_genes})")
    genes = common_genes(counts) if method == "inner" else counts.select(GENE).distinct()
    kept = counts.join(genes, GENE, "left_semi") if method == "inner" else counts
    samples = counts.select(STUDY, SAMPLE).distinct()
    return fill_genes(kept, samples, genes, [STUDY, SAMPLE], [], "count").select(STUDY, GENE, SAMPLE, "count")


def merge_metadata(frames: dict[str, DataFrame], info: dict[str, tuple[str, str]]) -> DataFrame:
    """Union of sample tables with study, repository and organism; missing columns become null."""
    out = None
    for study, frame in frames.items():
        repository, organism = info.get(study, ("", ""))
        part = frame.withColumns({STUDY: F.lit(study), "repository": F.lit(repository), "organism": F.lit(organism)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def samples_per_study(counts: DataFrame) -> DataFrame:
    return counts.select(STUDY, SAMPLE).distinct().groupBy(STUDY).agg(F.count(F.lit(1)).alias("n_samples"))


def leave_one_out(counts: DataFrame, study: str) -> tuple[DataFrame, DataFrame]:
    """(all other studies, the held-out study)."""
    return counts.where(F.col(STUDY) != study), counts.where(F.col(STUDY) == study)


def pool(counts: DataFrame, method: str = "inner", batch_correction: str = "none", min_common_genes: int = 100,
         mapping: DataFrame | None = None, aggregate: str = "mean") -> DataFrame:
    """Harmonise ids, resolve sample ids, merge, correct. Result: dataset 'pool', study-labelled values."""
    c = counts if mapping is None else convert_ids(counts, mapping, aggregate)
    merged = merge_studies(resolve_sample_conflicts(c), method, min_common_genes)
    return normalize.batch_correct(merged.withColumn("dataset_id", F.lit("pool")), batch_correction, STUDY)


def id_type(ids: DataFrame, by: list[str], gene: str = GENE) -> DataFrame:
    """ensembl | entrez | symbol | unknown by majority of the ids of each key."""
    g = F.col(gene).cast("string")
    a = ids.groupBy(*by).agg(
        F.avg(g.startswith("ENS").cast("int")).alias("e"), F.avg(g.rlike("^[0-9]+$").cast("int")).alias("n"),
        F.avg((g.rlike("^\\p{L}") & (F.length(g) < 20)).cast("int")).alias("s"))
    return a.select(*by, F.when(F.col("e") > 0.5, "ensembl").when(F.col("n") > 0.5, "entrez")
                    .when(F.col("s") > 0.5, "symbol").otherwise("unknown").alias("gene_id_type"))


def gene_like(name: Column) -> Column:
    """1 for a name that looks like a gene id (Ensembl, Entrez digits, short symbol), else 0."""
    return (name.rlike("^ENS[A-Z]*G[0-9]{11}") | name.rlike("^[0-9]{1,9}$")
            | name.rlike("^[A-Za-z][A-Za-z0-9]{1,14}$")).cast("int")


def orient(cells: DataFrame, expected: DataFrame | None = None, by: str = "dataset_id") -> DataFrame:
    """Swap row and column names of datasets whose columns look like genes or rows like samples.

    ``cells``: (dataset, row, col, count); ``expected``: (dataset, n_samples). In long form the
    transpose is a swap of two columns, decided by three aggregates per dataset.
    """
    rows, cols = cells.select(by, "row").distinct(), cells.select(by, "col").distinct()
    r = rows.groupBy(by).agg(F.count(F.lit(1)).alias("nr"), F.avg(gene_like(F.col("row"))).alias("rs"),
                             F.avg(F.col("row").startswith("GSM").cast("int")).alias("gsm"))
    c = cols.groupBy(by).agg(F.count(F.lit(1)).alias("nc"), F.avg(gene_like(F.col("col"))).alias("cs"))
    s = r.join(c, by)
    if expected is not None:
        s = s.join(expected.select(by, F.col("n_samples").alias("ne")), by, "left")
    else:
        s = s.withColumn("ne", F.lit(None).cast("bigint"))
    slack = F.greatest(F.lit(2.0), F.col("ne") * 0.2)
    near_r = F.coalesce(F.abs(F.col("nr") - F.col("ne")) <= slack, F.lit(False)) & (F.col("ne") > 0)
    near_c = F.coalesce(F.abs(F.col("nc") - F.col("ne")) <= slack, F.lit(False)) & (F.col("ne") > 0)
    near_r, near_c = F.coalesce(near_r, F.lit(False)), F.coalesce(near_c, F.lit(False))
    swap = (F.when(near_c & ~near_r, False).when(near_r & ~near_c, True)
            .otherwise(((F.col("cs") > 0.4) & (F.col("rs") < 0.2)) | (F.col("gsm") > 0.5)))
    d = s.select(by, swap.alias("transposed"))
    return cells.join(d, by).select(
        by, F.when(F.col("transposed"), F.col("col")).otherwise(F.col("row")).alias(GENE),
        F.when(F.col("transposed"), F.col("row")).otherwise(F.col("col")).alias(SAMPLE), "count", "transposed")
