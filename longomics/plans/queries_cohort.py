"""Queries over quantification files, pooled studies, cohort documents, text metadata and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import text
from ..operators import checks, cohort, pooling, quantification as qn
from ..runtime import scratch_path
from ..sources import files
from .queries_matrix import combat_ctes, recursive
from .registry import query, rnd, rounded, rq
from .views import with_views


def written(t, df, label, fmt="csv", sep="\t", parts=(), header=True):
    """Write a derived table as text files below the shared folder and return its path."""
    path = scratch_path(t.spark, label)
    writer = df.write.mode("overwrite").partitionBy(*parts) if parts else df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", header).option("sep", sep)
    writer.format(fmt).save(path)
    return path


def whole(t):
    """One matrix over all datasets."""
    return t.counts().groupBy("gene_id", "sample_id").agg(F.sum("count").alias("count"))


def str_id(df, name="sample_id"):
    return df.withColumn(name, F.col(name).cast("string"))


# ---- quantification -------------------------------------------------------------------------

QUANT_OUT = "CAST(sample_id AS VARCHAR) AS sample_id, tx_id, length, eff_length, num_reads, tpm"


@query("source_salmon", with_views("quant") + f"SELECT {QUANT_OUT} FROM quant")
def _(t):
    q = t.quant().select("sample_id", F.col("tx_id").alias("Name"), F.col("length").alias("Length"),
                         F.col("eff_length").alias("EffectiveLength"), F.col("tpm").alias("TPM"), F.col("num_reads").alias("NumReads"))
    return files.salmon(t.spark, written(t, q, "salmon", parts=["sample_id"]) + "/*/*.csv")


@query("source_kallisto", with_views("quant") + f"SELECT {QUANT_OUT} FROM quant")
def _(t):
    q = t.quant().select("sample_id", F.col("tx_id").alias("target_id"), "length", "eff_length", F.col("num_reads").alias("est_counts"), "tpm")
    return files.kallisto(t.spark, written(t, q, "kallisto", parts=["sample_id"]) + "/*/*.csv")


@query("source_rsem", with_views("counts") + "SELECT dataset_id || sample_id AS sample_id, CAST(gene_id AS VARCHAR) AS gene_id, count FROM counts")
def _(t):
    c = t.counts().select(F.concat("dataset_id", F.col("sample_id").cast("string")).alias("s"), "gene_id",
                          F.col("count").cast("double").alias("expected_count"), F.lit(1.0).alias("TPM"))
    return files.rsem(t.spark, written(t, c, "rsem", parts=["s"]) + "/*/*.csv").select("sample_id", "gene_id", "count")


@query("source_feature_counts", with_views("counts") + "SELECT dataset_id || sample_id AS sample_id, CAST(gene_id AS VARCHAR) AS gene_id, count FROM counts")
def _(t):
    c = t.counts().select(F.concat("dataset_id", F.col("sample_id").cast("string")).alias("s"), F.col("gene_id").alias("Geneid"),
                          F.lit("chr1").alias("Chr"), F.lit(1).alias("Start"), F.col("count").alias("aligned.bam"))
    return files.feature_counts(t.spark, written(t, c, "fc", parts=["s"]) + "/*/*.csv")


ENSG = "'ENSG' || lpad(CAST(gene_id AS VARCHAR), 11, '0')"


@query("source_star_counts", with_views("counts") + f"SELECT dataset_id || sample_id AS sample_id, {ENSG} AS gene_id, CAST(count AS DOUBLE) AS count FROM counts WHERE gene_id % 10 <> 0")
def _(t):
    gid = F.concat(F.when(F.col("gene_id") % 10 == 0, "N_").otherwise("ENSG"), F.lpad(F.col("gene_id").cast("string"), 11, "0"), F.lit(".5"))
    c = t.counts().select(F.concat("dataset_id", F.col("sample_id").cast("string")).alias("s"), gid.alias("gene_id"),
                          F.lit("x").alias("gene_name"), F.col("count").alias("unstranded"), F.lit(0).alias("stranded_first"))
    return files.star_counts(t.spark, written(t, c, "star", parts=["s"]) + "/*/*.csv")


@query("source_count_matrix", with_views("counts", "s AS (SELECT DISTINCT sample_id FROM counts)", "g AS (SELECT DISTINCT gene_id FROM counts)", "t AS (SELECT gene_id, sample_id, sum(count) AS count FROM counts GROUP BY 1, 2)") +
       """SELECT CAST(g.gene_id AS VARCHAR) AS gene_id, CAST(s.sample_id AS VARCHAR) AS sample_id, CAST(coalesce(t.count, 0) AS DOUBLE) AS count
FROM g CROSS JOIN s LEFT JOIN t ON t.gene_id = g.gene_id AND t.sample_id = s.sample_id""")
def _(t):
    a = whole(t)
    ids = [r[0] for r in a.select("sample_id").distinct().orderBy("sample_id").collect()]
    path = scratch_path(t.spark, "matrix")
    sinks.export_matrix(a, ids, path)
    return files.count_matrix(t.spark, path)


@query("sink_wide_matrix", with_views("counts") + "SELECT gene_id, " + ", ".join(f"CAST(coalesce(sum(count) FILTER (WHERE sample_id = {i}), 0) AS BIGINT) AS s{i}" for i in range(24)) + " FROM counts GROUP BY 1")
def _(t):
    w = sinks.wide_matrix(whole(t), list(range(24)))
    return w.select("gene_id", *[F.col(str(i)).alias(f"s{i}") for i in range(24)])


@query("sink_dataset_roundtrip", with_views("counts") + "SELECT dataset_id, gene_id, sample_id, count FROM counts")
def _(t):
    path = scratch_path(t.spark, "dataset")
    c = t.counts()
    sinks.save_dataset(c, t.samples(), c.select("dataset_id").distinct(), path)
    return sinks.load_dataset(t.spark, path)["counts"].select("dataset_id", "gene_id", "sample_id", "count")


@query("source_tx2gene_table", with_views("tx2gene") + "SELECT tx_id, gene_id FROM tx2gene")
def _(t):
    m = t.tx2gene().select(F.col("tx_id").alias("target_id"), F.col("gene_id").alias("ens_gene"))
    return files.tx2gene_table(t.spark, written(t, m, "tx2gene"))


@query("source_tx2gene_gtf", with_views("tx2gene") + "SELECT tx_id, gene_id FROM tx2gene")
def _(t):
    marked = t.tx2gene().withColumn("feature", F.explode(F.array(F.lit("transcript"), F.lit("exon"), F.lit("CDS"))))
    gff = F.length("tx_id") % 2 == 0
    attr = F.when(gff, F.concat(F.lit("transcript_id="), "tx_id", F.lit(";gene_id="), "gene_id")) \
        .otherwise(F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "tx_id", F.lit('";')))
    line = F.concat_ws("\t", F.lit("1"), F.lit("src"), "feature",
                       F.lit("1"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("."), attr)
    return files.tx2gene_gtf(t.spark, written(t, marked.select(line.alias("value")), "gtf", "text"))


@query("transcript_to_gene", with_views("quant tx2gene") + f"""SELECT sample_id, gene_id, CAST(sum(num_reads) AS BIGINT) AS count, {rq('sum(tpm)', 'tpm', 4)}, {rq('avg(eff_length)', 'mean_eff_length')}
FROM quant JOIN tx2gene ON tx2gene.tx_id = quant.tx_id GROUP BY 1, 2""")
def _(t):
    g = qn.aggregate_to_gene(t.quant(), t.tx2gene())
    return g.select("sample_id", "gene_id", "count", rnd("tpm", 4).alias("tpm"), rnd("mean_eff_length").alias("mean_eff_length"))


@query("combine_samples", with_views("quant tx2gene") + """SELECT CAST(sample_id AS VARCHAR) AS sample_id, gene_id, CAST(sum(num_reads) AS BIGINT) AS count
FROM quant JOIN tx2gene ON tx2gene.tx_id = quant.tx_id GROUP BY 1, 2""")
def _(t):
    q = t.quant().select("sample_id", F.col("tx_id").alias("Name"), F.col("length").alias("Length"),
                         F.col("eff_length").alias("EffectiveLength"), F.col("tpm").alias("TPM"), F.col("num_reads").alias("NumReads"))
    read = files.salmon(t.spark, written(t, q, "combine", parts=["sample_id"]) + "/*/*.csv")
    return qn.aggregate_to_gene(read, t.tx2gene()).select("sample_id", "gene_id", "count")


@query("count_summary", with_views("counts", "a AS (SELECT * FROM counts)") + f"""SELECT count(DISTINCT gene_id) AS n_genes, count(DISTINCT sample_id) AS n_samples, CAST(sum(count) AS DOUBLE) AS total_counts,
{rq('sum(count) / count(DISTINCT sample_id)', 'mean_per_sample')}, count(DISTINCT gene_id) FILTER (WHERE count > 0) AS detected_genes FROM a""")
def _(t):
    return rounded(qn.count_summary(t.counts()), "mean_per_sample")


def run_info(t):
    """Per-sample run-info documents derived from the order lines."""
    return (t.lineitem.groupBy((F.col("l_suppkey") % 24).cast("int").alias("sample_id"))
            .agg(F.count(F.lit(1)).alias("num_processed"), F.count_if(F.col("l_returnflag") == "A").alias("num_mapped")))


STATS_SQL = """r AS (SELECT CAST(l_suppkey % 24 AS INTEGER) AS sample_id, count(*) AS n_processed, count(*) FILTER (WHERE l_returnflag = 'A') AS n_mapped FROM lineitem GROUP BY 1)""", \
    "q AS (SELECT sample_id, sum(num_reads) AS total_counts, count(*) AS n_transcripts FROM quant GROUP BY 1)"


@query("quant_stats_salmon", with_views("quant", *STATS_SQL) + f"SELECT CAST(r.sample_id AS VARCHAR) AS sample_id, total_counts, n_transcripts, n_processed, n_mapped, {rq('100.0 * n_mapped / n_processed', 'mapping_rate')} FROM r JOIN q ON q.sample_id = r.sample_id")
def _(t):
    info = run_info(t).select("sample_id", F.lit("aux_info").alias("d"), "num_processed", "num_mapped",
                              (100.0 * F.col("num_mapped") / F.col("num_processed")).alias("percent_mapped"), F.lit("1.10").alias("salmon_version"))
    read = files.salmon_run_info(t.spark, written(t, info, "meta", "json", parts=["sample_id", "d"]) + "/*/*/*.json")
    s = qn.quant_stats(str_id(t.quant()), read)
    return rounded(s.select("sample_id", "total_counts", "n_transcripts", "n_processed", "n_mapped", "mapping_rate"), "mapping_rate")


@query("quant_report_aggregates", with_views("quant", *STATS_SQL) + f"""SELECT count(*) AS n_samples, {rq('avg(100.0 * n_mapped / n_processed)', 'mean_mapping_rate')}, CAST(sum(n_processed) AS BIGINT) AS total_reads,
{rq('stddev_samp(total_counts) / avg(total_counts) * 100', 'library_cv_pct')} FROM r JOIN q ON q.sample_id = r.sample_id""")
def _(t):
    info = run_info(t).select("sample_id", F.col("num_processed").alias("n_processed"), F.col("num_mapped").alias("n_pseudoaligned"),
                              (100.0 * F.col("num_mapped") / F.col("num_processed")).alias("p_pseudoaligned"), F.lit("0.50").alias("kallisto_version"))
    read = files.kallisto_run_info(t.spark, written(t, info, "runinfo", "json", parts=["sample_id"]) + "/*/*.json")
    return rounded(qn.report_aggregates(qn.quant_stats(str_id(t.quant()), read)), "mean_mapping_rate", "library_cv_pct")


def log_lines(t, *parts):
    """One log text per sample from its processed and mapped numbers."""
    numbers = {N: F.col("num_processed").cast("string"), M: F.col("num_mapped").cast("string"),
               PCT: F.round(100.0 * F.col("num_mapped") / F.col("num_processed"), 2).cast("string")}
    return run_info(t).select("sample_id", F.concat(*[numbers.get(p, F.lit(p)) for p in parts]).alias("value"))


N, M, PCT = "<processed>", "<mapped>", "<percent>"
PCT_SQL = "round(100.0 * n_mapped / n_processed, 2)"


def log_query(name, tool, parts, sql):
    @query(name, with_views("quant", *STATS_SQL) + f"SELECT CAST(sample_id AS VARCHAR) AS sample_id, {sql} FROM r")
    def _(t):
        return files.log_metrics(files.logs(t.spark, written(t, log_lines(t, *parts), tool, "text", parts=["sample_id"]) + "/*/*.txt"), tool)


log_query("log_star", "star", ["                          Number of input reads |\t", N, "\n   Uniquely mapped reads number |\t", M, "\n  Uniquely mapped reads % |\t", PCT, "%\n"],
          f"n_processed AS n_input_reads, n_mapped AS n_uniquely_mapped, {rq(PCT_SQL, 'uniquely_mapped_percent')}")
log_query("log_hisat2", "hisat2", [N, " reads; of these:\n    ", M, " (", PCT, "%) aligned concordantly exactly 1 time\n", PCT, "% overall alignment rate\n"],
          f"n_processed AS total_reads, n_mapped AS unique_alignments, {rq(PCT_SQL, 'unique_rate')}, {rq(PCT_SQL, 'overall_alignment_rate')}")
log_query("log_salmon", "salmon", ["[info] start\n[info] Mapping rate = ", PCT, "%\n"], rq(PCT_SQL, "mapping_rate"))
log_query("log_rsem", "rsem", [N, "\n", M, "\n0\n0\n"], f"n_processed AS n_total, n_mapped AS n_aligned, 100.0 * n_mapped / n_processed AS alignment_rate")
log_query("log_feature_counts", "feature_counts", ["Status\ts.bam\nAssigned\t", M, "\nUnassigned_NoFeatures\t", N, "\n"],
          "n_mapped AS assigned, n_mapped + n_processed AS total, n_mapped / (n_mapped + n_processed) * 100 AS assigned_percent")


# ---- multi-omic files ---------------------------------------------------------------------------

def omic_file(t, label, columns, rows=None):
    c = (rows if rows is not None else t.counts()).select(F.concat("dataset_id", F.col("sample_id").cast("string")).alias("s"), *columns)
    return written(t, c, label, parts=["s"]) + "/*/*.csv"


FEATURE = "dataset_id || sample_id AS sample_id"


@query("source_mirna", with_views("counts") + f"SELECT {FEATURE}, 'mir-' || gene_id AS feature, count / 2.0 AS value FROM counts")
def _(t):
    return files.mirna(t.spark, omic_file(t, "mirna", [F.concat(F.lit("mir-"), F.col("gene_id").cast("string")).alias("miRNA_ID"), F.col("count").alias("read_count"),
                                                       (F.col("count") / 2.0).alias("reads_per_million_miRNA_mapped")]))


@query("source_copy_number", with_views("counts") + f"SELECT {FEATURE}, {ENSG} AS feature, CAST(count AS DOUBLE) AS value FROM counts")
def _(t):
    return files.copy_number_genes(t.spark, omic_file(t, "cn", [F.concat(F.lit("ENSG"), F.lpad(F.col("gene_id").cast("string"), 11, "0"), F.lit(".2")).alias("gene_id"),
                                                                F.lit("chr1").alias("chromosome"), F.col("count").alias("copy_number"), F.lit(1).alias("max")]))


@query("source_methylation", with_views("counts") + f"SELECT {FEATURE}, 'cg' || gene_id AS feature, CASE WHEN count % 7 = 0 THEN NULL ELSE round(count / 1000.0, 3) END AS value FROM counts")
def _(t):
    beta = F.when(F.col("count") % 7 == 0, "NA").otherwise(F.round(F.col("count") / 1000.0, 3).cast("string"))
    return files.methylation(t.spark, omic_file(t, "meth", [F.concat(F.lit("cg"), F.col("gene_id").cast("string")).alias("Composite Element REF"), beta.alias("Beta_value")]))


@query("source_segments", with_views("counts") + f"SELECT {FEATURE}, 'chr' || (gene_id % 22) AS chrom, CAST(gene_id * 100 AS VARCHAR) AS \"start\", CAST(count AS VARCHAR) AS segment_mean FROM counts")
def _(t):
    return files.segments(t.spark, omic_file(t, "seg", [F.concat(F.lit("chr"), (F.col("gene_id") % 22).cast("string")).alias("chrom"),
                                                        (F.col("gene_id") * 100).alias("start"), F.col("count").alias("segment_mean")]))


@query("source_mutations", "SELECT 'G' || (l_partkey % 500) AS gene, 'P' || l_suppkey AS case_id, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    m = t.lineitem.select(F.concat(F.lit("G"), (F.col("l_partkey") % 500).cast("string")).alias("Hugo_Symbol"), F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("case"))
    read = files.mutations(t.spark, written(t, m, "maf"))
    return read.groupBy(F.col("Hugo_Symbol").alias("gene"), F.col("case").alias("case_id")).agg(F.count(F.lit(1)).alias("n"))


@query("source_proteins", with_views("counts") + f"SELECT {FEATURE}, 'p' || gene_id AS feature, CAST(count AS DOUBLE) AS value FROM counts")
def _(t):
    return files.proteins(t.spark, omic_file(t, "rppa", [F.lit("AGID1").alias("AGID"), F.concat(F.lit("p"), F.col("gene_id").cast("string")).alias("peptide_target"),
                                                         F.col("count").alias("abundance"), F.lit("note").alias("remark")]))


@query("source_gsm_tables", with_views("counts") + "SELECT CAST(gene_id AS VARCHAR) AS gene_id, CAST(sum(count) AS DOUBLE) AS count FROM counts GROUP BY 1")
def _(t):
    c = t.counts().select(F.col("gene_id").alias("ID_REF"), F.col("count").alias("VALUE"))
    return files.gsm_tables(t.spark, written(t, c, "gsm")).groupBy("gene_id").agg(F.sum("count").alias("count"))


@query("source_supplementary", with_views("counts") + """SELECT CAST(g.gene_id AS VARCHAR) AS gene_id, 's' || s.sample_id AS sample_id, CAST(coalesce(sum(c.count), 0) AS DOUBLE) AS count
FROM (SELECT DISTINCT gene_id FROM counts) g CROSS JOIN (SELECT DISTINCT sample_id FROM counts) s LEFT JOIN counts c ON c.gene_id = g.gene_id AND c.sample_id = s.sample_id GROUP BY 1, 2""")
def _(t):
    ids = sorted(r["sample_id"] for r in t.samples().select("sample_id").distinct().collect())
    w = sinks.wide_matrix(whole(t), ids)
    w = w.select("gene_id", F.lit("text").alias("description"), *[F.when(F.col(str(i)) > 0, F.col(str(i))).alias(f"s{i}") for i in ids])
    return files.supplementary_matrix(t.spark, written(t, w, "raw_counts.tsv"))


@query("source_sdrf", with_views("counts samples") + "SELECT dataset_id || c.sample_id AS sample_id, count(*) AS n, CAST(sum(count) AS BIGINT) AS total, CASE WHEN sample_id % 2 = 0 THEN 'control' ELSE 'treated' END AS disease FROM counts c GROUP BY 1, 4")
def _(t):
    name = F.concat("dataset_id", F.col("sample_id").cast("string"))
    sdrf = t.samples().select(name.alias("Source Name"), F.col("condition").alias("Characteristics[disease]"))
    cells = t.counts().select(name.alias("sample_id"), "gene_id", "count")
    return files.with_sdrf(cells, t.spark, written(t, sdrf, "sdrf")).groupBy("sample_id", "disease").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


@query("source_run_table", "SELECT 'SRR' || o_orderkey AS run_accession, CAST(o_custkey AS VARCHAR) AS sample_alias FROM orders")
def _(t):
    r = t.orders.select(F.concat(F.lit("SRR"), F.col("o_orderkey").cast("string")).alias("run_accession"), F.col("o_custkey").cast("string").alias("sample_alias"))
    return files.run_table(t.spark, written(t, r, "runs", "json")).select("run_accession", "sample_alias")


@query("source_sample_sheet", "SELECT 'S' || o_orderkey AS sample_id, o_orderstatus AS condition, '' AS batch, 'f' || o_orderkey || '.fq' AS fastq_r1, '' AS fastq_r2 FROM orders")
def _(t):
    k = F.col("o_orderkey").cast("string")
    s = t.orders.select(F.concat(F.lit("S"), k).alias("sample_id"), F.col("o_orderstatus").alias("condition"), F.concat(F.lit("f"), k, F.lit(".fq")).alias("fastq"))
    return files.sample_sheet(t.spark, written(t, s, "sheet", sep=","))


@query("source_de_result", with_views("de") + f"SELECT gene_id, {rq('log2fc', 'log2_fold_change')}, padj < 0.3 AND abs(log2fc) > 0.2 AS is_significant FROM (SELECT CAST(gene_id AS VARCHAR) AS gene_id, log2fc, padj FROM de)")
def _(t):
    from ..operators import de
    d = t.de().select(
        "gene_id", F.col("log2fc").alias("logFC"), F.lit(1.0).alias("logCPM"), F.lit(1.0).alias("LR"), F.col("p_value").alias("PValue"), F.col("padj").alias("FDR"))
    raw = files.de_result(t.spark, written(t, d, "edger_results", sep=","))
    return rounded(de.significance(de.standardise(raw), 0.3, 0.2).select("gene_id", "log2_fold_change", "is_significant"), "log2_fold_change")


@query("sink_de_json", with_views("de") + "SELECT contrast_id, method, gene_id, p_value FROM de")
def _(t):
    path = scratch_path(t.spark, "dejson")
    d = t.de().select("contrast_id", "method", "gene_id", "p_value")
    sinks.save_de_json(d, path)
    return sinks.load_de_json(t.spark, path, d.schema.simpleString()[7:-1].replace(":", " "))


# ---- pooling --------------------------------------------------------------------------------------

def studies(t):
    return t.counts().withColumnRenamed("dataset_id", "study")


MAP = "mp AS (SELECT p_partkey AS from_id, p_brand || '-' || (p_partkey % 50) AS to_id FROM part)"


def mapping(t):
    return t.part.select(F.col("p_partkey").alias("from_id"), F.concat_ws("-", "p_brand", F.pmod("p_partkey", F.lit(50)).cast("string")).alias("to_id"))


for _agg, _expr in {"mean": "avg(count)", "sum": "sum(count)", "max": "max(count)", "first": "arg_min(count, gene_id)"}.items():
    @query(f"convert_ids_{_agg}", with_views("counts", MAP) + f"SELECT dataset_id AS study, sample_id, to_id AS gene_id, {rq(_expr, 'count')} FROM counts JOIN mp ON from_id = gene_id GROUP BY 1, 2, 3")
    def _(t, agg=_agg):
        return pooling.convert_ids(studies(t), mapping(t), agg).select("study", "sample_id", "gene_id", rnd("count").alias("count"))


PREFIX = "study || '__' || sample_id"
STUDY_CTE = "st AS (SELECT dataset_id AS study, gene_id, sample_id, count FROM counts)"
COMMON_CTE = "cg AS (SELECT gene_id FROM st GROUP BY 1 HAVING count(DISTINCT study) = (SELECT count(DISTINCT study) FROM st))"


@query("sample_conflicts", with_views("counts", STUDY_CTE) + f"SELECT study, gene_id, {PREFIX} AS sample_id, count FROM st")
def _(t):
    return pooling.resolve_sample_conflicts(studies(t)).select("study", "gene_id", "sample_id", "count")


@query("gene_overlap", with_views("counts", STUDY_CTE, COMMON_CTE) + "SELECT count(DISTINCT study) AS n_studies, (SELECT count(*) FROM cg) AS n_common, count(DISTINCT gene_id) AS n_total FROM st")
def _(t):
    return pooling.gene_overlap(studies(t))


for _how in ("inner", "outer"):
    @query(f"pool_{_how}", with_views("counts", STUDY_CTE, COMMON_CTE, f"g AS (SELECT DISTINCT gene_id FROM {'cg' if _how == 'inner' else 'st'})", "s AS (SELECT DISTINCT study, sample_id FROM st)") +
           f"""SELECT s.study, g.gene_id, {PREFIX.replace('study', 's.study').replace('sample_id', 's.sample_id')} AS sample_id, coalesce(c.count, 0) AS count FROM g CROSS JOIN s
LEFT JOIN st c ON c.study = s.study AND c.gene_id = g.gene_id AND c.sample_id = s.sample_id""")
    def _(t, how=_how):
        c = pooling.resolve_sample_conflicts(studies(t))
        return pooling.merge_studies(c, how, 10).select("study", "gene_id", "sample_id", "count")


@query("pool_median_centre", with_views("counts", STUDY_CTE, COMMON_CTE, "s AS (SELECT DISTINCT study, sample_id FROM st)",
       "l AS (SELECT s.study, cg.gene_id, s.sample_id, log2(coalesce(c.count, 0) + 1.0) AS v FROM cg CROSS JOIN s LEFT JOIN st c ON c.study = s.study AND c.gene_id = cg.gene_id AND c.sample_id = s.sample_id)",
       "a AS (SELECT gene_id, quantile_cont(v, 0.5) AS m FROM l GROUP BY 1)", "o AS (SELECT gene_id, study, quantile_cont(v, 0.5) AS m FROM l GROUP BY 1, 2)") +
       f"SELECT l.study, l.gene_id, l.study || '__' || l.sample_id AS sample_id, {rq('greatest(pow(2.0, v + a.m - o.m) - 1.0, 0.0)', 'value', 5)} FROM l JOIN a ON a.gene_id = l.gene_id JOIN o ON o.gene_id = l.gene_id AND o.study = l.study")
def _(t):
    p = pooling.pool(studies(t), "inner", "median_centre", 10)
    return p.select("study", "gene_id", "sample_id", rnd("value", 5).alias("value"))


@query("pool_combat", recursive(with_views("counts", STUDY_CTE, COMMON_CTE, "s AS (SELECT DISTINCT study, sample_id FROM st)",
       "pl AS (SELECT 'pooled' AS dataset_id, s.study, cg.gene_id, s.study || '__' || s.sample_id AS sample_id, coalesce(c.count, 0) AS count FROM cg CROSS JOIN s LEFT JOIN st c ON c.study = s.study AND c.gene_id = cg.gene_id AND c.sample_id = s.sample_id)",
       *combat_ctes("pl"))) + f"SELECT study, gene_id, sample_id, {rq('value', 'value', 5)} FROM cbv")
def _(t):
    p = pooling.pool(studies(t), "inner", "combat", 10)
    return p.select("study", "gene_id", "sample_id", rnd("value", 5).alias("value"))


@query("pool_harmonised", with_views("counts", MAP, "st AS (SELECT dataset_id AS study, to_id AS gene_id, sample_id, CAST(sum(count) AS BIGINT) AS count FROM counts JOIN mp ON from_id = gene_id GROUP BY 1, 2, 3)", COMMON_CTE, "s AS (SELECT DISTINCT study, sample_id FROM st)") +
       f"SELECT s.study, cg.gene_id, s.study || '__' || s.sample_id AS sample_id, {rq('coalesce(c.count, 0)', 'value')} FROM cg CROSS JOIN s LEFT JOIN st c ON c.study = s.study AND c.gene_id = cg.gene_id AND c.sample_id = s.sample_id")
def _(t):
    p = pooling.pool(studies(t), "inner", "none", 10, mapping(t), "sum")
    return p.select("study", "gene_id", "sample_id", rnd("value").alias("value"))


@query("samples_per_study", with_views("counts") + "SELECT dataset_id AS study, count(DISTINCT sample_id) AS n_samples FROM counts GROUP BY 1")
def _(t):
    return pooling.samples_per_study(studies(t))


@query("leave_one_study_out", with_views("counts") + "SELECT CASE WHEN dataset_id = 'R' THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM counts GROUP BY 1")
def _(t):
    train, test = pooling.leave_one_out(studies(t), "R")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("merge_metadata", "SELECT 'S' || s_suppkey AS sample_id, CASE WHEN s_suppkey % 2 = 0 THEN 'E1' ELSE 'E2' END AS study, CASE WHEN s_suppkey % 2 = 0 THEN 'GEO' ELSE 'SRA' END AS repository, 'Homo sapiens' AS organism, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS tissue, CASE WHEN s_suppkey % 2 = 1 THEN s_nationkey END AS region FROM supplier")
def _(t):
    sid = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample_id")
    even, odd = t.supplier.where("s_suppkey % 2 = 0"), t.supplier.where("s_suppkey % 2 = 1")
    return pooling.merge_metadata({"E1": even.select(sid, F.col("s_nationkey").alias("tissue")), "E2": odd.select(sid, F.col("s_nationkey").alias("region"))},
                                  {"E1": ("GEO", "Homo sapiens"), "E2": ("SRA", "Homo sapiens")})


@query("gene_id_type", """SELECT dataset_id, CASE WHEN avg(CAST(starts_with(g, 'ENS') AS INT)) > 0.5 THEN 'ensembl' WHEN avg(CAST(regexp_matches(g, '^[0-9]+$') AS INT)) > 0.5 THEN 'entrez'
WHEN avg(CAST(regexp_matches(g, '^[A-Za-z]') AND length(g) < 20 AS INT)) > 0.5 THEN 'symbol' ELSE 'unknown' END AS gene_id_type FROM
(SELECT p_brand AS dataset_id, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'ENSG' || p_partkey WHEN p_brand = 'Brand#3' THEN CAST(p_partkey AS VARCHAR) WHEN p_brand = 'Brand#4' THEN 'GENE' || p_partkey ELSE '_x' END AS g FROM part) GROUP BY 1""")
def _(t):
    b, k = F.col("p_brand"), F.col("p_partkey").cast("string")
    g = F.when(b.isin("Brand#1", "Brand#2"), F.concat(F.lit("ENSG"), k)).when(b == "Brand#3", k).when(b == "Brand#4", F.concat(F.lit("GENE"), k)).otherwise("_x")
    return pooling.id_type(t.part.select(b.alias("dataset_id"), g.alias("gene_id")), ["dataset_id"])


@query("orient_matrix", with_views("counts") + "SELECT dataset_id, 'ENSG' || lpad(CAST(gene_id AS VARCHAR), 11, '0') AS gene_id, 'GSM.' || sample_id AS sample_id, count, dataset_id = 'A' AS transposed FROM counts")
def _(t):
    g, s = F.concat(F.lit("ENSG"), F.lpad(F.col("gene_id").cast("string"), 11, "0")), F.concat(F.lit("GSM."), F.col("sample_id").cast("string"))
    turned = F.col("dataset_id") == "A"
    return pooling.orient(t.counts().select("dataset_id", F.when(turned, s).otherwise(g).alias("row"), F.when(turned, g).otherwise(s).alias("col"), "count"))


# ---- cohort documents -------------------------------------------------------------------------------

TYPE_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Primary Tumor' WHEN '2-HIGH' THEN 'Solid Tissue Normal' WHEN '3-MEDIUM' THEN 'Metastatic' WHEN '4-NOT SPECIFIED' THEN 'Blood Derived Normal' ELSE 'Cell Lines' END"
CASES_SQL = """cs AS (SELECT c_custkey AS k, 'C' || c_custkey AS case_id, c_mktsegment AS project_id, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
  CASE WHEN c_custkey % 3 = 0 THEN 'Dead' ELSE 'Alive' END AS vital, CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 4000 END AS dtd, 10000 + c_custkey % 15000 AS age,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3000 END AS fu, CASE WHEN c_nationkey % 5 = 4 THEN 'not reported' ELSE 'stage ' || (c_nationkey % 5) END AS stage FROM customer)"""
SAMPLES_SQL = f"sm AS (SELECT 'C' || o_custkey AS case_id, 'S' || o_orderkey AS sample_id, {TYPE_SQL} AS sample_type FROM orders)"
CAT_SQL = "CASE WHEN sample_type IN ('Primary Tumor', 'Metastatic') THEN 'Tumor' WHEN sample_type LIKE '%Normal' THEN 'Normal' ELSE 'Other' END"


def sample_rows(t):
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "Primary Tumor").when(p == "2-HIGH", "Solid Tissue Normal").when(p == "3-MEDIUM", "Metastatic").when(p == "4-NOT SPECIFIED", "Blood Derived Normal").otherwise("Cell Lines")
    return t.orders.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("case_id"), F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("sample_id"), kind.alias("sample_type"))


def cases(t):
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    docs = t.customer.select(
        F.concat(F.lit("C"), k.cast("string")).alias("submitter_id"), F.col("c_mktsegment").alias("project_id"),
        F.struct(F.when(k % 2 == 0, "male").otherwise("female").alias("gender"), F.when(k % 3 == 0, "Dead").otherwise("Alive").alias("vital_status"),
                 F.lit("x").alias("race"), F.when(k % 6 == 0, k % 4000).alias("days_to_death")).alias("demographic"),
        F.array(F.struct((10000 + k % 15000).alias("age_at_diagnosis"), F.when(k % 5 != 0, k % 3000).alias("days_to_last_follow_up"),
                         F.when(nation % 5 == 4, "not reported").otherwise(F.concat(F.lit("stage "), (nation % 5).cast("string"))).alias("tumor_stage"),
                         F.lit("d").alias("primary_diagnosis"))).alias("diagnoses"))
    s = sample_rows(t).groupBy(F.col("case_id").alias("submitter_id")).agg(F.collect_list(F.struct(F.col("sample_id").alias("submitter_id"), "sample_type")).alias("samples"))
    return docs.join(s, "submitter_id", "left")


@query("source_case_documents", "WITH " + CASES_SQL + ", " + SAMPLES_SQL + " " + "SELECT sm.case_id, sample_id, sample_type, gender, vital AS vital_status, stage AS tumor_stage, age AS age_at_diagnosis_days, dtd AS days_to_death FROM sm JOIN cs ON cs.case_id = sm.case_id")
def _(t):
    read = files.case_documents(t.spark, written(t, cases(t), "cases", "json"))
    return cohort.flat_samples(read).drop("primary_diagnosis")


@query("survival_table", "WITH " + CASES_SQL + f""" SELECT case_id, CAST(CASE WHEN vital = 'Dead' AND dtd IS NOT NULL THEN dtd ELSE fu END AS DOUBLE) AS os_time,
CASE WHEN vital = 'Dead' AND dtd IS NOT NULL THEN 1 WHEN fu IS NOT NULL THEN 0 END AS os_event, {rq('age / 365.25', 'age_at_diagnosis_years', 1)} FROM cs""")
def _(t):
    return cohort.survival(cases(t)).select("case_id", "os_time", "os_event", rnd("age_at_diagnosis_years", 1).alias("age_at_diagnosis_years"))


@query("sample_type_counts", "WITH " + CASES_SQL + ", " + SAMPLES_SQL + f" SELECT project_id, sample_type, count(*) AS n, {CAT_SQL} AS category FROM sm JOIN cs ON cs.case_id = sm.case_id GROUP BY 1, 2")
def _(t):
    s = sample_rows(t).join(cases(t).select(F.col("submitter_id").alias("case_id"), "project_id"), "case_id")
    return cohort.type_counts(s, ["project_id"])


@query("sample_type_column", "SELECT 'o' AS dataset_id, 'o_orderstatus' AS type_column, count(DISTINCT o_orderstatus) AS n_types FROM orders")
def _(t):
    s = t.orders.select(F.lit("o").alias("dataset_id"), F.col("o_orderkey").alias("sample_id"), "o_orderpriority", "o_orderstatus", F.col("o_custkey").alias("who"))
    return cohort.pick_type_column(s, ["sample_type"])


@query("clinical_summary", "WITH " + CASES_SQL + """ SELECT project_id, 'gender' AS field, gender AS value, count(*) AS n FROM cs GROUP BY ALL UNION ALL
SELECT project_id, 'vital_status', vital, count(*) FROM cs GROUP BY ALL UNION ALL SELECT project_id, 'tumor_stage', stage, count(*) FROM cs WHERE stage <> 'not reported' GROUP BY ALL""")
def _(t):
    return cohort.clinical_summary(cases(t), ["project_id"])


@query("age_summary", "WITH " + CASES_SQL + f" SELECT project_id, {rq('avg(age / 365.25)', 'age_mean', 1)}, {rq('quantile_cont(age / 365.25, 0.5)', 'age_median', 1)}, {rq('min(age / 365.25)', 'age_min', 1)}, {rq('max(age / 365.25)', 'age_max', 1)} FROM cs GROUP BY 1")
def _(t):
    return rounded(cohort.age_summary(cases(t), ["project_id"]), "age_mean", "age_median", "age_min", "age_max", digits=1)


FILES_SQL = "fl AS (SELECT 'C' || l_suppkey AS case_id, CASE l_linenumber % 4 WHEN 0 THEN 'RNA-Seq' WHEN 1 THEN 'WXS' WHEN 2 THEN '' ELSE 'ATAC' END AS strategy, CASE l_linenumber % 4 WHEN 2 THEN 'Clinical' ELSE 'DNA Methylation' END AS data_category FROM lineitem)"


def file_rows(t):
    n = F.col("l_linenumber") % 4
    return t.lineitem.select(F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("case_id"),
                             F.when(n == 0, "RNA-Seq").when(n == 1, "WXS").when(n == 2, "").otherwise("ATAC").alias("strategy"),
                             F.when(n == 2, "Clinical").otherwise("DNA Methylation").alias("data_category"))


@query("project_comparison", "WITH " + CASES_SQL + ", " + SAMPLES_SQL + ", " + FILES_SQL + f""", fp AS (SELECT project_id, bool_or(strategy = 'RNA-Seq') AS rna, bool_or(data_category = 'DNA Methylation') AS met FROM fl JOIN cs ON cs.case_id = fl.case_id GROUP BY 1),
sp AS (SELECT project_id, count(*) FILTER (WHERE {CAT_SQL} = 'Tumor') AS tu, count(*) FILTER (WHERE {CAT_SQL} = 'Normal') AS no FROM sm JOIN cs ON cs.case_id = sm.case_id GROUP BY 1)
SELECT cs.project_id, count(*) AS cases, max(tu) AS tumor_samples, max(no) AS normal_samples, bool_or(rna) AS has_rnaseq, bool_or(met) AS has_methylation, false AS has_cnv, false AS has_mutations,
{rq('quantile_cont(age / 365.25, 0.5)', 'median_age', 1)}, {rq("100.0 * count(*) FILTER (WHERE gender = 'male') / count(*)", 'pct_male', 1)} FROM cs LEFT JOIN fp ON fp.project_id = cs.project_id LEFT JOIN sp ON sp.project_id = cs.project_id GROUP BY 1""")
def _(t):
    c = cases(t)
    f = file_rows(t).join(c.select(F.col("submitter_id").alias("case_id"), "project_id"), "case_id").withColumnRenamed("strategy", "experimental_strategy")
    return rounded(cohort.compare_projects(c, f), "median_age", "pct_male", digits=1)


@query("data_availability", "WITH " + SAMPLES_SQL + ", " + FILES_SQL + f""", a AS (SELECT case_id, CASE WHEN strategy = '' THEN data_category ELSE strategy END AS s FROM fl),
n AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE {CAT_SQL} = 'Tumor') AS tu, count(*) FILTER (WHERE {CAT_SQL} = 'Normal') AS no FROM sm GROUP BY 1)
SELECT a.case_id, {', '.join(f"CASE WHEN bool_or(s = '{x}') THEN 'Yes' ELSE '' END AS " + '"' + x + '"' for x in ('ATAC', 'Clinical', 'RNA-Seq', 'WXS'))},
coalesce(max(n), 0) AS n_samples, coalesce(max(tu), 0) AS tumor_samples, coalesce(max(no), 0) AS normal_samples FROM a LEFT JOIN n ON n.case_id = a.case_id GROUP BY 1""")
def _(t):
    f = file_rows(t)
    return cohort.availability(f, sample_rows(t), cohort.strategy_list(f))


MUT_SQL = "mu AS (SELECT 'G' || (l_partkey % 500) AS gene, 'P' || l_suppkey AS case_id, l_returnflag AS project FROM lineitem)"


@query("mutation_frequency", "WITH " + MUT_SQL + f""" SELECT project, gene, n_cases, n_total, {rq('n_cases / n_total', 'frequency')}, rank FROM (SELECT g.project, gene, n_cases, n_total, row_number() OVER (PARTITION BY g.project ORDER BY n_cases DESC, gene) AS rank
FROM (SELECT project, gene, count(DISTINCT case_id) AS n_cases FROM mu GROUP BY 1, 2) g JOIN (SELECT project, count(DISTINCT case_id) AS n_total FROM mu GROUP BY 1) t ON t.project = g.project) WHERE rank <= 20""")
def _(t):
    m = t.lineitem.select(F.concat(F.lit("G"), (F.col("l_partkey") % 500).cast("string")).alias("gene"), F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("case_id"), F.col("l_returnflag").alias("project"))
    return rounded(cohort.mutation_frequency(m, 20, ["project"]), "frequency")


@query("tumor_normal_pairs", "WITH " + SAMPLES_SQL + f" SELECT a.case_id, a.sample_id AS tumor_sample, a.sample_type AS tumor_type, b.sample_id AS normal_sample, b.sample_type AS normal_type FROM (SELECT * FROM sm WHERE {CAT_SQL} = 'Tumor') a JOIN (SELECT * FROM sm WHERE {CAT_SQL} = 'Normal') b ON a.case_id = b.case_id")
def _(t):
    return cohort.tumor_normal_pairs(sample_rows(t))


@query("enrich_samples", "WITH " + CASES_SQL + ", " + SAMPLES_SQL + " SELECT sm.case_id, sample_id, sample_type, gender, vital AS vital_status FROM sm LEFT JOIN cs ON cs.case_id = sm.case_id")
def _(t):
    c = cohort.survival(cases(t)).select("case_id", "gender", "vital_status")
    return cohort.enrich_samples(sample_rows(t), c)


# ---- text -------------------------------------------------------------------------------------------

BAR_SQL = "bc AS (SELECT 'TCGA-' || lpad(CAST(o_custkey % 97 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_custkey % 9999 AS VARCHAR), 4, '0') || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '-' || lpad(CAST(o_orderkey % 62 AS VARCHAR), 2, '0') || 'A-11R-0001-07' END AS b, o_orderkey FROM orders)"


def barcodes(t):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    tail = F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("-"), pad(k % 62, 2), F.lit("A-11R-0001-07")))
    return t.orders.select("o_orderkey", F.concat(F.lit("TCGA-"), pad(u % 97, 2), F.lit("-"), pad(u % 9999, 4), tail).alias("b"))


TYPES_SQL = "CASE split_part(b, '-', 4)[1:2] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SAMPLE_TYPES.items()) + " ELSE CASE WHEN split_part(b, '-', 4) = '' THEN 'Unknown' ELSE 'Unknown (' || split_part(b, '-', 4)[1:2] || ')' END END"


@query("parse_barcodes", "WITH " + BAR_SQL + f""" SELECT o_orderkey, split_part(b, '-', 1) AS project, split_part(b, '-', 2) AS tss, split_part(b, '-', 3) AS participant,
split_part(b, '-', 1) || '-' || split_part(b, '-', 2) || '-' || split_part(b, '-', 3) AS patient_barcode, split_part(b, '-', 4)[1:2] AS sample_type_code, {TYPES_SQL} AS sample_type,
split_part(b, '-', 4)[3:] AS vial, split_part(b, '-', 5)[1:2] AS portion, split_part(b, '-', 5)[3:] AS analyte, split_part(b, '-', 6) AS plate, split_part(b, '-', 7) AS center,
CASE WHEN split_part(b, '-', 4) = '' THEN b ELSE b[1:16] END AS sample_barcode FROM bc""")
def _(t):
    return barcodes(t).select("o_orderkey", *[c.alias(n) for n, c in text.barcode_fields(F.col("b")).items()])


@query("barcode_predicates", "WITH " + BAR_SQL + " SELECT o_orderkey, coalesce(TRY_CAST(split_part(b, '-', 4)[1:2] AS INT) BETWEEN 1 AND 9, false) AS is_tumor, coalesce(TRY_CAST(split_part(b, '-', 4)[1:2] AS INT) BETWEEN 10 AND 14, false) AS is_normal FROM bc")
def _(t):
    return barcodes(t).select("o_orderkey", text.is_tumor(F.col("b")).alias("is_tumor"), text.is_normal(F.col("b")).alias("is_normal"))


@query("sample_category", "WITH " + SAMPLES_SQL + f" SELECT sample_id, {CAT_SQL} AS category FROM sm")
def _(t):
    return sample_rows(t).select("sample_id", text.sample_category(F.col("sample_type")).alias("category"))


def chain(words, labels=None):
    return "CASE " + " ".join(f"WHEN contains(lower(p), '{w}') THEN '{(labels or (lambda x: x))(w)}'" for w in words) + " ELSE 'unknown' END"


PROC_SQL = "pr AS (SELECT p_partkey, 'Aligned with ' || CASE p_partkey % 5 WHEN 0 THEN 'STAR' WHEN 1 THEN 'HISAT2' WHEN 2 THEN 'Bowtie' WHEN 3 THEN 'BWA' ELSE p_name END || ' to ' || CASE p_partkey % 4 WHEN 0 THEN 'GRCh38' WHEN 1 THEN 'hg19' WHEN 2 THEN 'mm10' ELSE p_type END || '; counts by ' || CASE p_partkey % 3 WHEN 0 THEN 'featureCounts' WHEN 1 THEN 'HTSeq' ELSE 'RSEM' END AS p, CASE p_partkey % 3 WHEN 0 THEN 'polyA RNA' WHEN 1 THEN 'total RNA' ELSE p_name END AS mol FROM part)"


@query("processing_keywords", "WITH " + PROC_SQL + f""" SELECT p_partkey, {chain(text.ASSEMBLIES)} AS assembly, {chain(text.ALIGNERS, lambda w: w.upper() if w in ('star', 'bwa') else w.capitalize())} AS aligner,
{chain(text.QUANTIFIERS, str.capitalize)} AS quantification, CASE WHEN contains(lower(mol), 'polya') THEN 'polyA' WHEN contains(lower(mol), 'total') THEN 'total RNA' ELSE mol END AS rna_type FROM pr""")
def _(t):
    k = F.col("p_partkey")
    pick = lambda n, *xs: F.coalesce(*[F.when(k % n == i, x) for i, x in enumerate(xs)])
    body = F.concat(F.lit("Aligned with "), pick(5, *map(F.lit, ["STAR", "HISAT2", "Bowtie", "BWA"]), F.col("p_name")), F.lit(" to "),
                    pick(4, *map(F.lit, ["GRCh38", "hg19", "mm10"]), F.col("p_type")), F.lit("; counts by "), pick(3, *map(F.lit, ["featureCounts", "HTSeq", "RSEM"])))
    mol = pick(3, F.lit("polyA RNA"), F.lit("total RNA"), F.col("p_name"))
    return t.part.select("p_partkey", body.alias("p"), mol.alias("mol")).select("p_partkey", *[c.alias(n) for n, c in text.processing_fields(F.col("p"), F.col("mol")).items()])


@query("characteristics", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation_key, lower(c_mktsegment) AS market FROM customer")
def _(t):
    items = F.array(F.concat(F.lit("Nation Key: "), F.col("c_nationkey").cast("string")), F.lit("no separator"), F.concat(F.lit("market:"), F.lower("c_mktsegment")))
    m = text.characteristics(items)
    return t.customer.select("c_custkey", m["nation_key"].alias("nation_key"), m["market"].alias("market"))


@query("clean_titles", "SELECT p_partkey, p_name AS title FROM part")
def _(t):
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, F.concat("p_name", F.lit("_rep"), k.cast("string"))).when(k % 3 == 1, F.concat("p_name", F.lit(", replicate 2"))).otherwise(F.concat("p_name", F.lit(" 7")))
    return t.part.select("p_partkey", text.clean_title(title).alias("title"))


@query("accession_ids", "SELECT DISTINCT 'GSM' || u AS gsm_id FROM (SELECT o_custkey AS u FROM orders UNION ALL SELECT o_orderkey FROM orders)")
def _(t):
    blob = F.concat(F.lit("a GSM"), F.col("o_custkey").cast("string"), F.lit(";GSM"), F.col("o_orderkey").cast("string"), F.lit("x"))
    return t.orders.select(F.explode(text.accession_ids(blob)).alias("gsm_id")).distinct()


FQ_SQL = "fq AS (SELECT o_orderkey, '/data/run/S' || o_custkey || CASE o_orderkey % 6 WHEN 0 THEN '_R1_001.fastq.gz' WHEN 1 THEN '_R2_001.fastq.gz' WHEN 2 THEN '_1.fq.gz' WHEN 3 THEN '_2.fq' WHEN 4 THEN '.R1.fastq' ELSE '_x.fastq' END AS path, 'S' || o_custkey || CASE WHEN o_orderkey % 6 = 5 THEN '_x' ELSE '' END AS sample_name, CASE o_orderkey % 6 WHEN 0 THEN 'R1' WHEN 1 THEN 'R2' WHEN 2 THEN 'R1' WHEN 3 THEN 'R2' WHEN 4 THEN 'R1' ELSE 'unknown' END AS mate FROM orders)"


def fastqs(t):
    k = F.col("o_orderkey") % 6
    tail = F.coalesce(*[F.when(k == i, x) for i, x in enumerate(["_R1_001.fastq.gz", "_R2_001.fastq.gz", "_1.fq.gz", "_2.fq", ".R1.fastq", "_x.fastq"])])
    p = t.orders.select("o_orderkey", F.concat(F.lit("/data/run/S"), F.col("o_custkey").cast("string"), tail).alias("path"))
    return p.select("o_orderkey", "path", text.fastq_sample(F.col("path")).alias("sample_name"), text.fastq_mate(F.col("path")).alias("mate"))


@query("fastq_names", "WITH " + FQ_SQL + " SELECT o_orderkey, path, sample_name, mate FROM fq")
def _(t):
    return fastqs(t)


@query("fastq_pairs", "WITH " + FQ_SQL + " SELECT sample_name, max(path) FILTER (WHERE mate = 'R1') AS fastq_r1, max(path) FILTER (WHERE mate = 'R2') AS fastq_r2, max(path) FILTER (WHERE mate = 'R2') IS NOT NULL AS is_paired FROM fq GROUP BY 1 HAVING max(path) FILTER (WHERE mate = 'R1') IS NOT NULL")
def _(t):
    return cohort.pair_mates(fastqs(t))


@query("read_types", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'single' ELSE 'paired' END AS read_type FROM orders")
def _(t):
    r2 = F.when(F.col("o_orderkey") % 3 == 0, F.lit("N/A")).otherwise("f_2.fq")
    return t.orders.select("o_orderkey", text.read_type(r2).alias("read_type"))


@query("sample_sheet_checks", "SELECT o_orderpriority AS dataset_id, CAST(sum(k) AS BIGINT) AS n_samples, count(*) FILTER (WHERE k > 1) AS n_duplicate_samples, bool_or(p) AND bool_or(NOT p) AS mixed_reads, sum(np) * 2 > sum(k) AS mostly_paired, max(nc) AS n_conditions FROM (SELECT o_orderpriority, o_custkey, count(*) AS k, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS np, bool_or(o_orderkey % 3 <> 0) AS p FROM orders GROUP BY 1, 2) JOIN (SELECT o_orderpriority AS pr, count(DISTINCT o_orderstatus) AS nc FROM orders GROUP BY 1) ON pr = o_orderpriority GROUP BY 1")
def _(t):
    r2 = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise("f_2.fq")
    s = t.orders.select(F.col("o_orderpriority").alias("dataset_id"), F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("condition"), F.lit("").alias("batch"), text.read_type(r2).alias("read_type"))
    return checks.sample_sheet_report(s).select("dataset_id", "n_samples", "n_duplicate_samples", "mixed_reads", "mostly_paired", "n_conditions")


@query("catalog_search", "SELECT 'dataset' AS type, 'D' || p_partkey AS name FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'brand#1') AND contains(lower('D' || p_partkey || ' ' || p_name || ' ' || p_type || ' ' || p_brand), 'economy') UNION ALL SELECT 'pool', s_name FROM supplier WHERE contains(lower(s_name || ' brand#1'), 'brand#1') AND contains(lower(s_name || ' brand#1'), 'economy')")
def _(t):
    d = t.part.select(F.concat(F.lit("D"), F.col("p_partkey").cast("string")).alias("accession"), F.col("p_name").alias("organism"), F.col("p_type").alias("description"),
                      F.col("p_brand").alias("platform"), F.lit("GEO").alias("repository"), F.array(F.lit("tag")).alias("tags"))
    p = t.supplier.select(F.col("s_name").alias("pool_name"), F.lit("brand#1").alias("description"), F.array(F.lit("S1")).alias("studies"), F.array(F.lit("tag")).alias("tags"))
    return cohort.catalog_search(d, p, "Brand#1 ECONOMY").select("type", F.coalesce("accession", "pool_name").alias("name"))


@query("catalog_filter", "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#1' AND contains(lower(p_name), 'r') AND p_type = 'ECONOMY'")
def _(t):
    d = t.part.select("p_partkey", F.col("p_brand").alias("repository"), F.col("p_name").alias("organism"), F.col("p_type").alias("data_type"))
    return cohort.catalog_filter(d, "BRAND#1", "R", "ECONOMY").select("p_partkey")


@query("title_alignment", "SELECT r.r_name AS dataset_id, n_name AS \"column\", 'GSM' || n_nationkey AS sample_id, 'title' AS strategy FROM nation JOIN region r ON r.r_regionkey = n_regionkey")
def _(t):
    n = t.nation.join(t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    c = n.select(F.col("r_name").alias("dataset_id"), F.col("n_name").alias("column"), F.col("n_nationkey").alias("position"))
    s = n.select(F.col("r_name").alias("dataset_id"), F.concat(F.lit("GSM"), F.col("n_nationkey").cast("string")).alias("sample_id"),
                 F.lower("n_name").alias("title"), F.lit("").alias("source"), F.col("n_nationkey").alias("position"))
    return cohort.align_titles(c, s)


@query("title_scores")
def _(t):
    study = F.floor(F.col("p_partkey") / 40).cast("string").alias("dataset_id")
    name, k = F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_partkey").cast("string")
    c = t.part.select(study, F.concat_ws("_", name, k).alias("column"))
    s = t.part.select(study, F.concat(F.lit("GSM"), k).alias("sample_id"), F.concat(name, F.lit(",rep"), k).alias("title"))
    return cohort.title_scores(c, s)


@query("title_matches")
def _(t):
    study = F.floor(F.col("p_partkey") / 40).cast("string").alias("dataset_id")
    name, k = F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_partkey").cast("string")
    c = t.part.select(study, F.concat_ws("_", name, k).alias("column"))
    s = t.part.select(study, F.concat(F.lit("GSM"), k).alias("sample_id"), F.concat(name, F.lit(",rep"), k).alias("title"))
    return cohort.greedy_match(cohort.title_scores(c, s))


# ---- checks -------------------------------------------------------------------------------------------

@query("check_count_matrix", with_views("gstats libs") + """SELECT g.dataset_id, CAST(0 AS BIGINT) AS n_negative, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_infinite, CAST(0 AS BIGINT) AS n_duplicate_cells,
g.ng AS n_genes, g.nz AS n_zero_genes, l.ns AS n_samples, l.nz AS n_zero_samples, true AS valid FROM (SELECT dataset_id, count(*) AS ng, count(*) FILTER (WHERE total = 0) AS nz FROM gstats GROUP BY 1) g
JOIN (SELECT dataset_id, count(*) AS ns, count(*) FILTER (WHERE lib = 0) AS nz FROM libs GROUP BY 1) l ON l.dataset_id = g.dataset_id""")
def _(t):
    return checks.count_matrix_report(t.counts(), 10, 2)


@query("check_integrity", with_views("counts samples") + """SELECT c.dataset_id, n_cells, n_features, 12 AS n_shared, n_lack_metadata, true AS valid FROM (SELECT dataset_id, count(*) AS n_cells, count(DISTINCT gene_id) AS n_features, CAST(count(DISTINCT sample_id) FILTER (WHERE sample_id % 2 = 1) AS BIGINT) AS n_lack_metadata FROM counts GROUP BY 1) c""".replace("12 AS n_shared", "(SELECT count(*) FROM samples s WHERE s.dataset_id = c.dataset_id AND sample_id % 2 = 0) AS n_shared"))
def _(t):
    r = checks.integrity_report(t.counts(), t.samples().where("condition = 'control'"))
    return r.select("dataset_id", "n_cells", "n_features", "n_shared", "n_lack_metadata", "valid")


@query("check_missing_metadata", with_views("samples") + "SELECT dataset_id, sample_id FROM samples WHERE condition = 'treated'")
def _(t):
    return checks.missing_metadata(t.counts(), t.samples().where("condition = 'control'"))


@query("check_missing_data", with_views("samples") + "SELECT dataset_id, sample_id FROM samples WHERE dataset_id = 'R'")
def _(t):
    return checks.missing_data(t.counts().where("dataset_id <> 'R'"), t.samples())


@query("check_groups", with_views("samples") + "SELECT dataset_id, CAST(sum(k) AS BIGINT) AS n_samples, CAST(0 AS BIGINT) AS n_duplicate_samples, count(*) AS n_groups, min(k) AS smallest_group, count(*) FILTER (WHERE k < 2) AS n_small_groups, count(*) FILTER (WHERE k < 2) = 0 AS valid FROM (SELECT dataset_id, batch, count(*) AS k FROM samples GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return checks.metadata_report(t.samples(), "batch")


@query("check_de_result", with_views("de") + "SELECT contrast_id, method, count(*) AS n_genes, CAST(0 AS BIGINT) AS n_missing_lfc, CAST(0 AS BIGINT) AS n_missing_p, CAST(0 AS BIGINT) AS n_infinite_lfc FROM de GROUP BY 1, 2")
def _(t):
    return checks.de_report(t.de(), ["contrast_id", "method"])


@query("check_ground_truth", "SELECT count(*) AS n_genes, count(*) AS n_distinct, CASE WHEN count(*) < 10 THEN 'too_few' WHEN count(*) < 20 THEN 'borderline' WHEN count(*) < 50 THEN 'good' ELSE 'excellent' END AS level FROM part WHERE p_size > 25")
def _(t):
    return checks.truth_report(t.part.where("p_size > 25").select(F.col("p_partkey").alias("gene_id")))


@query("samples_by_condition", with_views("samples") + "SELECT dataset_id, sample_id FROM samples WHERE condition = 'treated' AND batch = 'b1'")
def _(t):
    return t.samples().where("condition = 'treated' AND batch = 'b1'").select("dataset_id", "sample_id")


@query("subset_samples", with_views("counts samples") + "SELECT c.dataset_id, c.gene_id, c.sample_id, c.count FROM counts c JOIN samples s ON s.dataset_id = c.dataset_id AND s.sample_id = c.sample_id WHERE batch = 'b2'")
def _(t):
    keep = t.samples().where("batch = 'b2'").select("dataset_id", "sample_id")
    return t.counts().join(keep, ["dataset_id", "sample_id"], "left_semi").select("dataset_id", "gene_id", "sample_id", "count")
