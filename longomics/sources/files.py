"""File readers. Every reader takes a path or glob and returns a long DataFrame.

Multi-file readers keep each row's file through ``_metadata.file_path``. Where tools differ in their columns, the names
are resolved in every file's own header (``picked``); values are cast with ``try_cast``.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Accepted column names in order of preference.
KEY_NAMES = ["gene_id", "geneid", "gene", "id"]
TX_NAMES = ["transcript_id", "txname", "transcript", "tx_id", "target_id", "ensembl_transcript_id"]
GENE_NAMES = ["gene_id", "geneid", "gene", "gene_name", "ens_gene", "ensembl_gene_id"]
STAR_FALLBACK = ["unstranded", "tpm_unstranded", "fpkm_unstranded", "expected_count"]
GSM_IDS = ["ID_REF", "Gene", "gene_id", "GeneID"]
GSM_VALUES = ["VALUE", "value", "counts", "Count", "expected_count", "TPM", "FPKM"]
KALLISTO_NAMES = {"target_id": "Name", "length": "Length", "eff_length": "EffectiveLength",
                  "est_counts": "NumReads", "tpm": "TPM"}
COUNT_WORDS = ["count", "counts", "raw_count", "gene_count", "readcount", "read_count", "expression", "expr",
               "matrix", "abundance", "fpkm", "tpm", "rpkm"]
SKIP_WORDS = ["readme", "metadata", "sample_info", "design", "annotation", "filelist", ".bed", ".bw", ".bam"]


def table(spark: SparkSession, path: str | list[str], sep: str = ",", comment: str | None = None) -> DataFrame:
    """Delimited text with a header, all columns as strings, plus the source file in ``_file``."""
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path).withColumn("_file", F.col("_metadata.file_path"))


def file_headers(spark: SparkSession, path: str | list[str], comment: str | None = None) -> DataFrame:
    """(file, header): the first line of every file that is neither blank nor a comment."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("n"), "value")
    first = lines.where((F.col("block") == 0) & (F.trim("value") != ""))
    if comment:
        first = first.where(~F.col("value").startswith(comment))
    return first.groupBy("file").agg(F.min_by("value", "n").alias("header"))


def picked(spark: SparkSession, path: str | list[str], pick: Callable[[list[str]], dict[str, int | None]], sep: str = "\t",
           comment: str | None = None, missing: bool = False) -> DataFrame:
    """The columns that ``pick`` names by position from the header of each file, as strings, plus ``_file`` and ``_line``.

    Files whose columns stand at the same places are read together, so the number of scans follows the layouts and not
    the files. A column without a place (None) is null, with ``missing`` also one that ``pick`` names in other files only;
    files without a header line hold no rows. Only the file names and headers reach the driver, which lists the files in
    any case.
    """
    layouts = defaultdict(list)
    for row in file_headers(spark, path, comment).collect():
        names = next(csv.reader([row["header"]], delimiter=sep))
        places = pick(names)
        layouts[len(names), tuple(places.items())].append(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(row["file"])))
    if not layouts:
        raise ValueError(f"no file with a header line at {path}")
    parts = []
    for (_, places), names in sorted(layouts.items(), key=repr):
        df = table(spark, sorted(names), sep, comment)
        kept = data_columns(df)
        parts.append(df.select(*[(F.lit(None).cast("string") if at is None else col(kept[at])).alias(name) for name, at in places],
                               "_file", line_order().alias("_line")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), parts)


def place(columns: Sequence[str], name: str | None, default: int | None = 0) -> int | None:
    return columns.index(name) if name is not None else default


def line_order() -> Column:
    """Sortable place of a row: file, split, then the order inside the split; project it straight from the read."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("n"))


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("_file", "_line")]


def first_match(columns: Sequence[str], names: Sequence[str]) -> str | None:
    return next((n for n in names if n in columns), None)


def containing(columns: Sequence[str], *parts: str) -> str | None:
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def parent_folder(file: Column) -> Column:
    """Name of the folder holding the file; 'sample=x' partition folders give x."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -2), "^[^=]*=", "")


def file_stem(file: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\..*$", "")


def double(name: str) -> Column:
    return col(name).try_cast("double")


def count_matrix(spark: SparkSession, path: str, gene_column: str | None = None, sep: str = ",") -> DataFrame:
    """Wide matrix file -> (gene_id, sample_id, count); the key column is found by name, else first."""
    df = table(spark, path, sep)
    cols = data_columns(df)
    key = gene_column or next((c for c in cols if c.lower() in KEY_NAMES), cols[0])
    wide = df.select(col(key).alias("gene_id"), *[double(c).alias(c) for c in cols if c != key])
    return wide.unpivot(["gene_id"], [c for c in cols if c != key], "sample_id", "count")


def salmon(spark: SparkSession, glob: str) -> DataFrame:
    df = table(spark, glob, "\t")
    return df.select(parent_folder(F.col("_file")).alias("sample_id"), col("Name").alias("tx_id"),
                     double("Length").alias("length"), double("EffectiveLength").alias("eff_length"),
                     double("NumReads").alias("num_reads"), double("TPM").alias("tpm"))


def kallisto(spark: SparkSession, glob: str) -> DataFrame:
    df = table(spark, glob, "\t").withColumnsRenamed(KALLISTO_NAMES)
    return df.select(parent_folder(F.col("_file")).alias("sample_id"), col("Name").alias("tx_id"),
                     double("Length").alias("length"), double("EffectiveLength").alias("eff_length"),
                     double("NumReads").alias("num_reads"), double("TPM").alias("tpm"))


def rsem(spark: SparkSession, glob: str) -> DataFrame:
    df = table(spark, glob, "\t")
    return df.select(parent_folder(F.col("_file")).alias("sample_id"), col("gene_id"),
                     F.bround(double("expected_count"), 0).cast("bigint").alias("count"), double("TPM").alias("tpm"))


def feature_counts(spark: SparkSession, glob: str) -> DataFrame:
    """'#' lines skipped, key Geneid, last column is the count."""
    df = table(spark, glob, "\t", "#")
    cols = data_columns(df)
    return df.select(parent_folder(F.col("_file")).alias("sample_id"), col(cols[0]).alias("gene_id"),
                     F.bround(double(cols[-1]), 0).cast("bigint").alias("count"))


def star_counts(spark: SparkSession, glob: str, quant_column: str = "unstranded") -> DataFrame:
    """Quantity column by exact name, substring, fallback list, else second; Ensembl genes only, unversioned."""
    def pick(cols: list[str]) -> dict[str, int | None]:
        chosen = (quant_column if quant_column in cols else None) or containing(cols, quant_column.lower()) or first_match(cols, STAR_FALLBACK)
        return {"gene_id": place(cols, containing(cols, "gene_id")), "count": place(cols, chosen, 1)}

    gid = F.element_at(F.split("gene_id", r"\."), 1)
    return picked(spark, glob, pick, "\t", "#").select(
        parent_folder(F.col("_file")).alias("sample_id"), gid.alias("gene_id"), double("count").alias("count")
    ).where(F.col("gene_id").startswith("ENSG"))


def tx2gene_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(tx_id, gene_id) from tables with or without known names (any case, else the first two columns).

    ``sep`` None: tab where a header holds one, else comma. The last row of a transcript wins, by file and line.
    """
    if sep is None:
        tabs = file_headers(spark, path).agg(F.count_if(F.col("header").contains("\t")).alias("n")).first()["n"]
        sep = "\t" if tabs else ","

    def pick(cols: list[str]) -> dict[str, int | None]:
        low = [c.lower().strip() for c in cols]
        tx, gene = first_match(low, TX_NAMES), first_match(low, GENE_NAMES)
        known = tx is not None and gene is not None
        return {"tx_id": place(low, tx) if known else 0, "gene_id": place(low, gene) if known else 1}

    return picked(spark, path, pick, sep).groupBy("tx_id").agg(F.max_by("gene_id", "_line").alias("gene_id"))


def tx2gene_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Transcript and exon lines of GTF or GFF; both attribute syntaxes; a transcript's last line wins, by file and line."""
    lines = spark.read.text(path).withColumn("_n", line_order()).where(~F.col("value").startswith("#"))
    f = F.split(F.trim("value"), "\t")
    rows = lines.select("_n", f.alias("f")).where((F.size("f") >= 9) & F.get("f", F.lit(2)).isin("transcript", "exon"))
    attr = F.get("f", F.lit(8))

    def pick(key: str) -> Column:
        quoted = F.regexp_extract(attr, key + r' "([^"]+)"', 1)
        return F.when(quoted != "", quoted).otherwise(F.nullif(F.regexp_extract(attr, key + r"=([^;]+)", 1), F.lit("")))

    pairs = rows.select("_n", pick("transcript_id").alias("tx_id"), pick("gene_id").alias("gene_id"))
    return (pairs.where("tx_id IS NOT NULL AND gene_id IS NOT NULL").groupBy("tx_id")
            .agg(F.max_by("gene_id", "_n").alias("gene_id")))


def keyed_values(spark: SparkSession, glob: str, key_parts: Sequence[str], value_parts: Sequence[str],
                 fallback: int = 1, sample: Column | None = None) -> DataFrame:
    """(sample_id, feature, value) with columns found by name parts in each file, else by position."""
    def pick(cols: list[str]) -> dict[str, int | None]:
        return {"feature": place(cols, containing(cols, *key_parts)),
                "value": place(cols, containing(cols, *value_parts), fallback % len(cols))}

    return picked(spark, glob, pick).select((parent_folder(F.col("_file")) if sample is None else sample).alias("sample_id"),
                                            "feature", double("value").alias("value"))


def mirna(spark: SparkSession, glob: str) -> DataFrame:
    return keyed_values(spark, glob, ["mirna_id"], ["reads_per_million"])


def copy_number_genes(spark: SparkSession, glob: str) -> DataFrame:
    df = keyed_values(spark, glob, ["gene_id"], ["copy_number"], fallback=-1)
    return df.withColumn("feature", F.element_at(F.split("feature", r"\."), 1))


def methylation(spark: SparkSession, glob: str) -> DataFrame:
    """Beta values; unreadable ones stay null."""
    return keyed_values(spark, glob, ["composite", "probe"], ["beta"])


def by_name(spark: SparkSession, glob: str, comment: str | None = None) -> DataFrame:
    """All columns of all files under their own names; a column that a file lacks is null there."""
    headers = file_headers(spark, glob, comment).select("header").distinct().collect()
    names = list(dict.fromkeys(c for r in sorted(headers) for c in next(csv.reader([r["header"]], delimiter="\t"))))
    return picked(spark, glob, lambda cols: {c: cols.index(c) if c in cols else None for c in names}, "\t", comment)


def segments(spark: SparkSession, glob: str) -> DataFrame:
    df = by_name(spark, glob)
    return df.select(parent_folder(F.col("_file")).alias("sample_id"), *[col(c) for c in data_columns(df)])


def mutations(spark: SparkSession, glob: str) -> DataFrame:
    return by_name(spark, glob, "#").drop("_file", "_line")


def proteins(spark: SparkSession, glob: str) -> DataFrame:
    """Protein and value columns by name in each file; without a value name, a file's last mostly numeric column.

    The numeric shares of such files come from one aggregate by file.
    """
    def pick(cols: list[str]) -> dict[str, int | None]:
        protein = [i for i, c in enumerate(cols) if "peptide_target" in c.lower() or ("protein" in c.lower() and "expression" not in c.lower())]
        values = [i for i, c in enumerate(cols) if i not in protein and "expression" in c.lower()]
        # Files without a value name carry all their columns, those with one carry it as the only one.
        shown = [values[-1]] if values else list(range(len(cols)))
        return {"feature": protein[-1] if protein else 0} | {f"v{k}": at for k, at in enumerate(shown)}

    df = picked(spark, glob, pick, missing=True)
    cols = [c for c in df.columns if c.startswith("v")]
    share = df.groupBy("_file").agg(F.array(*[F.avg(double(c).isNotNull().cast("int")) for c in cols]).alias("share"),
                                    F.array(*[F.count(c) for c in cols]).alias("filled"))
    places = F.filter(F.sequence(F.lit(0), F.lit(len(cols) - 1)), lambda i: F.get("share", i) > 0.5)
    used = F.filter(F.sequence(F.lit(0), F.lit(len(cols) - 1)), lambda i: F.get("filled", i) > 0)
    chosen = share.select("_file", F.coalesce(F.array_max(places), F.array_max(used), F.lit(0)).alias("at"))
    return df.join(chosen, "_file").select(parent_folder(F.col("_file")).alias("sample_id"), "feature",
                                           F.get(F.array(*[col(c) for c in cols]), F.col("at")).try_cast("double").alias("value"))


def gsm_tables(spark: SparkSession, glob: str) -> DataFrame:
    """One table per sample, named by its file; a file without a value column is an error."""
    def pick(cols: list[str]) -> dict[str, int | None]:
        value = first_match(cols, GSM_VALUES)
        if value is None:
            raise ValueError(f"no value column among {cols}")
        return {"gene_id": place(cols, first_match(cols, GSM_IDS)), "count": place(cols, value)}

    return picked(spark, glob, pick).select(file_stem(F.col("_file")).alias("sample_id"), "gene_id", double("count").alias("count"))


def file_score(name: str) -> int | None:
    """Rank of a supplementary file name: +5 for count, +3 for raw; None when it is to be skipped."""
    low = name.lower()
    if any(w in low for w in SKIP_WORDS):
        return None
    score = sum(1 for w in COUNT_WORDS if w in low)
    return score + (5 if "count" in low else 0) + (3 if "raw" in low else 0)


def supplementary_matrix(spark: SparkSession, path: str, min_rows: int = 100, min_columns: int = 2) -> DataFrame:
    """Sniffed matrix file -> long cells: separator by extension or first line, too small or mostly
    non-numeric files refused, columns over 90% empty dropped, all-empty rows dropped, gaps as 0.

    Row and numeric counts of every column come from one aggregate.
    """
    low = path.lower()
    if ".tsv" in low or ".txt" in low:
        sep = "\t"
    else:
        head = spark.read.text(path).first()
        sep = "\t" if head and "\t" in head["value"] else ","
    df = table(spark, path, sep)
    key, *cols = data_columns(df)
    typed = df.select(col(key).alias("gene_id"), *[double(c).alias(c) for c in cols])
    some = F.lit(False)
    for c in cols:
        some = some | col(c).isNotNull()
    a = typed.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(some).alias("_full"),
                  *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    if a["_rows"] < min_rows or len(cols) < min_columns:
        raise ValueError(f"too small for a count matrix: {a['_rows']} x {len(cols)}")
    filled = [a[f"n{i}"] for i in range(len(cols))]
    if sum(filled) < 0.5 * a["_rows"] * len(cols):
        raise ValueError("less than half of the cells are numeric")
    keep = [c for i, c in enumerate(cols) if filled[i] > 0 and 1 - filled[i] / max(a["_full"], 1) <= 0.9]
    return (typed.where(some).select("gene_id", *[F.coalesce(col(c), F.lit(0.0)).alias(c) for c in keep])
            .unpivot(["gene_id"], keep, "sample_id", "count"))


def with_sdrf(cells: DataFrame, spark: SparkSession, sdrf: str) -> DataFrame:
    """Attach an SDRF sample table (key: Source Name, else first column) to long cells; the first row of a sample counts."""
    df = table(spark, sdrf, "\t").withColumn("_line", line_order())
    cols = data_columns(df)
    key = first_match(cols, ["Source Name"]) or cols[0]
    named = df.select(col(key).alias("sample_id"), *[
        col(c).alias(c.lower().replace("characteristics[", "").rstrip("]").strip().replace(" ", "_")) for c in cols if c != key], "_line")
    facts = [c for c in named.columns if c not in ("sample_id", "_line")]
    first = named.groupBy("sample_id").agg(F.min_by(F.struct(*facts), "_line").alias("_first")).select("sample_id", "_first.*") \
        if facts else named.select("sample_id").distinct()
    return cells.join(first, "sample_id", "left")


CASE_SCHEMA = ("submitter_id string, project_id string, "
               "demographic struct<gender:string,vital_status:string,race:string,days_to_death:bigint>, "
               "diagnoses array<struct<age_at_diagnosis:bigint,days_to_last_follow_up:bigint,tumor_stage:string,primary_diagnosis:string>>, "
               "samples array<struct<submitter_id:string,sample_type:string>>")


def case_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE_SCHEMA).json(path)


def run_table(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.option("multiLine", multiline).json(path)


def de_result(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "\t" if path.lower().endswith((".tsv", ".txt")) else ",").drop("_file")


def salmon_run_info(spark: SparkSession, glob: str) -> DataFrame:
    """meta_info.json below <sample>/aux_info/."""
    schema = "salmon_version string, num_processed bigint, num_mapped bigint, percent_mapped double, num_decoy_fragments bigint"
    df = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("_file", F.col("_metadata.file_path"))
    sample = F.regexp_replace(F.element_at(F.split("_file", "/"), -3), "^[^=]*=", "")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.select(sample.alias("sample_id"), zero("num_processed").alias("n_processed"), zero("num_mapped").alias("n_mapped"),
                     F.coalesce("percent_mapped", F.lit(0.0)).alias("mapping_rate"), zero("num_decoy_fragments").alias("n_unique"),
                     F.coalesce("salmon_version", F.lit("unknown")).alias("tool_version"))


def kallisto_run_info(spark: SparkSession, glob: str) -> DataFrame:
    schema = "n_processed bigint, n_pseudoaligned bigint, p_pseudoaligned double, n_unique bigint, kallisto_version string"
    df = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("_file", F.col("_metadata.file_path"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.select(parent_folder(F.col("_file")).alias("sample_id"), zero("n_processed").alias("n_processed"),
                     zero("n_pseudoaligned").alias("n_mapped"), F.coalesce("p_pseudoaligned", F.lit(0.0)).alias("mapping_rate"),
                     zero("n_unique").alias("n_unique"), F.coalesce("kallisto_version", F.lit("unknown")).alias("tool_version"))


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Sample sheet with '' for missing columns; a single 'fastq' column counts as R1."""
    df = table(spark, path)
    cols = data_columns(df)
    r1 = "fastq_r1" if "fastq_r1" in cols else "fastq" if "fastq" in cols else None
    pick = lambda c: F.coalesce(col(c), F.lit("")) if c and c in cols else F.lit("")
    return df.select(pick("sample_id").alias("sample_id"), pick("condition").alias("condition"), pick("batch").alias("batch"),
                     pick(r1).alias("fastq_r1"), pick("fastq_r2").alias("fastq_r2"))


def logs(spark: SparkSession, glob: str) -> DataFrame:
    """Whole small log files: (sample_id, text)."""
    return spark.read.text(glob, wholetext=True).select(
        parent_folder(F.col("_metadata.file_path")).alias("sample_id"), F.col("value").alias("text"))


def grab(pattern: str, kind: str = "double") -> Column:
    return F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")).try_cast(kind)


def log_metrics(df: DataFrame, tool: str) -> DataFrame:
    """Metrics of (sample_id, text) logs: star | hisat2 | salmon | feature_counts | rsem."""
    fields = {
        "star": {"n_input_reads": grab(r"Number of input reads\s*\|\s*(\d+)", "bigint"),
                 "n_uniquely_mapped": grab(r"Uniquely mapped reads number\s*\|\s*(\d+)", "bigint"),
                 "uniquely_mapped_percent": grab(r"Uniquely mapped reads %\s*\|\s*([\d.]+)%?")},
        "hisat2": {"total_reads": grab(r"(\d+) reads", "bigint"),
                   "overall_alignment_rate": grab(r"([\d.]+)% overall alignment rate"),
                   "unique_alignments": grab(r"(\d+) \([\d.]+%\) aligned concordantly exactly 1 time", "bigint"),
                   "unique_rate": grab(r"\d+ \(([\d.]+)%\) aligned concordantly exactly 1 time")},
        "salmon": {"mapping_rate": grab(r"[Mm]apping rate[^\n]*?(\d+\.?\d*)%")},
        "rsem": {"n_total": grab(r"^\s*(\d+)[^\n]*\n", "bigint"), "n_aligned": grab(r"^[^\n]*\n\s*(\d+)", "bigint")},
    }
    if tool == "feature_counts":
        lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.split(s, "\t")), lambda p: F.size(p) >= 2)
        values = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(0))), lambda p: F.struct(p[0].alias("k"), p[1].try_cast("bigint").alias("v")))
        total = F.aggregate(values, F.lit(0).cast("bigint"), lambda a, e: a + F.coalesce(e["v"], F.lit(0)))
        got = F.get(F.filter(values, lambda e: e["k"] == "Assigned"), F.lit(0))["v"]
        out = df.select("sample_id", F.coalesce(got, F.lit(0)).alias("assigned"), total.alias("total"))
        return out.withColumn("assigned_percent", F.when(F.col("total") > 0, F.col("assigned") / F.col("total") * 100).otherwise(0.0))
    if tool not in fields:
        raise ValueError(f"unknown tool {tool!r}")
    out = df.select("sample_id", *[c.alias(n) for n, c in fields[tool].items()])
    if tool == "rsem":
        out = out.withColumn("alignment_rate", F.when(F.col("n_total") > 0, F.col("n_aligned") / F.col("n_total") * 100))
    return out
