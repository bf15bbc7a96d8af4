"""Column expressions for sample names, barcodes and free-text metadata."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sample-type names by two-digit code.
SAMPLE_TYPES = {
    "01": "Primary Solid Tumor", "02": "Recurrent Solid Tumor",
    "03": "Primary Blood Derived Cancer - Peripheral Blood",
    "04": "Recurrent Blood Derived Cancer - Bone Marrow", "05": "Additional - New Primary",
    "06": "Metastatic", "07": "Additional Metastatic", "08": "Human Tumor Original Cells",
    "09": "Primary Blood Derived Cancer - Bone Marrow", "10": "Blood Derived Normal",
    "11": "Solid Tissue Normal", "12": "Buccal Cell Normal", "13": "EBV Immortalized Normal",
    "14": "Bone Marrow Normal", "20": "Control Analyte",
    "40": "Recurrent Blood Derived Cancer - Peripheral Blood", "50": "Cell Lines",
    "60": "Primary Xenograft Tissue", "61": "Cell Line Derived Xenograft Tissue",
}

# Keywords in order of preference.
ASSEMBLIES = ["grch38", "grch37", "hg38", "hg19", "hg18", "mm39", "mm10", "mm9", "grcm39", "grcm38",
              "rn7", "rn6", "danrer11", "dm6"]
ALIGNERS = ["star", "hisat2", "hisat", "bowtie2", "bowtie", "bwa", "tophat", "salmon", "kallisto", "minimap2"]
QUANTIFIERS = ["featurecounts", "htseq", "stringtie", "ballgown", "salmon", "kallisto", "rsem", "cufflinks"]

# FASTQ extensions, read-mate patterns in file names, and name suffixes in the order tried.
FASTQ_EXTENSIONS = [".fastq.gz", ".fq.gz", ".fastq", ".fq"]
R1 = [r"_R1_001\.", r"_R1\.", r"\.R1\.", r"_1\.", r"_read1\.", r"_r1\.", r"\.1\."]
R2 = [r"_R2_001\.", r"_R2\.", r"\.R2\.", r"_2\.", r"_read2\.", r"_r2\.", r"\.2\."]
SUFFIXES = ["_R1_001", "_R2_001", "_R1", "_R2", ".R1", ".R2", "_read1", "_read2", "_r1", "_r2", "_1", "_2"]
NOT_PAIRED = ["", "NA", "na", "N/A", "n/a", "None", "none"]


def _part(parts: Column, i: int) -> Column:
    return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))


def barcode_fields(barcode: Column) -> dict[str, Column]:
    """Component columns of a project-tss-participant-sample-portion-plate-center barcode."""
    parts = F.split(barcode, "-")
    n = F.size(parts)
    sample, portion = _part(parts, 3), _part(parts, 4)
    code = F.substring(sample, 1, 2)
    names = F.create_map(*[F.lit(v) for kv in SAMPLE_TYPES.items() for v in kv])
    has = n > 3
    return {
        "project": _part(parts, 0), "tss": _part(parts, 1), "participant": _part(parts, 2),
        "patient_barcode": F.when(n >= 3, F.array_join(F.slice(parts, 1, 3), "-")).otherwise(barcode),
        "sample_type_code": F.when(has, code).otherwise(""),
        "sample_type": F.when(has, F.coalesce(F.element_at(names, code), F.concat(F.lit("Unknown ("), code, F.lit(")")))).otherwise("Unknown"),
        "vial": F.when(has, F.substring(sample, 3, 100)).otherwise(""),
        "sample_barcode": F.when(has, F.array_join(F.slice(parts, 1, 4), "-")).otherwise(barcode),
        "portion": F.substring(portion, 1, 2), "analyte": F.substring(portion, 3, 100),
        "plate": _part(parts, 5), "center": _part(parts, 6),
    }


def sample_category(sample_type: Column) -> Column:
    low = F.lower(sample_type)
    return (F.when(low.rlike("tumor|cancer|metastatic"), "Tumor").when(low.contains("normal"), "Normal").otherwise("Other"))


def code_between(barcode: Column, low: int, high: int) -> Column:
    code = barcode_fields(barcode)["sample_type_code"]
    return F.coalesce(code.rlike("^[0-9]+$") & code.try_cast("int").between(low, high), F.lit(False))


def is_tumor(barcode: Column) -> Column:
    return code_between(barcode, 1, 9)


def is_normal(barcode: Column) -> Column:
    return code_between(barcode, 10, 14)


def first_keyword(text: Column, words: list[str], label=lambda w: w) -> Column:
    low = F.lower(text)
    out = None
    for word in words:
        hit = low.contains(word)
        out = F.when(hit, label(word)) if out is None else out.when(hit, label(word))
    return F.coalesce(out, F.lit("unknown"))


def processing_fields(text: Column, molecule: Column) -> dict[str, Column]:
    mol = F.lower(F.coalesce(molecule, F.lit("")))
    return {
        "assembly": first_keyword(text, ASSEMBLIES),
        "aligner": first_keyword(text, ALIGNERS, lambda w: w.upper() if w in ("star", "bwa") else w.capitalize()),
        "quantification": first_keyword(text, QUANTIFIERS, str.capitalize),
        "rna_type": F.when(mol.contains("polya") | mol.contains("poly-a") | mol.contains("poly(a)"), "polyA")
        .when(mol.contains("total"), "total RNA").otherwise(F.coalesce(molecule, F.lit("unknown"))),
    }


def characteristics(items: Column) -> Column:
    """['Key name: value', ...] -> map(key_name -> value); items without ':' are dropped, last wins."""
    pairs = F.filter(items, lambda s: s.contains(":"))
    entries = F.transform(pairs, lambda s: F.struct(
        F.replace(F.lower(F.trim(F.substring_index(s, ":", 1))), F.lit(" "), F.lit("_")).alias("key"),
        F.trim(F.regexp_extract(s, "(?s)^[^:]*:(.*)$", 1)).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
                                                  lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def clean_title(title: Column) -> Column:
    """Title without replicate wording and trailing numbers; the title itself if nothing is left."""
    a = F.trim(F.regexp_replace(title, r"(?i)[,_\s]*(rep|replicate|sample|rep\.?\s*)\s*\d+\s*$", ""))
    b = F.trim(F.regexp_replace(a, r"[_\s]+\d+\s*$", ""))
    return F.when(b == "", title).otherwise(b)


def accession_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(GSM\d+)"), F.lit(1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def fastq_mate(path: Column) -> Column:
    name = file_name(path)
    one, two = (name.rlike("(?i)" + "|".join(p)) for p in (R1, R2))
    return F.when(one & ~two, "R1").when(two & ~one, "R2").otherwise("unknown")


def fastq_sample(path: Column) -> Column:
    """File name without extension and without the first matching read suffix; trailing _ and . cut."""
    name = file_name(path)
    stem = name
    for ext in reversed(FASTQ_EXTENSIONS):
        stem = F.when(name.endswith(ext), F.substring(name, F.lit(1), F.length(name) - len(ext))).otherwise(stem)
    low, out = F.lower(stem), None
    for suffix in SUFFIXES:
        hit = low.endswith(suffix.lower())
        trimmed = F.substring(stem, F.lit(1), F.length(stem) - len(suffix))
        out = F.when(hit, trimmed) if out is None else out.when(hit, trimmed)
    return F.regexp_replace(out.otherwise(stem), r"[_\.]+$", "")


def read_type(fastq_r2: Column) -> Column:
    return F.when(fastq_r2.isNull() | fastq_r2.isin(NOT_PAIRED), "single").otherwise("paired")


def stability_label(phi: Column) -> Column:
    """excellent from 0.75, poor below 0.4, else intermediate."""
    return F.when(phi >= 0.75, "excellent").when(phi < 0.4, "poor").otherwise("intermediate")
