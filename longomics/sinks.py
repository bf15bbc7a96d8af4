"""Writers and their readers. Paths are folders on shared storage; nothing is collected."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .operators import de as de_ops
from .operators.ordered import sort_columns

# Version of the stored layout, and the tables that a result of each kind has at least.
RESULT_VERSION = 1
RESULT_TABLES = {
    "biomarkers": ["ranking", "panel", "panel_curve", "oof", "fold_panels", "fold_metrics"],
    "optimisation": ["trials", "best", "genes"],
    "pooled": ["counts", "samples", "studies"],
}


def save_dataset(counts: DataFrame, samples: DataFrame, info: DataFrame, path: str) -> None:
    """Cells partitioned by dataset, sample table and dataset description."""
    counts.write.mode("overwrite").partitionBy("dataset_id").parquet(f"{path}/counts")
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    info.write.mode("overwrite").parquet(f"{path}/datasets")


def load_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("counts", "samples", "datasets")}


def wide_matrix(counts: DataFrame, sample_ids: Sequence, value: str = "count") -> DataFrame:
    """genes x samples with the given sample columns; absent cells 0."""
    return (counts.groupBy("gene_id").pivot("sample_id", list(sample_ids)).agg(F.first(value))
            .fillna(0, [str(s) for s in sample_ids]))


def export_matrix(counts: DataFrame, sample_ids: Sequence, path: str, sep: str = ",", value: str = "count") -> None:
    wide_matrix(counts, sample_ids, value).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def save_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per named table: consensus, tuning and biomarker results."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: Sequence[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    return {n: spark.read.format(fmt).load(f"{path}/{n}") for n in names}


def save_de_outputs(result: DataFrame, path: str) -> None:
    """Full and significant rows as CSV, summary as JSON."""
    full = result.select(*[c for c in result.columns])
    full.write.mode("overwrite").option("header", True).csv(f"{path}/full")
    full.where("is_significant").write.mode("overwrite").option("header", True).csv(f"{path}/significant")
    de_ops.summary(result).write.mode("overwrite").json(f"{path}/summary")


def save_de_json(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").json(path)


def load_de_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_result(kind: str, tables: Mapping[str, DataFrame], path: str) -> None:
    """All tables of one result, each in a folder of this save, then one manifest row a table.

    Rows are counted by the write itself. The manifest is appended after the last table, so a save that is cut short is
    never read and a reader of the former save is not disturbed.
    """
    missing = [n for n in RESULT_TABLES.get(kind, []) if n not in tables]
    if kind not in RESULT_TABLES or missing:
        raise ValueError(f"a result is one of {sorted(RESULT_TABLES)} with all its tables; {kind!r} lacks {missing}")
    spark = next(iter(tables.values())).sparkSession
    save, rows = uuid.uuid4().hex[:12], []
    at = time.time_ns()
    for name, frame in tables.items():
        seen = Observation()
        frame.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/tables/{save}/{name}")
        rows.append((kind, RESULT_VERSION, at, name, f"tables/{save}/{name}", frame.schema.json(), seen.get["n"]))
    manifest = "kind string, version int, saved_at long, name string, folder string, schema string, n_rows long"
    spark.createDataFrame(rows, manifest).coalesce(1).write.mode("append").json(f"{path}/manifest")


def load_result(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """Tables of the last complete save. Another kind or version, or a table that is missing or not as it was written
    (columns, types, number of rows), raises ValueError."""
    manifest = "kind string, version int, saved_at long, name string, folder string, schema string, n_rows long"
    rows = spark.read.schema(manifest).json(f"{path}/manifest")
    last = rows.join(rows.agg(F.max("saved_at").alias("saved_at")), "saved_at").collect()
    if {r["kind"] for r in last} != {kind} or {r["version"] for r in last} != {RESULT_VERSION}:
        raise ValueError(f"{path} holds {sorted({(r['kind'], r['version']) for r in last})}, not {kind!r} of version {RESULT_VERSION}")
    out = {}
    for r in last:
        schema = StructType.fromJson(json.loads(r["schema"]))
        frame = spark.read.parquet(f"{path}/{r['folder']}")
        written = [(f.name, f.dataType) for f in schema.fields]
        if [(f.name, f.dataType) for f in frame.schema.fields] != written or frame.count() != r["n_rows"]:
            raise ValueError(f"table {r['name']} of {path} is not as it was saved")
        out[r["name"]] = frame
    missing = [n for n in RESULT_TABLES[kind] if n not in out]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return out


def save_ordered(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Files whose rows, file by file, follow ``order`` (a leading '-' is descending): a range partition and a sort inside
    each file. End ``order`` with a key, so that equal rows stay in one order."""
    columns = sort_columns(order)
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def load_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`save_ordered` with ``position``, counted from 0 in the written order.

    Rows before a file come from the number of rows of the files before it; the row's own place is in the file.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    rows = spark.read.parquet(path).select("*", F.struct(part.alias("part"), F.col("_metadata.file_name").alias("name")).alias("_file"),
                                           F.col("_metadata.row_index").alias("_row"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", before.alias("_before"))
    return rows.join(F.broadcast(files), "_file").withColumn("position", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
