"""Samples that arrive one file set at a time, folded into gene counts without re-reading old ones.

The batch readers re-read a whole folder; here a file stream hands over only new quantification
files, and every micro-batch runs the same transcript-to-gene aggregate and appends its samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quantification import aggregate_to_gene
from ..sources.files import parent_folder

SALMON = "Name string, Length double, EffectiveLength double, TPM double, NumReads double"


def quantity_stream(spark: SparkSession, glob: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SALMON).option("header", True).option("sep", "\t")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.csv(glob)
    return df.select(parent_folder(F.col("_metadata.file_path")).alias("sample_id"), F.col("Name").alias("tx_id"),
                     F.col("Length").alias("length"), F.col("EffectiveLength").alias("eff_length"),
                     F.col("NumReads").alias("num_reads"), F.col("TPM").alias("tpm"))


def append_gene_counts(stream: DataFrame, tx2gene: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Start a run over everything available. Each batch overwrites its own folder, so a replayed
    batch after a failure leaves no duplicates. A sample's file must arrive whole in one batch."""
    def fold(batch: DataFrame, number: int) -> None:
        aggregate_to_gene(batch, tx2gene).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
