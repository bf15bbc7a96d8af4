from pyspark.sql import functions as F

from longomics.operators import quantification
from longomics.plans.views import Tables
from longomics.sources import files
from longomics.streaming import arrivals


def test_arriving_samples_equal_one_batch(spark, sf, tmp_path):
    t = Tables(spark, sf)
    q = t.quant().select("sample_id", F.col("tx_id").alias("Name"), F.col("length").alias("Length"), F.col("eff_length").alias("EffectiveLength"),
                         F.col("tpm").alias("TPM"), F.col("num_reads").alias("NumReads")).repartition("sample_id")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda df: df.write.mode("append").partitionBy("sample_id").option("header", True).option("sep", "\t").csv(src)
    for part in ("sample_id < 4", "sample_id >= 4"):
        write(q.where(part))
        stream = arrivals.quantity_stream(spark, src + "/*/*.csv", 3)
        arrivals.append_gene_counts(stream, t.tx2gene(), out, str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(out).select("sample_id", "gene_id", "count")
    want = quantification.aggregate_to_gene(files.salmon(spark, src + "/*/*.csv"), t.tx2gene()).select("sample_id", "gene_id", "count")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
