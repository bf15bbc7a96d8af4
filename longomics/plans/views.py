"""Domain views over the supplied star-schema tables, in Spark and in ANSI SQL.

Genes are parts, samples are supplier slots, datasets are return flags, counts are summed whole
quantities, so both engines see identical integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class Tables:
    """Lazy readers of the parquet tables plus the derived domain views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def counts(self) -> DataFrame:
        return (self.lineitem
                .groupBy(F.col("l_returnflag").alias("dataset_id"),
                         F.col("l_partkey").alias("gene_id"),
                         (F.col("l_suppkey") % 24).cast("int").alias("sample_id"))
                .agg(F.sum("l_quantity").cast("bigint").alias("count")))

    def samples(self) -> DataFrame:
        s = F.col("sample_id")
        return (self.lineitem
                .select(F.col("l_returnflag").alias("dataset_id"),
                        (F.col("l_suppkey") % 24).cast("int").alias("sample_id")).distinct()
                .select("dataset_id", "sample_id",
                        F.when(s % 2 == 0, "control").otherwise("treated").alias("condition"),
                        F.concat(F.lit("b"), ((s / 2).cast("int") % 3).cast("string")).alias("batch"),
                        F.concat(F.lit("r"), (s % 2).cast("string")).alias("run")))

    def de(self) -> DataFrame:
        """Stand-in differential-expression rows: contrast x method x gene."""
        odd = F.col("l_suppkey") % 2 == 1
        q = F.col("l_quantity")
        means = (self.lineitem
                 .groupBy(F.col("l_linestatus").alias("contrast_id"),
                          F.col("l_returnflag").alias("method"),
                          F.col("l_partkey").alias("gene_id"))
                 .agg(F.sum(F.when(odd, q)).alias("sa"), F.count_if(odd).alias("na"),
                      F.sum(F.when(~odd, q)).alias("sb"), F.count_if(~odd).alias("nb"))
                 .where("na > 0 and nb > 0"))
        a, b = F.col("sa") / F.col("na"), F.col("sb") / F.col("nb")
        z = (a - b) / 8.0
        p = F.greatest(F.round(F.exp(-z * z / 2.0), 10), F.lit(1e-10))
        return means.select(
            "contrast_id", "method", "gene_id",
            F.round(F.log2(a / b), 8).alias("log2fc"),
            F.least(p, F.lit(1.0)).alias("p_value"),
            F.least(F.lit(1.0), p * 1.5).alias("padj"),
            ((a + b) / 2.0).alias("base_mean"))

    def scores(self) -> DataFrame:
        n = F.col("n_chars")
        return (self.labels.join(self.documents.select("doc_id", "n_chars"), "doc_id")
                .select(F.col("doc_id").alias("id"), F.col("quality").alias("y"),
                        (n / (n + 2000.0)).alias("score"),
                        (F.pmod(n * 37, F.lit(1009)) / 1009.0).alias("risk_old"),
                        (F.pmod(n * 53 + F.col("quality") * 211, F.lit(1009)) / 1009.0).alias("risk_new")))

    def clinical(self) -> DataFrame:
        """Per customer: days between first and last order, event = some order has status F."""
        return (self.orders.groupBy(F.col("o_custkey").alias("sample_id"))
                .agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("os_time"),
                     F.max((F.col("o_orderstatus") == "F").cast("int")).alias("os_event")))

    def quant(self) -> DataFrame:
        return (self.lineitem.join(self.part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
                .groupBy((F.col("l_suppkey") % 24).cast("int").alias("sample_id"),
                         F.concat_ws(".", F.col("l_partkey").cast("string"),
                                     F.col("l_linenumber").cast("string")).alias("tx_id"))
                .agg(F.max("p_size").cast("double").alias("length"),
                     F.max(F.col("p_size") + 10).cast("double").alias("eff_length"),
                     F.sum("l_quantity").alias("num_reads"),
                     F.round(F.sum("l_tax"), 4).alias("tpm")))

    def tx2gene(self) -> DataFrame:
        return (self.lineitem.select("l_partkey", "l_linenumber").distinct()
                .join(self.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
                .select(F.concat_ws(".", F.col("l_partkey").cast("string"),
                                    F.col("l_linenumber").cast("string")).alias("tx_id"),
                        F.concat_ws("-", "p_brand", F.pmod("l_partkey", F.lit(50)).cast("string")).alias("gene_id")))

    def gene_sets(self) -> DataFrame:
        return self.part.select(F.concat_ws(" ", "p_type", "p_brand").alias("pathway"),
                                F.col("p_partkey").alias("gene_id"))


SQL = {
    "counts": """counts AS (
  SELECT l_returnflag AS dataset_id, l_partkey AS gene_id, CAST(l_suppkey % 24 AS INTEGER) AS sample_id,
         CAST(sum(l_quantity) AS BIGINT) AS count
  FROM lineitem GROUP BY 1, 2, 3)""",
    "samples": """samples AS (
  SELECT dataset_id, sample_id,
         CASE WHEN sample_id % 2 = 0 THEN 'control' ELSE 'treated' END AS condition,
         'b' || CAST((sample_id // 2) % 3 AS VARCHAR) AS batch,
         'r' || CAST(sample_id % 2 AS VARCHAR) AS run
  FROM (SELECT DISTINCT l_returnflag AS dataset_id, CAST(l_suppkey % 24 AS INTEGER) AS sample_id FROM lineitem))""",
    "dense": """genes_u AS (SELECT DISTINCT dataset_id, gene_id FROM counts),
samples_u AS (SELECT DISTINCT dataset_id, sample_id FROM counts),
dense AS (
  SELECT g.dataset_id, g.gene_id, s.sample_id, coalesce(c.count, 0) AS count
  FROM genes_u g JOIN samples_u s ON g.dataset_id = s.dataset_id
  LEFT JOIN counts c ON c.dataset_id = g.dataset_id AND c.gene_id = g.gene_id AND c.sample_id = s.sample_id)""",
    "gstats": """gstats AS (
  SELECT dataset_id, gene_id, count(*) AS n, sum(count) AS total, avg(count) AS mean, var_samp(count) AS var,
         stddev_samp(count) AS sd, count(*) FILTER (WHERE count = 0) AS zeros
  FROM dense GROUP BY 1, 2)""",
    "libs": """libs AS (
  SELECT dataset_id, sample_id, CAST(sum(count) AS DOUBLE) AS lib, count(*) FILTER (WHERE count > 0) AS detected
  FROM dense GROUP BY 1, 2)""",
    "de": """de AS (
  SELECT contrast_id, method, gene_id, round(log2(a / b), 8) AS log2fc, least(p, 1.0) AS p_value,
         least(1.0, p * 1.5) AS padj, (a + b) / 2.0 AS base_mean
  FROM (SELECT *, greatest(round(exp(-((a - b) / 8.0) * ((a - b) / 8.0) / 2.0), 10), 1e-10) AS p
        FROM (SELECT l_linestatus AS contrast_id, l_returnflag AS method, l_partkey AS gene_id,
                     sum(l_quantity) FILTER (WHERE l_suppkey % 2 = 1) / count(*) FILTER (WHERE l_suppkey % 2 = 1) AS a,
                     sum(l_quantity) FILTER (WHERE l_suppkey % 2 = 0) / count(*) FILTER (WHERE l_suppkey % 2 = 0) AS b
              FROM lineitem GROUP BY 1, 2, 3
              HAVING count(*) FILTER (WHERE l_suppkey % 2 = 1) > 0 AND count(*) FILTER (WHERE l_suppkey % 2 = 0) > 0)))""",
    "scores": """scores AS (
  SELECT l.doc_id AS id, l.quality AS y, d.n_chars / (d.n_chars + 2000.0) AS score,
         ((d.n_chars * 37) % 1009) / 1009.0 AS risk_old,
         ((d.n_chars * 53 + l.quality * 211) % 1009) / 1009.0 AS risk_new
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
    "clinical": """clinical AS (
  SELECT o_custkey AS sample_id,
         CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS DOUBLE) AS os_time,
         max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS os_event
  FROM orders GROUP BY 1)""",
    "quant": """quant AS (
  SELECT CAST(l_suppkey % 24 AS INTEGER) AS sample_id, l_partkey || '.' || l_linenumber AS tx_id,
         CAST(max(p_size) AS DOUBLE) AS length, CAST(max(p_size + 10) AS DOUBLE) AS eff_length,
         sum(l_quantity) AS num_reads, round(sum(l_tax), 4) AS tpm
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)""",
    "tx2gene": """tx2gene AS (
  SELECT DISTINCT l_partkey || '.' || l_linenumber AS tx_id, p_brand || '-' || (l_partkey % 50) AS gene_id
  FROM lineitem JOIN part ON p_partkey = l_partkey)""",
    "gene_sets": """gene_sets AS (
  SELECT p_type || ' ' || p_brand AS pathway, p_partkey AS gene_id FROM part)""",
}

NEEDS = {"dense": ["counts"], "gstats": ["counts", "dense"], "libs": ["counts", "dense"]}


def with_views(names: str, *ctes: str) -> str:
    """``WITH`` clause for the named views (dependencies first) and further CTEs."""
    seen: list[str] = []
    for name in names.split():
        for dep in [*NEEDS.get(name, []), name]:
            if dep not in seen:
                seen.append(dep)
    return "WITH " + ",\n".join([SQL[n] for n in seen] + list(ctes)) + "\n"
