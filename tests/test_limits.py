"""No caps on numbers of methods, and no machine-local folder off a local master."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longomics import runtime
from longomics.functions.tails import chi2_even_upper
from longomics.operators import ensemble, outliers


def test_fisher_over_eighty_methods(spark):
    de = spark.range(80).select(F.lit("c").alias("contrast_id"), F.concat(F.lit("m"), "id").alias("method"), F.lit(1).alias("gene_id"),
                                F.lit(1.0).alias("log2fc"), F.lit(0.3).alias("p_value"), F.lit(0.3).alias("padj"))
    got = ensemble.combined_pvalues(de).first()
    assert got["combined_pvalue"] == pytest.approx(0.0401, abs=1e-4) and got["n_methods"] == 80
    assert 0 <= ensemble.combined_pvalues(de, "brown").first()["combined_pvalue"] <= 1


def test_erlang_sum_ends(spark):
    row = spark.range(1).select(chi2_even_upper(F.lit(0.0), F.lit(3)).alias("zero"), chi2_even_upper(F.lit(5000.0), F.lit(2000)).alias("far"),
                                chi2_even_upper(F.lit(3.0), F.lit(1)).alias("one"), chi2_even_upper(F.lit(3.0), F.lit(0)).alias("none")).first()
    assert row["zero"] == 1.0 and 0 < row["far"] < 1e-10 and row["one"] == pytest.approx(0.22313016) and row["none"] is None


def test_shared_folder_is_asked_for():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="share"):
        runtime.shared_dir(Session())


def test_correlation_vote(spark):
    rng = np.random.default_rng(3)
    base = rng.gamma(2.0, 2.0, size=60)
    x = np.stack([base + rng.normal(size=60) * 0.4 for _ in range(30)])
    x[7] = rng.permutation(x[7])
    x[rng.random(x.shape) < 0.2] = 0
    x[:, 5] = 0  # a gene without a cell is no gene of the table
    rows = [("d", g, f"s{s:02}", float(v)) for s, row in enumerate(x) for g, v in enumerate(row) if v]
    values = spark.createDataFrame(rows, "dataset_id string, gene_id int, sample_id string, value double")
    z = np.delete(x, 5, axis=1)
    want = (np.corrcoef((z - z.mean(0)) / z.std(0)).sum(axis=1) - 1) / 29
    parts = outliers.sample_structure(values)
    got = {r.sample_id: r.mean_correlation for r in outliers.mean_correlation(values, parts).collect()}
    assert [got[f"s{s:02}"] for s in range(30)] == pytest.approx(want.tolist(), abs=1e-9)
    assert len(outliers.correlation_outliers(values, parts).collect()) == 30
