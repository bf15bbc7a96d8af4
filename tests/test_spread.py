import pytest
from pyspark.sql import functions as F

from longomics import runtime
from longomics.operators import classify, ensemble, moments, survival


def cells(spark, n=60):
    return spark.range(n * 5).selectExpr("'d' AS dataset_id", "concat('g', id % 5) AS gene_id", "CAST(id DIV 5 AS INT) AS sample_id",
                                         "CAST(id * id % 17 AS DOUBLE) AS value", "CAST((id DIV 5) % 2 AS INT) AS y")


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(moments, "PLAIN_CELLS", 10)
    monkeypatch.setattr(runtime, "TASK_ROWS", 15)
    some = cells(spark).where("value > 4")
    dense = moments.densify(some, "value")
    assert dense.rdd.getNumPartitions() >= 15
    known = {(r.gene_id, r.sample_id): r.value for r in some.collect()}
    got = {(r.gene_id, r.sample_id): r.value for r in dense.collect()}
    assert len(got) == dense.count() == 5 * len({s for _, s in known}) and all(v == known.get(k, 0.0) for k, v in got.items())


def test_sample_vectors_in_parts(spark, monkeypatch):
    values = cells(spark)
    positions = classify.gene_positions(values)
    plain = {r.sample_id: (r.y, list(r.features)) for r in classify.sample_matrix(values, positions).collect()}
    monkeypatch.setattr(runtime, "TASK_ROWS", 15)
    parted = classify.sample_matrix(values, positions)
    assert parted.rdd.getNumPartitions() == 300 // 15
    assert {r.sample_id: (r.y, list(r.features)) for r in parted.collect()} == plain


def test_small_tables_stay_with_spark(spark):
    assert runtime.spread(cells(spark), 300, "sample_id").rdd.getNumPartitions() == cells(spark).rdd.getNumPartitions()


def test_aligned_rows_are_computed_once(spark):
    clinical = spark.createDataFrame([(i, 10.0 + i if i != 3 else None, i % 2) for i in range(12)], "sample_id int, os_time double, os_event int")
    aligned = survival.align_clinical(cells(spark), clinical)
    assert "Join" not in aligned._jdf.queryExecution().executedPlan().toString()
    assert {r.sample_id for r in aligned.select("sample_id").distinct().collect()} == set(range(12)) - {3}
    with pytest.raises(ValueError, match="only 11 samples"):
        survival.align_clinical(cells(spark), clinical, 12)


def people(spark, n=80):
    return spark.range(n * 3).selectExpr("concat('g', id % 3) AS gene_id", "CAST(id DIV 3 AS INT) AS sample_id", "CAST((id DIV 3) * 7 % 11 + 1 AS DOUBLE) AS time",
                                         "CAST((id DIV 3) % 3 > 0 AS INT) AS event", "CAST((id * id + id DIV 3) % 13 AS DOUBLE) AS value")


def test_tied_deaths_are_summed_in_parts(spark, monkeypatch):
    cells = people(spark)
    plain = {r.gene_id: r for r in survival.cox_univariate(cells).collect()}
    coefs, _ = survival.cox_lasso(cells, 0.01)
    weights = {r.gene_id: r.coef for r in coefs.collect()}
    monkeypatch.setattr(survival, "TASK_DEATHS", 10)
    assert survival._dealt(cells, 53, "time").rdd.getNumPartitions() == 6
    for r in survival.cox_univariate(cells).collect():
        assert r.coef == pytest.approx(plain[r.gene_id].coef, abs=1e-9) and r.se == pytest.approx(plain[r.gene_id].se, abs=1e-9)
    coefs, _ = survival.cox_lasso(cells, 0.01)
    assert {r.gene_id: r.coef for r in coefs.collect()} == pytest.approx(weights, abs=1e-6)


def test_compared_ensembles_share_one_table(spark, monkeypatch):
    seen, real = [], ensemble.voting_ensemble
    monkeypatch.setattr(ensemble, "voting_ensemble", lambda de, *rest: seen.append(de) or real(de, *rest))
    raw = spark.range(240).selectExpr("'c' AS contrast_id", "concat('m', id % 3) AS method", "concat('g', id DIV 6) AS gene_id",
                                      "CAST(id % 7 - 3 AS DOUBLE) AS log2fc", "(id % 11 + 1) / 100 AS p_value", "(id % 11 + 1) / 90 AS padj")
    de = raw.groupBy("contrast_id", "method", "gene_id").agg(*[F.max(c).alias(c) for c in ("log2fc", "p_value", "padj")])
    assert ensemble.compare_ensembles(de).count() == 5
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
