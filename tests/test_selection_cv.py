import numpy as np
import pytest
from pyspark.sql import functions as F

from longomics.operators import classify, selection
from longomics.plans import biomarkers


def cohort(spark, n, genes, signal, seed):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = rng.normal(size=(genes, n))
    x[:signal] += 1.6 * y
    rows = [("d", f"g{g:02d}", s, float(x[g, s]), int(y[s])) for g in range(genes) for s in range(n)]
    return spark.createDataFrame(rows, "dataset_id string, gene_id string, sample_id int, value double, y int").cache()


def test_noise_stays_near_chance_and_signal_is_found(spark):
    noise = biomarkers.fold_cv(cohort(spark, 60, 40, 0, 1), ["univariate_filter"], 4, 10, 3, classifiers=["logistic_regression"])
    assert abs(noise["fold_metrics"].agg(F.avg("auc")).first()[0] - 0.5) < 0.2
    found = biomarkers.fold_cv(cohort(spark, 60, 40, 3, 2), ["univariate_filter"], 3, 10, 3, classifiers=["logistic_regression"])
    assert found["fold_metrics"].agg(F.avg("auc")).first()[0] > 0.85
    assert found["oof"].count() == 60 and found["oof"].select("sample_id").distinct().count() == 60
    top = found["panels"].groupBy("gene_id").count().orderBy(F.desc("count")).limit(3).toPandas()["gene_id"]
    assert set(top) == {"g00", "g01", "g02"}


def test_selectors_rank_signal_first(spark):
    v = cohort(spark, 50, 12, 2, 3)
    for frame in (selection.univariate_filter(v, 2), selection.lasso(v, 5.0), selection.mrmr(v, 2), selection.rfe(v, 4, 0.3, trees=20)):
        best = set(frame.orderBy(F.desc("score")).limit(2).toPandas()["gene_id"])
        assert best & {"g00", "g01"}, frame.first()["method"]
    assert selection.resolve_methods(["de_filter"], False) == ["univariate_filter"]
    with pytest.raises(ValueError):
        selection.resolve_methods(["magic"], False)
    assert selection.panel_sizes(2, 9, 3) == [2, 5, 8, 9] and selection.panel_sizes(2, 8, 3) == [2, 5, 8] and selection.panel_sizes(5, 4, 1) == []


def test_only_undefined_selectors_are_skipped(spark, monkeypatch):
    v = cohort(spark, 20, 3, 1, 5)

    def undefined(*_):
        raise ValueError("one class")

    def broken(*_):
        raise MemoryError

    monkeypatch.setitem(selection.SELECTORS, "lasso", undefined)
    assert selection.run_selectors(v, ["lasso", "univariate_filter"], 2)[1] == ["univariate_filter"]
    monkeypatch.setitem(selection.SELECTORS, "lasso", broken)
    with pytest.raises(MemoryError):
        selection.run_selectors(v, ["lasso", "univariate_filter"], 2)


def test_folds_are_stratified_and_seeded(spark):
    s = cohort(spark, 50, 2, 0, 4).select("sample_id", "y").distinct()
    a, b = classify.stratified_folds(s, 5, 1, 1), classify.stratified_folds(s.repartition(7), 5, 1, 1)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    sizes = a.groupBy("fold", "y").count().toPandas()["count"]
    assert len(sizes) == 10 and (sizes == 5).all()
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, classify.stratified_folds(s, 5, 1, 2).collect()))


def test_intents():
    assert biomarkers.check_intent("diagnostic", ["expression", "group"])["minimum_samples"] == 30
    with pytest.raises(ValueError):
        biomarkers.check_intent("prognostic", ["expression"])


def test_boruta_confirms_signal_and_vectors_are_cut_in_order(spark):
    v = cohort(spark, 60, 15, 2, 9)
    got = {r["gene_id"]: r["score"] for r in selection.boruta(v, max_iter=12, trees=30).collect()}
    assert len(got) == 15 and got["g00"] == got["g01"] == 1.0
    assert max(s for g, s in got.items() if g not in ("g00", "g01")) < 1.0
    x = classify.sample_matrix(v, classify.gene_positions(v)).orderBy("sample_id").first()["features"]
    kept = classify.select_features(classify.sample_matrix(v, classify.gene_positions(v)), [7, 2]).orderBy("sample_id").first()["features"]
    assert list(kept.toArray()) == [x[7], x[2]]


def test_boruta_runs_all_rounds_with_trees_for_all_genes(spark, monkeypatch):
    v = cohort(spark, 20, 30, 0, 9)
    calls = []

    def grow(rows, y, features, seed, trees, columns):
        calls.append((len(features), seed, trees))
        return [seed] * trees

    # The first gene wins in every other round, so it is never decided; the others never win.
    monkeypatch.setattr(selection, "DRAWS", 400)
    monkeypatch.setattr(selection.wide, "grow", grow)
    monkeypatch.setattr(selection.wide, "importance", lambda forest: {0: float(forest[0] % 2), 1: 0.5})
    got = {r["gene_id"]: r["score"] for r in selection.boruta(v, seed=0).collect()}
    assert len({seed % 1_000_003 for _, seed, _ in calls}) == 100
    first = [c for c in calls if c[1] % 1_000_003 == 1]
    assert first[0][0] == 60 and len(first) == 4 and sum(c[2] for c in first) == selection.tree_number(30) == 154
    assert calls[-1][0] == 2 and sum(c[2] for c in calls if c[1] % 1_000_003 == 100) == selection.tree_number(1) == 28
    assert 1.0 >= got["g00"] > got["g01"] == got["g29"]
