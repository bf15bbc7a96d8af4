"""The penalised Cox model against the optimality conditions of its objective, with plain loops over risk sets."""

import numpy as np
import pytest

from longomics.operators import survival
from longomics.plans import biomarkers


def plain_gradient(time, event, x, beta):
    """Gradient of the mean negative Efron log-likelihood."""
    w, grad = np.exp(x @ beta), np.zeros(x.shape[1])
    for t in np.unique(time[event == 1]):
        dead, at = (time == t) & (event == 1), time >= t
        for f in np.arange(dead.sum()) / dead.sum():
            weight = w * at - f * w * dead
            grad += weight @ x / weight.sum()
        grad -= x[dead].sum(0)
    return grad / len(time)


def study(spark, genes, n, seed, signal=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, genes)) + 0.5 * rng.normal(size=(n, 1))
    time = np.ceil(rng.exponential(1 / np.exp(0.8 * x[:, :signal].sum(1))) * 6)
    event = (rng.random(n) < 0.7).astype(int)
    rows = [(f"g{j:03d}", i, float(time[i]), int(event[i]), float(3.0 + 2.0 * x[i, j])) for j in range(genes) for i in range(n)]
    df = spark.createDataFrame(rows, "gene_id string, sample_id int, time double, event int, value double").cache()
    return df, time, event, (x - x.mean(0)) / x.std(0)


@pytest.mark.parametrize("genes, n, alpha, ratio", [(6, 70, 0.15, 1.0), (40, 25, 0.15, 0.7)])
def test_solution_meets_the_optimality_conditions(spark, genes, n, alpha, ratio):
    df, time, event, x = study(spark, genes, n, 4)
    coefs, scores = survival.cox_lasso(df, alpha, ratio)
    beta = np.array([r["coef"] for r in coefs.orderBy("gene_id").collect()])
    assert 0 < np.count_nonzero(beta) < genes and beta[0] > 0
    slope = plain_gradient(time, event, x, beta) + alpha * (1 - ratio) * beta
    on = beta != 0
    assert np.abs(slope[on] + alpha * ratio * np.sign(beta[on])).max() < 1e-4
    assert np.abs(slope[~on]).max() <= alpha * ratio + 1e-4
    got = {r["sample_id"]: r["score"] for r in scores.collect()}
    assert max(abs(got[i] - x[i] @ beta) for i in range(n)) < 1e-6


def test_defined_cases(spark):
    df, *_ = study(spark, 3, 20, 5)
    assert {r["coef"] for r in survival.cox_lasso(df, 50.0)[0].collect()} == {0.0}
    flat = survival.cox_lasso(df.selectExpr("gene_id", "sample_id", "time", "0 AS event", "1.0D AS value"))
    assert {r["coef"] for r in flat[0].collect()} == {0.0} and flat[1].count() == 20
    empty = survival.cox_lasso(df.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_panel_keeps_the_signal(spark):
    df, *_ = study(spark, 12, 60, 6)
    out = biomarkers.cox_lasso_panel(df, 0.1)
    assert {"g000", "g001"} <= {r["gene_id"] for r in out["panel"].collect()}
    assert out["c_index"].first()["c_index"] > 0.7
