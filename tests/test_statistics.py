import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longomics.functions import tails
from longomics.operators import clinical, ensemble, genetests, normalize, survival


def test_tail_values():
    assert tails.student_two_sided([2.0], [10.0])[0] == pytest.approx(0.07338803, rel=1e-6)
    assert tails.student_two_sided([40.0], [200.0])[0] == pytest.approx(
        np.exp(tails.log_betainc(100.0, 0.5, 200.0 / (200.0 + 1600.0))), rel=1e-12)
    assert tails.gamma_upper([1.0], [3.0])[0] == pytest.approx(np.exp(-3.0), rel=1e-12)
    assert tails.normal_isf([0.025])[0] == pytest.approx(1.959963984540054, rel=1e-12)
    assert tails.normal_isf([1e-15])[0] == pytest.approx(7.941345326170997, rel=1e-9)
    # 3 of 5 drawn marked out of 20 with 7 marked, by enumeration.
    from math import comb
    want = sum(comb(7, k) * comb(13, 5 - k) for k in (3, 4, 5)) / comb(20, 5)
    assert tails.hypergeom_upper(3, 20, 7, 5) == pytest.approx(want, rel=1e-10)
    assert tails.binomial_two_sided_half(8, 10) == pytest.approx(2 * (45 + 10 + 1) / 1024, rel=1e-10)


def test_chi2_closed_form_equals_incomplete_gamma(spark):
    df = spark.createDataFrame([(3.0, 1), (7.5, 2), (20.0, 3)], "s double, k int")
    got = df.select(tails.chi2_even_upper(F.col("s"), F.col("k")).alias("a"),
                    tails.chi2_upper("s", (2.0 * F.col("k"))).alias("b")).toPandas()
    assert np.allclose(got["a"], got["b"], rtol=1e-10)


def two_groups(spark, ref, base):
    rows = [("d", "g", f"r{i}", float(v), 1) for i, v in enumerate(ref)] + [("d", "g", f"b{i}", float(v), 0) for i, v in enumerate(base)]
    full = spark.createDataFrame(rows, "dataset_id string, gene_id string, sample_id string, value double, y int")
    return full.where("value <> 0"), full.select("dataset_id", "sample_id", "y")


def test_welch_with_absent_zeros(spark):
    ref, base = [3.0, 4.0, 0.0, 5.5], [1.0, 0.0, 2.0]
    v, labels = two_groups(spark, ref, base)
    got = genetests.welch(v, labels).first()
    a, b = np.var(ref, ddof=1) / 4, np.var(base, ddof=1) / 3
    t = (np.mean(ref) - np.mean(base)) / np.sqrt(a + b)
    df = (a + b) ** 2 / (a * a / 3 + b * b / 2)
    assert got["t"] == pytest.approx(t) and got["df"] == pytest.approx(df)
    assert got["p_value"] == pytest.approx(float(tails.student_two_sided([t], [df])[0]))


def test_mann_whitney_exact_and_ties(spark):
    v, labels = two_groups(spark, [4.0, 5.0, 6.0], [1.0, 2.0, 3.0])
    assert genetests.mann_whitney(v, labels).first()["p_value"] == pytest.approx(0.1)
    v, labels = two_groups(spark, [1.0, 2.0, 2.0, 3.0, 5.0], [2.0, 0.0, 0.0, 1.0])
    got = genetests.mann_whitney(v, labels).first()
    pooled = pd.Series([1, 2, 2, 3, 5, 2, 0, 0, 1])
    u = pooled.rank()[:5].sum() - 15
    ties = sum(k ** 3 - k for k in pooled.value_counts())
    sd = np.sqrt(20 / 12 * (10 - ties / 72))
    z = (max(u, 20 - u) - 10 - 0.5) / sd
    assert got["u"] == pytest.approx(u)
    assert got["p_value"] == pytest.approx(2 * float(tails.normal_upper([z])[0]))


def efron_fit(time, event, x):
    """Brute-force Cox with Efron ties for one or more covariates."""
    x = np.atleast_2d(x.T).T
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        grad, info = np.zeros_like(beta), np.zeros((len(beta), len(beta)))
        w = np.exp(x @ beta)
        for t in np.unique(time[event == 1]):
            risk, dead = time >= t, (time == t) & (event == 1)
            d = dead.sum()
            for i in range(d):
                ww = np.where(risk, w, 0) - i / d * np.where(dead, w, 0)
                m = (ww[:, None] * x).sum(0) / ww.sum()
                grad -= m
                info += (ww[:, None, None] * x[:, :, None] * x[:, None]).sum(0) / ww.sum() - np.outer(m, m)
            grad += x[dead].sum(0)
        beta = beta + np.linalg.solve(info, grad)
    return beta, info


@pytest.fixture(scope="module")
def cohort():
    rng = np.random.default_rng(5)
    n = 60
    x = rng.normal(size=(n, 2))
    time = np.ceil(rng.exponential(1 / np.exp(0.7 * x[:, 0] - 0.3 * x[:, 1])) * 8)
    event = (rng.random(n) < 0.7).astype(int)
    return time, event, x


def test_cox_univariate_matches_brute_force(spark, cohort):
    time, event, x = cohort
    rows = [(f"g{j}", i, float(time[i]), int(event[i]), float(x[i, j])) for j in (0, 1) for i in range(len(time))]
    df = spark.createDataFrame(rows, "gene_id string, sample_id int, time double, event int, value double")
    got = survival.cox_univariate(df).toPandas().set_index("gene_id")
    for j in (0, 1):
        beta, info = efron_fit(time, event, x[:, j])
        assert got.loc[f"g{j}", "coef"] == pytest.approx(beta[0], abs=1e-5)
        assert got.loc[f"g{j}", "se"] == pytest.approx(1 / np.sqrt(info[0, 0]), abs=1e-4)


def test_cox_multivariate_and_penalty(spark, cohort):
    time, event, x = cohort
    df = spark.createDataFrame([(i, float(time[i]), int(event[i]), [float(v) for v in x[i]]) for i in range(len(time))],
                               "sample_id int, time double, event int, x array<double>")
    beta, _ = efron_fit(time, event, x)
    assert np.allclose(survival.cox_fit(df, 2), beta, atol=1e-5)
    assert np.allclose(survival.cox_fit(df, 2, alpha=10.0), 0.0)


def test_brown_ignores_copies_of_a_method(spark):
    rng = np.random.default_rng(0)
    p = rng.random(50)
    one = spark.createDataFrame([("c", "a", i, 0.5, float(v), float(v)) for i, v in enumerate(p)],
                                "contrast_id string, method string, gene_id int, log2fc double, p_value double, padj double")
    f = ensemble.combined_pvalues(one, "fisher").toPandas().set_index("gene_id")["combined_pvalue"].sort_index()
    b = ensemble.combined_pvalues(one, "brown").toPandas().set_index("gene_id")["combined_pvalue"].sort_index()
    assert np.allclose(f, p) and np.allclose(b, p)
    both = one.unionByName(one.withColumn("method", F.lit("b")))
    b = ensemble.combined_pvalues(both, "brown").toPandas().set_index("gene_id")["combined_pvalue"].sort_index()
    assert np.allclose(b, p, rtol=1e-6)
    simple = ensemble.combined_pvalues(both, "brown", simple_brown=True).toPandas().set_index("gene_id")["combined_pvalue"].sort_index()
    stat, var, mean = -4 * np.log(p), 4 * 2 + 4 * 1.0, 4.0
    want = tails.gamma_upper(mean * mean / var / 2 * np.ones(50), stat / (var / (2 * mean)) / 2)
    assert np.allclose(simple, want, rtol=1e-6)


def test_combat_removes_batch_shift(spark):
    rng = np.random.default_rng(2)
    rows = [("d", g, f"s{b}{i}", f"b{b}", float(rng.normal(5 + g % 3 + 4 * b, 1 + b))) for g in range(40) for b in (0, 1) for i in range(8)]
    df = spark.createDataFrame(rows, "dataset_id string, gene_id int, sample_id string, study string, count double")
    out = normalize.combat(df).toPandas()
    means = out.groupby("study")["value"].mean()
    raw = df.toPandas().groupby("study")["count"].mean()
    assert abs(means["b0"] - means["b1"]) < 0.1 < abs(raw["b0"] - raw["b1"])
    spread = out.groupby(["study", "gene_id"])["value"].var().groupby("study").mean()
    assert 0.7 < spread["b0"] / spread["b1"] < 1.4


def test_bootstrap_interval_is_deterministic_and_covers(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(a), float(np.round(rng.normal(a), 2))) for a in y], "y int, score double")
    one, two = clinical.bootstrap_auc(df, replicates=300).first(), clinical.bootstrap_auc(df.repartition(5), replicates=300).first()
    assert one["ci_lower"] == two["ci_lower"] and one["ci_upper"] == two["ci_upper"]
    assert one["ci_lower"] < one["point_estimate"] < one["ci_upper"]
    with pytest.raises(ValueError):
        clinical.bootstrap_auc(df, ci=0.2)
