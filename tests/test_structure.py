import numpy as np
import pytest
from pyspark.sql import functions as F

from longomics.operators import outliers, selection, structure
from longomics.operators.moments import densify


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(11)
    x = np.where(rng.random((80, 12)) < 0.3, 0.0, rng.gamma(2, 2, (80, 12)))
    rows = [("d", g, s, float(x[g, s])) for g in range(80) for s in range(12) if x[g, s] != 0]
    return x, spark.createDataFrame(rows, "dataset_id string, gene_id int, sample_id int, value double")


def scaled(x):
    sd = x.std(1, keepdims=True)
    return ((x - x.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1)).T


def test_components_match_numpy(matrix):
    x, df = matrix
    z = scaled(x)
    val = np.sort(np.linalg.eigvalsh(z @ z.T))[::-1]
    got = outliers.principal_components(df).orderBy("sample_id").toPandas()
    assert np.allclose(got["ratios"].iloc[0], np.clip(val, 0, None) / val.sum(), atol=1e-9)
    s = np.vstack(got["scores"])
    assert np.allclose(s @ s.T, z @ z.T, atol=1e-8)


def test_leading_components_of_more_samples_than_columns(matrix, monkeypatch):
    """Fewer columns than samples, several blocks: the leading values and scores still agree."""
    x, df = matrix
    monkeypatch.setattr(structure, "SAMPLE_BLOCK", 5)
    monkeypatch.setattr(structure, "GENE_BLOCK", 16)
    got = structure.components(df, outliers.sample_index(df), n_components=2, guard=8, rounds=7).orderBy("i").toPandas()
    z = scaled(x)
    val, vec = np.linalg.eigh(z @ z.T)
    val, vec = val[::-1], vec[:, ::-1]
    assert np.allclose(got["ratios"].iloc[0], (val / val.sum())[:2], rtol=1e-5)
    want = vec[:, :2] * np.sqrt(val[:2])
    want = want * np.where(want[np.abs(want).argmax(0), range(2)] < 0, -1, 1)
    assert np.allclose(np.vstack(got["scores"]), want, atol=1e-2)


def test_two_datasets_at_once_and_a_constant_one(spark, matrix):
    x, df = matrix
    other = df.where("sample_id < 7").withColumn("dataset_id", F.lit("e"))
    flat = spark.createDataFrame([("f", g, s, 2.0) for g in range(3) for s in range(4)], df.schema)
    both = outliers.principal_components(df.unionByName(other).unionByName(flat)).toPandas()
    for ds, n in (("d", 12), ("e", 7)):
        s = np.vstack(both[both.dataset_id == ds].sort_values("i")["scores"])
        z = scaled(x[(x[:, :n] != 0).any(1)][:, :n])
        assert np.allclose(s @ s.T, z @ z.T, atol=1e-8)
    assert np.allclose(np.vstack(both[both.dataset_id == "f"]["scores"]), 0.0, atol=1e-6)


def plain_covariance_determinant(x, h, rng, starts):
    best = None
    for _ in range(starts):
        keep, last = rng.permutation(len(x))[:x.shape[1] + 1], np.inf
        for _ in range(60):
            centre, cov = x[keep].mean(0), np.atleast_2d(np.cov(x[keep].T, bias=True))
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.pinv(cov), x - centre)
            keep = np.argsort(d, kind="stable")[:h]
            logdet = np.linalg.slogdet(cov)[1]
            if len(keep) == h and logdet == last:
                break
            last = logdet
        if best is None or logdet < best[0]:
            best = (logdet, d)
    return best[1]


def test_robust_covariance_matches_numpy(spark, monkeypatch):
    """Starts are tried on 120 of 200 samples; the steps over all samples then reach the optimum of all."""
    monkeypatch.setattr(outliers, "COVARIANCE_BLOCK", 64)
    monkeypatch.setattr(outliers, "TRIED", 120)
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(110, 2)) * [0.3, 0.2], rng.normal(size=(65, 2)) * [6, 4], 40 + rng.normal(size=(25, 2))))
    pcs = spark.createDataFrame([("d", k, k, [float(v) for v in x[k]]) for k in range(200)], "dataset_id string, sample_id int, i int, scores array<double>")
    raw = plain_covariance_determinant(x, 102, rng, 400)
    near = raw * outliers.chi2_quantile(0.5, 2) / np.median(raw) < outliers.chi2_quantile(0.025, 2)
    diff = x - x[near].mean(0)
    want = np.einsum("ij,jk,ik->i", diff, np.linalg.pinv(np.cov(x[near].T, bias=True)), diff)
    scores = outliers.elliptic_scores(pcs, starts=400, kept=8).cache()
    assert np.allclose(scores.orderBy("sample_id").toPandas()["score"], want, rtol=1e-8)
    flagged = outliers.flag_share(scores, 0.125).where("outlier").toPandas()["sample_id"]
    assert sorted(flagged) == list(range(175, 200))


def test_chi2_quantiles():
    assert outliers.chi2_quantile(0.5, 2) == pytest.approx(2 * np.log(2), rel=1e-12)
    assert outliers.chi2_quantile(0.025, 10) == pytest.approx(20.483177350807546, rel=1e-10)


def test_isolation_forest_of_genes_that_seldom_differ(spark, monkeypatch):
    """Most genes differ in one sample only, so most nodes fall back to all genes of their samples."""
    rng = np.random.default_rng(6)
    rows = [("d", g, int(rng.integers(0, 39)), 1.0) for g in range(300)] + [("d", 300 + g, 39, 50.0 + g) for g in range(200)]
    rows += [("d", 900, s, 1.0) for s in range(40)]
    values = spark.createDataFrame(rows, "dataset_id string, gene_id int, sample_id int, value double")
    monkeypatch.setattr(outliers, "DRAWS", 1)
    got = outliers.isolation_scores(values, outliers.sample_index(values), trees=30).orderBy(F.desc("score")).toPandas()
    assert len(got) == 40 and got["sample_id"].iloc[0] == 39 and got["score"].between(0, 1).all()
    assert got["score"].iloc[0] > got["score"].iloc[1] + 0.05


def test_isolation_paths_of_a_line(spark):
    """One gene: every split is a random cut of a line, so the far point is alone after about one cut."""
    rows = [("d", 0, s, float(s)) for s in range(1, 30)] + [("d", 0, 30, 400.0)]
    values = spark.createDataFrame(rows, "dataset_id string, gene_id int, sample_id int, value double")
    got = outliers.isolation_scores(values, outliers.sample_index(values), trees=200).toPandas().set_index("sample_id")["score"]
    assert got.idxmax() == 30 and got[30] > 0.75 and got.drop(30).max() < 0.65
    flat = spark.createDataFrame([("d", 0, s, 1.0) for s in range(6)], values.schema)
    assert outliers.isolation_scores(flat, outliers.sample_index(flat), trees=5).toPandas()["score"].round(9).tolist() == [0.5] * 6


def test_mahalanobis_and_lof_match_brute_force(matrix, monkeypatch):
    x, df = matrix
    pcs = outliers.principal_components(df)
    s = np.vstack(pcs.orderBy("sample_id").toPandas()["scores"])[:, :5]
    inv = np.linalg.pinv(np.cov(s.T))
    want = np.sqrt(np.einsum("ij,jk,ik->i", s - s.mean(0), inv, s - s.mean(0)))
    got = outliers.mahalanobis(pcs).orderBy("sample_id").toPandas()["distance"]
    assert np.allclose(got, want)
    z, k = scaled(x), 4
    d = np.linalg.norm(z[:, None] - z[None], axis=2)
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, 1)[:, :k]
    kd = np.take_along_axis(d, nn, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, nn, 1), kd[nn]).mean(1) + 1e-10)
    lof = lrd[nn].mean(1) / lrd
    for size, merged in ((2048, 32), (4, 2)):  # one pair of blocks, and several pairs merged in two steps
        monkeypatch.setattr(outliers, "NEAR_BLOCK", size)
        monkeypatch.setattr(outliers, "MERGED", merged)
        got = outliers.lof_scores(pcs, k).orderBy("sample_id").toPandas()["score"]
        assert np.allclose(got, lof, rtol=1e-5)


def test_planted_outlier_gets_the_votes(spark):
    rng = np.random.default_rng(4)
    x = rng.poisson(50, (120, 20)).astype(float)
    x[:, 7] = rng.poisson(900, 120) * rng.integers(0, 2, 120)
    counts = spark.createDataFrame([("d", g, s, int(x[g, s])) for g in range(120) for s in range(20) if x[g, s]],
                                   "dataset_id string, gene_id int, sample_id int, count bigint")
    votes = outliers.consensus_outliers(counts, counts.select("dataset_id", "gene_id", "sample_id", F.log2(F.col("count") + 1.0).alias("value")))
    top = votes.orderBy(F.desc("votes")).first()
    assert top["sample_id"] == 7 and top["votes"] >= 5 and top["is_outlier"]


def test_densify_keeps_values(matrix):
    x, df = matrix
    d = densify(df, "value").toPandas().pivot(index="gene_id", columns="sample_id", values="value")
    assert np.array_equal(d.to_numpy(), x[d.index])


def test_panel_size_rules():
    curve = [(1, 0.6), (2, 0.75), (3, 0.84), (4, 0.88), (5, 0.885), (6, 0.886), (7, 0.886), (8, 0.886)]
    assert selection.panel_size(curve, "argmax") == (6, "argmax")
    assert selection.panel_size([(3, .7), (4, .8), (5, .803), (6, .9)], "first_drop") == (4, "first_drop")
    size, how = selection.panel_size(curve, "kneedle")
    assert how == "kneedle" and 2 <= size <= 4
    assert selection.panel_size([(3, .7), (4, .7), (5, .7)], "kneedle") == (3, "argmax_fallback")
    with pytest.raises(ValueError):
        selection.panel_size(curve, "none")


def test_panel_stability_extremes(spark):
    same = spark.createDataFrame([(f, g) for f in range(5) for g in range(4)], "fold int, gene_id int")
    got = selection.panel_stability(same, 100, 5, 50).first()
    assert got["phi"] == pytest.approx(1.0) and got["label"] == "excellent"
    rng = np.random.default_rng(0)
    rand = spark.createDataFrame([(f, int(g)) for f in range(40) for g in rng.choice(100, 10, replace=False)], "fold int, gene_id int")
    got = selection.panel_stability(rand, 100, 40, 50).first()
    assert abs(got["phi"]) < 0.05 and got["label"] == "poor"
