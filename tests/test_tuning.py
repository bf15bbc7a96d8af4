"""Stability tuning against plain sets drawn with the same hashes."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from longomics.operators import thresholds

REPLICATES, SEED = 8, 42


@pytest.mark.parametrize("n_genes", [30, 900])  # every gene is below the level, and few are
def test_stability_of_perturbed_sets(spark, n_genes):
    rng = np.random.default_rng(5)
    rows = [("c", f"g{k:04}", float(p), float(x)) for k, (p, x) in enumerate(zip(rng.random(n_genes), rng.normal(size=n_genes)))]
    rows += [("c", "null", None, None)]
    de = spark.createDataFrame(rows, "contrast_id string, gene_id string, p_value double, log2fc double")
    points = [(0.05, 0.0), (0.5, 0.2), (1.1, 0.0), (0.0, 0.0)]
    hashes = de.select("gene_id", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("b")).select(
        "gene_id", "b", F.xxhash64("gene_id", "b", F.lit(SEED)).alias("h1"),
        F.pmod(F.xxhash64("gene_id", "b", F.lit(SEED + 7919)), F.lit(1 << 52)).alias("h2")).collect()
    h1, h2 = ({(r.gene_id, r.b): r[k] for r in hashes} for k in ("h1", "h2"))
    got = {r.iteration: (r.n_significant, r.score) for r in thresholds.stability_trials(de, points, ["contrast_id"], REPLICATES, SEED).collect()}
    for i, (alpha, lfc) in enumerate(points):
        base = {g for _, g, p, x in rows if p is not None and p < alpha and abs(x) > lfc}
        v, sets = max(1, len(base) // 10), []
        for b in range(REPLICATES):
            order = sorted(base, key=lambda g: (h1[g, b], g))
            gone = set(order[:v]) if len(base) > v else set()
            rest = ({r[1] for r in rows} - base) | gone
            sets.append((base - gone) | set(sorted(rest, key=lambda g: (h2[g, b], g))[:v]))
        score = np.mean([len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2)]) if base else 0.0
        assert got[i] == (len(base), pytest.approx(score, rel=1e-12))


def plain_score(rows, hashes):
    """Score of rows (gene, in the base set) drawn row by row; a gene that is held twice counts twice on one side."""
    base, v, held = [g for g, b in rows if b], 0, []
    v = max(1, len(base) // 10)
    for b in range(REPLICATES):
        order = sorted(base, key=lambda g: (hashes[g, b][0], g))
        gone = order[:v] if len(base) > v else []
        rest = [g for g, x in rows if not x] + gone
        held.append(order[len(gone):] + sorted(rest, key=lambda g: (hashes[g, b][1], g))[:v])
    shared = [[sum(g in set(y) for g in x) for y in held] for x in held]
    return np.mean([shared[i][j] / (shared[i][i] + shared[j][j] - shared[i][j]) for i in range(REPLICATES) for j in range(i + 1, REPLICATES)])


@pytest.mark.parametrize("repeated", [False, True])
def test_only_hashes_near_the_level_are_ranked(spark, monkeypatch, repeated):
    # 6,000 genes of which half are in the base set; repeated: the other half is one id, which no level of hashes holds.
    rows = [(f"g{k:05}" if k % 2 or not repeated else "one", bool(k % 2)) for k in range(6000)]
    de = spark.createDataFrame([("c", g, 0.01 if b else 0.5, 1.0) for g, b in rows], "contrast_id string, gene_id string, p_value double, log2fc double")
    hashes = {(r.gene_id, r.b): (r.h1, r.h2) for r in de.select("gene_id").distinct().select(
        "gene_id", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("b")).select(
        "gene_id", "b", F.xxhash64("gene_id", "b", F.lit(SEED)).alias("h1"),
        F.pmod(F.xxhash64("gene_id", "b", F.lit(SEED + 7919)), F.lit(1 << 52)).alias("h2")).collect()}
    ranked, number = [], thresholds.ordered.row_numbers
    monkeypatch.setattr(thresholds.ordered, "row_numbers", lambda df, *a: ranked.append(df.count()) or number(df, *a))
    got = thresholds.stability_trials(de, [(0.05, 0.0)], ["contrast_id"], REPLICATES, SEED).first()
    assert (got.n_significant, got.score) == (3000, pytest.approx(plain_score(rows, hashes), rel=1e-12))
    if not repeated:
        assert sum(ranked) < 3000 * REPLICATES


def test_rows_without_a_contrast_have_no_score(spark):
    rows = [(c, f"g{k}", 0.01 * k, 1.0) for c in ("c", None) for k in range(40)]
    de = spark.createDataFrame(rows, "contrast_id string, gene_id string, p_value double, log2fc double")
    got = {r.contrast_id: (r.n_significant, r.score) for r in thresholds.stability_trials(de, [(0.2, 0.0)], ["contrast_id"], REPLICATES, SEED).collect()}
    assert got[None] == (20, 0.0) and got["c"][0] == 20 and got["c"][1] > 0.5
