"""Batch corrections against plain sums on rows with nulls and repeated cells; the cells are made once or twice, not more."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longomics.operators import moments, normalize

CELLS = "dataset_id string, gene_id int, sample_id int, study string, count double"


def cells(spark):
    rng = np.random.default_rng(3)
    rows = [("a", g, s, f"s{s % 3}", float(rng.integers(0, 40))) for g in range(12) for s in range(11)]
    rows += [("a", 3, 4, "s1", 9.0), ("a", 5, 99, None, 7.0), ("a", 5, 98, "s2", None), (None, 1, 1, "s1", 2.0), ("a", 20, 1, "s1", 0.0)]
    return spark.createDataFrame(rows, CELLS), rows


def test_median_centre_by_positions(spark):
    df, rows = cells(spark)
    frame = normalize.median_centre(df)
    pdf = pd.DataFrame([r for r in rows if r[0]], columns=["d", "g", "s", "study", "count"])
    pdf["l"] = np.log2(pdf["count"] + 1)
    shift = pdf.groupby("g")["l"].transform("median") - pdf.groupby(["g", "study"])["l"].transform("median")
    pdf["v"] = np.maximum(2 ** (pdf["l"] + shift) - 1, 0).fillna(0)  # a cell without a count is clipped to 0
    want = sorted((g, s, v) for g, s, st, v in zip(pdf.g, pdf.s, pdf.study, pdf.v) if st is not None)
    got = sorted((r.gene_id, r.sample_id, r.value) for r in frame.collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-9, abs=1e-9)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "Join" not in plan


def test_posterior_settles_row_by_row(spark):
    rng = np.random.default_rng(4)
    one = lambda lo, hi: pd.Series(rng.uniform(lo, hi, 50))
    args = [pd.Series(rng.integers(1, 9, 50)).astype(float), one(-1, 1), one(0, 2), one(-1, 1), one(0, 1), one(2, 5), one(1, 4)]
    got = normalize.posterior(*args, 100, 1e-4)
    for i in range(50):
        n, g, d, g_bar, t2, a, b = (float(x[i]) for x in args)
        gs, ds = g, d
        for _ in range(100):
            old = gs, ds
            gs = (n * t2 * g + ds * g_bar) / (n * t2 + ds + 1e-300)
            ds = (0.5 * ((n - 1) * d + n * (g - gs) * (g - gs)) + b) / (n / 2.0 + a - 1.0)
            if max(abs(gs - old[0]), abs(ds - old[1])) < 1e-4:
                break
        assert (got["gs"][i], got["ds"][i]) == (gs, ds)
    df, _ = cells(spark)
    plan = normalize.combat(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(sequence" not in plan


def test_known_cells_are_not_searched_place_by_place(spark, monkeypatch):
    monkeypatch.setattr(moments, "PLAIN_CELLS", 0)
    df = spark.createDataFrame([("a", g, s, g + s) for g in range(40) for s in range(g % 9)], "dataset_id string, gene_id int, sample_id int, count long")
    filled = moments.densify(df)
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" in plan
    assert filled.count() == df.select("gene_id").distinct().count() * 8
    assert filled.agg(F.sum("count")).first()[0] == df.agg(F.sum("count")).first()[0]
