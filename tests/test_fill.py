"""Filled cells: the three ways to fill give the same rows, and none gathers many cells in one row."""

import pytest

from longomics.operators import moments


@pytest.mark.parametrize("few, plain", [(3, 0), (0, 0), (3, 1000)])
@pytest.mark.parametrize("turned", [False, True])
def test_fill_is_the_same_in_every_form(spark, monkeypatch, few, plain, turned):
    # Two datasets, three short ids and ten long ones; nulls, a repeated cell and a cell of an unlisted sample.
    cells = [("a", i % 3 if not turned else i, i if not turned else i % 3, float(i)) for i in range(10) if i % 4]
    cells += [("b", 1, 1, 5.0), ("b", 1, 1, 7.0), ("b", 2, 1, None), ("b", None, 1, 3.0), ("b", 1, None, 4.0), (None, 1, 1, 2.0)]
    df = spark.createDataFrame(cells, "dataset_id string, sample_id int, gene_id int, count double")
    samples = df.where("sample_id IS NULL OR sample_id <> 2").select("dataset_id", "sample_id")
    want = {}
    for d in {c[0] for c in cells if c[0]}:
        for s in {c[1] for c in cells if c[0] == d and c[1] != 2}:
            for g in {c[2] for c in cells if c[0] == d}:
                found = [c[3] for c in cells if c[:3] == (d, s, g) and c[3] is not None]
                want[d, g, s] = max(found, default=0.0)
    monkeypatch.setattr(moments, "FEW", few)
    monkeypatch.setattr(moments, "PLAIN_CELLS", plain)
    filled = moments.densify(df, samples=samples)
    got = [((r["dataset_id"], r["gene_id"], r["sample_id"]), r["count"]) for r in filled.collect()]
    assert len(got) == len(want) and dict(got) == want
    if few and not plain:
        assert "_k" not in filled._jdf.queryExecution().optimizedPlan().toString()
