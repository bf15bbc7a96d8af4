import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longomics.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 4000
    pdf = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.8, "hot", rng.choice(list("abc"), n)),
        "id": np.arange(n),
        "v": np.round(rng.random(n), 2),
    })
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_row_numbers_match_pandas(skewed):
    pdf, df = skewed
    got = ordered.row_numbers(df, ["g"], ["v", "id"], "rn").toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"]).groupby("g").cumcount().sort_index() + 1
    assert (got["rn"].to_numpy() == want.to_numpy()).all()


def test_hot_group_spans_blocks(spark, skewed):
    _, df = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = ordered.block_order(df, ["g"], ["v", "id"])
        assert blocks.where("g = 'hot'").select(ordered.BLOCK).distinct().count() > 1
        got = (ordered.scan(blocks, ["g"], ["v", "id"], {"s": ("sum", "v"), "m": ("min", "v")},
                            reverse=True).toPandas())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for _, part in got.groupby("g"):
        part = part.sort_values(["v", "id"], ascending=False)
        assert np.allclose(part["v"].cumsum(), part["s"])
        assert np.allclose(part["v"].cummin(), part["m"])


def test_tie_ranks(skewed):
    pdf, df = skewed
    got = ordered.tie_ranks(df, ["g"], "v").toPandas().set_index(["g", "v"])["rank_avg"]
    pdf = pdf.assign(r=pdf.groupby("g")["v"].rank(method="average"))
    want = pdf.groupby(["g", "v"])["r"].first()
    assert np.allclose(got.sort_index(), want.sort_index())


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = ordered.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.95}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float),
                           np.quantile(part["v"], [0.1, 0.5, 0.95]))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(p)] + [("c", 9, None)],
                               "g string, i int, p double")
    got = ordered.benjamini_hochberg(df, ["g"], "p", "q").orderBy("i").toPandas()
    order = np.argsort(p)
    raw = np.array(p)[order] * len(p) / np.arange(1, len(p) + 1)
    want = np.empty(len(p))
    want[order] = np.minimum.accumulate(raw[::-1])[::-1]
    assert np.allclose(got["q"][:6], want)
    assert np.isnan(got["q"][6])
