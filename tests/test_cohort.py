import random

import pytest
from pyspark.sql import functions as F

from longomics.functions import text
from longomics.operators import cohort, pooling, thresholds
from longomics.sources import files


def test_greedy_match_equals_sequential(spark):
    rnd = random.Random(1)
    rows = [("d", f"c{i}", f"s{j}", rnd.randint(1, 6)) for i in range(8) for j in range(8) if rnd.random() < 0.7]
    got = {(r["column"], r["sample_id"]) for r in cohort.greedy_match(
        spark.createDataFrame(rows, "dataset_id string, column string, sample_id string, score int")).collect()}
    want, used_c, used_s = set(), set(), set()
    for _, c, s, k in sorted(rows, key=lambda r: (r[3], r[1], r[2]), reverse=True):
        if c not in used_c and s not in used_s:
            want.add((c, s))
            used_c.add(c)
            used_s.add(s)
    assert got == want


def test_scored_titles(spark):
    c = spark.createDataFrame([("d", "PS19_1", 0), ("d", "PS19_2", 1), ("d", "WT_1", 2)], "dataset_id string, column string, position int")
    t = spark.createDataFrame([("d", "G1", "PS19, rep1", "", 0), ("d", "G2", "PS19, rep2", "", 1), ("d", "G3", "WT, rep1", "", 2)],
                              "dataset_id string, sample_id string, title string, source string, position int")
    got = {r["column"]: (r["sample_id"], r["strategy"]) for r in cohort.align_titles(c, t).collect()}
    assert got == {"PS19_1": ("G1", "scored"), "PS19_2": ("G2", "scored"), "WT_1": ("G3", "scored")}


def test_characteristics_last_value_wins(spark):
    df = spark.createDataFrame([(["Cell Type: B", "cell type: T: x", "junk"],)], "a array<string>")
    assert df.select(text.characteristics(F.col("a")).alias("m")).first()["m"] == {"cell_type": "T: x"}


def test_pooling_guards(spark):
    c = spark.createDataFrame([("A", "g1", "s1", 3), ("B", "g2", "s1", 4)], "study string, gene_id string, sample_id string, count int")
    with pytest.raises(ValueError):
        pooling.merge_studies(c, "outer", 1)
    with pytest.raises(ValueError):
        pooling.merge_studies(c, "left", 0)


def test_file_name_scores():
    assert files.file_score("GSE1_raw_counts.csv.gz") > files.file_score("GSE1_fpkm.txt.gz") > 0
    assert files.file_score("sample_metadata.csv") is None


def test_grid_points_bounds():
    pts = thresholds.grid_points(5)
    assert len(pts) == 25 and pts[0] == (0.001, 0.0) and pts[-1] == (0.2, 2.0)


def test_differential_evolution_improves(spark):
    def evaluate(params):
        return spark.createDataFrame([(i, 1.0 - abs(a - 0.1) - abs(c - 1.0)) for i, (a, c) in enumerate(params)], "iteration int, score double")
    (a, c), score = thresholds.differential_evolution(evaluate, generations=6, population=8)
    assert score > 0.8 and abs(c - 1.0) < 0.3
