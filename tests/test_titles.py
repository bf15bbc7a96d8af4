"""Title matching: no side is broadcast by a size estimated before its trigrams, at any size of the tables."""

from longomics.operators import cohort


def test_titles_are_joined_without_broadcast(spark):
    c = spark.createDataFrame([("d", f"liver_{i}") for i in range(4)], 'dataset_id string, column string')
    s = spark.createDataFrame([("d", f"GSM{i}", f"liver,rep{i}") for i in range(4)], "dataset_id string, sample_id string, title string")
    scores = cohort.title_scores(c, s)
    assert "Broadcast" not in scores._jdf.queryExecution().executedPlan().toString()
    seen, plain = [], cohort.cut
    try:
        cohort.cut = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df)
        got = {(r["column"], r["sample_id"]) for r in cohort.greedy_match(scores).collect()}
    finally:
        cohort.cut = plain
    assert got == {(f"liver_{i}", f"GSM{i}") for i in range(4)}
    assert seen and not any("Broadcast" in plan for plan in seen)
