"""Registered queries beside their SQL. LONGOMICS_ALL=1 runs every pair, else a cross-section."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, table

CROSS_SECTION = ["cpm", "gene_moments", "median_ratio", "profile_full", "library_quality", "confounding", "de_summary",
                 "confusion_metrics", "set_overlap_pairwise", "benjamini_hochberg", "fisher_combined", "rank_aggregation",
                 "voting_ensemble", "tuning_fdr", "null_proportion", "auc", "decision_curve", "transcript_to_gene",
                 "source_salmon", "log_star", "pool_inner", "convert_ids_sum", "survival_table", "parse_barcodes",
                 "fastq_pairs", "welch_statistics", "concordance_index", "ratio_search", "panel_stability_phi"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("LONGOMICS_ALL") else CROSS_SECTION


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(entry.oracle_sql()[name])
    assert got == table([d[0] for d in rel.description], rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
