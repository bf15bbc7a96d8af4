"""Stored results: what is written comes back whole, in order, and anything else is refused."""

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from longomics import sinks
from longomics.operators import de


@pytest.fixture()
def result(spark):
    genes = spark.range(40).select(F.col("id").alias("gene_id"), (F.col("id") % 7).cast("double").alias("score"))
    none = genes.where("false")
    return {"ranking": genes, "panel": genes.limit(5), "panel_curve": none, "oof": genes, "fold_panels": genes, "fold_metrics": none}


def test_result_comes_back(spark, tmp_path, result):
    path = str(tmp_path / "r")
    sinks.save_result("biomarkers", result, path)
    got = sinks.load_result(spark, path, "biomarkers")
    assert set(got) == set(result) and got["panel_curve"].count() == 0
    assert sorted(got["ranking"].collect()) == sorted(result["ranking"].collect())
    # A second save is the one that is read; the tables of the first stay for its readers.
    sinks.save_result("biomarkers", result | {"ranking": result["ranking"].where("gene_id < 3")}, path)
    assert sinks.load_result(spark, path, "biomarkers")["ranking"].count() == 3 and got["ranking"].count() == 40


def test_unfinished_and_changed_results_are_refused(spark, tmp_path, result):
    path = tmp_path / "r"
    sinks.save_result("biomarkers", result, str(path))
    with pytest.raises(ValueError, match="not 'optimisation'"):
        sinks.load_result(spark, str(path), "optimisation")
    with pytest.raises(ValueError, match="lacks"):
        sinks.save_result("biomarkers", {"ranking": result["ranking"]}, str(path))
    with pytest.raises(ValueError, match="one of"):
        sinks.save_result("unknown", result, str(path))
    broken = result | {"oof": result["oof"].withColumn("bad", F.raise_error(F.lit("cut short")))}
    with pytest.raises(Exception, match="cut short"):
        sinks.save_result("biomarkers", broken, str(path))
    assert sinks.load_result(spark, str(path), "biomarkers")["oof"].count() == 40  # the save before it still stands
    folder = next((path / "tables").glob("*/oof"))
    row = json.loads(next(x for f in (path / "manifest").glob("*.json") for x in Path(f).read_text().splitlines() if '"oof"' in x))
    assert row["n_rows"] == 40 and row["version"] == sinks.RESULT_VERSION
    shutil.copytree(path / row["folder"], tmp_path / "kept")
    result["oof"].where("gene_id > 3").write.mode("overwrite").parquet(str(path / row["folder"]))
    with pytest.raises(ValueError, match="not as it was saved"):
        sinks.load_result(spark, str(path), "biomarkers")
    assert folder.exists()


def test_order_is_kept_over_many_files(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("score")).repartition(6)
    path = str(tmp_path / "o")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.save_ordered(rows, path, ["-score", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(path).glob("*.parquet"))) > 2
    got = [(r.score, r.id) for r in sinks.load_ordered(spark, path).orderBy("position").collect()]
    assert got == sorted(((r.score, r.id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert sinks.load_ordered(spark, path).agg(F.max("position")).first()[0] == 4999


def test_tools_of_many_files(spark, tmp_path):
    headers = {"deseq2": '"","baseMean","log2FoldChange","lfcSE","stat","pvalue","padj"', "edger": "gene_id,logFC,logCPM,F,PValue,FDR",
               "limma": "gene_id,logFC,AveExpr,t,P.Value,adj.P.Val,B", "wilcoxon": "gene_id,logFC,pvalue,padj"}
    for tool, header in headers.items():
        for k in range(3):
            (tmp_path / f"{tool}-{k}.csv").write_text("\n" * k + header + "\nx,1,2,3,4,5\n")
    (tmp_path / "other-0.csv").write_text("a,b\n")
    got = {r.file.rsplit("/", 1)[1].rsplit("-", 1)[0]: r.tool for r in de.detect_tools(spark, str(tmp_path)).collect()}
    assert got == {t: t for t in headers} | {"other": "deseq2"}
    for header in headers.values():
        assert de.detect_tool(header.replace('"', "").split(",")) in headers
