"""Queries over sinks and entry points: written results read back, tuned gene lists, gene-list preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..operators import de, ensemble, genetests, mlrecommend, thresholds
from ..runtime import scratch_path
from .queries_de import BH, DIRECTION, GRID, GRID_SQL, METHOD_DE, PI0, SIG, STD, VOTES, sig, std
from .queries_ml import benchmark, nation_profiles
from .registry import query, rnd, rounded, rq
from .views import with_views


@query("sink_de_outputs", with_views("de", STD, SIG) + "SELECT gene_id, 'significant' AS part FROM (SELECT CAST(gene_id AS VARCHAR) AS gene_id, s FROM sig) WHERE s UNION ALL SELECT CAST(gene_id AS VARCHAR), 'full' FROM sig")
def _(t):
    path = scratch_path(t.spark, "de-out")
    sinks.save_de_outputs(sig(t), path)
    read = lambda part: t.spark.read.option("header", True).csv(f"{path}/{part}").select("gene_id", F.lit(part).alias("part"))
    return read("significant").unionByName(read("full"))


@query("sink_ensemble_roundtrip", with_views("de", VOTES) + "SELECT contrast_id, gene_id, n AS n_votes FROM v WHERE n >= 2 AND greatest(up, down) = n")
def _(t):
    path = scratch_path(t.spark, "ensemble")
    sinks.save_tables({"consensus": ensemble.voting_ensemble(t.de(), 2, {"padj": 0.9, "lfc": 0.1})}, path)
    return sinks.load_tables(t.spark, path, ["consensus"])["consensus"].select("contrast_id", "gene_id", "n_votes")


@query("sink_direction_roundtrip", with_views("de", DIRECTION) + "SELECT contrast_id, gene_id, up AS n_up, down AS n_down FROM dir")
def _(t):
    path = scratch_path(t.spark, "directions")
    sinks.save_tables({"directions": ensemble.direction_table(t.de())}, path)
    return sinks.load_tables(t.spark, path, ["directions"])["directions"].select("contrast_id", "gene_id", "n_up", "n_down")


BEST = (PI0, GRID_SQL, "h AS (SELECT contrast_id, method, iteration, alpha, lfc, count(*) AS m, count(*) FILTER (WHERE p_value < alpha AND abs(log2fc) > lfc) AS n FROM de CROSS JOIN grid GROUP BY 1, 2, 3, 4, 5)",
        "s AS (SELECT h.*, CASE WHEN n > 0 THEN 1 - abs(least(1.0, pi0 * alpha * h.m / n) - 0.05) ELSE 0 END AS score FROM h JOIN pi ON pi.contrast_id = h.contrast_id AND pi.method = h.method)",
        "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contrast_id, method ORDER BY score DESC, iteration) AS k FROM s) WHERE k = 1)")


@query("tuning_optimised_genes", with_views("de", *BEST) + "SELECT de.contrast_id, de.method, gene_id, CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END AS direction FROM de JOIN b ON b.contrast_id = de.contrast_id AND b.method = de.method WHERE padj < alpha AND abs(log2fc) > b.lfc")
def _(t):
    d = t.de()
    got = thresholds.optimise(thresholds.fdr_trials(d, GRID, METHOD_DE), d, METHOD_DE)
    path = scratch_path(t.spark, "tuning")
    sinks.save_tables(got, path)
    return sinks.load_tables(t.spark, path, ["genes"])["genes"].select("contrast_id", "method", "gene_id", "direction")


@query("tuning_result_roundtrip", with_views("de", *BEST) + f"""SELECT s.contrast_id, s.method, CAST(s.iteration AS INTEGER) AS iteration, {rq('s.score', 'score')}, s.iteration = b.iteration AS is_best
FROM s JOIN b ON b.contrast_id = s.contrast_id AND b.method = s.method""")
def _(t):
    d = t.de()
    path = scratch_path(t.spark, "tuned")
    sinks.save_result("optimisation", thresholds.optimise(thresholds.fdr_trials(d, GRID, METHOD_DE), d, METHOD_DE), path)
    got = sinks.load_result(t.spark, path, "optimisation")
    best = got["best"].select(*METHOD_DE, F.col("iteration").alias("_best"))
    trials = got["trials"].join(best, METHOD_DE)
    return rounded(trials.select(*METHOD_DE, F.col("iteration").cast("int").alias("iteration"), "score", (F.col("iteration") == F.col("_best")).alias("is_best")), "score")


# A result in the layout of the biomarker flow whose tables both engines can work out.
BIOMARKERS = ("bp AS (SELECT gene_id, min(p_value) AS p FROM de GROUP BY 1)", "br AS (SELECT *, row_number() OVER (ORDER BY p, gene_id) AS k FROM bp)")


@query("biomarker_result_roundtrip", with_views("de", *BIOMARKERS) + """SELECT 'ranking' AS name, count(*) AS n, CAST(sum(k) AS BIGINT) AS checksum FROM br
UNION ALL SELECT 'panel', count(*), CAST(sum(k) AS BIGINT) FROM br WHERE k <= 25
UNION ALL SELECT 'panel_curve', count(*), CAST(sum(k) AS BIGINT) FROM br WHERE k <= 25 AND k >= 3
UNION ALL SELECT 'fold_panels', count(*), CAST(sum(k) AS BIGINT) FROM br CROSS JOIN (VALUES (0), (1), (2)) f(fold) WHERE k <= 25 AND k % 3 <> fold
UNION ALL SELECT 'fold_metrics', count(*), CAST(sum(quality) AS BIGINT) FROM labels GROUP BY 1
UNION ALL SELECT 'oof', count(*), CAST(sum(quality) AS BIGINT) FROM labels GROUP BY 1""")
def _(t):
    from ..operators import ordered
    best = t.de().groupBy("gene_id").agg(F.min("p_value").alias("p_value")).withColumn("all", F.lit(0))
    ranking = ordered.row_numbers(best, ["all"], ["p_value", "gene_id"], "consensus_rank").drop("all")
    panel = ranking.where("consensus_rank <= 25")
    folds = panel.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("consensus_rank % 3 <> fold")
    oof = t.labels.select("doc_id", F.col("quality").cast("long").alias("y"))
    path = scratch_path(t.spark, "biomarkers")
    sinks.save_result("biomarkers", {"ranking": ranking, "panel": panel, "panel_curve": panel.where("consensus_rank >= 3"),
                                     "oof": oof, "fold_panels": folds, "fold_metrics": oof}, path)
    got = sinks.load_result(t.spark, path, "biomarkers")
    out = None
    for name, frame in got.items():
        key = "y" if name in ("oof", "fold_metrics") else "consensus_rank"
        part = frame.agg(F.count(F.lit(1)).alias("n"), F.sum(key).cast("long").alias("checksum")).select(F.lit(name).alias("name"), "n", "checksum")
        out = part if out is None else out.unionByName(part)
    return out


@query("sink_ordered_results", with_views("de", VOTES, STD, SIG) + """SELECT 'voting' AS result, contrast_id AS part, CAST(gene_id AS VARCHAR) AS gene_id, row_number() OVER (ORDER BY contrast_id, n DESC, gene_id) - 1 AS position FROM v WHERE n >= 2 AND greatest(up, down) = n
UNION ALL SELECT 'weighted', contrast_id, CAST(gene_id AS VARCHAR), row_number() OVER (ORDER BY contrast_id, place, gene_id) - 1 FROM (SELECT contrast_id, gene_id, -round(ws, 6) AS place FROM v WHERE ws >= 1.45 AND greatest(up, down) / n >= 0.6) w
UNION ALL SELECT 'tool', '', CAST(gene_id AS VARCHAR), row_number() OVER (ORDER BY q, g, contrast_id, method) - 1 FROM (SELECT contrast_id, method, gene_id, padj AS q, CAST(gene_id AS VARCHAR) AS g FROM de) d""")
def _(t):
    votes = ensemble.voting_ensemble(t.de(), 2, {"padj": 0.9, "lfc": 0.1})
    weighted = rounded(ensemble.weighted_ensemble(t.de(), {"A": 0.5, "N": 0.3, "R": 0.2}, 1.45, {"padj": 0.9, "lfc": 0.1}, direction_threshold=0.6).select(
        "contrast_id", "gene_id", "weighted_score"), "weighted_score")
    tool = de.output_order(std(t)).withColumn("gene_id", F.col("gene_id").cast("string"))
    out = None
    for name, frame, order in [("voting", votes, ensemble.RESULT_ORDER["voting"]), ("weighted", weighted, ensemble.RESULT_ORDER["weighted"]),
                               ("tool", tool, [*de.OUTPUT_ORDER, "contrast_id", "method"])]:
        sinks.save_ordered(frame, path := scratch_path(t.spark, name), order)
        part = F.lit("") if name == "tool" else F.col("contrast_id")
        rows = sinks.load_ordered(t.spark, path).select(F.lit(name).alias("result"), part.alias("part"), F.col("gene_id").cast("string").alias("gene_id"), "position")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("significant_genes", with_views("de") + "SELECT contrast_id, method, gene_id, CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END AS direction FROM de WHERE padj < 0.6 AND abs(log2fc) > 0.3")
def _(t):
    return de.significant_genes(t.de(), 0.6, 0.3).select("contrast_id", "method", "gene_id", "direction")


@query("adjusted_significance", with_views("de", BH) + f"SELECT contrast_id, method, count(*) FILTER (WHERE q < 0.9) AS n_significant, {rq('min(q)', 'smallest_q')} FROM bh GROUP BY 1, 2")
def _(t):
    from ..operators import ordered
    d = ordered.benjamini_hochberg(t.de(), ["contrast_id", "method"], "p_value", "q")
    return d.groupBy("contrast_id", "method").agg(F.count_if(F.col("q") < 0.9).alias("n_significant"), rnd(F.min("q")).alias("smallest_q"))


@query("prepare_gene_list", with_views("dense", "k AS (SELECT dataset_id, gene_id FROM dense GROUP BY 1, 2 HAVING avg(count) >= 12)",
       "kl AS (SELECT k.* FROM k JOIN part ON p_partkey = gene_id WHERE p_size > 25)",
       "e AS (SELECT dataset_id FROM kl GROUP BY 1 HAVING count(*) >= 10)",
       "kk AS (SELECT * FROM kl WHERE dataset_id IN (SELECT dataset_id FROM e) UNION ALL SELECT * FROM k WHERE dataset_id NOT IN (SELECT dataset_id FROM e))",
       "f AS (SELECT d.* FROM dense d JOIN kk ON kk.dataset_id = d.dataset_id AND kk.gene_id = d.gene_id)",
       "l AS (SELECT dataset_id, sample_id, CAST(sum(count) AS DOUBLE) AS lib FROM f GROUP BY 1, 2)") +
       f"SELECT f.dataset_id, f.gene_id, f.sample_id, {rq('log2(count / lib * 1e6 + 1)', 'value')} FROM f JOIN l ON l.dataset_id = f.dataset_id AND l.sample_id = f.sample_id WHERE count > 0")
def _(t):
    genes = t.part.where("p_size > 25").select(F.col("p_partkey").alias("gene_id"))
    p = genetests.prepare_expression(t.counts(), t.samples(), 12.0, genes, "condition", "control", "treated")
    return rounded(p.select("dataset_id", "gene_id", "sample_id", "value"), "value")


@query("recommendation_importances")
def _(t):
    f = mlrecommend.model_features(nation_profiles(t))
    b = benchmark(t).join(t.supplier.select(F.col("s_suppkey").alias("dataset_id"), "s_nationkey"), "dataset_id").groupBy(
        F.col("s_nationkey").alias("dataset_id"), "method").agg(F.avg("f1_score").alias("f1_score"))
    m = mlrecommend.train(f, mlrecommend.best_method(b), folds=1)
    return t.spark.createDataFrame(mlrecommend.importances(m), "feature string, importance double").select("feature", rnd("importance", 4).alias("importance"))
