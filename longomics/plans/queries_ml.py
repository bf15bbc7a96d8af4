"""Queries over feature selection, panels, classifiers, discovery and learned recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, coexpression, mlrecommend, moments, profile, selection
from ..runtime import cut
from . import biomarkers
from .queries_tests import patients
from .registry import query, rnd, rounded, rq


def cohort(t):
    """Brand expression per customer, label = any finished order."""
    return patients(t).select("dataset_id", "gene_id", "sample_id", "value", F.col("event").alias("y"))


def slots(t):
    """Brand expression per supplier slot: 24 samples."""
    from .queries_tests import brand_values
    return cut(brand_values(t).withColumn("y", F.col("y").cast("int")))


def part_slots(t):
    """Expression of every part per supplier slot: as many genes as parts, 24 samples."""
    c = (t.lineitem.groupBy(F.lit("all").alias("dataset_id"), F.col("l_partkey").alias("gene_id"), (F.col("l_suppkey") % 24).cast("int").alias("sample_id"))
         .agg(F.log2(F.sum("l_quantity") + 1.0).alias("value")))
    return cut(moments.densify(c, "value").withColumn("y", F.col("sample_id") % 2))


def out(df):
    return rounded(df.select("method", "gene_id", "score", "selected"), "score", digits=4)


@query("select_de_filter", "SELECT 'de_filter' AS method, p_brand AS gene_id, CAST(CASE WHEN max(p_size) >= 50 AND min(p_size) <= 1 THEN 1 ELSE 0 END AS DOUBLE) AS score, max(p_size) >= 50 AND min(p_size) <= 1 AS selected FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY 2")
def _(t):
    de = t.part.join(t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").groupBy(F.col("p_brand").alias("gene_id")).agg(F.max("p_size").alias("hi"), F.min("p_size").alias("lo")).where("hi >= 50 AND lo <= 1")
    return selection.de_filter(slots(t), de)


@query("select_univariate")
def _(t):
    return out(selection.univariate_filter(cohort(t), 10))


@query("select_lasso")
def _(t):
    return out(selection.lasso(part_slots(t)))


@query("select_elastic_net")
def _(t):
    return out(selection.lasso(part_slots(t), l1_ratio=0.5, method="elastic_net"))


@query("select_boruta")
def _(t):
    return out(selection.boruta(part_slots(t)))


@query("select_mrmr")
def _(t):
    return out(selection.mrmr(cohort(t), 5))


@query("select_rfe")
def _(t):
    return out(selection.rfe(part_slots(t)))


@query("select_shapley")
def _(t):
    return out(selection.shapley(part_slots(t), 50))


@query("select_coexpression_hubs")
def _(t):
    return out(selection.coexpression_hubs(part_slots(t), min_size=5))


@query("coexpression_modules")
def _(t):
    return coexpression.modules(part_slots(t), min_size=5)


@query("selector_consensus")
def _(t):
    r = selection.rank_genes(cohort(t), ["univariate_filter", "elastic_net"], 10)
    return rounded(r, "mean_rank", "consensus_score", digits=4)


@query("stability_selection")
def _(t):
    return selection.stability_selection(cohort(t), (1.0, 10.0), replicates=3)


@query("stratified_folds")
def _(t):
    f = classify.stratified_folds(cohort(t).select("sample_id", "y").distinct(), 5, 2)
    return f.groupBy("repeat", "fold", "y").agg(F.count(F.lit(1)).alias("n"))


@query("nested_cv")
def _(t):
    v = cohort(t)
    pos = cut(classify.gene_positions(v))
    x = classify.sample_matrix(v, pos)
    oof = classify.cross_validate(x, classify.stratified_folds(x, 3), trees=20)
    m = classify.fold_means(classify.threshold_metrics(oof, ["classifier", "repeat", "fold"]))
    return rounded(m, "accuracy", "auc", "f1", "sensitivity", "specificity", "auc_std", digits=4)


@query("best_classifier")
def _(t):
    v = cohort(t)
    x = classify.sample_matrix(v, cut(classify.gene_positions(v)))
    oof = classify.cross_validate(x, classify.stratified_folds(x, 3), ["logistic_regression", "random_forest"], trees=20)
    m = classify.fold_means(classify.threshold_metrics(oof, ["classifier", "repeat", "fold"]))
    return rounded(classify.best_classifier(m), "auc", "f1", digits=4)


@query("leave_one_out_cv")
def _(t):
    v = slots(t)
    x = classify.sample_matrix(v, cut(classify.gene_positions(v)))
    oof = classify.leave_one_out(x, ["logistic_regression"])
    return rounded(classify.threshold_metrics(oof, ["classifier"]), "accuracy", "sensitivity", "specificity", "f1", "auc", digits=4)


@query("forward_panel_curve")
def _(t):
    v = cohort(t)
    r = selection.rank_genes(v, ["univariate_filter"], 10)
    return rounded(selection.forward_curve(v, r, 2, 6, 2, 3, trees=20), "auc_mean", "auc_std", digits=4)


@query("panel_fold_cv")
def _(t):
    cv = biomarkers.fold_cv(cohort(t), ["univariate_filter"], 5, 10, 3, classifiers=["logistic_regression"], trees=20)
    return rounded(cv["fold_metrics"], "accuracy", "sensitivity", "specificity", "f1", "auc", digits=4)


PANELS_SQL = "pn AS (SELECT DISTINCT l_linenumber AS fold, p_brand AS gene_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45 AND l_quantity >= 49)"


def fold_panels(t):
    return (t.lineitem.where("l_quantity >= 49").join(t.part.where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
            .select(F.col("l_linenumber").alias("fold"), F.col("p_brand").alias("gene_id")).distinct())


@query("selection_frequency", "WITH " + PANELS_SQL + f" SELECT b.gene_id, {rq('count(pn.gene_id) / (SELECT count(DISTINCT fold) FROM pn)', 'selection_frequency')} FROM (SELECT DISTINCT p_brand AS gene_id FROM part) b LEFT JOIN pn ON pn.gene_id = b.gene_id GROUP BY 1")
def _(t):
    return rounded(selection.selection_frequency(fold_panels(t), t.part.select(F.col("p_brand").alias("gene_id"))), "selection_frequency")


@query("panel_stability_phi", "WITH " + PANELS_SQL + f""", k AS (SELECT CAST(count(DISTINCT fold) AS DOUBLE) AS m, (SELECT CAST(count(DISTINCT p_brand) AS DOUBLE) FROM part) AS p FROM pn), h AS (SELECT gene_id, count(*) AS h FROM pn GROUP BY 1),
a AS (SELECT max(m) AS m, max(p) AS p, sum(h) AS q, sum(h / m * (1 - h / m)) AS v FROM h, k)
SELECT {rq('1 - (m / (m - 1) * v / p) / (q / (m * p) * (1 - q / (m * p)))', 'phi')} FROM a""")
def _(t):
    p = cut(fold_panels(t))
    m, n = p.select("fold").distinct().count(), t.part.select("p_brand").distinct().count()
    return selection.panel_stability(p, n, m, replicates=100).select(rnd("phi").alias("phi"))


@query("panel_stability_interval")
def _(t):
    p = cut(fold_panels(t))
    m, n = p.select("fold").distinct().count(), t.part.select("p_brand").distinct().count()
    return rounded(selection.panel_stability(p, n, m, replicates=200), "phi", "ci_lower", "ci_upper", digits=4)


@query("signature_diagnostic")
def _(t):
    s = biomarkers.diagnostic_signature(cohort(t), ["Brand#1", "Brand#2", "Brand#3"])
    return rounded(s["signature"], "mu", "sd", "weight", digits=4)


@query("discover_biomarkers")
def _(t):
    d = biomarkers.discover(cohort(t), ["univariate_filter"], 2, 6, folds=3, classifiers=["logistic_regression"], trees=20, step=2)
    return rounded(d["panel"].select("gene_id", "consensus_rank", "consensus_score", "p_value", "panel_size", "size_method"), "consensus_score", "p_value", digits=4)


@query("validate_biomarkers")
def _(t):
    panel = t.part.select(F.col("p_brand").alias("gene_id")).distinct().where("gene_id <= 'Brand#13'")
    v = biomarkers.validate(panel, cohort(t), 3, classifiers=["logistic_regression", "svm"])
    return rounded(v["classifier_means"], "accuracy", "auc", "f1", "sensitivity", "specificity", "auc_std", digits=4)


def nation_profiles(t):
    c = (t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
         .groupBy(F.col("s_nationkey").alias("dataset_id"), F.col("l_partkey").alias("gene_id"), F.col("l_suppkey").cast("int").alias("sample_id"))
         .agg(F.sum("l_quantity").cast("bigint").alias("count")))
    s = c.select("dataset_id", "sample_id").distinct().withColumn("condition", (F.col("sample_id") % 2).cast("string"))
    return cut(profile.full_profile(c, s))


@query("model_features")
def _(t):
    f = mlrecommend.model_features(nation_profiles(t))
    return rounded(f, *[c for c in f.columns if c != "dataset_id"], digits=4)


BENCH_SQL = "b AS (SELECT l_suppkey AS dataset_id, l_returnflag AS method, avg(l_discount) AS f1 FROM lineitem GROUP BY 1, 2)"


def benchmark(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("dataset_id"), F.col("l_returnflag").alias("method")).agg(
        F.round(F.avg("l_discount"), 10).alias("f1_score"), F.lit(0.5).alias("auc"), F.lit(0.5).alias("tpr"), F.lit(0.1).alias("fdr"))


@query("best_method_labels", "WITH " + BENCH_SQL + " SELECT dataset_id, method AS best_method FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY round(f1, 10) DESC, method) AS k FROM b) WHERE k = 1")
def _(t):
    return mlrecommend.best_method(benchmark(t))


@query("learned_recommendation")
def _(t):
    f = mlrecommend.model_features(nation_profiles(t))
    b = benchmark(t).join(t.supplier.select(F.col("s_suppkey").alias("dataset_id"), "s_nationkey"), "dataset_id").groupBy(
        F.col("s_nationkey").alias("dataset_id"), "method").agg(F.avg("f1_score").alias("f1_score"))
    m = mlrecommend.train(f, mlrecommend.best_method(b), folds=1)
    return mlrecommend.recommend(m, f).select("dataset_id", "method", rnd("confidence", 4).alias("confidence"))


@query("assess_and_recommend")
def _(t):
    from . import flows
    r = flows.assess_and_recommend(t.counts(), t.samples(), ["condition", "batch", "run"])
    return r.select("dataset_id", "primary", "primary_score", "alternative", "third", "warnings")


@query("intent_defaults", "SELECT * FROM (VALUES ('diagnostic', 30), ('prognostic', 50), ('predictive', 40), ('monitoring', 20), ('exploratory', 20), ('translational', 20)) v(intent, minimum_samples) WHERE minimum_samples <= (SELECT count(DISTINCT o_custkey) FROM orders)")
def _(t):
    rows = [(k, v["minimum_samples"]) for k, v in biomarkers.INTENTS.items()]
    table = t.spark.createDataFrame(rows, "intent string, minimum_samples int")
    n = t.orders.agg(F.count_distinct("o_custkey").alias("n"))
    return table.crossJoin(F.broadcast(n)).where("minimum_samples <= n").drop("n")


@query("enhanced_diagnostic")
def _(t):
    v = cohort(t)
    d = biomarkers.discover(v, ["univariate_filter"], 2, 4, target_size=4, folds=3, classifiers=["logistic_regression"], trees=20, step=2)
    e = biomarkers.enhance(v, d, "diagnostic", bootstrap=200)
    return rounded(e["clinical"], "threshold", "sensitivity", "specificity", "youdens_j", "auc", "ppv", "npv", "train_auc", "optimism_gap", digits=4)
