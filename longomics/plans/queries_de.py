"""Queries over differential-expression results: standardising, comparing, consensus, tuning, clinical."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clinical, compare, de, ensemble, ordered, thresholds
from ..runtime import scratch_path
from .registry import query, rnd, rounded, rq
from .views import with_views

K = "contrast_id, gene_id"
STD = "std AS (SELECT contrast_id, method, gene_id, log2fc AS lfc, p_value AS p, padj AS q, base_mean AS bm FROM de)"
SIG = "sig AS (SELECT *, q < 0.3 AND abs(lfc) > 0.2 AS s FROM std)"


def raw_table(t, tool="deseq2"):
    """The de view under a tool's own column names."""
    names = {"deseq2": ("log2FoldChange", "pvalue", "padj", "baseMean"), "edger": ("logFC", "PValue", "FDR", "logCPM"),
             "limma": ("logFC", "P.Value", "adj.P.Val", "AveExpr")}[tool]
    d = t.de()
    return d.select("contrast_id", "method", F.col("gene_id").alias("GeneID"),
                    *[F.col(c).alias(n) for c, n in zip(["log2fc", "p_value", "padj", "base_mean"], names)])


def std(t):
    return de.standardise(raw_table(t), keep=["contrast_id", "method"])


def sig(t):
    return de.significance(std(t), 0.3, 0.2)


@query("de_detect_tool", with_views("de") + "SELECT tool, CAST(count(*) AS BIGINT) AS n_rows FROM de CROSS JOIN (VALUES ('deseq2'), ('edger'), ('limma'), ('wilcoxon')) v(tool) GROUP BY 1")
def _(t):
    d = raw_table(t)
    tables = [d.withColumn("lfcSE", F.lit(1.0)), raw_table(t, "edger").withColumn("LR", F.lit(1.0)),
              raw_table(t, "limma").withColumn("B", F.lit(1.0)), d.withColumnsRenamed({"log2FoldChange": "logFC"})]
    path = scratch_path(t.spark, "results")
    for k, table in enumerate(tables):
        table.write.option("header", True).csv(f"{path}/{k}")
    found = de.detect_tools(t.spark, f"{path}/*")
    lines = t.spark.read.text(f"{path}/*").groupBy(F.col("_metadata.file_path").alias("file")).agg((F.count(F.lit(1)) - 1).alias("n"))
    return found.join(lines, "file").groupBy("tool").agg(F.sum("n").alias("n_rows"))


@query("de_standardise", with_views("de", STD) + f"SELECT contrast_id, method, gene_id, {rq('lfc', 'log2_fold_change')}, {rq('p', 'p_value')}, {rq('q', 'adjusted_p_value')}, {rq('bm', 'base_mean')} FROM std")
def _(t):
    return rounded(std(t), "log2_fold_change", "p_value", "adjusted_p_value", "base_mean")


@query("de_significance", with_views("de", STD, SIG) + """SELECT contrast_id, method, gene_id, s AS is_significant,
CASE WHEN s AND lfc > 0 THEN 'up' WHEN s AND lfc < 0 THEN 'down' ELSE 'unchanged' END AS direction FROM sig""")
def _(t):
    return sig(t).select("contrast_id", "method", "gene_id", "is_significant", "direction")


@query("de_filter_by_threshold", with_views("de", STD) + """SELECT contrast_id, method, gene_id, q < 0.1 AND abs(lfc) > 0.5 AS is_significant FROM std""")
def _(t):
    return de.filter_by_threshold(sig(t), 0.1, 0.5).select("contrast_id", "method", "gene_id", "is_significant")


@query("de_tool_output", with_views("de", STD) + f"SELECT gene_id, {rq('pow(2.0, bm / 10)', 'base_mean', 5)}, q < 0.05 AS is_significant FROM std")
def _(t):
    raw = raw_table(t, "limma").withColumn("AveExpr", F.col("AveExpr") / 10)
    return de.tool_output(raw, "limma").select("gene_id", rnd("base_mean", 5).alias("base_mean"), "is_significant")


@query("de_summary", with_views("de", STD, SIG) + """SELECT contrast_id, method, count(*) AS n_tested, count(*) FILTER (WHERE s) AS n_significant,
count(*) FILTER (WHERE s AND lfc > 0) AS n_up, count(*) FILTER (WHERE s AND lfc < 0) AS n_down FROM sig GROUP BY 1, 2""")
def _(t):
    return de.summary(sig(t), ["contrast_id", "method"])


for _by, _order in {"padj": "q ASC", "pvalue": "p ASC", "lfc": "abs(lfc) DESC", "base_mean": "bm DESC"}.items():
    @query(f"de_top_genes_{_by}", with_views("de", STD, SIG) + f"SELECT gene_id, {rq('lfc', 'log2_fold_change')} FROM (SELECT * FROM sig ORDER BY {_order}, gene_id, contrast_id, method LIMIT 50)")
    def _(t, by=_by):
        top = de.top_genes(sig(t), 50, by, ties=("gene_id", "contrast_id", "method"))
        return rounded(top.select("gene_id", "log2_fold_change"), "log2_fold_change")


@query("de_top_significant", with_views("de", STD, SIG) + "SELECT contrast_id, method, gene_id FROM sig WHERE s ORDER BY q, gene_id, contrast_id, method LIMIT 30")
def _(t):
    top = de.top_genes(sig(t), 30, "padj", True, ("gene_id", "contrast_id", "method"))
    return top.select("contrast_id", "method", "gene_id")


@query("de_prefilter", with_views("counts") + """SELECT c.dataset_id, c.gene_id, c.sample_id, c.count FROM counts c JOIN
(SELECT dataset_id, gene_id FROM counts GROUP BY 1, 2 HAVING count(*) FILTER (WHERE count >= 40) >= 2) k ON k.dataset_id = c.dataset_id AND k.gene_id = c.gene_id""")
def _(t):
    return de.prefilter(t.counts(), 40, 2).select("dataset_id", "gene_id", "sample_id", "count")


@query("filter_genes", with_views("counts") + """SELECT c.dataset_id, c.gene_id, c.sample_id, c.count FROM counts c JOIN
(SELECT dataset_id, gene_id FROM counts GROUP BY 1, 2 HAVING sum(count) >= 200 AND count(*) FILTER (WHERE count >= 20) >= 5) k ON k.dataset_id = c.dataset_id AND k.gene_id = c.gene_id""")
def _(t):
    return de.filter_genes(t.counts(), 200, 5, 20).select("dataset_id", "gene_id", "sample_id", "count")


TRUTH = "truth AS (SELECT p_partkey AS gene_id, p_size > 25 AS is_de, CASE WHEN p_size % 2 = 0 THEN 'up' ELSE 'down' END AS expected_direction FROM part)"


def truth(t):
    return t.part.select(F.col("p_partkey").alias("gene_id"), (F.col("p_size") > 25).alias("is_de"),
                         F.when(F.col("p_size") % 2 == 0, "up").otherwise("down").alias("expected_direction"))


@query("confusion_metrics", with_views("de", STD, SIG, TRUTH, """c AS (SELECT contrast_id, method, CAST(count(*) FILTER (WHERE s AND is_de) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE s AND NOT is_de) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE NOT s AND is_de) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE NOT s AND NOT is_de) AS DOUBLE) AS tn FROM sig JOIN truth ON truth.gene_id = sig.gene_id GROUP BY 1, 2)""") +
       f"""SELECT contrast_id, method, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
{rq('tp / (tp + fn)', 'sensitivity')}, {rq('tn / (tn + fp)', 'specificity')}, {rq('tp / (tp + fp)', 'precision')}, {rq('fp / (tp + fp)', 'fdr')},
{rq('2 * tp / (2 * tp + fp + fn)', 'f1')}, {rq('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')} FROM c""")
def _(t):
    c = compare.confusion(sig(t), truth(t), ["contrast_id", "method"])
    return rounded(c, "sensitivity", "specificity", "precision", "fdr", "f1", "accuracy")


@query("set_overlap", with_views("de", STD, SIG, "g AS (SELECT contrast_id, gene_id, count(DISTINCT method) AS k FROM sig WHERE s GROUP BY 1, 2)") +
       f"SELECT contrast_id, CAST(3 AS BIGINT) AS n_sets, count(*) FILTER (WHERE k = 3) AS n_common, count(*) AS n_union, {rq('count(*) FILTER (WHERE k = 3) / count(*)', 'jaccard')} FROM g GROUP BY 1")
def _(t):
    return rounded(compare.overlap(sig(t).where("is_significant"), "method", ["contrast_id"]), "jaccard")


@query("set_overlap_pairwise", with_views("de", STD, SIG, "z AS (SELECT contrast_id, method, count(*) AS n FROM sig WHERE s GROUP BY 1, 2)",
       "sh AS (SELECT a.contrast_id, a.method AS x, b.method AS y, count(*) AS n FROM sig a JOIN sig b ON a.contrast_id = b.contrast_id AND a.gene_id = b.gene_id AND a.method < b.method WHERE a.s AND b.s GROUP BY 1, 2, 3)") +
       f"""SELECT sh.contrast_id, x AS set_a, y AS set_b, za.n AS size_a, zb.n AS size_b, sh.n AS n_shared, {rq('sh.n / (za.n + zb.n - sh.n)', 'jaccard')}
FROM sh JOIN z za ON za.contrast_id = sh.contrast_id AND za.method = x JOIN z zb ON zb.contrast_id = sh.contrast_id AND zb.method = y""")
def _(t):
    return rounded(compare.pairwise_overlap(sig(t).where("is_significant"), "method", ["contrast_id"]), "jaccard")


@query("cross_cohort_direction", with_views("de", STD, SIG, "d AS (SELECT contrast_id, method, gene_id, CASE WHEN lfc > 0 THEN 'up' ELSE 'down' END AS dir FROM sig WHERE s)",
       "j AS (SELECT coalesce(a.method, b.method) AS method, a.dir AS da, b.dir AS db FROM (SELECT * FROM d WHERE contrast_id = 'O') a FULL JOIN (SELECT * FROM d WHERE contrast_id = 'F') b ON a.method = b.method AND a.gene_id = b.gene_id)") +
       f"""SELECT method, count(*) FILTER (WHERE da IS NOT NULL AND db IS NOT NULL) AS n_common, count(*) FILTER (WHERE da = db) AS n_agree, count(*) FILTER (WHERE da <> db) AS n_disagree,
count(*) FILTER (WHERE db IS NULL) AS only_here, count(*) FILTER (WHERE da IS NULL) AS only_there, {rq('count(*) FILTER (WHERE da = db) / count(*) FILTER (WHERE da IS NOT NULL AND db IS NOT NULL)', 'agreement_fraction')} FROM j GROUP BY 1""")
def _(t):
    s = sig(t).where("is_significant")
    c = compare.cross_cohort(s.where("contrast_id = 'O'"), s.where("contrast_id = 'F'"), ["method"])
    return rounded(c.drop("binomial_p"), "agreement_fraction")


@query("cross_cohort_binomial", with_views("de", STD, SIG, "d AS (SELECT contrast_id, method, gene_id, CASE WHEN lfc > 0 THEN 'up' ELSE 'down' END AS dir FROM sig WHERE s)",
       "j AS (SELECT a.method, count(*) AS n, count(*) FILTER (WHERE a.dir = b.dir) AS k FROM (SELECT * FROM d WHERE contrast_id = 'O') a JOIN (SELECT * FROM d WHERE contrast_id = 'F') b ON a.method = b.method AND a.gene_id = b.gene_id GROUP BY 1)") +
       f"SELECT method, n AS n_common, k AS n_agree, {rq('CASE WHEN 2 * k = n THEN 1 ELSE least(1.0, 2 * list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0)) FOR i IN range(greatest(k, n - k), n + 1)])) END', 'binomial_p')} FROM j")
def _(t):
    s = sig(t).where("is_significant")
    c = compare.cross_cohort(s.where("contrast_id = 'O'"), s.where("contrast_id = 'F'"), ["method"])
    return rounded(c.select("method", "n_common", "n_agree", "binomial_p"), "binomial_p")


BH = """o AS (SELECT *, count(*) OVER w * 1.0 AS m, row_number() OVER (PARTITION BY contrast_id, method ORDER BY p_value, gene_id) AS r FROM de WINDOW w AS (PARTITION BY contrast_id, method)),
bh AS (SELECT contrast_id, method, gene_id, least(1.0, min(p_value * m / r) OVER (PARTITION BY contrast_id, method ORDER BY p_value DESC, r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM o)"""


@query("benjamini_hochberg", with_views("de", BH) + f"SELECT contrast_id, method, gene_id, {rq('q', 'q_value')} FROM bh")
def _(t):
    d = t.de().select("contrast_id", "method", "gene_id", "p_value")
    return ordered.benjamini_hochberg(d, ["contrast_id", "method"], "p_value", "q_value").select(
        "contrast_id", "method", "gene_id", rnd("q_value").alias("q_value"))


@query("average_rank", with_views("de", "r AS (SELECT *, row_number() OVER (PARTITION BY contrast_id, method ORDER BY p_value) AS k FROM de)") +
       f"SELECT contrast_id, method, {rq('p_value', 'p_value', 8)}, count(*) AS n, {rq('avg(k)', 'rank_avg')} FROM r GROUP BY 1, 2, p_value")
def _(t):
    r = ordered.tie_ranks(t.de(), ["contrast_id", "method"], "p_value")
    return r.select("contrast_id", "method", rnd("p_value", 8).alias("p_value"), "n", rnd("rank_avg").alias("rank_avg"))


DIRECTION = """dir AS (SELECT contrast_id, gene_id, count(*) FILTER (WHERE log2fc > 0) AS up, count(*) FILTER (WHERE NOT log2fc > 0) AS down,
  coalesce(string_agg(method, ',' ORDER BY method) FILTER (WHERE log2fc > 0), '') AS mu, coalesce(string_agg(method, ',' ORDER BY method) FILTER (WHERE NOT log2fc > 0), '') AS md FROM de GROUP BY 1, 2)"""


@query("direction_consistency", with_views("de", DIRECTION) + f"""SELECT contrast_id, gene_id, up AS n_up, down AS n_down, mu AS methods_up, md AS methods_down,
CASE WHEN up >= down THEN 'up' ELSE 'down' END AS direction, {rq('greatest(up, down) / (up + down)', 'direction_agreement')}, greatest(up, down) = up + down AS is_consistent FROM dir""")
def _(t):
    return rounded(ensemble.direction_table(t.de()), "direction_agreement")


FISHER = """fs AS (SELECT contrast_id, gene_id, -2 * sum(ln(least(greatest(p_value, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS st, count(*) AS k FROM de GROUP BY 1, 2),
fp AS (SELECT contrast_id, gene_id, k, exp(-st / 2) * (1 + CASE WHEN k > 1 THEN st / 2 ELSE 0 END + CASE WHEN k > 2 THEN st * st / 8 ELSE 0 END) AS p FROM fs),
fq0 AS (SELECT *, count(*) OVER (PARTITION BY contrast_id) * 1.0 AS m, rank() OVER (PARTITION BY contrast_id ORDER BY p) - 1 + count(*) OVER (PARTITION BY contrast_id, p) AS r FROM fp),
fq AS (SELECT *, least(1.0, min(p * m / r) OVER (PARTITION BY contrast_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q FROM fq0)"""


@query("fisher_combined", with_views("de", FISHER) + f"SELECT contrast_id, gene_id, k AS n_methods, {rq('p', 'combined_pvalue')}, {rq('q', 'combined_padj')} FROM fq")
def _(t):
    c = ensemble.combined_pvalues(t.de())
    return rounded(c.select("contrast_id", "gene_id", "n_methods", "combined_pvalue", "combined_padj"), "combined_pvalue", "combined_padj")


@query("fisher_ensemble", with_views("de", FISHER, DIRECTION) + f"""SELECT fq.contrast_id, fq.gene_id, k AS n_methods, {rq('p', 'combined_pvalue')}, {rq('q', 'combined_padj')},
CASE WHEN up >= down THEN 'up' ELSE 'down' END AS direction FROM fq JOIN dir ON dir.contrast_id = fq.contrast_id AND dir.gene_id = fq.gene_id WHERE q < 0.6 AND greatest(up, down) = up + down""")
def _(t):
    c = ensemble.pvalue_ensemble(t.de(), "fisher", 0.6)["consensus"]
    return rounded(c.select("contrast_id", "gene_id", "n_methods", "combined_pvalue", "combined_padj", "direction"), "combined_pvalue", "combined_padj")


@query("ensemble_method_statistics", with_views("de", FISHER, DIRECTION, "c AS (SELECT fq.contrast_id, fq.gene_id FROM fq JOIN dir ON dir.contrast_id = fq.contrast_id AND dir.gene_id = fq.gene_id WHERE q < 0.6 AND greatest(up, down) = up + down)") +
       "SELECT de.contrast_id, method, count(*) AS n_genes, count(c.gene_id) AS n_in_consensus FROM de LEFT JOIN c ON c.contrast_id = de.contrast_id AND c.gene_id = de.gene_id GROUP BY 1, 2")
def _(t):
    return ensemble.pvalue_ensemble(t.de(), "fisher", 0.6)["method_statistics"]


@query("brown_combined")
def _(t):
    c = ensemble.combined_pvalues(t.de(), "brown")
    return rounded(c.select("contrast_id", "gene_id", "n_methods", "combined_pvalue", "combined_padj"), "combined_pvalue", "combined_padj")


@query("brown_parity", with_views("de", FISHER) + f"SELECT contrast_id, gene_id, {rq('p', 'combined_pvalue')} FROM fq")
def _(t):
    c = ensemble.combined_pvalues(t.de(), "brown", parity=True)
    return rounded(c.select("contrast_id", "gene_id", "combined_pvalue"), "combined_pvalue")


@query("meta_lfc_from_statistic", with_views("de", "s AS (SELECT *, abs(log2fc / (log2fc * 3 + 0.5)) AS se FROM de WHERE log2fc * 3 + 0.5 <> 0 AND log2fc <> 0)") +
       f"SELECT contrast_id, gene_id, {rq('sum(log2fc / (se * se)) / sum(1 / (se * se))', 'meta_lfc')}, {rq('sqrt(1 / sum(1 / (se * se)))', 'meta_lfc_se')} FROM s GROUP BY 1, 2")
def _(t):
    d = t.de().withColumn("stat", F.col("log2fc") * 3 + 0.5).where("stat <> 0 AND log2fc <> 0")
    return rounded(ensemble.meta_lfc(d), "meta_lfc", "meta_lfc_se")


@query("meta_lfc_from_pvalue")
def _(t):
    return rounded(ensemble.meta_lfc(t.de()), "meta_lfc", "meta_lfc_se", digits=5)


RRA = """rk AS (SELECT *, row_number() OVER (PARTITION BY contrast_id, method ORDER BY p_value, gene_id) AS r FROM de),
g AS (SELECT contrast_id, gene_id, count(*) AS k, avg(r) AS mean_rank, min(r) AS lo, max(r) AS hi FROM rk GROUP BY 1, 2),
s AS (SELECT *, 1 - pow(1 - lo / (count(*) OVER (PARTITION BY contrast_id)), k) AS score FROM g),
s1 AS (SELECT *, count(*) OVER (PARTITION BY contrast_id) * 1.0 AS m, rank() OVER (PARTITION BY contrast_id ORDER BY score) - 1 + count(*) OVER (PARTITION BY contrast_id, score) AS rr FROM s),
s2 AS (SELECT *, least(1.0, min(score * m / rr) OVER (PARTITION BY contrast_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) AS q FROM s1)"""


@query("rank_aggregation", with_views("de", RRA) + f"SELECT contrast_id, gene_id, k AS n_methods, {rq('mean_rank', 'mean_rank')}, lo AS min_rank, hi AS max_rank, {rq('score', 'rra_score')}, {rq('q', 'rra_pvalue', 4)} FROM s2")
def _(t):
    r = ensemble.rank_aggregation(t.de())
    return r.select("contrast_id", "gene_id", "n_methods", rnd("mean_rank").alias("mean_rank"), "min_rank", "max_rank",
                    rnd("rra_score").alias("rra_score"), rnd("rra_pvalue", 4).alias("rra_pvalue"))


@query("rank_ensemble", with_views("de", RRA, DIRECTION) + "SELECT s2.contrast_id, s2.gene_id, CASE WHEN up >= down THEN 'up' ELSE 'down' END AS direction FROM s2 JOIN dir ON dir.contrast_id = s2.contrast_id AND dir.gene_id = s2.gene_id WHERE q < 0.9 AND greatest(up, down) = up + down")
def _(t):
    return ensemble.rank_ensemble(t.de(), 0.9)["consensus"].select("contrast_id", "gene_id", "direction")


VOTES = """v AS (SELECT contrast_id, gene_id, count(*) AS n, sum(CASE method WHEN 'A' THEN 1.5 WHEN 'N' THEN 0.9 ELSE 0.6 END) AS ws, count(*) FILTER (WHERE log2fc > 0) AS up, count(*) FILTER (WHERE NOT log2fc > 0) AS down,
  string_agg(method, ',' ORDER BY method) AS ml FROM de WHERE padj < 0.9 AND abs(log2fc) > 0.1 GROUP BY 1, 2)"""


@query("voting_ensemble", with_views("de", VOTES) + f"SELECT contrast_id, gene_id, n AS n_votes, ml AS methods_detected, CASE WHEN up >= down THEN 'up' ELSE 'down' END AS direction, {rq('greatest(up, down) / n', 'direction_agreement')} FROM v WHERE n >= 2 AND greatest(up, down) = n")
def _(t):
    v = ensemble.voting_ensemble(t.de(), 2, {"padj": 0.9, "lfc": 0.1})
    return rounded(v.select("contrast_id", "gene_id", "n_votes", "methods_detected", "direction", "direction_agreement"), "direction_agreement")


@query("weighted_ensemble", with_views("de", VOTES) + f"SELECT contrast_id, gene_id, {rq('ws', 'weighted_score')}, n AS n_methods, CASE WHEN up >= down THEN 'up' ELSE 'down' END AS direction FROM v WHERE ws >= 1.45 AND greatest(up, down) / n >= 0.6")
def _(t):
    w = ensemble.weighted_ensemble(t.de(), {"A": 0.5, "N": 0.3, "R": 0.2}, 1.45, {"padj": 0.9, "lfc": 0.1}, direction_threshold=0.6)
    return rounded(w.select("contrast_id", "gene_id", "weighted_score", "n_methods", "direction"), "weighted_score")


@query("ensemble_compare")
def _(t):
    return ensemble.compare_ensembles(t.de(), 0.6, 2, {"padj": 0.9, "lfc": 0.1})


GRID = thresholds.grid_points(5)
GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a!r}, {c!r})" for i, (a, c) in enumerate(GRID)) + ") g(iteration, alpha, lfc))"
METHOD_DE = ["contrast_id", "method"]


@query("tuning_ground_truth", with_views("de", TRUTH, GRID_SQL, "tr AS (SELECT gene_id, expected_direction AS ed FROM truth WHERE is_de)",
       """h AS (SELECT contrast_id, method, iteration, alpha, lfc, count(*) FILTER (WHERE pass AND ed IS NOT NULL) AS tp, count(*) FILTER (WHERE pass AND ed IS NULL) AS fp,
  count(*) FILTER (WHERE pass AND ed IS NOT NULL AND ed <> CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END) AS w
  FROM (SELECT de.*, grid.*, ed, de.padj < alpha AND abs(log2fc) > lfc AS pass FROM de CROSS JOIN grid LEFT JOIN tr ON tr.gene_id = de.gene_id) GROUP BY 1, 2, 3, 4, 5)""",
       "s AS (SELECT *, (SELECT count(*) FROM tr) - tp AS fn FROM h)") +
       f"""SELECT contrast_id, method, iteration, tp AS true_positives, fp AS false_positives, fn AS false_negatives, w AS wrong_direction,
{rq('CASE WHEN tp - w > 0 THEN 2.0 * (tp - w) / (2.0 * (tp - w) + fp + w + fn + w) ELSE 0 END', 'score')} FROM s""")
def _(t):
    tr = truth(t).where("is_de").select("gene_id", "expected_direction")
    s = thresholds.ground_truth_trials(t.de(), tr, GRID, METHOD_DE)
    return rounded(s.drop("alpha", "lfc"), "score")


@query("tuning_ground_truth_metrics", with_views("de", TRUTH, GRID_SQL, "tr AS (SELECT gene_id FROM truth WHERE is_de)",
       """h AS (SELECT contrast_id, method, iteration, count(*) AS n, CAST(count(*) FILTER (WHERE pass AND t) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE pass AND NOT t) AS DOUBLE) AS fp FROM
  (SELECT de.*, grid.*, tr.gene_id IS NOT NULL AS t, de.padj < alpha AND abs(log2fc) > lfc AS pass FROM de CROSS JOIN grid LEFT JOIN tr ON tr.gene_id = de.gene_id) GROUP BY 1, 2, 3)""",
       "s AS (SELECT *, (SELECT count(*) FROM tr) - tp AS fn FROM h)") +
       f"""SELECT contrast_id, method, iteration, CAST(n - tp - fp - fn AS BIGINT) AS true_negatives, {rq('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END', 'precision')},
{rq('tp / (tp + fn)', 'recall')}, {rq('(n - fp - fn) / n', 'accuracy')} FROM s""")
def _(t):
    tr = truth(t).where("is_de").select("gene_id", "expected_direction")
    trials = thresholds.ground_truth_trials(t.de(), tr, GRID, METHOD_DE)
    m = thresholds.ground_truth_metrics(trials, t.de(), METHOD_DE)
    return rounded(m.select(*METHOD_DE, "iteration", "true_negatives", "precision", "recall", "accuracy"), "precision", "recall", "accuracy")


PI0 = "pi AS (SELECT contrast_id, method, count(*) AS m, quantile_cont(e, 0.5) AS pi0 FROM (SELECT contrast_id, method, l, least(1.0, count(*) FILTER (WHERE p_value > l) / (count(*) * (1.0 - l))) AS e FROM de CROSS JOIN (SELECT unnest([" + ", ".join(map(repr, thresholds.LAMBDAS)) + "]) AS l) GROUP BY 1, 2, 3) GROUP BY 1, 2)"


@query("null_proportion", with_views("de", PI0) + f"SELECT contrast_id, method, {rq('pi0', 'pi0')} FROM pi")
def _(t):
    return rounded(thresholds.pi0(t.de(), METHOD_DE), "pi0")


@query("tuning_fdr", with_views("de", PI0, GRID_SQL, "h AS (SELECT contrast_id, method, iteration, alpha, count(*) AS m, count(*) FILTER (WHERE p_value < alpha AND abs(log2fc) > lfc) AS n FROM de CROSS JOIN grid GROUP BY 1, 2, 3, 4)") +
       f"""SELECT h.contrast_id, h.method, iteration, n AS n_significant, {rq('CASE WHEN n > 0 THEN pi0 * alpha * h.m / n ELSE 0 END', 'estimated_fdr')},
{rq('CASE WHEN n > 0 THEN 1 - abs(least(1.0, pi0 * alpha * h.m / n) - 0.05) ELSE 0 END', 'score')} FROM h JOIN pi ON pi.contrast_id = h.contrast_id AND pi.method = h.method""")
def _(t):
    s = thresholds.fdr_trials(t.de(), GRID, METHOD_DE)
    return rounded(s.select(*METHOD_DE, "iteration", "n_significant", "estimated_fdr", "score"), "estimated_fdr", "score")


@query("tuning_best", with_views("de", PI0, GRID_SQL, "h AS (SELECT contrast_id, method, iteration, alpha, lfc, count(*) AS m, count(*) FILTER (WHERE p_value < alpha AND abs(log2fc) > lfc) AS n FROM de CROSS JOIN grid GROUP BY 1, 2, 3, 4, 5)",
       "s AS (SELECT h.*, CASE WHEN n > 0 THEN 1 - abs(least(1.0, pi0 * alpha * h.m / n) - 0.05) ELSE 0 END AS score FROM h JOIN pi ON pi.contrast_id = h.contrast_id AND pi.method = h.method)") +
       f"SELECT contrast_id, method, iteration, {rq('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY contrast_id, method ORDER BY score DESC, iteration) AS k FROM s) WHERE k = 1")
def _(t):
    b = thresholds.best_trial(thresholds.fdr_trials(t.de(), GRID, METHOD_DE), METHOD_DE)
    return rounded(b.select(*METHOD_DE, "iteration", "score"), "score")


RANDOM = thresholds.random_points(40)


@query("tuning_random_search", with_views("de", "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a!r}, {c!r})" for i, (a, c) in enumerate(RANDOM)) + ") g(iteration, alpha, lfc))") +
       "SELECT contrast_id, method, iteration, count(*) FILTER (WHERE p_value < alpha AND abs(log2fc) > lfc) AS n_significant FROM de CROSS JOIN grid GROUP BY 1, 2, 3")
def _(t):
    return thresholds.fdr_trials(t.de(), RANDOM, METHOD_DE).select(*METHOD_DE, "iteration", "n_significant")


@query("tuning_reproducibility", with_views("de", GRID_SQL, "j AS (SELECT coalesce(a.method, b.method) AS method, a.p_value AS p1, a.log2fc AS l1, b.p_value AS p2, b.log2fc AS l2 FROM (SELECT * FROM de WHERE contrast_id = 'O') a FULL JOIN (SELECT * FROM de WHERE contrast_id = 'F') b ON a.method = b.method AND a.gene_id = b.gene_id)",
       "h AS (SELECT method, iteration, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE b) AS n2, count(*) FILTER (WHERE a AND b) AS nb FROM (SELECT *, coalesce(p1 < alpha AND abs(l1) > lfc, false) AS a, coalesce(p2 < alpha AND abs(l2) > lfc, false) AS b FROM j CROSS JOIN grid) GROUP BY 1, 2)") +
       f"""SELECT method, iteration, n1 AS cohort1_degs, n2 AS cohort2_degs, nb AS reproducible_degs, n1 - nb AS cohort1_unique, n2 - nb AS cohort2_unique,
{rq('CASE WHEN n1 + n2 - nb > 0 THEN nb / (n1 + n2 - nb) ELSE 0 END', 'score')} FROM h""")
def _(t):
    d = t.de()
    s = thresholds.reproducibility_trials(d.where("contrast_id = 'O'"), d.where("contrast_id = 'F'"), GRID, ["method"])
    return rounded(s.drop("alpha", "lfc"), "score")


@query("tuning_stability")
def _(t):
    points = [(0.05, 0.0), (0.1, 0.1), (0.2, 0.2), (0.9, 0.0)]
    return rounded(thresholds.stability_trials(t.de(), points, METHOD_DE), "score")


@query("tuning_evolution")
def _(t):
    one = t.de()
    (a, c), score = thresholds.differential_evolution(
        lambda p: thresholds.fdr_trials(one, p, []), generations=3, population=8)
    return thresholds.fdr_trials(one, [(a, c)], []).withColumn("evolved_score", F.lit(score))


AUC_SQL = "r AS (SELECT s.*, avg(k) OVER (PARTITION BY score) AS ra FROM (SELECT *, row_number() OVER (ORDER BY score) AS k FROM scores) s)"


@query("auc", with_views("scores", AUC_SQL) + f"""SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg,
{rq('(sum(ra) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))', 'auc')} FROM r""")
def _(t):
    return rounded(clinical.auc(t.scores()), "auc")


ROC = "p AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM scores GROUP BY 1), c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS tot_p, sum(neg) OVER () AS tot_n FROM p WINDOW w AS (ORDER BY score DESC))"


@query("roc_points", with_views("scores", ROC) + f"SELECT {rq('score', 'threshold', 8)}, {rq('tp / tot_p', 'tpr')}, {rq('fp / tot_n', 'fpr')} FROM c")
def _(t):
    r = clinical.roc_points(t.scores()).where(F.col("threshold") < float("inf"))
    return r.select(rnd("threshold", 8).alias("threshold"), rnd("tpr").alias("tpr"), rnd("fpr").alias("fpr"))


@query("youden_threshold", with_views("scores", ROC) + f"SELECT {rq('score', 'threshold', 8)}, {rq('tp / tot_p', 'sensitivity')}, {rq('1 - fp / tot_n', 'specificity')}, {rq('tp / tot_p - fp / tot_n', 'youdens_j')} FROM c ORDER BY round(tp / tot_p - fp / tot_n, 14) DESC, score DESC LIMIT 1")
def _(t):
    y = clinical.youden(t.scores())
    return y.select(rnd("threshold", 8).alias("threshold"), *[rnd(c).alias(c) for c in ("sensitivity", "specificity", "youdens_j")])


@query("decision_curve", with_views("scores", "th AS (SELECT unnest([" + ", ".join(map(repr, clinical.THRESHOLDS)) + "]) AS pt)",
       "a AS (SELECT pt, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE score >= pt AND y = 1) AS tp, count(*) FILTER (WHERE score >= pt AND y = 0) AS fp, avg(y) AS er FROM scores CROSS JOIN th GROUP BY 1)") +
       f"SELECT {rq('pt', 'threshold', 4)}, {rq('tp / n - fp / n * (pt / (1 - pt))', 'net_benefit_model')}, {rq('er - (1 - er) * (pt / (1 - pt))', 'net_benefit_treat_all')}, CAST(0.0 AS DOUBLE) AS net_benefit_treat_none FROM a")
def _(t):
    d = clinical.decision_curve(t.scores())
    return d.select(rnd("threshold", 4).alias("threshold"), rnd("net_benefit_model").alias("net_benefit_model"),
                    rnd("net_benefit_treat_all").alias("net_benefit_treat_all"), "net_benefit_treat_none")


@query("risk_categories", with_views("scores") + "SELECT id, CASE WHEN risk_old >= 0.5 THEN 2 WHEN risk_old >= 0.2 THEN 1 ELSE 0 END AS category FROM scores")
def _(t):
    return t.scores().select("id", clinical.risk_category(F.col("risk_old")).alias("category"))


@query("net_reclassification", with_views("scores", "c AS (SELECT y, CASE WHEN risk_old >= 0.5 THEN 2 WHEN risk_old >= 0.2 THEN 1 ELSE 0 END AS a, CASE WHEN risk_new >= 0.5 THEN 2 WHEN risk_new >= 0.2 THEN 1 ELSE 0 END AS b FROM scores)",
       """n AS (SELECT CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS ne, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS nn, count(*) FILTER (WHERE y = 1 AND b > a) AS eu, count(*) FILTER (WHERE y = 1 AND b < a) AS ed,
  count(*) FILTER (WHERE y = 0 AND b > a) AS nu, count(*) FILTER (WHERE y = 0 AND b < a) AS nd FROM c)""") +
       f"""SELECT eu AS events_up, ed AS events_down, nu AS nonevents_up, nd AS nonevents_down, {rq('(eu - ed) / ne', 'nri_events')}, {rq('(nd - nu) / nn', 'nri_nonevents')}, {rq('(eu - ed) / ne + (nd - nu) / nn', 'nri')},
{rq('((eu - ed) / ne + (nd - nu) / nn) / sqrt(((eu + ed) / ne - pow((eu - ed) / ne, 2)) / ne + ((nu + nd) / nn - pow((nu - nd) / nn, 2)) / nn)', 'z_score')} FROM n""")
def _(t):
    n = clinical.net_reclassification(t.scores())
    return n.select("events_up", "events_down", "nonevents_up", "nonevents_down", *[rnd(c).alias(c) for c in ("nri_events", "nri_nonevents", "nri", "z_score")])


@query("net_reclassification_p")
def _(t):
    return rounded(clinical.net_reclassification(t.scores()), "nri", "z_score", "p_value")


@query("predictive_values", with_views("scores", ROC) + f"""SELECT {rq('score', 'threshold', 8)}, {rq('tp / tot_p * 0.1 / (tp / tot_p * 0.1 + fp / tot_n * 0.9)', 'ppv')}, {rq('(1 - fp / tot_n) * 0.9 / ((1 - fp / tot_n) * 0.9 + (1 - tp / tot_p) * 0.1)', 'npv')} FROM c WHERE tp > 0 AND fp > 0 AND fp < tot_n""")
def _(t):
    r = clinical.roc_points(t.scores()).where("tpr > 0 AND fpr > 0 AND fpr < 1")
    v = clinical.ppv_npv(F.col("tpr"), 1 - F.col("fpr"), F.lit(0.1))
    return r.select(rnd("threshold", 8).alias("threshold"), rnd(v["ppv"]).alias("ppv"), rnd(v["npv"]).alias("npv"))


@query("bootstrap_auc")
def _(t):
    return rounded(clinical.bootstrap_auc(t.scores(), replicates=500), "point_estimate", "ci_lower", "ci_upper")


@query("bootstrap_custom_metric")
def _(t):
    brier = lambda w, y, s: F.sum(w * (y - s) * (y - s)) / F.sum(w)
    return rounded(clinical.bootstrap_metric(t.scores(), brier, "id", replicates=200), "point_estimate", "ci_lower", "ci_upper")


@query("optimism_gap", with_views("scores", AUC_SQL, "r2 AS (SELECT s.*, avg(k) OVER (PARTITION BY risk_old) AS ra FROM (SELECT *, row_number() OVER (ORDER BY risk_old) AS k FROM scores) s)") +
       f"""SELECT {rq('a.auc - b.auc', 'optimism_gap')} FROM (SELECT (sum(ra) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r) a,
(SELECT (sum(ra) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r2) b""")
def _(t):
    s = t.scores()
    both = s.select(F.explode(F.array(F.struct(F.lit("train").alias("part"), "y", "score"),
                                      F.struct(F.lit("oof").alias("part"), "y", F.col("risk_old").alias("score")))).alias("e")).select("e.*")
    a = clinical.auc(both, ["part"])
    gap = F.sum(F.when(F.col("part") == "train", F.col("auc")).otherwise(-F.col("auc")))
    return a.agg(rnd(gap).alias("optimism_gap"))
