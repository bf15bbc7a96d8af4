"""Queries over per-gene tests, patterns, enrichment, ratios, signatures and survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clinical, genetests, moments, normalize, ordered, signature, survival
from ..runtime import cut, spread
from .registry import query, rnd, rounded, rq
from .views import with_views

DG = ["dataset_id", "gene_id"]


def labels(t):
    return t.samples().select("dataset_id", "sample_id", (F.col("condition") == "treated").cast("int").alias("y"))


def values(t):
    return normalize.log2p1(t.counts()).join(labels(t), ["dataset_id", "sample_id"])


def dense_values(t):
    return moments.densify(normalize.log2p1(t.counts()), "value").join(labels(t), ["dataset_id", "sample_id"])


LV = "lv AS (SELECT dataset_id, gene_id, sample_id, log2(count + 1.0) AS v, sample_id % 2 AS y FROM dense)"
WELCH = (LV, "wm AS (SELECT dataset_id, gene_id, avg(v) FILTER (WHERE y = 1) AS m1, avg(v) FILTER (WHERE y = 0) AS m0, var_samp(v) FILTER (WHERE y = 1) AS v1, var_samp(v) FILTER (WHERE y = 0) AS v0, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE v <> 0) AS nz FROM lv GROUP BY 1, 2)",
         "w AS (SELECT *, nz < 3 OR (v1 = 0 AND v0 = 0) AS sk FROM wm)")


@query("welch_statistics", with_views("dense", *WELCH) + f"""SELECT dataset_id, gene_id, {rq('m1', 'mean_ref')}, {rq('m0', 'mean_base')}, sk AS skipped, {rq('CASE WHEN sk THEN 0 ELSE m1 - m0 END', 'log2fc')},
{rq('CASE WHEN NOT sk THEN (m1 - m0) / sqrt(v1 / n1 + v0 / n0) END', 't')}, {rq('CASE WHEN NOT sk THEN pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) END', 'df')} FROM w""")
def _(t):
    w = genetests.welch(values(t), labels(t))
    return rounded(w.select(*DG, "mean_ref", "mean_base", "skipped", "log2fc", "t", "df"), "mean_ref", "mean_base", "log2fc", "t", "df")


@query("per_gene_de_welch")
def _(t):
    return rounded(genetests.per_gene_de(values(t), labels(t)).select(*DG, "log2fc", "p_value", "neg_log10p"), "log2fc", "p_value", "neg_log10p")


@query("mann_whitney_u", with_views("dense", LV, "r AS (SELECT *, avg(k) OVER (PARTITION BY dataset_id, gene_id, v) AS ra FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, gene_id ORDER BY v) AS k FROM lv))") +
       f"SELECT dataset_id, gene_id, {rq('sum(ra) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0', 'u')} FROM r GROUP BY 1, 2")
def _(t):
    return rounded(genetests.mann_whitney(values(t), labels(t)).select(*DG, "u"), "u")


@query("per_gene_de_mann_whitney")
def _(t):
    return rounded(genetests.per_gene_de(values(t), labels(t), "mann_whitney").select(*DG, "log2fc", "p_value"), "log2fc", "p_value")


PREP = ("k AS (SELECT dataset_id, gene_id FROM dense GROUP BY 1, 2 HAVING avg(count) >= 12)",
        "f AS (SELECT d.* FROM dense d JOIN k ON k.dataset_id = d.dataset_id AND k.gene_id = d.gene_id)",
        "l AS (SELECT dataset_id, sample_id, CAST(sum(count) AS DOUBLE) AS lib FROM f GROUP BY 1, 2)")


@query("prepare_expression", with_views("dense", *PREP) + f"SELECT f.dataset_id, f.gene_id, f.sample_id, {rq('log2(count / lib * 1e6 + 1)', 'value')}, CAST(f.sample_id % 2 AS INTEGER) AS y FROM f JOIN l ON l.dataset_id = f.dataset_id AND l.sample_id = f.sample_id WHERE count > 0")
def _(t):
    return rounded(genetests.prepare_expression(t.counts(), t.samples(), 12.0).select(*DG, "sample_id", "value", "y"), "value")


PATTERN = "pt AS (SELECT *, m1 - m0 AS lfc FROM w WHERE NOT sk AND abs(m1 - m0) >= 1.0)"


def pattern(t):
    de = genetests.welch(values(t), labels(t))
    return genetests.direction_pattern(de.withColumn("p_value", F.when(F.col("skipped"), 1.0).otherwise(0.01)).withColumn("neg_log10p", F.lit(2.0)), 0.05, 1.0)


@query("direction_pattern", with_views("dense", *WELCH, PATTERN) + f"SELECT dataset_id, gene_id, CASE WHEN lfc > 0 THEN 'up' ELSE 'down' END AS direction, {rq('lfc', 'log2fc')}, {rq('m0', 'base_mean')}, {rq('sqrt(v0)', 'base_std')} FROM pt")
def _(t):
    return rounded(pattern(t).drop("confidence"), "log2fc", "base_mean", "base_std")


@query("direction_pattern_tested")
def _(t):
    p = genetests.direction_pattern(genetests.per_gene_de(values(t), labels(t)), 0.05, 0.5)
    return rounded(p, "log2fc", "confidence", "base_mean", "base_std")


@query("concordance", with_views("dense", *WELCH, PATTERN) + f"""SELECT lv.dataset_id, lv.sample_id, {rq('avg(CASE WHEN lfc > 0 THEN 1 ELSE -1 END * tanh((v - m0) / greatest(sqrt(v0), 1e-10)))', 'concordance')}
FROM lv JOIN pt ON pt.dataset_id = lv.dataset_id AND pt.gene_id = lv.gene_id GROUP BY 1, 2""")
def _(t):
    return rounded(genetests.concordance(pattern(t), normalize.log2p1(t.counts()), t.samples()), "concordance")


ORA = ("q AS (SELECT DISTINCT gene_id FROM de WHERE padj < 0.5)", "u AS (SELECT gene_id FROM gene_sets UNION SELECT gene_id FROM q)",
       "n AS (SELECT count(*) AS nu, (SELECT count(*) FROM q) AS nq FROM u)",
       "c AS (SELECT pathway, count(*) AS sz, count(q.gene_id) AS ov FROM (SELECT DISTINCT pathway, gene_id FROM gene_sets) s LEFT JOIN q ON q.gene_id = s.gene_id GROUP BY 1)")


@query("enrichment_counts", with_views("de gene_sets", *ORA) + f"SELECT pathway, ov AS overlap_count, sz AS gene_set_size, {rq('ov * (nu - nq - sz + ov) / greatest((nq - ov) * (sz - ov), 1)', 'odds_ratio')} FROM c, n WHERE sz >= 2 AND ov > 0")
def _(t):
    e = genetests.over_representation(t.de().where("padj < 0.5"), t.gene_sets())
    return rounded(e.select("pathway", "overlap_count", "gene_set_size", "odds_ratio"), "odds_ratio")


HYPER = """t AS (SELECT pathway, ov, sz, ov * (nu - nq - sz + ov) / greatest((nq - ov) * (sz - ov), 1) AS odds, least(1.0, list_sum([
  exp(lgamma(sz + 1) - lgamma(k + 1) - lgamma(sz - k + 1) + lgamma(nu - sz + 1) - lgamma(nq - k + 1) - lgamma(nu - sz - nq + k + 1) - lgamma(nu + 1) + lgamma(nq + 1) + lgamma(nu - nq + 1)) FOR k IN range(ov, least(sz, nq) + 1)])) AS p FROM c, n WHERE sz >= 2 AND ov > 0),
t1 AS (SELECT *, round(p, 12) AS pr FROM t),
t2 AS (SELECT *, count(*) OVER () * 1.0 AS m, rank() OVER (ORDER BY pr) - 1 + count(*) OVER (PARTITION BY pr) AS r FROM t1),
t3 AS (SELECT *, least(1.0, min(p * m / r) OVER (ORDER BY pr DESC ROWS UNBOUNDED PRECEDING)) AS q FROM t2)"""


@query("enrichment_fisher", with_views("de gene_sets", *ORA, HYPER) + f"SELECT pathway, ov AS overlap_count, sz AS gene_set_size, nq AS n_query, nu AS n_universe, {rq('odds', 'odds_ratio')}, {rq('p', 'p_value')}, {rq('q', 'adjusted_p_value', 5)} FROM t3, n")
def _(t):
    e = genetests.over_representation(t.de().where("padj < 0.5"), t.gene_sets())
    return rounded(rounded(e, "odds_ratio", "p_value"), "adjusted_p_value", digits=5)


SEL = "sl AS (SELECT DISTINCT contrast_id || method AS method, gene_id, round(abs(log2fc), 4) AS score, padj < 0.5 AS selected FROM de WHERE padj < 0.9)"


def selector_scores(t):
    return t.de().where("padj < 0.9").select(F.concat("contrast_id", "method").alias("method"), "gene_id", F.round(F.abs("log2fc"), 4).alias("score"), (F.col("padj") < 0.5).alias("selected"))


CONS = (SEL, "g AS (SELECT p_partkey AS gene_id FROM part)", "m AS (SELECT DISTINCT method FROM sl)",
        "x AS (SELECT m.method, g.gene_id, coalesce(s.score, 0.0) AS score, coalesce(s.selected, false) AS selected FROM g CROSS JOIN m LEFT JOIN sl s ON s.method = m.method AND s.gene_id = g.gene_id)",
        "rk AS (SELECT *, avg(k) OVER (PARTITION BY method, score) AS ra FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC) AS k FROM x))",
        "a AS (SELECT gene_id, avg(ra) AS mean_rank, count(*) FILTER (WHERE selected) AS ns FROM rk GROUP BY 1)",
        "cs AS (SELECT *, (max(mean_rank) OVER () - mean_rank) / max(mean_rank) OVER () * 0.7 + ns / 6.0 * 0.3 AS score FROM a)")


@query("consensus_ranking", with_views("de", *CONS) + f"SELECT gene_id, {rq('mean_rank', 'mean_rank')}, ns AS n_methods_selected, {rq('score', 'consensus_score')}, row_number() OVER (ORDER BY round(score, 12) DESC, gene_id) AS consensus_rank FROM cs")
def _(t):
    c = genetests.consensus_ranking(selector_scores(t), t.part.select(F.col("p_partkey").alias("gene_id")), 6)
    return rounded(c, "mean_rank", "consensus_score")


@query("calibrated_ranking", with_views("de", *CONS, "pv AS (SELECT gene_id, min(p_value) AS p FROM de GROUP BY 1)",
       "cw AS (SELECT cs.gene_id, score * CASE WHEN coalesce(p, 1.0) < 0.5 THEN 1.0 ELSE 0.5 END AS sc FROM cs LEFT JOIN pv ON pv.gene_id = cs.gene_id)") +
       f"SELECT gene_id, {rq('sc', 'consensus_score_calibrated')}, row_number() OVER (ORDER BY round(sc, 12) DESC, gene_id) AS consensus_rank FROM cw")
def _(t):
    c = genetests.consensus_ranking(selector_scores(t), t.part.select(F.col("p_partkey").alias("gene_id")), 6)
    p = t.de().groupBy("gene_id").agg(F.min("p_value").alias("p_value"))
    return rounded(genetests.calibrate(c, p, 0.5).select("gene_id", "consensus_score_calibrated", "consensus_rank"), "consensus_score_calibrated")


# ---- ratios and signatures ------------------------------------------------------------------------------

def brand_values(t):
    """Small panel matrix: brands as genes, supplier slots as samples."""
    c = (t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
         .groupBy(F.lit("all").alias("dataset_id"), F.col("p_brand").alias("gene_id"), (F.col("l_suppkey") % 24).cast("int").alias("sample_id"))
         .agg(F.log2(F.sum("l_quantity") + 1.0).alias("value")))
    return moments.densify(c, "value").withColumn("y", F.col("sample_id") % 2)


BV = """b0 AS (SELECT p_brand AS gene_id, CAST(l_suppkey % 24 AS INTEGER) AS sample_id, log2(sum(l_quantity) + 1.0) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
bv AS (SELECT g.gene_id, s.sample_id, coalesce(b.value, 0.0) AS value, s.sample_id % 2 AS y FROM (SELECT DISTINCT gene_id FROM b0) g CROSS JOIN (SELECT DISTINCT sample_id FROM b0) s LEFT JOIN b0 b ON b.gene_id = g.gene_id AND b.sample_id = s.sample_id)"""


@query("apply_ratios", "WITH " + BV + f" SELECT a.sample_id, a.gene_id AS gene_a, b.gene_id AS gene_b, {rq('(a.value + 1) / (b.value + 1)', 'ratio')} FROM bv a JOIN bv b ON a.sample_id = b.sample_id WHERE a.gene_id < b.gene_id")
def _(t):
    v = brand_values(t)
    genes = F.transform(F.col("g"), lambda a: F.struct(a.alias("gene_a"), F.filter("g", lambda b: b > a).alias("later")))
    names = v.select("gene_id").distinct().agg(F.collect_set("gene_id").alias("g")).select(F.explode(genes).alias("p"))
    pairs = names.select("p.gene_a", F.explode("p.later").alias("gene_b"))
    return rounded(signature.apply_ratios(v, pairs).drop("dataset_id"), "ratio")


@query("ratio_search", "WITH " + BV + f""", pr AS (SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, a.y, (a.value + 1) / (b.value + 1) AS r FROM bv a JOIN bv b ON a.sample_id = b.sample_id AND a.gene_id < b.gene_id),
rk AS (SELECT *, avg(k) OVER (PARTITION BY gene_a, gene_b, r) AS ra FROM (SELECT *, row_number() OVER (PARTITION BY gene_a, gene_b ORDER BY r) AS k FROM pr)),
au AS (SELECT gene_a, gene_b, (sum(ra) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc, avg(r) FILTER (WHERE y = 1) AS mr, avg(r) FILTER (WHERE y = 0) AS mb FROM rk GROUP BY 1, 2),
fl AS (SELECT *, greatest(auc, 1 - auc) AS best FROM au)
SELECT gene_a, gene_b, {rq('best', 'auc')}, CASE WHEN auc < 0.5 THEN 'higher_in_baseline' ELSE 'higher_in_reference' END AS direction, {rq('mr', 'mean_ratio_reference')}, {rq('mb', 'mean_ratio_baseline')}
FROM fl WHERE best >= 0.5 ORDER BY round(best, 12) DESC, gene_a, gene_b LIMIT 40""")
def _(t):
    s = signature.search_ratios(brand_values(t), 40, 0.5)
    return rounded(s.drop("dataset_id", "rank"), "auc", "mean_ratio_reference", "mean_ratio_baseline")


@query("signature_score", "WITH " + BV + f""", st AS (SELECT gene_id, avg(value) AS mu, stddev_pop(value) AS sd FROM bv GROUP BY 1)
SELECT sample_id, {rq('sum(length(bv.gene_id) * (value - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END) + 0.5', 'signature_score')}, CASE WHEN round(sum(length(bv.gene_id) * (value - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END) + 0.5, 6) < 0.25 THEN 'low' ELSE 'high' END AS risk FROM bv JOIN st ON st.gene_id = bv.gene_id GROUP BY 1""")
def _(t):
    v = brand_values(t)
    sig = signature.normalisation(v, v).withColumn("weight", F.length("gene_id").cast("double"))
    s = signature.score_signature(sig, v, 0.5).select("sample_id", rnd("signature_score").alias("signature_score"))
    return s.withColumn("risk", signature.stratify(F.col("signature_score"), {"threshold": 0.25}))


@query("risk_groups", with_views("scores") + "SELECT id, CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.6 THEN 'medium' ELSE 'high' END AS risk_group FROM scores")
def _(t):
    return t.scores().select("id", signature.stratify(F.col("score"), {"low": 0.3, "high": 0.6}).alias("risk_group"))


# ---- survival -------------------------------------------------------------------------------------------

def patients(t):
    """Brand expression per customer next to that customer's follow-up."""
    n = t.lineitem.count()
    o = spread(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sample_id")), n, "l_orderkey")
    p = spread(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene_id")), n, "l_partkey")
    sold = t.lineitem.join(o, "l_orderkey").join(p, "l_partkey").select("gene_id", "sample_id", "l_quantity")
    c = cut(spread(sold, n, "gene_id", "sample_id").groupBy(F.lit("all").alias("dataset_id"), "gene_id", "sample_id")
            .agg(F.log2(F.sum("l_quantity") + 1.0).alias("value")))
    return survival.align_clinical(moments.densify(c, "value"), t.clinical())


def risk_rows(t):
    k = F.col("sample_id")
    return t.clinical().select("sample_id", F.col("os_time").alias("time"), F.col("os_event").alias("event"), (F.pmod(k * 7919, F.lit(1009)) / 1009.0).alias("score"))


RISK = "rr AS (SELECT sample_id, os_time AS time, os_event AS event, (sample_id * 7919) % 1009 / 1009.0 AS score FROM clinical)"


@query("cox_screen")
def _(t):
    c = survival.cox_screen(patients(t).select("gene_id", "sample_id", "time", "event", "value"))
    return rounded(c, "coef", "hazard_ratio", "se", "z", "ci_lower", "ci_upper", "p_value", "adjusted_p_value", digits=4)


@query("concordance_index", with_views("clinical", RISK, "p AS (SELECT a.score AS sa, b.score AS sb FROM rr a JOIN rr b ON a.event = 1 AND (b.time > a.time OR (b.time = a.time AND b.event = 0)))") +
       f"SELECT CAST(count(*) FILTER (WHERE sa > sb) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE sa < sb) AS BIGINT) AS bad, CAST(count(*) FILTER (WHERE sa = sb) AS BIGINT) AS tie, {rq('(count(*) FILTER (WHERE sa > sb) + 0.5 * count(*) FILTER (WHERE sa = sb)) / count(*)', 'c_index')} FROM p")
def _(t):
    return rounded(survival.concordance_index(risk_rows(t)), "c_index")


@query("logrank_scan", with_views("clinical", RISK, "cu AS (SELECT DISTINCT score AS cutoff FROM rr WHERE score > (SELECT min(score) FROM rr) AND score < (SELECT max(score) FROM rr))",
       "tm AS (SELECT time, count(*) AS n, sum(event) AS d FROM rr GROUP BY 1)", "rk AS (SELECT time, d, CAST(sum(n) OVER (ORDER BY time DESC) AS DOUBLE) AS r FROM tm)",
       "h AS (SELECT cutoff, k.time, k.d, k.r, count(x.time) AS r1 FROM cu CROSS JOIN rk k LEFT JOIN rr x ON x.score >= cutoff AND x.time >= k.time WHERE k.d > 0 GROUP BY 1, 2, 3, 4)",
       "e AS (SELECT cutoff, sum(d * r1 / r) AS ex, sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS v FROM h GROUP BY 1)",
       "o AS (SELECT cutoff, sum(event) AS ob, count(*) AS nh FROM cu JOIN rr ON score >= cutoff GROUP BY 1)") +
       f"SELECT {rq('o.cutoff', 'cutoff')}, nh AS n_high, {rq('pow(ob - ex, 2) / v', 'chi2', 4)} FROM o JOIN e ON e.cutoff = o.cutoff WHERE nh >= 5 AND (SELECT count(*) FROM rr) - nh >= 5")
def _(t):
    s = survival.logrank_scan(risk_rows(t))
    return s.select(rnd("cutoff").alias("cutoff"), "n_high", rnd("chi2", 4).alias("chi2"))


@query("signature_prognostic")
def _(t):
    from . import biomarkers
    fit = biomarkers.prognostic_signature(patients(t))
    return fit["cutoff"].select(rnd("cutoff", 4).alias("cutoff"), rnd("chi2", 3).alias("chi2"), rnd("c_index", 4).alias("c_index"))


@query("survival_panel")
def _(t):
    from . import biomarkers
    return rounded(biomarkers.survival_flow(patients(t), alpha=0.01, fdr=0.99)["panel"], "coef", digits=4)


@query("panel_forward_prefixes", "SELECT s AS size, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS position, p_partkey AS gene_id FROM part CROSS JOIN (SELECT unnest([3, 5, 10]) AS s) WHERE p_partkey < s")
def _(t):
    from ..operators import selection
    ranked = ordered.row_numbers(t.part.select(F.col("p_partkey").alias("gene_id")), [], ["gene_id"], "consensus_rank")
    return selection.panel_prefixes(ranked, [3, 5, 10])


@query("clinical_report")
def _(t):
    s = t.scores()
    return clinical.youden(s).select(*[rnd(c).alias(c) for c in ("threshold", "sensitivity", "specificity", "youdens_j", "auc")])
