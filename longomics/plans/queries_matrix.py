"""Queries over count matrices: normalisation, profile, quality, outliers, recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import moments, normalize, outliers, profile, qc, recommend
from .registry import query, rnd, rounded, rq
from .views import with_views

IDS = ["dataset_id", "gene_id", "sample_id"]


def values6(df, name="value"):
    return df.select(*IDS, rnd(name).alias("value"))


LOGV = "logv AS (SELECT dataset_id, gene_id, sample_id, log2(count + 1.0) AS v FROM dense)"


@query("log2_counts", with_views("counts") + f"SELECT dataset_id, gene_id, sample_id, {rq('log2(count + 1.0)', 'value')} FROM counts")
def _(t):
    return values6(normalize.log2p1(t.counts()))


CPM_SQL = """SELECT c.dataset_id, c.gene_id, c.sample_id, {} FROM counts c
JOIN (SELECT dataset_id, sample_id, CAST(sum(count) AS DOUBLE) AS lib FROM counts GROUP BY 1, 2) l
ON l.dataset_id = c.dataset_id AND l.sample_id = c.sample_id"""


@query("cpm", with_views("counts") + CPM_SQL.format(rq("c.count / l.lib * 1e6", "value", 4)))
def _(t):
    return normalize.cpm(t.counts()).select(*IDS, rnd("value", 4).alias("value"))


@query("log2_cpm", with_views("counts") + CPM_SQL.format(rq("log2(c.count / l.lib * 1e6 + 1.0)", "value")))
def _(t):
    return values6(normalize.cpm(t.counts(), log=True))


@query("bround_counts", with_views("quant") + """SELECT tx_id, CAST(sum(CASE WHEN num_reads % 2 = 0 THEN CAST(num_reads / 2 AS BIGINT)
  WHEN (num_reads - 1) / 2 % 2 = 0 THEN CAST((num_reads - 1) / 2 AS BIGINT) ELSE CAST((num_reads + 1) / 2 AS BIGINT) END) AS BIGINT) AS half_reads
FROM quant GROUP BY 1""")
def _(t):
    return (t.quant().groupBy("tx_id")
            .agg(F.sum(F.bround(F.col("num_reads") / 2.0, 0).cast("bigint")).alias("half_reads")))


@query("densify", with_views("counts dense") + "SELECT dataset_id, gene_id, sample_id, count FROM dense")
def _(t):
    return moments.densify(t.counts())


@query("gene_moments", with_views("gstats") + f"""SELECT dataset_id, gene_id, CAST(n AS BIGINT) AS n_samples,
CAST(total AS DOUBLE) AS total, {rq('mean', 'mean')}, {rq('var', 'var')}, CAST(zeros AS BIGINT) AS zeros FROM gstats""")
def _(t):
    return rounded(moments.gene_moments(t.counts()).select(
        "dataset_id", "gene_id", "n_samples", "total", "mean", "var", "zeros"), "mean", "var")


@query("sample_totals", with_views("libs") + "SELECT dataset_id, sample_id, lib AS library_size, CAST(detected AS BIGINT) AS detected_genes FROM libs")
def _(t):
    return moments.sample_totals(t.counts())


@query("standardise_genes", with_views("dense", LOGV, """st AS (SELECT dataset_id, gene_id, avg(v) AS m,
  CASE WHEN stddev_pop(v) > 1e-12 THEN stddev_pop(v) ELSE 1.0 END AS s FROM logv GROUP BY 1, 2)""") +
       f"SELECT l.dataset_id, l.gene_id, l.sample_id, {rq('(v - m) / s', 'z')} FROM logv l JOIN st ON st.dataset_id = l.dataset_id AND st.gene_id = l.gene_id")
def _(t):
    return rounded(moments.standardise(normalize.log2p1(t.counts())), "z")


@query("quantile_normalise_ordinal", with_views("dense", LOGV, """r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, sample_id ORDER BY v, gene_id) AS k FROM logv)""",
       "m AS (SELECT dataset_id, k, avg(v) AS value FROM r GROUP BY 1, 2)") +
       f"SELECT r.dataset_id, gene_id, sample_id, {rq('value', 'value')} FROM r JOIN m ON m.dataset_id = r.dataset_id AND m.k = r.k")
def _(t):
    return values6(normalize.quantile_normalise(t.counts()))


@query("quantile_normalise_average", with_views("dense", """r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, sample_id ORDER BY count, gene_id) AS k FROM dense)""",
       "m AS (SELECT dataset_id, k, avg(count) AS value FROM r GROUP BY 1, 2)",
       "a AS (SELECT dataset_id, sample_id, count, avg(k) AS ra FROM r GROUP BY 1, 2, 3)") +
       f"""SELECT d.dataset_id, d.gene_id, d.sample_id, {rq('lo.value + (hi.value - lo.value) * (a.ra - floor(a.ra))', 'value')}
FROM dense d JOIN a ON a.dataset_id = d.dataset_id AND a.sample_id = d.sample_id AND a.count = d.count
JOIN m lo ON lo.dataset_id = d.dataset_id AND lo.k = floor(a.ra) JOIN m hi ON hi.dataset_id = d.dataset_id AND hi.k = ceil(a.ra)""")
def _(t):
    return values6(normalize.quantile_normalise_interpolated(t.counts()))


STUDY_SQL = "st AS (SELECT *, 's' || CAST(sample_id % 3 AS VARCHAR) AS study FROM dense)"


def studied(t):
    return moments.densify(t.counts()).withColumn("study", F.concat(F.lit("s"), (F.col("sample_id") % 3).cast("string")))


@query("median_centre", with_views("dense", STUDY_SQL, "l AS (SELECT *, log2(count + 1.0) AS v FROM st)",
       "a AS (SELECT dataset_id, gene_id, quantile_cont(v, 0.5) AS m FROM l GROUP BY 1, 2)",
       "o AS (SELECT dataset_id, gene_id, study, quantile_cont(v, 0.5) AS m FROM l GROUP BY 1, 2, 3)") +
       f"""SELECT l.dataset_id, l.gene_id, l.sample_id, {rq('greatest(pow(2.0, v + a.m - o.m) - 1.0, 0.0)', 'value', 5)}
FROM l JOIN a ON a.dataset_id = l.dataset_id AND a.gene_id = l.gene_id
JOIN o ON o.dataset_id = l.dataset_id AND o.gene_id = l.gene_id AND o.study = l.study""")
def _(t):
    return normalize.median_centre(studied(t)).select(*IDS, rnd("value", 5).alias("value"))


SF_SQL = ("g AS (SELECT dataset_id, gene_id, exp(avg(ln(count))) AS geo FROM counts WHERE count > 0 GROUP BY 1, 2)",
          """sf AS (SELECT d.dataset_id, d.sample_id, quantile_cont(d.count / g.geo, 0.5) AS f FROM dense d
  JOIN g ON g.dataset_id = d.dataset_id AND g.gene_id = d.gene_id GROUP BY 1, 2)""")


@query("size_factors", with_views("dense", *SF_SQL) + f"SELECT dataset_id, sample_id, {rq('f', 'size_factor')} FROM sf")
def _(t):
    return rounded(normalize.size_factors(t.counts()), "size_factor")


@query("median_ratio", with_views("dense", *SF_SQL) + f"""SELECT c.dataset_id, c.gene_id, c.sample_id,
{rq('c.count / CASE WHEN f > 0 THEN f ELSE 1.0 END', 'value', 5)} FROM counts c JOIN sf ON sf.dataset_id = c.dataset_id AND sf.sample_id = c.sample_id""")
def _(t):
    return normalize.median_ratio(t.counts()).select(*IDS, rnd("value", 5).alias("value"))


def combat_ctes(source: str) -> tuple[str, ...]:
    """CTEs of the batch adjustment of ``source`` (dataset_id, gene_id, sample_id, study, count); the last is ``cbv``."""
    return (f"pb AS (SELECT dataset_id, gene_id, study, count(*) AS n, avg(count) AS m, var_pop(count) AS vp FROM {source} GROUP BY 1, 2, 3)",
            "gn AS (SELECT dataset_id, gene_id, sum(n * m) / sum(n) AS grand, sum(n * vp) / sum(n) AS pooled FROM pb GROUP BY 1, 2)",
            "sc AS (SELECT pb.*, grand, CASE WHEN pooled > 0 THEN sqrt(pooled) ELSE 1.0 END AS sd FROM pb JOIN gn ON gn.dataset_id = pb.dataset_id AND gn.gene_id = pb.gene_id)",
            "sz AS (SELECT *, (m - grand) / sd AS g, CASE WHEN n > 1 THEN vp * n / (n - 1) ELSE 0.0 END / (sd * sd) AS d FROM sc)",
            "p0 AS (SELECT dataset_id, study, avg(g) AS g_bar, coalesce(var_samp(g), 0.0) AS t2, avg(d) AS d_bar, greatest(coalesce(var_samp(d), 0.0), 1e-12) AS s2 FROM sz GROUP BY 1, 2)",
            "pr AS (SELECT dataset_id, study, g_bar, t2, (2 * s2 + d_bar * d_bar) / s2 AS pa, (d_bar * s2 + d_bar * d_bar * d_bar) / s2 AS pb FROM p0)",
            "jn AS (SELECT sz.*, g_bar, t2, pr.pa, pr.pb FROM sz JOIN pr ON pr.dataset_id = sz.dataset_id AND pr.study = sz.study)",
            """it AS (SELECT dataset_id, gene_id, study, n, g, d, g_bar, t2, pa, pb, grand, sd, 0 AS k, CAST(g AS DOUBLE) AS gs, CAST(d AS DOUBLE) AS ds, false AS done FROM jn
UNION ALL SELECT dataset_id, gene_id, study, n, g, d, g_bar, t2, pa, pb, grand, sd, k + 1, gs2, ds2, greatest(abs(gs2 - gs), abs(ds2 - ds)) < 1e-4 FROM (
  SELECT *, (0.5 * ((n - 1) * d + n * (g - gs2) * (g - gs2)) + pb) / (n / 2.0 + pa - 1.0) AS ds2 FROM (
    SELECT *, (n * t2 * g + ds * g_bar) / (n * t2 + ds + 1e-300) AS gs2 FROM it WHERE NOT done AND k < 100) q1) q2)""",
            "fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, gene_id, study ORDER BY k DESC) AS lastk FROM it) q WHERE lastk = 1)",
            f"""cbv AS (SELECT c.dataset_id, c.gene_id, c.sample_id, c.study, ((count - grand) / sd - gs) / sqrt(greatest(ds, 1e-12)) * sd + grand AS value
FROM {source} c JOIN fi ON fi.dataset_id = c.dataset_id AND fi.gene_id = c.gene_id AND fi.study = c.study)""")


def recursive(ctes: str) -> str:
    return ctes.replace("WITH ", "WITH RECURSIVE ", 1)


@query("combat", recursive(with_views("dense", STUDY_SQL, *combat_ctes("st"))) + f"SELECT dataset_id, gene_id, sample_id, {rq('value', 'value')} FROM cbv")
def _(t):
    return values6(normalize.batch_correct(studied(t), "combat"))


PROFILE_SQL = with_views(
    "counts samples dense gstats libs",
    """grp AS (SELECT dataset_id, count(*) AS n_groups, min(n) AS lo, max(n) AS hi, avg(n) AS avg_n FROM
  (SELECT dataset_id, condition, count(*) AS n FROM samples GROUP BY 1, 2) GROUP BY 1)""",
    """lib AS (SELECT dataset_id, avg(lib) AS m, stddev_pop(lib) AS sd, min(lib) AS lo, max(lib) AS hi, quantile_cont(lib, 0.5) AS med,
  quantile_cont(lib, 0.75) - quantile_cont(lib, 0.25) AS iqr, avg(detected) AS gm, stddev_pop(detected) AS gsd FROM libs GROUP BY 1)""",
    """gene AS (SELECT dataset_id, count(*) AS n_genes, max(n) AS n_samples, count(*) FILTER (WHERE total > 0) AS n_expressed,
  count(*) FILTER (WHERE mean >= 10) AS n_rel, count(*) FILTER (WHERE mean >= 100) AS n_high, sum(zeros) AS n_zeros,
  sum(exp(-mean) * n) AS ez, count(*) FILTER (WHERE mean > 1 AND var > 0) AS nfit,
  regr_slope(log10(var), log10(mean)) FILTER (WHERE mean > 1 AND var > 0) AS slope,
  regr_intercept(log10(var), log10(mean)) FILTER (WHERE mean > 1 AND var > 0) AS icpt,
  regr_r2(log10(var), log10(mean)) FILTER (WHERE mean > 1 AND var > 0) AS r2 FROM gstats GROUP BY 1)""",
    """mask AS (SELECT dataset_id, CASE WHEN count(*) FILTER (WHERE mean >= 5) >= 50 THEN 5 ELSE 1 END AS fl FROM gstats GROUP BY 1)""",
    """disp0 AS (SELECT g.*, sum(CASE WHEN var > mean THEN 1 ELSE 0 END) OVER (PARTITION BY g.dataset_id) < 10 AS use_all,
  count(*) OVER (PARTITION BY g.dataset_id) AS kept FROM gstats g JOIN mask m ON m.dataset_id = g.dataset_id WHERE mean >= fl)""",
    """disp AS (SELECT dataset_id, gene_id, mean, var, (var > mean OR use_all) AS valid,
  least(greatest(CASE WHEN var > mean OR use_all THEN (var - mean) / (mean * mean) ELSE 0.0 END, 0.001), 10.0) AS d FROM disp0 WHERE kept >= 10)""",
    """trim AS (SELECT dataset_id, avg(d) AS common FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY d) AS k,
  count(*) OVER (PARTITION BY dataset_id) AS n FROM disp) WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY 1)""",
    """ds AS (SELECT dataset_id, avg(d) AS dm, quantile_cont(d, 0.5) AS dmed, stddev_pop(d) AS dsd, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS diqr,
  regr_slope(log10(d + 0.001), log10(mean + 1)) FILTER (WHERE valid) AS ts, regr_intercept(log10(d + 0.001), log10(mean + 1)) FILTER (WHERE valid) AS ti,
  quantile_cont(var / mean, 0.5) FILTER (WHERE var > 0) AS odr FROM disp GROUP BY 1)""",
    """ex AS (SELECT dataset_id, avg(x) AS em, quantile_cont(x, 0.5) AS emed, var_pop(x) AS ev,
  avg(x) AS mx, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS eiqr, max(x) - min(x) AS er,
  quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.95) AS p95, avg(count) AS cm, quantile_cont(count, 0.5) AS cmed,
  CAST(max(count) AS DOUBLE) AS cmax, log2(max(count) / min(count)) AS dr,
  count(*) FILTER (WHERE count >= 1 AND count < 10) AS n_low, count(*) FILTER (WHERE count >= 10 AND count < 100) AS n_med,
  count(*) FILTER (WHERE count >= 100 AND count < 1000) AS n_hi
  FROM (SELECT *, log2(count + 1.0) AS x FROM counts WHERE count > 0) GROUP BY 1)""",
    """sk AS (SELECT c.dataset_id, avg(pow(log2(count + 1.0) - em, 3)) / pow(max(ev), 1.5) AS skew, avg(pow(log2(count + 1.0) - em, 4)) / (max(ev) * max(ev)) - 3 AS kurt
  FROM counts c JOIN ex ON ex.dataset_id = c.dataset_id WHERE count > 0 GROUP BY 1)""")

PROFILE_OUT = [
    ("n_samples", "CAST(n_samples AS BIGINT)"), ("n_genes", "CAST(n_genes AS BIGINT)"), ("n_groups", "CAST(n_groups AS BIGINT)"),
    ("min_group_size", "CAST(grp.lo AS BIGINT)"), ("n_expressed_genes", "CAST(n_expressed AS BIGINT)"),
    ("n_reliably_expressed", "CAST(n_rel AS BIGINT)"), ("n_highly_expressed", "CAST(n_high AS BIGINT)")]
PROFILE_FLOATS = {
    "sample_balance": "grp.lo / grp.hi", "library_size_mean": "lib.m", "library_size_median": "lib.med", "library_size_std": "lib.sd",
    "library_size_cv": "lib.sd / lib.m", "library_size_range": "lib.hi / lib.lo", "library_size_iqr": "lib.iqr",
    "detection_rate": "n_expressed / n_genes", "reliable_detection_rate": "n_rel / n_genes",
    "genes_per_sample_mean": "gm", "genes_per_sample_cv": "gsd / gm",
    "expression_mean": "em", "expression_median": "emed", "expression_variance": "ev", "expression_skewness": "skew",
    "expression_kurtosis": "kurt", "expression_iqr": "eiqr", "expression_range": "er", "expression_p5": "p5", "expression_p95": "p95",
    "dispersion_mean": "dm", "dispersion_median": "dmed", "dispersion_std": "dsd", "dispersion_iqr": "diqr",
    "common_dispersion": "common", "bcv": "sqrt(common)", "trended_dispersion_slope": "ts", "trended_dispersion_intercept": "ti",
    "overdispersion_ratio": "odr", "sparsity": "n_zeros / (n_genes * n_samples)", "zero_inflation_index": "(n_zeros - ez) / ez",
    "dropout_rate": "1 - gm / n_genes", "low_count_proportion": "n_low / (n_genes * n_samples)",
    "medium_count_proportion": "n_med / (n_genes * n_samples)", "high_count_proportion": "n_hi / (n_genes * n_samples)",
    "count_mean": "cm", "count_median": "cmed", "count_max": "cmax", "dynamic_range": "dr",
    "mean_var_slope": "CASE WHEN nfit >= 50 THEN slope ELSE 0 END", "mean_var_intercept": "CASE WHEN nfit >= 50 THEN icpt ELSE 0 END",
    "mean_var_r_squared": "CASE WHEN nfit >= 50 THEN r2 ELSE 0 END",
    "poisson_fit_score": "CASE WHEN nfit >= 50 THEN exp(-abs(slope - 1)) ELSE 0 END",
    "nb_fit_score": "CASE WHEN nfit >= 50 THEN CASE WHEN slope BETWEEN 1.3 AND 2.2 THEN r2 ELSE r2 * 0.8 END ELSE 0 END"}
PROFILE_CATEGORIES = {
    "library_size_category": "CASE WHEN lib.sd / lib.m < 0.1 THEN 'low' WHEN lib.sd / lib.m < 0.3 THEN 'moderate' WHEN lib.sd / lib.m < 0.5 THEN 'high' ELSE 'very_high' END",
    "bcv_category": "CASE WHEN sqrt(common) < 0.2 THEN 'low' WHEN sqrt(common) < 0.4 THEN 'moderate' ELSE 'high' END",
    "sparsity_category": "CASE WHEN n_zeros / (n_genes * n_samples) < 0.3 THEN 'low' WHEN n_zeros / (n_genes * n_samples) < 0.6 THEN 'moderate' ELSE 'high' END",
    "design_complexity": "CASE WHEN n_groups <= 2 AND grp.lo / grp.hi >= 0.8 THEN 'simple' WHEN n_groups <= 4 AND grp.lo / grp.hi >= 0.5 THEN 'moderate' ELSE 'complex' END"}
PROFILE_FROM = " FROM gene " + " ".join(f"JOIN {x} ON {x}.dataset_id = gene.dataset_id" for x in ["grp", "lib", "trim", "ds", "ex", "sk"])


@query("profile_full", PROFILE_SQL + "SELECT gene.dataset_id, " + ", ".join(
    [f"{e} AS {n}" for n, e in PROFILE_OUT] + [rq(e, n) for n, e in PROFILE_FLOATS.items()]
    + [f"{e} AS {n}" for n, e in PROFILE_CATEGORIES.items()]) + PROFILE_FROM)
def _(t):
    p = profile.full_profile(t.counts(), t.samples())
    return p.select("dataset_id", *[n for n, _ in PROFILE_OUT], *[rnd(n).alias(n) for n in PROFILE_FLOATS], *PROFILE_CATEGORIES)


@query("profile_feature_vector", PROFILE_SQL + "SELECT gene.dataset_id, " + ", ".join([
    rq("log2(n_samples + 1)", "log2_n_samples", 4), rq("lib.iqr / (lib.m + 1)", "library_size_iqr_norm", 4), rq("log2(odr + 1)", "overdispersion_ratio", 4),
    rq("greatest(least((n_zeros - ez) / ez, 5), -5)", "zero_inflation_index", 3), rq("log2(dr + 1)", "dynamic_range", 4), "CAST(32 AS INTEGER) AS n_features"]) + PROFILE_FROM)
def _(t):
    p = profile.full_profile(t.counts(), t.samples())
    digits = {"log2_n_samples": 4, "library_size_iqr_norm": 4, "overdispersion_ratio": 4, "zero_inflation_index": 3, "dynamic_range": 4}
    return p.select("dataset_id", *[rnd(F.col("feature_vector")[profile.FEATURES.index(n)], d).alias(n) for n, d in digits.items()],
                    F.size("feature_vector").alias("n_features"))


@query("key_characteristics", PROFILE_SQL + f"""SELECT gene.dataset_id, CAST(n_genes AS BIGINT) AS n_genes, CAST(n_samples AS BIGINT) AS n_samples,
{rq('lib.m', 'library_size_mean')}, {rq('lib.sd / lib.m', 'library_size_cv')}, {rq('lib.hi / lib.lo', 'library_size_range')},
{rq('n_zeros / (n_genes * n_samples)', 'sparsity')}, {rq('qb', 'bcv')}, {rq('cmed', 'median_count')}, {rq('dr', 'dynamic_range')}, {rq('n_expressed / n_genes', 'detection_rate')}
{PROFILE_FROM} JOIN (SELECT dataset_id, sqrt(quantile_cont(least(greatest((var - mean) / (mean * mean), 0.001), 10.0), 0.5)) AS qb
FROM gstats WHERE mean >= 5 AND var > mean GROUP BY 1) q ON q.dataset_id = gene.dataset_id""")
def _(t):
    k = profile.key_characteristics(t.counts())
    return rounded(k, *[c for c in k.columns if c not in ("dataset_id", "n_genes", "n_samples")])


SCORE_SQL = PROFILE_SQL.rstrip() + """,
pr AS (SELECT gene.dataset_id, grp.lo AS mn, sqrt(common) AS bcv, n_low / (n_genes * n_samples) AS low, n_zeros / (n_genes * n_samples) AS sp,
  lib.sd / lib.m AS cv, lib.hi / lib.lo AS rng, CASE WHEN n_groups <= 2 AND grp.lo / grp.hi >= 0.8 THEN 0 WHEN n_groups <= 4 AND grp.lo / grp.hi >= 0.5 THEN 0 ELSE 1 END AS cx""" + PROFILE_FROM + """),
raw AS (SELECT dataset_id, mn, 'DESeq2' AS method, 2 AS mr, 70 + CASE WHEN mn < 3 THEN 20 WHEN mn < 8 THEN 15 WHEN mn < 20 THEN 10 ELSE 5 END
    + CASE WHEN bcv < 0.2 THEN 5 WHEN bcv < 0.4 THEN 10 ELSE 5 END + CASE WHEN low > 0.3 THEN 5 ELSE 0 END + CASE WHEN sp > 0.6 THEN 5 ELSE 0 END
    + CASE WHEN cv > 0.3 THEN 5 ELSE 0 END + CASE WHEN rng > 5 THEN 5 ELSE 0 END + 5 * cx AS s FROM pr
  UNION ALL SELECT dataset_id, mn, 'edgeR', 2, 70 + CASE WHEN mn < 3 THEN 10 WHEN mn < 8 THEN 15 WHEN mn < 20 THEN 10 ELSE 5 END
    + CASE WHEN bcv < 0.2 THEN 0 WHEN bcv < 0.4 THEN 10 ELSE 15 END + CASE WHEN low > 0.3 THEN 10 ELSE 0 END + CASE WHEN sp > 0.6 THEN 5 ELSE 0 END
    + CASE WHEN cv > 0.3 THEN 5 ELSE 0 END FROM pr
  UNION ALL SELECT dataset_id, mn, 'limma-voom', 3, 70 + CASE WHEN mn < 3 THEN -20 WHEN mn < 8 THEN 10 WHEN mn < 20 THEN 15 ELSE 20 END
    + CASE WHEN bcv < 0.2 THEN 10 WHEN bcv < 0.4 THEN 5 ELSE -5 END + 15 * cx FROM pr
  UNION ALL SELECT dataset_id, mn, 'Wilcoxon', 8, 50 + CASE WHEN mn < 3 THEN -30 WHEN mn < 8 THEN -20 WHEN mn < 20 THEN 15 ELSE 25 END - 15 * cx FROM pr
  UNION ALL SELECT dataset_id, mn, 'edgeR_robust', 2, 60 + CASE WHEN bcv >= 0.4 THEN 10 ELSE 0 END + CASE WHEN low > 0.3 THEN 5 ELSE 0 END FROM pr),
sc AS (SELECT dataset_id, method, CAST(CASE WHEN mn < mr THEN greatest(0, greatest(0, least(100, s)) - 30) ELSE greatest(0, least(100, s)) END AS DOUBLE) AS score FROM raw)
"""


@query("method_rule_scores", SCORE_SQL + "SELECT dataset_id, method, score FROM sc")
def _(t):
    return recommend.method_scores(profile.full_profile(t.counts(), t.samples())).select("dataset_id", "method", "score")


@query("method_recommendation", SCORE_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC,
  CASE method WHEN 'DESeq2' THEN 0 WHEN 'edgeR' THEN 1 WHEN 'limma-voom' THEN 2 WHEN 'Wilcoxon' THEN 3 ELSE 4 END) AS k FROM sc)
SELECT dataset_id, max(method) FILTER (WHERE k = 1) AS primary_method, max(score) FILTER (WHERE k = 1) AS primary_score,
  max(method) FILTER (WHERE k = 2) AS alternative_method, max(score) FILTER (WHERE k = 2) AS alternative_score,
  max(method) FILTER (WHERE k = 3) AS third_method, max(score) FILTER (WHERE k = 3) AS third_score FROM r GROUP BY 1""")
def _(t):
    r = recommend.recommend(profile.full_profile(t.counts(), t.samples()))
    return r.select("dataset_id", *[F.col(a).alias(b) for a, b in [
        ("primary", "primary_method"), ("primary_score", "primary_score"), ("alternative", "alternative_method"),
        ("alternative_score", "alternative_score"), ("third", "third_method"), ("third_score", "third_score")]])


@query("library_quality", with_views("libs", """a AS (SELECT dataset_id, avg(lib) AS m, stddev_samp(lib) / avg(lib) AS cv, min(lib) AS lo, max(lib) AS hi FROM libs GROUP BY 1)""") +
       f"""SELECT dataset_id, {rq('m', 'mean_size')}, {rq('cv', 'cv')}, lo AS min_size, hi AS max_size, {rq('hi / lo', 'size_range')},
{rq('greatest(0, 100 - least(30, cv * 50) - least(20, (hi / lo - 1) * 10))', 'score')},
CASE WHEN 100 - least(30, cv * 50) - least(20, (hi / lo - 1) * 10) > 70 THEN 'good' WHEN 100 - least(30, cv * 50) - least(20, (hi / lo - 1) * 10) > 50 THEN 'warning' ELSE 'poor' END AS status,
CAST(CAST(cv > 0.5 AS INTEGER) + CAST(lo < m * 0.3 AS INTEGER) + CAST(hi > m * 3 AS INTEGER) AS INTEGER) AS n_flags FROM a""")
def _(t):
    q = qc.library_quality(t.counts()).withColumn("n_flags", F.size("flags")).drop("flags")
    return rounded(q, "mean_size", "cv", "size_range", "score")


@query("gene_detection", with_views("gstats", "q AS (SELECT dataset_id, quantile_cont(mean, 0.25) AS q1, quantile_cont(mean, 0.75) AS q3 FROM gstats GROUP BY 1)",
       """a AS (SELECT g.dataset_id, count(*) AS n, avg(zeros / n) * 100 AS pct, count(*) FILTER (WHERE mean > q3) AS hi,
  count(*) FILTER (WHERE mean > q1 AND mean <= q3) AS med, count(*) FILTER (WHERE mean <= q1) AS lo FROM gstats g JOIN q ON q.dataset_id = g.dataset_id GROUP BY 1)""") +
       f"""SELECT dataset_id, {rq('1 - pct / 100', 'mean_detection_rate')}, {rq('pct', 'zero_inflation_pct')}, hi AS n_highly_expressed, med AS n_medium_expressed, lo AS n_low_expressed,
{rq('greatest(0, 100 - least(40, pct * 0.5) - CASE WHEN hi < n * 0.05 THEN 10 ELSE 0 END)', 'score')} FROM a""")
def _(t):
    q = qc.gene_detection(moments.gene_moments(t.counts())).drop("flags", "status")
    return rounded(q, "mean_detection_rate", "zero_inflation_pct", "score")


SIGNAL_CTES = ("cvs AS (SELECT dataset_id, gene_id, mean, CASE WHEN mean > 0 THEN sd / mean ELSE 0 END AS cv FROM gstats)",
               "md AS (SELECT dataset_id, quantile_cont(mean, 0.5) AS mm, quantile_cont(cv, 0.5) FILTER (WHERE cv > 0) AS mc FROM cvs GROUP BY 1)",
               "sg AS (SELECT c.dataset_id, count(*) AS n, count(*) FILTER (WHERE mean > mm AND cv > mc) AS k, max(mc) AS mc FROM cvs c JOIN md ON md.dataset_id = c.dataset_id GROUP BY 1)")


@query("biological_signal", with_views("gstats", *SIGNAL_CTES) + f"""SELECT dataset_id, {rq('k / n * 100', 'signal_strength')}, k AS n_signal_genes,
{rq('mc', 'median_cv')}, {rq('least(100, k / n * 200)', 'score')} FROM sg""")
def _(t):
    q = qc.biological_signal(moments.gene_moments(t.counts())).drop("flags", "status")
    return rounded(q, "signal_strength", "median_cv", "score")


@query("f_statistic_libraries", with_views("libs samples", "x AS (SELECT l.dataset_id, condition AS g, lib FROM libs l JOIN samples s ON s.dataset_id = l.dataset_id AND s.sample_id = l.sample_id)",
       "p AS (SELECT dataset_id, g, count(*) AS n, avg(lib) AS m, var_pop(lib) AS v FROM x GROUP BY 1, 2)",
       "t AS (SELECT dataset_id, sum(n * m) / sum(n) AS gm FROM p GROUP BY 1)") +
       f"""SELECT p.dataset_id, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_values,
{rq('(sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))', 'f')} FROM p JOIN t ON t.dataset_id = p.dataset_id GROUP BY 1""")
def _(t):
    libs = moments.sample_totals(t.counts()).join(t.samples(), ["dataset_id", "sample_id"])
    return rounded(qc.f_statistic(libs, ["dataset_id"], "library_size", "condition"), "f")


@query("confounding", with_views("samples", "p AS (SELECT dataset_id, condition, count(DISTINCT run) AS nb FROM samples GROUP BY 1, 2)",
       "p2 AS (SELECT dataset_id, condition, count(DISTINCT batch) AS nb FROM samples GROUP BY 1, 2)") +
       """SELECT a.dataset_id, run_confounded, batch_confounded FROM (SELECT dataset_id, min(nb) = 1 AND count(*) >= 2 AS run_confounded FROM p GROUP BY 1) a
JOIN (SELECT dataset_id, min(nb) = 1 AND count(*) >= 2 AS batch_confounded FROM p2 GROUP BY 1) b ON a.dataset_id = b.dataset_id""")
def _(t):
    s = t.samples()
    return (qc.confounding(s, "run", "condition").withColumnRenamed("confounded", "run_confounded")
            .join(qc.confounding(s, "batch", "condition").withColumnRenamed("confounded", "batch_confounded"), "dataset_id"))


@query("sample_components")
def _(t):
    pcs = outliers.principal_components(normalize.log2p1(t.counts()))
    return pcs.select("dataset_id", "sample_id", *[rnd(F.abs(F.col("scores")[j]), 4).alias(f"abs_pc{j + 1}") for j in range(3)],
                      rnd(F.col("ratios")[0], 6).alias("ratio1"))


@query("variance_structure")
def _(t):
    pcs = outliers.principal_components(normalize.log2p1(t.counts()))
    return rounded(qc.variance_structure(outliers.variance_ratios(pcs)), "pc1_variance", "pc2_variance")


@query("batch_effects")
def _(t):
    pcs = outliers.principal_components(normalize.log2p1(t.counts()))
    return qc.batch_effects(outliers.coordinates(pcs, 1), t.samples(), ["condition", "batch", "run"])


@query("outliers_basic")
def _(t):
    c = t.counts()
    return outliers.basic_outliers(outliers.principal_components(normalize.log2p1(c)), c)


@query("outliers_library_size", with_views("libs", "s AS (SELECT dataset_id, avg(lib) AS m, stddev_pop(lib) AS sd FROM libs GROUP BY 1)") +
       f"SELECT l.dataset_id, sample_id, {rq('abs(lib - m) / sd', 'z')}, abs(lib - m) / sd > 3 AS outlier FROM libs l JOIN s ON s.dataset_id = l.dataset_id")
def _(t):
    z = outliers.library_z(t.counts())
    return z.select("dataset_id", "sample_id", rnd("z").alias("z"), (F.col("z") > 3).alias("outlier"))


@query("outliers_mean_correlation", with_views("dense", LOGV,
       "st AS (SELECT dataset_id, gene_id, avg(v) AS m, CASE WHEN stddev_pop(v) > 1e-12 THEN stddev_pop(v) ELSE 1.0 END AS s FROM logv GROUP BY 1, 2)",
       "z AS (SELECT l.dataset_id, l.gene_id, l.sample_id, (v - m) / s AS z FROM logv l JOIN st ON st.dataset_id = l.dataset_id AND st.gene_id = l.gene_id)",
       "c AS (SELECT a.dataset_id, a.sample_id, b.sample_id AS o, corr(a.z, b.z) AS r FROM z a JOIN z b ON a.dataset_id = b.dataset_id AND a.gene_id = b.gene_id AND a.sample_id <> b.sample_id GROUP BY 1, 2, 3)") +
       f"SELECT dataset_id, sample_id, {rq('avg(r)', 'mean_correlation')} FROM c GROUP BY 1, 2")
def _(t):
    return rounded(outliers.mean_correlation(normalize.log2p1(t.counts())), "mean_correlation")


@query("outliers_correlation")
def _(t):
    return outliers.correlation_outliers(normalize.log2p1(t.counts()))


@query("outliers_pca_mahalanobis")
def _(t):
    return outliers.pca_mahalanobis_outliers(outliers.principal_components(normalize.log2p1(t.counts())))


@query("outliers_lof")
def _(t):
    return rounded(outliers.lof_outliers(outliers.principal_components(normalize.log2p1(t.counts()))), "score")


# Five coordinates a sample, so that both engines start from the same points.
POINTS = ("pc AS (SELECT l_returnflag AS dataset_id, CAST(l_suppkey % 24 AS INTEGER) AS sample_id, l_linenumber AS k, log2(sum(l_quantity) + 1.0) AS v FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2, 3)",
          "pt AS (SELECT s.dataset_id, s.sample_id, ks.k, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT dataset_id, sample_id FROM pc) s CROSS JOIN (VALUES (1), (2), (3), (4), (5)) ks(k) LEFT JOIN pc ON pc.dataset_id = s.dataset_id AND pc.sample_id = s.sample_id AND pc.k = ks.k)")


def points(t):
    line = F.col("l_linenumber")
    sums = (t.lineitem.where("l_linenumber <= 5").groupBy(F.col("l_returnflag").alias("dataset_id"), (F.col("l_suppkey") % 24).cast("int").alias("sample_id"))
            .agg(*[F.log2(F.coalesce(F.sum(F.when(line == k, F.col("l_quantity"))), F.lit(0.0)) + 1.0).alias(f"c{k}") for k in range(1, 6)]))
    sums = sums.withColumn("scores", F.array(*[f"c{k}" for k in range(1, 6)]))
    return sums.join(outliers.sample_index(sums), ["dataset_id", "sample_id"]).select("dataset_id", "sample_id", "i", "scores")


@query("lof_of_points", "WITH " + ", ".join(POINTS) + f""", dd AS (SELECT a.dataset_id, a.sample_id, b.sample_id AS o, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM pt a JOIN pt b ON a.dataset_id = b.dataset_id AND a.k = b.k AND a.sample_id <> b.sample_id GROUP BY 1, 2, 3),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, sample_id ORDER BY d, o) AS r FROM dd) q WHERE r <= 5),
kd AS (SELECT dataset_id, sample_id, max(d) AS kd FROM nn GROUP BY 1, 2),
lr AS (SELECT nn.dataset_id, nn.sample_id, 1.0 / (avg(greatest(nn.d, kd.kd)) + 1e-10) AS l FROM nn JOIN kd ON kd.dataset_id = nn.dataset_id AND kd.sample_id = nn.o GROUP BY 1, 2)
SELECT nn.dataset_id, nn.sample_id, {rq('avg(f.l) / max(own.l)', 'score')} FROM nn JOIN lr f ON f.dataset_id = nn.dataset_id AND f.sample_id = nn.o
JOIN lr own ON own.dataset_id = nn.dataset_id AND own.sample_id = nn.sample_id GROUP BY 1, 2""")
def _(t):
    return rounded(outliers.lof_scores(points(t), 5), "score")


@query("mahalanobis_of_points", "WITH " + ", ".join(POINTS) + f""", mo AS (SELECT dataset_id, k, avg(v) AS m, var_samp(v) AS s FROM pt GROUP BY 1, 2)
SELECT pt.dataset_id, sample_id, {rq('sqrt(sum((v - m) * (v - m) / s))', 'distance')} FROM pt JOIN mo ON mo.dataset_id = pt.dataset_id AND mo.k = pt.k GROUP BY 1, 2""")
def _(t):
    return rounded(outliers.mahalanobis(points(t)), "distance")


@query("outliers_isolation_forest")
def _(t):
    return rounded(outliers.isolation_forest_outliers(normalize.log2p1(t.counts())), "score")


@query("outliers_robust_covariance")
def _(t):
    return rounded(outliers.elliptic_outliers(outliers.principal_components(normalize.log2p1(t.counts()))), "score", digits=3)


@query("outliers_consensus")
def _(t):
    c = t.counts()
    return outliers.consensus_outliers(c, normalize.log2p1(c))


@query("quality_report")
def _(t):
    from . import flows
    return flows.quality_report(t.counts(), t.samples(), ["condition", "batch", "run"])
