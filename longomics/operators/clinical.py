"""Clinical metrics over predictions (by..., y 0/1, score): AUC, ROC, Youden, decision curves, NRI."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ordered
from ..functions.tails import normal_two_sided

# Default threshold probabilities of a decision curve.
THRESHOLDS = [0.01 + 0.01 * i for i in range(99)]


def ppv_npv(sens: Column, spec: Column, prevalence: Column) -> dict[str, Column]:
    tp, fp = sens * prevalence, (1 - spec) * (1 - prevalence)
    tn, fn = spec * (1 - prevalence), (1 - sens) * prevalence
    return {"ppv": tp / (tp + fp), "npv": tn / (tn + fn)}


def _by_score(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def auc(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve by rank sums with averaged ties; null unless both classes occur."""
    d = _by_score(df, by, y, score)
    cum = ordered.scan(ordered.block_order(d, by, ["score"]), by, ["score"], {"below": ("sum", "neg")})
    a = cum.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0)).alias("_u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return a.select(*by, "n_pos", "n_neg",
                    F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                           F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def roc_points(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """One point per distinct score (threshold descending) plus the +infinity start."""
    d = _by_score(df, by, y, score)
    cum = ordered.scan(ordered.block_order(d, by, ["-score"]), by, ["-score"],
                       {"tp": ("sum", "pos"), "fp": ("sum", "neg")}, totals={"P": "tp", "N": "fp"})
    totals = d.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    points = cum.select(*by, F.col("score").alias("threshold"), "tp", "fp", "P", "N")
    zero = F.lit(0).cast("bigint")
    start = totals.select(*by, F.lit(float("inf")).alias("threshold"), zero.alias("tp"), zero.alias("fp"), "P", "N")
    both = points.unionByName(start)
    return both.select(*by, "threshold", (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr"))


def youden(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest such threshold wins."""
    pts = roc_points(df, by, y, score).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 14))
    best = pts.groupBy(*by).agg(F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct("j", "threshold")).alias("b"))
    out = best.select(*by, F.col("b.threshold").alias("threshold"), F.col("b.tpr").alias("sensitivity"),
                      (1.0 - F.col("b.fpr")).alias("specificity"), (F.col("b.tpr") - F.col("b.fpr")).alias("youdens_j"))
    a = auc(df, by, y, score).select(*by, "auc")
    return out.join(a, list(by)) if by else out.crossJoin(F.broadcast(a))


def decision_curve(df: DataFrame, by: Sequence[str] = (), thresholds: Sequence[float] | None = None,
                   y: str = "y", score: str = "score") -> DataFrame:
    """Net benefit of the model, of treating all and of treating none at each threshold.

    Rows shrink to a histogram over the threshold positions before thresholds are applied.
    """
    points = [t for t in (THRESHOLDS if thresholds is None else thresholds) if 0 < t < 1]
    arr = F.array(*[F.lit(float(t)) for t in points])
    hist = (df.select(*by, (F.col(y) == 1).alias("e"), F.size(F.filter(arr, lambda t: t <= F.col(score))).alias("k"))
            .groupBy(*by, "k").agg(F.count_if("e").alias("pos"), F.count_if(~F.col("e")).alias("neg")))
    spread = hist.select(*by, "k", "pos", "neg", F.posexplode(F.sort_array(arr)).alias("i", "threshold"))
    hit = F.col("k") > F.col("i")
    a = spread.groupBy(*by, "threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("P"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    w, rate = F.col("threshold") / (1 - F.col("threshold")), F.col("P") / F.col("n")
    return a.select(*by, "threshold", (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * w).alias("net_benefit_model"),
                    (rate - (1 - rate) * w).alias("net_benefit_treat_all"), F.lit(0.0).alias("net_benefit_treat_none"))


def risk_category(p: Column, cutoffs: Sequence[float] = (0.2, 0.5)) -> Column:
    """Number of sorted cut-offs reached."""
    total = F.lit(0)
    for c in sorted(cutoffs):
        total = total + (p >= c).cast("int")
    return total


def net_reclassification(df: DataFrame, by: Sequence[str] = (), cutoffs: Sequence[float] = (0.2, 0.5),
                         y: str = "y", old: str = "risk_old", new: str = "risk_new") -> DataFrame:
    a_, b_ = risk_category(F.col(old), cutoffs), risk_category(F.col(new), cutoffs)
    event, up, down = F.col(y) == 1, b_ > a_, b_ < a_
    c = df.groupBy(*by).agg(
        F.count_if(event).alias("n_events"), F.count_if(~event).alias("n_nonevents"),
        F.count_if(event & up).alias("events_up"), F.count_if(event & down).alias("events_down"),
        F.count_if(~event & up).alias("nonevents_up"), F.count_if(~event & down).alias("nonevents_down"))
    ne, nn = F.col("n_events"), F.col("n_nonevents")
    eu, ed, nu, nd = (F.col(x) for x in ("events_up", "events_down", "nonevents_up", "nonevents_down"))
    gain_e, gain_n = (eu - ed) / ne, (nd - nu) / nn
    var = (((eu + ed) / ne - gain_e * gain_e) / ne) + (((nu + nd) / nn - gain_n * gain_n) / nn)
    se = F.when(var > 0, F.sqrt(var)).otherwise(1e-10)
    out = c.where((ne > 0) & (nn > 0)).select(
        "*", gain_e.alias("nri_events"), gain_n.alias("nri_nonevents"), (gain_e + gain_n).alias("nri"),
        ((gain_e + gain_n) / se).alias("z_score"))
    return out.withColumn("p_value", normal_two_sided("z_score"))


def bootstrap_auc(df: DataFrame, by: Sequence[str] = (), replicates: int = 2000, ci: float = 0.95,
                  seed: int = 42, y: str = "y", score: str = "score") -> DataFrame:
    """Percentile interval of the AUC from Poisson-weighted resamples.

    Distinct scores (with class counts) are block-ordered once. A block draws the weights of its
    scores for all replicates, seeded by score, and emits three numbers per replicate; carries over
    blocks complete each replicate's rank sum. Rows are never multiplied by the replicates.
    """
    if not 0.5 <= ci < 1.0:
        raise ValueError("ci must lie in [0.5, 1)")
    keys = list(by)
    blocks = ordered.block_order(_by_score(df, by, y, score), by, ["score"])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        pos, neg = np.zeros(replicates), np.zeros(replicates)
        within = np.zeros(replicates)
        for s, a, b in zip(pdf["score"], pdf["pos"], pdf["neg"]):
            rng = np.random.default_rng([seed, int(np.float64(s).view(np.uint64))])
            wa, wb = rng.poisson(a, replicates), rng.poisson(b, replicates)
            within += wa * (neg + wb / 2.0)
            pos += wa
            neg += wb
        out = pd.DataFrame({"rep": np.arange(replicates), "pos": pos, "neg": neg, "within": within})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out[ordered.BLOCK] = pdf[ordered.BLOCK].iloc[0]
        return out[[*keys, ordered.BLOCK, "rep", "pos", "neg", "within"]]

    schema = ", ".join([*[f"{k} {df.schema[k].dataType.simpleString()}" for k in keys],
                        f"{ordered.BLOCK} int, rep int, pos double, neg double, within double"])
    parts = blocks.groupBy(*keys, ordered.BLOCK).applyInPandas(draw, schema)
    before = (Window.partitionBy(*keys, "rep").orderBy(ordered.BLOCK)
              .rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    per_rep = parts.groupBy(*keys, "rep").agg(
        F.sum(F.col("within") + F.col("pos") * F.col("ahead")).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    est = per_rep.where("p > 0 AND n > 0").withColumn("est", F.col("u") / (F.col("p") * F.col("n")))
    return _interval(est, auc(df, by, y, score).select(*keys, F.col("auc").alias("point_estimate")), keys, ci)


def _interval(est: DataFrame, point: DataFrame, keys: list[str], ci: float) -> DataFrame:
    """Percentile interval over at most ``replicates`` estimates per key; fewer than 100 give nulls."""
    tail = (1.0 - ci) / 2.0
    a = est.groupBy(*keys).agg(F.percentile("est", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("q"),
                               F.count(F.lit(1)).alias("n_bootstrap"))
    a = point.join(a, keys) if keys else point.crossJoin(F.broadcast(a))
    enough = F.col("n_bootstrap") >= 100
    return a.select(*keys, "point_estimate", F.when(enough, F.col("q")[0]).alias("ci_lower"),
                    F.when(enough, F.col("q")[1]).alias("ci_upper"), F.lit(ci).alias("ci_level"), "n_bootstrap")


def bootstrap_metric(df: DataFrame, metric: Callable[[Column, Column, Column], Column], row_id: str,
                     by: Sequence[str] = (), replicates: int = 2000, ci: float = 0.95, seed: int = 42,
                     y: str = "y", score: str = "score") -> DataFrame:
    """Interval of any weighted aggregate ``metric(weight, y, score)``.

    Poisson(1) weights come from a seeded hash of (row id, replicate), so partial aggregates leave
    only replicates x partitions rows for the shuffle. One-class resamples are skipped.
    """
    keys = list(by)
    # Cumulative Poisson(1) probabilities up to the resolution of the 53-bit draw.
    cdf, term = [math.exp(-1.0)], math.exp(-1.0)
    while (term := term / len(cdf)) > 2.0 ** -53:
        cdf.append(cdf[-1] + term)
    u = F.pmod(F.xxhash64(row_id, "rep", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    weight = F.lit(0)
    for c in cdf:
        weight = weight + (u >= c).cast("int")
    reps = (df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
            .withColumn("_w", weight).where("_w > 0"))
    est = reps.groupBy(*keys, "rep").agg(metric(F.col("_w"), F.col(y), F.col(score)).alias("est"),
                                         F.min(y).alias("lo"), F.max(y).alias("hi")).where("lo <> hi AND est IS NOT NULL")
    point = df.groupBy(*keys).agg(metric(F.lit(1), F.col(y), F.col(score)).alias("point_estimate"))
    return _interval(est, point, keys, ci)
