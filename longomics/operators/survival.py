"""Survival analysis on (gene, sample, time, event, value) rows: Cox fits, concordance, log-rank scan.

Risk-set sums are reverse prefix sums over event times, computed with ordered block scans. The time
order does not change between iterations, so it is laid out once; an iteration is one aggregate per
(key, time) plus one scan. No task ever holds all samples of a gene.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from . import ordered
from .moments import GENE, SAMPLE
from ..functions.tails import normal_two_sided
from ..runtime import cut, settle

Z95 = 1.959963984540054
# Tied deaths that one task sums one by one.
TASK_DEATHS = 100_000


def _efron(term: Column, d: Column) -> Column:
    """Sum over the d tied deaths l = 0..d-1 of ``term(l / d)``."""
    return F.aggregate(F.sequence(F.lit(0), (d - 1).cast("int")), F.lit(0.0), lambda acc, i: acc + term(i / d))


def _dealt(risk: DataFrame, deaths: int, *keys: str) -> DataFrame:
    """Risk rows in parts that follow the deaths to be summed: the rows are few and small, so Spark would take one task."""
    parts = -(-deaths // TASK_DEATHS)
    return risk.repartition(parts, *keys) if parts > 1 else risk


def cox_univariate(cells: DataFrame, iterations: int = 12, tol: float = 1e-7) -> DataFrame:
    """One-covariate Cox model per gene (Efron ties, Newton steps), all genes in the same jobs.

    ``cells``: (gene_id, sample_id, time, event, value), every sample present for every gene.
    Values are centred and scaled per gene for the iterations and reported on the raw scale.
    """
    stats = cells.groupBy(GENE).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    usable = stats.where(F.col("s") > 1e-12)
    z = cells.join(usable, GENE).select(GENE, "time", "event", ((F.col("value") - F.col("m")) / F.col("s")).alias("x"))
    blocks = ordered.block_order(z.select(GENE, "time").distinct(), [GENE], ["time"])
    rows = cut(z.join(blocks, [GENE, "time"]))
    deaths = rows.where("event = 1").count()
    beta = cut(usable.select(GENE, F.lit(0.0).alias("beta"), F.lit(0.0).alias("info"), F.lit(1.0).alias("step")))

    def derivatives(current: DataFrame) -> DataFrame:
        w = F.exp(F.col("x") * F.col("beta"))
        e = F.col("event") == 1
        at = rows.join(current.select(GENE, "beta"), GENE).groupBy(GENE, ordered.BLOCK, "time").agg(
            F.sum(w).alias("w0"), F.sum(w * F.col("x")).alias("w1"), F.sum(w * F.col("x") * F.col("x")).alias("w2"),
            F.count_if(e).alias("d"), F.coalesce(F.sum(F.when(e, F.col("x"))), F.lit(0.0)).alias("dx"),
            F.coalesce(F.sum(F.when(e, w)), F.lit(0.0)).alias("d0"), F.coalesce(F.sum(F.when(e, w * F.col("x"))), F.lit(0.0)).alias("d1"),
            F.coalesce(F.sum(F.when(e, w * F.col("x") * F.col("x"))), F.lit(0.0)).alias("d2"))
        risk = ordered.scan(at, [GENE], ["time"], {"s0": ("sum", "w0"), "s1": ("sum", "w1"), "s2": ("sum", "w2")}, reverse=True)
        risk = _dealt(risk.where("d > 0"), deaths, GENE, "time")

        def mean(f: Column) -> Column:
            return (F.col("s1") - f * F.col("d1")) / (F.col("s0") - f * F.col("d0"))

        def second(f: Column) -> Column:
            return (F.col("s2") - f * F.col("d2")) / (F.col("s0") - f * F.col("d0")) - mean(f) * mean(f)

        return risk.groupBy(GENE).agg(F.sum(F.col("dx") - _efron(mean, F.col("d"))).alias("grad"),
                                      F.sum(_efron(second, F.col("d"))).alias("info"))

    for _ in range(iterations):
        d = derivatives(beta)
        move = F.when(F.col("info") > 1e-12, F.col("grad") / F.col("info")).otherwise(0.0)
        bounded = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), move))
        beta = cut(beta.select(GENE, "beta").join(d, GENE).select(GENE, (F.col("beta") + bounded).alias("beta"), "info",
                                                                   F.abs(bounded).alias("step")))
        if beta.where(F.col("step") > tol).isEmpty():
            break
    fit = beta.join(usable, GENE)
    coef, se = F.col("beta") / F.col("s"), F.when(F.col("info") > 0, 1.0 / (F.sqrt("info") * F.col("s")))
    out = fit.select(GENE, coef.alias("coef"), se.alias("se"), (F.col("beta") * F.sqrt("info")).alias("z"))
    return out.select(GENE, "coef", F.exp("coef").alias("hazard_ratio"), "se", "z",
                      F.exp(F.col("coef") - Z95 * F.col("se")).alias("ci_lower"),
                      F.exp(F.col("coef") + Z95 * F.col("se")).alias("ci_upper"),
                      normal_two_sided("z").alias("p_value"))


def cox_screen(cells: DataFrame, fdr: float = 0.05) -> DataFrame:
    fit = cut(cox_univariate(cells))
    adjusted = ordered.benjamini_hochberg(fit, [], "p_value", "adjusted_p_value")
    return adjusted.withColumn("significant", F.col("adjusted_p_value") < fdr)


def cox_fit(vectors: DataFrame, p: int, alpha: float = 0.0, l1_ratio: float = 1.0, iterations: int = 25,
            tol: float = 1e-7) -> np.ndarray:
    """Coefficients of a p-covariate Cox model, optionally with an elastic-net penalty.

    ``vectors``: (time, event, x array<double>), x standardised. Each iteration aggregates
    [w, w x, w x x^T] per event time, prefix-sums the components over descending time, and reduces
    gradient and information (p + p^2 numbers) for one proximal Newton step.
    """
    width = 1 + p + p * p
    blocks = ordered.block_order(vectors.select("time").distinct(), [], ["time"])
    rows = cut(vectors.join(blocks, "time"))
    n = rows.count()
    beta = np.zeros(p)

    def powers(weight: Column) -> Column:
        x = F.col("x")
        outer = F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
        return F.transform(F.concat(F.array(F.lit(1.0)), x, outer), lambda v: v * weight)

    def reduce_times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grad, info, loglik = np.zeros(p), np.zeros((p, p)), 0.0
        for pdf in batches:
            for s, dsum, d, dx in zip(pdf["s"], pdf["dsum"], pdf["d"], pdf["dx"]):
                s, dsum = np.asarray(s), np.asarray(dsum)
                f = np.arange(int(d)) / d
                s0 = s[0] - f * dsum[0]
                m = (s[1:p + 1][None] - f[:, None] * dsum[1:p + 1][None]) / s0[:, None]
                q = (s[p + 1:][None] - f[:, None] * dsum[p + 1:][None]) / s0[:, None]
                grad += np.asarray(dx) - m.sum(0)
                info += q.sum(0).reshape(p, p) - m.T @ m
                loglik -= np.log(s0).sum()
        yield pd.DataFrame({"v": [np.concatenate([grad, info.ravel(), [loglik]])]})

    for _ in range(iterations):
        eta = sum((F.col("x")[j] * float(beta[j]) for j in range(p)), F.lit(0.0))
        e = F.col("event") == 1
        zeros = F.array_repeat(F.lit(0.0), width)
        at = rows.withColumn("w", F.exp(eta)).groupBy(ordered.BLOCK, "time").agg(
            Summarizer.sum(array_to_vector(powers(F.col("w")))).alias("all"),
            Summarizer.sum(array_to_vector(F.when(e, powers(F.col("w"))).otherwise(zeros))).alias("dead"),
            Summarizer.sum(array_to_vector(F.when(e, F.col("x")).otherwise(F.array_repeat(F.lit(0.0), p)))).alias("dx"),
            F.count_if(e).alias("d"))
        at = cut(at.select(ordered.BLOCK, "time", vector_to_array("all").alias("all"), vector_to_array("dead").alias("dsum"),
                           vector_to_array("dx").alias("dx"), "d"))
        long = at.select(ordered.BLOCK, "time", F.posexplode("all").alias("c", "v"))
        sums = ordered.scan(long, ["c"], ["time"], {"s": ("sum", "v")}, reverse=True)
        risk = sums.groupBy("time").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("r"))
        joined = at.where("d > 0").join(risk, "time").select(F.col("r.s").alias("s"), "dsum", "d", "dx")
        part = joined.mapInPandas(reduce_times, "v array<double>")
        v = np.asarray(part.agg(Summarizer.sum(array_to_vector("v")).alias("v")).first()["v"].toArray())
        grad, info = v[:p] / n, v[p:p + p * p].reshape(p, p) / n
        step = proximal_newton(beta, grad, info, alpha * l1_ratio, alpha * (1 - l1_ratio))
        moved = np.clip(step - beta, -2.0, 2.0)
        beta = beta + moved
        if np.abs(moved).max() < tol:
            break
    return beta


def proximal_newton(beta: np.ndarray, grad: np.ndarray, info: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Minimise the local quadratic model with L1 and L2 terms by coordinate descent."""
    b = beta.copy()
    h = info + 1e-9 * np.eye(len(b))
    for _ in range(500):
        before = b.copy()
        for j in range(len(b)):
            r = grad[j] - h[j] @ (b - beta) + h[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - l1, 0.0) / (h[j, j] + l2)
        if np.abs(b - before).max() < 1e-10:
            break
    return b


def cox_lasso(cells: DataFrame, alpha: float = 0.1, l1_ratio: float = 1.0, iterations: int = 300,
              tol: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """Elastic-net Cox model over all genes of ``cells``: (gene_id, coef) and (sample_id, time, event, score).

    ``cells``: (gene_id, sample_id, time, event, value), every sample present for every gene; values are z-scored, genes
    without spread get coefficient 0. Minimises -loglik / n + alpha (l1_ratio |b| + (1 - l1_ratio) b^2 / 2), Efron ties.

    The gradient of a gene is the sum of its values times the samples' martingale residuals, so a step is two scans over
    event times and one aggregate over the cells: nothing grows with genes^2, and coefficients stay a table. Step lengths
    follow the last change of the gradient (Barzilai and Borwein) and are halved until the objective falls enough below the
    highest of the last five.
    """
    usable = cells.groupBy(GENE).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).where("s > 1e-12")
    z = settle(cells.join(usable, GENE).select(GENE, SAMPLE, ((F.col("value") - F.col("m")) / F.col("s")).alias("x")))
    people = cells.groupBy(SAMPLE).agg(F.max("time").alias("time"), F.max("event").alias("event"))
    blocks = ordered.block_order(people.select("time").distinct(), [], ["time"])
    rows = settle(people.join(blocks, "time"))
    n, genes, deaths = rows.count(), z.select(GENE).distinct().count(), rows.where("event = 1").count()
    l1, l2, dead, eta = alpha * l1_ratio, alpha * (1 - l1_ratio), F.col("event") == 1, F.col("eta")

    def scores(beta: DataFrame) -> DataFrame:
        used = z.join(beta.where("beta <> 0").select(GENE, "beta"), GENE).groupBy(SAMPLE).agg(F.sum(F.col("x") * F.col("beta")).alias("eta"))
        return rows.join(used, SAMPLE, "left").withColumn("eta", F.coalesce("eta", F.lit(0.0)))

    def evaluate(beta: DataFrame) -> tuple[float, DataFrame]:
        """Loss, and the table with the gradient beside each coefficient."""
        at = settle(scores(beta).withColumn("w", F.exp(eta)))
        times = at.groupBy(ordered.BLOCK, "time").agg(
            F.sum("w").alias("w0"), F.count_if(dead).alias("d"), F.sum(F.when(dead, F.col("w")).otherwise(0.0)).alias("d0"),
            F.sum(F.when(dead, eta).otherwise(0.0)).alias("de"))
        left = lambda f: F.col("s0") - f * F.col("d0")
        each = lambda term: F.when(F.col("d") > 0, _efron(term, F.col("d"))).otherwise(0.0)
        risk = _dealt(ordered.scan(times, [], ["time"], {"s0": ("sum", "w0")}, reverse=True), deaths, "time").select(
            ordered.BLOCK, "time", each(lambda f: 1.0 / left(f)).alias("h"), each(lambda f: f / left(f)).alias("own"),
            (F.col("de") - each(lambda f: F.log(left(f)))).alias("ll"))
        if deaths > TASK_DEATHS:
            risk = settle(risk)
        curve = settle(ordered.scan(risk, [], ["time"], {"hazard": ("sum", "h")}))
        loss = -(curve.agg(F.sum("ll")).first()[0] or 0.0) / max(n, 1)
        kept = F.when(dead, 1.0 + F.col("w") * F.col("own")).otherwise(0.0) - F.col("w") * F.col("hazard")
        residual = at.join(curve.select("time", "own", "hazard"), "time").select(SAMPLE, kept.alias("r"))
        slope = z.join(residual, SAMPLE).groupBy(GENE).agg((-F.sum(F.col("x") * F.col("r")) / n).alias("slope"))
        return loss, beta.join(slope, GENE)

    def penalty(row) -> float:
        return l1 * (row["size"] or 0.0) + l2 / 2 * (row["square"] or 0.0)

    sizes = F.sum(F.abs("beta")).alias("size"), F.sum(F.col("beta") * F.col("beta")).alias("square")
    loss, graded = evaluate(usable.select(GENE, F.lit(0.0).alias("beta")))
    state, recent, step = settle(graded), [loss], 1.0 / max(genes, 1)
    for _ in range(iterations if genes else 0):
        raw = F.col("beta") - step * F.col("slope")
        shrunk = F.signum(raw) * F.greatest(F.abs(raw) - step * l1, F.lit(0.0)) / (1.0 + step * l2)
        moved = state.select(GENE, shrunk.alias("beta"), (shrunk - F.col("beta")).alias("move"), F.col("slope").alias("before"))
        loss, graded = evaluate(moved)
        graded = settle(graded)
        turn = F.col("move") * (F.col("slope") - F.col("before"))
        row = graded.agg(*sizes, F.sum(F.col("move") * F.col("move")).alias("far"), F.sum(turn).alias("turn"), F.max(F.abs("move")).alias("most")).first()
        reached = loss + penalty(row)
        # A loss that overflowed is not a number and fails the comparison as well.
        if not reached <= max(recent[-5:]) - 1e-4 / (2 * step) * row["far"] + 1e-12:
            step /= 2
            continue
        state = graded
        recent.append(reached)
        if row["most"] < tol:
            break
        step = min(row["far"] / row["turn"], 1e6) if row["turn"] > 0 else step * 2
    coefs = cells.select(GENE).distinct().join(state.select(GENE, "beta"), GENE, "left").select(GENE, F.coalesce("beta", F.lit(0.0)).alias("coef"))
    return coefs, scores(state).select(SAMPLE, "time", "event", F.round("eta", 9).alias("score"))


def concordance_index(df: DataFrame) -> DataFrame:
    """Harrell's C of (time, event, score), higher score meaning earlier event.

    Comparable pairs are counted, never listed: a pair (event at t, later sample) is concordant when
    its score is larger, so C needs, per event, how many later samples have smaller or equal scores.
    Scores are reduced to ranks, and the two-dimensional counts come from a merge over bit levels of
    the rank: at each level a prefix sum over time inside a rank bucket.
    """
    ranks = ordered.row_numbers(df.select("score").distinct(), [], ["score"], "r")
    rows = cut(df.join(ranks, "score").select("time", "event", F.col("r").cast("bigint").alias("r")))
    top = rows.agg(F.max("r")).first()[0] or 1
    spread = bit_levels(rows, "r", top)
    grouped = spread.groupBy("lvl", "bucket", "time").agg(
        F.count_if(F.col("bit") == 0).alias("low"), F.count_if(F.col("bit") == 1).alias("high"),
        F.count_if((F.col("bit") == 0) & (F.col("event") == 1)).alias("low_e"),
        F.count_if((F.col("bit") == 1) & (F.col("event") == 1)).alias("high_e"))
    later = ordered.scan(ordered.block_order(grouped, ["lvl", "bucket"], ["time"]), ["lvl", "bucket"], ["time"],
                         {"low_from": ("sum", "low"), "high_from": ("sum", "high")}, reverse=True)
    lo_after, hi_after = F.col("low_from") - F.col("low"), F.col("high_from") - F.col("high")
    # Ties in time: a death is comparable with samples censored at the same time.
    lo_c, hi_c = lo_after + F.col("low") - F.col("low_e"), hi_after + F.col("high") - F.col("high_e")
    split = later.agg(F.sum(F.col("high_e") * lo_c).alias("good"), F.sum(F.col("low_e") * hi_c).alias("bad"))
    same = rows.groupBy("r", "time").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event") == 1).alias("e"))
    tied = ordered.scan(ordered.block_order(same, ["r"], ["time"]), ["r"], ["time"], {"from": ("sum", "n")}, reverse=True)
    ties = tied.agg(F.sum(F.col("e") * (F.col("from") - F.col("e"))).alias("tie"))
    both = split.crossJoin(F.broadcast(ties))
    total = F.col("good") + F.col("bad") + F.col("tie")
    return both.select("good", "bad", "tie", F.when(total > 0, (F.col("good") + 0.5 * F.col("tie")) / total).alias("c_index"))


def bit_levels(rows: DataFrame, rank: str, top: int) -> DataFrame:
    """One row per bit of the rank: two ranks lo < hi share a bucket and differ in the bit at exactly
    one level, so sums over pairs become scans inside (level, bucket)."""
    levels = max(1, int(top).bit_length())
    return (rows.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
            .withColumn("bucket", F.expr(f"shiftright({rank}, lvl + 1)"))
            .withColumn("bit", F.expr(f"shiftright({rank}, lvl) & 1")))


def logrank_scan(df: DataFrame, min_side: int = 5) -> DataFrame:
    """Log-rank chi-square of every inner distinct score as a cut-off (high group = score >= cutoff).

    ``df``: (sample_id, time, event, score). Observed and expected deaths of the high group are
    prefix sums over scores (expected = summed cumulative hazards at the samples' times). The
    variance needs sum_t a_t r1_t^2 = sum over sample pairs of B(min time): pairs are summed by bit
    levels of the score rank, so the whole scan is n log n rows and a few ordered passes.
    """
    ranked = ordered.row_numbers(df, [], ["score", SAMPLE], "r").withColumn("r", F.col("r").cast("bigint"))
    per_time = df.groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event") == 1).alias("d"))
    blocks = ordered.block_order(per_time, [], ["time"])
    risk = ordered.scan(blocks, [], ["time"], {"at": ("sum", "n")}, reverse=True)
    at, d = F.col("at").cast("double"), F.col("d")
    a = F.when(at > 1, d * (at - d) / ((at - 1) * at * at)).otherwise(0.0)
    risk = risk.select(ordered.BLOCK, "time", (d / at).alias("h"), (a * at).alias("ar"), a.alias("b"))
    curves = ordered.scan(risk, [], ["time"], {"c_h": ("sum", "h"), "c_a": ("sum", "ar"), "c_b": ("sum", "b")})
    rows = cut(ranked.join(curves.select("time", "c_h", "c_a", "c_b"), "time"))
    top = rows.count()
    lv = bit_levels(rows.select("r", "time", "c_b"), "r", top)
    per = lv.groupBy("lvl", "bucket", "time").agg(
        F.sum(F.when(F.col("bit") == 1, F.col("c_b")).otherwise(0.0)).alias("hb"), F.count_if(F.col("bit") == 1).alias("hn"))
    pref = ordered.scan(ordered.block_order(per, ["lvl", "bucket"], ["time"]), ["lvl", "bucket"], ["time"],
                        {"pb": ("sum", "hb"), "pn": ("sum", "hn")})
    total = per.groupBy("lvl", "bucket").agg(F.sum("hn").alias("tn"))
    low = (lv.where("bit = 0").join(pref.select("lvl", "bucket", "time", "pb", "pn"), ["lvl", "bucket", "time"])
           .join(total, ["lvl", "bucket"]))
    pair = low.groupBy("r").agg(F.sum(F.col("pb") + F.col("c_b") * (F.col("tn") - F.col("pn"))).alias("s"))
    u = F.col("c_b") + 2.0 * F.coalesce("s", F.lit(0.0))
    by_score = rows.join(pair, "r", "left").groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event") == 1).alias("o"), F.sum("c_h").alias("e"),
        F.sum("c_a").alias("va"), F.sum(u).alias("vq"))
    cum = ordered.scan(ordered.block_order(by_score, [], ["-score"]), [], ["-score"], {
        "n_high": ("sum", "n"), "obs": ("sum", "o"), "exp": ("sum", "e"), "sa": ("sum", "va"), "sq": ("sum", "vq")})
    ends = by_score.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    v = F.col("sa") - F.col("sq")
    ok = ((F.col("score") > F.col("lo")) & (F.col("score") < F.col("hi")) & (F.col("n_high") >= min_side)
          & (top - F.col("n_high") >= min_side) & (v > 1e-12))
    return cum.crossJoin(F.broadcast(ends)).where(ok).select(
        F.col("score").alias("cutoff"), "n_high", (F.pow(F.col("obs") - F.col("exp"), 2) / v).alias("chi2"))


def best_cutoff(scan: DataFrame) -> DataFrame:
    """Cut-off with the largest chi-square, the smallest such cut-off winning."""
    top = F.max_by(F.struct("cutoff", "chi2"), F.struct("chi2", -F.col("cutoff")))
    return scan.agg(top.alias("b")).select("b.*")


def align_clinical(values: DataFrame, clinical: DataFrame, minimum: int = 10) -> DataFrame:
    """Join expression and survival by sample; at least ``minimum`` shared samples are required."""
    c = clinical.where("os_time IS NOT NULL AND os_event IS NOT NULL")
    aligned = cut(values.join(c.select(SAMPLE, F.col("os_time").alias("time"), F.col("os_event").alias("event")), SAMPLE))
    shared = aligned.select(SAMPLE).distinct().limit(minimum).count()
    if shared < minimum:
        raise ValueError(f"only {shared} samples with survival data (need {minimum})")
    return aligned
