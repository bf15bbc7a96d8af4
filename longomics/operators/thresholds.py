"""Threshold tuning: score a whole parameter grid from one small histogram of the result table.

A gene passes (alpha, lfc) iff p < alpha and |log2fc| > lfc. Each row is reduced to two positions
(how many alphas it fails, how many lfc cut-offs it passes); counting rows per position pair is one
map-side-combined aggregate, and every grid point's totals come from that histogram. Rows are never
multiplied by the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from . import ordered
from .compare import ratio
from ..runtime import cut, settle, small

# Parameter bounds and the lambda grid of the null-proportion estimate.
ALPHA_BOUNDS = (0.001, 0.20)
LFC_BOUNDS = (0.0, 2.0)
LAMBDAS = [round(0.05 * i, 2) for i in range(1, 19)]
# Sets of draws whose shared counts a task holds before it hands them on.
HELD = 64

Params = Sequence[tuple[float, float]]


def grid_points(n: int = 5, alpha: tuple[float, float] = ALPHA_BOUNDS, lfc: tuple[float, float] = LFC_BOUNDS) -> Params:
    return [(float(a), float(c)) for a in np.linspace(*alpha, n) for c in np.linspace(*lfc, n)]


def random_points(n: int, seed: int = 42, alpha=ALPHA_BOUNDS, lfc=LFC_BOUNDS) -> Params:
    rng = np.random.default_rng(seed)
    return [(float(rng.uniform(*alpha)), float(rng.uniform(*lfc))) for _ in range(n)]


def passing_counts(rows: DataFrame, params: Params, by: Sequence[str], p: str, lfc: str,
                   classes: dict[str, Column]) -> DataFrame:
    """Per (by, iteration): rows passing the point, counted per class condition."""
    alphas = sorted({a for a, _ in params})
    cuts = sorted({c for _, c in params})
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    positioned = rows.select(
        *by, *[c.alias(f"_is_{n}") for n, c in classes.items()],
        F.when(F.col(p).isNull() | F.isnan(p), F.lit(len(alphas)))
        .otherwise(F.size(F.filter(arr(alphas), lambda a: a <= F.col(p)))).alias("_ia"),
        F.size(F.filter(arr(cuts), lambda c: c < F.abs(lfc))).alias("_il"))
    hist = positioned.groupBy(*by, "_ia", "_il").agg(
        *[F.count_if(f"_is_{n}").alias(n) for n in classes])
    points = F.array(*[F.struct(F.lit(i).alias("iteration"), F.lit(a).alias("alpha"), F.lit(c).alias("lfc"),
                                F.lit(alphas.index(a)).alias("ka"), F.lit(cuts.index(c)).alias("kl"))
                       for i, (a, c) in enumerate(params)])
    spread = hist.withColumn("g", F.explode(points))
    ok = (F.col("_ia") <= F.col("g.ka")) & (F.col("_il") > F.col("g.kl"))
    return spread.groupBy(*by, F.col("g.iteration").alias("iteration"), F.col("g.alpha").alias("alpha"),
                          F.col("g.lfc").alias("lfc")).agg(
        *[F.sum(F.when(ok, F.col(n)).otherwise(0)).alias(n) for n in classes])


def pi0(de: DataFrame, by: Sequence[str], p: str = "p_value") -> DataFrame:
    """Storey's null proportion: median over the lambda grid of min(1, #p > l / (m (1 - l)))."""
    v = F.col(p)
    known = v.isNotNull() & ~F.isnan(v)
    a = de.groupBy(*by).agg(F.count_if(known).alias("m"), *[F.count_if(known & (v > x)).alias(f"a{i}") for i, x in enumerate(LAMBDAS)])
    est = F.array_sort(F.array(*[F.least(F.lit(1.0), F.col(f"a{i}") / (F.col("m") * (1.0 - x))) for i, x in enumerate(LAMBDAS)]))
    half = len(LAMBDAS) // 2
    return a.select(*by, F.when(F.col("m") == 0, 1.0).otherwise((est[half - 1] + est[half]) / 2.0).alias("pi0"))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return ratio(2 * precision * recall, precision + recall)


def ground_truth_trials(de: DataFrame, truth: DataFrame, params: Params, by: Sequence[str],
                        check_direction: bool = True) -> DataFrame:
    """F1 against known genes; a true positive with the wrong direction counts as one fp and one fn."""
    has_dir = check_direction and "expected_direction" in truth.columns
    known = truth.select("gene_id", F.lit(True).alias("_true"),
                         *([F.col("expected_direction")] if has_dir else []))
    joined = de.join(known, "gene_id", "left").withColumn("_true", F.coalesce("_true", F.lit(False)))
    p = "padj" if "padj" in de.columns else "p_value"
    predicted = F.when(F.col("log2fc") > 0, "up").otherwise("down")
    wrong = F.col("_true") & (F.col("expected_direction") != predicted) if has_dir else F.lit(False)
    c = passing_counts(joined, params, by, p, "log2fc",
                       {"hits": F.col("_true"), "misses": ~F.col("_true"), "wrong": F.coalesce(wrong, F.lit(False)),
                        })
    n_true = truth.select("gene_id").distinct().agg(F.count(F.lit(1)).alias("n_true"))
    c = c.crossJoin(F.broadcast(n_true))
    hits, misses, w = F.col("hits"), F.col("misses"), F.col("wrong")
    fn = F.col("n_true") - hits
    return c.select(*by, "iteration", "alpha", "lfc", hits.alias("true_positives"), misses.alias("false_positives"),
                    fn.alias("false_negatives"), w.alias("wrong_direction"),
                    f1_of(hits - w, misses + w, fn + w).alias("score"))


def ground_truth_metrics(trials: DataFrame, de: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision, recall, F1, accuracy per trial; true negatives are rows minus tp, fp and fn."""
    n = de.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    t = trials.join(n, list(by)) if by else trials.crossJoin(F.broadcast(n))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    tn = F.col("n_rows") - tp - fp - fn
    return t.select(*by, "iteration", "alpha", "lfc", tp, fp, fn, tn.alias("true_negatives"),
                    ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                    f1_of(tp, fp, fn).alias("f1_score"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def fdr_trials(de: DataFrame, params: Params, by: Sequence[str], target: float = 0.05) -> DataFrame:
    """1 - |estimated FDR - target| with FDR = pi0 * alpha * m / n_significant (raw p-values)."""
    c = passing_counts(de, params, by, "p_value", "log2fc", {"n_significant": F.lit(True)})
    n = de.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"))
    base = n.join(pi0(de, by), list(by)) if by else n.crossJoin(F.broadcast(pi0(de, by)))
    c = c.join(base, list(by)) if by else c.crossJoin(F.broadcast(base))
    some = F.col("n_significant") > 0
    fdr = F.when(some, F.col("pi0") * F.col("alpha") * F.col("n_total") / F.col("n_significant")).otherwise(0.0)
    clipped = F.least(F.greatest(fdr, F.lit(0.0)), F.lit(1.0))
    return c.select(*by, "iteration", "alpha", "lfc", "pi0", "n_significant", fdr.alias("estimated_fdr"),
                    F.when(some, 1.0 - F.abs(clipped - target)).otherwise(0.0).alias("score"))


def reproducibility_trials(first: DataFrame, second: DataFrame, params: Params, by: Sequence[str]) -> DataFrame:
    """Jaccard of the two cohorts' gene sets at every point.

    A gene passes in both cohorts iff its larger p and its smaller |log2fc| pass, so one joined
    row per gene and three histograms cover the grid.
    """
    a = first.select(*by, "gene_id", F.col("p_value").alias("p1"), F.abs("log2fc").alias("l1"))
    b = second.select(*by, "gene_id", F.col("p_value").alias("p2"), F.abs("log2fc").alias("l2"))
    j = a.join(b, [*by, "gene_id"], "full")
    both = F.col("p1").isNotNull() & F.col("p2").isNotNull()
    rows = j.select(*by, F.explode(F.array(
        F.struct(F.lit(1).alias("k"), F.col("p1").alias("p"), F.col("l1").alias("l")),
        F.struct(F.lit(2).alias("k"), F.col("p2").alias("p"), F.col("l2").alias("l")),
        F.struct(F.lit(3).alias("k"), F.when(both, F.greatest("p1", "p2")).alias("p"),
                 F.when(both, F.least("l1", "l2")).alias("l")))).alias("e")).select(*by, "e.*").where("p IS NOT NULL")
    k = F.col("k")
    c = passing_counts(rows, params, by, "p", "l", {"n_first": k == 1, "n_second": k == 2, "n_both": k == 3})
    union = F.col("n_first") + F.col("n_second") - F.col("n_both")
    return c.select(*by, "iteration", "alpha", "lfc", F.col("n_first").alias("cohort1_degs"), F.col("n_second").alias("cohort2_degs"),
                    F.col("n_both").alias("reproducible_degs"), (F.col("n_first") - F.col("n_both")).alias("cohort1_unique"),
                    (F.col("n_second") - F.col("n_both")).alias("cohort2_unique"), ratio(F.col("n_both"), union).alias("score"))


def shared_counts(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """Per set of draws and replicate, how many genes it shares with every replicate, summed over the rows of the task."""
    held: dict[int, np.ndarray] = {}

    def release() -> pa.RecordBatch:
        ids = np.repeat(np.array(list(held), dtype=np.int64), replicates)
        rows = [row for m in held.values() for row in m]
        out = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(replicates, dtype=np.int32), len(held))),
                                          pa.array(rows, pa.list_(pa.float64()))], names=["_id", "b", "shared"])
        held.clear()
        return out

    for batch in batches:
        ids, lists = batch.column("_id").to_numpy(zero_copy_only=False), batch.column("bs")
        owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
        member = np.zeros((len(ids), replicates))
        np.add.at(member, (owner, lists.flatten().to_numpy(zero_copy_only=False)), 1.0)
        for i in np.unique(ids):
            mine = member[ids == i]
            held[int(i)] = held.get(int(i), 0.0) + mine.T @ (mine > 0)
            if len(held) >= HELD:
                yield release()
    if held:
        yield release()


def stability_trials(de: DataFrame, params: Params, by: Sequence[str], replicates: int = 100, seed: int = 42) -> DataFrame:
    """Mean pairwise Jaccard of perturbed gene sets (drop a tenth, add as many at random).

    Every replicate orders genes by a seeded hash; the first ``v`` go or come. Hashes well below the level that holds
    ``v`` of them are in, those well above it out, without a rank: only the band between is ranked, about the root of the
    genes. The counts below and inside the band are checked, and if a band misses its place (ids that repeat very often)
    all are ranked. A gene's memberships over the replicates form one vector; the replicate-by-replicate intersection
    counts are sums of outer products, made inside the tasks.
    """
    points = F.array(*[F.struct(F.lit(i).alias("iteration"), F.lit(a).alias("alpha"), F.lit(c).alias("lfc"))
                       for i, (a, c) in enumerate(params)])
    rows = de.select(*by, "gene_id", "p_value", "log2fc", F.explode(points).alias("g"))
    rows = rows.select(*by, "gene_id", "g.iteration", F.coalesce(
        (F.col("p_value") < F.col("g.alpha")) & (F.abs("log2fc") > F.col("g.lfc")), F.lit(False)).alias("base"))
    keys = [*by, "iteration"]
    size = rows.groupBy(*keys).agg(F.count_if("base").alias("n"), F.count(F.lit(1)).alias("all"))
    vary = F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))
    pool = F.col("all") - F.col("n") + F.when(F.col("n") > vary, vary).otherwise(0)
    size = cut(size.select(*keys, "n", "all", vary.alias("v"), pool.alias("pool"), F.monotonically_increasing_id().alias("_id")))
    drawn = size.where("n > 0").dropna(subset=keys)
    members = _perturbed(rows, drawn, keys, replicates, seed, False)
    members = _perturbed(rows, drawn, keys, replicates, seed, True) if members is None else members
    gram = members.mapInArrow(lambda batches: shared_counts(batches, replicates), "_id long, b int, shared array<double>")
    gram = gram.groupBy("_id", "b").agg(Summarizer.sum(array_to_vector("shared")).alias("s"))
    gram = gram.select("_id", "b", vector_to_array("s").alias("shared")).withColumn("own", F.element_at("shared", F.col("b") + 1))
    sizes = gram.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("b", "own"))).alias("sizes"))
    j = gram.join(sizes, "_id")
    total = F.aggregate(F.zip_with("shared", "sizes", lambda s, o: F.when(
        o["b"] > F.col("b"), s / (F.col("own") + o["own"] - s)).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)
    pairs = replicates * (replicates - 1) / 2.0
    scored = j.groupBy("_id").agg((F.sum(total) / pairs).alias("score"))
    named = size.join(scored, "_id", "left").withColumn("g", F.element_at(points, F.col("iteration") + 1))
    return named.select(*keys, F.col("g.alpha").alias("alpha"), F.col("g.lfc").alias("lfc"),
                        F.col("n").alias("n_significant"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _perturbed(rows: DataFrame, size: DataFrame, keys: list[str], replicates: int, seed: int, whole: bool) -> DataFrame | None:
    """(_id, bs): the replicates that hold each gene. With ``whole`` all hashes are ranked; else None if a band fails."""
    infinite = F.lit(float("inf"))
    slack = 10.0 * F.sqrt("v") + 60.0
    part = lambda sign, of: F.lit(sign) * infinite if whole else (F.col("v") + F.lit(sign) * slack) / F.greatest(of, F.lit(1))
    scale = lambda x: F.when(F.col("n") > F.col("v"), x * 2.0**64 - 2.0**63).otherwise(-infinite)
    size = size.select(*keys, "_id", "n", "v", "pool", scale(part(-1, F.col("n"))).alias("lo1"), scale(part(1, F.col("n"))).alias("hi1"),
                       part(-1, F.col("pool")).alias("lo2"), part(1, F.col("pool")).alias("hi2"))
    place = lambda b: F.pmod(F.xxhash64("gene_id", b, F.lit(seed + 7919)), F.lit(1 << 52)) / float(1 << 52)
    every, none = F.sequence(F.lit(0), F.lit(replicates - 1)), F.array().cast("array<int>")
    first = F.when(F.col("base"), F.transform(every, lambda b: F.struct(b.alias("b"), F.xxhash64("gene_id", b, F.lit(seed)).alias("h1"))))
    placed = rows.join(small(size), keys).withColumn("x", first)
    number = lambda xs: F.transform(xs, lambda x: x["b"])
    placed = placed.select("_id", "gene_id", "base", "lo2", "hi2",
                           F.coalesce(number(F.filter("x", lambda x: x["h1"] >= F.col("hi1"))), none).alias("kept"),
                           F.filter("x", lambda x: (x["h1"] >= F.col("lo1")) & (x["h1"] < F.col("hi1"))).alias("band"),
                           F.coalesce(number(F.filter("x", lambda x: x["h1"] < F.col("lo1"))), none).alias("gone"))
    free = F.transform(F.when(F.col("base"), F.col("gone")).otherwise(every), lambda b: F.struct(b.alias("b"), place(b).alias("h2")))
    coded = settle(placed.select("_id", "gene_id", "lo2", "kept", "band", "gone", F.filter(free, lambda x: x["h2"] < F.col("hi2")).alias("free")))

    def ranked(band: DataFrame, sure: DataFrame, order: str, least: Column) -> tuple[DataFrame, bool]:
        """``band`` with ``inside``, true for those of the first ``v``; whether the band holds the place."""
        group = ["_id", "b"]
        below = cut(sure.groupBy(*group).agg(F.count(F.lit(1)).alias("below")))
        band = cut(ordered.row_numbers(band, group, [order, "gene_id"], "_r"))
        spans = size.withColumn("b", F.explode(every)).join(below, group, "left").join(
            band.groupBy(*group).agg(F.count(F.lit(1)).alias("more")), group, "left").fillna(0, ["below", "more"])
        holds = spans.where((F.col("below") > F.col("v")) | (F.col("below") + F.col("more") < least)).isEmpty()
        left = band.join(spans.select(*group, "v", "below", "lo2", "hi2"), group)
        return left.select(*group, "gene_id", order, "lo2", "hi2", (F.col("_r") <= F.col("v") - F.col("below")).alias("inside")), holds

    going, holds = ranked(coded.select("_id", "gene_id", F.explode("band").alias("e")).select("_id", "gene_id", "e.*"),
                          coded.select("_id", F.explode("gone").alias("b")), "h1", F.when(F.col("n") > F.col("v"), F.col("v")).otherwise(0))
    if not holds:
        return None
    left = going.where("inside").withColumn("h2", place(F.col("b"))).where("h2 < hi2")
    free = coded.select("_id", "gene_id", "lo2", F.explode("free").alias("e")).select("_id", "e.b", "gene_id", "e.h2", "lo2").unionByName(
        left.select("_id", "b", "gene_id", "h2", "lo2"))
    coming, holds = ranked(free.where("h2 >= lo2").drop("lo2"), free.where("h2 < lo2"), "h2", F.least("v", "pool"))
    if not holds:
        return None
    one = lambda df: df.select("_id", "gene_id", F.array("b").alias("bs"))
    sure = coded.select("_id", "gene_id", F.concat("kept", number(F.filter("free", lambda x: x["h2"] < F.col("lo2")))).alias("bs"))
    parts = sure.where(F.size("bs") > 0).unionByName(one(going.where("NOT inside"))).unionByName(
        one(left.where("h2 < lo2"))).unionByName(one(coming.where("inside")))
    return parts.groupBy("_id", "gene_id").agg(F.flatten(F.collect_list("bs")).alias("bs")).select("_id", "bs")


def best_trial(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    """First trial with the highest score."""
    top = F.max_by(F.struct("iteration", "alpha", "lfc", "score"), F.struct("score", -F.col("iteration")))
    return trials.groupBy(*by).agg(top.alias("t")).select(*by, "t.*")


def differential_evolution(evaluate: Callable[[Params], DataFrame], generations: int = 10, population: int = 15,
                           mutation: float = 0.5, recombination: float = 0.7, seed: int = 42,
                           alpha=ALPHA_BOUNDS, lfc=LFC_BOUNDS) -> tuple[tuple[float, float], float]:
    """Best point of one trial table per generation; only population scores reach the driver.

    ``evaluate(params)`` returns trials with ``iteration`` and ``score`` for a single contrast.
    """
    rng = np.random.default_rng(seed)
    low, high = np.array([alpha[0], lfc[0]]), np.array([alpha[1], lfc[1]])

    def scores(points: np.ndarray) -> np.ndarray:
        got = {r["iteration"]: r["score"] for r in
               evaluate([(float(a), float(c)) for a, c in points]).select("iteration", "score").limit(len(points)).collect()}
        return np.array([got.get(i, 0.0) for i in range(len(points))])

    pop = rng.uniform(low, high, size=(population, 2))
    fit = scores(pop)
    for _ in range(generations):
        trial = pop.copy()
        for i in range(population):
            a, b, c = rng.choice([j for j in range(population) if j != i], 3, replace=False)
            mutant = np.clip(pop[a] + mutation * (pop[b] - pop[c]), low, high)
            trial[i] = np.where(rng.random(2) < recombination, mutant, pop[i])
        got = scores(trial)
        better = got > fit
        pop[better], fit[better] = trial[better], got[better]
    best = int(np.argmax(fit))
    return (float(pop[best][0]), float(pop[best][1])), float(fit[best])


def optimise(trials: DataFrame, de: DataFrame, by: Sequence[str]) -> dict[str, DataFrame]:
    """trials, best point and the genes passing it."""
    best = cut(best_trial(trials, by))
    point = best.select(*by, F.col("alpha").alias("_a"), F.col("lfc").alias("_c"))
    joined = de.join(point, list(by)) if by else de.crossJoin(F.broadcast(point))
    p = "padj" if "padj" in de.columns else "p_value"
    genes = joined.where((F.col(p) < F.col("_a")) & (F.abs("log2fc") > F.col("_c"))).withColumn(
        "direction", F.when(F.col("log2fc") > 0, "up").otherwise("down")).drop("_a", "_c")
    return {"trials": trials, "best": best, "genes": genes}
