"""Feature selectors, panel curves, panel size and panel stability.

A selector takes dense long values (gene_id, sample_id, value, y) of one cohort and returns
(method, gene_id, score, selected). Selectors that need only sums stay on the long table; model-based
ones work on sample vectors over the candidate genes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from . import classify, clinical, coexpression, genetests, ordered, qc, treeshap, wide
from .moments import DS, GENE, SAMPLE
from ..functions.tails import binomial_two_sided_half, t_two_sided
from ..functions.text import stability_label
from ..runtime import cut, small

# Draws for the roots of the trees that one scan of the gene rows serves.
DRAWS = 1 << 19


def scored(df: DataFrame, method: str, n: int | None = None) -> DataFrame:
    """Tag with the method; ``selected`` = the n best by (score, gene) or score > 0."""
    if n is None:
        return df.select(F.lit(method).alias("method"), GENE, "score", (F.col("score") > 0).alias("selected"))
    ranked = ordered.row_numbers(df.select(GENE, "score"), [], ["-score", GENE], "_r")
    return ranked.select(F.lit(method).alias("method"), GENE, "score", (F.col("_r") <= n).alias("selected"))


def labels_of(values: DataFrame) -> DataFrame:
    return values.select(DS, SAMPLE, "y").distinct()


def de_filter(values: DataFrame, de_genes: DataFrame) -> DataFrame:
    hit = de_genes.select(GENE).distinct().withColumn("_h", F.lit(1.0))
    genes = values.select(GENE).distinct().join(hit, GENE, "left")
    return scored(genes.select(GENE, F.coalesce("_h", F.lit(0.0)).alias("score")), "de_filter")


def univariate_filter(values: DataFrame, n: int = 50, test: str = "welch") -> DataFrame:
    """-log10 p of the two-group test; n best selected."""
    de = genetests.per_gene_de(values, labels_of(values), test, min_nonzero=0)
    return scored(de.select(GENE, F.col("neg_log10p").alias("score")), "univariate_filter", n)


def _positions(values: DataFrame) -> tuple[DataFrame, int]:
    """(gene_id, j) positions and their number; above ``wide.WIDE`` features genes stay rows."""
    positions = cut(classify.gene_positions(values))
    return positions, positions.count()


def _vectors(values: DataFrame, positions: DataFrame) -> DataFrame:
    return cut(classify.sample_matrix(values, positions))


def _frame(positions: DataFrame, **columns: Sequence[float]) -> DataFrame:
    """(gene_id, one column for each name) from numbers in vector order."""
    rows = pd.DataFrame({"j": np.arange(len(next(iter(columns.values()))), dtype=np.int32)} | {
        k: np.asarray(v, dtype=float) for k, v in columns.items()})
    numbers = positions.sparkSession.createDataFrame(rows, "j int, " + ", ".join(f"{k} double" for k in columns))
    return positions.join(numbers, "j").drop("j")


def _sparse(positions: DataFrame, numbers: dict[int, float]) -> DataFrame:
    """(gene_id, score): absolute number of the listed positions, zero for all others."""
    rows = [(j, abs(v)) for j, v in numbers.items()]
    some = positions.sparkSession.createDataFrame(rows, "j int, score double")
    return positions.join(some, "j", "left").select(GENE, F.coalesce("score", F.lit(0.0)).alias("score"))


def _standardised(vectors: DataFrame) -> DataFrame:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return scaler.fit(vectors).transform(vectors)


def lasso(values: DataFrame, alpha: float = 0.5, l1_ratio: float = 1.0, method: str = "lasso") -> DataFrame:
    """Absolute elastic-net logistic coefficients on standardised genes."""
    positions, p = _positions(values)
    if p > wide.WIDE and l1_ratio > 0:
        return scored(_sparse(positions, wide.elastic_net(values, positions, alpha, l1_ratio)), method)
    vectors = _vectors(values, positions)
    n = vectors.count()
    model = LogisticRegression(featuresCol="scaled", labelCol="y", regParam=alpha / n, elasticNetParam=l1_ratio,
                               standardization=False, maxIter=200).fit(_standardised(vectors))
    return scored(_frame(positions, score=np.abs(model.coefficients.toArray())), method)


def forest_importance(vectors: DataFrame, seed: int, trees: int = 100, depth: int = 5) -> np.ndarray:
    model = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)
    return model.featureImportances.toArray()


def places(values: DataFrame) -> DataFrame:
    """Position of each sample inside its gene."""
    return cut(ordered.row_numbers(values.select(GENE, SAMPLE, "y"), [GENE], [SAMPLE], "n"))


def shadows(values: DataFrame, place: DataFrame, round_: int, seed: int = 42) -> DataFrame:
    """Each gene's values dealt to other samples: two ordered numberings per gene joined on position."""
    base = values.select(GENE, SAMPLE, "value", "y")
    mixed = ordered.row_numbers(base.select(GENE, SAMPLE, "value").withColumn(
        "_h", F.xxhash64(F.col(SAMPLE).cast("string"), F.col(GENE).cast("string"), F.lit(seed + round_))),
        [GENE], ["_h", SAMPLE], "n")
    return place.join(mixed.select(GENE, "n", "value"), [GENE, "n"]).select(GENE, SAMPLE, "value", "y")


def tree_number(genes: int, depth: int = 5) -> int:
    """Trees with which all genes and their shadows are drawn often enough: 20 times the root of their number."""
    return max(1, int(2 * genes / (np.sqrt(2 * genes) * depth) * 100))


def forest_shares(rows: DataFrame, y: np.ndarray, features: np.ndarray, seed: int, trees: int, **options) -> dict[int, float]:
    """Importances of a forest over gene rows, grown in turns of about ``DRAWS`` draws for the roots."""
    turn = max(1, int(DRAWS / np.sqrt(len(features))))
    forest = []
    for k, at in enumerate(range(0, trees, turn)):
        forest += wide.grow(rows, y, features, seed + 1_000_003 * k, min(turn, trees - at), **options)
    return wide.importance(forest)


def boruta(values: DataFrame, max_iter: int = 100, seed: int = 42, trees: int | None = None, p_limit: float = 0.05) -> DataFrame:
    """All-relevant selection (Kursa and Rudnicki 2010): real genes must beat the best shadow.

    Hits per gene are tested two-sided binomially with a Bonferroni factor; decided genes keep their
    status, rejected genes leave later rounds. Without ``trees`` their number follows the genes left.
    """
    positions, p = _positions(values)
    hits, status = np.zeros(p, int), np.zeros(p, int)
    if long := trees is None or 2 * p > wide.WIDE:
        rows, y = wide.gene_rows(values, positions)
    else:
        vectors, place = _vectors(values, positions), places(values)
    for it in range(1, max_iter + 1):
        active = np.flatnonzero(status >= 0)
        if len(active) == 0 or (status != 0).all():
            break
        k = len(active)
        if long:
            shares = forest_shares(rows, y, (2 * active[:, None] + [0, 1]).ravel(), seed + it, trees or tree_number(k),
                                   columns=(wide.dealt(it, seed),))
            limit = max((v for f, v in shares.items() if f % 2), default=0.0)
            hits[[f // 2 for f, v in shares.items() if f % 2 == 0 and v > limit]] += 1
        else:
            dealt = shadows(values, place, it, seed)
            shadow = classify.sample_matrix(dealt, positions).select(SAMPLE, F.col("features").alias("sh"))
            both = vectors.join(shadow, SAMPLE).select("y", array_to_vector(
                F.concat(vector_to_array("features"), vector_to_array("sh"))).alias("features"))
            imp = forest_importance(classify.select_features(cut(both), [*active, *(active + p)]), seed + it, trees)
            hits[active[imp[:k] > imp[k:].max()]] += 1
        sure = np.array([binomial_two_sided_half(h, it) * p < p_limit for h in range(it + 1)])
        decided = (status == 0) & sure[hits]
        status[decided] = np.where(hits[decided] > it / 2, 1, -1)
    rank = np.where(status == 1, 1, np.where(status == 0, 2, 3))
    importance = (rank.max() - rank + 1) / rank.max()
    df = _frame(positions, score=importance, kept=rank <= 2)
    return df.select(F.lit("boruta").alias("method"), GENE, "score", (F.col("kept") > 0).alias("selected"))


def mrmr(values: DataFrame, n: int = 20, floor: float = 0.001) -> DataFrame:
    """Greedy relevance / redundancy: F statistic over mean absolute correlation with the picks so far.

    Each step is one ``corr`` aggregate of every gene against the last pick's sample values.
    """
    dense = cut(values.select(GENE, SAMPLE, "value", "y"))
    relevance = cut(qc.f_statistic(dense, [GENE], "value", "y").select(GENE, F.coalesce("f", F.lit(0.0)).alias("f")))
    state = cut(relevance.select(GENE, "f", F.lit(0.0).alias("red"), F.lit(0).alias("k")))
    picked: list = []
    for _ in range(n):
        score = F.when(F.col("k") == 0, F.col("f")).otherwise(F.col("f") / F.greatest(F.col("red") / F.col("k"), F.lit(floor)))
        rest = state if not picked else state.where(~F.col(GENE).isin(picked))
        top = rest.withColumn("_s", F.round(score, 12)).orderBy(F.desc("_s"), GENE).select(GENE).first()
        if top is None:
            break
        picked.append(top[GENE])
        last = dense.where(F.col(GENE) == top[GENE]).select(SAMPLE, F.col("value").alias("_v"))
        corr = dense.join(small(last), SAMPLE).groupBy(GENE).agg(F.abs(F.coalesce(F.corr("value", "_v"), F.lit(0.0))).alias("c"))
        state = cut(state.join(corr, GENE).select(GENE, "f", (F.col("red") + F.nanvl("c", F.lit(0.0))).alias("red"), (F.col("k") + 1).alias("k")))
    order = {g: (n - i) / n for i, g in enumerate(picked)}
    kind = values.schema[GENE].dataType.simpleString()
    got = values.sparkSession.createDataFrame(list(order.items()), f"{GENE} {kind}, score double")
    every = values.select(GENE).distinct().join(got, GENE, "left")
    return scored(every.select(GENE, F.coalesce("score", F.lit(0.0)).alias("score")), "mrmr")


def rfe(values: DataFrame, n: int = 20, step: float = 0.1, seed: int = 42, trees: int = 100) -> DataFrame:
    """Recursive elimination with a forest: kept genes 1 + scaled importance, dropped 1 / ranking."""
    positions, p = _positions(values)
    if p > wide.WIDE:
        rows, y = wide.gene_rows(values, positions)
    else:
        vectors = _vectors(values, positions)

    def importance(kept: np.ndarray) -> np.ndarray:
        if p <= wide.WIDE:
            return forest_importance(classify.select_features(vectors, kept), seed, trees)
        shares = wide.importance(wide.grow(rows, y, 2 * kept, seed, trees))
        out = np.zeros(len(kept))
        out[np.searchsorted(kept, [f // 2 for f in shares])] = list(shares.values())
        return out

    alive = np.arange(p)
    n = min(n, p)
    drop = max(1, int(step * p)) if step < 1 else int(step)
    rounds: list[np.ndarray] = []
    while len(alive) > n:
        imp = importance(alive)
        out = np.argsort(imp, kind="stable")[:min(drop, len(alive) - n)]
        rounds.append(alive[out])
        alive = np.delete(alive, out)
    imp = importance(alive)
    score = np.zeros(p)
    spread = imp.max() - imp.min()
    score[alive] = 1.0 + (imp - imp.min()) / spread if spread > 0 else 1.5
    for i, gone in enumerate(reversed(rounds)):
        score[gone] = 1.0 / (i + 2)
    df = _frame(positions, score=score)
    return df.select(F.lit("rfe").alias("method"), GENE, "score", (F.col("score") >= 1.0).alias("selected"))


def shapley(values: DataFrame, n: int = 20, seed: int = 42, trees: int = 100, depth: int = 5) -> DataFrame:
    """Mean absolute exact Shapley values of a forest over all samples; genes that no tree uses score zero."""
    positions, p = _positions(values)
    if p > wide.WIDE:
        paths = wide.leaves(wide.grow(*wide.gene_rows(values, positions), 2 * np.arange(p), seed, trees, depth))
        used = values.sparkSession.createDataFrame([(j,) for j in treeshap.features_of(paths)], "j int")
        narrow = classify.sample_matrix(values, positions.join(F.broadcast(used), "j"))
        importances = treeshap.mean_absolute(paths, narrow.select(SAMPLE, vector_to_array("features").alias("x")))
    else:
        vectors = _vectors(values, positions)
        model = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)
        importances = treeshap.importances(model, vectors)
    ranked = positions.join(importances, "j", "left")
    return scored(ranked.select(GENE, F.coalesce("score", F.lit(0.0)).alias("score")), "shap", n)


def coexpression_hubs(values: DataFrame, power: int = 6, neighbours: int | None = None, height: float = 0.9, min_size: int = 30,
                      hubs: int = 10, trait: float = 0.3, rounds: int = 15) -> DataFrame:
    """Hub genes of trait-correlated modules: kME x |module-trait correlation|, kept for the best hubs.

    Fewer than 15 samples are refused. The eigengene of every module comes from power iteration as
    alternating gene and sample aggregates keyed by module.
    """
    if (found := values.select(SAMPLE).distinct().limit(15).count()) < 15:
        raise ValueError(f"co-expression modules need 15 samples, found {found}")
    m = cut(coexpression.modules(values, power, neighbours, height, min_size).select(GENE, "module"))
    stats = values.groupBy(GENE).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd")).where("sd > 1e-12")
    cells = cut(values.join(m, GENE).join(stats, GENE).select("module", GENE, SAMPLE, "y", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("z")))
    eig = cells.groupBy("module", SAMPLE).agg(F.avg("z").alias("e"), F.max("y").alias("y"))
    for _ in range(rounds):
        load = cells.join(eig.select("module", SAMPLE, "e"), ["module", SAMPLE]).groupBy("module", GENE).agg(F.sum(F.col("z") * F.col("e")).alias("l"))
        raw = cells.join(load, ["module", GENE]).groupBy("module", SAMPLE).agg(F.sum(F.col("z") * F.col("l")).alias("e"), F.max("y").alias("y"))
        norm = raw.groupBy("module").agg(F.sqrt(F.sum(F.col("e") * F.col("e"))).alias("norm"))
        eig = cut(raw.join(norm, "module").select("module", SAMPLE, "y", (F.col("e") / F.greatest("norm", F.lit(1e-300))).alias("e")))
    r = F.col("r")
    traits = eig.groupBy("module").agg(F.corr("e", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    t = r * F.sqrt((F.col("n") - 2) / F.greatest(1 - r * r, F.lit(1e-15)))
    traits = traits.withColumn("p", t_two_sided(t, (F.col("n") - 2).cast("double"))).where((F.abs("r") >= trait) & (F.col("p") < 0.05))
    kme = cells.join(eig.select("module", SAMPLE, "e"), ["module", SAMPLE]).groupBy("module", GENE).agg(F.abs(F.corr("z", "e")).alias("kme"))
    ranked = ordered.row_numbers(kme.join(traits, "module"), ["module"], ["-kme", GENE], "k").where(F.col("k") <= hubs)
    got = ranked.select(GENE, (F.col("kme") * F.abs("r")).alias("score"))
    every = values.select(GENE).distinct().join(got, GENE, "left")
    return scored(every.select(GENE, F.coalesce("score", F.lit(0.0)).alias("score")), "wgcna")


SELECTORS: dict[str, Callable[..., DataFrame]] = {
    "univariate_filter": lambda v, n, de, seed: univariate_filter(v, n),
    "de_filter": lambda v, n, de, seed: de_filter(v, de),
    "elastic_net": lambda v, n, de, seed: lasso(v, l1_ratio=0.5, method="elastic_net"),
    "lasso": lambda v, n, de, seed: lasso(v),
    "boruta": lambda v, n, de, seed: boruta(v, seed=seed),
    "mrmr": lambda v, n, de, seed: mrmr(v, n),
    "rfe": lambda v, n, de, seed: rfe(v, n, seed=seed),
    "shap": lambda v, n, de, seed: shapley(v, n, seed=seed),
    "wgcna": lambda v, n, de, seed: coexpression_hubs(v),
}


def resolve_methods(methods: Sequence[str] | None, has_de: bool) -> list[str]:
    """Fold-safe method list: de_filter without a gene list becomes the univariate filter."""
    chosen = list(methods or ["univariate_filter", "elastic_net", "rfe"])
    unknown = set(chosen) - set(SELECTORS)
    if unknown:
        raise ValueError(f"unknown selectors {sorted(unknown)}")
    if not has_de and "de_filter" in chosen:
        chosen = [m for m in chosen if m != "de_filter"] if "univariate_filter" in chosen else [
            "univariate_filter" if m == "de_filter" else m for m in chosen]
    return chosen


def run_selectors(values: DataFrame, methods: Sequence[str], n: int = 50, de_genes: DataFrame | None = None,
                  seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Scores of all methods that run; one that is undefined for the cohort is skipped, none left is an error.

    Failures of the jobs themselves, memory and lost files among them, are raised.
    """
    out, done, last = None, [], None
    for name in methods:
        try:
            part = cut(SELECTORS[name](values, n, de_genes, seed))
        except (ValueError, IllegalArgumentException, np.linalg.LinAlgError) as error:
            last = error
            continue
        out = part if out is None else out.unionByName(part)
        done.append(name)
    if out is None:
        raise RuntimeError("no selector succeeded") from last
    return out, done


def rank_genes(values: DataFrame, methods: Sequence[str], n: int = 50, de_genes: DataFrame | None = None, seed: int = 42) -> DataFrame:
    scores, done = run_selectors(values, methods, n, de_genes, seed)
    return cut(genetests.consensus_ranking(scores, values.select(GENE).distinct(), len(done)))


# ---- panels -----------------------------------------------------------------------------------------------

def panel_sizes(min_panel: int, max_panel: int, step: int) -> list[int]:
    """Every ``step``-th size up to the largest, which always counts; none when the limits cross."""
    return sorted({*range(min_panel, max_panel, step), max_panel}) if min_panel <= max_panel else []


def panel_prefixes(ranking: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(size, position, gene_id) for the prefixes of a ranking."""
    top = ranking.where(F.col("consensus_rank") <= max(sizes)).select(F.col("consensus_rank").alias("position"), GENE)
    arr = F.filter(F.array(*[F.lit(int(s)) for s in sizes]), lambda s: s >= F.col("position"))
    return top.withColumn("size", F.explode(arr)).select("size", "position", GENE)


def top_genes(ranking: DataFrame, k: int | None = None) -> list:
    chosen = ranking if k is None else ranking.where(F.col("consensus_rank") <= k)
    return [r[GENE] for r in chosen.orderBy("consensus_rank").select(GENE).toLocalIterator()]


def panel_vectors(values: DataFrame, genes: Sequence) -> DataFrame:
    kind = values.schema[GENE].dataType.simpleString()
    pos = values.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], f"{GENE} {kind}, j int")
    return classify.sample_matrix(values, pos)


def forward_curve(values: DataFrame, ranking: DataFrame, min_panel: int = 3, max_panel: int = 20, step: int = 1,
                  folds: int = 5, seed: int = 42, trees: int = 100) -> DataFrame:
    """(panel_size, auc_mean, auc_std): forest AUC by stratified CV for every prefix size."""
    genes = top_genes(ranking, max_panel)
    vectors = cut(panel_vectors(values, genes))
    split = cut(classify.stratified_folds(vectors, folds, 1, seed))
    out = None
    for size in panel_sizes(min(min_panel, len(genes)), len(genes), step):
        oof = classify.cross_validate(classify.select_features(vectors, range(size)), split, ["random_forest"], seed, trees)
        part = oof.select(F.lit(size).alias("panel_size"), "fold", "y", "prob")
        out = part if out is None else out.unionByName(part)

    auc = clinical.auc(out, ["panel_size", "fold"], "y", "prob")
    return auc.groupBy("panel_size").agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))


def kneedle(x: np.ndarray, y: np.ndarray, sensitivity: float = 1.0) -> float | None:
    """Knee of a concave increasing curve (Satopaa et al. 2011) after a degree-7 polynomial fit."""
    smooth = np.polyval(np.polyfit(x, y, 7), x) if len(x) > 1 else y
    xn, yn = (x - x.min()) / np.ptp(x), (smooth - smooth.min()) / max(np.ptp(smooth), 1e-300)
    diff = yn - xn
    inner = range(1, len(x) - 1)
    peaks = [i for i in inner if diff[i] >= diff[i - 1] and diff[i] >= diff[i + 1]]
    dips = {i for i in inner if diff[i] <= diff[i - 1] and diff[i] <= diff[i + 1]}
    slack = sensitivity * np.abs(np.diff(xn)).mean()
    for n, peak in enumerate(peaks):
        threshold = diff[peak] - slack
        until = peaks[n + 1] if n + 1 < len(peaks) else len(x) - 1
        for i in range(peak, until):
            if i in dips and i != peak:
                threshold = 0.0
            if diff[i + 1] < threshold:
                return float(x[peak])
    return None


def panel_size(curve: Sequence[tuple[int, float]], strategy: str = "kneedle", sensitivity: float = 1.0) -> tuple[int, str]:
    """Size and how it was found from the (size, auc) points of a curve."""
    sizes = np.array([s for s, _ in curve], dtype=float)
    aucs = np.array([a for _, a in curve], dtype=float)
    best = int(sizes[aucs == aucs.max()].min())
    if strategy == "argmax":
        return best, "argmax"
    if strategy == "first_drop":
        gains = np.flatnonzero(np.diff(aucs) < 0.005)
        return int(sizes[gains[0] if len(gains) else len(sizes) - 1]), "first_drop"
    if strategy != "kneedle":
        raise ValueError(f"unknown strategy {strategy!r}")
    if len(sizes) < 3 or np.ptp(aucs) < 1e-6:
        return best, "argmax_fallback"
    with np.errstate(all="ignore"):
        import warnings
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            knee = kneedle(sizes, aucs, sensitivity)
    return (int(knee), "kneedle") if knee is not None else (best, "argmax_fallback")


def curve_points(curve: DataFrame) -> list[tuple[int, float]]:
    return [(r["panel_size"], r["auc_mean"]) for r in curve.orderBy("panel_size").collect()]


def stability_selection(values: DataFrame, alphas: Sequence[float] = (0.01, 0.05, 0.1, 0.5, 1.0), replicates: int = 100,
                        threshold: float = 0.6, seed: int = 42) -> DataFrame:
    """Share of half-sample lasso fits that keep each gene. A half-sample is the lower half of a seeded
    hash order, chosen per replicate; fits are submitted from driver threads."""
    positions, _ = _positions(values)
    vectors = _vectors(values, positions)
    n = vectors.count()

    def job(b: int):
        def run() -> list[np.ndarray]:
            order = ordered.row_numbers(vectors.withColumn("_h", F.xxhash64(F.col(SAMPLE).cast("string"), F.lit(seed + b))), [], ["_h", SAMPLE], "_n")
            half = cut(_standardised(order.where(F.col("_n") <= n // 2).drop("_h", "_n")))
            got = []
            for a in alphas:
                model = LogisticRegression(featuresCol="scaled", labelCol="y", regParam=a / max(n // 2, 1), elasticNetParam=1.0,
                                           standardization=False, maxIter=100).fit(half)
                got.append(np.abs(model.coefficients.toArray()) > 0)
            return got
        return run

    runs = [k for part in classify.in_threads([job(b) for b in range(replicates)]) for k in part]
    freq = np.mean(runs, axis=0)
    return _frame(positions, score=freq).select(GENE, F.col("score").alias("selection_frequency"), (F.col("score") >= threshold).alias("is_stable"))


def selection_frequency(panels: DataFrame, universe: DataFrame) -> DataFrame:
    """Share of folds that chose each gene of the universe. ``panels``: (fold, gene_id)."""
    m = panels.select("fold").distinct().agg(F.count(F.lit(1)).alias("m"))
    h = panels.select("fold", GENE).distinct().groupBy(GENE).agg(F.count(F.lit(1)).alias("h"))
    return (universe.select(GENE).distinct().join(h, GENE, "left").crossJoin(F.broadcast(m))
            .select(GENE, (F.coalesce("h", F.lit(0)) / F.col("m")).alias("selection_frequency")))


def phi(counts: DataFrame, by: Sequence[str], m: str = "m", p: str = "p") -> DataFrame:
    """Nogueira, Sechidis and Brown (2018) stability from per-gene selection counts ``h``.

    Genes never selected add nothing to either sum, so only selected genes need rows; ``m`` folds
    and ``p`` genes are columns.
    """
    share = F.col("h") / F.col(m)
    a = counts.groupBy(*by, m, p).agg(F.sum("h").alias("q"), F.sum(share * (1 - share)).alias("v"))
    rate = F.col("q") / (F.col(m) * F.col(p))
    chance = rate * (1 - rate)
    observed = F.col(m) / (F.col(m) - 1.0) * F.col("v") / F.col(p)
    value = (F.when(F.col(m) < 2, F.when(F.col("q") > 0, 1.0).otherwise(0.0))
             .when((F.col(p) == 0) | (chance <= 0), 0.0).otherwise(1.0 - observed / chance))
    return a.select(*by, value.alias("phi"))


def panel_stability(panels: DataFrame, n_genes: int, n_folds: int, replicates: int = 1000, ci: float = 0.95,
                    seed: int = 42) -> DataFrame:
    """Phi with a fold-bootstrap interval and its label. Replicates enter as fold weights, so every
    resample is a weighted sum over the same (fold, gene) rows."""
    z = cut(panels.select("fold", GENE).distinct())
    base = z.groupBy(GENE).agg(F.count(F.lit(1)).alias("h")).withColumns({"m": F.lit(n_folds), "p": F.lit(n_genes)})
    if n_folds < 2:
        return phi(base, []).select(F.lit(0.0).alias("phi"), F.lit(0.0).alias("ci_lower"), F.lit(0.0).alias("ci_upper"), F.lit("poor").alias("label"))
    folds = sorted(r["fold"] for r in z.select("fold").distinct().toLocalIterator())
    rng = np.random.default_rng(seed)
    draws = rng.multinomial(n_folds, np.full(n_folds, 1.0 / n_folds), size=replicates)
    rows = [(int(b), f, int(draws[b, i])) for i, f in enumerate(folds) for b in range(replicates) if draws[b, i]]
    weights = panels.sparkSession.createDataFrame(rows, f"b int, fold {panels.schema['fold'].dataType.simpleString()}, w int")
    boot = z.join(small(weights), "fold").groupBy("b", GENE).agg(F.sum("w").alias("h")).withColumns({"m": F.lit(n_folds), "p": F.lit(n_genes)})
    tail = (1.0 - ci) / 2.0
    q = phi(boot, ["b"]).agg(F.percentile("phi", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("q"))
    return phi(base, []).crossJoin(F.broadcast(q)).select(
        "phi", F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"), stability_label(F.col("phi")).alias("label"))
