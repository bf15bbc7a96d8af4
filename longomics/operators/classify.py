"""Classifiers on sample vectors: folds, cross-validation, out-of-fold predictions and their metrics."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from . import clinical, ordered
from .moments import GENE, SAMPLE
from ..runtime import cut, small, spread

# Classifier names in order of preference for ties.
CLASSIFIERS = ["logistic_regression", "svm", "random_forest", "gradient_boosting"]
PARALLEL = 4


def gene_positions(genes: DataFrame) -> DataFrame:
    """0-based vector position of each gene, by gene id."""
    return (ordered.row_numbers(genes.select(GENE).distinct(), [], [GENE], "j")
            .select(GENE, (F.col("j") - 1).cast("int").alias("j")))


def sample_matrix(values: DataFrame, positions: DataFrame) -> DataFrame:
    """(sample_id, y, features) from dense long values; a sample's vector is as long as the candidate list."""
    cells = spread(values.join(small(positions), GENE), values.count(), SAMPLE).groupBy(SAMPLE).agg(
        F.max("y").alias("y"), F.sort_array(F.collect_list(F.struct("j", "value"))).alias("c"))
    return cells.select(SAMPLE, "y", array_to_vector(F.col("c.value")).alias("features"))


def stratified_folds(samples: DataFrame, k: int, repeats: int = 1, seed: int = 42) -> DataFrame:
    """(repeat, sample_id, y, fold): samples of each class dealt round-robin in seeded hash order."""
    rep = samples.select(SAMPLE, "y").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    keyed = rep.withColumn("_h", F.xxhash64(F.col(SAMPLE).cast("string"), F.lit(seed) + F.lit(1000) * F.col("repeat")))
    dealt = ordered.row_numbers(keyed, ["repeat", "y"], ["_h", SAMPLE], "_n")
    return dealt.select("repeat", SAMPLE, "y", ((F.col("_n") + F.col("y")) % k).cast("int").alias("fold"))


def estimator(name: str, seed: int = 42, trees: int = 100, n: int = 100):
    """Classifier by name; the linear ones weigh the sum of losses over ``n`` samples like half the squared norm (C = 1)."""
    options = dict(featuresCol="scaled", labelCol="y")
    if name == "logistic_regression":
        return LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, maxIter=100, standardization=False, **options)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, **options)
    if name == "svm":
        return LinearSVC(regParam=1.0 / n, maxIter=50, standardization=False, **options)
    if name == "gradient_boosting":
        return GBTClassifier(maxIter=20, maxDepth=5, seed=seed, **options)
    raise ValueError(f"unknown classifier {name!r}")


def fit(train: DataFrame, name: str, seed: int = 42, trees: int = 100):
    """Scaler + classifier; the linear SVM gets a logistic curve over its margin for probabilities."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    model = Pipeline(stages=[scaler, estimator(name, seed, trees, max(train.count(), 1))]).fit(train)
    if name != "svm":
        return model, None
    margins = model.transform(train).select("y", array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("margin"))
    platt = LogisticRegression(featuresCol="margin", labelCol="y", regParam=1e-4).fit(margins)
    return model, (float(platt.coefficients[0]), float(platt.intercept))


def predict(fitted, rows: DataFrame) -> DataFrame:
    model, platt = fitted
    out = model.transform(rows)
    if platt is None:
        return out.withColumn("prob", vector_to_array("probability")[1])
    a, b = platt
    return out.withColumn("prob", 1.0 / (1.0 + F.exp(-(F.lit(a) * vector_to_array("rawPrediction")[1] + F.lit(b)))))


def in_threads(jobs: Sequence, workers: int = PARALLEL) -> list:
    """Run independent Spark submissions from driver threads."""
    with ThreadPoolExecutor(max_workers=min(workers, max(1, len(jobs)))) as pool:
        return list(pool.map(lambda j: j(), jobs))


def cross_validate(vectors: DataFrame, folds: DataFrame, classifiers: Sequence[str] | None = None,
                   seed: int = 42, trees: int = 100) -> DataFrame:
    """Out-of-fold rows (classifier, repeat, fold, sample_id, y, prob): one fit per classifier and fold."""
    data = cut(vectors.join(folds.select("repeat", SAMPLE, "fold"), SAMPLE))
    keys = [(r["repeat"], r["fold"]) for r in data.select("repeat", "fold").distinct().orderBy("repeat", "fold").toLocalIterator()]

    def job(name: str, repeat: int, fold: int):
        def run() -> DataFrame:
            mine = data.where(F.col("repeat") == repeat)
            fitted = fit(mine.where(F.col("fold") != fold), name, seed + 1000 * repeat + fold, trees)
            return predict(fitted, mine.where(F.col("fold") == fold)).select(
                F.lit(name).alias("classifier"), "repeat", "fold", SAMPLE, "y", "prob")
        return run

    parts = in_threads([job(n, r, f) for n in (classifiers or CLASSIFIERS) for r, f in keys])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut(out)


def leave_one_out(vectors: DataFrame, classifiers: Sequence[str], seed: int = 42, trees: int = 50) -> DataFrame:
    """Every sample is its own fold."""
    folds = ordered.row_numbers(vectors.select(SAMPLE, "y"), [], [SAMPLE], "n").select(
        F.lit(0).alias("repeat"), SAMPLE, "y", (F.col("n") - 1).cast("int").alias("fold"))
    return cross_validate(vectors, folds, classifiers, seed, trees)


def threshold_metrics(oof: DataFrame, by: Sequence[str]) -> DataFrame:
    """accuracy, sensitivity, specificity and F1 at probability one half, plus AUC, per key."""
    p, y = F.col("prob") >= 0.5, F.col("y") == 1
    c = oof.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                             F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    safe = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    m = c.select(*by, safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fn).alias("sensitivity"),
                 safe(tn, tn + fp).alias("specificity"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))
    a = clinical.auc(oof, list(by), "y", "prob").select(*by, "auc")
    return m.join(a, list(by))


def fold_means(metrics: DataFrame) -> DataFrame:
    """Mean fold metrics per classifier; folds with a single class have no AUC and are skipped in its mean."""
    names = ["accuracy", "auc", "f1", "sensitivity", "specificity"]
    return metrics.groupBy("classifier").agg(*[F.avg(n).alias(n) for n in names], F.stddev_pop("auc").alias("auc_std"))


def best_classifier(means: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Highest AUC; within eps the highest F1; then the preference order."""
    order = F.coalesce(*[F.when(F.col("classifier") == n, F.lit(i)) for i, n in enumerate(CLASSIFIERS)], F.lit(len(CLASSIFIERS)))
    top = means.agg(F.max("auc").alias("_a"))
    tied = means.crossJoin(F.broadcast(top)).where(F.col("_a") - F.col("auc") <= eps)
    best = tied.agg(F.max("f1").alias("_f"))
    final = tied.crossJoin(F.broadcast(best)).where(F.col("_f") - F.col("f1") <= eps)
    pick = F.min_by(F.struct("classifier", "auc", "f1"), F.struct(order.alias("o"), F.col("classifier").alias("n")))
    return final.agg(pick.alias("b")).select("b.*")


def select_features(vectors: DataFrame, keep: Sequence[int]) -> DataFrame:
    """The vectors cut to the kept positions, in their order."""
    kept = VectorSlicer(inputCol="features", outputCol="_kept", indices=[int(j) for j in keep]).transform(vectors)
    return kept.drop("features").withColumnRenamed("_kept", "features")
