"""Learned method recommendation from profile rows and a user-supplied benchmark table."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from .moments import DS

# Model inputs, the profile column each is read from, and its default.
FEATURES = {
    "n_samples": ("n_samples", 6.0), "n_groups": ("n_groups", 2.0), "min_group_size": ("min_group_size", 3.0),
    "max_group_size": ("max_group_size", 3.0), "mean_bcv": ("bcv", 0.3), "median_bcv": ("median_bcv", 0.25),
    "bcv_variance": ("bcv_variance", 0.05), "outlier_proportion": ("outlier_proportion", 0.0),
    "mean_library_size": ("library_size_mean", 10_000_000.0), "library_size_cv": ("library_size_cv", 0.2),
    "sparsity": ("sparsity", 0.5), "zero_inflation_index": ("zero_inflation_index", 0.0),
    "low_count_proportion": ("low_count_proportion", 0.3), "high_count_proportion": ("high_count_proportion", 0.1),
    "dynamic_range": ("dynamic_range", 15.0), "mean_var_slope": ("mean_var_slope", 1.5),
    "poisson_fit_score": ("poisson_fit_score", 0.5),
}
DERIVED = ["sample_size_balanced", "has_outliers"]
CRITERIA = ("f1_score", "auc", "tpr", "fdr_control")


def model_features(profile: DataFrame) -> DataFrame:
    """Numeric inputs with defaults for absent or non-finite values."""
    cols = []
    for name, (source, default) in FEATURES.items():
        value = F.col(source).cast("double") if source in profile.columns else F.lit(None).cast("double")
        finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        cols.append(F.coalesce(finite, F.lit(default)).alias(name))
    balanced = (F.col("min_group_size") >= F.col("max_group_size") * 0.8).cast("double")
    outliers = F.coalesce(F.col("has_outliers").cast("double"), F.lit(0.0)) if "has_outliers" in profile.columns else F.lit(0.0)
    return profile.select(DS, *cols, balanced.alias("sample_size_balanced"), outliers.alias("has_outliers"))


def best_method(benchmark: DataFrame, criterion: str = "f1_score") -> DataFrame:
    """Best method per dataset of (dataset, method, f1_score, auc, tpr, fdr); ties go to the first name."""
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    score = 1.0 - F.coalesce("fdr", F.lit(1.0)) if criterion == "fdr_control" else F.coalesce(
        F.col(criterion), F.lit(0.5 if criterion == "auc" else 0.0))
    return benchmark.groupBy(DS).agg(F.min_by("method", F.struct((-score).alias("s"), "method")).alias("best_method"))


def train(features: DataFrame, labels: DataFrame, model: str = "random_forest", seed: int = 42, folds: int = 5,
          test_share: float = 0.2) -> dict:
    """Scaled forest (or one-vs-rest boosted trees): 80/20 split by seeded hash, CV accuracy, test accuracy."""
    data = features.join(labels, DS)
    inputs = [*FEATURES, *DERIVED]
    index = StringIndexer(inputCol="best_method", outputCol="label", handleInvalid="keep").fit(data)
    data = index.transform(data)
    share = F.pmod(F.xxhash64(F.col(DS).cast("string"), F.lit(seed)), F.lit(10_000)) / 10_000.0
    tr, te = data.where(share >= test_share), data.where(share < test_share)
    options = dict(featuresCol="features", labelCol="label")
    if model == "random_forest":
        clf = RandomForestClassifier(numTrees=200, maxDepth=10, seed=seed, **options)
    elif model == "gradient_boosting":
        clf = OneVsRest(classifier=GBTClassifier(maxIter=30, maxDepth=5, seed=seed), **options)
    else:
        raise ValueError("model must be random_forest or gradient_boosting")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="raw"),
                            StandardScaler(inputCol="raw", outputCol="features", withMean=True), clf])
    judge = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=folds,
                        seed=seed, parallelism=4).fit(tr) if folds > 1 else None
    fitted = cv.bestModel if cv else pipe.fit(tr)
    test = None if te.isEmpty() else judge.evaluate(fitted.transform(te))
    return {"model": fitted, "labels": list(index.labels), "inputs": inputs, "cv_accuracy": float(cv.avgMetrics[0]) if cv else None,
            "test_accuracy": test}


def recommend(trained: dict, features: DataFrame) -> DataFrame:
    """Class, confidence and the three next classes per dataset."""
    names = F.array(*[F.lit(n) for n in trained["labels"]])
    out = trained["model"].transform(features)
    prob = vector_to_array("probability") if "probability" in out.columns else vector_to_array("rawPrediction")
    pairs = F.reverse(F.array_sort(F.zip_with(F.slice(prob, 1, len(trained["labels"])), names,
                                              lambda p, n: F.struct(p.alias("p"), n.alias("n")))))
    return out.select(DS, pairs.alias("r")).select(
        DS, F.col("r")[0]["n"].alias("method"), F.col("r")[0]["p"].alias("confidence"),
        F.transform(F.slice("r", 2, 3), lambda e: e["n"]).alias("alternatives"))


def importances(trained: dict, n: int = 10) -> list[tuple[str, float]]:
    """Top inputs of a forest model."""
    imp = trained["model"].stages[-1].featureImportances.toArray()
    return sorted(zip(trained["inputs"], map(float, imp)), key=lambda e: (-e[1], e[0]))[:n]
