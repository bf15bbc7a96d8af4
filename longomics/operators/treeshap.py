"""Exact Shapley values of tree ensembles on sample vectors (path-dependent form, Lundberg et al. 2020).

The trees are read from the saved model, at most trees x 2^(depth + 1) nodes. A path to a leaf bounds each of its
features by an interval and knows the share of training rows that follow it; the leaf's part in a feature's value is a
sum over subsets of the other features of the path, which are the coefficients of a small polynomial. Samples stay
where they are: vectors are cut to the used features in the JVM and a task takes a few hundred of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from .moments import SAMPLE
from ..runtime import scratch_path

ROWS = 256
CELLS = 1 << 18


def leaves(spark: SparkSession, model) -> list[tuple[float, dict]]:
    """(value, {feature: (low, high, share)}) of every leaf: x follows the path where low < x <= high for each feature.

    Values add up to the probability of class 1 for a forest, to the weighted sum of the trees for boosting.
    """
    model.write().overwrite().save(path := scratch_path(spark, "trees"))
    boosted = isinstance(model, GBTClassificationModel)
    weights = list(model.treeWeights)
    trees: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    out: list[tuple[float, dict]] = []
    for tree, nodes in trees.items():
        # Boosted trees are regressions: their statistics start with the weight of the rows.
        cover = {i: (n["impurityStats"][0] if boosted else sum(n["impurityStats"])) for i, n in nodes.items()}
        stack = [(0, {})]
        while stack:
            i, path_so_far = stack.pop()
            node = nodes[i]
            if node["leftChild"] < 0:
                value = node["prediction"] if boosted else node["impurityStats"][1] / cover[i]
                out.append((value * weights[tree] / (1.0 if boosted else sum(weights)), path_so_far))
                continue
            j, at = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            low, high, share = path_so_far.get(j, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["leftChild"], (low, min(high, at))), (node["rightChild"], (max(low, at), high))):
                stack.append((child, path_so_far | {j: (*bounds, share * cover[child] / cover[i])}))
    return out


def _groups(paths: list[tuple[float, dict]], used: list[int]) -> list[tuple[np.ndarray, ...]]:
    """Leaves with equally many features as arrays: value, feature place, low, high, share."""
    place = {j: i for i, j in enumerate(used)}
    by_length: dict[int, list] = {}
    for value, path in paths:
        if path:
            by_length.setdefault(len(path), []).append((value, [(place[j], *b) for j, b in path.items()]))
    out = []
    for _, group in sorted(by_length.items()):
        rows = np.array([p for _, p in group])
        out.append((np.array([v for v, _ in group]), rows[:, :, 0].astype(int), rows[:, :, 1], rows[:, :, 2], rows[:, :, 3]))
    return out


def contributions_of(x: np.ndarray, groups: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Shapley values, rows x used features."""
    n, m = x.shape
    phi = np.zeros((n, m))
    for value, place, low, high, share in groups:
        k = place.shape[1]
        weight = np.array([factorial(s) * factorial(k - 1 - s) / factorial(k) for s in range(k)])
        for start in range(0, len(value), step := max(1, CELLS // (n * k))):
            cut = slice(start, start + step)
            here = x[:, place[cut]]
            on = ((here > low[cut]) & (here <= high[cut])).astype(float)
            z = share[cut]
            for i in range(k):
                # Coefficient s: subsets of s other features that x decides, the rest averaged over training rows.
                poly = np.zeros((k, n, on.shape[1]))
                poly[0] = 1.0
                for j in range(k):
                    if j != i:
                        poly[1:] = poly[1:] * z[:, j] + poly[:-1] * on[:, :, j]
                        poly[0] *= z[:, j]
                part = np.tensordot(weight, poly, 1) * (on[:, :, i] - z[:, i]) * value[cut]
                np.add.at(phi.T, place[cut, i], part.T)
    return phi


def features_of(paths: list[tuple[float, dict]]) -> list[int]:
    return sorted({j for _, path in paths for j in path})


def along(paths: list[tuple[float, dict]], used: list[int], narrow: DataFrame) -> DataFrame:
    """Rows (sample_id, phi) from rows (sample_id, x) that hold the used features in order."""
    kind = narrow.schema[SAMPLE].dataType.simpleString()
    groups = _groups(paths, used)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                x = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, len(used))
                flat = pa.array(contributions_of(x, groups).ravel())
                ends = pa.array(np.arange(0, len(flat) + 1, len(used), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(ends, flat)], ["sample_id", "phi"])

    return narrow.mapInArrow(score, f"{SAMPLE} {kind}, phi array<double>")


def contributions(model, vectors: DataFrame) -> tuple[DataFrame, list[int], float]:
    """Rows (sample_id, phi) with one value for each used feature, the used features, and the mean prediction.

    ``sum(phi) + base`` is the model's output for the sample. A model without a split uses no feature.
    """
    paths = leaves(vectors.sparkSession, model)
    used = features_of(paths)
    base = float(sum(v * np.prod([b[2] for b in path.values()]) for v, path in paths))
    if not used:
        return vectors.select(SAMPLE, F.array().cast("array<double>").alias("phi")), used, base
    narrow = VectorSlicer(inputCol="features", outputCol="_x", indices=used).transform(vectors).select(
        SAMPLE, vector_to_array("_x").alias("x"))
    return along(paths, used, narrow), used, base


def importances(model, vectors: DataFrame) -> DataFrame:
    """(j, score): mean absolute Shapley value of every feature that the model uses."""
    phi, used, _ = contributions(model, vectors)
    return _mean(phi, used)


def mean_absolute(paths: list[tuple[float, dict]], narrow: DataFrame) -> DataFrame:
    """The same from paths and rows (sample_id, x) of their features."""
    used = features_of(paths)
    return _mean(along(paths, used, narrow) if used else narrow, used)


def _mean(phi: DataFrame, used: list[int]) -> DataFrame:
    if not used:
        return phi.sparkSession.createDataFrame([], "j int, score double")
    mean = phi.agg(vector_to_array(Summarizer.mean(array_to_vector(F.transform("phi", F.abs)))).alias("s"))
    places = F.array(*[F.lit(int(j)) for j in used]) if len(used) <= 64 else F.from_json(F.lit(str(used)), "array<int>")
    return mean.select(F.explode(F.arrays_zip(places.alias("j"), F.col("s").alias("score"))).alias("e")).select("e.j", "e.score")
