"""Outlying samples: six methods on sample structure, and their vote.

Components come from ``structure``; neighbours are sought by pairs of bounded blocks, concentration steps are sums and an
ordered cut over all starts at once, and an isolation tree is grown from its bounded draw. No task holds a dataset.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ordered, structure
from .moments import DS, GENE, SAMPLE, gene_moments, sample_totals
from .structure import key_type, sample_index, sum_vectors
from ..functions.tails import gamma_upper
from ..runtime import cut, settle


def sample_structure(values: DataFrame, n_components: int = structure.COMPONENTS) -> dict[str, DataFrame]:
    """index and leading components of long values (absent = zero)."""
    index = cut(sample_index(values))
    return {"index": index, "components": cut(structure.components(values, index, n_components))}


def principal_components(values: DataFrame, n_components: int = structure.COMPONENTS) -> DataFrame:
    """(dataset, sample, i, scores array, ratios array) from long values (absent cells are zero)."""
    return sample_structure(values, n_components)["components"]


def variance_ratios(pcs: DataFrame) -> DataFrame:
    one = pcs.where("i = 0").select(DS, F.posexplode("ratios").alias("component", "variance_ratio"))
    return one.select(DS, (F.col("component") + 1).alias("component"), "variance_ratio")


def coordinates(pcs: DataFrame, n: int = 3) -> DataFrame:
    return pcs.select(DS, SAMPLE, *[F.col("scores")[j].alias(f"pc{j + 1}") for j in range(n)])


def mahalanobis(pcs: DataFrame, n_components: int = 5) -> DataFrame:
    """Distance from the centre in the leading components.

    Component scores are uncorrelated with variances lambda/(n-1), so the covariance is diagonal
    and the distance is a plain weighted sum; null directions drop out as in a pseudo-inverse.
    """
    cut_to = F.slice("scores", 1, n_components)
    squares = pcs.select(DS, SAMPLE, F.posexplode(cut_to).alias("k", "s"))
    var = squares.groupBy(DS, "k").agg(F.var_samp("s").alias("v"), F.avg("s").alias("m"))
    top = var.groupBy(DS).agg(F.max("v").alias("vmax"))
    d = F.col("s") - F.col("m")
    usable = F.col("v") > F.col("vmax") * 1e-13
    return (squares.join(var, [DS, "k"]).join(top, DS).groupBy(DS, SAMPLE)
            .agg(F.sqrt(F.sum(F.when(usable, d * d / F.col("v")).otherwise(0.0))).alias("distance")))


def library_z(counts: DataFrame) -> DataFrame:
    libs = sample_totals(counts)
    s = libs.groupBy(DS).agg(F.avg("library_size").alias("m"), F.stddev_pop("library_size").alias("sd"))
    return libs.join(s, DS).select(DS, SAMPLE, F.abs((F.col("library_size") - F.col("m")) / F.col("sd")).alias("z"))


def basic_outliers(pcs: DataFrame, counts: DataFrame) -> DataFrame:
    """Samples beyond mean + 3 sd in Mahalanobis distance and beyond 3 in library z (both needed)."""
    dist = mahalanobis(pcs)
    limit = dist.groupBy(DS).agg((F.avg("distance") + 3 * F.stddev_pop("distance")).alias("limit"))
    return (dist.join(limit, DS).join(library_z(counts), [DS, SAMPLE])
            .select(DS, SAMPLE, "distance", "z",
                    ((F.col("distance") > F.col("limit")) & (F.coalesce("z", F.lit(0.0)) > 3)).alias("outlier")))


def pca_mahalanobis_outliers(pcs: DataFrame) -> DataFrame:
    dist = mahalanobis(pcs)
    limit = ordered.quantiles(dist, [DS], "distance", {"limit": 0.95})
    return dist.join(limit, DS).select(DS, SAMPLE, (F.col("distance") > F.col("limit")).alias("outlier"))


def library_size_outliers(counts: DataFrame) -> DataFrame:
    return library_z(counts).select(DS, SAMPLE, F.coalesce(F.col("z") > 3, F.lit(False)).alias("outlier"))


def mean_correlation(values: DataFrame, parts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Mean correlation of each sample's standardised profile with all other samples'.

    With u the centred profile of a sample at unit length, its correlations sum to u . U, where U is the sum of all u
    by gene. So sums by gene and by sample suffice at every number of samples, and absent cells enter in closed form.
    """
    index = parts["index"] if parts else cut(sample_index(values))
    stats = cut(gene_moments(values, "value").select(
        DS, GENE, "mean", F.when(F.col("var_pop") > 1e-30, F.sqrt("var_pop")).otherwise(1.0).alias("scale")))
    zero = -F.col("mean") / F.col("scale")
    base = stats.groupBy(DS).agg(F.sum(zero).alias("zero_sum"), F.sum(zero * zero).alias("zero_squares"),
                                 F.count(F.lit(1)).alias("n_genes"))
    z = (F.col("value") - F.col("mean")) / F.col("scale")
    cells = values.join(stats, [DS, GENE]).select(DS, GENE, SAMPLE, zero.alias("zero"), z.alias("z"))
    own = cells.groupBy(DS, SAMPLE).agg(F.sum(F.col("z") - F.col("zero")).alias("s"),
                                        F.sum(F.col("z") * F.col("z") - F.col("zero") * F.col("zero")).alias("q"))
    total, squares = F.coalesce("s", F.lit(0.0)) + F.col("zero_sum"), F.coalesce("q", F.lit(0.0)) + F.col("zero_squares")
    per = cut(index.join(own, [DS, SAMPLE], "left").join(base, DS)
              .select(DS, SAMPLE, (total / F.col("n_genes")).alias("m"),
                      F.sqrt(squares - total * total / F.col("n_genes")).alias("c")))
    all_samples = per.groupBy(DS).agg(F.sum(1 / F.col("c")).alias("inverse"), F.sum(F.col("m") / F.col("c")).alias("shift"),
                                      F.count(F.lit(1)).alias("n"))
    present = cells.join(per, [DS, SAMPLE]).groupBy(DS, GENE).agg(F.sum((F.col("z") - F.col("zero")) / F.col("c")).alias("p"))
    genes = cut(stats.join(present, [DS, GENE], "left").join(all_samples.select(DS, "inverse", "shift"), DS)
                .select(DS, GENE, zero.alias("zero"), (F.coalesce("p", F.lit(0.0)) + zero * F.col("inverse") - F.col("shift")).alias("u")))
    whole = genes.groupBy(DS).agg(F.sum(F.col("u") * F.col("zero")).alias("zero_u"), F.sum("u").alias("sum_u"))
    met = cells.join(genes.select(DS, GENE, "u"), [DS, GENE]).groupBy(DS, SAMPLE) \
        .agg(F.sum((F.col("z") - F.col("zero")) * F.col("u")).alias("t"))
    dot = (F.coalesce("t", F.lit(0.0)) + F.col("zero_u") - F.col("m") * F.col("sum_u")) / F.col("c")
    return (per.join(met, [DS, SAMPLE], "left").join(whole, DS).join(all_samples.select(DS, "n"), DS)
            .select(DS, SAMPLE, ((dot - 1.0) / (F.col("n") - 1)).alias("mean_correlation")))


def correlation_outliers(values: DataFrame, parts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Mean correlation below median - 3 * 1.4826 * MAD."""
    c = cut(mean_correlation(values, parts))
    med = ordered.quantiles(c, [DS], "mean_correlation", {"med": 0.5}).select(DS, "med")
    dev = c.join(med, DS).withColumn("dev", F.abs(F.col("mean_correlation") - F.col("med")))
    mad = ordered.quantiles(dev, [DS], "dev", {"mad": 0.5}).select(DS, "mad")
    limit = F.col("med") - 3 * 1.4826 * F.col("mad")
    return dev.join(mad, DS).select(DS, SAMPLE, (F.col("mean_correlation") < limit).alias("outlier"))


def flag_share(scores: DataFrame, contamination: float) -> DataFrame:
    """Flag scores strictly above the (1 - contamination) quantile of their dataset."""
    limit = ordered.quantiles(scores, [DS], "score", {"limit": 1.0 - contamination}).select(DS, "limit")
    return scores.join(limit, DS).select(DS, SAMPLE, "score", (F.col("score") > F.col("limit")).alias("outlier"))


# Samples of a block in the search for neighbours, and blocks whose finds are merged at once.
NEAR_BLOCK, MERGED = 2048, 32


def nearest_samples(pcs: DataFrame, neighbours: int) -> DataFrame:
    """(dataset, i, d, j): the ``neighbours`` nearest samples of every sample, ties by position.

    Every pair of blocks is one row of work, bounded on both sides, and leaves the nearest few of each of its samples;
    those are merged in two aggregates.
    """
    blocks = cut(structure.point_blocks(pcs, NEAR_BLOCK))
    many = blocks.groupBy(DS).agg(F.max("block").alias("last"))
    left = blocks.join(many, DS).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    right = blocks.select(DS, F.col("block").alias("other"), F.col("i").alias("j"), F.col("x").alias("y"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ds, part, i, x, j, y in zip(pdf[DS], pdf["part"], pdf["i"], pdf["x"], pdf["j"], pdf["y"]):
                i, j = np.asarray(i), np.asarray(j)
                a, b = np.asarray(x).reshape(len(i), -1), np.asarray(y).reshape(len(j), -1)
                d = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0))
                d[i[:, None] == j[None]] = np.inf
                pick = np.argsort(d, axis=1, kind="stable")[:, :neighbours]
                best = np.take_along_axis(d, pick, 1)
                found = [[(float(v), int(k)) for v, k in zip(row, at) if v < np.inf] for row, at in zip(best, j[pick])]
                yield pd.DataFrame({DS: [ds] * len(i), "part": part, "i": i, "near": found})

    pairs = left.join(right, [DS, "other"]).select(DS, F.floor(F.col("other") / MERGED).cast("int").alias("part"), "i", "x", "j", "y")
    kind = "array<struct<d:double,j:int>>"
    found = pairs.mapInPandas(near, f"{DS} {key_type(pcs)}, part int, i int, near {kind}")
    top = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, neighbours).alias("near")
    merged = found.groupBy(DS, "part", "i").agg(top).groupBy(DS, "i").agg(top)
    return merged.select(DS, "i", F.explode("near").alias("e")).select(DS, "i", "e.d", "e.j")


def lof_outliers(pcs: DataFrame, contamination: float = 0.1, neighbours: int = 20) -> DataFrame:
    return flag_share(lof_scores(pcs, neighbours), contamination)


def lof_scores(pcs: DataFrame, neighbours: int = 20) -> DataFrame:
    """Local outlier factor (Breunig et al. 2000) with k = min(neighbours, n - 1); densities follow by joins."""
    knn = cut(nearest_samples(pcs, neighbours))
    kdist = knn.groupBy(DS, "i").agg(F.max("d").alias("kd"))
    reach = knn.join(kdist.select(DS, F.col("i").alias("j"), F.col("kd").alias("kdj")), [DS, "j"])
    lrd = reach.groupBy(DS, "i").agg((1.0 / (F.avg(F.greatest("d", "kdj")) + 1e-10)).alias("lrd"))
    lof = (knn.join(lrd.select(DS, F.col("i").alias("j"), F.col("lrd").alias("lrdj")), [DS, "j"])
           .groupBy(DS, "i").agg(F.avg("lrdj").alias("m")).join(lrd, [DS, "i"])
           .select(DS, "i", (F.col("m") / F.col("lrd")).alias("score")))
    return lof.join(pcs.select(DS, SAMPLE, "i"), [DS, "i"]).select(DS, SAMPLE, "score")


# Genes drawn at once for a node; a node none of whose draws differs looks at all genes of its samples.
DRAWS = 4
# Samples that are walked down a tree at once.
WALK_BLOCK = 2048


def unit_hash(*parts) -> Column:
    """A number in [0, 1) from columns."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    if n <= 2:
        return float(n == 2)
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def isolation_forest_outliers(values: DataFrame, contamination: float = 0.1, trees: int = 100,
                              subsample: int = 256, seed: int = 42) -> DataFrame:
    return flag_share(isolation_scores(values, cut(sample_index(values)), trees, subsample, seed), contamination)


def _training(index: DataFrame, trees: int, subsample: int, seed: int) -> DataFrame:
    """(dataset, tree, n, trains): the min(subsample, n) samples of the smallest hashes for every tree.

    Hashes up to a level that all but surely holds ``subsample`` of them go on to the exact rank.
    """
    n = index.groupBy(DS).agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = index.select(DS, "i").join(n, DS).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    rows = rows.withColumn("u", unit_hash("i", "tree", F.lit(seed)))
    level = (subsample + 12.0 * math.sqrt(subsample) + 40.0) / F.col("n")
    rank = F.row_number().over(Window.partitionBy(DS, "tree").orderBy("u", "i"))
    picked = rows.where(F.col("u") < level).withColumn("_r", rank).where(F.col("_r") <= subsample)
    return picked.groupBy(DS, "tree", "n").agg(F.sort_array(F.collect_list("i")).alias("trains"))


def _grow(draws: DataFrame, cells: DataFrame, training: DataFrame, subsample: int) -> DataFrame:
    """Nodes of every tree: number, drawn gene and cut (null at a leaf), training samples, and the samples of a node for
    which no draw differs (``waits``). A group is one tree: its training samples' cells of the genes drawn for it.

    ``draws`` has (dataset, tree, node, c, g, u): the c-th gene of a node and the place of the cut in its range; c < 0
    is a gene known to differ, and g < 0 says that none does.
    """
    drawn = draws.groupBy(DS, "tree").agg(F.collect_list(F.struct("node", "c", "g", "u")).alias("draws"))
    wanted = draws.where("g >= 0").select(DS, "g", "tree").distinct()
    held = (wanted.join(cells, [DS, "g"]).join(training.select(DS, "tree", F.explode("trains").alias("i")), [DS, "tree", "i"])
            .select(DS, "tree", "g", "i", "value").toDF(DS, "tree", "g", "i", "value"))
    told = training.join(drawn, [DS, "tree"])

    def grow(key: tuple, tree: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        trains = np.asarray(tree["trains"].iloc[0])
        names, at = np.unique(held["g"].to_numpy(), return_inverse=True)
        x = np.zeros((len(names) + 1, len(trains)))
        x[at, np.searchsorted(trains, held["i"].to_numpy())] = held["value"].to_numpy()
        own: dict[int, list] = {}
        for d in tree["draws"].iloc[0]:
            own.setdefault(d["node"], []).append((d["c"], d["g"], d["u"]))
        limit = max(1, math.ceil(math.log2(max(min(len(trains), subsample), 2))))
        rows, stack = [], [(1, np.arange(len(trains)), 0)]
        while stack:
            node, members, depth = stack.pop()
            leaf = [key[0], key[1], node, None, None, len(members), None]
            if len(members) < 2 or depth >= limit:
                rows.append(leaf)
                continue
            for c, g, u in sorted(own.get(node, [])):
                if g < 0:
                    rows.append(leaf)
                    break
                k = np.searchsorted(names, g)
                v = x[k if k < len(names) and names[k] == g else len(names), members]
                if v.max() > v.min():
                    cut_at = v.min() + (v.max() - v.min()) * u
                    rows.append([key[0], key[1], node, g, cut_at, len(members), None])
                    stack += [(2 * node, members[v <= cut_at], depth + 1), (2 * node + 1, members[v > cut_at], depth + 1)]
                    break
            else:
                rows.append([*leaf[:6], trains[members].tolist()])
        return pd.DataFrame(rows, columns=[DS, "tree", "node", "g", "at", "size", "waits"]).astype({"g": "Int64"})

    kind = f"{DS} {key_type(cells)}, tree int, node long, g long, at double, size int, waits array<int>"
    return told.groupBy(DS, "tree").cogroup(held.groupBy(DS, "tree")).applyInPandas(grow, kind)


def isolation_trees(cells: DataFrame, training: DataFrame, genes: DataFrame, subsample: int, seed: int) -> DataFrame:
    """Nodes (dataset, tree, node, g, at, size) of all trees.

    Every possible node has its own draws over all genes of the dataset that vary, by hash. Nodes whose samples differ in
    none of them wait: all genes of their samples are then looked at, the smallest hash among those that differ is the
    node's gene, and the trees with such nodes are grown again, at most once a level.
    """
    node = [DS, "tree", "node"]
    limit = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size("trains"), F.lit(2)).cast("double"))).cast("int"))
    nodes = training.withColumn("node", F.explode(F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2.0), limit).cast("long") - 1)))
    pick = F.floor(unit_hash("tree", "node", "c", F.lit(seed)) * F.col("genes")).cast("long")
    place = unit_hash("tree", "node", F.lit("at"), F.lit(seed))
    draws = (nodes.join(genes, DS).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
             .select(*node, "c", pick.alias("g"), place.alias("u")))
    grown = settle(_grow(draws, cells, training, subsample))
    done = grown.where("waits IS NULL")
    waiting = grown.where("waits IS NOT NULL")
    while waiting.take(1):
        again = waiting.select(DS, "tree").distinct()
        asked = waiting.select(*node, "size", F.explode("waits").alias("i"))
        every = (asked.join(cells, [DS, "i"]).groupBy(*node, "size", "g")
                 .agg(F.count(F.lit(1)).alias("m"), F.min("value").alias("low"), F.max("value").alias("high")))
        zero = F.col("m") < F.col("size")
        differs = F.when(zero, (F.col("low") < 0) | (F.col("high") > 0)).otherwise(F.col("high") > F.col("low"))
        found = every.where(differs).groupBy(*node).agg(F.min_by("g", F.struct(unit_hash("tree", "node", "g", F.lit(seed)), "g")).alias("g"))
        known = waiting.select(*node).join(found, node, "left").select(*node, F.lit(-1).alias("c"), F.coalesce("g", F.lit(-1).cast("long")).alias("g"), place.alias("u"))
        draws = settle(draws.join(again, [DS, "tree"], "left_semi").unionByName(known))
        grown = settle(_grow(draws, cells, training.join(again, [DS, "tree"], "left_semi"), subsample))
        done = settle(done.join(again, [DS, "tree"], "left_anti").unionByName(grown.where("waits IS NULL")))
        waiting = grown.where("waits IS NOT NULL")
        # Trees that still wait are grown anew, so their settled nodes leave.
        done = done.join(waiting.select(DS, "tree").distinct(), [DS, "tree"], "left_anti")
    return done.drop("waits")


def isolation_scores(values: DataFrame, index: DataFrame, trees: int = 100, subsample: int = 256,
                     seed: int = 42) -> DataFrame:
    """Isolation forest (Liu, Ting and Zhou 2008) on gene values.

    A tree is grown by one group of bounded size; then blocks of samples walk down it with the cells of its genes only.
    The mean path, with the mean depth of what a leaf holds, becomes the score.
    """
    varying = gene_moments(values, "value").where("var_pop > 0").select(DS, GENE)
    numbered = cut(ordered.row_numbers(varying, [DS], [GENE], "g").withColumn("g", F.col("g") - 1))
    genes = numbered.groupBy(DS).agg(F.count(F.lit(1)).alias("genes"))
    genes = index.select(DS).distinct().join(genes, DS, "left").select(DS, F.coalesce("genes", F.lit(1)).alias("genes"))
    cells = cut(values.join(numbered, [DS, GENE]).join(index, [DS, SAMPLE]).select(DS, "g", "i", F.col("value").cast("double").alias("value")))
    training = cut(_training(index, trees, subsample, seed))
    grown = settle(isolation_trees(cells, training, genes, subsample, seed))
    packed = grown.groupBy(DS, "tree").agg(F.collect_list(F.struct("node", "g", "at", "size")).alias("nodes")).join(training.select(DS, "tree", "n"), [DS, "tree"])
    blocks = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / WALK_BLOCK).cast("int"))))
    used = grown.where("g IS NOT NULL").select(DS, "tree", "g").distinct()
    held = cells.join(used, [DS, "g"]).select(DS, "tree", F.floor(F.col("i") / WALK_BLOCK).cast("int").alias("block"), "g", "i", "value")
    held = held.toDF(*held.columns)

    def walk(key: tuple, tree: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        n, first = int(tree["n"].iloc[0]), int(key[2]) * WALK_BLOCK
        names, at = np.unique(held["g"].to_numpy(), return_inverse=True)
        x = np.zeros((len(names) + 1, min(WALK_BLOCK, n - first)))
        x[at, held["i"].to_numpy() - first] = held["value"].to_numpy()
        nodes = {d["node"]: d for d in tree["nodes"].iloc[0]}
        path = np.zeros(x.shape[1])
        stack = [(1, np.arange(x.shape[1]), 0)]
        while stack:
            node, members, depth = stack.pop()
            d = nodes[node]
            if d["g"] is None:
                path[members] = depth + average_path(d["size"])
                continue
            k = np.searchsorted(names, d["g"])
            right = x[k if k < len(names) and names[k] == d["g"] else len(names), members] > d["at"]
            stack += [(2 * node, members[~right], depth + 1), (2 * node + 1, members[right], depth + 1)]
        norm = max(average_path(min(n, subsample)), 1e-300)
        return pd.DataFrame({DS: [key[0]] * len(path), "i": np.arange(len(path), dtype=np.int32) + first, "path": path, "norm": norm})

    walked = blocks.groupBy(DS, "tree", "block").cogroup(held.groupBy(DS, "tree", "block")).applyInPandas(
        walk, f"{DS} {key_type(values)}, i int, path double, norm double")
    score = walked.groupBy(DS, "i").agg(F.pow(F.lit(2.0), -F.avg("path") / F.max("norm")).alias("score"))
    return score.join(index, [DS, "i"]).select(DS, SAMPLE, "score")


# Samples of a dataset on which starts are tried before all samples decide.
TRIED = 1500
COVARIANCE_BLOCK = 2048


def chi2_quantile(upper: float, df: int) -> float:
    """Point with upper tail ``upper``, by bisection."""
    low, high = 0.0, 1000.0 + 10.0 * df
    for _ in range(200):
        middle = (low + high) / 2.0
        low, high = (middle, high) if float(gamma_upper([df / 2.0], [middle / 2.0])[0]) > upper else (low, middle)
    return (low + high) / 2.0


def elliptic_outliers(pcs: DataFrame, contamination: float = 0.1, dims: int = 10, steps: int = 30,
                      starts: int = 100, seed: int = 42) -> DataFrame:
    return flag_share(elliptic_scores(pcs, dims, steps, starts, seed), contamination)


def _tried_starts(points: DataFrame, sizes: DataFrame, starts: int, kept: int, seed: int) -> DataFrame:
    """Fits of the ``kept`` best of many starts on at most ``TRIED`` samples of each dataset, drawn by hash."""
    rows = points.join(sizes, DS).withColumn("u", unit_hash("i", F.lit(seed)))
    rank = F.row_number().over(Window.partitionBy(DS).orderBy("u", "i"))
    tried = rows.where(F.col("u") < (TRIED + 12.0 * math.sqrt(TRIED)) / F.col("n")).withColumn("_r", rank).where(F.col("_r") <= TRIED)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        p = int(pdf["p"].iloc[0])
        x = np.vstack(pdf["x"].to_numpy())[:, :p]
        h = min(len(x), math.ceil((len(x) + p + 1) / 2))
        rng = np.random.default_rng(seed)

        def step(members: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
            centre = x[members].mean(0)
            cov = np.atleast_2d(np.cov(x[members].T, bias=True))
            inverse = np.linalg.pinv(cov, hermitian=True)
            diff = x - centre
            closest = np.argsort(np.einsum("ij,jk,ik->i", diff, inverse, diff), kind="stable")[:h]
            sign, logdet = np.linalg.slogdet(cov)
            return closest, logdet if sign > 0 and np.isfinite(logdet) else -1e300, centre, inverse

        tries = []
        for k in range(starts):
            members = rng.permutation(len(x))[:p + 1]
            for _ in range(3):
                members, logdet, centre, inverse = step(members)
            tries.append((logdet, k, members, centre, inverse))
        best = []
        for logdet, k, members, centre, inverse in sorted(tries, key=lambda t: t[:2])[:kept]:
            for _ in range(50):
                members, now, centre, inverse = step(members)
                if now >= logdet - 1e-12:
                    break
                logdet = now
            best.append((pdf[DS].iloc[0], k, p, centre, inverse.ravel(), now))
        return pd.DataFrame(best, columns=[DS, "start", "p", "centre", "inverse", "logdet"])

    kind = f"{DS} {key_type(points)}, start int, p int, centre array<double>, inverse array<double>, logdet double"
    return tried.select(DS, "u", "x", "p").groupBy(DS).applyInPandas(fit, kind)


def _fit(sums: DataFrame) -> DataFrame:
    """Centre, inverse and log determinant of every (dataset, start) from its count, sums and sums of products."""
    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            centres, inverses, logdets = [], [], []
            for p, v in zip(pdf["p"], pdf["v"]):
                v = np.asarray(v)
                centre = v[1:1 + p] / v[0]
                cov = v[1 + p:].reshape(p, p) / v[0] - np.outer(centre, centre)
                sign, logdet = np.linalg.slogdet(cov)
                centres.append(centre)
                inverses.append(np.linalg.pinv(cov, hermitian=True).ravel())
                logdets.append(logdet if sign > 0 and np.isfinite(logdet) else -1e300)
            yield pd.DataFrame({DS: pdf[DS], "start": pdf["start"], "p": pdf["p"], "centre": centres, "inverse": inverses, "logdet": logdets})

    return sums.mapInPandas(fit, f"{DS} {key_type(sums)}, start int, p int, centre array<double>, inverse array<double>, logdet double")


def _distances(blocks: DataFrame, fits: DataFrame) -> DataFrame:
    """Squared distances of every sample under every fit: (dataset, start, i, p, d)."""
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ds, start, p, centre, inverse, i, x in zip(*(pdf[c] for c in (DS, "start", "p", "centre", "inverse", "i", "x"))):
                diff = np.asarray(x).reshape(len(i), -1)[:, :p] - np.asarray(centre)
                yield pd.DataFrame({DS: [ds] * len(i), "start": start, "i": i, "p": p,
                                    "d": np.maximum(np.einsum("ij,jk,ik->i", diff, np.asarray(inverse).reshape(p, p), diff), 0.0)})

    met = blocks.join(fits, DS).select(DS, "start", "p", "centre", "inverse", "i", "x")
    return met.mapInPandas(measure, f"{DS} {key_type(blocks)}, start int, i int, p int, d double")


def _member_sums(points: DataFrame, members: DataFrame) -> DataFrame:
    """Count, sums and sums of products of the chosen samples of every (dataset, start)."""
    x = F.slice("x", 1, F.col("p"))
    products = F.flatten(F.transform("_x", lambda a: F.transform("_x", lambda b: a * b)))
    rows = (points.join(members.select(DS, "start", "i", "p"), [DS, "i"]).withColumn("_x", x)
            .select(DS, "start", "p", F.concat(F.array(F.lit(1.0)), F.col("_x"), products).alias("v")))
    return sum_vectors(rows, [DS, "start", "p"])


def _closest(distances: DataFrame) -> DataFrame:
    """The h samples of smallest distance of every (dataset, start), with all that tie with the last of them."""
    by = [DS, "start"]
    ranks = ordered.tie_ranks(distances, by, "d").select(*by, "d", "rank_max")
    sizes = distances.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p"))
    h = F.least(F.col("n"), F.ceil((F.col("n") + F.col("p") + 1) / 2))
    limits = ranks.join(sizes, by).where(F.col("rank_max") >= h).groupBy(*by).agg(F.min("d").alias("limit"))
    return distances.join(limits, by).where("d <= limit")


def elliptic_scores(pcs: DataFrame, dims: int = 10, steps: int = 30, starts: int = 100, seed: int = 42, kept: int = 5) -> DataFrame:
    """Robust squared distance: fast minimum covariance determinant (Rousseeuw and Van Driessen 1999), reweighted.

    Starts are tried on a bounded draw of every dataset. The best go on over all samples, as rows of one frame: a
    concentration step takes mean and covariance as sums and the h closest samples by an ordered cut, until no
    determinant falls. The best fit is scaled to the chi-square median, and samples within its 97.5 % point give the
    final mean and covariance.
    """
    points = cut(pcs.select(DS, "i", F.slice("scores", 1, dims).alias("x")))
    blocks = cut(structure.point_blocks(pcs, COVARIANCE_BLOCK, dims))
    n = points.groupBy(DS).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("_k"))
    n = cut(n.select(DS, "n", F.greatest(F.lit(1), F.least(F.col("_k"), F.col("n") - 1)).cast("int").alias("p")))
    fits = settle(_tried_starts(points, n, starts, kept, seed))
    for step in range(steps):
        closer = settle(_fit(_member_sums(points, _closest(settle(_distances(blocks, fits))))))
        before = fits.select(DS, "start", F.col("logdet").alias("_before"))
        # The first step moves from the draw to all samples, whose determinants are not comparable.
        falls = closer.join(before, [DS, "start"]).where(F.abs(F.col("logdet") - F.col("_before")) > 1e-9)
        fits = closer
        if not falls.take(1):
            break
    best = fits.groupBy(DS).agg(F.min_by(F.struct("start", "p", "centre", "inverse", "logdet"), F.struct("logdet", "start")).alias("e")).select(DS, "e.*")
    raw = cut(_distances(blocks, best))
    quantile = lambda upper: F.element_at(F.array(*[F.lit(chi2_quantile(upper, p)) for p in range(1, dims + 1)]), F.col("p"))
    middle = ordered.quantiles(raw, [DS], "d", {"median": 0.5}).select(DS, "median")
    inside = raw.join(middle, DS).where(F.col("d") * quantile(0.5) < quantile(0.025) * F.col("median"))
    final = _fit(_member_sums(points, inside))
    # A fit that rests on too few directions leaves no sample inside; then the raw distances stand.
    scored = _distances(blocks, final).select(DS, "i", F.col("d").alias("score"))
    return (pcs.select(DS, SAMPLE, "i").join(raw.select(DS, "i", "d"), [DS, "i"]).join(scored, [DS, "i"], "left")
            .select(DS, SAMPLE, F.coalesce("score", "d").alias("score")))


# Method names of the vote.
METHODS = ["pca_mahalanobis", "isolation_forest", "lof", "elliptic_envelope", "correlation", "library_size"]


def consensus_outliers(counts: DataFrame, values: DataFrame, methods: list[str] | None = None,
                       threshold: int = 3, contamination: float = 0.1,
                       parts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Votes per sample over the chosen methods; consensus at ``threshold`` votes.

    Score-quantile methods are stacked, so all their limits come from one ordered pass.
    """
    chosen = methods or METHODS
    unknown = set(chosen) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    if set(chosen) != {"library_size"}:
        values = cut(values)
        parts = parts or sample_structure(values)
    scorers: dict[str, Callable[[], DataFrame]] = {
        "pca_mahalanobis": lambda: mahalanobis(parts["components"]).withColumnRenamed("distance", "score"),
        "isolation_forest": lambda: isolation_scores(values, parts["index"]),
        "lof": lambda: lof_scores(parts["components"]),
        "elliptic_envelope": lambda: elliptic_scores(parts["components"]),
    }
    voters: dict[str, Callable[[], DataFrame]] = {
        "correlation": lambda: correlation_outliers(values, parts), "library_size": lambda: library_size_outliers(counts)}
    # The methods are chains of small jobs that do not wait for each other.
    with ThreadPoolExecutor(len(chosen)) as pool:
        made = dict(zip(chosen, pool.map(lambda m: cut((scorers | voters)[m]()), chosen)))
    votes, scores = None, None
    for method in chosen:
        part = made[method].withColumn("method", F.lit(method))
        if method in scorers:
            scores = part if scores is None else scores.unionByName(part)
        else:
            votes = part if votes is None else votes.unionByName(part.select(*votes.columns))
    if scores is not None:
        q = ordered.quantiles(scores, [DS, "method"], "score", {"q95": 0.95, "share": 1.0 - contamination})
        limit = F.when(F.col("method") == "pca_mahalanobis", F.col("q95")).otherwise(F.col("share"))
        flagged = scores.join(q, [DS, "method"]).select(DS, SAMPLE, "method", (F.col("score") > limit).alias("outlier"))
        votes = flagged if votes is None else votes.select(*flagged.columns).unionByName(flagged)
    return votes.groupBy(DS, SAMPLE).agg(
        F.count_if("outlier").alias("votes"),
        F.sort_array(F.collect_list(F.when(F.col("outlier"), F.col("method")))).alias("flagged_by"),
    ).withColumn("is_outlier", F.col("votes") >= threshold)
