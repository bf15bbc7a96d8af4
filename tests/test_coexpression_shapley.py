"""Modules against linkage one pair at a time, tree Shapley values against all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from longomics.operators import coexpression, selection, treeshap


def plain_overlap(x, power):
    w = np.round(np.clip((1 + np.corrcoef(x)) / 2, 0, 1) ** power, 12)
    np.fill_diagonal(w, 0.0)
    k = w.sum(0)
    t = (w @ w + w) / (np.minimum(k[:, None], k[None]) + 1 - w)
    np.fill_diagonal(t, 0.0)
    return t


def plain_linkage(t, height):
    groups = [[i] for i in range(len(t))]
    while len(groups) > 1:
        best = max(((np.mean(t[np.ix_(a, b)]), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)))
        if best[0] < 1 - height:
            break
        groups[best[1]] += groups.pop(best[2])
    return {tuple(sorted(g)) for g in groups}


def expression(spark, x):
    rows = [("d", g, s, float(x[g, s]), s % 2) for g in range(x.shape[0]) for s in range(x.shape[1])]
    return spark.createDataFrame(rows, "dataset_id string, gene_id int, sample_id int, value double, y int").cache()


def grouped(labels):
    return {tuple(sorted(r["g"])) for r in labels.groupBy("module").agg(F.collect_list("gene_id").alias("g")).collect()}


def planted(genes=60, samples=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, samples))
    return np.vstack([centres[g % 4] * 1.2 + rng.normal(size=samples) for g in range(genes)])


@pytest.mark.parametrize("height", [0.97, 0.8, 0.6])
def test_modules_equal_linkage_one_pair_at_a_time(spark, height):
    x = planted()
    t = plain_overlap(x, 6)
    v = expression(spark, x)
    overlap = coexpression.topological_overlap(coexpression.adjacency(v, 6, neighbours=60, size=16)).cache()
    got = {(r["a"], r["b"]): r["s"] for r in overlap.collect()}
    assert len(got) == 60 * 59 / 2 and max(abs(s - t[a, b]) for (a, b), s in got.items()) < 1e-9
    assert grouped(coexpression.average_linkage(overlap, v.select("gene_id"), height)) == plain_linkage(t, height)


@pytest.mark.parametrize("height", [0.8, 0.6])
def test_modules_count_every_pair(spark, height):
    x = planted(64, seed=4)
    t = np.round(plain_overlap(x, 6), 12)
    v = expression(spark, x)
    assert grouped(coexpression.modules(v, height=height, min_size=1)) == plain_linkage(t, height)


def test_overlaps_are_whole_inside_the_groups_of_strong_pairs(spark, monkeypatch):
    monkeypatch.setattr(coexpression.network, "TILE", 16)
    x = planted(90, seed=4)
    x[7, 3] = x[8, 3]
    t = plain_overlap(x, 6)
    for limit in (0.0, 0.3, 0.4):
        near = t >= limit
        group = np.arange(90)
        for _ in range(90):
            group = np.array([min(group[near[g]].min(initial=90), group[g]) for g in range(90)])
        got = {(r["a"], r["b"]): r["s"] for r in coexpression.topological_overlap(
            coexpression.adjacency(expression(spark, x), 6, size=20), limit).collect()}
        want = {(a, b) for a in range(90) for b in range(a + 1, 90) if group[a] == group[b] and t[a, b] > 0}
        assert set(got) == want and max(abs(s - t[p]) for p, s in got.items()) < 1e-9
    assert 0 < len(want) < 90 * 89 / 2


def test_edges_are_bounded_and_mutual(spark):
    x = planted(40)
    w = np.round(np.clip((1 + np.corrcoef(x)) / 2, 0, 1) ** 6, 12)
    np.fill_diagonal(w, -1.0)
    near = [set(sorted(range(40), key=lambda o: (-w[g, o], o))[:5]) for g in range(40)]
    want = {(a, b) for a in range(40) for b in near[a] if a < b and a in near[b]}
    got = coexpression.adjacency(expression(spark, x), 6, neighbours=5, size=7).collect()
    assert {(r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("rows, blocks", [(1, 2), (3, 100)])
def test_a_meeting_hands_on_the_best_of_its_own_genes_only(spark, monkeypatch, rows, blocks):
    x = np.vstack([planted(50), planted(50)])  # copies tie
    w = np.round(np.clip((1 + np.corrcoef(x)) / 2, 0, 1) ** 6, 12)
    np.fill_diagonal(w, -1.0)
    near = [set(sorted(range(100), key=lambda o: (-w[g, o], o))[:5]) for g in range(100)]
    monkeypatch.setattr(coexpression, "ROWS", rows)
    monkeypatch.setattr(coexpression, "SPAN", blocks)
    got = coexpression.adjacency(expression(spark, x), 6, neighbours=5, size=9).collect()
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in range(100) for b in near[a] if a < b and a in near[b]}
    z = (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) * np.sqrt(x.shape[1]))
    monkeypatch.setattr(coexpression, "PENDING", 50)
    nearest = coexpression.Nearest(z[:30], np.arange(30), 5, 6)
    for at in range(0, 100, 9):
        nearest.meet(z[at:at + 9], np.arange(at, min(at + 9, 100)))
    nearest.merge()
    assert len(nearest.held[0]) == 30 * 5
    assert [set(nearest.held[1][nearest.held[0] == g]) for g in range(30)] == near[:30]


def test_ties_repeats_and_constant_genes(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 20))
    x = np.vstack([base[g // 6] for g in range(18)] + [np.full((1, 20), 2.0)])
    labels = coexpression.modules(expression(spark, x), min_size=1, height=0.5)
    assert grouped(labels) == {tuple(range(6)), tuple(range(6, 12)), tuple(range(12, 18)), (18,)}
    assert {r["module"] for r in labels.collect()} == {0, 6, 12, 18}
    empty = expression(spark, x).limit(0)
    assert coexpression.modules(empty).count() == 0
    with pytest.raises(ValueError):
        selection.coexpression_hubs(expression(spark, x[:, :14]))


def test_hubs_come_from_the_module_of_the_trait(spark):
    rng = np.random.default_rng(8)
    trait, other = np.arange(30) % 2 * 2.0, np.arange(30) // 2 % 2 * 2.0
    x = np.vstack([(trait if g < 8 else other if g < 16 else np.zeros(30)) + rng.normal(size=30) * 0.4 for g in range(30)])
    got = selection.coexpression_hubs(expression(spark, x), min_size=5, hubs=4, height=0.7).where("selected").collect()
    assert len(got) == 4 and {r["gene_id"] for r in got} <= set(range(8))


def test_hubs_come_from_modules_of_all_pairs(spark):
    rng = np.random.default_rng(12)
    trait = np.arange(30) % 2
    x = np.vstack([trait * (2.4 if g < 60 else 0) + rng.normal(size=30) for g in range(70)])
    want = set()
    for m in plain_linkage(np.round(plain_overlap(x, 6), 12), 0.7):
        z = (x[list(m)] - x[list(m)].mean(1, keepdims=True)) / x[list(m)].std(1, keepdims=True)
        e = np.linalg.svd(z, full_matrices=False)[2][0]
        if len(m) >= 5 and abs(np.corrcoef(e, trait)[0, 1]) > 0.5:
            want |= {m[i] for i in np.argsort([-abs(np.corrcoef(e, row)[0, 1]) for row in z])[:4]}
    got = selection.coexpression_hubs(expression(spark, x), min_size=5, hubs=4, height=0.7).where("selected").collect()
    assert len(want) == 4 and {r["gene_id"] for r in got} == want


def expectation(nodes, x, known, at=0):
    """Output of a tree that follows known features and averages over training rows elsewhere."""
    value, left, right, j, threshold, cover = nodes[at]
    if left < 0:
        return value
    if j in known:
        return expectation(nodes, x, known, left if x[j] <= threshold else right)
    return sum(nodes[c][5] * expectation(nodes, x, known, c) for c in (left, right)) / cover


def plain_trees(model, boosted):
    out = []
    for w, tree in zip(model.treeWeights, model.trees):
        nodes = []

        def walk(node):
            at = len(nodes)
            nodes.append(None)
            stats = list(node.impurityStats().stats())
            cover = stats[0] if boosted else sum(stats)
            value = w * node.prediction() if boosted else stats[1] / cover / len(model.treeWeights)
            if node.numDescendants() == 0:
                nodes[at] = (value, -1, -1, -1, 0.0, cover)
            else:
                j, threshold = node.split().featureIndex(), node.split().threshold()
                nodes[at] = (value, walk(node.leftChild()), walk(node.rightChild()), j, threshold, cover)
            return at

        walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"))
        out.append(nodes)
    return out


@pytest.mark.parametrize("boosted", [False, True])
def test_shapley_values_equal_all_subsets(spark, boosted):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(80, 8))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=80) > 0).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(80)], "sample_id int, y int, f array<double>")
    vectors = rows.select("sample_id", "y", array_to_vector("f").alias("features")).repartition(3).cache()
    kind = GBTClassifier(maxIter=4, maxDepth=4, labelCol="y", seed=2) if boosted else RandomForestClassifier(numTrees=6, maxDepth=4, labelCol="y", seed=2)
    model = kind.fit(vectors)
    phi, used, base = treeshap.contributions(model, vectors)
    got = {r["sample_id"]: dict(zip(used, r["phi"])) for r in phi.collect()}
    trees = plain_trees(model, boosted)
    for i in (0, 7, 33):
        table = {s: sum(expectation(t, x[i], set(s)) for t in trees) for n in range(9) for s in itertools.combinations(range(8), n)}
        for j in range(8):
            want = sum(math.factorial(len(s)) * math.factorial(7 - len(s)) / math.factorial(8) * (table[tuple(sorted((*s, j)))] - table[s])
                       for s in table if j not in s)
            assert got[i].get(j, 0.0) == pytest.approx(want, abs=1e-9)
    output = "rawPrediction" if boosted else "probability"
    for r in model.transform(vectors).collect():
        assert base + sum(got[r["sample_id"]].values()) == pytest.approx(r[output][1], abs=1e-9)


def test_shapley_selector_finds_the_signal_and_survives_one_class(spark):
    rng = np.random.default_rng(1)
    y = np.arange(60) % 2
    x = rng.normal(size=(80, 60))
    x[:2] += 2.0 * y
    v = expression(spark, x)
    got = selection.shapley(v, 2, trees=30)
    assert got.count() == 80 and {r["gene_id"] for r in got.where("selected").collect()} == {0, 1}
    flat = selection.shapley(v.withColumn("y", F.lit(1)), 2, trees=3)
    assert flat.agg(F.max("score")).first()[0] == 0.0
