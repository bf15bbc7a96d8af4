"""What one task holds does not follow from how many vectors a shard has."""

import tracemalloc

import numpy as np
import pytest

neardup = pytest.importorskip("longomics.llm.neardup")


def test_whole_comparison_holds_a_bounded_number_of_similarities():
    rng = np.random.default_rng(3)
    vectors = neardup._unit(rng.normal(size=(60_000, 8)))
    queries = vectors[:256].copy()
    tracemalloc.start()
    a, b = neardup._whole(queries, vectors, 0.97)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    near = queries @ vectors.T
    assert {(i, j) for i, j in zip(a.tolist(), b.tolist())} >= set(zip(*map(np.ndarray.tolist, np.nonzero(near >= 0.97 + 1e-9))))
    assert (near[a, b] >= 0.97 - 1e-9).all()
