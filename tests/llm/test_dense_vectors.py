import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from dossier.llm import embeddings


def near_all(n, dims=32, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dims)
    v = centre / np.linalg.norm(centre) + rng.normal(size=(n, dims)) * 0.02
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_a_dense_group_takes_bounded_memory():
    v = near_all(6000)
    axes = embeddings.principal_axes(v[:1000])
    tracemalloc.start()
    forest, links = embeddings.Forest(len(v)), np.zeros(len(v))
    edges = 0
    for i, j in embeddings.similar_pairs(v @ axes, v @ axes, 0.9, 12):
        i, j = i[i < j], j[i < j]
        links += np.bincount(i, minlength=len(v)) + np.bincount(j, minlength=len(v))
        edges += len(forest.add(i, j))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links == len(v) - 1).all() and edges == len(v) - 1
    assert peak < 200_000_000  # all pairs would be 18 million, in two columns


def test_planted_links_equal_brute_force_over_many_tiles(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 24))
    groups = np.concatenate([base[k] + rng.normal(size=(n, 24)) * s for k, n, s in [(0, 90, 0.05), (1, 60, 0.3), (2, 40, 0.45), (3, 30, 0.6)]])
    rows = np.concatenate([base, groups, base[5:8], 3 * base[9:11]])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    cos = unit @ unit.T
    linked = (cos >= 0.9) & ~np.eye(len(rows), dtype=bool)
    assert 2000 < linked.sum() and np.abs(cos - 0.9).min() > 1e-9
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([root[k], *(root[j] for j in np.flatnonzero(linked[k]))]) for k in range(len(rows))]
        if new == root:
            break
        root = new
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df.withColumn("a", F.lit(1)), tile=64).collect()}
    assert got == {k: (int(linked[k].sum()), root[k], root[k] == k) for k in range(len(rows))}
