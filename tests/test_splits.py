"""Splits by priority against the plain loop that splits one cluster at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import clustering, splits


@pytest.fixture(autouse=True)
def few_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_halves(v, ids):
    m = v.mean(axis=0)
    d = ((v - m) ** 2).sum(axis=1)
    a = v[max(range(len(ids)), key=lambda i: (d[i], ids[i]))]
    d = ((v - a) ** 2).sum(axis=1)
    b = v[max(range(len(ids)), key=lambda i: (d[i], ids[i]))]
    for _ in range(splits.ROUNDS):
        side = ((v - a) ** 2).sum(axis=1) > ((v - b) ** 2).sum(axis=1)
        new = (v[~side].mean(axis=0) if (~side).any() else a, v[side].mean(axis=0) if side.any() else b)
        if np.allclose(new[0], a, rtol=0, atol=0) and np.allclose(new[1], b, rtol=0, atol=0):
            break
        a, b = new
    return ((v - a) ** 2).sum(axis=1) > ((v - b) ** 2).sum(axis=1)


def plain_loop(v, labels, k):
    labels, n = np.array(labels), 0
    while len(set(labels.tolist())) < k:
        sizes = {x: int((labels == x).sum()) for x in sorted(set(labels.tolist()))}
        top = max(sizes, key=lambda x: (sizes[x], -x))
        at = np.flatnonzero(labels == top)
        if len(at) < 2:
            break
        side = plain_halves(v[at], at.tolist())
        if not side.any():
            break
        labels[at[side]] = labels.max() + 1
        n += 1
    return labels.tolist(), n


def framed(spark, v, labels):
    return spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, labels, strict=True))], "vec_id long, v array<double>, label int")


@pytest.mark.parametrize("k", [3, 9, 24])
def test_splits_equal_the_plain_loop(spark, k):
    rng = np.random.default_rng(k)
    v = np.round(np.concatenate([rng.normal(0, 1, (70, 2)), rng.normal(20, 3, (25, 2)), rng.normal(-20, 1, (8, 2))]), 3)
    labels = [4] * 70 + [7] * 25 + [9] * 8
    got, n = splits.split_to(framed(spark, v, labels), k)
    assert ([r.label for r in got.orderBy("vec_id").collect()], n) == plain_loop(v, labels, k)
    assert got.columns == ["vec_id", "v", "label"]


def test_a_cluster_that_cannot_be_halved_ends_it(spark):
    v = np.array([[0.0, 0.0]] * 9 + [[5.0, 5.0], [6.0, 5.0], [9.0, 5.0]])
    labels = [0] * 9 + [1] * 3
    got, n = splits.split_to(framed(spark, v, labels), 5)
    assert ([r.label for r in got.orderBy("vec_id").collect()], n) == plain_loop(v, labels, 5) == (labels, 0)
    got, n = splits.split_to(framed(spark, v[:3] + np.arange(3)[:, None], [0, 0, 0]), 9)
    assert n == 2 and len({r.label for r in got.collect()}) == 3


def test_hybrid_obeys_its_options(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 0.2, (50, 2)), rng.normal(8, 0.2, (30, 2)), rng.uniform(-9, 18, (12, 2))])
    df = framed(spark, v, [0] * len(v)).drop("label")
    found, report = clustering.fit(df, "hybrid", 6, noise="drop", min_size=10, min_samples=4)
    assert report["raw_clusters"] == 2 and report["noise"] > 0 and report["noise_policy"] == "drop_bucket"
    assert report["splits"] == 3 and report["effective_k"] == 6 and report["fallback"] is None
    assert report["noise"] in [r["count"] for r in found.groupBy("label").count().collect()]  # the bucket of noise
    assert all(isinstance(report[k], float) for k in ("silhouette", "davies_bouldin", "calinski_harabasz"))
