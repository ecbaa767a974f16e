"""Vectors as array<double>: centroids, assignment, quality of a clustering, projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clusters that a driver may hold: their centroids are collected and sent to every task.
MOST_CLUSTERS = 10_000


def squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(points: DataFrame, label: str = "label", vector: str = "v") -> DataFrame:
    """(label, n, center): the mean vector of each label; sums are combined before the shuffle."""
    held = points.groupBy(label).agg(F.count("*").alias("n"), Summarizer.mean(array_to_vector(vector)).alias("m"))
    return held.select(label, "n", vector_to_array("m").alias("center"))


def assigned(points: DataFrame, centers: DataFrame, label: str = "label", vector: str = "v") -> DataFrame:
    """Adds nearest and distance2 (squared); of equally near centers the lowest label wins. Centers are one broadcast row of checked size."""
    if centers.limit(MOST_CLUSTERS + 1).count() > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} centers")
    row = centers.agg(F.sort_array(F.collect_list(F.struct(label, "center"))).alias("parley_centers"))
    near = F.array_min(F.transform("parley_centers", lambda c: F.struct(squared(F.col(vector), c["center"]).alias("d2"), c[label].alias("k"))))
    out = points.join(F.broadcast(row), F.lit(True)).withColumn("parley_near", near)
    return out.withColumn("nearest", F.col("parley_near.k")).withColumn("distance2", F.col("parley_near.d2")).drop("parley_near", "parley_centers")


def lloyd(points: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """Points with the nearest of the centers that ``rounds`` rounds of k-means make of ``seeds`` (label, center)."""
    centers = seeds
    for _ in range(rounds):
        rows = centroids(assigned(points, centers).drop("label"), "nearest").select(F.col("nearest").alias("label"), "center").collect()
        centers = points.sparkSession.createDataFrame(rows, "label int, center array<double>")
    return assigned(points, centers)


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """One row (score); null with one cluster or as many clusters as points."""
    return _scattered(points).select(F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), F.round((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))), 6)).alias("score"))


def _scattered(points: DataFrame) -> DataFrame:
    own = centroids(points)
    whole = points.groupBy(F.lit(1)).agg(Summarizer.mean(array_to_vector("v")).alias("m")).select(vector_to_array("m").alias("mean"))
    between = own.join(F.broadcast(whole), F.lit(True)).agg(F.sum(F.col("n") * squared(F.col("center"), F.col("mean"))).alias("between"), F.count("*").alias("k"), F.sum("n").alias("n"))
    within = points.join(own.select("label", "center"), "label").agg(F.sum(squared(F.col("v"), F.col("center"))).alias("within"))
    return between.join(F.broadcast(within), F.lit(True))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """One row (score): the mean over clusters of the worst (spread + spread) / distance; centers pair in one join, and beyond MOST_CLUSTERS
    are not sent to all tasks but meet part by part."""
    own = centroids(points)
    few = own.limit(MOST_CLUSTERS + 1).count() <= MOST_CLUSTERS
    spread = points.join(own.select("label", "center"), "label").groupBy("label").agg(F.avg(F.sqrt(squared(F.col("v"), F.col("center")))).alias("s"))
    held = own.join(spread, "label").select("label", "center", "s")
    other = held.select(F.col("label").alias("l2"), F.col("center").alias("c2"), F.col("s").alias("s2"))
    pairs = held.join(F.broadcast(other) if few else other, F.col("label") != F.col("l2")).groupBy("label").agg(F.max((F.col("s") + F.col("s2")) / F.sqrt(squared(F.col("center"), F.col("c2")))).alias("r"))
    return pairs.agg(F.round(F.avg("r"), 6).alias("score"))


def silhouette(points: DataFrame, sample: int = 2000, order: str = "vec_id", seed: int = 42) -> DataFrame:
    """One row (score) over at most ``sample`` points, the first by a seeded hash of ``order``; a point alone in its cluster counts 0.

    The sample is bounded, and so sent to all tasks; each compares its share of it with the whole in blocks of one matrix.
    """
    taken = points.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string"))), order).limit(sample).select(order, "label", "v")
    rows = taken.collect()
    if not rows:
        return points.sparkSession.createDataFrame([(None,)], "score double")
    names, labels = np.unique([r["label"] for r in rows], return_inverse=True)
    v = np.array([r["v"] for r in rows], float)
    sizes = np.bincount(labels, minlength=len(names))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i in frame["id"].tolist():
                d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
                sums, own = np.bincount(labels, d, len(names)), labels[i]
                others = np.delete(sums / sizes, own)
                if sizes[own] < 2 or not len(others):
                    out.append(0.0)
                    continue
                a, b = sums[own] / (sizes[own] - 1), others.min()
                out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
            yield pd.DataFrame({"s": out})

    spark = points.sparkSession
    each = spark.range(len(rows), numPartitions=max(1, min(len(rows), spark.sparkContext.defaultParallelism)))
    return each.mapInPandas(run, "s double").agg(F.round(F.avg("s"), 6).alias("score"))


def pca_map(points: DataFrame) -> DataFrame:
    """Adds x and y: the two main components about the mean, each with its largest loading positive."""
    from pyspark.ml.feature import PCA

    held = points.withColumn("parley_v", array_to_vector("v"))
    model = PCA(k=2, inputCol="parley_v", outputCol="parley_p").fit(held)
    loads = model.pc.toArray()
    mean = held.agg(Summarizer.mean(F.col("parley_v")).alias("m")).first()["m"].toArray()
    signs = [1.0 if loads[abs(loads[:, k]).argmax(), k] > 0 else -1.0 for k in range(2)]
    shift = mean @ loads
    out = model.transform(held).withColumn("parley_a", vector_to_array("parley_p"))
    for k, name in enumerate(("x", "y")):
        out = out.withColumn(name, F.lit(signs[k]) * (F.col("parley_a")[k] - F.lit(float(shift[k]))))
    return out.drop("parley_v", "parley_p", "parley_a")
