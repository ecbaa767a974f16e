"""Clusterings: how many leaves, k-means, density clusters, what becomes of noise, refinement, and the sizes against thresholds."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.conversations import batches, joined_or_error, numbered_within
from parley.operators.density import core_distances, density  # noqa: F401 - a clustering like the others
from parley.operators.splits import split_to
from parley.operators.vectors import assigned, calinski_harabasz, centroids, davies_bouldin, silhouette
from parley.sources.store import stage


def leaf_count(n: int, *, mode: str = "auto", requested: int = 20, target_size: int = 25, least: int = 20, most: int = 200) -> tuple[int, int | None]:
    """(k, auto target before the limit of n): a fixed number, or n over the target size between least and most."""
    if mode not in ("auto", "fixed") or min(requested, target_size, least) < 1 or most < least:
        raise ValueError("mode is auto or fixed, sizes are positive, and least is no more than most")
    if mode == "fixed":
        return max(1, min(requested, n)), None
    bounded = max(least, min(most, math.ceil(n / target_size)))
    return max(1, min(bounded, n)), bounded


def kmeans(points: DataFrame, k: int, *, seed: int = 42, starts: int = 10, vector: str = "v", at_once: int = 5) -> DataFrame:
    """Adds label by the best of ``starts`` runs of k-means, ``at_once`` of them at a time; there may be fewer than k clusters."""
    held = (stage(points, "points") if starts > 1 else points).withColumn("parley_v", array_to_vector(vector))

    def fitted(i: int):
        return KMeans(k=max(2, k), seed=seed + i, featuresCol="parley_v", predictionCol="label").fit(held)

    with ThreadPool(max(1, min(at_once, starts))) as pool:
        models = pool.map(inheritable_thread_target(points.sparkSession)(fitted), range(starts), chunksize=1)
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(held).drop("parley_v")
    return out.withColumn("label", F.lit(0)) if k == 1 else out


def bisecting(points: DataFrame, k: int, *, seed: int = 42, vector: str = "v") -> DataFrame:
    """Adds label by splitting the largest clusters in two until there are k: refinement that stays in Spark."""
    held = points.withColumn("parley_v", array_to_vector(vector))
    return BisectingKMeans(k=k, seed=seed, featuresCol="parley_v", predictionCol="label").fit(held).transform(held).drop("parley_v")


def with_noise(points: DataFrame, policy: str, *, order: str = "vec_id", vector: str = "v") -> DataFrame:
    """Labels without -1. nearest: the nearest center's label; singleton: new labels after the largest, in order; drop: one more
    label for all noise, which keeps its rows. Without any cluster nearest becomes singleton."""
    if policy not in ("nearest", "singleton", "drop"):
        raise ValueError("policy is nearest, singleton or drop")
    top = points.agg(F.coalesce(F.max("label"), F.lit(-1)).alias("m")).first()["m"]
    if policy == "drop":
        return points.withColumn("label", F.when(F.col("label") < 0, F.lit(top + 1)).otherwise(F.col("label")))
    if policy == "nearest" and top >= 0:
        near = assigned(points.withColumnRenamed("label", "own"), centroids(points.where("label >= 0")), "label", vector)
        return near.withColumn("label", F.when(F.col("own") < 0, F.col("nearest")).otherwise(F.col("own"))).drop("own", "nearest", "distance2")
    noise = batches(points.where("label < 0"), order, 1).withColumn("label", (F.lit(top + 1) + F.col("batch")).cast("int")).drop("batch")
    return points.where("label >= 0").withColumn("label", F.col("label").cast("int")).unionByName(noise)


def dense_labels(points: DataFrame) -> DataFrame:
    """Labels renumbered 0, 1, ... in their order, a null label last; ranks are counted over the distinct labels alone, in ranges of them."""
    ranks = numbered_within(points.select("label").distinct(), [], "label").select(F.col("label").alias("parley_was"), (F.col("parley_n") - 1).cast("int").alias("parley_dense"))
    return points.join(ranks, F.col("label").eqNullSafe(F.col("parley_was"))).drop("label", "parley_was").withColumnRenamed("parley_dense", "label")


def largest(points: DataFrame) -> DataFrame:
    """One row (label, n): the label with the most points, the lowest of equals."""
    sizes = points.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.max("n").alias("n"))


def fit(points: DataFrame, strategy: str, k: int, *, noise: str = "nearest", key: str = "vec_id", vector: str = "v", seed: int = 42, min_size: int = 12, min_samples: int = 6) -> tuple[DataFrame, dict]:
    """(points with dense labels, report) by kmeans, density or hybrid: density clusters whose largest are split until there are ``k``, or plain
    k-means where density finds fewer than two.

    The report names what was asked for, the clusters and the noise that density found, what was done about noise, the splits, why
    a strategy fell back, and three scores (null with one cluster; the silhouette is that of a sample). Vectors must be there,
    finite and of one width.
    """
    if strategy not in ("kmeans", "density", "hybrid") or noise not in ("nearest", "singleton", "drop"):
        raise ValueError("strategy is kmeans, density or hybrid; noise is nearest, singleton or drop")
    bad = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    seen = points.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
    if not seen["n"] or seen["bad"] or seen["low"] != seen["high"] or seen["low"] < 1:
        raise ValueError("vectors must be there, finite and of one width")
    k = max(1, min(k, seen["n"]))
    report = {"strategy": strategy, "requested_k": k, "noise_policy": noise, "noise": 0, "raw_clusters": None, "splits": 0, "fallback": None}
    if strategy == "kmeans":
        found = kmeans(points, k, seed=seed, vector=vector)
    else:
        raw = stage(density(points, key=key, vector=vector, min_size=min_size, min_samples=min_samples), "raw")
        counted = raw.agg(F.count_if(F.col("label") < 0).alias("noise"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters")).first()
        report |= {"noise": counted["noise"], "raw_clusters": counted["clusters"]}
        report["noise_policy"] = {"nearest": "nearest" if counted["clusters"] else "nearest_with_singleton_fallback", "drop": "drop_bucket"}.get(noise, noise)
        found = with_noise(raw, noise, order=key, vector=vector)
        if strategy == "hybrid":
            found, report["splits"] = split_to(stage(found, "dense"), k, key=key, vector=vector)
            if found.select("label").distinct().limit(2).count() < min(2, k):
                found, report["fallback"] = kmeans(points, k, seed=seed, vector=vector), "density found too few clusters"
    found = dense_labels(stage(found, "fitted"))
    scored = stage(found.select(F.col(key).alias("vec_id"), "label", F.col(vector).alias("v")), "scored")
    report["effective_k"] = scored.select("label").distinct().count()
    if report["raw_clusters"] is None:
        report["raw_clusters"] = report["effective_k"]
    for name, score in (("silhouette", silhouette), ("davies_bouldin", davies_bouldin), ("calinski_harabasz", calinski_harabasz)):
        report[name] = score(scored).first()["score"] if report["effective_k"] > 1 else None
    return found, report


def members(assignments: DataFrame, order: str) -> DataFrame:
    """(cluster_id, position, conversation_id): the conversations of each cluster in their order, a row for each."""
    return numbered_within(assignments, ["cluster_id"], order).select("cluster_id", F.col("parley_n").alias("position"), "conversation_id")


def rolled_up(facets: DataFrame, source: DataFrame, *, min_users: int, min_conversations: int) -> DataFrame:
    """The rollup of facets (conversation_id, cluster_id) with the users of the input; a facet of an unknown conversation is an error."""
    known = joined_or_error(facets, source.select("conversation_id", "user_id"), "conversation_id")
    return rollup(known, min_users=min_users, min_conversations=min_conversations)


def kept_split(points: DataFrame, kept: str = "kept_by_threshold") -> tuple[DataFrame, DataFrame]:
    """(points that are shown as kept, points that are filtered); null counts as filtered."""
    own = F.coalesce(F.col(kept), F.lit(False))
    return points.where(own), points.where(~own)


def visual_points(places: DataFrame, labels: DataFrame, *, order: str, most: int = 1600) -> DataFrame:
    """The first ``most`` points (cluster_id, kept_by_threshold, ...) with the names of ``labels`` (cluster_id, name, kept), of which kept counts where there is one."""
    first = places.orderBy(order).limit(most)
    named = first.join(labels.select("cluster_id", "name", F.col("kept").alias("own")), "cluster_id", "left")
    return named.withColumns({"name": F.coalesce("name", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))), "kept_by_threshold": F.coalesce("own", "kept_by_threshold")}).drop("own")


def rollup(assignments: DataFrame, *, min_users: int, min_conversations: int, ids: str = "conversation_id") -> DataFrame:
    """(cluster_id, size, unique_users, kept_by_threshold): clusters below a threshold are marked, never dropped."""
    out = assignments.groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_distinct("user_id").alias("unique_users"))
    return out.withColumn("kept_by_threshold", (F.col("size") >= min_conversations) & (F.col("unique_users") >= min_users))


def cluster_map(points: DataFrame) -> DataFrame:
    """Mean place, size and concern of each cluster from points (cluster_id, x, y, concerning_score, kept, ord); kept is the first row's."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return points.groupBy("cluster_id").agg(F.count("*").alias("size"), mean("x"), mean("y"), mean("concerning_score"), F.min_by("kept", "ord").alias("kept"))


def map_points(facets: DataFrame, places: DataFrame, assignments: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Facets with x and y and their cluster, joined by key; without an assignment the cluster is -1 and not kept."""
    out = facets.join(places.select(key, "x", "y"), key).join(assignments.select(key, "cluster_id", "kept_by_threshold"), key, "left")
    filled = {"cluster_id": F.coalesce("cluster_id", F.lit(-1)), "kept_by_threshold": F.coalesce("kept_by_threshold", F.lit(False))}
    return out.withColumns(filled)


def preferred_labels(labels: DataFrame, filtered: DataFrame) -> DataFrame:
    """(cluster_id, name, kept): a label from ``filtered`` where there is one; kept if its final_kept or its kept_by_threshold holds."""
    better = filtered.select("cluster_id", F.col("name").alias("better"), "final_kept")
    out = labels.join(better, "cluster_id", "left")
    return out.select("cluster_id", F.coalesce("better", "name").alias("name"), (F.coalesce("final_kept", F.lit(False)) | F.col("kept_by_threshold")).alias("kept"))
