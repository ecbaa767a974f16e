"""Splitting the largest cluster in two, again and again, many splits to one pass over the points.

The driver holds a heap of cluster sizes. It plays the splits in their order as far as their outcomes are known; for the cluster that it stops
at, and the largest others that may come next, one pass makes the outcomes in Spark. An outcome depends on a cluster's points
alone, so what is made ahead of its turn is right when its turn comes.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.vectors import MOST_CLUSTERS, squared
from parley.sources.store import stage

#: Rounds of 2-means, at most.
ROUNDS = 25


def halves(points: DataFrame, key: str, vector: str) -> DataFrame:
    """``points`` with side 0 or 1 in their cluster (column parley_c): 2-means from the point farthest from the mean, the larger key of equals, and
    the point farthest from that. A cluster whose points are all equal has side 0 alone. There are MOST_CLUSTERS clusters at most."""
    farthest = lambda d, c: F.max_by(c, F.struct(d.alias("d"), key)).alias("v")
    with_center = lambda c: points.join(F.broadcast(c), "parley_c")
    means = points.groupBy("parley_c").agg(vector_to_array(Summarizer.mean(array_to_vector(vector))).alias("m"))
    one = with_center(means).groupBy("parley_c").agg(farthest(squared(F.col(vector), F.col("m")), vector).alias("a"))
    two = with_center(one).groupBy("parley_c").agg(F.first("a").alias("a"), farthest(squared(F.col(vector), F.col("a")), vector).alias("b"))
    rows = two.limit(MOST_CLUSTERS + 1).collect()
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters to split")
    spark = points.sparkSession

    def sided(rows: list) -> DataFrame:
        centers = spark.createDataFrame(rows, "parley_c long, parley_a array<double>, parley_b array<double>")
        near = squared(F.col(vector), F.col("parley_a")) > squared(F.col(vector), F.col("parley_b"))
        return points.join(F.broadcast(centers), "parley_c").withColumn("side", near.cast("int"))

    rows = [(r["parley_c"], r["a"], r["b"]) for r in rows]
    for _ in range(ROUNDS):
        found = sided(rows).groupBy("parley_c", "side").agg(vector_to_array(Summarizer.mean(array_to_vector(vector))).alias("m")).collect()
        new = {(r["parley_c"], r["side"]): r["m"] for r in found}
        moved = [(c, new.get((c, 0), a), new.get((c, 1), b)) for c, a, b in rows]
        if moved == rows:
            break
        rows = moved
    return sided(rows).drop("parley_a", "parley_b")


def split_to(points: DataFrame, k: int, *, key: str = "vec_id", vector: str = "v") -> tuple[DataFrame, int]:
    """(``points`` with label anew, number of splits): the largest cluster, the lowest label of equals, is halved until there are ``k``.

    The second half gets the next label. It ends early when the largest cluster is a single point or cannot be halved.
    """
    sizes = [(r["label"], r["n"]) for r in points.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_CLUSTERS + 1).collect()]
    if len(sizes) >= k:
        return points, 0
    if k > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    sizes = sorted(sizes)
    held = points.join(F.broadcast(points.sparkSession.createDataFrame([(n, i) for i, (n, _) in enumerate(sizes)], "label int, parley_c long")), "label")
    outcome: dict[int, tuple | None] = {}  # of a cluster: its two halves (number, points), or none
    below: dict[int, list[int]] = {}
    number = len(sizes)
    while True:
        heap = [(-n, label, i) for i, (label, n) in enumerate(sizes)]
        heapify(heap)
        top, splits = max(label for label, _ in sizes), 0
        while len(heap) < k and -heap[0][0] >= 2 and heap[0][2] in outcome:
            _, label, i = heap[0]
            if outcome[i] is None:
                break
            heappop(heap)
            (a, m), (b, n) = outcome[i]
            top, splits = top + 1, splits + 1
            heappush(heap, (-m, label, a))
            heappush(heap, (-n, top, b))
        if len(heap) >= k or -heap[0][0] < 2 or heap[0][2] in outcome:
            break
        todo = [x for x in sorted(heap) if -x[0] >= 2 and x[2] not in outcome][: k - len(heap)]
        ids = {i: (number + 2 * j, number + 2 * j + 1) for j, (_, _, i) in enumerate(todo)}
        number += 2 * len(todo)
        names = points.sparkSession.createDataFrame([(i, *ab) for i, ab in ids.items()], "parley_c long, parley_0 long, parley_1 long")
        going = held.join(F.broadcast(names), "parley_c", "left_semi")
        parts = halves(going, key, vector).select(F.col(key).alias("parley_key"), F.col("side").alias("parley_side"))
        new = held.join(F.broadcast(names), "parley_c", "left").join(parts, F.col(key) == F.col("parley_key"), "left")
        new = new.withColumn("parley_c", F.coalesce(F.when(F.col("parley_side") == 0, F.col("parley_0")).when(F.col("parley_side") == 1, F.col("parley_1")), "parley_c"))
        held = stage(new.drop("parley_0", "parley_1", "parley_key", "parley_side"), "halves")
        found = {r["parley_c"]: r["n"] for r in held.groupBy("parley_c").agg(F.count("*").alias("n")).collect()}
        for i, (a, b) in ids.items():
            below[i] = [x for x in (a, b) if x in found]
            outcome[i] = ((a, found[a]), (b, found[b])) if len(below[i]) == 2 else None
    own = {}
    for _, label, i in heap:  # halves that were made ahead and not called for are parts of their cluster
        todo = [i]
        while todo:
            own[x := todo.pop()] = label
            todo += below.get(x, [])
    table = points.sparkSession.createDataFrame([*own.items()], "parley_c long, parley_l int")
    return held.drop("label").join(F.broadcast(table), "parley_c").withColumnRenamed("parley_l", "label").drop("parley_c").select(*points.columns), splits
