"""What a dashboard shows of a run: points of the map, the tree, privacy stages and evaluation, in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.hierarchy import shares


def payload(points: DataFrame, nodes: DataFrame, edges: DataFrame, audits: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(part, name, value) of a run's parts; a part without rows is left out.

    map: points, and those kept and filtered, of ``points`` (kept_by_threshold). hierarchy: leaves, levels and roots of a tree.
    privacy: the pass rate of each stage of ``audits`` (stage, total, passed). evaluation: the accuracy of each representation.
    """
    kept = F.coalesce(F.col("kept_by_threshold"), F.lit(False))
    shown = points.agg(F.count("*").alias("points"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("filtered"))
    top = nodes.join(edges, nodes.node_id == edges.child_id, "left_anti").agg(F.count("*").alias("roots"))
    tree = nodes.agg(F.count_if(F.col("level") == 0).alias("leaves"), (F.max("level") + 1).alias("levels")).join(F.broadcast(top), F.lit(True))

    def rows(df: DataFrame, part: str) -> DataFrame:
        """One row of numbers as rows of names and values."""
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns])
        return df.select(F.lit(part).alias("part"), F.explode(pairs).alias("x")).select("part", "x.name", "x.value")

    given = points.limit(1).select(F.lit(True).alias("there"))
    parts = [
        rows(shown, "map").join(F.broadcast(given), F.lit(True), "left_semi"),
        rows(tree, "hierarchy").where("value is not null").join(F.broadcast(nodes.limit(1).select(F.lit(True).alias("there"))), F.lit(True), "left_semi"),
        audits.select(F.lit("privacy").alias("part"), F.col("stage").alias("name"), F.round(F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)), 6).alias("value")),
        evaluation.select(F.lit("evaluation").alias("part"), F.col("representation").alias("name"), F.col("accuracy").cast("double").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Columns of a row of ``sections``; what a section does not have is null.
SECTION = {"section": "string", "id": "string", "parent": "string", "name": "string", "x": "double", "y": "double", "size": "long", "level": "int", "kept": "boolean", "value": "double", "histogram": "string"}


def sections(points: DataFrame, labels: DataFrame, nodes: DataFrame, edges: DataFrame, audits: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Everything that a dashboard draws of a run, a row for each thing, told apart by section; no section needs all rows in one place.

    point: each of ``points`` (id, x, y, cluster_id, kept_by_threshold) with the name of its cluster and the kept of ``labels``
    (cluster_id, name, kept) where it has one. cluster: their number and mean place; kept if any point is. node: a tree's nodes
    with their parent, and their share of it (of all on the top level) as value. root: nodes without a parent. stage:
    of ``audits`` (stage, rating) how many there are, the share rated 3 or better, and how many have each rating, as
    ``rating:n`` in order. ablation: the accuracy of each representation of ``evaluation``.
    """

    def rows(df: DataFrame, section: str, **columns: Column) -> DataFrame:
        own = {"section": F.lit(section)} | columns
        return df.select(*[own.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in SECTION.items()])

    named = points.join(labels.select("cluster_id", "name", F.col("kept").alias("own")), "cluster_id", "left")
    named = named.select("id", "x", "y", "cluster_id", F.coalesce("name", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).alias("name"), F.coalesce("own", "kept_by_threshold", F.lit(False)).alias("kept"))
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    clusters = named.groupBy("cluster_id", "name").agg(F.count("*").alias("size"), mean("x"), mean("y"), F.bool_or("kept").alias("kept"))
    tree = shares(nodes, edges).select("node_id", "parent_id", "of_parent").join(nodes, "node_id")
    rated = audits.groupBy("stage", "rating").agg(F.count("*").alias("n"))
    counted = F.array_sort(F.collect_list(F.struct("rating", "n")))
    stages = rated.groupBy("stage").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("rating") >= 3, F.col("n")).otherwise(0)).alias("passed"), counted.alias("h"))
    histogram = F.array_join(F.transform("h", lambda x: F.concat(x["rating"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")
    col = F.col
    parts = [
        rows(named, "point", id=col("id"), parent=col("cluster_id"), name=col("name"), x=col("x"), y=col("y"), kept=col("kept")),
        rows(clusters, "cluster", id=col("cluster_id"), name=col("name"), x=col("x"), y=col("y"), size=col("size"), kept=col("kept")),
        rows(tree, "node", id=col("node_id"), parent=col("parent_id"), name=col("name"), size=col("size"), level=col("level"), value=col("of_parent")),
        rows(tree.where("parent_id is null"), "root", id=col("node_id"), name=col("name"), size=col("size"), level=col("level")),
        rows(stages, "stage", id=col("stage"), size=col("total"), value=F.round(col("passed") / col("total"), 6), histogram=histogram),
        rows(evaluation, "ablation", id=col("representation"), value=col("accuracy")),
    ]
    return reduce(DataFrame.unionByName, parts)
