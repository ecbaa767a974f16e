"""Trees of clusters: levels, roots, shares and search. A tree is nodes (node_id, name, size, level) and edges (parent_id, child_id)."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import matches, share
from parley.operators.clustering import dense_labels, kmeans
from parley.operators.conversations import joined_or_error, lead_sample, numbered_within
from parley.sources.store import stage

MOST_LEVELS = 20


#: Why a tree has no more levels.
SINGLE_ROOT, NO_REDUCTION, REACHED = "collapsed_to_single_root", "no_reduction_possible", "reached_requested_levels"


def two_level(leaves: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of leaves (node_id, name, size) under one node for each group of ``groups`` (node_id, label): ``top-000`` and so on
    by the groups' labels in their order. A leaf without a group is an error."""
    ranks = numbered_within(groups.select("label").distinct(), [], "label").select("label", F.format_string("top-%03d", F.col("parley_n") - 1).alias("parent_id"))
    placed = joined_or_error(leaves, groups.join(ranks, "label"), "node_id")
    top = placed.groupBy("parent_id").agg(F.sum("size").alias("size"))
    nodes = leaves.select("node_id", "name", "size", F.lit(0).alias("level")).union(top.select("parent_id", F.concat(F.lit("Group "), "parent_id"), "size", F.lit(1)))
    return nodes, placed.select("parent_id", F.col("node_id").alias("child_id"))


def levels(leaves: DataFrame, *, target_group_size: int = 4, most: int = 10, strict: bool = True, seed: int = 42, label=None) -> tuple[DataFrame, DataFrame, str]:
    """(nodes, edges, why it stopped) over leaves (node_id, name, size, v); a parent's vector is the plain mean of its children's.

    Each level is written to the shared folder before the next is fitted on it. ``label`` makes (node_id, name) from rows (node_id,
    text: the names of the children); a node that it leaves out is called ``Group L<level>-<number>``.
    """
    if target_group_size < 2 or not 2 <= most <= MOST_LEVELS:
        raise ValueError("groups hold two or more, and there are 2 to 20 levels")
    current = stage(leaves.select("node_id", "name", "size", "v"), "level")
    nodes, edges, why = current.select("node_id", "name", "size", F.lit(0).alias("level")), None, REACHED
    for level in range(1, most):
        n = current.count()
        if n <= 1:
            why = SINGLE_ROOT
            break
        k = math.ceil(n / target_group_size)
        if strict and n > 2:
            k = max(2, min(n - 1, k))
        if k >= n:
            why = NO_REDUCTION
            break
        grouped = dense_labels(stage(kmeans(current, k, seed=seed + level, starts=1), "grouped"))
        grouped = stage(grouped.withColumn("parent", F.format_string(f"lvl-{level:02d}-%03d", F.col("label"))), "grouped")
        edge = grouped.select(F.col("parent").alias("parent_id"), F.col("node_id").alias("child_id"))
        edges = edge if edges is None else edges.union(edge)
        up = grouped.groupBy("parent", "label").agg(F.sum("size").alias("size"), Summarizer.mean(array_to_vector("v")).alias("m"))
        up = up.select(F.col("parent").alias("node_id"), F.concat(F.lit(f"Group L{level}-"), F.col("label").cast("string")).alias("given"), "size", vector_to_array("m").alias("v"))
        if label is not None:
            below = lead_sample(grouped.select(F.col("parent").alias("node_id"), F.col("node_id").alias("child"), "name"), "node_id", "child", 12)
            told = below.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), "\n").alias("text"))
            up = up.join(label(told), "node_id", "left")
        else:
            up = up.withColumn("name", F.lit(None).cast("string"))
        current = stage(up.select("node_id", F.coalesce("name", "given").alias("name"), "size", "v"), "level")
        nodes = nodes.union(current.select("node_id", "name", "size", F.lit(level).alias("level")))
    else:
        if current.count() <= 1:
            why = SINGLE_ROOT
    if edges is None:
        edges = leaves.sparkSession.createDataFrame([], "parent_id string, child_id string")
    return nodes, edges, why


def _climbed(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node_id, top, steps, path) of every node of ``own`` (node_id, path) that has a parent: the last node above it, how many steps up, and
    the paths from below ``top`` down to it, joined by ``/``. Steps are doubled, so any depth takes few rounds; a cycle is an error."""
    held = own.join(edges.select(F.col("child_id").alias("node_id"), F.col("parent_id").alias("top")), "node_id").select("node_id", "top", F.lit(1).cast("long").alias("steps"), "path")
    held = stage(held, "climbed")
    most = held.count()
    while True:
        above = held.select(F.col("node_id").alias("top"), F.col("top").alias("beyond"), F.col("steps").alias("more"), F.col("path").alias("upper"))
        held = held.join(above, "top", "left").select(
            "node_id",
            F.coalesce("beyond", "top").alias("top"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.when(F.col("beyond").isNull(), F.col("path")).otherwise(F.concat("upper", F.lit("/"), "path")).alias("path"),
            F.col("beyond").isNotNull().alias("moved"),
        )
        held = stage(held, "climbed")
        seen = held.agg(F.coalesce(F.max("steps"), F.lit(0)).alias("steps"), F.coalesce(F.bool_or("moved"), F.lit(False)).alias("moved")).first()
        if seen["steps"] > most:
            raise ValueError("the edges have a cycle")
        if not seen["moved"]:
            return held.drop("moved")


def roots(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node_id, root_id, steps) of each leaf: the end of its way up the edges, whatever the depth; a node has one parent, a cycle is an error."""
    own = edges.select(F.col("child_id").alias("node_id"), F.lit("").alias("path"))
    found = _climbed(edges, own).select("node_id", "top", F.col("steps").cast("int").alias("steps"))
    return leaves.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("top", "node_id").alias("root_id"), F.coalesce("steps", F.lit(0)).alias("steps"))


def shares(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, parent_id, size, of_parent, of_all): sizes as shares; of_all is against the nodes of the top level."""
    up = nodes.join(edges, nodes.node_id == edges.child_id, "left").select("node_id", "parent_id", "size", "level")
    top = nodes.select(F.max("level").alias("top"))
    total = nodes.join(F.broadcast(top), F.col("level") == F.col("top")).agg(F.sum("size").alias("total"))
    parent = nodes.select(F.col("node_id").alias("p"), F.col("size").alias("parent_size"))
    out = up.join(parent, up.parent_id == parent.p, "left").join(F.broadcast(total), F.lit(True))
    return out.select("node_id", "parent_id", "size", F.round(share(F.col("size"), F.coalesce("parent_size", "total")), 6).alias("of_parent"), F.round(share(F.col("size"), F.col("total")), 6).alias("of_all"))


def flattened(nodes: DataFrame, edges: DataFrame, root: Column) -> DataFrame:
    """Nodes below the roots (a condition), depth first, larger children first: with depth and a path that sorts in that order, at any
    depth. Nodes that no root is above are left out; a cycle is an error."""
    step = F.concat(F.lpad((F.lit(999999999999) - F.col("size")).cast("string"), 12, "0"), F.col("node_id")).alias("path")
    top = nodes.where(root).select("node_id", "size", step)
    inner = edges.join(top.select(F.col("node_id").alias("child_id")), "child_id", "left_anti")  # a root's own parents do not count
    below = _climbed(inner, nodes.select("node_id", step))
    upper = top.select(F.col("node_id").alias("top"), F.col("path").alias("upper"))
    found = below.join(upper, "top").join(nodes.select("node_id", "size"), "node_id")
    found = found.select("node_id", "size", F.col("steps").cast("int").alias("depth"), F.concat("upper", F.lit("/"), "path").alias("path"))
    return top.select("node_id", "size", F.lit(0).alias("depth"), "path").union(found)


def tree_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, level, children): the children's ids in order, comma-joined; empty for a leaf."""
    below = edges.groupBy(F.col("parent_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("child_id")), ",").alias("children"))
    return nodes.join(below, "node_id", "left").select("node_id", "level", F.coalesce("children", F.lit("")).alias("children"))


def search(nodes: DataFrame, query: str) -> DataFrame:
    return nodes.where(matches(query, F.col("name"), F.col("node_id"))).select("node_id", "name", "level")


def top_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The four largest roots; with a single root its six largest children."""
    top = nodes.join(edges, nodes.node_id == edges.child_id, "left_anti")
    first = top.orderBy(F.desc("size"), "node_id").limit(4)
    if first.count() != 1:
        return first
    below = edges.join(F.broadcast(first.select(F.col("node_id").alias("parent_id"))), "parent_id").select(F.col("child_id").alias("node_id"))
    return nodes.join(below, "node_id").select(*nodes.columns).orderBy(F.desc("size"), "node_id").limit(6)
