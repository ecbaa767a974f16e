"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.store import stage

#: Rounds after which a graph that still changes is an error rather than a wrong answer.
MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b: long); the component is its smallest node.

    In each round every component points to the smallest one that it has an edge to, and where pointers end is one component; only
    the two smallest of these can point to each other. All that have an edge merge, so those left at least halve in each round, however long the
    paths are, and edges within a component are dropped. Labels and edges are written to the shared folder; hubs meet in joins
    that Spark splits and in sums made before the shuffle. Self-loops make a node known. Null ends are left out.
    """
    edges = edges.where("a is not null and b is not null")
    links = stage(_links(edges), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stage(nodes.select("node", F.col("node").alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        if not links.limit(1).count():
            return labels
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a"))
        merged = roots(both.groupBy("node").agg(F.min("to").alias("to")))
        of = lambda p: merged.select(F.col("node").alias(p), F.col("component").alias(f"to_{p}"))  # noqa: B023, E731
        labels = labels.join(of("component"), "component", "left").select("node", F.coalesce("to_component", "component").alias("component"))
        labels = stage(labels, "labels")
        links = stage(_links(links.join(of("a"), "a").join(of("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "edges")
    raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")


def _links(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(pointers: DataFrame) -> DataFrame:
    """(node, component) of pointers (node, to): where following them ends; two nodes that point to each other end at the smaller.

    Every node has one pointer, and there are no other cycles. Pointers are doubled, so rounds grow as the logarithm of the chains.
    """
    back = pointers.select(F.col("node").alias("to"), F.col("to").alias("back"))
    held = pointers.join(back, "to", "left").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to"))
    held = stage(held, "pointers")
    for _ in range(MAX_ROUNDS):
        on = held.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        new = stage(held.join(on, "to").select("node", F.col("beyond").alias("to"), (F.col("beyond") != F.col("to")).alias("moved")), "pointers")
        held = new.select("node", "to")
        if not new.where("moved").limit(1).count():
            return held.select("node", F.col("to").alias("component"))
    raise RuntimeError(f"pointers still move after {MAX_ROUNDS} rounds")
