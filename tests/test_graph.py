"""Components of graphs whose paths are long."""

import random

from parley.operators.graph import components


def test_components_of_a_long_path_without_an_order(spark):
    path = list(range(1000))
    random.Random(3).shuffle(path)
    edges = [*zip(path, path[1:], strict=False), *((i, i + 1) for i in range(3000, 3600)), (2000, 2000), (2001, 2001), (None, 5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == dict.fromkeys(range(1000), 0) | dict.fromkeys(range(3000, 3601), 3000) | {2000: 2000, 2001: 2001}
