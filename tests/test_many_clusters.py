"""Scores of more clusters than the driver holds."""

from parley.operators import vectors


def test_davies_bouldin_beyond_the_most_clusters(spark, monkeypatch):
    points = spark.createDataFrame([(i, i % 3, [float(9 * (i % 3) ** 2), float(i)]) for i in range(12)], "vec_id long, label int, v array<double>")
    few = vectors.davies_bouldin(points).first().score
    monkeypatch.setattr(vectors, "MOST_CLUSTERS", 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    many = vectors.davies_bouldin(points).first().score
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert few is not None and many == few
