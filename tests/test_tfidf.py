"""Word frequencies read the texts no more often than they must."""

import numpy as np
from pyspark.sql import functions as F

from parley.operators import evaluate


def test_texts_are_read_twice_and_words_are_runs(spark):
    texts = ["a cat, the cat", "the do_g's x", "", None, "Élan élan naïve 12", "cat the"]
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    rows = spark.createDataFrame([*enumerate(texts)], "id long, t string").coalesce(1)
    got = {r.id: r.v.toArray() for r in evaluate.tfidf(rows.mapInPandas(seen, "id long, t string"), "id", "t").collect()}
    assert read.value == 2 * len(texts)
    words = [["cat", "the", "cat"], ["the", "do_g"], [], [], ["élan", "élan", "naïve", "12"], ["cat", "the"]]
    for i, own in enumerate(words):
        n = {w: own.count(w) * np.log(7 / (1 + sum(w in x for x in words))) for w in own}
        want = sorted(x / np.sqrt(sum(y * y for y in n.values())) for x in n.values())
        assert np.allclose(sorted(got[i][got[i] != 0]), want)
    assert rows.where(F.col("t").rlike(evaluate.WORD)).count() == 4
