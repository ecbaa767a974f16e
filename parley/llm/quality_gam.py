"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone are cut into bins; cyclic boosting visits one feature after another with a small step and a shallow
tree on that feature's bins, so each feature ends up as a lookup table; then the pairs with the largest gain on the residuals
are boosted in the same way over two-dimensional tables. A score is the sum of looked-up values through the logistic function.

The model is fitted on at most ``sample`` labelled rows, taken by the order of a hash of their id, in numpy on the driver (with
the defaults 20,000 rows of 16 numbers); features and scores of all rows are made in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import crc_of_id, slices, small_batches
from parley.llm.profile import CLASSES, COMMON, common_counts, kept_columns, profile, VOCABULARY


SHARES = ("lower", "upper", "digit", "space", "stop", "mark", "beyond")
#: Features of a text, in the order of their columns; 0 where a count divides by nothing.
FEATURES = ("log_words", "word_length", "symbols", "bars", "dup_lines", "repeats", "distinct", "log_line", "common", *SHARES)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of every row of texts."""
    p = profile(data, offsets)
    share = lambda a, b: a / np.where(b > 0, b, 1) * (b > 0)
    words, chars, lines = p["n_words"], p["n_chars"], p["n_lines"]
    common = common_counts(data, offsets, [VOCABULARY], np.zeros(len(offsets) - 1, int), len(COMMON))
    columns = [np.log1p(words), share(p["word_chars"], words), share(p["n_symbols"], chars), share(p["n_bars"], chars), share(p["n_dup_lines"], lines), share(p["n_repeat_words"], words)]
    columns += [share(p["n_distinct_words"], words), np.log1p(share(words, lines)), 1 - share(common[:, -1], common.sum(axis=1))]
    return np.stack(columns + [share(p["chars"][:, CLASSES.index(k)], chars) for k in SHARES], axis=1).astype(float)


@dataclass
class Additive:
    """Cuts and tables: score = sigmoid(base + sum of tables[f][bin of f] + sum of pair tables)."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cut, x[:, f])]
        for (f, g), table in self.pairs.items():
            out += table[np.searchsorted(self.coarse[f], x[:, f]), np.searchsorted(self.coarse[g], x[:, g])]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values of the bins by a tree of at most ``leaves`` leaves over ordered bins; g, h: gradient and curvature of each bin."""
    parts = [(0, len(g))]
    g_sum, h_sum = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h))
    worth = lambda a, b: (g_sum[b] - g_sum[a]) ** 2 / (h_sum[b] - h_sum[a] + 1.0)
    while len(parts) < leaves:
        best = max(((worth(a, k) + worth(k, b) - worth(a, b), i, k) for i, (a, b) in enumerate(parts) for k in range(a + 1, b)), default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g_sum[b] - g_sum[a], h_sum[b] - h_sum[a])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a two-dimensional table: the gain, and the table of the four leaves' values."""
    corner = lambda v: np.pad(np.cumsum(np.cumsum(v, 0), 1), ((1, 0), (1, 0)))
    gs, hs = corner(g), corner(h)
    a, b = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not a.size or not b.size:
        return 0.0, np.zeros_like(g)

    def four(s: np.ndarray) -> list[np.ndarray]:
        return [s[a, b], s[a, -1] - s[a, b], s[-1, b] - s[a, b], s[-1, -1] - s[a, -1] - s[-1, b] + s[a, b]]

    gains = sum(x**2 / (y + 1.0) for x, y in zip(four(gs), four(hs), strict=True))
    at, out = np.unravel_index(int(gains.argmax()), gains.shape), np.zeros_like(g)
    for rows, columns in ((slice(0, at[0] + 1), slice(0, at[1] + 1)), (slice(0, at[0] + 1), slice(at[1] + 1, None)), (slice(at[0] + 1, None), slice(0, at[1] + 1)), (slice(at[0] + 1, None), slice(at[1] + 1, None))):
        out[rows, columns] = _leaf(g[rows, columns].sum(), h[rows, columns].sum())
    return float(gains.max() - gs[-1, -1] ** 2 / (hs[-1, -1] + 1.0)), out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, coarse: int = 8, rounds: int = 150, step: float = 0.1, leaves: int = 3, n_pairs: int = 6, pair_rounds: int = 40) -> Additive:
    """Fit by cyclic boosting. Without rows, or with rows of one label, the model gives about that label's share."""
    n, width = x.shape
    rate = (y.sum() + 1.0) / (n + 2.0)
    model = Additive(base=float(np.log(rate / (1 - rate))))
    quantiles = lambda k: [np.unique(np.quantile(x[:, f], np.arange(1, k) / k)) if n else np.zeros(0) for f in range(width)]
    model.cuts, model.coarse = quantiles(bins), quantiles(coarse)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not n or y.min() == y.max():
        return model
    place = [np.searchsorted(c, x[:, f]) for f, c in enumerate(model.cuts)]
    total = np.full(n, model.base)
    for _ in range(rounds):
        for f in range(width):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[f])
            delta = step * _tree(np.bincount(place[f], y - p, size), np.bincount(place[f], p * (1 - p), size), leaves)
            model.tables[f] += delta
            total += delta[place[f]]
    rough = [np.searchsorted(c, x[:, f]) for f, c in enumerate(model.coarse)]

    def grids(f: int, g: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)
        at = rough[f] * shape[1] + rough[g]
        return np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape), at

    p = 1 / (1 + np.exp(-total))
    gains = sorted(((_quadrants(*grids(f, g, p)[:2])[0], f, g) for f, g in combinations(range(width), 2)), reverse=True)
    chosen = [(f, g) for gain, f, g in gains[:n_pairs] if gain > 1e-9]
    model.pairs = {(f, g): np.zeros((len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)) for f, g in chosen}
    for _ in range(pair_rounds):
        for f, g in chosen:
            p = 1 / (1 + np.exp(-total))
            gradient, curvature, at = grids(f, g, p)
            delta = step * _quadrants(gradient, curvature)[1]
            model.pairs[f, g] += delta
            total += delta.ravel()[at]
    return model


def taught_model(texts: DataFrame, labels: DataFrame, sample: int) -> Additive:
    """The model fitted on labelled rows of ``texts`` (doc_id, text), of ``sample`` ids at most; only their texts are looked at. Of rows
    that repeat an id that with the smallest hash of its text counts."""
    taught = labels.where("doc_id is not null and y is not null").where(crc_of_id(F.col("doc_id")) % 3 != 1).groupBy("doc_id").agg(F.max("y").alias("y"))
    # At most ``sample`` pairs of numbers: a broadcast of known size.
    taught = F.broadcast(taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in slices(batch.column("text")):
                x = features(data, offsets)
                places = pa.array(np.arange(end - start + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, end - start) for k in ("doc_id", "y", "h")), pa.ListArray.from_arrays(places, pa.array(x.ravel()))], names=["doc_id", "y", "h", "x"])

    rows = small_batches(texts.withColumn("h", F.xxhash64("text")).join(taught, "doc_id").select("doc_id", "y", "h", "text")).mapInArrow(run, "doc_id long, y int, h long, x array<double>")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("x", "h").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    return fit(np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; score is the likelihood of label 1.

    Labels are learnt only from ids whose crc32(id as text) mod 3 is not 1; those with remainder 1 are held_out. Of several
    labels of an id the largest counts; null ids and labels are left out. Null and empty texts are scored like any other, by
    features that are all 0; very long ones are read whole. Ids may be null or repeat; a null id counts as the empty text. With no labels at all the score is
    0.5. With ``keep``, the result is these columns of the rows with a score of 0.5 or more. Other columns are not read and may
    have any name. An empty table gives an empty result.
    """
    there, back = kept_columns(docs, keep)
    carried = [f"keep_{i}" for i in range(len(keep))]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *there)
    model = taught_model(texts.select("doc_id", "text"), labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")), sample)
    names = ["doc_id", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, end - start) for k in names), pa.array(model.scores(features(data, offsets)))], names=[*names, "score"])

    schema = T.StructType([T.StructField(k, texts.schema[k].dataType) for k in names]).add("score", T.DoubleType())
    scored = small_batches(texts.select(*names, "text")).mapInArrow(run, schema)
    if keep:
        return scored.where("score >= 0.5").select(*back)
    return scored.select("doc_id", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
