"""Language identification by multilingual mixture inference.

Each language has a model of byte n-grams, learnt from labelled texts. A document is a mixture: every word was drawn from one of
the languages, with unknown proportions. Expectation-maximisation estimates the proportions from the words' n-gram
likelihoods; this is done for nested sets of languages (the most likely one, the two with the largest proportions, ... up to all
that have a proportion of ``LEAST`` or more), and the set with the largest likelihood less a penalty for each language is selected.

The models are fitted on a bounded sample: about ``sample`` documents of each language, taken by a hash of id and text. All
documents are predicted from their whole text; the words of very long ones are gone through in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import byte_table, crc_of_id, LOWERED, mixed, slices, small_batches, spans

#: Bytes of words: ASCII letters and all beyond ASCII.
LETTERS = byte_table((65, 90), (97, 122), (128, 255))
N, BUCKETS = 4, 1 << 15
MOST_LANGS = 1000
#: Proportion from which on a language may be in the selected set.
LEAST = 0.01
#: Numbers of a table of words or n-grams by language that a task holds at once.
PART_NUMBERS = 1 << 22


def _lower(texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(texts)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, where each word's n-grams begin, and where each row's words begin.

    A word is padded by a blank on either side; its n-grams are those that end in one of its bytes or in the blank behind it.
    """
    starts, ends, rows = spans(data, offsets, LETTERS)
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    place = np.arange(total) - np.repeat(first - starts, sizes)
    inside = np.arange(total) - np.repeat(first, sizes)
    padded = np.append(LOWERED[data], np.uint8(32)).astype(np.uint64)
    code = np.where(inside < np.repeat(sizes - 1, sizes), padded[place], np.uint64(32))
    key, seen = code.copy(), code
    for back in range(1, N):
        seen = np.concatenate([np.full(1, 32, np.uint64), seen[:-1]]) if total else seen
        key |= np.where(inside >= back, seen, np.uint64(32)) << np.uint64(8 * back)
    return (mixed(key) & np.uint64(BUCKETS - 1)).astype(np.int64), np.append(first, total), rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for start, end, data, offsets in slices(_lower(batch.column("text"))):
            found, first, rows = grams(data, offsets)
            cuts = first[rows]
            for i in range(end - start):
                sums.setdefault(langs[start + i], np.zeros(BUCKETS, np.int64))[:] += np.bincount(found[cuts[i] : cuts[i + 1]], minlength=BUCKETS)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(counts[at])], names=["lang", "bucket", "n"])


def fit(taught: DataFrame, sample: int = 1500) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of the n-gram buckets [bucket, language], from the columns doc_id, text, lang.

    Rows that agree in id, text and language count once.
    """
    keyed = taught.withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("rows"))
    if sizes.limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    picked = keyed.join(F.broadcast(sizes), "lang").where(F.pmod("h", F.col("rows")) < sample).dropDuplicates(["lang", "h"])
    counts = picked.select("lang", "text").mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toPandas()  # at most BUCKETS rows for each language
    langs = sorted(table["lang"].unique())
    seen = np.zeros((BUCKETS, len(langs)))
    seen[table["bucket"].to_numpy(int), [langs.index(x) for x in table["lang"]]] = table["n"]
    return langs, np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)


def _summed(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of rows of ``values`` between neighbouring cuts."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[cuts[1:]] - sums[cuts[:-1]]


class Words:
    """Log likelihoods of words [word, language], from the buckets of their n-grams; made in parts where they are many."""

    def __init__(self, table: np.ndarray, found: np.ndarray, first: np.ndarray) -> None:
        self.table, self.found, self.first = table, found, first
        step = max(1, PART_NUMBERS // max(1, table.shape[1]))
        cuts = [0]
        while cuts[-1] < len(first) - 1:  # as many words as have ``step`` n-grams, or one
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + step, "right")) - 1))
        self.cuts = cuts
        self.held = [self._part(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if (len(first) - 1) * table.shape[1] <= PART_NUMBERS else None

    def _part(self, a: int, b: int) -> tuple[int, int, np.ndarray]:
        first = self.first[a : b + 1]
        return a, b, np.add.reduceat(self.table[self.found[first[0] : first[-1]]], first[:-1] - first[0], axis=0)

    def parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, end, likelihoods)."""
        if self.held is not None:
            yield from self.held
        else:
            for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
                yield self._part(a, b)


def alone(words: Words, rows: np.ndarray, width: int) -> np.ndarray:
    """Log likelihood of each row by each single language."""
    out = np.zeros((len(rows) - 1, width))
    for a, b, part in words.parts():
        out += _summed(part.astype(float), np.clip(rows - a, 0, b - a))
    return out


def mixture(words: Words, rows: np.ndarray, allowed: np.ndarray, active: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the ``allowed`` languages [row, language] and log likelihood of each ``active`` row; other rows keep what they are given."""
    counts = np.diff(rows)
    of = np.repeat(np.arange(len(counts)), counts)
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for a, b, part in words.parts():
            mine = active[of[a:b]]
            part = part[mine]
            top = part.max(axis=1, keepdims=True) if len(part) else part[:, :1]
            yield np.exp(part - top), top[:, 0], of[a:b][mine], np.concatenate([[0], np.cumsum(mine)])[np.clip(rows - a, 0, b - a)]

    held = list(parts()) if words.held is not None else None
    for _ in range(rounds):
        sums = np.zeros_like(share)
        for odds, _, at, cuts in held if held is not None else parts():
            joint = odds * share[at]
            joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
            sums += _summed(joint, cuts)
        share = np.where((active & (counts > 0))[:, None], sums / np.maximum(counts, 1)[:, None], share)
    total = np.zeros(len(counts))
    for odds, top, at, cuts in held if held is not None else parts():
        total += _summed(np.log(np.maximum((odds * share[at]).sum(axis=1), 1e-300)) + top, cuts)
    return share, total


def infer(words: Words, rows: np.ndarray, width: int, *, rounds: int = 12, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [row, language] of the selected set of languages, and the proportions over all languages."""
    n = len(rows) - 1
    full, _ = mixture(words, rows, np.ones((n, width)), np.ones(n, bool), rounds)
    single = alone(words, rows, width)
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.zeros((n, width))
    best[np.arange(n), single.argmax(axis=1)] = 1
    cost = penalty * np.log(np.maximum(np.diff(rows), 1) + 1)
    worth = single.max(axis=1) - cost
    most = np.where(np.diff(rows) > 0, (full >= LEAST).sum(axis=1), 0)
    for k in range(2, int(most.max(initial=0)) + 1):
        active = most >= k
        allowed = np.zeros((n, width))
        np.put_along_axis(allowed, order[:, :k], 1, axis=1)
        share, likelihood = mixture(words, rows, allowed, active, rounds)
        better = active & (likelihood - k * cost > worth)
        best[better], worth = share[better], np.where(better, likelihood - k * cost, worth)
    return best, full


def languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 1500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs) for every row of ``docs``.

    Learns from rows with text and lang whose crc32(id as text) mod 5 is not 0 (the rest are held_out). lang_pred is the
    language with the largest proportion of the selected set, ``und`` (score 0) for a null text, a text without letters, or
    where nothing could be learnt; score is that proportion; langs lists the selected set, the largest first, comma-joined.
    Ids may be null or repeat; a null id counts as the empty text. Texts of any length are judged whole. Other columns are not
    read and may have any name. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    names, table = fit(docs.where("text is not null and lang is not null").where(crc_of_id(F.col("doc_id")) % 5 != 0), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in slices(_lower(batch.column("text"))):
                found, first, rows = grams(data, offsets)
                best, _ = infer(Words(table, found, first), rows, len(names))
                order = np.argsort(-best, axis=1, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.array([names[x] for x in order[:, 0]]),
                        pa.array(np.clip(best.max(axis=1), 0, 1)),
                        pa.array([",".join(names[x] for x in row if best[i, x] > 0) for i, row in enumerate(order)]),
                        batch.column("known").slice(start, end - start),
                    ],
                    names=["doc_id", "lang_pred", "score", "langs", "known"],
                )

    held = (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out")
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not names:
        return docs.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit("").alias("langs"))
    found = small_batches(docs.select("doc_id", "text", known.alias("known"))).mapInArrow(run, "doc_id long, lang_pred string, score double, langs string, known boolean")
    return found.select(
        "doc_id",
        held,
        F.when(F.col("known"), F.col("lang_pred")).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(F.col("known"), F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        F.when(F.col("known"), F.col("langs")).otherwise(F.lit("")).alias("langs"),
    )
