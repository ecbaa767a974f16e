"""Quality rules: how far a document's characters and common words diverge from those of its language.

The common words of a language are the ``n_common`` words that most of its texts hold. The reference of a language is the sum of
the histograms of its documents that pass the base rules. A document is compared by Jensen-Shannon distance (base 2, so 0 to
1). Languages of fewer than ``min_documents`` documents, and those beyond the ``most_languages`` largest, are taken together as
one. Guards: texts shorter than ``min_words`` words are not compared.

Most words of any text are not common ones, so even a text without a common word is at a word distance well below 1. The limit of
word distances is therefore the upper fence of the distances that the documents of the language have themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import _BYTES as BYTE_POWERS
from parley.llm.common import LOWERED, mixed, slices, small_batches, span_hashes, spans, stage, WORDLIKE
from parley.llm.profile import CLASSES, kept_columns, profiles


def shares(counts: np.ndarray) -> np.ndarray:
    """Rows of counts as shares of their sum; zeros where that is zero."""
    total = counts.sum(axis=1, keepdims=True)
    return counts / np.where(total > 0, total, 1)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of the rows of two matrices of shares."""
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)
    return np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))


#: Documents that a fence needs, and the least that it stands above the upper quartile.
FENCE_ROWS, FENCE_MARGIN = 30, 0.05
KEPT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _distances(names: list[str], references: dict[str, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.array(batch.column("group").to_pylist(), object)
            found = np.zeros((2, batch.num_rows))
            for at, k in enumerate(("chars", "common")):
                own = shares(batch.column(k).flatten().to_numpy().reshape(batch.num_rows, -1))
                for g in set(groups.tolist()):
                    if g in references:
                        found[at, groups == g] = jensen_shannon(own[groups == g], references[g][at][None])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *(pa.array(x) for x in found)], names=[*names, "char_distance", "word_distance"])

    return run


def _grouped(docs: DataFrame, min_documents: int, most_languages: int) -> DataFrame:
    """``docs`` with group: ``=`` and the language, or nothing for the languages that are taken together."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_documents)
    own = sizes.orderBy(F.desc("rows"), "lang").limit(most_languages).select("lang", F.concat(F.lit("="), "lang").alias("own"))
    return docs.join(F.broadcast(own), "lang", "left").withColumn("group", F.coalesce("own", F.lit(""))).drop("own")


#: Words that a task counts at once; beyond that it gives on the rarer half of them, as frequent words are met again.
HELD_WORDS = 60_000


def _held_by_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, word, n): how many texts (group, text) hold a word, summed over what a task has seen since it last gave counts on."""
    held: dict[tuple[str, bytes], int] = {}

    def given(rest: int) -> pa.RecordBatch:
        gone = sorted(held, key=held.get)[: len(held) - rest]
        columns = [pa.array([g for g, _ in gone]), pa.array([w.decode() for _, w in gone]), pa.array([held.pop(k) for k in gone], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["group", "word", "n"])

    for batch in batches:
        groups = np.array(batch.column("group").to_pylist(), object)
        for start, end, data, offsets in slices(batch.column("text")):
            text = LOWERED[data]
            starts, ends, rows = spans(text, offsets, WORDLIKE)
            words = span_hashes(text.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_POWERS)
            row = np.repeat(np.arange(end - start), np.diff(rows))
            _, once = np.unique(mixed(words + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
            of, raw = groups[start:end][row[once]], text.tobytes()
            for g in set(of.tolist()):
                mine = once[of == g]
                _, at, counts = np.unique(words[mine], return_index=True, return_counts=True)
                for k, n in zip(mine[at].tolist(), counts.tolist(), strict=True):
                    key = g, raw[starts[k] : ends[k]]
                    held[key] = held.get(key, 0) + n
            if len(held) > HELD_WORDS:
                yield given(HELD_WORDS // 2)
    if held:
        yield given(0)


def common_words(docs: DataFrame, n: int) -> dict[str, list[str]]:
    """The ``n`` words that most texts (group, text) of each group hold, of equals the first by their letters."""
    counts = small_batches(docs.select("group", "text")).mapInArrow(_held_by_texts, "group string, word string, n long").groupBy("group", "word").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= n)
    found: dict[str, list[str]] = {r["group"]: [] for r in docs.select("group").distinct().collect()}  # most_languages and one, at most
    for r in sorted(ranked.select("group", "rank", "word").collect(), key=lambda r: r["rank"]):
        found[r["group"]].append(r["word"])
    return found


def _fences(usual: DataFrame, width: float) -> DataFrame:
    """(group, fence) from rows (group, d): the upper quartile and ``width`` times the distance of the quartiles; d has four digits, so
    what is sorted is at most 10,001 counts of a group."""
    counts = usual.groupBy("group", "d").agg(F.count("*").alias("n"))
    w = Window.partitionBy("group")
    ranked = counts.withColumns({"upto": F.sum("n").over(w.orderBy("d")), "all": F.sum("n").over(w)}).where(F.col("all") >= FENCE_ROWS)
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("d")))
    q1, q3 = quartile(0.25), quartile(0.75)
    return ranked.groupBy("group").agg((q3 + F.greatest(F.lit(FENCE_MARGIN), width * (q3 - q1))).alias("fence"))


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_chars: float = 0.25,
    max_words: float = 0.75,
    word_fence: float | None = 1.5,
    min_words: int = 40,
    n_common: int = 100,
    min_documents: int = 30,
    most_languages: int = 1000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance; a row for each
    row. With ``keep``, these columns of the rows that are kept.

    base_failed: fewer than 10 words, or more than a fifth of the words in 5-word windows that the text repeats. kept is false
    for those, and for texts of ``min_words`` words or more with a distance above ``max_chars`` or ``max_words``, or with a word
    distance, to four digits, beyond the upper quartile of its language by more than ``word_fence`` times the distance of the
    quartiles (FENCE_MARGIN at least). Quartiles are counted over all texts of the language that pass the other rules; below
    FENCE_ROWS of them, and with ``word_fence`` None, there is no fence. Up to a quarter of a language may be odd without moving
    its fence much.
    Null and empty texts have no words and fail the base rules. A null language is a language of its own, the same as ''. Very long
    texts are counted whole. Ids may be null or repeat; rows that agree are judged alike. Other columns are not read and may have
    any name. An empty table gives an empty result.
    """
    there, back = kept_columns(docs, keep)
    carried = [f"keep_{i}" for i in range(len(keep))]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text"), *there)
    docs = _grouped(docs, min_documents, most_languages)
    lists = common_words(docs.select("group", "text"), n_common)
    found = profiles(docs, ["doc_id", "group", *carried], lists=lists, by="group")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = found.select("group", *KEPT[:-1], "chars", "common", failed.alias("base_failed"), *carried)
    found = stage(found, "rules")
    size = max(map(len, lists.values()), default=0) + 1
    sums = [F.array(*[F.sum(F.col(k)[i]) for i in range(n)]).alias(k) for k, n in (("chars", len(CLASSES)), ("common", size))]
    rows = found.where("not base_failed").groupBy("group").agg(*sums).collect()  # most_languages and one, at most
    references = {r["group"]: tuple(shares(np.array([r[k]], float))[0] for k in ("chars", "common")) for r in rows}

    def measured(df: DataFrame, names: list[str]) -> DataFrame:
        schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in names]).add("char_distance", T.DoubleType()).add("word_distance", T.DoubleType())
        return df.select(*names, "chars", "common", *([] if "group" in names else ["group"])).mapInArrow(_distances(names, references), schema)

    out = measured(found, ["group", *KEPT, *carried])
    judged = F.col("n_words") >= min_words
    odd = judged & ((F.col("char_distance") > max_chars) | (F.col("word_distance") > max_words))
    if word_fence is not None:
        digits = F.round("word_distance", 4)
        usual = measured(found.where(judged & ~F.col("base_failed")), ["group"]).where((F.col("char_distance") <= max_chars) & (F.col("word_distance") <= max_words))
        fences = stage(_fences(usual.select("group", digits.alias("d")), word_fence), "fences")
        out = out.join(F.broadcast(fences), "group", "left")  # most_languages and one, at most
        odd = odd | (judged & F.coalesce(digits > F.round("fence", 6), F.lit(False)))
    out = out.withColumn("kept", ~F.col("base_failed") & ~odd)
    if keep:
        return out.where("kept").select(*back)
    return out.select(*KEPT, "kept", *[F.when(judged, F.col(k)).alias(k) for k in ("char_distance", "word_distance")])
