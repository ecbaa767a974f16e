"""Document fingerprints by locally consistent parsing.

The bytes of a text are cut into phrases at places that depend only on a few neighbours: runs of one symbol are folded, then
deterministic coin tossing shrinks the alphabet (a symbol becomes twice the place of the lowest bit in which it differs from its
left neighbour, plus that bit) until six labels are left, and the local maxima of the labels begin phrases of 2 to 11 symbols.
A phrase is named by a hash of its symbols. The names are the symbols of the next level, up to a single name. Equal substrings
therefore get equal names in their interior, wherever they stand. The names of the second level and above are reduced to a
fixed number of slots by one-permutation MinHash; the likeness of two fingerprints is the share of equal slots.

All texts of a batch are parsed together: a level costs a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import item_hashes, mixed, SLICE_BYTES, small_batches

SLOTS = 64
#: The lowest level whose names count.
LOWEST = 2


def _table(size: int) -> np.ndarray:
    """Coin tossing for small symbols: the label of [symbol, left neighbour]."""
    own, left = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = own ^ left
    place = np.log2(np.maximum(differ & -differ, 1)).astype(int)
    return np.where(differ > 0, 2 * place + ((own >> place) & 1), 0).astype(np.uint8)


_TOSS = {n: _table(n) for n in (256, 128, 16, 8)}


def _tossed(labels: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    left = np.empty_like(labels)
    left[1:] = labels[:-1]
    left[first] = labels[first] ^ 1  # the first symbol of a row has a neighbour of its own making
    return _TOSS[size].ravel()[labels.astype(np.int32) * size + left]


def _wide_tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing for 64-bit names: labels below 128."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = names[first] ^ np.uint64(1)
    differ = names ^ left
    lowest = differ & (~differ + np.uint64(1))
    place = np.frexp(np.maximum(lowest, 1).astype(np.float64))[1] - 1
    return (2 * place + ((names >> place.astype(np.uint64)) & np.uint64(1)).astype(np.int64)).astype(np.uint8)


def _folded(symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one symbol: the place of each run's first symbol, the runs' lengths, and where the runs of each row begin."""
    new = np.ones(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[rows[:-1][np.diff(rows) > 0]] = True
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(symbols))), np.searchsorted(at, rows)


def levels(data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The names of each level from 1 on, and where the names of each row begin, until no row has more than one."""
    at, run, rows = _folded(data, rows)
    labels = data[at]
    names = mixed(labels.astype(np.uint64) + (run.astype(np.uint64) << np.uint64(8)))
    size, level = 256, 0
    while True:
        level += 1
        first = rows[:-1][np.diff(rows) > 0]
        if size == 0:
            labels, size = _wide_tossed(names, first), 128
        for alphabet in ((256, 16, 8) if size == 256 else (128, 16, 8)):
            labels = _tossed(labels, first, alphabet)
        begins = np.zeros(len(names), bool)
        if len(names) > 2:
            begins[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
            ends = rows[1:][np.diff(rows) > 0] - 1
            begins[ends] = False
        begins[first] = True
        starts = np.flatnonzero(begins)
        names = item_hashes(names, starts, np.append(starts[1:], len(names)))
        rows = np.searchsorted(starts, rows)
        yield names, rows
        if not len(names) or (np.diff(rows) <= 1).all() or level > 60:
            return
        at, run, rows = _folded(names, rows)
        names, size = np.where(run > 1, mixed(names[at] + run.astype(np.uint64)), names[at]), 0


def sketches(texts: list[bytes]) -> np.ndarray:
    """Fingerprints [text, SLOTS] of 16-bit slots; 0 marks an empty slot."""
    out = np.zeros((len(texts), SLOTS), np.uint16)
    start = 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end]) <= SLICE_BYTES):
            held += len(texts[end])
            end += 1
        rows = np.concatenate([[0], np.cumsum([len(x) for x in texts[start:end]])])
        if held:
            _sketch(np.frombuffer(b"".join(texts[start:end]), np.uint8), rows, out[start:end])
        start = end
    return out


def _sketch(data: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    names, of = [], []
    done = np.zeros(len(rows) - 1, bool)  # rows that were one name on a level before: other rows of the batch may go on
    for level, (found, cuts) in enumerate(levels(data, rows), 1):
        row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        alone = np.diff(cuts) <= 1
        counts = (~done if level >= LOWEST else alone)[row]
        names.append(found[counts])
        of.append(row[counts])
        done |= alone
    value, row = mixed(np.concatenate(names)), np.concatenate(of)
    slot = row * SLOTS + (value % np.uint64(SLOTS)).astype(np.int64)
    order = np.lexsort((value, slot))
    slot, value = slot[order], value[order]
    head = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.zeros(0, bool)
    out.reshape(-1)[slot[head]] = (mixed(value[head]) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal slots among those that aren't empty in both; 1 if all are."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    return np.where(used > 0, ((a == b) & (a > 0)).sum(axis=1) / np.maximum(used, 1), 1.0)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row: 64 slots of 16 bits in hexadecimal. Null texts count as empty: all slots 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches([x.encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.byteswap().tobytes().hex() for x in found])], names=["doc_id", "fingerprint"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, fingerprint string")


#: Code points by which the rows of one hot id are told apart.
PREFIX = 64


def _dealt(texts: DataFrame, parts: int) -> DataFrame:
    """Rows dealt into ranges of falling doc_id and text, each range with a copy (guest) of the rows that follow its last one.

    Ranges are cut at quantiles of the ids. An id that fills a range or more, as null may, is cut again by the beginnings of its
    texts, at quantiles of a sample of 20 rows for each range. One row for each range is gathered.
    """
    spark = texts.sparkSession
    ids = texts.select(F.col("order").cast("double").alias("at"))
    cuts = ids.stat.approxQuantile("at", [i / parts for i in range(1, parts)], 0.5 / parts) if parts > 1 else []
    splits = [float("-inf"), *sorted({0.0, *cuts}), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="at", outputCol="bucket").transform(texts.withColumn("at", F.col("order").cast("double"))).withColumn("bucket", F.col("bucket").cast("int"))
    placed = placed.withColumn("start", F.substring("text", 1, PREFIX))
    hot = sorted({x for x in cuts if cuts.count(x) > 1})
    if hot:
        rows = placed.where(F.col("at").isin(hot)).select("bucket", "at", "start").orderBy(F.xxhash64("doc_id", "text")).limit(20 * parts).collect()
        marks = []
        for x in hot:
            mine = sorted(r["start"] for r in rows if r["at"] == x)
            if mine:
                n = cuts.count(x)
                marks.append((next(r["bucket"] for r in rows if r["at"] == x), x, sorted({mine[len(mine) * i // n] for i in range(1, n)})))
        placed = placed.join(F.broadcast(spark.createDataFrame(marks, "bucket int, hot double, marks array<string>")), "bucket", "left")
        below = F.when(F.col("at") > F.col("hot"), F.size("marks")).when(F.col("at") == F.col("hot"), F.size(F.filter("marks", lambda m: m <= F.col("start")))).otherwise(0)
        placed = placed.withColumn("range", F.col("bucket").cast("long") * parts + F.coalesce(below, F.lit(0)))
    else:
        placed = placed.withColumn("range", F.col("bucket").cast("long"))
    placed = placed.select("doc_id", "order", "text", "start", "range")
    heads = placed.groupBy("range").agg(F.max(F.struct("order", "start")).alias("head")).select("range", "head.order", "head.start").collect()
    heads.sort(key=lambda r: r["range"], reverse=True)
    if not heads:
        return texts.withColumn("range", F.lit(0).cast("long")).withColumn("guest", F.lit(False))
    # The head of each range is a guest of the range before; the first head follows the last row of all.
    hosts = [(r["range"], r["order"], r["start"], heads[i - 1]["range"]) for i, r in enumerate(heads)]
    table = spark.createDataFrame(hosts, "range long, order long, start string, host long")
    placed = placed.join(F.broadcast(table), ["range", "order", "start"], "left")
    own, guest = (F.struct(F.col(c).alias("range"), F.lit(g).alias("guest")) for c, g in (("range", False), ("host", True)))
    both = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))
    return placed.withColumn("to", F.explode(both)).select("doc_id", "order", "text", "to.range", "to.guest")


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges, sorted: each with its edited text and the next row's fingerprint."""
    held: tuple | None = None  # id, range, guest, text, fingerprint of the last row seen

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("doc_id", "range", "guest", "text")]
        for start in range(0, batch.num_rows, 256):
            rows = [*zip(*(c[start : start + 256] for c in columns), strict=True)]
            marks = sketches([r[3].encode("utf-8", "surrogatepass") for r in rows])
            chain = ([held] if held else []) + [(*r, m) for r, m in zip(rows, marks, strict=True)]
            held = chain[-1]
            pairs = [(a, b) for a, b in zip(chain[:-1], chain[1:], strict=True) if not a[2] and a[1] == b[1]]
            if pairs:
                yield _compared(pairs)


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    from hashlib import sha256

    edited = []
    for (_, _, _, text, _), (_, _, _, after, _) in pairs:
        k = len(text) // 3
        edited.append((text[: len(text) - k] + after[:k]).encode("utf-8", "surrogatepass"))
    own, next_, marks = np.stack([a[4] for a, _ in pairs]), np.stack([b[4] for _, b in pairs]), sketches(edited)
    text = lambda found: pa.array([x.byteswap().tobytes().hex() for x in found])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[0] for a, _ in pairs], pa.int64()),
            pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([sha256(x).hexdigest() for x in edited]),
            text(own),
            text(marks),
            pa.array(likeness(own, marks)),
            pa.array(likeness(own, next_)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row and of its edited text, and their likeness; a row for each row.

    The edited text is the text with its last floor(n/3) code points replaced by the first as many (or all) of the next
    document by falling doc_id; after the last comes the first. Null texts count as empty. Rows that repeat an id follow each
    other by falling text; null ids come last. A single row is its own next document. Other columns are not read and may have
    any name. Texts of any length are read whole. An empty table gives an empty result.

    Texts are shuffled once, into ranges of ids that are sorted and streamed; a task holds one Arrow batch.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("order", F.coalesce("doc_id", F.lit(-(2**63))))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(texts, parts).repartition("range").sortWithinPartitions(F.col("range"), F.col("guest"), F.col("order").desc(), F.col("text").desc())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return small_batches(dealt.select("doc_id", "range", "guest", "text")).mapInArrow(_paired, schema)
