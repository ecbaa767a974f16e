"""What the training-data operators share: staged tables, and text kernels that work on whole Arrow batches.

The kernels treat the texts of a batch as one byte array, so their cost is a few numpy passes over the bytes instead of
Python work per word. Null texts count as empty. A slice of a batch holds about ``SLICE_BYTES`` of text, or one text if that
is longer, which bounds a task's memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.sources.store import stage  # noqa: F401 - the operators take it from here

SLICE_BYTES = 1 << 18
#: Rows of whole texts, and bytes, in one Arrow batch, at most (a single longer text is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 24
#: Rows that may be broadcast: about 64 bytes each, so 64 MB at most.
BROADCAST_ROWS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches hold BATCH_ROWS rows and BATCH_BYTES bytes at most, as ten thousand whole texts are
    too many for a task. Results are lazy and Spark reads these settings when it plans them, so they stay set in the session."""
    conf = docs.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = conf.get(key, None)  # none where this Spark has no such setting
        if held is not None and not 0 < int(re.match(r"-?[0-9]+", held)[0]) <= most:
            conf.set(key, str(most))
    return docs


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later result reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if "/parley-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` marked for broadcast if it is counted to have at most ``rows`` rows; else as it is, for a shuffle join."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self.inverse
            self.down = np.multiply.accumulate(steps)
        return self.up[:n], self.down[:n]


_BYTES, _ITEMS = _Powers(0x100000001B3), _Powers(0xD6E8FEB86659FD93)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal spans wherever they stand."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of a text column, about SLICE_BYTES at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, count=n + column.offset + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:  # null rows may still span bytes
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        data = np.concatenate([data[offsets[i] : offsets[i] + lengths[i]] for i in range(n)]) if n else data
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def byte_table(*spans: tuple[int, int]) -> np.ndarray:
    """Which byte values lie in one of the (low, high) spans."""
    out = np.zeros(256, bool)
    for low, high in spans:
        out[low : high + 1] = True
    return out


#: Bytes of words between ASCII white space, and of words of ASCII letters, digits and all that is not ASCII.
UNSPACED = ~byte_table((9, 13), (32, 32))
WORDLIKE = byte_table((48, 57), (65, 90), (97, 122), (128, 255))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes in ``inside`` that don't cross rows; for each row, where its runs begin."""
    on = np.zeros(len(data) + 2, bool)
    on[1:-1] = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(on[1:-1] & (~on[:-2] | first[:-1]))
    ends = np.flatnonzero(on[1:-1] & (~on[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows; for each row, where its words begin."""
    starts, ends, rows = spans(data, offsets, inside)
    return span_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, _BYTES), rows


def window_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` words that lie in one row, and the place of each window's first word."""
    counts = np.diff(rows)
    last = np.repeat(rows[1:], counts)
    places = np.flatnonzero(np.arange(len(words)) + width <= last)
    return span_hashes(words, places, places + width, _ITEMS), places


def item_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of 64-bit items."""
    return span_hashes(items, starts, ends, _ITEMS)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by ``keys`` (longs without nulls), whole, one after another; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = columns[:, start].tolist()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``run`` (group as Arrow table -> RecordBatch or None) for each group of ``keys``, many small groups to a task at little cost."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        rows = 0
        for group in runs(batches, keys):
            if (got := run(group)) is not None and got.num_rows:
                out.append(got)
                rows += got.num_rows
            if rows >= 20_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, rows = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    # A fixed number of partitions: groups are small in bytes but not in work, and Spark merges partitions by their bytes.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(mapped, schema)
