"""Packing by the histogram of lengths: non-negative least squares over combinations of lengths that fill a window.

A document is its token ids and an end id. What it has of whole windows are sequences of their own; the rest, shorter than a
window, is an item. The histogram of the items' lengths has fewer numbers than a window has tokens, whatever the corpus, and that
is all that the driver sees of it.

1. Combinations of up to three lengths that fill a window exactly are enumerated. Non-negative least squares says how often each is
   to be used, so that the lengths used come to the histogram; the numbers are rounded down, and then up by one where items are left.
2. Items are numbered within their length: within their task as they are made, and by the sums of the tasks before. An item's number
   and the table of combinations give its sequence and its place there, with no shuffle of texts.
3. Items beyond the plan are dealt into shards and packed greedily: the largest that fits comes next, and if none fits, the smallest
   is cut to fill the window. The last sequence of a shard is cut into powers of two, which need no padding.

Texts are tokenized once, and those of the few cut items once more for the checksums of their pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bounded, by_group, small_batches, stage
from parley.llm.token_count import byte_letters, PATTERN

WINDOW, END_ID = 2048, 1
#: Items and tokens of a shard of what the plan leaves over, about.
SHARD_ITEMS, SHARD_TOKENS = 50_000, 4_000_000
#: Sequence numbers: planned ones from 0, whole windows from WHOLE (2**36 for each task), shards from LEFT (2**32 for each).
WHOLE, LEFT = 1 << 61, 1 << 62


class TokenIds:
    """The ids that the library gives a text, as little-endian bytes of 32-bit numbers.

    Where a vocabulary is plain byte-level BPE whose ids follow its merges, the merging is left to tiktoken, which gives the same ids
    in a sixth of the time; a text that it refuses (white space of 10**5 characters and more), and all texts of other vocabularies, go to
    the library itself.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread to a task
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        with open(vocabulary, encoding="utf-8") as file:
            held = json.load(file)
        model, before = held["model"], held["pre_tokenizer"] or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        ids = [model["vocab"][a + b] for a, b in merges]
        plain = model["type"] == "BPE" and not held["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not model.get("ignore_merges")
        special = {t["content"]: t["id"] for t in held["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])}
        self.fast = None
        if plain and ids == sorted(ids) and len(special) == len(held["added_tokens"]):
            byte = {c: i for i, c in enumerate(byte_letters())}
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
            except ValueError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_TOKENIZERS: dict[str, TokenIds] = {}


def token_ids(vocabulary: str) -> TokenIds:
    """The tokenizer of a vocabulary file, one in each Python worker."""
    if vocabulary not in _TOKENIZERS:
        _TOKENIZERS[vocabulary] = TokenIds(vocabulary)
    return _TOKENIZERS[vocabulary]


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three of ``lengths`` (sorted, below ``window``), the largest first and 0 for none, that sum to ``window``."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found = [np.zeros((0, 3), np.int64)]
    for a in lengths[lengths * 3 >= window]:
        b = lengths[(lengths <= a) & (2 * lengths >= window - a) & (lengths <= window - a)]
        b = b[(b == window - a) | there[window - a - b]]
        found.append(np.column_stack([np.full(len(b), a), b, window - a - b]))
    return np.concatenate(found)


def least_squares(combos: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that brings the lengths used, sum of x over the combinations that hold them, to ``counts`` in the sense of least squares.

    Accelerated projected gradients; the step is one over a bound of the largest eigenvalue, restarted when the error rises.
    """
    n, columns = len(counts), [np.ascontiguousarray(c, np.int32) for c in combos.T]

    def held(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(c, x, n) for c in columns)
        out[0] = 0.0  # no length
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return sum(np.take(r, c) for c in columns)

    v = np.ones(len(combos))
    top = 1.0
    for _ in range(20):
        v = back(held(v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (1.05 * top)
    x = y = np.zeros(len(combos))
    t, error = 1.0, np.inf
    for _ in range(rounds):
        new = np.maximum(y - step * back(held(y) - counts), 0)
        now = float(np.square(held(new) - counts).sum())
        if now > error:
            t, y = 1.0, x  # too much momentum
            error = np.inf
            continue
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t, error = new, new + (t - 1) / s * (new - x), s, now
    return x


def planned(counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, repeats) for a histogram: counts[l] items of length l < window. No length is used more often than it occurs."""
    combos = combinations(np.flatnonzero(counts), window)
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    x = least_squares(combos, counts.astype(float))
    repeats = np.floor(x + 1e-9).astype(np.int64)
    left = counts.astype(np.int64).copy()
    for k in np.flatnonzero(repeats):  # what is left after rounding down; the fit may ask for a little too much
        need = np.bincount(combos[k][combos[k] > 0], minlength=len(left))
        on = need > 0
        repeats[k] = min(repeats[k], int((left[on] // need[on]).min()))
        left -= repeats[k] * need
    left = left.tolist()
    for k in np.argsort(repeats - x, kind="stable"):  # the largest rests first
        if x[k] <= repeats[k]:
            break
        need: dict[int, int] = {}
        for length in combos[k].tolist():
            if length:
                need[length] = need.get(length, 0) + 1
        if all(left[length] >= m for length, m in need.items()):
            repeats[k] += 1
            for length, m in need.items():
                left[length] -= m
    on = repeats > 0
    return combos[on], repeats[on]


class Slots:
    """Where the n-th item of a length goes: its sequence and its place there."""

    def __init__(self, combos: np.ndarray, repeats: np.ndarray, window: int) -> None:
        base = np.cumsum(repeats) - repeats
        times = (combos[:, :, None] == combos[:, None, :]).sum(axis=2)  # of each length in its combination
        first = np.cumsum(combos, axis=1) - combos  # the largest length stands first
        rows = []
        for j in range(3):
            own = (combos[:, j] > 0) & ((combos[:, j] != combos[:, j - 1]) if j else True)  # a length once for each combination
            rows.append(np.column_stack([combos[own, j], np.flatnonzero(own), times[own, j], first[own, j], base[own], repeats[own]]))
        table = np.concatenate(rows)
        self.table = table[np.lexsort((table[:, 1], table[:, 0]))]
        length, n = self.table[:, 0], self.table[:, 2] * self.table[:, 5]
        ends = np.cumsum(n)
        self.bounds = np.searchsorted(length, np.arange(window + 1))  # rows of each length
        before = np.append(0, ends)[self.bounds[:-1]]  # items of all lengths before
        self.starts, self.before = ends - n, before
        self.room = np.diff(np.append(0, ends)[self.bounds])

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset), both -1 beyond the plan."""
        inside = number < self.room[length]
        at = self.before[length[inside]] + number[inside]
        row = np.searchsorted(self.starts, at, "right") - 1
        length_, _, times, first, base, _ = self.table[row].T
        k = at - self.starts[row]
        sequence, offset = np.full(len(length), -1), np.full(len(length), -1)
        sequence[inside], offset[inside] = base + k // times, first + k % times * length_
        return sequence, offset


def greedy(sizes: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset): whole items while one fits, else the smallest cut; the last sequence in powers of two."""
    by_size: dict[int, list[tuple[int, int]]] = {}
    for i, n in enumerate(sizes):
        by_size.setdefault(n, []).append((i, 0))
    present = sorted(by_size)
    out: list[tuple[int, int, int, int, int]] = []
    sequence, offset = 0, 0

    def take(size: int) -> tuple[int, int]:
        held = by_size[size]
        got = held.pop()
        if not held:
            del by_size[size], present[bisect_right(present, size) - 1]
        return got

    while present:
        room = window - offset
        at = bisect_right(present, room)
        size = present[at - 1] if at else present[0]
        item, start = take(size)
        length = min(size, room)
        out.append((item, start, length, sequence, offset))
        if size > length:
            rest = size - length
            if rest not in by_size:
                insort(present, rest)
            by_size.setdefault(rest, []).append((item, start + length))
        offset += length
        if offset == window:
            sequence, offset = sequence + 1, 0
    if not offset:
        return out
    last = [x for x in out if x[3] == sequence]
    out = [x for x in out if x[3] < sequence]
    ends = np.cumsum([1 << k for k in range(offset.bit_length() - 1, -1, -1) if offset >> k & 1]).tolist()
    for item, start, length, _, place in last:
        while length:
            k = bisect_right(ends, place)
            part = min(length, ends[k] - place)
            out.append((item, start, part, sequence + k, place - (ends[k - 1] if k else 0)))
            start, length, place = start + part, length - part, place + part
    return out


def _tokenized(vocabulary: str, window: int, end_id: int):
    """Rows of a text: a row for each whole window, and one for the rest, numbered among the task's rests of its length."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "mark", "task", "number", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = token_ids(vocabulary), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            rows = []
            marks, keys = batch.column("mark").to_pylist(), batch.column("doc_id").to_pylist()
            for doc_id, mark, text in zip(keys, marks, batch.column("text"), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    length = min(window, n - at)
                    rows.append((doc_id, mark, task, seen[length], at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

    return run


def _placed(slots: Slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            held = {k: batch.column(k) for k in ("doc_id", "mark", "task", "number", "start", "length", "ids_crc32", "doc_tokens")}
            yield pa.RecordBatch.from_pydict(held | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return run


def _shard_packed(window: int):
    def run(shard: pa.Table) -> pa.RecordBatch:
        shard = shard.sort_by([(k, "ascending") for k in ("length", "doc_id", "mark", "task", "number")])
        item, start, length, sequence, offset = np.array(greedy(shard.column("length").to_pylist(), window), np.int64).T
        whole = shard.column("length").to_numpy()[item] == length
        crc = pa.array(np.where(whole, shard.column("ids_crc32").to_numpy()[item], 0), mask=~whole)
        first = shard.column("start").to_numpy()[item]
        held = {k: shard.column(k).combine_chunks().take(pa.array(item)) for k in ("doc_id", "mark", "doc_tokens")}
        number = LEFT + shard.column("shard")[0].as_py() * (1 << 32)
        return pa.RecordBatch.from_pydict(held | {"start": pa.array(first + start), "length": pa.array(length), "ids_crc32": crc, "sequence_id": pa.array(number + sequence), "offset": pa.array(offset)})

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def ids_of(pieces: DataFrame, docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``pieces`` (doc_id, mark, start, length, ...) with ``ids``, their token ids as little-endian 32-bit numbers; texts are tokenized again."""
    on = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])
    wanted = bounded(pieces.select("doc_id", "mark").distinct())
    texts = _texts(docs, id_col, text_col)
    texts = texts.join(wanted, on(texts, wanted), "left_semi").groupBy("doc_id", "mark").agg(F.first("text").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(vocabulary)
        for batch in batches:
            ids = [encode(x.as_py()) + end for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(ids, pa.binary())], names=["doc_id", "mark", "all_ids"])

    held = texts.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, all_ids binary")
    found = pieces.join(held.withColumnsRenamed({"doc_id": "parley_id", "mark": "parley_mark"}), F.col("doc_id").eqNullSafe(F.col("parley_id")) & (F.col("mark") == F.col("parley_mark")))
    ids = F.substring("all_ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return found.withColumn("ids", ids).drop("all_ids", "parley_id", "parley_mark")


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, mark, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece of every row of ``docs``; mark is a hash of the text.

    A document is its text's ids and ``end_id``; doc_tokens counts them, start the ids before the piece. A sequence holds ``window``
    tokens, or a power of two fewer, without gaps, so nothing is padded. sequence_id is unique but not dense. Documents of more
    than a window are cut at whole windows; others stay whole but for about one in each sequence that the plan leaves over. Null
    and empty texts are one token, the end id. Ids may be null or repeat; every row is packed. Texts of any length are tokenized
    whole. Other columns are not read and may have any name. An empty table gives an empty result. ``vocabulary`` is the path of
    a byte-level file, at the same place on every executor; ``window`` is a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window is a power of two")
    kinds = "doc_id long, mark long, task long, number long, start long, length long, ids_crc32 long, doc_tokens long"
    rows = stage(_texts(docs, id_col, text_col).select("doc_id", "mark", "text").mapInArrow(_tokenized(vocabulary, window, end_id), kinds), "tokenized")
    columns = ["doc_id", "mark", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = rows.where(F.col("length") == window).withColumn("sequence_id", F.lit(WHOLE) + F.col("task") * (1 << 36) + F.col("number"))
    whole = whole.withColumn("offset", F.lit(0).cast("long")).select(columns)
    counts = stage(rows.where(F.col("length") < window).groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # fewer rows than a window has tokens
        histogram[r["length"]] = r["n"]
    slots = Slots(*planned(histogram, window), window)
    before = counts.selectExpr("length", "task", "sum(n) OVER (PARTITION BY length ORDER BY task) - n AS before")
    items = rows.join(before, ["length", "task"]).withColumn("number", F.col("number") + F.col("before")).drop("before")
    items = stage(items.select(*[k.split()[0] for k in kinds.split(", ")]).mapInArrow(_placed(slots), kinds + ", sequence_id long, offset long"), "items")
    left = items.where("sequence_id < 0")
    n, tokens = left.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-tokens // SHARD_TOKENS))
    dealt = left.drop("sequence_id", "offset").withColumn("shard", F.pmod(F.xxhash64("task", "length", "number"), F.lit(shards)))
    rest = stage(by_group(dealt, ["shard"], _shard_packed(window), "doc_id long, mark long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long"), "left")
    cut = ids_of(rest.where("ids_crc32 is null"), docs, vocabulary, id_col=id_col, text_col=text_col, end_id=end_id)
    cut = cut.withColumn("ids_crc32", F.crc32("ids"))
    parts = [whole, items.where("sequence_id >= 0"), rest.where("ids_crc32 is not null"), cut]
    return parts[0].unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns)).unionByName(cut.select(columns))


def sequences(pieces: DataFrame, docs: DataFrame, vocabulary: str, *, window: int = WINDOW, pad_id: int = 0, **more) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences of ``pieces`` as arrays of token ids, padded to ``window`` unless they hold a power of two."""
    held = ids_of(pieces, docs, vocabulary, **more).select("sequence_id", "offset", "length", "ids")
    joined = held.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))

    @F.pandas_udf("array<int>")
    def opened(column):
        return column.map(lambda x: np.frombuffer(x, "<u4").astype(np.int32))

    flat = F.aggregate("x", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    n = F.col("n_tokens")
    pad = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(window) - n)
    found = joined.select("sequence_id", "n_tokens", opened(flat).alias("ids"), pad.alias("pad"))
    return found.select("sequence_id", "n_tokens", F.concat("ids", F.array_repeat(F.lit(pad_id), F.col("pad").cast("int"))).alias("ids"))
