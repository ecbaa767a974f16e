"""Counts and histograms of whole texts, in one pass: what the quality rules and the quality classifier look at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import byte_table, LOWERED, mixed, slices, small_batches, span_hashes, spans, UNSPACED, window_hashes, word_hashes, WORDLIKE
from parley.llm.common import _BYTES

#: Frequent function words of four languages: a feature of the classifier, which learns what they are worth; other languages have none of them.
COMMON_WORDS = (
    "the of and to in is that for was with as be this it on by are from or an "
    "der die und das den von zu mit für auf ist im nicht ein eine als auch sich "
    "le la les de des et un une du que qui dans pour pas sur au avec est "
    "el los las que y en del se con por no una su para al lo como"
).split()
COMMON = sorted(set(COMMON_WORDS))
#: Character classes of the histogram; bytes that continue a UTF-8 character belong to none.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "mark", "beyond")
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("mark"), np.int64)
    for name, low, high in (("space", 0, 32), ("digit", 48, 57), ("upper", 65, 90), ("lower", 97, 122), ("beyond", 192, 255)):
        table[low : high + 1] = CLASSES.index(name)
    for name, chars in (("line", "\n"), ("stop", ".,;:'\"?-"), ("symbol", SYMBOLS)):
        table[[ord(c) for c in chars]] = CLASSES.index(name)
    table[128:192] = len(CLASSES)
    return table


_CLASS = _class_table()
_SYMBOL = byte_table(*((ord(c), ord(c)) for c in SYMBOLS))


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data.astype(np.uint64) + np.uint64(1), np.array([0]), np.array([len(data)]), _BYTES)[0])


def vocabulary(words: list[str]) -> np.ndarray:
    """(hash, place in ``words``) of each word, sorted by hash."""
    return np.array(sorted((_hash_of(w), i) for i, w in enumerate(words)), dtype=np.uint64).reshape(-1, 2)


VOCABULARY = vocabulary(COMMON)

LONGS = ("n_words", "word_chars", "n_chars", "n_symbols", "n_bars", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words")


def _summed(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The sum of ``flags`` between neighbouring cuts."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[cuts])


def _repeated(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a key occurs twice or more in its row."""
    own = mixed(keys + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The number of distinct keys of each row."""
    own = mixed(keys + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(own, return_index=True)
    return np.bincount(row[first], minlength=n)


def profile(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """LONGS, and the histogram chars, of every row."""
    n = len(offsets) - 1
    inside, lead = UNSPACED[data], (data & 0xC0) != 0x80
    words, rows = word_hashes(data, offsets, UNSPACED)
    word_row = np.repeat(np.arange(n), np.diff(rows))
    out = {"n_words": np.diff(rows), "word_chars": _summed(inside & lead, offsets), "n_chars": _summed(lead, offsets)}
    out |= {"n_symbols": _summed(_SYMBOL[data], offsets), "n_bars": _summed(data == ord("|"), offsets)}
    starts, ends, lines = spans(data, offsets, data_not_newline())
    hashes = span_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, _BYTES)
    sums = np.concatenate([[0], np.cumsum(inside)])
    worded = sums[ends] > sums[starts]
    line_row = np.repeat(np.arange(n), np.diff(lines))[worded]
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(hashes[worded], line_row, n)
    windows, places = window_hashes(words, rows, REPEAT_WINDOW)
    again = places[_repeated(windows, word_row[places])]
    covered = np.zeros(len(words) + REPEAT_WINDOW, bool)
    for k in range(REPEAT_WINDOW):
        covered[again + k] = True
    out["n_repeat_words"] = _summed(covered[: len(words)], rows)
    out["n_distinct_words"] = _distinct(words, word_row, n)
    width = len(CLASSES) + 1
    kinds = np.bincount(np.repeat(np.arange(n) * width, np.diff(offsets)) + _CLASS[data], minlength=n * width).reshape(n, width)
    out["chars"] = kinds[:, :-1]
    return out


def common_counts(data: np.ndarray, offsets: np.ndarray, held: list[np.ndarray], kinds: np.ndarray, size: int) -> np.ndarray:
    """How often each row has each of ``size`` common words, and other words: row i counts by the vocabulary ``held[kinds[i]]``."""
    n = len(offsets) - 1
    words, rows = word_hashes(LOWERED[data], offsets, WORDLIKE)
    row = np.repeat(np.arange(n), np.diff(rows))
    known = np.full(len(words), size)
    for kind in np.unique(kinds):
        table = held[kind]
        if len(table):
            mine = np.flatnonzero(kinds[row] == kind) if len(held) > 1 else slice(None)
            at = np.minimum(np.searchsorted(table[:, 0], words[mine]), len(table) - 1)
            known[mine] = np.where(table[at, 0] == words[mine], table[at, 1].astype(np.int64), size)
    return np.bincount(row * (size + 1) + known, minlength=n * (size + 1)).reshape(n, size + 1)


def data_not_newline() -> np.ndarray:
    """Bytes that belong to a line."""
    return ~byte_table((10, 10))


def _profiles(keep: list[str], lists: dict[str, list[str]] | None, by: str | None):
    held = [VOCABULARY] if lists is None else [vocabulary(x) for x in lists.values()]
    size = len(COMMON) if lists is None else max(map(len, lists.values()), default=0)
    place = {k: i for i, k in enumerate(lists or {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([place[x] for x in batch.column(by).to_pylist()], int) if by else np.zeros(batch.num_rows, int)
            for start, end, data, offsets in slices(batch.column("text")):
                found = profile(data, offsets)
                found["common"] = common_counts(data, offsets, held, of[start:end], size)
                columns = [batch.column(k).slice(start, end - start) for k in keep]
                columns += [pa.array(found[k].astype(np.int64)) for k in LONGS]
                for k in ("chars", "common"):
                    wide = found[k].shape[1]
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(end - start + 1, dtype=np.int32) * wide), pa.array(found[k].ravel().astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *LONGS, "chars", "common"])

    return run


def profiles(docs: DataFrame, keep: list[str], *, lists: dict[str, list[str]] | None = None, by: str | None = None) -> DataFrame:
    """The profile of column ``text`` of each row, beside the columns ``keep``, which may include ``text``. Common words are COMMON, or
    those that ``lists`` has for the value of column ``by``, one of ``keep``."""
    fields = [docs.schema[k] for k in keep]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    for k in LONGS:
        schema.add(k, T.LongType())
    for k in ("chars", "common"):
        schema.add(k, T.ArrayType(T.IntegerType()))
    return small_batches(docs.select(*dict.fromkeys([*keep, "text"]))).mapInArrow(_profiles(keep, lists, by), schema)


def kept_columns(docs: DataFrame, keep: tuple[str, ...]) -> tuple[list, list]:
    """Columns to carry along under names that clash with nothing, and the way back to their names."""
    return [F.col(f"`{k}`").alias(f"keep_{i}") for i, k in enumerate(keep)], [F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)]
