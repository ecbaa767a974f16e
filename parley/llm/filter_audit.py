"""How filters interact: what each removes in every order, what is removed twice, and what only it removes.

Whether a row fails a filter does not depend on the order, so a row is known by its mask of failed filters, and all orders follow
from the number of rows of each mask.

Repeated texts are found by a fingerprint-routed RDD. In each input partition texts meet in a chain for each xxhash64: a chain
holds whole texts, each with its smallest id, so texts that share a fingerprint stay apart. What is not smallest there is given
out as a repeat; the smallest goes on to the partition of its fingerprint, where the same is done over all. So of any number of
equal texts each input partition sends one on. Chains are given up, and what they hold sent on, once they hold CHAIN_BYTES of
text; a text may then be sent more than once, which changes nothing in the end.

The masks are joined with labels, and combineByKey merges vectors of counts by part: one vector for each part and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stage

FILTERS = "ABCDE"
#: Text that the chains of an input partition hold, at most (or one text if that is longer).
CHAIN_BYTES = 1 << 26
#: Text that a partition of fingerprints holds, about, if no two texts are equal.
PART_BYTES = 1 << 26
UPPER, SIGNS = bytes(range(65, 91)), b"#$%&*|"


def failed(data: bytes, chars: int) -> int:
    """The mask of the filters A to D that a text of ``chars`` code points fails; bit 0 is A.

    bytes.split cuts at ASCII white space, which is what words end at.
    """
    words = data.split()
    mask = int(len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words))
    mask += 4 * (100 * (len(data) - len(data.translate(None, UPPER))) > 10 * chars)
    return mask + 8 * (len(data.translate(None, SIGNS)) < len(data))


def larger(a: int | None, b: int | None) -> bool:
    """Whether id a is larger than id b; a null id is larger than any other."""
    return b is not None and (a is None or a > b)


class Chains:
    """Texts by fingerprint: for each text its smallest id, and how many rows of each part have it."""

    def __init__(self) -> None:
        self.by_key: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, data: bytes, doc_id: int | None, mask: int, rows: dict[str, int]) -> Iterator[tuple]:
        """Takes in rows that agree in text and id; gives (id, part, mask, rows) of those that turn out to be repeats."""
        chain = self.by_key.setdefault(key, [])
        for held in chain:
            if held[0] == data:
                if larger(held[1], doc_id):
                    held[1], held[3], doc_id, rows = doc_id, rows, held[1], held[3]
                elif held[1] == doc_id:
                    for part, n in rows.items():
                        held[3][part] = held[3].get(part, 0) + n
                    return
                for part, n in rows.items():
                    yield doc_id, part, mask | 16, n
                return
        chain.append([data, doc_id, mask, rows])
        self.bytes += len(data) + 200

    def drained(self) -> Iterator[tuple[int, bytes, int | None, int, dict[str, int]]]:
        for key, chain in self.by_key.items():
            for data, doc_id, mask, rows in chain:
                yield key, data, doc_id, mask, rows
        self.by_key, self.bytes = {}, 0


def _local(rows: Iterator) -> Iterator[tuple[int, tuple]]:
    """Of one input partition: (fingerprint, smallest rows of a text), and (-1, repeat)."""
    chains, n = Chains(), TaskContext.get().partitionId()
    for doc_id, part, text in rows:
        data = text.encode()
        for repeat in chains.add(xxhash.xxh64_intdigest(data), data, doc_id, failed(data, len(text)), {part: 1}):
            n += 1  # repeats are done with: they go anywhere, evenly
            yield n, (None, *repeat)
        if chains.bytes > CHAIN_BYTES:
            for key, *held in chains.drained():
                yield key, tuple(held)
    for key, *held in chains.drained():
        yield key, tuple(held)


def _over_all(records: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """(id, part, mask, rows) of all rows whose fingerprints lead to one partition."""
    chains = Chains()
    for key, (data, *rest) in records:
        if data is None:
            yield tuple(rest)
        else:
            yield from chains.add(key, data, *rest)
    for _, _, doc_id, mask, rows in chains.drained():
        for part, n in rows.items():
            yield doc_id, part, mask, n


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): n rows of ``docs`` with this id and part fail the filters of this mask, bit 0 for A to bit 4 for E.

    E fails for a row whose text some row with a smaller id has; rows that agree in id and text do not make each other fail, and a
    null id is larger than all others. Null texts are empty, and null parts the part ''.
    """
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fill(part_col).alias("part"), fill(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    most = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    found = rows.rdd.mapPartitions(_local).partitionBy(most, lambda key: key).mapPartitions(_over_all)
    return docs.sparkSession.createDataFrame(found, "doc_id long, part string, mask int, n long")


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def _audited(counts: np.ndarray) -> Iterator[tuple]:
    """(filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part, from its
    counts of rows, good rows and toxic rows by mask."""
    by_mask = np.arange(counts.shape[1])
    fails = {f: (by_mask >> i) & 1 == 1 for i, f in enumerate(FILTERS)}
    removed: dict[tuple[str, int], list[int]] = {}
    lines, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in orders():
        before = np.zeros(counts.shape[1], bool)
        for step, f in enumerate(order, 1):
            now = fails[f] & ~before
            gone = counts[:, now].sum(axis=1).tolist()
            again = int(counts[0, fails[f] & before].sum())
            before |= fails[f]
            shapley[f] += gone[0]
            lines.append((order, step, f, int(counts[0, ~before].sum()), gone, again, int(counts[0, 1 << FILTERS.index(f)])))
    for order, step, f, kept, gone, again, alone in lines:
        yield order, step, f, kept, gone[0], again, alone, gone[1], gone[2], shapley[f]


def _vectors(width: int = 1 << len(FILTERS)) -> tuple[Callable, Callable, Callable]:
    """The functions of combineByKey: a first vector, another row to a vector, two vectors to one."""

    def add(held: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        held[:, mask] += (n, n * good, n * toxic)
        return held

    return lambda row: add(np.zeros((3, width), np.int64), row), add, lambda a, b: a + b


def filter_audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each
    value of ``part_col`` that occurs (null: ''), five steps of 120 orders, zeros included.

    ``labels`` (doc_id, quality, toxic) may lack ids, and may repeat them: an id is good if one of its rows has quality 1, toxic if
    one has toxic 1. Null ids have no labels. Null texts are empty ones, which are equal to each other. Rows that repeat an id are
    rows of their own. Very long texts are read whole, one at a time. Other columns are not read and may have any name. An empty
    table gives an empty result.
    """
    held = stage(masks(docs, id_col=id_col, text_col=text_col, part_col=part_col), "masks")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = held.join(known, "doc_id", "left").select("part", "mask", "n", zero("good"), zero("toxic"))
    vectors = joined.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(*_vectors())
    found = vectors.flatMap(lambda x: [(x[0], *row) for row in _audited(x[1])])
    columns = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(found, columns)
