"""N-gram Jaccard join: Bayesian candidate pruning over MinHash, and exact verification.

Texts are sets of word shingles (five words by default; letters, digits and all beyond ASCII make words, A-Z count as a-z).

1. One pass over the texts makes, for each row, a key of its shingle set and a MinHash signature. Rows of equal sets are one
   node from here on, whatever their number. A set's key has 128 bits, so that no two sets of any corpus are expected to share one;
   nodes are numbered as they are written down.
2. Signatures are cut into bands; nodes that agree in a band share a bucket. With 25 bands of 4 a pair at Jaccard 0.8 shares
   none with probability 2e-6.
3. In each bucket a few leaders cover the rest: MinHash values are compared block by block, and a pair is dropped when the
   posterior probability that it reaches ``family`` (0.6) falls below ``tolerance``. Jaccard distance is a metric: if a text
   is within 0.1 of its leader, all that is within 0.2 of the text is within 0.3 of the leader, so the leader's links at 0.6
   or more tie together every pair that can reach 0.8. A bucket gives a number of links in proportion to its nodes, not to its
   pairs. Large buckets are dealt into parts of ``PART`` nodes; the leaders of the parts meet again in the next round.
4. Components of those links are families. The node with the smallest key is a family's head; the other sets are written as what
   they have and what they lack against the head's set, which for copies with a few edits is little. These differences are dealt
   in pairs of blocks of ``BLOCK`` nodes or ``BLOCK_SHINGLES`` shingles, with the head's set beside them. Within a pair of
   blocks pairs are pruned by posterior, and what is left is verified by the exact intersection of the shingle sets. It gives a
   spanning forest of its verified links and the number of links of each node, never the pairs.
5. Components of the forest are the classes.

Pruning and banding are probabilistic by the nature of the method, with the tolerances named; every link reported is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bounded, by_group, LOWERED, mixed, slices, small_batches, stage, window_hashes, word_hashes, WORDLIKE
from parley.operators.graph import components

#: Nodes of a bucket, and nodes or shingles of a family, that one group handles (a single larger set is a block of its own).
PART, BLOCK, BLOCK_SHINGLES = 1024, 160, 1 << 20
#: Sets that a task remembers to have given.
SEEN = 100_000
#: Rounds over leaders before those that are left are compared by blocks.
LEADER_ROUNDS = 20
#: Jaccard similarity that ties families, and the share of equal MinHash values that covers a text.
FAMILY, COVER = 0.6, 0.9


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each row; a row of fewer words has one, of all its words; a row without words none."""
    words, rows = word_hashes(LOWERED[data], offsets, WORDLIKE)
    found, places = window_hashes(words, rows, width)
    at = np.searchsorted(places, rows)
    out = []
    for i in range(len(offsets) - 1):
        if at[i + 1] > at[i]:
            out.append(np.unique(found[at[i] : at[i + 1]]))
        else:
            few = words[rows[i] : rows[i + 1]]
            out.append(mixed(np.array([int.from_bytes(few.tobytes(), "little") % ((1 << 64) - 59)], np.uint64)) if len(few) else few)
    return out


def set_key(found: np.ndarray, seed: int) -> int:
    """64 bits of a set's key; seeds 0 and 1 give both halves."""
    one = int(mixed(found + np.uint64(seed)).sum(dtype=np.uint64)) + len(found) * 0x9E3779B97F4A7C15
    return int(mixed(np.array([one % (1 << 64)], np.uint64)).view(np.int64)[0])


class MinHash:
    """``n`` independent MinHash values of sets of 64-bit items, 32 bits each."""

    def __init__(self, n: int, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.n = n
        self.times = (draw.integers(0, 1 << 63, n, np.uint64) << np.uint64(1)) | np.uint64(1)
        self.plus = draw.integers(0, 1 << 63, n, np.uint64)

    def __call__(self, items: np.ndarray) -> np.ndarray:
        low = np.full(self.n, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(items), 1024):
            part = np.multiply.outer(self.times, items[i : i + 1024])
            part += self.plus[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        return (mixed(low) >> np.uint64(32)).astype(np.uint32)


@lru_cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among ``n`` MinHash values with which P(Jaccard >= threshold | matches) is ``tolerance`` or more.

    The prior is uniform, so the posterior is Beta(m + 1, n - m + 1), whose upper tail is a sum of binomial terms.
    """
    for m in range(n + 1):
        if sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1)) >= tolerance:
            return m
    return n + 1


def likely(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float, step: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of two signature matrices that survive block-wise comparison: row of a, row of b, matches in all."""
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    same = np.zeros(len(i), np.int16)
    for at in range(0, a.shape[1], step):
        same += (a[i, at : at + step] == b[j, at : at + step]).sum(axis=1, dtype=np.int16)
        keep = same >= least_matches(min(at + step, a.shape[1]), threshold, tolerance)
        i, j, same = i[keep], j[keep], same[keep]
    return i, j, same


def _signatures(width: int, bands: int, rows: int):
    minhash = MinHash(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in slices(batch.column("text")):
                found = shingles(data, offsets, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.array([set_key(x, 0) if len(x) else None for x in found], pa.int64()),
                        pa.array([set_key(x, 1) if len(x) else None for x in found], pa.int64()),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([minhash(x).tobytes() if len(x) else None for x in found], pa.binary()),
                        batch.column("mark").slice(start, end - start),
                    ],
                    names=["doc_id", "key", "check", "size", "sig", "mark"],
                )

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, bands, rows).astype(np.uint64)
            key = np.zeros(sig.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
            for k in range(rows):
                key = mixed(key * np.uint64(0x100000001B3) + sig[:, :, k])
            nodes = np.repeat(batch.column("node").to_numpy(), bands)
            for at in range(0, len(nodes), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()[at : at + 50_000].view(np.int64)), pa.array(nodes[at : at + 50_000])], names=["bucket", "node"])

    return run


def _forest(n: int):
    """Union-find over 0..n-1 whose roots are the smallest members: (find, join)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(a: int, b: int) -> bool:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
        return p != q

    return find, join


def _cover(tolerance: float, last: bool = False):
    """Of one part of a bucket: links (a, b) that hold families together, and as (a, null) the leaders of a bucket in many parts.

    A text with COVER of its values equal to its leader's needs no look of its own: what is near it is in the leader's family.
    """

    def run(part: pa.Table) -> pa.RecordBatch | None:
        nodes, order = np.unique(part.column("node").to_numpy(), return_index=True)
        sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(part.num_rows, -1)[order]
        _, join = _forest(len(nodes))
        left, leaders, links = np.arange(len(nodes)), [], []
        while len(left):
            lead = int(left[0])
            leaders.append(lead)
            _, j, same = likely(sigs[lead : lead + 1], sigs, FAMILY, tolerance)
            links += [(nodes[lead], nodes[x]) for x in j.tolist() if join(lead, x)]
            left = np.setdiff1d(left, np.append(j[same >= COVER * sigs.shape[1]], lead))
        many = not last and part.column("parts")[0].as_py() > 1
        a = np.array([x for x, _ in links] + ([nodes[x] for x in leaders] if many else []), np.int64)
        b = pa.array([int(x) for _, x in links] + [None] * (len(a) - len(links)), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.full(len(a), part.column("bucket")[0].as_py(), np.int64))], names=["a", "b", "bucket"])

    return run


def _families(signed: DataFrame, small: DataFrame, bands: int, rows: int, tolerance: float) -> DataFrame:
    """Links (a, b) between nodes whose components are families; ``small``: the nodes with one byte of each MinHash value."""
    placed = stage(signed.select("node", "sig").mapInArrow(_bands(bands, rows), "bucket long, node long"), "bands")
    links, seen = None, None
    for _ in range(LEADER_ROUNDS):
        shared = stage(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        members = placed.join(shared, "bucket").select("bucket", "node", "n")
        dealt = members.withColumn("parts", F.ceil(F.col("n") / PART)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        found = dealt.join(small, "node").select("bucket", "part", "parts", "node", "sig")
        found = stage(by_group(found, ["bucket", "part"], _cover(tolerance), "a long, b long, bucket long"), "links")
        here = found.where("b is not null").select("a", "b")
        links = here if links is None else links.union(here)
        left = found.where("b is null").select("bucket", F.col("a").alias("node"))
        now = left.count()
        if not now:
            return links.distinct()
        if seen is not None and now >= seen:  # the parts hold nothing but leaders: compare them by blocks
            return links.union(_by_blocks(left, small, tolerance)).distinct()
        placed, seen = left, now
    return links.union(_by_blocks(left, small, tolerance)).distinct()


def _by_blocks(left: DataFrame, small: DataFrame, tolerance: float) -> DataFrame:
    """Links between leaders that no further leader covers, for every pair of parts of a bucket."""
    n = left.groupBy("bucket").agg(F.count("*").alias("n"))
    dealt = left.join(stage(n, "left"), "bucket").withColumn("parts", F.ceil(F.col("n") / BLOCK)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    pairs = dealt.join(small, "node").select("bucket", "node", "sig", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    pairs = pairs.select("bucket", F.least("part", "other").alias("part"), F.greatest("part", "other").alias("other"), "node", "sig")
    return by_group(pairs, ["bucket", "part", "other"], _cover(tolerance, last=True), "a long, b long, bucket long").select("a", "b")


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = [x[::4] for x in batch.column("sig").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sigs, pa.binary())], names=["node", "sig"])


def _verify(threshold: float, tolerance: float):
    """Of one pair of blocks of a family: each node's forest parent and the number of rows its verified links lead to."""

    def run(part: pa.Table) -> pa.RecordBatch | None:
        part = part.sort_by([("block", "ascending"), ("node", "ascending")])
        nodes, block = part.column("node").to_numpy(), part.column("block").to_numpy()
        once = np.flatnonzero(np.append(True, (nodes[1:] != nodes[:-1]) | (block[1:] != block[:-1])))  # rows may repeat an id and a text
        nodes, block, copies = nodes[once], block[once], part.column("copies").to_numpy()[once]
        more, less, sigs = (part.column(k).take(pa.array(once)).to_pylist() for k in ("more", "less", "sig"))
        items = lambda x: np.frombuffer(x, np.uint64)
        head = items(more[0])  # block -1: it is here to read the others by, and takes part as a member of its own block
        nodes, block, copies, more, less, sigs = (x[1:] for x in (nodes, block, copies, more, less, sigs))
        if not len(nodes):  # no node fell into these two blocks
            return None
        sets = [items(m) if s is None else np.union1d(np.setdiff1d(head, items(s), assume_unique=True), items(m)) for m, s in zip(more, less, strict=True)]
        sigs = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(nodes), -1)
        size, links = np.array([len(x) for x in sets]), np.zeros(len(nodes), np.int64)
        find, join = _forest(len(nodes))
        low, high = part.column("low")[0].as_py(), part.column("high")[0].as_py()
        split = int(np.searchsorted(block, high)) if low < high else None
        for i in range(len(nodes) if split is None else split):
            rest = np.arange(i + 1 if split is None else split, len(nodes))
            rest = rest[np.minimum(size[rest], size[i]) >= threshold * np.maximum(size[rest], size[i])]
            rest = rest[likely(sigs[i : i + 1], sigs[rest], threshold, tolerance)[1]]
            if not len(rest):
                continue
            found = np.concatenate([sets[x] for x in rest])
            at = np.minimum(np.searchsorted(sets[i], found), size[i] - 1)
            both = np.add.reduceat((sets[i][at] == found).astype(np.int64), np.cumsum(size[rest]) - size[rest])
            for x in rest[both >= threshold * (size[rest] + size[i] - both) - 1e-9].tolist():
                links[i] += copies[x]
                links[x] += copies[i]
                join(i, x)
        roots = nodes[[find(i) for i in range(len(nodes))]]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.array(links)], names=["a", "b", "links"])

    return run


def _sets(width: int):
    """The shingle sets of texts. Rows that agree in id and set are given once for each SEEN others; what reads them takes one of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, end, data, offsets in slices(batch.column("text")):
                rows = []
                for i, found in zip(ids[start:end], shingles(data, offsets, width), strict=True):
                    if len(found) and (key := (i, set_key(found, 0), set_key(found, 1))) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        rows.append((*key, found.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "key", "check", "found"])

    return run


def _member_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` with ``found``, read again from a row that has the node's first id; a null first id is looked for among null ids."""
    wanted = bounded(members.select(F.coalesce("first", F.lit(-(2**63))).alias("want")))
    texts = docs.withColumn("want", F.coalesce("doc_id", F.lit(-(2**63)))).join(wanted, "want", "left_semi")
    sets = texts.select("doc_id", "text").mapInArrow(_sets(width), "doc_id long, key long, check long, found binary")
    sets = sets.select(F.col("key").alias("of"), F.col("check").alias("too"), F.col("doc_id").alias("read"), "found")
    on = (F.col("of") == F.col("key")) & (F.col("too") == F.col("check")) & F.col("read").eqNullSafe(F.col("first"))
    return sets.join(bounded(members), on).drop("of", "too", "read")


def _block() -> Column:
    return F.pmod(F.xxhash64("node"), F.col("blocks"))


def _apart(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(component, node, more, less) of all members. The head's set is joined by block, so that a large family is many keys."""
    held = _member_sets(docs, members, width).withColumn("block", _block())
    heads = _member_sets(docs, members.where("node = component"), width)
    heads = heads.select("component", F.col("node").alias("its"), F.col("found").alias("head"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    both = held.join(heads, ["component", "block"]).select("component", "node", "found", F.when(F.col("node") != F.col("its"), F.col("head")).alias("head"))
    return both.mapInArrow(_against_head, "component long, node long, more binary, less binary")


def _against_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets (found) beside the head's set (head; null for the head itself): what they have more and less, or all they have if that is shorter."""
    for batch in batches:
        more, less = [], []
        for found, head in zip(batch.column("found").to_pylist(), batch.column("head").to_pylist(), strict=True):
            more.append(found)
            less.append(None)
            if head is not None:
                a, b = np.frombuffer(found, np.uint64), np.frombuffer(head, np.uint64)
                plus, minus = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
                if len(plus) + len(minus) < len(a):
                    more[-1], less[-1] = plus.tobytes(), minus.tobytes()
        columns = [batch.column(k) for k in ("component", "node")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(more, pa.binary()), pa.array(less, pa.binary())], names=["component", "node", "more", "less"])


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, check, mark), and nodes (node, key, check, first, copies, size, sig), one for each set."""
    signed = docs.withColumn("mark", F.xxhash64("text"))
    signed = stage(small_batches(signed).mapInArrow(_signatures(width, bands, rows), "doc_id long, key long, check long, size long, sig binary, mark long"), "signed")
    held = [F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("sig").alias("sig")]
    nodes = signed.where("key is not null").groupBy("key", "check").agg(*held)
    return signed.select("doc_id", "key", "check", "mark"), stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, tolerance: float = 1e-4, bands: int = 25, rows: int = 4) -> DataFrame:
    """(doc_id, class_id, class_size, n_links, mark) for every row of ``docs``; mark is a hash of the text.

    Rows are linked if their shingle sets have a Jaccard similarity of ``threshold`` or more; classes are what links connect.
    class_id is the smallest id of the class (null if all its ids are null), class_size its rows, n_links the other rows that a
    row is linked to, rows of equal sets included. Rows that repeat an id are rows of their own and keep their number.
    Null, empty and wordless texts are linked to nothing: their class is their own row. A text of fewer words than ``width`` is
    one shingle of all its words. Other columns are not read and may have any name. An empty table gives an empty result.
    ``threshold`` below 0.8 would need another family bound and is refused.
    """
    if threshold < 0.8:
        raise ValueError("families are only proven to hold links at 0.8 or more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed, nodes = _signed(docs, width, bands, rows)
    small = stage(nodes.select("node", "sig").mapInArrow(_low_bytes, "node long, sig binary"), "low")
    families = components(_families(nodes, small, bands, rows, tolerance))
    sizes = families.join(nodes.select("node", "size"), "node").groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")
    members = families.join(stage(sizes, "sizes"), "component").join(nodes.select("node", "key", "check", "first", "copies"), "node")
    members = stage(members.select("component", "node", "key", "check", "first", "copies", blocks), "members")
    apart = stage(_apart(docs, members, width), "apart")
    placed = apart.join(members.select("node", "copies", "blocks"), "node").join(small, "node")
    dealt = placed.withColumn("block", _block()).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "copies", "more", "less", "sig", "block")
    # The head's set goes to every pair of blocks, as block -1.
    heads = placed.where("node = component").withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    heads = heads.withColumn("high", F.explode(F.sequence(F.col("low"), F.col("blocks") - 1)))
    heads = heads.select("component", "low", "high", F.lit(-(2**63)).alias("node"), "copies", "more", "less", "sig", F.lit(-1).cast("long").alias("block"))
    dealt = dealt.unionByName(heads)
    forest = stage(by_group(dealt, ["component", "low", "high"], _verify(threshold, tolerance), "a long, b long, links long"), "forest")
    classes = components(forest.select("a", "b"))
    links = forest.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = nodes.select("node", "key", "check", "first", "copies").join(stage(classes.join(links, "node"), "classed"), "node", "left")
    joined = stage(joined.select("key", "check", "first", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "joined")
    whole = stage(joined.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size")), "whole")
    by_node = stage(joined.join(whole, "component").select("key", "check", "class_id", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links")), "by_node")
    placed = signed.join(by_node, ["key", "check"], "left")
    alone = F.col("class_size").isNull()
    return placed.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "mark",
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest id stays.

    Rows with a null id stay. Of rows that repeat an id and a text one stays, if it is the one of its class.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **more).select("doc_id", "mark", "class_id")
    found = stage(found, "classes")
    named = [F.col("doc_id").alias("parley_id"), F.col("mark").alias("parley_mark")]
    is_it = (F.col(id_col).cast("long") == F.col("parley_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("parley_mark"))
    extra = bounded(found.where("doc_id is not null and doc_id <> class_id").select(*named).distinct())
    kept = docs.join(extra, is_it, "left_anti")
    again = found.where("doc_id = class_id").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select(*named)
    if again.limit(1).count():  # rows that repeat an id and a text, and stand for their class
        again = bounded(again)
        twice = kept.join(again, is_it, "left_semi").dropDuplicates([id_col, text_col])
        kept = kept.join(again, is_it, "left_anti").unionByName(twice)
    return kept
