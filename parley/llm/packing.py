"""Best-fit packing with conflicts.

Documents are packed into bins of ``capacity`` tokens; two documents of one source, or of one cluster of duplicates, never share a bin.
Open bins are ordered by what is left in them, and each carries a bitmap of its sources and one of its duplicate clusters. A
document goes to the first bin in that order with enough room whose bitmaps do not hit its own: the successor search goes on
until this tightest compatible bin is found, and a new bin is opened if there is none.

Texts of more than ``capacity`` tokens are cut into pieces of that size and a rest; every piece is an item. Items are dealt by a
hash of their row into shards of about ``shard_items``, so that a hot source, copies and rows without an id are spread evenly;
each shard is packed on its own, the largest item first.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import by_group, stage

SHARD_BINS = 1 << 32


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each item, items in the order given; sources and clusters are bit numbers, -1 for none."""
    open_: list[tuple[int, int]] = []  # (left, bin), ordered
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        own_source, own_cluster = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(open_, (size, -1))
        while at < len(open_):
            k = open_[at][1]
            if not source_bits[k] & own_source and not cluster_bits[k] & own_cluster:
                break
            at += 1
        if at < len(open_):
            left, k = open_.pop(at)
        else:
            left, k = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[k] |= own_source
        cluster_bits[k] |= own_cluster
        if left > size:
            insort(open_, (left - size, k))
        out.append(k)
    return out


def _bits(values: list) -> list[int]:
    """Bit numbers of values that occur twice or more; -1 for the others and for null, which can't conflict."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    bit: dict = {}
    return [bit.setdefault(v, len(bit)) if v is not None and seen[v] > 1 else -1 for v in values]


def _packed(capacity: int):
    def run(shard: pa.Table) -> pa.RecordBatch:
        shard = shard.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        sizes = shard.column("tokens").to_pylist()
        bins = np.array(best_fit(sizes, _bits(shard.column("source").to_pylist()), _bits(shard.column("cluster").to_pylist()), capacity), np.int64)
        size = np.array(sizes, np.int64)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        first = np.append(True, bins[order][1:] != bins[order][:-1])
        offset = np.empty_like(size)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        fill = np.bincount(bins, size, bins.max() + 1).astype(np.int64)[bins]
        columns = [shard.column(k).combine_chunks() for k in ("doc_id", "piece", "tokens", "source")]
        number = shard.column("shard")[0].as_py() * SHARD_BINS
        return pa.RecordBatch.from_arrays([*columns, pa.array(bins + number), pa.array(offset), pa.array(fill)], names=["doc_id", "piece", "tokens", "source", "bin", "offset", "bin_tokens"])

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, tokens_col: str | None = None, capacity: int = 2048, shard_items: int = 2000) -> DataFrame:
    """(doc_id, piece, tokens, source, bin, offset, bin_tokens): where each piece of each row of ``docs`` lies.

    Pieces count from 0; only the last may be shorter than ``capacity``. bin numbers are unique over all shards, offset is the
    number of tokens before the piece in its bin, bin_tokens what the bin holds. ``tokens_col`` names a column of token counts, such
    as an exact tokenizer's (null and negative: 0); without it words between white space are tokens. ``cluster_col`` names
    duplicate clusters; without it equal texts are a cluster. Texts without words are one piece of 0 tokens and take part like others. Null sources
    and clusters conflict with nothing. Ids may be null or repeat; every row is packed. Other columns are not read and may have
    any name. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    cluster = F.xxhash64(cluster_col) if cluster_col else F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))
    if cluster_col:
        cluster = F.when(F.col(cluster_col).isNotNull(), cluster)
    n = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col(tokens_col).cast("long"), F.lit(0).cast("long"))) if tokens_col else n_tokens(F.col(text_col))
    # Row numbers are written down with the items, so a lost executor cannot change them.
    items = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), n.alias("n"))
    items = stage(items, "items")
    shards = max(1, -(-items.count() // shard_items))
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / capacity) - 1)
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    items = items.select(
        F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards)).alias("shard"),
        "doc_id",
        "piece",
        F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("tokens"),
        "source",
        "cluster",
    )
    return by_group(items, ["shard"], _packed(capacity), "doc_id long, piece long, tokens long, source string, bin long, offset long, bin_tokens long")
