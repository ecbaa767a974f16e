"""URL filters: a sort-merge range join of urls with host and path rules.

A host is turned round (``a.example.net`` to ``net.example.a.``), so that a rule's host and all its subdomains are one interval of
keys. Urls are sorted by key, by Spark, and swept together with the sorted rules: a stack holds the hosts whose intervals are
open, nested one in the other, each with its path rules; the innermost host with a rule whose path starts the url's path wins,
and of its rules the longest path.

Up to ``sweep_rules`` rules are broadcast, and urls are sorted where they lie: no shuffle, so a hot host is no hot task. More
rules are dealt into ranges of keys together with the urls. A range also gets the rules of the hosts that are open where it
begins, and the urls of a full range are dealt to several sweeps, each with all rules of the range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stage

#: (host, path, verdict) triples.
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column) -> Column:
    """The labels of a host from the last to the first, each closed by a dot."""
    return F.concat_ws("", F.transform(F.reverse(F.split(host, r"\.")), lambda x: F.concat(x, F.lit("."))))


class _Open:
    """The hosts that are open at the present key, with their path rules."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, path: str, name: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, sizes = self.stack[-1]
        paths[path] = name, verdict
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def find(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.close(key)
        for _, paths, sizes in reversed(self.stack):
            for n in sizes:
                if n <= len(path) and (hit := paths.get(path[:n])):
                    return hit
        return None, None


NAMES = ["page_id", "host", "path", "rule", "verdict"]
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def _sweep(rules: list[tuple[str, str, str, str]]):
    """Rules (key, path, name, verdict), sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = 0, _Open()
        for batch in batches:
            found = []
            for key, path in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True):
                while at < len(rules) and rules[at][0] <= key:
                    held.add(*rules[at])
                    at += 1
                found.append(held.find(key, path))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in NAMES[:3]), *(pa.array([f[i] for f in found], pa.string()) for i in range(2))], names=NAMES)

    return run


def _sweep_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules and urls of ranges, sorted; a rule stands before the urls of its key."""
    last, held = None, _Open()
    for batch in batches:
        out: list[tuple] = []
        for place, key, path, name, verdict, page, host in zip(*(batch.column(k).to_pylist() for k in ("place", "key", "path", "rule", "verdict", "page_id", "host")), strict=True):
            if place != last:
                last, held = place, _Open()
            if name is not None:
                held.add(key, path, name, verdict)
            else:
                out.append((page, host, path, *held.find(key, path)))
        if out:
            kinds = (pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=NAMES)


def _checked(rules: DataFrame) -> DataFrame:
    """(key, path, rule, verdict): A-Z of hosts lower-cased; of rules with one host and path an allowing one counts."""
    held = rules.select(F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    wrong = held.where((F.col("host") == "") | ~F.coalesce(F.col("verdict").isin("allow", "block"), F.lit(False))).limit(1).collect()
    if wrong:
        raise ValueError(f"a rule needs a host and allow or block: {tuple(wrong[0])}")
    held = held.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    return held.select(_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", sweep_rules: int = 500_000) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` are (host, path, verdict) triples, or a DataFrame with these columns. A rule fits its host and all subdomains, if
    the url's path starts with the rule's; of several, the one with the longest host wins, then that with the longest path; of
    rules with one host and path the allowing one. A-Z in rules' hosts are lower-cased, null paths count as empty; a rule without
    a host, or with another verdict than allow and block, is an error. Without a rule, rule is null and the verdict is
    ``default``. Null urls and urls without ``://`` have an empty host and path and no rule. Ids may be null or repeat; very long
    urls are judged whole. Other columns are not read and may have any name. An empty table gives an empty result.
    """
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = urls.withColumn("key", _key(F.col("host")))
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")
    held = stage(_checked(rules), "rules")
    if held.limit(sweep_rules + 1).count() > sweep_rules:
        out = _by_ranges(keyed, held)
    else:
        out = keyed.sortWithinPartitions("key").mapInArrow(_sweep(sorted(tuple(r) for r in held.collect())), SCHEMA)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _by_ranges(keyed: DataFrame, rules: DataFrame, share: int = 200_000) -> DataFrame:
    """The sweep by ranges of keys, for rules beyond what is broadcast; ``share``: urls of one sweep, about."""
    spark = keyed.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted(r["key"] for r in rules.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(20 * parts).collect())
    cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)})
    table = F.broadcast(spark.createDataFrame([(cuts,)], "cuts array<string>"))
    ranged = lambda df: df.join(table, F.lit(True)).withColumn("range", F.size(F.filter("cuts", lambda c: c <= F.col("key")))).drop("cuts")
    urls = stage(ranged(keyed), "urls")
    sizes = urls.groupBy("range").agg(F.ceil(F.count("*") / share).cast("int").alias("sweeps"))  # one row for each of at most ``parts`` ranges
    # Hosts that are open where a range begins: the proper prefixes of its first key, label by label.
    labels = F.split(F.col("cut"), r"\.")
    opened = spark.createDataFrame(list(enumerate(cuts, 1)), "range int, cut string")
    opened = opened.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit("."))))).where("key <> cut")
    held = ranged(rules).unionByName(rules.join(F.broadcast(opened.select("range", "key")), "key"))
    sizes = F.broadcast(stage(sizes, "sizes"))
    held = held.join(sizes, "range").withColumn("sweep", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1))).select("range", "sweep", "key", F.lit(0).alias("kind"), "path", "rule", "verdict", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"))
    dealt = urls.join(sizes, "range").withColumn("sweep", F.pmod(F.xxhash64("page_id", "host", "path"), F.col("sweeps")).cast("int"))
    dealt = dealt.select("range", "sweep", "key", F.lit(1).alias("kind"), "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "page_id", "host")
    both = held.unionByName(dealt).repartition("range", "sweep").sortWithinPartitions("range", "sweep", "key", "kind", "path")
    return both.select(F.concat_ws(" ", "range", "sweep").alias("place"), "key", "path", "rule", "verdict", "page_id", "host").mapInArrow(_sweep_ranges, SCHEMA)
