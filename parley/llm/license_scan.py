"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block (a line, by default) matches a template if it holds at least ``threshold`` of the template's distinct words. Template
words are ordered by how many blocks of the whole corpus hold them, the rarest first. Of a template of t words, a - the least
overlap - is ceil(threshold * t), and a block that matches must hold one of the first t - a + 1 words (prefix filter), must have a words of
the templates at all (length filter), and from its first common word on must have enough words left on both sides (positional
filter). Candidates are made by an index join on prefix words, each pair only at its first common word, and then verified.

A notice of five words holds four of them by chance or for another license. So each template names the words that tell it apart, which
a block must hold too, and of templates of one family a block matches the most telling one.

A notice may be wrapped. From each line a run of lines reaches as far as a notice can that begins in it: its inner lines hold
fewer words than the longest template, and a line without words ends it. Runs are blocks of the same join; a run counts for a
template only if none of its lines matches that template by itself.

Templates are a parameter of bounded size, so their index is broadcast and texts are never shuffled: only counts of the
templates' words and one row of results for each document are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import stage

#: Words of a text after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words must stand one after the other, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of well-known licenses, as they stand at the head of files.
TEMPLATES = {
    "agpl-3.0": "licensed under the gnu affero general public license version 3",
    "apache-2.0": "licensed under the apache license version 2.0",
    "boost-1.0": "distributed under the boost software license version 1.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "licensed under cc by 4.0",
    "cc-by-nc-4.0": "licensed under cc by-nc 4.0",
    "cc-by-sa-4.0": "licensed under cc by-sa 4.0",
    "cc0-1.0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-3.0": "licensed under the gnu lesser general public license version 3",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "odbl-1.0": "made available under the open database license",
    "proprietary": "confidential and proprietary no license is granted",
    "public-domain": "this work is released into the public domain",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
}
#: The words of a template that tell it from others: a block without them is no match, however many of the rest it holds.
MUST = {
    "agpl-3.0": "gnu affero general 3",
    "apache-2.0": "apache license",
    "boost-1.0": "boost software",
    "bsd": "redistribution source binary",
    "cc-by-4.0": "cc by",
    "cc-by-nc-4.0": "cc by nc",
    "cc-by-sa-4.0": "cc by sa",
    "cc0-1.0": "waived copyright",
    "epl-2.0": "eclipse",
    "gpl": "gnu general",
    "gpl-3.0": "gnu general 3",
    "isc": "permission fee granted",
    "lgpl-3.0": "gnu lesser general 3",
    "mit": "mit",
    "mit-grant": "permission granted charge software",
    "mpl-2.0": "mozilla",
    "odbl-1.0": "database license",
    "proprietary": "confidential proprietary",
    "public-domain": "released public domain",
    "unlicense": "unencumbered released public domain",
    "zlib": "software warranty liable",
}
#: Templates that say more and less of the same: of a family a block matches one, the one that tells most apart and then holds most words.
FAMILIES = {"agpl-3.0": "gnu", "gpl": "gnu", "gpl-3.0": "gnu", "lgpl-3.0": "gnu", "cc-by-4.0": "cc", "cc-by-nc-4.0": "cc", "cc-by-sa-4.0": "cc", "public-domain": "domain", "unlicense": "domain"}
MOST_TEMPLATE_WORDS = 10_000


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _starts(words: Column) -> Column:
    """Where one of PHRASES begins, from word 0."""

    def here(i: Column) -> Column:
        found = F.lit(False)
        for phrase in PHRASES:
            own = F.lit(True)
            for k, w in enumerate(phrase.split()):
                own = own & (F.coalesce(F.get(words, i + k), F.lit("")) == w)
            found = found | own
        return found

    places = F.sequence(F.lit(0), F.size(words) - 1)
    return F.when(F.size(words) > 0, F.filter(places, here)).otherwise(F.array().cast("array<int>"))


def _template_words(templates: Mapping[str, str]) -> dict[str, list[str]]:
    found = {k: sorted(set(re.findall(WORD, v.lower()))) for k, v in templates.items()}
    if any(not w for w in found.values()) or sum(map(len, found.values())) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates need words, and {MOST_TEMPLATE_WORDS} in all at most")
    return found


def longest_template(templates: Mapping[str, str]) -> int:
    """The words of the longest template."""
    return max(len(re.findall(WORD, v.lower())) for v in templates.values())


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, must: Mapping[str, str] = MUST, families: Mapping[str, str] = FAMILIES, threshold: float = 0.8, separator: str = "\n") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks; a row for each row of ``docs``.

    n_base counts all places where PHRASES stand, first_word and last_word are the first and last of them (null without any).
    labels holds the labels of phrases and of the templates that a block matches; a template that ``must`` leaves out needs no word in
    particular, and one that ``families`` leaves out is alone in its family. n_blocks counts those blocks. score is the
    largest containment of a matched template (runs that overlap are one block), 1 where a phrase stands, else 0. Null and empty
    texts have no words; very long ones are scanned whole. Ids may be null or repeat; rows that agree in all of their columns each
    keep a row. Other columns are not read and may have any name. An empty table gives an empty result.
    """
    held = _template_words(templates)
    telling = {k: sorted(set(must.get(k, "").split())) for k in held}
    if any(set(ws) - set(held[k]) for k, ws in telling.items()):
        raise ValueError("the telling words of a template are words of it")
    longest = longest_template(templates)
    vocabulary = sorted({w for ws in held.values() for w in ws})
    known = F.array(*[F.lit(w) for w in vocabulary])
    text = lowered(F.col(text_col))
    least = min(math.ceil(threshold * len(ws) - 1e-9) for ws in held.values())
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    read = read.withColumn("words", words_of(F.col("text")))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    some = F.lit(False)
    for phrase in PHRASES:
        some = some | joined.contains(f" {phrase} ")
    base = read.withColumn("some", some).withColumn("starts", F.when(F.col("some"), _starts(F.col("words"))).otherwise(F.array().cast("array<int>")))
    labels = F.array(*[F.when(F.col("some") & joined.contains(f" {p} "), F.lit(label)) for p, label in PHRASES.items()])
    lines = F.transform(F.split("text", f"\\Q{separator}\\E"), lambda b: _line(words_of(b), known))
    # Only documents that hold enough words of some template at all can have a block that does.
    base = base.withColumn("known", F.array_intersect("words", known))
    enough = F.lit(False)
    for k, ws in held.items():
        there = F.size(F.array_intersect("known", F.array(*[F.lit(w) for w in ws]))) >= math.ceil(threshold * len(ws) - 1e-9)
        for w in telling[k]:
            there = F.array_contains("known", w) & there
        enough = enough | there
    base = base.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_compact(labels).alias("base"),
        F.when(enough, lines).alias("lines"),
    )
    runs = F.transform("lines", lambda _, i: _run(F.slice("lines", i + 1, longest + 1), i, longest))
    single = F.transform("lines", lambda x, i: F.struct(i.alias("first"), i.alias("last"), x["held"].alias("held")))
    blocks = F.filter(F.concat(single, F.filter(runs, lambda x: x["last"] > x["first"])), lambda x: F.size(x["held"]) >= least)
    base = stage(base.withColumn("blocks", F.coalesce(blocks, F.array().cast("array<struct<first:int,last:int,held:array<string>>>"))).drop("lines"), "licenses")
    placed = base.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", F.struct("b.first", "b.last").alias("block"), "b.held")
    counts = stage(placed.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "counts")
    ordered, index, whole = _index(counts, held, threshold, telling, families)
    placed = placed.join(F.broadcast(ordered), F.lit(True)).select("row", "block", F.filter("words", lambda w: F.array_contains("held", w)).alias("held"))
    probes = placed.select("row", "block", "held", F.posexplode("held").alias("at", "word"))
    met = probes.join(F.broadcast(index), "word")
    left = F.least(F.size("held") - F.col("at"), F.col("t") - F.col("place"))
    earlier = F.array_intersect(F.slice("held", F.lit(1), F.col("at")), F.slice("prefix", F.lit(1), F.col("place")))
    met = met.where((F.size("held") >= F.col("a")) & (left >= F.col("a")) & (F.size(earlier) == 0))
    met = met.join(F.broadcast(whole), "template").withColumn("both", F.size(F.array_intersect("held", "all")))
    met = met.where((F.col("both") >= F.col("a")) & (F.size(F.array_intersect("must", "held")) == F.size("must")))
    rank = F.struct((-F.size("must")).alias("m"), (-F.col("both")).alias("b"), "template", (F.col("both") / F.col("t")).alias("share"))
    met = met.groupBy("row", "block", "family").agg(F.min(rank).alias("best")).select("row", "block", "best.template", "best.share")
    met = _matched(met)
    found = met.groupBy("row").agg(F.array_sort(F.collect_set("template")).alias("found"), F.max("share").alias("share"), F.count_distinct("block").alias("n_blocks"))
    out = base.drop("blocks").join(found, "row", "left")
    all_labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0).cast("long")).alias("n_blocks"),
    )


def _line(words: Column, known: Column) -> Column:
    return F.struct(F.size(words).alias("n"), F.array_intersect(F.array_distinct(words), known).alias("held"))


def _run(lines: Column, first: Column, longest: int) -> Column:
    """The run from the first of ``lines`` on: first and last line, and the template words that it holds."""
    start = F.struct(F.lit(-1).alias("inner"), (first - 1).alias("last"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("held"))

    def step(a: Column, x: Column) -> Column:
        # inner: the words of all lines after the first, -1 before it
        done = a["done"] | (x["n"] == 0) | (a["inner"] >= longest - 1)
        inner = F.when(a["inner"] < 0, 0).otherwise(a["inner"] + x["n"])
        more = F.struct(inner.alias("inner"), (a["last"] + 1).alias("last"), F.lit(False).alias("done"), F.array_union(a["held"], x["held"]).alias("held"))
        return F.when(done, F.struct(a["inner"].alias("inner"), a["last"].alias("last"), F.lit(True).alias("done"), a["held"].alias("held"))).otherwise(more)

    return F.aggregate(lines, start, step, lambda a: F.struct(first.alias("first"), a["last"].alias("last"), a["held"].alias("held")))


def _matched(met: DataFrame) -> DataFrame:
    """Lines that match, and runs that do without a line of theirs; runs of a template that overlap are one block."""
    own = met.where("block.first = block.last").groupBy("row", "template").agg(F.collect_set("block.first").alias("own"))
    met = met.join(own, ["row", "template"], "left")
    inside = F.exists("own", lambda x: (x >= F.col("block.first")) & (x <= F.col("block.last")))
    met = met.where((F.col("block.first") == F.col("block.last")) | ~F.coalesce(inside, F.lit(False)))
    earlier = Window.partitionBy("row", "template").orderBy("block.first", "block.last").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("start", F.when(F.coalesce(F.max("block.last").over(earlier) < F.col("block.first"), F.lit(True)), F.col("block.first")))
    met = met.withColumn("start", F.last("start", True).over(Window.partitionBy("row", "template").orderBy("block.first", "block.last")))
    # The last of the runs begins where the notice does.
    return met.select("row", F.max("block.first").over(Window.partitionBy("row", "template", "start")).alias("block"), "template", "share")


def _index(counts: DataFrame, held: Mapping[str, list[str]], threshold: float, telling: Mapping[str, list[str]], families: Mapping[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All template words in order of frequency (one row); the index word -> template of prefix words; the templates' words,
    telling words and families."""
    spark = counts.sparkSession
    rows = [(k, w, len(ws), math.ceil(threshold * len(ws) - 1e-9)) for k, ws in held.items() for w in ws]
    table = spark.createDataFrame(rows, "template string, word string, t int, a int").join(F.broadcast(counts), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = F.array_sort(F.collect_set(F.struct("n", "word")))
    ordered = table.agg(order.alias("o")).select(F.col("o.word").alias("words"))
    whole = table.groupBy("template", "t", "a").agg(order.alias("o")).select("template", "t", "a", F.col("o.word").alias("all"))
    prefix = F.slice("all", F.lit(1), F.col("t") - F.col("a") + 1)
    index = whole.select("template", "t", "a", prefix.alias("prefix"), F.posexplode(prefix).alias("place", "word"))
    more = spark.createDataFrame([(k, telling[k], families.get(k, f"={k}")) for k in held], "template string, must array<string>, family string")
    return ordered, index, whole.select("template", "all").join(F.broadcast(more), "template")
