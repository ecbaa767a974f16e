"""Conversations from messages, their statistics and their renderings."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.sources.store import stage


def assemble(messages: DataFrame) -> DataFrame:
    """conversation_id and messages (role, content) in turn order, from rows (conv_id, turn, role, text)."""
    held = messages.groupBy(F.col("conv_id").alias("conversation_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return held.select("conversation_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def transcript(messages: Column, numbered: bool = False) -> Column:
    """``ROLE: text`` lines; numbered ``1. ROLE: text``."""
    line = lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])
    lines = F.transform(messages, lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), line(m))) if numbered else F.transform(messages, line)
    return F.array_join(lines, "\n")


def facet_statistics(messages: DataFrame) -> DataFrame:
    """Counts and mean lengths of each conversation, straight from message rows: one aggregate, no arrays."""
    own = lambda r: F.col("role") == r
    mean = lambda r: F.coalesce(F.avg(F.when(own(r), F.length("text"))), F.lit(0.0))
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("turn_count"),
        F.count("*").alias("message_count"),
        F.count_if(own("user")).alias("user_message_count"),
        F.count_if(own("assistant")).alias("assistant_message_count"),
        F.round(mean("user"), 6).alias("avg_user_message_length"),
        F.round(mean("assistant"), 6).alias("avg_assistant_message_length"),
    )


def dataset_summary(messages: DataFrame, user: Column) -> DataFrame:
    """One row: conversations, users, messages, and the mean, least and most turns; zeros for an empty input."""
    return summed_up(messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(user).alias("user_id")))


def summed_up(turns: DataFrame) -> DataFrame:
    """The summary of conversations (n: turns, user_id)."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return turns.agg(
        F.count("*").alias("conversations"),
        F.count_distinct("user_id").alias("users"),
        zero(F.sum("n")).alias("messages"),
        F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("avg_turns"),
        zero(F.min("n")).alias("min_turns"),
        zero(F.max("n")).alias("max_turns"),
    )


def enriched(conversations: DataFrame, facets: DataFrame, assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """Conversations with what is known of them as JSON; parts that are missing leave their key out."""
    out = conversations.join(facets, "conversation_id", "left").join(assignments, "conversation_id", "left").join(labels, "cluster_id", "left")
    cluster = F.when(F.col("cluster_id").isNotNull(), F.struct("cluster_id", "name"))
    return out.select("conversation_id", F.to_json(F.struct(F.col("facets"), cluster.alias("clustering")), {"ignoreNullFields": "true"}).alias("analysis"))


def _ranged(df: DataFrame, order: str) -> DataFrame:
    """Adds parley_range: the rank of a range of the numeric column ``order`` that holds about an equal part of the rows; nulls and NaN come last."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = df.select(F.col(order).cast("double").alias("at"))
    cuts = at.stat.approxQuantile("at", [i / parts for i in range(1, parts)], 0.5 / parts) if parts > 1 else []
    splits = [float("-inf"), *sorted({0.0, *cuts}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="parley_at", outputCol="parley_range", handleInvalid="keep").transform(df.withColumn("parley_at", F.col(order).cast("double"))).drop("parley_at")
    return ranged.withColumn("parley_range", F.coalesce("parley_range", F.lit(float(len(splits)))))


def numbered_within(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds parley_n: the number of a row, from 1, among those with its ``keys`` by the numeric column ``order``, rows without
    an order after all others (and among themselves in no order). Null keys are a key.

    Rows are counted within ranges of values, and then over the counts of the ranges, so no task sees all rows of a key.
    """
    ranged = _ranged(df, order)
    ranged = ranged.withColumn("parley_n", F.row_number().over(Window.partitionBy(*keys, "parley_range").orderBy(F.col(order).asc_nulls_last())))
    counts = ranged.groupBy(*[F.col(k).alias(f"parley_{k}") for k in keys], F.col("parley_range").alias("parley_at")).agg(F.count("*").alias("parley_rows"))
    own = Window.partitionBy(*[f"parley_{k}" for k in keys]).orderBy("parley_at")  # as many rows of a key as there are ranges
    before = counts.withColumn("parley_before", F.sum("parley_rows").over(own) - F.col("parley_rows")).drop("parley_rows")
    on = F.col("parley_range") == F.col("parley_at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"parley_{k}"))
    out = ranged.join(before, on).withColumn("parley_n", F.col("parley_before") + F.col("parley_n"))
    return out.drop("parley_range", "parley_at", "parley_before", *[f"parley_{k}" for k in keys])


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch: rows by the numeric column ``order``, ``size`` to a batch; ranks are counted in ranges, so no task sees all rows."""
    return numbered_within(df, [], order).withColumn("batch", F.floor((F.col("parley_n") - 1) / size)).drop("parley_n")


def ordinals(df: DataFrame, *order: str | Column) -> DataFrame:
    """Adds parley_n, the place of each row from 0: by ``order``, or as the rows stand if it is left out. No task sees more than its part.

    Rows are written down with the number of their part and their place in it; parts are few, and their sizes give where each begins.
    """
    held = stage((df.orderBy(*order) if order else df).withColumn("parley_at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("parley_at", 33), F.col("parley_at").bitwiseAND((1 << 33) - 1)
    sizes = held.groupBy(part.alias("parley_part")).agg(F.count("*").alias("n")).orderBy("parley_part").collect()
    starts, before = [], 0
    for r in sizes:
        starts.append((r["parley_part"], before))
        before += r["n"]
    table = df.sparkSession.createDataFrame(starts, "parley_part long, parley_start long")
    out = held.withColumn("parley_part", part).join(F.broadcast(table), "parley_part")
    return out.withColumn("parley_n", F.col("parley_start") + place).drop("parley_at", "parley_part", "parley_start")


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """The n-th row of ``left`` beside the n-th of ``right``, as rows stand: position, and the columns of both, of unlike names. Unequal lengths
    are an error. The sides meet in one shuffle, by position."""
    side = lambda df, this, other: ordinals(df).select(F.col("parley_n").alias("position"), F.struct(*df.columns).alias(this), F.lit(None).cast(other_type(other)).alias("parley_other"))
    other_type = lambda df: df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType
    a = side(left, "a", right).withColumnRenamed("parley_other", "b")
    b = side(right, "b", left).withColumnRenamed("parley_other", "a")
    lengths = [d.count() for d in (a, b)]
    if lengths[0] != lengths[1]:
        raise ValueError(f"{lengths[0]} rows cannot be paired with {lengths[1]}")
    met = a.unionByName(b).groupBy("position").agg(F.first("a", True).alias("a"), F.first("b", True).alias("b"))
    return met.select("position", "a.*", "b.*")


def reconcile(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """(key, status) of what a batch gave back: ok, duplicate, unexpected or missing."""
    got = returned.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key, F.lit(True).alias("wanted")).distinct().join(got, key, "full_outer")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return both.select(key, status.alias("status"))


def remaining(selected: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return selected.join(processed.select(key), key, "left_anti")


def first_of_each(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, by an aggregate that combines before the shuffle."""
    names = df.columns
    return df.groupBy(*key).agg(F.min_by(F.struct(*names), order).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in names])


def lead_sample(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rank") <= n)


def audit_text(kind: str, df: DataFrame) -> DataFrame:
    """(stage, id, content) of what an auditor reads: raw transcripts, facets or clusters."""
    content = {
        "raw_conversation": lambda: transcript(F.col("messages")),
        "facet_summary": lambda: F.concat(F.lit("summary="), "summary", F.lit("\ntask="), "task", F.lit("\nlanguage="), "language", F.lit("\nturn_count="), F.col("turn_count").cast("string")),
        "cluster_summary": lambda: F.concat("name", F.lit(": "), "description"),
    }[kind]()
    return df.select(F.lit(kind).alias("stage"), F.col(df.columns[0]).cast("string").alias("id"), content.alias("content"))


def last_of_each(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``: what counts of partial results that were written again."""
    names = df.columns
    return df.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in names])


def resumed(partial: DataFrame, expected: DataFrame, key: str, order: str) -> DataFrame:
    """The last partial row of each key that is still expected."""
    return last_of_each(partial, [key], order).join(expected.select(key), key, "left_semi")


def length_faults(df: DataFrame, key: str, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, fault) of texts outside their length: ``limits`` maps a column to its least and largest number of characters; nulls are faults."""
    wrong = [F.when(~F.coalesce(F.length(c).between(low, high), F.lit(False)), F.lit(c)) for c, (low, high) in limits.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*wrong))).alias("fault"))


def limited(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first ``n`` rows by ``order``: what a limit selects before any filter."""
    return df if n is None else df.orderBy(order).limit(n)


def unresolved(errors: DataFrame, succeeded: DataFrame, key: str) -> DataFrame:
    """Errors whose key did not succeed later."""
    return errors.join(succeeded.select(key).distinct(), key, "left_anti")


def semi_or_all(df: DataFrame, having: DataFrame, key: str) -> DataFrame:
    """The rows whose key ``having`` knows; all rows if there are none."""
    found = df.join(having.select(key).distinct(), key, "left_semi")
    return found if found.limit(1).count() else df


def joined_or_error(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right``, of one row for each key; a key that ``right`` lacks is an error when the rows are read."""
    known = right.withColumn("parley_known", F.lit(True))
    out = left.join(known, key, "left")
    there = F.when(F.col("parley_known").isNull(), F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return out.where(there.cast("boolean")).drop("parley_known")


def in_order_of(df: DataFrame, ordinals: DataFrame, key: str, order: str) -> DataFrame:
    """Adds the ordinal that each key had on input, by which results are put in order again."""
    return df.join(ordinals.select(key, F.col(order).alias("ordinal")), key)


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def detail(conversation_id: object, enriched: DataFrame, facets: DataFrame, assignments: DataFrame, labels: DataFrame, source: DataFrame) -> DataFrame:
    """What is known of one conversation: facts of the enriched table first, then of facets, assignments, labels and the input.

    ``enriched`` (conversation_id, messages, summary, cluster_id, cluster_name), ``facets`` (conversation_id, summary), ``assignments``
    (conversation_id, cluster_id, user_id), ``labels`` (cluster_id, name), ``source`` (conversation_id, user_id, messages).
    """
    own = lambda df, **names: df.where(F.col("conversation_id") == F.lit(conversation_id)).select("conversation_id", *[F.col(c).alias(n) for n, c in names.items()])
    out = own(source, source_user="user_id", source_messages="messages").join(own(enriched, messages="messages", own_summary="summary", own_cluster="cluster_id", own_name="cluster_name"), "conversation_id", "full_outer")
    out = out.join(own(facets, facet_summary="summary"), "conversation_id", "full_outer").join(own(assignments, given="cluster_id", given_user="user_id"), "conversation_id", "full_outer")
    out = out.withColumn("cluster_id", F.coalesce("own_cluster", "given")).join(labels.select("cluster_id", "name"), "cluster_id", "left")
    first = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    return out.select("conversation_id", first("given_user", "source_user").alias("user_id"), F.coalesce("messages", "source_messages").alias("messages"), first("own_summary", "facet_summary").alias("summary"), "cluster_id", first("own_name", "name").alias("cluster_name"))


def cluster_conversations(cluster_id: int, assignments: DataFrame, facets: DataFrame, source: DataFrame) -> DataFrame:
    """The conversations of a cluster with what facets and the input know of them, the latest first, then by id.

    The user is that of the assignment, or else of the input; parts that are missing are null.
    """
    own = assignments.where(F.col("cluster_id") == cluster_id).select("conversation_id", F.col("user_id").alias("given"))
    out = own.join(facets, "conversation_id", "left").join(source.select("conversation_id", F.col("user_id").alias("known"), "timestamp"), "conversation_id", "left")
    user = F.coalesce(F.nullif("given", F.lit("")), F.nullif("known", F.lit("")), F.lit(""))
    kept = [c for c in facets.columns if c != "conversation_id"]
    return out.select("conversation_id", user.alias("user_id"), "timestamp", *kept).orderBy(F.desc_nulls_last("timestamp"), "conversation_id")


#: The least and the largest length of texts that a model gives.
LENGTHS = {"name": (1, 120), "description": (1, 500), "justification": (1, 1000)}


def facet_faults(facets: DataFrame, key: str) -> DataFrame:
    """(key, fault) of facets outside their contract: language_confidence from 0 to 1, concerning_score from 1 to 5; nulls are faults."""
    sure, score = F.col("language_confidence"), F.col("concerning_score")
    wrong = lambda ok: ~F.coalesce(ok, F.lit(False))
    faults = F.array_compact(F.array(F.when(wrong(sure.between(0, 1)), "language_confidence"), F.when(wrong(score.between(1, 5)), "concerning_score")))
    return facets.select(key, F.explode(faults).alias("fault"))


def representations(corpus: DataFrame) -> DataFrame:
    """conversation_id and the texts by which topics may be found again: two summaries, and the first message of the user or ''."""
    first = F.coalesce(F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"], F.lit(""))
    return corpus.select("conversation_id", "privacy_summary", "non_private_summary", first.alias("raw_user_text"))


def first_user_message(messages: DataFrame) -> DataFrame:
    """(conv_id, text): the first message of the user in each conversation, empty if there is none."""
    own = F.col("role") == "user"
    return messages.groupBy("conv_id").agg(F.coalesce(F.min_by(F.when(own, F.col("text")), F.when(own, F.col("turn"))), F.lit("")).alias("text"))
