"""Conversations from JSON lines: validating and strict scans, discovery of keys, normalisation, and its report.

Lines come as a DataFrame (line_number: long, line: string); ``read_lines`` makes one from files. Repeated keys of a JSON object
count with their last value; the scans set ``spark.sql.variant.allowDuplicateKeys`` in the session for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.text import role_of, strip, synthetic_id, time_of
from parley.operators.conversations import batches, numbered_within
from parley.sources.store import stage

#: The keys of a conversation and of a message.
REQUIRED = {"conversation_id": "STRING", "user_id": "STRING"}
KEYS = ("schema_version", "conversation_id", "user_id", "timestamp", "messages", "metadata")
#: Keys that may stand for a role and for a content, the first found counts.
ROLE_KEYS = ("role", "speaker", "author", "type", "from")
CONTENT_KEYS = ("content", "text", "body", "message", "value")


#: Keys that may stand for a field of a conversation, in the order in which they are tried.
CANDIDATES = {
    "conversation_id": ("conversation_id", "chat_id", "chatId", "thread_id", "threadId", "id", "_id", "session_id", "sessionId", "convo_id"),
    "user_id": ("user_id", "userId", "userHash", "user_hash", "uid", "author_id", "authorId", "account_id", "accountId"),
    "timestamp": ("timestamp", "created_at", "createdAt", "start_time", "startTime", "ts", "date", "datetime", "created", "updatedAt", "updated_at"),
    "messages": ("messages", "turns", "conversation", "exchanges", "chat", "dialog", "dialogue", "history"),
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, numbered from 1 over all files in the order of their paths.

    Lines are numbered within each block of a file as it is read, and these numbers are written down; then the counts of the
    blocks, one row for each, say how many lines stand before a block.
    """
    read = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    read = stage(read, "lines")
    blocks = read.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = blocks.select("file", "block", "first", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))
    return read.join(before, ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line_number"), "line")


def _typed(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def repeated_keys(spark: SparkSession) -> None:
    """From now on JSON objects of the session may repeat a key."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parsed(lines: DataFrame) -> DataFrame:
    """line_number, line (stripped), v (null for bad JSON) and is_object of the lines that are not blank."""
    repeated_keys(lines.sparkSession)
    held = lines.select("line_number", strip(F.col("line")).alias("line")).where("line <> ''").withColumn("v", F.try_parse_json("line"))
    return held.withColumn("is_object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))


def _coded(lines: DataFrame) -> DataFrame:
    """The codes of ``checked`` that a line has by itself."""
    held = parsed(lines)
    keys = F.json_object_keys("line")
    text = lambda k: F.coalesce(_typed(F.col("v"), f"$.{k}") == "STRING", F.lit(False))
    optional = lambda k, kinds: F.coalesce(_typed(F.col("v"), f"$.{k}").rlike(kinds), F.lit(True))
    messages = F.try_variant_get("v", "$.messages", "array<variant>")
    sound = F.forall(messages, lambda m: F.schema_of_variant(m) == "OBJECT<content: STRING, role: STRING>")
    when = F.try_variant_get("v", "$.timestamp", "string")
    fits = text("conversation_id") & text("user_id") & optional("schema_version", "^(STRING|VOID)$") & optional("metadata", "^OBJECT")
    fits = fits & (F.size(F.array_except(keys, F.array(*map(F.lit, KEYS)))) == 0) & ~time_of(when)[1] & F.coalesce(sound, F.lit(False))
    code = F.when(F.col("v").isNull(), "invalid_json").when(~F.col("is_object"), "non_object_line").when(~fits, "schema_validation_failed")
    return held.select("line_number", "line", F.when(code.isNull(), F.try_variant_get("v", "$.conversation_id", "string")).alias("conversation_id"), code.alias("code"))


def sound(lines: DataFrame) -> DataFrame:
    """line_number, line and conversation_id of valid lines, also of a stream; ids may repeat."""
    return _coded(lines).where("code is null").drop("code")


def checked(lines: DataFrame) -> DataFrame:
    """line_number, line, conversation_id and code: null for a valid line, else what is wrong; blank lines are left out.

    Codes: invalid_json, non_object_line, schema_validation_failed, duplicate_conversation_id. Of valid lines with one id the
    first stays valid. A message is an object of role and content, both strings; metadata is an object where it is given.
    """
    held = _coded(lines)
    first = held.where("code is null").groupBy("conversation_id").agg(F.min("line_number").alias("first"))
    held = held.join(first, "conversation_id", "left")
    return held.select("line_number", "line", "conversation_id", F.when(F.col("line_number") > F.col("first"), "duplicate_conversation_id").otherwise(F.col("code")).alias("code"))


def conversations_of(found: DataFrame) -> DataFrame:
    """Typed conversations from valid lines."""
    repeated_keys(found.sparkSession)
    v, at = F.try_parse_json("line"), lambda k: F.get_json_object("line", f"$.{k}")
    messages = F.transform(F.try_variant_get(v, "$.messages", "array<variant>"), lambda m: F.struct(F.try_variant_get(m, "$.role", "string").alias("role"), F.try_variant_get(m, "$.content", "string").alias("content")))
    time = time_of(F.try_variant_get(v, "$.timestamp", "string"))[0]
    return found.select("line_number", "conversation_id", F.try_variant_get(v, "$.user_id", "string").alias("user_id"), time.alias("timestamp"), messages.alias("messages"), F.coalesce(at("metadata"), F.lit("{}")).alias("metadata"))


def strict(lines: DataFrame) -> DataFrame:
    """The conversations of lines that are all valid; the first wrong line, or an input without any, is an error."""
    found = stage(checked(lines), "checked")
    wrong = found.where("code is not null").orderBy("line_number").limit(1).collect()
    if wrong:
        raise ValueError(f"line {wrong[0]['line_number']}: {wrong[0]['code']}")
    if not found.limit(1).count():
        raise ValueError("empty_dataset")
    return conversations_of(found)


def chunks(lines: DataFrame, size: int = 200, limit: int | None = None) -> DataFrame:
    """Strictly scanned conversations with their batch of ``size``; of the first ``limit`` lines that are not blank: later ones are
    not even looked at."""
    if size < 1 or (limit is not None and limit < 1):
        raise ValueError("size and limit are positive")
    if limit is not None:
        lines = lines.where(strip(F.col("line")) != "").orderBy("line_number").limit(limit)
    return batches(strict(lines), "line_number", size)


def records(lines: DataFrame) -> DataFrame:
    """Lines that are objects; other JSON is passed over, and bad JSON is an error when the rows are read."""
    held = parsed(lines)
    sound = F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("bad JSON in line "), F.col("line_number").cast("string")))).otherwise(F.col("is_object"))
    return held.where(sound.cast("boolean")).select("line_number", "line")


def capped(lines: DataFrame, most: int = 400) -> DataFrame:
    """The first ``most`` objects; nothing at all if a line before the last of them is bad JSON."""
    held = parsed(lines).select("line_number", "line", "is_object", F.col("v").isNull().alias("bad"))
    first = stage(held.where("is_object").orderBy("line_number").limit(most).select("line_number", "line"), "capped")
    last = first.agg(F.count("*").alias("n"), F.max("line_number").alias("last")).first()
    bad = held.where("bad")
    if last["n"] >= most:
        bad = bad.where(F.col("line_number") < last["last"])
    return first.limit(0) if bad.limit(1).count() else first


def object_or_empty(text: Column) -> Column:
    """The text of a JSON object; ``{}`` for anything else. Repeated keys are allowed, whatever the session had set."""
    repeated_keys(SparkSession.active())
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text).otherwise(F.lit("{}"))


def errors(lines: DataFrame, max_errors: int = 100) -> DataFrame:
    """The first ``max_errors`` wrong lines."""
    return checked(lines).where("code is not null").select("line_number", "code").orderBy("line_number").limit(max_errors)


def validation_report(lines: DataFrame, max_errors: int = 100) -> DataFrame:
    """One row of counts; an input without a non-empty line has the one error empty_dataset."""
    total = lines.agg(F.count("*").alias("total_lines"))
    counts = checked(lines).agg(
        F.count("*").alias("non_empty_lines"),
        F.count_if(F.col("code").isNull()).alias("valid_lines"),
        F.count_if(F.col("code") == "duplicate_conversation_id").alias("duplicates"),
        F.count("code").alias("found"),
    )
    both = total.join(F.broadcast(counts), F.lit(True))
    n = F.when(F.col("non_empty_lines") == 0, F.lit(1)).otherwise(F.col("found"))
    kept = F.least(n, F.lit(max_errors))
    return both.select(
        "total_lines", "non_empty_lines", "valid_lines", (F.col("non_empty_lines") - F.col("valid_lines")).alias("invalid_lines"), "duplicates", n.alias("errors"), kept.cast("long").alias("retained"), (n - kept).cast("long").alias("dropped")
    )


def sampled(lines: DataFrame, sample: int = 200) -> DataFrame:
    """The first ``sample`` lines that are objects."""
    return parsed(lines).where("is_object").orderBy("line_number").limit(sample)


def detect_keys(lines: DataFrame, candidates: list[str], sample: int = 200) -> DataFrame:
    """(key, n, found): in how many of the first ``sample`` objects a dotted key is not null; found if in more than half."""
    found = sampled(lines, sample).select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.get_json_object("line", f"$.{k}").isNotNull().alias("there")) for k in candidates])).alias("x"))
    return found.groupBy("x.key").agg(F.count_if("x.there").alias("n"), (2 * F.count_if("x.there") > F.count("*")).alias("found"))


def discover(lines: DataFrame, sample: int = 200) -> dict[str, str | None]:
    """The key of each field: the first candidate that more than half of the sample have. Messages must be arrays that begin with an
    object; the keys of role and content are those of the first message of the sample. Without any object no key is found."""
    held = stage(sampled(lines, sample).select("line_number", "line"), "sample")
    n = held.count()
    v = F.try_parse_json("line")
    has = lambda k: F.get_json_object("line", f"$.{k}").isNotNull()
    lists = lambda k: F.coalesce(_typed(v, f"$.{k}[0]").startswith("OBJECT"), F.lit(False))
    tests = {(f, k): F.count_if(lists(k) if f == "messages" else has(k)) for f, keys in CANDIDATES.items() for k in keys}
    hits = held.agg(*[c.alias(f"c{i}") for i, c in enumerate(tests.values())]).first()
    out: dict[str, str | None] = {}
    for f, keys in CANDIDATES.items():
        out[f] = next((k for k in keys if 2 * hits[f"c{[*tests].index((f, k))}"] > n), None)
    out |= {"role": "role", "content": "content"}
    if out["messages"]:
        first = held.where(lists(out["messages"])).orderBy("line_number").select(F.json_object_keys(F.get_json_object("line", f"$.{out['messages']}[0]")).alias("keys")).first()
        for name, others in (("role", ROLE_KEYS), ("content", CONTENT_KEYS)):
            out[name] = next((k for k in others if k in first["keys"]), name)
    return out


def leftover_keys(line: Column, used: list[str]) -> Column:
    """Top-level keys that are not used, sorted."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(line), F.array().cast("array<string>")), F.array(*map(F.lit, used))))


def unique_ids(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """Adds unique_id: an id that occurs again gets _dup1, _dup2, ... in the order of the numbers ``order``; names that exist are left
    out: the n-th repeat gets the n-th number that no id of the input has.

    Repeats are numbered in ranges of ``order`` and over the counts of the ranges, so that a hot id is no single task.
    """
    numbered = numbered_within(df, [id_col], order).withColumn("parley_n", F.col("parley_n") - 1)
    stem = F.regexp_replace(id_col, r"_dup[0-9]+$", "")
    number = F.regexp_extract(id_col, r"_dup([0-9]+)$", 1).try_cast("long")
    taken = df.where(F.col(id_col).rlike(r"_dup[1-9][0-9]*$")).select(stem.alias("stem"), number.alias("k")).where("k is not null").distinct()
    # A number k that is taken, the i-th of its stem, moves all repeats from k - i + 1 on one further.
    rank = F.row_number().over(Window.partitionBy("stem").orderBy("k"))
    steps = taken.withColumn("from", F.col("k") - rank + 1).groupBy("stem").agg(F.array_sort(F.collect_list("from")).alias("steps"))
    numbered = numbered.join(steps, numbered[id_col] == steps.stem, "left")
    moved = F.col("parley_n") + F.coalesce(F.size(F.filter("steps", lambda s: s <= F.col("parley_n"))), F.lit(0))
    unique = F.when(F.col("parley_n") == 0, F.col(id_col)).otherwise(F.concat(id_col, F.lit("_dup"), moved.cast("string")))
    return numbered.withColumn("unique_id", unique).drop("parley_n", "stem", "steps")


def _told(messages: Column, mapping: dict[str, str | None]) -> Column:
    """role and content (may be null or empty) of the messages of a JSON array, by the mapped keys or the first that are found."""
    roles, contents = ((mapping[k],) if mapping.get(k) else names for k, names in (("role", ROLE_KEYS), ("content", CONTENT_KEYS)))
    kind = f"array<struct<{','.join(f'`{k}`:string' for k in dict.fromkeys((*roles, *contents)))}>>"
    pick = lambda m, keys: F.coalesce(*[F.nullif(m[k], F.lit("")) for k in keys])
    return F.transform(F.from_json(messages, kind), lambda m: F.struct(role_of(pick(m, roles)).alias("role"), strip(pick(m, contents)).alias("content")))


def normalization_report(lines: DataFrame, mapping: dict[str, str | None], most: int = 20) -> DataFrame:
    """One row of counts over a normalisation: lines, parsed, written, rejected, ids that were there before, missing times and users,
    the roles of kept messages as ``role:n`` (0 for roles of empty messages only), and the first ``most`` errors as ``line:reason``."""
    at = lambda k: F.get_json_object("line", f"$.{mapping[k]}") if mapping.get(k) else F.lit(None).cast("string")
    rows, rejects = (stage(x, "normalized") for x in normalized(lines, mapping))
    held = parsed(lines)
    objects = held.where("is_object").withColumn("id", F.nullif(strip(at("conversation_id")), F.lit("")))
    totals = lines.agg(F.count("*").alias("total_lines"))
    ids = objects.agg(F.count("*").alias("parsed_lines"), (F.count("id") - F.count_distinct("id")).alias("duplicate_ids"))
    written = rows.agg(F.count("*").alias("output_lines"), F.count_if("timestamp_synthetic").alias("missing_timestamps"), F.count_if(F.col("user_id") == "unknown_user").alias("missing_users"))
    roles = objects.select(F.explode(_told(at("messages"), mapping)).alias("m")).where("m.role is not null").groupBy("m.role").agg(F.count_if(F.coalesce(F.col("m.content"), F.lit("")) != "").alias("n"))
    roles = roles.agg(F.array_join(F.array_sort(F.collect_list(F.concat("role", F.lit(":"), F.col("n").cast("string")))), ",").alias("roles"))
    first = rejects.orderBy("line_number").limit(most)
    errors = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "reason"))), lambda x: F.concat(x["line_number"].cast("string"), F.lit(":"), x["reason"])), ",").alias("errors"))
    out = totals
    for part in (ids, written, rejects.agg(F.count("*").alias("rejected_lines")), roles, errors):  # one row each
        out = out.join(F.broadcast(part), F.lit(True))
    return out


def normalized(lines: DataFrame, mapping: dict[str, str | None]) -> tuple[DataFrame, DataFrame]:
    """(conversations, rejects) from lines of another layout; mapping: conversation_id, user_id, timestamp, messages to dotted keys,
    and role and content to those of messages (without them the first known ones that are found).

    An id is used up before its messages are looked at. A missing id is made from the line, a missing user is unknown_user, a
    missing time is the epoch.
    """
    repeated_keys(lines.sparkSession)
    at = lambda k: F.get_json_object("line", f"$.{mapping[k]}") if mapping.get(k) else F.lit(None).cast("string")
    held = lines.select("line_number", strip(F.col("line")).alias("line")).where("line <> ''").withColumn("v", F.try_parse_json("line"))
    held = held.withColumn("reason", F.when(F.col("v").isNull(), "invalid_json").when(~F.schema_of_variant("v").startswith("OBJECT"), "non_object_line"))
    objects = held.where("reason is null").withColumn("id", F.coalesce(F.nullif(strip(at("conversation_id")), F.lit("")), synthetic_id(F.col("line"))))
    objects = unique_ids(objects, "id", "line_number")
    messages = F.filter(_told(at("messages"), mapping), lambda m: m["role"].isNotNull() & (m["content"] != ""))
    time, missing = time_of(at("timestamp"))
    objects = objects.withColumn("messages", messages)
    wrong = F.coalesce(F.size("messages") <= 0, F.lit(True))
    rows = objects.where(~wrong).select(
        "line_number",
        F.col("unique_id").alias("conversation_id"),
        F.coalesce(F.nullif(at("user_id"), F.lit("")), F.lit("unknown_user")).alias("user_id"),
        time.alias("timestamp"),
        missing.alias("timestamp_synthetic"),
        "messages",
        leftover_keys(F.col("line"), [mapping[k] for k in CANDIDATES if mapping.get(k)]).alias("source_payload_keys"),
    )
    rejects = held.where("reason is not null").select("line_number", "reason", "line").unionByName(objects.where(wrong).select("line_number", F.lit("no_valid_messages").alias("reason"), "line"))
    return rows, rejects.select("line_number", "reason", F.substring("line", 1, 500).alias("raw_line"))
