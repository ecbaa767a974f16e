"""Queries of the conversation analytics engine, and the SQL that they are held against.

The driver's tables stand in for an engine's own: ``conversations`` holds messages, ``embeddings`` vectors with a label as their
cluster, ``events`` a log of runs (run = user_id % 50, phase = event_id % 7), region - nation - customer a tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import clustering, conversations, density, evaluate, hierarchy, privacy, providers, runs, vectors
from parley.sources import jsonl
from parley.streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


STATUS = {"click": "running", "purchase": "completed", "error": "failed", "signup": "skipped", "view": "warning"}


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")]
    phase = F.element_at(F.array(*map(F.lit, runs.PHASES)), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select((F.col("user_id") % 50).alias("run_id"), "event_id", "ts", phase.alias("phase"), status.alias("status"))


_EVENTS = f"""ev AS (SELECT user_id % 50 AS run_id, event_id, ts, ['{"', '".join(runs.PHASES)}'][event_id % 7 + 1] AS phase,
 CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())} END AS status FROM events)"""
_LATEST = _EVENTS + ", latest AS (SELECT run_id, phase, arg_max(status, (ts, event_id)) AS status FROM ev GROUP BY ALL)"
_STATES = _LATEST + """, states AS (SELECT run_id, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'failed') THEN 'failed'
 WHEN bool_or(status = 'warning') THEN 'completed_with_warnings' WHEN bool_or(status = 'completed') THEN 'completed' ELSE 'partial' END AS state FROM latest GROUP BY run_id)"""
_SPINE = _LATEST + f""", spine AS (SELECT run_id, i::INTEGER - 1 AS ordinal, ['{"', '".join(runs.PHASES)}'][i] AS phase FROM (SELECT DISTINCT run_id FROM ev), range(1, 8) AS r(i)),
 line AS (SELECT run_id, ordinal, phase, coalesce(status, 'pending') AS status FROM spine LEFT JOIN latest USING (run_id, phase))"""
_V = "p AS (SELECT vec_id, label::INTEGER AS label, embedding::DOUBLE[] AS v FROM embeddings)"
_LONG = _V + ", l AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM p)"
_CENTERS = _LONG + ", c AS (SELECT label, list(m ORDER BY d) AS center, any_value(n) AS n FROM (SELECT label, d, avg(x) AS m, count(*) AS n FROM l GROUP BY ALL) GROUP BY label)"
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query("SELECT count(*) AS conversations, count(DISTINCT u) AS users, sum(n)::BIGINT AS messages, round(avg(n), 6) AS avg_turns, min(n) AS min_turns, max(n) AS max_turns FROM (SELECT conv_id, conv_id % 40 AS u, count(*) AS n FROM conversations GROUP BY ALL)")
def dataset_summary(spark, sf_dir):
    return conversations.dataset_summary(messages(spark, sf_dir), F.col("conv_id") % 40)


@query("""SELECT conv_id, count(*) AS turn_count, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_message_count,
 count(*) FILTER (role = 'assistant') AS assistant_message_count, round(coalesce(avg(length(text)) FILTER (role = 'user'), 0), 6) AS avg_user_message_length,
 round(coalesce(avg(length(text)) FILTER (role = 'assistant'), 0), 6) AS avg_assistant_message_length FROM conversations GROUP BY conv_id""")
def facet_stats(spark, sf_dir):
    return conversations.facet_statistics(messages(spark, sf_dir))


@query("SELECT conv_id AS conversation_id, md5(string_agg(role || '|' || text, chr(10) ORDER BY turn)) AS digest, count(*)::INTEGER AS n, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id")
def messages_only(spark, sf_dir):
    held = conversations.assemble(messages(spark, sf_dir))
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit("|"), m["content"]))
    return held.select("conversation_id", F.md5(F.array_join(line, "\n")).alias("digest"), F.size("messages").alias("n"), F.col("messages")[0]["content"].alias("first_text"))


@query("SELECT conv_id AS conversation_id, md5(string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn)) AS plain, md5(string_agg(n || '. ' || upper(role) || ': ' || text, chr(10) ORDER BY turn)) AS numbered FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def transcript_render(spark, sf_dir):
    held = conversations.assemble(messages(spark, sf_dir))
    return held.select("conversation_id", F.md5(conversations.transcript(F.col("messages"))).alias("plain"), F.md5(conversations.transcript(F.col("messages"), True)).alias("numbered"))


def defective_lines(spark, sf_dir):
    """Lines of conversations with defects by conv_id % 10."""
    held = conversations.assemble(messages(spark, sf_dir)).withColumn("k", F.col("conversation_id") % 10)
    n, k = F.col("conversation_id"), F.col("k")
    name = F.when((k == 3) & (n >= 10), n - 4).otherwise(n).cast("string")
    user = F.when(k == 2, "").otherwise('"user_id":"u",')
    said = F.when(k == 4, '[{"role":"user","content":5}]').when(k == 7, '[{"role":"user","content":{"k":1}}]').otherwise(F.to_json("messages"))
    tail = F.when(k == 5, ',"extra":"x"').when(k == 6, ',"metadata":null').when(k == 8, ',"user_id":"v"').otherwise("")
    row = F.concat(F.lit('{"conversation_id":"c-'), name, F.lit('",'), user, F.lit('"timestamp":"2025-01-01T00:00:00Z","messages":'), said, tail, F.lit("}"))
    return held.select((n + 1).alias("line_number"), F.when(k == 0, F.lit("{not json")).when(k == 1, F.lit("[]")).otherwise(row).alias("line"))


_CODES = "SELECT DISTINCT conv_id + 1 AS line_number, CASE WHEN conv_id % 10 = 0 THEN 'invalid_json' WHEN conv_id % 10 = 1 THEN 'non_object_line' WHEN conv_id % 10 IN (2, 4, 5, 6, 7) THEN 'schema_validation_failed' WHEN conv_id % 10 = 3 AND conv_id >= 10 THEN 'duplicate_conversation_id' END AS code FROM conversations"


@query(f"SELECT line_number, code FROM ({_CODES}) WHERE code IS NOT NULL ORDER BY line_number LIMIT 100")
def contract_errors(spark, sf_dir):
    return jsonl.errors(defective_lines(spark, sf_dir))


@query(f"SELECT count(*) AS total_lines, count(*) AS non_empty_lines, count(*) - count(code) AS valid_lines, count(code) AS invalid_lines, count(*) FILTER (code = 'duplicate_conversation_id') AS duplicates, count(code) AS errors, least(100, count(code))::BIGINT AS retained, greatest(0, count(code) - 100)::BIGINT AS dropped FROM ({_CODES})")
def contract_report(spark, sf_dir):
    return jsonl.validation_report(defective_lines(spark, sf_dir))


def external_lines(spark, sf_dir):
    """Lines of another layout: every third id is missing, every fifth repeats the one before, every seventh has no content."""
    held = conversations.assemble(messages(spark, sf_dir))
    n = F.col("conversation_id")
    name = F.when(n % 3 != 0, F.concat(F.lit("x"), F.when(n % 5 == 0, n - 1).otherwise(n).cast("string")))
    alias = F.when(n % 7 != 0, F.transform("messages", lambda m: F.struct(F.when(m["role"] == "user", F.lit("Human")).otherwise(m["role"]).alias("from"), m["content"].alias("value"))))
    row = F.to_json(F.struct(name.alias("id"), F.lit("h").alias("userHash"), F.lit(1700000000).alias("createdAt"), alias.alias("messages"), F.lit("t").alias("title")))
    return held.select((n + 1).alias("line_number"), row.alias("line"))


MAPPING = {"conversation_id": "id", "user_id": "userHash", "timestamp": "createdAt", "messages": "messages"}
_EXTERNAL = """b AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS users, CASE WHEN conv_id % 3 <> 0 THEN 'x' || CASE WHEN conv_id % 5 = 0 THEN conv_id - 1 ELSE conv_id END END AS id FROM conversations GROUP BY conv_id),
 r AS (SELECT *, CASE WHEN id IS NOT NULL THEN id || CASE WHEN row_number() OVER (PARTITION BY id ORDER BY conv_id) > 1 THEN '_dup' || (row_number() OVER (PARTITION BY id ORDER BY conv_id) - 1) ELSE '' END END AS u FROM b)"""


@query(f"WITH {_EXTERNAL} SELECT conv_id + 1 AS line_number, coalesce(u, 'synth') AS conversation_id, 'h' AS user_id, n::INTEGER AS n_messages, users::INTEGER AS n_users, '2023-11-14 22:13:20' AS ts, 'title' AS leftover FROM r WHERE conv_id % 7 <> 0")
def normalize_export(spark, sf_dir):
    rows, _ = jsonl.normalized(external_lines(spark, sf_dir), MAPPING)
    name = F.when(F.col("conversation_id").rlike("^synth-[0-9a-f]{16}$"), F.lit("synth")).otherwise(F.col("conversation_id"))
    users = F.size(F.filter("messages", lambda m: m["role"] == "user"))
    return rows.select("line_number", name.alias("conversation_id"), "user_id", F.size("messages").alias("n_messages"), users.alias("n_users"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.array_join("source_payload_keys", ",").alias("leftover"))


@query("SELECT DISTINCT conv_id + 1 AS line_number, 'no_valid_messages' AS reason FROM conversations WHERE conv_id % 7 = 0")
def normalize_rejects(spark, sf_dir):
    return jsonl.normalized(external_lines(spark, sf_dir), MAPPING)[1].select("line_number", "reason")


@query("SELECT conv_id, turn, CASE lower(trim(CASE turn % 4 WHEN 0 THEN ' Human ' WHEN 1 THEN 'AI' WHEN 2 THEN 'tool' ELSE role END)) WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' ELSE lower(trim(CASE turn % 4 WHEN 0 THEN ' Human ' WHEN 1 THEN 'AI' WHEN 2 THEN 'tool' ELSE role END)) END AS role FROM conversations")
def normalize_roles(spark, sf_dir):
    raw = F.when(F.col("turn") % 4 == 0, " Human ").when(F.col("turn") % 4 == 1, "AI").when(F.col("turn") % 4 == 2, "tool").otherwise(F.col("role"))
    return messages(spark, sf_dir).select("conv_id", "turn", text.role_of(raw).alias("role"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN 0 ELSE epoch_ms(date_trunc('second', ts)) END AS ms, event_id % 4 = 3 AS missing FROM events")
def normalize_timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    raw = F.when(F.col("event_id") % 4 == 0, F.col("s").cast("string")).when(F.col("event_id") % 4 == 1, (F.col("s") * 1000).cast("string")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("soon"))
    time, missing = text.time_of(raw)
    return e.select("event_id", F.unix_millis(time).alias("ms"), missing.alias("missing"))


@query(r"SELECT doc_id, 'synth-' || substr(sha256(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')), 1, 16) AS id FROM documents")
def synth_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.synthetic_id(F.coalesce("text", F.lit(""))).alias("id"))


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedupe_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("k"))
    return conversations.first_of_each(d, ["k"], "doc_id").select("doc_id", "source")


@query("SELECT doc_id, md5(text) || CASE WHEN n > 1 THEN '_dup' || (n - 1) ELSE '' END AS unique_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents)")
def dup_suffix(spark, sf_dir):
    return jsonl.unique_ids(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("id")), "id", "doc_id").select("doc_id", "unique_id")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 32)::BIGINT AS batch FROM documents")
def batch_plan(spark, sf_dir):
    return conversations.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32)


@query("SELECT doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN w IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM (SELECT doc_id, true AS w FROM documents WHERE doc_id % 5 <> 0) FULL JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 3 = 0) GROUP BY doc_id) USING (doc_id)")
def batch_reconcile(spark, sf_dir):
    got = table(spark, sf_dir, "labels").select("doc_id")
    return conversations.reconcile(table(spark, sf_dir, "documents").where("doc_id % 5 <> 0"), got.union(got.where("doc_id % 3 = 0")), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf_dir):
    return conversations.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def event_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("line_number"), F.col("props").alias("line"))


@query("SELECT k AS key, count(*) FILTER (json_extract_string(props, '$.' || k) IS NOT NULL) AS n, 2 * count(*) FILTER (json_extract_string(props, '$.' || k) IS NOT NULL) > count(*) AS found FROM (SELECT props FROM events ORDER BY event_id LIMIT 200), (VALUES ('k'), ('id')) AS c(k) GROUP BY k")
def key_detect(spark, sf_dir):
    return jsonl.detect_keys(event_lines(spark, sf_dir), ["k", "id"])


@query("SELECT event_id + 1 AS line_number, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def leftover_keys(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_number", F.array_join(jsonl.leftover_keys(F.col("line"), ["id"]), ",").alias("keys"))


@query("SELECT label::INTEGER AS cluster_id, count(*) AS size, count(DISTINCT vec_id % 37) AS unique_users, count(*) >= 45 AND count(DISTINCT vec_id % 37) >= 20 AS kept_by_threshold FROM embeddings GROUP BY label")
def cluster_rollup_threshold(spark, sf_dir):
    p = points(spark, sf_dir).select(F.col("label").alias("cluster_id"), (F.col("vec_id") % 37).alias("user_id"))
    return clustering.rollup(p, min_users=20, min_conversations=45)


@query(f"WITH {_LONG} SELECT label, (d - 1)::INTEGER AS d, round(avg(x), 6) AS x FROM l GROUP BY label, d")
def centroids(spark, sf_dir):
    c = vectors.centroids(points(spark, sf_dir))
    return c.select("label", F.posexplode("center").alias("d", "x")).withColumn("x", F.round("x", 6))


_NEAREST = "SELECT vec_id, arg_min(c.label, (d2, c.label)) AS nearest, round(min(d2), 6) AS distance2 FROM (SELECT p.vec_id, c.label, {d2} AS d2 FROM p, c) AS c GROUP BY vec_id"


@query(f"WITH {_CENTERS} {_NEAREST.format(d2=_D2.format(a='p.v', b='c.center'))}")
def nearest_centroid(spark, sf_dir):
    p = points(spark, sf_dir)
    return vectors.assigned(p, vectors.centroids(p)).select("vec_id", "nearest", F.round("distance2", 6).alias("distance2"))


def _lloyd_sql(k: int, rounds: int) -> str:
    parts = [_V, f"c0 AS (SELECT vec_id::INTEGER AS label, v AS center FROM p WHERE vec_id < {k})"]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(label, (d2, label)) AS nearest FROM (SELECT p.vec_id, p.v, c.label, {_D2.format(a='p.v', b='c.center')} AS d2 FROM p, c{i} AS c) GROUP BY vec_id)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT label, list(m ORDER BY d) AS center FROM (SELECT nearest AS label, d, avg(x) AS m FROM (SELECT nearest, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i}) GROUP BY ALL) GROUP BY label)")
    return f"WITH {', '.join(parts)} SELECT vec_id, nearest AS label FROM a{rounds}"


@query(_lloyd_sql(10, 3))
def lloyd_k10(spark, sf_dir):
    p = points(spark, sf_dir)
    seeds = p.where("vec_id < 10").select(F.col("vec_id").cast("int").alias("label"), F.col("v").alias("center"))
    return vectors.lloyd(p.drop("label"), seeds, 3).select("vec_id", F.col("nearest").alias("label"))


def noisy(spark, sf_dir):
    return points(spark, sf_dir).withColumn("label", F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")))


@query("SELECT vec_id, (CASE WHEN label = 9 THEN (SELECT max(label) FROM embeddings WHERE label <> 9) + row_number() OVER (PARTITION BY label = 9 ORDER BY vec_id) ELSE label END)::INTEGER AS label FROM embeddings")
def noise_singleton(spark, sf_dir):
    return clustering.with_noise(noisy(spark, sf_dir), "singleton").select("vec_id", "label")


@query("SELECT vec_id, (CASE WHEN label = 9 THEN (SELECT max(label) FROM embeddings WHERE label <> 9) + 1 ELSE label END)::INTEGER AS label FROM embeddings")
def noise_bucket(spark, sf_dir):
    return clustering.with_noise(noisy(spark, sf_dir), "drop").select("vec_id", "label")


@query(f"WITH {_CENTERS}, k AS (SELECT * FROM c WHERE label <> 9), near AS ({_NEAREST.format(d2=_D2.format(a='p.v', b='c.center')).replace('FROM p, c)', 'FROM p, k AS c)')}) SELECT vec_id, CASE WHEN p.label = 9 THEN nearest ELSE p.label END AS label FROM p JOIN near USING (vec_id)")
def noise_nearest(spark, sf_dir):
    return clustering.with_noise(noisy(spark, sf_dir), "nearest").select("vec_id", "label")


@query("SELECT vec_id, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS label FROM embeddings WHERE label % 3 <> 1")
def dense_relabel(spark, sf_dir):
    return clustering.dense_labels(points(spark, sf_dir).where("label % 3 <> 1")).select("vec_id", "label")


@query(f"""WITH {_CENTERS}, m AS (SELECT list(m ORDER BY d) AS mean FROM (SELECT d, avg(x) AS m FROM l GROUP BY d)),
 b AS (SELECT sum(n * {_D2.format(a='center', b='mean')}) AS between_, count(*) AS k, sum(n) AS n FROM c, m), w AS (SELECT sum({_D2.format(a='v', b='center')}) AS within_ FROM p JOIN c USING (label))
 SELECT round((between_ / (k - 1)) / (within_ / (n - k)), 6) AS score FROM b, w""")
def ch_score(spark, sf_dir):
    return vectors.calinski_harabasz(points(spark, sf_dir))


@query(f"""WITH {_CENTERS}, s AS (SELECT label, any_value(center) AS center, avg(sqrt({_D2.format(a='v', b='center')})) AS s FROM p JOIN c USING (label) GROUP BY label)
 SELECT round(avg(r), 6) AS score FROM (SELECT a.label, max((a.s + b.s) / sqrt({_D2.format(a='a.center', b='b.center')})) AS r FROM s AS a JOIN s AS b ON a.label <> b.label GROUP BY a.label)""")
def db_score(spark, sf_dir):
    return vectors.davies_bouldin(points(spark, sf_dir))


@query(f"""WITH {_V}, t AS (SELECT * FROM p ORDER BY md5('42:' || vec_id), vec_id LIMIT 2000), m AS (SELECT a.vec_id, a.label, b.label AS other, avg(sqrt({_D2.format(a='a.v', b='b.v')})) AS d FROM t AS a JOIN t AS b ON a.vec_id <> b.vec_id GROUP BY ALL),
 s AS (SELECT vec_id, max(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM m GROUP BY vec_id) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS score FROM s""")
def silhouette_sample(spark, sf_dir):
    return vectors.silhouette(points(spark, sf_dir))


@query("SELECT label::INTEGER AS cluster_id, count(*) AS size, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y, round(avg(vec_id % 5 + 1), 6) AS concerning_score, arg_min(vec_id % 2 = 0, vec_id) AS kept FROM embeddings GROUP BY label")
def cluster_map(spark, sf_dir):
    p = points(spark, sf_dir)
    return clustering.cluster_map(p.select(F.col("label").alias("cluster_id"), F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), (F.col("vec_id") % 5 + 1).alias("concerning_score"), (F.col("vec_id") % 2 == 0).alias("kept"), F.col("vec_id").alias("ord")))


@query("SELECT source, doc_id, rank::INTEGER AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 12")
def label_sample(spark, sf_dir):
    return conversations.lead_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 12)


_LABELS = r"""lead AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
 told AS (SELECT source AS cluster_id, string_agg(text, chr(10) ORDER BY n) AS t FROM lead WHERE n <= 12 GROUP BY source),
 named AS (SELECT cluster_id, coalesce(nullif(substr(array_to_string(regexp_extract_all(t, '\S+')[1:4], ' '), 1, 120), ''), 'Unnamed') AS name, coalesce(nullif(substr(regexp_replace(t, '^\s+|\s+$', '', 'g'), 1, 500), ''), 'Nothing to describe.') AS description FROM told)"""


@query(f"WITH {_LABELS} SELECT cluster_id, name, md5(description) AS description, false AS fallback_used, NULL::VARCHAR AS error FROM named")
def label_clusters(spark, sf_dir):
    return source_labels(spark, sf_dir).withColumn("description", F.md5("description"))


def source_labels(spark, sf_dir):
    """Labels of sources as clusters, from their first twelve documents."""
    return providers.cluster_labels(table(spark, sf_dir, "documents").select(F.col("source").alias("cluster_id"), F.col("text").alias("summary"), "doc_id"), "doc_id")


_FACETS = r"""said AS (SELECT conv_id, string_agg(n || '. ' || upper(role) || ': ' || text, chr(10) ORDER BY turn) AS t, count(*) AS turn_count FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id),
 facets AS (SELECT conv_id AS conversation_id, turn_count, substr(regexp_replace(t, '^\s+|\s+$', '', 'g'), 1, 200) AS summary, substr(lower(regexp_extract(t, '\S+')), 1, 40) AS task, 'unknown' AS language FROM said)"""


@query(f"WITH {_FACETS} SELECT conversation_id, summary, task, language, 0.8::DOUBLE AS language_confidence, 1 AS concerning_score, false AS fallback_used, NULL::VARCHAR AS error FROM facets")
def facet_extraction(spark, sf_dir):
    return extracted(spark, sf_dir)


def extracted(spark, sf_dir):
    """Facets of conversations by the offline provider."""
    held = conversations.assemble(messages(spark, sf_dir)).withColumn("t", conversations.transcript(F.col("messages"), True))
    return providers.answered(held, "conversation_id", "t", "facets", providers.FACETS, {"summary": "", "task": "", "language": "unknown", "language_confidence": 0.0, "concerning_score": 1})


def tree(spark, sf_dir):
    """Region, nation, customer as nodes of levels 2, 1, 0 and edges."""
    r, n, c = (table(spark, sf_dir, k) for k in ("region", "nation", "customer"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    leaf = c.select(name("c", "c_custkey").alias("node_id"), F.col("c_name").alias("name"), F.lit(1).cast("long").alias("size"), F.lit(0).alias("level"), name("n", "c_nationkey").alias("parent"))
    sizes = c.groupBy("c_nationkey").agg(F.count("*").alias("size"))
    mid = n.join(sizes, n.n_nationkey == sizes.c_nationkey, "left").select(name("n", "n_nationkey").alias("node_id"), F.col("n_name").alias("name"), F.coalesce("size", F.lit(0)).alias("size"), F.lit(1).alias("level"), name("r", "n_regionkey").alias("parent"))
    top = mid.groupBy("parent").agg(F.sum("size").alias("size"))
    top = r.join(top, name("r", "r_regionkey") == top.parent).select(name("r", "r_regionkey").alias("node_id"), F.col("r_name").alias("name"), "size", F.lit(2).alias("level"), F.lit(None).cast("string").alias("parent"))
    every = leaf.union(mid).union(top)
    return every.drop("parent"), every.where("parent is not null").select(F.col("parent").alias("parent_id"), F.col("node_id").alias("child_id"))


_TREE = """leaf AS (SELECT 'c' || c_custkey AS node_id, c_name AS name, 1::BIGINT AS size, 0 AS level, 'n' || c_nationkey AS parent FROM customer),
 mid AS (SELECT 'n' || n_nationkey AS node_id, any_value(n_name) AS name, count(c_custkey) AS size, 1 AS level, any_value('r' || n_regionkey) AS parent FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey),
 top AS (SELECT 'r' || r_regionkey AS node_id, any_value(r_name) AS name, sum(size)::BIGINT AS size, 2 AS level, NULL AS parent FROM region JOIN mid ON mid.parent = 'r' || r_regionkey GROUP BY r_regionkey),
 t AS (SELECT * FROM leaf UNION ALL SELECT * FROM mid UNION ALL SELECT * FROM top)"""


@query(f"WITH {_TREE} SELECT l.node_id, m.parent AS root_id, 2 AS steps FROM leaf AS l JOIN mid AS m ON l.parent = m.node_id")
def hierarchy_roots(spark, sf_dir):
    nodes, edges = tree(spark, sf_dir)
    return hierarchy.roots(edges, nodes.where("level = 0"))


@query(f"WITH {_TREE} SELECT t.node_id, t.parent AS parent_id, t.size, round(t.size / coalesce(u.size, (SELECT sum(size) FROM top)), 6) AS of_parent, round(t.size / (SELECT sum(size) FROM top), 6) AS of_all FROM t LEFT JOIN t AS u ON t.parent = u.node_id")
def tree_shares(spark, sf_dir):
    return hierarchy.shares(*tree(spark, sf_dir))


@query(f"WITH {_TREE}, f AS (SELECT node_id, size, 0 AS depth, lpad((999999999999 - size)::VARCHAR, 12, '0') || node_id AS path FROM top), g AS (SELECT m.node_id, m.size, 1 AS depth, path || '/' || lpad((999999999999 - m.size)::VARCHAR, 12, '0') || m.node_id AS path FROM f JOIN mid AS m ON m.parent = f.node_id) SELECT * FROM f UNION ALL SELECT * FROM g UNION ALL SELECT l.node_id, l.size, 2, path || '/' || lpad((999999999999 - l.size)::VARCHAR, 12, '0') || l.node_id FROM g JOIN leaf AS l ON l.parent = g.node_id")
def tree_flattened(spark, sf_dir):
    nodes, edges = tree(spark, sf_dir)
    return hierarchy.flattened(nodes, edges, F.col("level") == 2)


@query(f"WITH {_TREE} SELECT t.node_id, t.level, coalesce(string_agg(u.node_id, ',' ORDER BY u.node_id), '') AS children FROM t LEFT JOIN t AS u ON u.parent = t.node_id GROUP BY ALL")
def tree_view(spark, sf_dir):
    return hierarchy.tree_view(*tree(spark, sf_dir))


@query(f"WITH {_TREE} SELECT node_id, name, level FROM t WHERE contains(lower(name || ' ' || node_id), 'n1')")
def tree_search(spark, sf_dir):
    return hierarchy.search(tree(spark, sf_dir)[0], "N1")


@query(f"WITH {_TREE} SELECT node_id, name, size, level FROM top ORDER BY size DESC, node_id LIMIT 4")
def top_clusters(spark, sf_dir):
    return hierarchy.top_clusters(*tree(spark, sf_dir))


_RATED = f"CASE WHEN regexp_matches(x, '{privacy.EMAIL}') OR regexp_matches(x, '{privacy.PHONE}') THEN 1 WHEN regexp_matches(x, '{privacy.SECRET}') THEN 2 WHEN regexp_matches(x, '[0-9]{{6}}') THEN 3 ELSE 5 END"
_AUDITS = f"a AS (SELECT 'raw_conversation' AS stage, conv_id::VARCHAR AS id, {_RATED} AS rating FROM (SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS x FROM conversations GROUP BY conv_id) UNION ALL SELECT 'document', doc_id::VARCHAR, {_RATED} FROM (SELECT doc_id, text AS x FROM documents))"


def audits(spark, sf_dir):
    raw = conversations.audit_text("raw_conversation", conversations.assemble(messages(spark, sf_dir)))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("stage"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return raw.union(docs).select("stage", "id", privacy.rule_rating(F.col("content")).alias("rating"))


@query(f"WITH {_AUDITS} SELECT * FROM a")
def privacy_audit(spark, sf_dir):
    return audits(spark, sf_dir)


@query(f"WITH {_AUDITS}, c AS (SELECT stage, rating, count(*) AS n FROM a GROUP BY ALL) SELECT stage, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (rating >= 3), 0)::BIGINT AS passed, (sum(n) - coalesce(sum(n) FILTER (rating >= 3), 0))::BIGINT AS failed, round(coalesce(sum(n) FILTER (rating >= 3), 0) / sum(n), 6) AS pass_rate, string_agg(rating || ':' || n, ',' ORDER BY rating) AS histogram FROM c GROUP BY stage")
def privacy_summary(spark, sf_dir):
    return privacy.summary(audits(spark, sf_dir))


@query("SELECT label::INTEGER AS cluster_id, count(*) AS size, count(*) >= 45 AS kept_by_threshold, CASE WHEN label % 4 = 0 THEN 1 ELSE (label % 5 + 1)::INTEGER END AS rating, CASE WHEN label % 4 = 0 THEN 'Missing privacy audit result.' ELSE '' END AS note, CASE WHEN label % 4 = 0 THEN 1 ELSE label % 5 + 1 END >= 3 AS privacy_kept, CASE WHEN label % 4 = 0 THEN 1 ELSE label % 5 + 1 END >= 3 AND count(*) >= 45 AS final_kept FROM embeddings GROUP BY label")
def privacy_gate(spark, sf_dir):
    c = points(spark, sf_dir).groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").alias("size")).withColumn("kept_by_threshold", F.col("size") >= 45)
    rated = c.where("cluster_id % 4 <> 0").select("cluster_id", (F.col("cluster_id") % 5 + 1).alias("rating"))
    return privacy.gate(c, rated)


@query("SELECT count(*) AS cases, round(avg(CASE WHEN r BETWEEN lo AND hi THEN 1 ELSE 0 END), 6) AS in_range_rate, round(avg(abs(r - round_even((lo + hi) / 2, 0))), 6) AS mean_error FROM (SELECT event_id % 5 + 1 AS r, event_id % 3 + 1 AS lo, event_id % 3 + 2 + event_id % 2 AS hi FROM events)")
def auditor_validation(spark, sf_dir):
    e = F.col("event_id")
    return privacy.auditor_score(table(spark, sf_dir, "events").select((e % 5 + 1).alias("rating"), (e % 3 + 1).alias("low"), (e % 3 + 2 + e % 2).alias("high")))


def _f1_sql(rows: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""WITH r AS ({rows}), s AS (SELECT {k}truth AS label, count(*) FILTER (truth = predicted) AS tp, count(*) AS t, 0 AS p FROM r GROUP BY ALL UNION ALL SELECT {k}predicted, 0, 0, count(*) FROM r GROUP BY ALL),
 e AS (SELECT {k}label, sum(tp) AS tp, sum(t) AS t, sum(p) AS p, coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(t) + sum(p), 0), 0) AS f1 FROM s GROUP BY {k}label)
 SELECT {k}sum(t)::BIGINT AS n, round(sum(tp) / sum(t), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * t) / sum(t), 6) AS weighted_f1 FROM e {g}"""


def judged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("lang", F.col("quality").cast("string").alias("truth"), F.when(F.col("n_chars") > 600, "1").otherwise("0").alias("predicted"))


_JUDGED = "SELECT lang, quality::VARCHAR AS truth, CASE WHEN n_chars > 600 THEN '1' ELSE '0' END AS predicted FROM documents JOIN labels USING (doc_id)"


@query(_f1_sql(_JUDGED))
def confusion_f1(spark, sf_dir):
    return evaluate.scores(judged(spark, sf_dir))


@query(_f1_sql(_JUDGED, "lang"))
def language_metrics(spark, sf_dir):
    return evaluate.scores(judged(spark, sf_dir), ["lang"])


@query("SELECT cluster_id, arg_max(topic, (n, -first)) AS topic FROM (SELECT label::INTEGER AS cluster_id, 't' || vec_id % 6 AS topic, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY ALL) GROUP BY cluster_id")
def majority_map(spark, sf_dir):
    rows = points(spark, sf_dir).select(F.col("label").alias("cluster_id"), F.concat(F.lit("t"), (F.col("vec_id") % 6).cast("string")).alias("topic"), F.col("vec_id").alias("ord"))
    return evaluate.majority(rows)


def synthetic_size(spark, sf_dir) -> int:
    """As many synthetic conversations as there are given ones."""
    return messages(spark, sf_dir).select("conv_id").distinct().count()


def _synthetic_sql() -> str:
    lists = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    more = [i for i, m in enumerate(evaluate.more_turns(5000, 19)) if m]
    return f"""c AS (SELECT i, i + 1 AS variant, {lists([t[0] for t in evaluate.TOPICS])}[i % 8 + 1] AS topic, {lists([t[1] for t in evaluate.TOPICS])}[i % 8 + 1] AS summary,
 {lists(evaluate.LANGUAGES[:5])}[i % 5 + 1] AS language, replace({lists([t[2] for t in evaluate.TOPICS])}[i % 8 + 1], '{{variant}}', (i + 1)::VARCHAR) AS asked, i IN {tuple(more)} AS more FROM (SELECT unnest(range(0, (SELECT count(DISTINCT conv_id) FROM conversations))) AS i)),
 s AS (SELECT *, CASE WHEN language = 'English' THEN '' ELSE '[' || language || '] ' END || asked AS first, summary || ' for ProjectOrchid' || (i % 11 + 1) AS named FROM c)"""


@query(f"""WITH {_synthetic_sql()} SELECT printf('eval-conv-%04d', variant) AS conversation_id, printf('eval-user-%03d', i % 40 + 1) AS user_id, strftime(TIMESTAMP '2025-02-01 10:00:00' + INTERVAL (i * 5) MINUTE, '%Y-%m-%d %H:%M:%S') AS ts, topic, language, summary, named,
 md5('user|' || first || chr(10) || 'assistant|' || CASE WHEN topic = 'safety_high_risk' THEN '{evaluate.REFUSAL}' ELSE '{evaluate.HELP}' END || CASE WHEN more THEN chr(10) || 'user|' || replace('{evaluate.MORE}', '{{variant}}', variant::VARCHAR) || chr(10) || 'assistant|{evaluate.ADDED}' ELSE '' END) AS said FROM s""")
def synthetic_corpus(spark, sf_dir):
    c = evaluate.synthetic(spark, synthetic_size(spark, sf_dir))
    said = F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "\n")).alias("said")
    return c.select("conversation_id", "user_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("ground_truth_topic").alias("topic"), F.col("ground_truth_language").alias("language"), F.col("privacy_summary").alias("summary"), F.col("non_private_summary").alias("named"), said)


@query(r"""SELECT conv_id AS conversation_id, 'about ' || count(*) AS privacy_summary, 'about ' || count(*) || ' of ' || conv_id AS non_private_summary, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS raw_user_text FROM conversations GROUP BY conv_id""")
def eval_representations(spark, sf_dir):
    c = conversations.assemble(messages(spark, sf_dir))
    told = F.concat(F.lit("about "), F.size("messages").cast("string"))
    c = c.withColumns({"privacy_summary": told, "non_private_summary": F.concat(told, F.lit(" of "), F.col("conversation_id").cast("string"))})
    return conversations.representations(c)


@query(f"WITH {_synthetic_sql()} SELECT 'topic' AS kind, topic AS value, count(*) AS n FROM s GROUP BY topic UNION ALL SELECT 'language', language, count(*) FROM s GROUP BY language UNION ALL SELECT 'role', role, count(*) FROM conversations GROUP BY role")
def histograms(spark, sf_dir):
    c = evaluate.synthetic(spark, synthetic_size(spark, sf_dir))
    parts = [conversations.histogram(d, k).select(F.lit(name).alias("kind"), "value", "n") for d, k, name in ((c, "ground_truth_topic", "topic"), (c, "ground_truth_language", "language"), (messages(spark, sf_dir), "role", "role"))]
    return parts[0].union(parts[1]).union(parts[2])


def drill(spark, sf_dir):
    """Assignments, facets and the input of conversations: every third assignment has no user, every fourth has no facets, every fifth
    is not in the input."""
    f = conversations.facet_statistics(messages(spark, sf_dir)).withColumnRenamed("conv_id", "conversation_id")
    n = F.col("conversation_id")
    user = F.concat(F.lit("u"), (n % 40).cast("string"))
    assignments = f.select("conversation_id", F.when(n % 3 == 0, "").otherwise(user).alias("user_id"), (n % 10).alias("cluster_id"))
    facets = f.where(n % 4 != 0).select("conversation_id", "turn_count", F.concat(F.lit("s"), n.cast("string")).alias("summary"))
    source = f.where(n % 5 != 0).select("conversation_id", user.alias("user_id"), (n * 660 % 86400).alias("timestamp"))
    return assignments, facets, source


_DRILL = """b AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), r AS (SELECT conv_id AS conversation_id, CASE WHEN conv_id % 3 <> 0 OR conv_id % 5 <> 0 THEN 'u' || conv_id % 40 ELSE '' END AS user_id,
 CASE WHEN conv_id % 5 <> 0 THEN conv_id * 660 % 86400 END AS timestamp, CASE WHEN conv_id % 4 <> 0 THEN n END AS turn_count, CASE WHEN conv_id % 4 <> 0 THEN 's' || conv_id END AS summary FROM b WHERE conv_id % 10 = {k})"""


@query(f"WITH {_DRILL.format(k=3)} SELECT * FROM r UNION ALL SELECT * FROM (WITH {_DRILL.format(k=5)} SELECT * FROM r)")
def cluster_drilldown(spark, sf_dir):
    parts = drill(spark, sf_dir)
    return conversations.cluster_conversations(3, *parts).union(conversations.cluster_conversations(5, *parts))


@query("SELECT conv_id AS conversation_id, min(turn) AS first_turn FROM conversations WHERE contains(lower(conv_id || ' ' || role || ' ' || text), 'the th') GROUP BY conv_id")
def record_search(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.where(text.matches("The th", F.col("conv_id").cast("string"), F.col("role"), F.col("text"))).groupBy(F.col("conv_id").alias("conversation_id")).agg(F.min("turn").alias("first_turn"))


@query("""SELECT conv_id AS conversation_id, '{' || array_to_string(list_filter([CASE WHEN conv_id % 3 <> 0 THEN '"facets":{"turns":' || count(*) || '}' END, CASE WHEN conv_id % 2 = 0 THEN '"clustering":{"cluster_id":' || conv_id % 10 || CASE WHEN conv_id % 10 < 6 THEN ',"name":"k' || conv_id % 10 || '"' ELSE '' END || '}' END], lambda z: z IS NOT NULL), ',') || '}' AS analysis FROM conversations GROUP BY conv_id""")
def enrich_conversations(spark, sf_dir):
    base = messages(spark, sf_dir).groupBy(F.col("conv_id").alias("conversation_id")).agg(F.count("*").alias("n"))
    facets = base.where("conversation_id % 3 <> 0").select("conversation_id", F.struct(F.col("n").alias("turns")).alias("facets"))
    assigned = base.where("conversation_id % 2 = 0").select("conversation_id", (F.col("conversation_id") % 10).alias("cluster_id"))
    names = spark.range(6).select(F.col("id").alias("cluster_id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("name"))
    return conversations.enriched(base.select("conversation_id"), facets, assigned, names)


@query(f"WITH {_STATES} SELECT * FROM states")
def run_states(spark, sf_dir):
    return runs.states(run_events(spark, sf_dir))


@query(f"WITH {_STATES} SELECT count(*) AS total, count(*) FILTER (state = 'running') AS running, count(*) FILTER (starts_with(state, 'completed')) AS completed, count(*) FILTER (state = 'failed') AS failed FROM states")
def run_state_counts(spark, sf_dir):
    return runs.state_counts(run_events(spark, sf_dir))


@query(f"WITH {_SPINE} SELECT * FROM line")
def phase_timeline(spark, sf_dir):
    return runs.timeline(run_events(spark, sf_dir))


_REACHED = f"""cp AS (SELECT user_id % 50 AS run_id, ['{"', '".join(runs.PHASES)}'][event_id % 7 + 1] AS phase, sum(event_id % 11) AS processed, sum(CASE WHEN event_id % 7 <> 4 THEN event_id % 13 + 10 END) AS total FROM events GROUP BY ALL),
 pc AS (SELECT run_id, phase, CASE WHEN total > 0 THEN round(least(100.0::DOUBLE, 100.0::DOUBLE * processed / total), 1) END AS measured FROM cp),
 pg AS (SELECT run_id, count(*) FILTER (status <> 'skipped') AS active, count(*) FILTER (status IN ('completed', 'resumed')) AS done, (list(measured ORDER BY ordinal) FILTER (status = 'running'))[1] AS running FROM line LEFT JOIN pc USING (run_id, phase) GROUP BY run_id),
 reached AS (SELECT run_id, CASE WHEN active = 0 THEN 100.0::DOUBLE ELSE round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, (100.0::DOUBLE * done + coalesce(running, 0)) / active)), 1) END AS percent FROM pg)"""


@query(f"WITH {_SPINE}, {_REACHED} SELECT * FROM reached")
def overall_progress(spark, sf_dir):
    return runs.progress(run_events(spark, sf_dir), runs.checkpoint_progress(checkpoints(spark, sf_dir)))


@query(f"WITH {_EVENTS} SELECT event_id, run_id, phase, status FROM ev ORDER BY ts DESC, event_id DESC LIMIT 40")
def latest_events(spark, sf_dir):
    return runs.latest_events(run_events(spark, sf_dir)).select("event_id", "run_id", "phase", "status")


@query(f"WITH {_EVENTS}, r AS (SELECT run_id, max(ts) AS updated, run_id % 7 = 0 AS locked FROM ev GROUP BY run_id), o AS (SELECT *, row_number() OVER (ORDER BY updated DESC, run_id DESC) <= 10 AS newest FROM r) SELECT run_id, CASE WHEN newest AND updated < TIMESTAMP '2024-01-31 23:00:00' THEN 'skipped_keep' WHEN newest THEN 'keep' WHEN locked THEN 'skipped_locked' ELSE 'delete' END AS action FROM o")
def prune_plan(spark, sf_dir):
    r = run_events(spark, sf_dir).groupBy("run_id").agg(F.max("ts").alias("updated")).withColumn("locked", F.col("run_id") % 7 == 0)
    return runs.prune_plan(r, keep_last=10, cutoff=F.lit("2024-01-31 23:00:00").cast("timestamp_ntz"))


@query("SELECT key, a.value AS was, b.value AS now FROM (SELECT 's' || doc_id AS key, lang AS value FROM documents WHERE doc_id % 3 <> 0) AS a FULL JOIN (SELECT 's' || doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS value FROM documents WHERE doc_id % 4 <> 0) AS b USING (key) WHERE a.value IS DISTINCT FROM b.value")
def fingerprint_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("key"), F.col("lang").alias("value"))
    after = d.where("doc_id % 4 <> 0").withColumn("value", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("value")))
    return runs.settings_drift(d.where("doc_id % 3 <> 0"), after)


@query("""WITH s AS (SELECT count(*) AS n, round(avg(k), 6) AS t FROM (SELECT count(*) AS k FROM conversations GROUP BY conv_id)),
 c AS (SELECT *, greatest(1, least(greatest(20, least(600, ceil(n / 25))), n))::BIGINT AS k FROM s), h AS (SELECT *, greatest(1, ceil(k / 8))::BIGINT AS h, least(40, n) + n + k + least(20, n) AS p FROM c),
 t AS (SELECT *, (n * greatest(120, floor(90 * t)) + k * 700 + h * 900 + p * 500 + 3 * 1200)::BIGINT AS prompt FROM h)
 SELECT k AS clusters, n + k + h + p + 3 AS requests, prompt AS prompt_tokens, floor(prompt * 0.35::DOUBLE)::BIGINT AS completion_tokens, prompt + floor(prompt * 0.35::DOUBLE)::BIGINT AS total_tokens,
 round(n / 8 * 2.0::DOUBLE + 4.0::DOUBLE + k / 8 * 2.0::DOUBLE + h / 8 * 2.5::DOUBLE + p / 8 * 1.8::DOUBLE + 4.5::DOUBLE, 3) AS seconds, round(prompt / 1e6 * 2.5::DOUBLE + floor(prompt * 0.35::DOUBLE) / 1e6 * 10.0::DOUBLE, 6) AS cost FROM t""")
def preflight_estimate(spark, sf_dir):
    return runs.preflight(conversations.dataset_summary(messages(spark, sf_dir), F.col("conv_id") % 40), input_cost=2.5, output_cost=10.0)


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY conv_id")
def stream_summary(spark, sf_dir):
    return ingest.drained(ingest.turns(ingest.opened(spark, f"{sf_dir}/conversations.parquet")), "turns", "complete")


@query("SELECT DISTINCT conv_id, role FROM conversations")
def stream_dedupe(spark, sf_dir):
    s = ingest.opened(spark, f"{sf_dir}/conversations.parquet").select("conv_id", "role")
    return ingest.drained(ingest.first_seen(s, ["conv_id", "role"]), "seen", "append")


_TICKS = "k AS (SELECT user_id % 50 AS run_id, ts, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id % 50) AS total FROM events)"


@query(f"WITH {_TICKS}, w AS (SELECT *, floor(done::DOUBLE / total / 0.05::DOUBLE) AS b, lag(floor(done::DOUBLE / total / 0.05::DOUBLE)) OVER o AS pb, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER o AS gap FROM k WINDOW o AS (PARTITION BY run_id ORDER BY ts, done)) SELECT run_id, done, total FROM w WHERE coalesce(done = 1 OR done = total OR b > pb OR gap >= 20000, true)")
def progress_throttle(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("run_id")
    e = run_events(spark, sf_dir).select("run_id", "ts", F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("done"), F.count("*").over(w).alias("total"))
    return runs.throttled(e, seconds=20000.0).select("run_id", "done", "total")


@query(f"WITH {_STATES} SELECT run_id, state, phases_seen, last_event FROM states JOIN (SELECT run_id, count(DISTINCT phase) AS phases_seen, max(event_id) AS last_event FROM ev GROUP BY run_id) USING (run_id)")
def list_runs(spark, sf_dir):
    e = run_events(spark, sf_dir)
    seen = e.groupBy("run_id").agg(F.count_distinct("phase").alias("phases_seen"), F.max("event_id").alias("last_event"))
    return runs.states(e).join(seen, "run_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    e = ingest.opened(spark, f"{sf_dir}/events.parquet").select("ts", "event_type")
    out = ingest.drained(ingest.windowed(e), "windows", "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT count(*) AS conversations, count(DISTINCT u) AS users, sum(n)::BIGINT AS messages, round(avg(n), 6) AS avg_turns, min(n) AS min_turns, max(n) AS max_turns FROM (SELECT conv_id, conv_id % 40 AS u, count(*) AS n FROM conversations GROUP BY ALL)")
def stream_dataset_summary(spark, sf_dir):
    return ingest.dataset_summary(ingest.opened(spark, f"{sf_dir}/conversations.parquet"), F.col("conv_id") % 40)


@query()
def kmeans_clusters(spark, sf_dir):
    p = clustering.kmeans(points(spark, sf_dir).drop("label"), 10)
    return p.groupBy("label").agg(F.count("*").alias("n"))


#: Characters whose shares in a text are its vector.
LETTERS = ("eE", "oO", "hH", "nN", "äöüß", "éèàç", "ñóíá", "#$%&*|")
REACH = 0.02


def letters(spark, sf_dir):
    """(vec_id, v): shares of LETTERS in the whole text of each document, by which its languages and its junk lie apart."""
    d = table(spark, sf_dir, "documents")
    x = F.coalesce("text", F.lit(""))
    return d.select(F.col("doc_id").alias("vec_id"), F.array(*[F.regexp_count(x, F.lit(f"[{k}]")) / F.greatest(F.length(x), F.lit(1)) for k in LETTERS]).alias("v"))


_SHARES = ", ".join(f"length(regexp_replace(x, '[^{k}]', '', 'g')) / greatest(length(x), 1)" for k in LETTERS)
_L = f"p AS MATERIALIZED (SELECT doc_id AS vec_id, [{_SHARES}]::DOUBLE[] AS v FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))"


def _density_sql(rounds: int = 12) -> str:
    parts = [_L, f"d AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, sqrt({_D2.format(a='a.v', b='b.v')}) AS d FROM p AS a, p AS b)"]
    parts.append("core AS (SELECT a AS vec_id, max(d) AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS n FROM d) WHERE n <= 6 GROUP BY a)")
    parts.append(f"e AS MATERIALIZED (SELECT a, b FROM d JOIN core AS x ON x.vec_id = a JOIN core AS y ON y.vec_id = b WHERE greatest(d, x.core, y.core) <= {REACH})")
    parts.append("l0 AS (SELECT a AS node, min(b) AS label FROM e GROUP BY a)")
    for i in range(rounds):
        parts.append(f"m{i} AS MATERIALIZED (SELECT e.a AS node, min(label) AS label FROM e JOIN l{i} ON l{i}.node = e.b GROUP BY e.a)")
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT m.node, least(m.label, n.label) AS label FROM m{i} AS m JOIN m{i} AS n ON n.node = m.label)")
    parts.append(f"big AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM l{rounds} GROUP BY label HAVING count(*) >= 12)")
    return f"WITH {', '.join(parts)} SELECT vec_id, coalesce(k, -1)::INTEGER AS label FROM p LEFT JOIN l{rounds} AS l ON l.node = vec_id LEFT JOIN big ON big.label = l.label"


@query(_density_sql())
def density_clusters(spark, sf_dir):
    return clustering.density(letters(spark, sf_dir), reach=REACH).select("vec_id", "label")


@query()
def density_hierarchy(spark, sf_dir):
    return clustering.density(letters(spark, sf_dir)).select("vec_id", "label")


@query()
def hybrid_clusters(spark, sf_dir):
    found, _ = clustering.fit(letters(spark, sf_dir), "hybrid", 12, noise="drop")
    return found.select("vec_id", "label")


@query(f"WITH {_V}, d AS (SELECT a.vec_id AS node, b.vec_id AS near, sqrt({_D2.format(a='a.v', b='b.v')}) AS d FROM p AS a JOIN p AS b ON a.vec_id <> b.vec_id) SELECT node, rank::INTEGER AS rank, near, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, near) AS rank FROM d) WHERE rank <= 5")
def neighbour_join(spark, sf_dir):
    found = density.nearest_points(points(spark, sf_dir).drop("label"), 5)
    return found.select("node", F.col("rank").cast("int").alias("rank"), "near", F.round("distance", 6).alias("distance"))


@query()
def hierarchy_levels(spark, sf_dir):
    c = vectors.centroids(points(spark, sf_dir)).select(F.format_string("leaf-%03d", "label").alias("node_id"), F.format_string("Cluster %d", "label").alias("name"), F.col("n").alias("size"), F.col("center").alias("v"))
    nodes, edges, _ = hierarchy.levels(c)
    return nodes.join(edges, nodes.node_id == edges.child_id, "left").select("node_id", "level", "size", "parent_id")


@query()
def pca_map(spark, sf_dir):
    return vectors.pca_map(points(spark, sf_dir)).select("vec_id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def conversation_clusters(spark, sf_dir):
    return flagship(spark, sf_dir)


def checkpoints(spark, sf_dir):
    """Parts of phases of runs, with what is done and what there is; one phase has no totals."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    phase = F.element_at(F.array(*map(F.lit, runs.PHASES)), (n % 7 + 1).cast("int"))
    return e.select((F.col("user_id") % 50).alias("run_id"), phase.alias("phase"), (n % 3).alias("part"), (n % 11).alias("processed"), F.when(n % 7 != 4, n % 13 + 10).alias("total"))


@query(f"SELECT run_id, phase, processed::BIGINT AS processed, total::BIGINT AS total, CASE WHEN total > 0 THEN round(least(100.0::DOUBLE, 100.0::DOUBLE * processed / total), 1) END AS percent FROM (SELECT user_id % 50 AS run_id, ['{"', '".join(runs.PHASES)}'][event_id % 7 + 1] AS phase, sum(event_id % 11) AS processed, sum(CASE WHEN event_id % 7 <> 4 THEN event_id % 13 + 10 END) AS total FROM events GROUP BY ALL)")
def checkpoint_progress(spark, sf_dir):
    return runs.checkpoint_progress(checkpoints(spark, sf_dir))


@query(f"WITH {_SPINE} SELECT run_id, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status <> 'skipped') AS active, count(*) FILTER (status IN ('completed', 'resumed')) AS completed FROM line GROUP BY run_id")
def phase_counts(spark, sf_dir):
    return runs.phase_counts(run_events(spark, sf_dir))


@query("SELECT event_id, event_type AS kind, NULL::BIGINT AS pid, NULL::BIGINT AS processed FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, 'checkpoint', NULL, event_id % 11 FROM events WHERE event_type = 'view' UNION ALL SELECT max(event_id) + 1, 'lock', 4242, NULL FROM events")
def merged_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.where("event_type <> 'view'").select("event_id", F.col("event_type").alias("kind"))
    saved = e.where("event_type = 'view'").select("event_id", F.lit("checkpoint").alias("kind"), (F.col("event_id") % 11).alias("processed"))
    lock = e.agg((F.max("event_id") + 1).alias("event_id")).select("event_id", F.lit("lock").alias("kind"), F.lit(4242).cast("long").alias("pid"))
    return runs.merged_events(log, saved, lock)


@query("SELECT user_id % 50 AS run_id, count(*) AS requests, sum(event_id % 100)::BIGINT AS prompt_tokens, coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN event_id % 40 END), 0)::BIGINT AS completion_tokens, (sum(event_id % 100) + coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN event_id % 40 END), 0))::BIGINT AS total_tokens FROM events GROUP BY 1")
def usage_rollup(spark, sf_dir):
    n = F.col("event_id")
    return runs.usage(table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run_id"), F.lit(1).cast("long").alias("requests"), (n % 100).alias("prompt_tokens"), F.when(n % 3 != 0, n % 40).alias("completion_tokens")))


@query(f"""WITH {_EVENTS}, f AS (SELECT run_id, 'f' || event_id % 9 AS name, arg_max('p' || event_id, event_id) AS path FROM ev GROUP BY ALL)
 SELECT run_id, (SELECT string_agg(DISTINCT phase, ',' ORDER BY phase) FROM ev WHERE ev.run_id = r.run_id) AS completed_phases, (SELECT string_agg(name || '=' || path, ',' ORDER BY name) FROM f WHERE f.run_id = r.run_id) AS output_files FROM (SELECT DISTINCT run_id FROM ev) AS r""")
def manifest_merge(spark, sf_dir):
    n = F.col("event_id")
    file = F.create_map(F.concat(F.lit("f"), (n % 9).cast("string")), F.concat(F.lit("p"), n.cast("string")))
    return runs.merged_manifest(run_events(spark, sf_dir).select("run_id", n.alias("seq"), F.array("phase").alias("completed_phases"), file.alias("output_files")))


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id % 3 <> 0 GROUP BY user_id")
def resume_partial(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "event_type")
    return conversations.resumed(e, e.where("key % 3 <> 0").select("key").distinct(), "key", "event_id").select("key", "event_type")


@query("SELECT event_id, unnest(list_filter([CASE WHEN (value BETWEEN 0 AND 1) IS NOT TRUE THEN 'language_confidence' END, CASE WHEN event_id % 7 NOT BETWEEN 1 AND 5 THEN 'concerning_score' END], lambda z: z IS NOT NULL)) AS fault FROM events")
def facet_contract(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("language_confidence"), (F.col("event_id") % 7).alias("concerning_score"))
    return conversations.facet_faults(e, "event_id")


@query("SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS text FROM conversations GROUP BY conv_id")
def first_user_message(spark, sf_dir):
    return conversations.first_user_message(messages(spark, sf_dir))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, (CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END)::INTEGER AS cluster_id, vec_id % 4 <> 0 AND label % 2 = 0 AS kept_by_threshold FROM embeddings")
def map_points(spark, sf_dir):
    p = points(spark, sf_dir)
    places = p.select("vec_id", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"))
    given = p.where("vec_id % 4 <> 0").select("vec_id", F.col("label").alias("cluster_id"), (F.col("label") % 2 == 0).alias("kept_by_threshold"))
    return clustering.map_points(p.select("vec_id"), places, given, "vec_id")


@query("SELECT DISTINCT label::INTEGER AS cluster_id, CASE WHEN label % 3 = 0 THEN 'safe' ELSE 'k' END || label AS name, label % 2 = 0 OR (label % 3 = 0 AND label > 5) AS kept FROM embeddings")
def preferred_labels(spark, sf_dir):
    c = points(spark, sf_dir).select(F.col("label").alias("cluster_id")).distinct()
    name = lambda x: F.concat(F.lit(x), F.col("cluster_id").cast("string")).alias("name")
    own = c.select("cluster_id", name("k"), (F.col("cluster_id") % 2 == 0).alias("kept_by_threshold"))
    return clustering.preferred_labels(own, c.where("cluster_id % 3 = 0").select("cluster_id", name("safe"), (F.col("cluster_id") > 5).alias("final_kept")))


_CASES = ", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in privacy.CASES)


@query(f"SELECT count(*) AS cases, round(avg(CASE WHEN r BETWEEN lo AND hi THEN 1 ELSE 0 END), 6) AS in_range_rate, round(avg(abs(r - round_even((lo + hi) / 2, 0))), 6) AS mean_error FROM (SELECT {_RATED} AS r, lo, hi FROM (SELECT x, lo, hi FROM (VALUES {_CASES}) AS c(id, x, lo, hi) UNION ALL SELECT text, CASE WHEN contains(text, '@') THEN 1 ELSE 2 END, CASE WHEN contains(text, '@') THEN 2 ELSE 5 END FROM documents))")
def auditor_cases(spark, sf_dir):
    at = F.col("text").contains("@")
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.when(at, 1).otherwise(2).alias("low"), F.when(at, 2).otherwise(5).alias("high"))
    held = privacy.cases(spark).select("content", "low", "high").unionByName(docs)
    return privacy.auditor_score(held.withColumn("rating", privacy.rule_rating(F.col("content"))))


@query("SELECT event_type AS stage, count(*) AS audits, count(*) FILTER (event_id % 4 = 0) AS fallbacks FROM events GROUP BY event_type")
def fallback_counts(spark, sf_dir):
    return privacy.fallback_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("event_id") % 4 == 0).alias("fallback_used")))


@query("SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS ago FROM (SELECT event_id, event_id * event_id % 400000 AS s FROM events)")
def relative_times(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", text.ago(n * n % 400000).alias("ago"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, round(value, 6))) END AS share FROM events")
def clamped_numbers(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, "soon").when(F.col("event_id") % 4 == 1, "Infinity").otherwise(F.round("value", 6).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", text.clamped(raw, 0.0, 1.0, 0.5).alias("share"))


class FailingEmbedder(providers.HashedEmbedder):
    """Gives no answer for texts that hold a mark."""

    def embed(self, texts):
        if any(t.startswith("*") for t in texts):
            raise providers.ProviderError("no vectors")
        return super().embed(texts)


@query()
def ablation(spark, sf_dir):
    """How well clusters of documents by their texts, by their sources and by marked texts, which the provider refuses, give back their languages."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("truth"), "text", "source", F.concat(F.lit("* "), "text").alias("marked"))
    return evaluate.ablation(d, "doc_id", ["text", "source", "marked"], 8, provider=FailingEmbedder())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to facets, embeddings and clusters, and the clusters' sizes against the thresholds."""
    held = conversations.assemble(messages(spark, sf_dir)).select("conversation_id", conversations.transcript(F.col("messages")).alias("t"))
    v = providers.embedded(held, "conversation_id", "t").withColumnRenamed("conversation_id", "vec_id")
    k, _ = clustering.leaf_count(held.count(), least=4, most=200)
    labelled = clustering.kmeans(v, k).select(F.col("label").alias("cluster_id"), (F.col("vec_id") % 40).alias("user_id"))
    return clustering.rollup(labelled, min_users=2, min_conversations=2)


from parley.plans import analysis, monitoring, scans  # noqa: E402, F401 - they register their queries here


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
