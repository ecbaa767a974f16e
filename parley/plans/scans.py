"""Queries of the scans and sinks of JSON lines, of schema discovery, and of ingest as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import conversations, phases, providers
from parley.plans import _CODES, _EXTERNAL, _FACETS, MAPPING, defective_lines, event_lines, external_lines, messages, query, table
from parley.sources import jsonl, manifest, tables
from parley.sources.store import shared_folder
from parley.streaming import ingest


def sound_lines(spark, sf_dir):
    return jsonl.checked(defective_lines(spark, sf_dir)).where("code is null").select("line_number", "line")


_SOUND = f"k AS ({_CODES}), n AS (SELECT conv_id, count(*)::INTEGER AS n FROM conversations GROUP BY conv_id), v AS (SELECT line_number, 'c-' || (line_number - 1) AS conversation_id, CASE line_number % 10 WHEN 9 THEN 'v' ELSE 'u' END AS user_id, n FROM k JOIN n ON conv_id = line_number - 1 WHERE code IS NULL)"


@query(f"WITH {_SOUND} SELECT line_number, conversation_id, user_id, n AS n_messages, '2025-01-01 00:00:00' AS ts FROM v")
def strict_scan(spark, sf_dir):
    found = jsonl.strict(sound_lines(spark, sf_dir))
    return found.select("line_number", "conversation_id", "user_id", F.size("messages").alias("n_messages"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(f"WITH {_SOUND} SELECT line_number, conversation_id, ((row_number() OVER (ORDER BY line_number) - 1) // 3)::BIGINT AS batch FROM v ORDER BY line_number LIMIT 20")
def chunked_scan(spark, sf_dir):
    return jsonl.chunks(sound_lines(spark, sf_dir), 3, 20).select("line_number", "conversation_id", "batch")


@query("SELECT DISTINCT conv_id + 1 AS line_number FROM conversations WHERE conv_id % 10 > 1")
def json_records(spark, sf_dir):
    return jsonl.records(defective_lines(spark, sf_dir).where("line_number % 10 <> 1")).select("line_number")


@query("SELECT event_id + 1 AS line_number, props AS line FROM events ORDER BY event_id LIMIT 400")
def capped_read(spark, sf_dir):
    return jsonl.capped(event_lines(spark, sf_dir))


@query("SELECT DISTINCT conv_id + 1 AS line_number, conv_id % 10 > 1 AS is_object FROM conversations")
def lenient_objects(spark, sf_dir):
    lines = defective_lines(spark, sf_dir)
    return lines.select("line_number", (jsonl.object_or_empty(F.col("line")) != "{}").alias("is_object"))


@query("SELECT event_id + 1 AS line_number, props AS line FROM events")
def numbered_files(spark, sf_dir):
    path = f"{shared_folder(spark)}/parley-lines-{uuid.uuid4().hex}"
    event_lines(spark, sf_dir).repartitionByRange(4, "line_number").sortWithinPartitions("line_number").select("line").write.text(path)
    return jsonl.read_lines(spark, path)


@query("SELECT * FROM (VALUES ('conversation_id', 'id'), ('user_id', 'userHash'), ('timestamp', 'createdAt'), ('messages', 'messages'), ('role', 'from'), ('content', 'value')) AS m(field, key)")
def schema_discovery(spark, sf_dir):
    found = jsonl.discover(external_lines(spark, sf_dir))
    return spark.createDataFrame([*found.items()], "field string, key string")


@query(f"""WITH {_EXTERNAL}, roles AS (SELECT CASE role WHEN 'Human' THEN 'user' ELSE role END AS role, count(*) AS n FROM conversations WHERE conv_id % 7 <> 0 GROUP BY ALL)
 SELECT (SELECT count(*) FROM b) AS total_lines, (SELECT count(*) FROM b) AS parsed_lines, (SELECT count(id) - count(DISTINCT id) FROM b) AS duplicate_ids, (SELECT count(*) FROM b WHERE conv_id % 7 <> 0) AS output_lines,
 0::BIGINT AS missing_timestamps, 0::BIGINT AS missing_users, (SELECT count(*) FROM b WHERE conv_id % 7 = 0) AS rejected_lines, (SELECT string_agg(role || ':' || n, ',' ORDER BY role) FROM roles) AS roles,
 (SELECT string_agg((conv_id + 1) || ':no_valid_messages', ',' ORDER BY conv_id) FROM (SELECT conv_id FROM b WHERE conv_id % 7 = 0 ORDER BY conv_id LIMIT 20)) AS errors""")
def normalize_report(spark, sf_dir):
    lines = external_lines(spark, sf_dir)
    return jsonl.normalization_report(lines, jsonl.discover(lines))


@query(f"WITH {_SOUND} SELECT conversation_id, user_id, n AS n_messages FROM v")
def stream_ingest(spark, sf_dir):
    path = f"{shared_folder(spark)}/parley-lines-{uuid.uuid4().hex}"
    defective_lines(spark, sf_dir).where(~((F.col("line_number") % 10 == 4) & (F.col("line_number") > 10))).repartition(3, "line_number").select("line").write.text(path)
    return ingest.ingested(spark, path, files=1).select("conversation_id", "user_id", F.size("messages").alias("n_messages"))


@query("SELECT doc_id, text FROM documents")
def append_promote(spark, sf_dir):
    root, schema = f"{shared_folder(spark)}/parley-run-{uuid.uuid4().hex}", "doc_id long, text string"
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest.commit(spark, root, lambda m: {"run_id": "run"})
    for k in range(2):
        tables.append(d.where(F.pmod("doc_id", F.lit(2)) == k), f"{root}/partial")
    tables.promote(spark, root, f"{root}/partial", schema)
    return manifest.table(spark, root, "facets", schema)


@query("SELECT row_number() OVER (ORDER BY event_id)::INTEGER AS position, props AS line FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 120)")
def log_tail(spark, sf_dir):
    path = f"{shared_folder(spark)}/parley-log-{uuid.uuid4().hex}"
    event_lines(spark, sf_dir).orderBy("line_number").select("line").write.text(path)
    return tables.tail_file(spark, path, 120)[0]


@query(f"WITH {_FACETS} SELECT conversation_id, summary, task, language, 0.8::DOUBLE AS language_confidence, 1 AS concerning_score, false AS fallback_used, NULL::VARCHAR AS error FROM facets")
def resumed_phase(spark, sf_dir):
    """Facets in waves: a first run over a part of the conversations, and a second over all, which asks for the rest."""
    held = conversations.assemble(messages(spark, sf_dir)).withColumn("t", conversations.transcript(F.col("messages"), True))
    none = {"summary": "", "task": "", "language": "unknown", "language_confidence": 0.0, "concerning_score": 1}
    root = f"{shared_folder(spark)}/parley-run-{uuid.uuid4().hex}"
    go = lambda df: phases.run_phase(df, "conversation_id", "t", "facets", providers.FACETS, none, root=root, name="facets")
    go(held.where("conversation_id % 3 <> 0"))
    return go(held)


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, lang, length(text)::BIGINT AS chars FROM documents")
def positional_zip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("chars")).orderBy("doc_id")
    return conversations.zipped(d.select("doc_id", "lang"), d.select("chars"))


@query("SELECT doc_id, lang FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 150) WHERE lang <> 'en'")
def limit_then_filter(spark, sf_dir):
    return conversations.limited(table(spark, sf_dir, "documents"), "doc_id", 150).where("lang <> 'en'").select("doc_id", "lang")


@query("SELECT conv_id AS conversation_id, min(turn) AS turn FROM conversations WHERE conv_id % 4 = 1 GROUP BY conv_id")
def audit_population(spark, sf_dir):
    m = messages(spark, sf_dir).groupBy(F.col("conv_id").alias("conversation_id")).agg(F.min("turn").alias("turn"))
    return conversations.semi_or_all(m, m.where("conversation_id % 4 = 1"), "conversation_id")


@query("SELECT doc_id, 'failed' AS error FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def unresolved_errors(spark, sf_dir):
    errors = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit("failed").alias("error"))
    return conversations.unresolved(errors, table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, quality::INTEGER AS quality, row_number() OVER (ORDER BY lang, doc_id) AS ordinal FROM documents LEFT JOIN labels USING (doc_id) QUALIFY quality IS NOT NULL")
def input_order(spark, sf_dir):
    d = conversations.ordinals(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id").select("doc_id", (F.col("parley_n") + 1).alias("ord"))
    return conversations.in_order_of(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), d, "doc_id", "ord")


@query("SELECT doc_id, unnest(list_filter([CASE WHEN length(text) NOT BETWEEN 1 AND 500 THEN 'description' END, CASE WHEN length(source) NOT BETWEEN 1 AND 120 THEN 'name' END], lambda z: z IS NOT NULL)) AS fault FROM documents")
def length_contract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"), F.col("source").alias("name"))
    return conversations.length_faults(d, "doc_id", {k: conversations.LENGTHS[k] for k in ("description", "name")})


@query(f"WITH {_EXTERNAL} SELECT conv_id + 1 AS line_number, coalesce(u, 'synth') AS conversation_id, 'h' AS user_id, n::INTEGER AS n_messages, 'conversation,meta' AS leftover FROM r WHERE conv_id % 7 <> 0")
def normalize_nested(spark, sf_dir):
    """The lines of ``external_lines`` with all but the title under dotted keys."""
    line = F.col("line")
    field = lambda k: F.get_json_object(line, f"$.{k}")
    told = F.from_json(field("messages"), "array<struct<`from`:string,value:string>>")
    nested = F.to_json(F.struct(F.struct(field("id").alias("id"), field("userHash").alias("user")).alias("meta"), F.struct(field("createdAt").alias("at"), told.alias("turns")).alias("conversation")))
    lines = external_lines(spark, sf_dir).withColumn("line", nested)
    mapping = {"conversation_id": "meta.id", "user_id": "meta.user", "timestamp": "conversation.at", "messages": "conversation.turns"}
    rows, _ = jsonl.normalized(lines, mapping)
    name = F.when(F.col("conversation_id").rlike("^synth-[0-9a-f]{16}$"), F.lit("synth")).otherwise(F.col("conversation_id"))
    return rows.select("line_number", name.alias("conversation_id"), "user_id", F.size("messages").alias("n_messages"), F.array_join("source_payload_keys", ",").alias("leftover"))


@query(r"""SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), '[^A-Za-z0-9._-]', '', 'g'), 1, 64) AS slug,
 md5(CASE WHEN length(x) <= 120 THEN x ELSE substr(x, 1, 117) || '...' END) AS preview FROM (SELECT doc_id, text AS x FROM documents)""")
def slugs_and_previews(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.slug(F.col("text")).alias("slug"), F.md5(text.preview(F.col("text"))).alias("preview"))
