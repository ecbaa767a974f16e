"""Queries over runs: listing, detail, events, options and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import runs
from parley.plans import _EVENTS, _REACHED, _SPINE, _STATES, checkpoints, query, run_events, table


def manifests(spark, sf_dir):
    """Runs by user: every ninth folder begins with an underscore, every eleventh has no manifest."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.min("ts").alias("first"))
    u, name = F.col("user_id"), F.concat(F.lit("run-"), F.col("user_id").cast("string"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm")
    return e.select(F.concat(F.when(u % 9 == 0, "_").otherwise(""), name).alias("folder"), F.when(u % 11 != 0, name).alias("run_id"), stamp("first").alias("created"), stamp("last").alias("updated"), (u % 5 == 0).alias("locked"))


@query("""WITH r AS (SELECT CASE WHEN user_id % 9 = 0 THEN '_' ELSE '' END || 'run-' || user_id AS folder, CASE WHEN user_id % 11 <> 0 THEN 'run-' || user_id END AS run_id, strftime(min(ts), '%Y-%m-%dT%H:%M') AS created, strftime(max(ts), '%Y-%m-%dT%H:%M') AS updated, user_id % 5 = 0 AS locked FROM events GROUP BY user_id)
 SELECT *, (row_number() OVER (ORDER BY updated DESC, created DESC, run_id DESC))::INTEGER AS position FROM r WHERE NOT starts_with(folder, '_') AND run_id IS NOT NULL QUALIFY position <= 100""")
def run_listing(spark, sf_dir):
    return runs.listed(manifests(spark, sf_dir))


@query("SELECT 'run-1' AS run_id, strftime(min(ts), '%Y-%m-%dT%H:%M') AS created, strftime(max(ts), '%Y-%m-%dT%H:%M') AS updated FROM events WHERE user_id = 1 HAVING count(*) > 0")
def run_inspect(spark, sf_dir):
    return runs.resolved(manifests(spark, sf_dir), " run-1 ").select("run_id", "created", "updated")


def artifacts(spark, sf_dir):
    """Artifacts of runs: three required ones and six others, by event."""
    names = [*runs.REQUIRED, "facets_jsonl", "base_clusters_json", "hierarchy_json", "privacy_audit_json", "phase6_metrics_json", "tree_view_json"]
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).alias("run_id"), F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 9 + 1).cast("int")).alias("artifact"))


@query(f"""WITH {_SPINE}, {_REACHED}, {_STATES[_STATES.index('states AS'):]},
 pc2 AS (SELECT run_id, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status <> 'skipped') AS active, count(*) FILTER (status IN ('completed', 'resumed')) AS completed FROM line GROUP BY run_id),
 w AS (SELECT run_id, count(*) FILTER (status = 'warning') AS warnings FROM ev GROUP BY run_id),
 a AS (SELECT run_id, 3 - count(*) FILTER (k < 3) AS required_missing, count(*) FILTER (k >= 3) AS optional_present FROM (SELECT DISTINCT user_id % 50 AS run_id, event_id % 9 AS k FROM events) GROUP BY run_id)
 SELECT run_id, state, percent, failed, skipped, active, completed, warnings, coalesce(required_missing, 3) AS required_missing, coalesce(optional_present, 0) AS optional_present FROM states JOIN reached USING (run_id) JOIN pc2 USING (run_id) JOIN w USING (run_id) LEFT JOIN a USING (run_id)""")
def run_detail(spark, sf_dir):
    return runs.run_detail(run_events(spark, sf_dir), runs.checkpoint_progress(checkpoints(spark, sf_dir)), artifacts(spark, sf_dir))


@query("SELECT event_type, user_id % 50 AS run_id, min(event_id) AS first_seen FROM events GROUP BY ALL")
def event_first_seen(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("run_id", F.col("user_id") % 50)
    return runs.first_seen_events(e, ["event_type", "run_id"], "event_id")


@query("""SELECT event_id, h OR p OR l AS with_labeling, h OR p OR l OR c AS with_clustering, h OR p OR l OR c OR f AS with_facets, h AS with_hierarchy, p AS with_privacy, greatest(2, least(20, CASE WHEN event_id % 6 = 0 THEN 5 ELSE event_id % 25 END))::BIGINT AS hierarchy_levels,
 greatest(1, event_id % 40)::BIGINT AS stream_chunk_size, CASE WHEN event_id % 3 = 0 THEN 'kmeans' ELSE 'hybrid' END AS cluster_strategy, CASE WHEN event_id % 4 = 0 THEN 'drop' ELSE 'nearest' END AS noise_policy, CASE WHEN event_id % 10 > 5 THEN event_id % 10 - 5 END::BIGINT AS limit
 FROM (SELECT event_id, event_id % 2 = 0 AS f, event_id % 3 = 0 AS c, event_id % 5 = 0 AS l, event_id % 7 = 0 AS h, event_id % 11 = 0 AS p FROM events)""")
def launch_options(spark, sf_dir):
    n = F.col("event_id")
    flags = {f"with_{name}": (n % k == 0).cast("string") for name, k in (("facets", 2), ("clustering", 3), ("labeling", 5), ("hierarchy", 7), ("privacy", 11))}
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        *[c.alias(k) for k, c in flags.items()],
        F.when(n % 6 == 0, "many").otherwise((n % 25).cast("string")).alias("hierarchy_levels"),
        F.concat((n % 40).cast("string"), F.lit(".7")).alias("stream_chunk_size"),
        F.when(n % 3 == 0, "kmeans").otherwise("other").alias("cluster_strategy"),
        F.when(n % 4 == 0, "drop").otherwise(F.lit(None).cast("string")).alias("noise_policy"),
        (n % 10 - 5).cast("string").alias("limit"),
    )
    return runs.launch_options(raw)


@query("SELECT 'dataset_rows' AS key, count(*)::VARCHAR AS value FROM documents UNION ALL SELECT 'dataset_digest', bit_xor(b)::VARCHAR || ':' || sum(b)::VARCHAR FROM (SELECT ('0x' || substr(md5(text), 1, 15))::BIGINT AS b FROM documents) UNION ALL SELECT * FROM (VALUES ('limit', NULL), ('random_seed', '42'), ('strategy', 'hybrid')) AS s(key, value)")
def fingerprint_build(spark, sf_dir):
    return runs.fingerprint({"strategy": "hybrid", "random_seed": 42, "limit": None}, table(spark, sf_dir, "documents"), "text")


@query("""SELECT event_id, CASE WHEN n < 1000 THEN n::VARCHAR ELSE regexp_replace(printf('%.1f', round(n / CASE WHEN n < 999950 THEN 1e3 ELSE 1e6 END, 1)), '[.]0$', '') || CASE WHEN n < 999950 THEN 'K' ELSE 'M' END END AS shown FROM (SELECT event_id, event_id * event_id % 3000017 AS n FROM events)""")
def compact_numbers(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", text.compact((n * n % 3000017).cast("double")).alias("shown"))


@query(f"""WITH {_EVENTS}, r AS (SELECT run_id, arg_max(phase, event_id) AS current, run_id % 3 <> 0 AS locked FROM ev GROUP BY run_id),
 c AS (SELECT DISTINCT run_id, phase FROM ev WHERE status = 'completed' AND event_id % 3 = 0), m AS (SELECT run_id, phase, arg_max(status, event_id) AS said FROM ev WHERE status IN ('pending', 'running', 'completed', 'resumed', 'failed', 'skipped') AND event_id % 2 = 0 GROUP BY ALL),
 s AS (SELECT run_id, i::INTEGER - 1 AS ordinal, ['{"', '".join(runs.PHASES)}'][i] AS phase, current, locked FROM r, range(1, 8) AS t(i))
 SELECT run_id, ordinal, phase, CASE WHEN locked AND current = phase AND c.run_id IS NULL THEN 'running' WHEN said IS NOT NULL THEN said WHEN c.run_id IS NOT NULL THEN 'completed' ELSE 'pending' END AS status,
 CASE WHEN locked AND current = phase AND c.run_id IS NULL THEN 'lock' WHEN said IS NOT NULL THEN 'metric' WHEN c.run_id IS NOT NULL THEN 'manifest' ELSE 'none' END AS source FROM s LEFT JOIN c USING (run_id, phase) LEFT JOIN m USING (run_id, phase)""")
def resolved_timeline(spark, sf_dir):
    e = run_events(spark, sf_dir)
    current = e.groupBy("run_id").agg(F.max_by("phase", "event_id").alias("phase")).withColumn("locked", F.col("run_id") % 3 != 0)
    metrics = e.where("event_id % 2 = 0").select("run_id", "phase", "status", F.col("event_id").alias("ord"))
    return runs.resolved_timeline(current, e.where("status = 'completed' and event_id % 3 = 0").select("run_id", "phase"), metrics)
