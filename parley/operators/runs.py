"""Runs and their events: state, timeline, progress, retention, drift of settings, and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import percent

#: The phases of a run, in order.
PHASES = ("phase1_dataset_load", "phase2_facet_extraction", "phase3_base_clustering", "phase4_cluster_labeling", "phase4_hierarchy_scaffold", "phase5_privacy_audit", "phase6_evaluation")


def latest_status(events: DataFrame) -> DataFrame:
    """(run_id, phase, status): the last event of each phase wins."""
    return events.groupBy("run_id", "phase").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def run_state(locked: Column, failed: Column, warned: Column, measured: Column) -> Column:
    return F.when(locked, "running").when(failed, "failed").when(warned, "completed_with_warnings").when(measured, "completed").otherwise("partial")


def states(events: DataFrame) -> DataFrame:
    """(run_id, state) from the latest status of each phase."""
    s = F.col("status")
    flags = latest_status(events).groupBy("run_id").agg(*[F.bool_or(s == k).alias(k) for k in ("running", "failed", "warning", "completed")])
    return flags.select("run_id", run_state(F.col("running"), F.col("failed"), F.col("warning"), F.col("completed")).alias("state"))


def state_counts(events: DataFrame) -> DataFrame:
    s = F.col("state")
    return states(events).agg(F.count("*").alias("total"), F.count_if(s == "running").alias("running"), F.count_if(s.startswith("completed")).alias("completed"), F.count_if(s == "failed").alias("failed"))


def timeline(events: DataFrame) -> DataFrame:
    """Every phase of every run, pending where nothing happened."""
    spine = events.select("run_id").distinct().withColumn("p", F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("phase")) for i, k in enumerate(PHASES)])))
    out = spine.select("run_id", "p.ordinal", "p.phase").join(latest_status(events), ["run_id", "phase"], "left")
    return out.select("run_id", "ordinal", "phase", F.coalesce("status", F.lit("pending")).alias("status"))


#: The statuses of a metric that say something of its phase.
METRIC_STATUS = ("pending", "running", "completed", "resumed", "failed", "skipped")


def resolved_timeline(runs: DataFrame, completed: DataFrame, metrics: DataFrame) -> DataFrame:
    """(run_id, ordinal, phase, status, source) of every phase of ``runs`` (run_id, phase: the current one, locked), by rank of three sources.

    A phase of ``completed`` (run_id, phase) is completed; the last of ``metrics`` (run_id, phase, status, ord) that says
    anything goes before that; a lock makes the current phase run unless it is completed. Where none speaks it is pending.
    """
    spine = runs.select("run_id", F.col("phase").alias("current"), "locked", F.posexplode(F.array(*map(F.lit, PHASES))).alias("ordinal", "phase"))
    last = metrics.where(F.col("status").isin(*METRIC_STATUS)).groupBy("run_id", "phase").agg(F.max_by("status", "ord").alias("said"))
    done = completed.select("run_id", "phase", F.lit(True).alias("done")).distinct()
    found = spine.join(done, ["run_id", "phase"], "left").join(last, ["run_id", "phase"], "left")
    running = F.coalesce(F.col("locked"), F.lit(False)) & F.coalesce(F.col("current") == F.col("phase"), F.lit(False)) & F.col("done").isNull()
    ranked = lambda a, b, c, d: F.when(running, a).when(F.col("said").isNotNull(), b).when(F.col("done"), c).otherwise(d)
    return found.select("run_id", "ordinal", "phase", ranked(F.lit("running"), F.col("said"), F.lit("completed"), F.lit("pending")).alias("status"), ranked(*map(F.lit, ("lock", "metric", "manifest", "none"))).alias("source"))


def progress(events: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """(run_id, percent): completed and resumed phases, and the measured percent of the first one that runs, over those not skipped.

    A run whose phases are all skipped is at 100. ``checkpoints`` (run_id, phase, percent) are those of ``checkpoint_progress``.
    """
    line = timeline(events)
    line = line.withColumn("measured", F.lit(None).cast("double")) if checkpoints is None else line.join(checkpoints.select("run_id", "phase", F.col("percent").alias("measured")), ["run_id", "phase"], "left")
    s = F.col("status")
    sums = line.groupBy("run_id").agg(
        F.count_if(s != "skipped").alias("active"), F.count_if(s.isin("completed", "resumed")).alias("done"), F.min_by("measured", F.when(s == "running", F.col("ordinal"))).alias("running")
    )
    reached = (100.0 * F.col("done") + F.coalesce("running", F.lit(0.0))) / F.col("active")
    return sums.select("run_id", F.when(F.col("active") == 0, 100.0).otherwise(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), reached)), 1)).alias("percent"))


def latest_events(events: DataFrame, n: int = 40) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def throttled(events: DataFrame, every: float = 0.05, seconds: float = 2.0) -> DataFrame:
    """Progress events (run_id, done, total, ts) that are shown: the first, the last, each new share bucket, or after a pause."""
    w = Window.partitionBy("run_id").orderBy("ts", "done")
    bucket = F.floor(F.col("done") / F.col("total") / every)
    seconds_since = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(w)
    shown = (F.col("done") == 1) | (F.col("done") == F.col("total")) | (bucket > F.lag(bucket).over(w)) | (seconds_since >= seconds)
    return events.withColumn("shown", F.coalesce(shown, F.lit(True))).where("shown").drop("shown")


def prune_plan(runs: DataFrame, *, keep_last: int, cutoff: Column) -> DataFrame:
    """(run_id, action): the newest ``keep_last`` are always kept, locked runs are skipped, the rest goes.

    Every run past the newest is a candidate, whatever its age; age alone only marks newest runs as kept though old.
    """
    newest = runs.orderBy(F.desc("updated"), F.desc("run_id")).limit(keep_last).select("run_id", F.lit(True).alias("newest"))
    out = runs.join(F.broadcast(newest), "run_id", "left")
    action = F.when(F.col("newest") & (F.col("updated") < cutoff), "skipped_keep").when(F.col("newest"), "keep").when(F.col("locked"), "skipped_locked").otherwise("delete")
    return out.select("run_id", action.alias("action"))


def settings_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, was, now) of settings (key, value) that differ or stand on one side only."""
    both = before.select("key", F.col("value").alias("was")).join(after.select("key", F.col("value").alias("now")), "key", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


#: Prompt tokens of a request and seconds of one, by kind; tokens of an answer for each of its prompt.
TOKENS = {"label": 700, "hierarchy": 900, "privacy": 500, "eval": 1200}
SECONDS = {"facet": 2.0, "clustering": 4.0, "label": 2.0, "hierarchy": 2.5, "privacy": 1.8, "eval": 1.5}
ANSWER_SHARE = 0.35


def preflight(
    summary: DataFrame,
    *,
    target_size: int = 25,
    least: int = 20,
    most: int = 600,
    group_size: int = 8,
    raw_sample: int = 40,
    validation_cases: int = 20,
    eval_requests: int = 3,
    at_once: dict[str, int] | None = None,
    input_cost: float | None = None,
    output_cost: float | None = None,
) -> DataFrame:
    """Requests, tokens, seconds and cost that a run over conversations (conversations, avg_turns) may take, by fixed rates.

    ``at_once``: requests at a time, by kind (8 each). Costs are for a million tokens; without them the cost is null.
    """
    wide = {k: max(1, (at_once or {}).get(k, 8)) for k in ("facet", "label", "hierarchy", "privacy")}
    n = F.col("conversations")
    k = F.greatest(F.lit(1), F.least(F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.greatest(F.lit(1), n) / target_size))), F.greatest(F.lit(1), n))).cast("long")
    out = summary.select("conversations", "avg_turns", k.alias("clusters"))
    upper = F.greatest(F.lit(1), F.ceil(F.col("clusters") / group_size)).cast("long")
    privacy = F.least(F.lit(raw_sample), n) + n + F.col("clusters") + F.least(F.lit(validation_cases), n)
    out = out.withColumns({"hierarchy": upper, "privacy": privacy})
    prompt = n * F.greatest(F.lit(120), F.floor(90 * F.col("avg_turns"))) + F.col("clusters") * TOKENS["label"] + F.col("hierarchy") * TOKENS["hierarchy"] + F.col("privacy") * TOKENS["privacy"] + eval_requests * TOKENS["eval"]
    out = out.withColumn("prompt_tokens", prompt.cast("long")).withColumn("completion_tokens", F.floor(F.col("prompt_tokens") * ANSWER_SHARE).cast("long"))
    seconds = n / wide["facet"] * SECONDS["facet"] + SECONDS["clustering"] + F.col("clusters") / wide["label"] * SECONDS["label"] + F.col("hierarchy") / wide["hierarchy"] * SECONDS["hierarchy"]
    seconds = seconds + F.col("privacy") / wide["privacy"] * SECONDS["privacy"] + eval_requests * SECONDS["eval"]
    cost = F.lit(None).cast("double")
    if input_cost is not None and output_cost is not None:
        cost = F.col("prompt_tokens") / 1e6 * input_cost + F.col("completion_tokens") / 1e6 * output_cost
    return out.select(
        "clusters", (n + F.col("clusters") + F.col("hierarchy") + F.col("privacy") + eval_requests).alias("requests"), "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.round(seconds, 3).alias("seconds"), F.round(cost, 6).alias("cost")
    )


def checkpoint_progress(checkpoints: DataFrame) -> DataFrame:
    """(run_id, phase, processed, total, percent) from rows (run_id, phase, part, processed, total): the parts of a phase are summed.

    percent is null where no total is known.
    """
    out = checkpoints.groupBy("run_id", "phase").agg(F.sum("processed").alias("processed"), F.sum("total").alias("total"))
    return out.withColumn("percent", F.when(F.col("total") > 0, percent(F.col("processed"), F.col("total"))))


def phase_counts(events: DataFrame) -> DataFrame:
    """(run_id, failed, skipped, active, completed): the phases of each run by their status; all that are not skipped are active."""
    s = F.col("status")
    return timeline(events).groupBy("run_id").agg(
        F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s != "skipped").alias("active"), F.count_if(s.isin("completed", "resumed")).alias("completed")
    )


def merged_events(*logs: DataFrame) -> DataFrame:
    """Events of several logs in one, by the names of their columns; columns that a log lacks are null."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def usage(metrics: DataFrame) -> DataFrame:
    """By run: requests, prompt and completion tokens summed over the phases, and their total; nulls count as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = metrics.groupBy("run_id").agg(total("requests").alias("requests"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"))
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def merged_manifest(manifests: DataFrame) -> DataFrame:
    """(run_id, completed_phases, output_files) of manifests (run_id, seq, completed_phases, output_files): the sorted union of phases,
    and of each file name the path that was written last, as ``name=path``."""
    phases = manifests.select("run_id", F.explode("completed_phases").alias("phase")).distinct()
    phases = phases.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("phase")), ",").alias("completed_phases"))
    files = manifests.select("run_id", "seq", F.explode("output_files").alias("name", "path")).groupBy("run_id", "name").agg(F.max_by("path", "seq").alias("path"))
    files = files.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("="), "path"))), ",").alias("output_files"))
    out = manifests.select("run_id").distinct().join(phases, "run_id", "left").join(files, "run_id", "left")
    return out.select("run_id", F.coalesce("completed_phases", F.lit("")).alias("completed_phases"), F.coalesce("output_files", F.lit("")).alias("output_files"))


def listed(manifests: DataFrame, n: int = 100) -> DataFrame:
    """The newest runs of manifests (folder, run_id, created, updated: texts, locked) with their position: by update, creation and
    id, all falling. Folders that begin with ``_`` and rows without a manifest (null run_id) are no runs; 0 lists all."""
    found = manifests.where(~F.col("folder").startswith("_") & F.col("run_id").isNotNull())
    order = [F.desc("updated"), F.desc("created"), F.desc("run_id")]
    if n > 0:
        first = found.orderBy(*order).limit(n)
        return first.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # n rows
    return found.orderBy(*order)


def resolved(manifests: DataFrame, run_id: str) -> DataFrame:
    """The one run with this id; an error if there is none."""
    if not run_id.strip():
        raise ValueError("run_id must not be empty")
    found = listed(manifests, 0).where(F.col("run_id") == run_id.strip()).limit(1)
    if not found.count():
        raise ValueError(f"no run {run_id.strip()}")
    return found


#: Artifacts of a run that must be there, and those that may.
REQUIRED = ("run_manifest_json", "conversation_jsonl", "conversation_updated_jsonl")


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    """(run_id, required_missing, optional_present) from artifacts (run_id, artifact) that exist, repeated or not."""
    there = artifacts.select("run_id", "artifact").distinct()
    needed = F.count_if(F.col("artifact").isin(*REQUIRED))
    return there.groupBy("run_id").agg((F.lit(len(REQUIRED)) - needed).alias("required_missing"), (F.count("*") - needed).alias("optional_present"))


def run_detail(events: DataFrame, checkpoints: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row for each run: state, percent, its phases by status, artifacts, and how many of its events are warnings."""
    warnings = events.groupBy("run_id").agg(F.count_if(F.col("status") == "warning").alias("warnings"))
    out = states(events).join(progress(events, checkpoints), "run_id").join(phase_counts(events), "run_id").join(warnings, "run_id")
    found = out.join(artifact_counts(artifacts), "run_id", "left")
    return found.withColumns({"required_missing": F.coalesce("required_missing", F.lit(len(REQUIRED)).cast("long")), "optional_present": F.coalesce("optional_present", F.lit(0).cast("long"))})


def first_seen_events(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first event of each key, with the order in which it was first seen."""
    return events.groupBy(*key).agg(F.min(order).alias("first_seen"))


def dataset_digest(rows: DataFrame, column: str) -> DataFrame:
    """(rows, digest) of a column of text, whatever the order of the rows: an exclusive or of 60 bits of MD5, and their sum, in which equal
    rows do not cancel."""
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col(column), F.lit(""))), 1, 15), 16, 10).cast("long")
    both = F.concat_ws(":", F.coalesce(F.bit_xor(bits), F.lit(0)).cast("string"), F.coalesce(F.sum(bits.cast("decimal(38,0)")), F.lit(0)).cast("string"))
    return rows.agg(F.count("*").alias("rows"), both.alias("digest"))


def fingerprint(settings: dict[str, object], data: DataFrame, column: str) -> DataFrame:
    """(key, value) of a run's settings and of its data, for ``settings_drift`` with those of an earlier run."""
    digest = dataset_digest(data, column)
    own = digest.select(F.explode(F.array(F.struct(F.lit("dataset_rows").alias("key"), F.col("rows").cast("string").alias("value")), F.struct(F.lit("dataset_digest").alias("key"), F.col("digest").cast("string").alias("value")))).alias("x")).select("x.*")
    given = [(str(k), None if v is None else str(v)) for k, v in sorted(settings.items())]
    return own.union(data.sparkSession.createDataFrame(given, "key string, value string"))


def launch_options(raw: DataFrame) -> DataFrame:
    """Options of a launch in their limits, from raw ones as texts: a phase brings those that it needs, numbers are cut to whole ones
    within their range, unknown names become the default, and a limit of 0 or less is none."""
    on = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    number = lambda c, default: F.coalesce(F.floor(F.col(c).try_cast("double")), F.lit(default)).cast("long")
    named = lambda c, names: F.when(F.col(c).isin(*names[1:]), F.col(c)).otherwise(F.lit(names[0]))
    labelling = on("with_labeling") | on("with_hierarchy") | on("with_privacy")
    clustering = on("with_clustering") | labelling
    limit = F.floor(F.col("limit").try_cast("double")).cast("long")
    return raw.withColumns(
        {
            "with_labeling": labelling,
            "with_clustering": clustering,
            "with_facets": on("with_facets") | clustering,
            "with_hierarchy": on("with_hierarchy"),
            "with_privacy": on("with_privacy"),
            "hierarchy_levels": F.greatest(F.lit(2), F.least(F.lit(20), number("hierarchy_levels", 5))),
            "stream_chunk_size": F.greatest(F.lit(1), number("stream_chunk_size", 32)),
            "cluster_strategy": named("cluster_strategy", ("hybrid", "kmeans", "hdbscan")),
            "noise_policy": named("noise_policy", ("nearest", "singleton", "drop")),
            "limit": F.when(limit > 0, limit),
        }
    )
