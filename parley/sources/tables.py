"""Tables and lines of a run in the shared store: resume loaders, promotion, append and export sinks, tails of logs."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources import manifest
from parley.sources.jsonl import repeated_keys


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one of ``schema`` if nothing is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Tables of a run that a later run may take up again, and the columns of each.
RESUMABLE = {
    "facets": "conversation_id string, summary string, task string, language string, language_confidence double, concerning_score int, message_count int, user_message_count int, assistant_message_count int, avg_user_message_length double, avg_assistant_message_length double, turn_count int",
    "base_clusters": "cluster_id int, size long, unique_users long, centroid array<double>, kept_by_threshold boolean",
    "labeled_clusters": "cluster_id int, name string, description string, size long, unique_users long, kept_by_threshold boolean, labeling_fallback_used boolean, labeling_error string",
    "hierarchy": "node_id string, level int, name string, description string, size long, source_cluster_id int, parent_id string, children array<string>",
    "privacy_audit": "stage string, id string, rating int, justification string, fallback_used boolean, error string",
    "gated_clusters": "cluster_id int, name string, description string, size long, unique_users long, kept_by_threshold boolean, privacy_rating int, privacy_justification string, privacy_kept boolean, final_kept boolean",
    "evaluation": "representation string, n long, accuracy double, macro_f1 double, weighted_f1 double, language_metrics map<string,double>, error string",
}


#: Under which key the JSON object of a table holds its rows.
ROWS = {"base_clusters": "clusters", "labeled_clusters": "clusters", "gated_clusters": "clusters", "hierarchy": "nodes", "privacy_audit": "audits", "evaluation": "representations"}


def resumable(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the run at ``root``, empty if it was not written: a Parquet folder, JSON lines, or an object that holds rows under the
    key of ROWS. A torn line gives no row, an object that is torn or lacks the key no rows: what they held is made again."""
    schema = RESUMABLE[name]
    repeated_keys(spark)
    if manifest.exists(spark, f"{root}/{name}"):
        return read_or_empty(spark, f"{root}/{name}", schema)
    fields = f"struct<{schema}>"
    if manifest.exists(spark, f"{root}/{name}.jsonl"):
        row = F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"})
        lines = spark.read.text(f"{root}/{name}.jsonl").where(F.trim("value") != "")
        # A record is torn if it does not parse as any JSON at all; missing fields are null.
        return lines.where(F.try_parse_json("value").isNotNull()).select(row.alias("r")).select("r.*")
    if name in ROWS and manifest.exists(spark, f"{root}/{name}.json"):
        text = spark.read.text(f"{root}/{name}.json", wholetext=True)
        held = F.from_json("value", f"{ROWS[name]} array<{fields}>")
        return text.where(F.try_parse_json("value").isNotNull()).select(F.explode(held[ROWS[name]]).alias("r")).select("r.*")
    return spark.createDataFrame([], schema)


def resumable_privacy(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Audits and gated clusters of a run: both, or neither if one is missing."""
    names = ("privacy_audit", "gated_clusters")
    found = tuple(resumable(spark, root, k) for k in names)
    there = [any(manifest.exists(spark, f"{root}/{k}{end}") for end in ("", ".jsonl", ".json")) for k in names]
    return found if all(there) else tuple(t.limit(0) for t in found)


def append(df: DataFrame, path: str) -> None:
    """Add rows of a partial result; readers see whole files only."""
    df.write.mode("append").parquet(path)


#: The phase whose partial results may be promoted, and the note of a checkpoint that was.
PROMOTED_PHASE, PROMOTED_NOTE = "phase2_facet_extraction", "promoted_from_partial"


def promote(spark: SparkSession, root: str, partial: str, schema: str, *, name: str = "facets", errors: str | None = None, phase: str = PROMOTED_PHASE) -> dict:
    """Make a partial table (the folder ``partial``) the final table ``name`` of the run at ``root``; gives the new manifest.

    A run or a partial table that is not there, a partial one without rows, and a final one that is there already are refused, and then
    nothing changes. The final table, that of errors if there are any, the checkpoint and the completed phases are all named by one
    version of the manifest: readers see all of it or nothing.
    """
    if not manifest.exists(spark, root):
        raise FileNotFoundError(f"no run at {root}")
    if not manifest.exists(spark, partial):
        raise FileNotFoundError(f"no partial table at {partial}")
    version, held = manifest.read(spark, root)
    if name in held.get("tables", {}):
        raise FileExistsError(f"{name} is final already")
    rows = spark.read.schema(schema).parquet(partial)
    if not rows.limit(1).count():
        raise ValueError("the partial table is empty")
    new = {name: manifest.write_table(rows, root, name)}
    n = spark.read.schema(schema).parquet(f"{root}/{new[name]}").count()
    failed = 0
    if errors and manifest.exists(spark, errors):
        wrong = spark.read.parquet(errors)
        failed = wrong.count()
        if failed:
            new[f"{name}_errors"] = manifest.write_table(wrong, root, f"{name}_errors")

    def change(m: dict) -> dict:
        m["tables"] = m.get("tables", {}) | new
        m["completed_phases"] = sorted({*m.get("completed_phases", []), phase})
        m["checkpoints"] = m.get("checkpoints", {}) | {phase: m.get("checkpoints", {}).get(phase, {"phase": phase}) | {"completed": True, "note": PROMOTED_NOTE, f"{name}_count_success": n, "error_count_recorded": failed}}
        return m | {"phase": phase, "conversation_count_processed": n, "error_count": failed, "promoted_from_partial": True}

    return manifest.commit(spark, root, change, version)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, without the keys that are null."""
    df.write.mode("overwrite").json(path, ignoreNullFields=True)


def write_object(df: DataFrame, root: str, name: str) -> None:
    """One row as one JSON object, with its nulls, as a version of the manifest: readers see the old object or the new one."""
    rows = df.limit(2).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).collect()
    if len(rows) != 1:
        raise ValueError("an object is one row")
    value = json.loads(rows[0]["j"])
    manifest.commit(df.sparkSession, root, lambda m: m | {"objects": m.get("objects", {}) | {name: value}})


def read_object(spark: SparkSession, root: str, name: str) -> dict:
    """The object that was written last; {} if none was."""
    return manifest.read(spark, root)[1].get("objects", {}).get(name, {})


def read_object_file(spark: SparkSession, path: str) -> dict:
    """The JSON object that a file holds, as other tools write it; {} if the file is missing, torn or holds something else."""
    if not manifest.exists(spark, path):
        return {}
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    try:
        value = json.loads(rows[0]["value"]) if rows else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


#: The head of the table that ``report_lines`` makes.
REPORT_HEAD = ("# Evaluation", "", "| representation | n | accuracy | macro F1 | weighted F1 |", "|-|-|-|-|-|")


def report_lines(scores: DataFrame) -> DataFrame:
    """(line) of a Markdown report: REPORT_HEAD, then a row for each representation of scores."""
    rows = scores.select(F.format_string("| %s | %d | %.4f | %.4f | %.4f |", "representation", "n", "accuracy", "macro_f1", "weighted_f1").alias("line"))
    return scores.sparkSession.createDataFrame([(x,) for x in REPORT_HEAD], "line string").union(rows)


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` of numbered lines, between 20 and 500, in their order."""
    return lines.orderBy(F.desc("line_number")).limit(max(20, min(500, n))).orderBy("line_number")


#: Bytes that a tail reads at a time.
TAIL_BLOCK = 1 << 16


def tail_file(spark: SparkSession, path: str, n: int) -> tuple[DataFrame, int]:
    """((position, line), bytes read): the last ``n`` lines of a log, between 20 and 500, in their order, position from 1.

    ``path`` is a file, or a folder of files that follow each other by name. Blocks are read from the end backwards until there are
    lines enough, so what is read does not grow with the log. The line break at the end ends a line and begins none.
    """
    n = max(20, min(500, n))
    jvm, place = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(f.getPath().getName(), f.getPath(), f.getLen()) for f in system.listStatus(place) if f.isFile() and f.getPath().getName()[0] not in "._"]
    lines: list[bytes] = []
    read = 0
    for _, name, at in sorted(files, key=lambda f: f[0], reverse=True):
        held = b""
        stream = system.open(name)
        try:
            while at > 0 and held.rstrip(b"\n").count(b"\n") < n - len(lines):
                size = min(TAIL_BLOCK, at)
                at -= size
                stream.seek(at)
                held = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) + held
                read += size
        finally:
            stream.close()
        parts = held.removesuffix(b"\n").split(b"\n") if held else []
        if at > 0:
            parts = parts[1:]  # it begins before what was read
        lines = parts[max(0, len(parts) - (n - len(lines))) :] + lines
        if len(lines) >= n:
            break
    rows = [(i, line.decode("utf-8", "replace").removesuffix("\r")) for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "position int, line string"), read
