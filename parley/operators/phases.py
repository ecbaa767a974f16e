"""A phase that asks a model for every row, in waves that are committed one by one: a run that fails keeps what it has paid for.

Rows without a good answer are dealt into waves. A wave is a Spark job; its answers are a table of their own, and the manifest names
that table with the wave's number once it is written. A later run asks for the rows that no committed wave has answered well.

Inside a task requests go through a pool of threads. Its width is moved by one after each round of requests: down after any issue, up
after a clean round while there is more to ask.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.providers import Answerer, next_width, ProviderError, reconciled, RuleAnswerer
from parley.sources import manifest
from parley.sources.store import stage

#: Rows of a wave, about.
WAVE_ROWS = 10_000


def ask(items: list[tuple[object, str]], task: str, provider: Answerer) -> tuple[list[dict], bool]:
    """(a row (id, answer, fallback_used, error) for each of a batch of items, whether there was an issue): what the batch leaves out, or
    all of it if the batch fails, is asked again one by one; what fails then has no answer."""
    keys = [k for k, _ in items]
    try:
        found, errors = reconciled(keys, provider.complete(task, items))
    except ProviderError as failed:
        found, errors = {}, dict.fromkeys(keys, str(failed)[:500])
    rows, issue = [], bool(errors)
    for k, text in items:
        if k in found:
            rows.append({"id": k, "answer": found[k], "fallback_used": False, "error": errors.get(k)})
            continue
        answer, error = None, errors[k]
        try:
            one, wrong = reconciled([k], provider.complete(task, [(k, text)]))
            answer, error = one.get(k), error if k in one else wrong[k]
        except ProviderError as failed:
            error = str(failed)[:500]
        rows.append({"id": k, "answer": answer, "fallback_used": True, "error": error})
    return rows, issue


def adaptive(batches: Iterator[list[tuple[object, str]]], task: str, provider: Answerer, most: int) -> Iterator[tuple[int, int, list[dict]]]:
    """(round, width, rows) of every round of requests: ``width`` batches at once, from ``most`` on, results in the order of the batches."""
    batches = iter(batches)
    waiting = [b for _, b in zip(range(most), batches, strict=False)]
    width, n = max(1, min(most, len(waiting))), 0
    with ThreadPoolExecutor(most) as pool:
        while waiting:
            now, waiting = waiting[:width], waiting[width:]
            found = list(pool.map(lambda b: ask(b, task, provider), now))
            yield n, width, [row for rows, _ in found for row in rows]
            waiting += [b for _, b in zip(range(most + 1 - len(waiting)), batches, strict=False)]
            width, n = next_width(width, sum(issue for _, issue in found), most, bool(waiting)), n + 1


def _asked(key: str, kind: str, fields: str, task: str, provider: Answerer, batch: int, most: int):
    names = [f.split()[0] for f in fields.split(", ")]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        def cut() -> Iterator[list[tuple[object, str]]]:
            for frame in frames:
                items = [*zip(frame[key].tolist(), frame["t"].tolist(), strict=True)]
                yield from (items[at : at + batch] for at in range(0, len(items), batch))

        for n, width, rows in adaptive(cut(), task, provider, most):
            out = [{key: r["id"], **{f: (r["answer"] or {}).get(f) for f in names}, "ok": r["answer"] is not None, "fallback_used": r["fallback_used"], "error": r["error"], "round": n, "width": width} for r in rows]
            yield pd.DataFrame(out)

    return run, f"{key} {kind}, {fields}, ok boolean, fallback_used boolean, error string, round int, width int"


def committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of all committed waves of a phase, with the number of their wave."""
    held = manifest.read(spark, root)[1].get("waves", {}).get(name, [])
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{w['folder']}" for w in held])


def best_rows(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key: its last good one, or else its last; an error drops out once an answer is there."""
    names = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("ok", "wave")).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in names])


def run_phase(
    df: DataFrame, key: str, text: str, task: str, fields: str, fallback: dict, *, root: str, name: str, provider: Answerer | None = None, batch: int = 8, most: int = 8, wave_rows: int | None = None
) -> DataFrame:
    """(key, fields, fallback_used, error) for every row of ``df``, whose keys do not repeat: answers of this run and of those before it at ``root``.

    A key that no run has answered gets ``fallback``, in whose texts ``{id}`` stands for the key, and the last error; a later run asks for
    it again. Answers of keys that ``df`` lacks are left out. Null texts are empty. The manifest has, under ``waves``, a number, the rows
    and the errors of each committed wave, and under ``checkpoints`` how far the phase is.
    """
    spark, provider = df.sparkSession, provider or RuleAnswerer()
    run, schema = _asked(key, df.schema[key].dataType.simpleString(), fields, task, provider, batch, most)
    whole = schema + ", wave int"
    wanted = stage(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")), "wanted")
    done = committed(spark, root, name, whole).where("ok").select(key).distinct()
    rest = wanted.join(done, key, "left_anti")
    total, left = wanted.count(), rest.count()
    waves = -(-left // (wave_rows or WAVE_ROWS))
    if waves:
        rest = rest.withColumn("wave", F.pmod(F.xxhash64(key), F.lit(waves)).cast("int"))
        rest = stage(rest.repartition("wave"), "waves")  # written once: a wave reads its own rows alone
    for n in range(waves):
        own = rest.where(F.col("wave") == n).drop("wave")
        number = len(manifest.read(spark, root)[1].get("waves", {}).get(name, [])) + 1
        parts = max(1, spark.sparkContext.defaultParallelism)
        folder = manifest.write_table(own.repartition(parts, key).mapInPandas(run, schema).withColumn("wave", F.lit(number)), root, name)
        seen = spark.read.schema(whole).parquet(f"{root}/{folder}").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors")).first()
        left -= seen["n"] - seen["errors"]

        def change(m: dict, n: int = n, seen=seen, folder: str = folder, number: int = number, left: int = left) -> dict:
            every = m.get("waves", {})
            m["waves"] = every | {name: [*every.get(name, []), {"wave": number, "folder": folder, "rows": seen["n"], "errors": seen["errors"]}]}
            m["checkpoints"] = m.get("checkpoints", {}) | {name: {"phase": name, "total": total, "processed": total - left, "completed": n == waves - 1}}
            return m

        manifest.commit(spark, root, change)
    names = [f.split()[0] for f in fields.split(", ")]
    found = best_rows(committed(spark, root, name, whole), key)
    rows = wanted.select(key).join(found, key, "left")
    filled = []
    for f in names:
        v = fallback[f]
        given = F.replace(F.lit(v), F.lit("{id}"), F.col(key).cast("string")) if isinstance(v, str) else F.lit(v)
        filled.append(F.when(F.coalesce("ok", F.lit(False)), F.col(f)).otherwise(given).alias(f))
    return rows.select(key, *filled, F.coalesce("fallback_used", F.lit(True)).alias("fallback_used"), "error")
