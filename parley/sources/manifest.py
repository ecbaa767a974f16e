"""The manifest of a run: numbered versions, of which readers follow the last.

A version is a small JSON file that is written under another name and then renamed to its number, which fails if that number is
taken. So readers see a whole version or the one before, and of two writers one is told to read again. Tables are folders that
a version names; they are written before the version that names them, and never changed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has made the same version."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _system(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    return _system(spark, name).exists(_path(spark, name))


def _versions(spark: SparkSession, root: str) -> list[int]:
    folder = f"{root}/manifest"
    if not exists(spark, folder):
        return []
    names = [f.getPath().getName() for f in _system(spark, folder).listStatus(_path(spark, folder))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(version, manifest); version 0 is an empty one."""
    versions = _versions(spark, root)
    if not versions:
        return 0, {}
    lines = spark.read.text(f"{root}/manifest/{versions[-1]:08d}.json", wholetext=True).collect()
    return versions[-1], json.loads(lines[0]["value"])


def commit(spark: SparkSession, root: str, change: Callable[[dict], dict], version: int | None = None) -> dict:
    """Writes the version after ``version`` (the last, if left out): ``change`` of its manifest. A taken number is a Conflict."""
    last, held = read(spark, root)
    if version is not None and version != last:
        raise Conflict(f"version {last} is there, {version} was expected")
    new = change(json.loads(json.dumps(held))) | {"updated_at_utc": datetime.now(UTC).isoformat()}
    beside, final = (_path(spark, f"{root}/manifest/{n}") for n in (f".{uuid.uuid4().hex}", f"{last + 1:08d}.json"))
    out = _system(spark, root).create(beside, False)
    try:
        out.write(bytearray(json.dumps(new, indent=2).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_system(spark, root).getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(beside, final, none)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        _system(spark, root).delete(beside, False)
        raise Conflict(f"version {last + 1} is there already") from None
    return new


def write_table(df: DataFrame, root: str, name: str) -> str:
    """Writes ``df`` to a folder of its own under ``root``; its name relative to that. It is no part of the run until a version names it."""
    folder = f"{name}/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    return folder


def table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame | None:
    """The table that the last version names, or none."""
    folder = read(spark, root)[1].get("tables", {}).get(name)
    return None if folder is None else spark.read.schema(schema).parquet(f"{root}/{folder}")
