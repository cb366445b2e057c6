"""Sinks: atomic tables and documents, unchanged content left alone, write-once evidence, digest manifests."""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import frame_digest


#: A table is a folder of generations and a pointer to the current one; the pointer's name hides it from Spark's own reader.
POINTER, GENERATION = "_current", "generation-"


def _fs(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def current_generation(spark: SparkSession, path: str) -> str | None:
    """The folder that the table's pointer names; null where nothing was published yet."""
    fs, pointer = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path}/{spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as last published."""
    made = current_generation(spark, path)
    if made is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(made)


def write_table(df: DataFrame, path: str) -> str:
    """Publishes a new generation of the table and returns its folder: the rows go to a folder of their own, then the pointer file is
    replaced in one atomic rename. Readers see the old generation or the new one, and a crash before the rename
    leaves the old one in place. The generation before is kept for readers at work, older ones are removed."""
    spark = df.sparkSession
    before = current_generation(spark, path)
    name = f"{GENERATION}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{name}")
    fs, draft = _fs(spark, f"{path}/.{name}.pointer")
    stream = fs.create(draft, True)
    stream.write(name.encode())
    stream.close()
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    draft, pointer = fs.makeQualified(draft), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, pointer, how)
    for found in fs.listStatus(pointer.getParent()):
        folder = found.getPath().getName()
        if folder.startswith(GENERATION) and folder != name and folder != (before or "").rsplit("/", 1)[-1]:
            fs.delete(found.getPath(), True)
    return f"{path}/{name}"


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Publishes unless the table at `path` holds the same rows; copies count, row order doesn't."""
    if current_generation(df.sparkSession, path):
        old = read_table(df.sparkSession, path)
        if old.columns == df.columns and frame_digest(old, old.columns).first() == frame_digest(df, df.columns).first():
            return False
    write_table(df, path)
    return True


def plain_json(value: Any) -> Any:
    """What JSON can hold: not-a-number and infinity become null, dates their ISO text."""
    if isinstance(value, dict):
        return {str(k): plain_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain_json(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value.isoformat() if hasattr(value, "isoformat") else value


def write_document(value: Any, path: str) -> None:
    """A small JSON document with sorted keys, put in place at once."""
    folder = Path(path).parent
    folder.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder, prefix=".writing-")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(plain_json(value), f, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def write_once(value: Any, path: str) -> bool:
    """Evidence that is never overwritten: True if it was new, False if the same is there, an error if it differs."""
    text = json.dumps(plain_json(value), sort_keys=True, allow_nan=False, ensure_ascii=False)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o444)
    except FileExistsError:
        if Path(path).read_text(encoding="utf-8") == text:
            return False
        raise ValueError(f"{path} holds something else") from None
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    return True


def manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(name, bytes, sha256) of the files in a folder, hashed where they are read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_violations(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, problem): MISSING, UNEXPECTED or CHANGED files."""
    both = expected.select("name", F.col("sha256").alias("want")).join(found.select("name", F.col("sha256").alias("have")), "name", "full")
    problem = F.when(F.col("have").isNull(), "MISSING").when(F.col("want").isNull(), "UNEXPECTED").when(F.col("want") != F.col("have"), "CHANGED")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def digest_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()
