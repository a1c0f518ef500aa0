"""Readers and writers of the other inputs and outputs: keyed CSV, Parquet by key, versioned JSON, digests."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under a declared schema, so that ids stay text; a byte-order mark is no part of the first name."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def write_csv(table: DataFrame, path: str) -> None:
    """A small result as one CSV part with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_observations(table: DataFrame, path: str, files: int = 200) -> int:
    """Parquet clustered by sensor, so that one sensor's rows lie in few row groups; returns the rows read back."""
    clustered = table.repartitionByRange(files, "sensor_id", "ts").sortWithinPartitions("sensor_id", "ts")
    clustered.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return table.sparkSession.read.parquet(path).count()


def sensor_history(spark: SparkSession, path: str, sensor_id: str) -> DataFrame:
    """One sensor's rows in time order; the id's filter reaches the Parquet scan."""
    return spark.read.parquet(path).where(F.col("sensor_id") == sensor_id).orderBy("ts")


@dataclass(frozen=True)
class Artifact:
    data: dict[str, Any] | None
    error: str | None

    @property
    def available(self) -> bool:
        return self.data is not None


def read_artifact(spark: SparkSession, path: str, required: set[str], version: str = "1.0") -> Artifact:
    """JSON document with a ``schema_version`` and required fields; the error says which check failed."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as error:  # Spark reports an absent path as an analysis error
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return Artifact(None, "missing")
    try:
        data = json.loads(rows[0][0]) if rows else None
    except json.JSONDecodeError:
        return Artifact(None, "not JSON")
    if not isinstance(data, dict):
        return Artifact(None, "not an object")
    if data.get("schema_version") != version:
        return Artifact(None, f"schema version {data.get('schema_version')}")
    if absent := sorted(required - data.keys()):
        return Artifact(None, f"missing fields: {', '.join(absent)}")
    return Artifact(data, None)


def read_config(spark: SparkSession, path: str, required: set[str]) -> dict[str, Any]:
    """A JSON object that has to have all required fields; they are all named where some are missing."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    absent = sorted(required - found.keys()) if isinstance(found, dict) else sorted(required)
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    return found


def plain(value: Any) -> Any:
    """A value as JSON has it: rows and mappings as objects, sequences as arrays, times as ISO text, numbers of other libraries as
    Python's, and numbers that JSON lacks (not a number, infinite) as null."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if hasattr(value, "item") and not isinstance(value, (str, bytes)):
        value = value.item()
    if isinstance(value, Decimal):
        value = float(value)
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """One JSON document of a small result, in a folder of one text part that ``read_artifact`` and ``read_config`` read."""
    text = json.dumps(plain(value), ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_splits(table: DataFrame, path: str) -> DataFrame:
    """Parquet with a folder for each ``split``, clustered by sensor; returns the rows of each split as read back, or raises where they differ."""
    clustered = table.repartition("split", "sensor_id").sortWithinPartitions("split", "sensor_id", "ts")
    clustered.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)
    count = lambda df: {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}  # noqa: E731  a row for each split
    wanted, stored = count(table), count(table.sparkSession.read.parquet(path))
    if wanted != stored:
        raise ValueError(f"{path} holds {stored} rows, not {wanted}")
    return table.sparkSession.createDataFrame(sorted(stored.items()), "split string, n_rows bigint")


def folder_digest(spark: SparkSession, path: str) -> str:
    """sha256 over the names and digests of all files below a folder of bounded size, such as a fitted model's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select("path", F.sha2("content", 256)).collect()
    root = os.path.commonpath([os.path.dirname(r[0]) for r in rows]) if rows else ""
    lines = sorted(f"{r[0][len(root):]} {r[1]}" for r in rows)  # below the folder that holds all of them
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def save_model(model: PipelineModel, path: str) -> str:
    """Store a fitted pipeline; returns the digest that ``load_model`` asks for."""
    model.write().overwrite().save(path)
    return folder_digest(SparkSession.active(), path)


def load_model(spark: SparkSession, path: str, digest: str | None = None) -> PipelineModel:
    if digest is not None and (found := folder_digest(spark, path)) != digest:
        raise ValueError(f"{path} has digest {found}, not {digest}")
    return PipelineModel.load(path)


def file_digests(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """path, bytes and sha256 of each file, and its name below the folder; ``names``: a pattern, also of files in folders below."""
    files = spark.read.format("binaryFile")
    if names:
        files = files.option("recursiveFileLookup", True).option("pathGlobFilter", names)
    inside = F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/").rpartition("/")[2]) + "/", "")
    return files.load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), inside.alias("name"))


def require_digest(spark: SparkSession, path: str, expected: str) -> None:
    found = [r["sha256"] for r in file_digests(spark, path).collect()]
    if found != [expected]:
        raise ValueError(f"{path} has digest {found}, not {expected}")


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Parquet table, and for each plain column its nulls, least and greatest value, from the files' footers: no page is read.

    Spark answers these aggregates from the row groups' statistics on the executors where the newer reader may push them down, which a
    session of its own allows; the caller's settings stay. A plan that doesn't push them down is an error. Columns of texts and nested columns have
    no exact bounds there: texts get their nulls only, nested ones nothing.
    """
    own = spark.newSession()
    for name, value in (("spark.sql.sources.useV1SourceList", ""), ("spark.sql.parquet.aggregatePushdown", "true")):
        own.conf.set(name, value)
    table = own.read.parquet(path)
    plain_types = [(c, t) for c, t in table.dtypes if not t.startswith(("array", "map", "struct"))]
    bounded = [c for c, t in plain_types if t in ("tinyint", "smallint", "int", "bigint", "float", "double", "date")]
    found = table.agg(F.count("*").alias("n_rows"), *(F.count(F.col(c)).alias(f"n{i}") for i, (c, _) in enumerate(plain_types)), *(f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(bounded) for k, f in (("lo", F.min), ("hi", F.max))))
    if "PushedAggregation: [COUNT" not in found._jdf.queryExecution().toString():
        raise ValueError(f"the footers of {path} don't answer this")
    row = found.first()
    at = {c: i for i, c in enumerate(bounded)}
    rows = [(c, row["n_rows"], row["n_rows"] - row[f"n{i}"], *((str(row[f"{k}{at[c]}"]) if c in at and row[f"{k}{at[c]}"] is not None else None) for k in ("lo", "hi"))) for i, (c, _) in enumerate(plain_types)]
    return spark.createDataFrame(rows, "column string, n_rows bigint, nulls bigint, least string, greatest string")
