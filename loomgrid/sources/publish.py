"""Tables that are published whole or not at all.

A version is written to a folder of its own, checked there, and only then named by the table's manifest, which one rename replaces; until that readers
see the version before, and a write that fails changes nothing for them. Older versions stay until ``expire`` removes them, so a reader that began with
one can end with it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.lineage import remove
from loomgrid.sources.files import file_digests

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside ``path`` and rename it there, over what is there."""
    fs, new = _fs(spark, f"{path}.{uuid.uuid4()}")
    out = fs.create(new, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(path), options)


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The published version: ``version``, ``n_rows``, ``files`` and ``schema``; None where nothing is published."""
    fs, at = _fs(spark, f"{root}/{MANIFEST}")
    if not fs.exists(at):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{root}/{MANIFEST}").collect()))


def checked_rows(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Rows of a stored version; a ValueError where its keys repeat."""
    stored = spark.read.parquet(path)
    if keys and stored.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{path} repeats keys of {keys}")
    return stored.count()


def publish(table: DataFrame, root: str, keys: list[str] = (), n_rows: int | None = None, partition_by: list[str] = ()) -> dict:
    """Store ``table`` as the new version below ``root`` and return its manifest.

    Raises, and leaves the version before in place, where the write fails, where rows read back aren't as many as were written or as ``n_rows`` says, or
    where the keys repeat. The manifest holds the digest of every file, taken on the executors.
    """
    spark, version = table.sparkSession, f"v-{uuid.uuid4()}"
    path = f"{root}/{version}"
    try:
        from pyspark.sql import Observation

        seen = Observation()
        writer = table.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        wanted = seen.get["n"] if n_rows is None else n_rows
        stored = checked_rows(spark, path, list(keys))
        if stored != wanted:
            raise ValueError(f"{path} holds {stored} rows, not {wanted}")
        files = file_digests(spark.newSession(), path, "*.parquet")
        found = {"version": version, "n_rows": stored, "schema": json.loads(spark.read.parquet(path).schema.json()), "files": {r["name"]: r["sha256"] for r in files.collect()}}
        _replace(spark, f"{root}/{MANIFEST}", json.dumps(found, sort_keys=True))
    except BaseException:
        remove(spark, path)
        raise
    return found


def published(spark: SparkSession, root: str, verify: bool = False) -> DataFrame:
    """The published version; with ``verify`` a ValueError where its files aren't those of the manifest."""
    found = manifest(spark, root)
    if found is None:
        raise ValueError(f"nothing is published below {root}")
    path = f"{root}/{found['version']}"
    if verify:
        stored = {r["name"]: r["sha256"] for r in file_digests(spark, path, "*.parquet").collect()}
        if stored != found["files"]:
            raise ValueError(f"{path} isn't what its manifest names")
    return spark.read.parquet(path)


def expire(spark: SparkSession, root: str) -> int:
    """Remove all versions but the published one; returns how many."""
    found = manifest(spark, root)
    fs, at = _fs(spark, root)
    old = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("v-") and (found is None or s.getPath().getName() != found["version"])]
    for name in old:
        remove(spark, f"{root}/{name}")
    return len(old)
