"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.lineage import checkpoint  # noqa: F401

#: White space of the word contracts, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet (names compare without case)."""
    taken, name, n = {c.lower() for c in df.columns}, base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it many times while it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of ``text``; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def lowest_hashes(rows: DataFrame, key: Column, wanted: int, total: int) -> DataFrame:
    """The ``wanted`` rows with the lowest key hashes, out of ``total``.

    Hashes beyond about twice the share that is wanted are dropped before the sort, so that what meets in one
    task stays near ``wanted`` rows, however many partitions there are.
    """
    hashed = F.xxhash64(key)
    share = min(1.0, (2 * wanted + 100) / max(1, total))
    return rows.where(hashed <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))).orderBy(hashed, key).limit(wanted)
