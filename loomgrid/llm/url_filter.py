"""URL filter: longest host/path rule, else a list of canonical URLs behind a blocked Bloom filter.

The Bloom filter has blocks of eight 32-bit words; a key sets one bit in each word of its block. The
filter is built by one aggregation (``bit_or`` by block) and never exceeds ``max_blocks`` blocks of 32 bytes,
whatever the list's length, so it may be broadcast. Rows that the filter passes go on to an exact join
with the list, which removes false positives; the others never leave their partition. A fuller filter
passes more rows to the join, but never changes a verdict.

The list is read once; the URLs twice, for the rows that the filter passes and for the others. The exact join is a left join on the canonical URL with the list's distinct entries; a URL that fills a
third of the rows is split by Spark's adaptive skew join, as the list has one row for it.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and is not
listed; repeated rows each get their verdict; null ids stay; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import ascii_lower, checkpoint

#: Odd 31-bit multipliers that pick a bit in each word of a block; their products with 32-bit hashes fit a bigint.
SALTS = tuple(int(2**31 * (i * 0.6180339887498949 % 1)) | 1 for i in range(1, 9))
#: Query parameters that only track a visit.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)="


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slash, query without tracking parameters, no scheme or fragment."""
    host, path = host_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of action and rule of the longest rule that fits; ``rules``: (action, host/path), a short list."""
    out = None
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<action:string,rule:string>")


def _block_and_bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    bits = [F.shiftright((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27) for s in SALTS]
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)).cast("int"), bits


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """A row for each block in use: its number and its eight words."""
    block, bits = _block_and_bits(F.col(key), blocks)
    marked = listed.select(block.alias("block"), *(F.call_function("shiftleft", F.lit(1).cast("bigint"), b.cast("int")).alias(f"w{i}") for i, b in enumerate(bits)))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(SALTS))))


def probed(rows: DataFrame, listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """``rows`` with ``possible``: false where the filter proves that ``listed`` doesn't hold the row's key. The filter has at most ``blocks`` rows."""
    block, bits = _block_and_bits(F.col(key), blocks)
    found = rows.withColumn("block", block).join(F.broadcast(bloom(listed, key, blocks)), "block", "left")
    possible = F.col(key).isNotNull()
    for i, b in enumerate(bits):
        possible = possible & (F.call_function("shiftright", F.col(f"w{i}"), b.cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return found.withColumn("possible", F.coalesce(possible, F.lit(False))).select(*rows.columns, "possible")


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", bits_per_key: int = 16, max_blocks: int = 1 << 17) -> DataFrame:
    """Verdicts for the URLs of ``pages``. ``listed``: a DataFrame whose first column holds listed URLs."""
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical(F.col(url_col)).alias("key")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    keys = checkpoint(listed.select(canonical(F.col(listed.columns[0])).alias("key")).where("key is not null").distinct())  # read for its size, the filter and the join
    blocks = min(max_blocks, 1 << max(4, math.ceil(math.log2(max(1, keys.count()) * bits_per_key / 256))))

    open_rows = F.when(F.col("fit").isNull() & F.col("key").isNotNull(), F.col("key"))
    marked = probed(rows.withColumn("key", open_rows), keys, "key", blocks)

    hits = marked.where("possible").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    columns = ["page_id", "host", "path", "fit", "listed"]
    judged = hits.select(columns).unionByName(marked.where("not possible").withColumn("listed", F.lit(None).cast("boolean")).select(columns))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.action"), F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict"))
