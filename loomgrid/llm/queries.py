"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.byte_bpe import encode_decode
from loomgrid.llm.common import read
from loomgrid.llm.filter_audit import filter_interactions
from loomgrid.llm.fingerprint import fingerprints
from loomgrid.llm.html_extract import extract
from loomgrid.llm.license_scan import GAP, SHARE, license_scan, templates
from loomgrid.llm.lm_score import score
from loomgrid.llm.near_dedup import near_duplicates
from loomgrid.llm.packing import pack
from loomgrid.llm.quality import quality_rules
from loomgrid.llm.sharding import shard
from loomgrid.llm.source_audit import source_divergence
from loomgrid.llm.toxicity import toxicity
from loomgrid.llm.url_filter import host_path, url_filter

#: The rules of the contract, as (action, host/path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: The list that the filter blocks beside the rules: the URLs of hosts with such a label, and those of pages with an advert of a listed
#: campaign (their numbers end in 7), in the spelling of the advert's network.
LISTED_HOSTS, LISTED_ADS = r"^(.*[.-])?(casino|bet|win|pills|adult)([.-].*)?$", r"<!-- ad [0-9]*7 -->"


def listed_urls(pages: DataFrame) -> DataFrame:
    """URLs of the list; what a campaign lists differs from a page's own URL in scheme, ``www.``, port and tracking parameter."""
    host, path = host_path(F.col("url"))
    query = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    spelled = F.concat(F.lit("HTTP://www."), F.regexp_replace(host, r"^www\.", ""), F.lit(":80"), path, F.lit("?utm_source=list&"), query)
    found = F.array_compact(F.array(F.when(host.rlike(LISTED_HOSTS), F.col("url")), F.when(F.col("html").rlike(LISTED_ADS) & (host != ""), spelled)))
    return pages.select(F.explode(found).alias("url"))


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file, which every worker has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter(pages, listed_urls(pages), URL_RULES)


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4)


def op5_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def op7_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), words=True)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_subword_toxicity": op1_subword_toxicity,
        "op2_url_filter": op2_url_filter,
        "op3_cost_packing": op3_cost_packing,
        "op4_near_dedup": op4_near_dedup,
        "op5_crf_main_text": op5_crf_main_text,
        "op6_byte_shards": op6_byte_shards,
        "op7_multiset_fingerprint": op7_multiset_fingerprint,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_quality_rules": op9_quality_rules,
        "op10_lattice_lm": op10_lattice_lm,
        "op11_license_scan": op11_license_scan,
        "op12_source_audit": op12_source_audit,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    canonical = r"""CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
        || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END END"""
    listed = ", ".join(f"({i}, {words}, '{label}', {phrase}, {k})" for i, words, label, phrase, k in templates())
    return {
        "op2_url_filter": rf"""
WITH raw AS (SELECT page_id, url, html, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
parts AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)=')) AS q FROM raw),
keyed AS (SELECT *, {canonical} AS key,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts),
listed AS (SELECT DISTINCT key FROM keyed WHERE (regexp_matches(host, '{LISTED_HOSTS}') OR regexp_matches(coalesce(html, ''), '{LISTED_ADS}')) AND key IS NOT NULL)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM keyed""",
        "op11_license_scan": rf"""
WITH t(template, words, label, phrase, k) AS (VALUES {listed}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT rid, w, len(w)::BIGINT AS n_words, unnest(range(1, len(w)::BIGINT + 1)) AS pos FROM d),
ks AS (SELECT DISTINCT k FROM t),
g AS (SELECT rid, k, pos, array_to_string(w[pos:pos + k - 1], ' ') AS gram FROM i, ks WHERE pos + k - 1 <= n_words),
tp AS (SELECT template, words, k, unnest(range(1, len(words)::BIGINT + 1)) AS j FROM t),
tg AS (SELECT template, k, j, array_to_string(words[j:j + k - 1], ' ') AS gram FROM tp WHERE j + k - 1 <= len(words)),
diagonals AS (SELECT DISTINCT rid, template, pos - j AS diagonal FROM g JOIN tg USING (k, gram)),
same AS (SELECT rid, template, diagonal, j FROM diagonals JOIN tp USING (template) JOIN d USING (rid) WHERE diagonal + j >= 1 AND w[diagonal + j] = words[j]),
alone AS (SELECT rid, template, diagonal, count(*) AS hits FROM same GROUP BY ALL),
merged AS (SELECT a.rid, a.template, a.diagonal, count(DISTINCT b.j) AS hits FROM alone a JOIN same b ON b.rid = a.rid AND b.template = a.template AND b.diagonal BETWEEN a.diagonal AND a.diagonal + {GAP} GROUP BY ALL),
judged AS (SELECT rid, label, phrase, a.diagonal, (CASE WHEN phrase THEN a.hits ELSE m.hits END)::DOUBLE / len(words) AS share FROM alone a JOIN merged m USING (rid, template, diagonal) JOIN t USING (template)),
r AS (SELECT rid, count(*) FILTER (phrase AND share = 1) AS n_base, min(diagonal) FILTER (phrase AND share = 1) AS first_word, max(diagonal) FILTER (phrase AND share = 1) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (phrase AND share = 1))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label) FILTER (share >= CASE WHEN phrase THEN 1 ELSE {SHARE} END))), ',') AS labels, max(share) AS score FROM judged GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (rid)""",
        "op12_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT lang, source, rid, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM t GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS big FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
sums AS (SELECT lang, source, sum(c.n)::HUGEINT AS big FROM c JOIN kept USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.big, 0) + l.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.n + 1)) // (l.big + l.v))::BIGINT AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
        "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, [(len(w) < 200)::INT, (100 * len(list_distinct(w)) < 50 * len(w))::INT, (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text))::INT,
    regexp_matches(text, '[#$%&*|]')::INT, coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)::INT] AS fails FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(p, lambda i: 'ABCDE'[i]), '') AS filter_order, i AS step, p[i] AS f, p[1:i - 1] AS before FROM o, x),
r AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] = 1 AS hit, list_sum(list_transform(before, lambda k: fails[k])) > 0 AS gone, list_sum(fails) = 1 AS alone FROM c, s),
g AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT hit AND NOT coalesce(gone, false) THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT coalesce(gone, false) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN hit AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN hit AND NOT coalesce(gone, false) THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT coalesce(gone, false) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g""",
    }
