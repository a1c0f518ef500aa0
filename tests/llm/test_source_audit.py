"""The source divergence audit against plain Python."""

import collections
import random
import re

import numpy as np
import pytest

from loomgrid.llm.source_audit import pieces, runs, share, shares, source_divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, term string"


def brute(rows, min_docs=3, top=200):
    terms, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        terms[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = collections.Counter()
        for s in sources:
            whole.update(terms[lang, s])

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        f = lambda a, b: (a - b) * (a - b) // b
        mine, q = {s: p(terms[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(sum(f(mine[s][t], mine[o][t]) for t in kept), o) for o in sources if o != s]
            words = [(f(mine[s][t], q[t]), t) for t in kept if terms[lang, s][t] > 0 and mine[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", words)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top}
    return out


def rows_of(seed=5):
    rng = random.Random(seed)
    words = [a + b for a in ("a", "é", "Bo", "x", "日本", "zz", "Q") for b in ("", "n", "ter", "ü", "cd", "e", "p", "y")]
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "en", "en", "de", "fr", None])
        source = rng.choice(["s1", "s1", "s1", "s2", "S3", "é", "s10", None])
        n = int(rng.paretovariate(0.8)) % 60
        rows.append((i, rng.choice([" ", "\n", "1", "-'"]).join(rng.choice(words[: rng.choice([6, 20, 56])]) for _ in range(n)), lang, source, 1, "t"))
    rows += [rows[7], rows[7], (900, None, "en", "empty source", 1, "t"), (None, "a an", "en", "s1", 1, "t")]
    return rows + [(901, "only two", "xx", "a", 1, "t"), (902, "only two", "xx", "b", 1, "t"), (903, "alone alone", "yy", "c", 1, "t")]  # languages that keep no term; one source


@pytest.mark.parametrize("sizes", [{}, {"chunk": 5, "block": 2, "max_entries": 10}, {"chunk": 1, "block": 1, "max_entries": 1}])
def test_audit_equals_brute_force(spark, sizes):
    rows = rows_of()
    found = source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(4), **sizes)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_only_the_first_ranks_of_terms_are_kept(spark):
    rows = rows_of(6)
    assert {tuple(r) for r in source_divergence(spark.createDataFrame(rows, SCHEMA), top=3, min_docs=1).collect()} == brute(rows, 1, 3)


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_are_the_column():
    rng = random.Random(1)
    for height in (0, 1, 2, 30):
        for _ in range(20):
            column = [rng.choice([0, 0, 1, 1, 5]) for _ in range(height)]
            rows = np.array([i for i, c in enumerate(column) if c], np.int64)
            starts, values = runs(rows, np.array([column[i] for i in rows], np.int64), height)
            ends = [*starts[1:], height]
            assert [v for a, b, v in zip(starts, ends, values, strict=True) for _ in range(a, b)] == column
            assert all(a != b for a, b in zip(values, values[1:], strict=False))


def test_shares_are_exact_beyond_64_bits(spark):
    counts = [0, 1, 9_999_999_999, 10**13 - 7]
    want = [1 + 10**9 * (c + 1) // (2 * 10**13 + 3 * 10**9 + 1) for c in counts]
    assert shares(np.array(counts), 2 * 10**13, 3 * 10**9 + 1).tolist() == want
    found = spark.createDataFrame([(c, 2 * 10**13, 3 * 10**9 + 1) for c in counts], "c bigint, n bigint, v bigint")
    assert [r[0] for r in found.select(share(found.c, found.n, found.v)).collect()] == want


def test_long_texts_are_read_in_pieces():
    text = ("Ab1é " * 400_000 + "x" * 2_000_000).encode()
    found = list(pieces(text))
    assert len(found) == 3 and sum(map(len, found)) == 800_001 and found[0][:2] == [b"ab", "é".encode()]
    assert list(pieces(b"")) == []
