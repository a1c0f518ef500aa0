"""The filter audit against plain Python."""

import collections
import itertools
import math
import random
import re

import pytest

from loomgrid.llm.filter_audit import FILTERS, combinations, failed, filter_interactions, pieces

SCHEMA = "doc_id bigint, text string, lang string, source string, h int, part string"
WORDS = [f"w{i}" for i in range(300)]


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        body = " ".join(rng.choice(WORDS[: rng.choice([20, 300])]) for _ in range(rng.choice([3, 150, 250, 400])))
        out.append(rng.choice([body, body.upper(), body + " $", "É" + body.title(), body.replace(" ", "\x0b", 3)]))
    return out


def rows_of():
    rng = random.Random(2)
    made = texts(60)
    rows = [(i, rng.choice(made), rng.choice(["en", "de", None]), "s", 1, "x") for i in range(150)]
    rows += [(1000 + i, made[0], "en", "s", 1, "x") for i in range(200)]  # a group of copies with half of all rows
    rows += [(2000, None, "en", "s", 1, "x"), (2001, "", None, "s", 1, "x"), (None, made[0], "en", "s", 1, "x"), (None, "only", "en", "s", 1, "x")]
    return rows + [rows[3], rows[3], (5, "same id, another text", "fr", "s", 1, "x")]


def brute(rows, labels):
    fails = []
    for doc_id, text, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows)
        fails.append(dict(zip(FILTERS, (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), copy), strict=True)))
    marks = collections.defaultdict(lambda: [0, 0])
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            marks[doc_id] = [max(marks[doc_id][0], quality == 1), max(marks[doc_id][1], toxic == 1)]
    out, shapley = {}, collections.Counter()
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        for order in map("".join, itertools.permutations(FILTERS)):
            left, gone = mine, []
            for i, letter in enumerate(order):
                hit = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                good, toxic = (sum(int(marks[x[0]][k]) for x in hit if x[0] is not None) for k in (0, 1))
                alone = sum(x[1][letter] and sum(x[1].values()) == 1 for x in mine)
                out[part, order, i + 1] = [len(left), len(hit), sum(x[1][letter] for x in gone), alone, good, toxic]
                shapley[part, letter] += len(hit)
                gone = gone + hit
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("blocks", [1, 1 << 17])  # a filter that passes nearly everything changes nothing
def test_audit_equals_brute_force(spark, blocks):
    rows = rows_of()
    labels = [(i, i % 2, i % 3) for i in range(0, 1100, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (99999, 1, 1), (6, None, None)]
    found = filter_interactions(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), max_blocks=blocks).collect()
    wanted = brute(rows, labels)
    assert len(found) == len(wanted) == 4 * 600
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == wanted


def test_empty_table(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_interactions(docs, labels).collect() == []


def test_one_empty_text(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [tuple(r) for r in combinations(spark.createDataFrame([(1, None, None, None, 0, "")], SCHEMA), labels).collect()] == [("", 1, 1, 0, 0)]


def test_long_texts_are_read_in_pieces():
    text = b"\xc3\xa9a b " * 400_000 + b"x" * 3_000_000 + b" y"
    assert b"".join(pieces(text)) == text and max(map(len, pieces(text, 1000))) > 2_900_000
    assert failed(text) == 0b0010
    assert failed(b"one" * 5_000_000) == 0b0001


def test_a_text_of_many_steps_sums_up(spark):
    """Kept, removed and redundant of the last step make the part; Shapley values sum to what is removed in all orders."""
    rows = [r for r in rows_of() if r[2] == "en"]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = filter_interactions(spark.createDataFrame(rows, SCHEMA), labels).collect()
    by_order = collections.defaultdict(list)
    for r in found:
        by_order[r["filter_order"]].append(r)
    for steps in by_order.values():
        steps.sort(key=lambda r: r["step"])
        assert steps[-1]["kept"] + sum(r["removed"] for r in steps) == len(rows)
    total = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in found}
    assert sum(total.values()) == math.factorial(5) * (len(rows) - by_order["ABCDE"][-1]["kept"])
