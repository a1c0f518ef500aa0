"""License scans against plain Python."""

import random
import re

import pytest

from loomgrid.llm.license_scan import FOUR, GAP, NOTICES, PAIR, PHRASES, SHARE, SHORT, license_scan, templates

SCHEMA = "doc_id bigint, text string, words string, label string, template int"


def brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in PHRASES:
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += here
        base |= {label} if here else set()
    for phrase, label, short in [(*p, True) for p in PHRASES] + [(*n, False) for n in NOTICES]:
        t = phrase.split()
        k = PAIR if len(t) <= SHORT else FOUR
        diagonals = {i - j for j in range(len(t) - k + 1) for i in range(len(w) - k + 1) if w[i : i + k] == t[j : j + k]}
        agree = {d: {j for j in range(len(t)) if 0 <= d + j < len(w) and w[d + j] == t[j]} for d in diagonals}
        for d in diagonals:
            share = len(agree[d] if short else set().union(*(agree.get(d + g, set()) for g in range(GAP + 1)))) / len(t)
            score = max(score, share)
            if share >= (1 if short else SHARE):
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def texts(seed=4):
    rng = random.Random(seed)
    known = [words.split() for words, _ in PHRASES + NOTICES]
    out = []
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 6)):
            piece = list(rng.choice(known))
            for _ in range(rng.choice([0, 0, 1, 3])):
                at = rng.randrange(len(piece) + 1)
                if rng.random() < 0.5:
                    piece.insert(at, rng.choice(["the", "x", "mit", "ÉTÉ"]))
                elif piece:
                    del piece[min(at, len(piece) - 1)]
            if rng.random() < 0.3:
                piece = piece[rng.randrange(len(piece) or 1) :]
            text += piece + ["filler"] * rng.randrange(4)
        out.append(rng.choice([" ", "\n", ", ", "--\x00"]).join(w.upper() if rng.random() < 0.2 else w for w in text))
    return out


ODD = [
    None, "", " ...\n", "one", "cc by", "CC-BY cc by cc BY", "cc by " * 3000, "GNU General Public License.\nMIT License; Apache-License", "mitKMIT License", "É mit license é", "gnu general public",
    "permission is hereby granted", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "word " * 20000 + "mit license", "x" * 3_000_000 + " mit license",
]


def test_scan_equals_brute_force(spark):
    rows = [(i, t, "w", "l", 7) for i, t in enumerate(ODD + texts())]
    rows += [(None, ODD[5], "", "", 0), (3, "one", "w", "l", 7), (4, "another cc by", "w", "l", 7)] + [(9000 + i, ODD[7], "", "", 0) for i in range(400)]  # hot text, repeated rows, one id twice, no id
    found = license_scan(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    known = {t: brute(t) for t in {r[1] for r in rows}}
    wanted = sorted(((r[0], *known[r[1]]) for r in rows), key=repr)
    assert [g[:7] for g in got] == [w[:7] for w in wanted]
    assert [g[7] for g in got] == pytest.approx([w[7] for w in wanted])


def test_merged_diagonals_find_a_notice_with_words_put_in_and_left_out(spark):
    notice = max((n for n, _ in NOTICES), key=len).split()
    label = dict(NOTICES)[" ".join(notice)]
    changed = notice[:6] + ["new"] + notice[6:14] + notice[15:]
    far = notice[:9] + ["gap"] * (GAP + 5) + notice[9:]
    rows = [(1, " ".join(changed), "", "", 0), (2, " ".join(far), "", "", 0), (3, " ".join(sorted(notice)), "", "", 0)]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["labels"] == label and SHARE <= got[1]["score"] < 1
    assert got[2]["labels"] == "" and 0 < got[2]["score"] < SHARE
    assert got[3]["labels"] == "" and got[3]["score"] == 0


def test_empty_table_and_templates(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).collect() == []
    for _, words, _, _, k in templates():
        assert k <= len(words) < 64 and all(re.fullmatch("[a-z0-9]+", w) for w in words)


def test_main_path_has_no_python(spark):
    plan = license_scan(spark.createDataFrame([(1, "mit license", "", "", 0)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
