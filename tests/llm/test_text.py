"""Packing, byte BPE, near-duplicates, language-model scores, toxicity and main text against plain Python."""

import base64
import collections
import hashlib
import math
import random
import string
import time
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from loomgrid.llm import html_extract as H
from loomgrid.llm import lm_score, packing, toxicity
from loomgrid.llm.byte_bpe import encode_decode, encode_ids
from loomgrid.llm.components import components
from loomgrid.llm.near_dedup import Overlaps, keep_one, near_duplicates

SCHEMA = "doc_id bigint, text string, keys string"
ODD = [None, "", " \n ", "a", "x<|endoftext|>y don't we'll ÉCOLE é 4५6 \x1c b", "ΟΔΟΣ ΣΑΣ. ﬁ Å", "日本語 👩‍👩‍👧", "...then, end. ok.) 5, é.", "ß" * 50, "word " * 6000]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer, texts = Tokenizer.from_file(path), ODD + ["lorem ipsum dolor " * 40] * 30
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) for t in texts]
    rows = packing.pack(docs(spark, texts), path, pool_tokens=9000).toPandas()
    for i, ids in enumerate(want):
        own = rows[rows.doc_id == i].sort_values("start")
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == len(ids)
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset.to_numpy() == np.concatenate(([0], np.cumsum(part.length)[:-1]))).all()
        total = int(part.length.sum())
        assert total <= 2048 and total & (total - 1) == 0  # full, or a power of two: no padding
    assert packing.pack(docs(spark, []), path).count() == 0


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer, own, rng = Tokenizer.from_file(path), packing.WordIds(path, remember=300), random.Random(9)
    bits = ["<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "|>", " ", "\n", "\u00a0", "A", "b", "É", "e\u0301", "İ", "ß", "don't", "7", ".", ",", "'", "日本", "ΑΣ", "word", "\x1c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert [x.tolist() for x in own.encode(part)] == [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]


def test_word_ids_of_letters_and_closings_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer, own, rng = Tokenizer.from_file(path), packing.WordIds(path, remember=2000), random.Random(5)
    letters = [*"aehnsAZ", *(chr(i) for i in range(0xA1, 0x180)), "1", "\u0301", "'s", "ab"]
    words = ["".join(rng.choices(letters, weights=[40] * 7 + [1] * 223 + [9] * 4, k=rng.randint(0, 7))) + "".join(rng.choices(string.punctuation, k=rng.choice((0, 0, 1, 3)))) for _ in range(20000)]
    words = [w for w in words if "<|" not in w] + [chr(i) + c for i in range(0xA1, 0x180) for c in ("", ",", "***", "'")]
    for at in range(0, len(words), 400):
        part = [" ".join(words[at : at + 200]), "\n".join(words[at + 200 : at + 400])]
        assert [x.tolist() for x in own.encode(part)] == [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]


def test_word_ids_learn_stems_once_and_keep_what_is_used():
    own, learnt = packing.WordIds(P.path("word_bpe_49k.json"), remember=400), collections.Counter()
    learn = own._learn
    own._learn = lambda words: (learnt.update(words), learn(words))[1]
    own.encode(["stem stem*** stem&&& stem... Stem, été été### été!"])
    assert {w for w in learnt if w[:1].isalpha() or w[0] > 127} == {b"stem", "été".encode()} and set(learnt.values()) == {1}
    for i in range(40):  # 1600 words, 50 to a batch; those in each batch aren't forgotten
        own.encode([" ".join(["stem.", "été!", *(f"{'abcdefghij'[i % 10]}{'klmn'[i // 10]}{k}x" for k in range(40))])])
        assert len(own.known) + len(own.older) <= 400
    assert learnt[b"stem"] == learnt["été".encode()] == 1


def test_packing_of_repeated_rows(spark):
    rows = packing.pack(docs(spark, ["one two three"] * 3 + ["four"], [1, 1, None, None]), P.path("word_bpe_49k.json")).collect()
    by_id = collections.Counter()
    for r in rows:
        by_id[r["doc_id"]] += r["length"]
    assert by_id == {1: 8, None: 6} and sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == [2, 4, 4, 4]


def test_packing_balances_cost():
    lengths = np.random.default_rng(0).integers(1, 1500, 800)
    rows, n = packing.pack_pool(lengths, 2048, 1.0, 1 / 2048)
    cost = collections.Counter()
    for _, _, length, sequence, _ in rows.tolist():
        cost[sequence] += length + length * length / 2048
    full = [cost[s] for s in range(n) if sum(r[2] for r in rows.tolist() if r[3] == s) == 2048]
    assert max(full) < 2.1 * min(full) and len(rows) < 3 * len(lengths)


def test_byte_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r["doc_id"]: r for r in encode_decode(docs(spark, ODD), path, P.PATTERN).collect()}
    ids = {r["doc_id"]: list(r["ids"]) for r in encode_ids(docs(spark, ODD), path, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        want = coder.encode_ordinary(t or "")
        assert ids[i] == want and rows[i]["n_tokens"] == len(want)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_decode(docs(spark, []), path, P.PATTERN).count() == 0


def brute_components(texts, size, num=80, den=100):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = list(ODD)
    for edits in [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 8] * 4:
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    passage = " ".join(word() for _ in range(60))
    texts += [" ".join(word() for _ in range(100)) + " " + passage for _ in range(40)] + ["A  B c", "a b C", "a b d", " ".join(base).upper()]
    want, sizes = brute_components(texts, 4)
    rows = {r["doc_id"]: r for r in near_duplicates(docs(spark, texts), shingle=4).collect()}
    assert [rows[i]["component_id"] for i in range(len(texts))] == want
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(rows[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_near_duplicates_of_odd_rows(spark):
    texts, ids = ["same text of some words here"] * 4 + [None, "alone in its own group of words"], [7, 3, 3, None, None, None]
    rows = near_duplicates(docs(spark, texts, ids)).collect()
    assert sorted((r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None) == [(3, False), (3, True), (3, True)]
    assert [r["component_id"] for r in rows if r["doc_id"] is None and r["n_shingles"] == 2] == [3]
    kept = keep_one(docs(spark, texts, ids))
    assert kept.columns == ["doc_id", "text", "keys"] and sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("3", texts[0]), ("None", "None"), ("None", texts[5])]
    assert near_duplicates(docs(spark, [])).count() == 0 and keep_one(docs(spark, [])).count() == 0


def test_rows_with_one_id_keep_their_own_sets(spark):
    a = " ".join(f"w{i}" for i in range(60))
    b = " ".join(f"v{i}" for i in range(60))
    for other in (6, 5):
        rows = near_duplicates(docs(spark, [a, a + " extra", b], [3, 5, other])).collect()
        assert sorted((r["n_shingles"], r["component_id"]) for r in rows) == [(56, 3), (56, other), (57, 3)]
    kept = lambda texts, ids: sorted((str(r["doc_id"]), r["text"]) for r in keep_one(docs(spark, texts, ids)).collect())
    assert kept([a, a, b], [3, 5, 5]) == [("3", a), ("5", b)]
    assert kept([a, a, a + " extra", b, b], [None] * 5) == sorted([("None", min(a, a + " extra", key=lambda t: hash_key(t))), ("None", b)])
    assert kept([a, a.upper(), b], [4, 4, 9]) == sorted([("4", min(a, a.upper(), key=lambda t: hashlib.md5(t.encode()).hexdigest())), ("9", b)])
    assert kept([a, a, " ", " "], [1, 1, 2, 2]) == [("1", a), ("2", " "), ("2", " ")]


def hash_key(text):
    import pyspark.sql

    return pyspark.sql.SparkSession.active().createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]


def test_families_are_compared_whole(spark):
    """Hundreds of texts around one, most of them just beyond the similarity, in blocks of few shingles."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for _ in range(160):
        copy = list(common)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 2)] = [rng.choice(["x", "y"])]
        texts.append(" ".join(copy))
    want, _ = brute_components(texts, 4)
    for block in (700, 1_000_000):
        rows = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, texts), shingle=4, block=block).collect()}
        assert [rows[i] for i in range(len(texts))] == want and len(set(want)) > 3


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(1 << 40, size=rng.integers(1, 40)) if i % 2 else rng.integers(60, size=30)).astype(np.int64) for i in range(70)]
    for cells in (0, 300, 1 << 20):
        block = Overlaps(np.concatenate(sets[:50]), np.array([len(x) for x in sets[:50]]), cells)
        assert (block.of(sets[20:]) == [[len(np.intersect1d(a, b)) for b in sets[:50]] for a in sets[20:]]).all()


def test_near_duplicates_of_a_table(spark):
    """Components of the whole table of sf0.01 against brute force over shared shingles."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame, shingle=4).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in frame.collect())
    want, _ = brute_components([t for _, t in rows], 4)
    assert got == {i: rows[c][0] for (i, _), c in zip(rows, want, strict=True)}


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5), (None, 3)]
    parent = {x: x for l in links for x in l if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in linked}


@pytest.mark.parametrize("head", [0, 5, 200_000])
def test_lm_score(spark, head):
    texts = ODD[:-1] + ["the cat sat on the mat", "the dog", "the dog", "cat Cat CAT unseenword"] * 3
    ids = list(range(len(texts)))
    texts, ids = texts + [texts[9]], ids + [ids[9]]  # a repeated row
    rows = lm_score.score(docs(spark, texts, ids), P.path("piece_bpe_32k.model"), head=head).collect()
    train = collections.Counter()
    for i, t in zip(ids, texts, strict=True):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(lm_score.tokens(t or ""))
            train[b""] += 1
    n, v = sum(train.values()), len(train)
    assert len(rows) == len(texts)
    for r in rows:
        ts = lm_score.tokens(texts[ids.index(r["doc_id"])] or "") + [b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(train[t] > 0 for t in ts), n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
        assert r["score"] < 0
    assert lm_score.score(docs(spark, []), P.path("piece_bpe_32k.model"), head=head).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b" ab", b"ba", b"abababab", b""]
    logs = np.log(np.arange(1, len(pieces) + 1) / 45)
    index = {p: math.exp(x) for p, x in zip(pieces[:-1], logs[:-1], strict=True)}

    def total(w):
        return 1.0 if not w else sum(index[w[:k]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in index)

    def uses(w):
        """Pieces' expected numbers of uses by listing every segmentation."""
        out, whole = collections.Counter(), 0.0
        stack = [(w, 1.0, ())]
        while stack:
            rest, p, used = stack.pop()
            if not rest:
                whole += p
                for u in used:
                    out[u] += p
            for k in range(1, len(rest) + 1):
                if rest[:k] in index:
                    stack.append((rest[k:], p * index[rest[:k]], (*used, rest[:k])))
        return {k: x / whole for k, x in out.items()}

    words = [b"a", b"ab", b"abab", b"abababababab", b"bbb"]
    want = collections.Counter()
    for w in words:
        for k, x in uses(b" " + w).items():
            want[k] += 2 * x
    for long in (256, 5, 0):  # both ways
        lattice = lm_score.Lattice(pieces, logs, long)
        assert np.allclose(lattice.log_prob(words), [math.log(total(b" " + w)) for w in words])
        assert np.allclose(lattice.expected(words, np.full(len(words), 2.0)), [want[p] for p in pieces])


def test_lm_score_value(spark):
    """The ``score`` column by listing every segmentation: expected uses, the scale that makes them likeliest (on a grid), and the sum again."""
    texts = ["the cat sat", "A cat", None, "on the mat", "catalogue", "the the", "zq\u00e9", "a b c", "the end", "mat"]
    path = P.path("piece_bpe_32k.model")
    pieces, weights = lm_score.read_pieces(path)
    known = {p: w for p, w in zip(pieces[:-1], weights[:-1].tolist(), strict=True)}
    ways = lambda w: [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in known for rest in (ways(w[k:]) if w[k:] else [[]])]
    norm = lambda a: math.log(sum(math.exp(a * x) for x in known.values()))
    uses, ends = collections.Counter(), 0
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            ends += 1
            for w in lm_score.tokens(t or ""):
                found = [(way, math.exp(sum(known[p] - norm_1 + math.log(0.5) for p in way))) for norm_1 in [norm(1.0)] for way in ways(b" " + w)]
                whole = sum(x for _, x in found)
                for way, x in found:
                    for p in way:
                        uses[p] += x / whole
    n = sum(uses.values())
    gain = lambda a: sum(k * a * known[p] for p, k in uses.items()) - n * norm(a)
    scale = max((i / 1000 for i in range(1, 6000, 50)), key=gain)
    scale = max((scale + i / 1000 for i in range(-60, 61)), key=gain)
    end, log_norm = (ends + 1) / (ends + n + 2), norm(scale)
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id bigint, text string, word int, key int, pos int")
    for head in (0, 200_000):
        for r in lm_score.score(frame, path, head=head).collect():
            want = math.log10(end)
            for w in lm_score.tokens(texts[r["doc_id"]] or ""):
                want += math.log10(sum(math.exp(sum(scale * known[p] - log_norm + math.log(1 - end) for p in way)) for way in ways(b" " + w)))
            assert r["score"] == pytest.approx(want, rel=2e-3)


def test_held_out_scores_stay_near_the_base(spark):
    """The query's scores: finite, one for each row, and on held-out rows within a tenth of the base formula, which gives each of endlessly many unknown words the same."""
    from loomgrid.llm.queries import op10_lattice_lm

    rows = [r for r in op10_lattice_lm(spark, "/root/testdata/sf0.01").collect()]
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(r["score"] is not None and math.isfinite(r["score"]) for r in rows)
    held = [r for r in rows if r["held_out"]]
    known = [r for r in held if r["n_known"] == r["n_tokens"]]
    assert known and sum(r["score"] for r in known) > 1.05 * sum(r["base_score"] for r in known)
    assert sum(r["score"] for r in held) > 1.3 * sum(r["base_score"] for r in held)  # 17 % of these words are unknown


def test_words_and_lattice_sum_to_one(spark):
    """Discounted counts and what the lattice gets: known tokens by hand, and the unknown ones have what is left."""
    texts = ["the cat sat", "the cat", "the mat", "a dog", None, "the the end", "cat", "a b", "mat mat", "end"]
    path, frame = P.path("piece_bpe_32k.model"), docs(spark, texts)
    train = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(lm_score.tokens(t or ""))
            train[b""] += 1
    n, once, twice = sum(train.values()), sum(c == 1 for c in train.values()), sum(c == 2 for c in train.values())
    d = once / (once + 2 * twice) if once and twice else 0.5
    whole = 0.0
    ends = next(r["score"] for r in lm_score.score(frame, path, words=True).collect() if r["n_tokens"] == 1)
    held = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 5 == 1][: len(train) - 1]
    singles = docs(spark, texts + [w.decode() for w in train if w], list(range(len(texts))) + held)
    for r in lm_score.score(singles, path, words=True).where("doc_id >= 1000").collect():
        whole += 10 ** (r["score"] - ends)
    whole += 10**ends
    assert 1 - d * len(train) / n < whole <= 1  # all counts but the discounts, and some of the lattice's share


def test_very_long_words():
    pieces, weights = lm_score.read_pieces(P.path("piece_bpe_32k.model"))
    lattice, began = lm_score.Lattice(pieces, lm_score.scaled(weights, 1.0, 0.5)), time.process_time()
    word = bytes(random.Random(2).choices(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=200_000))
    assert lattice.log_prob([word])[0] < -200_000 and time.process_time() - began < 60


def toxic_world(seed, n):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["ta", "ri", "no", "ke", "lu"]) for _ in range(3)) for _ in range(200)]
    rows = []
    for i in range(n):
        words, toxic = [rng.choice(plain) for _ in range(rng.randint(5, 200))], rng.random() < 0.3
        for _ in range(1 + len(words) // 30 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["grumbold", "vexwit"]) + rng.choice(["", "s", "ish", "er"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toxic_world(1, 600) + [(9000, None, 0), (9001, "", 0), (9002, "you GRUMB0LDED thing", 0)]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t, _ in rows], "doc_id bigint, text string, score int, label_id int, label int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 9000], "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(frame, labels).collect()}
    held = [(y, found[i]["predicted"]) for i, _, y in rows if i < 9000 and found[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in found.items())
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert found[9000]["score"] == found[9001]["score"] < 0.3 and found[9002]["score"] > found[9001]["score"]  # a form never seen in training
    again = toxicity.toxicity(frame.union(frame), labels.union(labels))  # repeated rows and labels change nothing
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {i: r["score"] for i, r in found.items()} and again.count() == 2 * len(found)
    long = spark.createDataFrame([(1, "tari " * 40_000 + "grumbold vexwits grumbolder vexwit grumbold", 1, 2, 3), (2, "tari " * 40_000, 1, 2, 3)], frame.schema)
    assert [r["predicted"] for r in toxicity.toxicity(frame.union(long), labels).where("doc_id in (1, 2)").orderBy(F.desc("score")).collect()][0] == 1
    kept = toxicity.keep_clean(frame, labels)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["predicted"]}
    assert toxicity.toxicity(frame, labels.limit(0)).where("score > 0.3").count() == 0 and toxicity.toxicity(frame.limit(0), labels).count() == 0


def slow_score(model, text):
    """Score straight from the definition: the mean over a window's n-grams of each word between blanks, the greatest of all windows, on the scale."""
    found = [w[i : i + toxicity.LONG] for w in text.lower().split() for i in range(0, len(w), toxicity.LONG)]
    if not found:
        return 0.0
    factors, top = [int(f) for f in toxicity._FACTORS], (1 << 64) - 1
    values = []
    for k in range(0, len(found), toxicity.WINDOW):
        weights = []
        for w in found[k : k + toxicity.WINDOW]:
            padded = f" {w} "
            for size in toxicity.SIZES:
                for i in range(len(padded) - size + 1):
                    mixed = sum(ord(c) * f for c, f in zip(padded[i : i + size], factors, strict=False)) & top
                    weights.append(float(model.weights[(((mixed ^ (mixed >> 29)) * factors[0]) & top) >> 47]))
        values.append(sum(weights) / len(weights) + model.bias)
    return 1 / (1 + math.exp(-(model.slope * max(values) + model.shift)))


def test_toxicity_scores_equal_their_definition():
    rng = random.Random(8)
    texts = ["", " \n", "a", "Ab\tc\u00a0d", "ÉΣΣ İ", "x" * 1000 + " y " + "z" * 401, *(" ".join("".join(rng.choice("abcdéß日") for _ in range(rng.choice([1, 3, 9, 500]))) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    weights = np.random.default_rng(3).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    model = toxicity.Model(weights, 0.25, 1.5, -0.5)
    assert model.score(texts) == pytest.approx([slow_score(model, t) for t in texts], rel=1e-4)
    long = " ".join(texts) * 30  # looked at in many pieces
    assert len(list(toxicity.pieces(long))) > 1 and model.score([long, "a"]) == pytest.approx([slow_score(model, long), slow_score(model, "a")], rel=1e-4)


def test_toxicity_of_very_long_words_is_bounded_in_memory():
    import subprocess
    import sys

    code = """
import resource, numpy as np
from loomgrid.llm import toxicity
model = toxicity.Model(np.ones(toxicity.BUCKETS, np.float32), 0.0, 1.0, 0.0)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(model.score(["x" * 50_000_000])[0], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)"""
    score, mb = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert 0.7 < score < 0.74 and mb < 500


def test_toxicity_learns_from_whole_texts_within_its_bound(spark, monkeypatch):
    """A long labelled text is learned from whole or not at all; the bound takes rows away, never parts of them."""
    got = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, share: got.update(texts=[" ".join(t) for t in texts]) or toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0, 1, 0))
    texts = {i: " ".join([f"w{i}"] * (3000 if i % 10 == 0 else 20)) + " " + "long" * 300 for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in texts], "doc_id bigint, quality int, toxic int")
    split = {" ".join(toxicity.words(t)) for t in texts.values()}
    for bound in (16_000_000, 400_000):
        toxicity.fit(docs, labels, "doc_id", "text", 4000, bound)
        assert set(got["texts"]) <= split and sum(map(len, got["texts"])) < bound + 4 * len(got["texts"])
        assert (len(got["texts"]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in texts)) == (bound > 1_000_000)


def pages(n, seed):
    rng = random.Random(seed)
    line = lambda: " ".join("".join(rng.choice("aeioutrns") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(6, 30))).capitalize() + "."
    out = []
    for _ in range(n):
        main = [line() for _ in range(rng.randint(1, 8))]
        out.append(("<html><head><title>x</title></head><body><nav><a href=a>Home</a></nav><article>" + "".join(f"<p>{t}</p>" for t in main) + f"</article><footer>{line()}</footer></body></html>", "\n".join(main)))
    return out


def test_main_text(spark):
    made = pages(120, 7)
    odd = [None, "", "plain words only", "<div><p>a<p>b", "<!-- x -->&lt;", "</div></p>", "<script>var a='<p>no</p>'</script>", "<p title='a>b'>", "<"]
    frame = spark.createDataFrame([(i, f"u{i}", h, 1) for i, h in enumerate([m[0] for m in made] + odd)], "page_id bigint, url string, html string, text int")
    rows = {r["page_id"]: r for r in H.extract(frame).collect()}
    assert len(rows) == len(made) + len(odd) and all(r["n_chars"] == len(r["text"]) for r in rows.values())
    assert sum(rows[i]["text"] == t for i, (_, t) in enumerate(made)) >= 0.97 * len(made)
    assert rows[120]["text"] == rows[121]["text"] == "" == rows[126]["text"]
    assert H.extract(frame.limit(0)).count() == 0


def test_blocks_of_hostile_pages():
    read = lambda page: [(b.text, [e[0] for e in reversed(b.node.steps())]) for b in H.blocks_of(page)]
    assert read("<head><title>x</title><article><p>text") == [("text", ["article", "p"])]
    assert read("<article><p>a<svg><p>b</article>") == [("a", ["article", "p"]), ("b", ["article", "p"])]
    assert read("<p>a<script>b<p>c") == [("a", ["p"])]
    assert read("<ul><li>a<li><b>b<li>c</ul><p>d<div>e</p>f") == [("a", ["ul", "li"]), ("b", ["ul", "li", "b"]), ("c", ["ul", "li"]), ("d", ["p"]), ("e", ["div"]), ("f", ["div"])]
    assert read("<table><tr><td>a<td>b<tr><td>c</table>") == [(x, ["table", "tr", "td"]) for x in "abc"]
    model = H.Crf().fit(H.training_pages([m[0] for m in pages(30, 3)], 2, random.Random(1)))
    n = 1 << 20
    for piece in ("<div>x y", "<b>x", '<div class="a b c">t', "<p><li><b>x", "</b>", "<!", "<svg>x", "<a '", "<ul><b><li>x"):
        began = time.process_time()
        H.main_text(piece * (n // len(piece)), model)
        assert time.process_time() - began < 60, piece
    own = H.blocks_of(pages(3, 5)[0][0])
    assert model.label(own) == model.decode(H.features(own))


def test_main_text_in_unseen_layouts():
    made = [m[0] for m in pages(100, 8)]
    model = H.Crf().fit(H.training_pages(made, 4, random.Random(1)))
    right = total = 0
    for rows, labels in H.training_pages([m[0] for m in pages(60, 9)], 3, random.Random(2)):
        got = model.decode(rows)
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97
    page = "<header class=top><a href=x>Home</a></header><div class=cookie-notice>We use cookies</div><div id=content><h2>Big &amp; title</h2><p>First part\n goes on &lt;here&gt; for a while and on.</p><div class='ad'>Buy now!</div><p>The last part of the text is rather long, really.</p></div><div class=comments><p>I liked this very much, thanks.</p></div>"
    assert H.main_text(page, model) == "Big & title\nFirst part goes on <here> for a while and on.\nThe last part of the text is rather long, really."


def test_viterbi_is_the_best_path():
    crf, rng = H.Crf(), random.Random(3)
    crf.pairs = np.array([[[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)] for _ in range(2)])
    rows = [[f"f{i}"] + (["new_parent"] if i % 3 == 1 else []) for i in range(8)]
    crf.weights = {f"f{i}": rng.gauss(0, 2) for i in range(8)}
    scores, new = crf.scores(rows)
    value = lambda ls: sum(s for s, l in zip(scores, ls, strict=True) if l) + sum(crf.pairs[new[i], ls[i - 1], ls[i]] for i in range(1, 8))
    paths = [[k >> i & 1 for i in range(8)] for k in range(256)]
    assert crf.decode(rows) == max(paths, key=value)
    weights = np.exp([value(p) for p in paths])
    marginal, _ = crf._expect(scores, new)
    assert np.allclose(marginal, (np.array(paths) * (weights / weights.sum())[:, None]).sum(axis=0))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs_
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf).cache()
        assert out.columns == docs_.columns and 0 < out.count() <= kept.count()
        if name == "near_dedup":
            want, _ = brute_components([r["text"] for r in kept.orderBy("doc_id").collect()], 5)
            assert out.count() == len(set(want))
        kept = out
    pieces = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_pipeline_of_odd_rows(spark):
    """Nulls, repeated rows, clashing columns and an empty table go through all stages."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    good = " ".join(r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 600 and lang = 'en'").orderBy("doc_id").limit(1).collect())
    rows = [(None, good), (None, good), (7, good), (7, good), (8, None), (9, ""), (None, None), (5, good + " And one more line of the text.")]
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id bigint, text string, score string, quality_votes string, dedup_k string")
    for table in (frame, frame.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf)
            assert kept.columns == frame.columns
        assert [r["doc_id"] for r in kept.collect()] == ([5] if table is frame else [])
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
        assert {r["doc_id"] for r in pieces} == ({5} if table is frame else set())
