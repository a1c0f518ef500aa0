"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Main path: DataFrame functions only. Every rule is a column expression over the whole text. The
distinct vote patterns (at most 3**len(RULES), whatever the input) are counted over all documents in
one aggregation; expectation-maximisation of a two-class model runs on those counts, and the fitted
log-odds go back into the plan as literals.

Model: a text is good or bad; a rule that votes on it votes good with a probability of its own for either class,
independently of the other rules, and whether it votes at all says nothing. Nothing is clamped: probabilities and the share
of good texts are maximum a posteriori estimates under Beta priors (``VOTES_GOOD``, ``GOOD``) that weigh as much
as ``WEIGHT`` of the documents and one more, so they do the same at every size. The priors also tell the two classes apart:
most rules vote good on good texts, while a bad text breaks some rules only. So a bad vote of a rule that often fails on good texts
can be outvoted, and several weak votes can reject a text.

Defined results: a null or empty text has no words, all counts 0, fails the base rule and is not kept;
every row is judged by its own text, so repeated rows give repeated results; null ids stay null; an
empty table gives an empty result (the model is then the prior); other columns of the
input are ignored by ``quality_rules`` and kept untouched by ``keep_good``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import SPACE, checkpoint, fresh, let, words

#: Fixed value: the symbols that the contract counts.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """the of and to in is that it for was on are as with by be at this from or an le la les de des du et un une en que qui
est dans pour pas par sur au der die das den und zu mit von ist ein eine nicht im für auf el los las y una con por para se es lo""".split()
WINDOW = 5


def _repeated_words(ws: Column) -> Column:
    """Words covered by WINDOW-word windows that occur at least twice in the text.

    Windows are compared by 64-bit hash. Only texts with a repeated window pay for the sort that finds
    where the repeats are; all steps are O(n log n) in the text.
    """
    hashes = F.when(
        F.size(ws) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, p: F.struct((p + WINDOW).cast("bigint").alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).cast("bigint").alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def starts(s: Column) -> Column:
        same = lambda e, k: F.get(s, k)["h"].eqNullSafe(e["h"])
        return F.sort_array(F.filter(F.transform(s, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"])), lambda p: p.isNotNull()))

    def search(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(ordered, lambda s: let(starts(s), covered)))

    return let(hashes, search)


def measures(text: Column) -> Column:
    """Struct of the base counts and of the measures that the rules read."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    count = lambda c: c.cast("bigint")

    def of(ws: Column, ls: Column) -> Column:
        return F.struct(
            count(F.size(ws)).alias("n_words"),
            count(F.length(F.translate(text, "\x20\x09\x0a\x0b\x0c\x0d", ""))).alias("word_chars"),
            count(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
            count(F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"),
            _repeated_words(ws).alias("n_repeat_words"),
            count(F.size(F.array_distinct(ws))).alias("n_distinct_words"),
            count(F.size(F.array_intersect(ws, F.array(*(F.lit(w) for w in STOP_WORDS))))).alias("n_stop_words"),
            count(F.size(ls)).alias("n_lines"),
            count(F.regexp_count(text, F.lit(r"\p{Lu}"))).alias("n_upper"),
            count(F.regexp_count(text, F.lit(r"[#*$%&|<>](?=[\x20\x09-\x0D]|\z)"))).alias("n_marked_words"),
            count(F.regexp_count(text, F.lit(r"[.!?…][\"'”»)]*[\x20\x09\x0B-\x0D]*(\n|\z)"))).alias("n_closed_lines"),
        )

    return let(words(text), lambda ws: let(lines, lambda ls: of(ws, ls)))


#: name: (measure, over what, votes good beyond, votes bad beyond, is a low value good); between the two a rule abstains.
RULES: dict[str, tuple[str, str | None, float, float, bool]] = {
    "symbols": ("n_symbols", "word_chars", 0.005, 0.03, True),
    "marked_words": ("n_marked_words", "n_words", 0.01, 0.10, True),
    "repeats": ("n_repeat_words", "n_words", 0.02, 0.15, True),
    "dup_lines": ("n_dup_lines", "n_lines", 0.10, 0.35, True),
    "upper": ("n_upper", "word_chars", 0.06, 0.15, True),
    "word_length": ("word_chars", "n_words", 4.5, 3.5, False),
    "stop_words": ("n_stop_words", None, 4, 1, False),
    "variety": ("n_distinct_words", "n_words", 0.55, 0.40, False),
    "closed_lines": ("n_closed_lines", "n_lines", 0.70, 0.40, False),
}
#: Texts under so many words say too little for these rules, which then abstain.
MIN_WORDS = {"variety": 30, "stop_words": 30, "closed_lines": 20, "word_length": 20, "upper": 20, "dup_lines": 20}
#: Prior means of the probability that a rule votes good on a good (1) and on a bad (0) text, and of a text being good; prior weight as a share of all documents.
VOTES_GOOD, GOOD, WEIGHT = {1: 0.97, 0: 0.5}, 0.8, 0.02


def pattern(m: Column) -> Column:
    """The votes on a text as one number: a digit to base 3 for each rule, 0 for bad, 1 for no opinion, 2 for good."""
    total = F.lit(0)
    for r, (name, (what, over, good, bad, low)) in enumerate(RULES.items()):
        share = m[what] / F.nullif(m[over], F.lit(0)) if over else m[what]
        yes, no = (share <= good, share >= bad) if low else (share >= good, share <= bad)
        digit = F.when(m["n_words"] < MIN_WORDS.get(name, 1), 1).when(yes, 2).when(no, 0).otherwise(1)
        total = total + digit * 3**r
    return total.cast("int")


def votes_of(code: int) -> tuple[int, ...]:
    """Votes (1 good, -1 bad, 0 none) of a pattern."""
    return tuple(code // 3**r % 3 - 1 for r in range(len(RULES)))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500, settled: float = 1e-9) -> tuple[float, list[dict[int, float]]]:
    """EM on counted vote patterns; returns the share of good texts, and each rule's probability to vote good, if it votes, by class."""
    strength = 1 + WEIGHT * sum(n for _, n in patterns)
    prior, theta = GOOD, [dict(VOTES_GOOD) for _ in RULES]
    for _ in range(rounds):
        weights, start = log_odds(theta), math.log(prior / (1 - prior))
        good, total = strength * GOOD, strength
        up, cast = [{c: strength * x for c, x in VOTES_GOOD.items()} for _ in RULES], [dict.fromkeys(VOTES_GOOD, strength) for _ in RULES]
        for votes, count in patterns:
            p = 1 / (1 + math.exp(-max(-700.0, start + sum(w[v] for w, v in zip(weights, votes, strict=True)))))
            good, total = good + count * p, total + count
            for r, v in enumerate(votes):
                if v:
                    for c, share in ((1, count * p), (0, count * (1 - p))):
                        cast[r][c] += share
                        up[r][c] += share * (v > 0)
        before, prior = [prior, *(t[c] for t in theta for c in (0, 1))], good / total
        theta = [{c: u[c] / n[c] for c in (0, 1)} for u, n in zip(up, cast, strict=True)]
        if max(abs(a - b) for a, b in zip(before, [prior, *(t[c] for t in theta for c in (0, 1))], strict=True)) < settled:
            break
    return prior, theta


def log_odds(theta: list[dict[int, float]]) -> list[dict[int, float]]:
    """Evidence for a good text of each rule's votes."""
    return [{1: math.log(t[1] / t[0]), -1: math.log((1 - t[1]) / (1 - t[0])), 0: 0.0} for t in theta]


def fitted(df: DataFrame, code: str) -> tuple[float, list[dict[int, float]]]:
    """The model of a DataFrame's patterns."""
    return fit(sorted((votes_of(r[0]), r[1]) for r in df.groupBy(code).count().collect()))  # at most 3**len(RULES) rows


def posterior(code: Column, model: tuple[float, list[dict[int, float]]]) -> Column:
    """Probability that a text with this pattern is good."""
    prior, theta = model
    total = F.lit(math.log(prior / (1 - prior)))
    for r, w in enumerate(log_odds(theta)):
        digit = F.floor(code / 3**r) % 3
        total = total + F.when(digit == 2, w[1]).when(digit == 0, w[-1]).otherwise(w[0])
    return 1 / (1 + F.exp(-total))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, vote pattern, posterior and verdict for every row of ``docs``.

    The measures are taken once and checkpointed (ids and a few numbers, no text), since both the fit and
    the result read them.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = lambda m: F.struct(*(m[c].alias(c) for c in counts), base_failed(m).alias("base_failed"), pattern(m).alias("pattern"))
    found = checkpoint(docs.select(F.col(id_col).alias("doc_id"), let(measures(F.col(text_col)), judged).alias("m")).select("doc_id", "m.*"))
    chance = posterior(F.col("pattern"), fitted(found, "pattern"))
    return found.withColumn("posterior", chance).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Rows are checkpointed with their pattern, since the fit has to see all patterns before the first row can be judged; so
    the measures, by far the dearest part, are taken once.
    """
    raw = fresh(docs, "quality_votes")
    both = lambda m: F.struct(base_failed(m).alias("failed"), pattern(m).alias("code"))
    found = checkpoint(docs.withColumn(raw, let(measures(F.col(text_col)), both)))
    model = fitted(found.select(f"{raw}.code"), "code")
    return found.where(~F.col(f"{raw}.failed") & (posterior(F.col(f"{raw}.code"), model) >= threshold)).select(*docs.columns)
