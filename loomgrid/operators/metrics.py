"""Metrics of probabilities against labels: threshold sweep, confusion, ROC, and roll-ups of importances.

``scored`` has columns y (0 or 1) and p (probability).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratios(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1; a metric without a base is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {"accuracy": share(tp + tn, tp + fp + fn + tn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}


def threshold_sweep(scored: DataFrame, start: int = 10, stop: int = 90, step: int = 1) -> DataFrame:
    """Metrics at every threshold (in hundredths): predicted positive where p >= threshold.

    Rows are counted once, by how many thresholds they reach; running sums over those counts give every threshold.
    """
    n = (stop - start) // step + 1
    grid = [round((start + k * step) / 100, 10) for k in range(n)]
    reached = F.lit(0)
    guess = F.least(F.greatest(F.floor((F.col("p") * 100 - start) / step), F.lit(-1)), F.lit(n - 1)).cast("int")
    edges = F.array(*(F.lit(g) for g in grid))
    # floor may be off by one for thresholds that aren't exact in binary: compare with the neighbours themselves
    at = lambda k: F.when(k < 0, F.lit(True)).when(k >= n, F.lit(False)).otherwise(F.col("p") >= F.get(edges, k))
    reached = F.when(at(guess + 1), guess + 2).when(at(guess), guess + 1).otherwise(guess)
    counts = scored.where("p is not null").groupBy(reached.alias("k")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    spine = scored.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").fillna(0)
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # n + 1 rows
    whole = Window.partitionBy()
    summed = spine.select("k", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(whole).alias("p_all"), F.sum("neg").over(whole).alias("n_all"))
    found = summed.where("k > 0").withColumn("threshold", F.get(edges, F.col("k") - 1)).withColumn("fn", F.col("p_all") - F.col("tp")).withColumn("tn", F.col("n_all") - F.col("fp"))
    m = ratios(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return found.select("threshold", *(F.round(m[c], 6).alias(c) for c in ("f1", "recall", "precision")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest F1, then recall, then precision, then the lowest threshold."""
    return sweep.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "threshold").limit(1)


def confusion_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    hit = F.col("p") >= threshold
    n = F.count_if
    counts = scored.agg(n(hit & (F.col("y") == 1)).alias("tp"), n(hit & (F.col("y") == 0)).alias("fp"), n(~hit & (F.col("y") == 1)).alias("fn"), n(~hit & (F.col("y") == 0)).alias("tn"))
    m = ratios(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select("tp", "fp", "fn", "tn", *(F.round(v, 6).alias(k) for k, v in m.items()), F.round(F.try_divide(F.col("tp") + F.col("fn"), total), 6).alias("positive_rate"), F.round(F.try_divide(F.col("tp") + F.col("fp"), total), 6).alias("predicted_rate"))


def group_errors(scored: DataFrame, groups: list[list[str]], threshold: float) -> DataFrame:
    """Errors of each group of each grouping (lists of columns; an empty one is the whole), by one pass over the rows with subtotals.

    ``grouping`` names the columns that a row is of; the others are NULL. ``bias``: mean probability less share of positives.
    """
    columns = sorted({c for g in groups for c in g})
    hit = F.col("p") >= threshold
    n = F.count_if
    rows = scored.where("p is not null and y is not null").select(*columns, "p", F.col("y").cast("int").alias("y"))
    named = F.concat_ws("+", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in columns))
    found = rows.groupingSets([[F.col(c) for c in g] for g in groups], *columns).agg(
        named.alias("grouping"), n(hit & (F.col("y") == 1)).alias("tp"), n(hit & (F.col("y") == 0)).alias("fp"), n(~hit & (F.col("y") == 1)).alias("fn"), n(~hit & (F.col("y") == 0)).alias("tn"),
        F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("brier"), F.round(F.avg(F.col("p") - F.col("y")), 6).alias("bias"),
    )
    m = ratios(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return found.select("grouping", *columns, "tp", "fp", "fn", "tn", *(F.round(v, 6).alias(k) for k, v in m.items()), "brier", "bias")


def by_score(scored: DataFrame, buckets: int = 4096) -> DataFrame:
    """Positives and negatives at each distinct probability, with those above it.

    Distinct probabilities are summed within ``buckets`` ranges of p first, so that running sums go over ranges and, inside a
    range, over its own probabilities, never over all in one task.
    """
    values = scored.where("p is not null").groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    values = values.withColumn("bucket", F.least(F.floor(F.col("p") * buckets), F.lit(buckets - 1)))
    ranges = values.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    over = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    ranges = ranges.select("bucket", F.coalesce(F.sum("pos").over(over), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("neg").over(over), F.lit(0)).alias("neg_above"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    summed = values.select("*", F.sum("pos").over(inside).alias("pos_in"), F.sum("neg").over(inside).alias("neg_in")).join(ranges, "bucket")
    return summed.select("p", "pos", "neg", (F.col("pos_above") + F.col("pos_in")).alias("tp"), (F.col("neg_above") + F.col("neg_in")).alias("fp"))


def roc_points(scored: DataFrame) -> DataFrame:
    """False and true positive rates at every distinct probability."""
    whole = scored.where("p is not null").agg(F.count_if(F.col("y") == 1).alias("p_all"), F.count_if(F.col("y") == 0).alias("n_all"))
    rows = by_score(scored).crossJoin(F.broadcast(whole))  # one row
    return rows.select(F.round("p", 9).alias("threshold"), F.round(F.try_divide(F.col("fp"), F.col("n_all")), 6).alias("fpr"), F.round(F.try_divide(F.col("tp"), F.col("p_all")), 6).alias("tpr"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half; NULL with one class only."""
    rows = by_score(scored)
    wins = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos")) + F.col("neg").cast("double") * F.col("pos") / 2)
    return rows.agg(F.round(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")), 6).alias("auc"))


def importance_rollup(encoded: DataFrame, feature: Column) -> DataFrame:
    """Importances of encoded columns (name, importance) summed by the feature they come from, largest first."""
    return encoded.groupBy(feature.alias("feature")).agg(F.round(F.sum("importance"), 6).alias("importance")).orderBy(F.desc("importance"), "feature")


def melt_metrics(wide: DataFrame, id_col: str, metrics: list[str]) -> DataFrame:
    return wide.unpivot([id_col], metrics, "metric", "value")


def best_model(results: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Highest F1, then recall, then AUC, on validation rows; the first of ``names`` among equals."""
    return results.orderBy(F.desc("f1"), F.desc("recall"), F.desc("auc"), F.array_position(F.array(*(F.lit(n) for n in names)), F.col("model"))).limit(1)


def class_balance(found: DataFrame, label: str = "target") -> DataFrame:
    """Rows, positives, and the weight of a positive (negatives over positives, 1 without positives)."""
    n = found.agg(F.count("*").alias("n_rows"), F.count_if(F.col(label) == 1).alias("positives"))
    return n.select("n_rows", "positives", F.round(F.coalesce(F.try_divide(F.col("n_rows") - F.col("positives"), F.col("positives")), F.lit(1.0)), 6).alias("positive_weight"))


def exact_sample(rows: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows picked by hash of the key (a sampling operator); all rows where n <= 0 or there aren't more.

    Rows are counted by the first 16 bits of their hashes; only those of the one value in which the n-th row lies are ordered, the lower ones are taken as they are.
    """
    if n <= 0:
        return rows
    hashed = F.md5(F.concat_ws("|", key, F.lit(str(seed))))
    first, before = F.substring(hashed, 1, 4), 0
    for found, count in rows.groupBy(first.alias("first")).agg(F.count("*").alias("n")).orderBy("first").collect():  # at most 65,536 rows
        if before + count > n:
            return rows.where(first < found).unionByName(rows.where(first == found).orderBy(hashed, key).limit(n - before))
        before += count
    return rows
