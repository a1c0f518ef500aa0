"""License scans by diagonal voting, in DataFrame functions only.

Templates are short phrases (``PHRASES``, whose places the result counts) and longer notices (``NOTICES``). A text's rolling hashes of two and of
four words are joined with those of the templates, a constant table of a row for each template position. A hit of text position i with
template position j votes for the diagonal i - j; votes are added up by text, template and diagonal. With every hit goes an exact comparison of the
template's words with the text's along the diagonal, one bit for each word, so no hash decides anything. Words put in or left out move the
rest of a notice to a neighbouring diagonal: a diagonal is merged with those up to ``GAP`` beyond it, and a notice is found where the merged bits
hold at least ``SHARE`` of its words. A phrase is found on a diagonal that holds all of its words; its places aren't merged.

At scale. Hits are few against words, but every text is read whole, once: what is found (and a row for each text that carries its number of
words) is checkpointed. Votes are kept by text, as two hashes of 64 bits, not by document: they are unions of bits, so the copies
of a text, were they a third of all rows, fall together before the shuffle. What is found for a text goes back to its documents by a
join of two plain exchanges, which Spark splits where a text has very many.

Defined results: null and empty texts have no words, no labels, score 0 and null places; a text of one word likewise, with one word; null ids stay;
repeated rows each get their result; an empty table gives an empty result; other columns are ignored. The score is 1 where a phrase is found, else
the largest share of a template's words on merged diagonals that have a vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import LOWER, UPPER, checkpoint, let

#: The phrases of the contract with their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Notices of public licenses with their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
]
GAP, SHARE = 3, 0.8
#: Templates of at most SHORT words vote by pairs of words, longer ones by four; a template has at most 63 words, the bits of a bigint.
SHORT, PAIR, FOUR = 4, 2, 4
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for a whole text among its hashes.
WHOLE = -1


def scan_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, only A-Z lower-cased."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # the same for ASCII texts, and cheaper
    return F.array_remove(F.split(lowered, OTHER), "")


def rolling(words: Column) -> Column:
    """Hashes of the pairs of words that begin at each word, then those of the four words; at the end fewer, which match no template."""
    return let(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1))), lambda two: F.concat(two, F.transform(two, lambda h, i: F.xxhash64(h, F.get(two, i + 2)))))


def templates() -> list[tuple[int, list[str], str, bool, int]]:
    """Number, words, label, whether it is a phrase, and the words of a vote."""
    rows = [(*p, True) for p in PHRASES] + [(*n, False) for n in NOTICES]
    return [(i, words.split(), label, phrase, PAIR if len(words.split()) <= SHORT else FOUR) for i, (words, label, phrase) in enumerate(rows)]


def positions(spark: SparkSession) -> DataFrame:
    """A row for each template position with its hash, and one for the hash that stands for a whole text."""
    rows = spark.createDataFrame(templates(), "template int, t_words array<string>, label string, phrase boolean, k int")
    n = F.size("t_words")
    at = F.when(F.col("k") == PAIR, F.col("at")).otherwise(F.col("at") - n)
    found = rows.select("template", "t_words", "k", F.posexplode(rolling(F.col("t_words"))).alias("at", "hash")).withColumn("position", at).where((F.col("position") >= 0) & (F.col("position") <= n - F.col("k"))).drop("at")
    return found.unionByName(spark.createDataFrame([(-1, [], 0, WHOLE, 0)], found.schema))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each text a row with template -1 and its number of words, and one for each hash that is a template's: diagonal, vote and words that agree."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"), scan_words(text).alias("words"))
    hashes = F.concat(F.array(F.lit(WHOLE).cast("bigint")), rolling(F.col("words")))
    rolled = rows.select("*", F.posexplode(hashes).alias("at", "hash"))
    found = rolled.join(F.broadcast(positions(docs.sparkSession)), "hash").where((F.col("at") == 0) == (F.col("template") < 0))  # a constant table
    n = F.size("words")
    start = F.when(F.col("k") == PAIR, F.col("at") - 1).when(F.col("k") == FOUR, F.col("at") - 1 - n).otherwise(0)
    diagonal = start - F.col("position")
    agree = F.aggregate(
        F.transform("t_words", lambda w, j: F.when(F.get(F.col("words"), F.col("diagonal") + j) == w, _bit(j)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)
    )
    placed = found.where((F.col("k") != PAIR) | (F.col("at") <= n)).where((F.col("k") != FOUR) | (F.col("at") > n)).withColumn("diagonal", diagonal)
    return placed.select("doc_id", "d1", "d2", "template", "diagonal", n.cast("bigint").alias("n_words"), _bit(F.col("position")).alias("vote"), agree.alias("agree"))


def verdicts(found: DataFrame) -> DataFrame:
    """What is found in each text that has a hit, from its votes."""
    spark = found.sparkSession
    known = spark.createDataFrame([(i, label, phrase, len(words)) for i, words, label, phrase, _ in templates()], "template int, label string, phrase boolean, length int")
    voted = found.where("template >= 0").groupBy("d1", "d2", "template", "diagonal").agg(F.bit_or("vote").alias("votes"), F.bit_or("agree").alias("agree"))
    by_text = voted.repartition("d1", "d2")  # one row for each text, template and diagonal; what follows needs no other shuffle
    merged = F.bit_or("agree").over(Window.partitionBy("d1", "d2", "template").orderBy("diagonal").rangeBetween(0, GAP))
    judged = by_text.withColumn("merged", merged).join(F.broadcast(known), "template")  # a constant table
    share = F.bit_count(F.when(F.col("phrase"), F.col("agree")).otherwise(F.col("merged"))) / F.col("length")
    place = F.when(F.col("phrase") & (F.col("share") == 1), F.col("diagonal"))
    label = F.when(F.col("share") >= F.when(F.col("phrase"), 1.0).otherwise(SHARE), F.col("label"))
    return (
        judged.withColumn("share", share)
        .groupBy("d1", "d2")
        .agg(
            F.count(place).alias("n_base"),
            F.min(place).cast("bigint").alias("first_word"),
            F.max(place).cast("bigint").alias("last_word"),
            F.collect_set(F.when(place.isNotNull(), F.col("label"))).alias("base"),
            F.collect_set(label).alias("all"),
            F.max("share").alias("score"),
            F.max(F.bit_count("votes")).alias("votes"),
        )
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, places of phrases, labels and score for every row of ``docs``."""
    found = checkpoint(hits(docs, id_col, text_col))
    judged = checkpoint(verdicts(found))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return (
        found.where("template < 0")
        .join(judged, ["d1", "d2"], "left")
        .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word", joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
    )
