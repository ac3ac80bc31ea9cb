"""What filters remove, alone and after each other, by a Walsh-Hadamard transform (operator 12).

Five filters (FILTERS) judge each text; which of them it fails is its mask, a number below 32. Of each part of the
corpus (a value of lang) and each label (any document, one of quality 1, a toxic one) 32 signed sums are formed, one
for each set s of filters: the documents that fail an even number of s less those that fail an odd number. The
transform is its own inverse but for a factor of 32, so these sums give back exactly how many documents have each
mask. With these 32 numbers every question about an order of the filters is a sum: what a step removes fails its
filter and none before; what is redundant fails it and one before. Over all 120 orders a document that fails f filters
is removed by each of these equally often, in 120 / f orders, which is the closed form of the filter's Shapley sum.

Filter E asks whether a smaller doc_id has the same text, in the whole table. Texts are told apart by their SHA-256,
and only digests are shuffled. Documents of one text, part and label are counted before they meet, so that a text that
a third of the table has is a few rows in its task.

Null texts are empty, null langs are the part ''. A null doc_id has no smaller one and is none. Rows of one doc_id and
text are equal, so none makes another fail E. A document has a label if any row of labels says so for its doc_id; other
labels than 1 are none. An empty table has no parts and so no rows. Other columns play no part.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = 120
#: Least words; least share of distinct words and most of capitals, in hundredths; characters that make a text look like code.
WORDS, DISTINCT, CAPITALS, CODE = 200, 50, 3, r"[#$%&*|]"
LABELS = ("documents", "good", "toxic")


def failures(text: str = "text") -> Column:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words = F.filter(F.split(text, r"[ \x09-\x0D]+"), lambda w: w != "")
    many, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals, points = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"), F.length(text).cast("long")
    fails = (many < WORDS, 100 * distinct < DISTINCT * many, 100 * capitals > CAPITALS * points, F.col(text).rlike(CODE))
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: documents counted by these, in no particular order and not fully combined."""
    rows = documents.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    ).select("doc_id", "part", F.sha2("text", 256).alias("digest"), failures().alias("mask"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        *[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int").alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    )
    once = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # stored, so that the join knows its size, and can split the rows of a very frequent doc_id
    known = once.join(store(marks), "doc_id", "left").na.fill(0, ["good", "toxic"])
    alike = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.min("doc_id").alias("least"), F.sum("n").alias("n"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    fresh = F.col("nameless") + F.when(first, F.col("at_least")).otherwise(0)
    return (
        alike.select("part", "mask", "good", "toxic", "n", fresh.alias("fresh"))
        .select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))).alias("x"))
        .select("part", "good", "toxic", "x.*").where("n > 0")
    )


def sign(a: Column, b: Column) -> Column:
    """1 where two sets of filters have an even number in common, else -1."""
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, and for each label an array of the 32 signed sums."""
    weight = dict(zip(LABELS, (F.col("n"), F.col("n") * F.col("good"), F.col("n") * F.col("toxic"))))
    sums = rows.groupBy("part").agg(*[F.sum(sign(F.col("mask"), F.lit(s)) * weight[name]).alias(f"{name}{s}") for name in LABELS for s in range(MASKS)])
    return sums.select("part", *[F.array(*[f"{name}{s}" for s in range(MASKS)]).alias(name) for name in LABELS])


def cells(sums: DataFrame) -> DataFrame:
    """part, and for each label how many documents have each of the 32 masks: the sums transformed again, divided by 32."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def inverse(name: str) -> Column:
        one = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda total, s: total + sign(m, s) * F.get(name, s))
        return F.transform(every, lambda m: F.floor(one(m) / MASKS)).alias(name)

    return sums.select("part", *[inverse(name) for name in LABELS])


def steps() -> Column:
    """Every order and step, as an array: filter_order, step, the step's filter (bit) and those before it (bits)."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "own": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order: string, step: int, own: int, before: int>>")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    known = cells(parity_sums(judged(documents, labels)))
    own, before = F.col("own"), F.col("before")
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def counted(name: str, which) -> Column:
        share = lambda m: F.when(which(m), F.get(name, m)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(every, F.lit(0).cast("long"), lambda total, m: total + share(m))

    within = lambda m, some: m.bitwiseAND(some) != 0
    removed = lambda m: within(m, own) & ~within(m, before)
    shapley = F.aggregate(
        every, F.lit(0).cast("long"),
        lambda total, m: total + F.when(within(m, own), F.get("documents", m) * F.floor(ORDERS / F.bit_count(m))).otherwise(F.lit(0).cast("long")),
    )
    return known.withColumn("at", F.explode(steps())).select("part", *LABELS, "at.*").select(
        "part", "filter_order", "step", counted("documents", lambda m: ~within(m, own.bitwiseOR(before))).alias("kept"), counted("documents", removed).alias("removed"),
        counted("documents", lambda m: within(m, own) & within(m, before)).alias("redundant"), F.get("documents", own).alias("unique_fails"),
        counted("good", removed).alias("good_lost"), counted("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"),
    )
