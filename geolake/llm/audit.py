"""How filters interact: what each one removes in every order they can be applied in.

Every text is reduced to a mask, one bit a filter that it fails. Rows are counted by part, mask and label, so that a table of
any size leaves at most 32 cells a part and label. Cells are unpivoted against the 600 steps of all orders; a running bit-or
over the steps before tells which texts are gone already, and conditional sums and windows over the filters give the metrics.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SPACE = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for the filters A to D that a text fails by itself: few words, few distinct words, many capitals, symbols."""
    trimmed = F.trim(text, F.lit(SPACE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n = F.when(trimmed == "", 0).otherwise(F.size(words))
    distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    failed = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part and mask, and how many of them are labelled good and toxic.

    Filter E fails on texts that a smaller doc_id has too. Only ids, 256-bit digests, masks and parts are shuffled. Rows are
    counted by digest before digests are gathered, so a text of a third of all rows is a few counts to its task. A null text is
    an empty one. Rows without an id are no copies, nor are others copies of them, and they have no label.
    Rows of one id are counted each for itself. Of several labels of an id, any good and any toxic one counts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    known = d.where("doc_id is not null").join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    # rows by id first: the join has left them together
    known = known.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    # the smallest id of a text is no copy; by the number of rows an id has, its rows can be told from the counts
    texts = known.groupBy(*kind, "n").agg(F.count("*").alias("ids"), F.min("doc_id").alias("least"))
    first = F.when(F.col("least") == F.min("least").over(Window.partitionBy("digest")), 1).otherwise(0)
    texts = texts.withColumn("first", first)
    copy = 1 << FILTERS.index("E")
    both = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") * F.col("first")).alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") * (F.col("ids") - F.col("first"))).alias("n")),
    )
    counted = texts.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    unknown = d.where("doc_id is null").select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "mask", F.lit(1).cast("long").alias("n"))
    return counted.unionByName(unknown).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def outcomes(spark: SparkSession) -> DataFrame:
    """(mask, filter_order, step, filter, kept, removed, redundant, unique): what becomes of each mask at each step of each order.

    32 masks times 600 steps whatever the input: the bits that a mask fails before a step are a running bit-or over the order.
    """
    steps = [("".join(p), k + 1, f, 1 << FILTERS.index(f)) for p in itertools.permutations(FILTERS) for k, f in enumerate(p)]
    long = spark.createDataFrame(steps, "filter_order string, step int, filter string, bit int")
    long = long.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)))).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    return long.select(
        "mask", "filter_order", "step", "filter", (F.col("earlier") + F.col("fails") == 0).alias("kept"), ((F.col("fails") > 0) & (F.col("earlier") == 0)).alias("removed"),
        ((F.col("fails") > 0) & (F.col("earlier") > 0)).alias("redundant"), (F.col("mask") == F.col("bit")).alias("unique"),
    )


def metrics(counted: DataFrame) -> DataFrame:
    """The metrics of every part, order and step from `cells`, zeros included. Parts that a row has are there; without rows there are none."""
    rows = counted.join(F.broadcast(outcomes(counted.sparkSession)), "mask")

    def total(what: str, when: str) -> Column:
        return F.sum(F.when(F.col(when), F.col(what)).otherwise(0))

    out = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", "kept").alias("kept"), total("n", "removed").alias("removed"), total("n", "redundant").alias("redundant"), total("n", "unique").alias("unique_fails"),
        total("good", "removed").alias("good_lost"), total("toxic", "removed").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    See `cells` for nulls, repeated rows and labels. Empty documents give no rows, an empty table of labels zeros. Columns
    other than doc_id, text, source, quality and toxic aren't read.
    """
    # the few cells are kept in the shared folder: the texts are read once
    return metrics(stored(cells(docs, labels), "cells"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
