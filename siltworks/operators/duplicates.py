"""Duplicate flags over records: repeated keys, and similar titles within a window of rows."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import text as X
from ..session import settled

WINDOW = 50


def structural(records: DataFrame, key: str, order: str = "row_index") -> DataFrame:
    """(order, target, key) of the rows whose key an earlier row has; target is the first such row."""
    w = Window.partitionBy(key).orderBy(order)
    df = records.where(F.col(key).isNotNull() & (F.col(key) != ""))
    df = df.select(order, key, F.row_number().over(w).alias("__n"), F.first(order).over(w).alias("target"))
    return df.where("__n > 1").select(order, "target", key)


def windowed(rows: DataFrame, columns: list[str], window: int = WINDOW) -> DataFrame:
    """(i, j, a_*, b_*): pairs of rows at most window - 1 apart by their dense number i, with the columns of both.

    Rows are joined on stretches of window rows, each row with its own and the one before, so that
    the join is an equi-join.
    """
    near = F.explode(F.array(F.floor(F.col("i") / window), F.floor(F.col("i") / window) + 1))
    left = rows.select("i", *[F.col(c).alias(f"a_{c}") for c in columns], near.alias("k"))
    right = rows.select(F.col("i").alias("j"), *[F.col(c).alias(f"b_{c}") for c in columns], F.floor(F.col("i") / window).alias("k"))
    return left.join(right, "k").where(f"j > i and j < i + {window}").drop("k")


def titled(records: DataFrame, title: str, order: str) -> DataFrame:
    """(i, t): the numbers and titles of records that have one."""
    return records.select(F.col(order).cast("bigint").alias("i"), F.col(title).alias("t")).where("t is not null and trim(t) <> ''")


def window_pairs(records: DataFrame, title: str = "title", order: str = "row_index", window: int = WINDOW) -> DataFrame:
    """(i, j, a, b): the titles of rows at most window - 1 apart. order must be dense."""
    return windowed(titled(records, title, order), ["t"], window).select("i", "j", F.col("a_t").alias("a"), F.col("b_t").alias("b"))


def word_overlap(x: Column, y: Column) -> Column:
    """Shared share of the distinct words of two texts in comparable form, a decimal with six places."""
    a, b = (F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")) for c in (x, y))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, (F.size(F.array_intersect(a, b)).cast("decimal(9,0)") / union.cast("decimal(9,0)")).cast("decimal(9,6)")).otherwise(F.lit(0).cast("decimal(9,6)"))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


#: Classes of this many pairs of titles are broadcast; more are joined by a shuffle.
BROADCAST_CLASSES = 500_000


def title_classes(pairs: DataFrame) -> DataFrame:
    """(x, y, similarity, duplicate_type) of pairs (x, y) of different titles in comparable form.

    Similarity is half the character ratio and half the word overlap. No pair below an overlap of 0.2998,
    and none whose lengths allow no ratio that reaches 0.65, goes through Python.
    """
    longest = 2.0 * F.least(F.length("x"), F.length("y")) / (F.length("x") + F.length("y"))
    near = pairs.withColumn("jaccard", word_overlap(F.col("x"), F.col("y"))).where(F.col("jaccard") >= 0.2998)
    near = near.where(0.5 * longest + 0.5 * F.col("jaccard").cast("double") >= 0.6499)
    made = near.withColumn("similarity", F.round(0.5 * _ratio("x", "y") + 0.5 * F.col("jaccard").cast("double"), 4))
    tiers = F.array(*[F.lit(t) for t in K.TIERS])
    left, right = (F.array_sort(F.array_intersect(tiers, F.split(c, " "))) for c in ("x", "y"))
    kind = (
        F.when(F.col("similarity") >= 0.98, "EXACT_DUPLICATE")
        .when((F.col("similarity") >= 0.65) & (F.size(left) > 0) & (F.size(right) > 0) & (left != right), "LEGITIMATE_RELATED_RECORD")
        .when(F.col("similarity") >= 0.78, "POSSIBLE_SEMANTIC_DUPLICATE"))
    return made.select("x", "y", "similarity", kind.alias("duplicate_type")).where("duplicate_type is not null")


def similar_pairs(records: DataFrame, title: str = "title", order: str = "row_index", window: int = WINDOW) -> DataFrame:
    """(i, j, similarity, duplicate_type) of similar titles.

    Titles take their comparable form once for each row, and each pair of different titles is classed
    once, however often it occurs; the pairs of rows are then looked up in those classes.
    """
    rows = titled(records, title, order).select("i", X.comparable(F.col("t")).alias("x")).where("x <> ''")
    pairs = windowed(rows, ["x"], window).select("i", "j", F.col("a_x").alias("x"), F.col("b_x").alias("y"))
    # settled, or what is asked of a pair of titles would be asked of every pair of rows before they are made distinct
    titles = settled(pairs.where("x <> y").select("x", "y").distinct())
    classes = settled(title_classes(titles))
    few = classes.count() <= BROADCAST_CLASSES
    different = pairs.where("x <> y").join(F.broadcast(classes) if few else classes, ["x", "y"])
    equal = pairs.where("x = y").select("i", "j", F.lit(1.0).alias("similarity"), F.lit("EXACT_DUPLICATE").alias("duplicate_type"))
    return different.select("i", "j", "similarity", "duplicate_type").unionByName(equal)


def last_flag(pairs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(row_index, duplicate_type): of several flags of a row the last one; repeated keys come before pairs.

    Pairs are flagged in the order of i and j, and the flag of a pair is on its later row.
    """
    marks = repeated.select("row_index", F.lit("STRUCTURAL_DUPLICATE").alias("duplicate_type"), F.lit(-1).cast("bigint").alias("at"))
    marks = marks.unionByName(pairs.select(F.col("j").alias("row_index"), "duplicate_type", F.col("i").alias("at")))
    return marks.groupBy("row_index").agg(F.max_by("duplicate_type", "at").alias("duplicate_type"))


def class_counts(pairs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(duplicate_type, n): flags by class, repeated keys among them."""
    kinds = pairs.select("duplicate_type").unionByName(repeated.select(F.lit("STRUCTURAL_DUPLICATE").alias("duplicate_type")))
    return kinds.groupBy("duplicate_type").agg(F.count("*").alias("n"))
