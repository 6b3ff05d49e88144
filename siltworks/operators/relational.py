"""Splitting cells that list several items into entity, dimension, junction and review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Rows whose first items are numbered together.
RANGE = 100_000


def primary(records: DataFrame, key: str, fields: list[str], order: str = "row_index") -> DataFrame:
    """One row per record: entity_id (the key, or ROW-nnnn), each field cleaned and as it was."""
    made = F.coalesce(F.when(F.trim(key) != "", F.trim(key)), F.format_string("ROW-%04d", F.col(order)))
    columns = [c for f in fields for c in (X.null_if_token(X.collapse(F.col(f))).alias(f), F.col(f).alias(f"{f}_raw"))]
    return records.select(order, made.alias("entity_id"), *columns)


#: The certainty of a record that names none.
SURE = 0.85


def placed(table: DataFrame, records: DataFrame, page: str, confidence: str | None = None, order: str = "row_index") -> DataFrame:
    """A table of primary() or junction() with the source_page and confidence of the record that each row comes from.

    A null page is page 1, and a null certainty, or none at all, is SURE.
    """
    sure = F.col(confidence).cast("double") if confidence else F.lit(None).cast("double")
    return table.join(records.select(order, F.coalesce(page, F.lit(1)).cast("bigint").alias("source_page"), F.coalesce(sure, F.lit(SURE)).alias("confidence")), order)


def dimension(records: DataFrame, cell: str, order: str = "row_index", prefix: str = "DIM", width: int = 4) -> DataFrame:
    """(item_id, item_key, item): the distinct items of a list column, numbered by first appearance.

    Items are dealt out in ranges of their first row, numbered within each range and moved on by the
    size of the ranges before it, so no task sees all of them.
    """
    items = records.select(F.col(order), F.posexplode(X.split_items(F.col(cell))).alias("pos", "item"))
    first = items.groupBy(F.lower("item").alias("item_key")).agg(F.min(F.struct(order, "pos", "item")).alias("f"))
    dealt = first.withColumns({"r": F.col(f"f.{order}"), "p": F.col("f.pos")})
    block = dealt.withColumn("b", F.floor(F.col("r") / RANGE))
    # ranges are few beside the items: one count each
    sizes = block.groupBy("b").agg(F.count("*").alias("size"))
    before = sizes.withColumn("base", F.coalesce(F.sum("size").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    ranked = block.join(before, "b").withColumn("n", F.col("base") + F.row_number().over(Window.partitionBy("b").orderBy("r", "p")))
    return ranked.select(F.format_string(f"{prefix}-%0{width}d", "n").alias("item_id"), "item_key", F.col("f.item").alias("item"))


def junction(records: DataFrame, dims: DataFrame, cell: str, order: str = "row_index") -> DataFrame:
    """(order, item_id), one row for each distinct item of a record."""
    pairs = records.select(F.col(order), F.explode(F.array_distinct(F.transform(X.split_items(F.col(cell)), lambda x: F.lower(x)))).alias("item_key"))
    return pairs.join(dims.select("item_key", "item_id"), "item_key").select(order, "item_id")


def review(records: DataFrame, key: str, required: list[str], cell: str, pattern: str, order: str = "row_index") -> DataFrame:
    """(order, issue): repeated keys, missing fields, keys off the pattern, empty lists and items listed twice."""
    w = Window.partitionBy(key).orderBy(order)
    later = records.where(f"trim({key}) <> ''").select(order, key, F.row_number().over(w).alias("n")).where("n > 1")
    found = [later.select(order, F.lit("duplicate_key").alias("issue"))]
    found += [records.where(F.col(c).isNull() | (F.trim(c) == "")).select(order, F.lit(f"missing_{c}").alias("issue")) for c in required]
    found.append(records.where((F.trim(key) != "") & ~F.col(key).rlike(pattern)).select(order, F.lit("pattern").alias("issue")))
    size = F.size(X.distinct_items(F.col(cell))["items"])
    found.append(records.where(F.col(cell).isNull() | (size == 0)).select(order, F.lit("empty_list").alias("issue")))
    found.append(records.where(F.size(X.distinct_items(F.col(cell))["repeats"]) > 0).select(order, F.lit("repeated_item").alias("issue")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def qualification_tables(records: DataFrame, key: str = "saqa_id", title: str = "title", level: str = "nqf", funded: str = "nsfas", cell: str = "colleges", order: str = "row_index") -> dict[str, DataFrame]:
    """qualifications, colleges, qualification_colleges, centres and review of a list of qualifications.

    Keys off the pattern of four to seven digits, repeated keys, empty lists and items listed twice go
    to review; colleges are numbered by first appearance, and variant marks names that are short or
    hold no word for a college. centres has the rows that name a centre of specialisation.
    """
    number = F.regexp_extract(title, r"(?i)qual(?:ification)?\s*(?:no|number|#)?\s*:?\s*([0-9]+)", 1)
    digits = F.regexp_extract(level, "[0-9]+", 0)
    in_range = digits.try_cast("bigint").between(1, 10)
    low = F.lower(F.trim(F.coalesce(funded, F.lit(""))))
    main = records.select(
        order, F.trim(F.coalesce(key, F.lit(""))).alias("saqa_id"), F.nullif(number, F.lit("")).alias("qualification_number"), X.collapse(F.col(title)).alias("qualification_name"),
        F.col(title).alias("qualification_name_raw"), F.when(in_range, digits.try_cast("int")).alias("nqf_level"), F.when(low.isin("yes", "y", "true", "1", "eligible"), "Eligible").otherwise("Not Eligible").alias("nsfas_allowance"))
    dims = dimension(records, cell, order, "COL", 3)
    known = F.col("item").rlike("(?i)college|tvet|campus|centre") & (F.length("item") >= 5)
    colleges = dims.select(F.col("item_id").alias("college_id"), F.col("item").alias("college_name"), (~known).alias("is_variant"))
    pairs = junction(records, dims, cell, order)
    centres = records.where(F.lower(title).rlike("dspp|centre of specialisation")).select(order, key, title, cell)
    return {"qualifications": main, "colleges": colleges, "qualification_colleges": pairs, "centres": centres, "review": review(records, key, [], cell, "^[0-9]{4,7}$", order)}
