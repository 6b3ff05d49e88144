"""Order-sensitive table and document operators: filling, stitching, sections and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_forward(df: DataFrame, column: str, keys: list[str], order: list[str]) -> DataFrame:
    """Blank cells take the last value above them within their table."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(F.when(F.trim(column) != "", F.col(column)), ignorenulls=True).over(w))


def stitch(rows: DataFrame, id_col: str, columns: list[str], keys: list[str], order: list[str], lists: list[str] = ()) -> DataFrame:
    """Continuation rows (blank id_col, other text) merged into the row above, across tables and pages.

    Each cell fills an empty one, is skipped if contained in what is there, and is otherwise joined
    by "; " in list columns or where either text has a semicolon, else by a space.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    cells = rows.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in [id_col, *columns]})
    filled = cells.where(" or ".join(f"{c} <> ''" for c in [id_col, *columns]))
    start = (F.col(id_col) != "") | (F.row_number().over(w) == 1)
    marked = filled.withColumn("__start", start.cast("int"))
    marked = marked.withColumn("__island", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    packed = marked.groupBy(*keys, "__island").agg(F.array_sort(F.collect_list(F.struct(*order, id_col, *columns))).alias("__rows"))

    def merged(c):
        def step(held, cell):
            joint = F.when(F.lit(c in lists) | F.contains(held, F.lit(";")) | F.contains(cell, F.lit(";")), F.concat(held, F.lit("; "), cell)).otherwise(F.concat(held, F.lit(" "), cell))
            return F.when(cell == "", held).when(held == "", cell).when(F.contains(F.lower(held), F.lower(cell)), held).otherwise(joint)

        return F.aggregate(F.transform("__rows", lambda r: r[c]), F.lit(""), step)

    return packed.select(*keys, F.col("__island").cast("bigint").alias("record"), *[merged(c).alias(c) for c in [id_col, *columns]])


def running_count(rows: DataFrame, keys: list[str], order: str, flag: Column, name: str, block: Column | None = None, size: int = 65_536, first: bool = False) -> DataFrame:
    """rows plus name: how many rows of its group up to and with each have the flag; with first, a group's first row counts in any case.

    Rows are counted in blocks, which follow the order, and moved on by what the blocks before hold, so a group of
    any size is spread over tasks. A block is `size` values of a whole-numbered order unless given.
    """
    block = F.floor(F.col(order) / size) if block is None else block
    marked = rows.withColumns({"__block": block, "__flag": flag.cast("bigint")})
    sums = marked.groupBy(*keys, "__block").agg(F.sum("__flag").alias("__sum"), F.min_by("__flag", order).alias("__first"))
    blocks = Window.partitionBy(*keys).orderBy("__block")
    extra = 1 - F.coalesce(F.first("__first").over(blocks), F.lit(0)) if first else F.lit(0)
    base = sums.select(*keys, "__block", (F.coalesce(F.sum("__sum").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + extra).alias("__base"))
    within = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("__within", F.sum("__flag").over(within)).join(base, [*keys, "__block"])
    return counted.withColumn(name, F.col("__base") + F.col("__within")).drop("__block", "__flag", "__within", "__base")


def with_previous(rows: DataFrame, keys: list[str], order: str, columns: list[str], block: Column) -> DataFrame:
    """rows plus previous, a struct of columns of the row before in the group, NULL for the first.

    Rows are looked up in blocks, which follow the order, and the first of a block takes the last row of the
    block before it.
    """
    here = F.struct(*columns)
    marked = rows.withColumn("__block", block)
    last = marked.groupBy(*keys, "__block").agg(F.max_by(here, order).alias("__last"))
    before = last.select(*keys, "__block", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__block")).alias("__before"))
    within = F.lag(here).over(Window.partitionBy(*keys, "__block").orderBy(order))
    return marked.withColumn("__within", within).join(before, [*keys, "__block"]).withColumn("previous", F.coalesce("__within", "__before")).drop("__block", "__within", "__before")


def section_spans(headings: DataFrame, keys: list[str], page: str, order: list[str], last_page: str) -> DataFrame:
    """Adds page_end: one before the next heading's page, not before the own page, and last_page at the end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return headings.withColumn("page_end", F.greatest(F.col(page), F.coalesce(F.lead(page).over(w) - 1, F.col(last_page))))


def pages_in_sections(sections: DataFrame, keys: list[str], start: str, end: str, level: str, order: str) -> DataFrame:
    """(keys, page, section): for every page, the deepest section that covers it, the first on ties."""
    pages = sections.select(*keys, level, F.col(order).alias("section"), F.explode(F.sequence(start, end)).alias("page"))
    best = pages.groupBy(*keys, "page").agg(F.max(F.struct(level, -F.col("section"))).alias("b"))
    return best.select(*keys, "page", (-F.col("b.col2")).alias("section"))


def sessions(rows: DataFrame, keys: list[str], order: list[str], breaks) -> DataFrame:
    """Adds group_no, which grows where breaks(window) holds between a row and the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__new", F.coalesce(breaks(w), F.lit(False)).cast("int")).withColumn(
        "group_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__new")


def infer_types(cells: DataFrame, name: str, value: str) -> DataFrame:
    """(name, n, type): the type that 85 % of a column's non-blank cells have."""
    v = F.lower(F.trim(value))
    whole = v.rlike("^-?(0|[1-9][0-9]*)$")
    df = cells.where(v != "").groupBy(name).agg(
        F.count("*").alias("n"), F.count_if(v.isin("yes", "no", "true", "false", "y", "n")).alias("b"), F.count_if(whole).alias("i"),
        F.count_if(v.rlike(r"^-?[0-9]+\.[0-9]+$")).alias("f"))
    kind = F.when(F.col("b") * 100 >= F.col("n") * 85, "boolean").when(F.col("i") * 100 >= F.col("n") * 85, "integer")
    return df.select(name, "n", kind.when((F.col("i") + F.col("f")) * 100 >= F.col("n") * 85, "float").otherwise("string").alias("type"))


def unique_names(headers: DataFrame, name: str, keys: list[str], order: str) -> DataFrame:
    """Adds unique_name: repeated names get _2, _3 and so on."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order))
    return headers.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string"))))
