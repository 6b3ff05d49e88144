"""Schemas: rules on column names, mapping of headers to columns, and readers of list-like grids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X


def has_any(c: Column, parts: list[str]) -> Column:
    return F.lower(c).rlike("|".join(re.escape(p) for p in parts))


def column_rules(columns: DataFrame, name: str = "name") -> DataFrame:
    """columns plus forced_string, required, role and authority, by parts of the column's name."""
    n = F.col(name)
    role = F.lit("general")
    for kind, parts in reversed(K.COLUMN_ROLES):
        role = F.when(has_any(n, parts), kind).otherwise(role)
    return columns.withColumns({
        "forced_string": has_any(n, K.FORCED_STRINGS), "required": has_any(n, K.REQUIRED_PARTS), "role": role, "authority": F.lit("SOURCE_FACT")})


def dataset_units(columns: DataFrame, dataset: str = "dataset_id", schema_name: str = "schema_name", name: str = "name", order: str = "position") -> DataFrame:
    """(dataset, unit): what a record of each dataset stands for, by its columns and schema name.

    Regions count only for datasets of at most five columns; without any sign the first column's name
    is the unit.
    """
    flags = {f"u{i}": F.max(has_any(F.col(name), parts) | (has_any(F.col(schema_name), more) if more else F.lit(False))) for i, (parts, more, _) in enumerate(K.DATASET_UNITS)}
    sums = columns.groupBy(dataset).agg(*[c.alias(k) for k, c in flags.items()], F.count("*").alias("n"), F.min_by(name, order).alias("first"))
    unit = F.initcap(F.regexp_replace("first", "_", " "))
    for i, (_, more, label) in reversed(list(enumerate(K.DATASET_UNITS))):
        small = F.col("n") <= 5 if more is None else F.lit(True)
        unit = F.when(F.col(f"u{i}") & small, label).otherwise(unit)
    return sums.select(dataset, unit.alias("unit"))


def match_headers(headers: list[str], aliases: list[tuple[str, list[str]]]) -> dict[str, int]:
    """Field to header index: for each field in order the first unused header that contains an alias."""
    found: dict[str, int] = {}
    for field, words in aliases:
        for i, h in enumerate(headers):
            if i not in found.values() and any(w in h.lower() for w in words):
                found[field] = i
                break
    return found


def map_columns(headers: list[str], columns: list[str]) -> dict[str, int]:
    """Column to cell index for the rows of a table: equal or prefixing names, header families, then what is left in order.

    With fewer than two matches cells go to columns by position. A table is planned once, from its
    headers alone, and its rows become one select.
    """
    found: dict[str, int] = {}
    for i, header in enumerate(headers):
        h = (header or "").strip()
        if not h:
            continue
        snake, low = re.sub(r"[^a-z0-9]+", "_", h.lower()).strip("_"), h.lower()
        free = [c for c in columns if c not in found]
        own = [c for c in free if snake == c or snake.startswith(c) or c.startswith(snake)]
        if not own:
            family = next((f for f in K.HEADER_FAMILIES if any(p in low for p in f[0]) and not any(p in low for p in f[1])), None)
            own = [c for c in free if family and any(p in c for p in family[2]) and not any(p in c for p in family[3])]
        if own:
            found[own[0]] = i
    if len(found) < 2:
        return {c: i for i, c in enumerate(columns)}
    rest = [i for i in range(max(len(headers), len(columns))) if i not in found.values()]
    return found | dict(zip([c for c in columns if c not in found], rest))


def mapped_rows(rows: DataFrame, mapping: dict[str, int], cells: str = "cells") -> DataFrame:
    """rows with a column for each mapped cell; cells that a row lacks are empty."""
    return rows.select(*[c for c in rows.columns if c != cells], *[F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(c) for c, i in mapping.items()])


def listed(rows: DataFrame, table: str, order: str, key: str, is_key: str, joined: dict[str, str], defaults: dict[str, str]) -> DataFrame:
    """Records of a list whose long cells run on over rows: a row with a key starts a record, others continue it.

    is_key is a pattern of the key cell. Of continuing rows the columns in joined are appended with
    their separators; rows before the first key of a table are dropped. Empty cells take defaults.
    """
    starts = F.col(key).rlike(is_key)
    w = Window.partitionBy(table).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grouped = rows.withColumn("__n", F.sum(starts.cast("int")).over(w)).where("__n > 0")
    others = [c for c in rows.columns if c not in (table, order)]

    def text(c: str) -> Column:
        first = F.max_by(c, F.when(starts, 1).otherwise(0))
        if c in joined:
            parts = F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct(order, c)))), lambda x: x[c])
            return F.array_join(parts, joined[c])
        return F.when(first == "", defaults[c]).otherwise(first) if c in defaults else first

    return grouped.groupBy(table, "__n").agg(F.min(order).alias(order), *[text(c).alias(c) for c in others]).drop("__n")


def qualification_list(rows: DataFrame, headers: list[str], table: str = "table_id", order: str = "row_index", cells: str = "cells") -> DataFrame:
    """(table, order, the fields of a qualification list) from grid rows with an array of cells."""
    found = match_headers(headers, K.QUALIFICATION_ALIASES)
    fields = [f for f, _ in K.QUALIFICATION_ALIASES]
    at = found if found else dict(zip(fields, range(6)))
    named = mapped_rows(rows.select(table, order, cells), {f: at.get(f, len(headers) + 9) for f in fields})
    tidy = F.regexp_replace(F.regexp_replace("participating_colleges", "[\r\n•·]+", "; "), r"\s*;\s*", "; ")
    named = named.withColumn("participating_colleges", F.trim(tidy))
    return listed(named, table, order, "saqa_id", "[0-9]{4,7}", {"qualification": " ", "participating_colleges": "; "}, {"nsfas_eligible": "No"})


def occupation_list(rows: DataFrame, headers: list[str], table: str = "table_id", order: str = "row_index", cells: str = "cells") -> DataFrame:
    """(table, order, the fields of an occupation list) from grid rows; only titles run on over rows."""
    found = match_headers(headers, K.OCCUPATION_ALIASES)
    fields = [f for f, _ in K.OCCUPATION_ALIASES]
    at = found if found else dict(zip(fields, range(6)))
    named = mapped_rows(rows.select(table, order, cells), {f: at.get(f, len(headers) + 9) for f in fields})
    return listed(named, table, order, "ofo_code", "^[0-9]{4,6}$", {"occupation_title": " "}, {"demand_rank": "1", "province": "National"})


def codebook_lines(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """(page, line, variable, label, value, value_label) from codebook text with cells apart by | or tabs.

    Lines of four cells and more start a variable; lines of two and more whose first cell is a number
    are further values of the last one.
    """
    cells = F.filter(F.transform(F.split("l", r"\||\t"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    lines = pages.select(F.col(page).alias("page"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "l")).withColumn("c", cells)
    w = Window.partitionBy("page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    full = F.size("c") >= 4
    lines = lines.withColumns({"variable": F.last(F.when(full, F.get("c", F.lit(0))), True).over(w), "label": F.last(F.when(full, F.get("c", F.lit(1))), True).over(w), "full": full})
    value = lines.where("full or (size(c) >= 2 and variable is not null and c[0] rlike '^[0-9]+$')")
    return value.select("page", "line", "variable", "label", *[F.when(F.col("full"), F.get("c", F.lit(i + 2))).otherwise(F.get("c", F.lit(i))).alias(n) for i, n in enumerate(("value", "value_label"))])


def id_column(headers: Column) -> Column:
    """The place of a table's id column: the first header with a word for one, else 0."""
    at = F.array_position(F.transform(headers, lambda h: F.lower(F.trim(h)).rlike(r"\b(saqa|ofo|code|id|number|no\.?)\b")), True)
    return F.greatest(at - 1, F.lit(0))


def header_overlap(row: Column, headers: Column) -> Column:
    """Whether half of the headers or more stand in a row again, either text holding the other."""
    def clean(a):
        return F.filter(F.transform(a, lambda x: F.lower(X.collapse(x))), lambda x: x != "")

    r, h = clean(row), clean(headers)
    hits = F.size(F.filter(r, lambda c: F.exists(h, lambda x: x.contains(c) | c.contains(x))))
    return (F.size(r) > 0) & (F.size(h) > 0) & (hits * 2 >= F.size(h))


def rebuilt_grid(rows: DataFrame, headers: list[str], table: str = "table_id", order: str = "row_index", cells: str = "cells") -> DataFrame:
    """rows without repeated headers, footnotes and blank rows, cleaned, with new_index, confidence and shaded.

    shaded says that a table has more than ten rows and an empty first cell in 35 of 100 or more, so
    that its text lines are to be read instead.
    """
    from .discovery import is_footnote

    clean = F.transform(cells, lambda c: X.collapse(F.coalesce(c, F.lit(""))))
    first = F.trim(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))
    w = Window.partitionBy(table)
    marked = rows.withColumn("shaded", (F.count("*").over(w) > 10) & (F.sum(F.lower(first).isin("", "none").cast("int")).over(w) * 100 >= F.count("*").over(w) * 35))
    kept = marked.where(~header_overlap(F.col(cells), F.array(*[F.lit(h) for h in headers])) & ~is_footnote(F.col(cells))).withColumn(cells, clean)
    kept = kept.where(F.exists(cells, lambda c: c != ""))
    return kept.withColumn("new_index", F.row_number().over(w.orderBy(order))).withColumn("confidence", F.lit(0.92))


def merged_cells(before: Column, after: Column, separator: str = " ") -> Column:
    """Two rows as one, cell by cell, the shorter one filled up with nothing."""
    return F.zip_with(before, after, lambda a, b: F.array_join(F.filter(F.array(F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))), lambda x: x != ""), separator))


def title_of(record: dict[str, Column] | list[Column]) -> Column:
    """The first of several title columns that is not empty."""
    columns = list(record.values()) if isinstance(record, dict) else record
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns], F.lit(""))
