"""Grids of many tables as data: each table finds its own header, and its cells go to fields by what the header says.

Nothing about a table is planned on the driver, so tables of any number and any layout go through one
plan. Positions of fields in a table are an array<int>, -1 for a field that the table lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from .schema import id_column
from .structure import running_count

#: Rows at the top of a table among which its header is looked for, and the fields it must name.
SEARCH, LEAST = 3, 2



def tidy(cells: Column) -> Column:
    """Cells trimmed, nulls as empty texts."""
    return F.transform(cells, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))


def places(cells: Column, aliases: list[tuple[str, list[str]]]) -> Column:
    """For each field in order the first cell that holds one of its aliases and that no earlier field took."""
    fields = F.array(*[F.array(*[F.lit(w) for w in words]) for _, words in aliases])
    low = F.transform(cells, lambda c: F.lower(c))

    def step(found: Column, words: Column) -> Column:
        free = F.transform(low, lambda c, i: ~F.array_contains(found, i) & F.exists(words, lambda w: F.contains(c, w)))
        return F.array_append(found, (F.array_position(free, True) - 1).cast("int"))

    return F.aggregate(fields, F.array().cast("array<int>"), step)


def table_headers(rows: DataFrame, aliases: list[tuple[str, list[str]]], table: str = "table_id", order: str = "row_index", cells: str = "cells") -> DataFrame:
    """(table, header_row, at): the first of each table's top rows that names LEAST fields or more.

    order counts a table's rows from 0. Tables without such a row do not appear.
    """
    top = rows.where(F.col(order).between(0, SEARCH - 1)).select(table, order, places(tidy(F.col(cells)), aliases).alias("at"))
    named = top.where(F.size(F.filter("at", lambda i: i >= 0)) >= LEAST)
    return named.groupBy(table).agg(F.min(order).alias("header_row"), F.min_by("at", order).alias("at"))


def named_fields(rows: DataFrame, aliases: list[tuple[str, list[str]]], needed: list[str], least_cells: int, defaults: dict[str, str], skip: list[str], table: str = "table_id", order: str = "row_index", cells: str = "cells") -> DataFrame:
    """(table, order, header_row, a column for each field) of every row below its table's header.

    A header that names all needed fields places the cells; in other tables they go by position,
    if a row has least_cells or more, else all fields are empty. A field whose cell does not
    exist takes its default. Blank rows, and rows whose first cell holds a text of skip, are left out.
    """
    heads = table_headers(rows, aliases, table, order, cells)
    fields = [f for f, _ in aliases]
    body = rows.select(table, order, tidy(F.col(cells)).alias("__c")).join(heads, table, "left")
    body = body.where("header_row is null or " + order + " > header_row").where(F.exists("__c", lambda c: c != ""))
    first = F.lower(F.get("__c", F.lit(0)))
    for word in skip:
        body = body.where(~F.contains(first, F.lit(word)))
    named = F.coalesce(*[F.lit(True)] if not needed else [F.forall(F.array(*[F.get("at", F.lit(fields.index(n))) for n in needed]), lambda i: i >= 0)], F.lit(False))
    out = {}
    for n, f in enumerate(fields):
        default = F.lit(defaults.get(f, ""))
        own = F.get("at", F.lit(n))
        by_name = F.when(own >= 0, F.coalesce(F.get("__c", own), default)).otherwise(default)
        by_place = F.when(F.size("__c") >= least_cells, F.coalesce(F.get("__c", F.lit(n)), default)).otherwise(default)
        out[f] = F.when(named, by_name).otherwise(by_place)
    return body.select(table, order, "header_row", *[c.alias(f) for f, c in out.items()])


def list_records(rows: DataFrame, starts: Column, continues: Column, joined: dict[str, str], table: str = "table_id", order: str = "row_index") -> DataFrame:
    """One row for each row that starts a record, with the joined columns of the rows that continue it.

    Rows that do neither, and rows before a table's first record, are left out. A continuing text is
    put after the separator, and what results loses the separator's characters at its ends.
    """
    marked = rows.select("*", starts.alias("__start")).where(F.col("__start") | continues)
    counted = running_count(marked, [table], order, F.col("__start"), "__n").where("__n > 0")
    first = counted.where("__start").drop("__start")
    more = counted.where("not __start").groupBy(table, "__n").agg(F.array_sort(F.collect_list(F.struct(order, *joined))).alias("__more"))

    def text(c: str, separator: str) -> Column:
        def step(held: Column, x: Column) -> Column:
            return F.when(x == "", held).otherwise(F.btrim(F.concat(held, F.lit(separator), x), F.lit(separator)))

        return F.aggregate(F.transform("__more", lambda r: r[c]), F.col(c), step)

    both = first.join(more, [table, "__n"], "left").withColumns({c: F.when(F.col("__more").isNull(), F.col(c)).otherwise(text(c, s)) for c, s in joined.items()})
    return both.drop("__n", "__more")


def qualifications(rows: DataFrame, table: str = "table_id", order: str = "row_index", cells: str = "cells") -> DataFrame:
    """The records of qualification lists in grids of any layout, with the confidence of this reader.

    A record starts at an id of four to seven digits; rows with fewer than three digits there continue it.
    """
    named = named_fields(rows, K.QUALIFICATION_ALIASES, ["saqa_id", "qualification"], 4, {"nsfas_eligible": "No"}, K.QUALIFICATION_HEADER_WORDS, table, order, cells)
    bullets = F.regexp_replace(F.trim(F.regexp_replace("participating_colleges", "[\r\n•·]+", "; ")), r"\s*;\s*", "; ")
    named = named.withColumn("participating_colleges", bullets)
    found = list_records(named, F.col("saqa_id").rlike("[0-9]{4,7}"), ~F.col("saqa_id").rlike("[0-9]{3,}"), {"qualification": " ", "participating_colleges": "; "}, table, order)
    return found.withColumn("confidence", F.lit(0.96))


def occupations(rows: DataFrame, table: str = "table_id", order: str = "row_index", cells: str = "cells") -> DataFrame:
    """The records of occupation lists in grids of any layout, with the confidence of this reader.

    A record starts at a code of four to six digits; rows without a code but with a title continue it.
    """
    named = named_fields(rows, K.OCCUPATION_ALIASES, ["ofo_code", "occupation_title"], 3, {"demand_rank": "1", "province": "National"}, K.OCCUPATION_HEADER_WORDS, table, order, cells)
    found = list_records(named, F.col("ofo_code").rlike("^[0-9]{4,6}$"), (F.col("ofo_code") == "") & (F.col("occupation_title") != ""), {"occupation_title": " "}, table, order)
    return found.withColumn("confidence", F.lit(0.94))


# ---- any table under a dataset's columns -------------------------------------------------------


def column_places(headers: Column, columns: Column) -> Column:
    """For each column of a dataset the cell that a table's headers give it.

    Headers take columns in turn: the first free one that is equal to the header or that one of them
    begins with the other, else the first free one of the header's family. With fewer than
    two matches cells go by position.
    """
    def family(low: Column, pick) -> Column:
        # the first family that the header belongs to decides, even if no column of it is free
        out = F.lit(None)
        for parts, but, own, own_but in reversed(K.HEADER_FAMILIES):
            here = _any(low, parts) & ~_any(low, but)
            out = F.when(here, pick(own, own_but)).otherwise(out)
        return out

    def place(found: Column, head: Column, snake: Column, low: Column) -> Column:
        def first(test) -> Column:
            hits = F.transform(columns, lambda c, k: (F.get(found, k) < 0) & test(c))
            return F.nullif(F.array_position(hits, True), F.lit(0))

        alike = first(lambda c: (c == snake) | F.startswith(snake, c) | F.startswith(c, snake))
        kin = family(low, lambda own, but: first(lambda c: _any(c, own) & ~_any(c, but)))
        return F.when(head != "", F.coalesce(alike, kin)) - 1

    def step(found: Column, head: Column) -> Column:
        # the header's own number is that of headers seen so far, kept as the last element
        seen = F.get(found, F.size(columns))
        at = X.bound(F.struct(X.snake_case(head).alias("snake"), F.lower(head).alias("low")), lambda h: place(found, head, h["snake"], h["low"]))
        return X.bound(at, lambda a: F.transform(found, lambda x, k: F.when(k == a, seen).when(k == F.size(columns), seen + 1).otherwise(x)))

    start = F.array_append(F.transform(columns, lambda c: F.lit(-1)), F.lit(0))
    named = F.slice(F.aggregate(tidy(headers), start, step), 1, F.size(columns))
    return X.bound(named, lambda at: F.when(F.size(F.filter(at, lambda i: i >= 0)) >= 2, at).otherwise(F.transform(columns, lambda c, k: k)))


def _any(c: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(c, F.lit(p))
    return hit


def record(columns: Column, at: Column, cells: Column) -> Column:
    """map(column, cell) of a row; columns without a header take the cells without one in order, and are empty beyond the row's end."""
    def values(own: Column) -> Column:
        def value(c: Column, k: Column) -> Column:
            lacking = F.size(F.filter(F.slice(at, 1, k), lambda y: y < 0))
            return F.coalesce(F.get(own["cells"], F.when(F.get(at, k) >= 0, F.get(at, k)).otherwise(F.get(own["spare"], lacking))), F.lit(""))

        return F.transform(columns, value)

    def spare(c: Column) -> Column:
        return F.filter(F.transform(c, lambda x, i: F.when(~F.array_contains(at, i), i).otherwise(F.lit(-1))), lambda i: i >= 0)

    return F.map_from_arrays(columns, X.bound(cells, lambda c: X.bound(F.struct(c.alias("cells"), spare(c).alias("spare")), values)))


PLACE = ["page", "table_index"]


def document_records(heads: DataFrame, rows: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, record_no, record, page, table_index, row_index, n_rows): the rows of all tables of a document under the first table's columns.

    heads has (doc, page, table_index, headers), rows the same place with row_index and cells. Rows
    that repeat the first table's header go. A row whose id cell is empty continues the row before it, over
    the ends of tables and pages: each cell fills an empty one, is left out if it is there already, and is
    else put after "; " where either text has a semicolon or the header names an institution, or after a
    space. A record's place is that of its first row.
    """
    first = heads.groupBy(doc).agg(F.min_by("headers", F.struct(*PLACE)).alias("first"))
    first = first.withColumn("first", tidy(F.col("first")))

    def unique(names: Column) -> Column:
        # repeated names get a number, as a dataset's columns must differ
        return F.transform(names, lambda n, k: F.when(F.size(F.filter(F.slice(names, 1, k), lambda m: m == n)) == 0, n).otherwise(
            F.concat(n, F.lit("_"), (F.size(F.filter(F.slice(names, 1, k), lambda m: m == n)) + 1).cast("string"))))

    names = F.transform("first", lambda h: X.snake_case(h))
    known = heads.join(first.withColumn("columns", X.bound(names, unique)).hint("merge"), doc)
    low = F.transform(tidy(F.col("headers")), lambda h: F.lower(h))
    known = known.select(
        doc, *PLACE, "columns", F.filter(F.transform("first", lambda h: F.lower(h)), lambda h: h != "").alias("canon"), column_places(F.col("headers"), F.col("columns")).alias("at"),
        id_column(F.col("headers")).cast("int").alias("id_at"), F.transform(low, lambda h: _any(h, K.INSTITUTION_PARTS)).alias("lists"))
    # texts made from small columns look small enough to broadcast
    body = rows.select(doc, *PLACE, "row_index", tidy(F.col("cells")).alias("c")).join(known.hint("merge"), [doc, *PLACE])
    again = X.bound(F.transform("c", lambda x: F.lower(x)), lambda low_cells: F.size(F.filter("canon", lambda h: F.array_contains(low_cells, h)))) >= 2
    # one condition of both sides, which is tested once for each row, where the join has it
    body = body.where(F.when((F.size("canon") >= 2) & (F.size("c") >= 2) & again, F.lit(False)).otherwise(F.exists("c", lambda x: x != "")))
    blank_id = F.coalesce(F.get("c", F.col("id_at")), F.lit("")) == ""
    body = body.withColumn("__place", F.struct(*PLACE, "row_index"))
    body = running_count(body, [doc], "__place", ~blank_id, "record_no", F.col("page"), first=True)
    packed = body.groupBy(doc, "record_no").agg(F.array_sort(F.collect_list(F.struct(*PLACE, "row_index", "c", "lists"))).alias("__rows"), F.min_by(F.struct("columns", "at"), "__place").alias("__map"))

    def merged(held: Column, r: Column) -> Column:
        def cell(i: Column) -> Column:
            a, b = F.coalesce(F.get(held, i), F.lit("")), F.coalesce(F.get(r["c"], i), F.lit(""))
            listed = F.contains(a, F.lit(";")) | F.contains(b, F.lit(";")) | F.coalesce(F.get(r["lists"], i), F.lit(False))
            joint = F.when(listed, F.btrim(F.concat(a, F.lit("; "), b), F.lit("; "))).otherwise(F.concat(a, F.lit(" "), b))
            return F.when(b == "", a).when(a == "", b).when(F.contains(F.lower(a), F.lower(b)), a).otherwise(joint)

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(held), F.size(r["c"])) - 1), cell)

    head = F.get("__rows", F.lit(0))
    whole = F.aggregate(F.slice("__rows", F.lit(2), F.size("__rows")), head["c"], merged)
    out = packed.select(doc, F.col("record_no").cast("bigint"), record(F.col("__map.columns"), F.col("__map.at"), whole).alias("record"), head.alias("h"), F.size("__rows").alias("n_rows"))
    return out.select(doc, "record_no", "record", *[F.col(f"h.{c}").alias(c) for c in (*PLACE, "row_index")], "n_rows")
