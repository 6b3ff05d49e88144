"""Built-in schemas of datasets as data: looked up by name, read from grids of any layout, and checked by their own rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from . import tables, validation

FALLBACK = "universal_auto"


def chosen(name: Column) -> Column:
    """The blueprint of a name in any case; unknown and null names have the one without fields."""
    low = F.lower(name)
    return F.when(low.isin(list(K.BLUEPRINTS)), low).otherwise(FALLBACK)


def fields(spark: SparkSession) -> DataFrame:
    """(blueprint, position, field, type, required, primary_key): the fields of all blueprints."""
    rows = [(b, n, f[0], f[2], f[3], f[0] == key) for b, (_, _, key, own) in K.BLUEPRINTS.items() for n, f in enumerate(own)]
    return spark.createDataFrame(rows, "blueprint string, position int, field string, type string, required boolean, primary_key boolean")


def rules(spark: SparkSession, blueprint: str) -> DataFrame:
    """The rules of a blueprint's fields as rows for validation.issues_by_rules()."""
    made = []
    for f, _, kind, required, pattern, least, most, allowed in K.BLUEPRINTS[blueprint][3]:
        if required:
            made.append((f, "required", "error", True, None, None, None, None))
        if pattern:
            made.append((f, "pattern", "error", False, pattern, None, None, None))
        if least is not None or most is not None:
            made.append((f, "range", "error", False, None, least, most, None))
        if allowed:
            made.append((f, "allowed", "warning", False, None, None, None, allowed))
        if kind in ("integer", "currency"):
            made.append((f, kind, "warning", False, "[+-]?[0-9]+" if kind == "integer" else r"[^0-9+-]{0,4}[+-]?[0-9][0-9 ,]*(\.[0-9]+)?", None, None, None))
    return spark.createDataFrame(made, validation.RULES)


def read(rows: DataFrame, blueprint: str, table: str = "table_id", order: str = "row_index", cells: str = "cells") -> DataFrame:
    """(table, order, header_row, a column for each field): grid rows under a blueprint, each table by its own header.

    The primary key and a second field, or all fields where there are fewer, must be named for a header to place
    cells; other tables go by position. A blueprint without fields has only the first three columns.
    """
    aliases = [(f[0], f[1]) for f in K.BLUEPRINTS[blueprint][3]]
    if not aliases:
        return rows.select(table, order, F.lit(None).cast("bigint").alias("header_row"))
    key = K.BLUEPRINTS[blueprint][2]
    return tables.named_fields(rows, aliases, [key], min(3, len(aliases)), {}, [], table, order, cells)
