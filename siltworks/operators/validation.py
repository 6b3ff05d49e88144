"""Field rules over records: issues, statuses and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def _issue(bad: Column, column: str, rule: str, severity: str) -> Column:
    return F.when(bad, F.struct(F.lit(column).alias("column"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))


def rules_for(column: str, required: bool = False, kind: str = "string") -> list[Column]:
    """The issues that a column can have; a missing required value stops its other rules."""
    c, name = F.trim(F.col(column).cast("string")), column.lower()
    missing = c.isNull() | (c == "")
    out = [_issue(missing, column, "required", "error")] if required else []
    if "saqa" in name:
        out.append(_issue(~missing & ~c.rlike("^[0-9]{4,7}$"), column, "saqa_id", "error"))
    if "ofo" in name or name == "code":
        out.append(_issue(~missing & ~c.rlike("^(20[0-9]{2}-)?[0-9]{4,6}$"), column, "ofo_code", "error"))
    if "nqf" in name and not any(k in name for k in ("sub", "framework", "type", "desc")):
        n = F.regexp_extract(c, "([0-9]+)", 1)
        out.append(_issue(~missing & (n != "") & ~n.try_cast("bigint").between(1, 10), column, "nqf_range", "error"))
        out.append(_issue(~missing & (n == ""), column, "nqf_format", "warning"))
    if "province" in name:
        out.append(_issue(~missing & ~c.isin(sorted(set(K.PROVINCES.values()))), column, "province", "warning"))
    if "year" in name:
        out.append(_issue(~missing & ~c.rlike("^(19|20)[0-9]{2}$"), column, "year", "warning"))
    if kind == "integer":
        out.append(_issue(~missing & ~c.rlike("^[+-]?[0-9]+$"), column, "integer", "warning"))
    if kind == "float":
        out.append(_issue(~missing & c.try_cast("double").isNull(), column, "float", "warning"))
    return out


def validate(records: DataFrame, schema: list[tuple[str, bool, str]]) -> DataFrame:
    """Adds issues (array of struct, in column order), status and validation_confidence; schema lists (column, required, kind)."""
    issues = F.filter(F.array(*[i for c, required, kind in schema for i in rules_for(c, required, kind)]), lambda i: i.isNotNull())
    df = records.withColumn("issues", issues)

    def some(severity: str) -> Column:
        return F.exists("issues", lambda i: i["severity"] == severity)

    error, warning = some("error"), some("warning")
    status = F.when(error, "error").when(warning, "warning").otherwise("valid")
    confidence = F.when(error, "0.50").when(warning, "0.85").otherwise("1.00").cast("decimal(4,2)")
    return df.withColumns({"status": status, "validation_confidence": confidence})


#: Rules as rows; a null part checks nothing.
RULES = "column string, rule string, severity string, required boolean, pattern string, min double, max double, allowed array<string>"
#: Rules of at most this number are broadcast.
BROADCAST_RULES = 100_000


def issues_by_rules(records: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, column, rule, severity, value): what breaks the rules of a table with the columns of RULES.

    Blank values break only required. A value must match the whole pattern, be a number from min to
    max (a text that is no number breaks either), and be one of allowed. Rules of columns that
    records lack are left out, and a column may have any number of rules.
    """
    columns = [c for c in records.columns if c != key]
    cells = records.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("c")).select(key, "c.*")
    few = rules.count() <= BROADCAST_RULES
    both = cells.join(F.broadcast(rules) if few else rules, "column")
    text = F.trim(F.coalesce("value", F.lit("")))
    blank, number = text == "", text.try_cast("double")
    whole = F.rlike(text, F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$")))
    outside = (F.col("min").isNotNull() | F.col("max").isNotNull()) & (number.isNull() | F.isnan(number) | (number < F.col("min")) | (number > F.col("max")))
    bad = (blank & F.col("required")) | (~blank & (F.coalesce(~whole, F.lit(False)) | F.coalesce(outside, F.lit(False)) | F.coalesce(~F.array_contains("allowed", text), F.lit(False))))
    return both.where(F.coalesce(bad, F.lit(False))).select(key, "column", "rule", "severity", "value")


def issue_rows(validated: DataFrame, *keys: str) -> DataFrame:
    """One row for each issue, with the keys of its record."""
    return validated.select(*keys, F.inline("issues"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts by severity and column."""
    return issues.groupBy("severity", "column").agg(F.count("*").alias("n"))
