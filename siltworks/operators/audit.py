"""Ledgers, audits, overrides, review queue, search and lineage over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) for every field that differs."""
    a = before.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("a"))
    b = after.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("b"))
    changes = F.array(*[
        F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("old_value"), F.col(f"b.{f}").alias("new_value")))
        for f in fields])
    return a.join(b, key).select(key, F.inline(F.filter(changes, lambda c: c.isNotNull())))


def apply_overrides(records: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """records with column taken from overrides where they have the key; overridden says so."""
    new = overrides.select(key, F.col(column).alias("__new"))
    df = records.join(new, key, "left")
    return df.withColumns({column: F.coalesce("__new", column), "overridden": F.col("__new").isNotNull()}).drop("__new")


def search(records: DataFrame, needle: str, columns: list[str], order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of the records in which some column holds the text, whatever its case: search first, then page."""
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle.lower())), F.lit(False))
    return records.where(hit).orderBy(*order).offset(offset).limit(limit)


def newest(records: DataFrame, time: str, order: str, limit: int = 50, **where) -> DataFrame:
    """The newest rows first, at most limit (1 to 200) of them, with equal values in the columns of where; nulls come last."""
    found = records
    for column, value in where.items():
        found = found.where(F.col(column) == value)
    return found.orderBy(F.desc_nulls_last(time), F.desc(order)).limit(min(max(limit, 1), 200))


def review_queue(evaluated: DataFrame, flags: DataFrame, key: str = "row_index") -> DataFrame:
    """Records that need a person: REVIEW, invalid, or flagged as duplicates; rank orders by priority."""
    joined = evaluated.join(flags.select(key).distinct().withColumn("duplicate", F.lit(True)), key, "left").fillna(False, ["duplicate"])
    queue = joined.where("decision = 'REVIEW' or status = 'error' or duplicate")
    rank = F.when((F.col("priority") == "critical") | (F.col("status") == "error"), 0).when(F.col("priority") == "high", 1).otherwise(2)
    return queue.select(key, "decision", "reason_code", "status", "duplicate", rank.alias("rank"))


def lineage(evaluated: DataFrame, source: str, key: str = "row_index") -> DataFrame:
    """(key, step, stage, outcome): the ordered steps a record went through."""
    outcomes = {
        "extracted": F.lit(source), "normalised": F.lit("done"), "validated": F.col("status"),
        "classified": F.coalesce("unit_code", "major_code", F.lit("none")), "decided": F.col("decision"),
    }
    steps = F.array(*[F.struct(F.lit(k).alias("stage"), v.alias("outcome")) for k, v in outcomes.items()])
    return evaluated.select(key, F.posexplode(steps).alias("pos", "s")).select(key, (F.col("pos") + 1).alias("step"), F.col("s.stage").alias("stage"), F.col("s.outcome").alias("outcome"))


def column_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, distinct_values, total) in one pass over the table."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("v")) for c in columns])).alias("x")).select("x.*")
    return cells.groupBy("column").agg(F.count("v").alias("filled"), F.count_distinct("v").alias("distinct_values"), F.count("*").alias("total"))


def coverage(records: DataFrame, columns: dict[str, str | None], dataset: str = "dataset_id") -> DataFrame:
    """(dataset, column, total, filled, changed, sketch) of columns, each with the column of its raw text or None.

    sketch holds the distinct filled values in bounded space, so that coverages of parts can be kept and
    merged; changed counts filled values that differ from the raw text.
    """
    def cell(c: str, raw: str | None) -> Column:
        value = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        changed = F.lit(False) if raw is None else value.isNotNull() & ~F.col(c).cast("string").eqNullSafe(F.col(raw).cast("string"))
        return F.struct(F.lit(c).alias("column"), value.alias("v"), changed.alias("changed"))

    cells = records.select(dataset, F.explode(F.array(*[cell(c, r) for c, r in columns.items()])).alias("x")).select(dataset, "x.*")
    return cells.groupBy(dataset, "column").agg(F.count("*").alias("total"), F.count("v").alias("filled"), F.count_if("changed").alias("changed"), F.hll_sketch_agg("v").alias("sketch"))


def merged_coverage(parts: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """The coverage of all records from coverages of disjoint parts; the same whatever the parts."""
    return parts.groupBy(dataset, "column").agg(*[F.sum(c).alias(c) for c in ("total", "filled", "changed")], F.hll_union_agg("sketch").alias("sketch"))


def coverage_report(covered: DataFrame) -> DataFrame:
    """covered with coverage_pct (one digit) and distinct_estimate in place of the sketch.

    A sketch that was never merged is estimated by the order in which values came; a union with itself
    changes no register and makes the estimate one of the registers alone, the same whatever the parts.
    """
    share = F.round(F.col("filled").cast("decimal(18,0)") * 100 / F.col("total").cast("decimal(18,0)"), 1).cast("decimal(5,1)")
    return covered.withColumns({"coverage_pct": F.when(F.col("total") > 0, share), "distinct_estimate": F.hll_sketch_estimate(F.hll_union("sketch", "sketch"))}).drop("sketch")


def export_flat(evaluated: DataFrame, fields: list[str]) -> DataFrame:
    """Record fields with provenance and curation columns; no record that was not decided shows certainty."""
    sure = F.when((F.lower("decision") == "unprocessed") & ((F.col("overall_confidence") == 1) | F.col("overall_confidence").isNull()), None).otherwise(F.col("overall_confidence"))
    return evaluated.select(
        "row_index", *fields, F.col("dataset_id").alias("_prov_dataset"), F.coalesce("status", F.lit("valid")).alias("_prov_status"),
        F.col("decision").alias("_curation_decision"), sure.alias("_curation_confidence"), F.array_join("all_chambers", "; ").alias("_derived_chambers"))


#: Columns of an export beside the record's own, with what stands where a record lacks one.
PROVENANCE = {"_prov_doc": "", "_prov_page": None, "_prov_table": "", "_prov_section": "", "_prov_confidence": 0.85, "_prov_status": "valid"}


def export_full(evaluated: DataFrame, fields: list[str], provenance: dict[str, Column], key: str = "row_index") -> DataFrame:
    """export_flat with all provenance and curation columns.

    provenance has columns for some of PROVENANCE; a null or missing one takes the default there. A record that was not
    decided is unprocessed, and shows no certainty of 1.
    """
    unknown = set(provenance) - set(PROVENANCE)
    if unknown:
        raise ValueError(f"no provenance columns {sorted(unknown)}; known are {', '.join(PROVENANCE)}")
    decision = F.coalesce("decision", F.lit("unprocessed"))
    sure = F.when((F.lower(decision) == "unprocessed") & ((F.col("curation_confidence") == 1) | F.col("curation_confidence").isNull()), None).otherwise(F.col("curation_confidence"))
    given = [(F.coalesce(provenance[n], F.lit(d)) if n in provenance else F.lit(d)).alias(n) for n, d in PROVENANCE.items()]
    return evaluated.select(
        key, *fields, *given, decision.alias("_curation_decision"), F.coalesce("reason_code", F.lit("")).alias("_curation_reason"), sure.alias("_curation_confidence"),
        F.array_join("all_chambers", "; ").alias("_derived_chambers"))
