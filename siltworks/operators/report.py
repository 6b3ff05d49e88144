"""Explanations, suggestions and reports over evaluated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X


def suggested_decision(scored: DataFrame) -> DataFrame:
    """scored plus suggested, what the rules alone say."""
    case = (
        F.when(F.col("exclusion").isNotNull(), "EXCLUDE").when(F.col("ambiguous"), "REVIEW").when(F.col("score") >= F.col("include_at"), "INCLUDE")
        .when(F.col("score") < F.col("exclude_below"), "EXCLUDE").otherwise("REVIEW"))
    return scored.withColumn("suggested", case)


def blended(confidence: Column, model_confidence: Column) -> Column:
    """The mean of a confidence and a model's, with three places; without a model the confidence itself."""
    mean = F.round((confidence.cast("decimal(9,3)") + model_confidence.cast("decimal(9,3)")) / F.lit(2), 3).cast("decimal(6,3)")
    return F.coalesce(mean, confidence.cast("decimal(6,3)"))


def offline_relevance(title: Column) -> dict[str, Column]:
    """decision and model_confidence that stand in for a model that can't be asked."""
    hit = X.has_part(F.lower(F.coalesce(title, F.lit(""))), K.OFFLINE_TITLES)
    return {"offline_decision": F.when(hit, "INCLUDE").otherwise("REVIEW"), "offline_confidence": F.when(hit, 0.88).otherwise(0.65)}


def explained(evaluated: DataFrame) -> DataFrame:
    """(row_index, decision, why, why_not, method, derived, confidences): the contract of an explanation.

    derived holds what was inferred (unit, major group, chambers), confidences the three that a
    decision has, as text with three places.
    """
    why = F.when(F.col("decision") == "INCLUDE", F.concat(F.lit("score "), F.col("score").cast("string"))).otherwise(F.lit(None).cast("string"))
    why_not = F.when(F.col("decision") != "INCLUDE", F.coalesce("exclusion", "reason_code", F.concat(F.lit("score "), F.col("score").cast("string"))))
    derived = F.concat_ws("|", F.coalesce("unit_code", F.lit("-")), F.coalesce("major_code", F.lit("-")), F.array_join("all_chambers", "; "))
    parts = F.concat_ws("|", F.col("curation_confidence").cast("string"), F.col("overall_confidence").cast("string"), F.coalesce("status", F.lit("valid")))
    return evaluated.select("row_index", "decision", why.alias("why"), why_not.alias("why_not"), F.lit("DETERMINISTIC_RULES").alias("method"), derived.alias("derived"), parts.alias("confidences"))


def sources(records: DataFrame, dataset: str, page: str, source: str) -> DataFrame:
    """(dataset, sources, pages, first_page, last_page): where the records of a dataset come from."""
    return records.groupBy(dataset).agg(
        F.array_join(F.array_sort(F.collect_set(source)), "|").alias("sources"), F.count_distinct(page).alias("pages"),
        F.min(page).alias("first_page"), F.max(page).alias("last_page"))


def changed_samples(records: DataFrame, pairs: dict[str, tuple[Column, Column]], order: str = "row_index", n: int = 5) -> DataFrame:
    """(column, order, raw, normalised): the first n rows of each column whose value normalising changed."""
    cells = F.array(*[F.struct(F.lit(k).alias("column"), a.alias("raw"), b.alias("normalised")) for k, (a, b) in pairs.items()])
    rows = records.select(order, F.inline(cells)).where("not (raw <=> normalised)")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("column").orderBy(order))).where(f"__n <= {n}").drop("__n")


def relation_lines(evaluated: DataFrame, dataset: str = "dataset_id", n: int = 25, fallback: int = 20) -> DataFrame:
    """(dataset, row_index, line): the first n included records of a dataset, or the first ones where none is included."""
    some = evaluated.groupBy(dataset).agg(F.bool_or(F.col("decision") == "INCLUDE").alias("some"))
    # the lines of a dataset are all of one kind, and a partition gives up no more than the first of them
    first = Window.partitionBy(dataset).orderBy("row_index")
    df = evaluated.join(some, dataset).where(F.coalesce(F.col("decision") == "INCLUDE", F.lit(False)) | ~F.coalesce("some", F.lit(False)))
    df = df.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= max(n, fallback)).where(F.col("__n") <= F.when(F.col("some"), n).otherwise(fallback))
    line = F.concat(F.trim(F.coalesce("title", F.lit(""))), F.lit(" -> "), F.coalesce("unit_code", "major_code", F.lit("none")))
    return df.select(dataset, "row_index", line.alias("line"))


def report(evaluated: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """(dataset, body, sha256): counts and relations of a dataset as text, with the digest of the body."""
    sums = evaluated.groupBy(dataset).agg(
        F.count("*").alias("n"), F.count_if(F.col("decision") == "INCLUDE").alias("i"), F.count_if(F.col("decision") == "EXCLUDE").alias("e"), F.count_if(F.col("decision") == "REVIEW").alias("v"))
    lines = relation_lines(evaluated, dataset).groupBy(dataset).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("# "), F.col(dataset), F.lit("\nrecords: "), F.col("n"), F.lit("\nincluded: "), F.col("i"), F.lit("\nexcluded: "), F.col("e"), F.lit("\nreview: "), F.col("v"), F.lit("\n"))
    body = F.concat(head, F.coalesce("lines", F.lit("")))
    return sums.join(lines, dataset, "left").select(dataset, body.alias("body"), F.sha2(body, 256).alias("sha256"))


def evidence_by_record(items: DataFrame, most: int | None = None) -> DataFrame:
    """(row_index, claims): the claims of a record (the first so many), surest first, equal ones by type and text."""
    key = F.struct((-F.col("confidence")).alias("c"), "evidence_type", "claim")
    ordered = F.array_sort(F.collect_list(key))
    return items.groupBy("row_index").agg(F.array_join(F.transform(F.slice(ordered, 1, most) if most else ordered, lambda x: x["claim"]), "|").alias("claims"))


def legacy_score(n: Column, errors: Column, warnings: Column) -> Column:
    """100 less the share of errors (1.5 each) and warnings (0.5 each), from 0 to 100; without records 100."""
    raw = F.lit(100.0) - (errors * 1.5 + warnings * 0.5) / F.nullif(n, F.lit(0)) * 100
    return F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1), F.lit(100.0))
