"""The knowledge report of datasets in sixteen sections, as rows of lines.

A report lists every record of its dataset, so it is a table of (dataset, section, place, text) and
never one text in one task; written in order of its first three columns it reads as a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from . import quality, report
from .schema import has_any

#: Values of a column that the section of entities shows, and samples of changed values.
SHOWN, SAMPLES = 10, 5
GATES = [
    "document_understanding_gate", "dataset_identification_gate", "structural_integrity_gate", "schema_gate", "normalization_gate", "validation_gate", "curation_gate", "evidence_gate", "provenance_gate", "review_gate", "export_gate",
]


def _lines(rows: DataFrame, dataset: str, section: int, texts: list[Column], order: list[Column] | None = None) -> DataFrame:
    """Lines of a section from rows, each giving texts in turn (null: none); order sorts rows of one dataset."""
    made = rows.select(F.col(dataset).alias("dataset"), F.array(*(order or [F.lit("0")])).alias("key"), F.posexplode(F.array(*texts)).alias("pos", "text")).where("text is not null")
    # a place sorts as text, so numbers in it come padded
    return made.select("dataset", F.lit(section).alias("section"), F.concat_ws(".", "key", F.lpad(F.col("pos").cast("string"), 3, "0")).alias("place"), "text")


def _number(c: Column | str) -> Column:
    return F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), 12, "0")


def _say(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def report_lines(evaluated: DataFrame, names: list[str], columns: list[str], counts: DataFrame, policy: str, key: str = "row_index", dataset: str = "dataset_id", page: str = "page", source: str = "source", described: DataFrame | None = None) -> DataFrame:
    """(dataset, section, place, text): the report of every dataset of evaluated records.

    columns are the record's fields, names those that hold entities. counts has the columns of
    quality.COUNTS by dataset; described has (dataset, description) and may lack datasets, which then
    have no third section. page and source are columns of evaluated.
    """
    e = evaluated
    per = e.groupBy(dataset).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") == "warning").alias("warn"), F.count_if(F.col("status") == "error").alias("err"),
        F.count_if(F.col("decision") == "INCLUDE").alias("inc"), F.count_if(F.col("decision") == "REVIEW").alias("rev"), F.count_if(F.col("decision") == "EXCLUDE").alias("exc"),
        F.min(page).alias("p0"), F.max(page).alias("p1"), F.count_distinct(page).alias("pages"), F.count_distinct(F.nullif(F.trim(source), F.lit(""))).alias("sources"), F.sum(F.size("conflicts")).alias("conflicts"))
    out = [
        _lines(per, dataset, 1, [_say("Dataset Identifier: ", F.col(dataset)), _say("Record Count: ", F.col("n"))]),
        _lines(per, dataset, 2, [_say("Sources: ", F.col("sources")), _say("Page Range: ", F.col("p0"), " to ", F.col("p1"))]),
    ]
    if described is not None:
        out.append(_lines(described.where("trim(description) <> ''"), dataset, 3, [F.trim("description")]))
    unit = F.lit("Record")
    for parts, more, label in reversed(K.DATASET_UNITS):
        if any(p in c.lower() for p in parts for c in columns) and (more is not None or len(columns) <= 5):
            unit = F.lit(label)
    out.append(_lines(per, dataset, 4, [_say("Primary Entity: ", unit)]))
    out.append(_lines(per, dataset, 5, [_say("Total: ", F.col("n")), _say("Valid: ", F.col("valid")), _say("Warnings: ", F.col("warn")), _say("Errors: ", F.col("err"))], [F.lit("0")]))
    cells = e.select(dataset, F.inline(F.array(*[F.struct(F.lit(n).alias("at"), F.lit(c).alias("column"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("v")) for n, c in enumerate(columns)])))
    covered = cells.groupBy(dataset, "at", "column").agg(F.count("*").alias("n"), F.count("v").alias("filled"), F.count_distinct("v").alias("values"))
    share = F.round(F.col("filled").cast("decimal(18,0)") * 100 / F.col("n").cast("decimal(18,0)"), 1).cast("decimal(5,1)")
    out.append(_lines(covered, dataset, 5, [_say("- ", F.col("column"), ": ", F.col("filled"), "/", F.col("n"), " populated (", share, "%) | ", F.col("values"), " unique value(s)")], [F.lit("1"), _number("at")]))
    required = F.when(has_any(F.col("column"), K.REQUIRED_PARTS), "YES").otherwise("NO")
    out.append(_lines(covered, dataset, 6, [_say("Field: ", F.col("column")), F.lit("  Authority: SOURCE_FACT"), _say("  Mandatory: ", required), _say("  Coverage: ", F.col("filled"), " / ", F.col("n"))], [_number("at")]))
    # entities: the commonest values of each column, found by partial counts
    common = cells.where(F.col("column").isin(names) & F.col("v").isNotNull()).groupBy(dataset, "at", "column", "v").agg(F.count("*").alias("n"))
    best = Window.partitionBy(dataset, "at").orderBy(F.desc("n"), "v")
    common = common.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= SHOWN)
    out.append(_lines(common, dataset, 7, [_say(F.col("column"), ": ", F.col("v"), " (", F.col("n"), ")")], [_number("at"), _number("rank")]))
    changed = cells_changed(e, names, dataset, key)
    out.append(_lines(changed, dataset, 8, [_say(F.col("column"), ": '", F.col("raw"), "' -> '", F.col("clean"), "'")], [F.col("column"), _number("rank")]))
    out.append(_lines(report.relation_lines(e, dataset), dataset, 9, [F.col("line")], [_number(key)]))
    majors = e.groupBy(dataset, F.coalesce("major_code", F.lit("none")).alias("major")).agg(F.count("*").alias("n"))
    out.append(_lines(majors, dataset, 10, [_say("Major group ", F.col("major"), ": ", F.col("n"))], [F.col("major")]))
    kinds = F.when(F.col("decision") == "INCLUDE", F.struct(F.lit("0").alias("o"), F.lit("Record").alias("k"))).when(F.col("decision") == "REVIEW", F.struct(F.lit("1").alias("o"), F.lit("Review").alias("k"))).otherwise(F.struct(F.lit("2").alias("o"), F.lit("Excluded").alias("k")))
    fields = F.array_join(F.filter(F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", _say(f"{c}: ", X.collapse(F.col(c).cast("string")))) for c in columns]), lambda x: x.isNotNull()), " | ")
    tail = F.when(kinds["k"] == "Record", _say(" [Page ", F.col(page), "]")).otherwise(_say(" -> Reason: ", F.coalesce("exclusion", "reason_code", F.lit("none"))))
    out.append(_lines(e, dataset, 11, [_say(kinds["k"], " #", F.col(key), ": ", fields, tail)], [kinds["o"], _number(key)]))
    out.append(_lines(per, dataset, 12, [_say("Active Policy: ", F.lit(policy)), _say("Included: ", F.col("inc")), _say("Review Required: ", F.col("rev")), _say("Excluded: ", F.col("exc")), _say("Conflicts: ", F.col("conflicts"))]))
    posture = F.when(F.col("err") == 0, "PASSED").otherwise(_say("ACTION REQUIRED (", F.col("err"), " Errors)"))
    out.append(_lines(per, dataset, 13, [_say("Valid: ", F.col("valid"), " / ", F.col("n")), _say("Integrity Posture: ", posture)]))
    scored = quality.gates(quality.dimensions(counts))
    out.append(_lines(scored, dataset, 14, [_say("Overall Quality Score: ", F.col("overall"), "%"), *[_say(f"{g}: ", F.upper(g)) for g in GATES], *[_say(f"{d}: ", F.col(d), "%") for d in K.QUALITY_WEIGHTS]]))
    out.append(_lines(per, dataset, 15, [_say("Source Pages: ", F.col("pages"))]))
    out.append(_lines(per, dataset, 16, [F.lit("Raw and normalised values are both kept.")]))
    heads = per.select(dataset, F.explode(F.sequence(F.lit(1), F.lit(16))).alias("s"))
    titles = F.array(*[F.lit(f"{n + 1}. {t}") for n, t in enumerate(K.REPORT_SECTIONS)])
    if described is None:
        heads = heads.where("s <> 3")
    else:
        heads = heads.join(described.where("trim(description) <> ''").select(dataset, F.lit(3).alias("s"), F.lit(True).alias("has")), [dataset, "s"], "left").where("s <> 3 or has")
    # a heading has the empty place, before all others
    heads = heads.select(F.col(dataset).alias("dataset"), F.col("s").alias("section"), F.lit("").alias("place"), F.get(titles, F.col("s") - 1).alias("text"))
    return reduce(DataFrame.unionByName, out).unionByName(heads)


def cells_changed(records: DataFrame, columns: list[str], dataset: str, key: str) -> DataFrame:
    """(dataset, column, rank, raw, clean): the first SAMPLES values of each dataset's column that cleaning changes."""
    rows = records.select(dataset, key, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw"), X.collapse(F.col(c).cast("string")).alias("clean")) for c in columns]))).where("raw <> clean")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(dataset, "column").orderBy(key))).where(F.col("rank") <= SAMPLES)
