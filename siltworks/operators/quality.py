"""Quality dimensions and release gates from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

COUNTS = ["total", "valid", "errors", "warnings", "review", "duplicates", "conflicts", "null_cells", "cells", "no_provenance"]


def generic_columns(columns: DataFrame, dataset: str = "dataset_id", name: str = "name") -> DataFrame:
    """(dataset, generic_columns): whether a dataset has at most two columns and one of them is named like column_1."""
    held = columns.select(dataset, name).distinct().groupBy(dataset).agg(F.count(name).alias("n"), F.coalesce(F.bool_or(F.startswith(name, F.lit("column_"))), F.lit(False)).alias("plain"))
    return held.select(dataset, (F.col("plain") & (F.col("n") <= 2)).alias("generic_columns"))


def dimensions(counts: DataFrame) -> DataFrame:
    """Adds the eight dimension scores and their weighted overall score (decimals) to rows with COUNTS.

    Without records every score is 100. Optional columns processed and generic_columns (boolean) say
    whether curation ran and whether columns have generic names.
    """
    has = set(counts.columns)
    processed = F.col("processed") if "processed" in has else F.lit(True)
    generic = F.col("generic_columns") if "generic_columns" in has else F.lit(False)
    d = "decimal(18,6)"

    def share(a, b, by):
        return F.when(F.col(b) > 0, (F.col(a).cast("decimal(18,0)") * F.lit(by) / F.col(b).cast("decimal(18,0)")).cast(d)).otherwise(F.lit(0).cast(d))

    raw = {
        "extraction": 100 - share("errors", "total", 60),
        "structural": 100 - share("duplicates", "total", 40) - F.when(generic, 50).otherwise(0),
        "normalization": 100 - share("warnings", "total", 20),
        "validation": 100 - share("errors", "total", 100) - share("warnings", "total", 50),
        "completeness": F.when(F.col("cells") > 0, 100 - share("null_cells", "cells", 100)).otherwise(F.lit(95).cast(d)),
        "consistency": 100 - F.least(F.col("conflicts") * 10, F.lit(50)),
        "curation": F.when(processed, 100 - share("review", "total", 50)).otherwise(F.lit(50).cast(d)),
        "provenance": 100 - share("no_provenance", "total", 100),
    }
    empty = F.col("total") <= 0
    scores = {k: F.when(empty, F.lit(100)).otherwise(F.greatest(F.lit(0).cast(d), F.round(v.cast(d), 2))).cast("decimal(6,2)") for k, v in raw.items()}
    df = counts.withColumns(scores)
    overall = sum((F.col(k) * F.lit(w).cast("decimal(4,2)") for k, w in K.QUALITY_WEIGHTS.items()), F.lit(0).cast("decimal(4,2)"))
    return df.withColumn("overall", F.round(overall, 2).cast("decimal(6,2)"))


def gates(scored: DataFrame) -> DataFrame:
    """Adds the ten gates, their three aliases, export_status and reasons to rows with dimensions.

    Optional boolean columns profile_valid and dataset_identified say whether the document was
    understood and its dataset found. reasons joins what failed, in the order of the gates.
    """
    has = set(scored.columns)
    known = F.col("profile_valid") if "profile_valid" in has else F.lit(True)
    identified = F.col("dataset_identified") if "dataset_identified" in has else F.lit(True)
    processed = F.col("processed") if "processed" in has else F.lit(True)
    generic = F.col("generic_columns") if "generic_columns" in has else F.lit(False)
    empty = F.col("total") <= 0
    critical = F.col("errors") + F.col("conflicts")

    def gate(c):
        return F.when(empty, "passed").otherwise(c)

    structural = gate(F.when(F.col("structural") >= 70, "passed").otherwise("warning"))
    understood = gate(F.when(known, "passed").otherwise("failed"))
    reasons = F.array_compact(F.array(
        F.when(~known, "document not understood"), F.when(~identified, "dataset not identified"), F.when(generic, "generic column names"),
        F.when(F.col("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit(" errors"))),
        F.when(~processed, "not curated").when(F.col("review") > 0, F.concat(F.col("review").cast("string"), F.lit(" for review"))),
        F.when(critical > 0, F.concat(critical.cast("string"), F.lit(" critical"))),
    ))
    return scored.withColumns({
        "document_understanding_gate": understood, "extraction_gate": understood, "dataset_identification_gate": gate(F.when(identified, "passed").otherwise("failed")),
        "structural_integrity_gate": structural, "reasons": F.when(empty, "").otherwise(F.array_join(reasons, "; ")),
        "structural_gate": gate(F.when(F.col("structural") >= 70, "passed").otherwise("warning")),
        "schema_gate": gate(F.when(generic, "failed").otherwise("passed")),
        "normalization_gate": gate(F.when(F.col("normalization") >= 75, "passed").otherwise("warning")),
        "validation_gate": gate(F.when(F.col("errors") == 0, "passed").when(F.col("errors") > 5, "failed").otherwise("warning")),
        "curation_gate": gate(F.when(~processed, "partially_processed").when(F.col("review") == 0, "passed").otherwise("requires_review")),
        "evidence_gate": gate(F.when(processed, "passed").otherwise("pending")),
        "provenance_gate": gate(F.when(F.col("no_provenance") == 0, "passed").otherwise("warning")),
        "review_gate": gate(F.when((critical == 0) & (F.col("review") == 0), "passed").when(critical == 0, "warning").otherwise("failed")),
        "export_gate": F.when(empty | ((critical == 0) & ~generic), "ready").otherwise("blocked"),
        "export_status": F.when(empty, "PRODUCTION_READY").when(generic | (F.col("errors") > 5), "BLOCKED").when(~processed, "PARTIALLY_PROCESSED")
        .when((F.col("review") > 0) | (F.col("warnings") > 0) | (F.col("conflicts") > 0), "REQUIRES_REVIEW").otherwise("PRODUCTION_READY"),
    })
