"""Sinks: flat exports, dictionaries, manifests and packages of relational tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("csv", "json", "parquet")


def file_name(name: str) -> str:
    """A name that is safe in a path."""
    return re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_") or "export"


def chosen(flat: DataFrame, columns: list[str] | None = None, valid_only: bool = False, decision: str | None = None) -> DataFrame:
    """Rows and columns of an export; columns with a leading underscore always stay."""
    df = flat.where(F.col("_prov_status").isin("valid", "human_reviewed")) if valid_only else flat
    df = df.where(F.col("_curation_decision") == decision.upper()) if decision else df
    keep = [c for c in flat.columns if columns is None or c in columns or c.startswith("_")]
    return df.select(*keep)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Writes one of FORMATS, replacing what is there."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    w = df.write.mode("overwrite").option("header", "true")
    (w.partitionBy(*partition_by) if partition_by else w).format(fmt).save(path)


def write_package(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> dict[str, int]:
    """Writes each table under its name and returns the row counts that were written."""
    for name, df in tables.items():
        write(df, f"{folder}/{file_name(name)}", fmt)
    spark = next(iter(tables.values())).sparkSession
    read = {n: spark.read.format(fmt).option("header", "true").load(f"{folder}/{file_name(n)}") for n in tables}
    return {n: df.count() for n, df in read.items()}


def data_dictionary(columns: DataFrame) -> DataFrame:
    """(column, original, type, required, description) of schema rows, required as YES or NO."""
    return columns.select(
        F.col("name").alias("column"), F.coalesce("original_name", "name").alias("original"), F.coalesce("type", F.lit("string")).alias("type"),
        F.when(F.col("required"), "YES").otherwise("NO").alias("required"), F.coalesce("description", F.lit("")).alias("description"))


def manifest(summary: DataFrame, policy: str) -> DataFrame:
    """(dataset_id, manifest, reproducibility_hash): counts and policy as JSON without times, and its digest."""
    counts = [c for c in summary.columns if c != "dataset_id"]
    body = F.to_json(F.struct("dataset_id", F.lit(policy).alias("policy"), *counts))
    return summary.select("dataset_id", body.alias("manifest"), F.sha2(body, 256).alias("reproducibility_hash"))
