"""Sources: parquet tables, files with digests, page text and raw table grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of which two or more make a row a header. Fixed values.
HEADER_WORDS = ["saqa", "qualification", "nqf", "ofo", "occupation", "title", "code", "variable", "label", "value", "province"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, sha256) of files, hashed where they are read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def text_pages(spark: SparkSession, path: str, separator: str = "\f") -> DataFrame:
    """(path, page_number, text): text files cut into pages at form feeds."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", separator)).alias("pos", "text"))
    return df.select("path", (F.col("pos") + 1).alias("page_number"), "text")


def pages_between(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Only the pages of a range; the filter reaches the scan."""
    return pages.where(F.col("page_number").between(first, last))


def is_header(cells: Column) -> Column:
    """Whether a row of cells reads as a header: two known words, no code in front, not blank at the start."""
    text = F.lower(F.array_join(cells, " "))
    hits = sum((F.when(text.rlike(rf"\b{w}\b"), 1).otherwise(0) for w in HEADER_WORDS), F.lit(0))
    first, second = F.coalesce(F.get(cells, F.lit(0)), F.lit("")), F.coalesce(F.get(cells, F.lit(1)), F.lit(""))
    return (hits >= 2) & ~F.trim(first).rlike("^[0-9]{4,7}$") & ~((F.trim(first) == "") & (F.trim(second) == ""))


def with_headers(grid: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """grid (…, cells) without header rows, plus headers: the last header row seen in the document."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = grid.withColumn("__header", is_header(F.col("cells")))
    filled = marked.withColumn("headers", F.last(F.when(F.col("__header"), F.col("cells")), ignorenulls=True).over(w))
    return filled.where(~F.col("__header") & F.exists("cells", lambda c: F.trim(c) != "")).drop("__header")


def document_kind(name: Column, first_page: Column) -> Column:
    """The kind of a document by words in its name and first page, in this order."""
    text = F.lower(F.concat_ws(" ", name, first_page))
    return (
        F.when(text.rlike("qualification|tvet|saqa"), "qualifications").when(text.rlike("occupation|ofo|oihd"), "occupations")
        .when(text.rlike("codebook|survey|qlfs"), "codebook").otherwise("generic")
    )


def previews(pages: DataFrame, doc: str, page: str, text: str, n: int = 5, chars: int = 300) -> DataFrame:
    """(doc, page, preview, pages): the beginnings of the first n pages of each document, and how many it has."""
    w = Window.partitionBy(doc)
    placed = pages.withColumns({"__n": F.row_number().over(w.orderBy(page)), "pages": F.count("*").over(w)})
    return placed.where(F.col("__n") <= n).select(doc, page, F.substring(F.coalesce(text, F.lit("")), 1, chars).alias("preview"), "pages")
