"""A source of pages in text files: spark.read.format("pages").load(folder).

Rows are (path, page, text, has_text, parser, error). A file is read by the first of its parsers that
can read it: the option "parsers" lists them, by default gzip, json and text; "lenient" reads anything and
must be asked for. A file that none can read gives one row of a null page with the errors. Ranges
of pages and chosen paths are pushed into the scan: files that are not asked for are not opened, and a file
is read no further than the last page that is. A file counts as readable if what was read of it is.

Files are opened through pyarrow's file systems, so a folder may be local or in a store that they
reach. Many small files share a partition, and a page is the most that a task holds.
"""

from __future__ import annotations

import codecs
import gzip
import io
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, page int, text string, has_text boolean, parser string, error string"
#: Bytes and files of a partition.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 256
CHUNK = 1 << 20
LAST = (1 << 31) - 1


def _pages(stream: BinaryIO, decoder: codecs.IncrementalDecoder, last: int) -> Iterator[tuple[int, str]]:
    page, held = 1, []
    while page <= last:
        data = stream.read(CHUNK)
        *ends, rest = decoder.decode(data, not data).split("\f")
        for part in ends:
            yield page, "".join([*held, part])
            held, page = [], page + 1
            if page > last:
                return
        held.append(rest)
        if not data:
            yield page, "".join(held)
            return


def text_pages(stream: BinaryIO, last: int) -> Iterator[tuple[int, str]]:
    """UTF-8 text, pages apart by form feeds."""
    return _pages(stream, codecs.getincrementaldecoder("utf-8")("strict"), last)


def lenient_pages(stream: BinaryIO, last: int) -> Iterator[tuple[int, str]]:
    """As text, with a mark in the place of bytes that are no UTF-8."""
    return _pages(stream, codecs.getincrementaldecoder("utf-8")("replace"), last)


def gzip_pages(stream: BinaryIO, last: int) -> Iterator[tuple[int, str]]:
    """Compressed text."""
    raw = io.BufferedReader(stream, CHUNK)
    if raw.peek(2)[:2] != b"\x1f\x8b":
        raise ValueError("not compressed")
    yield from text_pages(gzip.GzipFile(fileobj=raw), last)


def json_pages(stream: BinaryIO, last: int) -> Iterator[tuple[int, str]]:
    """One object with page and text in each line, pages in order."""
    seen = False
    for line in io.BufferedReader(stream, CHUNK):
        if not line.strip():
            continue
        row = json.loads(line)
        if not (isinstance(row, dict) and isinstance(row.get("page"), int) and isinstance(row.get("text"), str)):
            raise ValueError("a line is no page")
        seen = True
        if row["page"] > last:
            return
        yield row["page"], row["text"]
    if not seen:
        raise ValueError("no pages")


PARSERS = {"gzip": gzip_pages, "json": json_pages, "text": text_pages, "lenient": lenient_pages}
#: What a parser raises for a file that it cannot read.
UNREADABLE = (ValueError, EOFError, OSError, zlib.error)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


@dataclass
class PagesReader(DataSourceReader):
    folder: str
    parsers: list[str]
    first: int = 1
    last: int = LAST
    limited: bool = False
    wanted: list[str] | None = None
    pushed: list[str] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "page" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                low = f.value if isinstance(f, (EqualTo, GreaterThanOrEqual)) else f.value + 1 if isinstance(f, GreaterThan) else None
                high = f.value if isinstance(f, (EqualTo, LessThanOrEqual)) else f.value - 1 if isinstance(f, LessThan) else None
                self.first, self.last, self.limited = max(self.first, low or 1), min(self.last, LAST if high is None else high), True
            elif name == "path" and isinstance(f, (EqualTo, In)):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.wanted = values if self.wanted is None else [v for v in self.wanted if v in values]
            else:
                yield f

    def _listed(self) -> list[tuple[str, int]]:
        system, at = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        info = system.get_file_info(at)
        found = system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
        # as other sources do, leave out what begins with a dot or an underscore
        shown = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.folder)
        return sorted((f.path, f.size) for f in shown)

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        total = 0
        for path, size in self._listed():
            if self.wanted is not None and path not in self.wanted:
                continue
            if not out or total + size > PARTITION_BYTES or len(out[-1].paths) == PARTITION_FILES:
                out.append(Files([]))
                total = 0
            out[-1].paths.append(path)
            total += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            errors = []
            for name in self.parsers:
                try:
                    # the first pass only finds out whether the parser fits
                    with self._open(path) as stream:
                        for _ in PARSERS[name](stream, self.last):
                            pass
                except UNREADABLE as e:
                    errors.append(f"{name}: {e}")
                    continue
                with self._open(path) as stream:
                    for page, text in PARSERS[name](stream, self.last):
                        if page >= self.first:
                            yield path, page, text, bool(text.strip()), name, None
                break
            else:
                if not self.limited:
                    yield path, None, None, None, None, "; ".join(errors)

    def _open(self, path: str):
        system = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else fs.LocalFileSystem()
        return system.open_input_stream(path, compression=None)


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        parsers = [p.strip() for p in self.options.get("parsers", "gzip,json,text").split(",")]
        unknown = [p for p in parsers if p not in PARSERS]
        if unknown:
            raise ValueError(f"unknown parsers {unknown}; known are {', '.join(PARSERS)}")
        return PagesReader(self.options["path"], parsers)


def pages(spark: SparkSession, folder: str, parsers: str = "gzip,json,text") -> DataFrame:
    """The pages of the files below a folder; filters on page and path reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagesSource)
    return spark.read.format("pages").option("parsers", parsers).load(folder)


def table_count(text: Column) -> Column:
    """How many tables a page of text holds: runs of two lines and more that have cells apart by | or tabs."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.size(F.filter(F.split(line, r"\||\t"), lambda c: F.trim(c) != "")) >= 2)
    second = F.transform(lines, lambda here, i: here & F.coalesce(F.get(lines, i - 1), F.lit(False)) & ~F.coalesce(F.get(lines, i - 2), F.lit(False)))
    return F.size(F.filter(second, lambda x: x))


def file_facts(pages: DataFrame, sample: int = 5, chars: int = 2000) -> DataFrame:
    """(path, page_count, has_text_layer, preview, sample_text, table_count, parser, error) of each file.

    has_text_layer and preview are of the first page, as at an upload; sample_text says whether one of the first
    `sample` pages has text, and table_count is of those pages.
    """
    near = F.col("page") <= sample
    return pages.groupBy("path").agg(
        F.count("page").alias("page_count"), F.coalesce(F.bool_or(F.when(F.col("page") == 1, F.col("has_text"))), F.lit(False)).alias("has_text_layer"),
        F.coalesce(F.max(F.when(F.col("page") == 1, F.substring("text", 1, chars))), F.lit("")).alias("preview"), F.coalesce(F.bool_or(near & F.col("has_text")), F.lit(False)).alias("sample_text"),
        F.coalesce(F.sum(F.when(near, table_count(F.col("text")))), F.lit(0)).alias("table_count"), F.first("parser").alias("parser"), F.first("error").alias("error"))


def extractor(target: Column) -> Column:
    """The extractor that a target asks for, by parts of its name in this order: llm, qualifications, occupations, codebook, generic."""
    low = F.lower(F.coalesce(target, F.lit("")))
    return (
        F.when(low.rlike("llm|ai"), "llm").when(low.rlike("qual|tvet"), "qualifications").when(low.rlike("occup|oihd|ofo"), "occupations")
        .when(low.rlike("codebook|qlfs|survey"), "codebook").otherwise("generic"))


def chosen_extractor(kind: Column, pipeline: Column) -> Column:
    """By the pipeline asked for, or by the document's kind where that is auto."""
    return extractor(F.when(F.coalesce(pipeline, F.lit("auto")) == "auto", kind).otherwise(pipeline))


def with_fallback(documents: DataFrame, attempts: list[tuple[str, DataFrame]], doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(rows, outcome): of each document the rows of the first attempt that has any, and which one that was.

    attempts are (name, rows with doc) in order. outcome has (doc, extractor, error), an error for
    documents that no attempt has rows of.
    """
    order = {name: n for n, (name, _) in enumerate(attempts)}
    marks = None
    for name, rows in attempts:
        own = rows.select(doc).where(F.col(doc).isNotNull()).groupBy(doc).agg(F.lit(order[name]).alias("__n"))
        marks = own if marks is None else marks.unionByName(own)
    first = marks.groupBy(doc).agg(F.min("__n").alias("__n"))
    kept = None
    for name, rows in attempts:
        own = rows.join(first.where(F.col("__n") == order[name]).select(doc), doc, "left_semi").withColumn("extractor", F.lit(name))
        kept = own if kept is None else kept.unionByName(own, allowMissingColumns=True)
    names = F.create_map(*[F.lit(x) for name, n in order.items() for x in (n, name)])
    outcome = documents.select(doc).distinct().join(first, doc, "left")
    return kept, outcome.select(doc, F.element_at(names, F.col("__n")).alias("extractor"), F.when(F.col("__n").isNull(), "no tables or records were found").alias("error"))
