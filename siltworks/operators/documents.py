"""Document structure: headings of pages, sections, metadata and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K

TOC = ("table of contents", "contents")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def semantics(title: Column) -> Column:
    """The first keyword group with a word of the title; the order of the groups counts."""
    out = F.lit("UNKNOWN")
    for kind, words in reversed(K.HEADING_GROUPS):
        out = F.when(F.lower(title).rlike(rf"\b({'|'.join(words)})\b"), kind).otherwise(out)
    return out


def headings(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, page, line, title, level, semantic_type) of the headings on the first 15 lines of each page.

    Pages of a table of contents give one heading and no others; up to page 7 that holds on for the
    following pages. Running headers are skipped from page 6 on, parts and annexures take the next line
    as subtitle, and a heading equal to the one before on the same page goes. Null texts have none.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), stripped), lambda x: x != "")
    df = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), lines.alias("lines"))
    here = F.exists(F.slice("lines", 1, 3), lambda x: F.lower(x).isin(*TOC))
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("toc", here).withColumn("inside", F.col("toc") | ((F.col("page") <= 7) & F.max("toc").over(before)))
    listed = df.where("toc").select("doc", "page", F.lit(0).alias("line"), F.lit("Table of Contents").alias("title"), F.lit(1).alias("level"), F.lit("FRONT_MATTER").alias("semantic_type"))
    each = df.where("not inside").select("doc", "page", "lines", F.posexplode(F.slice("lines", 1, 15)).alias("line", "s"))
    each = each.withColumn("after", F.get("lines", F.col("line") + 1)).drop("lines")
    many = (F.size(F.split("s", r"\s+")) > 4) & (F.col("page") > 5)
    each = each.where(~(many & (F.col("s").rlike(K.RUNNING_HEADERS[0]) | F.col("s").rlike(K.RUNNING_HEADERS[1]))))
    part, annex, front, numbered, major = (F.col("s").rlike(p) for p in K.HEADING_PATTERNS)
    subtitle = F.col("after").isNotNull() & ~F.lower("after").rlike("part |annexure|page ") & (F.length("after") < 100)
    title = (
        F.when(part, F.when(subtitle, F.concat("s", F.lit(": "), "after")).otherwise(F.col("s")))
        .when(annex, F.when(F.col("after").isNotNull() & ~F.col("s").contains(":") & (F.length("after") < 120), F.concat("s", F.lit(": "), "after")).otherwise(F.col("s")))
        .when(front | numbered | (major & ~F.lower("s").rlike("figure|table")), F.col("s"))
    )
    deep = F.when(F.length("s") - F.length(F.replace("s", F.lit("."), F.lit(""))) == 1, 2).otherwise(3)
    level = F.when(part, 1).when(annex, 4).when(front, 1).when(numbered, deep).otherwise(1)
    found = each.select("doc", "page", "line", title.alias("title"), level.alias("level"), F.when(annex & ~part, "APPENDIX").otherwise(semantics(title)).alias("semantic_type"))
    both = listed.unionByName(found.where("title is not null"))
    w = Window.partitionBy("doc").orderBy("page", "line")
    last = both.withColumns({"t": F.lag(F.lower("title")).over(w), "p": F.lag("page").over(w)})
    return last.where("t is null or t <> lower(title) or p <> page").drop("t", "p")


def section_tree(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, section, title, level, semantic_type, page_start, page_end) of each document.

    A section ends on the page before the next one starts (its own at least), the last one on the last
    page. A document without headings has one section, all of it.
    """
    found = headings(pages, doc, page, text)
    total = pages.groupBy(F.col(doc).alias("doc")).agg(F.max(page).alias("pages"))
    w = Window.partitionBy("doc").orderBy("page", "line")
    placed = found.join(total, "doc").withColumns({"section": F.row_number().over(w), "next": F.lead("page").over(w)})
    end = F.when(F.col("next").isNull(), F.col("pages")).otherwise(F.greatest("page", F.col("next") - 1))
    placed = placed.select("doc", "section", "title", "level", "semantic_type", F.col("page").alias("page_start"), end.alias("page_end"))
    bare = total.join(found.select("doc").distinct(), "doc", "left_anti")
    root = bare.select("doc", F.lit(0).alias("section"), F.lit("Document Content").alias("title"), F.lit(1).alias("level"), F.lit("GENERAL_CONTENT").alias("semantic_type"), F.lit(1).alias("page_start"), F.col("pages").alias("page_end"))
    return placed.unionByName(root)


def metadata(text: Column) -> dict[str, Column]:
    """title, publisher, publication_date and author of a document, read off its first pages."""
    titles = [F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, p, 1), r"\s+", " ")), F.lit("")) for p in K.TITLE_PATTERNS]
    publisher = F.lit(None).cast("string")
    for literal, name in reversed(K.PUBLISHERS):
        publisher = F.when(text.contains(literal), name).otherwise(publisher)
    block = F.regexp_extract(text, K.AUTHOR_BLOCK, 1)
    names = F.slice(F.filter(F.transform(F.split(block, "\n"), stripped), lambda x: x != ""), 1, 3)
    return {
        "title": F.coalesce(*titles),
        "publisher": publisher,
        "publication_date": F.nullif(F.regexp_extract(text, r"\b(20[0-9]{2})\b", 1), F.lit("")),
        "author": F.nullif(F.array_join(names, ", "), F.lit("")),
    }


def profile(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """One row for each document: pages, chars, scanned, sections, first_section and its metadata.

    Documents of fewer than 100 characters count as scanned.
    """
    txt = F.coalesce(F.col(text), F.lit(""))
    sums = pages.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("pages"), F.sum(F.length(F.trim(txt))).alias("chars"), F.min_by(txt, page).alias("first"))
    tree = section_tree(pages, doc, page, text).groupBy("doc").agg(F.count("*").alias("sections"), F.min_by("title", "section").alias("first_section"))
    out = sums.join(tree, "doc", "left").withColumns({k: v for k, v in metadata(F.col("first")).items()})
    return out.withColumn("scanned", F.col("chars") < 100).drop("first")


def resolve_target(candidates: DataFrame, doc: str = "doc", requested: str = "requested", authoritative: str = "authoritative", least: str = "0.75") -> DataFrame:
    """(doc, target): the requested candidate, else the authoritative one, else the best if its score is high enough.

    candidates has doc, id, score and the columns requested and authoritative (ids or null, the same on
    each row of a document). A named id that no candidate has resolves to nothing.
    """
    named = F.coalesce(requested, authoritative)
    best = candidates.groupBy(doc).agg(
        F.max(F.when(F.col("id") == named, F.col("id"))).alias("named"), F.max(named).alias("wish"), F.max(F.struct("score", (-F.col("rank")).alias("r"), "id")).alias("top"))
    top = F.when(F.col("top.score") >= F.lit(least).cast("decimal(6,3)"), F.col("top.id"))
    return best.select(doc, F.when(F.col("wish").isNotNull(), F.col("named")).otherwise(top).alias("target"))


def confidences(structural: Column, score: Column) -> dict[str, Column]:
    """Structural and semantic confidence within their bounds, with two places."""
    lo, hi = F.lit("0.40").cast("decimal(6,3)"), F.lit("0.99").cast("decimal(6,3)")
    semantic = score.cast("decimal(9,3)") / F.lit(10)
    return {
        "structural_confidence": F.round(F.least(F.greatest(structural.cast("decimal(9,3)"), lo), hi), 2).cast("decimal(4,2)"),
        "semantic_confidence": F.round(F.least(F.greatest(semantic, F.lit("0.20").cast("decimal(6,3)")), hi), 2).cast("decimal(4,2)"),
    }


def full_profile(pages: DataFrame, report: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """profile() with what discovery found: digest, tables, candidates, the selected one, and the document's type.

    report is of discovery.discovery_report(). digest is that of the digests of the pages in order, so no document is put
    together in one row; type and its confidence come from the first five pages.
    """
    from .discovery import document_type

    txt = F.coalesce(F.col(text), F.lit(""))
    near = F.when(F.col(page) <= 5, F.struct(F.col(page).alias("p"), txt.alias("t")))
    sums = pages.groupBy(F.col(doc).alias("doc")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.sha2(txt, 256).alias("d")))), lambda x: x["d"]), ""), 256).alias("digest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(near)), lambda x: x["t"]), " ").alias("front"))
    kind = document_type(F.col("front"))
    base = profile(pages, doc, page, text).join(sums, "doc").withColumns({"document_type": kind["type"], "type_confidence": kind["confidence"]}).drop("front")
    found = report.select(F.col(doc).alias("doc"), "tables_detected", "candidate_count", "selected_id", "authoritative")
    joined = base.join(found, "doc", "left").fillna(0, ["tables_detected", "candidate_count"]).fillna(False, ["authoritative"])
    shape = F.concat(F.col("sections").cast("string"), F.lit(" sections, "), F.col("tables_detected").cast("string"), F.lit(" tables, "), F.col("candidate_count").cast("string"), F.lit(" candidate datasets"))
    return joined.withColumns({"has_tables": F.col("tables_detected") > 0, "structure": shape})
