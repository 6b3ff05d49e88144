"""Finding datasets in documents: captions, stated counts, units, roles, groups and scores; page and grid filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .structure import running_count, with_previous


def caption(text: Column) -> Column:
    """The first caption of a page by kind (table, annexure, appendix, in any case) of more than seven characters."""
    def first(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(f"(?i)({pattern}[:.-][ \\t]+[^\\n\\r]+)"), F.lit(1)), lambda x: F.trim(x))
        return F.get(F.filter(found, lambda x: F.length(x) > 7), F.lit(0))

    return F.coalesce(first(r"table[ \t]+[0-9]+"), first(r"annexure[ \t]+[0-9]+"), first(r"appendix[ \t]+[A-Z0-9]+"), F.lit(""))


def stated_counts(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, stated): the record counts above five that a text states, each once."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(F.col(text), F.lit(f"(?i){p}"), F.lit(1)) for p in K.STATED_PATTERNS]))
    return pages.select(*keys, F.explode(found).alias("s")).select(*keys, F.col("s").cast("int").alias("stated")).where(F.col("stated") > K.STATED_ABOVE).distinct()


#: A character that no text holds, as it is none.
CUT = "\uffff"


def matches(text: Column, pattern: str) -> Column:
    """array(struct(start, match)) of a pattern's matches in order, start counting code points from 0.

    Matches are cut out of the text, and a fold over the pieces adds up what lies before each.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), CUT, "\ufffd")
    pieces = F.split(F.regexp_replace(clean, f"({pattern})", f"{CUT}$1{CUT}"), CUT)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("found"), F.lit(False).alias("inside"))

    def step(held: Column, piece: Column) -> Column:
        own = F.struct(held["at"].alias("start"), piece.alias("match"))
        return F.struct((held["at"] + F.length(piece)).alias("at"), F.when(held["inside"], F.array_append(held["found"], own)).otherwise(held["found"]).alias("found"), (~held["inside"]).alias("inside"))

    return F.aggregate(pieces, none, step, lambda held: held["found"])


def stated_contexts(pages: DataFrame, doc: str, page: str = "page", text: str = "text") -> DataFrame:
    """(doc, stated, page, context): each count above five that a document states, where it does so first, with 40 characters on both sides.

    Within a page the patterns go one after the other, each from the beginning. Null texts state nothing.
    """
    def placed_by(kind: int, pattern: str) -> Column:
        def one(m: Column) -> Column:
            count = F.regexp_extract(m["match"], pattern, 1).cast("int")
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), F.length(m["match"]).alias("size"), count.alias("stated"))

        return F.transform(matches(F.col(text), pattern), one)

    held = F.array(*[placed_by(n, f"(?i){p}") for n, p in enumerate(K.STATED_PATTERNS)])
    found = pages.select(doc, page, text, F.explode(F.flatten(held)).alias("m")).where(F.col("m.stated") > K.STATED_ABOVE)
    low = F.greatest(F.col("m.start") - K.STATED_CONTEXT, F.lit(0))
    around = F.trim(F.replace(F.substring(text, low + 1, F.col("m.start") - low + F.col("m.size") + K.STATED_CONTEXT), F.lit("\n"), F.lit(" ")))
    placed = found.select(doc, F.col("m.stated").alias("stated"), F.struct(page, "m.kind", "m.start").alias("place"), around.alias("context"))
    first = placed.groupBy(doc, "stated").agg(F.min_by(F.struct("place", "context"), "place").alias("f"))
    return first.select(doc, "stated", F.col(f"f.place.{page}").alias(page), "f.context")


def table_groups(tables: DataFrame, doc: str = "doc", carried: list[str] = ()) -> DataFrame:
    """(doc, group_no, caption, section_title, role, unit, page_start, page_end, n_tables, row_count): tables that go on over pages as one.

    tables has (doc, page_start, page_end, table_index, caption, section_title, role, unit, column_count, row_count, layout).
    Layout grids and tables of the role metadata are left out. A table joins the one before it if it begins
    on the page where that one ends or on the next, and if both have as many columns (more than one), or
    captions that are equal or a caption of a table that always goes on, or one role. row_count is the group's sum; what names a
    group, and the carried columns, are of its first table.
    """
    used = tables.where("not layout and coalesce(role, '') <> 'metadata'").withColumn("__place", F.struct("page_start", "table_index"))
    linked = with_previous(used, [doc], "__place", ["page_end", "column_count", "caption", "role"], F.floor(F.col("page_start") / 1024))
    p, low = F.col("previous"), F.lower("caption")
    near = (F.col("page_start") == p["page_end"] + 1) | (F.col("page_start") == p["page_end"])
    columns = (F.col("column_count") == p["column_count"]) & (F.col("column_count") > 1)
    captions = (F.coalesce("caption", F.lit("")) != "") & (F.coalesce(p["caption"], F.lit("")) != "") & ((low == F.lower(p["caption"])) | F.contains(low, F.lit(K.CONTINUED_CAPTION)))
    goes_on = near & (columns | captions | F.col("role").eqNullSafe(p["role"]))
    starts = p.isNull() | ~F.coalesce(goes_on, F.lit(False))
    numbered = running_count(linked, [doc], "__place", starts, "group_no", F.floor(F.col("page_start") / 1024))
    first = F.min_by(F.struct("caption", "section_title", "role", "unit", *carried), "__place")
    groups = numbered.groupBy(doc, "group_no").agg(first.alias("f"), F.min("page_start").alias("page_start"), F.max_by("page_end", "__place").alias("page_end"), F.count("*").alias("n_tables"), F.sum("row_count").alias("row_count"))
    return groups.select(
        doc, "group_no", F.when(F.coalesce("f.caption", F.lit("")) == "", F.concat(F.lit("Table from Page "), F.col("page_start").cast("string"))).otherwise(F.col("f.caption")).alias("caption"),
        F.when(F.coalesce("f.section_title", F.lit("")) == "", "Unassigned Section").otherwise(F.col("f.section_title")).alias("section_title"), "f.role", "f.unit", "page_start", "page_end", "n_tables", "row_count", *[f"f.{c}" for c in carried])


#: Records by which a group may differ from a count that the text states.
STATED_NEAR = 2


def dataset_candidates(groups: DataFrame, stated: DataFrame, doc: str = "doc") -> DataFrame:
    """groups plus candidate_id, stated, stated_page, score, rank, authoritative and reasons.

    groups is of table_groups() with the carried column headers (an array); stated of stated_contexts(). A group is
    corroborated by the first stated count, by page and size, that its records come near. Candidates rank by score and then by their order
    in the document; the first is authoritative if its score is high enough. reasons lists what the score is made of.
    """
    # counts have four digits at most, so a document's are a short list
    known = stated.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("at"), F.col("stated").alias("count")))).alias("__stated"))
    both = groups.join(known, doc, "left")
    near = F.get(F.filter(F.coalesce("__stated", F.array().cast("array<struct<at:long,count:int>>")), lambda s: F.abs(F.col("row_count") - s["count"]) <= STATED_NEAR), F.lit(0))
    label, heads = F.concat("caption", F.lit(" "), "section_title"), F.array_join(F.coalesce("headers", F.array().cast("array<string>")), "\n")
    low, low_heads = F.lower(label), F.lower(heads)
    signs = [
        (low.rlike("final list|final oihd|occupations in high demand"), "final wording"), (F.contains(low, F.lit("consolidation of evidence")), "consolidation section"), (F.col("role") == "final_dataset", "final dataset role"),
        (F.col("unit").isin("occupation", "qualification"), "unit of observation"), (F.col("unit") == "survey_response", "survey responses"), (near.isNotNull(), "stated count"),
        (F.contains(low_heads, F.lit("ofo")) & F.contains(low_heads, F.lit("occupation")), "code and title columns"), (F.col("role") == "intermediate_analysis", "intermediate analysis"), (F.col("role") == "survey", "survey table"),
        ((F.col("role") == "appendix") & ~F.contains(low, F.lit("final")), "appendix"),
    ]
    score = candidate_score(label, F.coalesce("role", F.lit("unknown")), F.coalesce("unit", F.lit("unknown")), heads, near.isNotNull())
    name = F.lower(F.substring(F.regexp_replace("caption", "[^a-zA-Z0-9]", "_"), 1, 20))
    scored = both.withColumns({
        "candidate_id": F.concat(F.lit("cand_"), F.col("group_no").cast("string"), F.lit("_"), name), "stated": near["count"], "stated_page": near["at"], "score": score,
        "reasons": F.filter(F.array(*[F.when(ok, F.lit(text)) for ok, text in signs]), lambda r: r.isNotNull())})
    best = Window.partitionBy(doc).orderBy(F.desc("score"), "group_no")
    ranked = scored.withColumn("rank", F.row_number().over(best))
    return ranked.withColumn("authoritative", (F.col("rank") == 1) & (F.col("score") >= 3)).drop("__stated")


def discovery_report(documents: DataFrame, tables: DataFrame, candidates: DataFrame, stated: DataFrame, doc: str = "doc") -> DataFrame:
    """documents plus tables_detected, candidate_count, selected_id, rationale and stated_counts.

    documents has one row for each doc. The authoritative candidate is selected, else the one of the highest score; a document
    without candidates has none. stated_counts lists the counts with their pages, in order.
    """
    found = tables.groupBy(doc).agg(F.count("*").alias("tables_detected"))
    top = candidates.where("rank = 1").select(doc, "candidate_id", "caption", "page_start", "page_end", "score", "authoritative", "reasons")
    sums = candidates.groupBy(doc).agg(F.count("*").alias("candidate_count"))
    said = stated.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "stated"))), lambda s: F.concat(s["stated"].cast("string"), F.lit("@"), s["page"].cast("string"))), ", ").alias("stated_counts"))
    out = documents.join(found, doc, "left").join(sums, doc, "left").join(top, doc, "left").join(said, doc, "left")
    pages = F.concat(F.lit("pages "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))
    chosen = F.concat(F.col("caption"), F.lit(" ("), pages, F.lit(") is authoritative: "), F.array_join("reasons", "; "))
    rationale = F.when(F.col("authoritative"), chosen).when(F.col("candidate_id").isNotNull(), F.concat(F.col("caption"), F.lit(" has the highest score"))).otherwise("no candidates")
    return out.select(
        *documents.columns, F.coalesce("tables_detected", F.lit(0)).alias("tables_detected"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.col("candidate_id").alias("selected_id"),
        F.coalesce("authoritative", F.lit(False)).alias("authoritative"), rationale.alias("rationale"), F.coalesce("stated_counts", F.lit("")).alias("stated_counts"))


def document_type(text: Column) -> Column:
    """struct(type, confidence) of a document by the first rule that its text meets."""
    low = F.lower(text)

    def kind(name: str, sure: str) -> Column:
        return F.struct(F.lit(name).alias("type"), F.lit(sure).cast("decimal(4,2)").alias("confidence"))

    return (
        F.when(F.contains(low, F.lit("research report")), kind("research_report", "0.95"))
        .when(F.contains(low, F.lit("policy")) & F.contains(low, F.lit("framework")), kind("policy_document", "0.85"))
        .when(low.rlike("codebook|variable name"), kind("codebook", "0.90")).when(F.contains(low, F.lit("survey report")), kind("survey_report", "0.85"))
        .when(F.contains(low, F.lit("statistical")), kind("statistical_report", "0.85")).otherwise(kind("unknown", "0.40"))
    )


def unit_of_observation(headers: Column) -> Column:
    """What a row of a table stands for: the unit with the highest weighted count of signal words, at least 1.5."""
    text = F.lower(F.replace(headers, F.lit("_"), F.lit(" ")))
    scores = []
    for n, (unit, (weight, words)) in enumerate(K.UNIT_SIGNALS.items()):
        hits = sum((F.when(text.rlike(rf"\b{w}\b"), F.lit(weight).cast("decimal(4,1)")).otherwise(F.lit(0).cast("decimal(4,1)")) for w in words), F.lit(0).cast("decimal(4,1)"))
        bonus = {"occupation": F.contains(text, F.lit("ofo")), "qualification": F.contains(text, F.lit("nqf level"))}.get(unit)
        hits = hits + F.when(bonus, 4).otherwise(0).cast("decimal(4,1)") if bonus is not None else hits
        scores.append(F.struct(hits.cast("decimal(8,1)").alias("score"), F.lit(-n).alias("place"), F.lit(unit).alias("unit")))
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] >= 1.5, best["unit"]).otherwise("unknown")


def table_role(label: Column, unit: Column, section: Column | None = None) -> Column:
    """The role of a table by its caption, section title and headers, and by the kind of its section.

    In order: metadata, survey, final_dataset, appendix, intermediate_analysis, methodology, evidence, unknown.
    """
    low = F.lower(label)
    kind = F.coalesce(section, F.lit("")) if section is not None else F.lit("")
    role = F.lit("unknown")
    for semantic, name in reversed(K.SECTION_ROLES):
        role = F.when(kind == semantic, name).otherwise(role)
    return (
        F.when(low.rlike("|".join(K.METADATA_WORDS)), "metadata").when((unit == "survey_response") | low.rlike("|".join(K.SURVEY_WORDS)), "survey")
        .when(low.rlike("|".join(K.FINAL_WORDS)) & unit.isin("occupation", "qualification"), "final_dataset")
        .when((kind == "APPENDIX") | low.rlike("annexure|appendix"), "appendix").when(low.rlike("|".join(K.INTERMEDIATE_WORDS)), "intermediate_analysis").otherwise(role)
    )


def candidate_score(label: Column, role: Column, unit: Column, headers: Column, corroborated: Column) -> Column:
    """The score of a dataset candidate: wording, role, unit, a stated count that fits, and its columns."""
    low, heads = F.lower(label), F.lower(headers)
    d = "decimal(6,2)"

    def add(ok: Column, points: str) -> Column:
        return F.when(ok, F.lit(points).cast(d)).otherwise(F.lit(0).cast(d))

    return (
        add(low.rlike("final list|final oihd|occupations in high demand"), "4") + add(F.contains(low, F.lit("consolidation of evidence")), "2.5") + add(role == "final_dataset", "3")
        + add(unit == "occupation", "2") + add(unit == "qualification", "1.5") + add(unit == "survey_response", "-3") + add(corroborated, "5")
        + add(F.contains(heads, F.lit("ofo")) & F.contains(heads, F.lit("occupation")), "2") + add(role == "intermediate_analysis", "-2") + add(role == "survey", "-4")
        + add((role == "appendix") & ~F.contains(low, F.lit("final")), "-1.5")
    ).cast(d)


def authoritative(candidates: DataFrame, keys: list[str], score: str, order: str, least: float = 3.0) -> DataFrame:
    """The best candidate of each document, the first on ties, if its score is high enough."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    return candidates.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) & (F.col(score) >= least)).drop("__n")


def is_layout(rows: Column) -> Column:
    """Whether a grid (array of rows of cells) is a border or box: two cells, one text, or short boilerplate."""
    cells = F.flatten(rows)
    texts = F.filter(cells, lambda c: F.trim(c) != "")
    joined = F.lower(F.array_join(texts, " "))
    boiler = (F.size(rows) <= 3) & joined.rlike("© published in|isbn:|all rights reserved")
    return rows.isNull() | (F.size(rows) == 0) | (F.size(cells) <= 2) | (F.size(texts) <= 1) | boiler


def is_acronyms(rows: Column) -> Column:
    """Whether a grid lists acronyms: of its first ten rows, 70 % hold one and its words."""
    sample = F.slice(rows, 1, 10)
    hits = F.filter(sample, lambda r: (F.size(r) >= 2) & F.trim(F.get(r, F.lit(0))).rlike("^[A-Z0-9&-]{2,8}$") & F.trim(F.get(r, F.lit(1))).rlike(r"\S\s+\S"))
    return (F.size(F.get(rows, F.lit(0))) == 2) & (F.size(sample) > 0) & (F.size(hits) * 10 >= F.size(sample) * 7)


def is_footnote(cells: Column) -> Column:
    """Whether a row is a footnote or a running header."""
    texts = F.filter(cells, lambda c: F.trim(c) != "")
    joined = F.lower(F.array_join(texts, " "))
    running = joined.rlike("consolidation of evidence|technical research report|list of occupations in high demand") & (F.size(texts) <= 2)
    return (F.size(texts) == 0) | joined.rlike(r"^([0-9]+\s+)?(interquartile|upper outlier|source:|note:|footnote:)") | running


def repeats_header(cells: Column, headers: Column) -> Column:
    """Whether a row repeats a header: two of the header's names stand among its cells."""
    row = F.transform(cells, lambda c: F.lower(F.trim(c)))
    hits = F.filter(headers, lambda h: (F.trim(h) != "") & F.array_contains(row, F.lower(F.trim(h))))
    return F.size(hits) >= 2


def split_qualification(text: Column) -> Column:
    """struct(occupation, qualification): a merged cell cut where a kind of qualification begins."""
    kinds = "|".join(K.QUALIFICATION_WORDS)
    qualification = F.regexp_extract(text, rf"(?i)\b(({kinds}).*)$", 1)
    occupation = F.trim(F.substring(text, F.lit(1), F.length(text) - F.length(qualification)))
    return F.struct(
        F.when(qualification == "", text).otherwise(occupation).alias("occupation"), F.trim(F.regexp_replace(qualification, K.CELL_FOOTER, "")).alias("qualification"))


def records_from_lines(pages: DataFrame, keys: list[str], text: str = "text", code: str = "^[0-9]{4,6}") -> DataFrame:
    """(keys, record, body): lines that begin with a code start records, the lines below belong to them."""
    lines = pages.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("record", F.sum(F.col("line").rlike(code).cast("bigint")).over(w)).where("record > 0 and trim(line) <> ''")
    packed = marked.groupBy(*keys, "record").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return packed.select(*keys, "record", F.array_join(F.transform("l", lambda x: F.trim(x["line"])), " ").alias("body"))
