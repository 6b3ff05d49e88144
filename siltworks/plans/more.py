"""Further queries over document structure, schemas, ledgers and reports, registered beside those of slate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import curation, discovery, documents, duplicates, ledger, quality, relational, report, schema, validation
from ..sources import readers, writers
from . import records as R
from . import slate
from .slate import ORACLES, QUERIES, evaluated, query, quoted, table, validated

__all__ = ["ORACLES", "QUERIES"]

# ---- document structure ------------------------------------------------------------------------

#: Tops of pages; ~ is a line feed.
TOPS = [
    "PART I~Background of the study", "2.1 Survey data and methods", "ANNEXURE A~List of responses", "3 KEY FINDINGS", "Acknowledgements", "Just a line",
    "Table of Contents~1 INTRODUCTION", "2.1.3 Evidence of demand", "PART II~page 7", "APPENDIX 2: Survey questions~More", "7 THE LIST OF THE WHOLE PROVINCE", "3 KEY FINDINGS~3 KEY FINDINGS", "1.2 lower case",
    "Skills Audit Report~Authors~Ann Smith~Bo Lee~Department of Higher Education and Training 2021",
]
PAGES = f"""pg AS (SELECT conv_id AS doc, turn + 1 AS page, concat(replace({R._pick(TOPS, '(conv_id * 3 + turn)')}, '~', chr(10)), chr(10), coalesce(text, '')) AS text FROM conversations)"""


def paged(spark, sf):
    top = R._pick(TOPS, "(conv_id * 3 + turn)")
    return table(spark, sf, "conversations").selectExpr("conv_id AS doc", "turn + 1 AS page", f"concat(replace({top}, '~', chr(10)), chr(10), coalesce(text, '')) AS text")


def _match(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quoted([pattern])})"


_semantic = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '\\b({'|'.join(words)})\\b') THEN '{kind}'" for kind, words in K.HEADING_GROUPS) + " ELSE 'UNKNOWN' END"
_part, _annex, _front, _numbered, _major = (_match("s", p) for p in K.HEADING_PATTERNS)
_many = f"len(regexp_split_to_array(s, '\\s+')) > 4 AND page > 5 AND ({_match('s', K.RUNNING_HEADERS[0])} OR {_match('s', K.RUNNING_HEADERS[1])})"
SQL_HEADINGS = PAGES + rf""", ln AS (SELECT doc, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM pg),
tc AS (SELECT *, len(list_filter(l[1:3], lambda x: lower(x) IN ('table of contents', 'contents'))) > 0 AS toc FROM ln),
ins AS (SELECT *, toc OR (page <= 7 AND bool_or(toc) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING)) AS inside FROM tc),
ea AS (SELECT doc, page, i - 1 AS line, l[i] AS s, l[i + 1] AS nx FROM (SELECT *, unnest(range(1, least(len(l), 15) + 1)) AS i FROM ins WHERE NOT inside)),
hd AS (SELECT *, {_part} AS p1, {_annex} AS p2, {_front} AS p3, {_numbered} AS p4, {_major} AND NOT regexp_matches(lower(s), 'figure|table') AS p5 FROM ea WHERE NOT ({_many})),
ti AS (SELECT doc, page, line, CASE WHEN p1 THEN CASE WHEN nx IS NOT NULL AND NOT regexp_matches(lower(nx), 'part |annexure|page ') AND length(nx) < 100 THEN s || ': ' || nx ELSE s END
WHEN p2 THEN CASE WHEN nx IS NOT NULL AND NOT contains(s, ':') AND length(nx) < 120 THEN s || ': ' || nx ELSE s END ELSE s END AS title,
CASE WHEN p1 THEN 1 WHEN p2 THEN 4 WHEN p3 THEN 1 WHEN p4 THEN CASE WHEN length(s) - length(replace(s, '.', '')) = 1 THEN 2 ELSE 3 END ELSE 1 END AS level, p2 AND NOT p1 AS annex FROM hd WHERE p1 OR p2 OR p3 OR p4 OR p5),
al AS (SELECT doc, page, line, title, level, CASE WHEN annex THEN 'APPENDIX' ELSE {_semantic} END AS semantic_type FROM ti
UNION ALL SELECT doc, page, 0, 'Table of Contents', 1, 'FRONT_MATTER' FROM ins WHERE toc),
hs AS (SELECT doc, page, CAST(line AS INT) AS line, title, CAST(level AS INT) AS level, semantic_type FROM (SELECT *, lag(lower(title)) OVER w AS lt, lag(page) OVER w AS lp FROM al WINDOW w AS (PARTITION BY doc ORDER BY page, line)) WHERE lt IS NULL OR lt <> lower(title) OR lp <> page)"""
SQL_TREE = SQL_HEADINGS + """, tot AS (SELECT doc, max(page) AS pages FROM pg GROUP BY 1),
tr AS (SELECT doc, CAST(row_number() OVER w AS INT) AS section, title, level, semantic_type, page AS page_start, CASE WHEN lead(page) OVER w IS NULL THEN pages ELSE greatest(page, lead(page) OVER w - 1) END AS page_end
FROM hs JOIN tot USING (doc) WINDOW w AS (PARTITION BY doc ORDER BY page, line) UNION ALL SELECT doc, 0, 'Document Content', 1, 'GENERAL_CONTENT', 1, pages FROM tot WHERE doc NOT IN (SELECT doc FROM hs))"""


@query(f"WITH {SQL_HEADINGS} SELECT doc, page, line, title, level, semantic_type FROM hs")
def section_headings(spark, sf):
    return documents.headings(paged(spark, sf))


@query(f"WITH {SQL_TREE} SELECT doc, section, title, level, semantic_type, CAST(page_start AS BIGINT) AS page_start, CAST(page_end AS BIGINT) AS page_end FROM tr")
def section_tree(spark, sf):
    return documents.section_tree(paged(spark, sf)).withColumns({c: F.col(c).cast("bigint") for c in ("page_start", "page_end")})


_titles = ", ".join(f"nullif(trim(regexp_replace(regexp_extract(f, {quoted([p])}, 1), '\\s+', ' ', 'g')), '')" for p in K.TITLE_PATTERNS)
_publisher = "CASE " + " ".join(f"WHEN contains(f, '{a}') THEN '{b}'" for a, b in K.PUBLISHERS) + " END"
_authors = rf"nullif(array_to_string(list_filter(list_transform(string_split(regexp_extract(f, {quoted([K.AUTHOR_BLOCK])}, 1), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:3], ', '), '')"


@query(f"""WITH {SQL_TREE}, ag AS (SELECT doc, count(*) AS pages, CAST(sum(length(trim(text))) AS BIGINT) AS chars, arg_min(text, page) AS f FROM pg GROUP BY 1), sc AS (SELECT doc, count(*) AS sections, arg_min(title, section) AS first_section FROM tr GROUP BY 1)
SELECT doc, pages, chars, sections, first_section, coalesce({_titles}) AS title, {_publisher} AS publisher, nullif(regexp_extract(f, '\\b(20[0-9]{{2}})\\b', 1), '') AS publication_date, {_authors} AS author, chars < 100 AS scanned FROM ag LEFT JOIN sc USING (doc)""")
def document_profile(spark, sf):
    return documents.profile(paged(spark, sf))


CANDIDATES = """SELECT l_orderkey AS doc, concat('c', CAST(l_linenumber AS VARCHAR(9))) AS id, CAST(l_linenumber AS BIGINT) AS rank, CAST(l_discount * 10 AS DECIMAL(6,3)) AS score,
CASE WHEN l_orderkey % 5 = 0 THEN 'c2' END AS requested, CASE WHEN l_orderkey % 7 = 0 THEN 'c1' END AS authoritative, CAST(l_quantity / 50 AS DECIMAL(6,3)) AS structural FROM lineitem"""


def candidates(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("__lines")
    return spark.sql(CANDIDATES.replace("lineitem", "__lines"))


@query(f"""WITH c AS ({CANDIDATES}), t AS (SELECT doc, max(CASE WHEN id = coalesce(requested, authoritative) THEN id END) AS named, max(coalesce(requested, authoritative)) AS wish FROM c GROUP BY 1),
b AS (SELECT doc, id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, rank) AS n FROM c) WHERE n = 1)
SELECT doc, CASE WHEN wish IS NOT NULL THEN named WHEN score >= 0.75 THEN id END AS target FROM t JOIN b USING (doc)""")
def target_resolution(spark, sf):
    return documents.resolve_target(candidates(spark, sf))


@query(f"""WITH c AS ({CANDIDATES}) SELECT doc, id, CAST(round(CAST(least(greatest(structural, 0.40), 0.99) AS DECIMAL(9,3)), 2) AS DOUBLE) AS structural_confidence,
CAST(round(CAST(least(greatest(CAST(score AS DECIMAL(12,6)) * 0.1, 0.20), 0.99) AS DECIMAL(12,6)), 2) AS DOUBLE) AS semantic_confidence FROM c""")
def candidate_confidences(spark, sf):
    return candidates(spark, sf).select("doc", "id", *[c.cast("double").alias(k) for k, c in documents.confidences(F.col("structural"), F.col("score")).items()])


@query(f"WITH c AS ({CANDIDATES}) SELECT doc, count(*) AS n, string_agg(id || ':' || score::VARCHAR, ' ' ORDER BY score DESC, rank) AS ranked FROM c GROUP BY 1")
def discovery_report(spark, sf):
    row = F.struct((-F.col("score")).alias("s"), "rank", "id", "score")
    ranked = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.concat(x["id"], F.lit(":"), x["score"].cast("string")))
    return candidates(spark, sf).groupBy("doc").agg(F.count("*").alias("n"), F.array_join(ranked, " ").alias("ranked"))


# ---- schemas -----------------------------------------------------------------------------------

NAMES = ["saqa_id", "provider", "width", "ofo_code", "occupation_title", "nqf_level", "province", "amount", "notes", "demand_rank", "reg_no", "min_age", "city", "share", "indicator", "company", "variable", "programme", "entry_level", "first_year"]
COLS = f"SELECT p_partkey AS position, concat('t', CAST(p_partkey % 97 AS VARCHAR(9))) AS dataset_id, {R._pick(NAMES, '(p_partkey * 7 + p_size)')} AS name, CASE WHEN p_partkey % 97 % 9 = 0 THEN 'codebook one' ELSE 'plain' END AS schema_name FROM part"


def columns(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("__parts")
    return spark.sql(COLS.replace("FROM part", "FROM __parts"))


def _parts(c: str, parts: list[str]) -> str:
    return f"regexp_matches(lower({c}), '{'|'.join(parts)}')"


_role = "CASE " + " ".join(f"WHEN {_parts('name', p)} THEN '{k}'" for k, p in K.COLUMN_ROLES) + " ELSE 'general' END"


@query(f"WITH c AS ({COLS}) SELECT position, name, {_parts('name', K.FORCED_STRINGS)} AS forced_string, {_parts('name', K.REQUIRED_PARTS)} AS required, {_role} AS role, 'SOURCE_FACT' AS authority FROM c")
def column_rules(spark, sf):
    return schema.column_rules(columns(spark, sf)).drop("dataset_id", "schema_name")


_units = " ".join(
    f"WHEN bool_or({_parts('name', a)}{' OR ' + _parts('schema_name', b) if b else ''}){' AND count(*) <= 5' if b is None else ''} THEN '{u}'" for a, b, u in K.DATASET_UNITS)


@query(f"WITH c AS ({COLS}) SELECT dataset_id, CASE {_units} ELSE array_to_string(list_transform(string_split(arg_min(name, position), '_'), lambda w: upper(w[1]) || w[2:]), ' ') END AS unit FROM c GROUP BY 1")
def dataset_units(spark, sf):
    return schema.dataset_units(columns(spark, sf))


HEADERS = ["Learning Programme", "SAQA", "Sub-framework", "NQF Level", "Funded", "TVET College"]
GRID = f"""SELECT p_partkey AS row_index, CAST(p_partkey % 40 AS BIGINT) AS table_id, CASE p_partkey % 11 WHEN 4 THEN '' WHEN 7 THEN 'Learning Programme' ELSE {R._pick(R.TITLES, 'p_partkey')} END AS c0,
CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 31 = 5 THEN 'no. 12' WHEN p_partkey % 11 = 7 THEN 'SAQA' ELSE CAST(90000 + p_partkey AS VARCHAR(19)) END AS c1,
CASE p_partkey % 2 WHEN 0 THEN 'OQSF' ELSE '' END AS c2, {R._pick(R.LEVELS, 'p_partkey')} AS c3, CASE p_partkey % 4 WHEN 0 THEN 'Yes' ELSE '' END AS c4, {R._pick(R.COLLEGES, 'p_partkey')} AS c5 FROM part"""


def grid(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("__parts")
    df = spark.sql(GRID.replace("FROM part", "FROM __parts"))
    return df.select("row_index", "table_id", F.array(*[f"c{i}" for i in range(6)]).alias("cells"))


@query(f"WITH g AS ({GRID}) SELECT row_index, c1 AS saqa_id, c0 AS qualification, c3 AS nqf_level, c5 AS colleges, c2 AS framework, c4 AS nsfas FROM g")
def row_mapping(spark, sf):
    wanted = ["saqa_id", "qualification", "nqf_level", "colleges", "framework", "nsfas"]
    mapping = schema.map_columns(["Learning Programme", "SAQA ID", "Sub-framework", "NQF Level", "Funded by", "TVET College"], wanted)
    return schema.mapped_rows(grid(spark, sf).select("row_index", "cells"), mapping).select("row_index", *wanted)


@query(f"""WITH g AS ({GRID}), k AS (SELECT *, trim(regexp_replace(regexp_replace(c5, '[\\r\\n•·]+', '; ', 'g'), '\\s*;\\s*', '; ', 'g')) AS col, regexp_matches(c1, '[0-9]{{4,7}}') AS st FROM g),
n AS (SELECT *, sum(st::INT) OVER (PARTITION BY table_id ORDER BY row_index ROWS UNBOUNDED PRECEDING) AS n FROM k)
SELECT table_id, min(row_index) AS row_index, max(c1) FILTER (st) AS saqa_id, coalesce(string_agg(c0, ' ' ORDER BY row_index) FILTER (c0 <> ''), '') AS qualification, max(c3) FILTER (st) AS nqf_level,
max(c2) FILTER (st) AS framework, coalesce(nullif(max(c4) FILTER (st), ''), 'No') AS nsfas_eligible, coalesce(string_agg(col, '; ' ORDER BY row_index) FILTER (col <> ''), '') AS participating_colleges FROM n WHERE n > 0 GROUP BY table_id, n""")
def qualification_list(spark, sf):
    return schema.qualification_list(grid(spark, sf), HEADERS)


JOBS = f"""SELECT p_partkey AS row_index, CAST(p_partkey % 25 AS BIGINT) AS table_id, {R._pick(R.CODES, 'p_partkey')} AS c0, {R._pick(R.TITLES, 'p_partkey')} AS c1, CASE p_partkey % 3 WHEN 0 THEN '' ELSE '2' END AS c2,
{R._pick(R.REGIONS, 'p_partkey')} AS c3 FROM part"""


@query(f"""WITH g AS ({JOBS}), n AS (SELECT *, regexp_matches(c0, '^[0-9]{{4,6}}$') AS st, sum(regexp_matches(c0, '^[0-9]{{4,6}}$')::INT) OVER (PARTITION BY table_id ORDER BY row_index ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT table_id, min(row_index) AS row_index, max(c0) FILTER (st) AS ofo_code, coalesce(string_agg(c1, ' ' ORDER BY row_index) FILTER (c1 <> ''), '') AS occupation_title, coalesce(nullif(max(c2) FILTER (st), ''), '1') AS demand_rank,
'' AS major_group, coalesce(nullif(max(c3) FILTER (st), ''), 'National') AS province, '' AS educational_qualification_req FROM n WHERE n > 0 GROUP BY table_id, n""")
def occupation_list(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("__parts")
    rows = spark.sql(JOBS.replace("FROM part", "FROM __parts")).select("row_index", "table_id", F.array("c0", "c1", "c2", "c3").alias("cells"))
    return schema.occupation_list(rows, ["OFO Code", "Occupation", "Rank", "Province"])


CODEBOOKS = ["age|Age of person|1|young~2|old~x|y", "text only", "sex | Sex | 1 | male~2|female|more~~n|a|b|c~9|z", "7|before any variable~a|b|1|one", ""]


@query(f"""WITH b AS (SELECT p_partkey AS page, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT p_partkey, string_split(replace({R._pick(CODEBOOKS, 'p_partkey')}, '~', chr(10)), chr(10)) AS l FROM part)),
c AS (SELECT page, i - 1 AS line, list_filter(list_transform(string_split(l[i], '|'), lambda x: trim(x)), lambda x: x <> '') AS c FROM b),
v AS (SELECT *, last_value(CASE WHEN len(c) >= 4 THEN c[1] END IGNORE NULLS) OVER w AS variable, last_value(CASE WHEN len(c) >= 4 THEN c[2] END IGNORE NULLS) OVER w AS label FROM c WINDOW w AS (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING))
SELECT page, CAST(line AS INT) AS line, variable, label, CASE WHEN len(c) >= 4 THEN c[3] ELSE c[1] END AS value, CASE WHEN len(c) >= 4 THEN c[4] ELSE c[2] END AS value_label FROM v WHERE len(c) >= 4 OR (len(c) >= 2 AND variable IS NOT NULL AND regexp_matches(c[1], '^[0-9]+$'))""")
def codebook_lines(spark, sf):
    text = F.expr(f"replace({R._pick(CODEBOOKS, 'p_partkey')}, '~', chr(10))")
    return schema.codebook_lines(table(spark, sf, "part").select(F.col("p_partkey").alias("page"), text.alias("text")))


@query(f"""WITH g AS ({GRID}), f AS (SELECT *, count(*) OVER w AS n, sum((lower(trim(c0)) IN ('', 'none'))::INT) OVER w AS e FROM g WINDOW w AS (PARTITION BY table_id)),
k AS (SELECT *, list_filter([lower(trim(c0)), lower(trim(c1)), lower(c2), lower(c3), lower(c4), lower(trim(regexp_replace(c5, '\\s+', ' ', 'g')))], lambda x: x <> '') AS r FROM f)
SELECT row_index, table_id, n > 10 AND e * 100 >= n * 35 AS shaded, CAST(row_number() OVER (PARTITION BY table_id ORDER BY row_index) AS INT) AS new_index, CAST(0.92 AS DOUBLE) AS confidence
FROM k WHERE NOT (len(list_filter(r, lambda c: len(list_filter(['learning programme', 'saqa', 'sub-framework', 'nqf level', 'funded', 'tvet college'], lambda h: contains(h, c) OR contains(c, h))) > 0)) * 2 >= 6) AND len(r) > 0""")
def grid_rebuilt(spark, sf):
    return schema.rebuilt_grid(grid(spark, sf), HEADERS).select("row_index", "table_id", "shaded", "new_index", "confidence")


@query(f"""WITH h AS (SELECT p_partkey AS id, {R._pick(['Title|OFO Code|x', 'a|b|Number', 'Width|Paid', 'No.|Name', 'ID'], 'p_partkey')} AS h FROM part),
l AS (SELECT id, list_transform(string_split(h, '|'), lambda x: regexp_matches(lower(x), '\\b(saqa|ofo|code|id|number|no\\.?)\\b')) AS l FROM h) SELECT id, CAST(greatest(coalesce(list_position(l, true), 0) - 1, 0) AS BIGINT) AS id_column FROM l""")
def id_columns(spark, sf):
    h = F.split(F.expr(R._pick(["Title|OFO Code|x", "a|b|Number", "Width|Paid", "No.|Name", "ID"], "p_partkey")), r"\|")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), schema.id_column(h).cast("bigint").alias("id_column"))


@query("""SELECT p_partkey AS id, trim(p_brand || ' ' || p_type) || '|' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS merged FROM part""")
def ragged_merge(spark, sf):
    long = F.when(F.col("p_size") % 2 == 0, F.array("p_type", "p_name")).otherwise(F.array("p_type", F.lit("")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(schema.merged_cells(F.array("p_brand"), long), "|").alias("merged"))


@query(f"WITH {R.SQL} SELECT row_index, coalesce(CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(company_name) <> '' THEN company_name END, CASE WHEN trim(province) <> '' THEN province END, '') AS title FROM r")
def title_fallback(spark, sf):
    return R.records(spark, sf).select("row_index", schema.title_of([F.col("title"), F.col("company_name"), F.col("province")]).alias("title"))


# ---- qualification tables ----------------------------------------------------------------------

QUALS = """q AS (SELECT row_index, pk AS saqa_id, CASE WHEN row_index % 6 = 0 THEN title || ' Qualification no: ' || row_index::VARCHAR WHEN row_index % 13 = 0 THEN title || ' (DSPP)' ELSE title END AS title, nqf, CASE row_index % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE '' END AS nsfas, colleges FROM r)"""


def qualifications(spark, sf):
    r = R.records(spark, sf)
    title = F.expr("CASE WHEN row_index % 6 = 0 THEN concat(title, ' Qualification no: ', row_index) WHEN row_index % 13 = 0 THEN concat(title, ' (DSPP)') ELSE title END")
    nsfas = F.expr("CASE row_index % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE '' END")
    return relational.qualification_tables(r.select("row_index", F.col("pk").alias("saqa_id"), title.alias("title"), "nqf", nsfas.alias("nsfas"), "colleges"))


@query(f"""WITH {R.SQL}, {QUALS} SELECT row_index, saqa_id, nullif(regexp_extract(title, '(?i)qual(?:ification)?\\s*(?:no|number|#)?\\s*:?\\s*([0-9]+)', 1), '') AS qualification_number,
trim(regexp_replace(title, '\\s+', ' ', 'g')) AS qualification_name, title AS qualification_name_raw, CASE WHEN try_cast(regexp_extract(nqf, '[0-9]+') AS BIGINT) BETWEEN 1 AND 10 THEN try_cast(regexp_extract(nqf, '[0-9]+') AS INT) END AS nqf_level,
CASE WHEN nsfas = 'Yes' THEN 'Eligible' ELSE 'Not Eligible' END AS nsfas_allowance FROM q""")
def qualification_rows(spark, sf):
    return qualifications(spark, sf)["qualifications"]


@query(f"""WITH {slate.SQL_DIM} SELECT 'COL-' || CASE WHEN length(item_id) = 8 AND substr(item_id, 5, 1) = '0' THEN substr(item_id, 6) ELSE substr(item_id, 5) END AS college_id, item AS college_name, NOT (regexp_matches(item, '(?i)college|tvet|campus|centre') AND length(item) >= 5) AS is_variant FROM dm""")
def qualification_colleges(spark, sf):
    return qualifications(spark, sf)["colleges"]


@query(f"WITH {R.SQL}, {QUALS} SELECT row_index, saqa_id, title, colleges FROM q WHERE regexp_matches(lower(title), 'dspp|centre of specialisation')")
def qualification_centres(spark, sf):
    return qualifications(spark, sf)["centres"]


# ---- rules, gates and duplicates ---------------------------------------------------------------

@query(f"WITH {slate.SQL_SCORED} SELECT row_index, CASE WHEN exclusion IS NOT NULL THEN 'EXCLUDE' WHEN ambiguous THEN 'REVIEW' WHEN score >= 0.85 THEN 'INCLUDE' WHEN score < 0.55 THEN 'EXCLUDE' ELSE 'REVIEW' END AS suggested FROM scored")
def suggested_decisions(spark, sf):
    return report.suggested_decision(evaluated(spark, sf)).select("row_index", "suggested")


_tests = {
    "sector": "technical", "classification": "coalesce(major_code, '') IN ('2','3','6','7')", "context": "(technical OR coalesce(major_code, '') IN ('6','7'))", "process": "process",
    "source": "company_name <> ''",
}
_family = {rule: family for family, rules in K.RULE_FAMILIES.items() for rule in rules}


def _policy_sql(name: str) -> str:
    rules = [(w, _tests[_family[r]]) for r, w in K.POLICIES[name][2] if r in _family]
    score = " + ".join(f"CASE WHEN {test} THEN {w} ELSE 0.00 END" for w, test in rules)
    return f"SELECT row_index, '{name}' AS policy, CAST(CASE WHEN exclusion IS NOT NULL THEN 0 ELSE {score} END AS DOUBLE) AS score FROM judged"


@query(f"WITH {slate.SQL_JUDGED} " + " UNION ALL ".join(_policy_sql(p) for p in K.POLICIES))
def policy_scores(spark, sf):
    judged = curation.judge_titles(curation.resolve_taxonomy(R.records(spark, sf)))
    out = None
    for name in K.POLICIES:
        scored = curation.score_rules(judged, name, "company_name").select("row_index", F.lit(name).alias("policy"), F.col("score").cast("double").alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


FIELDS = """SELECT p_partkey AS row_index, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '12' WHEN 2 THEN 'SAQA 99' ELSE CAST(10000 + p_partkey AS VARCHAR(19)) END AS saqa_id,
CASE p_partkey % 4 WHEN 0 THEN '2021' WHEN 1 THEN '1850' WHEN 2 THEN 'next year' ELSE NULL END AS intake_year, CASE p_partkey % 6 WHEN 0 THEN '12' WHEN 1 THEN '-4' WHEN 2 THEN '1.5' WHEN 3 THEN 'True' WHEN 4 THEN '' ELSE '1e3' END AS seats FROM part"""


@query(f"""WITH f AS ({FIELDS}) SELECT row_index, 'saqa_id' AS "column", 'required' AS rule, 'error' AS severity FROM f WHERE saqa_id = '' UNION ALL SELECT row_index, 'saqa_id', 'saqa_id', 'error' FROM f WHERE saqa_id <> '' AND NOT regexp_matches(saqa_id, '^[0-9]{{4,7}}$')
UNION ALL SELECT row_index, 'intake_year', 'year', 'warning' FROM f WHERE NOT regexp_matches(intake_year, '^(19|20)[0-9]{{2}}$') UNION ALL SELECT row_index, 'seats', 'integer', 'warning' FROM f WHERE seats <> '' AND NOT regexp_matches(seats, '^[+-]?[0-9]+$')""")
def validate_fields(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("__parts")
    rows = spark.sql(FIELDS.replace("FROM part", "FROM __parts"))
    checked = validation.validate(rows, [("saqa_id", True, "string"), ("intake_year", False, "string"), ("seats", False, "integer")])
    return validation.issue_rows(checked, "row_index")


_off = _parts("coalesce(title, '')", K.OFFLINE_TITLES)


@query(f"""WITH {slate.SQL_DECIDED}, o AS (SELECT *, {_off} AS hit FROM decided) SELECT row_index, CASE WHEN hit THEN 'INCLUDE' ELSE 'REVIEW' END AS offline_decision, CAST(CASE WHEN hit THEN 0.88 ELSE 0.65 END AS DOUBLE) AS offline_confidence,
CAST(round(CAST(CAST(curation_confidence + CASE WHEN hit THEN 0.880 ELSE 0.650 END AS DECIMAL(9,3)) * 0.5 AS DECIMAL(12,6)), 3) AS DOUBLE) AS blended FROM o""")
def offline_blend(spark, sf):
    made = evaluated(spark, sf).withColumns(report.offline_relevance(F.col("title")))
    blend = report.blended(F.col("curation_confidence"), F.col("offline_confidence"))
    return made.select("row_index", "offline_decision", "offline_confidence", blend.cast("double").alias("blended"))


@query(f"""WITH {slate.SQL_DECIDED} SELECT row_index, decision, CASE WHEN decision = 'INCLUDE' THEN 'score ' || score::VARCHAR END AS why, CASE WHEN decision <> 'INCLUDE' THEN coalesce(exclusion, reason_code, 'score ' || score::VARCHAR) END AS why_not,
'DETERMINISTIC_RULES' AS method, coalesce(unit_code, '-') || '|' || coalesce(major_code, '-') || '|' || array_to_string(all_chambers, '; ') AS derived, curation_confidence::VARCHAR || '|' || overall_confidence::VARCHAR || '|' || status AS confidences FROM decided""")
def explanations(spark, sf):
    return report.explained(evaluated(spark, sf))


#: The names of each dataset's columns.
OWN = f"SELECT concat('ds', CAST(p_size % 4 AS VARCHAR(9))) AS dataset_id, CASE p_size % 4 WHEN 3 THEN concat('column_', CAST(p_partkey % 2 + 1 AS VARCHAR(9))) WHEN 2 THEN concat('column_', CAST(p_partkey % 3 + 1 AS VARCHAR(9))) ELSE {R._pick(NAMES, 'p_partkey')} END AS name FROM part"


@query(f"""WITH {slate.SQL_COUNTS}, g AS (SELECT *, dataset_id <> 'ds1' AS known, dataset_id <> 'ds2' AS found, dataset_id IN (SELECT dataset_id FROM ({OWN}) GROUP BY 1 HAVING count(DISTINCT name) <= 2 AND bool_or(starts_with(name, 'column_'))) AS generic, dataset_id <> 'ds0' AS processed FROM counts), {slate._dims('g').replace('dims AS', 'dm AS')}
SELECT dataset_id, CASE WHEN known THEN 'passed' ELSE 'failed' END AS document_understanding_gate, CASE WHEN known THEN 'passed' ELSE 'failed' END AS extraction_gate, CASE WHEN found THEN 'passed' ELSE 'failed' END AS dataset_identification_gate,
CASE WHEN generic THEN 'failed' ELSE 'passed' END AS schema_gate, CASE WHEN processed THEN 'passed' ELSE 'pending' END AS evidence_gate,
concat_ws('; ', CASE WHEN NOT known THEN 'document not understood' END, CASE WHEN NOT found THEN 'dataset not identified' END, CASE WHEN generic THEN 'generic column names' END, CASE WHEN errors > 0 THEN errors::VARCHAR || ' errors' END,
CASE WHEN NOT processed THEN 'not curated' WHEN review > 0 THEN review::VARCHAR || ' for review' END, CASE WHEN errors + conflicts > 0 THEN (errors + conflicts)::VARCHAR || ' critical' END) AS reasons FROM dm""")
def quality_gates_full(spark, sf):
    flags = {"profile_valid": "ds1", "dataset_identified": "ds2", "processed": "ds0"}
    table(spark, sf, "part").createOrReplaceTempView("__parts")
    generic = quality.generic_columns(spark.sql(OWN.replace("FROM part", "FROM __parts")))
    counts = slate._counts(spark, sf).withColumns({k: F.col("dataset_id") != v for k, v in flags.items()}).join(generic, "dataset_id", "left").fillna(False, ["generic_columns"])
    return quality.gates(quality.dimensions(counts)).select("dataset_id", "document_understanding_gate", "extraction_gate", "dataset_identification_gate", "schema_gate", "evidence_gate", "reasons")


@query(f"WITH {slate.SQL_DECIDED} SELECT dataset_id, count(*) AS total, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (decision = 'REVIEW' OR status = 'warning') AS review FROM decided GROUP BY 1")
def gate_recount(spark, sf):
    e = evaluated(spark, sf)
    return e.groupBy("dataset_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if((F.col("decision") == "REVIEW") | (F.col("status") == "warning")).alias("review"))


@query(f"WITH {R.SQL}, {slate.SQL_STATUS} SELECT dataset_id, greatest(0.0, least(100.0, round(100.0 - (count(*) FILTER (status = 'error') * CAST(1.5 AS DOUBLE) + count(*) FILTER (status = 'warning') * CAST(0.5 AS DOUBLE)) / count(*) * 100, 1)))::DOUBLE AS score FROM st GROUP BY 1")
def legacy_scores(spark, sf):
    v = validated(spark, sf).groupBy("dataset_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("e"), F.count_if(F.col("status") == "warning").alias("w"))
    return v.select("dataset_id", report.legacy_score(F.col("n"), F.col("e"), F.col("w")).alias("score"))


SQL_NAMES = """w AS (SELECT p_partkey AS k, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part),
pr AS (SELECT a.k AS i, b.k AS j, 'POSSIBLE_SEMANTIC_DUPLICATE' AS duplicate_type FROM w a JOIN w b ON b.k > a.k AND b.k < a.k + 50 AND b.k // 50 IN (a.k // 50, a.k // 50 + 1)
WHERE len(list_intersect(a.w, b.w)) * 2 >= len(list_distinct(list_concat(a.w, b.w))))"""


def flags(spark, sf):
    pairs = slate.dup_pairs_jaccard(spark, sf).select("i", "j", F.lit("POSSIBLE_SEMANTIC_DUPLICATE").alias("duplicate_type"))
    return pairs, duplicates.structural(R.records(spark, sf), "pk")


@query(f"WITH {R.SQL}, {slate.SQL_FLAGS}, {SQL_NAMES} SELECT duplicate_type, count(*) AS n FROM (SELECT duplicate_type FROM pr UNION ALL SELECT 'STRUCTURAL_DUPLICATE' FROM fl) GROUP BY 1")
def dup_class_counts(spark, sf):
    return duplicates.class_counts(*flags(spark, sf))


@query(f"WITH {R.SQL}, {slate.SQL_FLAGS}, {SQL_NAMES} SELECT row_index, arg_max(t, a) AS duplicate_type FROM (SELECT j AS row_index, duplicate_type AS t, i AS a FROM pr UNION ALL SELECT row_index, 'STRUCTURAL_DUPLICATE', -1 FROM fl) GROUP BY 1")
def dup_last_flag(spark, sf):
    return duplicates.last_flag(*flags(spark, sf))


# ---- reports -----------------------------------------------------------------------------------

@query(f"WITH {R.SQL} SELECT dataset_id, array_to_string(list_sort(list(DISTINCT company_name)), '|') AS sources, count(DISTINCT row_index // 40) AS pages, min(row_index // 40) AS first_page, max(row_index // 40) AS last_page FROM r GROUP BY 1")
def dataset_sources(spark, sf):
    r = R.records(spark, sf).withColumn("page", F.expr("row_index div 40"))
    return report.sources(r, "dataset_id", "page", "company_name")


@query(f"""WITH {R.SQL}, s AS (SELECT row_index, 'title' AS "column", title AS raw, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS normalised FROM r UNION ALL SELECT row_index, 'amount', amount, trim(regexp_replace(amount, '^0+', '')) FROM r)
SELECT row_index, "column", raw, normalised FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_index) AS n FROM s WHERE raw IS DISTINCT FROM normalised) WHERE n <= 5""")
def changed_samples(spark, sf):
    pairs = {"title": (F.col("title"), X.collapse(F.col("title"))), "amount": (F.col("amount"), F.trim(F.regexp_replace("amount", "^0+", "")))}
    return report.changed_samples(R.records(spark, sf), pairs)


SQL_LINES = slate.SQL_DECIDED + """, rl AS (SELECT dataset_id, row_index, trim(coalesce(title, '')) || ' -> ' || coalesce(unit_code, major_code, 'none') AS line FROM (SELECT *, bool_or(decision = 'INCLUDE') OVER (PARTITION BY dataset_id) AS any_kept,
row_number() OVER (PARTITION BY dataset_id, decision = 'INCLUDE' ORDER BY row_index) AS n FROM decided) WHERE (decision = 'INCLUDE' AND n <= 25) OR (NOT any_kept AND n <= 20))"""


@query(f"WITH {SQL_LINES} SELECT dataset_id, row_index, line FROM rl")
def relation_lines(spark, sf):
    return report.relation_lines(evaluated(spark, sf))


@query(f"""WITH {SQL_LINES}, sm AS (SELECT dataset_id, '# ' || dataset_id || chr(10) || 'records: ' || count(*) || chr(10) || 'included: ' || count(*) FILTER (decision = 'INCLUDE') || chr(10) || 'excluded: ' || count(*) FILTER (decision = 'EXCLUDE') || chr(10) || 'review: ' || count(*) FILTER (decision = 'REVIEW') || chr(10) AS h FROM decided GROUP BY 1),
b AS (SELECT dataset_id, h || coalesce((SELECT string_agg(line, chr(10) ORDER BY row_index) FROM rl WHERE rl.dataset_id = sm.dataset_id), '') AS body FROM sm) SELECT dataset_id, body, sha256(body) AS sha256 FROM b""")
def knowledge_report(spark, sf):
    return report.report(evaluated(spark, sf))


@query(f"""WITH e AS ({ORACLES['evidence_items']}) SELECT row_index, string_agg(claim, '|' ORDER BY confidence DESC, evidence_type, claim) AS claims FROM e GROUP BY 1""")
def evidence_by_record(spark, sf):
    return report.evidence_by_record(curation.evidence(evaluated(spark, sf)))


# ---- ledgers -----------------------------------------------------------------------------------

@query(f"""WITH {R.SQL}, {slate.SQL_STATUS} SELECT row_index, CASE row_index % 5 WHEN 0 THEN 'human_reviewed' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE status END AS status FROM st""")
def review_actions(spark, sf):
    v = validated(spark, sf).select("row_index", "status")
    actions = F.expr("CASE row_index % 5 WHEN 0 THEN 'approve_record' WHEN 1 THEN 'reject_record' WHEN 2 THEN 'flag_record' WHEN 3 THEN 'comment' END")
    asked = v.select("row_index", actions.alias("action"), F.lit(2).alias("seq")).unionByName(v.select("row_index", F.lit("reject_record").alias("action"), F.lit(1).alias("seq")).where("row_index % 5 <> 4"))
    return ledger.apply_reviews(v, asked, "row_index")


@query(f"""WITH {R.SQL}, e AS (SELECT row_index, CASE WHEN row_index % 2 = 0 THEN 'new title' END AS t, CASE WHEN row_index % 3 = 0 THEN province END AS p, title, province FROM r WHERE row_index % 4 <> 1),
a AS (SELECT row_index, 'title' AS field, title AS old_value, t AS new_value FROM e WHERE t IS NOT NULL AND t <> title) SELECT * FROM a UNION ALL SELECT row_index, 'record', NULL, NULL FROM e WHERE row_index NOT IN (SELECT row_index FROM a)""")
def record_edits(spark, sf):
    r = R.records(spark, sf).select("row_index", "title", "province", F.lit("valid").alias("status"))
    edits = r.where("row_index % 4 <> 1").selectExpr("row_index", "CASE WHEN row_index % 2 = 0 THEN 'new title' END AS title", "CASE WHEN row_index % 3 = 0 THEN province END AS province")
    return ledger.edit_records(r, edits, "row_index", ["title", "province"])[1]


@query(f"""WITH {R.SQL}, {slate.SQL_ISSUES} SELECT row_index, "column", rule, row_index % 3 = 0 AS resolved, CASE WHEN row_index % 6 = 0 THEN 'fixed' END AS fix FROM iss""")
def issue_resolution(spark, sf):
    found = validation.issue_rows(validated(spark, sf), "row_index").select("row_index", "column", "rule")
    made = found.where("row_index % 3 = 0").select("row_index", "column").distinct().withColumn("fix", F.expr("CASE WHEN row_index % 6 = 0 THEN 'fixed' END"))
    return ledger.resolve_issues(found, made)


@query(f"WITH {R.SQL}, {slate.SQL_ISSUES} SELECT s AS severity, count(i.severity) AS n FROM (VALUES ('error'), ('warning'), ('info')) x(s) LEFT JOIN (SELECT severity FROM iss WHERE severity = 'error') i ON s = severity GROUP BY 1")
def severity_counts(spark, sf):
    return ledger.severity_counts(validation.issue_rows(validated(spark, sf), "row_index").where("severity = 'error'"))


@query(f"WITH {R.SQL} SELECT dataset_id, count(*) FILTER (row_index % 3 <> 0 AND dataset_id <> 'ds2') AS n FROM r GROUP BY 1")
def delete_recount(spark, sf):
    r = R.records(spark, sf)
    return ledger.without_deleted(r, r.where("row_index % 3 = 0 or dataset_id = 'ds2'"), "row_index")[1]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 4 <> 0")
def delete_cascade(spark, sf):
    gone = table(spark, sf, "customer").where("c_custkey % 4 = 0").withColumnRenamed("c_custkey", "o_custkey")
    return ledger.cascade(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("""WITH s AS (SELECT n_nationkey % 7 AS policy_id, arg_max(n_name, n_nationkey) AS name FROM nation WHERE n_nationkey % 7 > 2 GROUP BY 1)
SELECT policy_id, name, true AS stored FROM s UNION ALL SELECT r_regionkey, r_name, false FROM region WHERE r_regionkey NOT IN (SELECT policy_id FROM s)""")
def policy_list(spark, sf):
    stored = table(spark, sf, "nation").where("n_nationkey % 7 > 2").selectExpr("n_nationkey % 7 AS policy_id", "n_name AS name", "n_nationkey AS seq")
    return ledger.policies(table(spark, sf, "region").selectExpr("r_regionkey AS policy_id", "r_name AS name"), stored)


@query("SELECT user_id AS intent_id, value, seq FROM (SELECT user_id, value, event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, event_id % 3 = 0 AS gone FROM events) WHERE n = 1 AND NOT gone")
def intent_list(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id AS intent_id", "value", "event_id AS seq", "if(event_id % 3 = 0, 'delete', 'save') AS action")
    return ledger.intents(e)


OVERRIDDEN = f"""WITH {slate.SQL_DECIDED}, o AS (SELECT row_index, 'INCLUDE' AS d, 'checked ' || row_index::VARCHAR AS reason, CASE WHEN row_index % 2 = 0 THEN 'Corrected' END AS fixed FROM decided WHERE row_index % 7 = 0)"""


def overridden(spark, sf):
    e = evaluated(spark, sf).select("row_index", "decision", "title")
    made = e.where("row_index % 7 = 0").selectExpr("row_index", "'INCLUDE' AS decision", "concat('checked ', row_index) AS reason", "CASE WHEN row_index % 2 = 0 THEN 'Corrected' END AS title")
    return ledger.override(e, made, "row_index", ["title"])


@query(f"{OVERRIDDEN} SELECT row_index, decision AS old_decision, d AS new_decision, reason FROM decided JOIN o USING (row_index)")
def override_ledger(spark, sf):
    return overridden(spark, sf)["ledger"]


@query(f"{OVERRIDDEN} SELECT row_index, 'HUMAN_OVERRIDE' AS evidence_type, reason AS claim, CAST(1 AS DOUBLE) AS confidence FROM o")
def override_evidence(spark, sf):
    return overridden(spark, sf)["evidence"]


@query(f"{OVERRIDDEN} SELECT row_index, 'decision' AS field, decision AS old_value, d AS new_value FROM decided JOIN o USING (row_index) WHERE decision <> d UNION ALL SELECT row_index, 'title', title, fixed FROM decided JOIN o USING (row_index) WHERE fixed IS NOT NULL AND title IS DISTINCT FROM fixed")
def override_audit(spark, sf):
    return overridden(spark, sf)["audit"]


@query(f"""WITH q AS ({ORACLES['review_queue']}), e AS ({ORACLES['evidence_items']}), t AS (SELECT row_index, string_agg(claim, '|' ORDER BY n) AS claims FROM (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY confidence DESC, evidence_type, claim) AS n FROM e) WHERE n <= 3 GROUP BY 1)
SELECT q.row_index, rank, coalesce(claims, '') AS claims FROM q LEFT JOIN t ON q.row_index = t.row_index""")
def review_evidence(spark, sf):
    queue = slate.review_queue(spark, sf).select("row_index", "rank")
    top = report.evidence_by_record(curation.evidence(evaluated(spark, sf)), 3)
    return queue.join(top, "row_index", "left").fillna("", ["claims"])


# ---- sources and sinks -------------------------------------------------------------------------

@query("""WITH t AS (SELECT doc_id, lower(concat_ws(' ', source, text)) AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(t, 'qualification|tvet|saqa') THEN 'qualifications' WHEN regexp_matches(t, 'occupation|ofo|oihd') THEN 'occupations'
WHEN regexp_matches(t, 'codebook|survey|qlfs') THEN 'codebook' ELSE 'generic' END AS kind FROM t""")
def document_kinds(spark, sf):
    return table(spark, sf, "documents").select("doc_id", readers.document_kind(F.col("source"), F.col("text")).alias("kind"))


@query("SELECT conv_id, turn AS page_number FROM conversations WHERE turn BETWEEN 1 AND 3")
def page_range(spark, sf):
    return readers.pages_between(table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("page_number")), 1, 3)


@query("SELECT conv_id, turn, substr(coalesce(text, ''), 1, 300) AS preview, pages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS pages FROM conversations) WHERE n <= 5")
def page_previews(spark, sf):
    return readers.previews(table(spark, sf, "conversations"), "conv_id", "turn", "text")


GRIDS = [
    [["ABC", "Some words here"], ["XY", "Other words"], ["Q-1", "More words yet"]], [["x", ""]], [["\u00a9 Published in 2020", "", ""], ["a", "b", "c"]],
    [["1", "2", "3"], ["4", "5", "6"], ["7", "8", "9"], ["10", "11", "12"]], [["", "", ""], ["only", "", ""]], [["ABC", "one"], ["x", "two words"]],
]


@query(f"""WITH g AS (SELECT p_partkey AS id, [{', '.join('[' + ', '.join('[' + quoted(r) + ']' for r in g) + ']' for g in GRIDS)}][p_partkey % {len(GRIDS)} + 1] AS g FROM part), f AS (SELECT *, flatten(g) AS f FROM g),
t AS (SELECT *, list_filter(f, lambda x: trim(x) <> '') AS t FROM f) SELECT id, len(f) <= 2 OR len(t) <= 1 OR (len(g) <= 3 AND regexp_matches(lower(array_to_string(t, ' ')), '© published in|isbn:|all rights reserved')) AS layout,
len(g[1]) = 2 AND len(list_filter(g, lambda r: len(r) >= 2 AND regexp_matches(trim(r[1]), '^[A-Z0-9&-]{{2,8}}$') AND regexp_matches(trim(r[2]), '\\S\\s+\\S'))) * 10 >= len(g) * 7 AS acronyms FROM t""")
def grid_kinds(spark, sf):
    grids = F.array(*[F.array(*[F.array(*[F.lit(c) for c in r]) for r in g]) for g in GRIDS])
    g = F.get(grids, (F.col("p_partkey") % len(GRIDS)).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), discovery.is_layout(g).alias("layout"), discovery.is_acronyms(g).alias("acronyms"))


@query("""WITH g AS (SELECT p_size AS doc, p_partkey AS row_index, CASE p_partkey % 10 WHEN 0 THEN ['OFO Code', 'Occupation Title'] WHEN 5 THEN ['Variable', 'Value Label'] WHEN 7 THEN ['', ' '] ELSE [p_partkey::VARCHAR, p_name] END AS c FROM part),
h AS (SELECT *, p IS NOT NULL AS hd, last_value(p IGNORE NULLS) OVER (PARTITION BY doc ORDER BY row_index ROWS UNBOUNDED PRECEDING) AS h FROM (SELECT *, CASE WHEN row_index % 10 IN (0, 5) THEN array_to_string(c, '|') END AS p FROM g))
SELECT doc, row_index, h AS headers FROM h WHERE NOT hd AND row_index % 10 <> 7""")
def header_fill(spark, sf):
    cells = (
        F.when(F.col("p_partkey") % 10 == 0, F.array(F.lit("OFO Code"), F.lit("Occupation Title"))).when(F.col("p_partkey") % 10 == 5, F.array(F.lit("Variable"), F.lit("Value Label")))
        .when(F.col("p_partkey") % 10 == 7, F.array(F.lit(""), F.lit(" "))).otherwise(F.array(F.col("p_partkey").cast("string"), "p_name")))
    grid_ = table(spark, sf, "part").select(F.col("p_size").alias("doc"), F.col("p_partkey").alias("row_index"), cells.alias("cells"))
    return readers.with_headers(grid_, ["doc"], ["row_index"]).select("doc", "row_index", F.array_join("headers", "|").alias("headers"))


@query(f"SELECT row_index, title, _prov_dataset, _prov_status, _curation_decision, _curation_confidence, _derived_chambers FROM ({ORACLES['export_flat']}) WHERE _prov_status = 'valid' AND _curation_decision = 'INCLUDE'")
def export_chosen(spark, sf):
    return writers.chosen(slate.export_flat(spark, sf), ["row_index", "title"], valid_only=True, decision="include")
