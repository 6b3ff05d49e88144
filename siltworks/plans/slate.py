"""The registered queries over the reference's operators, and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import audit, curation, discovery, duplicates, quality, relational, structure, validation
from ..session import importable
from ..sources import writers
from . import records as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SCHEMA = [("title", True, "string"), ("ofo_code", False, "string"), ("nqf", False, "string"), ("province", False, "string"), ("amount", False, "float")]


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL twin."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---- SQL pieces that several twins share -------------------------------------------------------

def sql_words(c: str, words: list[str]) -> str:
    return f"regexp_matches({c}, '\\b({'|'.join(words)})\\b')"


def sql_parts(c: str, parts: list[str]) -> str:
    return f"regexp_matches({c}, '{'|'.join(parts)}')"


def sql_map(code: str, pairs) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs) + " END"


def _list(v: list[str]) -> str:
    return f"[{quoted(v)}]" if v else "CAST([] AS VARCHAR[])"


SQL_TAX = R.SQL + """, c AS (SELECT *, regexp_replace(regexp_replace(trim(coalesce(ofo_code, '')), '^20[0-9]{2}-', ''), '[^0-9]', '', 'g') AS code FROM r),
lv AS (SELECT *, """ + ", ".join(
    f"CASE WHEN length(code) >= {n} THEN {sql_map(f'substr(code, 1, {n})', [(x[0], quoted([x[1]])) for x in rows])} END AS {name}_title"
    for name, rows, n in [("major", K.MAJOR_GROUPS, 1), ("sub_major", K.SUB_MAJOR_GROUPS, 2), ("minor", K.MINOR_GROUPS, 3), ("unit", K.UNIT_GROUPS, 4)]
) + """ FROM c),
lc AS (SELECT *, CASE WHEN major_title IS NOT NULL THEN substr(code, 1, 1) END AS major_code, CASE WHEN sub_major_title IS NOT NULL THEN substr(code, 1, 2) END AS sub_major_code,
CASE WHEN minor_title IS NOT NULL THEN substr(code, 1, 3) END AS minor_code, CASE WHEN unit_title IS NOT NULL THEN substr(code, 1, 4) END AS unit_code FROM lv),
tax AS (SELECT *, unit_code IS NOT NULL AS direct_unit, length(code) IN (4, 6) AS valid_format,
CASE WHEN code = '' THEN 'UNCLASSIFIED' WHEN unit_code IS NOT NULL THEN 'TAXONOMY_INFERRED' ELSE 'MODEL_INFERRED' END AS attribution,
CAST(CASE WHEN code = '' THEN 0.00 WHEN unit_code IS NOT NULL THEN 0.95 WHEN sub_major_code IS NOT NULL THEN """ + sql_map("sub_major_code", [(x[0], x[2]) for x in K.SUB_MAJOR_GROUPS]) + """
WHEN major_code IS NOT NULL THEN """ + sql_map("major_code", [(x[0], x[2]) for x in K.MAJOR_GROUPS]) + """ ELSE 0.30 END AS DECIMAL(4,2)) AS affinity,
coalesce(""" + sql_map("unit_code", [(x[0], _list(x[2])) for x in K.UNIT_GROUPS]) + ", " + sql_map("sub_major_code", [(x[0], _list(x[3])) for x in K.SUB_MAJOR_GROUPS]) + """, CAST([] AS VARCHAR[])) AS chambers FROM lc)"""

_first_excluded = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, '\\b{w}\\b') THEN '{w}' END" for w in K.EXCLUDED_ROLES) + ")"
_derived = "list_filter([" + ", ".join(f"CASE WHEN {sql_parts('t', w)} THEN '{ch}' END" for w, ch in K.TITLE_CHAMBERS) + "], lambda x: x IS NOT NULL)"
SQL_JUDGED = SQL_TAX + f""", tt AS (SELECT *, lower(trim(coalesce(title, ''))) AS t FROM tax),
ex AS (SELECT *, CASE WHEN NOT {sql_parts('t', K.INDUSTRIAL_QUALIFIERS)} THEN {_first_excluded} END AS exrole, {_derived} AS derived,
{sql_parts('t', K.TECHNICAL_CORE)} AS technical, {sql_parts('t', K.PROCESS_WORDS)} AS process FROM tt),
jd AS (SELECT *, CASE WHEN exrole IS NOT NULL THEN 'excluded_role:' || exrole WHEN {sql_words('t', K.SUPPORT_ROLES)} THEN 'support_role' END AS exclusion,
list_concat(chambers, list_filter(derived, lambda x: NOT list_contains(chambers, x))) AS all_chambers FROM ex),
judged AS (SELECT *, exclusion IS NULL AND {sql_words('t', K.LEADERSHIP_ROLES)} AND NOT {sql_parts('t', K.LEADERSHIP_QUALIFIERS)} AS ambiguous FROM jd)"""
SQL_SCORED = SQL_JUDGED + """, scored AS (SELECT *, CAST(CASE WHEN exclusion IS NOT NULL THEN 0 ELSE
(CASE WHEN technical THEN 0.30 ELSE 0.00 END) + (CASE WHEN coalesce(major_code, '') IN ('2','3','6','7') THEN 0.25 ELSE 0.00 END)
+ (CASE WHEN technical OR coalesce(major_code, '') IN ('6','7') THEN 0.20 ELSE 0.00 END) + (CASE WHEN process THEN 0.15 ELSE 0.00 END) END AS DECIMAL(4,2)) AS score FROM judged)"""
SQL_CONFLICTS = SQL_SCORED + f""", cf0 AS (SELECT *, {sql_words('t', K.NON_TECHNICAL_TITLES)} AS plain, coalesce(major_code, '') AS mj,
coalesce(sub_major_code, CASE WHEN length(code) >= 2 THEN substr(code, 1, 2) END, '') AS sb FROM scored),
cf AS (SELECT *, plain AND (mj IN ('6','7') OR sb IN ('21','31')) AS c1, {sql_parts('t', K.TECHNICAL_TITLES)} AND (mj IN ('4','5','8') OR sb IN ('22','23','24','26')) AS c2,
{sql_parts("lower(trim(coalesce(company_name, '')))", K.INDUSTRIAL_EMPLOYERS)} AND plain AS c3 FROM cf0)"""
_float = "try_cast(trim(amount) AS DOUBLE)"
_nq = "regexp_extract(trim(nqf), '([0-9]+)', 1)"
_blank = {c: f"(trim(coalesce({c}, '')) = '')" for c in ("title", "ofo_code", "nqf", "province", "amount")}
SQL_ISSUES = f"""iss AS (SELECT row_index, dataset_id, 'title' AS "column", 'required' AS rule, 'error' AS severity FROM r WHERE {_blank['title']}
UNION ALL SELECT row_index, dataset_id, 'ofo_code', 'ofo_code', 'error' FROM r WHERE NOT {_blank['ofo_code']} AND NOT regexp_matches(trim(ofo_code), '^(20[0-9]{{2}}-)?[0-9]{{4,6}}$')
UNION ALL SELECT row_index, dataset_id, 'nqf', 'nqf_range', 'error' FROM r WHERE NOT {_blank['nqf']} AND {_nq} <> '' AND NOT try_cast({_nq} AS BIGINT) BETWEEN 1 AND 10
UNION ALL SELECT row_index, dataset_id, 'nqf', 'nqf_format', 'warning' FROM r WHERE NOT {_blank['nqf']} AND {_nq} = ''
UNION ALL SELECT row_index, dataset_id, 'province', 'province', 'warning' FROM r WHERE NOT {_blank['province']} AND trim(province) NOT IN ({quoted(sorted(set(K.PROVINCES.values())))})
UNION ALL SELECT row_index, dataset_id, 'amount', 'float', 'warning' FROM r WHERE NOT {_blank['amount']} AND {_float} IS NULL)"""
SQL_STATUS = SQL_ISSUES + """, st AS (SELECT r.*, CASE WHEN i.e > 0 THEN 'error' WHEN i.w > 0 THEN 'warning' ELSE 'valid' END AS status FROM r LEFT JOIN
(SELECT row_index AS ri, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM iss GROUP BY 1) i ON r.row_index = i.ri)"""
SQL_DECIDED = SQL_CONFLICTS + ", " + SQL_ISSUES + """, st AS (SELECT row_index AS ri, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM iss GROUP BY 1),
d0 AS (SELECT cf.*, CASE WHEN st.e > 0 THEN 'error' WHEN st.w > 0 THEN 'warning' ELSE 'valid' END AS status, c1 OR c2 AS hard, c1 OR c2 OR c3 AS anyc,
CAST(CASE WHEN direct_unit THEN 0.95 WHEN major_code IS NOT NULL THEN 0.85 WHEN score >= 0.85 THEN 0.95 ELSE 0.60 END AS DECIMAL(9,6)) AS certainty FROM cf LEFT JOIN st ON cf.row_index = st.ri),
d1 AS (SELECT *, CAST(round(greatest(round(CAST(least(greatest(CAST(score * 0.70 AS DECIMAL(12,6)) + CAST(certainty * 0.30 AS DECIMAL(12,6)), CAST(0.40 AS DECIMAL(12,6))), CAST(0.98 AS DECIMAL(12,6))) AS DECIMAL(12,6)), 3)
 - CASE WHEN hard THEN 0.25 WHEN anyc THEN 0.05 ELSE 0.00 END, 0.20), 3) AS DECIMAL(6,3)) AS cur FROM d0),
decided AS (SELECT *, CASE WHEN hard THEN 'REVIEW' WHEN exclusion IS NOT NULL THEN 'EXCLUDE' WHEN status = 'error' OR anyc OR ambiguous THEN 'REVIEW' WHEN score >= 0.85 THEN 'INCLUDE' WHEN score < 0.55 THEN 'EXCLUDE' ELSE 'REVIEW' END AS decision,
CASE WHEN hard THEN 'classification_conflict' WHEN exclusion IS NOT NULL THEN NULL WHEN status = 'error' THEN 'validation_error' WHEN anyc THEN 'classification_conflict' WHEN ambiguous THEN 'ambiguous_evidence' WHEN score >= 0.85 OR score < 0.55 THEN NULL ELSE 'low_confidence' END AS reason_code,
CASE WHEN hard THEN 'critical' WHEN exclusion IS NOT NULL THEN 'medium' WHEN status = 'error' THEN 'critical' WHEN anyc OR ambiguous THEN 'high' WHEN score >= 0.85 OR score < 0.55 THEN 'medium' ELSE 'high' END AS priority,
CAST(CASE WHEN NOT hard AND exclusion IS NOT NULL THEN 0.95 ELSE cur END AS DECIMAL(6,3)) AS curation_confidence,
CAST(round(CAST(0.20 + CASE WHEN status = 'warning' THEN 0.1425 ELSE 0.1485 END + CASE status WHEN 'error' THEN 0.10 WHEN 'warning' THEN 0.2125 ELSE 0.25 END + CAST(cur * 0.40 AS DECIMAL(12,6)) AS DECIMAL(12,6)), 3) AS DECIMAL(6,3)) AS overall_confidence FROM d1)"""


def validated(spark, sf):
    return validation.validate(R.records(spark, sf), SCHEMA)


def evaluated(spark, sf):
    return curation.evaluate(validated(spark, sf).withColumn("extraction_confidence", F.lit("1.000").cast("decimal(6,3)")))


# ---- text and cells ----------------------------------------------------------------------------

#: White space of Unicode, for an engine whose regular expressions know only that of ASCII.
SQL_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"SELECT doc_id, trim(regexp_replace(text, '{SQL_SPACE}', ' ', 'g')) AS text FROM documents")
def norm_whitespace(spark, sf):
    """White space of every document collapsed."""
    return table(spark, sf, "documents").select("doc_id", X.collapse(F.col("text")).alias("text"))


@query(f"WITH {R.SQL} SELECT row_index, CASE WHEN lower(trim(province)) IN ({quoted(K.NULL_TOKENS)}) THEN NULL ELSE province END AS province FROM r")
def norm_null_tokens(spark, sf):
    return R.records(spark, sf).select("row_index", X.null_if_token(F.col("province")).alias("province"))


@query(f"""WITH {R.SQL}, x AS (SELECT row_index, CASE WHEN lower(trim(amount)) IN ({quoted(K.NULL_TOKENS)}) THEN NULL ELSE trim(amount) END AS v FROM r)
SELECT row_index, v AS value, CASE WHEN v IS NULL THEN 'null' WHEN regexp_matches(v, '^-?[0-9]+$') THEN 'integer' WHEN regexp_matches(v, '^-?[0-9]+\\.[0-9]+$') THEN 'float' ELSE 'string' END AS value_type FROM x""")
def typed_cell(spark, sf):
    return R.records(spark, sf).select("row_index", X.typed_cell(F.col("amount")).alias("c")).select("row_index", "c.*")


@query()
def unicode_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_unicode(F.col("text")).alias("text"))


@query(f"WITH {R.SQL} SELECT row_index, coalesce({sql_map('lower(trim(province))', [(k, quoted([v])) for k, v in K.PROVINCES.items()])}, province) AS province FROM r")
def province_lookup(spark, sf):
    return R.records(spark, sf).select("row_index", X.province(F.col("province")).alias("province"))


@query("""SELECT c_custkey, CASE WHEN s = '' THEN 'column' ELSE s END AS name FROM (SELECT c_custkey, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(trim(c_name || ' IdCode-' || c_mktsegment),
'[^A-Za-z0-9_\\s-]', '', 'g'), '[\\s-]+', '_', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_+', '_', 'g'), '^_|_$', '', 'g') AS s FROM customer)""")
def snake_case(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.snake_case(F.concat("c_name", F.lit(" IdCode-"), "c_mktsegment")).alias("name"))


@query(f"""WITH {R.SQL} SELECT row_index, regexp_replace(regexp_replace(trim(ofo_code), '^20[0-9]{{2}}-', ''), '[^0-9]', '', 'g') AS code,
CAST(CASE WHEN try_cast(regexp_extract(nqf, '([0-9]+)', 1) AS INT) BETWEEN 1 AND 10 THEN try_cast(regexp_extract(nqf, '([0-9]+)', 1) AS INT) END AS INT) AS level FROM r""")
def code_and_level(spark, sf):
    return R.records(spark, sf).select("row_index", X.clean_code(F.col("ofo_code")).alias("code"), X.nqf_level(F.col("nqf")).alias("level"))


SQL_ITEMS = R.SQL + """, it AS (SELECT row_index, i AS pos, trim(regexp_replace(p[i], '\\s+', ' ', 'g')) AS item FROM (SELECT row_index, string_split_regex(colleges, '[;\\n]+') AS p, unnest(range(1, len(string_split_regex(colleges, '[;\\n]+')) + 1)) AS i FROM r)
WHERE trim(p[i]) <> '')"""


@query(f"""WITH {SQL_ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY row_index, lower(item) ORDER BY pos) AS k FROM it)
SELECT r.row_index, coalesce(string_agg(item, '|' ORDER BY pos) FILTER (k = 1), '') AS items, coalesce(string_agg(item, '|' ORDER BY pos) FILTER (k > 1), '') AS repeats FROM r LEFT JOIN n ON r.row_index = n.row_index GROUP BY r.row_index""")
def incell_split_dedupe(spark, sf):
    got = X.distinct_items(F.col("colleges"))
    return R.records(spark, sf).select("row_index", F.array_join(got["items"], "|").alias("items"), F.array_join(got["repeats"], "|").alias("repeats"))


# ---- validation --------------------------------------------------------------------------------

@query(f"WITH {R.SQL}, {SQL_ISSUES} SELECT * FROM iss")
def validate_issues(spark, sf):
    return validation.issue_rows(validated(spark, sf), "row_index", "dataset_id")


@query(f"WITH {R.SQL}, {SQL_STATUS} SELECT row_index, status, CAST(CASE status WHEN 'error' THEN 0.5 WHEN 'warning' THEN 0.85 ELSE 1 END AS DOUBLE) AS confidence FROM st")
def record_status(spark, sf):
    return validated(spark, sf).select("row_index", "status", F.col("validation_confidence").cast("double").alias("confidence"))


@query(f"""WITH {R.SQL}, {SQL_ISSUES} SELECT severity, "column", count(*) AS n FROM iss GROUP BY ALL""")
def issue_summary(spark, sf):
    return validation.issue_summary(validation.issue_rows(validated(spark, sf), "row_index"))


# ---- relational decomposition ------------------------------------------------------------------

@query(f"""WITH {R.SQL} SELECT row_index, CASE WHEN trim(pk) <> '' THEN trim(pk) ELSE printf('ROW-%04d', row_index) END AS entity_id,
CASE WHEN lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) IN ({quoted(K.NULL_TOKENS)}) THEN NULL ELSE trim(regexp_replace(title, '\\s+', ' ', 'g')) END AS title, title AS title_raw FROM r""")
def decompose_primary(spark, sf):
    return relational.primary(R.records(spark, sf), "pk", ["title"])


SQL_DIM = SQL_ITEMS + """, dm AS (SELECT item_key, arg_min(item, row_index * 1000 + pos) AS item, printf('DIM-%04d', row_number() OVER (ORDER BY min(row_index * 1000 + pos))) AS item_id FROM (SELECT *, lower(item) AS item_key FROM it) GROUP BY item_key)"""


@query(f"WITH {SQL_DIM} SELECT item_id, item_key, item FROM dm")
def decompose_dimension(spark, sf):
    return relational.dimension(R.records(spark, sf), "colleges")


@query(f"WITH {SQL_DIM} SELECT DISTINCT row_index, item_id FROM it JOIN dm ON lower(it.item) = dm.item_key")
def decompose_junction(spark, sf):
    r = R.records(spark, sf)
    return relational.junction(r, relational.dimension(r, "colleges"), "colleges")


@query(f"""WITH {SQL_ITEMS} SELECT row_index, 'duplicate_key' AS issue FROM (SELECT row_index, row_number() OVER (PARTITION BY pk ORDER BY row_index) AS n FROM r) WHERE n > 1
UNION ALL SELECT row_index, 'missing_title' FROM r WHERE trim(title) = '' UNION ALL SELECT row_index, 'pattern' FROM r WHERE NOT regexp_matches(pk, '^K[0-9]+[02468]$')
UNION ALL SELECT row_index, 'empty_list' FROM r WHERE row_index NOT IN (SELECT row_index FROM it)
UNION ALL SELECT row_index, 'repeated_item' FROM it GROUP BY row_index HAVING count(*) > count(DISTINCT lower(item))""")
def decompose_review(spark, sf):
    return relational.review(R.records(spark, sf), "pk", ["title"], "colleges", "^K[0-9]+[02468]$")


# ---- curation ----------------------------------------------------------------------------------

@query(f"WITH {SQL_TAX} SELECT row_index, code, major_code, sub_major_code, minor_code, unit_code, unit_title, CAST(affinity AS DOUBLE) AS affinity, valid_format, attribution, array_to_string(chambers, '; ') AS chambers FROM tax")
def taxonomy_resolve(spark, sf):
    return curation.resolve_taxonomy(R.records(spark, sf)).select(
        "row_index", "code", "major_code", "sub_major_code", "minor_code", "unit_code", "unit_title", F.col("affinity").cast("double").alias("affinity"), "valid_format", "attribution", F.array_join("chambers", "; ").alias("chambers"))


@query(f"""WITH {SQL_TAX} SELECT row_index, 'major' AS level, major_code AS level_code, length(code) > 1 AS is_inherited, CAST(CASE WHEN length(code) > 1 THEN 0.50 ELSE 0.90 END AS DOUBLE) AS confidence FROM tax WHERE major_code IS NOT NULL
UNION ALL SELECT row_index, 'sub_major', sub_major_code, length(code) > 2, CAST(CASE WHEN length(code) > 2 THEN 0.65 ELSE 0.95 END AS DOUBLE) FROM tax WHERE sub_major_code IS NOT NULL
UNION ALL SELECT row_index, 'minor', minor_code, length(code) > 3, CAST(CASE WHEN length(code) > 3 THEN 0.80 ELSE 0.95 END AS DOUBLE) FROM tax WHERE minor_code IS NOT NULL
UNION ALL SELECT row_index, 'unit', unit_code, false, CAST(0.95 AS DOUBLE) FROM tax WHERE unit_code IS NOT NULL""")
def taxonomy_claims(spark, sf):
    return curation.taxonomy_claims(curation.resolve_taxonomy(R.records(spark, sf))).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"WITH {SQL_SCORED} SELECT row_index, exclusion, ambiguous, technical, CAST(score AS DOUBLE) AS score, array_to_string(all_chambers, '; ') AS chambers FROM scored")
def rule_scores(spark, sf):
    df = curation.score_rules(curation.judge_titles(curation.resolve_taxonomy(R.records(spark, sf))))
    return df.select("row_index", "exclusion", "ambiguous", "technical", F.col("score").cast("double").alias("score"), F.array_join("all_chambers", "; ").alias("chambers"))


@query(f"""WITH {SQL_CONFLICTS} SELECT row_index, 'CLASSIFICATION_VS_TITLE' AS type, 'critical' AS severity FROM cf WHERE c1 UNION ALL SELECT row_index, 'CLASSIFICATION_VS_TITLE', 'high' FROM cf WHERE c2
UNION ALL SELECT row_index, 'COMPANY_VS_OCCUPATION', 'medium' FROM cf WHERE c3""")
def conflicts(spark, sf):
    return evaluated(spark, sf).select("row_index", F.inline("conflicts"))


@query(f"WITH {SQL_DECIDED} SELECT row_index, status, decision, reason_code, priority, CAST(curation_confidence AS DOUBLE) AS curation_confidence, CAST(overall_confidence AS DOUBLE) AS overall_confidence FROM decided")
def decision(spark, sf):
    return evaluated(spark, sf).select(
        "row_index", "status", "decision", "reason_code", "priority", F.col("curation_confidence").cast("double").alias("curation_confidence"), F.col("overall_confidence").cast("double").alias("overall_confidence"))


@query(f"""WITH {SQL_CONFLICTS} SELECT row_index, 'SOURCE_FACT' AS evidence_type, 'title:' || t AS claim, CAST(0.98 AS DOUBLE) AS confidence FROM cf WHERE t <> ''
UNION ALL SELECT row_index, 'SOURCE_FACT', 'code:' || code, CAST(0.99 AS DOUBLE) FROM cf WHERE code <> '' UNION ALL SELECT row_index, 'DERIVED_CLASSIFICATION', 'unit:' || unit_code, CAST(0.95 AS DOUBLE) FROM cf WHERE direct_unit
UNION ALL SELECT row_index, 'DERIVED_CLASSIFICATION', 'major:' || major_code, CAST(0.75 AS DOUBLE) FROM cf WHERE NOT direct_unit AND major_code IS NOT NULL
UNION ALL SELECT row_index, 'SEMANTIC_INFERENCE', 'chambers:' || array_to_string(all_chambers, '; '), CAST(0.80 AS DOUBLE) FROM cf WHERE len(all_chambers) > 0
UNION ALL SELECT row_index, 'RULE_INFERENCE', 'conflicts:' || (c1::INT + c2::INT + c3::INT)::VARCHAR, CAST(0.99 AS DOUBLE) FROM cf WHERE c1 OR c2 OR c3""")
def evidence_items(spark, sf):
    return curation.evidence(evaluated(spark, sf)).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"""WITH {SQL_DECIDED} SELECT dataset_id, count(*) AS total, count(*) FILTER (decision = 'INCLUDE') AS included, count(*) FILTER (decision = 'EXCLUDE') AS excluded,
count(*) FILTER (decision = 'REVIEW') AS review, CAST(sum(c1::INT + c2::INT + c3::INT) AS BIGINT) AS conflicts FROM decided GROUP BY 1""")
def run_summary(spark, sf):
    return curation.run_summary(evaluated(spark, sf))


# ---- duplicates --------------------------------------------------------------------------------

SQL_FLAGS = "fl AS (SELECT row_index, target, pk FROM (SELECT row_index, pk, first_value(row_index) OVER w AS target, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY pk ORDER BY row_index)) WHERE n > 1)"


@query(f"WITH {R.SQL}, {SQL_FLAGS} SELECT row_index, target, pk FROM fl")
def dup_structural(spark, sf):
    return duplicates.structural(R.records(spark, sf), "pk")


@query("""WITH w AS (SELECT p_partkey AS k, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part)
SELECT a.k AS i, b.k AS j, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) AS jaccard FROM w a JOIN w b ON b.k > a.k AND b.k < a.k + 50 AND b.k // 50 IN (a.k // 50, a.k // 50 + 1)
WHERE len(list_intersect(a.w, b.w)) * 2 >= len(list_distinct(list_concat(a.w, b.w)))""")
def dup_pairs_jaccard(spark, sf):
    rows = duplicates.titled(table(spark, sf, "part"), "p_name", "p_partkey")
    pairs = duplicates.windowed(rows.select("i", F.array_distinct(F.split(X.comparable(F.col("t")), " ")).alias("w")), ["w"])
    share = F.size(F.array_intersect("a_w", "b_w")).cast("double") / F.size(F.array_union("a_w", "b_w"))
    return pairs.select("i", "j", share.alias("jaccard")).where("jaccard >= 0.5")


@query()
def dup_pairs_full(spark, sf):
    return duplicates.similar_pairs(R.records(spark, sf))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_text_dups(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# ---- quality -----------------------------------------------------------------------------------

def _counts(spark, sf) -> DataFrame:
    e = evaluated(spark, sf).join(duplicates.structural(R.records(spark, sf), "pk").select("row_index", F.lit(1).alias("dup")), "row_index", "left")
    cells = ["title", "ofo_code", "nqf", "province", "amount"]
    empty = sum((F.when(F.trim(c) == "", 1).otherwise(0) for c in cells), F.lit(0))
    return e.groupBy("dataset_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "warning").alias("warnings"), F.count_if(F.col("decision") == "REVIEW").alias("review"), F.count("dup").alias("duplicates"),
        F.sum(F.size("conflicts")).cast("bigint").alias("conflicts"), F.sum(empty).cast("bigint").alias("null_cells"), (F.count("*") * len(cells)).alias("cells"),
        F.count_if(F.col("company_name") == "").alias("no_provenance"))


def _dims(source: str) -> str:
    def share(a, b, by):
        return f"coalesce(CAST(CAST({a} AS DECIMAL(18,0)) * {by} AS DOUBLE) / nullif({b}, 0), 0)"

    raw = {
        "extraction": f"100 - {share('errors', 'total', 60)}", "structural": f"100 - {share('duplicates', 'total', 40)}", "normalization": f"100 - {share('warnings', 'total', 20)}",
        "validation": f"100 - {share('errors', 'total', 100)} - {share('warnings', 'total', 50)}", "completeness": f"100 - {share('null_cells', 'cells', 100)}",
        "consistency": "100 - least(conflicts * 10, 50)", "curation": f"100 - {share('review', 'total', 50)}", "provenance": f"100 - {share('no_provenance', 'total', 100)}",
    }
    cols = ", ".join(f"CAST(greatest(0, round(CAST({v} AS DECIMAL(18,6)), 2)) AS DECIMAL(6,2)) AS {k}" for k, v in raw.items())
    overall = " + ".join(f"{k} * {w}" for k, w in K.QUALITY_WEIGHTS.items())
    return f"dims AS (SELECT *, CAST(round(CAST({overall} AS DECIMAL(18,6)), 2) AS DECIMAL(6,2)) AS overall FROM (SELECT *, {cols} FROM {source}))"


SQL_COUNTS = SQL_DECIDED + ", " + SQL_FLAGS + """, counts AS (SELECT dataset_id, count(*) AS total, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'warning') AS warnings,
count(*) FILTER (decision = 'REVIEW') AS review, count(fl.row_index) AS duplicates, CAST(sum(c1::INT + c2::INT + c3::INT) AS BIGINT) AS conflicts,
CAST(sum((trim(title) = '')::INT + (trim(ofo_code) = '')::INT + (trim(nqf) = '')::INT + (trim(province) = '')::INT + (trim(amount) = '')::INT) AS BIGINT) AS null_cells, count(*) * 5 AS cells,
count(*) FILTER (company_name = '') AS no_provenance FROM decided d LEFT JOIN fl ON d.row_index = fl.row_index GROUP BY 1), """ + _dims("counts")
DIMS = [*K.QUALITY_WEIGHTS, "overall"]


@query(f"WITH {SQL_COUNTS} SELECT dataset_id, total, errors, warnings, review, duplicates, conflicts, null_cells, {', '.join(f'CAST({d} AS DOUBLE) AS {d}' for d in DIMS)} FROM dims")
def quality_dimensions(spark, sf):
    return quality.dimensions(_counts(spark, sf)).select(
        "dataset_id", "total", "errors", "warnings", "review", "duplicates", "conflicts", "null_cells", *[F.col(d).cast("double").alias(d) for d in DIMS])


SQL_GATES = """CASE WHEN structural >= 70 THEN 'passed' ELSE 'warning' END AS structural_gate, CASE WHEN normalization >= 75 THEN 'passed' ELSE 'warning' END AS normalization_gate,
CASE WHEN errors = 0 THEN 'passed' WHEN errors > 5 THEN 'failed' ELSE 'warning' END AS validation_gate, CASE WHEN review = 0 THEN 'passed' ELSE 'requires_review' END AS curation_gate,
CASE WHEN no_provenance = 0 THEN 'passed' ELSE 'warning' END AS provenance_gate,
CASE WHEN errors + conflicts = 0 AND review = 0 THEN 'passed' WHEN errors + conflicts = 0 THEN 'warning' ELSE 'failed' END AS review_gate, CASE WHEN errors + conflicts = 0 THEN 'ready' ELSE 'blocked' END AS export_gate,
CASE WHEN errors > 5 THEN 'BLOCKED' WHEN review > 0 OR warnings > 0 OR conflicts > 0 THEN 'REQUIRES_REVIEW' ELSE 'PRODUCTION_READY' END AS export_status"""
GATES = ["structural_gate", "normalization_gate", "validation_gate", "curation_gate", "provenance_gate", "review_gate", "export_gate", "export_status"]


@query(f"WITH {SQL_COUNTS} SELECT dataset_id, {SQL_GATES} FROM dims")
def quality_gates(spark, sf):
    return quality.gates(quality.dimensions(_counts(spark, sf))).select("dataset_id", *GATES)


@query("""WITH d AS (SELECT lang, text, source, (trim(coalesce(text, '')) = '') AS missing, length(trim(coalesce(text, ''))) < 200 AS short FROM documents),
counts AS (SELECT lang, count(*) AS total, count(*) FILTER (NOT missing AND NOT short) AS valid, count(*) FILTER (missing) AS errors, count(*) FILTER (NOT missing AND short) AS warnings, CAST(0 AS BIGINT) AS review,
count(*) - count(DISTINCT text) AS duplicates, CAST(0 AS BIGINT) AS conflicts, count(*) FILTER (missing) AS null_cells, count(*) AS cells, count(*) FILTER (source IS NULL OR source = '') AS no_provenance FROM d GROUP BY 1), """ + _dims("counts")
       + f" SELECT lang, total, valid, errors, warnings, duplicates, {', '.join(f'CAST({d} AS DOUBLE) AS {d}' for d in DIMS)}, {SQL_GATES} FROM dims")
def document_quality_gates(spark, sf):
    """Documents validated (required text, short text), counted by language, scored and gated."""
    t = F.trim(F.coalesce("text", F.lit("")))
    d = table(spark, sf, "documents").withColumns({"missing": t == "", "short": F.length(t) < 200})
    counts = d.groupBy("lang").agg(
        F.count("*").alias("total"), F.count_if(~F.col("missing") & ~F.col("short")).alias("valid"), F.count_if("missing").alias("errors"),
        F.count_if(~F.col("missing") & F.col("short")).alias("warnings"), F.lit(0).cast("bigint").alias("review"),
        # equal texts have equal digests, which keeps the texts themselves out of the shuffle
        (F.count("*") - F.count_distinct(F.sha2("text", 256))).alias("duplicates"), F.lit(0).cast("bigint").alias("conflicts"), F.count_if("missing").alias("null_cells"),
        F.count("*").alias("cells"), F.count_if(F.col("source").isNull() | (F.col("source") == "")).alias("no_provenance"))
    return quality.gates(quality.dimensions(counts)).select("lang", "total", "valid", "errors", "warnings", "duplicates", *[F.col(c).cast("double").alias(c) for c in DIMS], *GATES)


# ---- structure ---------------------------------------------------------------------------------

@query("""SELECT event_id, user_id, last_value(CASE WHEN value >= 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS variable FROM events""")
def codebook_ffill(spark, sf):
    e = table(spark, sf, "events").withColumn("variable", F.when(F.col("value") >= 50, F.col("event_type")).otherwise(F.lit("")))
    return structure.fill_forward(e, "variable", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "variable")


@query("""WITH s AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) + 3 AS total, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)
SELECT conv_id, turn, greatest(turn, coalesce(nx - 1, total)) AS page_end FROM s""")
def sections_span(spark, sf):
    c = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "max(turn) over (partition by conv_id) + 3 as total")
    return structure.section_spans(c, ["conv_id"], "turn", ["turn"], "total").select("conv_id", "turn", "page_end")


@query("""WITH s AS (SELECT conv_id, turn, turn % 3 AS level, turn + 2 AS page_end FROM conversations), p AS (SELECT conv_id, level, turn, unnest(range(turn, page_end + 1)) AS page FROM s)
SELECT conv_id, page, arg_max(turn, level * 100000 - turn) AS section FROM p GROUP BY conv_id, page""")
def page_section_join(spark, sf):
    s = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "turn % 3 as level", "turn + 2 as page_end")
    return structure.pages_in_sections(s, ["conv_id"], "turn", "page_end", "level", "turn")


@query("""SELECT event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type THEN 1 ELSE 0 END AS b FROM events)""")
def group_sessions(spark, sf):
    return structure.sessions(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], lambda w: F.lag("event_type").over(w) != F.col("event_type")).select("event_id", "group_no")


@query("""WITH c AS (SELECT 'p_size' AS name, CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 'flag', CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'No' END FROM part UNION ALL SELECT 'cost', CASE WHEN p_size % 2 = 0 THEN '12.5' ELSE '7' END FROM part),
s AS (SELECT name, count(*) AS n, count(*) FILTER (lower(trim(v)) IN ('yes','no','true','false','y','n')) AS b, count(*) FILTER (regexp_matches(trim(v), '^-?(0|[1-9][0-9]*)$')) AS i, count(*) FILTER (regexp_matches(trim(v), '^-?[0-9]+\\.[0-9]+$')) AS f FROM c WHERE trim(v) <> '' GROUP BY 1)
SELECT name, n, CASE WHEN b * 100 >= n * 85 THEN 'boolean' WHEN i * 100 >= n * 85 THEN 'integer' WHEN (i + f) * 100 >= n * 85 THEN 'float' ELSE 'string' END AS type FROM s""")
def infer_types(spark, sf):
    p = table(spark, sf, "part")
    cells = {"p_size": F.col("p_size").cast("string"), "p_name": F.col("p_name"), "flag": F.when(F.col("p_size") % 2 == 0, "yes").otherwise("No"), "cost": F.when(F.col("p_size") % 2 == 0, "12.5").otherwise("7")}
    long = p.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("v")) for k, v in cells.items()])).alias("x")).select("x.*")
    return structure.infer_types(long, "name", "v")


@query("SELECT n_nationkey, CASE WHEN n = 1 THEN c ELSE c || '_' || n::VARCHAR END AS unique_name FROM (SELECT n_nationkey, 'r' || n_regionkey AS c, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation)")
def unique_columns(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("c"))
    return structure.unique_names(n, "c", [], "n_nationkey").select("n_nationkey", "unique_name")


@query("""WITH o AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, o_orderkey, o_orderpriority AS p FROM orders),
i AS (SELECT *, sum(CASE WHEN rn % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY rn) AS record FROM o)
SELECT doc, CAST(record AS BIGINT) AS record, max(CASE WHEN rn % 3 = 1 THEN 'K' || o_orderkey END) AS key, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY rn) AS body FROM i GROUP BY doc, record""")
def stitch_continuations(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_custkey as doc", "row_number() over (partition by o_custkey order by o_orderkey) as rn", "o_orderkey")
    rows = o.selectExpr("doc", "rn", "case when rn % 3 = 1 then concat('K', o_orderkey) else '' end as key", "cast(o_orderkey as string) as body")
    return structure.stitch(rows, "key", ["body"], ["doc"], ["rn"])


# ---- reports, audits and export ----------------------------------------------------------------

@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(nullif(trim(CAST({c} AS VARCHAR)), '')) AS filled, count(DISTINCT nullif(trim(CAST({c} AS VARCHAR)), '')) AS distinct_values, count(*) AS total FROM customer""" for c in ("c_name", "c_nationkey", "c_mktsegment")))
def column_coverage(spark, sf):
    return audit.column_coverage(table(spark, sf, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])


@query("SELECT array_to_string(list_sort(list(DISTINCT p_type))[1:40], '|') AS first_values, greatest(count(DISTINCT p_type) - 40, 0) AS more FROM part")
def distinct_vocab_top40(spark, sf):
    """The first forty distinct types in order, and how many more there are (a report of fixed size)."""
    d = table(spark, sf, "part").select("p_type").distinct()
    top = d.orderBy("p_type").limit(40).agg(F.array_join(F.array_sort(F.collect_list("p_type")), "|").alias("first_values"))
    return top.crossJoin(d.agg(F.greatest(F.count("*") - 40, F.lit(0)).cast("bigint").alias("more")))  # one row each


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def project_counts(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["orders"])


@query(f"""WITH {SQL_DECIDED}, {SQL_FLAGS} SELECT d.row_index, decision, reason_code, status, fl.row_index IS NOT NULL AS duplicate,
CAST(CASE WHEN priority = 'critical' OR status = 'error' THEN 0 WHEN priority = 'high' THEN 1 ELSE 2 END AS INT) AS rank FROM decided d LEFT JOIN fl ON d.row_index = fl.row_index
WHERE decision = 'REVIEW' OR status = 'error' OR fl.row_index IS NOT NULL""")
def review_queue(spark, sf):
    return audit.review_queue(evaluated(spark, sf), duplicates.structural(R.records(spark, sf), "pk"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '1') OR contains(lower(c_mktsegment), '1') ORDER BY c_custkey LIMIT 20 OFFSET 5")
def record_search_page(spark, sf):
    return audit.search(table(spark, sf, "customer"), "1", ["c_name", "c_mktsegment"], ["c_custkey"], 20, 5).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_anti_docs(spark, sf):
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return d.join(lab.where("quality = 1"), "doc_id", "left_semi").join(lab.where("toxic = 1"), "doc_id", "left_anti")


@query(f"""WITH {SQL_DECIDED} SELECT row_index, title, dataset_id AS _prov_dataset, status AS _prov_status, decision AS _curation_decision, CAST(overall_confidence AS DOUBLE) AS _curation_confidence, array_to_string(all_chambers, '; ') AS _derived_chambers FROM decided""")
def export_flat(spark, sf):
    return audit.export_flat(evaluated(spark, sf), ["title"]).withColumn("_curation_confidence", F.col("_curation_confidence").cast("double"))


@query(f"""WITH {SQL_DECIDED} SELECT row_index, CAST(1 AS INT) AS step, 'extracted' AS stage, 'part' AS outcome FROM decided UNION ALL SELECT row_index, 2, 'normalised', 'done' FROM decided UNION ALL SELECT row_index, 3, 'validated', status FROM decided
UNION ALL SELECT row_index, 4, 'classified', coalesce(unit_code, major_code, 'none') FROM decided UNION ALL SELECT row_index, 5, 'decided', decision FROM decided""")
def lineage_steps(spark, sf):
    return audit.lineage(evaluated(spark, sf), "part")


@query(f"""WITH {R.SQL} SELECT row_index, 'title' AS field, title AS old_value, 'fixed' AS new_value FROM r WHERE row_index % 7 = 0 AND title <> 'fixed'""")
def audit_diff(spark, sf):
    r = R.records(spark, sf)
    after = r.withColumn("title", F.when(F.col("row_index") % 7 == 0, "fixed").otherwise(F.col("title")))
    return audit.field_changes(r, after, "row_index", ["title", "nqf"])


@query(f"WITH {R.SQL} SELECT row_index, CASE WHEN row_index % 5 = 0 THEN 'INCLUDE' ELSE 'unprocessed' END AS decision, row_index % 5 = 0 AS overridden FROM r")
def override_apply(spark, sf):
    r = R.records(spark, sf).select("row_index", F.lit("unprocessed").alias("decision"))
    o = r.where("row_index % 5 = 0").select("row_index", F.lit("INCLUDE").alias("decision"))
    return audit.apply_overrides(r, o, "row_index", "decision")


# ---- discovery ---------------------------------------------------------------------------------

LABELS = [
    "Table 4: The final list of occupations in high demand", "Annexure 2: survey questions to respondents", "TABLE 12. Top 10 indicators used", "Appendix B: notes", "table 9: SAQA qualification, NQF level and diploma",
    "total 167 occupations and 42 oihd", "Technical research report", "A policy framework", "Codebook: variable name and label", "list of 12 skills; total occupations 90", "Table 3",
]
HEADS = ["OFO_Code Occupation", "Company Employer", "variable label format", "province sector", "saqa diploma", "", "score frequency small", "gauteng", "engineer survey"]
SQL_LABELLED = "lb AS (SELECT p_partkey AS id, " + R._pick(LABELS, "p_partkey") + " AS label, " + R._pick(HEADS, "p_partkey") + " AS heads, p_partkey % 7 AS doc FROM part)"


def labelled(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey as id", R._pick(LABELS, "p_partkey") + " as label", R._pick(HEADS, "p_partkey") + " as heads", "p_partkey % 7 as doc")


@query(f"""WITH {SQL_LABELLED} SELECT id, coalesce(nullif(trim(regexp_extract(label, '(?i)(table[ \\t]+[0-9]+[:.-][ \\t]+[^\\n\\r]+)', 1)), ''), nullif(trim(regexp_extract(label, '(?i)(annexure[ \\t]+[0-9]+[:.-][ \\t]+[^\\n\\r]+)', 1)), ''),
nullif(trim(regexp_extract(label, '(?i)(appendix[ \\t]+[A-Z0-9]+[:.-][ \\t]+[^\\n\\r]+)', 1)), ''), '') AS caption FROM lb""")
def caption_extract(spark, sf):
    return labelled(spark, sf).select("id", discovery.caption(F.col("label")).alias("caption"))


@query(f"""WITH {SQL_LABELLED}, x AS (SELECT id, unnest(list_concat(list_concat(regexp_extract_all(label, '(?i)\\b(?:total|list of|identified|reveals|mapped[^0-9]{{1,10}})\\s+([0-9]{{1,4}})\\s+(?:occupations|oihd|qualifications|items|trades|skills)\\b', 1),
regexp_extract_all(label, '(?i)\\b([0-9]{{1,4}})\\s+(?:oihd|occupations in high demand)\\b', 1)), regexp_extract_all(label, '(?i)total\\s+occupations\\s+([0-9]{{1,4}})', 1))) AS s FROM lb)
SELECT DISTINCT id, CAST(s AS INT) AS stated FROM x WHERE CAST(s AS INT) > 5""")
def stated_counts(spark, sf):
    return discovery.stated_counts(labelled(spark, sf), ["id"], "label")


@query(f"""WITH {SQL_LABELLED}, l AS (SELECT id, lower(label) AS t FROM lb) SELECT id, CASE WHEN contains(t, 'research report') THEN 'research_report' WHEN contains(t, 'policy') AND contains(t, 'framework') THEN 'policy_document'
WHEN regexp_matches(t, 'codebook|variable name') THEN 'codebook' WHEN contains(t, 'survey report') THEN 'survey_report' WHEN contains(t, 'statistical') THEN 'statistical_report' ELSE 'unknown' END AS type FROM l""")
def doc_type_rules(spark, sf):
    return labelled(spark, sf).select("id", discovery.document_type(F.col("label"))["type"].alias("type"))


def _unit_sql() -> str:
    parts = []
    for n, (unit, (weight, words)) in enumerate(K.UNIT_SIGNALS.items()):
        hits = " + ".join(f"(CASE WHEN regexp_matches(t, '\\b{w}\\b') THEN {weight} ELSE 0 END)" for w in words)
        bonus = {"occupation": " + CASE WHEN contains(t, 'ofo') THEN 4 ELSE 0 END", "qualification": " + CASE WHEN contains(t, 'nqf level') THEN 4 ELSE 0 END"}.get(unit, "")
        parts.append(f"SELECT id, '{unit}' AS unit, {n} AS n, CAST({hits}{bonus} AS DOUBLE) AS s FROM ut")
    return "ut AS (SELECT id, lower(replace(heads, '_', ' ')) AS t FROM lb), us AS (" + " UNION ALL ".join(parts) + "), un AS (SELECT id, CASE WHEN max(s) >= 1.5 THEN arg_max(unit, s * 100 - n) ELSE 'unknown' END AS unit FROM us GROUP BY id)"


SQL_UNITS = SQL_LABELLED + ", " + _unit_sql()
SQL_ROLES = SQL_UNITS + f""", ro AS (SELECT lb.*, unit, CASE WHEN {sql_parts('lower(label)', K.METADATA_WORDS)} THEN 'metadata' WHEN unit = 'survey_response' OR {sql_parts('lower(label)', K.SURVEY_WORDS)} THEN 'survey' WHEN {sql_parts('lower(label)', K.FINAL_WORDS)} AND unit IN ('occupation', 'qualification') THEN 'final_dataset'
WHEN regexp_matches(lower(label), 'annexure|appendix') THEN 'appendix' WHEN {sql_parts('lower(label)', K.INTERMEDIATE_WORDS)} THEN 'intermediate_analysis' ELSE 'unknown' END AS role FROM lb JOIN un USING (id)),
sc AS (SELECT *, CAST((CASE WHEN regexp_matches(lower(label), 'final list|final oihd|occupations in high demand') THEN 4 ELSE 0 END) + (CASE WHEN contains(lower(label), 'consolidation of evidence') THEN 2.5 ELSE 0 END) + (CASE WHEN role = 'final_dataset' THEN 3 ELSE 0 END)
+ (CASE unit WHEN 'occupation' THEN 2 WHEN 'qualification' THEN 1.5 WHEN 'survey_response' THEN -3 ELSE 0 END) + (CASE WHEN id % 6 = 0 THEN 5 ELSE 0 END) + (CASE WHEN contains(lower(heads), 'ofo') AND contains(lower(heads), 'occupation') THEN 2 ELSE 0 END)
+ (CASE role WHEN 'intermediate_analysis' THEN -2 WHEN 'survey' THEN -4 ELSE 0 END) + (CASE WHEN role = 'appendix' AND NOT contains(lower(label), 'final') THEN -1.5 ELSE 0 END) AS DOUBLE) AS score FROM ro)"""


def scored_candidates(spark, sf):
    df = labelled(spark, sf).withColumn("unit", discovery.unit_of_observation(F.col("heads")))
    df = df.withColumn("role", discovery.table_role(F.col("label"), F.col("unit")))
    return df.withColumn("score", discovery.candidate_score(F.col("label"), F.col("role"), F.col("unit"), F.col("heads"), F.col("id") % 6 == 0).cast("double"))


@query(f"WITH {SQL_UNITS} SELECT id, unit FROM un")
def unit_argmax(spark, sf):
    return labelled(spark, sf).select("id", discovery.unit_of_observation(F.col("heads")).alias("unit"))


@query(f"WITH {SQL_ROLES} SELECT id, role, score FROM sc")
def candidate_scores(spark, sf):
    return scored_candidates(spark, sf).select("id", "role", "score")


@query(f"WITH {SQL_ROLES} SELECT doc, id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, id) AS n FROM sc) WHERE n = 1 AND score >= 3")
def candidate_topk(spark, sf):
    return discovery.authoritative(scored_candidates(spark, sf), ["doc"], "score", "id").select("doc", "id", "score")


@query("""WITH g AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN ['OFO Code', 'Title', 'x'] WHEN 1 THEN ['Note: data', '', ''] WHEN 2 THEN ['', '', ''] WHEN 3 THEN ['3115', 'Welder', 'A'] ELSE ['List of Occupations in High Demand', '27', ''] END AS cells FROM part)
SELECT id, len(list_filter(['OFO Code', 'Title', 'Province'], lambda h: list_contains(list_transform(cells, lambda c: lower(trim(c))), lower(h)))) >= 2 AS header,
len(list_filter(cells, lambda c: trim(c) <> '')) = 0 OR regexp_matches(lower(array_to_string(list_filter(cells, lambda c: trim(c) <> ''), ' ')), '^([0-9]+\\s+)?(interquartile|upper outlier|source:|note:|footnote:)')
OR (regexp_matches(lower(array_to_string(list_filter(cells, lambda c: trim(c) <> ''), ' ')), 'consolidation of evidence|technical research report|list of occupations in high demand') AND len(list_filter(cells, lambda c: trim(c) <> '')) <= 2) AS footnote FROM g""")
def grid_row_filters(spark, sf):
    rows = [["OFO Code", "Title", "x"], ["Note: data", "", ""], ["", "", ""], ["3115", "Welder", "A"], ["List of Occupations in High Demand", "27", ""]]
    cells = F.get(F.array(*[F.array(*[F.lit(c) for c in r]) for r in rows]), (F.col("p_partkey") % 5).cast("int"))
    head = F.array(F.lit("OFO Code"), F.lit("Title"), F.lit("Province"))
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), cells.alias("cells"))
    return df.select("id", discovery.repeats_header(F.col("cells"), head).alias("header"), discovery.is_footnote(F.col("cells")).alias("footnote"))


@query("""WITH g AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, i AS pos, CASE WHEN i % 3 = 2 THEN '112101 ' || l[i] ELSE l[i] END AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM g)),
m AS (SELECT *, sum(regexp_matches(line, '^[0-9]{4,6}')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS record FROM x)
SELECT doc_id, CAST(record AS BIGINT) AS record, string_agg(trim(line), ' ' ORDER BY pos) AS body FROM m WHERE record > 0 AND trim(line) <> '' GROUP BY doc_id, record""")
def text_line_records(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    coded = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("112101 "), x)).otherwise(x))
    return discovery.records_from_lines(d.select("doc_id", F.array_join(coded, "\n").alias("text")), ["doc_id"])


KINDS = ["Advanced Diploma in Metal", "intermediate certificate 12 MPUMALANGA list", "No Formal Qualification Required", ""]
_kinds = "(?i)\\b((" + "|".join(w.replace("'", "''") for w in K.QUALIFICATION_WORDS) + ").*)$"


@query(f"""WITH {R.SQL}, m AS (SELECT row_index, trim(CASE WHEN row_index % 2 = 0 THEN title || ' ' ELSE '' END || {R._pick(KINDS, '(row_index * 5)')}) AS t FROM r), q AS (SELECT *, regexp_extract(t, '{_kinds}', 1) AS q FROM m)
SELECT row_index, CASE WHEN q = '' THEN t ELSE trim(substr(t, 1, length(t) - length(q))) END AS occupation, trim(regexp_replace(q, '{K.CELL_FOOTER}', '')) AS qualification FROM q""")
def split_title_qualification(spark, sf):
    merged = F.trim(F.concat(F.when(F.col("row_index") % 2 == 0, F.concat("title", F.lit(" "))).otherwise(""), F.expr(R._pick(KINDS, "(row_index * 5)"))))
    return R.records(spark, sf).select("row_index", discovery.split_qualification(merged).alias("s")).select("row_index", "s.*")


WRAPPED = ["Engineer Motheo TVET", "North College; South College", "Level Two", "Software Developer Orbit Academy; East Campus", "", "Grade 9", "one two three four five; x", "a b", "; X Centre"]
_kw = "|".join(X.INSTITUTIONS)


@query("WITH w AS (SELECT p_partkey AS id, " + R._pick(WRAPPED, "p_partkey") + f""" AS s FROM part), a AS (SELECT *, regexp_matches(s, '(?i)\\b({_kw})\\b') AS f, regexp_extract(s, '(?is)^(.*?)\\b(?:{_kw})\\b', 1) AS pre, trim(split_part(s, ';', 1)) AS one FROM w),
b AS (SELECT *, list_filter(string_split_regex(regexp_replace(pre, '^[ ;,]+|[ ;,]+$', '', 'g'), '\\s+'), lambda x: x <> '') AS bits FROM a),
c AS (SELECT *, f AND len(bits) >= 2 AS wr, one <> '' AND NOT regexp_matches(lower(one), '{_kw}') AND len(string_split_regex(one, '\\s+')) <= 4 AND NOT regexp_matches(one, '[0-9]') AS lone FROM b)
SELECT id, CASE WHEN wr THEN 'T ' || array_to_string(bits[1:len(bits) - 1], ' ') WHEN lone THEN 'T ' || one ELSE 'T' END AS title, CASE WHEN wr THEN bits[len(bits)] || ' ' || substr(s, length(pre) + 1) WHEN lone THEN trim(array_to_string(string_split(s, ';')[2:], '; ')) ELSE s END AS items FROM c""")
def bleed_repair(spark, sf):
    d = table(spark, sf, "part").selectExpr("p_partkey as id", R._pick(WRAPPED, "p_partkey") + " as s")
    return d.select("id", X.repair_bleed(F.lit("T"), F.col("s")).alias("r")).select("id", "r.*")


@query("""SELECT 'c' || n_nationkey::VARCHAR AS "column", n_name AS original, 'string' AS type, CASE WHEN n_nationkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS required, '' AS description FROM nation""")
def data_dictionary(spark, sf):
    n = table(spark, sf, "nation").select(
        F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("original_name"), F.lit(None).cast("string").alias("type"),
        (F.col("n_nationkey") % 2 == 0).alias("required"), F.lit(None).cast("string").alias("description"))
    return writers.data_dictionary(n)


@query(f"""WITH {SQL_DECIDED}, s AS (SELECT dataset_id, '{{"dataset_id":"' || dataset_id || '","policy":"occupational_relevance","total":' || count(*) || ',"included":' || count(*) FILTER (decision = 'INCLUDE') || ',"excluded":' || count(*) FILTER (decision = 'EXCLUDE')
|| ',"review":' || count(*) FILTER (decision = 'REVIEW') || ',"conflicts":' || sum(c1::INT + c2::INT + c3::INT) || '}}' AS manifest FROM decided GROUP BY 1) SELECT dataset_id, manifest, sha256(manifest) AS reproducibility_hash FROM s""")
def manifest(spark, sf):
    return writers.manifest(curation.run_summary(evaluated(spark, sf)), "occupational_relevance")


@query(f"""WITH {SQL_DECIDED} SELECT dataset_id, 'Dataset ' || dataset_id || ': ' || count(*) || ' records, ' || count(*) FILTER (decision = 'INCLUDE') || ' included, ' || count(*) FILTER (decision = 'EXCLUDE') || ' excluded, '
|| count(*) FILTER (decision = 'REVIEW') || ' to review, statuses ' || string_agg(DISTINCT status, ', ' ORDER BY status) AS line FROM decided GROUP BY 1""")
def report_lines(spark, sf):
    """One line of the report for each dataset, from aggregates only."""
    g = evaluated(spark, sf).groupBy("dataset_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("decision") == d).alias(d) for d in ("INCLUDE", "EXCLUDE", "REVIEW")], F.array_join(F.array_sort(F.collect_set("status")), ", ").alias("s"))
    return g.select("dataset_id", F.format_string("Dataset %s: %d records, %d included, %d excluded, %d to review, statuses %s", "dataset_id", "n", "INCLUDE", "EXCLUDE", "REVIEW", "s").alias("line"))
