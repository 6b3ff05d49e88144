"""Queries over grids of many layouts, records of unknown keys, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import audit, blueprints, curation, discovery, documents, knowledge, ledger, lineage, normalise, relational, runs, tables, validation
from ..session import remove, settled, shared_folder, spread
from ..sources import paged
from . import records as R
from . import slate
from .more import ORACLES, QUERIES, SQL_LINES, TOPS, _family, _tests
from .slate import evaluated, query, quoted, table, validated

__all__ = ["ORACLES", "QUERIES"]

# ---- tables that find their own header ---------------------------------------------------------

_FIELDS = {
    "saqa": "CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 31 = 5 THEN 'no. 12' WHEN p_partkey % 37 = 4 THEN '123' ELSE CAST(90000 + p_partkey AS VARCHAR(19)) END",
    "title": R._pick(R.TITLES, "p_partkey"), "level": R._pick(R.LEVELS, "p_partkey"), "fw": "CASE p_partkey % 2 WHEN 0 THEN 'OQSF' ELSE '' END",
    "ns": "CASE p_partkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE '' END", "col": R._pick(R.COLLEGES, "p_partkey"),
    "code": R._pick(R.CODES, "p_partkey"), "rank": "CASE p_partkey % 3 WHEN 0 THEN '' ELSE '2' END", "prov": R._pick(R.REGIONS, "p_partkey"),
}
#: Layouts of qualification lists: the three rows at the top, then the order of a row's cells.
QUALIFICATION_LAYOUTS = [
    (["SAQA ID|Qualification Title|NQF Level|Sub-Framework|NSFAS Funded|TVET College", "", ""], ["saqa", "title", "level", "fw", "ns", "col"]),
    (["List of programmes||", "College|Level|Learning Programme|Code", ""], ["col", "level", "title", "saqa"]),
    (["", "", ""], ["saqa", "title", "level", "fw", "ns", "col"]),
    (["", "Annexure B", "Occupational qualification|Qual ID|Campus"], ["title", "saqa", "col"]),
    (["Name|Remarks|Rest|More", "|", " "], ["saqa", "title", "level", "fw"]),
    (["NQF|Sub-framework", "", ""], ["saqa", "title", "level"]),
    (["Learning Programme|Type|Bursary|SAQA", "SAQA ID|Qualification", ""], ["title", "fw", "ns", "saqa"]),
]
OCCUPATION_LAYOUTS = [
    (["OFO Code|Occupation|Rank|Province", "", ""], ["code", "title", "rank", "prov"]),
    (["", "Region|Job Title|Unit Group", ""], ["prov", "title", "code"]),
    (["", "", ""], ["code", "title", "rank"]),
    (["Occupation title|Code", "OFO Code|x", ""], ["title", "code"]),
]
SIZE = 25


def _sheet(layouts: list, part: str) -> str:
    """Lines of sheets in SQL that both engines read: every SIZE parts are one table."""
    n = f"CAST(floor((p_partkey - 1) / {SIZE}) AS BIGINT)"
    kind = f"{n} % {len(layouts)}"

    def line(cells):
        return "concat(" + ", '|', ".join(_FIELDS[c] for c in cells) + ")"

    body = f"CASE {kind} " + " ".join(f"WHEN {i} THEN {line(cells)}" for i, (_, cells) in enumerate(layouts)) + " END"
    tops = [f"SELECT {n}, CAST({k} AS BIGINT), CASE {kind} " + " ".join(f"WHEN {i} THEN '{top[k]}'" for i, (top, _) in enumerate(layouts)) + f" END FROM {part} WHERE (p_partkey - 1) % {SIZE} = 0" for k in range(3)]
    return f"SELECT {n} AS table_id, CAST((p_partkey - 1) % {SIZE} + 3 AS BIGINT) AS row_index, {body} AS line FROM {part} UNION ALL " + " UNION ALL ".join(tops)


def sheet(spark, sf, layouts):
    spread(table(spark, sf, "part"), "p_partkey").createOrReplaceTempView("__parts")
    return spark.sql(_sheet(layouts, "__parts")).select("table_id", "row_index", F.split("line", r"\|").alias("cells"))


def _sql_fields(layouts, aliases, needed, least_cells, defaults, skip) -> str:
    """The body of a WITH clause up to nm, the named fields of every row."""
    out = f"""g AS (SELECT table_id, row_index, list_transform(string_split(line, '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS c FROM ({_sheet(layouts, 'part')})),
p0 AS (SELECT table_id, row_index, list_transform(c, lambda x: lower(x)) AS lo, CAST([] AS BIGINT[]) AS u FROM g WHERE row_index < 3)"""
    for k, (_, words) in enumerate(aliases):
        hit = " OR ".join(f"contains(x, '{w}')" for w in words)
        out += f",\np{k + 1} AS (SELECT table_id, row_index, lo, list_append(u, coalesce(list_position(list_transform(lo, lambda x, i: ({hit}) AND NOT list_contains(u, i)), true), 0)) AS u FROM p{k})"
    out += f""",
hd AS (SELECT table_id, min(row_index) AS header_row, arg_min(u, row_index) AS u FROM p{len(aliases)} WHERE len(list_filter(u, lambda i: i > 0)) >= 2 GROUP BY 1),
b AS (SELECT g.table_id, g.row_index, header_row, c, coalesce(u, CAST([0] AS BIGINT[])) AS u FROM g LEFT JOIN hd USING (table_id) WHERE (header_row IS NULL OR g.row_index > header_row) AND len(list_filter(c, lambda x: x <> '')) > 0
  AND NOT ({' OR '.join(f"contains(lower(c[1]), '{w}')" for w in skip)}))"""
    names = [f for f, _ in aliases]
    ok = " AND ".join(f"coalesce(u[{names.index(n) + 1}], 0) > 0" for n in needed)
    cells = ", ".join(
        f"CASE WHEN {ok} THEN CASE WHEN u[{i + 1}] > 0 THEN coalesce(c[u[{i + 1}]], '{defaults.get(f, '')}') ELSE '{defaults.get(f, '')}' END WHEN len(c) >= {least_cells} THEN coalesce(c[{i + 1}], '{defaults.get(f, '')}') ELSE '{defaults.get(f, '')}' END AS {f}"
        for i, f in enumerate(names))
    return out + f",\nnm AS (SELECT table_id, row_index, header_row, {cells} FROM b)"


def _sql_joined(column: str, separator: str) -> str:
    """A column of a record with the texts of the rows that continue it."""
    more = f"list({column} ORDER BY row_index) FILTER (NOT st AND {column} <> '')"
    strip = f"trim(a || '{separator}' || x, '{separator}')"
    return f"list_reduce(list_concat([max({column}) FILTER (st)], coalesce({more}, [])), lambda a, x: {strip}) AS {column}"


_quals = _sql_fields(QUALIFICATION_LAYOUTS, K.QUALIFICATION_ALIASES, ["saqa_id", "qualification"], 4, {"nsfas_eligible": "No"}, K.QUALIFICATION_HEADER_WORDS)


@query(f"""WITH {_quals}, cl AS (SELECT * REPLACE (regexp_replace(trim(regexp_replace(participating_colleges, '[\\r\\n•·]+', '; ', 'g')), '\\s*;\\s*', '; ', 'g') AS participating_colleges) FROM nm),
st AS (SELECT *, regexp_matches(saqa_id, '[0-9]{{4,7}}') AS st FROM cl WHERE regexp_matches(saqa_id, '[0-9]{{4,7}}') OR NOT regexp_matches(saqa_id, '[0-9]{{3,}}')),
nb AS (SELECT *, sum(st::INT) OVER (PARTITION BY table_id ORDER BY row_index ROWS UNBOUNDED PRECEDING) AS n FROM st)
SELECT table_id, min(row_index) AS row_index, max(header_row) AS header_row, max(saqa_id) FILTER (st) AS saqa_id, {_sql_joined('qualification', ' ')}, max(nqf_level) FILTER (st) AS nqf_level, max(framework) FILTER (st) AS framework,
max(nsfas_eligible) FILTER (st) AS nsfas_eligible, {_sql_joined('participating_colleges', '; ')}, CAST(0.96 AS DOUBLE) AS confidence FROM nb WHERE n > 0 GROUP BY table_id, n""")
def grid_qualifications(spark, sf):
    return tables.qualifications(sheet(spark, sf, QUALIFICATION_LAYOUTS))


_jobs = _sql_fields(OCCUPATION_LAYOUTS, K.OCCUPATION_ALIASES, ["ofo_code", "occupation_title"], 3, {"demand_rank": "1", "province": "National"}, K.OCCUPATION_HEADER_WORDS)


@query(f"""WITH {_jobs}, st AS (SELECT *, regexp_matches(ofo_code, '^[0-9]{{4,6}}$') AS st FROM nm WHERE regexp_matches(ofo_code, '^[0-9]{{4,6}}$') OR (ofo_code = '' AND occupation_title <> '')),
nb AS (SELECT *, sum(st::INT) OVER (PARTITION BY table_id ORDER BY row_index ROWS UNBOUNDED PRECEDING) AS n FROM st)
SELECT table_id, min(row_index) AS row_index, max(header_row) AS header_row, max(ofo_code) FILTER (st) AS ofo_code, {_sql_joined('occupation_title', ' ')}, max(demand_rank) FILTER (st) AS demand_rank, max(major_group) FILTER (st) AS major_group,
max(province) FILTER (st) AS province, max(educational_qualification_req) FILTER (st) AS educational_qualification_req, CAST(0.94 AS DOUBLE) AS confidence FROM nb WHERE n > 0 GROUP BY table_id, n""")
def grid_occupations(spark, sf):
    return tables.occupations(sheet(spark, sf, OCCUPATION_LAYOUTS))


@query(f"WITH {_quals} SELECT table_id, header_row, array_to_string(list_transform(u, lambda x: x - 1), ',') AS places FROM hd")
def grid_headers(spark, sf):
    found = tables.table_headers(sheet(spark, sf, QUALIFICATION_LAYOUTS), K.QUALIFICATION_ALIASES)
    return found.select("table_id", "header_row", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("places"))


# ---- all tables of a document under the columns of its first -----------------------------------

#: Headers of tables in a document, by turns, and the cells of their rows.
DOCUMENT_LAYOUTS = [
    ("SAQA ID|Qualification Title|NQF Level|TVET College", ["saqa", "title", "level", "col"]),
    ("Programme|Provider Campus|SAQA|Level", ["title", "col", "saqa", "level"]),
    ("Level|Institution|Curriculum number|Qualification|Remarks", ["level", "col", "saqa", "title", "fw"]),
    ("Title|Title|Number", ["title", "fw", "saqa"]),
    ("|x", ["saqa", "title", "level", "col"]),
]
PER_TABLE, PER_DOC = 8, 4


def _doc_rows(part: str) -> tuple[str, str]:
    """Headers and rows of documents of PER_DOC tables, two on a page, in SQL that both engines read. Documents begin with different layouts."""
    t = f"CAST(floor((p_partkey - 1) / {PER_TABLE}) AS BIGINT)"
    doc = f"CAST(floor((p_partkey - 1) / {PER_TABLE * PER_DOC}) AS BIGINT)"
    kind = f"({t} + {doc}) % {len(DOCUMENT_LAYOUTS)}"
    place = f"{doc} AS doc, CAST(floor(({t} % {PER_DOC}) / 2) + 1 AS BIGINT) AS page, {t} % 2 AS table_index"
    head = f"CASE {kind} " + " ".join(f"WHEN {i} THEN '{h}'" for i, (h, _) in enumerate(DOCUMENT_LAYOUTS)) + " END"
    line = f"CASE {kind} " + " ".join("WHEN " + str(i) + " THEN concat(" + ", '|', ".join(_FIELDS[c] for c in cells) + ")" for i, (_, cells) in enumerate(DOCUMENT_LAYOUTS)) + " END"
    # some rows repeat the table's own header, as after a page break
    line = f"CASE WHEN p_partkey % 11 = 7 THEN {head} ELSE {line} END"
    return f"SELECT {place}, {head} AS head FROM {part} WHERE (p_partkey - 1) % {PER_TABLE} = 0", f"SELECT {place}, CAST((p_partkey - 1) % {PER_TABLE} AS BIGINT) AS row_index, {line} AS line FROM {part}"


def document_tables(spark, sf):
    spread(table(spark, sf, "part"), "p_partkey").createOrReplaceTempView("__parts")
    heads, rows = (spark.sql(q) for q in _doc_rows("__parts"))
    return heads.withColumn("headers", F.split("head", r"\|")).drop("head"), rows.withColumn("cells", F.split("line", r"\|")).drop("line")


def _sql_snake(x: str) -> str:
    x = f"regexp_replace(trim({x}), '[^A-Za-z0-9_\\s-]', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[\\s-]+', '_', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')"
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({x}), '_+', '_', 'g'), '^_|_$', '', 'g'), ''), 'column')"


def _sql_any(x: str, parts: list[str]) -> str:
    return "(" + (" OR ".join(f"contains({x}, '{p}')" for p in parts) or "false") + ")"


def _sql_places(width: int) -> str:
    """CTEs w0 to w{width}: the headers take columns in turn; u holds the header of each column, 0 for none."""
    out = "w0 AS (SELECT *, list_transform(cols, lambda c: CAST(0 AS BIGINT)) AS u FROM kn)"
    for j in range(1, width + 1):
        kin = "CASE " + " ".join(
            f"WHEN {_sql_any('lo', a)} AND NOT {_sql_any('lo', b)} THEN list_position(list_transform(cols, lambda c, k: u[k] = 0 AND {_sql_any('c', c)} AND NOT {_sql_any('c', d)}), true)" for a, b, c, d in K.HEADER_FAMILIES) + " END"
        alike = "list_position(list_transform(cols, lambda c, k: u[k] = 0 AND (c = sn OR starts_with(sn, c) OR starts_with(c, sn))), true)"
        out += f""",
v{j} AS (SELECT *, lower(h[{j}]) AS lo, {_sql_snake(f'h[{j}]')} AS sn FROM w{j - 1}),
y{j} AS (SELECT *, CASE WHEN coalesce(h[{j}], '') <> '' THEN coalesce(nullif({alike}, 0), nullif({kin}, 0)) END AS k{j} FROM v{j}),
w{j} AS (SELECT * EXCLUDE (u, lo, sn, k{j}), list_transform(u, lambda x, k: CASE WHEN k = k{j} THEN {j} ELSE x END) AS u FROM y{j})"""
    return out


def _sql_documents() -> str:
    heads, rows = _doc_rows("part")
    tidy = "list_transform(string_split({}, '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
    joint = "CASE WHEN x[2:] = '' THEN a WHEN a = '' THEN x[2:] WHEN contains(lower(a), lower(x[2:])) THEN a WHEN x[1] = '1' OR contains(a, ';') OR contains(x, ';') THEN trim(a || '; ' || x[2:], '; ') ELSE a || ' ' || x[2:] END"
    cell = f"list_reduce(list_concat([arg_min(coalesce(c[{{0}}], ''), r)], coalesce(list(coalesce(f[{{0}}], '0') ORDER BY r) FILTER (NOT nw), [])[1:]), lambda a, x: {joint})"
    return f"""hd AS (SELECT *, {tidy.format('head')} AS h FROM ({heads})),
fi AS (SELECT doc, arg_min(h, (page, table_index)) AS first FROM hd GROUP BY 1),
cn AS (SELECT doc, first, list_transform(first, lambda x: {_sql_snake('x')}) AS n FROM fi),
kn AS (SELECT hd.doc, page, table_index, h, first, list_transform(n, lambda x, i: CASE WHEN len(list_filter(n[1:i - 1], lambda y: y = x)) = 0 THEN x ELSE x || '_' || (len(list_filter(n[1:i - 1], lambda y: y = x)) + 1) END) AS cols FROM hd JOIN cn ON hd.doc = cn.doc),
{_sql_places(5)},
mp AS (SELECT *, CASE WHEN len(list_filter(u, lambda x: x > 0)) >= 2 THEN u ELSE list_transform(u, lambda x, k: CAST(k AS BIGINT)) END AS ats, greatest(coalesce(list_position(list_transform(h, lambda x: regexp_matches(lower(x), '\\b(saqa|ofo|code|id|number|no\\.?)\\b')), true), 1), 1) AS id_at,
  list_transform(h, lambda x: {_sql_any('lower(x)', K.INSTITUTION_PARTS)}) AS li, list_filter(list_transform(first, lambda x: lower(x)), lambda x: x <> '') AS canon FROM w5),
ro AS (SELECT *, {tidy.format('line')} AS c FROM ({rows})),
bd AS (SELECT ro.*, cols, ats, li, coalesce(c[id_at], '') <> '' AS has_id, (page, table_index, row_index) AS r FROM ro JOIN mp USING (doc, page, table_index) WHERE len(list_filter(c, lambda x: x <> '')) > 0
  AND NOT (len(canon) >= 2 AND len(c) >= 2 AND len(list_filter(canon, lambda x: list_contains(list_transform(c, lambda y: lower(y)), x))) >= 2)),
nw AS (SELECT *, has_id OR row_number() OVER w = 1 AS nw, list_transform(c, lambda x, i: CASE WHEN coalesce(li[i], false) THEN '1' ELSE '0' END || x) AS f FROM bd WINDOW w AS (PARTITION BY doc ORDER BY r)),
rn AS (SELECT *, sum(nw::INT) OVER (PARTITION BY doc ORDER BY r ROWS UNBOUNDED PRECEDING) AS record_no, max(len(c)) OVER (PARTITION BY doc) AS width FROM nw),
pk AS (SELECT doc, record_no, [{', '.join(cell.format(i) for i in range(1, 6))}] AS c, max(len(c)) AS width, arg_min(cols, r) AS cols, arg_min(ats, r) AS ats, arg_min(page, r) AS page, arg_min(table_index, r) AS table_index, arg_min(row_index, r) AS row_index, count(*) AS n_rows FROM rn GROUP BY 1, 2),
sp AS (SELECT *, list_filter(range(1, width + 1), lambda i: NOT list_contains(ats, i)) AS spare FROM pk)
SELECT doc, CAST(record_no AS BIGINT) AS record_no, array_to_string(list_transform(cols, lambda n, k: n || '=' || coalesce(c[CASE WHEN ats[k] > 0 THEN CASE WHEN ats[k] <= width THEN ats[k] END ELSE spare[len(list_filter(ats[1:k], lambda y: y = 0))] END], '')), '|') AS record,
page, table_index, row_index, CAST(n_rows AS INT) AS n_rows FROM sp"""


@query("WITH " + _sql_documents())
def document_records(spark, sf):
    found = tables.document_records(*document_tables(spark, sf))
    line = F.array_join(F.transform(F.map_entries("record"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return found.withColumn("record", line)


# ---- records of unknown keys -------------------------------------------------------------------

#: Raw values by turns; note has ligatures, quotes, spaces and forms beyond ASCII.
RAW = {
    "ofo_code": ['"007"', '"0421"', "12", '"1.5"', '"yes"'], "region": ['"gp"', '" KZN "', '"Mars"', '"N/A"', '""', '"National"'], "flag": ['"Yes"', '"no"', '"True"', '"maybe"', "true"],
    "amount": ['"0012"', "-7", '"3.50"', '"1e3"', '" "', '" 5 "', '"-000"'], "note": ['"ﬁne  “quoted”"', '"a b"', '"plain"', "null", '"½ – ½"', '"ＡＢＣ"', '"​"'],
}
_raw = "concat(substr(props, 1, length(props) - 1), " + ", ".join(f"', \"{k}\": ', {R._pick(v, f'(event_id + {n}) % 1009')}" for n, (k, v) in enumerate(RAW.items())) + ", CASE WHEN event_id % 13 = 5 THEN ', \"extra_id\": \"000\"' ELSE '' END, '}')"
#: One text in ten is no JSON.
JSON = f"CASE WHEN event_id % 10 = 9 THEN 'no json' ELSE {_raw} END"
_regions = "CASE lower(x) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.PROVINCES.items()) + " END"
_plain = "replace(replace(replace(replace(replace(replace(replace(replace(replace(raw, chr(8203), ''), 'ﬁ', 'fi'), chr(160), ' '), '“', '\"'), '”', '\"'), '½', '1⁄2'), 'ＡＢＣ', 'ABC'), '–', '-'), '—', '-')"
SQL_RECORDS = f"""j AS (SELECT event_id, {JSON} AS j FROM events), v AS (SELECT event_id, CAST(j AS JSON) AS j FROM j WHERE j <> 'no json'),
f AS (SELECT event_id, field, json_extract_string(j, '$."' || field || '"') AS raw FROM (SELECT event_id, j, unnest(json_keys(j)) AS field FROM v)),
c AS (SELECT *, trim(regexp_replace({_plain}, '\\s+', ' ', 'g')) AS x, regexp_matches(lower(field), '{'|'.join(K.CODE_FIELD_PARTS)}') AS code FROM f),
k AS (SELECT *, CASE WHEN x IS NULL OR lower(x) IN ({', '.join(repr(t) for t in K.NULL_TOKENS)}) THEN 'null' WHEN NOT code AND regexp_matches(x, '^-?[0-9]+$') THEN 'integer' WHEN NOT code AND regexp_matches(x, '^-?[0-9]+\\.[0-9]+$') THEN 'float'
WHEN lower(x) IN ('yes', 'true', 'y', 'no', 'false', 'n') THEN 'boolean' ELSE 'string' END AS kind, CASE WHEN regexp_matches(lower(field), 'prov|region') THEN {_regions} END AS region FROM c),
nr AS (SELECT event_id, field, raw, kind, CASE kind WHEN 'integer' THEN CAST(CAST(x AS BIGINT) AS VARCHAR) WHEN 'float' THEN x WHEN 'boolean' THEN CASE WHEN lower(x) IN ('yes', 'true', 'y') THEN 'true' ELSE 'false' END WHEN 'string' THEN coalesce(region, x) END AS value,
CASE WHEN raw IS NULL THEN false ELSE CASE kind WHEN 'null' THEN trim(raw) <> '' WHEN 'boolean' THEN raw <> CASE WHEN lower(x) IN ('yes', 'true', 'y') THEN 'True' ELSE 'False' END WHEN 'string' THEN CASE WHEN region IS NULL THEN x <> raw ELSE region <> x END ELSE raw <> x END END AS changed FROM k)"""


def raw_records(spark, sf):
    e = spread(table(spark, sf, "events"), "event_id").select("event_id", F.expr(JSON).alias("json"))
    return e.select("event_id", normalise.parsed(F.col("json")).alias("raw")).where("raw is not null").select("event_id", normalise.normalised(F.col("raw")).alias("record"))


@query(f"WITH {SQL_RECORDS} SELECT event_id, field, raw, kind, value, changed FROM nr")
def record_normalise(spark, sf):
    # explode() would have its record tested first, which works it out again for each test
    cells = raw_records(spark, sf).select("event_id", F.explode_outer("record").alias("field", "v")).where("field is not null")
    return cells.select("event_id", "field", "v.raw", "v.kind", "v.value", "v.changed")


@query(f"""WITH {SQL_RECORDS} SELECT event_id, max(TRY_CAST(value AS BIGINT)) FILTER (field = 'k') AS k, max(value) FILTER (field = 'ofo_code') AS ofo_code, max(TRY_CAST(value AS DOUBLE)) FILTER (field = 'amount') AS amount,
bool_or(CASE WHEN kind = 'boolean' THEN value = 'true' END) FILTER (field = 'flag') AS flag, max(value) FILTER (field = 'note') AS note FROM nr GROUP BY 1""")
def record_variant(spark, sf):
    v = raw_records(spark, sf).select("event_id", normalise.as_variant(F.col("record")).alias("v"))
    typed = {"k": "bigint", "ofo_code": "string", "amount": "double", "flag": "boolean", "note": "string"}
    return v.select("event_id", *[F.try_variant_get("v", f"$.{f}", t).alias(f) for f, t in typed.items()])


# ---- runs that replace earlier ones ------------------------------------------------------------


def _read_from(spark, folder: str, df):
    """df, which reads folder, as it is now; the folder goes."""
    out = settled(df)
    remove(spark, folder)
    return out


def _two_runs(spark, sf) -> str:
    """A store after a run over all datasets, one over half the records of ds0 and ds1, and one over ds2 that never commits."""
    folder = shared_folder(spark, "runs")
    e = evaluated(spark, sf)
    runs.run(e, folder, "first", "occupational_relevance")
    runs.run(e.where("dataset_id in ('ds0', 'ds1') and row_index % 2 = 0"), folder, "second", "occupational_relevance")
    runs.write_tables(e.where("dataset_id = 'ds2' and row_index % 3 = 0"), folder, "broken", "occupational_relevance")
    return folder


@query(f"WITH {slate.SQL_DECIDED} SELECT row_index, dataset_id, decision, CASE WHEN dataset_id IN ('ds0', 'ds1') THEN 'second' ELSE 'first' END AS run_id FROM decided WHERE dataset_id NOT IN ('ds0', 'ds1') OR row_index % 2 = 0")
def run_replaced(spark, sf):
    folder = _two_runs(spark, sf)
    return _read_from(spark, folder, runs.current(spark, folder, "decisions").select("row_index", "dataset_id", "decision", "run_id"))


@query(f"""WITH {slate.SQL_DECIDED} SELECT row_index, dataset_id, seq, CASE seq WHEN 1 THEN 'unprocessed' ELSE decision END AS previous_value, decision AS new_value, reason_code AS reason
FROM decided, (VALUES (1::BIGINT), (2)) s(seq) WHERE seq = 1 OR (dataset_id IN ('ds0', 'ds1') AND row_index % 2 = 0)""")
def run_ledger(spark, sf):
    folder = _two_runs(spark, sf)
    return _read_from(spark, folder, runs.ledger(spark, folder).select("row_index", "dataset_id", "seq", "previous_value", "new_value", "reason"))


@query(f"""WITH e AS ({ORACLES['evidence_items']}), r AS (SELECT p_partkey + 1 AS row_index, concat('ds', CAST(p_size % 4 AS VARCHAR)) AS dataset_id FROM part)
SELECT dataset_id, evidence_type, count(*) AS n FROM e JOIN r USING (row_index) WHERE dataset_id NOT IN ('ds0', 'ds1') OR row_index % 2 = 0 GROUP BY ALL""")
def run_evidence(spark, sf):
    folder = _two_runs(spark, sf)
    return _read_from(spark, folder, runs.current(spark, folder, "evidence").groupBy("dataset_id", "evidence_type").agg(F.count("*").alias("n")))


# ---- lineage as of a time ----------------------------------------------------------------------

#: One change in seven happened five hours before it was written down.
CHANGES = "SELECT user_id + 1 AS row_index, ts - CASE WHEN event_id % 7 = 0 THEN INTERVAL '5' HOUR ELSE INTERVAL '0' HOUR END AS at, event_id AS seq, CASE event_type WHEN 'click' THEN 'INCLUDE' WHEN 'error' THEN NULL ELSE upper(event_type) END AS new_value FROM {events} WHERE event_type <> 'view'"


def changes(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("__events")
    return spark.sql(CHANGES.format(events="__events"))


@query(f"""WITH c AS ({CHANGES.format(events='events')}), p AS (SELECT event_id, user_id + 1 AS row_index, ts AS at FROM events WHERE event_type = 'view')
SELECT event_id, p.row_index, c.seq, c.new_value FROM p ASOF LEFT JOIN c ON p.row_index = c.row_index AND p.at >= c.at""")
def state_as_of(spark, sf):
    points = table(spark, sf, "events").where("event_type = 'view'").select("event_id", (F.col("user_id") + 1).alias("row_index"), F.col("ts").alias("at"))
    return lineage.as_of(points, changes(spark, sf), "row_index", "at", "seq", ["seq", "new_value"]).drop("at")


@query(f"""WITH {slate.SQL_DECIDED}, i AS (SELECT row_index, count(*) AS n FROM iss GROUP BY 1),
s AS (SELECT d.row_index, status, decision, reason_code, coalesce(i.n, 0) AS n, title, CASE d.row_index % 9 WHEN 0 THEN 'checked' WHEN 1 THEN '' END AS notes, TIMESTAMP '2024-01-01' + to_days(CAST(d.row_index % 30 AS INTEGER)) AS c FROM decided d LEFT JOIN i ON i.row_index = d.row_index),
x AS (SELECT row_index, 1 AS step, 'EXTRACTION' AS stage, 'Extractor (table)' AS actor, 'completed' AS status, 'page ' || row_index // 40 AS detail, c AS at FROM s
UNION ALL SELECT row_index, 2, 'NORMALIZATION', 'Normalizer', 'completed', CASE WHEN title <> trim(regexp_replace(title, '\\s+', ' ', 'g')) THEN 'values changed' ELSE 'values as they were' END, c FROM s
UNION ALL SELECT row_index, 3, 'CURATION', 'Curation Engine', lower(decision), coalesce(reason_code, ''), c + to_days(1) FROM s
UNION ALL SELECT row_index, 4, 'VALIDATION', 'Validator', CASE WHEN n > 0 THEN 'warning' ELSE 'passed' END, n || ' issues', c FROM s
UNION ALL SELECT row_index, 5, 'HUMAN_REVIEW', 'Human Operator', 'approved', 'checked', c + to_days(1) FROM s WHERE notes = 'checked'),
l AS (SELECT k.*, row_number() OVER (PARTITION BY row_index ORDER BY "at", seq) AS k, lag(coalesce(new_value, ''), 1, '') OVER (PARTITION BY row_index ORDER BY "at", seq) AS before FROM ({CHANGES.format(events='events')}) k)
SELECT row_index, CAST(step AS INT) AS step, stage, actor, status, detail, "at" FROM x UNION ALL SELECT l.row_index, CAST(m.n + k AS INT), 'REVIEW', 'person', 'recorded', before || ' -> ' || coalesce(new_value, ''), "at" FROM l JOIN (SELECT row_index, max(step) AS n FROM x GROUP BY 1) m USING (row_index)""")
def record_lineage(spark, sf):
    e = evaluated(spark, sf)
    created = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(row_index % 30 as int))")
    notes = F.expr("CASE row_index % 9 WHEN 0 THEN 'checked' WHEN 1 THEN '' END")
    made = lineage.steps(
        e, "row_index", F.expr("row_index div 40"), F.lit("table"), F.col("title") != X.collapse(F.col("title")), F.size("issues"), notes, created, created + F.expr("interval '1' day"))
    log = changes(spark, sf).withColumns({"stage": F.lit("REVIEW"), "actor": F.lit("person")})
    before = F.lag(F.coalesce("new_value", F.lit("")), 1, "").over(Window.partitionBy("row_index").orderBy("at", "seq"))
    return lineage.with_ledger(made, log.withColumn("previous_value", before), "row_index", "at", "seq")


# ---- pages of files ----------------------------------------------------------------------------

#: Conversations of a file.
PER_FILE = 20
FILES = f"SELECT CAST(floor(conv_id / {PER_FILE}) AS BIGINT) AS f, conv_id, turn, concat(coalesce(text, ''), CASE WHEN conv_id % 3 = 0 THEN concat(chr(10), 'a|b', chr(10), 'c|d', chr(10), 'x', chr(10), 'k|l', chr(10), 'm|n') ELSE '' END) AS t FROM {{c}}"


def _files(spark, sf) -> str:
    """A folder of text files, one for every PER_FILE conversations, each turn a page."""
    folder = shared_folder(spark, "pages")
    table(spark, sf, "conversations").createOrReplaceTempView("__conversations")
    rows = spark.sql(FILES.format(c="__conversations"))
    whole = rows.groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "t"))), lambda r: r["t"]), "\f").alias("value"))
    # a line feed would end a row of the text writer, not of the file
    whole.repartition("f").write.partitionBy("f").option("lineSep", "\n").text(folder)
    return folder


_pages = f"x AS ({FILES.format(c='conversations')}), pg AS (SELECT f, row_number() OVER (PARTITION BY f ORDER BY conv_id, turn) AS page, count(*) OVER (PARTITION BY f) AS n, t FROM x)"


@query(f"WITH {_pages} SELECT f, CAST(page AS INT) AS page, CASE WHEN page = n THEN t || chr(10) ELSE t END AS text, 'text' AS parser FROM pg WHERE page BETWEEN 2 AND 9")
def paged_range(spark, sf):
    folder = _files(spark, sf)
    found = paged.pages(spark, folder).where("page between 2 and 9")
    return _read_from(spark, folder, found.select(F.regexp_extract("path", "/f=([0-9]+)/", 1).cast("bigint").alias("f"), "page", "text", "parser"))


@query(f"""WITH {_pages}, ln AS (SELECT f, page, list_transform(string_split(t, chr(10)), lambda l: len(list_filter(regexp_split_to_array(l, '\\||\\t'), lambda c: trim(c, ' ') <> '')) >= 2) AS l FROM pg),
tb AS (SELECT f, page, len(list_filter(range(1, len(l) + 1), lambda i: l[i] AND i > 1 AND l[i - 1] AND NOT (i > 2 AND l[i - 2]))) AS k FROM ln)
SELECT f, count(*) AS page_count, bool_or(page = 1 AND trim(t) <> '') AS has_text_layer, max(CASE WHEN page = 1 THEN substr(CASE WHEN page = n THEN t || chr(10) ELSE t END, 1, 2000) END) AS preview, CAST(sum(k) FILTER (page <= 5) AS BIGINT) AS table_count FROM pg JOIN tb USING (f, page) GROUP BY 1""")
def paged_facts(spark, sf):
    folder = _files(spark, sf)
    facts = paged.file_facts(paged.pages(spark, folder))
    return _read_from(spark, folder, facts.select(F.regexp_extract("path", "/f=([0-9]+)/", 1).cast("bigint").alias("f"), "page_count", "has_text_layer", "preview", "table_count"))


@query(f"""WITH {_quals}, cl AS (SELECT DISTINCT table_id AS doc FROM nm WHERE regexp_matches(saqa_id, '[0-9]{{4,7}}')),
d AS (SELECT DISTINCT table_id AS doc FROM g), gn AS (SELECT table_id AS doc, count(*) FILTER (len(list_filter(c, lambda x: x <> '')) >= 3) AS n FROM g WHERE row_index >= 3 AND table_id % 6 <> 5 GROUP BY 1)
SELECT d.doc, CASE WHEN cl.doc IS NOT NULL THEN 'qualifications' WHEN gn.n > 0 THEN 'generic' END AS extractor, CASE WHEN cl.doc IS NULL AND coalesce(gn.n, 0) = 0 THEN 'no tables or records were found' END AS error FROM d LEFT JOIN cl ON cl.doc = d.doc LEFT JOIN gn ON gn.doc = d.doc""")
def extraction_fallback(spark, sf):
    rows = sheet(spark, sf, QUALIFICATION_LAYOUTS)
    special = tables.qualifications(rows).withColumnRenamed("table_id", "doc")
    # some documents have no tables for the general reader either
    filled = F.size(F.filter(tables.tidy(F.col("cells")), lambda c: c != ""))
    generic = rows.where((F.col("row_index") >= 3) & (filled >= 3) & (F.col("table_id") % 6 != 5)).select(F.col("table_id").alias("doc"), "cells")
    return paged.with_fallback(rows.select(F.col("table_id").alias("doc")), [("qualifications", special), ("generic", generic)])[1]


_kind = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{k}'" for p, k in [("llm|ai", "llm"), ("qual|tvet", "qualifications"), ("occup|oihd|ofo", "occupations"), ("codebook|qlfs|survey", "codebook")]) + " ELSE 'generic' END"


@query(f"WITH t AS (SELECT doc_id, lower(CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE {R._pick(['OIHD list', 'tvet', 'generic', 'Survey 2', 'x'], 'doc_id')} END) AS x FROM documents) SELECT doc_id, {_kind} AS extractor FROM t")
def extractor_choice(spark, sf):
    asked = F.expr(f"CASE WHEN doc_id % 3 = 0 THEN 'auto' ELSE {R._pick(['OIHD list', 'tvet', 'generic', 'Survey 2', 'x'], 'doc_id')} END")
    return table(spark, sf, "documents").select("doc_id", paged.chosen_extractor(F.col("text"), asked).alias("extractor"))


# ---- stated counts with their place, groups of tables ------------------------------------------

#: Texts by turns; ~ is a line feed.
STATED = [
    "The study mapped all the 167 occupations in full~and identified 42 trades, total 12 items.", "Nothing stated here", "12 OIHD and 12 oihd; TOTAL  OCCUPATIONS 1670~of the list of 9 skills", "subtotal 8 items, a total 8 items",
    "é total 31 qualifications — 4 oihd", "total occupations 167 in all; 99 occupations in high demand",
]
PAGED = f"SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS doc, CAST(p_partkey % 12 AS BIGINT) AS page, concat(p_name, ' ', replace({R._pick(STATED, '(p_partkey * 5 + p_size)')}, '~', chr(10)), ' ', p_type, ' ', replace({R._pick(STATED, 'p_size')}, '~', chr(10))) AS text FROM {{p}}"


def _marked(n: int, p: str) -> str:
    """A pattern's matches by the text between them, found one after the other."""
    return f"""c{n} AS (SELECT doc, page, text, string_split_regex(text, '(?i){p}') AS gaps, regexp_extract_all(text, '(?i){p}') AS hits, regexp_extract_all(text, '(?i){p}', 1) AS nums FROM pg),
m{n} AS (SELECT doc, page, {n} AS kind, text, len(array_to_string(gaps[1:i], '')) + len(array_to_string(hits[1:i - 1], '')) AS at, length(hits[i]) AS size, CAST(nums[i] AS INT) AS stated FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM c{n}))"""


@query(f"""WITH pg AS ({PAGED.format(p='part')}), {', '.join(_marked(n, p) for n, p in enumerate(K.STATED_PATTERNS))}, al AS ({' UNION ALL '.join(f'SELECT * FROM m{n}' for n in range(len(K.STATED_PATTERNS)))}),
x AS (SELECT *, trim(replace(substr(text, CAST(greatest("at" - 40, 0) + 1 AS BIGINT), CAST("at" - greatest("at" - 40, 0) + size + 40 AS BIGINT)), chr(10), ' '), ' ') AS context, row_number() OVER (PARTITION BY doc, stated ORDER BY page, kind, "at") AS n FROM al WHERE stated > 5)
SELECT doc, stated, page, context FROM x WHERE n = 1""")
def stated_contexts(spark, sf):
    spread(table(spark, sf, "part"), "p_partkey").createOrReplaceTempView("__parts")
    return discovery.stated_contexts(spark.sql(PAGED.format(p="__parts")), "doc")


CAPTIONS = ["Table 4: The final list", "table 4: the FINAL list", "", "Table 2: Sectors", "Annexure 1: Questions"]
ROLES = ["final_dataset", "evidence", "metadata", "survey", "unknown", "unknown"]
METADATA = f"""SELECT CAST(floor(p_partkey / 30) AS BIGINT) AS doc, CAST(floor((p_partkey % 30) * 2 / 3) + 1 AS BIGINT) AS page_start, CAST(floor((p_partkey % 30) * 2 / 3) + 1 + CASE WHEN p_size % 10 = 3 THEN 1 ELSE 0 END AS BIGINT) AS page_end,
CAST(p_partkey % 3 AS INT) AS table_index, {R._pick(CAPTIONS, '(p_partkey + p_size)')} AS caption, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS section_title, {R._pick(ROLES, 'p_size')} AS role, p_brand AS unit, CAST(p_size % 3 + 1 AS INT) AS column_count,
CAST(p_size AS BIGINT) AS row_count, p_partkey % 17 = 3 AS layout FROM {{p}}"""


@query(f"""WITH t AS ({METADATA.format(p='part')}), u AS (SELECT * FROM t WHERE NOT layout AND role <> 'metadata'),
l AS (SELECT *, lag(page_end) OVER w AS pe, lag(column_count) OVER w AS pc, lag(caption) OVER w AS pt, lag(role) OVER w AS pr FROM u WINDOW w AS (PARTITION BY doc ORDER BY page_start, table_index)),
s AS (SELECT *, sum(CASE WHEN pe IS NOT NULL AND page_start IN (pe, pe + 1) AND ((column_count = pc AND column_count > 1) OR (caption <> '' AND pt <> '' AND (lower(caption) = lower(pt) OR contains(lower(caption), 'table 4'))) OR role = pr) THEN 0 ELSE 1 END)
  OVER (PARTITION BY doc ORDER BY page_start, table_index ROWS UNBOUNDED PRECEDING) AS group_no FROM l)
SELECT doc, CAST(group_no AS BIGINT) AS group_no, coalesce(nullif(arg_min(caption, (page_start, table_index)), ''), 'Table from Page ' || min(page_start)) AS caption, coalesce(arg_min(coalesce(section_title, 'Unassigned Section'), (page_start, table_index)), '') AS section_title,
arg_min(role, (page_start, table_index)) AS role, arg_min(unit, (page_start, table_index)) AS unit, min(page_start) AS page_start, arg_max(page_end, (page_start, table_index)) AS page_end, count(*) AS n_tables, CAST(sum(row_count) AS BIGINT) AS row_count FROM s GROUP BY doc, group_no""")
def table_groups(spark, sf):
    spread(table(spark, sf, "part"), "p_partkey").createOrReplaceTempView("__parts")
    return discovery.table_groups(spark.sql(METADATA.format(p="__parts")))


# ---- coverage of parts, deletions over levels, rules as rows -----------------------------------

COVERED = {"title": "title", "province": None, "amount": "company_name", "pk": None, "company_name": None}


@query(f"""WITH {R.SQL}, c AS ({' UNION ALL '.join(f"SELECT dataset_id, '{c}' AS column_name, {c} AS v, {f'{c} IS DISTINCT FROM {raw}' if raw else 'false'} AS d FROM r" for c, raw in COVERED.items())})
SELECT dataset_id, column_name AS "column", count(*) AS total, count(*) FILTER (trim(v) <> '') AS filled, count(*) FILTER (trim(v) <> '' AND d) AS changed, CAST(round(CAST(count(*) FILTER (trim(v) <> '') AS DECIMAL(18,0)) * 100 / count(*), 1) AS DOUBLE) AS coverage_pct,
true AS same, true AS near FROM c GROUP BY ALL""")
def coverage_merge(spark, sf):
    r = R.records(spark, sf)
    parts = audit.coverage(r.where("row_index % 3 = 0"), COVERED).unionByName(audit.coverage(r.where("row_index % 3 <> 0"), COVERED))
    merged = audit.coverage_report(audit.merged_coverage(parts))
    once = audit.coverage_report(audit.coverage(r, COVERED)).select("dataset_id", "column", F.col("distinct_estimate").alias("once"))
    exact = r.select("dataset_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.col(c)), F.lit("")).alias("v")) for c in COVERED])).alias("x"))
    exact = exact.groupBy("dataset_id", "x.column").agg(F.count_distinct("x.v").alias("exact"))
    both = merged.join(once, ["dataset_id", "column"]).join(exact, ["dataset_id", "column"])
    # twelve bits leave a standard error of 1.6 %
    near = F.abs(F.col("distinct_estimate") - F.col("exact")) <= F.col("exact") * 0.1
    return both.select("dataset_id", "column", "total", "filled", "changed", F.col("coverage_pct").cast("double").alias("coverage_pct"), (F.col("distinct_estimate") == F.col("once")).alias("same"), near.alias("near"))


NODES = """SELECT concat('p', r_regionkey) AS id, CAST(NULL AS VARCHAR(20)) AS parent, 'project' AS kind FROM {region} UNION ALL SELECT concat('d', n_nationkey), concat('p', n_regionkey), 'dataset' FROM {nation}
UNION ALL SELECT concat('c', c_custkey), concat('d', c_nationkey), 'document' FROM {customer} UNION ALL SELECT concat('o', o_orderkey), concat('c', o_custkey), 'record' FROM {orders}"""
GONE = "(id = 'p3' OR (kind = 'dataset' AND length(id) = 2) OR (kind = 'document' AND id LIKE '%7') OR (kind = 'record' AND id LIKE '%13'))"
_plain_tables = {t: t for t in ("region", "nation", "customer", "orders")}
SQL_GONE = f"""nodes AS ({NODES.format(**_plain_tables)}), del AS (SELECT id FROM nodes WHERE {GONE}),
up AS (SELECT id, kind, id AS above, parent AS next, 0 AS depth FROM nodes UNION ALL SELECT up.id, up.kind, n.id, n.parent, depth + 1 FROM up JOIN nodes n ON n.id = up.next),
gone AS (SELECT id, kind, CAST(min(depth) AS INT) AS depth FROM up WHERE above IN (SELECT id FROM del) GROUP BY ALL)"""


def _tree(spark, sf):
    for t in _plain_tables:
        table(spark, sf, t).createOrReplaceTempView(f"__{t}")
    nodes = spark.sql(NODES.format(**{t: f"__{t}" for t in _plain_tables}))
    return nodes, ledger.cascade_levels(nodes, nodes.where(GONE))


@query(f"WITH RECURSIVE {SQL_GONE} SELECT * FROM gone")
def cascade_levels(spark, sf):
    return _tree(spark, sf)[1]


@query(f"WITH RECURSIVE {SQL_GONE} SELECT n.kind, count(*) AS total, count(depth) AS deleted, count(*) FILTER (depth = 0) AS direct FROM nodes n LEFT JOIN gone USING (id) GROUP BY 1")
def cascade_counts(spark, sf):
    return ledger.recount(*_tree(spark, sf))


#: Rules as rows: column, rule, severity, required, pattern, min, max, allowed.
RULE_ROWS = [
    ("title", "title_required", "error", True, None, None, None, None), ("amount", "amount_range", "warning", False, None, 5.0, 40.0, None), ("amount", "amount_whole", "info", None, "[0-9]+", None, None, None),
    ("province", "province_known", "error", False, None, None, None, ["gp", "KZN", "Western Cape", "National"]), ("ofo_code", "code", "error", True, "(20[0-9]{2}-)?[0-9]{4,6}", 1000.0, None, None),
    ("nqf", "level", "warning", False, "NQF.*|[0-9]+", None, None, None), ("absent", "nothing", "error", True, None, None, None, None),
]


def _sql_rule(column, rule, severity, required, pattern, low, high, allowed) -> str:
    text = f"trim({column})"
    tests = [f"NOT regexp_full_match({text}, '{pattern}')"] * bool(pattern) + [f"NOT list_contains([{quoted(allowed or [])}], {text})"] * bool(allowed)
    tests += [f"coalesce(NOT (try_cast({text} AS DOUBLE) >= {low}), true)"] * (low is not None) + [f"coalesce(NOT (try_cast({text} AS DOUBLE) <= {high}), true)"] * (high is not None)
    parts = [f"{text} = ''"] * bool(required) + [f"({text} <> '' AND ({' OR '.join(tests)}))"] * bool(tests)
    return f"SELECT row_index, '{column}' AS \"column\", '{rule}' AS rule, '{severity}' AS severity, {column} AS value FROM r WHERE {' OR '.join(parts)}"


@query(f"WITH {R.SQL} " + " UNION ALL ".join(_sql_rule(*r) for r in RULE_ROWS if r[0] != "absent"))
def rules_as_rows(spark, sf):
    rules = spark.createDataFrame(RULE_ROWS, validation.RULES)
    r = R.records(spark, sf).select("row_index", "title", "amount", "province", "ofo_code", "nqf")
    return validation.issues_by_rules(r, "row_index", rules)


# ---- exports with all provenance, knowledge reports --------------------------------------------


@query(f"""WITH {slate.SQL_DECIDED} SELECT row_index, title, dataset_id AS _prov_doc, row_index // 40 AS _prov_page, CASE WHEN row_index % 5 = 0 THEN '' ELSE 'T' || row_index % 5 END AS _prov_table, '' AS _prov_section, CAST(0.85 AS DOUBLE) AS _prov_confidence, status AS _prov_status,
decision AS _curation_decision, coalesce(reason_code, '') AS _curation_reason, CAST(curation_confidence AS DOUBLE) AS _curation_confidence, array_to_string(all_chambers, '; ') AS _derived_chambers FROM decided""")
def export_provenance(spark, sf):
    given = {"_prov_doc": F.col("dataset_id"), "_prov_page": F.expr("row_index div 40"), "_prov_table": F.expr("CASE WHEN row_index % 5 <> 0 THEN concat('T', row_index % 5) END"), "_prov_status": F.col("status")}
    return audit.export_full(evaluated(spark, sf), ["title"], given).withColumn("_curation_confidence", F.col("_curation_confidence").cast("double"))


FIELDS = ["title", "ofo_code", "province", "company_name"]
ENTITIES = ["title", "company_name"]


def _section(n: int, source: str, texts: list[str], order: list[str] | None = None) -> str:
    """Lines of a section in SQL: each row of source gives its texts in turn."""
    place = " || '.' || ".join(order or ["'0'"])
    return " UNION ALL ".join(f"SELECT dataset_id AS dataset, {n} AS section, {place} || '.{k:03d}' AS place, {t} AS text FROM {source}" for k, t in enumerate(texts))


def _padded(c: str) -> str:
    return f"lpad(CAST({c} AS VARCHAR), 12, '0')"


_clean = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_fields = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN trim({c}) <> '' THEN '{c}: ' || {_clean.format(c)} END" for c in FIELDS) + "], lambda x: x IS NOT NULL), ' | ')"
_kind = "CASE decision WHEN 'INCLUDE' THEN {} WHEN 'REVIEW' THEN {} ELSE {} END"
_gate_sql = {
    "document_understanding_gate": "'PASSED'", "dataset_identification_gate": "'PASSED'", "structural_integrity_gate": "CASE WHEN structural >= 70 THEN 'PASSED' ELSE 'WARNING' END", "schema_gate": "'PASSED'",
    **{g: f"upper({g})" for g in ("normalization_gate", "validation_gate", "curation_gate")}, "evidence_gate": "'PASSED'", **{g: f"upper({g})" for g in ("provenance_gate", "review_gate", "export_gate")},
}
_values = " UNION ALL ".join(f"SELECT dataset_id, {n} AS pos, '{c}' AS c, nullif(trim({c}), '') AS v FROM decided" for n, c in enumerate(FIELDS))
_changes = " UNION ALL ".join(f"SELECT dataset_id, row_index, '{c}' AS c, {c} AS raw, {_clean.format(c)} AS clean FROM decided" for c in ENTITIES)
SQL_KNOWLEDGE = f"""{SQL_LINES}, {slate.SQL_COUNTS.removeprefix(slate.SQL_DECIDED + ', ')}, gt AS (SELECT *, {slate.SQL_GATES} FROM dims),
per AS (SELECT dataset_id, count(*) AS n, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'warning') AS warn, count(*) FILTER (status = 'error') AS err, count(*) FILTER (decision = 'INCLUDE') AS inc, count(*) FILTER (decision = 'REVIEW') AS rev,
  count(*) FILTER (decision = 'EXCLUDE') AS exc, min(row_index // 40) AS p0, max(row_index // 40) AS p1, count(DISTINCT row_index // 40) AS pages, count(DISTINCT nullif(trim(company_name), '')) AS srcs, CAST(sum(c1::INT + c2::INT + c3::INT) AS BIGINT) AS conf FROM decided GROUP BY 1),
cl AS ({_values}), cv AS (SELECT dataset_id, pos, c, count(*) AS n, count(v) AS filled, count(DISTINCT v) AS vals, CAST(round(CAST(count(v) AS DECIMAL(18,0)) * 100 / count(*), 1) AS DECIMAL(5,1)) AS pct FROM cl GROUP BY ALL),
cm AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, pos ORDER BY n DESC, v) AS rank FROM (SELECT dataset_id, pos, c, v, count(*) AS n FROM cl WHERE v IS NOT NULL AND c IN ('title', 'company_name') GROUP BY ALL)),
ch AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, c ORDER BY row_index) AS rank FROM ({_changes}) WHERE raw <> clean),
mj AS (SELECT dataset_id, coalesce(major_code, 'none') AS major, count(*) AS n FROM decided GROUP BY ALL)
{_section(1, 'per', ["'Dataset Identifier: ' || dataset_id", "'Record Count: ' || n"])} UNION ALL {_section(2, 'per', ["'Sources: ' || srcs", "'Page Range: ' || p0 || ' to ' || p1"])}
UNION ALL SELECT 'ds1', 3, '0.000', 'Records of one survey.' UNION ALL {_section(4, 'per', ["'Primary Entity: Occupation'"])} UNION ALL {_section(5, 'per', ["'Total: ' || n", "'Valid: ' || valid", "'Warnings: ' || warn", "'Errors: ' || err"])}
UNION ALL {_section(5, 'cv', ["'- ' || c || ': ' || filled || '/' || n || ' populated (' || pct || '%) | ' || vals || ' unique value(s)'"], ["'1'", _padded('pos')])}
UNION ALL {_section(6, 'cv', ["'Field: ' || c", "'  Authority: SOURCE_FACT'", "'  Mandatory: ' || CASE WHEN c = 'province' THEN 'NO' ELSE 'YES' END", "'  Coverage: ' || filled || ' / ' || n"], [_padded('pos')])}
UNION ALL SELECT * FROM ({_section(7, 'cm WHERE rank <= 10', ["c || ': ' || v || ' (' || n || ')'"], [_padded('pos'), _padded('rank')])})
UNION ALL SELECT * FROM ({_section(8, 'ch WHERE rank <= 5', ["c || ': ''' || raw || ''' -> ''' || clean || ''''"], ['c', _padded('rank')])})
UNION ALL {_section(9, 'rl', ['line'], [_padded('row_index')])} UNION ALL {_section(10, 'mj', ["'Major group ' || major || ': ' || n"], ['major'])}
UNION ALL {_section(11, 'decided', [_kind.format("'Record'", "'Review'", "'Excluded'") + " || ' #' || row_index || ': ' || " + _fields + " || CASE WHEN decision = 'INCLUDE' THEN ' [Page ' || row_index // 40 || ']' ELSE ' -> Reason: ' || coalesce(exclusion, reason_code, 'none') END"], [_kind.format("'0'", "'1'", "'2'"), _padded('row_index')])}
UNION ALL {_section(12, 'per', ["'Active Policy: occupational_relevance'", "'Included: ' || inc", "'Review Required: ' || rev", "'Excluded: ' || exc", "'Conflicts: ' || conf"])}
UNION ALL {_section(13, 'per', ["'Valid: ' || valid || ' / ' || n", "'Integrity Posture: ' || CASE WHEN err = 0 THEN 'PASSED' ELSE 'ACTION REQUIRED (' || err || ' Errors)' END"])}
UNION ALL {_section(14, 'gt', ["'Overall Quality Score: ' || overall || '%'"] + [f"'{g}: ' || {t}" for g, t in _gate_sql.items()] + [f"'{d}: ' || {d} || '%'" for d in K.QUALITY_WEIGHTS])}
UNION ALL {_section(15, 'per', ["'Source Pages: ' || pages"])} UNION ALL {_section(16, 'per', ["'Raw and normalised values are both kept.'"])}
UNION ALL SELECT dataset_id, s, '', s || '. ' || [{quoted(K.REPORT_SECTIONS)}][s] FROM per, (SELECT CAST(unnest(range(1, 17)) AS INTEGER) AS s) WHERE s <> 3 OR dataset_id = 'ds1'"""


@query(f"WITH {SQL_KNOWLEDGE}")
def knowledge_lines(spark, sf):
    e = evaluated(spark, sf).withColumns({"page": F.expr("row_index div 40"), "source": F.col("company_name")})
    described = spark.createDataFrame([("ds1", " Records of one survey. "), ("ds2", " ")], "dataset_id string, description string")
    return knowledge.report_lines(e, ENTITIES, FIELDS, slate._counts(spark, sf), "occupational_relevance", described=described)


# ---- discovery over documents ------------------------------------------------------------------

UNITS = ["occupation", "qualification", "survey_response", "unknown"]
HEADER_LISTS = ["OFO Code|Occupation Title", "SAQA|Title", "x", "Occupation|Rank"]
_table_sql = METADATA.replace("p_brand AS unit", f"{R._pick(UNITS, 'p_partkey')} AS unit, {R._pick(HEADER_LISTS, 'p_size')} AS head")
#: Documents in the numbering of METADATA; one in twenty pages states a count that a group of tables may come near.
_page_sql = f"SELECT CAST(floor(p_partkey / 30) AS BIGINT) AS doc, CAST(p_partkey % 30 + 1 AS BIGINT) AS page, concat(replace({R._pick(TOPS, '(p_partkey + p_size)')}, '~', chr(10)), chr(10), CASE WHEN p_partkey % 4 = 0 THEN concat('total ', p_size, ' items') ELSE p_name END) AS text FROM {{p}}"
_stated_sql = f"{', '.join(_marked(n, p) for n, p in enumerate(K.STATED_PATTERNS))}, al AS ({' UNION ALL '.join(f'SELECT * FROM m{n}' for n in range(len(K.STATED_PATTERNS)))}), sd AS (SELECT doc, stated, page FROM (SELECT *, row_number() OVER (PARTITION BY doc, stated ORDER BY page, kind, \"at\") AS n FROM al WHERE stated > 5) WHERE n = 1)"
_groups_sql = f"""t AS ({_table_sql.format(p='part')}), u AS (SELECT * FROM t WHERE NOT layout AND role <> 'metadata'),
l AS (SELECT *, lag(page_end) OVER w AS pe, lag(column_count) OVER w AS pc, lag(caption) OVER w AS pt, lag(role) OVER w AS pr FROM u WINDOW w AS (PARTITION BY doc ORDER BY page_start, table_index)),
s AS (SELECT *, sum(CASE WHEN pe IS NOT NULL AND page_start IN (pe, pe + 1) AND ((column_count = pc AND column_count > 1) OR (caption <> '' AND pt <> '' AND (lower(caption) = lower(pt) OR contains(lower(caption), 'table 4'))) OR role = pr) THEN 0 ELSE 1 END)
  OVER (PARTITION BY doc ORDER BY page_start, table_index ROWS UNBOUNDED PRECEDING) AS group_no FROM l),
gr AS (SELECT doc, CAST(group_no AS BIGINT) AS group_no, coalesce(nullif(arg_min(caption, (page_start, table_index)), ''), 'Table from Page ' || min(page_start)) AS caption, arg_min(coalesce(section_title, 'Unassigned Section'), (page_start, table_index)) AS section_title,
  arg_min(role, (page_start, table_index)) AS role, arg_min(unit, (page_start, table_index)) AS unit, arg_min(head, (page_start, table_index)) AS head, min(page_start) AS page_start, arg_max(page_end, (page_start, table_index)) AS page_end, CAST(sum(row_count) AS BIGINT) AS row_count FROM s GROUP BY doc, group_no),
nr AS (SELECT gr.*, n.stated, n.page AS stated_page FROM gr LEFT JOIN (SELECT doc, group_no, sd.stated, sd.page, row_number() OVER (PARTITION BY doc, group_no ORDER BY sd.page, sd.stated) AS k FROM gr JOIN sd USING (doc) WHERE abs(row_count - sd.stated) <= 2) n ON n.doc = gr.doc AND n.group_no = gr.group_no AND n.k = 1),
sg AS (SELECT *, lower(caption || ' ' || section_title) AS lo, [regexp_matches(lower(caption || ' ' || section_title), 'final list|final oihd|occupations in high demand'), contains(lower(caption || ' ' || section_title), 'consolidation of evidence'), role = 'final_dataset', unit IN ('occupation', 'qualification'),
  unit = 'survey_response', stated IS NOT NULL, contains(lower(head), 'ofo') AND contains(lower(head), 'occupation'), role = 'intermediate_analysis', role = 'survey', role = 'appendix' AND NOT contains(lower(caption || ' ' || section_title), 'final')] AS f FROM nr),
sc AS (SELECT *, CAST(f[1]::INT * 4 + f[2]::INT * 2.5 + f[3]::INT * 3 + CASE unit WHEN 'occupation' THEN 2 WHEN 'qualification' THEN 1.5 WHEN 'survey_response' THEN -3 ELSE 0 END + f[6]::INT * 5 + f[7]::INT * 2 - f[8]::INT * 2 - f[9]::INT * 4 - f[10]::INT * 1.5 AS DOUBLE) AS score,
  'cand_' || group_no || '_' || lower(substr(regexp_replace(caption, '[^a-zA-Z0-9]', '_', 'g'), 1, 20)) AS candidate_id,
  array_to_string(list_filter(list_transform(['final wording', 'consolidation section', 'final dataset role', 'unit of observation', 'survey responses', 'stated count', 'code and title columns', 'intermediate analysis', 'survey table', 'appendix'], lambda x, i: CASE WHEN f[i] THEN x END), lambda x: x IS NOT NULL), '; ') AS reasons FROM sg),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY score DESC, group_no) AS INT) AS rank FROM sc)"""
_discovery_sql = f"pg AS ({_page_sql.format(p='part')}), {_stated_sql}, {_groups_sql}"
_report_sql = f"""{_discovery_sql}, dc AS (SELECT doc, count(*) AS pages FROM pg GROUP BY 1), ts AS (SELECT doc, count(*) AS n FROM t GROUP BY 1), cs AS (SELECT doc, count(*) AS n FROM rk GROUP BY 1),
sx AS (SELECT doc, string_agg(stated || '@' || page, ', ' ORDER BY page, stated) AS c FROM sd GROUP BY 1),
rp AS (SELECT dc.doc, dc.pages, coalesce(ts.n, 0) AS tables_detected, coalesce(cs.n, 0) AS candidate_count, candidate_id AS selected_id, coalesce(score >= 3, false) AS authoritative,
CASE WHEN score >= 3 THEN caption || ' (pages ' || page_start || '-' || page_end || ') is authoritative: ' || reasons WHEN candidate_id IS NOT NULL THEN caption || ' has the highest score' ELSE 'no candidates' END AS rationale, coalesce(sx.c, '') AS stated_counts
FROM dc LEFT JOIN ts ON ts.doc = dc.doc LEFT JOIN cs ON cs.doc = dc.doc LEFT JOIN rk ON rk.doc = dc.doc AND rk.rank = 1 LEFT JOIN sx ON sx.doc = dc.doc)"""


def _discovered(spark, sf):
    """(pages, tables, stated counts, candidates) of the documents."""
    spread(table(spark, sf, "part"), "p_partkey").createOrReplaceTempView("__parts")
    pages, made = spark.sql(_page_sql.format(p="__parts")), spark.sql(_table_sql.format(p="__parts"))
    made = made.withColumn("headers", F.split("head", r"\|")).drop("head")
    stated = discovery.stated_contexts(pages, "doc")
    return pages, made, stated, discovery.dataset_candidates(discovery.table_groups(made, carried=["headers"]), stated)


@query(f"WITH {_discovery_sql} SELECT doc, candidate_id, stated, stated_page, score, rank, rank = 1 AND score >= 3 AS authoritative, reasons FROM rk")
def dataset_candidates(spark, sf):
    found = _discovered(spark, sf)[3]
    return found.select("doc", "candidate_id", "stated", "stated_page", F.col("score").cast("double").alias("score"), "rank", "authoritative", F.array_join("reasons", "; ").alias("reasons"))


@query(f"WITH {_report_sql} SELECT * FROM rp")
def discovery_reports(spark, sf):
    pages, made, stated, found = _discovered(spark, sf)
    return discovery.discovery_report(pages.groupBy("doc").agg(F.count("*").alias("pages")), made, found, stated)


@query(f"""WITH {_report_sql}, hs AS (SELECT doc, sha256(string_agg(sha256(text), '' ORDER BY page)) AS digest, lower(string_agg(text, ' ' ORDER BY page) FILTER (page <= 5)) AS front, CAST(sum(length(trim(text, ' '))) AS BIGINT) AS chars FROM pg GROUP BY 1)
SELECT doc, rp.pages, chars, digest, CASE WHEN contains(front, 'research report') THEN 'research_report' WHEN contains(front, 'policy') AND contains(front, 'framework') THEN 'policy_document' WHEN regexp_matches(front, 'codebook|variable name') THEN 'codebook'
WHEN contains(front, 'survey report') THEN 'survey_report' WHEN contains(front, 'statistical') THEN 'statistical_report' ELSE 'unknown' END AS document_type, tables_detected, candidate_count, selected_id, authoritative, tables_detected > 0 AS has_tables, chars < 100 AS scanned FROM rp JOIN hs USING (doc)""")
def document_full_profile(spark, sf):
    pages, made, stated, found = _discovered(spark, sf)
    report = discovery.discovery_report(pages.groupBy("doc").agg(F.count("*").alias("pages")), made, found, stated)
    full = documents.full_profile(pages, report)
    return full.select("doc", "pages", "chars", "digest", "document_type", "tables_detected", "candidate_count", "selected_id", "authoritative", "has_tables", "scanned")


# ---- evidence, audits, places ------------------------------------------------------------------

_met = f"list_filter([{', '.join(f'CASE WHEN exclusion IS NULL AND {_tests[_family[r]]} THEN {quoted([r])} END' for r, _ in K.POLICIES['occupational_relevance'][2] if _family[r] != 'source')}], lambda x: x IS NOT NULL)"
_claims = {
    "SOURCE_FACT:1": ("t <> ''", "'title:' || t", "0.98", "NULL"), "SOURCE_FACT:2": ("code <> ''", "'code:' || code", "0.99", "NULL"), "DERIVED_CLASSIFICATION:1": ("direct_unit", "'unit:' || coalesce(unit_code, '')", "0.95", "NULL"),
    "DERIVED_CLASSIFICATION:2": ("NOT direct_unit AND major_code IS NOT NULL", "'major:' || major_code", "0.75", "'major group ' || major_code"),
    "SEMANTIC_INFERENCE:1": ("len(all_chambers) > 0", "'chambers:' || array_to_string(all_chambers, '; ')", "CASE WHEN len(chambers) > 0 THEN 0.85 ELSE 0.70 END", "CASE WHEN NOT direct_unit THEN 'sector profile' END"),
    "LLM_INFERENCE:1": ("trim(province) <> ''", "trim(province)", "0.80", "NULL"), "RULE_INFERENCE:1": ("c1", "'conflict:CLASSIFICATION_VS_TITLE:critical'", "0.99", "NULL"), "RULE_INFERENCE:2": ("c2", "'conflict:CLASSIFICATION_VS_TITLE:high'", "0.99", "NULL"),
    "RULE_INFERENCE:3": ("c3", "'conflict:COMPANY_VS_OCCUPATION:medium'", "0.99", "NULL"),
}


@query(f"""WITH {slate.SQL_DECIDED}, x AS ({' UNION ALL '.join(f"SELECT row_index, '{k.split(':')[0]}' AS evidence_type, {c} AS claim, CAST({s} AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS rule_id, {i} AS inherited_from FROM decided WHERE {w}" for k, (w, c, s, i) in _claims.items())}
UNION ALL SELECT row_index, 'RULE_INFERENCE', 'rule:' || r, CASE r WHEN 'direct_sector_match' THEN CASE WHEN direct_unit OR len(all_chambers) > 0 THEN 0.95 ELSE 0.85 END WHEN 'occupational_classification' THEN CASE WHEN direct_unit THEN 0.95 ELSE 0.75 END
WHEN 'manufacturing_context' THEN 0.85 ELSE 0.90 END, r, NULL FROM (SELECT row_index, direct_unit, all_chambers, unnest({_met}) AS r FROM decided))
SELECT *, CASE WHEN confidence >= 0.85 THEN 'STRONG' ELSE 'MEDIUM' END AS strength, row_index // 40 AS page FROM x""")
def evidence_full(spark, sf):
    e = evaluated(spark, sf).withColumn("page", F.expr("row_index div 40"))
    found = curation.evidence_full(e, "dataset_id", "page", "province")
    return found.select("row_index", "evidence_type", "claim", F.col("confidence").cast("double").alias("confidence"), "rule_id", "inherited_from", "strength", "page")


@query(f"""WITH {R.SQL}, {slate.SQL_ISSUES} SELECT row_index, "column", rule, 'resolve_issue' AS action, 'open' AS old_value, CASE WHEN row_index % 6 = 0 THEN 'resolved: fixed' ELSE 'resolved' END AS new_value FROM iss WHERE row_index % 3 = 0""")
def issue_audit(spark, sf):
    found = validation.issue_rows(validated(spark, sf), "row_index").select("row_index", "column", "rule")
    made = found.where("row_index % 3 = 0").select("row_index", "column").distinct().withColumn("fix", F.expr("CASE WHEN row_index % 6 = 0 THEN 'fixed' END"))
    return ledger.issue_audit(found, made)


@query(f"""WITH {slate.SQL_DIM}, j AS (SELECT DISTINCT row_index, lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS k FROM (SELECT p_partkey + 1 AS row_index, unnest(regexp_split_to_array({R._pick(R.COLLEGES, 'p_partkey')}, '[;\\n•·]+')) AS x FROM part) WHERE trim(x) <> '')
SELECT row_index, item_id, CASE WHEN row_index % 7 = 0 THEN 1 ELSE row_index // 40 END AS source_page, CASE WHEN row_index % 3 = 0 THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence FROM j JOIN dm ON dm.item_key = j.k""")
def junction_places(spark, sf):
    r = R.records(spark, sf).withColumns({"page": F.expr("CASE WHEN row_index % 7 <> 0 THEN row_index div 40 END"), "sure": F.expr("CASE WHEN row_index % 3 <> 0 THEN 0.5 END")})
    pairs = relational.junction(r, relational.dimension(r, "colleges"), "colleges")
    return relational.placed(pairs, r, "page", "sure")


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_events(spark, sf):
    return audit.newest(table(spark, sf, "events"), "ts", "event_id", 50, event_type="click").select("event_id", "ts", "event_type")


# ---- blueprints --------------------------------------------------------------------------------

_names = ["Qualifications", "occupations", "CODEBOOKS", "financial", "other", ""]


@query(f"""WITH x AS (SELECT p_partkey AS id, lower({R._pick(_names, 'p_partkey')}) AS b FROM part), k(b, n) AS (VALUES {', '.join(f"('{b}', {len(v[3])})" for b, v in K.BLUEPRINTS.items())})
SELECT id, coalesce(k.b, 'universal_auto') AS blueprint, CAST(coalesce(k.n, 0) AS BIGINT) AS fields FROM x LEFT JOIN k ON k.b = x.b""")
def blueprint_lookup(spark, sf):
    named = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), blueprints.chosen(F.expr(R._pick(_names, "p_partkey"))).alias("blueprint"))
    sizes = blueprints.fields(spark).groupBy("blueprint").agg(F.count("*").alias("fields"))
    return named.join(F.broadcast(sizes), "blueprint", "left").select("id", "blueprint", F.coalesce("fields", F.lit(0)).cast("bigint").alias("fields"))


_print = [(f[0], f[1]) for f in K.BLUEPRINTS["qualifications"][3]]
_print_rules = [
    ("saqa_id", "required", "error", "x = ''"), ("saqa_id", "pattern", "error", "x <> '' AND NOT regexp_full_match(x, '[0-9]{4,7}')"), ("qualification_name", "required", "error", "x = ''"),
    ("nqf_level", "range", "error", "x <> '' AND coalesce(NOT try_cast(x AS DOUBLE) BETWEEN 1 AND 10, true)"), ("nqf_level", "integer", "warning", "x <> '' AND NOT regexp_full_match(x, '[+-]?[0-9]+')"),
    ("nqf_sub_framework", "allowed", "warning", "x <> '' AND x NOT IN ('OQSF', 'HEQSF', 'GFETQSF')"),
]


@query(f"WITH {_sql_fields(QUALIFICATION_LAYOUTS, _print, ['saqa_id'], 3, {}, ['no such text'])} " + " UNION ALL ".join(
    f"SELECT table_id * 1000 + row_index AS id, '{c}' AS \"column\", '{r}' AS rule, '{s}' AS severity, x AS value FROM (SELECT *, {c} AS x FROM nm) WHERE {w}" for c, r, s, w in _print_rules))
def blueprint_issues(spark, sf):
    read = blueprints.read(sheet(spark, sf, QUALIFICATION_LAYOUTS), "qualifications")
    named = read.select((F.col("table_id") * 1000 + F.col("row_index")).alias("id"), *[f for f, _ in _print])
    return validation.issues_by_rules(named, "id", blueprints.rules(spark, "qualifications"))
