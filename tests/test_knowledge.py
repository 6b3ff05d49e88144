"""Knowledge reports, candidates of documents and evidence on small cases."""

from siltworks.functions import constants as K
from siltworks.operators import audit, curation, discovery, documents, knowledge, ledger, validation
from pyspark.sql import functions as F

SCHEMA = [("title", True, "string"), ("ofo_code", False, "string")]
RECORD = "row_index long, dataset_id string, title string, ofo_code string, company_name string, page long"


def made(spark, rows):
    df = spark.createDataFrame(rows, RECORD)
    return curation.evaluate(validation.validate(df, SCHEMA).withColumn("extraction_confidence", F.lit("1.000").cast("decimal(6,3)"))).withColumn("source", F.col("company_name"))


def counts(e):
    return e.groupBy("dataset_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "warning").alias("warnings"),
        F.count_if(F.col("decision") == "REVIEW").alias("review"), F.lit(0).alias("duplicates"), F.lit(0).alias("conflicts"), F.lit(0).alias("null_cells"), F.lit(4).alias("cells"), F.lit(0).alias("no_provenance"))


ROWS = [(1, "a", "Mechanical  Engineering Technician", "311501", "Acme", 3), (2, "a", "Accountant", "2411", "", 4), (3, "a", "", "", None, None), (1, "b", "Welder", "651202", "Acme", 1)]


def test_sixteen_sections_and_nothing_made_up(spark):
    e = made(spark, ROWS)
    described = spark.createDataFrame([("b", " The list. ")], "dataset_id string, description string")
    got = {}
    for r in sorted(knowledge.report_lines(e, ["title"], ["title", "ofo_code", "company_name"], counts(e), "p", described=described).collect(), key=lambda r: (r.dataset, r.section, r.place)):
        got.setdefault((r.dataset, r.section), []).append(r.text)
    assert sorted(s for d, s in got if d == "b") == list(range(1, 17))
    # without a description there is no third section
    assert sorted(s for d, s in got if d == "a") == [1, 2, *range(4, 17)]
    assert all(lines[0] == f"{s}. {K.REPORT_SECTIONS[s - 1]}" for (_, s), lines in got.items())
    assert got["b", 3][1:] == ["The list."] and got["a", 1][1:] == ["Dataset Identifier: a", "Record Count: 3"]
    assert "- company_name: 1/3 populated (33.3%) | 1 unique value(s)" in got["a", 5]
    assert got["a", 8][1:] == ["title: 'Mechanical  Engineering Technician' -> 'Mechanical Engineering Technician'"]
    # every record has one line, blank fields are left out
    lines = got["a", 11][1:]
    assert len(lines) == 3 and any("#3: " in x and "title" not in x for x in lines)
    assert sum(x.startswith("Record #") for x in lines) == e.where("dataset_id = 'a' and decision = 'INCLUDE'").count()
    assert knowledge.report_lines(e.limit(0), ["title"], ["title"], counts(e.limit(0)), "p").collect() == []


def test_candidates_are_corroborated_by_the_text(spark):
    table = "doc int, page_start long, page_end long, table_index int, caption string, section_title string, role string, unit string, headers array<string>, column_count int, row_count long, layout boolean"
    rows = [
        (1, 3, 3, 0, "Table 4: The final list", "Consolidation of evidence", "final_dataset", "occupation", ["OFO Code", "Occupation"], 2, 60, False), (1, 4, 4, 0, "Table 4: The final list", None, "final_dataset", "occupation", None, 2, 106, False),
        (1, 9, 9, 0, "Annexure 1", None, "appendix", "survey_response", None, 5, 7, False), (2, 1, 1, 0, "x", None, None, None, None, None, None, False), (3, 1, 1, 0, "y", None, "unknown", None, None, 1, 1, True)]
    pages = spark.createDataFrame([(1, 1, "It identified 167 occupations."), (1, 2, "total 7 items, list of 9 skills"), (2, 1, None), (3, 1, ""), (4, 1, "research report")], "doc int, page long, text string")
    tables, stated = spark.createDataFrame(rows, table), discovery.stated_contexts(pages, "doc")
    found = discovery.dataset_candidates(discovery.table_groups(tables, carried=["headers"]), stated)
    got = {(r.doc, r.rank): r for r in found.collect()}
    best = got[1, 1]
    assert (best.candidate_id, best.row_count, best.stated, best.stated_page, best.authoritative) == ("cand_1_table_4__the_final_l", 166, 167, 1, True)
    assert float(best.score) == 4 + 2.5 + 3 + 2 + 5 + 2 and best.reasons[-1] == "code and title columns"
    assert (got[1, 2].stated, float(got[1, 2].score), got[1, 2].authoritative) == (7, 5 - 3 - 1.5, False)
    assert not got[2, 1].authoritative and got[2, 1].stated is None
    docs = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    report = discovery.discovery_report(docs, tables, found, stated)
    rows = {r.doc: r for r in report.collect()}
    assert (rows[1].tables_detected, rows[1].candidate_count, rows[1].stated_counts) == (3, 2, "167@1, 7@2, 9@2") and "is authoritative" in rows[1].rationale
    assert "highest score" in rows[2].rationale and (rows[3].tables_detected, rows[3].candidate_count, rows[3].rationale) == (1, 0, "no candidates") and rows[4].selected_id is None
    full = {r.doc: r for r in documents.full_profile(pages, report).collect()}
    assert len(full[1].digest) == 64 and full[1].has_tables and not full[4].has_tables and full[4].document_type == "research_report" and full[2].chars == 0 and full[2].scanned


def test_evidence_names_rules_and_conflicts(spark):
    e = made(spark, ROWS).withColumn("note", F.lit(" "))
    items = curation.evidence_full(e, "dataset_id", "page", "note").collect()
    rules = [i for i in items if i.rule_id]
    assert rules and all(i.evidence_type == "RULE_INFERENCE" and i.claim == f"rule:{i.rule_id}" for i in rules)
    assert {i.strength for i in items if i.confidence >= 0.85} == {"STRONG"} and not any(i.evidence_type == "LLM_INFERENCE" for i in items)
    assert not [i for i in items if i.row_index == 3 and i.evidence_type == "SOURCE_FACT"]
    assert curation.evidence_full(e.limit(0), "dataset_id", "page").collect() == []


def test_exports_audits_and_newest(spark):
    e = made(spark, ROWS)
    out = {(r["_prov_doc"], r.row_index): r for r in audit.export_full(e, ["title"], {"_prov_doc": F.col("dataset_id"), "_prov_page": F.col("page")}).collect()}
    r = out["a", 3]
    assert (r["_prov_page"], r["_prov_table"], r["_prov_section"], r["_prov_confidence"], r["_prov_status"]) == (None, "", "", 0.85, "valid")
    bare = audit.export_full(e.withColumns({"decision": F.lit(None).cast("string"), "curation_confidence": F.lit(1).cast("decimal(6,3)")}), [], {}).first()
    assert bare["_curation_decision"] == "unprocessed" and bare["_curation_confidence"] is None
    issues = spark.createDataFrame([(1, "a", "r1"), (1, "a", "r2"), (2, "b", "r1")], "row_index int, column string, rule string")
    fixes = spark.createDataFrame([(1, "a", "done"), (2, "b", None), (9, "a", "x")], "row_index int, column string, fix string")
    assert sorted((r.row_index, r.rule, r.new_value) for r in ledger.issue_audit(issues, fixes).collect()) == [(1, "r1", "resolved: done"), (1, "r2", "resolved: done"), (2, "r1", "resolved")]
    rows = spark.createDataFrame([(i, i % 5 if i else None, "xy"[i % 2]) for i in range(20)], "id int, at int, kind string")
    assert [r.id for r in audit.newest(rows, "at", "id", 3, kind="x").collect()] == [14, 4, 18] and audit.newest(rows, "at", "id", 0).count() == 1
