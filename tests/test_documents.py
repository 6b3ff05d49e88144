"""Structure, schemas and ledgers on hand-made rows: nulls, empty tables and the rules' edges."""

from pyspark.sql import functions as F

from siltworks.operators import curation, documents, duplicates, ledger, schema


def test_headings_and_sections(spark):
    pages = [
        (1, 1, "Table of Contents\nPART I 3\nPART II 9"), (1, 2, "PART I\nThis page is not read"), (1, 8, "PART I\nBackground\nbody"), (1, 9, "2.1 Survey data\n2.1 survey data\n2.1.4 Key findings"),
        (1, 12, "7 THE LIST OF THE WHOLE PROVINCE\nANNEXURE B\nTables"), (2, 1, None), (2, 2, "no heading"),
    ]
    df = spark.createDataFrame(pages, "doc long, page int, text string")
    got = [(r.doc, r.page, r.title, r.level, r.semantic_type) for r in documents.headings(df).orderBy("doc", "page", "line").collect()]
    assert got == [
        (1, 1, "Table of Contents", 1, "FRONT_MATTER"), (1, 8, "PART I: Background", 1, "INTRODUCTION"), (1, 9, "2.1 Survey data", 2, "EVIDENCE"),
        (1, 9, "2.1.4 Key findings", 3, "RESULTS"), (1, 12, "ANNEXURE B: Tables", 4, "APPENDIX"),
    ]
    tree = {(r.doc, r.section): (r.title, r.page_start, r.page_end) for r in documents.section_tree(df).collect()}
    assert tree[1, 1] == ("Table of Contents", 1, 7) and tree[1, 5] == ("ANNEXURE B: Tables", 12, 12) and tree[2, 0] == ("Document Content", 1, 2)
    assert documents.section_tree(df.limit(0)).collect() == [] and documents.profile(df.limit(0)).collect() == []
    assert {r.doc: (r.pages, r.scanned) for r in documents.profile(df).collect()} == {1: (5, False), 2: (2, True)}


def test_header_mapping_is_greedy(spark):
    wanted = ["saqa_id", "qualification", "nqf_level"]
    assert schema.map_columns(["Qualification title", "SAQA", "NQF"], wanted) == {"qualification": 0, "saqa_id": 1, "nqf_level": 2}
    assert schema.map_columns(["x", "y", "z"], wanted) == {"saqa_id": 0, "qualification": 1, "nqf_level": 2}
    aliases = [("a", ["code"]), ("b", ["code", "name"]), ("c", ["none"])]
    assert schema.match_headers(["OFO Code", "Name", "Code 2"], aliases) == {"a": 0, "b": 1}
    rows = spark.createDataFrame([(1, 1, ["", "lost", "", "", "", ""]), (1, 2, ["12345", "First", "4", "", "", "A"]), (1, 3, ["", "part", "", "", "", "B"]), (1, 4, ["99", None, "", "", "", ""])], "table_id int, row_index int, cells array<string>")
    got = schema.qualification_list(rows, []).collect()
    assert [(r.saqa_id, r.qualification, r.nsfas_eligible, r.participating_colleges) for r in got] == [("12345", "First part", "No", "A; B")]


def test_ledgers(spark):
    records = spark.createDataFrame([(1, "a", "valid", "d"), (2, "b", "valid", "d"), (3, None, "error", "e")], "row_index int, title string, status string, dataset_id string")
    edits = spark.createDataFrame([(1, "x"), (2, None), (9, "y")], "row_index int, title string")
    after, audits = ledger.edit_records(records, edits, "row_index", ["title"])
    assert sorted((r.row_index, r.title, r.status) for r in after.collect())[:2] == [(1, "x", "human_reviewed"), (2, "b", "human_reviewed")]
    assert sorted((r.row_index, r.field, r.new_value) for r in audits.collect()) == [(1, "title", "x"), (2, "record", None)]
    stay, counts = ledger.without_deleted(records, records.where("row_index = 3"), "row_index")
    assert stay.count() == 2 and {r.dataset_id: r.n for r in counts.collect()} == {"d": 2, "e": 0}


def test_declared_criteria_are_no_patterns(spark):
    df = spark.createDataFrame([("Senior C++ programmer", ""), ("Welder", "")], "title string, ofo_code string")
    judged = curation.judge_titles(curation.resolve_taxonomy(df.withColumn("row_index", F.lit(1))), ["C++"])
    assert {r.title: r.exclusion for r in judged.collect()} == {"Senior C++ programmer": "declared:C++", "Welder": None}


def test_last_flag_counts_repeated_keys(spark):
    pairs = spark.createDataFrame([(1, 2, "EXACT_DUPLICATE"), (1, 3, "POSSIBLE_SEMANTIC_DUPLICATE")], "i long, j long, duplicate_type string")
    repeated = spark.createDataFrame([(2,), (5,)], "row_index long")
    got = {r.row_index: r.duplicate_type for r in duplicates.last_flag(pairs, repeated).collect()}
    assert got == {2: "EXACT_DUPLICATE", 3: "POSSIBLE_SEMANTIC_DUPLICATE", 5: "STRUCTURAL_DUPLICATE"}


def test_similar_pairs_equal_brute_force(spark):
    from difflib import SequenceMatcher

    from siltworks.functions import constants as K

    base = ["mechanical engineering technician", "mechanical engineering technologist", "mechanical engineering technician", "welder", "metal welder", "boiler maker", "boilermaker metal", "electrical engineering technician", "mechanical technician engineering"]
    titles = [base[(7 * i) % len(base)] if i % 4 else base[i % len(base)] + f" {chr(97 + i % 5)}x" for i in range(80)]
    want = set()
    for i, a in enumerate(titles):
        for j in range(i + 1, min(i + 50, len(titles))):
            b = titles[j]
            x, y = set(a.split()), set(b.split())
            sim = 1.0 if a == b else round(0.5 * SequenceMatcher(None, a, b).ratio() + 0.5 * round(len(x & y) / len(x | y), 6), 4)
            tiers = ({t for t in K.TIERS if t in x}, {t for t in K.TIERS if t in y})
            if sim >= 0.98:
                want.add((i, j, "EXACT_DUPLICATE"))
            elif sim >= 0.65 and all(tiers) and tiers[0] != tiers[1]:
                want.add((i, j, "LEGITIMATE_RELATED_RECORD"))
            elif sim >= 0.78:
                want.add((i, j, "POSSIBLE_SEMANTIC_DUPLICATE"))
    df = spark.createDataFrame(list(enumerate(titles)), "row_index long, title string")
    got = {(r.i, r.j, r.duplicate_type) for r in duplicates.similar_pairs(df).collect()}
    assert len({k for _, _, k in want}) == 3 and got == want
