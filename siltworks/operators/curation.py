"""Taxonomy, relevance rules, conflicts and decisions over records.

Records have row_index, title, ofo_code and company_name. Every step is a projection; the code tables
are literal and small, so they are looked up in maps without a join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X


def _table(pairs: list[tuple[str, object]]) -> Column:
    out = []
    for k, v in pairs:
        out += [F.lit(k), F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)]
    return F.create_map(*out)


def resolve_taxonomy(records: DataFrame, code_col: str = "ofo_code") -> DataFrame:
    """Adds code, the codes and titles of the four levels that exist, direct_unit, affinity and chambers."""
    code = X.clean_code(F.coalesce(F.col(code_col), F.lit("")))
    df = records.withColumn("code", code)
    levels = [("major", K.MAJOR_GROUPS, 1), ("sub_major", K.SUB_MAJOR_GROUPS, 2), ("minor", K.MINOR_GROUPS, 3), ("unit", K.UNIT_GROUPS, 4)]
    for name, rows, n in levels:
        title = F.try_element_at(_table([(r[0], r[1]) for r in rows]), F.substring("code", 1, n))
        df = df.withColumn(f"{name}_title", F.when(F.length("code") >= n, title))
        df = df.withColumn(f"{name}_code", F.when(F.col(f"{name}_title").isNotNull(), F.substring("code", 1, n)))
    unit = _table([(r[0], r[2]) for r in K.UNIT_GROUPS])
    sub = _table([(r[0], r[3]) for r in K.SUB_MAJOR_GROUPS])
    sub_affinity = _table([(r[0], r[2]) for r in K.SUB_MAJOR_GROUPS])
    major_affinity = _table([(r[0], r[2]) for r in K.MAJOR_GROUPS])
    direct = F.col("unit_code").isNotNull()
    affinity = (
        F.when(F.col("code") == "", "0.00").when(direct, "0.95")
        .when(F.col("sub_major_code").isNotNull(), F.try_element_at(sub_affinity, "sub_major_code"))
        .when(F.col("major_code").isNotNull(), F.try_element_at(major_affinity, "major_code")).otherwise("0.30")
    )
    chambers = F.coalesce(F.try_element_at(unit, "unit_code"), F.try_element_at(sub, "sub_major_code"), F.array().cast("array<string>"))
    return df.withColumns({
        "direct_unit": direct, "affinity": affinity.cast("decimal(4,2)"), "chambers": chambers,
        "valid_format": F.length("code").isin(4, 6),
        "attribution": F.when(F.col("code") == "", "UNCLASSIFIED").when(direct, "TAXONOMY_INFERRED").otherwise("MODEL_INFERRED"),
    })


def taxonomy_claims(resolved: DataFrame) -> DataFrame:
    """(row_index, level, code, is_inherited, confidence), a row for each level that a code resolves to."""
    sure = {"major": "0.50", "sub_major": "0.65", "minor": "0.80", "unit": "0.95"}
    own = {"major": "0.90", "sub_major": "0.95", "minor": "0.95", "unit": "0.95"}
    claims = []
    for n, level in enumerate(sure, 1):
        deeper = (F.length("code") > n) & F.lit(level != "unit")
        claims.append(F.struct(
            F.lit(level).alias("level"), F.col(f"{level}_code").alias("level_code"), deeper.alias("is_inherited"),
            F.when(deeper, sure[level]).otherwise(own[level]).cast("decimal(4,2)").alias("confidence")))
    kept = F.filter(F.array(*claims), lambda c: c["level_code"].isNotNull())
    return resolved.select("row_index", F.inline(kept))


def judge_titles(resolved: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Adds what the title says: exclusions, ambiguity, technical content, and title-derived chambers."""
    t = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    df = resolved.withColumn("t", t)
    t = F.col("t")
    excluded = F.when(~X.has_part(t, K.INDUSTRIAL_QUALIFIERS), X.first_word_of(t, K.EXCLUDED_ROLES))
    support = X.has_word(t, K.SUPPORT_ROLES)
    declared = F.coalesce(*[F.when(t.rlike(r"(?<!\w)" + re.escape(c.strip().lower()) + r"(?!\w)"), F.lit(c)) for c in exclude]) if exclude else F.lit(None).cast("string")
    reason = (
        F.when(excluded.isNotNull(), F.concat(F.lit("excluded_role:"), excluded)).when(support, "support_role")
        .when(declared.isNotNull(), F.concat(F.lit("declared:"), declared))
    )
    derived = F.filter(F.array(*[F.when(X.has_part(t, words), F.lit(chamber)) for words, chamber in K.TITLE_CHAMBERS]), lambda c: c.isNotNull())
    return df.withColumns({
        "exclusion": reason,
        "ambiguous": reason.isNull() & X.has_word(t, K.LEADERSHIP_ROLES) & ~X.has_part(t, K.LEADERSHIP_QUALIFIERS),
        "technical": X.has_part(t, K.TECHNICAL_CORE), "process": X.has_part(t, K.PROCESS_WORDS),
        "all_chambers": F.array_distinct(F.concat("chambers", derived)),
    })


def score_rules(judged: DataFrame, policy: str = "occupational_relevance", document_col: str | None = None) -> DataFrame:
    """Adds score (sum of the weights of satisfied rules) and rules (the ids of the satisfied ones)."""
    include, exclude, rules = K.POLICIES[policy]
    tests = {
        "sector": F.col("technical"),
        "classification": F.coalesce(F.col("major_code").isin("2", "3", "6", "7"), F.lit(False)),
        "context": F.col("technical") | F.coalesce(F.col("major_code").isin("6", "7"), F.lit(False)),
        "process": F.col("process"),
        "source": F.coalesce(F.col(document_col) != "", F.lit(False)) if document_col else F.lit(False),
    }
    family = {r: f for f, ids in K.RULE_FAMILIES.items() for r in ids}
    met = [(r, w, F.col("exclusion").isNull() & tests[family[r]] if r in family else F.lit(False)) for r, w in rules]
    score = sum((F.when(ok, F.lit(w).cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)")) for _, w, ok in met), F.lit("0").cast("decimal(4,2)"))
    return judged.withColumns({
        "score": score.cast("decimal(4,2)"), "rules": F.filter(F.array(*[F.when(ok, F.lit(r)) for r, _, ok in met]), lambda r: r.isNotNull()),
        "include_at": F.lit(include).cast("decimal(4,2)"), "exclude_below": F.lit(exclude).cast("decimal(4,2)"),
    })


def find_conflicts(scored: DataFrame) -> DataFrame:
    """Adds conflicts, an array of struct(type, severity)."""
    t, company = F.col("t"), F.lower(F.trim(F.coalesce("company_name", F.lit(""))))
    sub = F.coalesce("sub_major_code", F.when(F.length("code") >= 2, F.substring("code", 1, 2)), F.lit(""))
    major = F.coalesce("major_code", F.lit(""))
    plain = X.has_word(t, K.NON_TECHNICAL_TITLES)
    found = [
        (plain & (major.isin("6", "7") | sub.isin("21", "31")), "CLASSIFICATION_VS_TITLE", "critical"),
        (X.has_part(t, K.TECHNICAL_TITLES) & (major.isin("4", "5", "8") | sub.isin("22", "23", "24", "26")), "CLASSIFICATION_VS_TITLE", "high"),
        (X.has_part(company, K.INDUSTRIAL_EMPLOYERS) & plain, "COMPANY_VS_OCCUPATION", "medium"),
    ]
    items = F.array(*[F.when(ok, F.struct(F.lit(k).alias("type"), F.lit(s).alias("severity"))) for ok, k, s in found])
    return scored.withColumn("conflicts", F.filter(items, lambda c: c.isNotNull()))


def decide(df: DataFrame, status_col: str = "status", confidence_col: str = "extraction_confidence") -> DataFrame:
    """Adds decision, reason_code, priority, curation_confidence and overall_confidence.

    Confidences are decimals rounded half up at the third place. The overall one is taken before an
    exclusion sets the curation confidence to 0.95.
    """
    d = "decimal(9,6)"
    error, warning = F.col(status_col) == "error", F.col(status_col) == "warning"
    hard = F.exists("conflicts", lambda c: c["type"] == "CLASSIFICATION_VS_TITLE")
    some = F.size("conflicts") > 0
    lit = lambda x: F.lit(x).cast(d)
    certain = F.when(F.col("direct_unit"), lit("0.95")).when(F.col("major_code").isNotNull(), lit("0.85")).when(F.col("score") >= 0.85, lit("0.95")).otherwise(lit("0.60"))
    df = df.withColumn("certainty", certain)
    raw = F.least(F.greatest((F.col("score") * lit("0.70") + F.col("certainty") * lit("0.30")), lit("0.40")), lit("0.98"))
    penalty = F.when(hard, lit("0.25")).when(some, lit("0.05")).otherwise(lit("0"))
    df = df.withColumn("cur", F.round(F.greatest(F.round(raw, 3) - penalty, lit("0.20")), 3).cast("decimal(6,3)"))
    ext = F.round(F.coalesce(F.col(confidence_col).cast("decimal(6,3)"), F.lit(1).cast("decimal(6,3)")), 3)
    norm = F.when(warning, lit("0.95")).otherwise(lit("0.99"))
    val = F.when(error, lit("0.40")).when(warning, lit("0.85")).otherwise(lit("1"))
    overall = F.round(ext * lit("0.20") + norm * lit("0.15") + val * lit("0.25") + F.col("cur") * lit("0.40"), 3).cast("decimal(6,3)")
    out = F.struct

    def verdict(decision, code, priority):
        return out(F.lit(decision).alias("decision"), F.lit(code).cast("string").alias("reason_code"), F.lit(priority).alias("priority"))

    case = (
        F.when(hard, verdict("REVIEW", "classification_conflict", "critical"))
        .when(F.col("exclusion").isNotNull(), verdict("EXCLUDE", None, "medium"))
        .when(error, verdict("REVIEW", "validation_error", "critical"))
        .when(some, verdict("REVIEW", "classification_conflict", "high"))
        .when(F.col("ambiguous"), verdict("REVIEW", "ambiguous_evidence", "high"))
        .when(F.col("score") >= F.col("include_at"), verdict("INCLUDE", None, "medium"))
        .when(F.col("score") < F.col("exclude_below"), verdict("EXCLUDE", None, "medium"))
        .otherwise(verdict("REVIEW", "low_confidence", "high"))
    )
    df = df.withColumns({"verdict": case, "overall_confidence": overall})
    shown = F.when(~hard & F.col("exclusion").isNotNull(), F.lit("0.95").cast("decimal(6,3)")).otherwise(F.col("cur"))
    return df.withColumn("curation_confidence", shown).select("*", "verdict.*").drop("verdict", "certainty", "cur")


def evaluate(records: DataFrame, policy: str = "occupational_relevance", exclude: list[str] | None = None, document_col: str | None = None) -> DataFrame:
    """Taxonomy, rules, conflicts and decision of every record, in one stage without a shuffle."""
    return (
        resolve_taxonomy(records).transform(judge_titles, exclude).transform(score_rules, policy, document_col).transform(find_conflicts).transform(decide)
    )


def evidence(evaluated: DataFrame, *carried: str) -> DataFrame:
    """(row_index, carried columns, evidence_type, claim, confidence): the claims that a decision rests on."""
    def item(ok, kind, claim, sure):
        return F.when(ok, F.struct(F.lit(kind).alias("evidence_type"), claim.alias("claim"), F.lit(sure).cast("decimal(4,2)").alias("confidence")))

    items = F.array(
        item(F.col("t") != "", "SOURCE_FACT", F.concat(F.lit("title:"), F.col("t")), "0.98"),
        item(F.col("code") != "", "SOURCE_FACT", F.concat(F.lit("code:"), F.col("code")), "0.99"),
        item(F.col("direct_unit"), "DERIVED_CLASSIFICATION", F.concat(F.lit("unit:"), F.coalesce("unit_code", F.lit(""))), "0.95"),
        item(~F.col("direct_unit") & F.col("major_code").isNotNull(), "DERIVED_CLASSIFICATION", F.concat(F.lit("major:"), F.coalesce("major_code", F.lit(""))), "0.75"),
        item(F.size("all_chambers") > 0, "SEMANTIC_INFERENCE", F.concat(F.lit("chambers:"), F.array_join("all_chambers", "; ")), "0.80"),
        item(F.size("conflicts") > 0, "RULE_INFERENCE", F.concat(F.lit("conflicts:"), F.size("conflicts").cast("string")), "0.99"),
    )
    return evaluated.select("row_index", *carried, F.inline(F.filter(items, lambda i: i.isNotNull())))


#: From this confidence on evidence is strong.
STRONG = "0.85"


def _rule_sure(rule: Column) -> Column:
    """How sure a satisfied rule is: by its family, and by what the title and the classification say."""
    direct = F.coalesce("direct_unit", F.lit(False))
    sure = {
        "sector": F.when(direct | (F.size("all_chambers") > 0), "0.95").otherwise("0.85"), "classification": F.when(direct, "0.95").otherwise("0.75"),
        "context": F.lit("0.85"), "process": F.lit("0.90"), "source": F.lit("0.90")}
    out = F.lit(None).cast("string")
    for family, rules in K.RULE_FAMILIES.items():
        out = F.when(rule.isin(rules), sure[family]).otherwise(out)
    return out


def evidence_full(evaluated: DataFrame, document: str, page: str, notes: str | None = None, key: str = "row_index") -> DataFrame:
    """(key, evidence_type, claim, confidence, strength, rule_id, inherited_from, document, page): all claims of a decision.

    Beside the record's facts and its classification there is one claim for each rule that it satisfies and one for each conflict, and
    what a model noted about it, if notes names a column. Classes and chambers of a wider group say where
    they are inherited from.
    """
    text = F.lit(None).cast("string")

    def item(kind: str, claim: Column, sure: Column | str, rule: Column = text, source: Column = text) -> Column:
        sure = (F.lit(sure) if isinstance(sure, str) else sure).cast("decimal(4,2)")
        return F.struct(
            F.lit(kind).alias("evidence_type"), claim.alias("claim"), sure.alias("confidence"), F.when(sure >= F.lit(STRONG).cast("decimal(4,2)"), "STRONG").otherwise("MEDIUM").alias("strength"),
            rule.alias("rule_id"), source.alias("inherited_from"))

    wide = ~F.coalesce("direct_unit", F.lit(False))
    single = F.array(
        F.when(F.col("t") != "", item("SOURCE_FACT", F.concat(F.lit("title:"), F.col("t")), "0.98")), F.when(F.col("code") != "", item("SOURCE_FACT", F.concat(F.lit("code:"), F.col("code")), "0.99")),
        F.when(~wide, item("DERIVED_CLASSIFICATION", F.concat(F.lit("unit:"), F.coalesce("unit_code", F.lit(""))), "0.95")),
        F.when(wide & F.col("major_code").isNotNull(), item("DERIVED_CLASSIFICATION", F.concat(F.lit("major:"), F.col("major_code")), "0.75", source=F.concat(F.lit("major group "), F.col("major_code")))),
        # chambers of the title alone are less sure than those of the classification
        F.when(F.size("all_chambers") > 0, item("SEMANTIC_INFERENCE", F.concat(F.lit("chambers:"), F.array_join("all_chambers", "; ")), F.when(F.size("chambers") > 0, "0.85").otherwise("0.70"), source=F.when(wide, "sector profile"))),
        F.when(F.trim(notes) != "", item("LLM_INFERENCE", F.trim(notes), "0.80")) if notes else F.lit(None).cast(evidence_type()))
    rules = F.transform("rules", lambda r: item("RULE_INFERENCE", F.concat(F.lit("rule:"), r), _rule_sure(r), rule=r))
    conflicts = F.transform("conflicts", lambda c: item("RULE_INFERENCE", F.concat(F.lit("conflict:"), c["type"], F.lit(":"), c["severity"]), "0.99"))
    every = F.concat(F.filter(single, lambda i: i.isNotNull()), rules, conflicts)
    return evaluated.select(key, F.inline(every), F.col(document).alias("document"), F.col(page).alias("page"))


def evidence_type() -> str:
    return "struct<evidence_type:string,claim:string,confidence:decimal(4,2),strength:string,rule_id:string,inherited_from:string>"


def run_summary(evaluated: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Counts of decisions and conflicts for each dataset."""
    return evaluated.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(F.col("decision") == "INCLUDE").alias("included"), F.count_if(F.col("decision") == "EXCLUDE").alias("excluded"),
        F.count_if(F.col("decision") == "REVIEW").alias("review"), F.sum(F.size("conflicts")).cast("bigint").alias("conflicts"),
    )
