"""Ledgers of people's work: reviews, edits, resolved issues, deletions, policies and intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .audit import field_changes


def status_after(action: Column, status: Column) -> Column:
    """The status of a record after a review action; other actions leave it."""
    return F.when(action == "approve_record", "human_reviewed").when(action == "reject_record", "error").when(action == "flag_record", "warning").otherwise(status)


def apply_reviews(records: DataFrame, reviews: DataFrame, key: str, order: str = "seq", action: str = "action") -> DataFrame:
    """records with status by the last review of each; a null or missing review leaves it."""
    last = reviews.groupBy(key).agg(F.max_by(action, order).alias("__action"))
    return records.join(last, key, "left").withColumn("status", status_after(F.col("__action"), F.col("status"))).drop("__action")


def edit_records(records: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records with the edits and status human_reviewed, audits).

    A null in an edit leaves its field. Every changed field has an audit row (key, field, old_value,
    new_value); an edit that changes nothing has one for the field record.
    """
    new = edits.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__edited"))
    after = records.join(new, key, "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields})
    after = after.withColumn("status", F.when(F.col("__edited"), "human_reviewed").otherwise(F.col("status"))).select(*records.columns)
    changed = field_changes(records, after, key, fields)
    same = edits.select(key).join(records.select(key), key).join(changed.select(key).distinct(), key, "left_anti")
    none = F.lit(None).cast("string")
    return after, changed.unionByName(same.select(key, F.lit("record").alias("field"), none.alias("old_value"), none.alias("new_value")))


def resolve_issues(issues: DataFrame, resolutions: DataFrame, key: str = "row_index") -> DataFrame:
    """issues plus resolved and fix; resolutions has key, column and fix (null: resolved without one)."""
    made = resolutions.select(key, "column", "fix", F.lit(True).alias("resolved"))
    return issues.join(made, [key, "column"], "left").fillna(False, ["resolved"])


def issue_audit(issues: DataFrame, resolutions: DataFrame, key: str = "row_index") -> DataFrame:
    """(key, column, rule, action, old_value, new_value): the audit of what resolve_issues() resolves, one row for each issue.

    A resolution of an issue that does not exist leaves no row.
    """
    made = resolutions.select(key, "column", "fix")
    return issues.join(made, [key, "column"]).select(
        key, "column", "rule", F.lit("resolve_issue").alias("action"), F.lit("open").alias("old_value"), F.coalesce(F.concat(F.lit("resolved: "), F.col("fix")), F.lit("resolved")).alias("new_value"))


def severity_counts(issues: DataFrame) -> DataFrame:
    """(severity, n) of open issues; error, warning and info are there even with none."""
    spark = issues.sparkSession
    seeds = spark.createDataFrame([("error",), ("warning",), ("info",)], "severity string")
    found = issues.groupBy("severity").agg(F.count("*").alias("n"))
    return seeds.join(found, "severity", "full").select("severity", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def without_deleted(records: DataFrame, deleted: DataFrame, key: str, dataset: str = "dataset_id") -> tuple[DataFrame, DataFrame]:
    """(the records that stay, their number by dataset); datasets that lose all their records count 0."""
    stay = records.join(deleted.select(key), key, "left_anti")
    counts = records.select(dataset).distinct().join(stay.groupBy(dataset).agg(F.count("*").alias("n")), dataset, "left").fillna(0, ["n"])
    return stay, counts


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children without those of deleted parents."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


#: Levels of a tree below a deleted node that are followed.
LEVELS = 100


def cascade_levels(nodes: DataFrame, deleted: DataFrame) -> DataFrame:
    """(id, kind, depth): all nodes that go with the deleted ones, through any number of levels.

    nodes has (id, parent, kind), deleted has id. depth is 0 for nodes deleted themselves, else the distance
    to the nearest of those above; unknown ids delete nothing. A tree of more than LEVELS levels, or a
    circle, is an error.
    """
    spark = nodes.sparkSession
    # the limits of recursion are settings of the session, and rows are not limited here
    before = {k: spark.conf.get(k) for k in ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")}
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(LEVELS))
    try:
        gone = spark.sql(
            """WITH RECURSIVE gone(id, kind, depth) AS (
              SELECT n.id, n.kind, 0 FROM {nodes} n WHERE n.id IN (SELECT id FROM {deleted})
              UNION ALL SELECT n.id, n.kind, g.depth + 1 FROM {nodes} n JOIN gone g ON n.parent = g.id
              WHERE NOT EXISTS (SELECT 1 FROM {deleted} d WHERE d.id = n.id)
            ) SELECT id, kind, depth FROM gone""", nodes=nodes.select("id", "parent", "kind"), deleted=deleted.select("id").distinct())
        # nodes with a deleted one above and below it are met once from the nearest, as a deleted node starts its own branch
        return settled(gone)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def recount(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """(kind, total, deleted, direct): how many nodes of each kind there are, go, and were deleted themselves."""
    both = nodes.select("id", "kind").join(gone.select("id", "depth"), "id", "left")
    return both.groupBy("kind").agg(F.count("*").alias("total"), F.count("depth").alias("deleted"), F.count_if(F.col("depth") == 0).alias("direct"))


def policies(built_in: DataFrame, stored: DataFrame, key: str = "policy_id", order: str = "seq") -> DataFrame:
    """The last stored version of each policy, and the built-in ones that none overrides; stored says which."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = stored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", order).withColumn("stored", F.lit(True))
    return last.unionByName(built_in.join(last.select(key), key, "left_anti").withColumn("stored", F.lit(False)))


def intents(events: DataFrame, key: str = "intent_id", order: str = "seq", action: str = "action") -> DataFrame:
    """The intents whose last event is no deletion, as that event left them."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("__n", F.row_number().over(w)).where(f"__n = 1 and {action} <> 'delete'").drop("__n", action)


def override(records: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> dict[str, DataFrame]:
    """records, evidence, ledger and audit after people's decisions.

    overrides has key, decision, reason and corrected values of fields (null: as it was); those without
    a record are ignored. Evidence of an override is certain; the ledger keeps both decisions.
    """
    new = overrides.select(key, F.col("decision").alias("__decision"), "reason", *[F.col(f).alias(f"__{f}") for f in fields])
    both = records.join(new, key)
    ledger = both.select(key, F.col("decision").alias("old_decision"), F.col("__decision").alias("new_decision"), "reason")
    evidence = both.select(key, F.lit("HUMAN_OVERRIDE").alias("evidence_type"), F.col("reason").alias("claim"), F.lit(1.0).alias("confidence"))
    after = records.join(new.drop("reason"), key, "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields} | {"decision": F.coalesce("__decision", "decision")})
    after = after.select(*records.columns)
    return {"records": after, "evidence": evidence, "ledger": ledger, "audit": field_changes(records, after, key, ["decision", *fields])}
