"""Where a record comes from and what held when: pipeline steps, ledger entries, and states as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(points: DataFrame, changes: DataFrame, key: str, time: str, order: str, values: list[str], block: str = "DAY") -> DataFrame:
    """points plus the values that the last change of their key at or before their time set.

    Changes count by when they happened, however late they arrived; of changes at one time the one of the highest
    order counts, and a change at the point's own time does. A null value that a change sets is
    a value. Points before the first change of their key, without one, or with a null key or time
    have nulls; changes with a null key or time are left out.

    Both sides are dealt out by key and block of time (a unit of date_trunc), and what the blocks before left is
    carried on, so a key with many changes is no single task.
    """
    # a column for what was set says apart nothing set and a null set
    put = F.struct(F.lit(True).alias("set"), *[F.col(v) for v in values])
    own = [c for c in points.columns]
    clash = [v for v in values if v in own]
    if clash:
        raise ValueError(f"points have columns {clash} already")
    usable = changes.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    a = points.select(F.col(key).alias("__key"), F.col(time).alias("__time"), F.lit(1).alias("__kind"), F.struct(*own).alias("__point"))
    b = usable.select(F.col(key).alias("__key"), F.col(time).alias("__time"), F.lit(0).alias("__kind"), F.col(order).alias("__order"), put.alias("__put"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__block", F.date_trunc(block, "__time"))
    last = b.withColumn("__block", F.date_trunc(block, "__time")).groupBy("__key", "__block").agg(F.max_by("__put", F.struct("__time", "__order")).alias("__left"))
    # a block of points alone passes on what came before it
    blocks = both.select("__key", "__block").distinct().join(last, ["__key", "__block"], "left")
    earlier = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("__key", "__block", F.last("__left", ignorenulls=True).over(earlier).alias("__carried"))
    within = Window.partitionBy("__key", "__block").orderBy("__time", "__kind", "__order").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__now", F.last("__put", ignorenulls=True).over(within)).where("__kind = 1")
    joined = seen.join(carried.where("__carried is not null"), ["__key", "__block"], "left").withColumn("__now", F.coalesce("__now", "__carried"))
    return joined.select(*[F.col(f"__point.`{c}`").alias(c) for c in own], *[F.col(f"__now.{v}").alias(v) for v in values])


def steps(evaluated: DataFrame, key: str, page: Column, method: Column, changed: Column, issues: Column, notes: Column, created: Column, updated: Column) -> DataFrame:
    """(key, step, stage, actor, status, detail, at): the steps of each record in order.

    Extraction, normalisation, curation and validation, and the human review of records that had one:
    those of status human_reviewed or with notes.
    """
    def step(stage: str, actor: Column, status: Column, detail: Column, at: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), actor.alias("actor"), status.alias("status"), detail.alias("detail"), at.alias("at"))

    decision = F.coalesce("decision", F.lit("unprocessed"))
    reviewed = F.coalesce(F.col("status") == "human_reviewed", F.lit(False)) | (F.coalesce(notes, F.lit("")) != "")
    found = F.array(
        step("EXTRACTION", F.concat(F.lit("Extractor ("), method, F.lit(")")), F.lit("completed"), F.concat(F.lit("page "), page.cast("string")), created),
        step("NORMALIZATION", F.lit("Normalizer"), F.lit("completed"), F.when(changed, "values changed").otherwise("values as they were"), created),
        step("CURATION", F.lit("Curation Engine"), F.lower(decision), F.coalesce("reason_code", F.lit("")), updated),
        step("VALIDATION", F.lit("Validator"), F.when(issues > 0, "warning").otherwise("passed"), F.concat(issues.cast("string"), F.lit(" issues")), created),
        F.when(reviewed, step("HUMAN_REVIEW", F.lit("Human Operator"), F.lit("approved"), F.coalesce(F.nullif(notes, F.lit("")), F.lit("confirmed")), updated)),
    )
    rows = evaluated.select(key, F.posexplode(F.filter(found, lambda s: s.isNotNull())).alias("n", "s"))
    return rows.select(key, (F.col("n") + 1).alias("step"), "s.*")


def with_ledger(made: DataFrame, ledger: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """The steps of steps() followed by the ledger entries of each record by time; ledger has stage, actor, previous_value and new_value.

    Entries are numbered within their record after its steps; entries of unknown records are left out.
    """
    count = made.groupBy(key).agg(F.max("step").alias("__n"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(time, order))
    detail = F.concat(F.coalesce("previous_value", F.lit("")), F.lit(" -> "), F.coalesce("new_value", F.lit("")))
    entries = ledger.select(key, number.alias("__k"), "stage", "actor", F.lit("recorded").alias("status"), detail.alias("detail"), F.col(time).alias("at")).join(count, key)
    return made.unionByName(entries.withColumn("step", F.col("__n") + F.col("__k")).select(made.columns))
