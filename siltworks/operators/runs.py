"""Curation runs kept as tables: a later run replaces the decisions of its datasets, all at once or not at all.

A run writes its rows under its own id, which nobody reads yet, and then one commit row for each of
its datasets. Readers follow the last commit of a dataset, so a run that ends before its commits
leaves the old decisions, conflicts and evidence as they are. The ledger keeps the rows of every committed run.
One run at a time writes to a dataset. Records without a dataset belong to no run and are left out.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from . import curation

REPLACED = ("decisions", "conflicts", "evidence")
COMMIT = "dataset_id string, run_id string, seq long, policy string, total long, included long, excluded long, review long, conflicts long, manifest string, manifest_sha256 string"
KEYS = ["run_id", "dataset_id"]


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """All commits; none before the first run."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{folder}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of runs with the ids as they are, even where they look like numbers; None if it has no rows."""
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException as e:
        # a run without such rows leaves no file
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name in KEYS else f for f in found])).parquet(path)


def last_commits(spark: SparkSession, folder: str) -> DataFrame:
    """The commit that each dataset's readers follow."""
    rows = commits(spark, folder)
    last = rows.groupBy("dataset_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "dataset_id"]), "seq").alias("c"))
    return last.select("dataset_id", "c.*")


def current(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of decisions, conflicts or evidence by the last committed run of each dataset; only the ids as columns if there are none at all."""
    rows = _read(spark, f"{folder}/{table}")
    if rows is None:
        return spark.createDataFrame([], "run_id string, dataset_id string")
    # run and dataset are partitions, so the join prunes the folders of other runs
    return rows.join(last_commits(spark, folder).select(*KEYS), KEYS)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Every decision of every committed run, in order of seq."""
    rows = _read(spark, f"{folder}/ledger")
    if rows is None:
        return spark.createDataFrame([], "run_id string, dataset_id string, seq long")
    return rows.join(commits(spark, folder).select(*KEYS, "seq"), KEYS)


def _put(rows: DataFrame, folder: str, table: str, run_id: str) -> None:
    # a run that is tried again replaces what its first attempt left
    kept = rows.withColumn("run_id", F.lit(run_id))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{folder}/{table}")


def write_tables(evaluated: DataFrame, folder: str, run_id: str, policy: str, key: str = "row_index") -> None:
    """The first half of a run: its tables under its id, which no reader sees before commit()."""
    spark = evaluated.sparkSession
    if not commits(spark, folder).where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id!r} is committed already")
    _put(evaluated.where("dataset_id <> ''"), folder, "decisions", run_id)
    # the other tables come from what was written, so records are evaluated once
    made = _read(spark, f"{folder}/decisions/run_id={run_id}")
    if made is None:
        return
    count = made.count()
    stored, made = made, spread(made, key, rows=count)
    _put(made.select(key, "dataset_id", F.inline("conflicts")), folder, "conflicts", run_id)
    _put(curation.evidence(made, "dataset_id"), folder, "evidence", run_id)
    # listed now, as a first attempt's files are gone since the decisions were written
    before = spark.createDataFrame([], "dataset_id string, k string, previous_value string")
    if not last_commits(spark, folder).isEmpty():
        before = current(spark, folder, "decisions").select("dataset_id", F.col(key).cast("string").alias("k"), F.col("decision").alias("previous_value"))
        count = max(count, before.count())
    sides = [spread(side, "dataset_id", "k", rows=count) for side in (stored.withColumn("k", F.col(key).cast("string")), before)]
    entry = sides[0].join(sides[1], ["dataset_id", "k"], "left")
    entry = entry.select(
        key, "dataset_id", F.lit("CURATION").alias("stage"), F.lit("curation_decision").alias("field"), F.coalesce("previous_value", F.lit("unprocessed")).alias("previous_value"),
        F.col("decision").alias("new_value"), F.col("reason_code").alias("reason"), F.lit("CurationEngine").alias("actor"), F.lit(policy).alias("actor_id"))
    _put(entry, folder, "ledger", run_id)


def commit(spark: SparkSession, folder: str, run_id: str, policy: str) -> None:
    """The second half: one file of commit rows, which makes the run the current one of its datasets."""
    made = _read(spark, f"{folder}/decisions/run_id={run_id}")
    if made is None:
        return
    seq = (commits(spark, folder).agg(F.max("seq")).first()[0] or 0) + 1
    counts = curation.run_summary(made)
    body = F.to_json(F.struct("dataset_id", F.lit(policy).alias("policy"), *[c for c in counts.columns if c != "dataset_id"]))
    rows = counts.withColumns({"run_id": F.lit(run_id), "seq": F.lit(seq).cast("bigint"), "policy": F.lit(policy), "manifest": body, "manifest_sha256": F.sha2(body, 256)})
    rows.select(*[c.split()[0] for c in COMMIT.split(", ")]).coalesce(1).write.mode("append").parquet(f"{folder}/commits")


def run(evaluated: DataFrame, folder: str, run_id: str, policy: str, key: str = "row_index") -> None:
    """Replaces the decisions, conflicts and evidence of the datasets in evaluated, and adds to the ledger; a run over nothing changes nothing."""
    write_tables(evaluated, folder, run_id, policy, key)
    commit(evaluated.sparkSession, folder, run_id, policy)


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Deletes the folders of runs that no reader follows: superseded ones, and ones that were never committed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    live = {(r.run_id, r.dataset_id) for r in last_commits(spark, folder).select(*KEYS).collect()}
    done = {(r.run_id, r.dataset_id) for r in commits(spark, folder).select(*KEYS).collect()}
    gone = []
    for table in (*REPLACED, "ledger"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
        files = path.getFileSystem(conf)
        for state in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}/run_id=*/dataset_id=*")):
            at = state.getPath()
            part = (at.getParent().getName().removeprefix("run_id="), jvm.java.net.URLDecoder.decode(at.getName().removeprefix("dataset_id="), "UTF-8"))
            if part not in (done if table == "ledger" else live):
                files.delete(at, True)
                gone.append(f"{table}/{at.getParent().getName()}/{at.getName()}")
    return sorted(gone)
