"""The corpus pipeline: stages that each apply one operator of siltworks.llm to what the last one kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents; each
result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from siltworks.llm.common import ready
from siltworks.llm.shards import keyed
from siltworks.session import importable, remove


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels of the documents given.

    A null text counts as empty; without labels every score is 0.5 and everything goes.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).where("predicted = 1").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from every text, and n_chars follows; documents left without text go too.

    A null text stays as it is. Of equal lines the one of the smallest doc_id stays, a null id first.
    """
    out = line_dedup.dedup_lines(docs).drop("n_lines", "n_removed")
    out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.where("text is null or length(trim(text)) > 0").select(docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 on sets of five words, the one with the smallest id stays.

    Rows without an id stay only if their group has no row with one. Of rows with one id and text the one
    with the smallest other columns stays. Texts without words have no partner.
    """
    classes = jaccard_join.similar_classes(docs, size=5, num=80, den=100)
    # a null id counts as the smallest long inside the operator
    rows = classes.withColumn("__doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    named = rows.where("doc_id is not null and doc_id = component_id")
    first = named.groupBy("component_id").agg(F.min(F.struct("__doc", "__row")).alias("f")).select("f.*")
    bare = rows.where("doc_id is null and component_id is null").select("__doc", "__row").distinct()
    kept = first.unionByName(bare)
    rows = keyed(docs, "doc_id", "text").join(kept, ["__doc", "__row"], "left_semi")
    return rows.groupBy("__doc", "__row").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("r")).select("r.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; null and empty texts leak nothing."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids and the decoded text of each document; a null text has no tokens."""
    path = bpe.word_vocabulary()
    out = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "n_chars", "text"), path)
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


def _stage(function):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        return function(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality", _stage(keep_good)),
    ("line_dedup", _stage(drop_repeated_lines)),
    ("jaccard_join", _stage(keep_one_of_similar)),
    ("decontaminate", _stage(drop_leaks)),
    ("bpe", _stage(to_tokens)),
]

#: The classifier, SimHash and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what each keeps goes through Parquet in the shared folder.

    A stage's Parquet goes once the next one is written; that of the last but one stays, as the result reads it.
    """
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove(spark, before)
            before = f"{folder}/{name}"
    return docs
