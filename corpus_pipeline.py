"""A corpus pipeline of five training-data operators; each stage works on all rows its predecessor kept.

Counted as part of the ``llm`` subpackage. Stages take (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regrove.llm import decontaminate, jaccard, mixing, sharding, toxicity
from regrove.llm._shared import BROADCAST_ROWS, MADE, forget, hashable, quoted, remainder, word_count, written

N_SHARDS = 16


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``docs`` has it."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field scores below a half; trained on those of them that have labels and a non-zero id remainder."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(F.col("doc_id"), 5) != 0)
    score, spans = fresh(docs, "score"), fresh(docs, "spans")
    return toxicity.tag(docs, model, keep_text=True, score=score, spans=spans).where(F.col(quoted(score)) < 0.5).select(*columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id (of equal ids, the least hash of the text; null ids last).

    Texts without words belong to no group and all stay. Rows are told apart by id and text, so ids may repeat.
    """
    groups = written(jaccard.jaccard_groups(docs), "groups")
    doc, text = fresh(docs, "_doc"), fresh(docs, "_hash")
    names = lambda rows: rows.select(F.col("doc").alias(doc), F.col("hash").alias(text))
    mine = (F.col("doc_id").eqNullSafe(F.col(doc))) & (F.xxhash64("text") == F.col(text))
    few = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    gone = written(names(groups.where("not first")).distinct(), "gone")
    kept = docs.join(few(gone), mine, "left_anti")
    again = groups.where("first and component is not null").groupBy("doc", "hash").agg(F.count("*").alias("n")).where("n > 1")
    again = written(names(again), "again")
    if again.isEmpty():
        return kept
    one = kept.join(few(again), mine).groupBy(doc, text).agg(F.min_by(F.struct(*columns(docs)), F.xxhash64(*hashable(docs))).alias("_row")).select("_row.*")
    return kept.join(few(again), mine, "left_anti").select(*columns(docs)).union(one.select(*columns(docs)))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix; a document that it repeats stands there as often."""
    return mixing.held(docs, F.col("source"), word_count(F.col("text")), F.col("doc_id"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their place in it; shards hold nearly the same number of bytes."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1
    return sharding.shard_by_size(docs, size, F.xxhash64("text"), F.col("doc_id"), N_SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]
#: The first stage is a trained model, which SQL cannot express; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(MADE)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(spark, since, docs)  # what the stage wrote on its way, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
