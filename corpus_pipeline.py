"""The corpus pipeline: toxicity, n-gram join, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the docs
of the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import decontaminate, ngram_join, packing, pii, toxicity
from orbweave.session import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier doesn't reject.

    Null and empty texts are scored as no windows; repeated rows stay or go together, null ids are
    scored as any other; without labels of both classes all stay.
    """
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), lambda key: toxicity.crc_mod(key, 5) != 0)
    return toxicity.score(docs, model).where(F.col("score") < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group that n-gram links connect.

    Rows without words and null ids link with nothing and stay.  Of rows that share a doc_id, one of
    each different text stays.
    """
    found = ngram_join.link_components(docs)
    # staged, so that its size is known and Spark broadcasts it below its threshold only
    copies = stage(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    twice = stage(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    single = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    return single.union(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, verbatim or re-parameterised.

    Null and empty texts and null ids stay; rows that share a doc_id go if one of them has an item.
    """
    leaks = decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(stage(leaks, "leaks"), "doc_id", "left_anti").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found spans replaced by their kind; n_chars follows the new text, null texts keep theirs."""
    n_chars = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return pii.redact(docs).withColumn("n_chars", n_chars).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, repeated rows and null ids too, with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: A stage that encodes texts, and one that fits a classifier, have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
