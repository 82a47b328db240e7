"""Queries of this subpackage: thin digests of the operators, one ``opN_<name>`` for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.pii import digest, find_pii

    return digest(find_pii(_table(spark, sf_dir, "documents")))


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings."""
    from orbweave.llm.chat_tree import format_chats, read_back

    names = ["conv_id", "turn", "role", "text"]
    extra = spark.createDataFrame(
        [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string",
    )
    turns, tree = format_chats(_table(spark, sf_dir, "conversations").select(*names).union(extra))
    return read_back(turns, tree)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.repeats import find_repeats

    return find_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.quality_rules import judge

    out = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*names)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op7_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from orbweave.llm.quality_net import score, train
    from orbweave.llm.toxicity import crc_mod

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, _table(spark, sf_dir, "labels"), lambda key: crc_mod(key, 4) != 2)
    out = score(docs, net, ["doc_id"])
    return out.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.ngram_join import link_components

    return link_components(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from orbweave.llm.toxicity import crc_mod, score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _table(spark, sf_dir, "labels"), lambda key: crc_mod(key, 5) != 0)
    out = score(docs, model, ["doc_id"])
    return out.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


OPS = (
    op1_decontaminate, op2_pii, op3_chat_tree, op4_repeats, op5_quality_rules,
    op6_token_counts, op7_quality_net, op8_ngram_join, op9_packing, op10_toxicity,
)


def queries() -> dict:
    return {f.__name__: f for f in OPS}


def oracle_sql() -> dict:
    from orbweave.llm.sql import ORACLE

    return dict(ORACLE)
