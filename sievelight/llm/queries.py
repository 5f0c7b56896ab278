"""Queries of the training-data operators: one ``opN_<name>`` each, and ``pipeline``.

A query applies its operator to its whole table and derives the columns of its
contract from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.scratch import bound_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query under its name, with its SQL for the oracle if any."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """Vocabulary that op1 is held against; any file of ranks can be given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sievelight.llm import bpe

    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file(), public_tokenizers.PATTERN)


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import simhash

    return simhash.with_neighbours(simhash.edited_pairs(table(spark, sf_dir, "documents")))


@query("op7_compress")
def op7_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import compress

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = compress.fit(docs, labels.where(~held_out))
    return compress.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_rules")
def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import crf

    docs = table(spark, sf_dir, "documents")
    return crf.judge(docs, crf.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_chat")
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import chat

    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    messages = chat.linear(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    path = chat.branches(messages)
    formatted = chat.format_branches(chat.with_messages(path, messages))
    return chat.read_back(formatted).withColumnRenamed("tree", "conv_id")


@query("op2_jaccard")
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import jaccard

    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("class_id")


@query("op4_kneser_ney")
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import kneser

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(kneser.fold() == 1, F.lit(False))
    return kneser.score(docs, kneser.count(docs.where(~held_out))).withColumn("held_out", held_out)


def _line_oracle() -> str:
    from sievelight.llm import lines

    return lines.ORACLE


@query("op6_lines", _line_oracle())
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import lines

    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_gear")
def op8_gear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import gear

    return gear.dedup(table(spark, sf_dir, "documents"), with_text=False)


#: Target mixture: sources alike, languages by share, topics (numbered from the largest cluster) evened out.
MIXTURE = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12},
    "topic": {"t0": 0.66, "t1": 0.10, "t2": 0.07, "t3": 0.05, "t4": 0.04, "t5": 0.03, "t6": 0.03, "t7": 0.02},
}
#: Share of all words that the sample is to have.
SAMPLE_SHARE = 0.5


@query("op3_mix")
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import mix

    return mix.sample(table(spark, sf_dir, "documents"), MIXTURE, SAMPLE_SHARE)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
