"""Corpus pipeline: quality rules, line dedup, near-duplicate groups, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet to the shared folder and read again as the next stage's documents.  All but
the last return the columns of documents; n_chars follows the text.  Null ids pass
the stages like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import bpe, crf, jaccard, lines, mix
from sievelight.llm.queries import MIXTURE, SAMPLE_SHARE, table, tokenizer_file
from sievelight.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules or the line labels reject."""
    field = crf.fit(docs, table(spark, sf_dir, "labels"))
    return crf.keep(docs.select(*COLUMNS), field)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows; a document left without any visible character goes."""
    out = lines.dedup(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | (F.length(F.trim(F.translate("text", "\n\r\t", "   "))) > 0))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that of the smallest id."""
    return jaccard.keep(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards the target mixture."""
    return mix.keep(docs.select(*COLUMNS), MIXTURE, SAMPLE_SHARE)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left."""
    import public_tokenizers

    return bpe.encode_decode(docs, tokenizer_file(), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("tokenize", tokenize),
]

#: SQL cannot express the random field, the raking and the merges; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
