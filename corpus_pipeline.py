"""A training corpus in five stages: each takes the documents its predecessor kept and returns them, but for the last,
which returns packed sequences. Every stage's result is written before the next one reads it.

All stages keep every column of the documents, whatever its name. Nulls in other columns than the text change nothing; rows
that repeat are treated alike, but for near_duplicates, where one of them stays; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, table
from paperloom.llm.op3_contextual_pii import redact
from paperloom.llm.op5_ngram_join import keep_one_of_each
from paperloom.llm.op7_decontamination import remove_contaminated
from paperloom.llm.op8_packing import pack_documents
from paperloom.llm.op9_language_id import UNDETERMINED, identify

#: A document is kept if one language has at least this share of its words.
LEAST_SHARE = 0.4
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (a null or empty text has none), and those of which no language has LEAST_SHARE of the
    words; of equal shares the language that sorts first counts. If no language can be learned, all documents go."""
    found = identify(docs)
    return found.where((F.col("found.lang") != UNDETERMINED) & (F.col("found.score") >= LEAST_SHARE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a similarity of 0.8 of their five-word shingles: the smallest doc_id (null last),
    then the first row. Links are between rows, so different texts of one doc_id all stay; a null or blank text stays."""
    return keep_one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go. Null and empty texts hold none
    and stay; items without id count like others, items without words do not count."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets, and n_chars follows the text; a null text stays null."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens; a null text is its end id alone."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.free(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
