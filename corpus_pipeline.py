"""Training-data pipeline over `documents`: quality, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. Between stages the
result is written as Parquet and read again. Nulls: a null text has no words and goes with the first stage; a null doc_id is kept as it is.
Repeated rows are near copies of each other: one stays. An empty table stays empty. Extra columns pass all stages but the last, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import bpe_automaton, decontamination, jaccard_join, quality_rules, suffix_dedup
from memloom.llm.common import stored, table, tokenizer_path


def _free(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column has (case does not tell columns apart)."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    to = _free(docs, "rejected_by")
    return quality_rules.apply_cascade(docs, to=to).where(F.col(to).isNull()).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each component of near copies (five words, similarity 0.8)."""
    return jaccard_join.one_of_each(docs, words=5, num=80, den=100)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 50-byte strings that start in a document with a smaller doc_id; n_chars follows the text."""
    to = _free(docs, "n_removed")
    cut = suffix_dedup.dedup(docs, to=to)
    return cut.withColumn("n_chars", F.when(F.col(to) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and the text that they decode to."""
    coded = bpe_automaton.encode_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality_rules", quality), ("jaccard_join", near_copies), ("suffix_dedup", passages), ("decontamination", leaks), ("bpe_automaton", tokens)]

#: SQL can't express the parses, fingerprints and merges of the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
