"""A corpus from documents to packed sequences, stage by stage.

Every stage takes documents with doc_id, text and any other columns, and all but the last return the same columns. Rows
without a doc_id, with a null or empty text, and repeated rows are defined for each; an empty table passes through all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from larder.llm.common import materialize
from larder.llm.queries import CATEGORIES, table
from larder.llm.tokens import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject, row by row. Null and empty texts are never rejected; repeated rows get one answer."""
    chain = toxicity.train_chain(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score_texts(docs, chain, CATEGORIES).where("NOT rejected").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of three-line windows that came before; n_chars follows the text.

    Documents come in the order of doc_id, rows without one first, rows of one doc_id by the hash of their text. Null
    texts stay null with null n_chars; a text all of whose lines go is empty; equal rows lose the same lines.
    """
    kept = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Rows without a doc_id come after all others; of rows equal in doc_id and text one stays. Null texts and texts
    without words are in no group and all stay.
    """
    return jaccard.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, each row by its own text; null and empty texts and items contain and match nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all kept documents into sequences of at most 4096 tokens; a null or empty text is its end token, repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard_join", drop_near_duplicates), ("benchmark_decontamination", drop_benchmark_leaks), ("best_fit_packing", pack)]
#: SQL expresses neither the classifier chain nor the packing; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
