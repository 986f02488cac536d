"""The registered queries of this package: name -> query, and name -> DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import alignment, decontaminate, jaccard, line_dedup, merkle, packing, passages, personal, spelling, token_counts, token_files, toxicity, warc
from larder.llm.tokens import tokenizer_path


#: The label columns, in the order of the chain: the last is the one that decides.
CATEGORIES = ("quality", "toxic")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train_chain(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score_texts(docs, chain, CATEGORIES).drop("text").withColumnRenamed("rejected", "toxic")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_digests(table(spark, sf_dir, "documents"))


_ALL = (
    op1_best_fit_packing, op2_ngram_jaccard_join, op3_document_fingerprints, op4_token_counts, op5_toxicity,
    op6_warc_derivatives, op7_benchmark_decontamination, op8_token_files, op9_line_dedup, op10_substring_dedup,
    op11_spelling_variants, op12_tokenizer_alignment, op13_personal_data,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "op3_document_fingerprints": merkle.ORACLE,
    "op6_warc_derivatives": warc.ORACLE,
    "op7_benchmark_decontamination": decontaminate.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
}
