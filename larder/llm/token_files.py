"""Documents as token-id files and back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bound_batches, partitions, scratch_path
from larder.llm.pfor import PforSource


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, mode: str = "append") -> None:
    """Write the token ids of each whole text, end_id after them, in ascending doc_id order as pfor files.

    A second append follows the first; mode "overwrite" replaces what is there. Null doc_id come first; rows of one doc_id follow each other by the hash of their text; a null text has the end id
    alone. An empty table makes files without documents.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    spark.dataSource.register(PforSource)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__larder_h"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "__larder_h").sortWithinPartitions("doc_id", "__larder_h")
    files = rows.select("doc_id", "text").write.format("pfor").option("tokenizer", tokenizer).option("end_id", end_id)
    files.mode(mode).save(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids, in file order; files without documents give no rows."""
    spark.dataSource.register(PforSource)
    return spark.read.format("pfor").load(path)


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read_token_files returns, row by row; null and repeated doc_id stay."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy().tolist()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the files, read them back and return token_digests of them; see write_token_files for odd rows."""
    path = path or scratch_path(docs.sparkSession, "tokens.pfor")
    write_token_files(docs, path, tokenizer, end_id)
    return token_digests(read_token_files(docs.sparkSession, path))
