"""Token counts by a two-tier look-up on the map side.

Tier one is a broadcast table of the most frequent pre-tokens and their numbers of tokens. It comes from a
frequent-items sketch over all documents, whose partial aggregates are all that is shuffled. Tier two, in each Python
worker, encodes the pre-tokens that the table lacks once and remembers their counts. No pre-token is ever shuffled, and
the table only saves time: counts never depend on it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bound_batches, slices

#: Entries of the broadcast table and of the sketch behind it, and the longest pre-token remembered.
FREQUENT, TRACKED, LONGEST = 20_000, 65_536, 64
#: Groups in which the sketches of tasks meet.
GROUPS = 16
#: Pre-tokens a worker remembers before it starts again.
REMEMBERED = 500_000
#: The byte-level pre-token pattern (fixed value of this family of tokenizers).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which the pattern's classes are known to agree with the library's; other texts go through the library whole.
VERIFIED = r"[^\t\n\r\x20-\x7e¡-ſ‐-‧€]"


def frequent_words(docs: DataFrame, n: int = FREQUENT, tracked: int = TRACKED) -> list[str]:
    """The n words that a sketch of `tracked` items finds most frequent between spaces in all texts."""
    words = docs.select(F.explode(F.split("text", " ")).alias("w")).where(F.length("w").between(1, LONGEST))
    # Sketches of tasks meet in groups first, so that the last step gets a bounded number of them however many tasks there are.
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS))
    sketches = words.groupBy(group.alias("g")).agg(F.expr(f"approx_top_k_accumulate(w, {tracked})").alias("s"))
    all_of = sketches.groupBy(F.lit(0).alias("g")).agg(F.expr("approx_top_k_combine(s)").alias("s"))  # no row without words
    top = all_of.select(F.expr(f"approx_top_k_estimate(s, {n})").alias("t")).first()  # n items at most
    return [r["item"] for r in top["t"]] if top else []


class PreTokenCounter:
    def __init__(self, path: str, table: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.table, self.own = Tokenizer.from_file(path), table, {}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = regex.compile("|".join([VERIFIED, *map(regex.escape, special)]))
        self.split = regex.compile(PATTERN).findall

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if self.odd.search(text):
            return self.lengths([text])[0]
        pieces = self.split(text)
        table, own = self.table, self.own
        got = [table.get(p) or own.get(p) or 0 for p in pieces]
        if 0 in got:
            missing = list({p for p, n in zip(pieces, got, strict=True) if not n})
            new = dict(zip(missing, self.lengths(missing), strict=True))
            if len(own) > REMEMBERED:
                own.clear()
            own.update((p, n) for p, n in new.items() if len(p) <= LONGEST)
            return sum(n or new[p] for p, n in zip(pieces, got, strict=True))
        return sum(got)


#: The counter of this Python worker, which Spark uses for many tasks, by the name of its table.
_COUNTERS: dict[str, PreTokenCounter] = {}


def worker_counter(name: str, path: str, table) -> PreTokenCounter:
    """The worker's counter for the broadcast table of that name; what it remembers lasts from task to task."""
    if name not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[name] = PreTokenCounter(path, table.value)
    return _COUNTERS[name]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, table: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    tokenizer is the path of a byte-level BPE file. Null and empty texts have no tokens; special strings inside texts
    count as the library's default has it. Repeated rows are counted each. table may carry over from another run.
    """
    spark = docs.sparkSession
    if table is None:
        words = frequent_words(docs)
        pieces = {p for w in words for p in regex.findall(PATTERN, " " + w)}
        names = sorted(pieces)
        table = dict(zip(names, PreTokenCounter(tokenizer, {}).lengths(names), strict=True))
    sent, name = spark.sparkContext.broadcast(table), uuid.uuid4().hex
    bound_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(name, tokenizer, sent)
        for batch in slices(batches):
            n = [counter.count(t) if t else 0 for t in batch.column("text").to_pylist()]
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(np.array(n) > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
