"""Best-fit packing by exact complements over a histogram of lengths.

Only the histogram, which has no more entries than the capacity, reaches the driver. There, single, pair and triple
length sums that fill a gap exactly are consumed under the availability counts; what has no exact complement is placed
best fit. The plan is a list of patterns with a number of copies; pieces find their slot by their rank among the pieces
of their length, so no task sees more than its share of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import bound_batches, materialize, partitions, slices
from larder.llm.tokens import encode_documents, worker_encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class SumIndex:
    """Lengths at hand, and the single, pair and triple sums that they make."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.there = counts > 0
        self.pairs: dict[int, int] = {}

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        self.there[length] = self.counts[length] > 0

    def largest(self, most: int) -> int:
        """The largest length at hand up to most, or 0."""
        at = np.flatnonzero(self.there[: most + 1])
        return int(at[-1]) if len(at) else 0

    def pair(self, total: int) -> int:
        """The larger length of a pair with this sum, or 0. Sums keep their last answer while it is at hand."""
        a = self.pairs.get(total)
        if a is not None and (a == 0 or (self.there[a] and self.there[total - a] and (2 * a != total or self.counts[a] > 1))):
            return a
        half = (total + 1) // 2
        both = np.flatnonzero(self.there[half:total] & self.there[total - half : 0 : -1])
        found = half + int(both[-1]) if len(both) else 0
        if found and 2 * found == total and self.counts[found] < 2:
            found = 0
        self.pairs[total] = found  # lengths only go, so "none" stays true
        return found

    def filling(self, gap: int) -> tuple[int, ...]:
        """At most three lengths at hand whose sum is gap, the largest first; () if there are none."""
        if self.there[gap]:
            return (gap,)
        if a := self.pair(gap):
            return (a, gap - a)
        for a in np.flatnonzero(self.there[:gap])[::-1].tolist():
            if 3 * a < gap:
                break
            if b := self.pair(gap - a):
                got = (a, b, gap - a - b)
                if all(self.counts[x] >= got.count(x) for x in got):
                    return got
        return ()


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their number of copies; together they hold each counted piece once.

    Each pattern uses up at least one length, so there are few more patterns than distinct lengths.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    index, plan = SumIndex(counts), []
    while first := index.largest(capacity):
        held, gap = [first], capacity - first
        index.take(first, 1)
        while gap:
            if fill := index.filling(gap):
                for x in fill:
                    index.take(x, 1)
                held += fill
                break
            if not (best := index.largest(gap)):
                break
            index.take(best, 1)
            held.append(best)
            gap -= best
        times = {x: held.count(x) for x in held}
        more = int(min(counts[x] // n for x, n in times.items()))
        for x, n in times.items():
            index.take(x, n * more)
        plan.append((tuple(held), 1 + more))
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each place of each pattern: its length, the first rank among pieces of that length, sequence and offset."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for held, copies in plan:
        offset = 0
        for x in held:
            rows.append((x, used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + copies
            offset += x
        base += copies
    rows.sort()
    table = np.array(rows or np.zeros((0, 4)), np.int64)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of pieces (with doc_id, piece, start, ids_crc32 and length, 1 to capacity) sequence_id and offset.

    pieces should be a written table: it is read twice. Other columns stay. An empty table gives an empty one.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if bad := [x for x in histogram if x is None or not 0 < x <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    table = spark.sparkContext.broadcast(slots(plan_patterns(histogram, capacity)))
    # Ranks within a length: numbered in salted groups, then shifted by what the groups before hold.
    salted = pieces.withColumn("__larder_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))))
    sizes = salted.groupBy("length", "__larder_salt").agg(F.count("*").alias("__larder_n"))
    before = Window.partitionBy("length").orderBy("__larder_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__larder_salt", F.coalesce(F.sum("__larder_n").over(before), F.lit(0)).alias("__larder_before"))
    within = Window.partitionBy("length", "__larder_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("__larder_rank", F.row_number().over(within)).join(sizes, ["length", "__larder_salt"])
    ranked = ranked.select(*columns, (F.col("__larder_before") + F.col("__larder_rank") - 1).alias("__larder_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = t["length"] << 44 | t["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__larder_rank"))
            at = np.searchsorted(keys, length.astype(np.int64) << 44 | rank, "right") - 1
            sequence = t["sequence"][at] + rank - t["rank"][at]
            own = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(t["offset"][at])], names=[*columns, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType(list(pieces.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(place, schema)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Cut the token ids of each whole text, with end_id after them, into pieces of at most capacity.

    Only longer documents are cut. A null or empty text has the end id alone. with_ids adds the ids themselves.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for batch in slices(batches):
            ids, starts = encode_documents(encoder, batch.column("text"), end_id)
            counts = np.diff(starts)
            n = -(-counts // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, counts[row] - start)
            a = starts[row] + start
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(data[4 * i : 4 * (i + k)]) for i, k in zip(a.tolist(), length.tolist(), strict=True)]
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(a, starts[-1]), pa.int32()), pa.array(ids.view(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pack whole documents (doc_id long, text string; others are ignored) into sequences of at most capacity tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null doc_id and repeated rows are
    pieces like any other. An empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity)


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array), doc_ids and offsets of their pieces in order.

    Null and empty texts are their end id alone, null doc_id and repeated rows are packed each, texts longer than a
    sequence are cut into several, an empty table gives no rows; columns besides doc_id and text are ignored.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, with_ids=True), "pieces")
    placed = pack_pieces(pieces, capacity)
    row = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # capacity ids at most
    return placed.groupBy("sequence_id").agg(row.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets")
    )
