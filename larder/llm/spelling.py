"""Spelling variants of a corpus' words by two-dimensional range reporting.

Words of one length, sorted forwards and sorted by their reversals, are points of a grid. Two words differ by one
replaced, deleted or inserted code point exactly if, at some edit position, one lies in the rectangle of the other's
prefix (an interval of the one order) and suffix (an interval of the other order). Wavelet trees over the points report
all of a rectangle.

The grid is cut so that no task holds it whole. A chunk is a run of one length's words in forward or in backward order,
bounded in rows and bytes, and has a wavelet tree of its own. A word goes to the chunks that its prefix interval
overlaps in forward order, or its suffix interval in backward order, whichever are fewer for that edit position: one of
the two fixes half of the word's letters at least, so there are few, and where many words share a half they are told
apart by the other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bound_batches, materialize, partitions

#: A run of letters (words hold code points up to U+00FF only), the least code points and occurrences of a word.
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A word's form occurs this many times as often at least.
RATIO = 5
#: Every run whose checksum this divides loses a code point.
SLIP = 199
#: Rows and bytes of a chunk, and edit positions that a task looks up at a time.
CHUNK_WORDS, CHUNK_BYTES, POSITIONS = 50_000, 1 << 20, 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = "Ā"  # follows every code point of a word


def count_words(docs: DataFrame, slip: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, the occurrences of each run of letters in all texts, with A-Z lower-cased; null texts have none.

    With slip, a run loses the code point at h % length if slip divides h, the crc32 of "<doc_id>:<run>" in UTF-8 (a
    null doc_id: empty). Only words of least_length code points and least_count occurrences are kept.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    runs = runs.where(F.length("run") >= least_length)
    runs = runs.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("word"))
    if slip:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word"))
        runs = runs.select("word", h.alias("h"))
        place = (F.col("h") % F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % slip == 0, short).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """Wavelet tree of a permutation, level by level: where each bit's zeros stood."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for b in reversed(range(max(1, int(len(values) - 1).bit_length()))):
            zero = (values >> b) & 1 == 0
            self.levels.append((b, np.concatenate([[0], np.cumsum(zero)]), int(zero.sum())))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a query and a value in [low, high) at a place in [left, right)."""
        query = np.flatnonzero((left < right) & (low < high))
        left, right, base = left[query], right[query], np.zeros(len(query), np.int64)
        for b, zeros, n_zero in self.levels:
            l0, r0, half = zeros[left], zeros[right], 1 << b
            l1, r1 = n_zero + left - l0, n_zero + right - r0
            lo, hi = low[query], high[query]
            a = (l0 < r0) & (base < hi) & (base + half > lo)
            c = (l1 < r1) & (base + half < hi) & (base + 2 * half > lo)
            left, right = np.concatenate([l0[a], l1[c]]), np.concatenate([r0[a], r1[c]])
            query, base = np.concatenate([query[a], query[c]]), np.concatenate([base[a], base[c] + half])
        return query, base


def _intervals(index: np.ndarray, asked: np.ndarray, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of row and length, the interval of the sorted index whose strings begin with asked[row][:length]."""
    width = max(index.dtype.itemsize, asked.dtype.itemsize)
    every = np.concatenate([index.astype(f"S{width}"), asked.astype(f"S{width}")])
    order = np.argsort(every, kind="stable")
    letters = every[order].view(np.uint8).reshape(len(every), width)
    same = letters[1:] == letters[:-1]
    shared = np.where(same.all(1), width, same.argmin(1))
    before = np.concatenate([[0], np.cumsum(order < len(index))])
    place = np.empty(len(every), np.int64)
    place[order] = np.arange(len(every))
    at = place[len(index) + row]
    first, last = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    by_length = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[by_length])) + 1
    for part in np.split(by_length, cuts):
        if len(part):
            edges = np.concatenate([[0], np.flatnonzero(shared < length[part[0]]) + 1, [len(every)]])
            of = np.searchsorted(edges, at[part], side="right")
            first[part], last[part] = before[edges[of - 1]], before[edges[of]]
    return first, last


def _flipped(keys: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Strings of bytes backwards; all are as long as their type."""
    width = keys.dtype.itemsize
    return np.ascontiguousarray(keys.view(np.uint8).reshape(len(keys), width)[:, ::-1]).view(f"S{width}").ravel()


class Chunk:
    """Words of one length in one order, with the tree of their places in the opposite order."""

    def __init__(self, words: list[str], counts: list[int], backward: bool):
        self.backward = backward
        keys = np.array([w.encode("latin-1") for w in words])
        keys = _flipped(keys) if backward else keys
        order = np.argsort(keys, kind="stable")
        self.words, self.counts, self.keys = [words[i] for i in order], [counts[i] for i in order], keys[order]
        ends = _flipped(self.keys)
        self.by_end = np.argsort(ends, kind="stable")
        self.ends = ends[self.by_end]
        rank = np.empty(len(words), np.int64)
        rank[self.by_end] = np.arange(len(words))
        self.tree = WaveletTree(rank)

    def near(self, words: list[str], positions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word's number (all are of one length: this chunk's, or one more) and of a word of the chunk that differs at one of its positions."""
        n = len(words[0])
        keys = np.array([w.encode("latin-1") for w in words])
        keys = _flipped(keys) if self.backward else keys
        row = np.repeat(np.arange(len(words)), [len(p) for p in positions])
        at = np.concatenate(positions).astype(np.int64)
        head = n - 1 - at if self.backward else at
        tail = n - 1 - head
        left, right = _intervals(self.keys, keys, row, head)
        some = np.flatnonzero(left < right)
        row, left, right, tail = row[some], left[some], right[some], tail[some]
        if not len(row):
            return row, row
        low, high = _intervals(self.ends, _flipped(keys), row, tail)
        query, value = self.tree.report(left, right, low, high)
        row, found = row[query], self.by_end[value]
        if n == self.keys.dtype.itemsize:
            other = self.keys[found] != keys[row]
            row, found = row[other], found[other]
        return row, found


_CHUNKS = "backward boolean, size int, chunk long, word string, n long"


def chunks_of(words: DataFrame) -> DataFrame:
    """Every word twice, in forward and in backward order, with the chunk of that order and length that holds it."""
    both = words.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"), F.length("word").alias("size"), "word", "n")
    both = both.withColumn("key", F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word")))
    rows = 2 * words.count()
    parts = max(min(partitions(words.sparkSession), rows // 1000 + 1), -(-rows // CHUNK_WORDS))
    both = both.repartitionByRange(parts, "backward", "size", "key").sortWithinPartitions("backward", "size", "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, last, rows, size = TaskContext.get().partitionId() << 32, None, 0, 0
        for batch in batches:
            out = []
            for kind in zip(batch.column("backward").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if kind != last or rows >= CHUNK_WORDS or size >= CHUNK_BYTES:
                    chunk, last, rows, size = chunk + 1, kind, 0, 0
                rows, size = rows + 1, size + kind[1]
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("backward"), batch.column("size"), pa.array(out, pa.int64()), batch.column("word"), batch.column("n")], names=["backward", "size", "chunk", "word", "n"])

    return both.select("backward", "size", "word", "n").mapInArrow(cut, _CHUNKS)


class Router:
    """Which chunks a word has to be looked up in, and at which edit positions."""

    def __init__(self, firsts: list[tuple[bool, int, int, str]]):
        self.chunks: dict[tuple[bool, int], tuple[list[str], list[int]]] = {}
        for kind, rows in groupby(sorted(firsts, key=lambda x: (x[0], x[1], x[3])), key=lambda x: (x[0], x[1])):
            rows = list(rows)
            self.chunks[kind] = [r[3] for r in rows], [r[2] for r in rows]

    def overlapped(self, kind: tuple[bool, int], head: str) -> range:
        firsts = self.chunks[kind][0]
        return range(max(bisect_right(firsts, head) - 1, 0), bisect_left(firsts, head + _AFTER))

    def routes(self, word: str) -> Iterator[tuple[bool, int, int, list[int]]]:
        """backward, size, chunk and edit positions, each replacement and each distinct deletion in one order only."""
        n = len(word)
        flip = word[::-1]
        for size in (n, n - 1):
            if (False, size) not in self.chunks:
                continue
            several = max(len(self.chunks[b, size][0]) for b in (False, True)) > 1
            asked = defaultdict(list)
            for i in range(n):
                if size < n and i and word[i] == word[i - 1]:
                    continue  # deleting either of two equal neighbours gives the same word
                backward = 2 * i < n - 1
                if several:
                    there, back = self.overlapped((False, size), word[:i]), self.overlapped((True, size), flip[: n - 1 - i])
                    if len(there) != len(back):
                        backward = len(back) < len(there)
                    for c in back if backward else there:
                        asked[backward, c].append(i)
                else:
                    asked[backward, 0].append(i)
            for (backward, c), positions in asked.items():
                yield backward, size, self.chunks[backward, size][1][c], positions


def near_words(words: DataFrame) -> DataFrame:
    """word, near and near_n: every ordered pair of words that differ by one inserted, deleted or replaced code point.

    words has distinct word (code points up to U+00FF) and n; empty words and an empty table have no pairs.
    """
    words = words.select("word", "n").where("word != ''")
    bound_batches(words.sparkSession)
    index = materialize(chunks_of(words), "chunks")
    key = F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))
    # One row a chunk, so at most the bytes of words over CHUNK_BYTES and a few for each partition and length.
    firsts = [tuple(r) for r in index.groupBy("backward", "size", "chunk").agg(F.min(key)).collect()]
    sent = words.sparkSession.sparkContext.broadcast(firsts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(sent.value)
        for batch in batches:
            rows = [(b, s, c, w, n, p) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True) for b, s, c, p in router.routes(w)]
            if rows:
                kinds = (pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["backward", "size", "chunk", "word", "n", "positions"])

    asked = words.mapInArrow(route, _CHUNKS + ", positions array<int>")
    spark = words.sparkSession
    met = index.withColumn("positions", F.lit(None).cast("array<int>")).unionByName(asked)
    met = met.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", F.col("positions").isNotNull(), F.length("word"))
    return met.mapInArrow(_search, "word string, near string, near_n long")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's words come first, then those that are looked up in it; only the chunk is held."""
    held, words, counts, chunk = None, [], [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("chunk", "backward", "word", "n")]
        lists = batch.column("positions")
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        asked = lists.is_valid().to_numpy(zero_copy_only=False)
        key = [(c, bool(a), len(w)) for c, a, w in zip(columns[0], asked, columns[2], strict=True)]
        edges = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            own, backward, ws, ns = columns[0][a], columns[1][a], columns[2][a:b], columns[3][a:b]
            if own != held:
                held, words, counts, chunk = own, [], [], None
            if not asked[a]:
                words += ws
                counts += ns
                continue
            chunk = chunk or Chunk(words, counts, backward)
            weight = np.cumsum(offsets[a + 1 : b + 1] - offsets[a:b]) // POSITIONS
            for part in np.split(np.arange(b - a), np.flatnonzero(np.diff(weight)) + 1):
                row, found = chunk.near([ws[i] for i in part], [values[offsets[a + i] : offsets[a + i + 1]] for i in part])
                row = part[row]
                out = [(ws[i], chunk.words[j], chunk.counts[j]) for i, j in zip(row.tolist(), found.tolist(), strict=True)]
                if out and len(out[0][0]) > len(out[0][1]):  # what one word loses, the other gains
                    out += [(chunk.words[j], ws[i], ns[i]) for i, j in zip(row.tolist(), found.tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of the distinct words (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is ratio times the
    word's n or more, else null; root is the end of the chain of forms, the word itself without one. An empty table
    gives no rows; columns besides word and n are ignored.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    formed = F.coalesce(-F.col("b.m") >= ratio * F.col("n"), F.lit(False))
    rows = words.join(best, "word", "left").select("word", F.when(formed, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, -F.col("b.m")).alias("form_n"))
    rows = materialize(rows, "forms")
    most = rows.agg(F.max("n")).first()[0] or 1
    up = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps, reach = 1, ratio  # a chain of k forms needs a word of n >= ratio ** k
    while reach * ratio <= most:
        steps, reach = steps + 1, reach * ratio
    covered = 1
    while covered < steps:  # each round doubles the steps that root has gone
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = materialize(up.join(over, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        covered *= 2
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, slip: int | None = SLIP) -> DataFrame:
    """variant_groups of the words of all texts, see count_words for nulls and slips."""
    return variant_groups(count_words(docs, slip))
