"""Substring dedup by compact windows: passages of fifty words and more that repeat, exactly or nearly, across texts.

For each of HASHES hash functions, the Cartesian tree over the hashes of a text's five-word shingles is descended while
its nodes span WIDTH shingles. A node (l, c, r) is a compact window: every run of shingles in l..r that holds c has its
min-hash at c, so the few windows of a text group all its passages by signature. Windows with one signature meet; the
intervals that they share along nearby shifts of two texts are joined, and where enough hash functions agree, the
passages are verified on the shingles themselves.

1. In a group of windows each is tried against the group's first, and against the first of those with the same shingle
   CONTEXT places before, and after, the centre: candidates are linear in the windows however large a group is.
2. Equal passages don't depend on what a group's first holds. A run of WIDTH shingles can only be equal to another if
   its windows of all hash functions have met; of those runs, the ones that no verified pair shows to be equal to a run
   of an earlier text are compared as such, each with the first of its equals.
3. A signature that is frequent within one batch of texts is dealt to many tasks by doc_id; each has a first of its own,
   which is tied to the first of the signature's other windows. So no group goes through one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import SHINGLE, SIMILAR, bound_batches, discard, materialize, mix, partitions, ragged, shingles, slices, word_hashes, words
from larder.llm.components import components

#: Hash functions (four at most), those that must agree, and the least shingles of a passage (of 50 words).
HASHES, AGREE, WIDTH = 4, 2, 50 - SHINGLE + 1
#: Places to either side of a window's centre whose shingles tell a group's windows apart, and the gap between shifts that count as one.
CONTEXT, SHIFT = 10, 16
#: Windows of a batch from which a signature is dealt to many tasks. Ways only: what is found doesn't depend on it.
HOT = 8
#: Extents of windows from this on are kept as the next multiple of it.
REACH = 1 << 14
#: Places beyond the shifts of two texts' windows that a run's like may be away.
LOOSE = 256
#: Requests for parts of texts are widened to multiples of this, so that many of one text are few.
GRAIN = 64
_SEEDS = np.array([0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47], np.uint64)
_ANCHOR = 16


def text_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, starts = words(texts)
    return shingles(word_hashes(flat), starts)


def compact_windows(values: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of the nodes of each run's Cartesian tree (the leftmost least value on top) that span `width` values or more.

    All trees are descended at once, a level at a time.
    """
    bits = max(1, int(len(values)).bit_length())
    low = np.uint64((1 << bits) - 1)
    packed = np.append((values & ~low) | np.arange(len(values), dtype=np.uint64), ~np.uint64(0))
    left, right = starts[:-1], starts[1:] - 1
    out: list[tuple[np.ndarray, ...]] = []
    while True:
        keep = right - left + 1 >= width
        left, right = left[keep], right[keep]
        if not len(left):
            break
        size = right - left + 1
        if 4 * size.sum() < len(values):  # few are left: gather them
            begin = np.cumsum(size) - size
            at = np.repeat(left - begin, size) + np.arange(int(size.sum()))
            least = np.minimum.reduceat(packed[at], begin)
        else:
            least = np.minimum.reduceat(packed, np.column_stack([left, right + 1]).ravel())[::2]
        centre = (least & low).astype(np.int64)
        out.append((left, centre, right))
        left, right = np.column_stack([left, centre + 1]).ravel(), np.column_stack([centre - 1, right]).ravel()
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def packed_place(centre: np.ndarray, j: int, back: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """centre, hash function and extents in one number; an extent of REACH or more is rounded up to a multiple of REACH."""
    small = lambda x: np.where(x < REACH, x, REACH - 1 - (-x // REACH))
    return centre << 34 | j << 30 | small(back) << 15 | small(ahead)


def unpacked_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    large = lambda x: np.where(x < REACH, x, (x - REACH + 1) * REACH)
    return place >> 34, place >> 30 & 15, large(place >> 15 & 32767), large(place & 32767)


def dealt(doc: np.ndarray, key: np.ndarray, contexts: tuple[np.ndarray, ...], ways: int) -> tuple[np.ndarray, np.ndarray]:
    """How rows of one batch are dealt out, and the rows that stand for frequent keys.

    The number holds the task (0 where few documents of the batch have the key), shifted by 8, and for the i-th context
    bits 2i (key and context are frequent) and 2i + 1 (the first such row).
    """
    out = np.zeros(len(key), np.int64)
    hot, first = frequent(key.view(np.uint64), doc)
    if len(hot):
        out[hot] = 1 + (mix(doc[hot].astype(np.uint64)) % np.uint64(ways)).astype(np.int64) << 8
        for i, context in enumerate(contexts):
            both, one = frequent(mix(key[hot].view(np.uint64) ^ mix(context[hot])), doc[hot])
            out[hot[both]] |= 1 << 2 * i
            out[hot[one]] |= 2 << 2 * i
    return out, first


def frequent(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose key HOT documents have, and the first of each such key."""
    _, of, n = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[of] >= HOT)
    _, one = np.unique(mix(key[some] ^ mix(doc[some].astype(np.uint64))), return_index=True)  # a row for each key and document
    names, n = np.unique(key[some[one]], return_counts=True)
    hot = some[np.isin(key[some], names[n >= HOT])]
    _, first = np.unique(key[hot], return_index=True)
    return hot, hot[first]


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, key (hash function and min-hash), place, context and deal of each window, and a row for each anchor of a frequent key."""
    ways = max(8, partitions(docs.sparkSession))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, starts = text_shingles(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for j in range(HASHES):
                with np.errstate(over="ignore"):
                    own = mix(h ^ _SEEDS[j])
                    left, c, right = compact_windows(own, starts, width)
                    if not len(c):
                        continue
                    doc = np.searchsorted(starts, c, "right") - 1
                    begin, end = starts[doc], starts[doc + 1]
                    key = mix(own[c] + np.uint64(j)).view(np.int64)
                    ahead = np.where(c + CONTEXT < end, h[np.minimum(c + CONTEXT, len(h) - 1)], np.uint64(j)) >> np.uint64(32)
                    behind = np.where(c - CONTEXT >= begin, h[np.maximum(c - CONTEXT, 0)], np.uint64(j)) >> np.uint64(32)
                    deal, anchors = dealt(ids[doc], key, (ahead, behind), ways)
                columns = [ids[doc], key, packed_place(c - begin, j, c - left, right - c), (ahead << np.uint64(32) | behind).view(np.int64), deal]
                if len(anchors):
                    columns = [np.concatenate([x, x[anchors]]) for x in columns]
                    columns[-1][len(key) :] = _ANCHOR
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc_id", "key", "place", "context", "deal"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(make, "doc_id long, key long, place long, context long, deal long")


def met_rows(rows: DataFrame, all_rows: bool = True) -> DataFrame:
    """The rows (doc_id, key, place, deal and more) whose key another document has, too, with the first (doc_id, place) of their key and task.

    big tells groups of more than two rows. Partitions are sorted by Spark and streamed; what is held back is no more
    than one document's rows of one key. Keys that are dealt to several tasks have met. Unless all_rows are asked for,
    those that stars doesn't need are left out.
    """
    names = rows.columns
    task = F.shiftright("deal", 8)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, first, sure = None, None, (0, 0), False  # sure: the open group has two documents and three rows

        def kept(batch: pa.RecordBatch, done: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, last, first, sure
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            doc, place, key, deal = (batch.column(c).to_numpy() for c in ("doc_id", "place", "key", "deal"))
            salt = deal >> 8
            begin = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1])
            size = np.diff(np.append(begin, len(key)))
            first_doc, first_place = doc[begin], place[begin]
            goes_on = sure and (key[0], salt[0]) == last
            if goes_on:
                first_doc[0], first_place[0] = first
            more, big = (first_doc != doc[begin + size - 1]) | (salt[begin] > 0), (size > 2) | (salt[begin] > 0)
            more[0] |= goes_on
            big[0] |= goes_on
            sure = bool(more[-1] and big[-1])
            last, first = (key[-1], salt[-1]), (first_doc[-1], first_place[-1])
            wait = not done and not sure
            held = batch.slice(begin[-1]) if wait else None
            if wait:
                more[-1] = False
            each = [np.repeat(x, size) for x in (first_doc, first_place, big)]
            good = np.repeat(more, size)
            if not all_rows:
                good &= (each[0] != doc) | (deal & _ANCHOR != 0) | ((salt > 0) & (each[1] == place))
            at = np.flatnonzero(good)
            if len(at):
                each = [x[at] for x in each]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in names), *map(pa.array, each)], names=[*names, "first_doc", "first_place", "big"])

        for batch in batches:
            if batch.num_rows:
                yield from kept(batch, False)
        if held is not None:
            rest, held = held, None
            yield from kept(rest, True)

    rows = rows.repartition("key", task).sortWithinPartitions("key", task, "doc_id", "place")
    return rows.mapInArrow(meet, ", ".join(f"{c} long" for c in names) + ", first_doc long, first_place long, big boolean")


def stars(met: DataFrame) -> DataFrame:
    """a, b, p, q: each met row q of document b with the first p, of document a, of its key; and the firsts of a key's tasks with the first of the rest."""
    own = met.where("doc_id != first_doc").select(F.col("first_doc").alias("a"), F.col("doc_id").alias("b"), F.col("first_place").alias("p"), F.col("place").alias("q"))
    anchors = met.where(F.col("deal").bitwiseAND(_ANCHOR) != 0).select("key", "first_doc", "first_place").distinct()  # a row for each frequent key
    tasks = met.where((F.col("deal") >= 256) & (F.col("doc_id") == F.col("first_doc")) & (F.col("place") == F.col("first_place"))).select("key", "doc_id", "place").distinct()
    x, y = F.struct(F.col("first_doc").alias("d"), F.col("first_place").alias("p")), F.struct(F.col("doc_id").alias("d"), F.col("place").alias("p"))
    ties = tasks.join(anchors, "key").where("doc_id != first_doc").select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    return own.union(ties.select("x.d", "y.d", "x.p", "y.p"))


def by_context(met: DataFrame) -> DataFrame:
    """The windows of groups of more than two again, with their key and one shingle of their context as key."""
    keys = (F.xxhash64("key", F.shiftright("context", 32)), F.xxhash64("key", F.lit("behind"), F.shiftleft("context", 32)))
    bit = lambda i: F.col("deal").bitwiseAND(1 << i) != 0
    task = F.col("deal").bitwiseAND(F.lit(-256))
    rows = [F.struct(k.alias("key"), F.when(bit(2 * i), task).otherwise(F.lit(0)).alias("deal")) for i, k in enumerate(keys)]
    anchors = [F.when(bit(2 * i + 1), F.struct(k.alias("key"), F.lit(_ANCHOR).cast("long").alias("deal"))) for i, k in enumerate(keys)]
    all_of = F.when(F.col("deal") == 0, F.array(*rows)).otherwise(F.array_compact(F.array(*rows, *anchors)))
    big = met.where(F.col("big") & (F.col("deal").bitwiseAND(_ANCHOR) == 0))
    return big.select("doc_id", "place", F.explode_outer(all_of).alias("x")).select("doc_id", "x.key", "place", "x.deal")


def streamed(rows: DataFrame, keys: list[str], order: list[str], f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f of the rows, in batches that hold all rows of each of their keys; partitions are sorted by Spark and streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                v = batch.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
                change[0] |= bool(held) and held[-1].column(k)[-1].as_py() != v[0]
            at = int(np.flatnonzero(change)[-1]) if change.any() else 0
            if change.any():
                whole = pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks().to_batches()
                held = []
                yield from (x for w in whole if (x := f(w)) is not None)
            held.append(batch.slice(at))
        if held:
            yield from (x for w in pa.Table.from_batches(held).combine_chunks().to_batches() if (x := f(w)) is not None)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def joined_intervals(pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b, a0, a1, b0, b1: the intervals that windows of two texts share along nearby shifts, joined where they overlap and AGREE hash functions are among them.

    Place i of a is at i + b0 - a0 to i + b1 - a1 in b. b0 may be negative, where b begins later than that.
    """

    def join(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        a, b, p, q = (batch.column(c).to_numpy() for c in ("a", "b", "p", "q"))
        (c, j, back, ahead), (d, _, back2, ahead2) = unpacked_place(p), unpacked_place(q)
        begin, end = np.maximum(c - np.minimum(back, back2), 0), c + np.minimum(ahead, ahead2) + 1
        keep = end - begin >= width
        if not keep.any():
            return None
        a, b, begin, end, shift, bit = a[keep], b[keep], begin[keep], end[keep], (d - c)[keep], np.left_shift(1, j[keep])
        pair = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        order = np.lexsort((shift, pair))
        jump = np.concatenate([[False], (np.diff(pair[order]) != 0) | (np.diff(shift[order]) > SHIFT)])
        group = np.empty(len(pair), np.int64)
        group[order] = np.cumsum(jump)
        order = np.lexsort((begin, group))
        group, begin, end, shift = group[order], begin[order], end[order], shift[order]
        top = np.maximum.accumulate(end + (group << 40))
        new = np.flatnonzero(np.concatenate([[True], begin[1:] + (group[1:] << 40) >= top[:-1]]))
        good = np.bitwise_count(np.bitwise_or.reduceat(bit[order], new)) >= AGREE
        a0, a1, s0, s1 = (f.reduceat(x, new)[good] for f, x in ((np.minimum, begin), (np.maximum, end), (np.minimum, shift), (np.maximum, shift)))
        at = order[new][good]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[at], b[at], a0, a1, a0 + s0, a1 + s1)], names=["a", "b", "a0", "a1", "b0", "b1"])

    return streamed(pairs, ["a", "b"], [], join, "a long, b long, a0 long, a1 long, b0 long, b1 long")


def extent(x: Column) -> Column:
    return F.when(x < REACH, x).otherwise((x - (REACH - 1)) * REACH)


def near_passages(met: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b, a0, a1, b0, b1: runs of shingles (ends excluded) of two texts, a before b, on which AGREE hash functions agree."""
    pairs = stars(met).union(stars(materialize(met_rows(by_context(met), all_rows=False), "contexts")))
    side = lambda c, shift: extent(F.shiftright(c, shift).bitwiseAND(32767))
    pairs = pairs.where(F.least(side("p", 15), side("q", 15)) + F.least(side("p", 0), side("q", 0)) + 1 >= width)
    return joined_intervals(pairs, width)


def swept(rows: DataFrame, on: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """id, x0, x1: the stretches of each text where on(m, c) holds, of m intervals of kind 0 and c of kind 1 that cover a place.

    rows has id, x0, x1 and, if there are two kinds, kind. An interval travels as one number of 34 bits for its start
    and the rest for its length, with the kind as the sign.
    """

    def sweep(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, x = (batch.column(c).to_numpy() for c in ("id", "x"))
        kind, x = (x < 0).astype(np.int64), np.abs(x) - 1
        x0, x1 = x >> 29, (x >> 29) + (x & ((1 << 29) - 1))
        text = np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])]) << 40
        at = np.concatenate([text + x0, text + x1])
        order = np.argsort(at, kind="stable")
        step = np.concatenate([np.ones(len(ids), np.int64), -np.ones(len(ids), np.int64)])
        kinds = np.concatenate([kind, kind])
        at = at[order]
        last = np.flatnonzero(np.append(at[1:] != at[:-1], True))
        m, c = (np.cumsum(np.where(kinds == k, step, 0)[order])[last] for k in (0, 1))
        good = on(m, c)
        begin, end = np.flatnonzero(good & ~np.append(False, good[:-1])), np.flatnonzero(~good & np.append(False, good[:-1]))
        if not len(begin):
            return None
        at = at[last]
        own = ids[np.searchsorted(text, at[begin] >> 40 << 40)]
        low = (1 << 40) - 1
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(at[begin] & low), pa.array(at[end] & low)], names=["id", "x0", "x1"])

    x = F.shiftleft(F.col("x0").cast("long"), 29) + F.col("x1") - F.col("x0") + 1
    x = F.when(F.col("kind") == 1, -x).otherwise(x) if "kind" in rows.columns else x
    return streamed(rows.select("id", x.alias("x")), ["id"], [], sweep, "id long, x0 long, x1 long")


def possible_runs(met: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, x0, x1: the places of each text at which a run of width shingles begins whose windows of all hash functions have met."""
    centre, back, ahead = F.shiftright("place", 34), extent(F.shiftright("place", 15).bitwiseAND(32767)), extent(F.col("place").bitwiseAND(32767))
    rows = met.where(F.col("deal").bitwiseAND(_ANCHOR) == 0)
    rows = rows.select(F.col("doc_id").alias("id"), F.greatest(centre - F.least(back, F.lit(width - 1)), F.lit(0)).alias("x0"), (centre + F.least(ahead - (width - 1), F.lit(0)) + 1).alias("x1"))
    return swept(rows.where("x1 > x0"), lambda m, _: m >= HASHES)


def sequences(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """id, p (where the asked parts of its text begin, in shingles), o (where each is in h, and h's length) and h, the shingles of the parts.

    asked has id, x0 and x1; parts that overlap are one.
    """
    wide = asked.select("id", (F.floor(F.col("x0") / GRAIN) * GRAIN).alias("x0"), (F.ceil(F.col("x1") / GRAIN) * GRAIN).alias("x1")).distinct()
    parts = swept(wide, lambda m, _: m > 0).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("parts"))  # one text's, without overlaps

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, starts = text_shingles(batch.column("text"))
            lists = batch.column("parts")
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            x0, x1 = (lists.flatten().field(k).to_numpy() for k in (0, 1))
            owner = np.repeat(np.arange(len(lists)), np.diff(edge))
            x1 = np.minimum(x1, np.diff(starts)[owner])  # another text of the same doc_id may be longer
            keep = x1 > x0
            owner, x0, x1 = owner[keep], x0[keep], x1[keep]
            size = x1 - x0
            total = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(starts[owner] + x0 - total[:-1], size) + np.arange(total[-1])
            edge = np.searchsorted(owner, np.arange(len(lists) + 1))
            ends = total[edge]
            o = [np.append(total[a:b], total[b]) - total[a] for a, b in zip(edge, edge[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), ragged(x0, edge, pa.int64()), ragged(np.concatenate(o), edge + np.arange(len(edge)), pa.int64()), ragged(h[at].view(np.int64), ends, pa.int64()),
            ], names=["id", "p", "o", "h"])

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text").join(parts, "id")
    return texts.mapInArrow(cut, "id long, p array<long>, o array<long>, h array<long>")


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width values, by prefix sums of a polynomial modulo 2^64."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        power, back = (np.concatenate([np.ones(1, np.uint64), np.full(len(h), x, np.uint64)]).cumprod(dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h.view(np.uint64)) * power[:-1], dtype=np.uint64)])
        return mix((total[width:] - total[:-width]) * back[: len(h) - width + 1])


def equal_passages(possible: DataFrame, shown: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b, a0, a1, b0, b1 of equal runs, of those in possible that shown lacks, each with the first document that has it.

    possible and shown have id, x0 and x1, places where runs begin. shown are runs that are known to be equal to one of
    an earlier document. If that one is shown, too, there is a yet earlier one, and so on; so of equal runs those that
    are not shown are all that has to be tied together.
    """
    rows = possible.withColumn("kind", F.lit(0)).union(shown.withColumn("kind", F.lit(1)))
    left = swept(rows, lambda m, c: (m > 0) & (c == 0)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("runs"))  # one text's, without overlaps
    ways = max(8, partitions(texts.sparkSession))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, p, o = batch.column("h"), batch.column("p"), batch.column("o")
            ids = batch.column("id").to_numpy()
            base = h.offsets.to_numpy() - h.offsets[0].as_py()
            g = run_hashes(h.flatten().to_numpy(), width).view(np.int64)
            doc, place, key = [], [], []
            for i, (starts, offsets, runs) in enumerate(zip(p.to_pylist(), o.to_pylist(), batch.column("runs").to_pylist(), strict=True)):
                for r in runs:
                    k = int(np.searchsorted(starts, r["x0"], "right")) - 1
                    stop = min(r["x1"], starts[k] + offsets[k + 1] - offsets[k] - width + 1) if k >= 0 else 0
                    if stop > r["x0"]:
                        at = base[i] + offsets[k] + r["x0"] - starts[k]
                        place.append(np.arange(r["x0"], stop))
                        key.append(g[at : at + stop - r["x0"]])
                        doc.append(np.full(stop - r["x0"], ids[i]))
            if not doc:
                continue
            columns = [np.concatenate(x) for x in (doc, key, place)]
            deal, anchors = dealt(columns[0], columns[1], (), ways)
            columns = [*(np.concatenate([x, x[anchors]]) for x in columns), np.concatenate([deal, np.full(len(anchors), _ANCHOR)])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc_id", "key", "place", "deal"])

    runs = texts.join(left, "id").mapInArrow(make, "doc_id long, key long, place long, deal long")
    pairs = stars(materialize(met_rows(runs, all_rows=False), "runs"))
    spans = pairs.groupBy("a", "b", (F.col("q") - F.col("p")).alias("shift")).agg(F.min("p").alias("a0"), (F.max("p") + width).alias("a1"))
    return spans.select("a", "b", "a0", "a1", (F.col("a0") + F.col("shift")).alias("b0"), (F.col("a1") + F.col("shift")).alias("b1"))


def best_runs(hit: np.ndarray, width: int, similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """Runs of at least width places in which hits make up the asked share, the best first, without overlaps."""
    a, b = similar
    out, todo = [], [(0, len(hit))]
    gain = np.where(hit, b - a, -a)
    while todo:
        x, y = todo.pop()
        if y - x < width:
            continue
        total = np.concatenate([[0], np.cumsum(gain[x:y])])
        floor = np.minimum.accumulate(total[: len(total) - width])  # starts that leave room for width places
        j = int(np.argmax(total[width:] - floor)) + width
        if total[j] < floor[j - width]:
            continue
        i = int(np.flatnonzero(total[: j - width + 1] == floor[j - width])[-1])
        out.append((x + i, x + j))
        todo += [(x, x + i), (x + j, y)]
    return out


def same_length(x: np.ndarray, y: np.ndarray) -> int:
    """How many first values of x and y are the same; ever longer pieces are compared."""
    done, piece, n = 0, 64, min(len(x), len(y))
    while done < n:
        apart = np.flatnonzero(x[done : min(n, done + piece)] != y[done : min(n, done + piece)])
        if len(apart):
            return done + int(apart[0])
        done, piece = done + piece, 4 * piece
    return n


def exact_runs(x: np.ndarray, y: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """s, e, t, u: equal runs x[s:e] and y[t:u] of width places or more; they cover every such run of y that x holds."""
    if min(len(x), len(y)) < width:
        return []
    of_x, of_y = run_hashes(x, width), run_hashes(y, width)
    values, first = np.unique(of_x, return_index=True)
    at = np.minimum(np.searchsorted(values, of_y), len(values) - 1)
    out, t = [], 0
    places = np.flatnonzero(values[at] == of_y)
    while (k := int(np.searchsorted(places, t))) < len(places):
        t = int(places[k])
        s = int(first[at[t]])
        n = same_length(x[s:], y[t:])
        if n >= width:
            out.append((s, s + n, t, t + n))
        t += max(n - width, 0) + 1
    return out


def similar_runs(x: np.ndarray, y: np.ndarray, width: int, similar: tuple[int, int] = SIMILAR, same: list[tuple[int, int, int, int]] | None = None, lag: tuple[int, int] | None = None) -> list[tuple[int, int, int, int, float]]:
    """s, e, t, u and similarity of runs x[s:e] and y[t:u] of width places or more whose sets are similar.

    Runs are sought by the share of places that the other text has. A share of n/d on both sides is a similarity of less,
    so a run that fails is searched again by the share 2n/(n+d), which suffices where places are distinct. Equal runs
    (same, see exact_runs) that then lie in none found are added, so none is lost to the edits around it. lag tells
    how far y's places may be from x's, less LOOSE; then a run's like is sought there only.
    """
    n, d = similar
    low, high = (-len(x), len(y)) if lag is None else (lag[0] - LOOSE, lag[1] + LOOSE)
    found: list[tuple[int, int, int, int, float]] = []

    def seek(s: int, e: int, share: tuple[int, int]) -> None:
        for s0, e0 in best_runs(np.isin(x[s:e], y), width, share):
            own = np.unique(x[s + s0 : s + e0])
            some = False
            first = max(0, s + s0 + low)
            for t, u in best_runs(np.isin(y[first : max(first, s + e0 + high)], own), width, share):
                t, u = t + first, u + first
                other = np.unique(y[t:u])
                k = len(np.intersect1d(own, other, assume_unique=True))
                if d * k >= n * (len(own) + len(other) - k):
                    found.append((s + s0, s + e0, t, u, k / (len(own) + len(other) - k)))
                    some = True
            if not some and share == similar:
                seek(s + s0, s + e0, (2 * n, n + d))

    seek(0, len(x), similar)
    for s, e, t, u in exact_runs(x, y, width) if same is None else same:
        if not any(f[2] <= t and u <= f[3] for f in found):
            found.append((s, e, t, u, 1.0))
    return found


def asked_parts(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.col("a").alias("id"), F.col("a0").alias("x0"), F.col("a1").alias("x1")).union(candidates.select("b", F.greatest("b0", F.lit(0)), "b1"))


_FOUND = "doc_id long, start long, end long, source_id long, source_start long, source_end long, similarity double"


def compared(candidates: DataFrame, texts: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, start, end, source_id, source_start, source_end (words, ends excluded) and similarity of true repeats in candidates.

    Rows with a null similarity are the places (start, end) of doc_id at which runs of width shingles begin that the
    source has as well.
    """

    def cut(x: str, y: str) -> Column:
        begin = F.greatest(F.col(x), F.lit(0))
        part = F.size(F.filter("p", lambda s: s <= begin))  # the part that holds it, from 1
        inside = begin - F.get("p", part - 1)
        size = F.get("o", part) - F.get("o", part - 1)
        got = F.slice("h", (F.get("o", part - 1) + inside + 1).cast("int"), F.greatest(F.least(F.col(y) - begin, size - inside), F.lit(0)).cast("int"))
        return F.coalesce(F.when(inside < size, got), F.array().cast("array<long>"))

    rows = candidates.join(texts, candidates["a"] == texts["id"]).select(*candidates.columns, cut("a0", "a1").alias("x"))
    rows = rows.join(texts, rows["b"] == texts["id"]).select(*candidates.columns, "x", cut("b0", "b1").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 6, pa.float64()]
        names = [x.split(" ")[0] for x in _FOUND.split(", ")]
        for batch in batches:
            lists = {k: (batch.column(k).flatten().to_numpy(), batch.column(k).offsets.to_numpy() - batch.column(k).offsets[0].as_py()) for k in ("x", "y")}
            found: list[tuple] = []
            for i, (a, b, a0, a1, b0, b1) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("a", "b", "a0", "a1", "b0", "b1")), strict=True)):
                lag, b0 = (min(b0, 0), b1 - b0 - (a1 - a0) + min(b0, 0)), max(b0, 0)
                x, y = (v[at[i] : at[i + 1]] for v, at in lists.values())
                if len(x) >= width and np.array_equal(x, y):  # copies
                    found += [(b, b0, b0 + len(y) + SHINGLE - 1, a, a0, a0 + len(x) + SHINGLE - 1, 1.0), (b, b0, b0 + len(y) - width + 1, a, None, None, None)]
                    continue
                same = exact_runs(x, y, width)
                for s, e, t, u, share in similar_runs(x, y, width, similar, same, lag):
                    found.append((b, b0 + t, b0 + u + SHINGLE - 1, a, a0 + s, a0 + e + SHINGLE - 1, share))
                found += [(b, b0 + t, b0 + u - width + 1, a, None, None, None) for _, _, t, u in same]
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(verify, _FOUND)


def verified(candidates: DataFrame, docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The true repeats in candidates, see compared."""
    return compared(candidates, sequences(docs, asked_parts(candidates)), width, similar).where("similarity IS NOT NULL").distinct()


def repeated_passages(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Passages that repeat one of an earlier document (the smaller doc_id), and group_id, the smallest doc_id that repeats reach.

    doc_id, start, end, source_id, source_start, source_end (words, ends excluded), similarity and group_id: one row per
    passage and source. Texts of fewer than fifty words, and null and empty ones, have none; rows without a doc_id take
    no part; rows of one doc_id are one document. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    met = materialize(met_rows(windows(docs, width)), "windows")
    near = materialize(near_passages(met, width), "near")
    possible = materialize(possible_runs(met, width), "possible")
    discard(met)
    asked = asked_parts(near).union(possible.select("id", "x0", F.col("x1") + (width - 1)))
    texts = materialize(sequences(docs, asked), "sequences")
    first = materialize(compared(near, texts, width), "compared")
    shown = first.where("similarity IS NULL").select(F.col("doc_id").alias("id"), F.col("start").alias("x0"), F.col("end").alias("x1"))
    equal = materialize(equal_passages(possible, shown, texts, width), "equal")
    found = materialize(first.union(compared(equal, texts, width)).where("similarity IS NOT NULL").distinct(), "passages")
    discard(near, possible, texts, first, equal)
    groups = components(found.select(F.col("doc_id").alias("a"), F.col("source_id").alias("b")))
    return found.join(groups, found["doc_id"] == groups["node"]).select(*found.columns, F.col("component").alias("group_id"))


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the words of their repeated passages taken out of text; other columns stay, as do texts without any.

    The words that are left of a changed text are joined by single spaces; if none is left the text is empty. Null and
    empty texts stay, as do rows without a doc_id. Passages of one doc_id that overlap or repeat count once, and all
    rows of that doc_id lose them.
    """
    by = Window.partitionBy("doc_id").orderBy("start", "end")
    rows = passages.select("doc_id", "start", "end").distinct()
    rows = rows.withColumn("before", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("k", F.sum(F.when(F.col("start") > F.coalesce("before", F.lit(-1)), 1).otherwise(0)).over(by))
    merged = rows.groupBy("doc_id", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gone = merged.groupBy(F.col("doc_id").alias("__larder_d")).agg(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("end") - 1))).alias("__larder_gone"))  # words of one text
    word = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    stays = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(word).cast("long") - 1), "__larder_gone")
    kept = F.get(F.transform(F.array(word), lambda all_of: F.array_join(F.transform(stays, lambda i: F.get(all_of, i.cast("int"))), " ")), F.lit(0))
    changed = F.col("__larder_gone").isNotNull() & (F.size(word) > 0)
    return docs.join(gone, docs["doc_id"] == F.col("__larder_d"), "left").withColumn("text", F.when(changed, kept).otherwise(F.col("text"))).drop("__larder_d", "__larder_gone")
