"""N-gram Jaccard join with signature trees: all texts whose sets of five-word shingles have a similarity of 0.8 or more.

1. Texts with equal shingle sets fall together in one class (128-bit set hash); one document stands for it.
2. Each class posts its prefix: its n - ceil(0.8 n) + 1 first shingles in an order that puts common ones last. Two
   similar sets share a shingle of their prefixes, so nothing is lost, and only postings that meet another of a size
   and place that may be similar go on.
3. Classes that meet are dealt to buckets of bounded size. In a bucket, a signature tree has the classes as leaves;
   its nodes hold the OR of their token bitmaps, their range of sizes and the most tokens that share bits. A dual
   traversal leaves out pairs of nodes whose greatest possible overlap is too small, or which are one component
   already. The bitmaps, which are small, come first; only for members with a pair that remains are the sets fetched,
   and their pairs compared exactly.
4. A first round over three postings of each class joins dense groups, so that the second round, over all postings,
   skips what is already connected. Groups beyond a bucket's size are cut in runs, whose pairs share a bucket each if
   their sizes allow a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import SIMILAR, bound_batches, distinct_sets, materialize, mix, ragged, shingles, slices, word_hashes, words
from larder.llm.components import components

#: Texts of one task, and of all, from which a shingle counts as common; how many common ones are told apart. Order only: results never depend on these.
COMMON_TASK, COMMON, COMMON_KEPT = 4, 64, 100_000
#: Most members and shingles of a run; a bucket has two runs at most.
RUN_MEMBERS, RUN_SHINGLES = 512, 500_000
#: Children of a tree's node, and postings of a class in the first round.
FANOUT, FIRST = 8, 3
#: Members of a bucket that has no tree.
FEW = 8
#: Shingles of all members of an anchor's buckets, whose bitmaps or sets a task holds at once.
BITMAP_SHINGLES, SET_SHINGLES = 32_000_000, 4_000_000
#: Rows of results that a task hands over at a time.
ROWS = 8192


def text_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, starts = words(texts)
    return distinct_sets(*shingles(word_hashes(flat), starts))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles, of the lowest quarter of hashes, that are in many texts: the COMMON_KEPT most frequent at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        def merge() -> None:
            nonlocal h, n, held, size
            new, k = np.unique(np.concatenate(held), return_counts=True)
            h, at = np.unique(np.concatenate([h, new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, k]), len(h)).astype(np.int64)
            held, size = [], 0

        for batch in slices(batches):
            s, _ = text_sets(batch.column("text"))
            held.append(s[s < np.uint64(1 << 62)])
            size += len(held[-1])
            if size > 2_000_000:
                merge()
        if held:
            merge()
        keep = n >= COMMON_TASK
        yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], names=["h", "n"])

    found = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["h"] for r in found.orderBy(F.desc("n"), "h").limit(COMMON_KEPT).collect()], np.int64).view(np.uint64))


def prefix_sets(docs: DataFrame, common: np.ndarray, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n (size of its set), c1 and c2 (set hash), and of the first text of its set in a task prefix and bits (its bitmap)."""
    sent = docs.sparkSession.sparkContext.broadcast(common)
    a, b = similar

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        late = sent.value
        for batch in slices(batches):
            h, starts = text_sets(batch.column("text"))
            n = np.diff(starts)
            owner = np.repeat(np.arange(len(n)), n)
            with np.errstate(over="ignore"):
                total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(x)), dtype=np.uint64)]) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                c1, c2 = ((t[starts[1:]] - t[starts[:-1]]).view(np.int64) for t in total)
            fresh = np.zeros(len(n), bool)
            for i, key in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
                if n[i] and key not in seen:
                    seen.add(key)
                    fresh[i] = True
            bits = [signature([h[x:y]], width(y - x)).tobytes() if new else None for x, y, new in zip(starts.tolist(), starts[1:].tolist(), fresh.tolist(), strict=False)]
            is_late = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h if len(late) else np.zeros(len(h), bool)
            if is_late.any():
                order = np.lexsort((h, is_late, owner))
                h = h[order]
            rank = np.arange(len(h)) - starts[owner]
            kept = (rank < (n - -(-n * a // b) + 1)[owner]) & fresh[owner]
            edge = np.concatenate([[0], np.cumsum(kept)])[starts]
            lists = ragged(h[kept].view(np.int64), edge, pa.int64())
            lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(~fresh))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(c1), pa.array(c2), lists, pa.array(bits, pa.binary())], names=["doc_id", "n", "c1", "c2", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, n long, c1 long, c2 long, prefix array<long>, bits binary")


def meeting(postings: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The postings (token, n, r and others, not null) whose token another one of a size that may be similar has, too.

    At the first shingle that two sets share, what they share is left in both from there on, so a posting at place r
    reaches partners of a * n <= b * own n - (a + b) * r at most. Partitions are sorted by Spark and streamed, whatever
    a token's rows: a larger partner is there if the next one is in reach, a smaller one if it reaches that far itself.
    """
    a, b = similar
    schema = postings.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met, most = None, False, -1  # the row held back, whether it meets one before it, and the furthest reach of its token so far
        for batch in batches:
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            k, n, r = (batch.column(c).to_numpy() for c in ("token", "n", "r"))
            reach = np.maximum(b * n - (a + b) * r.astype(np.int64), 0)
            reach[0] = max(reach[0], most)
            same = k[1:] == k[:-1]
            base = np.concatenate([[0], np.cumsum(~same)]) << 40
            furthest = np.maximum.accumulate(base + reach) - base
            back, ahead = same & (a * n[1:] <= furthest[:-1]), same & (a * n[1:] <= reach[:-1])
            good = np.concatenate([[met], back]) | np.concatenate([ahead, [False]])
            last, met, most = batch.slice(len(k) - 1), bool(good[-1]), int(furthest[-1])
            if good[:-1].any():
                yield batch.slice(0, len(k) - 1).filter(pa.array(good[:-1]))
        if met:
            yield last

    return postings.repartition("token").sortWithinPartitions("token", "n").mapInArrow(keep, schema)


def runs(postings: DataFrame) -> DataFrame:
    """postings (token, rep, n, comp) with run: numbers of runs of bounded size among a token's rows by ascending n."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, run, members, total = None, 0, 0, 0
        for batch in batches:
            out = []
            for t, n in zip(batch.column("token").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if t != token:
                    token, run, members, total = t, 0, 0, 0
                elif members >= RUN_MEMBERS or total + n > RUN_SHINGLES:
                    run, members, total = run + 1, 0, 0
                members, total = members + 1, total + n
                out.append(run)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "run"])

    rows = postings.select("token", "rep", "n", "comp").repartition("token").sortWithinPartitions("token", "n", "rep")
    return rows.mapInArrow(number, "token long, rep long, n long, comp long, run int")


def buckets(postings: DataFrame, pairs_of_runs: bool, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """anchor, bucket, rep and comp: each run, or each pair of runs of a token that sizes let link, with more than one component.

    Buckets of the same members are one. What is sent to buckets is dealt by anchor, the least member, as the buckets of
    texts that are alike in part mostly share it.
    """
    a, b = similar
    rows = materialize(runs(postings), "runs")
    each = rows.groupBy("token", "run").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y"), F.min("rep").alias("least"))
    pairs = each.select("token", F.col("run").alias("i"), F.col("run").alias("j"), "c0", "c1", "k", "x", "y", "least")
    if pairs_of_runs:
        left, right = each.alias("p"), each.where("run > 0").alias("q")
        on = (F.col("p.token") == F.col("q.token")) & (F.col("p.run") < F.col("q.run")) & (b * F.col("p.high") >= a * F.col("q.low"))
        two = left.join(right, on).select(
            "p.token", F.col("p.run").alias("i"), F.col("q.run").alias("j"), F.least("p.c0", "q.c0").alias("c0"), F.greatest("p.c1", "q.c1").alias("c1"),
            (F.col("p.k") + F.col("q.k")).alias("k"), F.col("p.x").bitwiseXOR(F.col("q.x")).alias("x"), F.col("p.y").bitwiseXOR(F.col("q.y")).alias("y"), F.least("p.least", "q.least").alias("least"),
        )
        pairs = pairs.union(two)
    pairs = pairs.where("c0 != c1").groupBy("k", "x", "y").agg(F.min(F.struct("token", "i", "j", "least")).alias("m"))
    bucket = F.xxhash64("k", "x", "y")
    pairs = pairs.select("m.token", F.col("m.least").alias("anchor"), bucket.alias("bucket"), F.explode(F.array_distinct(F.array("m.i", "m.j"))).alias("run"))
    return rows.join(pairs, ["token", "run"]).select("anchor", "bucket", "rep", "comp")


def together(members: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """members (anchor, bucket, rep, comp) as anchor, rep, comp and buckets, so that what a member brings comes once an anchor.

    An anchor with more than `most` shingles (sizes has n by rep) is several, among which its buckets are dealt, so a
    task holds a bounded part of it.
    """
    sized = members.join(sizes.select("rep", "n"), "rep")
    large = sized.groupBy("anchor").agg(F.sum("n").alias("all")).where(F.col("all") > most)
    part = F.pmod(F.xxhash64("bucket"), F.ceil(F.col("all") / most))
    anchor = F.when(F.col("all").isNull(), F.col("anchor")).otherwise(F.xxhash64("anchor", part))
    rows = members.join(large, "anchor", "left").select(anchor.alias("anchor"), "bucket", "rep", "comp")
    return rows.groupBy("anchor", "rep").agg(F.first("comp").alias("comp"), F.collect_set("bucket").alias("buckets"))


def signature(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """The token bitmaps of sets, a row of 64-bit words each; the first bit is that of the least hashes."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    plane = np.zeros((len(sets), bits), bool)
    plane[owner, (np.concatenate(sets) >> np.uint64(64 - int(np.log2(bits)))).astype(np.int64)] = True
    return np.packbits(plane, axis=1).view(np.uint64)


def width(n: float) -> int:
    """Bits of a bitmap of n tokens: a power of two, four times n or more."""
    return 1 << max(6, int(np.ceil(np.log2(4 * n + 1))))


def halved(bitmap: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many bits, of the same sets."""
    plane = np.unpackbits(bitmap.view(np.uint8), axis=1)
    return np.packbits(plane[:, ::2] | plane[:, 1::2], axis=1).view(np.uint64)


class SignatureTree:
    """Members in the order of their bitmaps, so that alike ones stand together, and the nodes above them."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray):
        n = np.array([len(s) for s in sets], np.int64)
        self.grow(signature(sets, width(np.median(n))), n, labels)

    @classmethod
    def of_bitmaps(cls, bitmap: np.ndarray, n: np.ndarray, labels: np.ndarray) -> SignatureTree:
        tree = cls.__new__(cls)
        tree.grow(bitmap, n, labels)
        return tree

    def grow(self, bitmap: np.ndarray, n: np.ndarray, labels: np.ndarray) -> None:
        excess = n - np.bitwise_count(bitmap).sum(1, dtype=np.int64)
        self.levels = [(bitmap, n, n, excess, labels)]
        while len(self.levels[-1][1]) > 1:
            bitmap, low, high, excess, label = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            first, last = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            mixed = (first != last) | (first < 0)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.where(mixed, -1, first)))

    def possible(self, level: int, x: np.ndarray, y: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
        """Which pairs of nodes may hold a similar pair that is not in one component already."""
        a, b = similar
        bitmap, low, high, excess, label = self.levels[level]
        good = (b * high[x] >= a * low[y]) & (b * high[y] >= a * low[x]) & ((label[x] != label[y]) | (label[x] < 0))
        at = np.flatnonzero(good)
        step = max(1, (1 << 20) // bitmap.shape[1])
        for i in range(0, len(at), step):
            k = at[i : i + step]
            both = np.bitwise_count(bitmap[x[k]] & bitmap[y[k]]).sum(1, dtype=np.int64) + np.minimum(excess[x[k]], excess[y[k]])
            good[k] = (a + b) * both >= a * (low[x[k]] + low[y[k]])
        return good

    def pairs(self, similar: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members x < y that remain, in blocks; depth first, so that few pairs of nodes wait at a time."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, x, y = stack.pop()
            if len(x) > 4096:
                half = len(x) // 2
                stack += [(level, x[half:], y[half:]), (level, x[:half], y[:half])]
                continue
            good = self.possible(level, x, y, similar)
            if level == 0:
                good &= x < y
            x, y = x[good], y[good]
            if not len(x):
                continue
            if level == 0:
                yield x, y
                continue
            size, k = len(self.levels[level - 1][1]), np.arange(FANOUT)
            cx = np.broadcast_to((x[:, None] * FANOUT + k)[:, :, None], (len(x), FANOUT, FANOUT)).ravel()
            cy = np.broadcast_to((y[:, None] * FANOUT + k)[:, None, :], (len(x), FANOUT, FANOUT)).ravel()
            ok = (cx < size) & (cy < size) & (cx <= cy)
            stack.append((level - 1, cx[ok], cy[ok]))


def groups_of_similar(n: np.ndarray, labels: np.ndarray, bitmaps: list[bytes], similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """For each member a number that members share if their bitmaps may connect them; -1 if a member has no such pair.

    Bitmaps differ in width by their sets' sizes. The members of one width meet those of twice the width, whose bitmaps
    are halved; sets further apart in size are never similar.
    """
    a, b = similar
    of = np.arange(len(n))
    touched = np.zeros(len(n), bool)
    size = np.array([len(x) for x in bitmaps])
    for w in np.unique(size).tolist():
        own = np.flatnonzero(size == w)
        larger = np.flatnonzero((size == 2 * w) & (a * n <= b * n[own].max()))
        planes = [np.frombuffer(b"".join(bitmaps[i] for i in own), np.uint64).reshape(len(own), -1)]
        if len(larger):
            planes.append(halved(np.frombuffer(b"".join(bitmaps[i] for i in larger), np.uint64).reshape(len(larger), -1)))
        at, plane = np.concatenate([own, larger]), np.concatenate(planes)
        order = np.lexsort(plane.byteswap().T[::-1])
        at = at[order]
        if len(at) < 2:
            continue
        for x, y in SignatureTree.of_bitmaps(plane[order], n[at], labels[at]).pairs(similar):
            x, y = at[x], at[y]
            fits = (size[x] == w) | (size[y] == w)
            x, y = x[fits], y[fits]
            touched[x] = touched[y] = True
            while len(x):
                low, high = np.minimum(of[x], of[y]), np.maximum(of[x], of[y])
                apart = low != high
                if not apart.any():
                    break
                np.minimum.at(of, high[apart], low[apart])
                while not np.array_equal(of, up := of[of]):
                    of = up
    return np.where(touched, of, -1)


def few_similar(n: list[int], labels: list[int], bitmaps: list[bytes], similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """The pairs of a few members that their bitmaps may link: most buckets hold two or three, for which a tree is far more work."""
    a, b = similar
    planes, out = [int.from_bytes(x) for x in bitmaps], []
    for j in range(1, len(n)):
        for i in range(j):
            if labels[i] == labels[j] or b * n[i] < a * n[j] or b * n[j] < a * n[i]:
                continue
            x, y = planes[i], planes[j]
            if len(bitmaps[i]) != len(bitmaps[j]):
                k = i if len(bitmaps[i]) > len(bitmaps[j]) else j
                half = int.from_bytes(halved(np.frombuffer(bitmaps[k], np.uint64).reshape(1, -1)).tobytes())
                x, y = (half, y) if k == i else (x, half)
            both = (x & y).bit_count() + min(n[i] - x.bit_count(), n[j] - y.bit_count())
            if (a + b) * both >= a * (n[i] + n[j]):
                out.append((i, j))
    return out


def tree_join(reps: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR, apart: set[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Links (member, root) that connect all members with a similar pair; pairs of one label need none.

    apart holds the pairs of sets, by identity, that are known not to be similar, and takes those found so.
    """
    a, b = similar
    apart = set() if apart is None else apart
    names, labels = np.unique(labels, return_inverse=True)
    if len(sets) > FEW:
        order = sorted(range(len(sets)), key=lambda i: (sets[i][:2].tolist(), len(sets[i])))
        reps, labels, sets = reps[order], labels[order], [sets[i] for i in order]
        pairs = SignatureTree(sets, labels).pairs(similar)
    else:
        n = [len(s) for s in sets]
        close = [(i, j) for j in range(len(n)) for i in range(j) if b * n[i] >= a * n[j] and b * n[j] >= a * n[i]]
        pairs = [tuple(np.array(close, np.int64).reshape(-1, 2).T)]
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for xs, ys in pairs:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            p, q = root(labels[x]), root(labels[y])
            pair = (id(sets[x]), id(sets[y])) if id(sets[x]) < id(sets[y]) else (id(sets[y]), id(sets[x]))
            if p == q or pair in apart:
                continue
            k = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if b * k >= a * (len(sets[x]) + len(sets[y]) - k):
                parent[max(p, q)] = min(p, q)
                links.append((int(reps[x]), int(reps[y])))
            else:
                apart.add(pair)
    return links


def grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[list[int]], list[list]]]:
    """Of each anchor, whose rows stand together, its buckets as numbers of members, and the members by column.

    Lists of numbers come as arrays.
    """
    anchor, buckets, held = None, {}, [[] for _ in columns]
    for batch in batches:
        values = [batch.column(c) for c in columns]
        values = [_arrays(v) if pa.types.is_list(v.type) else v.to_pylist() for v in values]
        for key, of, *row in zip(batch.column("anchor").to_pylist(), batch.column("buckets").to_pylist(), *values, strict=True):
            if key != anchor:
                if buckets:
                    yield list(buckets.values()), held
                anchor, buckets, held = key, {}, [[] for _ in columns]
            for bucket in of:
                buckets.setdefault(bucket, []).append(len(held[0]))
            for kept, x in zip(held, row, strict=True):
                kept.append(x)
    if buckets:
        yield list(buckets.values()), held


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    flat, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return [flat[i:j].copy() for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]


def narrowed(members: DataFrame, signatures: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The members of buckets that bitmaps alone don't rule out, in buckets of those that they may connect.

    Bitmaps are a small part of the sets, and few members remain, so few sets are moved after this. Two texts meet under
    many tokens, beside other texts each time; of a bucket of few members each pair is a bucket of its own, which is one
    however often it comes.
    """

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, keys, out = [], [], []

        def ready() -> pa.RecordBatch:
            columns = [np.array(anchors, np.int64), np.array(keys, np.uint64).view(np.int64), *np.array(out, np.int64).reshape(-1, 2).T]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "bucket", "rep", "comp"])

        for buckets, (reps, comps, n, bits) in grouped(batches, ["rep", "comp", "n", "bits"]):
            told: dict[tuple[int, int], bool] = {}  # the pairs of small buckets that were looked at, and whether they remain
            for at in buckets:
                if len(at) <= FEW:
                    new = [(i, j) for k, j in enumerate(at) for i in at[:k] if (i, j) not in told]
                    told.update(dict.fromkeys(new, False))
                    groups = []
                    if new:
                        pairs = few_similar(*([x[i] for i in at] for x in (n, comps, bits)), similar)
                        pairs = set(new) & {(at[i], at[j]) for i, j in pairs}
                        groups = [[(reps[i], comps[i]), (reps[j], comps[j])] for i, j in pairs]
                else:
                    of = groups_of_similar(np.array([n[i] for i in at], np.int64), np.array([comps[i] for i in at], np.int64), [bits[i] for i in at], similar).tolist()
                    whole: dict[int, list[tuple[int, int]]] = {}
                    for k, i in zip(of, at, strict=True):
                        if k >= 0:
                            whole.setdefault(k, []).append((reps[i], comps[i]))
                    groups = list(whole.values())
                for group in groups:
                    group.sort()
                    anchors += [group[0][0]] * len(group)
                    keys += [xxhash.xxh3_64_intdigest(np.array([rep for rep, _ in group], np.int64).tobytes())] * len(group)
                    out += group
                if len(keys) > ROWS:
                    yield ready()
                    anchors, keys, out = [], [], []
        yield ready()

    rows = together(members, signatures, BITMAP_SHINGLES).join(signatures, "rep").select("anchor", "buckets", "rep", "comp", "n", "bits")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(narrow, "anchor long, bucket long, rep long, comp long").distinct()


def joined(members: DataFrame, signatures: DataFrame, docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Links a, b found in buckets."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()

        def ready() -> pa.RecordBatch:
            x, y = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        for buckets, (reps, comps, sets) in grouped(batches, ["rep", "comp", "h"]):
            rep, label, apart = np.array(reps, np.int64), np.array(comps, np.int64), set()
            of = dict(zip(reps, comps, strict=True))
            for at in buckets:
                if len(at) < 2:
                    continue
                for x, y in tree_join(rep[at], label[at], [sets[i] for i in at], similar, apart):
                    found.add((x, y))
                    p, q = sorted((of[x], of[y]))
                    if p != q:  # what is connected now need not be compared in the anchor's other buckets
                        label[label == q] = p
                        of = dict(zip(reps, label.tolist(), strict=True))
            if len(found) > ROWS:
                yield ready()
                found.clear()
        if found:
            yield ready()

    left = materialize(narrowed(materialize(members, "buckets"), signatures, similar).hint("rebalance"), "members")
    rows = together(left, signatures, SET_SHINGLES).join(sets_of(docs, left.select("rep").distinct()), "rep").select("anchor", "buckets", "rep", "comp", "h")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(join, "a long, b long")


def sets_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and h, the ascending shingle hashes of each document named in reps."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, starts = text_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), ragged(h.view(np.int64), starts, pa.int64())], names=["rep", "h"])

    rows = docs.select(F.col("doc_id").alias("rep"), "text").join(reps, "rep")
    return rows.mapInArrow(make, "rep long, h array<long>")


def near_duplicates(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included), one row per row.

    Null and empty texts have no shingles and link with nothing. A row without a doc_id belongs to the component of the
    texts with its shingles, if any has an id. Rows of one doc_id are texts of their own; those that stand for their
    class are one node. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = materialize(prefix_sets(docs, common_shingles(docs), similar), "prefixes")
    classes = rows.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix", ignorenulls=True).alias("prefix"), F.first("bits", ignorenulls=True).alias("bits")).where("rep is not null")
    postings = classes.select("rep", "n", F.posexplode_outer("prefix").alias("r", "token"))
    postings = materialize(meeting(postings.select("token", "rep", "n", "r"), similar).hint("rebalance"), "postings")
    signatures = materialize(classes.select("rep", "n", "bits"), "signatures")
    first = postings.where(F.col("r") < FIRST).withColumn("comp", F.col("rep"))
    links = materialize(joined(buckets(first, False, similar), signatures, docs, similar).hint("rebalance"), "links")
    labels = components(links)
    again = postings.join(labels, postings["rep"] == labels["node"], "left").select("token", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    more = materialize(joined(buckets(again, True, similar), signatures, docs, similar).hint("rebalance"), "more")
    found = components(links.union(more))
    ids = rows.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    named = ids.join(found, ids["rep"] == found["node"], "left").select("c1", "c2", "n", F.coalesce("component", "rep").alias("component"))
    return rows.select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs, of each group of near duplicates only the row with the group's smallest doc_id; all columns stay.

    Rows are told apart by (doc_id, text), so each is judged by its own text, and of rows that are equal in both one
    stays. Rows without a doc_id come after those with one. Null and empty texts are in no group and all stay.
    """
    row = F.xxhash64("doc_id", "text")
    found = near_duplicates(docs.select(row.alias("doc_id"), "text"), similar).where("n_shingles > 0")
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count("*").alias("n")).withColumnRenamed("doc_id", "row")
    members = materialize(found.join(docs.select(row.alias("row"), "doc_id").distinct(), "row"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")
    groups = members.groupBy("component").agg(first, F.sum("n").alias("all")).where(F.col("all") > 1)
    judged = members.join(groups, "component").select(F.col("row").alias("__larder_row"), "n", (F.col("row") == F.col("first.row")).alias("stays"))
    judged = materialize(judged.where("n > 1 OR NOT stays"), "duplicates")
    same = F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__larder_row")
    kept = docs.join(judged.select("__larder_row"), same, "left_anti")
    repeated = docs.join(judged.where("stays").select("__larder_row"), same, "left_semi")
    return kept.union(repeated.dropDuplicates(["doc_id", "text"]))
