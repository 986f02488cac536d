"""Alignment of two tokenizers' tokens of one text, as Spark relations.

Tokens of neither span a space between two words, so a text is aligned if its pieces between such spaces are, and a
piece that comes again is aligned as it was. Runs of documents (groups) therefore keep each distinct piece once, with
how often it comes, and documents as their pieces' numbers.

The tokens of both are exploded with their ends in bytes of the piece, and the two streams meet on (piece, end): where
both have a token's end is a cut, and the running count of cuts numbers the groups of tokens. Every end of either
stream is the end of exactly one overlap of two tokens, that of the tokens which are open there, so the next token of
each stream at or after an end, which a window over the same order carries along, gives all links and no pair twice,
however many tokens a group has.

All of it runs within buckets of whole runs, so neither pieces nor documents move. How often ids are linked corpus-wide is
counted with partial sums, so only distinct pairs of a task move. In the end the documents of a run meet its pieces.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import bound_batches, drop_folder, materialize, ragged, scratch_path, slices

#: Bits of a token's code, and of its number of bytes within; of an id, before which comes the stream's bit and the end.
BITS, LENGTH_BITS, ID_BITS = 31, 11, 20
#: Bytes of text of a run of documents, about; of text for each bucket of a table, and its buckets at most.
RUN_BYTES, BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 4 << 20, 50_000
#: Bits of a piece's number in its run, and of a run's number in its task; pieces that are written at a time.
PIECE_BITS, RUN_BITS, WRITTEN = 28, 16, 1 << 15
#: Pairs of linked ids whose counts are broadcast at most; more are joined.
SENT_PAIRS = 1 << 20
#: Pieces of texts that a worker remembers before it starts again, and with it a run of documents; the share of the most
#: frequent of a run that it keeps for the next. Pieces that are encoded in one text.
REMEMBERED, KEPT, JOINED = 400_000, 4, 256
#: Pieces of documents that are put together at a time.
AT_ONCE = 1 << 19
#: Texts with white space beside a space, at an end, or with the mark that stands for a space in pieces.
ODD = r"[\s\p{Z}\x{85}\x1c-\x1f] | [\s\p{Z}\x{85}\x1c-\x1f]|^[\s\p{Z}]|[\s\p{Z}\x{85}\x1c-\x1f]$|▁"

#: How byte-level vocabularies write bytes: printable ones of Latin-1 as they are, the others from U+0100 on (fixed by the format).
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_level() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(_PLAIN)]
    return {chr(b): b for b in _PLAIN} | {chr(0x100 + i): b for i, b in enumerate(others)}


class TokenPair:
    """A byte-level BPE file (A) and a sentencepiece model (B), with their tokens as bytes.

    A token is known by its code, its id and its number of bytes in BITS bits.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        vocabulary, to_byte, special = self.a.get_vocab(with_added_tokens=True), _byte_level(), self.a.get_added_tokens_decoder()
        names = {i: w for w, i in vocabulary.items()}
        self.spell_a = [b"" if i in special else bytes(to_byte[c] for c in names.get(i, "")) for i in range(1 + max(names))]
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.spell_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.code_a, self.code_b = (np.array([i << LENGTH_BITS | len(w) for i, w in enumerate(x)], np.int32) for x in (self.spell_a, self.spell_b))
        if max(map(len, self.spell_a + self.spell_b)) >= 1 << LENGTH_BITS or max(map(len, (self.spell_a, self.spell_b))) > 1 << (BITS - LENGTH_BITS):
            raise ValueError("a token or a vocabulary is too long for its code")
        self.forget()

    def forget(self, times: np.ndarray = np.zeros(0, np.int64)) -> None:  # noqa: B008
        """Start again, with the most frequent of the pieces that came more than once (times by number)."""
        kept = np.argsort(-times, kind="stable")[: REMEMBERED // KEPT]
        kept = kept[times[kept] > 1]
        if not len(kept):
            self.known: dict[str, int] = {}
            self.fits, self.a_codes, self.b_codes = np.zeros(0, bool), np.zeros(0, np.int32), np.zeros(0, np.int32)
            self.a_starts = self.b_starts = np.zeros(1, np.int64)
            return
        names = list(self.known)
        self.known, self.fits = {names[i]: k for k, i in enumerate(kept.tolist())}, self.fits[kept]
        each = np.arange(len(kept) + 1)
        self.a_codes, self.a_starts = _gather(self.a_codes, self.a_starts, kept, each)
        self.b_codes, self.b_starts = _gather(self.b_codes, self.b_starts, kept, each)

    def learn(self, pieces: list[str], whole: list[str]) -> None:
        """Encode pieces and whole texts, a space before each, and remember their codes and whether both tokenizers spell them.

        Pieces are encoded many in one text, as no token spans the spaces between them. Where a text is not spelled so,
        its parts are encoded again, down to single pieces.
        """
        todo = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)] + [[w] for w in whole]
        while todo:
            part, todo, again = todo[:100], todo[100:], []
            texts = [" ".join(x) for x in part]
            ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
            ids_b = self.b.encode(texts, num_threads=1)
            made = []
            for names, text, *ids in zip(part, texts, ids_a, ids_b, strict=True):
                raw = (" " + text).encode()
                fits = all(b"".join(map(spell.__getitem__, x)) == raw for spell, x in zip((self.spell_a, self.spell_b), ids, strict=True))
                codes = [code[x] for code, x in zip((self.code_a, self.code_b), ids, strict=True)]
                if len(names) == 1:
                    made.append((names, [fits], *((c, [len(c)]) for c in codes)))
                    continue
                ends = np.cumsum([1 + len(w) for w in map(str.encode, names)])
                cuts = []
                for c in codes if fits else ():
                    size = c & ((1 << LENGTH_BITS) - 1)
                    total = np.cumsum(size)
                    at = np.searchsorted(total, ends)
                    if size.min() and np.array_equal(total[at], ends):
                        cuts.append(np.diff(at + 1, prepend=0))
                if len(cuts) == 2:
                    made.append((names, [True] * len(names), *zip(codes, cuts, strict=True)))
                else:
                    step = -(-len(names) // 8)
                    again += [names[i : i + step] for i in range(0, len(names), step)]
            todo = again + todo
            if made:
                names, fits, a, b = zip(*made, strict=True)
                self.known.update(zip(chain.from_iterable(names), range(len(self.known), len(self.known) + sum(map(len, names))), strict=True))
                self.fits = np.concatenate([self.fits, np.array(list(chain.from_iterable(fits)), bool)])
                self.a_codes, self.a_starts = self._more(self.a_codes, self.a_starts, a)
                self.b_codes, self.b_starts = self._more(self.b_codes, self.b_starts, b)

    @staticmethod
    def _more(codes: np.ndarray, starts: np.ndarray, made: tuple[tuple[np.ndarray, np.ndarray], ...]) -> tuple[np.ndarray, np.ndarray]:
        more, each = zip(*made, strict=True)
        return np.concatenate([codes, *more]).astype(np.int32, copy=False), np.concatenate([starts, starts[-1] + np.cumsum(np.concatenate(each))])

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pieces of all texts in a row, and where each text's begin; none unless both spell the text.

        Tokens of either never span a space between two characters other than white space, so what is between such
        spaces is encoded once and remembered; other texts are encoded whole.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, ODD)
        cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        flat, starts = cut.flatten(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_pylist()
        whole = texts.filter(odd).to_pylist()
        missing = [w for w in names if w not in self.known]
        self.learn([w for w in missing if w], [w for w in dict.fromkeys(["", *whole]) if w not in self.known])
        of_name = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        pieces = of_name[coded.indices.to_numpy()]
        pieces[starts[:-1][odd.to_numpy(zero_copy_only=False)]] = np.fromiter(map(self.known.__getitem__, whole), np.int64, len(whole))
        misfits = np.concatenate([[0], np.cumsum(~self.fits[pieces])])
        empty = (pc.binary_length(texts).to_numpy() == 0) | (misfits[starts[1:]] > misfits[starts[:-1]])
        taken = ~np.repeat(empty, np.diff(starts))
        return pieces[taken].astype(np.int32), np.concatenate([[0], np.cumsum(np.diff(starts) * ~empty)])

    def codes(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of both streams the end, stream and id of each token of the pieces with these numbers, and where each piece's begin, latest first as they are sorted."""
        made = []
        for stream, codes, at in ((0, self.a_codes, self.a_starts), (1, self.b_codes, self.b_starts)):
            codes, starts = _gather(codes, at, pieces, np.arange(len(pieces) + 1))
            total = np.concatenate([[0], np.cumsum(codes & ((1 << LENGTH_BITS) - 1), dtype=np.int64)])
            owner = np.repeat(np.arange(len(pieces)), np.diff(starts))
            made.append((owner, (total[1:] - total[starts[owner]]) << (ID_BITS + 1) | stream << ID_BITS | codes >> LENGTH_BITS))
        owner, codes = (np.concatenate(x) for x in zip(*made, strict=True))
        starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(pieces)))])
        bits = int(codes.max(initial=0)).bit_length()
        if bits + len(pieces).bit_length() < 63:  # both in one number, which sorts faster
            least = (1 << bits) - 1
            return least - (np.sort(owner << bits | least - codes) & least), starts
        return codes[np.lexsort((-codes, owner))], starts


def _gather(codes: np.ndarray, at: np.ndarray, pieces: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of pieces one after the other, and where those of each text begin."""
    each = at[pieces + 1] - at[pieces]
    ends = np.concatenate([[0], np.cumsum(each)])
    return codes[np.repeat(at[pieces] - ends[:-1], each) + np.arange(ends[-1])], ends[starts]


@cache
def worker_pair(path_a: str, path_b: str) -> TokenPair:
    """The tokenizers of this Python process, which Spark uses for many tasks."""
    return TokenPair(path_a, path_b)


def token_table(docs: DataFrame, path_a: str, path_b: str) -> str:
    """Write the documents and the pieces of docs (doc_id, text) as a table; returns its name.

    A row of docs is run, doc_id and pieces, the numbers of its pieces. A piece has run, row (run and number), times (in
    the documents of its run) and codes, the ends and ids of its tokens. The table is bucketed by run, so that neither
    need move. Its folders what=documents and what=pieces hold the two.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, run = worker_pair(path_a, path_b), TaskContext.get().partitionId() << RUN_BITS
        seen, times = 0, np.zeros(0, np.int64)

        def end() -> Iterator[pa.RecordBatch]:
            met = np.flatnonzero(times)
            for i in range(0, len(met), WRITTEN):
                part = met[i : i + WRITTEN]
                nothing = [pa.nulls(len(part), t) for t in (pa.int64(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), run)), pa.array((run << PIECE_BITS) + part), pa.array(times[part]), ragged(*pair.codes(part), pa.int64()), *nothing, pa.array(["pieces"] * len(part))], schema=_TABLE)

        for batch in slices(batches):
            if seen > RUN_BYTES or len(pair.known) > REMEMBERED:
                yield from end()
                if len(pair.known) > REMEMBERED:
                    pair.forget(times)
                run, seen, times = run + 1, 0, np.zeros(0, np.int64)
            pieces, starts = pair.pieces(batch.column("text"))
            new = np.bincount(pieces, minlength=len(pair.known))
            new[: len(times)] += times
            times, seen = new, seen + batch.column("text").nbytes
            n = len(batch)
            nothing = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, run)), *nothing, batch.column("doc_id"), ragged(pieces, starts, pa.int32()), pa.array(["documents"] * n)], schema=_TABLE)
        yield from end()

    name = f"larder_tokens_{uuid.uuid4().hex}"
    coded = docs.select("doc_id", "text").mapInArrow(encode, "run long, row long, times long, codes array<long>, doc_id long, pieces array<int>, what string")
    coded.write.partitionBy("what").bucketBy(int(min(size // BUCKET_BYTES + 1, MOST_BUCKETS)), "run").option("path", scratch_path(spark, name)).option("compression", "zstd").saveAsTable(name)
    return name


def _buckets(spark: SparkSession, name: str) -> int:
    """The number of buckets of a table."""
    return int(spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])


_TABLE = pa.schema([("run", pa.int64()), ("row", pa.int64()), ("times", pa.int64()), ("codes", pa.list_(pa.int64())), ("doc_id", pa.int64()), ("pieces", pa.list_(pa.int32())), ("what", pa.string())])


def aligned_tokens(tokens: DataFrame) -> DataFrame:
    """One row for each link of the pieces of a token_table.

    run and row name the piece. code begins with the link's end in bytes, a and b are the ids, kind is 0 if A's token alone
    ends there, 1 if B's, 2 at a cut; later is the number of cuts at or after it, the same for all links of a group. Rows
    come by piece, the latest link first.
    """
    ends = tokens.where("what = 'pieces'").select("run", "row", "times", F.explode("codes").alias("code"))
    by = Window.partitionBy("row", "run").orderBy(F.col("code").desc())
    back = by.rowsBetween(Window.unboundedPreceding, 0)
    of_b, end = F.col("code").bitwiseAND(1 << ID_BITS) != 0, lambda c: F.shiftright(c, ID_BITS + 1)
    open_ = lambda whose: F.last(F.when(whose, F.col("code")), ignorenulls=True).over(back)
    met = ends.select("run", "row", "times", "code", of_b.alias("of_b"), open_(~of_b).alias("a"), open_(of_b).alias("b"), F.lead("code").over(by).alias("next"))
    met = met.where(F.col("next").isNull() | (end("next") != end("code")))  # of two tokens that end at a cut, the second knows both
    kind = F.when(end("a") == end("b"), 2).when(F.col("of_b"), 1).otherwise(0)
    id_ = lambda c: F.col(c).bitwiseAND((1 << ID_BITS) - 1).cast("int")
    links = met.select("run", "row", "times", "code", id_("a").alias("a"), id_("b").alias("b"), kind.cast("byte").alias("kind"))
    return links.withColumn("later", F.sum((F.col("kind") == 2).cast("int")).over(back))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_SUMS = pa.schema([("run", pa.int64()), ("numbers", pa.list_(pa.int32())), *((n, pa.list_(pa.int32())) for n in _COUNTS), ("times", pa.list_(pa.int64())), *((n, pa.list_(pa.int32())) for n in "ab"), ("groups", pa.string())])
_DIGEST = "run long, numbers array<int>, " + ", ".join(f"{n} array<int>" for n in _COUNTS) + ", times array<long>, a array<int>, b array<int>, groups string"


def _give_up_tokenizers() -> None:
    """Once all is encoded, no task needs the tokenizers and the pieces that this worker remembers."""
    worker_pair.cache_clear()
    pa.default_memory_pool().release_unused()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links come in descending order of finish, piece by piece; a piece's last may come in a later batch."""
    _give_up_tokenizers()
    carried: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        row = batch.column("row").to_numpy() if batch else None
        if batch and carried and row[0] == row[-1] == carried[0].column("row")[0].as_py():
            carried.append(batch)
            continue
        keep = int(np.searchsorted(np.cumsum(row[::-1] != row[-1]), 1)) if batch else 0  # rows of the batch's last piece
        ready = [*carried, batch.slice(0, len(row) - keep)] if batch else carried
        carried = [batch.slice(len(row) - keep)] if batch else []
        if sum(map(len, ready)):
            yield _pieces(pa.Table.from_batches(ready))


def _joined(texts: pa.Array, starts: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), texts), by)


def _pieces(links: pa.Table) -> pa.RecordBatch:
    """A row for the pieces of a run: their numbers, counts and groups as lines, "a1,a2|b1;a3|b2,b3", and all their links.

    times is that of each link. Lists take a third of the bytes of a row for each piece. Every piece ends in a cut.
    """
    row, times, a, b, kind = (links.column(c).to_numpy()[::-1] for c in ("row", "times", "a", "b", "kind"))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]])
    before = lambda x: np.concatenate([[0], np.cumsum(x)])
    ends_a, ends_b, cuts = kind != 1, kind != 0, kind == 2
    a_before, b_before, cuts_before = before(ends_a), before(ends_b), before(cuts)
    at = np.concatenate([[0], np.flatnonzero(cuts) + 1])
    texts = [_joined(pa.array(ids[ends]).cast(pa.string()), n[at], ",") for ids, ends, n in ((a, ends_a, a_before), (b, ends_b, b_before))]
    groups = _joined(pc.binary_join_element_wise(*texts, "|"), cuts_before[edges], ";")
    run = row[edges[:-1]] >> PIECE_BITS
    of = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(run)]])  # where each run's pieces begin, and its links
    number = (row[edges[:-1]] & ((1 << PIECE_BITS) - 1)).astype(np.int32)
    counts = [ragged(np.diff(n[edges]).astype(np.int32), of, pa.int32()) for n in (a_before, b_before, cuts_before)]
    counts.append(ragged(np.diff(edges).astype(np.int32), of, pa.int32()))
    linked = [ragged(x, edges[of], kind) for x, kind in ((times, pa.int64()), (a, pa.int32()), (b, pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array(run[of[:-1]]), ragged(number, of, pa.int32()), *counts, *linked, _joined(groups, of, "\n")], schema=_SUMS)


def _pair(a: pa.Array, b: pa.Array) -> np.ndarray:
    return pc.list_flatten(a).to_numpy().astype(np.int64) << 32 | pc.list_flatten(b).to_numpy()


def _scored(whole: DataFrame, sent_pairs: int) -> tuple[DataFrame, list[np.ndarray] | None]:
    """whole and all linked pairs in order with their counts and whether these are best; or whole with those as lists."""
    spark = whole.sparkSession
    links = whole.select(F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("p.a", "p.b", "p.times")
    counts = materialize(links.groupBy("a", "b").agg(F.sum("times").alias("count")), "counts")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    known = counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    if counts.count() <= sent_pairs:
        pairs = known.select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b")).alias("pair"), "count", "best").toArrow().sort_by("pair")
        return whole, [pairs[c].to_numpy() for c in ("pair", "count", "best")]
    # the pairs of each row once, with their counts, meet the row again: no pair is so frequent that its rows are many links
    named = whole.withColumn("chunk", F.xxhash64("run", F.element_at("numbers", 1)))
    own = named.select("chunk", F.explode(F.array_distinct(F.arrays_zip("a", "b"))).alias("p")).select("chunk", "p.a", "p.b")
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b"))
    sums = own.join(known, ["a", "b"]).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(pair.alias("pair"), "count", "best"))).alias("k"))
    return named.join(sums, "chunk").select(*whole.columns, *(F.col(f"k.{c}").alias(f"of_{c}") for c in ("pair", "count", "best"))), None


def _put_together(docs: pa.Table, pieces: pa.Table, sent: list[np.ndarray] | None) -> pa.Table:
    """The documents of a run from their pieces. Counts of pairs were sent, or come beside the pieces of each row."""
    _give_up_tokenizers()
    scores = []
    for piece in pieces.to_batches() if len(pieces) else ():
        for i in range(len(piece)):
            row = piece.slice(i, 1)
            pair, count, best = sent or [pc.list_flatten(row[f"of_{c}"]).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")]
            at = np.searchsorted(pair, _pair(row["a"], row["b"]))
            edges = np.concatenate([[0], np.cumsum(pc.list_flatten(row["n_links"]).to_numpy())])
            scores.append([np.diff(np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[edges]) for x in (best, count)])
    score = dict(zip(("n_best", "count_sum"), (np.concatenate(x) for x in zip(*scores, strict=True)), strict=True)) if scores else dict.fromkeys(("n_best", "count_sum"), np.zeros(0, np.int64))
    number = pc.list_flatten(pieces["numbers"]).to_numpy()
    place = np.zeros(number.max(initial=-1) + 1, np.int32)
    place[number] = np.arange(len(number))
    of_piece = {n: score[n] if n in score else pc.list_flatten(pieces[n]).to_numpy() for n in (*_COUNTS, "n_best", "count_sum")}
    groups = pc.list_flatten(pc.split_pattern(pieces["groups"], "\n")).combine_chunks().cast(pa.large_string())
    made = [_some_together(part, place, of_piece, groups) for part in _parts(docs)]
    return pa.concat_tables(made)


def _parts(docs: pa.Table) -> Iterator[pa.Table]:
    """docs in slices of about AT_ONCE pieces, one at least."""
    cell = np.cumsum(pc.list_value_length(docs["pieces"]).to_numpy(), dtype=np.int64) // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(docs)]
    return (docs.slice(i, j - i) for i, j in pairwise(edges))


def _some_together(docs: pa.Table, place: np.ndarray, of_piece: dict[str, np.ndarray], groups: pa.Array) -> pa.Table:
    counts = pc.list_value_length(docs["pieces"]).to_numpy()
    starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    at = place[pc.list_flatten(docs["pieces"]).to_numpy()]
    sums = {}
    for name, own in of_piece.items():
        total = np.concatenate([[0], np.cumsum(own[at], dtype=np.int64)])
        sums[name] = pa.array(total[starts[1:]] - total[starts[:-1]])
    texts = groups.take(pa.array(at))
    if texts.nbytes < 1 << 31:
        lines = (x.as_buffer() for x in _joined(texts.cast(pa.string()), starts, ";"))
    else:  # one document of this size
        lines = (";".join(texts[i:j].to_pylist()).encode() for i, j in pairwise(starts.tolist()))
    digests = [hashlib.sha256(line).hexdigest() if n else "" for line, n in zip(lines, counts.tolist(), strict=True)]
    return pa.table({"doc_id": docs["doc_id"], **sums, "groups_sha256": pa.array(digests, pa.string())})


def align_documents(docs: DataFrame, path_a: str, path_b: str, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text).

    Texts that are null or empty, or that either tokenizer doesn't spell again, have zeros and ''. Repeated rows count
    each. An empty table gives no rows; columns besides doc_id and text are ignored. With more than sent_pairs distinct
    linked pairs of ids, their counts are joined by pair and part of the pieces instead of broadcast.
    """
    spark = docs.sparkSession
    name = token_table(docs, path_a, path_b)
    table = spark.table(name)
    links = aligned_tokens(table).sortWithinPartitions("row", "run", F.col("code").desc())
    aligned = f"{name}_aligned"
    made = links.select("row", "times", "a", "b", "kind").mapInArrow(_digest, _DIGEST)
    made.write.bucketBy(_buckets(spark, name), "run").option("path", scratch_path(spark, aligned)).option("compression", "zstd").saveAsTable(aligned)
    drop_folder(spark, name, "what=pieces")
    pieces, pairs = _scored(spark.table(aligned), sent_pairs)
    pieces, sent = pieces.drop("times"), spark.sparkContext.broadcast(pairs)
    rows = table.where("what = 'documents'").select("run", "doc_id", "pieces")
    put = rows.groupBy("run").cogroup(pieces.groupBy("run")).applyInArrow(lambda d, p: _put_together(d, p, sent.value), "doc_id long, " + ", ".join(f"{n} long" for n in (*_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string")
    return put.select("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")
