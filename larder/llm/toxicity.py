"""Toxicity by a chain of linear classifiers over hashed words and word beginnings.

The categories are predicted one after the other. Each link is a logistic model over a text's words and the
probabilities of the links before it; those it is trained with are out-of-fold, so a link sees its predecessors as they
will be on new texts. A word counts by itself and by its first characters (PREFIXES), so a stem is known in inflections
that the sample lacks. Training takes a bounded sample of labelled rows (TRAINING of them, the smallest by a hash of
doc_id) and runs as one group per fold; scoring is a map over all texts with the weights broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bound_batches, discard, materialize, mix, slices, word_hashes, words
from larder.llm.tokens import worker_encoder

#: Most labelled rows to train with, folds, hashed dimensions, texts of the sample that must have a word, passes, and weight decay.
TRAINING, FOLDS, BITS, LEAST, PASSES, DECAY = 8_000, 3, 18, 5, 150, 1e-4
#: Lengths of the beginnings of longer words that are features besides the words.
PREFIXES = (4, 5)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word beginnings of each text with log counts scaled to the text's length, and where each text's begin."""
    flat, starts = words(texts)
    counts = np.diff(starts)
    coded = flat.dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy()
    length = pc.utf8_length(names).to_numpy()
    with np.errstate(over="ignore"):
        begins = [mix(word_hashes(pc.utf8_slice_codeunits(names, 0, n)) + np.uint64(n)) for n in PREFIXES]
    table = (np.column_stack([word_hashes(names), *begins]) >> np.uint64(64 - bits)).astype(np.int64)
    there = np.column_stack([np.ones(len(names), bool), *(length > n for n in PREFIXES)])
    owner = np.repeat(np.arange(len(counts)), counts)
    key, n = np.unique((owner[:, None] << bits | table[codes])[there[codes]], return_counts=True)
    owner = key >> bits
    edge = np.searchsorted(owner, np.arange(len(counts) + 1))
    value = np.log1p(n) / np.sqrt(np.maximum(counts, 1.0))[owner] * 10
    return key & ((1 << bits) - 1), value, edge


def scores(index: np.ndarray, value: np.ndarray, edge: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(value * weights[index])])
    return total[edge[1:]] - total[edge[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(index: np.ndarray, value: np.ndarray, edge: np.ndarray, earlier: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Weights of a logistic model: one per hashed word, then the earlier links', then the constant. Classes weigh the same."""
    own, extra, n = 1 << bits, earlier.shape[1], len(y)
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(edge))
    used = np.bincount(index, minlength=own) >= LEAST
    value = value.astype(np.float32, copy=False)
    if not (keep := used[index]).all():
        rows, value, index = rows[keep], value[keep], index[keep]
    # Words that are used are numbered anew, and their places also put in the order of words, so both sums run along memory.
    # Arrays of all words are few at a time: they are most of a worker's memory.
    number = (np.cumsum(used) - 1).astype(np.int32)[index]
    size = int(used.sum())
    starts = np.concatenate([[0], np.bincount(number, minlength=size).cumsum()[:-1]]) if size else np.zeros(0, np.int64)
    by_row = np.searchsorted(rows, np.arange(n, dtype=np.int32))
    full = np.flatnonzero(np.diff(by_row, append=len(rows)))
    del keep, index
    by_word = np.argsort(number, kind="stable")
    rows = rows_of = rows[by_word]
    value_of = value[by_word]
    del rows, by_word
    each = np.empty(len(value), np.float32)  # one buffer for the products of all passes
    positive = max(y.sum(), 1)
    weight = np.where(y > 0, n / (2 * positive), n / (2 * max(n - positive, 1))) / n
    w = np.zeros(size + extra + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, PASSES + 1):
        total = earlier @ w[size:-1] + w[-1]
        if size:
            np.multiply(value, np.take(w[:size].astype(np.float32), number, out=each, mode="clip"), out=each)
            total[full] += np.add.reduceat(each, by_row[full])
        error = weight * (sigmoid(total) - y)
        if size:
            np.multiply(value_of, np.take(error.astype(np.float32), rows_of, out=each, mode="clip"), out=each)
        words_of = np.add.reduceat(each, starts) if size else np.zeros(0)
        g = np.concatenate([words_of, earlier.T @ error, [error.sum()]]) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    out = np.zeros(own + extra + 1)
    out[:own][used], out[own:] = w[:size], w[size:]
    return out


def give_up_kept() -> None:
    """Free what a worker keeps from a stage of tokenizing, which shares it with training in a pipeline."""
    worker_encoder.cache_clear()
    pa.default_memory_pool().release_unused()


def word_batches(part: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
    """Words, values and edges of part's rows, a batch after the other and not copied, and which rows these are."""
    at = 0
    for i, v in zip(part["index"].chunks, part["value"].chunks, strict=True):
        edge = i.offsets.to_numpy().astype(np.int64)
        yield i.flatten().to_numpy(), v.flatten().to_numpy(), edge - edge[0], slice(at, at + len(i))
        at += len(i)


def training_words(part: pa.Table, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, values and edges of the rows that are mine, copied once, without the words that too few of them have for fit."""
    texts = np.zeros(1 << BITS, np.int64)
    for index, _, edge, rows in word_batches(part):
        texts += np.bincount(index[np.repeat(mine[rows], np.diff(edge))], minlength=len(texts))
    used = texts >= LEAST
    n, at = int(texts[used].sum()), 0
    index, value, counts = np.empty(n, np.int32), np.empty(n, np.float32), []
    for i, v, edge, rows in word_batches(part):
        keep = np.repeat(mine[rows], np.diff(edge)) & used[i]
        to = at + int(keep.sum())
        index[at:to], value[at:to], at = i[keep], v[keep], to
        kept = np.concatenate([[0], np.cumsum(keep)])
        counts.append((kept[edge[1:]] - kept[edge[:-1]])[mine[rows]])
    return index, value, np.concatenate([[0], *counts]).cumsum()


def link_trainer(category: str, columns: list[str]):
    """Train one link on the rows outside fold `model` and predict those inside; model FOLDS trains on all and gives its weights."""

    def train(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        give_up_kept()
        y, fold = part[f"y_{category}"].to_numpy(), part["fold"].to_numpy()
        before = np.column_stack([part[c].to_numpy() for c in columns]) if columns else np.zeros((len(y), 0))
        model = key[0].as_py()
        mine = fold != model
        w = fit(*training_words(part, mine), before[mine], y[mine])
        if model == FOLDS:
            return pa.table({"doc_id": pa.array([None], pa.int64()), "p": pa.array([None], pa.float64()), "w": [w.astype(np.float32).tobytes()]})
        own = 1 << BITS
        total = np.concatenate([scores(index, value, edge, w) for index, value, edge, _ in word_batches(part)])
        p = sigmoid(total + before @ w[own:-1] + w[-1])[~mine]
        return pa.table({"doc_id": part["doc_id"].filter(pa.array(~mine)), "p": pa.array(p), "w": pa.array([None] * len(p), pa.binary())})

    return train


def train_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], training: int = TRAINING) -> list[np.ndarray]:
    """One weight vector per category.

    Rows without a doc_id, or with a null in any category, are not trained with; of a doc_id's repeated labels the
    largest counts, of its repeated rows in docs the text with the least hash, so `training` bounds the sample's rows.
    Without labelled rows all weights are zero.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(F.col(c).cast("double")).alias(f"y_{c}") for c in categories)).dropna()
    order = F.xxhash64(F.lit("training"), "doc_id")
    chosen = materialize(known.orderBy(order, "doc_id").limit(training), "chosen")
    sample = docs.select("doc_id", "text").join(chosen, "doc_id")
    truth = [f"y_{c}" for c in categories]
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *(F.first(c).alias(c) for c in truth))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_kept()
        for batch in slices(batches):
            index, value, edge = features(batch.column("text"))
            at = pa.array(edge, pa.int32())
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(at, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32)))], names=[*keep, "index", "value"])

    columns = ", ".join(f"{c} double" for c in truth)
    rows = materialize(sample.mapInArrow(hashed, f"doc_id long, {columns}, index array<int>, value array<float>"), "sample")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    out: list[np.ndarray] = []
    earlier: list[str] = []
    for k, category in enumerate(categories):
        last = k == len(categories) - 1
        models = [FOLDS] if last else [*range(FOLDS), FOLDS]  # FOLDS itself: all rows of the bounded sample
        made = rows.withColumn("model", F.explode(F.array(*map(F.lit, models)))).groupBy("model").applyInArrow(link_trainer(category, list(earlier)), "doc_id long, p double, w binary")
        made = materialize(made, f"link-{k}")
        got = made.where("w is not null").select("w").first()
        out.append(np.frombuffer(got["w"], np.float32) if got else np.zeros((1 << BITS) + len(earlier) + 1, np.float32))
        if not last:
            earlier.append(f"p_{category}")
            held = made.where("w is null").groupBy("doc_id").agg(F.avg("p").alias(earlier[-1]))
            rows = materialize(rows.join(held, "doc_id"), f"sample-{k}")
    return out


def score_texts(docs: DataFrame, chain: Sequence[np.ndarray], categories: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """docs with p_<category> for each category and rejected (the last category's probability is over threshold).

    Null and empty texts have no words and get the models' constants; they are never rejected. All columns stay, but
    for ones of the added names.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(list(chain))
    new = [*(f"p_{c}" for c in categories), "rejected"]
    columns = [c for c in docs.columns if c not in new]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = 1 << BITS
        for batch in slices(batches):
            index, value, edge = features(batch.column("text"))
            p: list[np.ndarray] = []
            for w in sent.value:
                p.append(sigmoid(scores(index, value, edge, w[:own]) + sum((x * c for x, c in zip(p, w[own:-1], strict=True)), np.zeros(len(edge) - 1)) + w[-1]))
            bad = (p[-1] > threshold) & (np.diff(edge) > 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, p), pa.array(bad)], names=[*columns, *new])

    from pyspark.sql.types import BooleanType, DoubleType, StructType

    schema = StructType([docs.schema[c] for c in columns])
    for c in new[:-1]:
        schema = schema.add(c, DoubleType())
    return docs.select(columns).mapInArrow(score, schema.add("rejected", BooleanType()))
