"""What the operators share: scratch tables in the cluster's shared folder and vectorised word and shingle hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Words of a shingle and the least similarity of near duplicates, as a fraction.
SHINGLE = 5
SIMILAR = (4, 5)
#: Bytes of text that a task works on at a time, and that Spark sends to a Python worker at a time.
SLICE_BYTES = 4 << 20
#: Spark's default of that bound.
DEFAULT_BYTES = str(64 << 20)

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_LENGTH = np.uint64(0xE7037ED1A0B428DB)


#: The folders of the tables that materialize has made, as long as they are in use.
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@cache
def _test_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="larder-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a master of one machine may do without; it gets a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or _test_dir()).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larder/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, work is done once, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, **options)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_folder(spark: SparkSession, name: str, folder: str) -> None:
    """Delete one folder of the files of a table that was saved at a scratch_path. Nothing that is still to run may read it."""
    where = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
    _delete(spark, f"{where}/{folder}/_")


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize made. Nothing that is still to run may read them."""
    for table in tables:
        if path := _TABLES.pop(table, None):
            _delete(table.sparkSession, path)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that this session sends to Python, unless the session has set a bound.

    Rows of texts and of sets differ in size by far, so Spark's bound on rows alone doesn't bound memory.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == DEFAULT_BYTES:
        spark.conf.set(name, str(SLICE_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about SLICE_BYTES of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cell = np.cumsum(sizes) // SLICE_BYTES
        cuts = np.flatnonzero(np.diff(cell)) + 1
        edges = [0, *cuts.tolist(), len(sizes)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.take(pa.array(np.arange(a, b)))  # a copy: some kernels misread arrays with an offset


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of texts in a row, and where each text's words start (one more entry than texts); null is empty.

    A word is a run of characters other than space and U+0009 to U+000D; only A-Z are lower-cased.
    """
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), kept[offsets]


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()]


def shingles(hashes: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each text, in text order, and where each text's begin.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    counts = np.diff(starts)
    n = len(hashes)
    rolling = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, n)):
            rolling[: n - k] += hashes[k:] * _MULTIPLIERS[k % 5] * np.uint64(2 * (k // 5) + 1)
        valid = np.ones(n, bool)
        ends = starts[1:]
        for k in range(1, size):  # the last size - 1 words of a text start no shingle
            at = ends - k
            valid[at[(counts >= k)]] = False
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            for i in short.tolist():
                a, b = starts[i], starts[i + 1]
                h = hashes[a:b]
                m = np.array([int(_MULTIPLIERS[k % 5]) * (2 * (k // 5) + 1) % 2**64 for k in range(b - a)], np.uint64)
                rolling[a] = (h * m).sum(dtype=np.uint64) + np.uint64(size - (b - a)) * _LENGTH
            valid[starts[short]] = True
        rolling = mix(rolling)
    kept = np.concatenate([[0], np.cumsum(valid)])
    return rolling[valid], kept[starts]


def distinct_sets(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, ascending, and where each text's begin."""
    counts = np.diff(starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], np.searchsorted(o[keep], np.arange(len(counts) + 1))


def ragged(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, kind))
