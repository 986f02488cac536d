"""Token-id files of patched frame-of-reference blocks, as a Spark data source named "pfor".

    spark.dataSource.register(PforSource)
    rows.write.format("pfor").mode("append").save(path)     # doc_id long, ids array<int>, in file order
    texts.write.format("pfor").option("tokenizer", file).option("end_id", 1).mode("append").save(path)   # doc_id long, text
    spark.read.format("pfor").load(path)                    # doc_id, start, ids array<int>

One file per task: the ids of its documents in a row, in blocks of BLOCK ids. A block stores its minimum, and each id
minus that packed in the width that a percentile of the block needs; wider ones stand in the block's exception list of
places and values. After the blocks come the index of block starts, the documents' ids and the documents' lengths, then
a footer. A file is complete before it gets its name, and the manifest that the driver writes at commit lists the files
of the task attempts that won, so a lost executor leaves no trace in what is read. Each append adds a manifest of its
own, with the next number; readers take them in order. An overwrite's manifest hides all before it, whose files are
then deleted. Two writers at once may get the same number; both are read, ordered by name.

Block:  n u16, exceptions u16, width u8, minimum u32 | packed ceil(n * width / 8) bytes | places u16[] | values u32[]
Footer: blocks u64, documents u64, ids u64, place of the index u64, magic "PFOR1\\0\\0\\0"
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from larder.llm.common import open_path, slices
from larder.llm.tokens import encode_documents, worker_encoder

BLOCK = 4096
#: Share of a block's ids that must fit the packed width.
PERCENTILE = 0.95
HEAD, FOOT = struct.Struct("<HHBI"), struct.Struct("<QQQQ8s")
MAGIC = b"PFOR1\0\0\0"
MANIFEST = "_manifest-"
#: Blocks that a reader decodes at a time.
READ_BLOCKS = 64


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """1 to 65535 uint32 values as one block."""
    low = int(ids.min())
    rest = ids - np.uint32(low)
    bits = np.frexp(rest.astype(np.float64))[1]  # the width that a value needs
    w = int(np.partition(bits, k := int(np.ceil(percentile * len(bits))) - 1)[k])
    out = np.flatnonzero(bits > w)
    low_bits = rest & np.uint32((1 << w) - 1)
    matrix = np.unpackbits(low_bits.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=w)
    packed = np.packbits(matrix, bitorder="little").tobytes() if w else b""
    return HEAD.pack(len(ids), len(out), w, low) + packed + out.astype("<u2").tobytes() + rest[out].astype("<u4").tobytes()


def decode_block(data: memoryview) -> np.ndarray:
    n, wide, w, low = HEAD.unpack_from(data)
    at = HEAD.size
    ids = np.zeros(n, np.uint32)
    if w:
        size = (n * w + 7) // 8
        matrix = np.zeros((n, 32), np.uint8)
        matrix[:, :w] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * w).reshape(n, w)
        ids = np.packbits(matrix, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
        at += size
    if wide:
        ids[np.frombuffer(data, "<u2", wide, at)] = np.frombuffer(data, "<u4", wide, at + 2 * wide)
    return ids + np.uint32(low)


def manifests(store: fs.FileSystem, root: str) -> list[tuple[str, dict]]:
    """Name and content of the manifests that count, in order."""
    out: list[tuple[str, dict]] = []
    for info in sorted(store.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda x: x.base_name):
        if info.base_name.startswith(MANIFEST) and info.base_name.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                content = json.loads(f.read())
            out = [*([] if content["overwrite"] else out), (info.base_name, content)]
    return out


@dataclass
class Written(WriterCommitMessage):
    task: int
    file: str
    documents: int
    ids: int


class PforWriter(DataSourceArrowWriter):
    def __init__(self, path: str, tokenizer: str | None = None, end_id: int = 1, overwrite: bool = False):
        self.path, self.tokenizer, self.end_id, self.overwrite = path, tokenizer, end_id, overwrite

    def rows(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """doc_id, ids in a row and the number of each document's, of rows with ids or with texts to encode."""
        if self.tokenizer:
            for batch in slices(iterator):
                ids, starts = encode_documents(worker_encoder(self.tokenizer), batch.column("text"), self.end_id)
                yield batch.column("doc_id"), ids, np.diff(starts)
        else:
            for batch in iterator:
                lists = batch.column("ids")
                yield batch.column("doc_id"), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = open_path(self.path)
        task = TaskContext.get().partitionId()
        name = f"part-{task:06d}-{uuid.uuid4().hex}.pfor"
        docs, lengths, starts, place = [], [], [], 0
        left = np.zeros(0, np.uint32)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_{name}") as out:

            def put(ids: np.ndarray, last: bool) -> np.ndarray:
                nonlocal place
                for a in range(0, len(ids) if last else len(ids) // BLOCK * BLOCK, BLOCK):
                    out.write(block := encode_block(ids[a : a + BLOCK]))
                    starts.append(place)
                    place += len(block)
                return ids[len(ids) // BLOCK * BLOCK :]

            for names, ids, count in self.rows(iterator):
                docs.append(names)
                lengths.append(count.astype("<i8"))
                left = put(np.concatenate([left, ids]), False)
            put(left, True)
            ids_of = pa.chunked_array(docs or [pa.array([], pa.int64())], pa.int64())
            count = np.concatenate(lengths or [np.zeros(0, "<i8")])
            for column in (np.array([*starts, place], "<u8"), ids_of.fill_null(0).to_numpy().astype("<i8"), ids_of.is_null().to_numpy().astype(np.uint8), count):
                out.write(column.tobytes())
            out.write(FOOT.pack(len(starts), len(count), int(count.sum()), place, MAGIC))
        store.move(f"{root}/_{name}", f"{root}/{name}")
        return Written(task, name, len(count), int(count.sum()))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_path(self.path)
        files = [vars(m) for m in sorted((m for m in messages if m), key=lambda m: m.task)]
        before = manifests(store, root)
        number = 1 + max((int(name.split("-")[1]) for name, _ in before), default=-1)
        name = f"{MANIFEST}{number:08d}-{uuid.uuid4().hex}.json"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/.{name}") as out:
            out.write(json.dumps({"overwrite": self.overwrite, "files": files}).encode())
        store.move(f"{root}/.{name}", f"{root}/{name}")
        if self.overwrite:
            for old, content in before:
                store.delete_file(f"{root}/{old}")
                for x in content["files"]:
                    store.delete_file(f"{root}/{x['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = open_path(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.file}")


@dataclass
class Part(InputPartition):
    file: str
    start: int

    def __init__(self, file: str, start: int):
        self.file, self.start = file, start


class PforReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        store, root = open_path(self.path)
        known = manifests(store, root)
        if not known:
            raise FileNotFoundError(f"{self.path} holds no token files")
        parts, start = [], 0
        for _, content in known:
            for x in content["files"]:
                parts.append(Part(x["file"], start))
                start += x["ids"]
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, root = open_path(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as f:
            f.seek(f.size() - FOOT.size)
            blocks, documents, ids, place, magic = FOOT.unpack(f.read(FOOT.size))
            if magic != MAGIC:
                raise ValueError(f"{partition.file} is no pfor file")
            f.seek(place)
            starts = np.frombuffer(f.read(8 * (blocks + 1)), "<u8").astype(np.int64)
            doc_ids = np.frombuffer(f.read(8 * documents), "<i8")
            null = np.frombuffer(f.read(documents), np.uint8).astype(bool)
            lengths = np.frombuffer(f.read(8 * documents), "<i8")
            ends = np.cumsum(lengths)
            done, have, base, b = 0, np.zeros(0, np.uint32), 0, 0
            while done < documents:
                if b < blocks:
                    stop = min(blocks, b + READ_BLOCKS)
                    f.seek(int(starts[b]))
                    data = memoryview(f.read(int(starts[stop] - starts[b])))
                    have = np.concatenate([have, *(decode_block(data[starts[i] - starts[b] :]) for i in range(b, stop))])
                    b = stop
                upto = int(np.searchsorted(ends, base + len(have), "right")) if b < blocks else documents
                if upto > done:
                    edge = np.concatenate([[base], ends[done:upto]]) - base
                    column = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(have[: edge[-1]].view(np.int32)))
                    first = partition.start + ends[done:upto] - lengths[done:upto]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[done:upto], mask=null[done:upto]), pa.array(first), column], names=["doc_id", "start", "ids"])
                    have, base, done = have[edge[-1] :], base + int(edge[-1]), upto


class PforSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pfor"

    def schema(self) -> str:
        return "doc_id long, start long, ids array<int>"

    def reader(self, schema) -> PforReader:
        return PforReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PforWriter:
        return PforWriter(self.options["path"], self.options.get("tokenizer"), int(self.options.get("end_id", 1)), overwrite)
