"""Token ids of whole texts inside tasks: chunks between white space are encoded once and gathered by code."""

from __future__ import annotations

import os
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larder.llm.common import words

#: Distinct cores of chunks a worker remembers before it starts again.
REMEMBERED = 500_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids by a tokenizer whose pre-tokens never span ASCII white space and that drops white space.

    For such a tokenizer the ids of a text are those of its chunks one after the other, so a chunk that comes again
    costs a look-up. The tokenizer folds case, and a comma or full stop between a letter and the chunk's end is a
    pre-token of its own, so chunks are known by their lower-case core. The first REMEMBERED cores are kept for good;
    the frequent ones are among them, and later ones last for one call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, int] = {}
        self.passing: list[str] = []
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def forget_passing(self) -> None:
        for w in self.passing:
            del self.known[w]
        self.passing = []
        self.starts = self.starts[: len(self.known) + 1]
        self.ids = self.ids[: self.starts[-1]]

    def places(self, cores: list[str]) -> np.ndarray:
        """Where self.starts has each core; unknown ones are encoded first."""
        known = self.known
        missing = [w for w in cores if w not in known]
        for a in range(0, len(missing), 20_000):
            part = missing[a : a + 20_000]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            if len(known) + len(part) > REMEMBERED:
                self.passing += part
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        return np.fromiter(map(known.__getitem__, cores), np.int64, len(cores))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and where each text's begin."""
        flat, starts = words(texts, lower=False)
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        self.forget_passing()
        comma, full = self.places([",", "."])
        coded = flat.dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy()
        # "<|" may begin a special string, which counts only as it is written
        folded = pc.if_else(pc.match_substring(names, "<|"), names, pc.ascii_lower(names))
        stop = pc.match_substring_regex(folded, r"^[\x21-\x7e]*[a-z][.,]$")
        cores = pc.if_else(stop, pc.utf8_slice_codeunits(folded, 0, -1), folded).dictionary_encode()
        core = self.places(cores.dictionary.to_pylist())[cores.indices.to_numpy()]
        tail = np.where(stop.to_numpy(zero_copy_only=False), np.where(pc.ends_with(folded, ",").to_numpy(zero_copy_only=False), comma, full), -1)
        parts = np.empty((len(codes), 2), np.int64)
        parts[:, 0], parts[:, 1] = core[codes], tail[codes]
        parts = parts.ravel()
        used = parts >= 0
        per_word = 1 + used[1::2]
        parts = parts[used]
        each = self.starts[parts + 1] - self.starts[parts]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(self.starts[parts] - ends[:-1], each)
        at += np.arange(len(at))
        first = np.concatenate([[0], np.cumsum(per_word)])
        return self.ids[at], ends[first[starts]]


@cache
def worker_encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker, which Spark uses for many tasks."""
    return ChunkEncoder(path)


def encode_documents(encoder: ChunkEncoder, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with end_id after each text."""
    ids, starts = encoder.encode(texts)
    counts = np.diff(starts)
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    place = np.ones(len(out), bool)
    ends = starts[1:] + np.arange(len(counts))
    place[ends] = False
    out[place] = ids
    return out, starts + np.arange(len(starts))
