import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larder.llm import packing, token_counts, token_files
from larder.llm.pfor import decode_block, encode_block
from larder.llm.tokens import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def ids_of(text):
    return [*Tokenizer.from_file(WORD).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def check_packed(got, rows, capacity):
    want = []
    for i, t in rows:
        ids = ids_of(t)
        want += [(i, k, a, len(ids[a : a + capacity]), crc(ids[a : a + capacity])) for k, a in enumerate(range(0, len(ids), capacity))]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted([tuple(r[:5]) for r in got], key=key) == sorted(want, key=key)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pack_documents(docs, rows):
    got = packing.pack_documents(docs, WORD).collect()
    n = check_packed(got, rows, 4096)
    assert n == -(-sum(r.length for r in got) // 4096)


def test_pack_small_capacity_and_odd_rows(odd, rows):
    got = packing.pack_documents(odd, WORD, capacity=50).collect()
    all_rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_packed(got, all_rows, 50)


def test_packed_sequences_hold_the_ids(docs, rows):
    texts = dict(rows)
    for s in packing.packed_sequences(docs, WORD, capacity=64).collect():
        assert len(s.ids) <= 64
        for i, a in zip(s.doc_ids, s.offsets, strict=True):
            assert s.ids[a] in ids_of(texts[i])


def test_pack_empty(empty):
    assert packing.pack_documents(empty, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=20))
def test_patterns_hold_each_piece_once(histogram):
    used = {}
    for held, copies in packing.plan_patterns(histogram, 60):
        assert sum(held) <= 60
        for x in held:
            used[x] = used.get(x, 0) + copies
    assert used == histogram


def test_exact_complements_come_first():
    plan = packing.plan_patterns({90: 3, 10: 1, 6: 1, 4: 1, 5: 1, 3: 1, 2: 1}, 100)
    assert sorted(sum(h) for h, k in plan for _ in range(k)) == [100, 100, 100]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.floats(0.5, 1))
def test_block_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    assert (decode_block(memoryview(encode_block(ids, percentile))) == ids).all()


def test_token_files(spark, odd, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(odd, path, WORD)
    got = token_files.read_token_files(spark, path).collect()
    want = sorted(((r.doc_id, tuple(ids_of(r.text))) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0], x[1]))
    assert sorted(((r.doc_id, tuple(r.ids)) for r in got), key=lambda x: (x[0] is not None, x[0], x[1])) == want
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [x[0] for x in want]
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) for r in got)])[:-1].tolist()


def test_appends_follow_each_other_and_overwrites_replace(spark, docs, tmp_path):
    path = f"file://{tmp_path}/t"
    some = docs.where("doc_id < 5")
    token_files.write_token_files(some, path, WORD)
    token_files.write_token_files(docs.where("doc_id between 5 and 9"), path, WORD)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(10))
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) for r in got)])[:-1].tolist()
    token_files.write_token_files(some, path, WORD, mode="overwrite")
    assert sorted(r.doc_id for r in token_files.read_token_files(spark, path).collect()) == list(range(5))
    token_files.write_token_files(docs.where("doc_id = 7"), path, WORD)
    assert sorted(r.doc_id for r in token_files.read_token_files(spark, path).collect()) == [0, 1, 2, 3, 4, 7]


def test_round_trip_digests(docs, rows, empty):
    got = sorted(token_files.round_trip(docs, WORD).collect())
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = ids_of(t)
        assert tuple(r) == (i, start, len(ids), crc(ids))
        start += len(ids)
    assert token_files.round_trip(empty, WORD).count() == 0


@pytest.mark.parametrize("table", [None, {}])
def test_token_counts(odd, empty, table):
    library = Tokenizer.from_file(BYTE)
    got = token_counts.count_tokens(odd, BYTE, table=table).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    want = []
    for r in odd.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(empty, BYTE).count() == 0
