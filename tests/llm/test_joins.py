import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from larder.llm import common, decontaminate, jaccard, line_dedup, merkle, passages
from larder.llm.components import components

from .conftest import frame, sentence


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")


def shingles(text):
    w = [x for x in words(text) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_words_of_sliced_batches(monkeypatch, rows):
    texts = [t for _, t in rows] * 3
    monkeypatch.setattr(common, "SLICE_BYTES", 3000)
    got = []
    for part in common.slices([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]):
        flat, starts = common.words(part.column("text"))
        got += [flat[a:b].to_pylist() for a, b in zip(starts, starts[1:], strict=False)]
    assert got == [[w for w in words(t) if w] for t in texts]
    flat, starts = common.words(pa.array(texts)[5:])
    assert len(starts) == len(texts) - 4 and flat[: starts[1]].to_pylist() == got[5]


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def dense_rows(seed, groups=6, size=40):
    rng, out = random.Random(seed), []
    line = sentence(rng, 25)
    for _ in range(groups):
        base = (sentence(rng, rng.randint(8, 90)) + " " + line).split(" ")
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_duplicates(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("members", [7, 512])
def test_dense_groups_over_several_runs(spark, monkeypatch, members):
    rows = dense_rows(members)
    monkeypatch.setattr(jaccard, "RUN_MEMBERS", members)
    monkeypatch.setattr(jaccard, "COMMON", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_odd_rows(odd, empty, rows):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    nameless = {r.n_shingles: r.component_id for r in got if r.doc_id is None}
    want = brute_components(rows)
    assert nameless[len(shingles(rows[1][1]))] == want[1][1] and nameless[0] is None and nameless[3] is None
    assert jaccard.near_duplicates(empty).count() == 0


def test_one_of_each(odd, rows):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    want = {d for d, (n, c) in brute_components(rows).items() if c == d}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want


def test_one_of_each_judges_rows_by_their_text(spark, odd, rows):
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(odd).collect()]
    assert sorted(t or "" for d, t in kept if d is None) == ["", "nobody has these seven words at all"]
    assert kept.count(tuple(rows[0])) == 1 and (2, "another text of the same id") in kept and tuple(rows[2]) in kept
    a, b, c = (sentence(random.Random(i), 30) for i in range(3))
    more = [(7, a), (7, b), (9, b), (None, a + " end"), (None, c), (None, c), (None, c + " end"), (None, ""), (None, "")]
    kept = sorted((r.doc_id or 0, r.text) for r in jaccard.one_of_each(frame(spark, more)).collect())
    assert [k for k in kept if k[1] not in (c, c + " end")] == sorted([(0, ""), (0, ""), (7, a), (7, b)]) and len(kept) == 5


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_postings_meet_only_sizes_that_may_be_similar(spark, monkeypatch, batch):
    rng = random.Random(int(batch))
    rows = [(t, i, rng.randint(1, 60), 0) for i in range(200) for t in {rng.randrange(30)}]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {tuple(r) for r in jaccard.meeting(spark.createDataFrame(rows, "token long, rep long, n long, r int")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    meet = lambda x, y: x is not y and x[0] == y[0] and 5 * min(x[2], y[2]) >= 4 * max(x[2], y[2])
    want = {x for x in rows if any(meet(x, y) for y in rows)}
    assert got == want and len(want) < len(rows)


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_postings_meet_only_places_that_may_be_similar(spark, batch):
    """No posting of a pair that may be similar at its places is lost, and one that can be similar to none is left out."""
    rng = random.Random(int(batch))
    rows = [(rng.randrange(40), i, n := rng.randint(10, 60), rng.randint(0, n // 5)) for i in range(200)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {tuple(r) for r in jaccard.meeting(spark.createDataFrame(rows, "token long, rep long, n long, r int").coalesce(1)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    meet = lambda x, y: x is not y and x[0] == y[0] and 9 * min(x[2] - x[3], y[2] - y[3]) >= 4 * (x[2] + y[2])
    close = lambda x, y: x is not y and x[0] == y[0] and 5 * min(x[2], y[2]) >= 4 * max(x[2], y[2])
    assert {x for x in rows if any(meet(x, y) for y in rows)} <= got < {x for x in rows if any(close(x, y) for y in rows)}


def test_a_pair_that_meets_in_many_buckets_is_compared_once(spark):
    rng = np.random.default_rng(11)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (40, 200, 700)]
    sets = [*base, *(s[len(s) // 20 :] for s in base)]  # 0 and 3, 1 and 4, 2 and 5 are alike
    n, bits = [len(s) for s in sets], [jaccard.signature([s], jaccard.width(len(s))).tobytes() for s in sets]
    assert jaccard.few_similar(n, list(range(6)), bits) == [(0, 3), (1, 4), (2, 5)] and jaccard.few_similar(n, [0] * 6, bits) == []
    signatures = spark.createDataFrame([(i, k, b) for i, (k, b) in enumerate(zip(n, bits, strict=True))], "rep long, n long, bits binary")
    members = [(7, b, i, i) for b, held in ((1, (0, 3)), (2, (0, 1, 3)), (3, (0, 2, 3, 5)), (4, (0, 1, 2))) for i in held]
    got = jaccard.narrowed(spark.createDataFrame(members, "anchor long, bucket long, rep long, comp long"), signatures).collect()
    assert sorted(r.rep for r in got) == [0, 2, 3, 5] and len({r.bucket for r in got}) == 2


def test_what_a_member_brings_comes_once_an_anchor(spark):
    """However many buckets of an anchor a member is in, it is one row; a large anchor is dealt in parts by whole buckets."""
    members = [(0, b, i, i) for b in range(40) for i in {0, b % 7, b % 5 + 10}] + [(5, 99, 5, 5), (5, 99, 6, 6)]
    frame = spark.createDataFrame(members, "anchor long, bucket long, rep long, comp long")
    sizes = spark.createDataFrame([(i, 100) for i in range(20)], "rep long, n long")
    one = jaccard.together(frame, sizes, 10**6).collect()
    assert len(one) == len({(r.anchor, r.rep) for r in one}) == 14
    parts = jaccard.together(frame, sizes, 2000).collect()
    for got in (one, parts):
        assert {(b, r.rep, r.comp) for r in got for b in r.buckets} == {m[1:] for m in members}
    where = {}
    for r in parts:
        for b in r.buckets:
            where.setdefault(b, set()).add(r.anchor)
    assert all(len(x) == 1 for x in where.values()) and 3 < len({r.anchor for r in parts}) < 12


def test_signature_tree_keeps_all_pairs():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in rng.integers(1, 80, 40)]
    sets = base + [np.unique(np.concatenate([s[rng.random(len(s)) > 0.1], rng.integers(0, 2**63, len(s) // 20).astype(np.uint64)])) for s in base]
    sets = [s for s in sets if len(s)]
    order = sorted(range(len(sets)), key=lambda i: sets[i][:2].tolist())
    sets = [sets[i] for i in order]
    pairs = {p for x, y in jaccard.SignatureTree(sets, np.arange(len(sets))).pairs((4, 5)) for p in zip(x.tolist(), y.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if k and 5 * k >= 4 * (len(sets[i]) + len(sets[j]) - k):
                assert (j, i) in pairs


def test_bitmaps_group_all_similar_pairs():
    rng = np.random.default_rng(7)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in rng.integers(1, 90, 60)]
    sets = base + [np.unique(np.concatenate([s[rng.random(len(s)) > 0.08], rng.integers(0, 2**63, len(s) // 12).astype(np.uint64)])) for s in base]
    sets = [s for s in sets if len(s)]
    n = np.array([len(s) for s in sets])
    bits = [jaccard.signature([s], jaccard.width(len(s))).tobytes() for s in sets]
    labels = np.arange(len(sets))
    of = jaccard.groups_of_similar(n, labels, bits)
    similar = [(i, j) for i in labels for j in labels[i + 1 :] if 5 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (n[i] + n[j] - k)]
    assert len(similar) > 20 and all(of[i] == of[j] >= 0 for i, j in similar)
    assert (jaccard.groups_of_similar(n, np.zeros(len(sets), int), bits) == -1).all()  # one component already
    apart = base[:1] + [base[0] ^ np.uint64(1 << 62)] if len(base[0]) > 1 else base[:2]
    assert (jaccard.groups_of_similar(np.array([len(s) for s in apart]), np.arange(2), [jaccard.signature([s], jaccard.width(len(s))).tobytes() for s in apart]) == -1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(f"_{name}", pd.DataFrame(rows, columns=["doc_id" if name == "documents" else "item_id", "text"]))
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    return con.sql(sql)


def compare(df, relation):
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    want = sorted(relation.select(", ".join(columns)).fetchall())
    assert got == want


def test_line_dedup(docs, rows):
    compare(line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed"), oracle(line_dedup.ORACLE, documents=rows))


def test_line_dedup_odd_rows(odd, empty):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == odd.count() and [c for c in got.columns if c in odd.columns] == [c for c in odd.columns if c != "text"] + ["text"]
    assert {r["_x"] for r in got.collect()} == {"x"}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_fingerprints(docs, rows):
    got = merkle.fingerprint_documents(docs)
    compare(got, oracle(merkle.ORACLE, documents=rows))
    same = {}
    for r in got.collect():
        t = dict(rows)[r.doc_id] or ""
        assert same.setdefault(r.fingerprint, t) == t
        n = len(t)
        after = dict(rows).get(r.doc_id + 1, rows[0][1]) if r.doc_id + 1 < len(rows) else rows[0][1]
        assert r.n_chars == n and r.near_edited >= 0


def test_fingerprints_odd_rows(odd, empty, spark):
    assert merkle.fingerprint_documents(odd).count() == odd.count()
    assert merkle.fingerprint_documents(empty).count() == 0
    one = merkle.fingerprint_documents(frame(spark, [(5, "abcdefgh")])).first()
    assert one.near_next == 1.0 and one.n_chars == 8


def test_changed_branches(spark):
    a = "\n".join(f"line {i}" for i in range(40))
    b = a.replace("line 20", "other")
    df = merkle.with_fingerprint(merkle.with_fingerprint(spark.createDataFrame([(a, b)], "x string, y string"), "x", "f"), "y", "g")
    sections, paragraphs = merkle.changed_branches("f", "g")
    assert tuple(df.select(sections, paragraphs).first()) == ([1], [20])


def benchmark_rows(rows):
    rng = random.Random(9)
    long = [t for _, t in rows if t and len(t.split()) > 80]
    items = [" ".join(t.split()[10 : 10 + n]) for t, n in zip(long, [16, 20, 37, 60, 5, 4], strict=False)]
    edited = long[7].split()[5:45]
    edited[20] = "edited"
    return list(enumerate([*items, " ".join(edited), sentence(rng, 20), "", None, "one", "two words"]))


def test_decontamination(spark, docs, rows):
    items = benchmark_rows(rows)
    got = decontaminate.contained_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    compare(got, oracle(decontaminate.ORACLE, documents=rows, benchmark=items))
    assert got.count() > 5


def test_decontaminate_odd_rows(spark, odd, empty, rows):
    items = spark.createDataFrame([*benchmark_rows(rows), (None, rows[1][1])], "item_id long, text string")
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == odd.count()


def test_decontaminate_judges_rows_by_their_text(spark):
    leak, clean, other = (sentence(random.Random(i), 40) for i in range(3))
    items = spark.createDataFrame([(1, leak[: len(leak) // 2])], "item_id long, text string")
    rows = [(None, leak), (None, clean), (None, None), (3, leak), (3, other), (4, clean)]
    kept = [(r.doc_id, r.text) for r in decontaminate.decontaminate(frame(spark, rows), items).collect()]
    assert sorted(kept, key=str) == sorted([(None, clean), (None, None), (3, other), (4, clean)], key=str)


def cartesian(values, width):
    out, todo = [], [(0, len(values) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a + 1 >= width:
            c = a + int(np.argmin(values[a : b + 1]))
            out.append((a, c, b))
            todo += [(a, c - 1), (c + 1, b)]
    return sorted(out)


def test_compact_windows():
    rng = np.random.default_rng(3)
    runs = [rng.integers(0, 2**64 - 1, n, dtype=np.uint64) for n in (0, 1, 5, 200, 64, 3000)]
    starts = np.cumsum([0, *map(len, runs)])
    got = sorted(zip(*(x.tolist() for x in passages.compact_windows(np.concatenate(runs), starts, 5)), strict=True))
    want = [(a + s, c + s, b + s) for r, s in zip(runs, starts, strict=False) for a, c, b in cartesian(r, 5)]
    assert got == sorted(want)


def test_repeated_passages(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for group in range(6):
        passage = sentence(rng, 52 + 10 * group).split(" ")
        for copy in range(4 + group):
            p = list(passage)
            if copy == 3 and len(p) > 70:
                p[len(p) // 2] = "edited"
            want[len(rows)] = group
            rows.append((len(rows), " ".join([sentence(rng, rng.randint(0, 120)), *p, sentence(rng, rng.randint(1, 120))])))
    line = sentence(rng, 12)
    clean = range(len(rows), len(rows) + 30)
    rows += [(i, f"{sentence(rng, 80)} {line} {sentence(rng, 80)}") for i in clean]
    rng.shuffle(rows)
    found = passages.repeated_passages(frame(spark, rows))
    got = found.collect()
    group_of = {}
    for r in got:
        assert r.end - r.start >= 50 and r.similarity >= 0.8 and want[r.doc_id] == want[r.source_id]
        group_of.setdefault(r.group_id, set()).update((r.doc_id, r.source_id))
    assert sorted(map(sorted, group_of.values())) == sorted(sorted(d for d, g in want.items() if g == k) for k in range(6))
    cut = {r.doc_id: r.text for r in passages.cut_passages(frame(spark, rows), found).collect()}
    assert all(cut[i] == t for i, t in rows if i in clean) and sum(len(cut[i].split()) < len(t.split()) for i, t in rows) == len({r.doc_id for r in got})


def brute_exact(x, y, width):
    """Places of y that equal runs of width and more with x cover."""
    runs = {tuple(x[i : i + width]) for i in range(len(x) - width + 1)}
    return {j + k for j in range(len(y) - width + 1) if tuple(y[j : j + width]) in runs for k in range(width)}


@pytest.mark.parametrize("percent", [1, 2, 3, 4, 5])
def test_exact_runs_between_edits_are_found(percent):
    rng, seen = np.random.default_rng(percent), 0
    for _ in range(30):
        x = rng.integers(-(2**63), 2**63 - 1, 600)
        y = x.copy()
        for i in np.flatnonzero(rng.random(600) < percent / 100):
            if not 270 <= i < 330:
                y[max(0, i - 4) : i + 1] = rng.integers(-(2**63), 2**63 - 1, i + 1 - max(0, i - 4))  # the shingles of one word
        y[270:330] = x[270:330]
        got = {j for s, e, t, u, share in passages.similar_runs(x, y, 46) for j in range(t, u)}
        assert brute_exact(x.tolist(), y.tolist(), 46) <= got
        for s, e, t, u, share in passages.similar_runs(x, y, 46):
            a, b = set(x[s:e].tolist()), set(y[t:u].tolist())
            assert e - s >= 46 and u - t >= 46 and share == len(a & b) / len(a | b) >= 0.8
        seen += 1
    assert seen == 30


def test_exact_passage_among_regular_edits(spark):
    rng = random.Random(11)
    passage = sentence(rng, 60).split(" ")
    blocks = [sentence(rng, 28).split(" ") for _ in range(10)]
    changed = [[*b[:14], "edited%d" % i, *b[15:]] for i, b in enumerate(blocks)]
    a, b = ([w for part in (*v[:5], passage, *v[5:]) for w in part] for v in (blocks, changed))  # words 140 to 200 hold it
    found = passages.verified(spark.createDataFrame([(1, 2, 0, len(a) - 4, 0, len(b) - 4)], "a long, b long, a0 long, a1 long, b0 long, b1 long"), frame(spark, [(1, " ".join(a)), (2, " ".join(b))])).collect()
    assert any(r.start <= 140 and r.end >= 200 for r in found)


def test_best_runs_are_not_stopped_by_a_short_one():
    hit = np.array([1] * 40 + [0] * 60 + ([1] * 9 + [0]) * 6, bool)
    assert any(s >= 100 for s, e in passages.best_runs(hit, 46))
    hit = np.array([0] * 90 + [1] * 36 + [0] + [1] * 4 + [0] * 3 + [1] * 6 + [0] * 90, bool)
    assert passages.best_runs(hit, 46)


def test_second_place_of_a_passage_is_reported():
    rng = np.random.default_rng(5)
    x, noise = rng.integers(0, 2**63, 60), rng.integers(0, 2**63, (4, 80))
    edited = np.concatenate([x[:30], noise[3][:4], x[34:]])
    y = np.concatenate([noise[0], x, noise[1], edited, noise[2]])
    assert sorted((t, u) for _, _, t, u, _ in passages.similar_runs(x, y, 46)) == [(80, 140), (220, 280)]


def test_runs_of_one_shingle_are_found():
    loop = np.full(5000, 7)
    assert passages.similar_runs(loop, loop, 46)


def test_truncated_first_copies_hide_no_passage(spark):
    rng, rows, want = random.Random(21), [], set()
    for group in range(40):
        passage, n = sentence(rng, 50).split(" "), len(rows)
        cut = passage[:40] if group % 2 else passage[10:]
        rows += [(n + k, " ".join([sentence(rng, 30), *p, sentence(rng, 30)])) for k, p in enumerate((cut, cut[:30], passage, passage))]
        want.add((n + 3, n + 2))
    found = passages.repeated_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.source_id) for r in found if r.start <= 30 and r.end >= 80} == want


def test_nearby_shifts_add_up(spark):
    place = lambda c, j: int(passages.packed_place(np.array(c), j, np.array(30), np.array(30)))
    rows = [(1, 2, place(100, 0), place(115, 0)), (1, 2, place(110, 1), place(126, 1)), (1, 3, place(100, 0), place(115, 0)), (1, 3, place(110, 1), place(160, 1))]
    pairs = spark.createDataFrame(rows, "a long, b long, p long, q long")
    assert [tuple(r) for r in passages.joined_intervals(pairs).collect()] == [(1, 2, 70, 141, 85, 157)]


def test_places_round_trip():
    c, back, ahead = np.array([0, 5, 1 << 28]), np.array([0, passages.REACH - 1, 3 * passages.REACH + 1]), np.array([7, passages.REACH, 1 << 27])
    got = passages.unpacked_place(passages.packed_place(c, 3, back, ahead))
    assert got[0].tolist() == c.tolist() and got[1].tolist() == [3] * 3
    assert got[2].tolist() == [0, passages.REACH - 1, 4 * passages.REACH] and got[3].tolist() == [7, passages.REACH, 1 << 27]


def test_run_hashes_tell_runs_apart():
    x = np.random.default_rng(2).integers(0, 3, 4000)
    got = passages.run_hashes(x, 6).tolist()
    want = [tuple(x[i : i + 6].tolist()) for i in range(len(x) - 5)]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def exact_pairs(rows, width=50):
    """Pairs of ids whose texts share a run of width words, by brute force."""
    holders = {}
    for i, t in rows:
        w = t.lower().split()
        for k in range(len(w) - width + 1):
            holders.setdefault(tuple(w[k : k + width]), set()).add(i)
    return {(min(h), i) for h in holders.values() for i in h if i != min(h)}


@pytest.mark.parametrize("hot", [2, 8])
def test_all_equal_passages_connect(spark, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    rng, rows = random.Random(31), []
    base = [sentence(rng, 90).split(" ") for _ in range(6)]
    for _ in range(120):  # cuts of mixed passages that overlap each other in part, some edited
        w = sentence(rng, rng.randint(0, 20)).split(" ")
        for _ in range(rng.randint(1, 3)):
            b = list(rng.choice(base))
            if rng.random() < 0.3:
                b[rng.randrange(90)] = "edited%d" % rng.randrange(4)
            x = rng.randint(0, 40)
            w += [*b[x : x + rng.randint(30, 70)], *sentence(rng, rng.randint(1, 20)).split(" ")]
        rows.append((len(rows), " ".join(w)))
    found = passages.repeated_passages(frame(spark, rows)).collect()
    group = {r.doc_id: r.group_id for r in found} | {r.source_id: r.group_id for r in found}
    want = exact_pairs(rows)
    assert want and all(group[a] == group[b] for a, b in want)
    assert {b for _, b in want} <= {r.doc_id for r in found}
    text = dict(rows)
    for r in found:
        x, y = (t.lower().split()[s:e] for t, s, e in ((text[r.doc_id], r.start, r.end), (text[r.source_id], r.source_start, r.source_end)))
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
        assert r.source_id < r.doc_id and r.similarity == len(x & y) / len(x | y) >= 0.8


def test_cut_passages(spark):
    rows = [(1, "a b  c d\te f g"), (2, "a b"), (3, None), (4, ""), (None, "a b c"), (1, "other text here of six words")]
    cuts = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (1, 2, 4), (1, 5, 6), (2, 0, 2), (3, 0, 2), (4, 0, 2), (9, 0, 5)], "doc_id long, start long, end long")
    got = passages.cut_passages(frame(spark, rows), cuts)
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("1", "a e g"), ("2", ""), ("3", "None"), ("4", ""), ("None", "a b c"), ("1", "other six")])
    assert got.columns == frame(spark, rows).columns
    words = [str(i) for i in range(100_000)]
    many = spark.createDataFrame([(7, i, i + 50) for i in range(0, 99_000, 100)], "doc_id long, start long, end long")
    left = passages.cut_passages(frame(spark, [(7, " ".join(words))]), many).first().text.split(" ")
    assert left == [w for i, w in enumerate(words) if i >= 99_000 or i % 100 >= 50]


def test_passages_odd_rows(odd, empty):
    assert passages.repeated_passages(odd).count() > 0
    assert passages.repeated_passages(empty).count() == 0


ORACLES = {"lines": line_dedup.ORACLE, "benchmark": decontaminate.ORACLE}
