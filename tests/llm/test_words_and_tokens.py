"""Spelling variants, token alignment and personal data against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from larder.llm import alignment, personal, spelling
from larder.llm.tokens import tokenizer_path

BYTE, PIECE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def by_null(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


# spelling variants


def plain_words(rows, slip, length, count):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= length and n >= count}


def plain_variants(counts, ratio):
    near = defaultdict(set)
    masks = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            if (u := w[:i] + w[i + 1 :]) in counts:
                near[w].add(u)
                near[u].add(w)
            masks[w[:i], w[i + 1 :]].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()]


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(5)
    words = {"".join(rng.choice("abÿé") for _ in range(rng.randint(1, 7))) for _ in range(900)}
    words |= {"prefixx" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(200)} | {"a" * 3000, "a" * 3001, "a" * 2999 + "b"}
    return {w: 5 ** rng.randint(0, 7) + rng.randint(0, 2) for w in words}


@pytest.mark.parametrize("chunk", [spelling.CHUNK_WORDS, 7])
def test_variants_equal_plain(spark, vocabulary, chunk, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(spelling, "POSITIONS", 50 * chunk)
    got = spelling.variant_groups(spark.createDataFrame(list(vocabulary.items()), "word string, n long")).collect()
    assert by_null(got) == by_null(plain_variants(vocabulary, 5))


def test_words_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = {r.word: r.n for r in spelling.count_words(odd, slip=3, least_length=2, least_count=1).collect()}
    assert got == plain_words(rows, 3, 2, 1)
    assert by_null(spelling.group_variants(odd).collect()) == by_null(plain_variants(plain_words(rows, 199, 6, 5), 5))


def test_no_words(spark, empty):
    assert spelling.group_variants(empty).collect() == []


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 65):
        values = rng.permutation(n)
        a, b, c, d = (rng.integers(0, n + 1, 200) for _ in range(4))
        query, value = spelling.WaveletTree(values).report(a, b, c, d)
        want = [(q, v) for q in range(200) for v in values[a[q] : max(a[q], b[q])].tolist() if c[q] <= v < d[q]]
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == sorted(want)


# token alignment


def plain_alignment(rows):
    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    names, to_byte = {i: w for w, i in a.get_vocab().items()}, {}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for x in range(256):
        to_byte[chr(x) if x in plain else chr(256 + sum(y not in plain for y in range(x)))] = x
    out, links = [], []
    for i, t in rows:
        raw = (" " + (t or "")).encode()
        ids_a, ids_b = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        sa = [bytes(to_byte[c] for c in names[x]) for x in ids_a]
        sb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not t or b"".join(sa) != raw or b"".join(sb) != raw:
            ids_a, ids_b, sa, sb = [], [], [], []
        ends = lambda s: np.cumsum([0, *map(len, s)]).tolist()
        ea, eb = ends(sa), ends(sb)
        own, k = [], 0
        for j, x in enumerate(ids_a):
            while k and eb[k] > ea[j]:
                k -= 1
            while k < len(ids_b) and eb[k] < ea[j + 1]:
                if eb[k + 1] > ea[j]:
                    own.append((x, ids_b[k]))
                k += 1
        cuts = sorted(set(ea) & set(eb))
        groups = [",".join(str(x) for x, e in zip(ids_a, ea[1:], strict=True) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(ids_b, eb[1:], strict=True) if lo < e <= hi) for lo, hi in zip(cuts, cuts[1:], strict=False)] if len(ids_a) < 3000 else None
        links.append(own)
        out.append((i, len(ids_a), len(ids_b), len(cuts) - 1, groups))
    count = Counter(p for own in links for p in own)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(i, na, nb, ng, len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), None if g is None else hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (i, na, nb, ng, g), own in zip(out, links, strict=True)]


@pytest.mark.parametrize("sent_pairs", [alignment.SENT_PAIRS, 0])
def test_alignment_equals_plain(spark, odd, sent_pairs):
    extra = [(900, " starts and ends "), (901, "two  spaces\n and\nlines"), (902, "a▁mark <s> </s> <unk> <0x41>"), (903, "tab\tnbsp  x y  z"), (904, "中 文 字é "), (905, "é ﬁ ½ ² ½"), (906, "nul\x00 \x1c and \x85 x")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    want, got = by_null(plain_alignment(rows)), by_null(alignment.align_documents(docs.withColumn("a", docs.text), BYTE, PIECE, sent_pairs).collect())
    assert [w[:-1] for w in want] == [g[:-1] for g in got]
    assert all(w[-1] in (None, g[-1]) for w, g in zip(want, got, strict=True))


def test_links_of_any_batches(spark, rows):
    """Groups are the same however the links of a document are cut into batches, and links of a group share later."""
    docs = spark.createDataFrame(rows[:12], "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = by_null(alignment.align_documents(docs, BYTE, PIECE).collect())
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert by_null(alignment.align_documents(docs, BYTE, PIECE).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    links = alignment.aligned_tokens(spark.table(alignment.token_table(docs, BYTE, PIECE))).where("kind IS NOT NULL").toPandas()
    assert (links.groupby(["row", "later"]).kind.apply(lambda k: (k == 2).sum()) == 1).all()


def test_pieces_are_aligned_once_in_a_run(spark, rows, monkeypatch):
    texts = [(i, t) for i, (_, t) in enumerate(rows[:8])]
    docs = lambda times: spark.createDataFrame(texts * times, "doc_id long, text string").coalesce(1)
    links = lambda times: alignment.aligned_tokens(spark.table(alignment.token_table(docs(times), BYTE, PIECE))).count()
    assert links(20) == links(1)
    want = Counter(by_null(alignment.align_documents(docs(6), BYTE, PIECE).collect()))
    monkeypatch.setattr(alignment, "RUN_BYTES", 1000)
    monkeypatch.setattr(alignment, "REMEMBERED", 700)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        table = spark.table(alignment.token_table(docs(6), BYTE, PIECE))
        assert table.where("what = 'documents'").select("run").distinct().count() > 3
        assert Counter(by_null(alignment.align_documents(docs(6), BYTE, PIECE).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("sent_pairs", [alignment.SENT_PAIRS, 0])
def test_runs_meet_where_they_are(spark, rows, monkeypatch, sent_pairs):
    """Of many runs in many buckets, documents are put together without moving, and as from one run."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = by_null(alignment.align_documents(docs, BYTE, PIECE).collect())
    monkeypatch.setattr(alignment, "RUN_BYTES", 1000)
    monkeypatch.setattr(alignment, "REMEMBERED", 200)
    monkeypatch.setattr(alignment, "BUCKET_BYTES", 5000)
    got = alignment.align_documents(docs, BYTE, PIECE, sent_pairs)
    assert by_null(got.collect()) == want
    if sent_pairs:
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_pieces_that_are_encoded_together_are_as_alone(monkeypatch):
    """Also beside pieces that a tokenizer doesn't spell, and after a worker forgets all but the frequent ones."""
    rng = random.Random(5)
    names = list(dict.fromkeys("".join(rng.choice("abcdeéü1.,-\n😀") for _ in range(rng.randint(1, 9))).strip() or "x" for _ in range(700)))
    names[30], names[300] = "a▁b", "é▁"  # the mark of a space is not spelled again
    alone, joint = alignment.TokenPair(BYTE, PIECE), alignment.TokenPair(BYTE, PIECE)
    calls, encode = [], joint.a.encode_batch_fast
    joint.a = type("", (), {"encode_batch_fast": lambda self, texts, **k: calls.extend(texts) or encode(texts, **k)})()
    alone.learn([], names)
    joint.learn(names, [])
    assert len(calls) < len(names) / 4 and set(joint.known) == set(names) and not joint.fits.all()

    def codes(pair, w):
        i = pair.known[w]
        return bool(pair.fits[i]), pair.a_codes[pair.a_starts[i] : pair.a_starts[i + 1]].tolist(), pair.b_codes[pair.b_starts[i] : pair.b_starts[i + 1]].tolist()

    want = {w: codes(alone, w) for w in names}
    assert {w: codes(joint, w) for w in names} == want
    monkeypatch.setattr(alignment, "REMEMBERED", 400)
    times = np.ones(len(names), np.int64)
    frequent = rng.sample(range(len(names)), 150)
    times[frequent] = range(2, 152)
    kept = list(joint.known)
    joint.forget(times)
    assert set(joint.known) == {kept[i] for i in frequent[50:]} and all(codes(joint, w) == want[w] for w in joint.known)


def test_documents_are_put_together_a_part_at_a_time(monkeypatch):
    docs = pa.table({"doc_id": pa.array(range(9), pa.int64()), "pieces": pa.array([[0], [], [0, 2, 2], [1], [2] * 9, [], [1, 0], [0], []], pa.list_(pa.int32()))})
    names = {n: [[1, 2, 1]] for n in ("n_a", "n_b", "n_groups", "n_links")}
    pieces = pa.table({"numbers": pa.array([[2, 0, 1]], pa.list_(pa.int32())), **{n: pa.array(x, pa.list_(pa.int32())) for n, x in names.items()}, "a": pa.array([[1, 2, 3, 4]], pa.list_(pa.int32())), "b": pa.array([[1, 2, 3, 4]], pa.list_(pa.int32())), "groups": ["c|c\na|a;b|b\nd|d"]})
    sent = [np.array([i << 32 | i for i in range(1, 5)]), np.arange(1, 5), np.array([True, False, True, True])]
    whole = alignment._put_together(docs, pieces, sent)
    monkeypatch.setattr(alignment, "AT_ONCE", 2)
    parts = []
    one = alignment._some_together
    monkeypatch.setattr(alignment, "_some_together", lambda d, *x: parts.append(len(d)) or one(d, *x))
    assert alignment._put_together(docs, pieces, sent).equals(whole) and len(parts) > 3
    assert whole["n_links"].to_pylist() == [2, 0, 4, 1, 9, 0, 3, 2, 0] and whole["count_sum"].to_pylist()[:3] == [5, 0, 7]
    assert whole["groups_sha256"].to_pylist()[2] == hashlib.sha256(b"a|a;b|b;c|c;c|c").hexdigest() and whole["groups_sha256"].to_pylist()[1] == ""


def test_alignment_of_nothing(empty):
    assert alignment.align_documents(empty, BYTE, PIECE).collect() == []


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


CASES = ["1.2.3.4.5.6.7.8 x@y.z.@q.r +12 345-678-901) +1", "a@b.c_d@e.f 4111 1111-1111 1111 300.1.2.3 é@b.c 000255.1.2.03", "+1 (234) 567-8901 and +1 234 567 890 123 456 or 4111111111111111 4111111111111112", "😀 a@b.co\n+49 30 901820 1.2.3", "9" * 300 + " 1.1.1." + "0" * 90 + "7", "@@ a@ @b.c a@b a@b. a.@-.-"]


def test_personal_data_of_odd_rows(spark, odd):
    rng = random.Random(1)
    noise = ["".join(rng.choice("1234.@ +-()ab") for _ in range(400)) for _ in range(30)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(500 + i, t) for i, t in enumerate(CASES + noise)], "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    want = []
    for i, t in rows:
        found = plain_spans(t)
        text = ",".join(x[2] for x in found)
        want.append((i, *(sum(x[1] == k for x in found) for k in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    got = personal.personal_digests(docs.withColumn("row", docs.text).withColumn("value", docs.text))
    assert by_null(got.drop("spans").collect()) == by_null(want)


def test_very_long_runs_end(spark):
    texts = ["9" * 200_000, "a" * 200_000, "a@" * 60_000, "+1 " * 60_000, "1.2.3.4, " * 5000, "(((1" * 50_000]
    got = personal.personal_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_phone) for r in got} == {0: (0, 0, 0), 1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 5000, 0), 5: (0, 0, 0)}


def test_contexts_give_identifiers_away(spark):
    """Good contexts find new forms; what these share with weaker contexts makes those good in a later round; common words stay out."""
    seen = [(i, f"e-mail: u{i}@mail.com and the call: +1 (555) 123-45{i:02d} now") for i in range(20)]
    new = [(100, "e-mail: jörg@büro and call: 555-123-4567 now"), (101, "the 555-999-4567 here"), (102, "e-mail: localuser@intranet"), (103, "and the 4111111111111112 now")]
    new += [(200 + i, f"e-mail: x{i}@intern") for i in range(9)] + [(220 + i, f"post x{i}@intern") for i in range(9)] + [(230 + i, f"post p{i}@mail.com") for i in range(3)] + [(240, "post only@round")]
    docs = spark.createDataFrame(seen + new, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal.personal_digests(docs).collect()}
    assert got[100] == "email:8:17,phone:28:40" and got[102] == "email:8:26" and got[240] == "email:5:15"
    assert got[101] == "" and got[103] == ""
    one = {r.doc_id: r.spans for r in personal.find_personal(docs, rounds=1).collect()}
    assert one[240] is None and one[100] is not None


def test_no_personal_data(empty):
    assert personal.personal_digests(empty).collect() == []
