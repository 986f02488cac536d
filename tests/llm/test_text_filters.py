import gzip
import html.parser
import io
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larder.llm import toxicity, warc

from .conftest import frame, sentence

PAGES = "page_id long, url string, html string, header string, block string"


#: Character references of each kind: named with and without semicolon, prefixes of names, unknown, numeric, remapped, forbidden, too large.
REFERENCES = "<title>&Eacute;t&eacute; &amp; &#8217;</title><p>&copy; &middot; &nbsp;&copy2 &notin; &notit; &unknown; &amp;lt; &#65;&#x41;&#X42 &#128;&#150; &#0; &#1; &#xD800; &#99999999999; &#xFFFF; & &; &#; &#x; a&b=c</p>"


def pages_rows():
    page = '<!DOCTYPE html><html lang="de"><head><title>A  title\n&amp; more</title><style>p{}</style><script>var t="</p>";</script></head><body><p>One &lt;two&gt; <b>th</b>ree.<br>four<!-- gone <p> --></p><a href="/x">out</a></body></html>'
    return [(1, "http://a.example/1", page), (2, None, page), (3, "http://b.example", None), (4, "http://c.example", ""), (None, "http://d.example", "plain &amp;amp; text"), (1, "http://a.example/1", page), (6, "http://e.example/ü", "<p>" + "lang ü " * 20000), (7, "http://f.example", REFERENCES), (8, "http://g.example", "<x <p> \n \t\n b<!-- <script> --><script>1</script ><SCRIPT>2</SCRIPT>c<br/>\xa0 d")]


def frame_of_pages(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in pages_rows()], PAGES)


def test_derivatives_match_sql(spark):
    got = warc.page_derivatives(frame_of_pages(spark))
    con = duckdb.connect()
    con.register("_p", pd.DataFrame(pages_rows(), columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    con.sql("CREATE VIEW pages AS SELECT * FROM _p")
    columns = got.columns
    key = lambda t: tuple((v is not None, v) for v in t)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({warc.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


class Visible(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


@pytest.mark.parametrize("page", [pages_rows()[0][2], REFERENCES, "<p>caf&eacute; 3 &lt; 4 &#8212; na&iuml;ve &notit; &amp;copy;</p>"])
def test_text_agrees_with_a_parser(page):
    parser = Visible()
    parser.feed(page)
    parser.close()
    assert "".join(warc.page_text(page).split()) == "".join(parser.words)


def test_titles_are_decoded():
    assert warc.page_title("<title>Fish &amp;\n chips &#8217;n&rsquo;</title>") == "Fish & chips ’n’"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_whole_pages_agree_with_a_parser():
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        parser = Visible()
        parser.feed(page)
        parser.close()
        assert "".join(warc.page_text(page).split()) == "".join(parser.words)


def test_all_source_headers_stay(spark):
    head = "HTTP/1.1 404 Not Found\r\nServer: a\r\nX-Cache: HIT\r\nX-Cache: again\r\n\r\n"
    row = spark.createDataFrame([("r", "u", "d", head, None, "kept")], warc.RESPONSE + ", block string")
    got = warc.derive(row).where("record_type = 'metadata'").first()
    lines = got.block.split("\r\n")
    assert "source-status: HTTP/1.1 404 Not Found" in lines
    assert [x for x in lines if x.startswith("source-header")] == ["source-header: Server: a", "source-header: X-Cache: HIT", "source-header: X-Cache: again"]


def test_records_link_and_round_trip(spark, tmp_path):
    made = warc.page_derivatives(frame_of_pages(spark)).cache()
    warc.write_records(made, f"file://{tmp_path}/w")
    for p in list((tmp_path / "w").glob("part-*"))[:1]:
        p.with_suffix(".warc.gz").write_bytes(gzip.compress(p.read_bytes()))
        p.unlink()
    read = warc.read_records(spark, f"file://{tmp_path}/w").collect()
    want = sorted((r.record_id, r.source_id, r.block) for r in made.collect())
    assert sorted((r.headers["warc-record-id"], r.headers["warc-refers-to"], bytes(r.block).decode()) for r in read) == want
    assert not any(r.problem for r in read)
    sources = {r.record_id for r in warc.responses(frame_of_pages(spark)).collect()}
    assert {r[1] for r in want} == sources
    assert warc.page_derivatives(spark.createDataFrame([], PAGES)).count() == 0


def record(block, length=None, extra=b""):
    return b"WARC/1.1\r\nWARC-Type: response\r\n" + extra + (b"" if length == "" else b"Content-Length: %s\r\n" % str(length or len(block)).encode()) + b"\r\n" + block + b"\r\n\r\n"


CASES = {
    "sound": (record(b"one") + record(b"WARC/1.1 two"), [(b"one", None), (b"WARC/1.1 two", None)]),
    "cut in a block": (record(b"one") + record(b"x" * 50)[:60], [(b"one", None), (None, "truncated")]),
    "cut in a header": (record(b"one") + b"WARC/1.1\r\nWARC-Ty", [(b"one", None), (b"", "truncated")]),
    "no length": (record(b"one", "") + record(b"two"), [(b"one", "length"), (b"two", None)]),
    "bad length": (record(b"one", "many") + record(b"two"), [(b"one", "length"), (b"two", None)]),
    "no UTF-8": (record(b"one", extra=b"X-A: \xff\xfe\r\n"), [(b"one", "encoding")]),
    "empty": (b"", []),
    "noise": (b"hello\r\n" + record(b"one"), [(b"one", None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_malformed_records_have_an_outcome(name, monkeypatch):
    monkeypatch.setattr(warc.Unpacked, "PIECE", 7)
    data, want = CASES[name]
    for packed in (data, gzip.compress(data), b"".join(gzip.compress(data[i : i + 20]) for i in range(0, len(data), 20))):
        got = [(block, problem) for _, _, block, problem in warc.parsed_records(io.BytesIO(packed))]
        assert [g if w[0] is not None else (None, g[1]) for g, w in zip(got, want, strict=True)] == want
    cut = gzip.compress(record(b"one") + record(random.Random(1).randbytes(400)))[:-60]
    assert [p for *_, p in warc.parsed_records(io.BytesIO(cut))] == [None, "truncated"]


BAD = ["zorkbad", "vilebad", "grimbad"]


def labelled(seed, n):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        w = sentence(rng, rng.randint(20, 200)).split(" ")
        toxic = i % 5 == 0
        for _ in range(len(w) // 12 + 1 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0), int(toxic)))
    return rows, labels


def test_chain_has_held_out_accuracy(spark):
    rows, labels = labelled(0, 900)
    docs = frame(spark, rows)
    known = spark.createDataFrame([*labels[:600], (None, 1, 1), (3, None, 1), (0, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train_chain(docs, known, ["quality", "toxic"])
    assert len(chain[1]) == len(chain[0]) + 1  # the second link sees the first
    got = {r.doc_id: r.rejected for r in toxicity.score_texts(docs, chain, ["quality", "toxic"]).collect()}
    wrong = sum(got[i] != (i % 5 == 0) for i in range(600, 900))
    assert wrong <= 6


def test_scores_of_odd_rows(spark, odd, empty):
    chain = toxicity.train_chain(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"), ["quality", "toxic"])
    got = toxicity.score_texts(odd.withColumn("rejected", F.lit("x")), chain, ["quality", "toxic"])
    assert got.count() == odd.count() and not got.where("rejected").count()
    assert toxicity.score_texts(empty, chain, ["quality", "toxic"]).count() == 0


def test_features_count_each_text_alone():
    import pyarrow as pa

    index, value, edge = toxicity.features(pa.array(["a b b", None, "", "A"]))
    assert np.diff(edge).tolist() == [2, 0, 0, 1] and index[2] in index[:2]
    index, _, edge = toxicity.features(pa.array(["running", "runnable", "runs"]))
    assert np.diff(edge).tolist() == [3, 3, 1]  # itself, "runn" and "runni"; "runn" and "runna"
    assert len(set(index[:3]) & set(index[3:6])) == 1


def test_training_rows_take_eight_bytes_a_word(spark, monkeypatch):
    rows, labels = labelled(1, 60)
    held, write = {}, toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, name, **options: held.setdefault(name, write(df, name, **options)))
    toxicity.train_chain(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ["quality", "toxic"])
    kinds = dict(held["sample"].dtypes)
    assert (kinds["index"], kinds["value"]) == ("array<int>", "array<float>")


def test_training_copies_only_the_words_that_count():
    """Of the rows of a fold, words that LEAST texts share are copied once; weights are those over all words."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, n)) * 7 if i % 9 else np.zeros(0, np.int64) for i, n in enumerate(rng.integers(1, 12, 90))]
    batch = lambda part: pa.record_batch({"index": pa.array(part, pa.list_(pa.int32())), "value": pa.array([np.ones(len(x)) + x / 9 for x in part], pa.list_(pa.float32()))})
    part = pa.Table.from_batches([batch(rows[:40]), batch(rows[40:]).slice(0)])
    mine = rng.random(90) < 0.6
    index, value, edge = toxicity.training_words(part, mine)
    texts = np.bincount(np.concatenate([x for x, m in zip(rows, mine, strict=True) if m]), minlength=1 << toxicity.BITS)
    want = [[i for i in x if texts[i] >= toxicity.LEAST] for x, m in zip(rows, mine, strict=True) if m]
    assert [index[i:j].tolist() for i, j in zip(edge, edge[1:], strict=False)] == want and 0 < len(index) < texts.sum()
    y = rng.integers(0, 2, len(want)).astype(float)
    whole = [x for x, m in zip(rows, mine, strict=True) if m]
    flat = np.concatenate(whole)
    all_ = toxicity.fit(flat, np.float32(1 + flat / 9), np.concatenate([[0], np.cumsum([len(x) for x in whole])]), np.zeros((len(y), 0)), y)
    assert np.array_equal(all_, toxicity.fit(index, value, edge, np.zeros((len(y), 0)), y))


def test_training_frees_what_tokenizing_kept():
    from larder.llm import tokens

    tokens.worker_encoder(tokens.tokenizer_path("word_bpe_49k.json"))
    part = pa.table({"doc_id": pa.array([1], pa.int64()), "y_toxic": [1.0], "fold": pa.array([0], pa.int32()), "index": pa.array([[1]], pa.list_(pa.int32())), "value": pa.array([[1.0]], pa.list_(pa.float32()))})
    toxicity.link_trainer("toxic", [])((pa.scalar(toxicity.FOLDS),), part)
    assert tokens.worker_encoder.cache_info().currsize == 0
