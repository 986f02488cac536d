"""Each stage of the pipeline against plain Python on its own input."""

import importlib

import pytest
from pyspark.sql import functions as F

from .test_joins import ORACLES, brute_components, oracle
from .test_packing_and_files import check_packed

corpus_pipeline = importlib.import_module("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage over a whole small set of tables."""
    import random

    from .conftest import corpus, sentence

    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(5)
    rows = [(i, t) for i, t in corpus(7, 80) if t is not None or i]
    items = [" ".join(rows[3][1].split()[:18]), sentence(rng, 20)]
    toxic = [(1000 + i, " ".join(rng.choice(["zorkbad", "vilebad", *sentence(rng, 4).split()]) for _ in range(40))) for i in range(20)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + toxic], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in rows[:60] + toxic[:14]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(folder))
        out.write.parquet(f"{folder}/{k}")
        seen.append((name, docs, spark.read.parquet(f"{folder}/{k}")))
        docs = seen[-1][2]
    return str(folder), seen, items


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(stages):
    _, seen, _ = stages
    assert [n for n, _, _ in seen] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    assert all(out.columns == COLUMNS for _, _, out in seen[:-1])


def test_toxic_documents_go_and_clean_ones_stay(stages):
    _, seen, _ = stages
    assert {r.doc_id for r in seen[0][1].collect()} - {r.doc_id for r in seen[0][2].collect()} == set(range(1000, 1020))


def test_lines(stages):
    _, seen, _ = stages
    want = oracle(ORACLES["lines"], documents=pairs(seen[1][1])).select("doc_id, text").fetchall()
    assert sorted(pairs(seen[1][2])) == sorted(want) if all(t is not None for _, t in want) else set(pairs(seen[1][2])) == set(want)


def test_near_duplicates(stages):
    _, seen, _ = stages
    want = brute_components(pairs(seen[2][1]))
    assert {r.doc_id for r in seen[2][2].collect()} == {d for d, (_, c) in want.items() if c == d}


def test_benchmark(stages):
    _, seen, items = stages
    found = oracle(ORACLES["benchmark"], documents=pairs(seen[3][1]), benchmark=list(enumerate(items))).fetchall()
    gone = {r.doc_id for r in seen[3][1].collect()} - {r.doc_id for r in seen[3][2].collect()}
    assert gone == {r[0] for r in found} and gone


def test_packing(stages, spark):
    folder, seen, _ = stages
    check_packed(seen[4][2].collect(), pairs(seen[4][1]), 4096)
    assert corpus_pipeline.run(spark, folder).agg(F.sum("length")).first() == seen[4][2].agg(F.sum("length")).first()


def write_tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "no such words in any of them"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_rows_and_clashing_columns_pass_through_all_stages(spark, odd, tmp_path):
    write_tables(spark, tmp_path, odd)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == odd.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()} and len([r for r in packed if r.piece == 0]) == docs.count()
    assert docs.where("text IS NULL").count() == odd.where("text IS NULL").count()


def test_an_empty_corpus_gives_no_sequences(spark, empty, tmp_path):
    write_tables(spark, tmp_path, empty)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
