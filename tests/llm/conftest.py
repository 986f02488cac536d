import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, h string, rank int, `_x` string, token string, a long, n string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(seed=0, n=60):
    """Random texts, exact and near copies, shared passages and lines, odd rows."""
    rng = random.Random(seed)
    texts = ["\n".join(sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 8))) for _ in range(n)]
    for i in range(0, n, 6):  # near copies
        w = texts[i].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    shared = sentence(rng, 60)
    texts += [f"{sentence(rng, 30)} {shared} {sentence(rng, 25)}" for _ in range(4)]
    lines = "\n".join(sentence(rng, 6) for _ in range(4))
    texts += [f"{sentence(rng, 12)}\n{lines}\n{sentence(rng, 9)}" for _ in range(3)] + [texts[3], texts[3].upper(), texts[5]]
    texts += ["", None, " \n\t ", "one", "two words", "a b c d e", "a b c d e", "x\n\n\n\n\ny", "Ünïcödé ßtraße é ñ 😀 <|endoftext|> 中文 ́x", "same\nsame\nsame\nsame\nsame", " ".join(["loop"] * 5000), "b" * 30000]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "h", 2, "x", "t", 3, "n") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated rows, null and repeated doc_id besides the corpus."""
    return frame(spark, [*rows, rows[0], rows[0], (None, rows[1][1]), (None, None), (2, "another text of the same id"), (None, "nobody has these seven words at all")]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
