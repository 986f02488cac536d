"""The written index of aliases finds what similar_names finds, after each of ten additions."""

import random

from larder.operators import matcher
from larder.operators.name_index import NameIndex


def test_ten_deltas(spark, tmp_path):
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("abcé") for _ in range(pick.randint(1, 6)))
    name = lambda: " ".join(word() for _ in range(pick.randint(1, 3)))
    some = lambda n: [(name(), pick.randint(1, 9)) for _ in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "alias string, ingredient_id long")
    aliases = [*some(60), (None, 1), ("", 2), ("--", 3)]
    names = spark.createDataFrame([(name(),) for _ in range(60)] + [(a,) for a, _ in aliases[:20]] + [(None,), ("",)], "name string")
    index = NameIndex(spark, f"file://{tmp_path}/index")
    index.build(frame(aliases), threshold=0.4)
    most = 1
    for size in (2, 0, 9, 4, 30, 3, 1, 5, 8, 20):
        more = some(size) + aliases[:1]
        aliases += more
        index.add(frame(more))
        want = sorted(map(tuple, matcher.similar_names(names, frame(aliases), 0.4).collect()))
        assert sorted(map(tuple, index.find(names).collect())) == want and want
        sizes = index.sizes()
        assert all(2 * b < a for a, b in zip(sizes, sizes[1:], strict=False))
        most = max(most, len(sizes))
    assert most > 1


def test_empty_index(spark, tmp_path):
    index = NameIndex(spark, f"file://{tmp_path}/index")
    none = spark.createDataFrame([], "alias string, ingredient_id long")
    index.build(none)
    index.add(none)
    assert index.find(spark.createDataFrame([("salt",)], "name string")).isEmpty()
    index.add(spark.createDataFrame([("salt", 1)], none.schema))
    assert [tuple(r) for r in index.find(spark.createDataFrame([("Salt",)], "name string")).collect()] == [("Salt", "salt", 1, 1.0)]
