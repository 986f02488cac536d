"""Counts that follow changes equal those counted anew, after each of several random changes."""

import random

from larder.operators import browse, kept_counts

DISH, LINE = "dish_id long, status string", "dish_id long, position long, ingredient_id long"


def test_follow_random_changes(spark):
    pick = random.Random(8)
    status = lambda: pick.choice(["active", "pending", "rejected", None])
    goods = spark.createDataFrame([(i, f"g{i % 9}") for i in range(12)], "ingredient_id long, name string")
    dishes = {d: status() for d in range(30)}
    lines = {(d, p): pick.choice([*range(12), None]) for d in range(33) for p in range(pick.randint(0, 4))}
    frames = lambda: (spark.createDataFrame(list(dishes.items()), DISH), spark.createDataFrame([(*k, v) for k, v in lines.items()], LINE))
    was = frames()
    kept, left = kept_counts.uses(*was), kept_counts.left(*was)
    for _ in range(4):
        for d in pick.sample(range(40), 8):
            if d in dishes and pick.random() < 0.3:
                del dishes[d]
            else:
                dishes[d] = status()
        for _ in range(15):
            k = (pick.randrange(40), pick.randrange(4))
            if pick.random() < 0.4:
                lines.pop(k, None)
            else:
                lines[k] = pick.choice([*range(12), None])
        now = frames()
        dish_changes = kept_counts.signed(was[0], now[0], ["dish_id", "status"])
        line_changes = kept_counts.signed(was[1], now[1], ["dish_id", "ingredient_id"])
        kept = kept_counts.change_uses(kept, *was, dish_changes, line_changes)
        left = kept_counts.change_left(left, dish_changes, line_changes)
        got, want = sorted(map(tuple, kept.collect())), sorted(map(tuple, kept_counts.uses(*now).collect()))
        assert got == want
        assert sorted(map(tuple, kept_counts.vocabulary(kept, goods).collect())) == sorted(map(tuple, browse.vocabulary(*now, goods).collect()))
        assert tuple(left.first()) == tuple(browse.remaining(*now).first())
        kept = spark.createDataFrame(got, kept.schema)
        left = spark.createDataFrame(left.collect(), left.schema)
        was = now
    empty = was[0].limit(0), was[1].limit(0)
    assert tuple(kept_counts.left(*empty).first()) == (0, 0) and kept_counts.uses(*empty).isEmpty()
