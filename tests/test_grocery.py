"""The shopping list against a plain Python model, and the authored cases."""

import random

import pytest
from pyspark.sql import functions as F

from larder.functions import fmt, units
from larder.operators import grocery
from larder.vocab import AISLES

LINE = "dish_id long, position int, raw_text string, ingredient_id long, qty double, unit string, optional boolean"
PICK = "list_id long, dish_id long, batches double, saved_at int"


def normal(unit):
    if unit is None:
        return "each"
    t = unit.strip()
    for u, names in units.CASED.items():
        if t in names:
            return u
    k = " ".join(t.lower().rstrip(".").split())
    return next((u for u, names in units.SPELLINGS.items() if k in names), None)


def factor(unit):
    return units.FACTOR[unit]


def model(picks, dishes, lines, ingredients):
    """list_id -> [(name, aisle, qty, unit, approximate, optional, titles)] in order."""
    out = {}
    for list_id in sorted({p[0] for p in picks}):
        buckets, seq = {}, 0
        for _, dish, batches, _ in sorted((p for p in picks if p[0] == list_id), key=lambda p: (p[3], p[1])):
            if dish not in dishes:
                continue
            times = max(1, min(4, int((1 if batches is None else batches) + 0.5)))
            for _, _, raw, ing, qty, unit, optional in sorted((x for x in lines if x[0] == dish), key=lambda x: x[1]):
                u = normal(unit)
                identity = f"i{ing}" if ing is not None else "r" + "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in raw.lower()).split())
                dim = "?" if qty is None else "unit:" + unit.strip().lower() if u is None else u if units.DIMENSION[u] == "count" else units.DIMENSION[u]
                name, aisle = ingredients.get(ing, (None, None))
                b = buckets.setdefault((identity, dim), {"name": (name or "").strip() or raw.strip(), "aisle": aisle if aisle in AISLES else AISLES[-1], "amounts": [], "approximate": False, "optional": True, "titles": [], "ord": seq})
                seq += 1
                b["approximate"] |= qty is None
                b["optional"] &= bool(optional)
                b["titles"] += [dishes[dish]] if dishes[dish] not in b["titles"] else []
                if qty is not None:
                    b["amounts"].append((qty * times, u, unit))
        for (identity, dim), b in list(buckets.items()):
            hosts = [o for (i, d), o in buckets.items() if i == identity and o["amounts"]]
            if dim == "?" and hosts:
                host = min(hosts, key=lambda o: o["ord"])
                host["approximate"] = True
                host["optional"] &= b["optional"]
                host["titles"] += [t for t in b["titles"] if t not in host["titles"]]
                del buckets[identity, dim]
        items = []
        for b in buckets.values():
            qty = unit = None
            if b["amounts"]:
                used = list(dict.fromkeys(u for _, u, _ in b["amounts"]))
                if used[0] is None:
                    qty, unit = sum(q for q, _, _ in b["amounts"]), b["amounts"][0][2]
                else:
                    made = [(sum(q * factor(v) / factor(u) if v != u else q for q, v, _ in b["amounts"]), -sum(v == u for _, v, _ in b["amounts"]), i, u) for i, u in enumerate(used)]
                    big = [m for m in made if m[0] >= 1]
                    qty, _, _, unit = min(big) if big else min((-t, n, i, u) for t, n, i, u in made)
                    qty = abs(qty)
            items.append((b["name"], b["aisle"], qty, unit, b["approximate"] or qty is None, b["optional"], b["titles"], b["ord"]))
        items.sort(key=lambda x: (AISLES.index(x[1]), x[0].lower(), x[7]))
        out[list_id] = [x[:7] for x in items]
    return out


def frames(spark, picks, dishes, lines, ingredients):
    return (
        spark.createDataFrame(picks, PICK),
        spark.createDataFrame(list(dishes.items()), "dish_id long, title string"),
        spark.createDataFrame(lines, LINE),
        spark.createDataFrame([(i, n, a) for i, (n, a) in ingredients.items()], "ingredient_id long, name string, aisle string"),
    )


def listed(spark, *tables):
    out = {}
    for r in grocery.grocery_list(*frames(spark, *tables)).orderBy("list_id", "place").collect():
        out.setdefault(r.list_id, []).append((r.name, r.aisle, r.qty, r.unit, r.approximate, r.optional, r.titles))
    return out


def test_against_model(spark):
    rng = random.Random(1)
    ingredients = {i: (rng.choice(["Apple", "banana", "Dill", "oats", None, " "]), rng.choice([*AISLES, None, "Nowhere"])) for i in range(12)}
    dishes = {i: f"dish {i % 17}" for i in range(20)}
    spellings = ["lb", "oz", "Tbsp.", "T", "t", "cups", "can", "cans", "smidgen", None, "fluid  ounces", "kg", " each "]
    lines = [(d, p, f" Line {rng.randrange(9)}! ", rng.choice([None, *range(12)]), rng.choice([None, rng.randint(1, 30) / 8]), rng.choice(spellings), rng.choice([True, False, None])) for d in range(20) for p in range(rng.randint(0, 8))]
    picks = [(x, d, rng.choice([None, 0.4, 1.0, 2.5, 9.0]), rng.randrange(5)) for x in range(6) for d in rng.sample(range(25), 8)]
    got, want = listed(spark, picks, dishes, lines, ingredients), model(picks, dishes, lines, ingredients)
    assert got.keys() == want.keys()
    for k in got:
        assert [(x[0], x[1], x[3:]) for x in got[k]] == [(x[0], x[1], x[3:]) for x in want[k]]
        assert [x[2] for x in got[k]] == pytest.approx([x[2] for x in want[k]])


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ([(1.0, "lb"), (8.0, "oz")], [(1.5, "lb", "1½ lb", False)]),
        ([(2.0, "cans"), (14.0, "oz")], [(2.0, "can", "2 cans", False), (14.0, "oz", "14 oz", False)]),
        ([(None, "to taste"), (1.0, "tsp")], [(1.0, "tsp", "1 tsp", True)]),
        ([(None, None)], [(None, None, "", True)]),
    ],
)
def test_authored_cases(spark, lines, want):
    rows = [(1, i, "salt", 7, q, u, False) for i, (q, u) in enumerate(lines)]
    got = grocery.grocery_list(*frames(spark, [(1, 1, 1.0, 0)], {1: "d"}, rows, {7: ("salt", "Spices")})).orderBy("place").collect()
    assert [(r.qty, r.unit, r.amount, r.approximate) for r in got] == want


def test_list_text(spark):
    items = grocery.grocery_list(*frames(spark, [(1, 1, 1.0, 0)], {1: "d"}, [(1, 0, "x", 7, 2.0, "cups", False), (1, 1, "y", None, None, None, False)], {7: ("oats", "Pantry")}))
    assert grocery.list_text(items).first().text == "PANTRY\n[ ] oats  2 cup\n\nOTHER\n[ ] y"


def test_units_and_formats(spark):
    rows = [("T", "tbsp"), ("t", "tsp"), ("2", None), ("Tbsp.", "tbsp"), (None, "each"), ("", "each"), ("smidgen", None), (" Fluid   Ounces. ", "fl oz")]
    got = spark.createDataFrame(rows, "u string, want string").select(units.normalize_unit(F.col("u")).alias("n"), "want").collect()
    assert all(r.n == r.want for r in got)
    amounts = [(0.125, "⅛"), (1.5, "1½"), (2 / 3, "⅔"), (2.0, "2"), (0.9, "0.9"), (1.999, "2"), (10.05, "10.05"), (0.005, "0")]
    got = spark.createDataFrame(amounts, "q double, want string").select(fmt.fmt_qty(F.col("q")).alias("t"), "want").collect()
    assert [r.t for r in got] == [r.want for r in got]
