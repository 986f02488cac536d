"""Rules kept up to date: histograms of ratings that merge, and rules of those users only whom a change touches.

A histogram has the number of each rating of a user, kind and value. Batches of cooks, given or taken back, add up in any
order and any grouping, and the median comes from the merged bins, so what is kept equals what a batch over all cooks
would derive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.rules import observations, rules_of

KEY, BINS = ["user_id", "kind", "value"], [f"n{r}" for r in range(1, 6)]


def histograms(cooked: DataFrame, sign: int = 1) -> DataFrame:
    """user_id, kind, value and n1 to n5 of cooks (see observations); sign -1 takes them back. Cooks without a rating from 1 to 5 count nowhere."""
    counts = [(F.count_if(F.col("rating") == r) * sign).alias(n) for r, n in enumerate(BINS, 1)]
    return observations(cooked).where(F.col("rating").between(1, 5)).groupBy(*KEY).agg(*counts)


def merge(*parts: DataFrame) -> DataFrame:
    """The sum of histograms; those with nothing left are dropped."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*KEY).agg(*(F.sum(n).alias(n) for n in BINS)).where(" OR ".join(f"{n} != 0" for n in BINS))


def _at(place: Column) -> Column:
    """The rating at a place (from 1) of all ratings in order."""
    out, below = F.lit(None).cast("double"), F.lit(0)
    whens = None
    for r, n in enumerate(BINS, 1):
        below = below + F.col(n)
        whens = F.when(place <= below, float(r)) if whens is None else whens.when(place <= below, float(r))
    return whens.otherwise(out)


def median(total: Column) -> Column:
    return (_at(F.floor((total + 1) / 2)) + _at(F.floor((total + 2) / 2))) / 2


def rules_from(kept: DataFrame) -> DataFrame:
    """The rules of histograms, as derive_rules gives them of all observations."""
    total = sum((F.col(n) for n in BINS[1:]), F.col(BINS[0]))
    return rules_of(kept.select(*KEY, total.alias("observations"), median(total).alias("m")))


def update(kept: DataFrame, rules: DataFrame, given: DataFrame, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The histograms and derived rules after cooks were given and taken back; users without a change keep their rules as they are."""
    change = merge(histograms(given), histograms(taken, -1)) if taken is not None else histograms(given)
    touched = change.select("user_id").distinct()
    now = merge(kept, change)
    return now, rules.join(touched, "user_id", "left_anti").unionByName(rules_from(now.join(touched, "user_id", "left_semi")))
