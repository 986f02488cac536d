"""A search from its words to its answer: the filter that they mean, the dishes that it finds, and what has to be admitted."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from larder.operators.search import Filter, search
from larder.operators.wording import Notice, describe, notices, repair, short_rule, text_filter


class BudgetSpent(Exception):
    """Raised by a reader of queries that may not be asked any more; the search is refused, not degraded."""


#: Reads a query: the words and the user's profile (or none) to a filter. Any failure but BudgetSpent degrades the search to its words.
Reader = Callable[[str, str | None], Filter]


@dataclass
class Reply:
    """filter is what was searched in the end; rows are ranked against what was asked at first."""

    query: str
    filter: Filter
    rows: DataFrame
    notices: list[Notice]
    repaired: tuple[str, ...] = ()

    def sentences(self) -> list[str]:
        return [describe(n) for n in self.notices]


def ask(query: str, dishes: DataFrame, lines: DataFrame, read: Reader | None = None, rules: Iterable[dict] = (), profile: str | None = None, available: bool = True, order: list[Column] | None = None, limit: int | None = None) -> Reply | None:
    """The reply to one query, or None if searching is refused: not available, or the reader's budget is spent on the way.

    A query is read by `read`; without one, or if it fails, its telling words are looked for, which is admitted. A user's
    enabled rules (dicts of kind, value and enabled) don't filter searches; they are named as bypassed. dishes needs
    lexemes, see search.with_lexemes.
    """
    if not query.strip():
        raise ValueError("an empty query")
    if not available:
        return None
    repaired: tuple[str, ...] = ()
    try:
        if read is None:
            raise LookupError("nothing reads queries")
        wanted, repaired = repair(read(query, profile))
        degraded = False
    except BudgetSpent:
        return None
    except Exception:  # whatever the reader does, a reasonable sentence gets an answer
        wanted, degraded = text_filter(query), True
    found = search(dishes, lines, wanted, order, limit)
    bypassed = [short_rule(r) for r in rules if r["enabled"]]
    return Reply(query, found.filter, found.rows, notices(bypassed, degraded, list(wanted.terms) if found.terms_union else [], found.relaxations), repaired)
