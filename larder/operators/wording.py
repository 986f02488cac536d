"""Searches in words: repairs of a parsed filter, plain text as a filter, and what a search has to admit, in sentences."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from larder.functions.stem import STOP_WORDS
from larder.functions.text import fingerprint, in_words
from larder.operators.search import Filter
from larder.vocab import CATEGORIES, TAGS

# Tags that stand for minutes, and words that name a meal and tell nothing of it.
TIME_TAGS = {"10 minutes": 10, "30 minutes": 30, "Under 20 min": 20}
EMPTY_TERMS = (
    "anything", "dinner", "dinners", "dish", "dishes", "fast", "food", "foods", "leftovers", "lunch", "lunches", "meal", "meals", "quick", "recipe", "recipes",
    "something", "supper", "weeknight",
)
#: Fields of a filter and kinds of notices, in the order in which they are told.
NOTICES = ("degraded", "rules-bypassed", "terms-union", "relaxed")
VOCABULARY = f"2-{fingerprint('categories:' + '|'.join(CATEGORIES) + chr(10) + 'tags:' + '|'.join(TAGS))}"


def repair(f: Filter) -> tuple[Filter, tuple[str, ...]]:
    """The filter without words that tell nothing and without contradictions, and the time tags that became a bound.

    In this order: empty terms go, one "any" tag is a required tag, an excluded ingredient is not asked for as well, one
    "any" ingredient is a required one, and time tags become the loosest of their bounds where there is none.
    """
    f = replace(f, terms=tuple(t for t in f.terms if t.strip().lower() not in EMPTY_TERMS))
    if len(f.any_tags) == 1:
        f = replace(f, tags=f.tags + f.any_tags, any_tags=())
    f = replace(f, ingredients=tuple(i for i in f.ingredients if i not in f.exclude_ingredients), any_ingredients=tuple(i for i in f.any_ingredients if i not in f.exclude_ingredients))
    if len(f.any_ingredients) == 1:
        f = replace(f, ingredients=f.ingredients + f.any_ingredients, any_ingredients=())
    timed = tuple(dict.fromkeys(t for t in f.tags + f.any_tags if t in TIME_TAGS))
    if timed:
        most = f.max_minutes if f.max_minutes is not None else max(TIME_TAGS[t] for t in timed)
        f = replace(f, max_minutes=most, tags=tuple(t for t in f.tags if t not in TIME_TAGS), any_tags=tuple(t for t in f.any_tags if t not in TIME_TAGS))
    return f, timed


def text_filter(query: str) -> Filter:
    """The first six telling words of a query as terms: three letters or more, no stop words, none that names the meal."""
    words = dict.fromkeys(w for w in re.split(r"[^\w'-]+|_", query.lower()) if 3 <= len(w) <= 60)
    terms = [w for w in words if any(p and p not in STOP_WORDS for p in re.split(r"[\W_]+", w))][:6]
    return repair(Filter(terms=tuple(terms)))[0]


@dataclass(frozen=True)
class Notice:
    kind: str
    about: tuple = ()


def notices(bypassed_rules: list[str], degraded: bool, union_terms: list[str], relaxations: list[tuple]) -> list[Notice]:
    """What a search has to admit, the gravest first."""
    facts = {"degraded": () if not degraded else (True,), "rules-bypassed": tuple(bypassed_rules), "terms-union": tuple(union_terms), "relaxed": tuple(relaxations)}
    return [Notice(k, facts[k]) for k in NOTICES if facts[k]]


def _quoted(words) -> str:
    return in_words([f"“{w}”" for w in words])


# What a relaxed search changed, by field.
WIDENED = {
    "max_minutes": "the time limit is {to} minutes, not {was}",
    "min_minutes": "the least time is {to} minutes, not {was}",
    "max_active_minutes": "the limit of active time is {to} minutes, not {was}",
}
DROPPED = {
    "min_keeps_days": "how long a dish keeps doesn't count",
    "freezer_only": "dishes need not freeze",
    "min_servings": "portions don't count",
    "any_tags": "alternative tags don't count",
    "tags": "tags are not required",
    "categories": "all categories are shown",
}


def describe(notice: Notice) -> str:
    """A notice as a sentence."""
    if notice.kind == "degraded":
        return "The search was read word by word, since it could not be understood as a whole."
    if notice.kind == "rules-bypassed":
        return f"Your {'rule' if len(notice.about) == 1 else 'rules'} {_quoted(notice.about)} {'is' if len(notice.about) == 1 else 'are'} off for this search."
    if notice.kind == "terms-union":
        return f"No dish has {_quoted(notice.about)} together, so one of them is enough."
    shown = [WIDENED[r[0]].format(was=r[2], to=r[3]) if r[1] == "widened" else DROPPED[r[0]] for r in notice.about]
    return f"No dish fits the whole search, so these are wider: {'; '.join(shown)}."


def describe_rule(rule: dict) -> str:
    kind, value = rule["kind"], rule["value"]
    return f"At most {value} minutes" if kind == "max_minutes" else f"No dishes of the category {value}" if kind == "exclude_category" else f"No dishes with the tag “{value}”"


def short_rule(rule: dict) -> str:
    kind, value = rule["kind"], rule["value"]
    return f"up to {value} min" if kind == "max_minutes" else f"not {value}"


def explain_rule(rule: dict) -> str:
    n = rule["observations"]
    return f"Median of {n} {'rating' if n == 1 else 'ratings'} here: {rule['median_rating']:g} of 5"
