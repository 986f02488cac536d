"""Ingredient lines: free text into quantity, unit, name and notes, and names that may stand for the same thing.

parse_lines works in steps, each a regular expression or a look-up, so no line leaves the JVM but those with character
references.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.fmt import alias_key
from larder.functions.text import clean_text, fold_accents
from larder.functions.units import lookup, normalize_unit

# Fraction characters, measures that are never converted, words before a measure, notes at the end of a name.
FRACTIONS = {"⅛": 1 / 8, "¼": 1 / 4, "⅓": 1 / 3, "⅜": 3 / 8, "½": 1 / 2, "⅝": 5 / 8, "⅔": 2 / 3, "¾": 3 / 4, "⅞": 7 / 8}
MEASURES = (
    "bag", "bags", "bottle", "bottles", "box", "boxes", "dash", "dashes", "envelope", "envelopes", "filet", "filets", "fillet", "fillets", "jar", "jars",
    "package", "packages", "packet", "packets", "pinch", "pinches", "sheet", "sheets", "sprig", "sprigs", "stick", "sticks",
)
MODIFIERS = ("full", "heaping", "level", "packed", "rounded", "scant")
SUFFIX = r"(?i)\s+(to taste|as needed|until desired consistency|for (?:serving|garnish|frying|drizzling))\s*$"
OPTIONAL = r"(?i)\boptional(?:ly)?\b"

# How amounts are written.
_GLYPHS = "".join(FRACTIONS)
_ATOM = rf"(?:\d+\s+\d+/\d+|\d*\s*[{_GLYPHS}]|\d+/\d+|\d+(?:\.\d+)?)"
_QUANTITY = rf"(?i)^({_ATOM})(?:\s*(?:-|–|—|to)\s*{_ATOM})?(?=\s|[^\d./]|$)"


def _balanced(depth: int) -> str:
    return r"\([^()]*+\)" if depth == 1 else rf"\((?:[^()]|{_balanced(depth - 1)})*+\)"


#: A group in parentheses, nested up to four deep; deeper ones count as unbalanced.
_GROUP = _balanced(4)


def _tidy(text: Column) -> Column:
    """One line without separators at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[,;:\s]+|[,;:\s]+$", "")


def _inner(groups: Column) -> Column:
    return F.transform(groups, lambda g: F.substring(g, F.lit(2), F.length(g) - 2))


def _amount(atom: Column) -> Column:
    part = lambda p, i: F.regexp_extract(atom, p, i).try_cast("double")
    glyph, mixed, fraction = rf"^(\d*)\s*([{_GLYPHS}])$", r"^(\d+)\s+(\d+)/(\d+)$", r"^(\d+)/(\d+)$"
    value = (
        F.when(atom.rlike(glyph), F.coalesce(part(glyph, 1), F.lit(0.0)) + lookup(FRACTIONS, F.regexp_extract(atom, glyph, 2)))
        .when(atom.rlike(mixed), part(mixed, 1) + F.try_divide(part(mixed, 2), part(mixed, 3)))
        .when(atom.rlike(fraction), F.try_divide(part(fraction, 1), part(fraction, 2)))
        .otherwise(atom.try_cast("double"))
    )
    return F.when(value < float("inf"), value)  # digits beyond what a double holds are no amount


def _measure(words: Column) -> Column:
    """The spelling of a measure, null if words are none."""
    bare = F.regexp_replace(words, r"[.,]+$", "")
    return F.when((words != "") & (normalize_unit(bare).isNotNull() | F.lower(bare).isin(*MEASURES)), bare)


def _words(text: Column, n: int) -> Column:
    """The first n words as they stand; empty if there are fewer."""
    return F.regexp_extract(text, r"^\S+" + r"\s+\S+" * (n - 1), 0)


def _note(n: Column) -> Column:
    return _tidy(F.regexp_replace(F.regexp_replace(F.regexp_replace(n, OPTIONAL, ""), r"\$\d+(?:\.\d+)?\**", ""), r"^\*+|\*+$", ""))


def _bound(state: Column, fields: list[str], name: str, value: Callable[[Column], Column]) -> Column:
    """state, a struct of fields, with the field name made of them.

    The state is the argument of a lambda, so it is computed once however often its fields are used. As columns of
    their own, steps would be put into each other by every filter that is pushed below them.
    """
    kept = [f for f in fields if f != name]
    return F.get(F.transform(F.array(state), lambda s: F.struct(*(s[f].alias(f) for f in kept), value(s).alias(name))), F.lit(0))


def parse_lines(df: DataFrame, column: str = "raw_text", into: str = "parsed") -> DataFrame:
    """df with a struct of qty, unit (as written), name, note and optional; null for lines without text.

    Quantities are numbers, fractions and mixed ones; of a range the lower end counts, and one that is not over zero
    stays in the name. A size in parentheses may stand before the unit; other groups, what follows a comma or
    semicolon, and closing phrases such as "to taste" are notes, each once whatever its case.
    """
    steps: list[tuple[str, Callable[[Column], Column]]] = [
        ("atom", lambda s: F.regexp_extract(s["text"], _QUANTITY, 1)),
        ("qty", lambda s: F.when(s["atom"] != "", _amount(F.trim(s["atom"])))),
        ("qty", lambda s: F.when(s["qty"] > 0, s["qty"])),
        ("rest", lambda s: F.when(s["qty"].isNotNull(), F.ltrim(F.substr(s["text"], F.length(F.regexp_extract(s["text"], _QUANTITY, 0)) + 1))).otherwise(s["text"])),
        ("lead", lambda s: F.regexp_extract(s["rest"], rf"^(?:{_GROUP}\s*+)+", 0)),
        ("rest", lambda s: F.substr(s["rest"], F.length(s["lead"]) + 1)),
        ("word", lambda s: F.regexp_extract(s["rest"], r"^([A-Za-z]+)\s+", 1)),
        ("after", lambda s: F.when(F.lower(s["word"]).isin(*MODIFIERS), F.ltrim(F.substr(s["rest"], F.length(s["word"]) + 1)))),
        ("modified", lambda s: _measure(_words(s["after"], 2)).isNotNull() | _measure(_words(s["after"], 1)).isNotNull()),
        ("rest", lambda s: F.when(s["modified"], s["after"]).otherwise(s["rest"])),
        ("two", lambda s: _measure(_words(s["rest"], 2))),
        ("unit", lambda s: F.coalesce(s["two"], _measure(_words(s["rest"], 1)))),
        ("taken", lambda s: F.when(s["two"].isNotNull(), _words(s["rest"], 2)).when(s["unit"].isNotNull(), _words(s["rest"], 1))),
        ("rest", lambda s: F.when(s["unit"].isNotNull(), F.regexp_replace(F.ltrim(F.substr(s["rest"], F.length(s["taken"]) + 1)), r"(?i)^of\b\s*", "")).otherwise(s["rest"])),
        ("head", lambda s: F.regexp_extract(s["rest"], rf"^(?:[^(]|{_GROUP})*+", 0)),  # up to an unbalanced parenthesis
        ("bare", lambda s: _tidy(F.concat(F.regexp_replace(s["head"], _GROUP, " "), F.substr(s["rest"], F.length(s["head"]) + 1)))),
        ("pieces", lambda s: F.filter(F.transform(F.split(s["bare"], r"\s*[,;]\s*"), lambda x: F.trim(x)), lambda x: x != "")),
        ("first", lambda s: F.coalesce(F.get(s["pieces"], F.lit(0)), s["text"])),
        ("suffix", lambda s: F.regexp_extract(s["first"], SUFFIX, 1)),
        ("name", lambda s: _tidy(F.when(s["suffix"] != "", F.regexp_replace(s["first"], SUFFIX, "")).otherwise(s["first"]))),
        ("notes", lambda s: F.concat(
            _inner(F.regexp_extract_all(s["lead"], F.lit(f"({_GROUP})"))), F.when(s["modified"], F.array(s["word"])).otherwise(F.array().cast("array<string>")),
            _inner(F.regexp_extract_all(s["head"], F.lit(f"({_GROUP})"))), F.slice(s["pieces"], F.lit(2), F.greatest(F.size(s["pieces"]), F.lit(1))), F.array(s["suffix"]),
        )),
        ("notes", lambda s: F.transform(F.flatten(F.transform(s["notes"], lambda n: F.split(n, r"\s*[,;]\s*"))), _note)),
        ("notes", lambda s: F.filter(s["notes"], lambda n: n != "")),
        ("lower", lambda s: F.transform(s["notes"], lambda n: F.lower(n))),
        ("notes", lambda s: F.filter(s["notes"], lambda n, i: F.array_position(s["lower"], F.lower(n)) == i + 1)),
    ]
    state = F.struct(F.col("__larder_text").alias("text"))
    fields = ["text"]
    for name, value in steps:
        state = _bound(state, fields, name, value)
        fields = [*(f for f in fields if f != name), name]
    made = _bound(state, fields, "made", lambda s: F.struct(
        s["qty"].alias("qty"), s["unit"].alias("unit"), F.coalesce(F.nullif(s["name"], F.lit("")), s["text"]).alias("name"),
        F.nullif(F.array_join(s["notes"], "; "), F.lit("")).alias("note"), s["text"].rlike(OPTIONAL).alias("optional"),
    ))["made"]
    rows = df.withColumn("__larder_text", F.nullif(clean_text(F.col(column)), F.lit("")))
    return rows.withColumn(into, F.when(F.col("__larder_text").isNotNull(), made)).drop("__larder_text")


# Words that tell how a thing was bought, cut or written down, not what it is.
HOW = (
    "chopped", "minced", "sliced", "diced", "grated", "shredded", "crushed", "ground", "cut", "trimmed", "peeled", "seeded", "cored", "pitted", "beaten",
    "cooked", "raw", "toasted", "roasted", "softened", "melted", "mashed", "fresh", "freshly", "dried", "frozen", "canned", "jarred", "ripe", "firm",
    "unsalted", "salted", "unsweetened", "sweetened", "low", "sodium", "store", "bought", "homemade", "room", "temperature", "quality", "best", "preferred",
    "favorite", "plain", "regular", "packed", "loosely", "lightly", "roughly", "finely", "coarsely", "thinly", "whole", "halves", "large", "medium", "small",
    "baby", "jumbo", "extra", "plus", "more", "about", "bunch", "head", "piece", "pieces", "leaves", "leaf", "stems", "stem", "sprigs", "sprig", "slab",
    "block", "loaf", "red", "green", "white", "black", "yellow", "purple", "brown", "golden", "a", "an", "the", "of", "or", "and", "to", "for", "as", "such",
    "like", "your", "with", "from", "in", "taste", "garnish", "serving", "optional", "needed", "divided", "other", "any",
)


def singular(word: Column) -> Column:
    return (
        F.when((F.length(word) > 4) & word.endswith("ies"), F.concat(F.regexp_replace(word, "ies$", ""), F.lit("y")))
        .when((F.length(word) > 4) & word.rlike("(?:s|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def identity_words(name: Column) -> Column:
    """The words of a name that say what it is, in the singular; all of them if none does."""
    every = F.transform(F.filter(F.split(fold_accents(F.lower(name)), "[^a-z0-9]+"), lambda w: w != ""), singular)
    telling = F.filter(every, lambda w: ~w.isin(*HOW))
    return F.when(F.size(telling) > 0, telling).otherwise(every)


def plausible_match(name: Column, canonical: Column) -> Column:
    """Whether two names share a word that says what they are; a word of four letters or more may begin the other's."""
    a, b = alias_key(name), alias_key(canonical)
    begins = lambda x, y: (F.length(x) >= 4) & F.startswith(y, x)
    both = F.array(F.struct(identity_words(a).alias("a"), identity_words(b).alias("b")))  # bound once
    shared = F.exists(both, lambda s: F.exists(s["a"], lambda x: F.exists(s["b"], lambda y: (x == y) | begins(x, y) | begins(y, x))))
    return F.when(a == b, True).when((a == "") | (b == ""), False).otherwise(shared)
