"""Lexemes of English text: words without stop words, in the stems of the published Snowball algorithm for English."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of Snowball.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her",
    "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
# Fixed values of the algorithm: words with stems of their own, words that end early, endings by step.
OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EARLY = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able",
    "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_VOWEL = "[aeiouy]"
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_SHORT = re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if first is None:
        m = _REGION.search(w)
        first = m.end() if m else len(w)
    m = _REGION.search(w, first)
    return first, m.end() if m else len(w)


def _ending(w: str, endings) -> str:
    return next((e for e in endings if w.endswith(e)), "")


@cache
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2 or word in OWN:
        return OWN.get(word, word)
    w = word.replace("’", "'").removeprefix("'")
    w = re.sub(r"(?<=[aeiouy])y|^y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in EARLY:
        return w
    e = _ending(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if e in ("eed", "eedly"):
        w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
    elif e and re.search(_VOWEL, w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif _SHORT.search(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    e = _ending(w, STEP2)
    if e and len(w) - len(e) >= r1 and (e != "ogi" or w.endswith("logi")) and (e != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(e)] + STEP2[e]
    e = _ending(w, STEP3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + STEP3[e]
    e = _ending(w, STEP4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: list(dict.fromkeys(map(stem, ws))) if isinstance(ws, (list, np.ndarray)) else None)


def plain_words(text: Column) -> Column:
    """Lower-case words of a text, stop words left out."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def lexemes(text: Column) -> Column:
    """The distinct stems of a text's words; null for null."""
    return F.pandas_udf(_stems, "array<string>")(F.when(text.isNotNull(), plain_words(text)))


def query_lexemes(term: str) -> list[str]:
    """A term's lexemes, on the driver; a term of stop words has none, and so matches nothing."""
    return list(dict.fromkeys(stem(w) for w in re.split(r"[^\w]+|_", term.lower()) if w and w not in STOP_WORDS))
