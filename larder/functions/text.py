"""Text columns: clean fragments of pages, slugs, keys, hashes and bounded texts."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from html.entities import html5
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in page text besides ASCII's: no-break, zero-width and direction characters, byte order mark.
BLANK = r"[\s  -   　​‎‏﻿]+"
NON_ASCII = r"[^\x00-\x7f]"


def _mapped(f: Callable[[str], str], text: Column) -> Column:
    """f of each text, in Arrow batches; nulls stay."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return F.pandas_udf(each, "string")(text)


def nfkd(text: Column) -> Column:
    """Compatibility decomposition; only texts beyond ASCII go to Python, all others are null there."""
    return F.coalesce(_mapped(lambda t: unicodedata.normalize("NFKD", t), F.when(text.rlike(NON_ASCII), text)), text)


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(text: str) -> str:
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def unescaped(text: Column, closed: bool = False) -> Column:
    """Character references decoded, closed: only those that a semicolon ends; only texts with an ampersand go to Python."""
    return F.coalesce(_mapped(_closed if closed else html.unescape, F.when(F.contains(text, F.lit("&")), text)), text)


def fold_accents(text: Column) -> Column:
    return F.regexp_replace(nfkd(text), r"\p{M}+", "")


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BLANK, " "), "^ | $", "")


def strip_html(text: Column, closed: bool = False) -> Column:
    """Text without markup: hidden elements go, block tags break lines, references (see unescaped) are decoded last, so none becomes a tag."""
    out = F.regexp_replace(text, r"(?is)<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|ol|tr|h[1-6]|section|article)\b[^>]*>", "\n")
    return unescaped(F.regexp_replace(out, "<[^>]*>", " "), closed)


def clean_text(text: Column, closed: bool = False) -> Column:
    """strip_html on one line; null gives an empty text."""
    return collapse_blanks(strip_html(F.coalesce(text, F.lit("")), closed))


def clean_or_null(text: Column) -> Column:
    return F.nullif(clean_text(text), F.lit(""))


def title_slug(title: Column, length: int = 200) -> Column:
    """Words of a title joined by dashes, accents and apostrophes dropped, cut between words."""
    s = F.lower(F.regexp_replace(nfkd(title), "[\\u0300-\\u036f]", ""))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "['\\u2019]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.regexp_replace(F.substring(s, 1, length), "-+[^-]*$", ""), "-+$", "")
    return F.when(F.length(s) <= length, s).otherwise(cut)


def stable_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON, by name, nulls kept, so that only equal contents have equal hashes."""
    named = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def bounded_text(text: Column, most: int) -> Column:
    """On one line, with an ellipsis where it is cut."""
    t = collapse_blanks(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.rtrim(F.substring(text, 1, most)))


def join_url(href: str | None, base: str | None) -> str | None:
    """href against base; null for what is no URL of a host or has no base."""
    href = (href or "").strip()
    try:
        out = urljoin(base or "", href) if href else ""
        parts = urlsplit(out)
        _ = parts.port
    except ValueError:
        return None
    if not parts.scheme or (parts.scheme in ("http", "https") and not parts.hostname):
        return None
    return out if parts.path or parts.scheme not in ("http", "https") else f"{parts.scheme}://{parts.netloc}/{'?' + parts.query if parts.query else ''}"


def absolute_url(href: Column, base: Column) -> Column:
    def each(hrefs: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([join_url(h, b) for h, b in zip(hrefs, bases, strict=True)])

    return F.pandas_udf(each, "string")(href, base)


def image_name(url: Column) -> Column:
    return F.concat(F.sha2(url, 256), F.lit(".webp"))


def is_image_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[0-9a-f]{64}\.webp$"), F.lit(False))


def without_inline_assets(page: Column) -> Column:
    """A page whose styles, and scripts other than structured data, are empty."""
    out = F.regexp_replace(page, r"(?is)<script((?![^>]*ld\+json)[^>]*)>.*?</script>", "<script$1></script>")
    return F.regexp_replace(out, r"(?is)<style([^>]*)>.*?</style>", "<style$1></style>")


def in_words(parts: list[str]) -> str:
    """a, a and b, a, b and c."""
    return parts[0] if len(parts) == 1 else f"{', '.join(parts[:-1])} and {parts[-1]}" if parts else ""


def fingerprint(text: str) -> str:
    """FNV-1a of 32 bits over UTF-16 units, in hex: tells when a vocabulary has changed."""
    h = 0x811C9DC5
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[i : i + 2], "little")) * 0x01000193 & 0xFFFFFFFF
    return f"{h:08x}"


def fingerprint_of(text: Column) -> Column:
    """fingerprint of each text; null for null."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16LE")), F.lit("(....)"), 1)
    number = lambda u: F.conv(F.concat(F.substring(u, 3, 2), F.substring(u, 1, 2)), 16, 10).cast("long")
    h = F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, u: (h.bitwiseXOR(number(u)) * 0x01000193).bitwiseAND(0xFFFFFFFF))
    return F.lower(F.lpad(F.hex(h), 8, "0"))
