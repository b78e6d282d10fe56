"""Text expressions; all JVM-side, and unrolled over lexicons that the caller passes in."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words too common to be keyword tokens.
KEYWORD_STOPWORDS = ("the", "and", "for", "with", "from", "into", "of", "to", "in", "on", "a", "an")
#: Markers of placeholder text.
PLACEHOLDER_MARKERS = ("lorem ipsum dolor sit amet", "consectetur adipiscing elit", "donec neque eros", "in accumsan, ex a ultrices bibendum")
#: Words that tell a page that blocks readers.
BLOCK_WORDS = ("blocked", "forbidden", "captcha", "access denied", "datadome")
#: Fixed value: names after "by".
BYLINE = r"\b[Bb]y\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"


def normalized(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed; null becomes empty."""
    # single spaces, which are most of the white space, are not matched
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\S ]\s*| \s+", " "))


def keyword_tokens(keyword: str, stopwords: Sequence[str] = KEYWORD_STOPWORDS) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", keyword.lower()) if len(t) > 2 and t not in stopwords]


def keyword_tokens_column(c: Column, stopwords: Sequence[str] = KEYWORD_STOPWORDS) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(*stopwords))


def keyword_weight(keyword: str, weights: Mapping[str, float]) -> float:
    return float(weights.get(keyword, 1.0))


def occurrences(c: Column, keyword: str) -> Column:
    """Whole-word occurrences; word characters are Unicode's. The literal leads, as the search then skips ahead by it."""
    k = re.escape(keyword)
    return F.regexp_count(c, F.lit(rf"(?U){k}(?<!\w{k})(?!\w)"))


def combo_bonus(c: Column, combos: Sequence[tuple[Sequence[str], float]]) -> Column:
    total = F.lit(0.0)
    for terms, bonus in combos:
        every = F.lit(True)
        for t in terms:
            every = every & F.contains(c, F.lit(t))
        total = total + F.when(every, float(bonus)).otherwise(0.0)
    return total


def is_placeholder(c: Column, markers: Sequence[str] = PLACEHOLDER_MARKERS) -> Column:
    """At least two markers in the lower-cased text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return sum((F.contains(low, F.lit(m)).cast("int") for m in markers), F.lit(0)) >= 2


def is_block_page(html: Column, words: Sequence[str] = BLOCK_WORDS) -> Column:
    return contains_any(F.lower(F.coalesce(html, F.lit(""))), words)


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(c, F.lit(t))
    return found


def byline(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, BYLINE, 1), F.lit(""))


def byline_variants(c: Column, patterns: Sequence[str], limit: int) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(F.left(c, F.lit(limit)), p, 1), F.lit("")) for p in patterns])


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))


def page_text(html: Column) -> Column:
    """Article text by a chain of replacements: dropped elements, tags, then white space."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)\b[^>]*>.*?</(script|style|nav|header|footer|aside)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def json_ld_author(html: Column) -> Column:
    """The author of the first JSON-LD block that names one: an object's name or a list's first name."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)

    def name(b):
        v = F.try_parse_json(b)
        paths = ("$.author.name", "$.author[0].name", "$[0].author.name", "$[1].author.name", "$[0].author[0].name")
        return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])

    return F.try_element_at(F.filter(F.transform(blocks, name), lambda x: x.isNotNull() & (x != "")), F.lit(1))


def resolved_author(json_ld: Column, extractor: Column, by: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(F.trim(json_ld), blank), F.nullif(F.trim(extractor), blank), by, F.lit("Unknown"))


def longer(text: Column, other: Column) -> Column:
    return F.when(F.length(other) > F.length(text), other).otherwise(text)


def lead_summary(c: Column, limit: int = 300, cut: int = 4000) -> Column:
    """Offline summary: leading sentences of the first `cut` characters while they fit in `limit`, the cut text otherwise."""
    head = F.left(F.coalesce(c, F.lit("")), F.lit(cut))
    sentences = F.regexp_extract(F.left(head, F.lit(limit)), r"(?s)^(.*[.!?])", 1)
    return F.when(sentences != "", sentences).otherwise(F.left(head, F.lit(limit)))


def split_list(c: Column, separator: str = r"\|") -> Column:
    """Trimmed, non-blank, distinct parts in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != ""))
