"""Text as columns: stripping, words, n-grams, shingles, overlap. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes that agree with Python's ``\\w`` and ``str.isspace`` (see SURVEY 7.4).
WORD = r"[\p{L}\p{N}_]+"
SPACE = r"(?U)[\s\x1c-\x1f]"
#: The usual short English stop list.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def strip(c: Column) -> Column:
    """Without white space at both ends, all of Unicode's."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def full_text(title: Column, text: Column) -> Column:
    """Stripped title, a space, stripped text; either alone if the other is empty. Null counts as empty."""
    t, b = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(text, F.lit("")))
    return F.when(t == "", b).when(b == "", t).otherwise(F.concat(t, F.lit(" "), b))


def split_words(c: Column) -> Column:
    """White-space separated words of the lowered text."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), f"{SPACE}+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Word tokens of the lowered text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), 1)


def index_terms(c: Column, stopwords: tuple[str, ...] | list[str] = tuple(STOPWORDS)) -> Column:
    """Terms as the sparse index has them: tokens of two characters or more that aren't stop words."""
    return F.filter(tokens(c), lambda t: (F.length(t) > 1) & ~t.isin(*stopwords)) if stopwords else F.filter(tokens(c), lambda t: F.length(t) > 1)


def runs(items: Column, n: int, joiner: str) -> Column:
    """Distinct runs of n items as strings; all items as one run if there are n or fewer; none if none."""
    several = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.array_join(F.slice(items, i, n), joiner)))
    return F.when(F.size(items) == 0, F.array().cast("array<string>")).when(F.size(items) <= n, F.array(F.array_join(items, joiner))).otherwise(several)


def char_ngrams(c: Column, n: int = 5) -> Column:
    """Distinct n-character strings of the lowered text."""
    return runs(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), ""), lambda x: x != ""), n, "")


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(query: Column, passage: Column) -> Column:
    """Share of the query's distinct tokens that the passage has; 0 without tokens."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(passage))) / F.size(q))


def exclusion_reason(text: Column, stop_reason: Column) -> Column:
    """Why a generated query is left out: a refusal, empty text, over 300 characters; else null."""
    body = strip(F.coalesce(text, F.lit("")))
    return F.when(stop_reason == "refusal", "model_declined").when(body == "", "empty").when(F.length(text) > 300, "too_long")


def render_prompt(template: Column, passage: Column) -> Column:
    """The passage in its place, literally."""
    return F.replace(template, F.lit("{passage}"), passage)
