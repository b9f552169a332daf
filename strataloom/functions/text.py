"""Column expressions over text. All stay in the JVM; fold_full is the Arrow fallback for what a translate table cannot say."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import DEFAULT, Settings


@cache
def _fold_table() -> tuple[str, str]:
    """Letters that decompose to one base letter and combining marks, with that base."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def let(expr: Column, use) -> Column:
    """use(expr), with expr evaluated once."""
    return F.element_at(F.transform(F.array(expr), use), 1)


def fold(text: Column) -> Column:
    """Without accents, in lower case. Accents go first, so that a dotted capital I becomes one letter."""
    src, dst = _fold_table()
    return F.lower(F.translate(text, src, dst))


@F.pandas_udf(StringType())
def fold_full(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """fold by full compatibility decomposition."""
    for part in texts:
        yield part.map(lambda x: x and "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower())


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Folded runs of letters, digits and underscores, as Unicode has them."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def char_ngrams(text: Column, n: int = DEFAULT.ngram_n) -> Column:
    """Distinct n-grams of folded text with single spaces; a shorter text is its own n-gram, an empty one has none."""

    def grams(t: Column) -> Column:
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))))

    return let(squeeze(fold(text)), grams)


def containment(query: Column, doc: Column) -> Column:
    """Share of the query's n-grams that the document has; 0 if either has none."""
    return F.when((F.size(query) == 0) | (F.size(doc) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(query, doc)) / F.size(query))


def sentences(text: Column) -> Column:
    """Cut after . ! ? and white space. The mark stands for a look-behind, which not every engine has."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")


def approx_tokens(text: Column, settings: Settings = DEFAULT) -> Column:
    return (F.size(words(text)) * F.lit(float(settings.token_per_word))).cast("int")


def extractive_summary(content: Column, heading: Column) -> Column:
    """The first three sentences, or the heading of an empty section."""
    return F.when(strip(F.coalesce(content, F.lit(""))) == "", heading).otherwise(F.array_join(F.slice(sentences(strip(content)), 1, 3), " "))


def repair_json(raw: Column) -> Column:
    """The object in a model's reply: without thoughts, from a fenced block or between the outer braces, without trailing commas."""
    bare = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(bare, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(F.when(fenced != "", fenced).otherwise(outer), r",\s*([}\]])", "$1")


def valid_ids(raw: Column, present: Column) -> Column:
    """Of ids given as JSON texts of numbers or strings, those that are whole numbers and present, in order."""
    whole = F.transform(F.filter(raw, lambda x: x.rlike(r"^[0-9]+$")), lambda x: x.try_cast("bigint"))
    return F.filter(whole, lambda x: F.coalesce(F.array_contains(present, x), F.lit(False)))


def heat_class(heat: Column) -> Column:
    return F.when(heat >= 0.7, "high").when(heat >= 0.5, "medium").when(heat > 0, "low")
