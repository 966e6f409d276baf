"""Column functions on Japanese text; null text stays null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import fixed as X
from gleanery.functions import text as T


def plain_style(text: Column) -> Column:
    """Redundant phrases shortened, sentences in polite form, one mark after each, single blanks; empty for null."""
    return F.trim(T.fold(F.coalesce(text, F.lit("")), [*X.REDUNDANT, *X.POLITE_FORMS, (r"。+", "。"), (r"(?U)\s+", " ")]))


def punctuation(text: Column) -> Column:
    """One form of each punctuation mark; no blanks before it, one after it at most."""
    for a, b in X.PUNCTUATION:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(T.fold(text, [(r"(?U)\s+([。、!?])", "$1"), (r"(?U)([。、!?])\s+", "$1 ")]))


def shortened(text: Column, limit: int) -> Column:
    """At most `limit` characters: up to the last sentence mark within them, else cut with an ellipsis."""
    cut = F.substring(text, 1, limit)
    upto = F.regexp_extract(cut, r"(?s)^(.*[。.!?！？])", 1)
    return F.when(F.length(text) <= limit, text).when(upto != "", upto).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def sentences(text: Column, low: int = 30, high: int = 300) -> Column:
    """Sentences of low to high characters that don't apologise."""
    sorry = ("申し訳", "すみません", "sorry", "i apologize", "i cannot")  # Fixed values: marks of an apology.
    every = F.transform(F.split(F.coalesce(text, F.lit("")), r"[。.!?]"), lambda s: F.trim(s))
    return F.filter(every, lambda s: F.length(s).between(low, high) & ~F.exists(F.array(*map(F.lit, sorry)), lambda w: F.contains(F.lower(s), w)))
