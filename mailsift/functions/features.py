"""Hand-made text features (Column -> Column), JVM-side."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (ACCOUNT_WORDS, ENGINEERED_FEATURES, PAYMENT_WORDS,
                        URGENT_WORDS)

LINK = r"(?i)http[s]?://|www\."


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _text(col: Column | str) -> Column:
    return F.coalesce(_c(col), F.lit(""))


def link_count(col: Column | str) -> Column:
    """Non-overlapping, case-insensitive hits of http://, https:// or www."""
    return F.regexp_count(_text(col), F.lit(LINK)).cast("int")


def has_any(col: Column | str, words: Iterable[str]) -> Column:
    """1 when any word occurs as a substring of the lower-cased text."""
    t = F.lower(_text(col))
    hit = None
    for w in words:
        h = t.contains(w)
        hit = h if hit is None else (hit | h)
    return hit.cast("int")


def has_urgent_words(col: Column | str) -> Column:
    return has_any(col, URGENT_WORDS)


def has_account_words(col: Column | str) -> Column:
    return has_any(col, ACCOUNT_WORDS)


def has_payment_words(col: Column | str) -> Column:
    return has_any(col, PAYMENT_WORDS)


def exclamation_count(col: Column | str) -> Column:
    t = _text(col)
    return (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("int")


def uppercase_ratio(col: Column | str) -> Column:
    """Upper-case letters / letters; 0.0 when there is no letter."""
    t = _text(col)
    n = F.length(t)
    # count by deleting whole runs (one match per word, not per letter)
    letters = n - F.length(F.regexp_replace(t, r"\p{L}+", ""))
    upper = n - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))
    return F.when(letters > 0, upper / letters).otherwise(F.lit(0.0)).cast("double")


def engineered_features(col: Column | str) -> Column:
    """All six features as one struct, in model feature order."""
    return F.struct(
        link_count(col).alias("link_count"),
        has_urgent_words(col).alias("has_urgent_words"),
        has_account_words(col).alias("has_account_words"),
        has_payment_words(col).alias("has_payment_words"),
        exclamation_count(col).alias("exclamation_count"),
        uppercase_ratio(col).alias("uppercase_ratio"),
    )


def display_features(feats: Column | str) -> Column:
    """Display form: flags as booleans, ratio rounded to 4 places."""
    f = _c(feats)
    return F.struct(
        f["link_count"].alias("link_count"),
        (f["has_urgent_words"] == 1).alias("has_urgent_words"),
        (f["has_account_words"] == 1).alias("has_account_words"),
        (f["has_payment_words"] == 1).alias("has_payment_words"),
        f["exclamation_count"].alias("exclamation_count"),
        F.round(f["uppercase_ratio"], 4).alias("uppercase_ratio"),
    )


def feature_values(feats: Column | str) -> Column:
    """The struct as array<double> in feature order (for the model input)."""
    f = _c(feats)
    return F.array(*[f[name].cast("double") for name in ENGINEERED_FEATURES])
