"""Scalar expressions shared by the operators. All are plain column expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wherry.session import link_key

__all__ = ["link_key", "half_up", "age_days", "recency_decay", "half_life", "cosine", "beta_mean", "top_folder", "folder_of", "file_stem", "tokens_of", "token_count", "word_count", "npmi", "idf_clamped", "fuzzy_similarity", "hub_boost", "edge_boost", "recency_boost", "reading_minutes", "slug", "fuzzy_key"]

#: Words that carry no meaning for matching (fixed list of common English function words).
STOPWORDS = (
    "a about after all also an and any are as at be been before being both but by can could did do does doing down during each few for from further had has have having he her here him his how i if in into is it its just "
    "me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who why will with would you your"
).split()


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards positive infinity."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / F.lit(float(scale))


def age_days(then: Column, as_of: str) -> Column:
    """Days from ``then`` to ``as_of`` with fractions."""
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86_400_000_000.0)


def recency_decay(then: Column, as_of: str, horizon: float = 180.0, floor: float = 0.1, unknown: float = 0.5) -> Column:
    """``max(floor, 1 - days / horizon)``; an unknown time has its own value."""
    return F.when(then.isNull(), F.lit(unknown)).otherwise(F.greatest(F.lit(floor), 1 - age_days(then, as_of) / horizon))


def half_life(then: Column, as_of: str, days: float) -> Column:
    """``2 ** (-age / days)``, 1 for ages below zero."""
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(age_days(then, as_of), F.lit(0.0)) / days)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def beta_mean(good: Column, bad: Column, alpha: float = 4.0, beta: float = 1.0) -> Column:
    """Mean of a Beta posterior."""
    return (good + alpha) / (good + bad + alpha + beta)


def top_folder(path: Column) -> Column:
    """First segment of a path."""
    return F.element_at(F.split(path, "/"), 1)


def folder_of(path: Column) -> Column:
    """Path without its last segment; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_stem(path: Column) -> Column:
    """Last segment without ``.md``."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md$", "")


def tokens_of(text: Column) -> Column:
    """Lower-cased words of a letter and at least two letters or digits, without stop words. Links count as their text."""
    plain = F.regexp_replace(F.lower(text), r"\[\[([^\]|]*\|)?([^\]]*)\]\]", "$2")
    words = F.regexp_extract_all(plain, F.lit("([a-z][a-z0-9]{2,})"), 1)
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def token_count(text: Column) -> Column:
    """Estimate of model tokens, a quarter of the characters."""
    return F.ceil(F.length(text) / 4).cast("long")


def word_count(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def npmi(together: Column, a: Column, b: Column, n: Column) -> Column:
    """Normalized pointwise mutual information, clamped to 0 and 1."""
    pab = together / n
    v = F.log(pab / ((a / n) * (b / n))) / -F.log(pab)
    return F.when((together <= 0) | (a <= 0) | (b <= 0), F.lit(0.0)).when(pab >= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def idf_clamped(df: Column, n: Column, low: float, high: float) -> Column:
    """``ln((n + 1) / (df + 1))`` within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.log((n + 1) / (df + 1))))


def fuzzy_similarity(a: Column, b: Column) -> Column:
    """1 minus edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def hub_boost(score: Column) -> Column:
    """``min(round(6 log2 score) / 10, 4)``, 0 without a score."""
    return F.when(score > 0, F.least(half_up(F.log2(score) * 6) / 10, F.lit(4.0))).otherwise(F.lit(0.0))


def edge_boost(mean_weight: Column) -> Column:
    """``min((w - 1) 2, 4)`` for weights above 1."""
    return F.when(mean_weight > 1, F.least((mean_weight - 1) * 2, F.lit(4.0))).otherwise(F.lit(0.0))


def recency_boost(then: Column, as_of: str) -> Column:
    """8, 5, 3, 1 within 1, 24, 72, 168 hours, else 0."""
    h = age_days(then, as_of) * 24
    return F.when(h <= 1, 8).when(h <= 24, 5).when(h <= 72, 3).when(h <= 168, 1).otherwise(0)


def reading_minutes(words: Column) -> Column:
    """Minutes at 200 words a minute, rounded up."""
    return F.ceil(words / 200).cast("long")


def slug(text: Column) -> Column:
    """Lower case, other characters as single hyphens."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def fuzzy_key(text: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
