"""Scalar expressions over claims, all built from JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: Characters that count as white space in text (Unicode's, with the ASCII separators).
BLANKS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def est_tokens(text: Column) -> Column:
    """Code points over CHARS_PER_TOKEN; a null text has none."""
    return F.coalesce(F.length(text), F.lit(0)) / F.lit(C.CHARS_PER_TOKEN)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; a zero vector scores 0, as 1e-12 is added to each length."""
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def squeeze(text: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text, BLANKS, "")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a shorter text is its own only element.

    The squeezed text is bound once, split into characters, and paired with its own tail.
    """
    pair = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: F.concat(x, y))
    own = lambda s: F.when(F.length(s) < 2, F.array(s)).otherwise(F.array_distinct(F.element_at(F.transform(F.array(F.split(s, "")), pair), 1)))
    return F.element_at(F.transform(F.array(squeeze(F.coalesce(text, F.lit("")))), own), 1)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / (F.size(F.array_union(a, b)) + F.lit(1e-12))


def to_time(text: Column) -> Column:
    return F.to_timestamp(text, C.TIME_FORMAT)


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), C.TIME_FORMAT)


def days_idle(last_accessed: Column, created: Column, now: Column) -> Column:
    """Whole days, rounded down, since the last access or else creation."""
    since = F.coalesce(F.when(last_accessed != "", last_accessed), created)
    return F.floor((F.unix_timestamp(to_time(now)) - F.unix_timestamp(to_time(since))) / F.lit(86400))


def retention(days: Column, hits: Column) -> Column:
    return F.exp(-days / (F.lit(C.TAU_DAYS) * (1 + F.coalesce(hits, F.lit(0)))))


def _by_level(confidence: Column, values: dict, other) -> Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(confidence == name, value).otherwise(out)
    return out


def confidence_rank(confidence: Column) -> Column:
    """0.3, 0.6 or 0.9; anything else, and null, 0."""
    return _by_level(confidence, C.RANK, 0.0)


def confidence_weight(confidence: Column) -> Column:
    """3, 2 or 1; anything else, and null, 1."""
    return _by_level(confidence, C.WEIGHT, 1)


def promoted(confidence: Column, hits: Column) -> Column:
    """The confidence that so many hits earn, if it is higher than the present one; else null."""
    earned = F.when(hits >= C.HIGH_HITS, "high").when(hits >= C.MID_HITS, "mid")
    return F.when(confidence_rank(earned) > confidence_rank(F.coalesce(confidence, F.lit("low"))), earned)


def render(kind: Column, entity: Column, created: Column, text: Column) -> Column:
    """[kind|entity|YYYY-MM] text, with blanks for nulls."""
    part = lambda x: F.coalesce(x, F.lit(""))
    return F.concat(F.lit("["), part(kind), F.lit("|"), part(entity), F.lit("|"), F.substring(part(created), 1, 7), F.lit("] "), part(text))


def brief() -> Column:
    return F.struct("id", "text")


def first_kept(hits_a: Column, created_a: Column, hits_b: Column, created_b: Column) -> Column:
    """Whether the first of two claims stays: more hits, then created later, then the first."""
    key = lambda h, c: F.struct(F.coalesce(h, F.lit(0)).alias("h"), F.coalesce(c, F.lit("")).alias("c"))
    return key(hits_a, created_a) >= key(hits_b, created_b)
