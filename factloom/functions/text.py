"""Scalar functions over text, numbers and dates, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(x: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def words(x: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(squeezed(x), " "), lambda w: w != "")


def safe_ratio(n: Column, d: Column, empty: float = 1.0) -> Column:
    return F.coalesce(F.try_divide(n, d), F.lit(float(empty)))


def plain_typography(x: Column) -> Column:
    """Bullets, quotes and dashes to ASCII, operators spaced alike, words broken over lines joined."""
    # fixed values: bullets, double quotes, single quotes, dashes
    y = F.translate(x, "•◦▪“”„«»‘’‚–—−", "***\"\"\"\"\"'''---")
    y = F.regexp_replace(y, r"(\w)-\n(\w)", "$1$2")
    y = F.regexp_replace(y, r"\s*(<=|>=|=|<|>)\s*", " $1 ")
    return squeezed(y)


#: Phrases of comparison and what they mean.
COMPARATORS = {"at least": "gte", "no less than": "gte", "minimum": "gte", "at most": "lte", "no more than": "lte", "maximum": "lte", "within": "lte", "more than": "gt", "less than": "lt", "exactly": "eq"}
#: Number words.
NUMBERS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def looked_up(x: Column, table: dict, default=None) -> Column:
    got = F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x)
    return got if default is None else F.coalesce(got, F.lit(default))


def comparator(phrase: Column) -> Column:
    return looked_up(F.lower(squeezed(phrase)), COMPARATORS)


def number(x: Column) -> Column:
    """A number word, or digits with a decimal point or comma; a comma before three digits may mean either and gives null."""
    y = F.lower(F.trim(x))
    digits = F.when(y.rlike(r"^\d{1,3}(,\d{3})+$"), F.lit(None)).when(y.rlike(r"^\d+([.,]\d+)?$"), F.regexp_replace(y, ",", ".").try_cast("double"))
    return F.coalesce(looked_up(y, {k: float(v) for k, v in NUMBERS.items()}), digits)


#: Patterns of critical tokens in order of precedence.
CRITICAL = (
    ("date", r"^\d{4}-\d{2}-\d{2}$"), ("operator", r"^(<=|>=|<|>|=)$"), ("negation", r"^(not|no|never|without)$"),
    ("modality", r"^(shall|must|may|should|will)$"), ("section", r"^\d+(\.\d+)+$"), ("numeric", r"^\d+([.,]\d+)?$"), ("unit", r"^(kg|g|m|mm|cm|km|days?|hours?|%)$"),
)


def critical_class(token: Column) -> Column:
    return reduce(lambda c, kv: c.when(token.rlike(kv[1]), kv[0]), CRITICAL, F.when(F.lit(False), "")).otherwise(F.lit(None).cast("string"))


def week_of(ts: Column, zone: str) -> Column:
    """Monday of the local week of a UTC timestamp."""
    return F.to_date(F.date_trunc("WEEK", F.from_utc_timestamp(ts, zone)))


def escaped_like(x: Column, needle: str) -> Column:
    """x holds needle, whose wildcards mean themselves."""
    safe = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return x.like(f"%{safe}%")


def digest(*parts: Column) -> Column:
    """SHA-256 of the compact JSON array of string parts, which hold no characters that JSON escapes."""
    inside = F.concat_ws(",", *[F.concat(F.lit('"'), p.cast("string"), F.lit('"')) for p in parts])
    return F.sha2(F.concat(F.lit("["), inside, F.lit("]")), 256)
