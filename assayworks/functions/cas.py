"""Registry numbers: shape, checksum, normal form and extraction, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT = r"^\d{2,7}-\d{2}-\d$"
CANDIDATE = r"\b([0-9-]{5,12})\b"
IN_TEXT = r"\s*[(\[]?\d{1,7}-\d{2}-\d[)\]]?\s*"


def _checked(digits: Column) -> Column:
    """Whether the last of at most ten digits is the sum of the others, weighted 1.. from the right, modulo 10."""
    padded = F.lpad(digits, 10, "0")
    digit = lambda place: F.ascii(F.substring(padded, place, 1)) - 48
    return reduce(lambda a, b: a + b, [digit(10 - i) * i for i in range(1, 10)]) % 10 == digit(10)


def is_cas(c: Column) -> Column:
    """Null for null."""
    return F.when(c.isNull(), None).when(c.rlike(STRICT), _checked(F.translate(c, "-", ""))).otherwise(False)


def _formed(digits: Column) -> Column:
    n = F.length(digits)
    formed = F.concat_ws("-", digits.substr(F.lit(1), n - 3), digits.substr(n - 2, F.lit(2)), F.right(digits, F.lit(1)))
    return F.when((n >= 5) & (n <= 10) & _checked(digits), formed)


def as_cas(c: Column) -> Column:
    """The normal form, or null. Leading zeros go."""
    return _formed(F.ltrim(F.regexp_replace(c, r"[^0-9]", ""), F.lit("0")))


def extract_cas(c: Column) -> Column:
    """All valid numbers in a text, in order, as an array."""
    found = F.regexp_extract_all(c, F.lit(CANDIDATE), 1)
    return F.filter(F.transform(found, lambda x: _formed(F.ltrim(F.translate(x, "-", ""), F.lit("0")))), lambda x: x.isNotNull())
