"""Dates in many spellings, first full match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIMES = (("[T ]+\\d{1,2}:\\d{2}:\\d{2}(?:\\.\\d+)?Z?", ""), ("[T ]+\\d{1,2}:\\d{2}Z?", ""), ("\\s+\\d{1,2}:\\d{2}\\s*[AaPp][Mm]", ""))
_SEP = r"[-/. ]"
#: Parts as group numbers: year, month, day. In the order of trial.
_SHAPES = (
    (rf"^(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})$", 1, 2, 3),
    (r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
    (r"^([A-Za-z]{3,9})[-/., ]*(\d{4})$", 2, 1, 0),
    (r"^(\d{1,2})[-/. ]*([A-Za-z]{3,9})[-/., ]*(\d{4})$", 3, 2, 1),
    (r"^([A-Za-z]{3,9})[-/. ]*(\d{1,2})[-/., ]+(\d{4})$", 3, 1, 2),
    (rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}}|\d{{2}})$", 3, 1, 2),
    (rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}}|\d{{2}})$", 3, 2, 1),
    (r"^(\d{4})$", 1, 0, 0),
    (r"^(\d{4})[-/. ](\d{1,2})$", 1, 2, 0),
)
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
PARTIAL = (r"^[0-9]{4}$", r"^[0-9]{4}[-/][0-9]{1,2}$", r"^[A-Za-z]+ [0-9]{4}$")
TWO_DIGIT = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}(\s|T|$)"


def _month(c: Column) -> Column:
    """Of a number or a name; one look-up in a fixed table."""
    named = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS, 1) for k in dict.fromkeys((m, m[:3])) for x in (k, i)])
    return F.coalesce(c.try_cast("int"), F.try_element_at(named, F.lower(c)))


def _year(c: Column) -> Column:
    """Of two digits, 69 and above are of the last century."""
    n = c.try_cast("int")
    return F.when(F.length(c) == 2, n + F.when(n < 69, 2000).otherwise(1900)).otherwise(n)


def _tried(t: Column, shape: str, y: int, m: int, d: int) -> Column:
    part = lambda k: F.regexp_extract(t, shape, k)
    month = _month(part(m)) if m else F.lit(1)
    day = part(d).try_cast("int") if d else F.lit(1)
    return F.when(t.rlike(shape), F.try_to_date(F.format_string("%04d-%02d-%02d", _year(part(y)), month, day), "yyyy-MM-dd"))


def date_of(c: Column) -> Column:
    """A date, or null. Shapes with a month's name and shapes of numbers alone exclude each other."""
    t = F.trim(c)
    t = F.when(t.contains(":"), F.regexp_replace(t, "|".join(f"(?:{p})$" for p, _ in _TIMES), "")).otherwise(t)
    named = [_tried(t, *s) for s in _SHAPES if "A-Z" in s[0]]
    plain = [_tried(t, *s) for s in _SHAPES if "A-Z" not in s[0]]
    return F.when(t.rlike("[A-Za-z]"), F.coalesce(*named)).otherwise(F.coalesce(*plain))


def _described(c: Column, d: Column) -> dict[str, Column]:
    flag = F.when(d.isNull(), "unparseable").when(F.trim(c).rlike("|".join(PARTIAL)), "partial").when(c.rlike(TWO_DIGIT), "inferred_format").when((F.dayofmonth(d) <= 12) & (F.month(d) <= 12), "ambiguous").otherwise("")
    return {"raw_date": c, "parsed_date": d.cast("string"), "date_year": F.year(d), "date_flag": flag}


def parsed(c: Column) -> dict[str, Column]:
    """raw_date, parsed_date (ISO text), date_year, date_flag."""
    return _described(c, date_of(c))


def with_dates(df: DataFrame, column: str) -> DataFrame:
    """df + parsed()'s columns, with the date found in a projection of its own."""
    c = F.col(column)
    return df.withColumn("_date", date_of(c)).withColumns(_described(c, F.col("_date"))).drop("_date")
