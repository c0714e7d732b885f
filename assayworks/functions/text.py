"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Symbols and what they become.
_SYMBOLS = {
    "±": "+/-", "≥": ">=", "≤": "<=", "≠": "!=", "≈": "~", "∞": "inf", "√": "sqrt", "×": "*", "·": "*", "∕": "/", "÷": "/", "−": "-", "–": "-", "—": "-", "∙": "*", "≡": "==", "∏": "II", "∪": "U", "∩": "^",
    "µ": "u", "°": "", "™": "", "®": "", "©": "", "…": "...", "′": "'", "´": "'", "“": '"', "”": '"', "‘": "'", "’": "'", " ": " ", "㏀": "KO", "㏁": "MO", "→": "->", "↑": "^", "§": "S", "¶": "P", "†": "|", "‡": "|",
}
_LATIN = {"ø": "o", "ß": "ss", "Æ": "AE", "æ": "ae"}


def unicode_map() -> dict[str, str]:
    """Code points to ASCII: Greek letters in all alphabets by name, digits above and below the line, accents, symbols."""
    out: dict[str, str] = {}
    for c in map(chr, [*range(0x370, 0x400), *range(0x1D6A8, 0x1D7CC)]):
        name = unicodedata.name(c, "")
        words = name.replace("FINAL SIGMA", "SIGMA").replace("LAMDA", "LAMBDA").split()
        if "LETTER" in words and len(words) == 4 and words[0] == "GREEK" or words[:1] == ["MATHEMATICAL"] and "LETTER" not in words and {"SMALL", "CAPITAL"} & set(words):
            plain = words[-1].lower()
            out[c] = plain.capitalize() if "CAPITAL" in words else plain
        elif name.endswith(" SYMBOL") and (words[0] == "GREEK" or words[0] == "MATHEMATICAL") and words[-2] in ("BETA", "THETA", "PHI", "PI", "KAPPA", "RHO", "EPSILON"):
            out[c] = words[-2].lower()
    out["ϒ"] = "upsilon"
    for c in map(chr, [0xB9, 0xB2, 0xB3, 0x2070, *range(0x2074, 0x207A), *range(0x2080, 0x208A)]):
        out[c] = str(unicodedata.digit(c))
    out |= {"⁻": "-", "⁺": "+"}
    for c in "üùúûéèëêàáâãäåòóôõöìíîïñç":
        out[c] = unicodedata.normalize("NFKD", c)[0]
    for k, v in (_SYMBOLS | _LATIN).items():
        out.setdefault(k, v)
    return out


UNICODE = unicode_map()
NON_ASCII = r"[^\x00-\x7F]"


def _class(chars) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def clean_unicode(c: Column) -> Column:
    """Mapped code points to ASCII; all others stay.

    One translate for code points that become one character or none. Only a value that holds one of the others is cut round
    them, and each part that is such a code point is looked up.
    """
    one = {k: v for k, v in UNICODE.items() if len(v) == 1 and ord(k) < 0x10000}
    gone = [k for k, v in UNICODE.items() if v == ""]
    many = {k: v for k, v in UNICODE.items() if k not in one and v}
    out = F.when(c.rlike(NON_ASCII), F.translate(c, "".join([*one, *gone]), "".join(one.values()))).otherwise(c)
    names = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
    near, far = (_class(k for k in many if (ord(k) < 0x10000) == low) for low in (True, False))
    named = lambda parts: F.array_join(F.transform(parts, lambda x: F.when(F.length(x) == 1, F.coalesce(F.try_element_at(names, x), x)).otherwise(x)), "")
    # look-arounds do not see code points of two Java characters; a value with one of these is cut everywhere
    return F.when(c.rlike(far), named(F.split(out, ""))).when(c.rlike(near), named(F.split(out, f"(?<={near})|(?={near})"))).otherwise(out)


def fenced(df: DataFrame, cols: list[str]) -> DataFrame:
    """df as it is, with the columns behind an expression that filters are not pushed through.

    A filter pushed below a chain of steps takes every step's expression with it, once for each use of the one before.
    """
    return df.withColumns({c: F.when(F.monotonically_increasing_id() >= 0, F.col(c)) for c in cols})


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text_field(c: Column) -> Column:
    """White space squished, then runs of _ or * at either end removed; what is inside stays."""
    return F.regexp_replace(squish(c), r"^[_*]+|[_*]+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def clean_unicode_frame(df: DataFrame) -> DataFrame:
    return df.withColumns({c: clean_unicode(F.col(c)) for c in string_columns(df)})


def trim_frame(df: DataFrame) -> DataFrame:
    return df.withColumns({c: clean_text_field(F.col(c)) for c in string_columns(df)})


def non_ascii_counts(df: DataFrame, cols: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """char, code_point, n and (with row_id) the rows of every non-ASCII code point left."""
    cols = cols or string_columns(df)
    cells = F.explode(F.array(*[F.col(c) for c in cols])).alias("cell")
    chars = df.select(*([row_id] if row_id else []), cells).select(*([row_id] if row_id else []), F.explode(F.regexp_extract_all("cell", F.lit(f"({NON_ASCII})"), 1)).alias("char"))
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.expr("ascii(char)")), 4, "0")).alias("code_point")
    aggs = [F.count("*").alias("n")] + ([F.sort_array(F.collect_set(row_id)).alias("rows")] if row_id else [])
    return chars.select("*", code).groupBy("char", "code_point").agg(*aggs)


def quoted(term: str) -> str:
    """A literal as a pattern."""
    return "".join("\\" + c if c in r"\/.[](){}|?+*^$-&#" else c for c in term)
