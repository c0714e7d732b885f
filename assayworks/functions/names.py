"""Substance names: markers, enclosures, adjectives, formulas, isotopes and several analytes in one value."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import quoted, squish

# Element symbols, those of two letters first.
ELEMENTS = (
    "He Li Be Ne Na Mg Al Si Cl Ar Ca Sc Ti Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta Re Os Ir Pt Au Hg Tl "
    "Pb Bi Po At Rn Fr Ra Ac Th Pa Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og H B C N O F P S K V I Y W U"
).split()
_ATOM = rf"(?:{'|'.join(ELEMENTS)})\d*"
FORMULA = rf"^(?:{_ATOM}|(?:\((?:{_ATOM})+\)\d*|\[(?:{_ATOM})+\]\d*))+(?:[+-]\d*)?$"
ROMAN = r"(?i)^\s*([A-Z][a-z]?\s+)?(I{1,3}|IV|V|VI{0,3}|IX|X|XI{0,2})\s*$"
CHIRAL = r"\((\+|-|\+-|\+/-|R,S|S,R|R|S|[dD][lL]|[dD]|[lL])\)"
CHIRAL_MARKERS = ("+", "-", "+-", "+/-", "R,S", "S,R", "R", "S", "dl", "dL", "Dl", "DL", "d", "D", "l", "L")
EXCEPTIONS = ("density", "probably", "average", "combination")
NAKED_PLUS, AND = r"(?<!\()\s\+\s(?!\))", r"(?i)\s+and\s+"
MIXTURE = r"(?:\(|\[)?\s*\d+(?:\.\d+)?\s*[:/\-]\s*\d+(?:\.\d+)?(?:\s*(?:w/w|v/v|wt%|vol%))?\s*(?:\)|\])?"
ADJECTIVES = r"(?i)\b(pure|purif\w*|tech|technical|grade|chemical)\b"
SALTS = r"(?i)and its (\w+ )?salts"
UNSPECIFIED = r"(?i)[,;-]?\s*unspecified\s*$"


def chiral_token(marker: str) -> str:
    return "###CHIRAL_" + marker.replace("+", "PLUS").replace("/", "SLASH").replace("-", "MINUS").replace(",", "_COMMA_") + "###"


def protect_chiral(c: Column) -> Column:
    for m in CHIRAL_MARKERS:
        c = F.replace(c, F.lit(f"({m})"), F.lit(chiral_token(m)))
    return c


def restore_chiral(c: Column) -> Column:
    for m in CHIRAL_MARKERS:
        c = F.replace(c, F.lit(chiral_token(m)), F.lit(f"({m})"))
    return c


def strip_enclosure(c: Column, opening: str = "(", closing: str = ")") -> tuple[Column, Column]:
    """The value without an enclosure at its end, and what was in it where that is kept as a formula."""
    shape = rf"^(.*)\{opening}([^\{closing}]*)\{closing}\s*$"
    base, inner = F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 2)
    exception = F.lit(False)
    for w in EXCEPTIONS:
        exception = exception | F.contains(F.lower(inner), F.lit(w))
    empty = F.trim(inner) == ""
    goes = (~F.contains(inner, F.lit("yl")) | exception) & ~F.contains(inner, F.lit("%")) & ~F.trim(inner).rlike(ROMAN)
    has = c.rlike(shape)
    return F.when(has & (empty | goes), F.trim(base)).otherwise(c), F.when(has & ~empty & goes, inner)


def strip_enclosures(c: Column) -> tuple[Column, Column]:
    """Round, then square brackets at the end."""
    once, a = strip_enclosure(c)
    twice, b = strip_enclosure(once, "[", "]")
    return twice, F.when(a.isNotNull() | b.isNotNull(), F.concat_ws("; ", a, b))


def strip_adjectives(c: Column) -> Column:
    return squish(F.regexp_replace(c, ADJECTIVES, ""))


def strip_salts(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SALTS, ""))


def strip_unspecified(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNSPECIFIED, ""))


def strip_terms(c: Column, terms: Iterable[tuple[str, str]]) -> Column:
    """(mode, pattern) in order: regex, literal_exact or literal_word; squished after each."""
    for mode, pattern in terms:
        if mode == "regex":
            c = squish(F.regexp_replace(c, f"(?i){pattern}", ""))
        elif mode == "literal_exact":
            c = F.when(F.lower(F.trim(c)) == pattern.strip().lower(), F.lit("")).otherwise(c)
        else:
            c = squish(F.regexp_replace(c, rf"(?i)\b{quoted(pattern)}\b", ""))
    return c


def tidy(c: Column) -> Column:
    """Squished, without an empty enclosure or separators at the end."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(squish(c), r"\(\s*\)\s*$", "")), r"[,;-]+$", ""))


def split_synonyms(c: Column) -> Column:
    """Parts between semicolons and commas; commas in locants, between letters or digits, do not separate."""
    held = c
    for _ in range(3):  # neighbours that share a character need a second look
        held = F.regexp_replace(held, r"(?<=[A-Za-z]),(?=[A-Za-z0-9])|(?<=[0-9]),(?=[0-9])", "@@@")
    held = F.regexp_replace(held, r",\s+(?=\d)", "%%%")
    parts = F.transform(F.split(held, "[;,]"), lambda x: F.replace(F.replace(F.trim(x), F.lit("@@@"), F.lit(",")), F.lit("%%%"), F.lit(", ")))
    return F.filter(parts, lambda x: x != "")


def is_bare_formula(c: Column) -> Column:
    test = F.regexp_replace(c, r"[\s.]+", "")
    return F.coalesce(~c.rlike("[a-z]{2}") & ~c.rlike("^[A-Z]+$") & (test != "") & test.rlike(FORMULA), F.lit(False))


def extract_formulas(c: Column) -> Column:
    """Distinct bracketed parts that are formulas, in order."""
    found = F.regexp_extract_all(c, F.lit(r"(\([A-Za-z0-9+\-\.·\s]*\)|\[[A-Za-z0-9()+\-\.·\s]*\])"), 1)
    inner = F.transform(found, lambda x: squish(x.substr(F.lit(2), F.length(x) - 2)))
    ok = lambda x: ~x.rlike(r"(?i)^\s*(?:i|v|x|l|c|d|m)+\s*$") & ~x.rlike(r"^\s*C\d+\s*[-–]\s*\d+\s*$") & F.regexp_replace(x, r"[·.\s]+", "").rlike(FORMULA)
    return F.array_distinct(F.filter(inner, ok))


def is_mixture(c: Column) -> Column:
    return c.rlike(MIXTURE)


def is_multi_analyte(c: Column) -> Column:
    return F.coalesce(c.rlike(NAKED_PLUS) | c.rlike(AND), F.lit(False))


def carry_element(parts: Column) -> Column:
    """A bare mass of two or three digits takes the element of the part before it."""
    shape = r"^([A-Za-z][A-Za-z ]*?)[ -]+(\d{2,3})$"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"))

    def step(a: Column, x: Column) -> Column:
        v = F.trim(x)
        own = F.trim(F.regexp_extract(v, shape, 1))
        made = F.when(v.rlike(r"^\d{2,3}$") & a["last"].isNotNull(), F.concat_ws("-", a["last"], v)).when(v.rlike(shape), F.concat_ws("-", own, F.regexp_extract(v, shape, 2))).otherwise(v)
        return F.struct(F.concat(a["out"], F.array(made)).alias("out"), F.when(v.rlike(shape), own).otherwise(a["last"]).alias("last"))

    return F.aggregate(parts, start, step, lambda a: a["out"])


def multi_analyte_parts(c: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(F.trim(c), NAKED_PLUS, "\n"), AND, "\n")
    parts = F.filter(F.transform(F.split(cut, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.array_distinct(carry_element(parts)), F.array().cast("array<string>"))


def expand_isotopes(c: Column, isotopes: Iterable[tuple[str, str, str]], alternates: dict[str, str] | None = None) -> Column:
    """(symbol, mass, element) rows: U238, u-238, U 238 and the element's names with the mass become Element-mass."""
    rows = sorted({(s, m, e) for s, m, e in isotopes}, key=lambda r: (-len(r[0]), r))
    names = {}
    for _, m, e in rows:
        names[e.lower(), m] = f"{e}-{m}"
    for alt, e in (alternates or {}).items():
        for _, m, own in rows:
            if own == e:
                names[alt.lower(), m] = f"{e}-{m}"
    if not rows:
        return c
    # One pattern and one lookup for each form, however many isotopes there are.
    by_symbol = {(s.lower(), m): f"{e}-{m}" for s, m, e in rows}

    def replaced(c: Column, pattern: str, table: dict[tuple[str, str], str]) -> Column:
        lookup = F.create_map(*[F.lit(x) for (a, m), v in table.items() for x in (f"{a} {m}", v)])
        marked = F.split(F.regexp_replace(c, pattern, "\u0001$1 $2\u0002"), "[\u0001\u0002]")
        return F.array_join(F.transform(marked, lambda x, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(lookup, F.lower(x)), F.regexp_replace(x, " ", "-"))).otherwise(x)), "")

    masses: dict[str, set[str]] = {}
    for s, m in by_symbol:
        masses.setdefault(s, set()).add(m)
    alternatives = "|".join(f"{quoted(s)}(?=\\s*[- ]?\\s*(?:{'|'.join(sorted(ms))})\\b)" for s, ms in sorted(masses.items(), key=lambda x: -len(x[0])))
    c = replaced(c, rf"(?<![0-9A-Za-z])((?i:{alternatives}))(?:\s*[- ]\s*)?({'|'.join(sorted({m for _, m in by_symbol}, key=lambda m: -len(m)))})\b(?![A-Z])", by_symbol)
    full: dict[str, set[str]] = {}
    for n, m in names:
        full.setdefault(n, set()).add(m)
    spelled = "|".join(f"{quoted(n)}(?=(?:\\s+|-)(?:{'|'.join(sorted(ms))})\\b)" for n, ms in sorted(full.items(), key=lambda x: -len(x[0])))
    return replaced(c, rf"\b((?i:{spelled}))(?:\s+|-)({'|'.join(sorted({m for _, m in names}, key=lambda m: -len(m)))})\b", names)


def wqx_key(c: Column) -> Column:
    """The lookup key of a characteristic's name: case, ampersands and locants in one spelling."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"\s*&\s*", " and ")
    # blanks round commas within a locant group: from its bracket on, each match goes on where the one before ended
    group = r"[(\[](?=[a-z0-9]+(?:\s*,\s*[a-z0-9]+)*[)\]])"
    c = F.regexp_replace(c, rf"((?:{group}|\G(?!^))[a-z0-9]+)\s*,\s*", "$1,")
    c = F.regexp_replace(c, r"\s+([(\[])([a-z0-9]+(?:,[a-z0-9]+)*)([)\]])", "$1$2$3")
    c = F.regexp_replace(c, r"\[([a-z0-9]+(?:,[a-z0-9]+)*)\]", "($1)")
    return F.regexp_replace(c, r"\(([a-z0-9]+(?:,[a-z0-9]+)*)\)\s+", "($1)")
