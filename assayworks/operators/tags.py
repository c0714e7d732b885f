"""Roles of columns, from their headers; metadata only."""

from __future__ import annotations

import re

# Phrases of each role.
PHRASES = {
    "CASRN": ("casrn", "cas rn", "cas number", "cas no", "cas registry number", "cas registry", "cas"),
    "Name": ("chemical name", "compound name", "substance name", "analyte name", "reagent name", "ingredient name", "chemical", "compound", "substance", "analyte", "reagent"),
    "Other": ("molecular formula", "chemical formula", "formula", "smiles", "inchi", "inchikey", "dtxsid", "structure", "synonym", "synonyms"),
    "Result": ("result value", "result", "concentration", "conc", "measurement", "measured value"),
    "Numeric": ("numeric measurement", "numeric value", "numeric"),
    "Unit": ("unit of measure", "units", "unit", "uom"),
    "Qualifier": ("qualifier", "qual"),
    "ReportingLimit": ("reporting limit", "report limit", "result reporting limit", "rl", "mda", "mdc", "detection limit", "method detection limit", "quantitation limit", "limit of quantitation", "lod", "loq"),
    "Uncertainty": ("uncertainty", "counting uncertainty", "measurement uncertainty", "result uncertainty", "two sigma uncertainty", "one sigma uncertainty", "sigma"),
    "UncertaintyCoverage": ("uncertainty coverage", "coverage factor", "coverage", "sigma coverage", "uncertainty type"),
    "Duration": ("exposure duration", "study duration", "exposure period", "exposure time", "duration"),
    "DurationUnit": ("duration unit", "duration units", "duration uom", "time unit"),
    "Species": ("test species", "test organism", "species", "organism", "animal"),
    "ExposureRoute": ("route of exposure", "exposure route", "administration route", "exposure pathway", "route"),
    "StudyDate": ("study start date", "study date", "test date", "sample date", "sampling date", "collection date"),
    "Media": ("sample matrix", "exposure media", "test media", "sample type", "media", "medium", "matrix"),
}
# Of equally long phrases, the role that comes first here.
PRIORITY = ("CASRN", "DurationUnit", "UncertaintyCoverage", "ReportingLimit", "ExposureRoute", "StudyDate", "Species", "Media", "Unit", "Qualifier", "Uncertainty", "Duration", "Result", "Numeric", "Other", "Name")
SINGULAR = ("Name", "CASRN")
GROUPS = {
    "chemical": ("Name", "CASRN", "Other"),
    "numeric": ("Result", "Numeric", "Unit", "Qualifier", "ReportingLimit", "Uncertainty", "UncertaintyCoverage", "Duration", "DurationUnit"),
    "study": ("Species", "ExposureRoute", "StudyDate"),
    "metadata": ("Media",),
}
Tags = dict[str, str]


def tokens(header: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", header.lower()).split()


def _holds(hay: list[str], needle: list[str]) -> bool:
    return any(hay[i : i + len(needle)] == needle for i in range(len(hay) - len(needle) + 1))


def best_phrase(words: list[str]) -> tuple[str, int] | None:
    """Role and length of the longest phrase found, by priority among equals."""
    found = [(len(p.split()), -PRIORITY.index(t), t) for t, ps in PHRASES.items() for p in ps if _holds(words, p.split())]
    return (max(found)[2], max(found)[0]) if found else None


def suggest(columns: list[str]) -> Tags:
    """Roles of columns. Headers of identifiers are no names unless they say so; Name and CASRN go to one column each."""
    got: dict[str, tuple[str, int]] = {}
    for c in columns:
        words = tokens(c)
        hit = best_phrase(words)
        if hit is None:
            continue
        explicit = any(_holds(words, p.split()) for p in PHRASES["Name"] if " " in p)
        if hit[0] == "Name" and {"id", "identifier", "code"} & set(words) and not explicit:
            continue
        got[c] = hit
    out: Tags = {}
    for c, (tag, n) in got.items():
        if tag in SINGULAR and any(t == tag and (m > n or (m == n and columns.index(o) < columns.index(c))) for o, (t, m) in got.items() if o != c):
            continue
        out[c] = tag
    return out


def grouped(tags: Tags) -> dict[str, Tags]:
    return {g: {c: t for c, t in tags.items() if t in kinds} for g, kinds in GROUPS.items()}


def pairing_warnings(tags: Tags) -> list[str]:
    have, out = set(tags.values()), []
    if "Result" in have and "Unit" not in have:
        out.append("a Result without a Unit")
    if "Unit" in have and not have & {"Result", "Numeric", "ReportingLimit", "Uncertainty"}:
        out.append("a Unit without any measure")
    if "DurationUnit" in have and "Duration" not in have:
        out.append("a DurationUnit without a Duration")
    return out


def changed(old: Tags, new: Tags) -> dict[str, tuple[str | None, str | None]]:
    """Columns whose role differs, whatever the order."""
    return {c: (old.get(c), new.get(c)) for c in {*old, *new} if old.get(c) != new.get(c)}


def has_chemical(tags: Tags) -> bool:
    return set(SINGULAR) <= set(tags.values())


def merged(*maps: Tags | None) -> Tags:
    return {c: t for m in maps if m for c, t in m.items()}
