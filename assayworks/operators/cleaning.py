"""The cleaning chain: each step takes a table with original_row_id and gives a Step."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cas, names, text
from ..sources.shared import checkpoint_folder, stored
from .audit import LOG, Step, deduplicated, entries, logged, skipped, stepped

CHIRAL_FLAG = "WARNING: chiral designation"
MULTI_FLAG = "WARNING: potential multi-analyte"
DELIMITER_FLAG, ELLIPSIS_FLAG = "BLOCK: truncated compound [unbalanced delimiter]", "BLOCK: truncated compound [ellipsis]"
BARE_FLAG = "BLOCK: bare formula"
MAX_ISOTOPES = 10_000


def with_row_ids(df: DataFrame, order: Iterable[str] | None = None) -> DataFrame:
    """A dense original_row_id from 1, in the order of the given columns (else as read).

    Rows are numbered within their partitions, and partitions by the sums of the counts before them, so no task gets all
    rows. The table is stored first: both passes must see the same rows in the same partitions.
    """
    if order:
        checkpoint_folder(df.sparkSession)
        df = df.orderBy(*order).checkpoint()
    else:
        df = stored(df, "rows")
    placed = df.withColumn("_m", F.monotonically_increasing_id())
    placed = placed.withColumns({"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = placed.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return got.select((F.col("_before") + F.col("_at") + 1).alias("original_row_id"), *df.columns)


def _flag(df: DataFrame) -> Column:
    return F.col("cleaning_flag") if "cleaning_flag" in df.columns else F.lit(None).cast("string")


def with_flag(existing: Column, flag: str, when: Column) -> Column:
    """The flag added to a `; ` list, once."""
    tokens = F.split(existing, r"\s*;\s*")
    added = F.when(existing.isNull() | (existing == ""), F.lit(flag)).when(F.array_contains(tokens, flag), existing).otherwise(F.concat_ws("; ", existing, F.lit(flag)))
    return F.when(F.coalesce(when, F.lit(False)), added).otherwise(existing)


def tagged(tags: dict[str, str], *kinds: str) -> list[str]:
    return [c for c, k in tags.items() if k in kinds]


def unicode_step(df: DataFrame) -> Step:
    cols = text.string_columns(df)
    return stepped(df, {c: text.clean_unicode(F.col(c)) for c in cols}, "unicode_to_ascii", "non-ASCII characters replaced")


def trim_step(df: DataFrame) -> Step:
    cols = text.string_columns(df)
    return stepped(df, {c: text.clean_text_field(F.col(c)) for c in cols}, "trim_whitespace", "white space and edge marks removed")


def normalize_cas_step(df: DataFrame, tags: dict[str, str]) -> Step:
    """The first number of a cell stays; others go, in order, to cas_extract_<col>_k, as many as any cell has."""
    cols = [c for c in tagged(tags, "CASRN") if c in df.columns]
    if not cols:
        return skipped(df)
    lists = {c: F.array_distinct(cas.extract_cas(F.col(c))) for c in cols}
    most = df.agg(*[F.max(F.size(lists[c])).alias(c) for c in cols]).first().asDict()
    new, more = {}, {}
    for c in cols:
        new[c] = F.when(F.size(lists[c]) > 1, F.get(lists[c], 0)).otherwise(cas.as_cas(F.col(c)))
        for k in range(1, most[c] or 0):
            new[f"cas_extract_{c}_{k}"] = F.get(lists[c], k)
            more[f"cas_extract_{c}_{k}"] = "CASRN"
    return stepped(df, new, "normalize_cas", "registry number normalised", cols, lambda c: F.coalesce(c, F.lit("[NA]")), more)


def rescue_cas_step(df: DataFrame, tags: dict[str, str]) -> Step:
    """Numbers in other tagged columns. Where any row has one, all number-shaped parts leave the whole column."""
    cols = [c for c, k in tags.items() if k != "CASRN" and c in df.columns]
    if not cols:
        return skipped(df)
    first = {c: F.get(cas.extract_cas(F.col(c).cast("string")), 0) for c in cols}
    any_ = df.agg(*[F.max(first[c].isNotNull()).alias(c) for c in cols]).first().asDict()
    new, more = {}, {}
    for c in cols:
        if any_[c]:
            new[f"cas_extract_{c}"] = first[c]
            more[f"cas_extract_{c}"] = "CASRN"
            new[c] = text.squish(F.regexp_replace(F.col(c), cas.IN_TEXT, " "))
    return stepped(df, new, "rescue_cas", "registry number moved out of the text", cols, tags=more) if new else skipped(df)


def multi_cas_step(df: DataFrame, tags: dict[str, str]) -> Step:
    cols = [c for c in tagged(tags, "CASRN") if c in df.columns]
    n = reduce(lambda a, b: a + b, [F.coalesce(F.col(c) != "", F.lit(False)).cast("int") for c in cols], F.lit(0))
    return Step(logged(df).withColumns({"multi_cas": n > 1, "multi_cas_count": n}))


def protect_chiral_step(df: DataFrame, cols: list[str]) -> Step:
    has = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(names.CHIRAL), F.lit(False)) for c in cols], F.lit(False))
    new = {c: names.protect_chiral(F.col(c)) for c in cols} | {"cleaning_flag": with_flag(_flag(df), CHIRAL_FLAG, has)}
    return stepped(df, new, "protect_chiral", "chiral marker set aside", cols)


def restore_chiral_step(df: DataFrame, cols: list[str]) -> Step:
    return stepped(df, {c: names.restore_chiral(F.col(c)) for c in cols}, "restore_chiral", "chiral marker put back")


def strip_enclosures_step(df: DataFrame, cols: list[str]) -> Step:
    new = {}
    for c in cols:
        value, inner = names.strip_enclosures(F.col(c))
        kept = F.col(f"formula_extract_{c}") if f"formula_extract_{c}" in df.columns else F.lit(None).cast("string")
        new[c] = value
        new[f"formula_extract_{c}"] = F.when(inner.isNull(), kept).otherwise(F.concat_ws("; ", F.when(kept != "", kept), inner))
    return stepped(df, new, "strip_terminal_enclosures", "enclosure at the end removed", cols)


def _plain(fn, step: str, reason: str):
    return lambda df, cols: stepped(df, {c: fn(F.col(c)) for c in cols}, step, reason)


strip_adjectives_step = _plain(names.strip_adjectives, "strip_quality_adjectives", "quality adjective removed")
strip_salts_step = _plain(names.strip_salts, "strip_salt_references", "salt reference removed")
strip_unspecified_step = _plain(names.strip_unspecified, "strip_terminal_unspecified", "trailing 'unspecified' removed")
tidy_step = _plain(names.tidy, "tidy_names", "separators at the end removed")


def strip_terms_step(df: DataFrame, cols: list[str], terms: list[tuple[str, str]]) -> Step:
    return stepped(df, {c: names.strip_terms(F.col(c), terms) for c in cols}, "strip_reference_terms", "listed term removed")


def split_synonyms_step(df: DataFrame, cols: list[str], tags: dict[str, str]) -> Step:
    """A row for each synonym; registry numbers stay with the first. Rows that do not split come first (split_order 0)."""
    numbers = [c for c in tagged(tags, "CASRN") if c in df.columns]
    df = text.fenced(logged(df), cols)
    for c in cols:
        parts = names.split_synonyms(F.col(c))
        got = df.withColumn("_split", parts)
        got = got.withColumn("_parts", F.when(F.coalesce(F.size("_split"), F.lit(0)) > 1, F.col("_split")).otherwise(F.array(F.col(c)))).drop("_split")
        many = F.size("_parts") > 1
        log = F.concat(LOG, F.when(many, entries({c: (F.col(c), F.array_join("_parts", " | "))}, "split_synonyms", F.concat(F.lit("split into "), F.size("_parts"), F.lit(" names")))).otherwise(F.slice(LOG, 1, 0)))
        others = [x for x in got.columns if x not in (c, "_parts", "synonym_count", "synonym_index", LOG)]
        got = got.select(*others, log.alias(LOG), F.size("_parts").alias("synonym_count"), F.posexplode("_parts").alias("_i", c))
        first = F.col("_i") == 0  # registry numbers and the log stay with the first
        got = got.withColumns({"synonym_index": F.col("_i") + 1, LOG: F.when(first, F.col(LOG)).otherwise(F.slice(LOG, 1, 0)), **{x: F.when(first, F.col(x)) for x in numbers}})
        df = got.select(*[x for x in df.columns if x not in ("synonym_count", "synonym_index")], "synonym_count", "synonym_index")
    return Step(df.withColumn("split_order", (F.col("synonym_count") > 1).cast("int")) if cols else df)


def expand_isotopes_step(df: DataFrame, cols: list[str], isotopes: DataFrame | None, alternates: dict[str, str] | None = None) -> Step:
    """isotopes: symbol, mass, element_name, dtxsid; a list of nuclides, refused beyond MAX_ISOTOPES."""
    if isotopes is None or not cols:
        return skipped(df)
    rows = isotopes.select("symbol", "mass", "element_name").distinct().limit(MAX_ISOTOPES + 1).collect()
    if len(rows) > MAX_ISOTOPES:
        raise ValueError(f"more than {MAX_ISOTOPES} isotopes")
    new = {c: names.expand_isotopes(F.col(c), [tuple(r) for r in rows], alternates) for c in cols}
    got = stepped(df, new, "expand_isotopes", "isotope spelled out")
    ids = isotopes.select(F.lower(F.concat_ws("-", "element_name", "mass")).alias("_canon"), F.col("dtxsid").alias("_id")).groupBy("_canon").agg(F.min("_id").alias("_id"))
    data = got.rows
    for c in cols:
        data = data.join(F.broadcast(ids), F.lower(F.trim(c)) == F.col("_canon"), "left")
        old = F.col("isotope_dtxsid") if "isotope_dtxsid" in data.columns else F.lit(None).cast("string")
        was = F.col("isotope_match") if "isotope_match" in data.columns else F.lit(False)
        data = data.withColumns({"isotope_dtxsid": F.coalesce(old, "_id"), "isotope_match": was | F.col("_canon").isNotNull()}).drop("_canon", "_id")
    return Step(data)


def flag_multi_analyte_step(df: DataFrame, cols: list[str]) -> Step:
    has = reduce(lambda a, b: a | b, [names.is_multi_analyte(F.col(c)) for c in cols], F.lit(False))
    reviewed = F.coalesce(_flag(df).contains("REVIEWED: multi-analyte"), F.lit(False))
    return Step(logged(df).withColumn("cleaning_flag", with_flag(_flag(df), MULTI_FLAG, has & ~reviewed)))


def truncated_step(df: DataFrame, cols: list[str]) -> Step:
    flag = _flag(df)
    for c in cols:
        v = F.col(c)
        count = lambda x, v=v: F.length(v) - F.length(F.translate(v, x, ""))
        flag = with_flag(flag, DELIMITER_FLAG, (v != "") & ((count("(") != count(")")) | (count("[") != count("]"))))
        flag = with_flag(flag, ELLIPSIS_FLAG, (v != "") & v.rlike(r"\.\.\.+|…"))
    return Step(logged(df).withColumn("cleaning_flag", flag))


def bare_formula_step(df: DataFrame, cols: list[str]) -> Step:
    """The flag is overwritten, the value moves to formula_blocked_<col>."""
    new, flag = {}, _flag(df)
    for c in cols:
        bare = names.is_bare_formula(F.col(c))
        flag = F.when(bare, F.lit(BARE_FLAG)).otherwise(flag)
        new[f"formula_blocked_{c}"] = F.when(bare, F.col(c))
        new[c] = F.when(~bare, F.col(c))
    return stepped(df, {**new, "cleaning_flag": flag}, "detect_bare_formulas", "value is a formula only", cols, lambda c: F.coalesce(c, F.lit("[NA]")))


def flag_references_step(df: DataFrame, cols: list[str], rules: Iterable[tuple], kind: str, label: str) -> Step:
    """rules: (mode, pattern, term, source), active ones in order. Exact matches of literal terms first, then the first
    pattern found; the log names the term, where it is from, how it was found, and the value.

    A warning leaves flagged rows alone; a block leaves only blocked rows alone and overwrites the rest.
    """
    prefix = "BLOCK" if kind == "blocking" else "WARN"
    rules = [(m, p, *(rest or (p, "app_default"))) for m, p, *rest in rules]
    named = lambda t, s: F.struct(F.lit(t).alias("term"), F.lit(s).alias("source"))
    exact: dict[str, Column] = {}
    for m, p, t, s in rules:
        if m != "regex":
            exact.setdefault(p.strip().lower(), named(t, s))
    table = F.create_map(*[x for k, v in exact.items() for x in (F.lit(k), v)]) if exact else None
    patterns = [("(?i)" + (p if m == "regex" else rf"\b{text.quoted(p)}\b"), named(t, s)) for m, p, t, s in rules if m != "literal_exact"]
    any_ = "(?i)" + "|".join(f"(?:{p[4:]})" for p, _ in patterns)
    none = F.lit(None).cast("struct<term:string,source:string>")
    made = logged(df).withColumn("_flag", _flag(df))
    for c in cols:
        v, flag = F.col(c), F.col("_flag")
        taken = F.coalesce(flag.startswith("BLOCK:") if kind == "blocking" else flag != "", F.lit(False))
        by_value = F.try_element_at(table, F.lower(F.trim(v))) if exact else none
        # one search for all patterns; only values that hold some are searched for the first
        by_pattern = F.when(v.rlike(any_), F.coalesce(*[F.when(v.rlike(p), n) for p, n in patterns])) if patterns else none
        made = made.withColumns({"_exact": F.when(~taken & v.isNotNull(), by_value)})
        made = made.withColumns({"_found": F.when(~taken & F.col("_exact").isNull(), by_pattern)})
        how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_found").isNotNull(), "substring")
        hit = F.coalesce("_exact", "_found")
        new = F.concat(F.lit(f"{prefix}: {label} ["), how, F.lit("]"))
        why = F.concat(F.lit("Matched '"), hit["term"], F.lit("' (source: "), hit["source"], F.lit(", match type: "), how, F.lit(f") in {c}"))
        entry = F.struct(F.lit(c).alias("field"), F.lit(f"flag_{kind}").alias("step"), v.cast("string").alias("original_value"), new.alias("new_value"), why.alias("reason"))
        made = made.withColumns({LOG: F.when(hit.isNotNull(), F.concat(LOG, F.array(entry))).otherwise(F.col(LOG)), "_flag": F.coalesce(new, flag)}).drop("_exact", "_found")
    return Step(text.fenced(made.withColumn("cleaning_flag", F.col("_flag")).drop("_flag"), ["cleaning_flag"]))


#: Patterns of first_match(); a longer list is refused.
MAX_PATTERNS = 100_000


def first_match(df: DataFrame, column: str, patterns: DataFrame) -> DataFrame:
    """df + term: the first pattern (by ord) that its value holds; for lists too long for an expression.

    patterns: ord, term, pattern and, where it has the column, match_mode. A literal word meets only the values that hold its
    first word, by an equi-join; regular expressions meet every distinct value, so only their number is bounded by a check.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    word = F.lower(F.regexp_extract("pattern", r"(\w+)", 1))
    literal = (F.col("match_mode") == "literal_word") & (word != "") if "match_mode" in patterns.columns else F.lit(False)
    every = patterns.filter(~F.coalesce(literal, F.lit(False))).select("ord", "term", "pattern")
    if every.limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} regular expressions")
    hits = values.join(F.broadcast(every), F.expr(f"`{column}` rlike concat('(?i)', pattern)")).select(column, "ord", "term")
    if "match_mode" in patterns.columns:
        words = values.select(column, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"(\w+)"), 1))).alias("_w"))
        named = patterns.filter(literal).select("ord", "term", word.alias("_w"), F.regexp_replace("pattern", r"([\\/.\[\](){}|?+*^$-])", r"\\$1").alias("_p"))
        hits = hits.unionByName(words.join(named, "_w").filter(F.expr(f"`{column}` rlike concat('(?i)\\\\b', _p, '\\\\b')")).select(column, "ord", "term"))
    return df.join(hits.groupBy(column).agg(F.min_by("term", "ord").alias("term")), column, "left")


MASK = {"unicode": True, "trim": True, "cas": True, "names": True, "synonyms": True, "isotopes": True, "multi_analyte": True, "chiral": True, "truncated": True, "bare_formula": False, "reference_flags": False}


def normalized_mask(mask: dict[str, bool] | None) -> dict[str, bool]:
    unknown = set(mask or {}) - set(MASK)
    if unknown:
        raise ValueError(f"no such step: {sorted(unknown)}")
    return MASK | (mask or {})


def probes(df: DataFrame, tags: dict[str, str]) -> dict[str, bool]:
    """Whether a step would change anything, for the steps whose absence shows in the table; one aggregate."""
    got = preflight(df, tags).collect()
    return {r["step"]: r["should_run"] for r in got}


def run(df: DataFrame, tags: dict[str, str] | None = None, references: dict | None = None, mask: dict[str, bool] | None = None, use_dedup: bool = True, respect_prechecks: bool = False) -> Step:
    """The whole chain in order. references: strip_terms, stop_words, block_patterns, functional (lists of (mode, pattern) or
    (mode, pattern, term, source)) and isotopes (a table).

    use_dedup: the names' chain runs on distinct names where these are few, and is joined back, with the same result.
    respect_prechecks: one aggregate over the table finds steps that need not run; registry numbers that are all well formed
    are then taken as they are, without a look at their check digits.
    """
    tags, references, on = dict(tags or {}), references or {}, normalized_mask(mask)
    if "original_row_id" not in df.columns:
        df = with_row_ids(df)
    if respect_prechecks:
        would = probes(df, tags)
        on |= {k: on[k] and would[k] for k in ("unicode", "trim", "cas")}
    df = logged(df)

    def take(step: Step) -> DataFrame:
        tags.update(step.new_tags)
        return step.rows

    if on["unicode"]:
        df = take(unicode_step(df))
    if on["trim"]:
        df = take(trim_step(df))
    if on["cas"]:
        df = take(normalize_cas_step(df, tags))
    df = take(rescue_cas_step(df, tags))
    df = take(multi_cas_step(df, tags))
    cols = [c for c in tagged(tags, "Name") if c in df.columns]
    if cols and on["names"]:

        def named(rows: DataFrame) -> Step:
            if on["chiral"]:
                rows = protect_chiral_step(rows, cols).rows
            for step in (strip_enclosures_step, strip_adjectives_step, strip_salts_step, strip_unspecified_step, strip_enclosures_step):
                rows = step(rows, cols).rows
            if references.get("strip_terms"):
                rows = strip_terms_step(rows, cols, [r[:2] for r in references["strip_terms"]]).rows
            return tidy_step(rows, cols)

        seen = [*cols, *(c for c in ("cleaning_flag", *(f"formula_extract_{c}" for c in cols)) if c in df.columns)]
        df = take(deduplicated(named, df, seen) if use_dedup else named(df))
    df = text.fenced(df, [c for c in tags if c in df.columns])
    if cols and on["synonyms"]:
        df = take(split_synonyms_step(df, cols, tags))
        df = take(tidy_step(df, cols))
        df = df.filter(reduce(lambda a, b: a | b, [~text.blank(F.col(c)) for c in cols]))
    if cols and on["isotopes"]:
        df = take(expand_isotopes_step(df, cols, references.get("isotopes"), references.get("isotope_names")))
    if cols and on["multi_analyte"]:
        df = take(flag_multi_analyte_step(df, cols))
    if cols and on["names"] and on["chiral"]:
        df = take(restore_chiral_step(df, cols))
    if cols and on["truncated"]:
        df = take(truncated_step(df, cols))
    if cols and on["bare_formula"]:
        df = take(bare_formula_step(df, cols))
    if cols and on["reference_flags"]:
        for name, kind, label in (("functional", "warning", "functional category"), ("stop_words", "warning", "stop word"), ("block_patterns", "blocking", "blocked pattern")):
            if references.get(name):
                df = take(flag_references_step(df, cols, references[name], kind, label))
    return Step(text.fenced(df, [c for c in tags if c in df.columns]), tags)


def preflight(df: DataFrame, tags: dict[str, str], isotopes: Iterable[str] = (), units: Iterable[str] = (), dates: Iterable[str] = (), media: Iterable[str] = (), durations: Iterable[str] = ()) -> DataFrame:
    """step, est_changes, should_run for every step, from one aggregate over the table."""
    cols, cells = text.string_columns(df), lambda cs, p: reduce(lambda a, b: a + b, [F.sum(F.coalesce(p(F.col(c)), F.lit(False)).cast("long")) for c in cs], F.lit(0).cast("long"))
    name_cols, cas_cols = tagged(tags, "Name"), tagged(tags, "CASRN")
    filled = lambda c: ~text.blank(c.cast("string"))
    codes = "|".join(text.quoted(x) for x in isotopes)
    odd = lambda c: F.lower(F.trim(c)).isin("no cas", "n/a", "na", "proprietary", "none", "-") | c.rlike(r"^\d+$") | ~c.rlike(cas.STRICT)
    aggs = {
        "unicode": cells(cols, lambda c: c.rlike(text.NON_ASCII)),
        "trim": cells(cols, lambda c: text.clean_text_field(c) != c),
        "cas": cells(cas_cols, odd),
        "names": cells(name_cols, filled),
        "isotopes": cells(name_cols, lambda c: c.rlike(rf"(?i)\b({codes})\b")) if codes else F.lit(0).cast("long"),
        "multi_analyte": cells(name_cols, names.is_multi_analyte),
        "chiral": cells(name_cols, lambda c: c.contains("###CHIRAL_")),
        "units": cells(units, filled),
        "durations": cells(durations, filled),
        "dates": cells(dates, filled),
        "media": cells(media, filled),
    }
    got = df.agg(*[F.coalesce(v, F.lit(0).cast("long")).alias(k) for k, v in aggs.items()])
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.col(k).alias("est_changes"), (F.col(k) > 0).alias("should_run")) for k in aggs]))
    return got.select(rows)
