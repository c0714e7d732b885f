"""More queries over the test tables and the same queries in SQL: review, measurements, look-ups, lists, shape and streams.

As in the catalog, dirty inputs are made from the tables by text that both engines read alike, and every query covers its
whole tables and gives a row for each of theirs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, names, text, units
from ..operators import audit, cleaning, consensus, detection, matching, measurements, media, references, review, shape, tags, toxval, unit_build
from ..sources import files
from ..sources.shared import checkpoint_folder, stored
from ..streaming import rows as streams
from .catalog import _query, _t

# --- the cleaning chain -----------------------------------------------------------------------------------------------

_DIRTY = "case cast(p_partkey % 9 as int) when 0 then concat('  ', p_name, ' (pure)') when 1 then concat('Technical ', p_name, '**') when 2 then concat(p_name, ', unspecified') when 3 then concat(p_name, ' and its sodium salts') when 4 then concat('(+)-', p_name) when 5 then concat(p_name, '; xylol') when 6 then concat(p_name, ' (broken') when 7 then concat(p_name, ' + toluol') else concat('é', p_name) end"
_CLEAN = "case k when 4 then '(+)-' || p_name when 6 then p_name || ' (broken' when 7 then p_name || ' + toluol' when 8 then 'e' || p_name else p_name end"
_CHAIN_FLAG = "case k when 4 then 'WARNING: chiral designation' when 6 then 'BLOCK: truncated compound [unbalanced delimiter]' when 7 then 'WARNING: potential multi-analyte' end"
_CHAIN = f"""
with x as (select p_partkey, cast(p_partkey % 9 as int) as k, p_name from part),
y as (select p_partkey, k, {_CLEAN} as name, 1 as synonym_index from x union all select p_partkey, k, 'xylol', 2 from x where k = 5)
select p_partkey, name, case when synonym_index = 1 and p_partkey % 2 = 0 then '67-64-1' end as cas, {_CHAIN_FLAG} as cleaning_flag, case when k = 0 then 'pure' end as formula_extract_name, synonym_index, case k when 5 then 2 else 1 end as synonym_count from y
"""


def _chained(spark, d, use_dedup: bool) -> audit.Step:
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), F.expr(_DIRTY).alias("name"), F.expr("case p_partkey % 2 when 0 then '0067641' else '67-64-2' end").alias("cas"))
    return cleaning.run(df, {"name": "Name", "cas": "CASRN"}, use_dedup=use_dedup)


def _chain_rows(step: audit.Step) -> DataFrame:
    return step.data.select(F.col("original_row_id").alias("p_partkey"), "name", "cas", "cleaning_flag", "formula_extract_name", "synonym_index", "synonym_count")


@_query(_CHAIN)
def cleaning_chain(spark, d):
    """All default steps, names cleaned on distinct values."""
    return _chain_rows(_chained(spark, d, True))


@_query(_CHAIN)
def cleaning_chain_by_row(spark, d):
    return _chain_rows(_chained(spark, d, False))


@_query("""
with x as (select cast(p_partkey as int) as row_id, cast(p_partkey % 9 as int) as k, p_name, p_partkey % 2 = 0 as ok from part)
select row_id, 'cas' as field, 'normalize_cas' as step, case when ok then '0067641' else '67-64-2' end as original_value, case when ok then '67-64-1' else '[NA]' end as new_value from x
union all select row_id, 'name', 'trim_whitespace', case k when 0 then '  ' || p_name || ' (pure)' else 'Technical ' || p_name || '**' end, case k when 0 then p_name || ' (pure)' else 'Technical ' || p_name end from x where k in (0, 1)
union all select row_id, 'name', 'unicode_to_ascii', 'é' || p_name, 'e' || p_name from x where k = 8
union all select row_id, 'name', 'strip_terminal_enclosures', p_name || ' (pure)', p_name from x where k = 0
union all select row_id, 'name', 'strip_quality_adjectives', 'Technical ' || p_name, p_name from x where k = 1
union all select row_id, 'name', 'strip_salt_references', p_name || ' and its sodium salts', p_name from x where k = 3
union all select row_id, 'name', 'strip_terminal_unspecified', p_name || ', unspecified', p_name from x where k = 2
union all select row_id, 'name', 'protect_chiral', '(+)-' || p_name, '###CHIRAL_PLUS###-' || p_name from x where k = 4
union all select row_id, 'name', 'restore_chiral', '###CHIRAL_PLUS###-' || p_name, '(+)-' || p_name from x where k = 4
union all select row_id, 'name', 'split_synonyms', p_name || '; xylol', p_name || ' | xylol' from x where k = 5
""")
def cleaning_audit(spark, d):
    """The whole chain's log."""
    return _chained(spark, d, True).audit.drop("reason")


_FLAGGED = "case cast(p_partkey % 5 as int) when 0 then 'Sample' when 1 then concat('a blank of ', p_name) when 2 then 'proprietary mix' when 3 then '---' else 'Benzene' end"


@_query(f"""
with x as (select cast(p_partkey as int) as row_id, cast(p_partkey % 5 as int) as k, {_FLAGGED} as v from part)
select row_id, 'v' as field, case when k in (0, 1) then 'flag_warning' else 'flag_blocking' end as step, v as original_value,
  case k when 0 then 'WARN: stop word [exact]' when 1 then 'WARN: stop word [substring]' else 'BLOCK: blocked pattern [substring]' end as new_value,
  case k when 0 then 'Matched ''sample'' (source: app_default, match type: exact) in v' when 1 then 'Matched ''blank'' (source: app_default, match type: substring) in v'
    when 2 then 'Matched ''^proprietary'' (source: app_default, match type: substring) in v' else 'Matched ''^-+$'' (source: app_default, match type: substring) in v' end as reason
from x where k < 4
""")
def flag_audit(spark, d):
    """What was flagged, by which term from where, and how it was found."""
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), F.expr(_FLAGGED).alias("v"))
    for kind, how, label in (("stop_words", "warning", "stop word"), ("block_patterns", "blocking", "blocked pattern")):
        df = cleaning.flag_references_step(df, ["v"], references.as_rules(references.default_list(spark, kind)), how, label).rows
    return audit.Step(df).audit


@_query(f"""
select p_partkey, p_partkey % 5 in (2, 3) as blocked from part
""")
def blocked_rows(spark, d):
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), F.expr(_FLAGGED).alias("v"))
    for kind, how, label in (("stop_words", "warning", "stop word"), ("block_patterns", "blocking", "blocked pattern")):
        df = cleaning.flag_references_step(df, ["v"], references.as_rules(references.default_list(spark, kind)), how, label).data
    return df.select(F.col("original_row_id").alias("p_partkey"), matching.blocked().alias("blocked"))


@_query("""
select c_custkey, replace(replace(c_name, 'C', 'e'), '#', ' ') || ' x' as a, 'u ' || c_mktsegment as b from customer
""")
def unicode_frame(spark, d):
    """All text columns of a table: mapped characters, then white space and edge marks."""
    df = _t(spark, d, "customer").select("c_custkey", F.expr("concat(' **', replace(replace(c_name, 'C', 'é'), '#', '  '), ' x_')").alias("a"), F.expr("concat('µ ', c_mktsegment)").alias("b"))
    return text.trim_frame(text.clean_unicode_frame(df))


@_query("""
select p_partkey, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then p_name || ' x' else p_name end as name, case when p_partkey % 3 = 0 then '67-64-1' when p_partkey % 3 = 1 then '50-00-0' end as cas_extract_name from part
""")
def rescue_cas(spark, d):
    """Registry numbers in names: valid ones move to a column of their own, and what looks like one leaves the text."""
    value = F.expr("case p_partkey % 3 when 0 then concat(p_name, ' (67-64-1)') when 1 then concat(p_name, ' 50-00-0 x') else concat(p_name, ' 12-34-5') end")
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), value.alias("name"))
    return cleaning.rescue_cas_step(df, {"name": "Name"}).data.select(F.col("original_row_id").alias("p_partkey"), "name", "cas_extract_name")


@_query("""
select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then '' when 2 then p_name || ' x' else p_name || ' pureness' end as v from part
""")
def strip_terms(spark, d):
    value = F.expr("case p_partkey % 4 when 0 then concat('Purified ', p_name, ' Grade') when 1 then 'unspecified' when 2 then concat(p_name, ' and its zinc salts x') else concat(p_name, ' pureness') end")
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), value.alias("v"))
    terms = references.as_terms(references.default_list(spark, "strip_terms"))
    return cleaning.strip_terms_step(df, ["v"], terms).data.select(F.col("original_row_id").alias("p_partkey"), "v")


@_query("""
select p_partkey, case when p_partkey % 3 = 0 then null else p_name end as v, case when p_partkey % 3 = 0 then 'NaCl' end as formula_blocked_v, case when p_partkey % 3 = 0 then 'BLOCK: bare formula' when p_partkey % 3 = 1 then 'WARN: x' end as cleaning_flag from part
""")
def bare_formula_flags(spark, d):
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), F.expr("case when p_partkey % 3 = 0 then 'NaCl' else p_name end").alias("v"), F.expr("case when p_partkey % 3 < 2 then 'WARN: x' end").alias("cleaning_flag"))
    return cleaning.bare_formula_step(df, ["v"]).data.withColumnRenamed("original_row_id", "p_partkey")


@_query("""
select p_partkey, v, case when p_partkey % 8 = 6 then 'H2O' else '' end as formulas, p_partkey % 8 <> 6 and p_partkey % 4 = 0 as mixture
from (select p_partkey, case when p_partkey % 8 = 6 then p_name || ' (H2O)' when p_partkey % 4 = 0 then p_name || ' 50:50 w/w' else p_name || ' (IV)' end as v from part)
""")
def formulas_and_mixtures(spark, d):
    v = F.expr("case when p_partkey % 8 = 6 then concat(p_name, ' (H2O)') when p_partkey % 4 = 0 then concat(p_name, ' 50:50 w/w') else concat(p_name, ' (IV)') end")
    df = _t(spark, d, "part").select("p_partkey", v.alias("v"))
    return df.select("p_partkey", "v", F.array_join(names.extract_formulas(F.col("v")), "; ").alias("formulas"), names.is_mixture(F.col("v")).alias("mixture"))


@_query("""
with x as (select p_partkey, p_name, p_partkey % 4 as k from part)
select p_partkey, case when k = 1 then 'renamed' when k = 2 then 'a-' || p_partkey when k = 3 then p_name || ' and toluol' else p_name end as name, case k when 1 then 'REVIEWED: multi-analyte renamed' when 2 then 'REVIEWED: multi-analyte split' when 3 then 'REVIEWED: multi-analyte kept' end as cleaning_flag, 1 as multi_analyte_index, case when k = 2 then 2 else 1 end as multi_analyte_count from x
union all select p_partkey, 'b', 'REVIEWED: multi-analyte split', 2, 2 from x where k = 2
""")
def multi_analyte_resolution(spark, d):
    p = _t(spark, d, "part")
    df = p.select(F.col("p_partkey").alias("original_row_id"), F.expr("case p_partkey % 4 when 0 then p_name when 2 then concat('a-', p_partkey, ' + b') else concat(p_name, ' and toluol') end").alias("name"), F.expr("case when p_partkey % 4 > 0 then 'WARNING: potential multi-analyte' end").alias("cleaning_flag"))
    decisions = p.filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("original_row_id"), F.expr("case p_partkey % 4 when 1 then 'Rename' when 2 then 'split' else 'keep-combined' end").alias("action"), F.expr("case p_partkey % 4 when 1 then 'renamed' end").alias("values"))
    got = review.resolve_multi_analyte(df, "name", decisions)
    return got.select(F.col("original_row_id").alias("p_partkey"), "name", "cleaning_flag", "multi_analyte_index", "multi_analyte_count")


@_query("""
select cast(n_nationkey as int) as row_id, 'v' as field, 's' as step, 'a' || n_regionkey as original_value, 'b' || n_regionkey as new_value, 'why' as reason from nation
""")
def audit_remap(spark, d):
    """A log of distinct values, once for every row that has them."""
    r, n = _t(spark, d, "region"), _t(spark, d, "nation")
    log = r.select(F.col("r_regionkey").alias("row_id"), F.lit("v").alias("field"), F.lit("s").alias("step"), F.concat(F.lit("a"), "r_regionkey").alias("original_value"), F.concat(F.lit("b"), "r_regionkey").alias("new_value"), F.lit("why").alias("reason"))
    return audit.remapped(log, n.select(F.col("n_regionkey").alias("row_id"), F.col("n_nationkey").alias("parent_id")))


# --- measurements -----------------------------------------------------------------------------------------------------

_RES, _LIM = "case cast(l_linenumber % 3 as int) when 0 then concat('<', {q}) when 1 then concat({q}, '-', {q}, '0') else 'ND' end", "concat({q}, ' mg')"
_LQ = "cast(cast(l_quantity as bigint) as {s})"


@_query(f"""
with x as (select l_orderkey * 8 + l_linenumber as orig_row_id, cast(l_linenumber % 3 as int) as k, cast(l_quantity as double) as q, {_RES.format(q=_LQ.format(s='varchar'))} as orig_result from (select distinct l_orderkey, l_linenumber, l_quantity from lineitem)),
r as (select orig_row_id, orig_result, 'Result' as measurement_role, case k when 0 then 'as_is' when 1 then b else 'as_is' end as range_bin, case k when 0 then q when 1 then case b when 'low' then q when 'mid' then q * 5.5 else q * 10 end end as numeric_value,
  case k when 0 then '<' when 1 then case b when 'low' then '>=' when 'mid' then '~' else '<=' end else '' end as qualifier, case k when 2 then 'narrative' else '' end as parse_flag from x, (values ('low'), ('mid'), ('high')) as bins(b) where k = 1 or b = 'low')
select *, numeric_value * 0.001::double as harmonized_value, 'mg/L' as harmonized_unit, '' as unit_flag from r
union all select orig_row_id, q::bigint::varchar, 'ReportingLimit', 'as_is', q, '', '', q * 0.001::double, 'mg/L', '' from x
""")
def measurement_roles(spark, d):
    """A result with ranges and narratives beside its reporting limit, corrected, parsed and in common units."""
    q = _LQ.format(s="string")
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").distinct().select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("original_row_id"), F.expr(_RES.format(q=q)).alias("r"), F.expr(_LIM.format(q=q)).alias("l"), F.lit("ug/L").alias("u"))
    _, every = measurements.tagged(df, {"r": "Result", "l": "ReportingLimit", "u": "Unit"}, units.unit_map(spark), corrections=[(r"\s*mg$", "")])
    return every.select("orig_row_id", "orig_result", "measurement_role", "range_bin", "numeric_value", "qualifier", "parse_flag", "harmonized_value", "harmonized_unit", "unit_flag")


@_query("""
select o_orderkey, 24.0 * (o_orderkey % 50) as harmonized_value, 'hr' as harmonized_unit, case when o_orderkey % 2 = 0 then '' else 'case_fallback' end as unit_flag from orders
""")
def durations_by_row(spark, d):
    df = _t(spark, d, "orders").select("o_orderkey", F.expr("cast(o_orderkey % 50 as string)").alias("v"), F.expr("case when o_orderkey % 2 = 0 then 'days' else 'D' end").alias("u"))
    return measurements.durations(df, "v", "u", units.unit_map(spark, durations=True)).select("o_orderkey", F.col("harmonized_value"), "harmonized_unit", "unit_flag")


@_query("""
select p_partkey as orig_row_id, p_partkey * 10 as ord, '' as parse_flag, 1.0::double as conversion_factor, '' as unit_flag, cast(null as double) as harmonized_value from part
""")
def identity_rows(spark, d):
    """Rows of a table without a result column."""
    return measurements.identity(_t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"))).select("orig_row_id", "ord", "parse_flag", "conversion_factor", "unit_flag", "harmonized_value")


_RADIO = "case cast(l_linenumber % 7 as int) when 0 then 'nCi/L' when 1 then 'Bq/L' when 2 then 'mBq per liter' when 3 then 'picocuries/L' when 4 then 'kBq' when 5 then 'ug/L' else 'pci/l' end"


@_query(f"""
select l_orderkey, l_linenumber, l_quantity, {_RADIO} as orig_unit, case cast(l_linenumber % 7 as int) when 0 then 1000.0 when 1 then 27.027027027027 when 2 then 0.027027027027027 when 4 then 27027.027027027 when 5 then 0.001 else 1.0 end::double as conversion_factor,
  case cast(l_linenumber % 7 as int) when 4 then 'pCi' when 5 then 'mg/L' else 'pCi/L' end as harmonized_unit, case when l_linenumber % 7 = 6 then 'case_fallback' else '' end as unit_flag from lineitem
""")
def radiological_map(spark, d):
    """The table of activities in front of others, by row."""
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr(_RADIO).alias("u"))
    got = units.harmonized(df, units.unit_map(spark, spark.sql("select 'ug/L' from_unit, 'mg/L' to_unit, 0.001D multiplier, 'c' category, 'HIGH' confidence, 'x' source union all select 'BQ/L', 'Bq/L', 1D, 'c', 'HIGH', 'x'")), "l_quantity", "u")
    return got.select("l_orderkey", "l_linenumber", "l_quantity", "orig_unit", "conversion_factor", "harmonized_unit", "unit_flag")


@_query("""
select l_orderkey, l_linenumber, l_quantity, 'mg/kg/d' as harmonized_unit, case cast(l_linenumber % 4 as int) when 0 then 'mg/kg bw/day' when 1 then 'MG/KG-DAY' when 2 then 'mg/kg-bw/day' else 'mg per kg per day' end as orig_unit from lineitem
""")
def unit_synonym_rules(spark, d):
    """Exact synonyms in any case, and patterns after them."""
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr("case cast(l_linenumber % 4 as int) when 0 then 'mg/kg bw/day' when 1 then 'MG/KG-DAY' when 2 then 'mg/kg-bw/day' else 'mg per kg per day' end").alias("u"))
    own = [(r["input_pattern"], r["normalized_unit"]) for r in references.unit_synonyms(spark).filter("not is_regex").collect()]
    got = df.withColumn("harmonized_unit", units.synonymous(F.col("u"), (*own, *units.SYNONYMS), [(r"^mg per kg per day$", "mg/kg/d")]))
    return got.withColumnRenamed("u", "orig_unit")


@_query("""
with t as (select distinct 'u' || c_nationkey as orig_unit, c_nationkey from customer)
select orig_unit, case when c_nationkey % 5 = 0 then 'mg/L' else orig_unit end as harmonized_unit, case when c_nationkey % 5 = 0 then '' else 'unmatched' end as unit_flag, case when c_nationkey % 5 = 0 then 2.0 else 1.0 end::double as conversion_factor, n from t join (select c_nationkey, count(*) as n from customer group by 1) using (c_nationkey)
""")
def reharmonized_units(spark, d):
    """Only rows of changed units, and unmatched ones, are converted again when the table changes."""
    df = _t(spark, d, "customer").select("c_custkey", "c_acctbal", F.concat(F.lit("u"), "c_nationkey").alias("u"))
    old = spark.sql("select 0L ord, 'u0' from_unit, 'mg/L' to_unit, 1D multiplier, 'c' category, 'HIGH' confidence, 'user' source")
    new = old.filter("false")
    for i in range(0, 25, 5):
        new = new.unionByName(spark.sql(f"select {i}L ord, 'u{i}' from_unit, 'mg/L' to_unit, 2D multiplier, 'c' category, 'HIGH' confidence, 'user' source"))
    first = units.harmonized(df, old, "c_acctbal", "u").drop("u")
    got = unit_build.reharmonized(first, unit_build.changed_units(old, new), new, lambda rows, table: units.harmonized(rows, table, "c_acctbal", "_unit").drop("_unit"))
    return got.groupBy("orig_unit", "harmonized_unit", "unit_flag", "conversion_factor").agg(F.count("*").alias("n"))


@_query("""
select n_name as from_unit, case when n_nationkey % 3 = 0 then 'mg/L' when n_nationkey % 3 = 1 then 'NEEDS_MW' else 'kg' end as to_unit, case when n_nationkey % 3 = 0 then 1000.0 * n_nationkey when n_nationkey % 3 = 2 then n_nationkey::double end as multiplier, case when n_nationkey % 2 = 0 then 'concentration' else 'mass' end as category from nation
""")
def unit_rebase(spark, d):
    """Raw unit rows rebased to targets; amounts of substance have no factor."""
    n = _t(spark, d, "nation")
    raw = n.select(F.col("n_name").alias("orig"), F.expr("case n_nationkey % 3 when 0 then 'G/L' when 1 then 'mol/L' else 'kg' end").alias("cur_target"), F.col("n_nationkey").cast("double").alias("ecotox_mult"), F.expr("case when n_nationkey % 2 = 0 then '' else ' Mass ' end").alias("domain"), F.col("n_nationkey").alias("ord"))
    got = unit_build.transformed(raw.unionByName(raw.withColumn("ord", F.col("ord") + 100).withColumn("cur_target", F.lit("x"))))
    unit_build.validate_molar(got)
    return got


@_query("""
select n_name as unit from nation where n_nationkey % 2 = 1 order by 1 limit 10
""")
def uncovered_units(spark, d):
    """The first ten, a report's limit, of the targets that no unit covers."""
    n = _t(spark, d, "nation")
    return unit_build.uncovered(n.filter("n_nationkey % 2 = 0").select(F.lower("n_name").alias("unit")), n.select(F.col("n_name").alias("unit")))


@_query("""
select n_name as from_unit, case when n_nationkey % 3 = 0 then 'new' when n_nationkey % 2 = 0 then 'old' else n_name end as to_unit from nation
""")
def unit_upserts(spark, d):
    """A table with a user's rows in place of its own, and every unmatched unit mapped to itself."""
    n = _t(spark, d, "nation")
    row = lambda df, to: df.select(F.col("n_name").alias("from_unit"), F.lit(to).alias("to_unit"), F.lit(1.0).alias("multiplier"), F.lit("user").alias("category"))
    table = unit_build.upserted(row(n.filter("n_nationkey % 2 = 0"), "old"), row(n.filter("n_nationkey % 3 = 0"), "new"))
    return unit_build.passed_through(table, n.select(F.col("n_name").alias("orig_unit"), F.lit("unmatched").alias("unit_flag"))).select("from_unit", "to_unit")


# --- media ------------------------------------------------------------------------------------------------------------


@_query("""
select replace(lower(n_name), '_', ' ') as term, 'r' || n_regionkey as canonical_media, case when n_regionkey = 4 then null else 'aqueous' end as media_category, case when n_nationkey % 5 = 0 then 'user' else 'x' end as source from nation
""")
def media_vocabulary(spark, d):
    """Users' rows before others, one row of a term, categories inferred where all donors agree."""
    n = _t(spark, d, "nation")
    cols = lambda source, category: [F.concat(F.lit(" "), "n_name").alias("term"), F.concat(F.lit("R"), "n_regionkey").alias("canonical_media"), F.lit("E").alias("envo_id"), category.alias("media_category"), F.lit(None).cast("string").alias("parent"), F.lit(source).alias("source"), F.lit("auto").alias("assertion_mode"), F.lit(True).alias("active"), F.col("n_nationkey").alias("ord")]
    donor = F.expr("case when n_regionkey < 4 and n_nationkey < 10 then 'aqueous' when n_regionkey = 4 and n_nationkey < 10 then case when n_nationkey < 5 then 'air' else 'solid' end end")
    own = n.filter("n_regionkey < 4 or n_nationkey >= 10").select(*cols("x", donor))
    fourth = n.filter("n_regionkey = 4 and n_nationkey < 10").select(*cols("x", F.lit(None).cast("string")))
    user = n.filter("n_nationkey % 5 = 0").select(*cols("user", donor))
    return media.prepared(own.unionByName(fourth).unionByName(user)).select("term", "canonical_media", "media_category", "source")


@_query("""
select s_suppkey, case cast(s_suppkey % 4 as int) when 0 then 'n0' when 1 then 'n1' when 2 then 'missing' end as fault_of,
  case cast(s_suppkey % 4 as int) when 0 then 'the node is no leaf' when 1 then 'the route is not the node''s' when 2 then 'unknown node' else 'an active row without a node' end as fault from supplier
""")
def media_canonical_faults(spark, d):
    """Canonical media held against their ontology."""
    nodes = spark.sql("select 'root' node_id, cast(null as string) parent_id, 'media' label, cast(null as string) routing_category, 'x' rank union all select 'n0', 'root', 'water', 'aqueous', 'x' union all select 'n1', 'n0', 'river', cast(null as string), 'x'")
    index = media.ontology_index(nodes).join(nodes.select("node_id", "rank"), "node_id")
    rows = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("canonical_media"), F.expr("case cast(s_suppkey % 4 as int) when 0 then 'n0' when 1 then 'n1' when 2 then 'missing' end").alias("ontology_node_id"), F.expr("case cast(s_suppkey % 4 as int) when 0 then 'aqueous' when 1 then 'air' end").alias("routing_category"), F.lit(True).alias("active"))
    got = media.canonical_faults(rows, index).join(rows, "canonical_media")
    return got.select(F.col("canonical_media").cast("long").alias("s_suppkey"), F.col("ontology_node_id").alias("fault_of"), "fault")


@_query("""
select lower(n_name) as term, 'm' || n_regionkey as canonical, 'm' || n_regionkey as canonical_term, case when n_nationkey % 2 = 0 then 'user' else 'app_default' end as source, case when n_nationkey % 2 = 0 then 'user' else 'auto' end as assertion_mode, n_nationkey % 3 <> 0 as active from nation
""")
def media_display(spark, d):
    n = _t(spark, d, "nation").select(F.concat(F.lit(" "), "n_name").alias("term"), F.concat(F.lit("m"), "n_regionkey").alias("canonical_media"), F.expr("case when n_nationkey % 2 = 0 then 'User ' end").alias("source"), F.expr("n_nationkey % 3 <> 0").alias("active"))
    return media.for_display(n).select("term", "canonical", "canonical_term", "source", "assertion_mode", "active")


@_query("""
select replace(lower(n_name), '_', ' ') as term, 'r' || n_regionkey as canonical_media, 'aqueous' as media_category, case when n_nationkey < 5 then 'x' else 'y' end as source from nation
union all select 'r' || r_regionkey, 'r' || r_regionkey, 'aqueous', 'canonical' from region
""")
def media_runtime(spark, d):
    """Aliases and canonical media as one vocabulary."""
    r, n = _t(spark, d, "region"), _t(spark, d, "nation")
    canonical = r.select(F.concat(F.lit("r"), "r_regionkey").alias("canonical_media"), F.lit("E").alias("envo_id"), F.lit("aqueous").alias("routing_category"), F.lit(True).alias("active"))
    aliases = n.select(F.concat(F.col("n_name"), F.lit(" ")).alias("term"), F.concat(F.lit("r"), "n_regionkey").alias("canonical_media"), F.expr("case when n_nationkey < 5 then 'x' else 'y' end").alias("source"), F.lit(True).alias("active"))
    return media.runtime_map(canonical, aliases).select("term", "canonical_media", "media_category", "source")


@_query("""
with c as (select c_nationkey, count(*) as n from customer group by 1)
select 'm' || c_nationkey as term, c_nationkey < 10 as known, n, case when c_nationkey % 2 = 1 then n else 0 end as n_unmatched from c where c_nationkey < 10 or c_nationkey % 2 = 1
""")
def media_editor(spark, d):
    """Hits of each term, and texts that matched nothing."""
    vocabulary = _t(spark, d, "nation").filter("n_nationkey < 10").select(F.concat(F.lit("m"), "n_nationkey").alias("term"), *[F.lit("x").alias(c) for c in ("canonical_media", "media_category", "source")])
    results = _t(spark, d, "customer").select(F.concat(F.lit(" M"), "c_nationkey").alias("raw_media"), F.expr("case when c_nationkey % 2 = 1 then 'media_unmatched' else '' end").alias("media_flag"))
    return media.editor_rows(vocabulary, results).select("term", "known", "n", "n_unmatched")


@_query("""
select replace(lower(n_name), '_', ' ') as term, case when n_nationkey % 4 = 0 then 'own' else 'm' end as canonical_media, 'air' as media_category, case when n_nationkey % 4 = 0 then 'user' else 'x' end as source from nation
""")
def media_upserts(spark, d):
    n = _t(spark, d, "nation")
    table = n.select(media.media_key(F.col("n_name")).alias("term"), F.lit("m").alias("canonical_media"), F.lit("E").alias("envo_id"), F.lit("air").alias("media_category"), F.lit(None).cast("string").alias("parent"), F.lit("x").alias("source"))
    table = table.unionByName(table.limit(0))
    new = n.filter("n_nationkey % 4 = 0").select(F.concat(F.col("n_name"), F.lit(" ")).alias("term"), F.lit("own").alias("canonical_media"), F.lit("air").alias("media_category"))
    return media.upserted(table, new).select("term", "canonical_media", "media_category", "source")


# --- look-ups ---------------------------------------------------------------------------------------------------------

_CATALOG = "select lower(p_name) || ' ' || p_partkey as search_key, 'D' || p_partkey as dtxsid, p_name as preferred_name, p_name as search_name, cast(p_size % 7 as int) as rank from part"


def _catalog(spark, d):
    return _t(spark, d, "part").select(F.concat(F.lower("p_name"), F.lit(" "), "p_partkey").alias("search_key"), F.concat(F.lit("D"), "p_partkey").alias("dtxsid"), F.col("p_name").alias("preferred_name"), F.col("p_name").alias("search_name"), (F.col("p_size") % 7).cast("int").alias("rank"))


@_query(f"""
with c as ({_CATALOG}), v as (select distinct p_name as search_value from part union select 'xy' union select 'zzzz')
select search_value, dtxsid, preferred_name, rank from (select v.search_value, c.*, row_number() over (partition by v.search_value order by rank, dtxsid) as k from v join c on length(v.search_value) >= 3 and starts_with(search_key, lower(v.search_value))) where k = 1
""")
def prefix_search(spark, d):
    v = _t(spark, d, "part").select(F.col("p_name").alias("search_value")).distinct().unionByName(spark.sql("select 'xy' search_value union all select 'zzzz'"))
    return matching.search_starts_with(v, _catalog(spark, d)).select("search_value", "dtxsid", "preferred_name", "rank")


@_query("""
select p_name || ' ' || p_partkey as search_value, case when p_partkey % 3 > 0 then 'D' || p_partkey end as dtxsid from part where p_partkey % 3 > 0
""")
def exact_search(spark, d):
    p = _t(spark, d, "part")
    catalog = _catalog(spark, d).filter("cast(substr(dtxsid, 2) as long) % 3 > 0")
    worse = catalog.withColumns({"dtxsid": F.lit("A"), "rank": F.lit(99)})
    return matching.search_exact(p.select(F.concat("p_name", F.lit(" "), "p_partkey").alias("search_value")), catalog.unionByName(worse)).select("search_value", "dtxsid")


@_query("""
select count(distinct p_name) as unique_names, count(distinct p_brand) as unique_cas from part where p_partkey % 2 = 0
""")
def dedup_counts(spark, d):
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), F.concat(F.lit(" "), "p_name").alias("name"), F.col("p_brand").alias("cas"), F.expr("p_partkey % 2 = 1").alias("skip"))
    return matching.dedup_preview(df, {"name": "Name", "cas": "CASRN"}, skip=F.col("skip"))


@_query("""
select p_partkey, case when p_partkey % 10 = 0 then 'X' when p_size % 2 = 0 then 'N' || p_size end as dtxsid_a, case when p_partkey % 10 = 0 then 'isotope' when p_size % 2 = 0 then 'exact' else 'miss' end as source_tier_a, case when p_partkey % 10 = 0 then 0 when p_size % 2 = 0 then 1 end as rank_a, 'B' || p_brand as dtxsid_b from part
""")
def mapped_results(spark, d):
    """Results of distinct values back on the rows of two columns, with rows known beforehand."""
    p = _t(spark, d, "part")
    df = p.select(F.col("p_partkey").alias("original_row_id"), F.concat(F.lit(" n"), "p_size").alias("a"), F.col("p_brand").alias("b"))
    found = lambda v, i, ok, tier: p.select(v.alias("search_value"), F.when(ok, i).alias("dtxsid"), F.when(ok, F.lit("nm")).alias("preferred_name"), F.when(ok, 1).alias("rank"), tier.alias("source_tier"), F.lit(0).alias("tier_order")).distinct()
    even = F.col("p_size") % 2 == 0
    results = found(F.concat(F.lit("n"), "p_size"), F.concat(F.lit("N"), "p_size"), even, F.when(even, "exact").otherwise("miss")).unionByName(found(F.col("p_brand"), F.concat(F.lit("B"), "p_brand"), F.lit(True), F.lit("exact")))
    known = df.filter("original_row_id % 10 = 0").select("original_row_id", F.lit("X").alias("dtxsid"), F.lit("iso").alias("name"))
    got = matching.mapped(df, {"a": "Name", "b": "Other"}, results, known.filter("original_row_id % 10 = 0"))
    return got.select(F.col("original_row_id").alias("p_partkey"), "dtxsid_a", "source_tier_a", "rank_a", F.expr("case when original_row_id % 10 = 0 then concat('B', b) else dtxsid_b end").alias("dtxsid_b"))


@_query("""
select 'D' || n_nationkey as dtxsid, case when n_nationkey < 5 then 'cached' when n_nationkey % 2 = 0 then n_name end as detail, case when n_nationkey >= 5 and n_nationkey % 2 = 0 then 'a|b' || n_nationkey end as synonyms from nation
""")
def enrichment(spark, d):
    """A cache with the details of ids that it lacked; ids without any are rows of nulls."""
    n = _t(spark, d, "nation")
    ids = n.select(F.concat(F.lit("D"), "n_nationkey").alias("dtxsid"))
    details = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("D"), "n_nationkey").alias("dtxsid"), F.col("n_name").alias("detail"), matching.flattened_synonyms(F.array(F.lit("a"), F.lit("")), F.array(F.concat(F.lit("b"), "n_nationkey"), F.lit("a")), F.lit(None).cast("array<string>")).alias("synonyms"))
    cache = n.filter("n_nationkey < 5").select(F.concat(F.lit("D"), "n_nationkey").alias("dtxsid"), F.lit("cached").alias("detail"), F.lit(None).cast("string").alias("synonyms"))
    return matching.enriched(ids, details, cache)


@_query("""
select 'D' || n_nationkey as dtxsid, n_nationkey % 2 = 0 as is_valid, case when n_nationkey % 2 = 0 then n_name end as preferred_name from nation
""")
def manual_ids(spark, d):
    n = _t(spark, d, "nation")
    catalog = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("D"), "n_nationkey").alias("dtxsid"), F.col("n_name").alias("preferred_name"))
    return matching.validated_ids(n.select(F.concat(F.lit(" d"), "n_nationkey").alias("dtxsid")), catalog)


@_query("""
select n_name || ' ' as value, case when n_nationkey % 3 = 0 then n_name when n_nationkey % 3 = 1 then 'C' || n_nationkey end as canonical_name from nation
""")
def wqx_override_names(spark, d):
    n = _t(spark, d, "nation")
    dictionary = n.filter("n_nationkey % 3 = 0").select(F.lit("x").alias("name"), F.col("n_name").alias("canonical_name")).unionByName(n.filter("n_nationkey % 3 = 1").select(F.col("n_name").alias("name"), F.concat(F.lit("C"), "n_nationkey").alias("canonical_name")))
    return review.wqx_names(n.select(F.concat("n_name", F.lit(" ")).alias("value")), dictionary)


@_query("""
select n_name || case when n_nationkey % 2 = 0 then ' (canonical)' else ' (alias)' end as label, 'C' || n_nationkey as canonical_name from nation
""")
def wqx_choices(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("C"), "n_nationkey").alias("canonical_name"), F.expr("case when n_nationkey % 2 = 0 then 'canonical' else 'synonym' end").alias("type"))
    return review.wqx_choices(n.unionByName(n.limit(0)))


# --- consensus and review ---------------------------------------------------------------------------------------------

_CAND = "select p_partkey, p_name as name, 'A' || p_partkey as dtxsid_a, case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then 'A' || p_partkey else 'B' || p_partkey end as dtxsid_b, p_name as pa, case when p_partkey % 5 = 2 then reverse(p_name) else p_name || 'x' end as pb from part"


def _candidates(spark, d):
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), F.col("p_name").alias("name"), F.concat(F.lit("A"), "p_partkey").alias("dtxsid_a"), F.expr("case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then concat('A', p_partkey) else concat('B', p_partkey) end").alias("dtxsid_b"), F.col("p_name").alias("preferredName_a"), F.expr("case when p_partkey % 5 = 2 then reverse(p_name) else concat(p_name, 'x') end").alias("preferredName_b"))
    return consensus.with_state(consensus.classified(df))


_SCORES = f"with c as ({_CAND}), s as (select *, case when pa = name then 1.0 else jaro_similarity(lower(name), lower(pa)) end as sa, jaro_similarity(lower(name), lower(pb)) as sb, dtxsid_b is not null and dtxsid_a <> dtxsid_b as disagree from c)"


@_query(f"""
{_SCORES} select p_partkey, case when disagree then round(greatest(sa, sb), 6) end as similarity_score from s
""")
def similarity_scores(spark, d):
    got = consensus.with_scores(_candidates(spark, d), "name")
    return got.select(F.col("original_row_id").alias("p_partkey"), F.round("similarity_score", 6).alias("similarity_score"))


_AUTO = f"""{_SCORES},
r as (select *, disagree and sa >= 0.95 and sa - sb >= 0.15 as good from s)
"""


@_query(f"""
{_AUTO} select p_partkey, case when good then 'auto_resolved' when disagree then 'suggested' when dtxsid_b is null then 'single' else 'agree' end as consensus_status, case when good then dtxsid_a when not disagree then dtxsid_a end as consensus_dtxsid, good as pinned, case when good then 'auto' end as resolution_method, case when disagree then 'dtxsid_a' end as suggested_column from r
""")
def auto_resolution(spark, d):
    got = consensus.auto_resolved(_candidates(spark, d), "name")
    return got.select(F.col("original_row_id").alias("p_partkey"), "consensus_status", "consensus_dtxsid", "pinned", "resolution_method", "suggested_column")


@_query(f"""
{_AUTO} select p_partkey, case when good then 'auto_resolved' when disagree then 'manual' when dtxsid_b is null then 'single' else 'agree' end as consensus_status, dtxsid_a as consensus_dtxsid, disagree as pinned, case when good then 'auto' when disagree then 'bulk-accept' end as resolution_method from r
""")
def accepted_suggestions(spark, d):
    got = consensus.accepted(consensus.auto_resolved(_candidates(spark, d), "name"))
    return got.select(F.col("original_row_id").alias("p_partkey"), "consensus_status", "consensus_dtxsid", "pinned", "resolution_method")


@_query(f"""
with c as ({_CAND}), x as (select *, case when dtxsid_b is null then 'single' when dtxsid_a = dtxsid_b then 'agree' else 'disagree' end as s from c)
select p_partkey, case when p_partkey % 3 = 0 and dtxsid_b is not null then 'manual' else s end as consensus_status, case when p_partkey % 3 = 1 then null when p_partkey % 3 = 0 and dtxsid_b is not null then dtxsid_b when s = 'disagree' then null else dtxsid_a end as consensus_dtxsid,
  p_partkey % 3 = 1 or (p_partkey % 3 = 0 and dtxsid_b is not null) as pinned, case when p_partkey % 3 = 1 then 'skip' when p_partkey % 3 = 0 and dtxsid_b is not null then 'manual' end as resolution_method,
  case when p_partkey % 2 = 0 then 'FOLLOW-UP' end as row_flag, case when p_partkey % 2 = 0 then 'look' end as row_flag_reason from x
""")
def manual_resolution(spark, d):
    """A picked candidate, rows pinned without one, and flags."""
    got = consensus.resolved(_candidates(spark, d), F.lit("dtxsid_b"), F.col("original_row_id") % 3 == 0)
    got = consensus.skipped(got, F.col("original_row_id") % 3 == 1)
    got = consensus.flagged(got, F.col("original_row_id") % 2 == 0, "follow-up", " look ")
    return got.select(F.col("original_row_id").alias("p_partkey"), "consensus_status", "consensus_dtxsid", "pinned", "resolution_method", "row_flag", "row_flag_reason")


@_query(f"""
with c as ({_CAND}) select p_partkey, case when dtxsid_b is null then dtxsid_a when p_partkey % 2 = 0 then dtxsid_b || ',' || dtxsid_a else dtxsid_a || ',' || dtxsid_b end as candidates from c
""")
def resolution_options(spark, d):
    df = _candidates(spark, d).withColumns({"rank_a": F.lit(3), "rank_b": F.expr("case when original_row_id % 2 = 0 then 1 end")})
    got = consensus.options(df, ["dtxsid_a", "dtxsid_b"])
    return got.select(F.col("original_row_id").alias("p_partkey"), F.array_join(F.transform("candidates", lambda x: x["id"]), ",").alias("candidates"))


@_query(f"""
with c as ({_CAND}) select distinct id as dtxsid from (select unnest(case when dtxsid_b is not null and dtxsid_a <> dtxsid_b then [dtxsid_a, dtxsid_b] else [dtxsid_a] end) as id from c)
""")
def candidate_ids(spark, d):
    return consensus.candidate_ids(_candidates(spark, d), ["dtxsid_a", "dtxsid_b"])


@_query("""
select p_partkey, case when p_partkey % 4 = 0 then 'wqx' else case when p_partkey % 4 = 1 then 'disagree' else 'single' end end as consensus_status, case when p_partkey % 4 > 1 then 'D' || p_partkey end as consensus_dtxsid from part
""")
def evidence_conflicts(spark, d):
    """A name found without an id disagrees with another column's id; alone it is evidence of its own."""
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), F.expr("case when p_partkey % 4 > 0 then concat('D', p_partkey) end").alias("dtxsid_a"), F.lit(None).cast("string").alias("dtxsid_b"), F.lit("silica").alias("preferredName_a"), F.expr("case p_partkey % 4 when 0 then 'gold' when 1 then 'gold' when 2 then 'silica' end").alias("preferredName_b"), F.lit("exact").alias("source_tier_a"), F.expr("case when p_partkey % 4 < 3 then 'wqx_exact' else 'miss' end").alias("source_tier_b"))
    return consensus.classified(df).select(F.col("original_row_id").alias("p_partkey"), "consensus_status", "consensus_dtxsid")


@_query("""
select p_partkey, case when p_partkey % 3 = 0 then case when p_partkey % 2 = 0 then 'unresolvable' else 'single' end else 'error' end as consensus_status, case when p_partkey % 3 = 0 and p_partkey % 2 = 1 then 'R' || p_partkey end as dtxsid from part
""")
def retried_rows(spark, d):
    """Selected rows take a second run's results; an error that stays one is unresolvable."""
    p = _t(spark, d, "part")
    was = consensus.with_state(p.select(F.col("p_partkey").alias("original_row_id"), F.lit(None).cast("string").alias("dtxsid"), F.lit("error").alias("consensus_status"), F.lit(None).cast("string").alias("consensus_dtxsid"), F.lit(None).cast("string").alias("consensus_source"), F.lit(3).alias("qc_tier")))
    now = p.select(F.col("p_partkey").alias("original_row_id"), F.expr("case when p_partkey % 2 = 1 then concat('R', p_partkey) end").alias("dtxsid"), F.expr("case when p_partkey % 2 = 1 then 'single' else 'error' end").alias("consensus_status"), F.lit(None).cast("string").alias("consensus_dtxsid"), F.lit(None).cast("string").alias("consensus_source"), F.lit(1).alias("qc_tier"))
    got = consensus.merged_retry(was, now, p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("original_row_id")))
    return got.select(F.col("original_row_id").alias("p_partkey"), "consensus_status", "dtxsid")


@_query("""
select o_orderkey, case when o_orderstatus = 'F' then 'BAD' when o_orderpriority = '1-URGENT' then 'VERIFIED' end as row_flag from orders
""")
def override_round_trip(spark, d):
    """Edits recorded by content and replayed on the table in another order."""
    before = consensus.with_state(_t(spark, d, "orders").select(F.col("o_orderkey").alias("original_row_id"), "o_orderpriority", "o_orderstatus"))
    after = before.withColumn("row_flag", F.expr("case when o_orderstatus = 'F' then 'BAD' when o_orderpriority = '1-URGENT' then 'VERIFIED' end"))
    spec = review.build(before, after)
    return review.replayed(before, spec).select(F.col("original_row_id").alias("o_orderkey"), "row_flag")


@_query("""
select c_custkey, case when c_custkey % 7 = 0 then 'X' when c_mktsegment = 'BUILDING' then 'B' || c_nationkey else c_mktsegment end as v from customer
""")
def override_priorities(spark, d):
    """Of overrides that match one row the last wins; each set of signature columns is one join."""
    df = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", (F.col("c_custkey") % 7 == 0).alias("seventh"), F.col("c_mktsegment").alias("v"))
    spec = [review.Override("v", f"B{i}", {"c_mktsegment": "BUILDING", "c_nationkey": i}) for i in range(25)] + [review.Override("v", "X", {"seventh": True})]
    return review.replayed(df, review.Spec(spec)).select("c_custkey", "v")


@_query("""
select p_partkey from part where (p_partkey % 4 = 0) or (p_partkey % 4 = 1 and p_partkey % 3 > 0)
""")
def review_filter(spark, d):
    """Rows in error, and rows neither assigned nor flagged."""
    df = consensus.with_state(_t(spark, d, "part").select("p_partkey", F.expr("case when p_partkey % 4 = 0 then 'error' else 'single' end").alias("consensus_status"), F.expr("case when p_partkey % 4 = 1 then ' ' else 'D' end").alias("consensus_dtxsid"))).withColumn("row_flag", F.expr("case when p_partkey % 3 = 0 then 'BAD' end"))
    return review.filtered(df, errors=True, untagged=True).select("p_partkey")


@_query("""
select c_custkey, case when c_nationkey % 2 = 0 then 'yes' else 'no' end as decision from customer
""")
def group_decisions(spark, d):
    """A decision on a displayed row holds for its whole group, nulls being equal."""
    df = _t(spark, d, "customer").select("c_custkey", F.expr("case when c_nationkey > 0 then c_nationkey end").alias("k"), F.lit("no").alias("decision"))
    shown = review.grouped_rows(df, ["k"], "c_custkey").filter("k is null or k % 2 = 0")
    return review.decided(df, shown.select("k", F.lit("yes").alias("decision")), ["k"]).select("c_custkey", "decision")


@_query("""
select p_partkey, case when p_partkey % 3 = 0 then 'b' when p_partkey % 3 = 1 then 'a' else 'b' end as name, case p_partkey % 3 when 1 then 'Exact name' else 'Prefix' end as match_type from part
""")
def aligned_values(spark, d):
    """The name of the consensus's source, else of the column whose id it is; and how it was matched."""
    df = _t(spark, d, "part").select("p_partkey", F.lit("A").alias("dtxsid_x"), F.lit("B").alias("dtxsid_y"), F.lit("a").alias("preferredName_x"), F.lit("b").alias("preferredName_y"), F.lit("exact").alias("source_tier_x"), F.lit("starts_with").alias("source_tier_y"), F.expr("case p_partkey % 3 when 0 then 'y' when 1 then 'x' end").alias("consensus_source"), F.expr("case when p_partkey % 3 = 2 then 'B' end").alias("consensus_dtxsid"))
    return df.select("p_partkey", review.aligned(df, "preferredName").alias("name"), review.match_type(df).alias("match_type"))


@_query("""
select n_nationkey, case when n_nationkey < 5 then 'D1' when n_nationkey < 8 then null else 'old' end as consensus_dtxsid, case when n_nationkey < 5 then 'manual' when n_nationkey < 8 then 'wqx' else 'single' end as consensus_status, n_nationkey < 8 as pinned from nation
""")
def queued_overrides(spark, d):
    """The newest of entries that share a row; ids that no catalog has are left out."""
    df = consensus.with_state(_t(spark, d, "nation").select(F.col("n_nationkey").alias("original_row_id"), F.lit("old").alias("consensus_dtxsid"), F.lit("single").alias("consensus_status"), F.lit("x").alias("consensus_source")))
    queue: list[review.Queued] = []
    for entry in (review.Queued(frozenset(range(3)), "dtxsid", "d9"), review.Queued(frozenset(range(5)), "DTXSID", " d1 "), review.Queued(frozenset(range(5, 8)), "wqx", "Name"), review.Queued(frozenset(range(8, 10)), "dtxsid", "D7")):
        queue = review.queued(queue, entry)
    valid = spark.sql("select 'D1' dtxsid, true is_valid union all select 'D7', false")
    got = review.apply_queue(df, queue, valid)
    return got.select(F.col("original_row_id").alias("n_nationkey"), "consensus_dtxsid", "consensus_status", "pinned")


@_query("""
select c_custkey, 'name = ''' || c_name || '''' || case when c_custkey % 2 = 0 then '; key = ''' || c_nationkey || '''' else '' end as cells from customer
""")
def tagged_cells(spark, d):
    df = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.expr("case when c_custkey % 2 = 0 then c_nationkey end").alias("key"))
    return review.tagged_values(df, {"name": "Name", "key": "CASRN", "gone": "Other"}, "c_custkey").select("c_custkey", F.array_join("cells", "; ").alias("cells"))


@_query("""
select p_partkey, case when p_partkey % 2 = 0 then 'VERIFIED' end as row_flag, p_partkey % 3 = 0 as pinned, 'single' as consensus_status from part
""")
def session_restore(spark, d):
    """Review state written with an export and laid over the curated table again."""
    df = consensus.with_state(_t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), F.lit("single").alias("consensus_status")))
    state = df.withColumns({"row_flag": F.expr("case when original_row_id % 2 = 0 then 'VERIFIED' end"), "pinned": F.expr("original_row_id % 3 = 0")})
    folder = f"{checkpoint_folder(spark)}/export-{uuid.uuid4().hex}"
    files.write_export(files.export_sheets(spark, {"Curated Data": df, "Session State": files.session_state(state, consensus.summary(state), consensus.REVIEW)}, {"name": "Name"}), folder)
    got = files.hydrated(files.read_export(spark, folder))
    return got.curated.select(F.col("original_row_id").alias("p_partkey"), "row_flag", "pinned", "consensus_status")


# --- detection and output ---------------------------------------------------------------------------------------------


@_query("""
select event_id, case when event_id % 3 = 0 then value * 2 when event_id % 3 = 1 then value end as u from events where event_id % 3 < 2 or event_id % 3 = 2
""")
def two_sigma(spark, d):
    df = _t(spark, d, "events")
    return df.select("event_id", detection.two_sigma(F.expr("case when event_id % 3 = 2 then -1D else value end"), F.expr("case when event_id % 3 = 0 then ' One_Sigma' else '2sigma' end")).alias("u"))


@_query("""
select event_id, case when event_id % 2 = 0 then event_type || '; J' else event_type end as q, case when event_id % 2 = 0 and value > 50 then 'a; b' when event_id % 2 = 0 then 'a' when value > 50 then 'b' end as why from events
""")
def combined_qualifiers(spark, d):
    df = _t(spark, d, "events")
    q = detection.combined([F.concat(F.lit(" "), "event_type"), F.expr("case when event_id % 2 = 0 then 'J' else event_type end"), F.lit("")])
    return df.select("event_id", q.alias("q"), detection.reasons({"a": F.col("event_id") % 2 == 0, "b": F.col("value") > 50}).alias("why"))


@_query("""
select p_partkey, p_partkey % 2 = 0 as result_flag, case when p_partkey % 2 = 0 then 'robust_reportable_detect' else 'non_reportable' end as detection_event_class from part
""")
def attached_detection(spark, d):
    """The collapsed columns in place of any of their names that a table has."""
    p = _t(spark, d, "part")
    events = detection.classified(p.select(F.col("p_partkey").alias("orig_row_id"), F.lit(0).alias("ord"), F.expr("case when p_partkey % 2 = 0 then 2D else 0.5D end").alias("result_value"), F.lit(1.0).alias("reporting_limit_value")))
    df = p.select(F.col("p_partkey").alias("original_row_id"), F.lit("old").alias("detection_event_class"))
    return detection.attached(df, detection.collapsed(events)).select(F.col("original_row_id").alias("p_partkey"), "result_flag", "detection_event_class")


@_query("""
select p_partkey as orig_row_id, 'indeterminate' as detection_event_class, 'missing_result' as detection_basis, false as result_flag, true as detection_review_flag from part
""")
def undetermined_rows(spark, d):
    got = detection.undetermined(_t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id")))
    return got.select("orig_row_id", "detection_event_class", "detection_basis", "result_flag", "detection_review_flag")


@_query("""
select p_partkey as n, p_name as name, 'toxval_numeric' as column_name, 0 as rows_of_empty from part
""")
def empty_output(spark, d):
    """The output's schema: the tenth column of an empty table, which is joined to every row."""
    none = toxval.empty(spark)
    toxval.assert_typed(none)
    return _t(spark, d, "part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("name"), F.lit(none.columns[9]).alias("column_name"), F.lit(none.count()).cast("int").alias("rows_of_empty"))


# --- reference lists --------------------------------------------------------------------------------------------------


@_query("""
select n_name as term, case when n_nationkey % 2 = 0 then n_name else 'p' end as pattern, case when n_nationkey % 3 = 0 then 'regex' else 'literal_word' end as match_mode, n_nationkey % 5 > 0 as active from nation
""")
def normalized_list(spark, d):
    df = _t(spark, d, "nation").select(F.concat(F.lit(" "), "n_name").alias("term"), F.expr("case when n_nationkey % 2 = 0 then ' ' else 'p' end").alias("pattern"), F.expr("case when n_nationkey % 3 = 0 then 'regex' end").alias("match_mode"), F.lit("user").alias("source"), F.expr("n_nationkey % 5 > 0").alias("active"))
    return references.normalized(df.unionByName(df.limit(1).withColumn("term", F.lit("  "))), "stop_words").select("term", "pattern", "match_mode", "active")


@_query("""
with u as (select 'sample' as term, 'user' as source, false as active union all select n_name, 'user', true from nation)
select term, source, active from u union all select t, 'app_default', true from (values ('test'), ('unknown'), ('blank'), ('standard'), ('control'), ('reference'), ('placeholder'), ('tbd'), ('tba'), ('na'), ('n/a'), ('none'), ('not available'), ('not applicable')) as x(t)
""")
def merged_list(spark, d):
    """A default list under what users changed, through their table in a folder."""
    folder = f"{checkpoint_folder(spark)}/lists-{uuid.uuid4().hex}"
    rows = _t(spark, d, "nation").select(F.col("n_name").alias("term"), F.lit("user").alias("source"), F.lit(True).alias("active"))
    rows = rows.unionByName(spark.sql("select 'sample' term, 'user' source, false active"))
    default = references.default_list(spark, "stop_words")
    references.save_user_lists({"stop_words": references.merged(default, references.normalized(rows, "stop_words"))}, folder)
    return references.all_lists(spark, folder)["stop_words"].select("term", "source", "active")


@_query("""
select n_name as term, n_nationkey % 2 = 0 as active from nation where n_nationkey > 0 union all select 'added', true
""")
def updated_list(spark, d):
    """A term added, one removed, and every second toggled."""
    df = _t(spark, d, "nation").select(F.col("n_name").alias("term"), F.col("n_name").alias("pattern"), F.lit("literal_word").alias("match_mode"), F.lit("user").alias("source"), F.expr("n_nationkey % 2 = 1").alias("active"), F.lit(None).cast("string").alias("notes"))
    got = references.updated(df, spark, "added")
    first = _t(spark, d, "nation").agg(F.min_by("n_name", "n_nationkey")).first()[0]
    got = references.updated(got, spark, first, "remove")
    return got.withColumn("active", F.when(F.col("term") == "added", F.col("active")).otherwise(~F.col("active"))).select("term", "active")


@_query("""
select n_name as term, case when n_nationkey % 4 = 0 then 'changed' else n_name end as pattern from nation
""")
def list_snapshot(spark, d):
    """What differs from the defaults, laid over them again after their hash has been checked."""
    base = _t(spark, d, "nation").select(F.col("n_name").alias("term"), F.col("n_name").alias("pattern"), F.lit("literal_word").alias("match_mode"), F.lit("app_default").alias("source"), F.lit(True).alias("active"), F.lit(None).cast("string").alias("notes"))
    own = _t(spark, d, "nation").select(F.col("n_name").alias("term"), F.expr("case when n_nationkey % 4 = 0 then 'changed' else n_name end").alias("pattern"), F.lit("literal_word").alias("match_mode"), F.lit("app_default").alias("source"), F.lit(True).alias("active"), F.lit(None).cast("string").alias("notes"))
    return references.reconstructed(base, references.overrides(own, base), references.snapshot_hash(base.repartition(3))).select("term", "pattern")


@_query("""
select n_name as term from nation union select 'a' || n_regionkey from nation union select 'b' from nation
""")
def functional_terms(spark, d):
    df = _t(spark, d, "nation").select(F.concat("n_name", F.lit(" (EPA) (a"), "n_regionkey", F.lit("; b)")).alias("category"))
    return references.functional_categories(df)


@_query("""
select n_name as name, n_name as canonical_name, 'canonical' as type from nation
union all select 'o' || n_nationkey, n_name, case n_nationkey % 4 when 0 then 'standardize' when 1 then 'synonym' else 'retired' end from nation where n_nationkey % 4 < 3
""")
def wqx_dictionary(spark, d):
    n = _t(spark, d, "nation")
    aliases = n.select(F.concat(F.lit("o"), "n_nationkey").alias("name"), F.col("n_name").alias("canonical_name"), F.expr("case n_nationkey % 4 when 0 then 'STANDARDIZED' when 1 then 'Synonym' when 2 then 'retired name' else 'other' end").alias("alias_type"))
    return references.wqx_dictionary(n.select(F.col("n_name").alias("name")), aliases)


@_query("""
select 'X' || chr(cast(97 + n_nationkey as int)) as symbol, lower('X' || chr(cast(97 + n_nationkey as int)) || (100 + n_nationkey)) as shortcode, n_name || '-' || (100 + n_nationkey) as canonical from nation
""")
def isotope_table(spark, d):
    n = _t(spark, d, "nation").select(F.concat(F.lit("X"), F.expr("chr(97 + n_nationkey)")).alias("element"), (F.col("n_nationkey") + 100).alias("Z"), F.col("n_name").alias("Name"))
    return references.isotope_lookup(n.unionByName(n)).select("symbol", "shortcode", "canonical")


@_query("""
select p_partkey, case when p_partkey % 4 = 0 then 't0' when p_partkey % 4 = 1 then 't1' when p_partkey % 4 = 2 then 't2' end as term from part
""")
def listed_terms(spark, d):
    """The first of a long list's patterns in each value: literal words by their first word, others one by one."""
    df = _t(spark, d, "part").select("p_partkey", F.expr("case p_partkey % 4 when 0 then concat('a Red-Oxide ', p_partkey) when 1 then concat(p_partkey, 'x5') when 2 then 'blue' else 'bluex' end").alias("v"))
    patterns = spark.sql("select 0 ord, 't0' term, 'red-oxide' pattern, 'literal_word' match_mode union all select 1, 't1', '^[0-9]+x', 'regex' union all select 2, 't2', 'BLUE', 'literal_word' union all select 3, 't3', 'a', 'literal_word'")
    return cleaning.first_match(df, "v", patterns).select("p_partkey", "term")


# --- tables as a whole ------------------------------------------------------------------------------------------------


@_query("""
select p_partkey + 4 as _row, p_name as "Chemical Name", p_brand as "CAS Number", cast(p_size as varchar) as "Result" from part
""")
def detected_table(spark, d):
    """A sheet with lines above its header: where the data starts, the names, and no empty rows or columns."""
    top = spark.sql("select 1L _row, 'Report' V1, cast(null as string) V2, cast(null as string) V3, cast(null as string) V4 union all select 2L, null, null, null, null union all select 3L, 'Chemical Name', 'CAS Number', 'Result', ''")
    grid = top.unionByName(_t(spark, d, "part").select((F.col("p_partkey") + 4).alias("_row"), F.col("p_name").alias("V1"), F.col("p_brand").alias("V2"), F.col("p_size").cast("string").alias("V3"), F.lit(" ").alias("V4")))
    return shape.without_empty(shape.sliced(grid, shape.detect_start(grid)))


@_query("""
select row_number() over (order by c_custkey) as _row, cast(c_custkey as varchar) as "V1", c_name || '; "x"' as "V2", case when c_custkey % 2 = 0 then c_mktsegment end as "V3" from customer
""")
def csv_grid(spark, d):
    """A file with another delimiter and quoted fields, read as a grid in its order."""
    path = f"{checkpoint_folder(spark)}/grid-{uuid.uuid4().hex}"
    rows = _t(spark, d, "customer").orderBy("c_custkey").select("c_custkey", F.concat("c_name", F.lit('; "x"')), F.expr("case when c_custkey % 2 = 0 then c_mktsegment end"))
    rows.coalesce(1).write.csv(path, sep=";", escape='"', quoteAll=True, emptyValue="")
    return files.read_csv(spark, path)


@_query("""
select * from (values ('Chemical Name', 'Name', 'chemical'), ('CAS Number', 'CASRN', 'chemical'), ('Result Value', 'Result', 'numeric'), ('Units', 'Unit', 'numeric'), ('Reporting Limit', 'ReportingLimit', 'numeric'), ('Sample Matrix', 'Media', 'metadata'), ('Test Species', 'Species', 'study'), ('Exposure Duration', 'Duration', 'numeric'), ('Duration Units', 'DurationUnit', 'numeric')) as t(header, tag, kind)
""")
def tag_suggestions(spark, d):
    """Roles of headers, and their groups."""
    headers = ["Chemical Name", "CAS Number", "Sample ID", "Result Value", "Units", "Reporting Limit", "Sample Matrix", "Test Species", "Exposure Duration", "Duration Units", "x"]
    got = tags.suggest(headers)
    kinds = {c: g for g, m in tags.grouped(got).items() for c in m}
    return spark.createDataFrame([(c, t, kinds[c]) for c, t in got.items()], "header string, tag string, kind string")


@_query("""
select * from (values ('size', '0', '0 B'), ('size', '1536', '1.5 KB'), ('size', '5242880', '5.0 MB'), ('size', '3221225472', '3.0 GB'), ('preview', '100', '50'), ('preview', '1000', '25'), ('preview', '1001', '10'), ('list', 'Stop Words', 'stop_words'), ('list', 'block pattern', 'block_patterns'), ('mode', '^x$', 'regex'), ('flag', ' bad', 'BAD'), ('pairs', 'Result', 'a Result without a Unit'), ('changed', 'a', 'Name>CASRN'), ('likeness', 'a,b,1', '0.444')) as t(what, given, made)
""")
def driver_rules(spark, d):
    """Rules that work on headers and settings, not on rows."""
    change = tags.changed({"a": "Name", "b": "Unit"}, {"b": "Unit", "a": "CASRN"})
    rows = [("size", str(n), files.format_size(n)) for n in (0, 1536, 5 << 20, 3 << 30)] + [("preview", str(n), str(shape.preview_rows(n))) for n in (100, 1000, 1001)]
    rows += [("list", x, references.list_type(x)) for x in ("Stop Words", "block pattern")] + [("mode", "^x$", references.default_mode("strip_terms", "^x$")), ("flag", " bad", consensus.normalized_flag(" bad"))]
    rows += [("pairs", "Result", tags.pairing_warnings({"x": "Result"})[0]), *[("changed", c, ">".join(v)) for c, v in change.items()], ("likeness", "a,b,1", f"{shape.header_likeness(['a', 'b', '1']):.3f}")]
    return spark.createDataFrame(rows, "what string, given string, made string")


@_query("""
select o_orderkey, strftime(o_orderdate, '%d') || upper(strftime(o_orderdate, '%b')) || strftime(o_orderdate, '%Y') as raw_date, strftime(o_orderdate, '%Y-%m-%d') as parsed_date, cast(year(o_orderdate) as integer) as date_year, case when day(o_orderdate) <= 12 then 'ambiguous' else '' end as date_flag from orders
""")
def named_months(spark, d):
    df = _t(spark, d, "orders").select("o_orderkey", F.upper(F.date_format("o_orderdate", "ddMMMyyyy")).alias("t"))
    return dates.with_dates(df, "t").drop("t")


# --- streams ----------------------------------------------------------------------------------------------------------


def _streamed(spark, d, table: str, made, label: str, mode: str = "append") -> DataFrame:
    """The rows that a stream over a table's file writes until it has read all there is."""
    base = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    source = _t(spark, d, table)
    out = made(spark.readStream.schema(source.schema).parquet(f"{d}/{table}.parquet*"))

    def kept(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/rows")

    out.writeStream.outputMode(mode).foreachBatch(kept).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


@_query("""
select p_partkey, p_name as name, 'e' || p_brand as b from part
""")
def stream_cleaned(spark, d):
    tagged = lambda s: s.select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(" (pure)")).alias("name"), F.concat(F.lit("é"), "p_brand", F.lit("**")).alias("b"))
    return _streamed(spark, d, "part", lambda s: streams.cleaned(tagged(s), {"name": "Name"}).select("p_partkey", "name", "b"), "stream-cleaned")


@_query("""
select l_orderkey, l_linenumber, l_quantity, l_quantity * case when l_linenumber % 2 = 0 then 0.001 else 1.0 end::double as harmonized_value, case when l_linenumber % 2 = 0 then 'mg/L' else 'zz' end as harmonized_unit from lineitem
""")
def stream_converted(spark, d):
    made = lambda s: streams.converted(s.select("l_orderkey", "l_linenumber", "l_quantity", F.expr("case when l_linenumber % 2 = 0 then 'ug/L' else 'zz' end").alias("u")), units.unit_map(spark), "l_quantity", "u").select("l_orderkey", "l_linenumber", "l_quantity", "harmonized_value", "harmonized_unit")
    return _streamed(spark, d, "lineitem", made, "stream-converted")


@_query("""
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as parsed_date from orders
""")
def stream_dated(spark, d):
    made = lambda s: streams.dated(s.select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("t")), "t").select("o_orderkey", "parsed_date")
    return _streamed(spark, d, "orders", made, "stream-dated")


@_query("""
select time_bucket(interval '1 hour', ts) as window_start, case when value > 50 then 'robust_reportable_detect' when value > 0 then 'non_reportable' else 'non_reportable' end as detection_event_class, count(*) as n from events group by 1, 2
""")
def stream_counted(spark, d):
    """Classes by hour, with a watermark."""
    made = lambda s: streams.counted(streams.detected(s.select("ts", F.col("value").alias("result_value"), F.lit(50.0).alias("reporting_limit_value"))), "ts")
    return _streamed(spark, d, "events", made, "stream-counted", "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("""
select c_nationkey, count(*) as n, max(c_custkey) as last from customer group by 1
""")
def stream_upserted(spark, d):
    """Each micro-batch merged into a keyed table."""
    base = f"{checkpoint_folder(spark)}/stream-upserted-{uuid.uuid4().hex}"
    source = _t(spark, d, "customer")

    def merge(batch: DataFrame, number: int) -> None:
        batch.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_custkey").alias("last")).write.mode("append").parquet(f"{base}/rows")

    streams.upserted(spark.readStream.schema(source.schema).parquet(f"{d}/customer.parquet*"), merge, f"{base}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/rows").groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
