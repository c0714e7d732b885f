"""Queries over the test tables and the same queries in SQL, by name.

Dirty inputs are derived from the tables' columns by text that both engines read alike; each query then runs an operator of
the library, and its SQL says independently what must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cas, dates, names, numeric, text, units
from ..functions.similarity import jaro_similarity
from ..operators import cleaning, consensus, detection, matching, media, references, review, shape, toxval, unit_build

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- units ------------------------------------------------------------------------------------------------------------

DIRTY_UNIT = "case cast(l_linenumber % 6 as int) when 0 then 'mg/L' when 1 then 'ug/L' when 2 then ' MG/L ' when 3 then 'm' when 4 then 'xyz' else 'ng / L' end"


@_query(f"""
with x as (select l_orderkey, l_linenumber, l_quantity as v, {DIRTY_UNIT} as raw from lineitem),
m(f, t, b) as (values ('mg/L', 'mg/L', 1.0::double), ('ug/L', 'mg/L', 0.001::double), ('min', 'hr', 1.0::double / 60)),
y as (select *, case when lower(trim(raw)) = 'm' then 'min' else regexp_replace(trim(raw), '\\s*/\\s*', '/', 'g') end as u from x)
select l_orderkey, l_linenumber, raw as orig_unit, v * coalesce(e.b, c.b, 1.0::double) as harmonized_value, coalesce(e.t, c.t, raw) as harmonized_unit,
  case when lower(trim(raw)) = 'm' then 'ambiguous_unit' when e.f is not null then '' when c.f is not null then 'case_fallback' else 'unmatched' end as unit_flag
  from y left join m e on e.f = u left join m c on lower(c.f) = lower(u)
""")
def unit_harmonize(spark, d):
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr(DIRTY_UNIT).alias("raw"))
    got = units.harmonized(df, units.unit_map(spark, durations=True), "l_quantity", "raw")
    return got.select("l_orderkey", "l_linenumber", "orig_unit", "harmonized_value", "harmonized_unit", "unit_flag")


PPX = "case cast(l_linenumber % 4 as int) when 0 then 'ppb' when 1 then 'PPM' when 2 then 'ppt' else 'ppm' end"
MEDIUM = "case cast(l_suppkey % 4 as int) when 0 then 'aqueous' when 1 then 'air' when 2 then 'solid' else cast(null as {s}) end"


@_query(f"""
with x as (select l_orderkey, l_linenumber, {PPX} as u, {MEDIUM.format(s='varchar')} as m, l_quantity as v from lineitem),
y as (select *, case when lower(u) in ('ppb', 'ppm') then case m when 'aqueous' then 'mg/L' when 'air' then 'mg/m3' when 'solid' then 'mg/kg' end end as t from x)
select l_orderkey, l_linenumber, u as orig_unit, m, v * case when lower(u) = 'ppb' then 0.001::double else 1.0::double end as harmonized_value, case when t is not null then t when lower(u) in ('ppb', 'ppm') then 'mg/L' else u end as harmonized_unit,
  case when t is not null or u in ('ppb', 'ppm') then '' when lower(u) = 'ppm' then 'case_fallback' else 'unmatched' end as unit_flag from y
""")
def unit_ppx_media(spark, d):
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr(PPX).alias("u"), F.expr(MEDIUM.format(s="string")).alias("m"))
    got = units.harmonized(df, units.unit_map(spark), "l_quantity", "u", media="m")
    return got.select("l_orderkey", "l_linenumber", "orig_unit", "m", "harmonized_value", "harmonized_unit", "unit_flag")


MOLAR = "case cast(p_partkey % 5 as int) when 0 then 'M' when 1 then 'mM' when 2 then 'umol/L' when 3 then 'nM' else 'mol/l' end"


@_query(f"""
with x as (select p_partkey, {MOLAR} as u, cast(p_size as double) as v, case when p_partkey % 7 = 0 then null else (100.0 + p_size)::double end as w from part)
select p_partkey, u as orig_unit, case when w > 0 then 'mg/L' else u end as harmonized_unit, case when w > 0 then '' else 'needs_mw' end as unit_flag,
  case when w > 0 then case lower(u) when 'm' then 1000.0 when 'mol/l' then 1000.0 when 'mm' then 1.0 when 'umol/l' then 0.001 else 0.000001 end::double * w else 1.0::double end as conversion_factor from x
""")
def unit_molarity(spark, d):
    df = _t(spark, d, "part").select("p_partkey", F.expr(MOLAR).alias("u"), F.col("p_size").cast("double").alias("v"), F.expr("case when p_partkey % 7 = 0 then cast(null as double) else 100.0D + p_size end").alias("w"))
    got = units.harmonized(df, units.unit_map(spark), "v", "u", weight="w")
    return got.select("p_partkey", "orig_unit", "harmonized_unit", "unit_flag", "conversion_factor")


SPAN = "case cast(l_linenumber % 5 as int) when 0 then 'day' when 1 then 'wk' when 2 then 'hrs' when 3 then 'Mo' else 'fortnight' end"


@_query(f"""
with x as (select l_orderkey, l_linenumber, {SPAN} as u, l_quantity as v from lineitem)
select l_orderkey, l_linenumber, u as orig_unit, case u when 'fortnight' then u else 'hr' end as harmonized_unit, case u when 'Mo' then 'case_fallback' when 'fortnight' then 'unmatched' else '' end as unit_flag,
  v * case u when 'day' then 24.0 when 'wk' then 168.0 when 'Mo' then 730.5 else 1.0 end::double as harmonized_value from x
""")
def duration_hours(spark, d):
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr(SPAN).alias("u"))
    got = units.harmonized(df, units.unit_map(spark, durations=True), "l_quantity", "u", category="duration")
    return got.select("l_orderkey", "l_linenumber", "orig_unit", "harmonized_unit", "unit_flag", "harmonized_value")


_ACTIVE = "case cast(l_linenumber % 3 as int) when 0 then 'Bq/L' when 1 then 'mg/L' else 'pCi' end"


@_query(f"""
select l_orderkey, l_linenumber, {_ACTIVE} as unit, l_linenumber % 3 <> 1 as radiological from lineitem
""")
def radiological_units(spark, d):
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_ACTIVE).alias("unit"))
    return df.withColumn("radiological", units.is_radiological(F.col("unit")))


# --- numbers and dates ------------------------------------------------------------------------------------------------

_Q = "cast(cast(l_quantity as bigint) as {s})"
NUMBER = "case cast(l_linenumber % 7 as int) when 0 then concat('<', {q}) when 1 then concat({q}, ' - ', {q}, '0') when 2 then concat({q}, 'x10^2') when 3 then concat({q}, ',', '500') when 4 then 'ND' when 5 then concat({q}, 'd') else concat(' >= ', {q}, ' ') end"


@_query(f"""
with x as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as q, cast(l_linenumber % 7 as int) as k, {NUMBER.format(q=_Q.format(s='varchar'))} as orig_result from lineitem)
select l_orderkey, l_linenumber, orig_result, case k when 0 then q when 2 then q * 100 when 3 then q * 1000 + 500 when 6 then q end * 1.0::double as numeric_value,
  case k when 0 then '<' when 6 then '>=' else '' end as qualifier, 'as_is' as range_bin, case k when 4 then 'narrative' when 5 then 'unparseable' else '' end as parse_flag from x where k <> 1
union all
select l_orderkey, l_linenumber, orig_result, (case b when 'low' then q when 'mid' then q * 5.5 else q * 10 end)::double, case b when 'low' then '>=' when 'mid' then '~' else '<=' end, b, ''
from x, (values ('low'), ('mid'), ('high')) as bins(b) where k = 1
""")
def numeric_parse(spark, d):
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(NUMBER.format(q=_Q.format(s="string"))).alias("v"))
    return numeric.parsed(df, "v").drop("v")


_YMD = "lpad(cast(year(o_orderdate) as {s}), 4, '0')", "lpad(cast(month(o_orderdate) as {s}), 2, '0')", "lpad(cast(day(o_orderdate) as {s}), 2, '0')"


def _date_text(s: str) -> str:
    y, m, dd = (p.format(s=s) for p in _YMD)
    return f"case cast(o_orderkey % 6 as int) when 0 then concat({y}, '-', {m}, '-', {dd}) when 1 then concat({m}, '/', {dd}, '/', {y}) when 2 then concat({y}, {m}, {dd}) when 3 then concat({y}, '-', {m}) when 4 then 'no date' else concat({y}, '-', {m}, '-', {dd}, ' 14:30:00') end"


@_query(f"""
with x as (select o_orderkey, o_orderkey % 6 as k, {_date_text('varchar')} as raw_date, cast(o_orderdate as date) as o from orders),
y as (select *, case when k = 4 then null when k = 3 then date_trunc('month', o)::date else o end as dt from x)
select o_orderkey, raw_date, strftime(dt, '%Y-%m-%d') as parsed_date, cast(year(dt) as integer) as date_year,
  case when k = 4 then 'unparseable' when k = 3 then 'partial' when day(dt) <= 12 then 'ambiguous' else '' end as date_flag from y
""")
def date_parse(spark, d):
    df = _t(spark, d, "orders").select("o_orderkey", F.expr(_date_text("string")).alias("t"))
    return dates.with_dates(df, "t").drop("t")


# --- registry numbers -------------------------------------------------------------------------------------------------

_DIGITS = "lpad(cast(p_partkey % 100000 + 10000 as {s}), 6, '1')"


def _cas_text(s: str) -> str:
    x = _DIGITS.format(s=s)
    total = " + ".join(f"cast(substr({x}, {7 - i}, 1) as int) * {i}" for i in range(1, 7))
    check = f"cast((({total}) % 10 + case when p_partkey % 3 = 0 then 1 else 0 end) % 10 as {s})"
    return f"concat(substr({x}, 1, 4), '-', substr({x}, 5, 2), '-', {check})"


@_query(f"""
with x as (select p_partkey, {_cas_text('varchar')} as c from part)
select p_partkey, c, p_partkey % 3 <> 0 as valid, case when p_partkey % 3 <> 0 then c end as normal, case when p_partkey % 3 <> 0 then 1 else 0 end as found,
  case when p_partkey % 3 <> 0 then c end as rescued from x
""")
def cas_checksum_extract(spark, d):
    df = _t(spark, d, "part").select("p_partkey", F.expr(_cas_text("string")).alias("c"))
    in_text = cas.extract_cas(F.concat(F.lit("see ("), F.col("c"), F.lit(") and 12-34")))
    return df.select("p_partkey", "c", cas.is_cas(F.col("c")).alias("valid"), cas.as_cas(F.translate("c", "-", "")).alias("normal"), F.size(in_text).alias("found"), F.get(in_text, 0).alias("rescued"))


@_query(f"""
with x as (select p_partkey, {_cas_text('varchar')} as c, p_partkey % 3 <> 0 as ok from part)
select p_partkey, case when ok then c end as cas, case when ok and p_partkey % 2 = 0 then '67-64-1' end as cas_extract_cas_1, case when not ok then 0 when p_partkey % 2 = 0 then 2 else 1 end as multi_cas_count from x
""")
def cas_multi(spark, d):
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), F.expr(f"concat({_cas_text('string')}, case when p_partkey % 2 = 0 then '; 67-64-1' else '' end)").alias("cas"))
    step = cleaning.normalize_cas_step(df, {"cas": "CASRN"})
    got = cleaning.multi_cas_step(step.data, {"cas": "CASRN"} | step.new_tags).data
    return got.select(F.col("original_row_id").alias("p_partkey"), "cas", "cas_extract_cas_1", "multi_cas_count")


# --- text and names ---------------------------------------------------------------------------------------------------

_MAPPED = ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in text.UNICODE.items())


@_query(f"""
with m as (select map {{{_MAPPED}}} as m)
select doc_id, md5(case when regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]') then array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: coalesce(m[c], c)), '') else coalesce(text, '') end) as h from documents, m
""")
def unicode_ascii(spark, d):
    """Whole texts: what the map lacks stays."""
    return _t(spark, d, "documents").select("doc_id", F.md5(text.clean_unicode(F.coalesce("text", F.lit("")))).alias("h"))


@_query("""
with c as (select unnest(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x7F]')) as "char" from documents)
select "char", 'U+' || lpad(upper(to_hex(unicode("char"))), 4, '0') as code_point, count(*) as n from c group by 1, 2
""")
def unicode_qc(spark, d):
    return text.non_ascii_counts(_t(spark, d, "documents").select("text"), ["text"])


@_query("""
with x as (select c_custkey, '  __' || c_name || '  x ' || c_mktsegment || '** ' as raw from customer)
select cast(c_custkey as int) as row_id, 'v' as field, 'trim_whitespace' as step, raw as original_value, regexp_replace(regexp_replace(trim(raw), '\\s+', ' ', 'g'), '^[_*]+|[_*]+$', '', 'g') as new_value from x
""")
def text_trim_audit(spark, d):
    df = _t(spark, d, "customer").select(F.col("c_custkey").alias("original_row_id"), F.expr("concat('  __', c_name, '  x ', c_mktsegment, '** ')").alias("v"))
    return cleaning.trim_step(df).audit.drop("reason")


_NAME = "case cast(p_partkey % 8 as int) when 0 then concat(p_name, ' (pure)') when 1 then concat(p_name, ' and its sodium salts') when 2 then concat(p_name, ', unspecified') when 3 then concat('Technical ', p_name) when 4 then concat(p_name, ' (propyl)') when 5 then concat('xylene, ', p_name, '; xylol') when 6 then 'H2O' else concat(p_name, ' (broken') end"


@_query(f"""
with x as (select p_partkey, cast(p_partkey % 8 as int) as k, p_name, {_NAME} as raw from part)
select p_partkey, raw, case k when 0 then p_name else raw end as enclosed, case when k = 0 then 'pure' end as kept,
  trim(regexp_replace(regexp_replace(raw, '(?i)\\b(pure|purif\\w*|tech|technical|grade|chemical)\\b', '', 'g'), '\\s+', ' ', 'g')) as adjectives,
  trim(regexp_replace(raw, '(?i)and its (\\w+ )?salts', '', 'g')) as salts, trim(regexp_replace(raw, '(?i)[,;-]?\\s*unspecified\\s*$', '', 'g')) as unspecified, k = 6 as bare from x
""")
def name_scalars(spark, d):
    df = _t(spark, d, "part").select("p_partkey", F.expr(_NAME).alias("raw"))
    base, kept = names.strip_enclosures(F.col("raw"))
    return df.select("p_partkey", "raw", base.alias("enclosed"), kept.alias("kept"), names.strip_adjectives(F.col("raw")).alias("adjectives"), names.strip_salts(F.col("raw")).alias("salts"), names.strip_unspecified(F.col("raw")).alias("unspecified"), names.is_bare_formula(F.col("raw")).alias("bare"))


@_query("""
select p_partkey, p as part, cast(i as int) as synonym_index, cast(3 as int) as synonym_count from (select p_partkey, unnest(['xylene', 'a-' || p_partkey || ',2-b', 'xylol']) as p, unnest([1, 2, 3]) as i from part where p_partkey % 2 = 0)
union all select p_partkey, 'butane, 2,2-dimethyl', 1, 1 from part where p_partkey % 2 = 1
""")
def synonym_split(spark, d):
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), F.expr("case when p_partkey % 2 = 0 then concat('xylene, a-', p_partkey, ',2-b; xylol') else 'butane, 2,2-dimethyl' end").alias("part"))
    got = cleaning.split_synonyms_step(df, ["part"], {"part": "Name"}).data
    return got.select(F.col("original_row_id").alias("p_partkey"), "part", "synonym_index", "synonym_count")


@_query(f"""
with x as (select p_partkey, {_NAME} as raw from part)
select p_partkey, raw, case when p_partkey % 8 = 7 then 'BLOCK: truncated compound [unbalanced delimiter]' end as cleaning_flag from x
""")
def truncated_names(spark, d):
    df = _t(spark, d, "part").select("p_partkey", F.expr(_NAME).alias("raw"))
    return cleaning.truncated_step(df, ["raw"]).data


_FLAGGED = "case cast(p_partkey % 5 as int) when 0 then 'Sample' when 1 then concat('a sample of ', p_name) when 2 then 'proprietary mix' when 3 then '---' else 'Benzene' end"


@_query(f"""
select p_partkey, {_FLAGGED} as v, case cast(p_partkey % 5 as int) when 0 then 'WARN: stop word [exact]' when 1 then 'WARN: stop word [substring]' when 2 then 'BLOCK: blocked pattern [substring]' when 3 then 'BLOCK: blocked pattern [substring]' end as cleaning_flag from part
""")
def reference_flags(spark, d):
    df = _t(spark, d, "part").select(F.col("p_partkey").alias("original_row_id"), F.expr(_FLAGGED).alias("v"))
    for kind, how, label in (("stop_words", "warning", "stop word"), ("block_patterns", "blocking", "blocked pattern")):
        df = cleaning.flag_references_step(df, ["v"], references.as_terms(references.default_list(spark, kind)), how, label).data
    return df.select(F.col("original_row_id").alias("p_partkey"), "v", "cleaning_flag")


_ISOTOPE = "case cast(n_nationkey % 6 as int) when 0 then 'Ra 228' when 1 then 'Cs-137' when 2 then 'u238 total' when 3 then 'cesium 137' when 4 then 'Uranium-234 and 235' else n_name end"


@_query(f"""
select n_nationkey, {_ISOTOPE} as raw, case cast(n_nationkey % 6 as int) when 0 then 'Radium-228' when 1 then 'Caesium-137' when 2 then 'Uranium-238 total' when 3 then 'Caesium-137' when 4 then 'Uranium-234 and 235' else n_name end as expanded,
  case when n_nationkey % 6 = 4 then 'Uranium-234|Uranium-235' else replace(replace({_ISOTOPE}, 'Ra 228', 'Ra-228'), 'cesium 137', 'cesium-137') end as parts, n_nationkey % 6 = 4 as several, '(+)-' || n_name || ' (R,S)' as chiral from nation
""")
def isotopes_and_markers(spark, d):
    df = _t(spark, d, "nation").select("n_nationkey", "n_name", F.expr(_ISOTOPE).alias("raw"))
    rows = [("Ra", "228", "Radium"), ("Cs", "137", "Caesium"), ("U", "238", "Uranium"), ("U", "234", "Uranium")]
    marked = F.concat(F.lit("(+)-"), F.col("n_name"), F.lit(" (R,S)"))
    return df.select("n_nationkey", "raw", names.expand_isotopes(F.col("raw"), rows, {"Cesium": "Caesium"}).alias("expanded"), F.array_join(names.multi_analyte_parts(F.col("raw")), "|").alias("parts"), names.is_multi_analyte(F.col("raw")).alias("several"), names.restore_chiral(names.protect_chiral(marked)).alias("chiral"))


# --- media ------------------------------------------------------------------------------------------------------------

_MEDIA = "case cast(s_suppkey % 5 as int) when 0 then 'Water' when 1 then ' SOIL' when 2 then 'river water sample' when 3 then 'unknown' else 'ambient_air' end"
_MEDIA_ROWS = "values ('water', 'surface water', 'E1', 'aqueous', cast(null as string), 'x', 'auto', true, 1), ('soil', 'soil', 'E2', 'solid', null, 'x', 'auto', true, 2), ('river water', null, null, null, 'water', 'x', 'auto', true, 3), ('ambient air', 'air', 'E3', 'air', null, 'x', 'auto', true, 4)"


@_query(f"""
select s_suppkey, {_MEDIA} as raw_media, case cast(s_suppkey % 5 as int) when 0 then 'surface water' when 1 then 'soil' when 2 then 'surface water' when 4 then 'air' end as canonical_media,
  case cast(s_suppkey % 5 as int) when 0 then 'aqueous' when 1 then 'solid' when 2 then 'aqueous' when 4 then 'air' end as media_category,
  case cast(s_suppkey % 5 as int) when 2 then 'parent_walk' when 3 then 'media_unmatched' else '' end as media_flag from supplier
""")
def media_harmonize(spark, d):
    table = spark.sql(f"select * from ({_MEDIA_ROWS}) as t(term, canonical_media, envo_id, media_category, parent, source, assertion_mode, active, ord)")
    df = _t(spark, d, "supplier").select("s_suppkey", F.expr(_MEDIA).alias("m"))
    return media.harmonized(df, "m", table).select("s_suppkey", "raw_media", "canonical_media", "media_category", "media_flag")


@_query("""
select 'r' || r_regionkey as node_id, 'media > ' || r_name as path, 1 as depth, r_name as state, true as has_children from region
union all select 'n' || n_nationkey, 'media > ' || r_name || ' > ' || n_name, 2, r_name, false from nation join region on n_regionkey = r_regionkey
union all select 'root', 'media', 0, null, true
""")
def ontology_paths(spark, d):
    r, n = _t(spark, d, "region"), _t(spark, d, "nation")
    nodes = spark.sql("select 'root' as node_id, cast(null as string) as parent_id, 'media' as label")
    nodes = nodes.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("label")))
    nodes = nodes.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("label")))
    return media.ontology_index(nodes.withColumn("routing_category", F.lit(None).cast("string"))).drop("label", "route")


# --- matching and consensus -------------------------------------------------------------------------------------------


@_query("""
with n as (select distinct n_name as a from nation), r as (select distinct n_name as b from nation)
select a, b, round(jaro_similarity(lower(a), lower(b)), 6) as score from n, r where a < b
""")
def jaro_scores(spark, d):
    n = _t(spark, d, "nation").select("n_name").distinct()
    pairs = n.select(F.col("n_name").alias("a")).join(n.select(F.col("n_name").alias("b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(jaro_similarity(F.lower("a"), F.lower("b")), 6).alias("score"))


_WQX_VALUE = "case when n_nationkey % 3 = 0 then n_name when n_nationkey % 3 = 1 then concat('old ', lower(n_name)) when n_nationkey % 2 = 0 then concat(n_name, 'x') else reverse(n_name) end"


@_query(f"""
with v as (select distinct {_WQX_VALUE} as input_name from nation),
c as (select distinct n_name from nation),
x as (select input_name, e.n_name as e_name, a.n_name as a_name from v left join c e on lower(e.n_name) = lower(input_name) left join c a on 'old ' || lower(a.n_name) = lower(input_name)),
s as (select input_name, n_name, 1 - jaro_similarity(lower(input_name), lower(n_name)) as d from x, c where e_name is null and a_name is null),
f as (select input_name, n_name, d from s qualify row_number() over (partition by input_name order by d, n_name) = 1)
select input_name, case when e_name is not null then e_name when a_name is not null then a_name when d <= 0.15 then f.n_name end as wqx_name,
  case when e_name is not null then 'wqx_exact' when a_name is not null then 'wqx_alias' when d <= 0.15 then 'wqx_fuzzy' else 'miss' end as match_tier,
  case when e_name is not null or a_name is not null then 0.0::double else round(d, 6) end as match_distance, case when e_name is null and a_name is not null then 'synonym' end as alias_type
from x left join f using (input_name)
""")
def wqx_tiers(spark, d):
    """Every row of nation: equal names, aliases, misspelt and unknown ones."""
    n = _t(spark, d, "nation")
    own = n.select(F.col("n_name").alias("name"), F.col("n_name").alias("canonical_name"), F.lit("canonical").alias("type"))
    alias = n.select(F.concat(F.lit("Old "), "n_name").alias("name"), F.col("n_name").alias("canonical_name"), F.explode(F.array(F.lit("retired"), F.lit("synonym"))).alias("type"))
    got = matching.match_wqx(n.select(F.expr(_WQX_VALUE).alias("search_value")), own.unionByName(alias))
    return got.withColumn("match_distance", F.round("match_distance", 6))


#: A registry number of a row of nation: its first part and what that part adds to the check digit, which `off` makes wrong.
_NUMBER = "concat('{first}-', lpad(cast(n_nationkey as {s}), 2, '0'), '-', cast((cast(n_nationkey % 10 as int) + 2 * cast(floor(n_nationkey / 10) as int) + {adds} + {off}) % 10 as {s}))"
_IN_NAME = {"first": 2000, "adds": 12, "off": 0}
_OF_COLUMN = {"first": 1000, "adds": 6, "off": "case when n_nationkey % 3 = 2 then 1 else 0 end"}
_LOOKUP = "case cast(n_nationkey % 5 as int) when 0 then n_name when 1 then concat('0', {number}) when 2 then case when n_nationkey % 10 = 2 then concat('old ', lower(n_name)) else concat(n_name, 'x') end when 3 then concat('Hydrate of ', n_name) else reverse(n_name) end"


@_query(f"""
select {_LOOKUP.format(number=_NUMBER.format(s="varchar", **_IN_NAME))} as search_value,
  case n_nationkey % 5 when 0 then 'D' || n_nationkey when 1 then 'E' || n_nationkey when 3 then 'S' || n_nationkey end as dtxsid,
  case n_nationkey % 5 when 2 then n_name when 0 then n_name when 1 then n_name when 3 then n_name end as preferred_name,
  case n_nationkey % 5 when 0 then 'exact' when 1 then 'cas_in_name' when 2 then case when n_nationkey % 10 = 2 then 'wqx_alias' else 'wqx_fuzzy' end when 3 then 'starts_with' else 'cas_invalid' end as source_tier from nation
union all select {_NUMBER.format(s="varchar", **_OF_COLUMN)}, case when n_nationkey % 3 = 0 then 'C' || n_nationkey end, case when n_nationkey % 3 = 0 then n_name end,
  case n_nationkey % 3 when 0 then 'cas' when 1 then 'cas_miss' else 'cas_invalid' end from nation
""")
def tiered_lookup(spark, d):
    """All tiers: names and numbers of the catalog, aliases and misspelt names of a dictionary, prefixes, unknown names."""
    n = _t(spark, d, "nation")
    name, column = (F.expr(_NUMBER.format(s="string", **x)) for x in (_IN_NAME, _OF_COLUMN))
    key = lambda rows, k, id_: F.when(F.expr(rows), F.struct(k.alias("search_key"), F.concat(F.lit(id_), "n_nationkey").alias("dtxsid")))
    keys = [key("n_nationkey % 5 = 0", F.lower("n_name"), "D"), key("n_nationkey % 5 = 1", name, "E"), key("n_nationkey % 5 = 3", F.concat(F.lit("hydrate of "), F.lower("n_name"), F.lit(" (ii)")), "S"), key("n_nationkey % 3 = 0", column, "C")]
    catalog = n.select("n_name", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("k.*", F.col("n_name").alias("preferred_name"), F.col("n_name").alias("search_name"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    listed = F.explode(F.array(F.struct(F.col("n_name").alias("name"), F.lit("canonical").alias("type")), F.struct(F.concat(F.lit("Old "), "n_name").alias("name"), F.lit("synonym").alias("type")))).alias("x")
    dictionary = n.filter("n_nationkey % 5 = 2").select(F.col("n_name").alias("canonical_name"), listed).select("x.name", "canonical_name", "x.type")
    values = n.select(F.expr(_LOOKUP.format(number=_NUMBER.format(s="string", **_IN_NAME))).alias("search_value"))
    got = matching.tiered(values, n.select(column.alias("search_value")), catalog, dictionary, starts_with=True)
    return matching.chosen(got).select("search_value", "dtxsid", "preferred_name", "source_tier")


_IDS = "case when p_partkey % 3 = 0 then cast(null as {s}) else concat('D', p_partkey % 4) end", "case when p_size % 5 = 0 then cast(null as {s}) else concat('D', p_size % 4) end"


@_query(f"""
with x as (select p_partkey, {_IDS[0].format(s='varchar')} as a, {_IDS[1].format(s='varchar')} as b from part),
y as (select *, case when a is null and b is null then 'error' when a is null or b is null then 'single' when a = b then 'agree' else 'disagree' end as s from x)
select p_partkey, s as consensus_status, case s when 'single' then coalesce(a, b) when 'agree' then a end as consensus_dtxsid, case s when 'single' then case when a is null then 'b' else 'a' end when 'agree' then 'a' end as consensus_source,
  case s when 'agree' then 1 when 'single' then 2 when 'disagree' then 3 else 4 end as qc_tier, case when s in ('single', 'agree', 'disagree') then coalesce(b, a) end as by_priority from y
""")
def consensus_qc(spark, d):
    df = _t(spark, d, "part").select("p_partkey", F.expr(_IDS[0].format(s="string")).alias("dtxsid_a"), F.expr(_IDS[1].format(s="string")).alias("dtxsid_b"))
    got = consensus.classified(df)
    ranked = consensus.by_priority(got, ["dtxsid_b", "dtxsid_a"]).select("p_partkey", F.col("consensus_dtxsid").alias("by_priority"))
    return got.join(ranked, "p_partkey").select("p_partkey", "consensus_status", "consensus_dtxsid", "consensus_source", "qc_tier", "by_priority")


@_query(f"""
with x as (select {_IDS[0].format(s='varchar')} as a, {_IDS[1].format(s='varchar')} as b from part),
y as (select case when a is null and b is null then 'error' when a is null or b is null then 'single' when a = b then 'agree' else 'disagree' end as s from x)
select k as status, (select count(*) from y where s = k) as n from (values ('agree'), ('agree_caveat'), ('single'), ('disagree'), ('wqx'), ('error'), ('auto_resolved'), ('suggested'), ('unresolvable'), ('manual')) as t(k)
""")
def consensus_summary(spark, d):
    df = _t(spark, d, "part").select("p_partkey", F.expr(_IDS[0].format(s="string")).alias("dtxsid_a"), F.expr(_IDS[1].format(s="string")).alias("dtxsid_b"))
    return consensus.summary(consensus.classified(df))


# --- detection and output ---------------------------------------------------------------------------------------------

_RESULT = "case when event_id % 11 = 0 then null when event_id % 7 = 0 then -value else value end"


@_query(f"""
with x as (select event_id, {_RESULT} as r, case when event_id % 5 = 0 then null else cast(json_extract(props, '$.k') as double) end as l, case when event_id % 3 = 0 then null else value * 0.1 end as u from events),
y as (select *, r > 0 and (l is null or r > l) as f from x)
select event_id, case when r is null then 'indeterminate' when r < 0 then 'review_required' when l is null and r > 0 then 'review_required' when f and u is not null and r - u >= l then 'robust_reportable_detect' when f and u is not null then 'estimated_reportable_detect'
  when f then 'robust_reportable_detect' when r > 0 and u is not null and r - u < l and r + u >= l then 'threshold_ambiguous' when r > 0 and u is not null and r - u > 0 then 'positive_below_reporting_limit' else 'non_reportable' end as detection_event_class, coalesce(f, false) as result_flag from y
""")
def detection_classify(spark, d):
    df = _t(spark, d, "events").select("event_id", F.expr(_RESULT).alias("result_value"), F.expr("case when event_id % 5 = 0 then null else cast(get_json_object(props, '$.k') as double) end").alias("reporting_limit_value"), F.expr("case when event_id % 3 = 0 then null else value * 0.1D end").alias("uncertainty_value"))
    return detection.classified(df).select("event_id", "detection_event_class", "result_flag")


@_query(f"""
with x as (select user_id, event_id, {_RESULT} as r, 50.0 as l from events),
y as (select *, case when r is null then 'indeterminate' when r < 0 then 'review_required' when r > l then 'robust_reportable_detect' else 'non_reportable' end as c, coalesce(r > l, false) as f from x)
select user_id, case when count(distinct c) > 1 then 'review_required' else min(c) end as detection_event_class, bool_or(f) as result_flag, count(distinct c) > 1 or bool_or(r is null) or bool_or(r < 0) as numeric_followup_flag from y group by 1
""")
def detection_collapse(spark, d):
    df = _t(spark, d, "events").select(F.col("user_id").alias("orig_row_id"), F.col("event_id").alias("ord"), F.expr(_RESULT).alias("result_value"), F.lit(50.0).alias("reporting_limit_value"))
    got = detection.collapsed(detection.classified(df))
    return got.select(F.col("orig_row_id").alias("user_id"), "detection_event_class", "result_flag", F.coalesce("numeric_followup_flag", F.lit(False)).alias("numeric_followup_flag"))


@_query("""select l_orderkey as orig_row_id, arg_min(l_quantity, l_linenumber * 1000 + l_quantity) as value, count(distinct l_quantity) > 1 as multiple from lineitem group by 1""")
def role_values(spark, d):
    df = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("orig_row_id"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("ord"), F.col("l_quantity").alias("harmonized_value"), F.lit("ReportingLimit").alias("measurement_role"))
    return detection.role_values(df, "ReportingLimit")


@_query("""
select 'D' || p_partkey as dtxsid, p_name as name, 'user_upload' as source, cast(p_size as double) as toxval_numeric, 'mg/L' as toxval_units, p_type as study_type, p_type as study_type_original, 'user_curated' as qc_category, 'pass' as qc_status, null::varchar as species_common from part
""")
def toxval_map(spark, d):
    p = _t(spark, d, "part")
    curated = p.select(F.col("p_partkey").alias("original_row_id"), F.concat(F.lit("D"), "p_partkey").alias("dtxsid"), F.col("p_name").alias("chemical_name"), F.col("p_type").alias("study_type"))
    got = toxval.mapped(curated, p.select(F.col("p_partkey").alias("orig_row_id"), F.col("p_size").cast("double").alias("harmonized_value"), F.lit("mg/L").alias("harmonized_unit"), F.lit("mg/l").alias("orig_unit")))
    toxval.assert_typed(got)
    return got.select("dtxsid", "name", "source", "toxval_numeric", "toxval_units", "study_type", "study_type_original", "qc_category", "qc_status", "species_common")


@_query("""select p_partkey, sha256(concat_ws('|', p_name, coalesce(p_brand, 'NA'), cast(p_size as varchar), 'NA')) as h from part""")
def row_hash(spark, d):
    df = _t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.lit(None).cast("string").alias("z"))
    return df.select("p_partkey", toxval.row_hash(["p_name", "p_brand", "p_size", "z"]).alias("h"))


# --- tables as a whole ------------------------------------------------------------------------------------------------


@_query("""
with x as (select conv_id, turn, row_number() over (order by conv_id, turn) as _row, case when turn = 0 then 'c' || conv_id end as v from conversations)
select _row, last_value(v ignore nulls) over (order by _row rows unbounded preceding) as v, role from x join conversations using (conv_id, turn)
""")
def merged_cell_fill(spark, d):
    c = _t(spark, d, "conversations")
    rank = F.row_number().over(Window.orderBy("conv_id", "turn")).cast("long")  # the grid's own order; a sheet is small
    grid = c.select(rank.alias("_row"), F.when(F.col("turn") == 0, F.concat(F.lit("c"), "conv_id")).alias("v"), "role")
    return shape.merged_cells_filled(grid, block=100)


@_query("""select row_number() over (order by p_partkey) as original_row_id, p_partkey from part""")
def row_lineage(spark, d):
    return cleaning.with_row_ids(_t(spark, d, "part").select("p_partkey"), ["p_partkey"])


@_query("""
select 'unicode' as step, 0::bigint as est_changes, false as should_run union all select 'trim', 0, false union all select 'cas', 0, false union all select 'names', (select count(*) from part), true union all select 'isotopes', 0, false
union all select 'multi_analyte', (select count(*) from part where p_partkey % 2 = 0), true union all select 'chiral', 0, false union all select 'units', (select count(*) from part), true union all select 'durations', 0, false union all select 'dates', 0, false union all select 'media', 0, false
""")
def preflight(spark, d):
    df = _t(spark, d, "part").select(F.expr("case when p_partkey % 2 = 0 then concat('x', p_partkey, ' and y') else concat('z', p_partkey) end").alias("name"), F.lit("mg/L").alias("unit"))
    return cleaning.preflight(df, {"name": "Name"}, units=["unit"])


@_query("""select o_orderkey, case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'VERIFIED' end as row_flag from orders""")
def override_replay(spark, d):
    df = consensus.with_state(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"))
    spec = review.Spec([review.Override("row_flag", "VERIFIED", {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"})])
    return review.replayed(df, spec).select("o_orderkey", "row_flag")


@_query("""select c_nationkey, c_mktsegment, min(c_custkey) as c_custkey, count(*) as n_rows from customer group by 1, 2""")
def review_groups(spark, d):
    return review.grouped_rows(_t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@_query("""select count(*) as n_targets, count(*) filter (where n_nationkey % 2 = 0) as n_covered, round(100.0 * count(*) filter (where n_nationkey % 2 = 0) / count(*), 1)::double as percent from nation""")
def coverage_report(spark, d):
    n = _t(spark, d, "nation")
    got = unit_build.coverage(n.filter("n_nationkey % 2 = 0").select(F.lower("n_name").alias("unit")), n.select(F.col("n_name").alias("unit")))
    return got.withColumn("percent", F.col("percent").cast("double"))


@_query("""select count(*) as n_rows, 2 as n_cols, round(100.0 * count(*) filter (where c_custkey % 4 = 0) / (2 * count(*)), 1)::double as missing_percent from customer""")
def preview_missing(spark, d):
    df = _t(spark, d, "customer").select("c_custkey", F.expr("case when c_custkey % 4 <> 0 then c_name end").alias("n"))
    return shape.missing_share(df).withColumn("missing_percent", F.col("missing_percent").cast("double"))


@_query("""
select cast(p_partkey as int) as row_id, 'v' as field, 'edit' as step, p_name as original_value, p_name || '!' as new_value from part where p_partkey % 9 = 0
""")
def audit_diff(spark, d):
    from ..operators.audit import build_audit_trail

    p = _t(spark, d, "part")
    before = p.select(F.col("p_partkey").alias("original_row_id"), F.col("p_name").alias("v"))
    after = p.select(F.col("p_partkey").alias("original_row_id"), F.expr("case when p_partkey % 9 = 0 then concat(p_name, '!') else p_name end").alias("v"))
    return build_audit_trail(before, after, "edit", "by hand").drop("reason")


def queries() -> dict[str, Query]:
    from . import entries  # noqa: F401 - adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import entries  # noqa: F401 - adds its own

    return dict(_SQL)
