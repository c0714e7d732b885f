"""Reviewers' overrides: recorded by content, so they can be replayed on a table whose rows have moved."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .consensus import REVIEW, STATE, id_columns

ORDER = ("review", "measurement", "study", "metadata", "chemical")
STATE_COLUMNS = (*STATE, *REVIEW, "similarity_score")
EXCLUDED = (*STATE_COLUMNS, "original_row_id", "row_id", "row_index", "orig_row_id")
WORKFLOWS = {"chemical": ("Name", "CASRN", "Other"), "measurement": ("Result", "Numeric", "Unit", "Qualifier", "ReportingLimit", "Uncertainty", "UncertaintyCoverage", "Duration", "DurationUnit"), "study": ("Species", "ExposureRoute", "StudyDate"), "metadata": ("Media",)}


@dataclass
class Override:
    column: str
    value: object
    signature: dict[str, object]
    workflow: str = "review"


@dataclass
class Spec:
    overrides: list[Override] = field(default_factory=list)


def workflows(tags: dict[str, str] | None) -> dict[str, str]:
    return {c: w for c, t in (tags or {}).items() for w, kinds in WORKFLOWS.items() if t in kinds}


def stable_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """Columns whose content can name a row: no ids of rows, no state, no lists, not the target itself."""
    return [f.name for f in df.schema.fields if f.name not in EXCLUDED and f.name != target and not f.dataType.simpleString().startswith(("array", "map", "struct", "binary"))]


def validate(spec: Spec) -> None:
    for o in spec.overrides:
        if not o.column or not o.signature:
            raise ValueError("an override needs a column and a signature")
        if o.workflow not in ORDER:
            raise ValueError(f"no such workflow: {o.workflow}")


def matches(signature: dict[str, object]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in signature.items()])


def _minimal(df: DataFrame, target: str, after: str, keys: list[str], identity: list[str], most: int = 3, tries: int = 200) -> list[str]:
    """The fewest columns that tell the rows to change from all others; the identity columns first."""
    tried = 0
    for n in range(1, min(most, len(keys)) + 1):
        for pick in combinations(sorted(keys, key=lambda c: (c not in identity, keys.index(c))), n):
            tried += 1
            if tried > tries:
                return keys
            mixed = df.groupBy(*pick).agg(F.count_distinct(F.struct(F.col(after).isNull(), after)).alias("a"), F.count_if(F.col("_hit")).alias("h"), F.count("*").alias("n")).filter("h > 0 and (a > 1 or h < n)")
            if not mixed.limit(1).count():
                return list(pick)
    return keys


def build(before: DataFrame, after: DataFrame, tags: dict[str, str] | None = None, row_id: str = "original_row_id", most: int = 10_000) -> Spec:
    """What turns the one table into the other, by content. Refused where equal rows were changed differently.

    Edits are made by people: more than `most` distinct ones are no review, and are refused too.
    """
    flow, spec = workflows(tags), Spec()
    identity = [c for c, w in flow.items() if w == "chemical"]
    kinds = dict(after.dtypes)
    for c in after.columns:
        if c == row_id or kinds[c].startswith(("array", "map", "struct")):
            continue
        old = F.col(f"b_{c}") if c in before.columns else F.lit(None).cast(kinds[c])
        keys = [k for k in stable_columns(before, c) if k in before.columns]
        both = before.select(row_id, *[F.col(k).alias(k) for k in keys], *([F.col(c).alias(f"b_{c}")] if c in before.columns else [])).join(after.select(row_id, F.col(c).alias("_after")), row_id).withColumn("_hit", ~old.eqNullSafe(F.col("_after")))
        if not both.filter("_hit").limit(1).count():
            continue
        clash = both.groupBy(*keys).agg(F.count_distinct(F.struct(F.col("_after").isNull(), "_after")).alias("n"), F.count_if("_hit").alias("h")).filter("h > 0 and n > 1")
        if clash.limit(1).count():
            raise ValueError(f"ambiguous overrides of {c}: equal rows were changed differently")
        pick = _minimal(both, c, "_after", keys, identity)
        rows = both.filter("_hit").select(*pick, "_after").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} distinct overrides of {c}")
        spec.overrides += [Override(c, r["_after"], {k: r[k] for k in pick}, "review" if c in STATE_COLUMNS or c.startswith("dtxsid") else flow.get(c, "review")) for r in rows]
    return spec


def replayed(df: DataFrame, overrides: Spec | Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The overrides in order of workflows; each must match a row. A function must keep the number of rows."""
    if overrides is None:
        return df
    if callable(overrides):
        got = overrides(df)
        if got.count() != df.count():
            raise ValueError("a review function must keep the number of rows")
        return got
    validate(overrides)
    for w in ORDER:
        todo = [o for o in overrides.overrides if o.workflow == w]
        for c in dict.fromkeys(o.column for o in todo):
            df = _overridden(df, c, [o for o in todo if o.column == c])
    return df


#: Overrides of one column; edits are made by people, and their table is broadcast.
MAX_OVERRIDES = 100_000


def _overridden(df: DataFrame, column: str, mine: list[Override]) -> DataFrame:
    """df with one column's overrides: a null-safe join for each set of signature columns; of several that match a row, the
    last in the list wins. Signatures see the table as it is before the column is changed."""
    if len(mine) > MAX_OVERRIDES:
        raise ValueError(f"more than {MAX_OVERRIDES} overrides of {column}")
    spark, kinds = df.sparkSession, dict(df.dtypes)
    kind = kinds.get(column) or ("boolean" if isinstance(mine[0].value, bool) else "double" if isinstance(mine[0].value, float) else "bigint" if isinstance(mine[0].value, int) else "string")
    groups: dict[tuple[str, ...], dict[tuple, tuple]] = {}
    for i, o in enumerate(mine):
        if gone := set(o.signature) - set(kinds):
            raise ValueError(f"no such columns: {sorted(gone)}")
        keys = tuple(sorted(o.signature))
        groups.setdefault(keys, {})[tuple(o.signature[k] for k in keys)] = (i, o.value)
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    got, found = df, []
    for g, (keys, rows) in enumerate(groups.items()):
        fields = ", ".join([*(f"`_k{j}` string" for j in range(len(keys))), f"_i{g} int", f"_v{g} string"])
        table = spark.createDataFrame([(*map(text, k), i, text(v)) for k, (i, v) in rows.items()], fields)
        table = table.withColumns({f"_k{j}": F.col(f"_k{j}").try_cast(kinds[k]) for j, k in enumerate(keys)} | {f"_v{g}": F.col(f"_v{g}").try_cast(kind)})
        got = got.join(F.broadcast(table), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)]), "left").drop(*[f"_k{j}" for j in range(len(keys))])
        found.append(F.struct(F.col(f"_i{g}").alias("i"), F.col(f"_v{g}").alias("v")))
    got = got.withColumn("_hit", F.array_max(F.filter(F.array(*found), lambda x: x["i"].isNotNull())) if len(found) > 1 else F.when(found[0]["i"].isNotNull(), found[0]))
    every = F.explode(F.array(*[F.col(f"_i{g}") for g in range(len(found))])).alias("i")
    seen = {r["i"] for r in got.select(every).filter("i is not null").distinct().collect()}
    last = {i for rows in groups.values() for i, _ in rows.values()}
    if missing := sorted(last - seen):
        raise ValueError(f"no row matches {mine[missing[0]].signature} for {column}")
    old = F.col(column) if column in df.columns else F.lit(None).cast(kind)
    return got.withColumn(column, F.when(F.col("_hit").isNotNull(), F.col("_hit.v")).otherwise(old)).select(*df.columns, *([column] if column not in df.columns else []))


def script(input_path: str, output_path: str, tags: dict[str, str], header_row: int | None, spec: Spec | None = None, **options: object) -> str:
    """A Python script that repeats a run with its overrides."""
    rows = "".join(f"    Override({o.column!r}, {o.value!r}, {o.signature!r}, {o.workflow!r}),\n" for o in (spec or Spec()).overrides)
    more = "".join(f", {k}={v!r}" for k, v in options.items())
    return (
        "from pyspark.sql import SparkSession\n\nfrom assayworks.operators.review import Override, Spec\nfrom assayworks.plans.curate import curate\n\n"
        f"SPEC = Spec([\n{rows}])\n\nspark = SparkSession.builder.getOrCreate()\n"
        f"curate(spark, {input_path!r}, {output_path!r}, tags={tags!r}, header_row={header_row!r}, overrides=SPEC{more})\n"
    )


def filtered(df: DataFrame, errors: bool = False, untagged: bool = False) -> DataFrame:
    """Rows in error, rows that are neither assigned nor flagged, or both."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) if c in df.columns else F.lit(True)
    pinned = F.coalesce(F.col("pinned"), F.lit(False)) if "pinned" in df.columns else F.lit(False)
    picks = ([F.col("consensus_status").isin("error", "unresolvable")] if errors else []) + ([blank("consensus_dtxsid") & blank("row_flag") & ~pinned] if untagged else [])
    return df.filter(reduce(lambda a, b: a | b, picks)) if picks else df


def grouped_rows(df: DataFrame, cols: list[str], row_id: str = "original_row_id") -> DataFrame:
    """The first row of each group of equal visible columns (nulls equal), n_rows, and its rows' ids."""
    rest = [c for c in df.columns if c not in cols and c != row_id]
    got = df.groupBy(*cols).agg(F.min(row_id).alias(row_id), F.min_by(F.struct(*[F.col(c) for c in rest] or [F.lit(1).alias("one")]), row_id).alias("r"), F.count("*").alias("n_rows"))
    return got.select(row_id, *cols, *[F.col(f"r.{c}").alias(c) for c in rest], "n_rows")


def decided(df: DataFrame, decisions: DataFrame, cols: list[str]) -> DataFrame:
    """A decision on a displayed row for all rows of its group. decisions: cols and new state columns."""
    new = [c for c in decisions.columns if c not in cols]
    right = decisions.select(*[F.col(c).alias(f"_d_{c}") for c in cols], F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in new])
    got = df.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in cols]), "left")
    return got.select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns], *[F.col(f"_n_{c}").alias(c) for c in new if c not in df.columns])


def aligned(df: DataFrame, prefix: str) -> Column:
    """The prefix's value for the consensus's source, else of the column whose id it is, else the first there is."""
    cols = [(c, prefix + c[len("dtxsid") :]) for c in id_columns(df) if prefix + c[len("dtxsid") :] in df.columns]
    if not cols:
        return F.lit(None).cast("string")
    by_source = [F.when(F.col("consensus_source") == (c[len("dtxsid_") :] or "Name"), F.col(p)) for c, p in cols]
    by_id = [F.when(F.col(c) == F.col("consensus_dtxsid"), F.col(p)) for c, p in cols]
    return F.coalesce(*by_source, *by_id, *[F.col(p) for _, p in cols])


MATCH_TYPES = {"exact": "Exact name", "cas": "CAS number", "cas_in_name": "CAS number in name", "wqx_exact": "Characteristic", "wqx_alias": "Characteristic alias", "wqx_fuzzy": "Characteristic, near", "starts_with": "Prefix", "isotope": "Isotope", "miss": "None", "cas_invalid": "Invalid CAS number"}


def match_type(df: DataFrame) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MATCH_TYPES.items() for x in kv]), aligned(df, "source_tier")), F.lit("None"))


@dataclass
class Queued:
    rows: frozenset[int]
    kind: str
    value: str

    def __post_init__(self):
        self.kind = self.kind.strip().lower()
        if self.kind not in ("dtxsid", "wqx"):
            raise ValueError(f"no such override: {self.kind}")
        self.value = self.value.strip().upper() if self.kind == "dtxsid" else self.value.strip()


def queued(queue: list[Queued], entry: Queued) -> list[Queued]:
    """The newest wins over those that share a row with it."""
    return [q for q in queue if not q.rows & entry.rows] + [entry]


def apply_queue(df: DataFrame, queue: list[Queued], valid: DataFrame | None = None, row_id: str = "original_row_id") -> DataFrame:
    """Ids (only valid ones, where a table of them is given) and characteristic names for their rows; these are pinned."""
    spark = df.sparkSession
    rows = [(r, q.kind, q.value) for q in queue for r in sorted(q.rows)]
    if len(rows) > MAX_OVERRIDES:
        raise ValueError(f"more than {MAX_OVERRIDES} queued rows")
    todo = spark.createDataFrame(rows, "_row long, _kind string, _value string")
    if valid is not None:
        ok = valid.filter("is_valid").select(F.col("dtxsid").alias("_value"), F.lit(True).alias("_ok"))
        todo = todo.join(ok, "_value", "left").filter("_kind = 'wqx' or _ok").drop("_ok")
    got = df.join(F.broadcast(todo), F.col(row_id) == F.col("_row"), "left")
    hit = F.col("_row").isNotNull()
    new = {"consensus_dtxsid": F.when(F.col("_kind") == "dtxsid", F.col("_value")), "consensus_status": F.when(F.col("_kind") == "wqx", "wqx").otherwise("manual"), "consensus_source": F.concat(F.lit("override_"), F.col("_kind")), "pinned": F.lit(True), "resolution_method": F.lit("override"), "resolution_reason": F.when(F.col("_kind") == "wqx", F.col("_value"))}
    return got.withColumns({c: F.when(hit, v).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in new.items()}).drop("_row", "_kind", "_value")


def resolve_multi_analyte(df: DataFrame, column: str, decisions: DataFrame, row_id: str = "original_row_id") -> DataFrame:
    """Decisions (row_id, action keep, rename or split, values) for all rows at once; a split row becomes one for each part."""
    from ..functions import names
    from .cleaning import MULTI_FLAG

    asked = F.regexp_replace(F.lower(F.trim("action")), "[ _-]+", "_")
    action = F.when(asked.isin("keep", "keep_combined", "combined"), "keep").when(asked.isin("split", "rename"), asked)
    checked = F.when(action.isNull(), F.raise_error(F.concat(F.lit("no such action: "), F.coalesce("action", F.lit("none")))).cast("string")).otherwise(action)
    right = decisions.select(F.col(row_id).alias("_row"), checked.alias("_action"), F.filter(F.transform(F.split("values", "[\n;]"), lambda x: F.trim(x)), lambda x: x != "").alias("_values"))
    got = df.join(right, F.col(row_id) == F.col("_row"), "left")
    given = F.when(F.size("_values") > 0, F.col("_values"))
    parts = F.when(F.col("_action") == "split", F.coalesce(given, names.multi_analyte_parts(F.col(column)))).when(F.col("_action") == "rename", F.slice(F.coalesce(given, F.array(column)), 1, 1)).otherwise(F.array(column))
    status = F.when(F.col("_action") == "split", "split").when(F.col("_action") == "rename", "renamed").when(F.col("_action") == "keep", "kept")
    flag = F.when(status.isNotNull(), F.regexp_replace(F.coalesce("cleaning_flag", F.lit(MULTI_FLAG)), MULTI_FLAG, F.concat(F.lit("REVIEWED: multi-analyte "), status))).otherwise(F.col("cleaning_flag"))
    other = [c for c in df.columns if c not in (column, "cleaning_flag")]
    got = got.select(*other, flag.alias("cleaning_flag"), F.col(column).alias("multi_analyte_original"), F.col("_action").alias("multi_analyte_action"), F.size(parts).alias("multi_analyte_count"), F.posexplode(parts).alias("_i", column))
    return got.withColumn("multi_analyte_index", F.col("_i") + 1).select(*df.columns, "multi_analyte_original", "multi_analyte_action", "multi_analyte_count", "multi_analyte_index")


def override_table(overrides: dict[int, dict[str, object]]) -> list[tuple[int, str, object]]:
    """(row, column, value) of overrides by row number, as older sessions kept them, in order."""
    return [(row, c, v) for row, cells in sorted(overrides.items()) for c, v in cells.items()]


def replayed_by_row(df: DataFrame, overrides: dict[int, dict[str, object]], row_id: str = "original_row_id") -> DataFrame:
    """Overrides by row number, as older sessions kept them."""
    return replayed(df, Spec([Override(c, v, {row_id: row}) for row, c, v in override_table(overrides)]))


def wqx_choices(dictionary: DataFrame) -> DataFrame:
    """label (the name and what it is) and canonical_name of each entry of the dictionary that has both."""
    kind = F.when(F.col("type") == "canonical", "canonical").otherwise("alias") if "type" in dictionary.columns else F.lit("canonical")
    return dictionary.filter("name <> '' and canonical_name <> ''").select(F.concat("name", F.lit(" ("), kind, F.lit(")")).alias("label"), "canonical_name")


def wqx_names(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """value and canonical_name: itself where it is one, else that of the name it is, else null."""
    v = values.select("value").distinct().withColumn("_v", F.nullif(F.trim("value"), F.lit("")))
    d = dictionary.select(F.trim("name").alias("_n"), F.trim("canonical_name").alias("_c"))
    own = d.select(F.col("_c").alias("_v")).distinct().withColumn("_own", F.col("_v"))
    named = d.filter("_n <> '' and _c <> ''").groupBy(F.col("_n").alias("_v")).agg(F.min("_c").alias("_by"))
    return v.join(own, "_v", "left").join(named, "_v", "left").select("value", F.coalesce("_own", "_by").alias("canonical_name"))


def tagged_values(df: DataFrame, tags: dict[str, str], row_id: str = "original_row_id") -> DataFrame:
    """row_id and its tagged cells as texts `column = 'value'`, in order, without blank ones."""
    cells = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c} = '"), F.col(c).cast("string"), F.lit("'"))) for c in tags if c in df.columns]
    return df.select(row_id, F.array_compact(F.array(*cells) if cells else F.array().cast("array<string>")).alias("cells"))
