"""Reading messy files and writing results: CSV, workbooks, Parquet."""

from __future__ import annotations

import csv
import io
import os
import re
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = ("csv", "xlsx", "xls")
MAX_ROWS, MAX_COLS = 1_048_576, 16_384
DELIMITERS = (",", ";", "\t")
PROBE_LINES = 50


def format_size(n: float) -> str:
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} GB"


def validate(path: str, max_mb: float = 50) -> None:
    """A known kind and a size within the limit, for files that people upload."""
    if path.rsplit(".", 1)[-1].lower() not in EXTENSIONS:
        raise ValueError(f"not one of {', '.join(EXTENSIONS)}: {path}")
    if (size := os.path.getsize(path)) > max_mb * (1 << 20):
        raise ValueError(f"{format_size(size)} is more than {max_mb} MB")


def _probe(spark: SparkSession, path: str) -> tuple[str, str, bool, int]:
    """Encoding, delimiter, whether a field holds a line break, and the widest line's fields.

    The delimiter is that of the first lines; the rest is one aggregate over all lines, so a byte or a quote at the file's end
    counts like one at its head.
    """
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.limit(PROBE_LINES).collect()]
    head = [x for x in head if x.strip()]
    count = {d: sorted(len(r) for r in csv.reader(head, delimiter=d)) for d in DELIMITERS} if head else {}
    sep = max(DELIMITERS, key=lambda d: (count[d][len(count[d]) // 2] if count else 0, -DELIMITERS.index(d)))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    bare = F.regexp_replace("value", '"[^"]*"', "")
    got = lines.agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("open"), F.max(F.length(bare) - F.length(F.replace(bare, F.lit(sep))) + 1).alias("width")).first()
    encoding, broken, width = "UTF-8" if got["utf8"] is not False else "ISO-8859-1", bool(got["open"]), got["width"] or 0
    return encoding, sep, broken, _widest(spark, path, encoding, sep) if broken else width


def _widest(spark: SparkSession, path: str, encoding: str, sep: str) -> int:
    """The fields of the widest record of a file whose fields hold line breaks, so that its lines do not tell."""

    def run(batches):
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for raw in batch.column("value").to_pylist():
                rows = csv.reader(io.StringIO(raw.decode(encoding), newline=""), delimiter=sep)
                yield pa.RecordBatch.from_arrays([pa.array([max((len(r) for r in rows), default=0)])], names=["width"])

    whole = spark.read.text(path, wholetext=True).select(F.col("value").cast("binary").alias("value"))
    return whole.mapInArrow(run, "width bigint").agg(F.max("width")).first()[0] or 0


def numbered(df: DataFrame) -> DataFrame:
    """_row from 1 in the order read; partitions are numbered by sums of the counts before them."""
    placed = df.withColumn("_m", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    return placed.join(F.broadcast(counts), "_part").select((F.col("_before") + F.col("_at") + 1).alias("_row"), *df.columns)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A raw grid _row, V1..Vn of text, as wide as the widest line, without a header. A file without line breaks in its fields
    is read in as many tasks as it has splits."""
    encoding, sep, broken, width = _probe(spark, path)
    if not width:
        raise ValueError(f"empty: {path}")
    schema = ", ".join(f"V{i} string" for i in range(1, width + 1))
    return numbered(spark.read.csv(path, schema=schema, header=False, sep=sep, encoding=encoding, multiLine=broken, quote='"', escape='"', mode="PERMISSIVE"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _cells(raw: bytes, sheet: str | None) -> list[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet")]
        at = sheets.index(sheet) if sheet else 0
        rows: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{at + 1}.xml")).iter(f"{{{_NS['m']}}}row"):
            cells: list[str | None] = []
            for c in row:
                letters = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
                k = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                cells += [None] * (k + 1 - len(cells))
                kind, v = c.get("t"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    cells[k] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is not None and v.text is not None:
                    cells[k] = shared[int(v.text)] if kind == "s" else v.text
            n = int(row.get("r", len(rows) + 1))
            rows += [[] for _ in range(n - 1 - len(rows))]
            rows.append(cells)
        return rows


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def sheet_names(raw: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet")]


def read_sheet(spark: SparkSession, raw: bytes, sheet: str) -> DataFrame:
    """A sheet's rows under the names of its first."""
    rows = _cells(raw, sheet)
    names = [c or f"Column_{i}" for i, c in enumerate(rows[0], 1)] if rows else []
    if not names:
        return spark.createDataFrame([], "Column_1 string")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:]], schema)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A raw grid of one sheet. A workbook holds about a million rows at most, and is one file: it is read on the driver."""
    rows = _cells(_bytes(spark, path), sheet)
    width = max((len(r) for r in rows), default=0) or 1
    schema = "_row long, " + ", ".join(f"V{i} string" for i in range(1, width + 1))
    return spark.createDataFrame([(i, *r, *[None] * (width - len(r))) for i, r in enumerate(rows, 1)], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A raw grid by the file's kind; Parquet as it is, as text."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        return read_xlsx(spark, path)
    if kind == "parquet":
        return numbered(spark.read.parquet(path))
    if kind == "xls":
        raise ValueError("the old workbook format is not read; save it as xlsx")
    return read_csv(spark, path)


def assert_fits_sheet(df: DataFrame, name: str) -> None:
    if len(df.columns) >= MAX_COLS or df.limit(MAX_ROWS).count() >= MAX_ROWS:
        raise ValueError(f"{name} is too large for a workbook")


def _xml(s: str) -> str:
    s = re.sub(r"[^\x09\x0A\x0D\x20-\U0010FFFF]", "", s)
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def write_xlsx(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook on the driver's disk, of tables that are checked to fit."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{_xml(n)[:31]}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (name, df) in enumerate(sheets.items(), 1):
            assert_fits_sheet(df, name)
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetData>'.encode())
                rows = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).toLocalIterator()
                for r in _chain(df.columns, rows):
                    f.write(("<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{_xml(str(v))}</t></is></c>' for v in r) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")


def _chain(head: Iterable, rows: Iterable):
    yield head
    yield from rows


def write(df: DataFrame, path: str, kind: str = "parquet") -> list[str]:
    """parquet, csv or both; the paths written."""
    if kind not in ("parquet", "csv", "both"):
        raise ValueError("the format is parquet, csv or both")
    out = []
    if kind in ("parquet", "both"):
        df.write.mode("overwrite").parquet(f"{path}.parquet")
        out.append(f"{path}.parquet")
    if kind in ("csv", "both"):
        df.write.mode("overwrite").csv(f"{path}.csv", header=True)
        out.append(f"{path}.csv")
    return out


MARKER = ("assayworks_export", "true")
SHEETS = ("Raw Data", "Cleaned Data", "Curated Data", "Summary", "Cleaning Audit", "Reference Lists", "Column Tags", "Pipeline Config", "Session State", "ToxVal Output", "Harmonization Audit")


def export_sheets(spark: SparkSession, tables: dict[str, DataFrame], tags: dict[str, str], config: dict[str, object] | None = None) -> dict[str, DataFrame]:
    """All sheets of an export by name; config and tags become key and value rows."""
    unknown = set(tables) - set(SHEETS)
    if unknown:
        raise ValueError(f"no such sheet: {sorted(unknown)}")
    rows = [MARKER, *[(k, None if v is None else str(v)) for k, v in (config or {}).items()]]
    own = {"Column Tags": spark.createDataFrame(list(tags.items()), "Column string, Type string"), "Pipeline Config": spark.createDataFrame(rows, "Key string, Value string")}
    every = tables | own
    return {s: every[s] for s in SHEETS if s in every}


def write_export(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook (a path that ends in .xlsx, on the driver's disk), or a folder of Parquet tables, which has no size limit."""
    if path.endswith(".xlsx"):
        write_xlsx(sheets, path.removeprefix("file://"))
        return
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name.lower().replace(' ', '_')}.parquet")


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The sheets of an export of ours, or None for anything else. A workbook's cells are texts."""
    from pyspark.errors import AnalysisException

    out = {}
    if path.endswith(".xlsx"):
        raw = _bytes(spark, path)
        out = {s: read_sheet(spark, raw, s) for s in sheet_names(raw) if s in SHEETS}
    for s in SHEETS if not path.endswith(".xlsx") else ():
        try:
            out[s] = spark.read.parquet(f"{path}/{s.lower().replace(' ', '_')}.parquet")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
    config = out.get("Pipeline Config")
    if config is None or not {"Key", "Value"} <= set(config.columns) or not config.filter((F.col("Key") == MARKER[0]) & (F.lower(F.trim("Value")) == MARKER[1])).limit(1).count():
        return None
    return out


def config_of(sheets: dict[str, DataFrame]) -> dict[str, str | None]:
    return {r["Key"]: r["Value"] for r in sheets["Pipeline Config"].collect()}


def tags_of(sheets: dict[str, DataFrame]) -> dict[str, str]:
    rows = sheets["Column Tags"].filter("Column <> '' and Type <> ''").collect() if "Column Tags" in sheets else []
    return {r["Column"]: r["Type"] for r in rows}


def session_state(df: DataFrame, summary: DataFrame, columns: Iterable[str], row_id: str = "original_row_id") -> DataFrame:
    """Rows' review state and the summary's counts in one table."""
    state = df.select(F.lit("row_state").alias("record_type"), F.col(row_id).alias("row_index"), *[F.col(c).cast("string") for c in columns if c in df.columns])
    counts = summary.select(F.lit("summary").alias("record_type"), F.col("status").alias("key"), F.col("n").cast("string").alias("value"))
    return state.unionByName(counts, allowMissingColumns=True)


def summary_of(state: DataFrame) -> dict[str, float | str]:
    """A session's counts by status; what is no number stays a text."""
    if not {"record_type", "key", "value"} <= set(state.columns):
        return {}

    def value(x: str | None) -> float | str | None:
        try:
            return float(x)
        except (TypeError, ValueError):
            return x

    return {r["key"]: value(r["value"]) for r in state.filter("record_type = 'summary' and key <> ''").select("key", "value").collect()}


def restored(df: DataFrame, state: DataFrame, row_id: str = "original_row_id") -> DataFrame:
    """df with the review state of a session's rows, in the types that review state has."""
    from ..operators.consensus import REVIEW, STATE

    rows = state.filter("record_type = 'row_state'")
    new = [c for c in rows.columns if c not in ("record_type", "row_index", "key", "value")]
    kinds = dict(df.dtypes) | STATE | REVIEW
    bools = {c: F.lower(F.trim(F.col(f"_s_{c}"))).isin("true", "t", "1", "yes") for c in new if kinds.get(c) == "boolean"}
    right = rows.select(F.col("row_index").try_cast("double").cast("long").alias("_row"), *[F.when(F.col(c).cast("string") != "NA", F.col(c).cast("string")).alias(f"_s_{c}") for c in new])
    got = df.join(right, F.col(row_id).cast("long") == F.col("_row"), "left")
    return got.withColumns({c: F.coalesce(bools[c], F.lit(False)) if c in bools else F.col(f"_s_{c}").try_cast(kinds.get(c, "string")) for c in new}).drop("_row", *[f"_s_{c}" for c in new])


HARMONIZED = {"orig_row_id": "bigint", "orig_result": "string", "numeric_value": "double", "parse_flag": "string", "orig_unit": "string", "harmonized_value": "double", "harmonized_unit": "string", "conversion_factor": "double", "unit_flag": "string"}


def harmonized_of(audit: DataFrame) -> DataFrame:
    """The measurements' rows of a session's audit, with their types and with defaults for columns it lacks."""
    default = lambda c: F.lit("") if c.endswith("_flag") else F.lit(None)
    return audit.select(*[(F.coalesce(F.col(c).try_cast(k), default(c).cast(k)) if c in audit.columns else default(c).cast(k)).alias(c) for c, k in HARMONIZED.items()])


@dataclass
class Session:
    raw: DataFrame | None
    cleaned: DataFrame | None
    curated: DataFrame | None
    tags: dict[str, str]
    config: dict[str, str | None]
    summary: dict[str, float | str]
    audit: DataFrame | None
    harmonized: DataFrame | None
    toxval: DataFrame | None
    lists: dict[str, DataFrame]
    warnings: list[str]


def hydrated(sheets: dict[str, DataFrame], lists: dict[str, DataFrame] | None = None, row_id: str = "original_row_id") -> Session:
    """A session as an export holds it; what does not fit together is a warning."""
    from ..operators import consensus, references

    curated, state, warnings = sheets.get("Curated Data"), sheets.get("Session State"), []
    summary = summary_of(state) if state is not None else {}
    if curated is not None:
        n = curated.count()
        if state is not None:
            rows = state.filter("record_type = 'row_state'").count()
            if rows != n:
                warnings.append(f"the session state has {rows} rows, the curated data {n}: those in both are restored")
            curated = restored(curated, state, row_id)
        curated = consensus.with_state(curated)
        if not summary and "consensus_status" in curated.columns:
            summary = {r["status"]: float(r["n"]) for r in consensus.summary(curated).collect()}
        if "Raw Data" in sheets and (raw := sheets["Raw Data"].count()) != n:
            warnings.append(f"the raw data has {raw} rows, the curated data {n}: the state may be stale")
    audit = sheets.get("Harmonization Audit")
    own = references.imported(lists or {}, sheets["Reference Lists"]) if "Reference Lists" in sheets else dict(lists or {})
    return Session(sheets.get("Raw Data"), sheets.get("Cleaned Data"), curated, tags_of(sheets), config_of(sheets), summary, sheets.get("Cleaning Audit"), harmonized_of(audit) if audit is not None else None, sheets.get("ToxVal Output"), own, warnings)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """A table read through a Parquet copy, made on first use."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
