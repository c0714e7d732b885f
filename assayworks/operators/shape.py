"""Where the data of a raw grid starts, and its shape from there.

A raw grid has the columns _row (from 1) and V1..Vn, all text. The start is found on the driver from its first rows only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import stdev

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD_ROWS = 70
# Words that headers of such tables have.
KEYWORDS = (
    "name", "id", "date", "type", "value", "code", "description", "amount", "status", "category", "number", "chemical", "cas", "formula", "molecular", "structure", "compound", "substance", "reagent", "solvent",
    "hazard", "safety", "ghs", "sds", "msds", "quantity", "qty", "mass", "volume", "concentration", "purity", "grade", "supplier", "manufacturer", "storage", "location", "expiry", "batch", "lot",
)
Cells = Sequence[str | None]


@dataclass(frozen=True)
class Start:
    header_row: int
    confidence: float
    method: str


def _filled(cells: Cells) -> list[str]:
    return [c.strip() for c in cells if c is not None and c.strip()]


def _number(c: str) -> bool:
    return bool(re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", c))


def header_likeness(cells: Cells) -> float:
    """Filled x unique x (1 - numeric) squared."""
    got = _filled(cells)
    if not got:
        return 0.0
    return len(got) / len(cells) * len(set(got)) / len(got) * (1 - sum(map(_number, got)) / len(got)) ** 2


def by_heuristic(rows: Sequence[Cells], min_filled: float = 0.7, min_cols: int = 3) -> Start | None:
    share = []
    for cells in rows[:50]:
        got = _filled(cells)
        share.append((len(got) / max(1, len(cells)), len(got), len(set(got)) / max(1, len(got))))
    ok = [i for i, (f, n, u) in enumerate(share) if n >= min_cols and f >= min_filled and u > 0.3]
    if not ok:
        return None
    at = ok[0]
    header = at - 1 if at > 0 and share[at - 1][0] > 0.5 else at
    fills = [share[i][0] for i in ok]
    return Start(header + 1, min(1.0, sum(fills) / len(fills) * (1 - min(stdev(fills) if len(fills) > 1 else 0.0, 0.3))), "heuristic")


def by_keywords(rows: Sequence[Cells]) -> Start | None:
    """The row, of the first 20, that names most of the words; short texts count a tenth each."""
    scores = []
    for cells in rows[:20]:
        text = " ".join(c or "" for c in cells).lower()
        scores.append(sum(k in text for k in KEYWORDS) + 0.1 * sum(c is not None and 2 < len(c) < 30 for c in cells))
    if not scores:
        return None
    best = max(scores)
    return Start(scores.index(best) + 1, min(1.0, best / len(KEYWORDS)), "pattern") if best else Start(1, 0.2, "pattern")


def by_types(rows: Sequence[Cells], scan: int = 50) -> Start | None:
    """The header after which columns are most of one type."""
    best = None
    for i in range(min(20, len(rows) - 1)):
        below, steady = rows[i + 1 : i + 1 + scan], []
        for k in range(len(rows[i])):
            got = [r[k].strip() for r in below if k < len(r) and r[k] is not None and r[k].strip()]
            if got:
                share = sum(map(_number, got)) / len(got)
                steady.append(1.0 if share > 0.8 else 0.9 if share < 0.2 else 0.3)
        if steady:
            score = sum(steady) / len(steady) * (0.5 + 0.5 * header_likeness(rows[i]))
            if best is None or score > best[0]:
                best = (score, i)
    return Start(best[1] + 1, best[0], "type_consistency") if best else None


def value_columns(grid: DataFrame) -> list[str]:
    return [c for c in grid.columns if c != "_row"]


def head(grid: DataFrame, n: int = HEAD_ROWS) -> list[Cells]:
    return [list(r)[1:] for r in grid.select("_row", *value_columns(grid)).filter(F.col("_row") <= n).orderBy("_row").collect()]


def detect_start(grid: DataFrame, manual: int | None = None) -> Start:
    """The surest of three detectors, the first of equals; row 1 at 0.3 where none finds any."""
    if manual is not None:
        return Start(manual, 1.0, "manual")
    rows = head(grid)
    found = [s for s in (by_heuristic(rows), by_keywords(rows), by_types(rows)) if s is not None]
    return max(found, key=lambda s: s.confidence, default=Start(1, 0.3, "fallback"))


def clean_names(columns: Sequence[str]) -> list[str]:
    """Lower-case words joined by _, unique."""
    out: list[str] = []
    for c in columns:
        name = re.sub(r"[^0-9a-z]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", c.replace("%", "_percent_").replace("#", "_number_")).lower()).strip("_") or "x"
        name = f"x{name}" if name[0].isdigit() else name
        n, base = 1, name
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def sliced(grid: DataFrame, start: Start) -> DataFrame:
    """Rows below the header, under its names; blank names become Column_i."""
    cols = value_columns(grid)
    top = grid.filter(F.col("_row") == start.header_row).select(*cols).first()
    names, seen = [], set()
    for i, c in enumerate(cols, 1):
        name = (top[c] or "").strip() if top is not None else ""
        name = name if name and name not in seen else f"Column_{i}"
        seen.add(name)
        names.append(name)
    return grid.filter(F.col("_row") > start.header_row).select("_row", *[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)])


def without_empty(df: DataFrame) -> DataFrame:
    """No rows and no columns that hold nothing; the columns from one aggregate."""
    cols = value_columns(df)
    n = df.agg(*[F.count_if(F.trim(F.col(f"`{c}`")) != "").alias(str(i)) for i, c in enumerate(cols)]).first()
    kept = [c for i, c in enumerate(cols) if n[i]]
    if not kept:
        return df.select("_row").filter("false")
    return df.select("_row", *[F.col(f"`{c}`") for c in kept]).filter(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in kept]).isNotNull())


def merged_cells_filled(df: DataFrame, order: str = "_row", threshold: float = 0.3, block: int = 100_000) -> DataFrame:
    """Where the first column is more than threshold blank, nulls take the value above them; blank texts stay.

    Rows are filled within blocks of the order, and a block's first rows from the last value of the blocks before.
    """
    first = value_columns(df)[0] if order == "_row" else next(c for c in df.columns if c != order)
    blank = df.agg(F.avg((F.coalesce(F.trim(F.col(first)), F.lit("")) == "").cast("int"))).first()[0] or 0.0
    if blank <= threshold:
        return df
    split = df.withColumn("_b", F.floor(F.col(order) / block))
    up_to = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = split.withColumn("_v", F.last(first, ignorenulls=True).over(up_to))
    ends = split.groupBy("_b").agg(F.max_by(first, F.when(F.col(first).isNotNull(), F.col(order))).alias("_end"))
    before = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", "_carry")
    return inner.join(F.broadcast(before), "_b").withColumn(first, F.coalesce("_v", "_carry")).select(*df.columns)


def preview_rows(n: int) -> int:
    return 50 if n <= 100 else 25 if n <= 1000 else 10


def missing_share(df: DataFrame) -> DataFrame:
    """n_rows, n_cols and the percentage of missing cells, of one decimal."""
    cols = df.columns
    n = F.count("*")
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in cols), F.lit(0))
    return df.agg(n.alias("n_rows"), F.lit(len(cols)).alias("n_cols"), F.round(100.0 * missing / F.nullif(n * len(cols), F.lit(0)), 1).alias("missing_percent"))
