"""One identity for each row from several columns' candidates, with its quality tier, and what reviewers do with it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import jaro_similarity

FLAGS = ("BAD", "FOLLOW-UP", "VERIFIED")
STATE = {"consensus_status": "string", "consensus_dtxsid": "string", "consensus_source": "string", "qc_tier": "int"}
REVIEW = {"pinned": "boolean", "resolution_method": "string", "resolution_reason": "string", "suggested_column": "string", "row_flag": "string", "row_flag_reason": "string"}
STATUSES = ("agree", "agree_caveat", "single", "disagree", "wqx", "error", "auto_resolved", "suggested", "unresolvable")


def id_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "dtxsid" or c.startswith("dtxsid_")]


def companion(column: str, prefix: str) -> str:
    """dtxsid_x to prefix_x."""
    return prefix + column[len("dtxsid") :]


def source_of(column: str) -> str:
    return column[len("dtxsid_") :] if column.startswith("dtxsid_") else "Name"


def evidence_key(c: Column) -> Column:
    """Characters outside a-z and 0-9 go before the case is folded, so capitals go too."""
    return F.lower(F.regexp_replace(c, "[^a-z0-9]", ""))


def _get(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def classified(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """df + consensus_status, consensus_dtxsid, consensus_source, qc_tier."""
    cols = cols or id_columns(df)
    k = len(cols)
    each = F.array(*[F.struct(F.col(c).alias("id"), F.lit(source_of(c)).alias("source"), _get(df, companion(c, "preferredName")).alias("name"), F.coalesce(_get(df, companion(c, "source_tier")).startswith("wqx_"), F.lit(False)).alias("wqx")) for c in cols])
    df = df.withColumn("_c", each)
    df = df.withColumns({"_has": F.filter("_c", lambda x: x["id"].isNotNull()), "_wqx": F.filter("_c", lambda x: x["id"].isNull() & x["wqx"] & x["name"].isNotNull()), "_tier": F.filter("_c", lambda x: x["wqx"])})
    keys = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: evidence_key(x["name"])), lambda x: x.isNotNull()))
    df = df.withColumns({"_m": F.size("_has"), "_same": F.size(F.array_distinct(F.transform("_has", lambda x: x["id"]))) == 1, "_ik": keys("_has"), "_wk": keys("_wqx")})
    conflict = (F.size("_wk") > 0) & (F.size("_ik") > 0) & (F.size(F.array_except("_wk", "_ik")) > 0)
    m = F.col("_m")
    status = F.when((m > 0) & conflict, "disagree").when((m == 0) & (F.size("_tier") > 0), "wqx").when(m == 0, "error").when(m == 1, "single").when(F.col("_same") & (m == k), "agree").when(F.col("_same"), "agree_caveat").otherwise("disagree")
    df = df.withColumn("consensus_status", status)
    s = F.col("consensus_status")
    one = s.isin("agree", "agree_caveat", "single")
    source = F.when(s == "wqx", F.get("_tier", F.lit(0))["source"]).when(one, F.get("_has", F.lit(0))["source"])
    return df.withColumns({"consensus_dtxsid": F.when(one, F.get("_has", F.lit(0))["id"]), "consensus_source": source, "qc_tier": qc_tier(s, m, k)}).drop("_c", "_has", "_wqx", "_tier", "_m", "_same", "_ik", "_wk")


def qc_tier(status: Column, matched: Column, total: int) -> Column:
    return F.when(status == "agree", 1).when(status == "agree_caveat", 1 + F.lit(total) - matched).when(status.isin("single", "wqx"), total).when(status == "disagree", total + 1).when(status == "error", total + 2).cast("int")


def with_state(df: DataFrame) -> DataFrame:
    new = {c: (F.lit(False) if c == "pinned" else F.lit(None).cast(t)) for c, t in REVIEW.items() if c not in df.columns}
    return df.withColumns(new) if new else df


def scored(df: DataFrame, name: str, cols: list[str] | None = None, cache: DataFrame | None = None, row_id: str = "original_row_id") -> DataFrame:
    """row_id, column, id, score of each candidate of the rows that disagree.

    The best Jaro similarity of the name to the candidate's preferred name and synonyms, and 0.05 for a rank of three or
    better, one at most. Distinct pairs are compared, not rows.
    """
    cols = cols or id_columns(df)
    rows = df.filter((F.col("consensus_status") == "disagree") & (F.trim(name) != ""))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col(c).alias("id"), _get(df, companion(c, "preferredName")).alias("preferred"), _get(df, companion(c, "rank"), "int").alias("rank")) for i, c in enumerate(cols)])).alias("c")
    cand = rows.select(row_id, F.lower(name).alias("_name"), each).select(row_id, "_name", "c.*").filter("id is not null")
    if cache is not None and "synonyms" in cache.columns:
        cand = cand.join(cache.groupBy("dtxsid").agg(F.first("synonyms", ignorenulls=True).alias("synonyms")).withColumnRenamed("dtxsid", "id"), "id", "left")
    else:
        cand = cand.withColumn("synonyms", F.lit(None).cast("string"))
    words = F.array_distinct(F.filter(F.concat(F.array(F.lower("preferred")), F.coalesce(F.split(F.lower("synonyms"), r"\|"), F.array().cast("array<string>"))), lambda x: x != ""))
    cand = cand.withColumn("_words", words)
    pairs = cand.select("_name", F.explode("_words").alias("_word")).distinct().withColumn("_s", jaro_similarity("_name", "_word"))
    best = cand.select(row_id, "ord", "column", "id", "rank", "_name", F.explode("_words").alias("_word")).join(pairs, ["_name", "_word"]).groupBy(row_id, "ord", "column", "id", "rank").agg(F.max("_s").alias("_s"))
    return best.select(row_id, "ord", "column", "id", F.least(F.lit(1.0), F.col("_s") + F.when(F.col("rank") <= 3, 0.05).otherwise(0.0)).alias("score"))


def with_scores(df: DataFrame, name: str, cols: list[str] | None = None, cache: DataFrame | None = None, row_id: str = "original_row_id") -> DataFrame:
    best = scored(df, name, cols, cache, row_id).groupBy(row_id).agg(F.max("score").alias("similarity_score"))
    return df.join(best, row_id, "left")


def auto_resolved(df: DataFrame, name: str, cols: list[str] | None = None, cache: DataFrame | None = None, auto: float = 0.95, gap: float = 0.15, suggest: float = 0.70, row_id: str = "original_row_id") -> DataFrame:
    """Unpinned rows that disagree: resolved where the best is good and far ahead, else suggested where it is fair."""
    df = with_state(df)
    s = scored(df.filter("not coalesce(pinned, false)"), name, cols, cache, row_id)
    top = s.groupBy(row_id).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "ord", "column", "id"))), 1, 2).alias("t"))
    first, second = -F.col("t")[0]["neg"], F.coalesce(-F.get("t", F.lit(1))["neg"], F.lit(0.0))
    top = top.select(row_id, first.alias("_best"), (first - second).alias("_gap"), F.col("t")[0]["column"].alias("_col"), F.col("t")[0]["id"].alias("_id"))
    df = df.join(top, row_id, "left")
    good = F.coalesce((F.col("_best") >= auto) & (F.col("_gap") >= gap), F.lit(False))
    fair = ~good & F.coalesce(F.col("_best") >= suggest, F.lit(False))
    why = F.when(good, F.format_string(f"score=%.2f, gap=%.2f, threshold={auto:.2f}", "_best", "_gap")).when(fair, F.format_string(f"score=%.2f, gap=%.2f, suggest_threshold={suggest:.2f}", "_best", "_gap"))
    source = F.coalesce(F.nullif(F.regexp_replace("_col", "^dtxsid_?", ""), F.lit("")), F.lit("Name"))
    return df.withColumns({
        "consensus_status": F.when(good, "auto_resolved").when(fair, "suggested").otherwise(F.col("consensus_status")),
        "pinned": good | F.coalesce("pinned", F.lit(False)),
        "resolution_method": F.when(good, "auto").when(fair, F.lit(None)).otherwise(F.col("resolution_method")),
        "resolution_reason": F.coalesce(why, "resolution_reason"),
        "consensus_dtxsid": F.when(good, F.col("_id")).otherwise(F.col("consensus_dtxsid")),
        "consensus_source": F.when(good, source).otherwise(F.col("consensus_source")),
        "suggested_column": F.when(good | fair, F.col("_col")).otherwise(F.col("suggested_column")),
    }).drop("_best", "_gap", "_col", "_id")


def _value_of(cols: list[str], which: Column) -> Column:
    return reduce(lambda a, c: F.when(which == c, F.col(c)).otherwise(a), cols, F.lit(None).cast("string"))


def accepted(df: DataFrame, cols: list[str] | None = None, method: str = "bulk-accept", rows: Column | None = None) -> DataFrame:
    """Unpinned suggested rows take their suggested column."""
    cols = cols or id_columns(df)
    go = (F.col("consensus_status") == "suggested") & ~F.coalesce("pinned", F.lit(False)) & (F.lit(True) if rows is None else rows)
    return resolved(df, F.col("suggested_column"), go, cols, method)


def resolved(df: DataFrame, column: Column, rows: Column, cols: list[str] | None = None, method: str = "manual") -> DataFrame:
    """Pins a column's id for the rows."""
    df = with_state(df)
    cols = cols or id_columns(df)
    go = F.coalesce(rows, F.lit(False)) & _value_of(cols, column).isNotNull()
    source = F.coalesce(F.nullif(F.regexp_replace(column, "^dtxsid_?", ""), F.lit("")), F.lit("Name"))
    new = {"consensus_dtxsid": _value_of(cols, column), "consensus_source": source, "consensus_status": F.lit("manual"), "pinned": F.lit(True), "resolution_method": F.lit(method)}
    return df.withColumns({c: F.when(go, v).otherwise(F.col(c)) for c, v in new.items()})


def skipped(df: DataFrame, rows: Column) -> DataFrame:
    """Pins rows without an id."""
    df = with_state(df)
    return df.withColumns({"pinned": F.when(rows, True).otherwise(F.col("pinned")), "consensus_dtxsid": F.when(rows, F.lit(None)).otherwise(F.col("consensus_dtxsid")), "resolution_method": F.when(rows, "skip").otherwise(F.col("resolution_method"))})


def by_priority(df: DataFrame, order: list[str]) -> DataFrame:
    """Unpinned rows that disagree take the first id in the order of columns; their status stays, and they are not pinned."""
    go = (F.col("consensus_status") == "disagree") & ~F.coalesce(_get(df, "pinned", "boolean"), F.lit(False))
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), source_of(c)) for c in order])
    return df.withColumns({"consensus_dtxsid": F.when(go, F.coalesce(*order)).otherwise(F.col("consensus_dtxsid")), "consensus_source": F.when(go, source).otherwise(F.col("consensus_source"))})


def options(df: DataFrame, cols: list[str] | None = None, cache: DataFrame | None = None, row_id: str = "original_row_id") -> DataFrame:
    """row_id and its candidates (column, id, name, rank), by rank with nulls last."""
    cols = cols or id_columns(df)
    each = F.array(*[F.struct(F.coalesce(_get(df, companion(c, "rank"), "int"), F.lit(2**31 - 1)).alias("by"), F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col(c).alias("id"), _get(df, companion(c, "preferredName")).alias("name")) for i, c in enumerate(cols)])
    kept = F.array_sort(F.filter(each, lambda x: x["id"].isNotNull()))
    return df.select(row_id, F.transform(kept, lambda x: F.struct(x["column"], x["id"], x["name"], F.nullif(x["by"], F.lit(2**31 - 1)).alias("rank"))).alias("candidates"))


def normalized_flag(flag: str | None) -> str | None:
    got = (flag or "").strip().upper()
    if got in ("", "CLEAR"):
        return None
    if got not in FLAGS:
        raise ValueError(f"no such flag: {flag}")
    return got


def flagged(df: DataFrame, rows: Column, flag: str | None, reason: str | None = None) -> DataFrame:
    df, flag = with_state(df), normalized_flag(flag)
    why = (reason or "").strip() or None if flag else None
    return df.withColumns({"row_flag": F.when(rows, F.lit(flag)).otherwise(F.col("row_flag")), "row_flag_reason": F.when(rows, F.lit(why)).otherwise(F.col("row_flag_reason"))})


def merged_retry(original: DataFrame, retry: DataFrame, selected: DataFrame, tags_changed: bool = False, row_id: str = "original_row_id") -> DataFrame:
    """Selected unpinned rows take the retry's columns; an error that stays one becomes unresolvable."""
    cols = [c for c in retry.columns if c != row_id and (c in STATE or c.split("_")[0] in ("dtxsid", "preferredName", "rank", "source") or (tags_changed and c not in original.columns))]
    right = retry.join(selected.select(row_id).distinct(), row_id, "left_semi").select(row_id, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_r_{c}") for c in cols])
    got = original.join(right, row_id, "left")
    go = F.coalesce("_hit", F.lit(False)) & ~F.coalesce(_get(original, "pinned", "boolean"), F.lit(False))
    stuck = go & (F.col("consensus_status") == "error") & (F.col("_r_consensus_status") == "error")
    new = {c: F.when(go, F.col(f"_r_{c}")).otherwise(F.col(c) if c in original.columns else F.lit(None)) for c in cols}
    new["consensus_status"] = F.when(stuck, "unresolvable").when(go, F.col("_r_consensus_status")).otherwise(F.col("consensus_status"))
    return got.withColumns(new).drop("_hit", *[f"_r_{c}" for c in cols])


def summary(df: DataFrame) -> DataFrame:
    """status, n over all statuses, from one aggregate; disagree leaves pinned rows out."""
    pinned = F.coalesce(_get(df, "pinned", "boolean"), F.lit(False))
    counts = {s: F.count_if((F.col("consensus_status") == s) & (~pinned if s == "disagree" else F.lit(True))) for s in (*STATUSES, "manual")}
    got = df.agg(*[v.alias(k) for k, v in counts.items()])
    return got.select(F.inline(F.array(*[F.struct(F.lit(k).alias("status"), F.col(k).alias("n")) for k in counts])))


def candidate_ids(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct ids: all candidates of rows that disagree, the consensus of others."""
    cols = cols or id_columns(df)
    ids = F.when(F.col("consensus_status") == "disagree", F.array(*cols)).otherwise(F.array("consensus_dtxsid"))
    return df.select(F.explode(ids).alias("dtxsid")).filter("dtxsid is not null").distinct()


def postprocessed(spark: SparkSession, df: DataFrame, name: str, details: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores and resolves; the table and its summary."""
    cache = candidate_ids(df).join(details, "dtxsid", "left") if details is not None else None
    got = auto_resolved(with_scores(df, name, cache=cache), name, cache=cache)
    return got, summary(got)
