"""Quality rules: a threshold table compiled into one projection of ratios, without user functions.

Words are `[^\\x20\\x09-\\x0D]+`; all counts are over the whole text.

Defined results: a null or empty text has no words, so all counts are 0 and base_failed is true; repeated rows are judged
one by one; very long texts go through the same expressions; an empty table gives an empty table. Columns of the input
that clash with those made here are not carried, only those asked for, which may not be named like an output.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Common function words of the languages in question; their share shows running prose.
STOP_WORDS = ("the", "of", "and", "to", "in", "that", "is", "for", "with", "a", "on", "de", "la", "el", "que", "y", "los", "en", "un", "del", "le", "les", "des", "et", "une", "du", "der", "die", "und", "das", "zu", "mit", "den", "von", "ist")


@dataclass(frozen=True)
class Threshold:
    """A document passes where low <= numerator / denominator <= high; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The threshold table: ratios of the counts below.
THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", 2.0, 12.0),
    Threshold("symbols", "n_symbols", "word_chars", None, 0.10),
    Threshold("stop_words", "n_stop_words", "n_words", 0.02, None),
    Threshold("duplicate_lines", "n_dup_lines", "n_word_lines", None, 0.50),
    Threshold("repeated_words", "n_repeat_words", "n_words", None, 0.50),
)
MIN_WORDS = 50
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_stop_words", "base_failed", "missed", "kept")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the table's ratios are made of."""
    # Each array is made in a projection of its own, so nothing below evaluates it anew for every element. The fence, a
    # running number that no optimizer rule can see through, keeps a filter on the results from being pushed below.
    t = F.coalesce(F.col(text), F.lit(""))
    fence = F.monotonically_increasing_id()
    on = F.col("_fence") + F.monotonically_increasing_id()
    df = docs.withColumns({"_fence": fence, "_w": F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")})
    df = df.withColumn("_l", F.filter(F.split(t, "\n"), lambda s: F.translate(s, SPACES, "") != ""))
    n = F.size("_w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("g"), i.alias("i"))))
    df = df.withColumns({"_fence": on, "_g": F.sort_array(F.coalesce(windows, F.array().cast("array<struct<g:bigint,i:int>>")))})

    # Windows equal to a neighbour in the order of their hashes are those found twice or more; their places, in order. Of
    # equal hashes the words themselves are compared.
    def same(x: Column, y: Column) -> Column:
        words = [F.get("_w", x["i"] + j) == F.get("_w", y["i"] + j) for j in range(3)]
        return F.coalesce(F.when(x["g"] == y["g"], words[0] & words[1] & words[2]), F.lit(False))

    twice = F.filter("_g", lambda x, k: same(x, F.get("_g", k - 1)) | same(x, F.get("_g", k + 1)))
    df = df.withColumns({"_fence": on, "_p": F.sort_array(F.transform(twice, lambda x: x["i"]))})
    # Each place covers three words, less those that the next place covers too.
    covered = F.aggregate("_p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    plain = F.translate(t, SPACES, "")
    return df.withColumns(
        {
            "_fence": on,
            "n_words": n.cast("long"),
            "word_chars": F.length(plain).cast("long"),
            "n_symbols": (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long"),
            "n_word_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": covered,
            "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        }
    ).drop("_w", "_l", "_g", "_p")


def compiled(thresholds: Iterable[Threshold] = THRESHOLDS) -> Column:
    """The names of the thresholds that a row misses, as one expression."""

    def miss(t: Threshold) -> Column:
        ratio = F.col(t.numerator) / F.when(F.col(t.denominator) != 0, F.col(t.denominator))
        out = F.lit(False)
        if t.low is not None:
            out = out | (ratio < t.low)
        if t.high is not None:
            out = out | (ratio > t.high)
        return F.when(F.coalesce(out, F.lit(False)), F.lit(t.name))

    return F.array_compact(F.array(*[miss(t) for t in thresholds]))


def quality(docs: DataFrame, text: str = "text", keep: Iterable[str] = ("doc_id",), thresholds: Iterable[Threshold] = THRESHOLDS) -> DataFrame:
    """keep + counts, base_failed, the missed thresholds and the verdict."""
    keep = list(keep)
    if clash := set(OUTPUTS) & set(keep):
        raise ValueError(f"columns named like an output: {sorted(clash)}")
    df = counts(docs.select(*keep, *([] if text in keep else [text])), text)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumns({"base_failed": base, "missed": compiled(thresholds)})
    df = df.withColumn("kept", ~F.col("base_failed") & (F.size("missed") == 0) & (F.col("_fence") >= 0))
    return df.select(*keep, *OUTPUTS)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = {
    "op7_quality": """
with w as (select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
l as (select *, len(w) as n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
  list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as g from w),
u as (select row_number() over () as uid, * from l),
win as (select uid, unnest(g) as gram, unnest(range(1, len(g) + 1)) as i from u),
dup as (select uid, i from (select uid, i, count(*) over (partition by uid, gram) as c from win) where c > 1),
cov as (select uid, count(distinct i + k) as n_rep from dup, (values (0), (1), (2)) as o(k) group by uid),
c as (select u.doc_id, n as n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(n_rep, 0) as n_repeat_words, len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop from u left join cov using (uid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / n_words between 2.0 and 12.0 and (word_chars = 0 or n_symbols / word_chars <= 0.10) and n_stop / n_words >= 0.02 and n_dup_lines / n_lines <= 0.50
  and n_repeat_words / n_words <= 0.50 as kept from b
""".replace("{stop}", ", ".join(f"'{w}'" for w in STOP_WORDS))
}
