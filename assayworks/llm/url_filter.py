"""URL rules: a blocked Bloom filter passes possible hits to an exact hash join. DataFrame and SQL functions only.

A rule is a canonical URL without scheme (`host/path`), with a verdict. It fits its host and all subdomains where the
page's path starts with the rule's path; the longest fitting rule wins, and of rules listed twice a block wins.

The filter holds each rule and each rule's host. A page's host gives as many probes as it has labels, but no more than any
rule's host has; only a host that passes is probed with its path, at each length that the path of any rule has. So a page's
probes do not grow with the list, and the plan has no part for each rule. What passes is joined with the rules, which
removes false positives; where the list is too long to broadcast, the join is salted, since a rule like `org/` may fit a
third of all pages.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and the default verdict; repeated
rows are judged one by one; of rules of one length for one page, which have one text, a block wins; an empty table or an
empty list gives no hits; columns other than those asked for are not looked at, and these may not be named like an output.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A block of the filter is 256 bits: four words, two bits set in each.
WORDS = 4
BITS_PER_KEY = 24
#: The filter never exceeds this many blocks (32 bytes each): 2 MB, the proven bound of what is broadcast. A longer list
#: only raises the share of false positives, which the exact join removes.
MAX_BLOCKS = 1 << 16
#: Rules up to this count (of at most MAX_RULE_CHARS each) are broadcast for the exact join; beyond, the join shuffles.
MAX_BROADCAST_RULES, MAX_RULE_CHARS = 20_000, 2048
#: Copies of each rule that a salted join meets.
SALTS = 16
OUTPUTS = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(verdict, canonical url) pairs as a table."""
    rules = list(rules)
    if not rules:
        return spark.sql("select cast('' as string) rule, cast('' as string) verdict where false")
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for v, r in rules])))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the four words of the key's block."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * j).bitwiseOR(bit(2 * j + 1)) for j in range(WORDS)]


def bloom_words(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: the filter's words as an array, block after block."""
    per = keys.select(_block(F.col("rule"), blocks).alias("block"), *[m.alias(f"m{j}") for j, m in enumerate(_masks(F.col("rule")))])
    per = per.groupBy("block").agg(*[F.bit_or(f"m{j}").alias(f"m{j}") for j in range(WORDS)])
    filled = per.select(F.struct("block", F.array(*[f"m{j}" for j in range(WORDS)]).alias("w")).alias("b"))
    # Blocks are numbered, so the sorted list of those that hold bits is searched by block number through a dense array.
    dense = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.array(*[F.lit(0).cast("long")] * WORDS).alias("none"))
    dense = dense.join(filled.select("b.block", "b.w"), "block", "left").select("block", F.coalesce("w", "none").alias("w"))
    return dense.groupBy().agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "w"))), lambda x: x["w"])).alias("words"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Iterable[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """keep + host, path, rule, verdict for every row of pages; rules has the columns rule and verdict."""
    keep = list(keep)
    if clash := set(OUTPUTS) & set(keep):
        raise ValueError(f"columns named like an output: {sorted(clash)}")
    rules = rules.filter("rule is not null and verdict is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    hosts = F.regexp_extract("rule", "(?s)^([^/]*)(.*)$", 1)
    count, longest = rules.agg(F.count("*"), F.max(F.length("rule"))).first()
    base = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    none = F.lit(None).cast("string")
    if not count:
        return base.withColumns({"rule": none, "verdict": F.lit(default)})
    # Rules that end with their host have a path of no characters and no / to tell them from the host itself.
    keys = rules.select("rule").unionByName(rules.select(F.concat(F.lit("/"), hosts).alias("rule"))).distinct()
    blocks = 1
    while blocks < min(MAX_BLOCKS, 2 * count * BITS_PER_KEY / 256):
        blocks *= 2
    # What probes need of the list: one row, bounded by the filter's size and the longest rule.
    chars = F.length("rule") - F.length(hosts)
    shape = rules.agg(F.max(_labels(hosts)).alias("most_labels"), F.sort_array(F.collect_set(chars)).alias("chars"))
    one = bloom_words(keys, blocks).withColumn("one", F.lit(1)).join(shape.withColumn("one", F.lit(1)), "one")
    probed = base.withColumns({"uid": F.monotonically_increasing_id(), "one": F.lit(1)}).join(F.broadcast(one), "one", "left")

    def passes(key: Column) -> Column:
        at = _block(key, blocks) * WORDS
        found = [F.get("words", at + j).bitwiseAND(m) == m for j, m in enumerate(_masks(key))]
        return found[0] & found[1] & found[2] & found[3]

    suffixes = F.transform(F.sequence(F.lit(1), F.least(_labels(F.col("host")), F.col("most_labels"))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    probed = probed.withColumn("hosts", F.filter(suffixes, lambda h: passes(F.concat(F.lit("/"), h))))
    fits = F.filter("chars", lambda n: n <= F.length("path"))
    probes = F.flatten(F.transform("hosts", lambda h: F.transform(fits, lambda n: F.concat(h, F.col("path").substr(F.lit(1), n)))))
    probed = probed.withColumn("hits", F.when(F.size("hosts") > 0, F.filter(probes, passes)).otherwise(F.array().cast("array<string>")))
    probed = probed.select(*keep, "host", "path", "uid", "hits")
    missed = probed.filter(F.size("hits") == 0).select(*keep, "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    hits = probed.filter(F.size("hits") > 0).select(*keep, "host", "path", "uid", F.explode("hits").alias("rule"))
    if count <= MAX_BROADCAST_RULES and longest <= MAX_RULE_CHARS:
        exact = hits.join(F.broadcast(rules), "rule", "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        exact = hits.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(salted, ["rule", "salt"], "left").drop("salt")
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))))
    found = exact.groupBy("uid", *keep, "host", "path").agg(best.alias("best"))
    found = found.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return missed.unionByName(found)


#: The rules of the query.
QUERY_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, QUERY_RULES))


SQL = {
    "op10_url_filter": """
with rules(host, path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut as (select row_number() over () as uid, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select uid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fits as (select p.uid, r.host || r.path as rule, r.verdict, row_number() over (partition by p.uid order by length(r.host || r.path) desc) as k
  from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict from parts p left join fits f on f.uid = p.uid and f.k = 1
"""
}
