"""Names and registry numbers to identities, tier after tier, over distinct values.

A catalog is a table search_key, dtxsid, preferred_name, search_name, rank; keys are lower case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cas, names
from ..functions.similarity import jaro_similarity
from ..sources.shared import stored

RESULT = ("search_value", "dtxsid", "preferred_name", "search_name", "rank", "source_tier", "tier_order")
TIERS = ("exact", "cas_in_name", "wqx", "starts_with", "miss", "cas")


def keyed(df: DataFrame, tags: dict[str, str], row_id: str = "original_row_id", skip: Column | None = None) -> DataFrame:
    """row_id, column, tag, key of every non-blank name and registry number of the rows not skipped."""
    rows = df if skip is None else df.filter(~F.coalesce(skip, F.lit(False)))
    cols = [(c, t) for c, t in tags.items() if t in ("Name", "Other", "CASRN") and c in df.columns]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("tag"), F.trim(F.col(c).cast("string")).alias("key")) for c, t in cols])).alias("c")
    return rows.select(row_id, cells).select(row_id, "c.*").filter("key <> ''")


def blocked(flag: str = "cleaning_flag") -> Column:
    """Whether any token of the flag is a block."""
    return F.coalesce(F.exists(F.split(F.col(flag), ";"), lambda t: F.trim(t).startswith("BLOCK:")), F.lit(False))


def dedup_preview(df: DataFrame, tags: dict[str, str], skip: Column | None = None) -> DataFrame:
    """unique_names and unique_cas, one aggregate."""
    keys = keyed(df, tags, skip=skip)
    return keys.agg(F.count_distinct(F.when(F.col("tag") != "CASRN", F.col("key"))).alias("unique_names"), F.count_distinct(F.when(F.col("tag") == "CASRN", F.col("key"))).alias("unique_cas"))


def _best(rows: DataFrame, by: str) -> DataFrame:
    """The lowest rank of each value, nulls last, then by id: partial aggregates, no window."""
    return rows.groupBy(by).agg(F.min_by(F.struct("dtxsid", "preferred_name", "search_name", "rank"), F.struct(F.col("rank").isNull(), "rank", "dtxsid")).alias("b")).select(by, "b.*")


def _tier(df: DataFrame, tier: str) -> DataFrame:
    return df.select("search_value", "dtxsid", "preferred_name", "search_name", "rank", F.lit(tier).alias("source_tier"), F.lit(TIERS.index(tier.split("_")[0] if tier.startswith("wqx") else tier)).alias("tier_order"))


def search_exact(values: DataFrame, catalog: DataFrame) -> DataFrame:
    found = values.join(catalog, F.lower("search_value") == F.col("search_key")).drop("search_key")
    return _tier(_best(found, "search_value"), "exact")


def search_cas(values: DataFrame, catalog: DataFrame, tier: str = "cas") -> DataFrame:
    """Valid numbers that the catalog has; others are rows without an id (cas_invalid, or cas_miss where valid)."""
    normal = values.withColumn("_cas", cas.as_cas(F.col("search_value")))
    found = _best(normal.join(catalog, F.lower("_cas") == F.col("search_key")).drop("search_key"), "search_value")
    got = normal.join(found, "search_value", "left")
    name = F.when(F.col("dtxsid").isNotNull(), tier).when(F.col("_cas").isNull(), "cas_invalid").otherwise("cas_miss")
    return got.select("search_value", "dtxsid", "preferred_name", "search_name", "rank", name.alias("source_tier"), F.lit(TIERS.index(tier)).alias("tier_order"))


def search_starts_with(values: DataFrame, catalog: DataFrame, least: int = 3) -> DataFrame:
    """Values of three characters and more as a prefix of a key. The first characters are an equi-join key."""
    v = values.filter(F.length("search_value") >= least).withColumns({"_low": F.lower("search_value")})
    v = v.withColumn("_b", F.substring("_low", 1, least))
    c = catalog.withColumn("_b", F.substring("search_key", 1, least))
    found = v.join(c, (v["_b"] == c["_b"]) & F.expr("startswith(search_key, _low)")).select("search_value", "dtxsid", "preferred_name", "search_name", "rank")
    return _tier(_best(found, "search_value"), "starts_with")


def _letters(c: Column) -> Column:
    """A text's characters, each with how often it was there before: equal texts of a bag of characters."""
    chars = F.split(c, "")
    return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda y: y == x)).cast("string")))


def fuzzy(values: DataFrame, targets: DataFrame, threshold: float = 0.85, beyond: bool = True) -> DataFrame:
    """search_value, wqx_name, match_distance: the nearest target of each distinct value by Jaro, ties by name.

    A similarity s needs min(len)/max(len) >= 3 s - 2, so with lengths as an equi-join key only lengths near enough meet, and
    (3 s - 1) la lb / (la + lb) characters in common, which a count of bags of characters checks before any pair is scored.
    What is within the threshold is found so. With `beyond`, values with nothing within it then meet all targets that by
    their lengths can be as near as what was found.
    """
    share = max(0.0, 3 * threshold - 2)
    v = stored(values.withColumns({"_n": F.length("search_key"), "_bag": _letters(F.col("search_key"))}), "fuzzy-values")
    sized = stored(targets.withColumns({"_tn": F.length("target_key"), "_tbag": _letters(F.col("target_key"))}), "fuzzy-targets")
    lengths = sized.select("_tn").distinct()
    fits = F.least("_n", "_tn") >= F.greatest("_n", "_tn") * share
    common = F.size(F.array_intersect("_bag", "_tbag")) >= (3 * threshold - 1) * F.col("_n") * F.col("_tn") / F.greatest(F.col("_n") + F.col("_tn"), F.lit(1)) - 1e-9

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("search_value").agg(F.min_by(F.struct(F.col("target").alias("wqx_name"), "match_distance"), F.struct("match_distance", "target")).alias("b")).select("search_value", "b.*")

    def met(rows: DataFrame, lengths_: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(lengths_), "_n").join(sized, "_tn")

    scored = lambda rows: rows.withColumn("match_distance", 1 - jaro_similarity("search_key", "target_key"))
    pairs = v.select("_n").distinct().join(F.broadcast(lengths))
    near = stored(best(scored(met(v, pairs.filter(fits)).filter(common))), "near")
    if not beyond:
        return near
    left = v.join(near.select("search_value", F.col("match_distance").alias("_d")), "search_value", "left").filter(f"_d is null or _d > {1 - threshold} + 1e-12")
    # a distance is a third of the lengths' difference, as a share of the longer, at least; an empty text has the distance 1
    able = (1 - F.least("_n", "_tn") / F.greatest("_n", "_tn", F.lit(1))) / 3 <= F.coalesce("_d", F.lit(1.0)) + 1e-9
    far = best(scored(met(left, pairs).filter(able)))
    both = near.unionByName(far).withColumnRenamed("wqx_name", "target")
    return best(both)


def match_wqx(values: DataFrame, dictionary: DataFrame, threshold: float = 0.85, beyond: bool = True) -> DataFrame:
    """input_name, wqx_name, match_tier, match_distance, alias_type of every distinct value.

    dictionary: name, canonical_name, type (canonical, standardize, synonym, retired). First an equal canonical key, then
    an alias (standardize before synonym before retired), then the nearest canonical name. A distance beyond the
    threshold is kept with the miss; without `beyond` it may not be that of the nearest name.
    """
    d = dictionary.withColumn("_key", names.wqx_key(F.col("name")))
    rank = F.when(F.col("type") == "standardize", 1).when(F.col("type") == "synonym", 2).otherwise(3)
    canonical = d.filter("type = 'canonical'").groupBy("_key").agg(F.min("canonical_name").alias("wqx_name"))
    alias = d.filter("type <> 'canonical'").groupBy("_key").agg(F.min_by(F.struct(F.col("canonical_name").alias("a_name"), F.col("type").alias("a_type")), F.struct(rank, "canonical_name")).alias("a")).select("_key", "a.*")
    v = values.select("search_value").distinct().withColumn("_key", names.wqx_key(F.col("search_value")))
    got = stored(v.join(canonical, "_key", "left").join(alias, "_key", "left"), "wqx-keys")
    missing = got.filter("wqx_name is null and a_name is null").select("search_value", F.col("_key").alias("search_key"))
    near = fuzzy(missing, canonical.select(F.col("_key").alias("target_key"), F.col("wqx_name").alias("target")), threshold, beyond).select("search_value", F.col("wqx_name").alias("f_name"), "match_distance")
    got = got.join(near, "search_value", "left")
    within = F.col("match_distance") <= 1 - threshold + 1e-12
    tier = F.when(F.col("wqx_name").isNotNull(), "wqx_exact").when(F.col("a_name").isNotNull(), "wqx_alias").when(within, "wqx_fuzzy").otherwise("miss")
    name = F.coalesce("wqx_name", "a_name", F.when(within, F.col("f_name")))
    distance = F.when(tier.isin("wqx_exact", "wqx_alias"), 0.0).otherwise(F.col("match_distance"))
    return got.select(F.col("search_value").alias("input_name"), name.alias("wqx_name"), tier.alias("match_tier"), distance.alias("match_distance"), F.when(tier == "wqx_alias", F.col("a_type")).alias("alias_type"))


def tiered(names_: DataFrame, numbers: DataFrame, catalog: DataFrame, dictionary: DataFrame | None = None, starts_with: bool = False, threshold: float = 0.85) -> DataFrame:
    """Results of every tier in turn, each over what the tiers before left, and of the registry numbers.

    Each tier's results and what it leaves are stored, so a tier's plan does not repeat those of all tiers before it.
    """
    exact = stored(search_exact(names_, catalog), "tier-exact")
    left = stored(names_.join(exact.select("search_value"), "search_value", "left_anti"), "tier-left")
    in_name = stored(search_cas(left, catalog, "cas_in_name"), "tier-cas")
    out = [exact, in_name]
    left = stored(left.join(in_name.filter("dtxsid is not null").select("search_value"), "search_value", "left_anti"), "tier-left")
    if dictionary is not None:
        w = match_wqx(left, dictionary, threshold, beyond=False).filter("wqx_name is not null")
        w = w.select(F.col("input_name").alias("search_value"), F.lit(None).cast("string").alias("dtxsid"), F.col("wqx_name").alias("preferred_name"), F.col("wqx_name").alias("search_name"), F.lit(None).cast("int").alias("rank"), F.col("match_tier").alias("source_tier"), F.lit(TIERS.index("wqx")).alias("tier_order"))
        w = stored(w, "tier-wqx")
        out.append(w)
        left = stored(left.join(w.select("search_value"), "search_value", "left_anti"), "tier-left")
    if starts_with:
        p = stored(search_starts_with(left, catalog), "tier-prefix")
        out.append(p)
        left = left.join(p.select("search_value"), "search_value", "left_anti")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("dtxsid", "string"), ("preferred_name", "string"), ("search_name", "string"), ("rank", "int"))]
    out.append(left.select("search_value", *none, F.lit("miss").alias("source_tier"), F.lit(TIERS.index("miss")).alias("tier_order")))
    out.append(search_cas(numbers, catalog))
    return reduce(lambda a, b: a.unionByName(b), [o.withColumn("rank", F.col("rank").cast("int")) for o in out])


def chosen(results: DataFrame) -> DataFrame:
    """One result of each value: those with an id or a name first, then by rank (nulls last), then in order of tiers."""
    order = F.struct((F.col("dtxsid").isNull() & F.col("preferred_name").isNull()).alias("a"), F.col("rank").isNull().alias("b"), "rank", "tier_order")
    return results.groupBy("search_value").agg(F.min_by(F.struct("dtxsid", "preferred_name", "rank", "source_tier"), order).alias("b")).select("search_value", "b.*")


def mapped(df: DataFrame, tags: dict[str, str], results: DataFrame, pre_resolved: DataFrame | None = None, row_id: str = "original_row_id") -> DataFrame:
    """df with dtxsid, preferredName, rank and source_tier for each tagged column, suffixed where there are several.

    pre_resolved: row_id, dtxsid, name of rows known beforehand; they get rank 0.
    """
    best = chosen(results)
    cols = [c for c, t in tags.items() if t in ("Name", "Other", "CASRN") and c in df.columns]
    for c in cols:
        end = f"_{c}" if len(cols) > 1 else ""
        side = best.select(F.col("search_value").alias("_sv"), F.col("dtxsid").alias(f"dtxsid{end}"), F.col("preferred_name").alias(f"preferredName{end}"), F.col("rank").alias(f"rank{end}"), F.col("source_tier").alias(f"source_tier{end}"))
        df = df.join(side, F.trim(F.col(c).cast("string")) == F.col("_sv"), "left").drop("_sv")
        if pre_resolved is not None and tags[c] == "Name":
            df = df.join(pre_resolved.select(row_id, F.col("dtxsid").alias("_pd"), F.col("name").alias("_pn")), row_id, "left")
            known = F.col("_pd").isNotNull()
            df = df.withColumns({f"dtxsid{end}": F.coalesce("_pd", f"dtxsid{end}"), f"preferredName{end}": F.coalesce("_pn", f"preferredName{end}"), f"rank{end}": F.when(known, 0).otherwise(F.col(f"rank{end}")), f"source_tier{end}": F.when(known, "isotope").otherwise(F.col(f"source_tier{end}"))}).drop("_pd", "_pn")
    return df


def enriched(ids: DataFrame, details: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """The cache with rows for ids it lacks; ids that details lack are rows of nulls, so they are not looked up again."""
    new = ids.select("dtxsid").filter("dtxsid is not null").distinct()
    if cache is not None:
        new = new.join(cache.select("dtxsid"), "dtxsid", "left_anti")
    got = new.join(details, "dtxsid", "left")
    return got if cache is None else cache.unionByName(got, allowMissingColumns=True)


def flattened_synonyms(*tiers: Column) -> Column:
    """Arrays of synonyms as one text, distinct in order, joined by |."""
    return F.array_join(F.array_distinct(F.filter(F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in tiers]), lambda x: x != "")), "|")


def validated_ids(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """dtxsid, is_valid, preferred_name: whether the catalog has the id."""
    known = catalog.groupBy("dtxsid").agg(F.min("preferred_name").alias("preferred_name"))
    return ids.select(F.upper(F.trim("dtxsid")).alias("dtxsid")).distinct().join(known, "dtxsid", "left").select("dtxsid", F.col("preferred_name").isNotNull().alias("is_valid"), "preferred_name")
