"""Sample media: a vocabulary with an ontology behind it, and texts mapped to it."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quoted

CATEGORIES = ("aqueous", "air", "solid")
#: A vocabulary is a curated list; beyond this size the containment search is refused rather than broadcast.
MAX_TERMS = 100_000


def media_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[_\s]+", " ")


def prepared(media: DataFrame) -> DataFrame:
    """Active rows of known standing, user rows before others, the first of each term; missing categories inferred.

    media: term, canonical_media, envo_id, media_category, parent, source, assertion_mode, active, ord.
    """
    rows = media.filter(F.coalesce("active", F.lit(True)) & F.coalesce("assertion_mode", F.lit("auto")).isin("auto", "user"))
    rows = rows.withColumns({"term": media_key(F.col("term")), "canonical_media": F.nullif(F.lower(F.trim("canonical_media")), F.lit("")), "media_category": F.nullif(F.lower(F.trim("media_category")), F.lit("")), "parent": F.nullif(media_key(F.col("parent")), F.lit("")), "_user": (F.coalesce("source", F.lit("")) != "user").cast("int")})
    rows = rows.filter(F.col("term") != "")
    first = rows.groupBy("term").agg(F.min_by(F.struct("canonical_media", "envo_id", "media_category", "parent", "source"), F.struct("_user", "ord")).alias("r")).select("term", "r.*")
    return inferred(first)


def inferred(media: DataFrame) -> DataFrame:
    """A missing category from donors of the same canonical medium, where they agree on one."""
    donors = media.filter("media_category is not null and canonical_media is not null").groupBy("canonical_media").agg(F.min("media_category").alias("lo"), F.max("media_category").alias("hi")).filter("lo = hi").select("canonical_media", F.col("lo").alias("_cat"))
    return media.join(donors, "canonical_media", "left").withColumn("media_category", F.coalesce("media_category", "_cat")).drop("_cat").select("term", "canonical_media", "envo_id", "media_category", "parent", "source")


def climbed(media: DataFrame) -> dict[str, tuple]:
    """term to the first resolved row on its way up: (canonical, envo, category). Done on the driver: a vocabulary."""
    rows = {r["term"]: r for r in media.limit(MAX_TERMS + 1).collect()}
    if len(rows) > MAX_TERMS:
        raise ValueError("the media vocabulary is too large")
    out = {}
    for term in rows:
        at, seen = term, set()
        while at in rows and at not in seen:
            seen.add(at)
            r = rows[at]
            if r["canonical_media"] and r["media_category"]:
                out[term] = (r["canonical_media"], r["envo_id"], r["media_category"])
                break
            at = r["parent"]
    return out


def harmonized(df: DataFrame, column: str, media: DataFrame) -> DataFrame:
    """df + raw_media, canonical_media, envo_id, media_category, media_flag.

    First an exact term that is resolved; else the longest term found in the text between word borders, resolved on its
    way up (parent_walk); else media_unmatched. Distinct texts are searched, not rows.
    """
    spark, table = df.sparkSession, prepared(media)
    up = climbed(table)
    exact = table.filter("canonical_media is not null and media_category is not null").select(F.col("term").alias("_key"), F.struct("canonical_media", "envo_id", "media_category", F.lit("").alias("media_flag")).alias("_exact"))
    # A term's first run of letters and digits is a word of every text that holds the term: an equi-join finds the few to search.
    first = lambda t: (re.findall(r"[a-z0-9]+", t) or [""])[0]
    walk = spark.createDataFrame([(t, *v, rf"(^|[^\p{{Alnum}}]){quoted(t)}($|[^\p{{Alnum}}])", first(t)) for t, v in up.items()], "_term string, canonical_media string, envo_id string, media_category string, _pattern string, _word string")
    keys = df.select(media_key(F.col(column)).alias("_key")).filter("_key <> ''").distinct().join(F.broadcast(exact), "_key", "left")
    words = F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("_key", F.lit("([a-z0-9]+)"), 1)))).alias("_word")
    missing = keys.filter("_exact is null").select("_key", words).join(F.broadcast(walk), "_word").filter(F.expr("_key rlike _pattern"))
    best = missing.groupBy("_key").agg(F.max_by(F.struct("canonical_media", "envo_id", "media_category", F.lit("parent_walk").alias("media_flag")), F.struct(F.length("_term"), "_term")).alias("_walk"))
    found = keys.join(best, "_key", "left").select("_key", F.coalesce("_exact", "_walk").alias("_m"))
    got = df.withColumns({"raw_media": F.col(column), "_key": media_key(F.col(column))}).join(found, "_key", "left")
    return got.select(*df.columns, "raw_media", "_m.canonical_media", "_m.envo_id", "_m.media_category", F.coalesce("_m.media_flag", F.lit("media_unmatched")).alias("media_flag"))


def validate_ontology(nodes: DataFrame) -> list[str]:
    """Faults of a tree node_id, parent_id, routing_category: repeated ids, missing parents, unknown routes, cycles."""
    rows = nodes.limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError("the media ontology is too large")
    ids = Counter(r["node_id"] for r in rows)
    parent = {r["node_id"]: r["parent_id"] for r in rows}
    out = [f"repeated id {i}" for i in sorted(i for i, n in ids.items() if n > 1)]
    out += [f"missing parent {p} of {i}" for i, p in parent.items() if p and p not in parent]
    out += [f"unknown route {r['routing_category']} of {r['node_id']}" for r in rows if r["routing_category"] and r["routing_category"] not in CATEGORIES]
    for i in parent:
        at, seen = i, set()
        while at and at in parent and at not in seen:
            seen.add(at)
            at = parent[at]
        if at in seen:
            out.append(f"cycle at {i}")
    return out


def ontology_index(nodes: DataFrame) -> DataFrame:
    """node_id, path of labels, depth, physical state (the label below the root), route and has_children, by recursion.

    The route is the one that a node's path names; a path that names two is an error.
    """
    view = "media_nodes_for_index"
    nodes.select("node_id", "parent_id", "label", "routing_category").createOrReplaceTempView(view)
    got = nodes.sparkSession.sql(f"""
        with recursive up(node_id, label, path, depth, state, route, clash) as (
          select node_id, label, coalesce(nullif(label, ''), node_id), 0, cast(null as string), nullif(routing_category, ''), false from {view} where parent_id is null or parent_id = ''
          union all
          select n.node_id, n.label, concat(u.path, ' > ', coalesce(nullif(n.label, ''), n.node_id)), u.depth + 1, coalesce(u.state, n.label), coalesce(u.route, nullif(n.routing_category, '')),
            u.clash or coalesce(u.route <> nullif(n.routing_category, ''), false)
          from {view} n join up u on n.parent_id = u.node_id)
        select up.*, exists (select 1 from {view} c where c.parent_id = up.node_id) as has_children from up""")
    checked = F.when(F.col("clash"), F.raise_error(F.concat(F.lit("routes conflict on the path of "), F.col("node_id")))).otherwise(F.col("has_children"))
    return got.withColumn("has_children", checked.cast("boolean")).drop("clash")


def canonical_faults(canonical: DataFrame, index: DataFrame) -> DataFrame:
    """canonical_media and fault of rows that do not agree with the ontology.

    canonical: canonical_media, ontology_node_id, routing_category, active. index: ontology_index() and the nodes' rank.
    """
    node = index.select(F.col("node_id").alias("ontology_node_id"), F.col("route").alias("_route"), F.col("has_children").alias("_has"), (F.col("rank") if "rank" in index.columns else F.lit(None).cast("string")).alias("_rank"), F.lit(True).alias("_known"))
    got = canonical.withColumn("ontology_node_id", F.nullif("ontology_node_id", F.lit(""))).join(node, "ontology_node_id", "left")
    active, route = F.coalesce("active", F.lit(False)), F.col("routing_category")
    fault = (
        F.when(active & F.col("ontology_node_id").isNull(), "an active row without a node")
        .when(F.col("ontology_node_id").isNotNull() & F.col("_known").isNull(), "unknown node")
        .when(~F.coalesce(route.isin(*CATEGORIES), F.lit(True)), "unknown route")
        .when(~route.eqNullSafe(F.col("_route")) & (active | route.isNotNull()), "the route is not the node's")
        .when(active & F.coalesce("_has", F.lit(False)) & ~F.coalesce(F.col("_rank").isin("abstract", "routing"), F.lit(False)), "the node is no leaf")
    )
    return got.select("canonical_media", fault.alias("fault")).filter("fault is not null")


def canonical_with_paths(canonical: DataFrame, index: DataFrame) -> DataFrame:
    """canonical + the derived route, path and physical state; refused where a row has a fault."""
    if bad := canonical_faults(canonical, index).limit(5).collect():
        raise ValueError("; ".join(f"{r['canonical_media']}: {r['fault']}" for r in bad))
    node = index.select(F.col("node_id").alias("ontology_node_id"), F.col("route").alias("derived_routing_category"), F.col("path").alias("ontology_path"), F.col("state").alias("physical_state"))
    return canonical.join(node, "ontology_node_id", "left")


DISPLAY = ("term", "canonical", "canonical_term", "envo_id", "parent", "media_category", "ontology_node_id", "ontology_path", "physical_state", "source", "fetch_timestamp", "assertion_mode", "confidence", "active")


def for_display(media: DataFrame) -> DataFrame:
    """The vocabulary with all columns that an editor shows, in one spelling and with their defaults."""
    have = set(media.columns)
    get = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in have] or [F.lit(None).cast("string")])
    source = F.coalesce(F.lower(get("source")), F.lit("app_default"))
    out = {c: get(c) for c in DISPLAY}
    out |= {"term": F.lower(get("term")), "canonical": get("canonical", "canonical_term", "canonical_media"), "canonical_term": get("canonical_term", "canonical", "canonical_media"), "ontology_node_id": F.lower(get("ontology_node_id")), "physical_state": F.lower(get("physical_state")), "source": source}
    out["assertion_mode"] = F.coalesce(F.lower(get("assertion_mode")), F.when(source == "user", "user").otherwise("auto"))
    out["active"] = F.coalesce(F.col("active").cast("boolean"), F.lit(False)) if "active" in have else F.lit(True)
    return media.select(*[v.alias(c) for c, v in out.items()])


def upserted(media: DataFrame, rows: DataFrame) -> DataFrame:
    """The vocabulary with users' rows (term, canonical_media and more) in place of theirs; categories are inferred again."""
    new = rows.withColumns({"term": media_key(F.col("term")), "source": F.lit("user")})
    return inferred(media.join(new.select("term"), "term", "left_anti").unionByName(new, allowMissingColumns=True))


def user_rows(media: DataFrame) -> DataFrame:
    """What is kept of a vocabulary between runs: the rows that users made."""
    return media.filter("source = 'user'")


def runtime_map(canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases and the canonical media themselves as terms; an alias wins over an equal name. Sorted by term."""
    own = canonical.filter("active").select(media_key(F.col("canonical_media")).alias("term"), "canonical_media", "envo_id", F.col("routing_category").alias("media_category"), F.lit("canonical").alias("source"), F.lit(1).alias("_o"))
    named = aliases.filter("active").select(media_key(F.col("term")).alias("term"), "canonical_media", "source").join(canonical.select("canonical_media", "envo_id", "routing_category"), "canonical_media", "left")
    named = named.select("term", "canonical_media", "envo_id", F.col("routing_category").alias("media_category"), "source", F.lit(0).alias("_o"))
    both = named.unionByName(own)
    first = both.groupBy("term").agg(F.min_by(F.struct("canonical_media", "envo_id", "media_category", "source"), F.struct("_o", "canonical_media")).alias("r")).select("term", "r.*")
    return first.withColumns({"parent": F.lit(None).cast("string"), "assertion_mode": F.lit("auto"), "active": F.lit(True), "ord": F.lit(0)}).orderBy("term")


def editor_rows(media: DataFrame, results: DataFrame) -> DataFrame:
    """For each term of the vocabulary how often it was hit, and texts that matched nothing with their counts."""
    hits = results.groupBy(media_key(F.col("raw_media")).alias("term")).agg(F.count("*").alias("n"), F.count_if(F.col("media_flag") == "media_unmatched").alias("n_unmatched"))
    known = media.select("term", "canonical_media", "media_category", "source").join(hits, "term", "left").withColumn("known", F.lit(True))
    other = hits.filter("n_unmatched > 0").join(media.select("term"), "term", "left_anti").withColumns({c: F.lit(None).cast("string") for c in ("canonical_media", "media_category", "source")}).withColumn("known", F.lit(False))
    return known.unionByName(other).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_unmatched")}).orderBy(F.col("known"), F.col("n_unmatched").desc(), F.col("n").desc(), "term")


def from_files(spark: SparkSession, folder: str) -> DataFrame:
    """The runtime map from media_canonical.csv and media_aliases.csv in a folder."""
    read = lambda name: spark.read.csv(f"{folder}/{name}.csv", header=True).withColumn("active", F.lower("active").isin("true", "t", "1", "yes"))
    return runtime_map(read("media_canonical"), read("media_aliases"))
