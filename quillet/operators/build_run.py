"""The source build from end to end, and the small tables around it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.functions import fixed, text, urls
from quillet.operators import builder, crawl
from quillet.sources import storage


@dataclass
class Build:
    entries: DataFrame
    problems: DataFrame
    audit: DataFrame
    unmatched: DataFrame


def expand_seeds(seeds: DataFrame, topic_repositories: DataFrame, most: int) -> DataFrame:
    """repository -> all seeds that lead to it: its own, and topics among whose first `most` repositories it is.

    topic_repositories: topic, repository, stars.
    """
    own = seeds.where("kind = 'repository'").select(F.col("name").alias("repository"), "seed")
    top = topic_repositories.withColumn("r", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("stars"), "repository"))).where(F.col("r") <= most)
    by_topic = seeds.where("kind = 'topic'").join(top, seeds["name"] == top["topic"]).select("repository", "seed")
    return own.unionByName(by_topic).groupBy("repository").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))


def clean_distinct(listed: Column, skip: Column) -> Column:
    """Cleaned URLs in order, without repeats and without those to skip."""
    return F.array_except(F.array_distinct(F.filter(F.transform(listed, urls.clean_url), lambda u: u.isNotNull())), skip)


def overrides_of(spark: SparkSession, yaml_text: str) -> DataFrame:
    """Overrides as rows; an unknown field, a missing site or a repeated site key is an error."""
    import yaml

    entries = yaml.safe_load(yaml_text) or []
    known = {"site", "id", "kind", *builder.OVERRIDABLE}
    for i, e in enumerate(entries):
        if not e.get("site"):
            raise ValueError(f"override {i}: site is required")
        if set(e) - known:
            raise ValueError(f"override {i}: unknown {sorted(set(e) - known)}")
    rows = spark.createDataFrame([(e["site"], e.get("name"), e.get("feed"), e.get("tags")) for e in entries], "site string, name string, feed string, tags array<string>")
    repeated = rows.groupBy(urls.site_key(F.col("site")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"override {repeated[0]['key']} is repeated")
    return rows


def sources_yaml(entries: DataFrame) -> str:
    """The list as YAML in order of name; a source list is small enough for the driver by its nature."""
    import yaml

    order = ("id", "name", "site", "feed", "kind", "tags")
    rows = entries.orderBy(F.lower("name"), "site").select(*order).collect()
    return yaml.safe_dump([{k: r[k] for k in order if r[k] not in (None, "", [])} for r in rows], sort_keys=False, allow_unicode=True)


def bookmarks_json(rows: DataFrame, now: str) -> DataFrame:
    """owner, file name and export envelope; rows: owner, url, title, saved_at. An owner has a bounded number of rows."""
    at = F.date_format("saved_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    items = F.transform(F.sort_array(F.collect_list(F.struct(F.col("saved_at").alias("s"), F.struct("url", "title", at.alias("savedAt")).alias("x"))), asc=False), lambda v: v["x"])
    body = rows.groupBy("owner").agg(items.alias("bookmarks"), F.count(F.lit(1)).alias("count"))
    stamp = F.lit(now).cast("timestamp")
    return body.select(
        "owner", F.concat(F.lit("bookmarks-"), F.date_format(stamp, "yyyy-MM-dd"), F.lit(".json")).alias("name"),
        F.to_json(F.struct(F.lit("quillet-bookmarks").alias("format"), F.lit(1).alias("version"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("exportedAt"), "count", "bookmarks")).alias("body"),
    )


def add_bookmarks(saved: DataFrame, new: DataFrame, cap: int = fixed.BOOKMARK_CAP) -> DataFrame:
    """New rows (owner, url, saved_at) that are not saved yet, as long as the owner is under the cap."""
    n = saved.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    fresh = new.join(saved.select("owner", "url"), ["owner", "url"], "left_anti").join(n, "owner", "left")
    turn = F.row_number().over(W.partitionBy("owner").orderBy("saved_at", "url"))
    return saved.unionByName(fresh.withColumn("k", turn).where(F.col("k") + F.coalesce("n", F.lit(0)) <= cap).select(saved.columns))


def saved_search(rows: DataFrame, words: str) -> DataFrame:
    """Rows whose title or host contains the words, whatever their case."""
    return rows.where(F.lower(F.concat_ws(" ", "title", urls.host_label(F.col("url")))).contains(words.strip().lower()))


def feed_coverage(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("feed").isNotNull()).alias("with_feed"))


def scored_feeds(found: DataFrame, facts: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """site, feed_url, feed_title, feed_tags, inconclusive: of each site's working feed (site, url, inconclusive) its title,
    and the tags that its text and categories earn (facts as feed_facts() gives them). Feeds are as many as sites, so that
    no side of their joins goes through the driver."""
    earned = builder.tag_scores(facts.where("ok"), vocabulary, "text", "url", "categories")
    rank = F.struct((-F.col("score")).alias("s"), F.array_position(F.array(*map(F.lit, vocabulary)), F.col("tag")).alias("at"), "tag")
    tags = earned.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["tag"]).alias("feed_tags"))  # six at most
    named = facts.where("ok").select("url", F.col("title").alias("feed_title")).join(tags.hint("merge"), "url", "left")
    return found.join(named.hint("merge"), "url", "left").select("site", F.col("url").alias("feed_url"), "feed_title", F.coalesce("feed_tags", F.array().cast("array<string>")).alias("feed_tags"), "inconclusive")


def build(
    lines: DataFrame, probes: DataFrame, known_feeds: DataFrame, feeds: DataFrame, previous: DataFrame, overrides: DataFrame, retries: DataFrame | None = None, files: DataFrame | None = None,
) -> Build:
    """Harvest, check, second try of sites that never answered, merge redirects, ids, drop platform roots, overrides, validate, audit.

    previous: site, id of the last build, whose ids stay with their sites. files: whole list files beside the lines.
    """
    found = builder.harvest(lines).withColumn("feed", F.lit(None).cast("string"))
    if files is not None:
        found = found.unionByName(builder.harvest_files(files))
    candidates = storage.staged(builder.merge_candidates(builder.candidate_rows(found)), "candidates")
    if retries is not None:
        probes = crawl.second_try(probes, retries)
    # a site of many lists is probed once for each of them: equal answers count once, and its origins, as long as the number of
    # lists, stay out of the joins with its answers
    probes = probes.distinct()
    given = candidates.select("site", "name", F.array().cast("array<string>").alias("tags"), F.col("tags").alias("fallback_tags"), "ord", F.array().cast("array<string>").alias("origins"))
    checked = crawl.check_candidates(given, probes, known_feeds, feeds)
    merged = storage.staged(builder.merge_candidates(checked.where("error IS NULL")).select("site", "name", "feed", "tags"), "checked")
    pinned = merged.join(previous.select("site", F.col("id").alias("old")), "site", "left").withColumn("base", urls.source_id_base(F.col("site")))
    fresh = builder.unique_ids(pinned.where("old IS NULL"), "base", ["name", "site"], "id", previous.select("id"))
    kept = pinned.where("old IS NOT NULL").withColumn("id", F.col("old"))
    named = storage.staged(fresh.unionByName(kept).select("id", "name", "site", "feed", "tags"), "named")
    entries = builder.apply_overrides(builder.drop_platform_roots(named).select("site", "name", "feed", "tags"), overrides)
    ids = named.select(F.col("site").alias("__s"), "id")
    joined = entries.join(ids, entries["site"] == ids["__s"], "left").select("id", "name", "site", "feed", "tags", urls.source_id_base(F.col("site")).alias("base"))
    # entries that only an override knows get ids beside all that are in use
    added = builder.unique_ids(joined.where("id IS NULL").drop("id"), "base", ["name", "site"], "id", previous.select("id").unionByName(named.select("id")))
    full = joined.where("id IS NOT NULL").drop("base").unionByName(added.drop("base"))
    provenance = F.array(*map(F.lit, fixed.PROVENANCE_TAGS))
    split = storage.staged(full, "entries").withColumn("kind", F.array_intersect(provenance, "tags")).withColumn("tags", F.array_except("tags", provenance))
    states = candidates.join(probes.select("site", "status_code", "error").distinct(), "site", "left")
    return Build(split, builder.violations(split), builder.audit(states, probes), builder.unmatched_overrides(named, overrides))
