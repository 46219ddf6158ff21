"""Parsers of feeds, sitemaps, robots files and outlines, and the file sources of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.functions import fixed, text, urls

_ITEM = "struct<title:string,link:string,creator:string,author:string,description:string,encoded:string,category:array<string>,pubDate:string,date:string>"
_ENTRY = (
    "struct<title:string,link:array<struct<_href:string,_rel:string>>,author:struct<name:string>,summary:string,content:string,"
    "category:array<struct<_term:string,_label:string>>,published:string,updated:string>"
)
_XML = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_value", "mode": "PERMISSIVE"}


def _tame(xml: Column) -> Column:
    """Bare ampersands, which make XML unreadable, are escaped."""
    return F.regexp_replace(xml, r"&(?!#?\w+;)", "&amp;")


def feed_items(rows: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """One row an item, RSS items then Atom entries, in document order."""
    rss = F.from_xml(_tame(F.col(xml_col)), f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>", _XML)
    atom = F.from_xml(_tame(F.col(xml_col)), f"entry array<{_ENTRY}>", _XML)
    read = rows.select(id_col, rss.alias("rss"), atom.alias("atom"))
    items = read.select(id_col, F.posexplode(F.coalesce("rss.channel.item", "rss.item")).alias("pos", "i")).select(
        id_col, "pos",
        text.clean_short(F.col("i.title")).alias("title"), F.trim("i.link").alias("link"),
        text.clean_short(text.first_non_blank(F.col("i.creator"), F.col("i.author"))).alias("author"),
        text.clean_short(F.col("i.description")).alias("summary"),
        F.coalesce(F.nullif(F.trim("i.encoded"), F.lit("")), F.col("i.description")).alias("content"),
        F.coalesce("i.category", F.array().cast("array<string>")).alias("categories"),
        text.first_non_blank(F.col("i.pubDate"), F.col("i.date")).alias("published"),
    )
    alternate = F.filter("i.link", lambda x: F.coalesce(x["_rel"], F.lit("")).isin("alternate", ""))
    link = F.trim(F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get("i.link", F.lit(0))["_href"]))
    entries = read.select(id_col, F.posexplode("atom.entry").alias("pos", "i")).select(
        id_col, (F.col("pos") + 1_000_000).alias("pos"),
        text.clean_short(F.col("i.title")).alias("title"), link.alias("link"),
        text.clean_short(F.col("i.author.name")).alias("author"),
        text.clean_short(F.col("i.summary")).alias("summary"),
        F.coalesce(F.nullif(F.trim("i.content"), F.lit("")), F.col("i.summary")).alias("content"),
        F.transform(F.coalesce("i.category", F.array().cast("array<struct<_term:string,_label:string>>")), lambda c: F.coalesce(F.nullif(F.trim(c["_label"]), F.lit("")), c["_term"])).alias("categories"),
        text.first_non_blank(F.col("i.published"), F.col("i.updated")).alias("published"),
    )
    return items.unionByName(entries)


def feed_title(xml: Column) -> Column:
    """The title of a feed as a whole."""
    read = F.from_xml(_tame(xml), "channel struct<title:string>, title string", _XML)
    return F.nullif(text.clean_short(F.coalesce(read["channel"]["title"], read["title"])), F.lit(""))


def sitemap_links(rows: DataFrame, id_col: str, xml_col: str, most: int | None = 20_000) -> DataFrame:
    """One row a location: kind (url or sitemap), loc, lastmod; nothing from what is no sitemap. Of a map `most` of each kind, or all."""
    kind = "array<struct<loc:string,lastmod:string>>"
    looks = F.left(F.col(xml_col), F.lit(2000)).rlike(r"(?i)<(urlset|sitemapindex)[\s>]")
    read = rows.where(looks).select(id_col, F.from_xml(_tame(F.col(xml_col)), f"url {kind}, sitemap {kind}", _XML).alias("x"))
    one = lambda c: read.select(id_col, F.lit(c).alias("kind"), F.posexplode(F.slice(F.col(f"x.{c}"), 1, most) if most else F.col(f"x.{c}")).alias("pos", "l"))
    return one("url").unionByName(one("sitemap")).select(id_col, "kind", "pos", F.trim("l.loc").alias("loc"), F.trim("l.lastmod").alias("lastmod"))


def newest_links(links: DataFrame, per: str, keep: int) -> DataFrame:
    """The newest links of each sitemap, undated ones last, document order where dates tie."""
    order = W.partitionBy(per).orderBy(F.col("at").desc_nulls_last(), "pos")
    dated = links.withColumn("at", link_time(F.col("lastmod")))
    return dated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def link_time(lastmod: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(lastmod, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(lastmod, F.lit("yyyy-MM-dd")))


def chosen_children(children: DataFrame, per: str, most: int = fixed.SITEMAP_MAPS, entries: int = fixed.SITEMAP_ENTRIES) -> DataFrame:
    """Of fetched child maps the newest, stopping once enough entries were read. Columns: at, pos, n."""
    order = W.partitionBy(per).orderBy(F.col("at").desc_nulls_last(), "pos")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return children.where("n IS NOT NULL").select("*", F.row_number().over(order).alias("rank"), before.alias("before")).where((F.col("rank") <= most) & (F.col("before") < entries))


def chosen_maps(read: DataFrame, used: DataFrame, most: int, entries: int) -> DataFrame:
    """Of maps that answered (source_id, place, n) those within the budgets that `used` (source_id, maps, pages) leaves."""
    order = W.partitionBy("source_id").orderBy("place")
    sums = read.join(used, "source_id", "left").select(
        "*", (F.coalesce("maps", F.lit(0)) + F.row_number().over(order)).alias("rank"),
        (F.coalesce("pages", F.lit(0)) + F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("before"),
    )
    return sums.where((F.col("rank") <= most) & (F.col("before") < entries)).select(*read.columns)


def robots_lines(rows: DataFrame, host_col: str, body_col: str) -> DataFrame:
    """Directives with the number of their group; consecutive user-agent lines open one group."""
    lines = rows.select(host_col, F.posexplode(F.split(F.regexp_replace(body_col, "\r", "\n"), "\n")).alias("pos", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    d = lines.select(host_col, "pos", F.lower(F.trim(F.substring_index(bare, ":", 1))).alias("directive"), F.trim(F.regexp_extract(bare, r"^[^:]*:(.*)$", 1)).alias("value")).where(bare.contains(":"))
    own = d.where(F.col("directive").isin("user-agent", "allow", "disallow"))
    w = W.partitionBy(host_col).orderBy("pos")
    opens = (F.col("directive") == "user-agent") & (F.coalesce(F.lag("directive").over(w), F.lit("")) != "user-agent")
    grouped = own.withColumn("opens", opens.cast("int")).withColumn("grp", F.sum("opens").over(w)).drop("opens")
    return grouped.unionByName(d.where("directive = 'sitemap'").withColumn("grp", F.lit(0).cast("long")))


def robots_rules(lines: DataFrame, host_col: str, agent: str) -> DataFrame:
    """host, pattern, allow: rules of the groups that name the agent, else of the wildcard's."""
    agents = lines.where("directive = 'user-agent'").select(host_col, "grp", F.lower("value").alias("agent"))
    named = agents.where(F.col("agent") == agent).select(host_col).distinct().withColumn("named", F.lit(True))
    mine = agents.join(named, host_col, "left").where((F.col("agent") == agent) | (F.col("named").isNull() & (F.col("agent") == "*"))).select(host_col, "grp").distinct()
    rules = lines.where("directive <> 'user-agent' AND directive <> 'sitemap' AND grp > 0 AND value <> ''")
    return rules.join(mine, [host_col, "grp"]).select(host_col, F.col("value").alias("pattern"), (F.col("directive") == "allow").alias("allow"))


def robots_pattern(pattern: Column) -> Column:
    """A pattern as its texts between stars, and whether a final `$` asks for the path's end."""
    return F.struct(F.split(F.regexp_replace(pattern, r"\$$", ""), r"\*").alias("texts"), pattern.endswith("$").alias("ends"))


def robots_hit(rule: Column, path: Column) -> Column:
    """Whether a path matches a prepared pattern: its first text begins the path, the others follow at their first places."""
    texts, n = rule["texts"], F.size(rule["texts"])
    first, last = F.get(texts, F.lit(0)), F.element_at(texts, -1)
    middle = F.slice(texts, 2, F.when(rule["ends"], F.greatest(n - 2, F.lit(0))).otherwise(n - 1))

    def follow(at: Column, text_: Column) -> Column:
        found = F.call_function("locate", text_, path, at)
        return F.when((at == 0) | (found == 0), 0).otherwise(found + F.length(text_))

    after = F.aggregate(middle, F.length(first) + 1, follow)
    end = F.when(n == 1, path == first).otherwise((after > 0) & path.endswith(last) & (F.length(path) - F.length(last) + 1 >= after))
    return path.startswith(first) & F.when(rule["ends"], end).otherwise(after > 0)


def robots_match(pattern: Column, path: Column) -> Column:
    """`*` matches anything, a final `$` the end, else the pattern is a prefix."""
    return robots_hit(robots_pattern(pattern), path)


def robots_allowed(rows: DataFrame, rules: DataFrame, key: list[str], host_col: str = "host", path_col: str = "path") -> DataFrame:
    """The longest matching pattern decides, allow wins a tie, no match allows.

    A host's rules are one array, prepared and sorted once, as large as its robots file; the first that hits ends the search.
    """
    one = F.struct((-F.length("pattern")).alias("minus"), (~F.col("allow")).alias("forbids"), robots_pattern(F.col("pattern")).alias("rule"))
    sets = rules.groupBy(F.col(host_col).alias("__host")).agg(F.sort_array(F.collect_set(one)).alias("__rules"))
    verdict = F.aggregate("__rules", F.lit(None).cast("boolean"), lambda a, r: F.coalesce(a, F.when(robots_hit(r["rule"], F.col(path_col)), ~r["forbids"])))
    return rows.join(sets, F.col(host_col) == F.col("__host"), "left").select(*key, F.coalesce(verdict, F.lit(True)).alias("allowed")).distinct()


def outlines(rows: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """Feed, site and name of every outline element, whatever its nesting."""
    quoted = r"\"[^\"]*\"|'[^']*'"
    tags = F.regexp_extract_all(F.col(xml_col), F.lit(rf"(?s)<outline\s((?:[^>\"']|{quoted})*)>"), F.lit(1))
    value = lambda n: F.regexp_replace(F.regexp_extract("t", rf"(?i)(?:^|\s){n}\s*=\s*({quoted})", 1), "^[\"']|[\"']$", "")
    attr = lambda *names: F.coalesce(*[F.nullif(text.decode_basic_entities(value(n)), F.lit("")) for n in names])
    return rows.select(id_col, F.posexplode(tags).alias("pos", "t")).select(
        id_col, "pos", attr("xmlurl", "feed", "rss").alias("feed"), attr("htmlurl", "url", "site").alias("site"), attr("title", "text", "name").alias("name")
    )


def is_list_file(path: Column, size: Column, most: int) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    stem, ext = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), urls.extension(path)
    return (
        (size <= most) & ~path.rlike(r"(^|/)\.git") & ~stem.isin(*fixed.SKIPPED_STEMS) & ~ext.isin(*fixed.NON_PAGE_EXTENSIONS)
        & (ext.isin(*fixed.LIST_FILE_EXTENSIONS) | ((ext == "") & stem.isin(*fixed.LIST_FILE_STEMS)))
    )


def seeds(lines: DataFrame, col: str = "value") -> DataFrame:
    """Seed, its class (repository, topic or page) and its parts; blank and comment lines go."""
    s = F.replace(F.trim(F.col(col)), F.lit("\\:"), F.lit(":"))
    rows = lines.select(s.alias("seed")).where((F.col("seed") != "") & ~F.col("seed").startswith("#"))
    host, seg = urls.host(F.col("seed")), urls.segments(urls.path(F.col("seed")))
    code = host.isin("github.com")
    topic = code & (F.size(seg) == 2) & (F.get(seg, F.lit(0)) == "topics")
    repo = code & (F.size(seg) >= 2) & (F.get(seg, F.lit(0)) != "topics")
    kind = F.when(topic, "topic").when(repo, "repository").when(urls.is_http(F.col("seed")) & ~code, "page").otherwise("skipped")
    return rows.select("seed", kind.alias("kind"), F.when(repo, F.concat_ws("/", F.slice(seg, 1, 2))).when(topic, F.get(seg, F.lit(1))).alias("name"))


# File sources and sinks.


def files(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """Files below a folder; without contents only names, times and sizes are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows if contents else rows.select("path", "modificationTime", "length")


def text_value(spark: SparkSession, path: str) -> str:
    """A small text file, trimmed; empty where there is none."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return rows[0]["value"].strip() if rows else ""


def page_path(url: Column) -> Column:
    """A path by which a page's format is told: one without an extension is HTML."""
    p = F.regexp_replace(url, "[?#].*$", "")
    return F.when(urls.extension(urls.path(p)) == "", F.concat(F.regexp_replace(p, "/+$", ""), F.lit(".html"))).otherwise(p)


def list_files(spark: SparkSession, folder: str, origin: str, most_bytes: int = 2_000_000, most_files: int = 400) -> DataFrame:
    """path, origin and content of the list files below a repository's folder, the first by path if there are many."""
    named = files(spark, folder, contents=False).where(is_list_file(F.col("path"), F.col("length"), most_bytes)).orderBy("path").limit(most_files)
    # the limit bounds the list of names; only their files are read
    wanted = F.broadcast(named.select("path"))
    return files(spark, folder).join(wanted, "path", "left_semi").select("path", F.lit(origin).alias("origin"), F.col("content").cast("string").alias("content"))


def previous_build(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of an earlier list: site and id, and site key and feed, which a new build keeps."""
    feeds = entries.where("feed IS NOT NULL").groupBy(urls.site_key(F.col("site")).alias("key")).agg(F.min("feed").alias("feed"))
    return entries.select("site", "id"), feeds


def entry_rows(entries: DataFrame) -> DataFrame:
    """Entries with the declared fields in their order, empty ones null, numbered by name and site."""
    bare = lambda c: F.when(F.size(c) > 0, F.col(c)) if entries.schema[c].dataType.typeName() == "array" else F.nullif(F.col(c), F.lit(""))
    fields = [bare(c).alias(c) for c in ("id", "name", "site", "feed", "kind", "tags")]
    from quillet.sources import storage  # which reads texts by this module

    return storage.numbered(entries.select(*fields), [], [F.lower("name"), F.col("site")], "place")


SOURCE_SCHEMA = "id string, name string, site string, feed string, kind array<string>, tags array<string>, pos int"


def allowlist(spark: SparkSession, yaml_text: str) -> DataFrame:
    """A source list as rows in list order; an empty id or site or a repeated id is an error that names its place."""
    import yaml

    entries = yaml.safe_load(yaml_text) or []
    seen: set[str] = set()
    for i, e in enumerate(entries):
        if not e.get("id") or not e.get("site"):
            raise ValueError(f"source {i}: id and site are required")
        if e["id"] in seen:
            raise ValueError(f"source {i}: id {e['id']} is repeated")
        seen.add(e["id"])
    rows = [(e["id"], e.get("name"), e["site"], e.get("feed"), e.get("kind") or [], e.get("tags") or [], i) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def write_json(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "true")
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)
