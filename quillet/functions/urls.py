"""URL functions as Column expressions; an unparseable URL gives null parts, never an error."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import fixed, text

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return F.lower(_part(url, 2))


def host(url: Column) -> Column:
    """Lower-case host without user, port or outer dots; empty where there is none."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@|:[0-9]*$", ""), r"^\.+|\.+$", "")


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) != "")


def host_label(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def ends_with(c: Column, suffixes) -> Column:
    return c.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def starts_with(c: Column, prefixes) -> Column:
    return c.rlike("^(" + "|".join(s.replace(".", r"\.") for s in prefixes) + ")")


def extension(p: Column) -> Column:
    """The last path segment's extension with its dot, lower case, or empty."""
    return F.lower(F.regexp_extract(p, r"[^/.][^/]*?(\.[^./]+)/*$", 1))


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def is_multi_tenant(h: Column) -> Column:
    return h.isin(*fixed.MULTI_TENANT_HOSTS) | ends_with(h, fixed.MULTI_TENANT_HOST_SUFFIXES)


def clean_url(raw: Column) -> Column:
    """The URL a list entry points at, or null where it cannot be a site of writing."""
    u = F.replace(F.regexp_replace(text.decode_basic_entities(F.trim(raw)), r"[.,;:!?'\">)\]}]+$", ""), F.lit("\\:"), F.lit(":"))
    h, ext = host(u), extension(path(u))
    bad = (
        ~u.rlike("^https?://") | ~h.contains(".") | h.isin(*fixed.EXCLUDED_HOSTS) | host_label(u).isin(*fixed.EXCLUDED_HOSTS)
        | ends_with(h, fixed.EXCLUDED_HOST_SUFFIXES) | starts_with(h, fixed.EXCLUDED_HOST_PREFIXES) | h.rlike("^[0-9.]+$")
        | ends_with(h, fixed.RESERVED_TLD_SUFFIXES) | ext.isin(*fixed.NON_PAGE_EXTENSIONS)
    )
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query(u), "&"), lambda p: (p != "") & ~key(p).isin(*fixed.TRACKING_QUERY_KEYS) & ~key(p).startswith("utm_"))
    pairs = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    q = F.array_join(pairs, "&")
    sch = F.when((scheme(u) == "http") & h.endswith(".github.io"), "https").otherwise(scheme(u))
    return F.when(~bad, F.concat(sch, F.lit("://"), netloc(u), path(u), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def canonical_site(site: Column) -> Column:
    h = host(site)
    first = F.get(segments(path(site)), F.lit(0))
    low = F.lower(first)
    keep = low.rlike("^[@~]") | low.isin(*fixed.BLOG_PATH_SEGMENTS) | (
        is_multi_tenant(h) & ~low.isin(*fixed.PATH_NOISE_SEGMENTS) & ~low.contains(".") & ~low.rlike("^[0-9]+$")
    )
    tail = F.when(first.isNotNull() & keep, F.concat(F.lit("/"), first, F.lit("/"))).otherwise("/")
    return F.when(h != "", F.concat(scheme(site), F.lit("://"), netloc(site), tail))


def site_key(site: Column) -> Column:
    return F.concat(host_label(site), F.regexp_replace(path(site), "/+$", ""))


def domain_name(site: Column) -> Column:
    labels = F.split(host_label(site), r"\.")
    name = F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(F.element_at(labels, 1))
    return F.initcap(F.replace(name, F.lit("-"), F.lit(" ")))


def registrable_domain(h: Column) -> Column:
    bare = F.regexp_replace(F.lower(h), r"^www\.", "")
    labels = F.split(bare, r"\.")
    keep = F.when(ends_with(bare, fixed.MULTI_TENANT_HOST_SUFFIXES), 3).otherwise(2)
    return F.when(F.size(labels) >= keep, F.array_join(F.slice(labels, -keep, keep), ".")).otherwise(bare)


def feed_guesses(site: Column) -> Column:
    root = F.concat(scheme(site), F.lit("://"), netloc(site), F.lit("/"))
    base = F.when(site.endswith("/"), site).otherwise(F.concat(site, F.lit("/")))
    paths = F.array(*[F.lit(p) for p in fixed.COMMON_FEED_PATHS])
    return F.array_distinct(F.concat(F.transform(paths, lambda p: F.concat(base, p)), F.transform(paths, lambda p: F.concat(root, p))))


def source_id_base(site: Column) -> Column:
    h = host_label(site)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    parts = F.when(ends_with(h, fixed.MULTI_TENANT_HOST_SUFFIXES) & (n > 2), F.slice(labels, 1, 1)).when(n > 1, F.slice(labels, F.lit(1), n - 1)).otherwise(labels)
    first = F.get(segments(path(site)), F.lit(0))
    every = F.when(first.isNotNull(), F.concat(parts, F.array(F.regexp_replace(first, "^[@~]+", "")))).otherwise(parts)
    base = text.kebab(F.array_join(every, "-"))
    return F.when(base == "", "source").otherwise(base)


def visit_canonical(url: Column) -> Column:
    """One form for each page, however it was linked; what is no URL is hashed as it came, lower case."""
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(name(p)).rlike(fixed.VISIT_TRACKING))
    pairs = F.array_sort(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))
    q = F.array_join(pairs, "&")
    # as a URL parser has it: no user, and no port that is the scheme's own
    place = F.regexp_replace(netloc(url), "^.*@", "")
    place = F.when(scheme(url) == "https", F.regexp_replace(place, ":(443)?$", "")).when(scheme(url) == "http", F.regexp_replace(place, ":(80)?$", "")).otherwise(place)
    page = F.concat(F.regexp_replace(place, r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(host(url) != "", page).otherwise(F.lower(F.trim(url)))


def cyrb53(c: Column) -> Column:
    """A 53-bit hash over UTF-16 units, in 32-bit steps."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = 0xFFFFFFFF

        def one(value):
            if value is None:
                return None
            a, b = 0xDEADBEEF, 0x41C6CE57
            units = value.encode("utf-16-le", "surrogatepass")
            for i in range(0, len(units), 2):
                u = units[i] | units[i + 1] << 8
                a, b = (a ^ u) * 2654435761 & m, (b ^ u) * 1597334677 & m
            a = (a ^ a >> 16) * 2246822507 & m
            a ^= (b ^ b >> 13) * 3266489909 & m
            b = (b ^ b >> 16) * 2246822507 & m
            b ^= (a ^ a >> 13) * 3266489909 & m
            return 4294967296 * (2097151 & b) + a

        for s in batches:
            yield s.map(one).astype("Int64")

    return run(c)


def visit_key(url: Column) -> Column:
    return cyrb53(visit_canonical(url))


def resolve(base: Column, reference: Column) -> Column:
    """RFC 3986 reference resolution."""

    @F.pandas_udf("string")
    def run(bases: pd.Series, refs: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        def one(b, r):
            try:
                return urljoin(b, r) if b is not None and r is not None else None
            except ValueError:
                return None

        return pd.Series([one(b, r) for b, r in zip(bases, refs)])

    return run(base, reference)


#: Suffixes of more than one label under which names are registered; a parameter, as the public list is long and changes.
LONG_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "com.au", "co.nz", "co.jp", "com.br", "co.in", "github.io", "gitlab.io", "blogspot.com", "netlify.app",
    "vercel.app", "pages.dev",
)


def public_suffix_plus_one(h: Column, long_suffixes=LONG_SUFFIXES) -> Column:
    """The name registered under a public suffix: one label before it."""
    labels = F.split(h, r"\.")
    keep = F.when(ends_with(h, ["." + s for s in long_suffixes]), 3).otherwise(2)
    return F.when(F.size(labels) >= keep, F.array_join(F.slice(labels, -keep, keep), ".")).otherwise(h)


_rules: dict[str, tuple[frozenset, frozenset, frozenset]] = {}


def suffix_rules(spark) -> tuple[frozenset, frozenset, frozenset]:
    """The public suffix list that ships with Spark: suffixes, suffixes of which any name below is one, and exceptions."""
    app = spark.sparkContext.applicationId
    if app not in _rules:
        lists = spark._jvm.com.google.thirdparty.publicsuffix.PublicSuffixPatterns
        # one string a list crosses the gateway
        _rules[app] = tuple(frozenset(getattr(lists, name).keySet().toString().strip("[]").split(", ")) - {""} for name in ("EXACT", "UNDER", "EXCLUDED"))
    return _rules[app]


def with_registered_name(rows: DataFrame, host_col: Column, out: str, rules: tuple[frozenset, frozenset, frozenset] | None = None) -> DataFrame:
    """The rows with the registered name of a host: its public suffix and one label before it, by rules as suffix_rules() gives
    them; a host that is itself a suffix, or none, stays as it is.

    The suffixes of every different host are joined to the table of rules by their hashes; of those that a rule names
    the longest counts, an exception before the rule it is one of. Which side of a join is broadcast is left to Spark.
    """
    spark = rows.sparkSession
    exact, under, excluded = rules or suffix_rules(spark)
    listed = [(x, 0, "name") for x in excluded] + [(x, 1, "name") for x in exact] + [(x, 1, "parent") for x in under]
    table = spark.createDataFrame(listed, "__suffix string, __kind int, __how string")
    keyed = rows.withColumn("__host", host_col)
    hosts = keyed.select("__host").where("__host <> ''").distinct()
    labels = F.split("__host", r"\.")
    tails = hosts.select("__host", labels.alias("l"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("i", "name"))
    parent = F.when(F.col("name").contains("."), F.regexp_replace("name", r"^[^.]*\.", "")).otherwise("")
    asked = tails.select("__host", "l", "i", F.inline(F.array(*[F.struct(c.alias("__suffix"), F.lit(how).alias("__how")) for c, how in ((F.col("name"), "name"), (parent, "parent"))])))
    hit = asked.join(table, ["__suffix", "__how"], "left").groupBy("__host").agg(
        F.first("l").alias("l"), F.min(F.when(F.col("__kind").isNotNull(), F.struct("i", "__kind"))).alias("best")
    )
    n, i = F.size("l"), F.col("best.i")
    cut = F.when(F.col("best").isNull(), F.greatest(n - 2, F.lit(0))).when(F.col("best.__kind") == 0, i).otherwise(F.greatest(i - 1, F.lit(0)))
    named = hit.select(F.col("__host").alias("__of"), F.array_join(F.slice("l", cut + 1, n), ".").alias(out))
    return keyed.join(named, F.col("__host") == F.col("__of"), "left").withColumn(out, F.coalesce(out, "__host")).drop("__host", "__of")


def is_article_url(url: Column, site: Column) -> Column:
    p = path(url)
    low = F.transform(segments(p), lambda s: F.lower(s))
    return (
        is_http(url) & (host(url) == host(site)) & (F.size(low) > 0) & ~extension(p).isin(*fixed.NON_ARTICLE_EXTENSIONS)
        & ~F.arrays_overlap(low, F.array(*[F.lit(s) for s in fixed.NON_ARTICLE_SEGMENTS]))
    )


def date_in_path(p: Column, last_year: int) -> Column:
    """A date written in the path; a day over the month's end runs into the next month."""
    pattern = r"(?:^|/)([0-9]{4})[/-]([0-9]{1,2})(?:[/-]([0-9]{1,2}))?(?:[/-]|$)"
    y, m, d = (F.regexp_extract(p, pattern, g).try_cast("int") for g in (1, 2, 3))
    d = F.when(F.regexp_extract(p, pattern, 3) == "", 1).otherwise(d)
    fits = y.between(1990, last_year) & m.between(1, 12) & d.between(1, 31)
    return F.when(fits, F.date_add(F.make_date(F.when(fits, y), F.when(fits, m), F.lit(1)), d - 1))


def is_public_ipv4(ip: Column) -> Column:
    octets = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127))
    )
    return ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & ~private
