"""robots.txt rules, crawl permission, indexability.

A robots file is one row. Its rules stay in an array of that row, so deciding about a URL is an
equality join on the host followed by a scan of a short array: no theta join, no grouping, and a
host with very many URLs is only a long run of probes that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from silkgraph.functions.text import strip
from silkgraph.functions.urls import let, netloc, path

# Fixed value: the characters that end a line of a robots file.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
RULES = "array<struct<agent:string,kind:string,path:string>>"


def robots_files(robots: DataFrame) -> DataFrame:
    """Readable files (status 200), the newest per domain when there are several."""
    ok = robots.filter(F.col("status") == 200)
    if "fetched_at" not in robots.columns:
        return ok.select("domain", "content")
    return ok.groupBy("domain").agg(F.max_by("content", "fetched_at").alias("content"))


def _lines(content: Column) -> Column:
    return F.filter(
        F.transform(F.split(content, LINE_END), strip), lambda l: (l != "") & ~l.startswith("#")
    )


def _key(line: Column) -> Column:
    return F.lower(strip(F.substring_index(line, ":", 1)))


def _value(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"(?s)\A[^:]*:", ""))


def rules_array(content: Column) -> Column:
    """Rules of a file, in file order. A rule belongs to the user-agent line before it; rules before
    the first one, or under an empty one, count for nobody.

    The lines are cut into groups at the user-agent lines, so each group is read once.
    """
    pairs = F.transform(
        F.filter(_lines(content), lambda l: l.contains(":")),
        lambda l: F.struct(_key(l).alias("k"), _value(l).alias("v")),
    )
    known = F.filter(pairs, lambda p: p["k"].isin("user-agent", "allow", "disallow"))
    numbered = F.transform(
        known, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))
    )

    def group(rows: Column, starts: Column, start: Column, g: Column) -> Column:
        stop = F.coalesce(F.try_element_at(starts, g + 2)["i"], F.size(rows))
        length = F.when(start["v"] != "", stop - start["i"] - 1).otherwise(0)
        return F.transform(
            F.slice(rows, start["i"] + 2, length),
            lambda r: F.struct(
                start["v"].alias("agent"), r["k"].alias("kind"), r["v"].alias("path")
            ),
        )

    grouped = let(
        numbered,
        lambda rows: let(
            F.filter(rows, lambda p: p["k"] == "user-agent"),
            lambda starts: F.flatten(
                F.transform(starts, lambda start, g: group(rows, starts, start, g))
            ),
        ),
    )
    return F.coalesce(grouped, F.array().cast(RULES))


def robots_rules(robots: DataFrame) -> DataFrame:
    """(domain, position, agent, kind, path), one row per rule."""
    return (
        robots_files(robots)
        .select("domain", F.posexplode(rules_array(F.col("content"))).alias("position", "rule"))
        .select("domain", "position", "rule.*")
    )


def rules_for_agent(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(domain, rules): the rules that decide for ``agent``, with their positions in the file, in the
    order in which they are tried: those of the exact agent, then those of everyone. Files without such
    rules drop out."""
    placed = F.transform(
        "rules", lambda r, i: F.struct(i.alias("position"), r["agent"].alias("agent"), r["kind"].alias("kind"), r["path"].alias("path"))
    )
    rules = F.filter(placed, lambda r: ~((r["kind"] == "disallow") & (r["path"] == "")))
    everyone = F.filter(rules, lambda r: r["agent"] == "*")
    mine = F.filter(rules, lambda r: r["agent"] == agent)
    ordered = everyone if agent == "*" else F.concat(mine, everyone)
    tried = F.transform(
        ordered,
        lambda r: F.struct(
            (r["kind"] == "allow").alias("allow"),
            F.regexp_replace(r["path"], r"\*\z", "").alias("prefix"),
            r["position"].alias("position"),
        ),
    )
    return (
        robots_files(robots)
        .select("domain", rules_array(F.col("content")).alias("rules"))
        .select("domain", tried.alias("rules"))
        .filter(F.size("rules") > 0)
    )


def rule_matches(url_path: Column, prefix: Column) -> Column:
    """Prefix match; the rule ``/`` matches even an empty path."""
    return (prefix == "/") | url_path.startswith(prefix)


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """``urls`` with ``robots_allowed``: the first matching rule decides, none means allowed.

    The host is compared as written, like the domain of the file.
    """
    rules = rules_for_agent(robots, agent).withColumnRenamed("domain", "_host")
    keyed = urls.withColumn("_host", netloc(F.col(url))).withColumn("_path", path(F.col(url)))
    first = F.try_element_at(
        F.filter("rules", lambda r: rule_matches(F.col("_path"), r["prefix"])), F.lit(1)
    )
    return (
        keyed.join(rules, "_host", "left")
        .withColumn("robots_allowed", F.coalesce(first["allow"], F.lit(True)))
        .drop("_host", "_path", "rules")
    )


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(domain, position, sitemap_url) of the Sitemap lines."""
    lines = F.filter(
        F.transform(F.split("content", LINE_END), strip),
        lambda l: F.lower(l).startswith("sitemap:") & (_value(l) != ""),
    )
    return robots_files(robots).select(
        "domain",
        F.posexplode(F.transform(lines, _value)).alias("position", "sitemap_url"),
    )


def robots_directives(content: DataFrame) -> DataFrame:
    """(url, source, directive) without repeats. ``content`` has one row per URL, so repeats can
    only stand inside a row and no shuffle is needed to drop them."""
    tagged = F.concat(
        F.transform(
            F.array_distinct("html_meta_directives"),
            lambda d: F.struct(F.lit("html_meta").alias("source"), d.alias("directive")),
        ),
        F.transform(
            F.array_distinct("http_header_directives"),
            lambda d: F.struct(F.lit("http_header").alias("source"), d.alias("directive")),
        ),
    )
    return content.select("url", F.explode(tagged).alias("d")).select("url", "d.*")


def canonicals(content: DataFrame) -> DataFrame:
    """(url, canonical_url, source) where a page names its canonical URL."""
    return content.filter(F.coalesce("canonical_url", F.lit("")) != "").select(
        "url", "canonical_url", F.lit("html_head").alias("source")
    )


def indexability(content: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Permission by robots.txt, page and header, their conjunction, and the directives behind."""

    def free(directives: str) -> Column:
        return ~F.exists(directives, lambda d: d.contains("noindex"))

    slim = content.select("url", "html_meta_directives", "http_header_directives")
    return (
        robots_allowed(slim, robots, agent)
        .withColumnRenamed("robots_allowed", "robots_txt_allows")
        .withColumn("html_meta_allows", free("html_meta_directives"))
        .withColumn("http_header_allows", free("http_header_directives"))
        .select(
            "url", "robots_txt_allows", "html_meta_allows", "http_header_allows",
            (
                F.col("robots_txt_allows") & F.col("html_meta_allows") & F.col("http_header_allows")
            ).alias("overall_indexable"),
            F.when(F.col("robots_txt_allows"), F.array().cast("array<string>"))
            .otherwise(F.array(F.lit("disallow")))
            .alias("robots_txt_directives"),
            "html_meta_directives", "http_header_directives",
        )
    )
