"""URL functions as native Column expressions.

A URL is handled as a struct of parts (``url_parts``), so that a page URL is taken apart once per
page and only the href once per link.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Schemes with a ``//host`` part, and those against which relative links resolve.
NETLOC_SCHEMES = [
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
    "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
    "git+ssh", "ws", "wss", "itms-services",
]
RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]

# Social networks, and the file extensions of images and other assets.
SOCIAL_DOMAINS = [
    "facebook.com", "fb.com", "twitter.com", "x.com", "instagram.com", "linkedin.com",
    "youtube.com", "tiktok.com", "snapchat.com", "pinterest.com", "reddit.com", "discord.com",
    "telegram.org", "whatsapp.com", "messenger.com", "skype.com", "zoom.us",
]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "webp", "svg", "avif"]
ASSET_EXTENSIONS = ["css", "js", "pdf", "zip", "woff", "woff2", "ttf"]

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_PATH = f"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"(?s)^[^#]*#(.*)\z"
_LEADING_JUNK = "".join(map(chr, range(0x21)))


def _clean(url: Column) -> Column:
    return F.translate(F.ltrim(url, F.lit(_LEADING_JUNK)), "\t\r\n", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), f"^({_SCHEME}):", 1))


def netloc(url: Column) -> Column:
    """Host part with port and user info, case kept."""
    return F.regexp_extract(_clean(url), f"^(?:{_SCHEME}:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _QUERY, 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _FRAGMENT, 1)


def host(url: Column) -> Column:
    return F.lower(netloc(url))


def _params(full_path: Column) -> Column:
    """``;x`` of the last path segment, empty when nothing follows the semicolon."""
    found = F.regexp_extract(full_path, r"(;[^/]*)\z", 1)
    return F.when(~full_path.contains(";") | (found == ";"), "").otherwise(found)


def _without_params(full_path: Column) -> Column:
    return F.when(
        full_path.contains(";"), F.regexp_replace(full_path, r";[^/]*\z", "")
    ).otherwise(full_path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for an expression that uses it many times."""
    return F.transform(F.array(value), body)[0]


def url_parts(url: Column) -> Column:
    """Struct (url, scheme, netloc, path, params, query, fragment)."""

    def parts(text: Column, full: Column) -> Column:
        return F.struct(
            url.alias("url"),
            F.lower(F.regexp_extract(text, f"^({_SCHEME}):", 1)).alias("scheme"),
            F.regexp_extract(text, f"^(?:{_SCHEME}:)?//([^/?#]*)", 1).alias("netloc"),
            _without_params(full).alias("path"),
            _params(full).alias("params"),
            F.when(text.contains("?"), F.regexp_extract(text, _QUERY, 1)).otherwise("").alias("query"),
            F.when(text.contains("#"), F.regexp_extract(text, _FRAGMENT, 1)).otherwise("").alias("fragment"),
        )

    return let(
        _clean(url),
        lambda text: let(F.regexp_extract(text, _PATH, 1), lambda full: parts(text, full)),
    )


def url_split(url: Column) -> Column:
    """Struct (scheme, netloc, path, query, fragment)."""
    return F.struct(
        scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        path(url).alias("path"),
        query(url).alias("query"),
        fragment(url).alias("fragment"),
    )


def unsplit(parts: Column, *, lower_host=False, with_query=True, with_fragment=False) -> Column:
    """URL text of a struct of parts."""
    scheme_, path_, params_ = (parts.getField(f) for f in ("scheme", "path", "params"))
    netloc_ = F.lower(parts.getField("netloc")) if lower_host else parts.getField("netloc")
    query_, fragment_ = parts.getField("query"), parts.getField("fragment")
    slash = F.lit("//")
    full = F.concat(path_, params_)
    body = (
        F.when(
            netloc_ != "",
            F.concat(
                slash, netloc_,
                F.when((full != "") & ~full.startswith("/"), "/").otherwise(""), full,
            ),
        )
        .when(
            full.startswith("//")
            | (scheme_.isin(NETLOC_SCHEMES) & ((full == "") | full.startswith("/"))),
            F.concat(slash, full),
        )
        .otherwise(full)
    )
    out = [F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""), body]
    if with_query:
        out.append(F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""))
    if with_fragment:
        out.append(F.when(fragment_ != "", F.concat(F.lit("#"), fragment_)).otherwise(""))
    return F.concat(*out)


def _remove_dots(path_: Column) -> Column:
    segments = F.split(path_, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    ended = F.when(
        F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))
    ).otherwise(kept)
    joined = F.array_join(ended, "/")
    return F.when(joined == "", "/").otherwise(joined)


def _dots_if_any(path_: Column) -> Column:
    return F.when(path_.rlike(r"(^|/)\.{1,2}(/|\z)"), _remove_dots(path_)).otherwise(path_)


def _merged_path(base_path: Column, rel: Column) -> Column:
    directory = F.regexp_replace(base_path, r"[^/]*\z", "")
    directory = F.when(directory == "", "/").otherwise(directory)
    return _dots_if_any(F.regexp_replace(F.concat(directory, rel), "/{2,}", "/"))


def join_parts(b: Column, h: Column) -> Column:
    """Parts of the absolute URL for a reference with parts ``h`` on a page with parts ``b``."""
    foreign = (
        ((h["scheme"] != "") & (h["scheme"] != b["scheme"]))
        | ~b["scheme"].isin(RELATIVE_SCHEMES)
        | (b["url"] == "")
    )
    whole = foreign | (h["netloc"] != "")
    pathless = (h["path"] == "") & (h["params"] == "")
    return F.struct(
        F.when(foreign, h["scheme"]).otherwise(b["scheme"]).alias("scheme"),
        F.when(whole, h["netloc"]).otherwise(b["netloc"]).alias("netloc"),
        F.when(whole, h["path"])
        .when(pathless, b["path"])
        .when(h["path"].startswith("/"), _dots_if_any(h["path"]))
        .otherwise(_merged_path(b["path"], h["path"]))
        .alias("path"),
        F.when(~whole & pathless, b["params"]).otherwise(h["params"]).alias("params"),
        F.when(~whole & pathless & (h["query"] == ""), b["query"])
        .otherwise(h["query"])
        .alias("query"),
        F.when(h["url"] == "", b["fragment"]).otherwise(h["fragment"]).alias("fragment"),
    )


def bare_parts(h: Column) -> Column:
    """The parts without query and fragment."""
    return F.struct(
        F.concat(h["scheme"], h["netloc"], h["path"], h["params"]).alias("url"),
        *[h[f].alias(f) for f in ("scheme", "netloc", "path", "params")],
        F.lit("").alias("query"),
        F.lit("").alias("fragment"),
    )


def url_resolve(base: Column, href: Column, *, keep_fragment: bool = False) -> Column:
    """Absolute URL of ``href`` on the page ``base``; the query stays, the fragment goes."""
    return let(
        F.struct(url_parts(base).alias("b"), url_parts(href).alias("h")),
        lambda v: let(
            join_parts(v["b"], v["h"]), lambda t: unsplit(t, with_fragment=keep_fragment)
        ),
    )


def url_normalize_storage(url: Column) -> Column:
    """Key form: scheme and host in lower case, no fragment; path, params and query as they are.

    Works on the text in two cuts (up to the path, then up to the fragment), which keeps the
    expression small enough to be repeated inside joins and filters.
    """
    text = _clean(url)
    head = F.regexp_extract(text, f"^(?:{_SCHEME}:)?(?://[^/?#]*)?", 0)
    tail = F.substring_index(F.substring(text, F.length(head) + 1, F.length(text)), "#", 1)
    # A query or params mark with nothing behind it goes.
    neat = F.when(
        tail.contains(";") | tail.endswith("?"),
        F.regexp_replace(
            F.regexp_replace(tail, r"\A([^?]*)\?\z", "$1"),
            r"\A((?:[^?]*/)?[^/;?]*);(?=\?|\z)", "$1",
        ),
    ).otherwise(tail)
    hostless = F.lower(head).isin([f"{s}:" for s in NETLOC_SCHEMES]) & (
        (tail == "") | tail.startswith("/")
    )
    return F.concat(F.lower(head), F.when(hostless, "//").otherwise(""), neat)


def url_kind(content_type: Column, url: Column) -> Column:
    """html, sitemap, image, asset or other, from the content type, then the extension."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    extension = F.when(url.contains("."), F.lower(F.substring_index(url, ".", -1))).otherwise("")
    return (
        F.when(ct.contains("xml") & ct.contains("sitemap"), "sitemap")
        .when(ct.startswith("text/html"), "html")
        .when(extension.isin(IMAGE_EXTENSIONS), "image")
        .when(extension.isin(ASSET_EXTENSIONS), "asset")
        .otherwise("other")
    )


def bare_host(domain: Column) -> Column:
    """Lower-case host without one leading ``www.``."""
    low = F.lower(domain)
    return F.when(low.startswith("www."), F.substring(low, F.lit(5), F.length(low))).otherwise(low)


def host_classification(
    netloc_: Column, base_domain: Column, from_sitemap: Column | None = None
) -> Column:
    """social, internal, network or external, seen from ``base_domain``.

    Every social domain has two labels, so comparing the last two labels of the host covers the
    domain and its subdomains with one set lookup.
    """
    sitemap = F.lit(False) if from_sitemap is None else F.coalesce(from_sitemap, F.lit(False))
    own = bare_host(netloc_)
    return (
        F.when(F.substring_index(own, ".", -2).isin(SOCIAL_DOMAINS), "social")
        .when(own == bare_host(base_domain), "internal")
        .when(sitemap, "network")
        .otherwise("external")
    )


def url_classification(url: Column, base_domain: Column, from_sitemap: Column | None = None) -> Column:
    """``host_classification`` of a URL text."""
    return host_classification(netloc(url), base_domain, from_sitemap)


def _decoded(text: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _parameters(query_: Column) -> Column:
    """``k=v`` pairs joined with ``&``: first value per key, blank values dropped, decoded."""
    pairs = F.transform(
        F.filter(F.split(query_, "&"), lambda kv: kv.rlike("(?s)^[^=]*=.")),
        lambda kv: F.struct(
            _decoded(F.substring_index(kv, "=", 1)).alias("k"),
            _decoded(F.regexp_replace(kv, "(?s)^[^=]*=", "")).alias("v"),
        ),
    )
    keys = F.transform(pairs, lambda p: p["k"])
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.array_join(F.transform(first, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def components_from(h: Column, joined: Column) -> Column:
    """Struct (href, url_fragment, url_parameters) from the parts of an href and the parts of its
    bare form joined to the base."""
    return F.struct(
        F.when(h["netloc"] != "", unsplit(h, with_query=False))
        .otherwise(unsplit(joined, with_fragment=True))
        .alias("href"),
        F.when(h["fragment"] != "", h["fragment"]).alias("url_fragment"),
        F.when(h["query"] != "", _parameters(h["query"])).alias("url_parameters"),
    )


def url_components(href: Column, base: Column) -> Column:
    """Href without query and fragment (absolute if it has no host), fragment, parameters; the
    last two are NULL when absent."""
    return let(
        F.struct(url_parts(base).alias("b"), url_parts(href).alias("h")),
        lambda v: let(
            F.struct(v["h"].alias("h"), join_parts(v["b"], bare_parts(v["h"])).alias("j")),
            lambda w: components_from(w["h"], w["j"]),
        ),
    )


def site_key(url: Column) -> Column:
    """Storage name of a site: bare host, everything but letters and digits as ``_``."""
    return F.regexp_replace(bare_host(netloc(url)), r"[^\p{L}\p{N}_]", "_")


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def crawl_policy(
    classification: Column, robots_allowed: Column, allow_external: bool = False,
    respect_robots: bool = True,
) -> Column:
    """True when a URL is to be crawled, False when it is only recorded."""
    own = F.coalesce(robots_allowed, F.lit(True)) if respect_robots else F.lit(True)
    return (
        F.when(classification.isin("internal", "network"), own)
        .when(classification == "external", F.lit(allow_external))
        .otherwise(False)
    )
