"""URL functions as column expressions: keys, hosts, guards and the resolution of links.

SCA-30/31/32/33/35, FLT-06/07/08/09/10. Addresses are judged by their text; nothing is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths that are navigation, and extensions that are never readable pages.
NOISE = r"(?i)/print(/|$)|/(login|logout|signin|signout|signup|register|subscribe|share|feedback|rss|feed)(/|$)"
ASSET = r"(?i)\.(css|js|json|xml|txt|png|jpe?g|gif|webp|svg|ico|zip|rar|7z|tar|gz|tgz|bz2)(\?|#|$)"
PDF = r"(?i)\.pdf(\?|#|$)"


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def search_key(url: Column) -> Column:
    """SCA-32, search results: without query, fragment and trailing slashes, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(_text(url), r"[#?].*$", ""), r"/+$", ""))


def branch_key(url: Column) -> Column:
    """SCA-32, covered pages and citations: trimmed, without trailing slashes, lower-cased."""
    return F.lower(F.regexp_replace(F.trim(_text(url)), r"/+$", ""))


def link_key(url: Column) -> Column:
    """SCA-32, links of a page: without trailing slashes, lower-cased."""
    return F.lower(F.regexp_replace(_text(url), r"/+$", ""))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(_text(url)), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    """SCA-31: the lower-cased host without user and port; brackets of an IPv6 address are kept off."""
    authority = F.regexp_extract(F.trim(_text(url)), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^[^@]*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":\d*$", "")))


def is_external(href: Column, base: Column) -> Column:
    return (host(href) != "") & (host(base) != "") & (host(href) != host(base))


_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
#: Private, local, shared, documentation, benchmark and reserved blocks, as their leading octets.
_PRIVATE_BLOCKS = (
    (r"(?:0{1,3}|0?10|127)", 3), (r"169\.254", 2), (r"172\.(?:0?1[6-9]|0?2\d|0?3[01])", 2), (r"192\.168", 2),
    (r"100\.(?:0?6[4-9]|0?[7-9]\d|1[01]\d|12[0-7])", 2), (r"192\.0{1,3}\.0{0,2}[02]", 1), (r"198\.0?1[89]", 2), (r"(?:22[4-9]|2[34]\d|25[0-5])", 3),
)
PRIVATE_IPV4 = "^(?:" + "|".join(lead + (r"\." + _OCTET) * n for lead, n in _PRIVATE_BLOCKS) + ")$"


def is_private_ipv4(h: Column) -> Column:
    """FLT-07: one pattern, so that the guard stays a small expression."""
    return F.coalesce(h.rlike(PRIVATE_IPV4), F.lit(False))


def is_blocked_host(h: Column) -> Column:
    """FLT-08: no host, this machine, local names, private IPv4 and local or mapped IPv6."""
    x = F.lower(_text(h))
    v6 = x.contains(":") & (x.isin("::1", "::") | x.rlike(r"^(fc|fd|fe[89ab])") | is_private_ipv4(F.regexp_extract(x, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)))
    return (x == "") | (x == "localhost") | x.endswith(".localhost") | x.endswith(".local") | is_private_ipv4(x) | v6


def guard(url: Column) -> Column:
    """FLT-09: null where the url may be fetched, else why not."""
    u = F.trim(_text(url))
    return (
        F.when(u == "", "no-url").when(scheme(u) == "", "invalid-url").when(~scheme(u).isin("http", "https"), "bad-scheme")
        .when(is_blocked_host(host(u)), "blocked-host")
    )


def is_local_endpoint(provider: Column, url: Column) -> Column:
    """FLT-10: by provider where there is no host; else a blocked host or one without a dot."""
    h = host(url)
    return F.when(h == "", provider.isin("ollama", "unsloth")).otherwise(is_blocked_host(h) | ~h.contains("."))


def resolve(href: Column, base: Column) -> Column:
    """SCA-30: an absolute http(s) url without fragment, or ''. `..` and `.` steps of relative paths are folded."""
    raw = F.trim(_text(href))
    root = F.regexp_extract(_text(base), r"^(?i)(https?://[^/?#]+)", 1)
    here = F.regexp_extract(_text(base), r"^(?i)https?://[^/?#]+(/[^?#]*)?", 1)
    folder = F.when(here == "", "/").otherwise(F.regexp_replace(here, r"[^/]*$", ""))
    path = F.regexp_extract(raw, r"^([^?#]*)", 1)
    rest = F.substring(raw, F.length(path) + 1, F.lit(1 << 30))
    joined = F.when(raw.startswith("/"), path).when(path == "", F.when(here == "", "/").otherwise(here)).otherwise(F.concat(folder, path))
    steps = F.aggregate(
        F.split(F.substring(joined, F.lit(2), F.lit(1 << 30)), "/"), F.array().cast("array<string>"),
        lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    tail = F.when(joined.rlike(r"/\.{1,2}$"), "/").otherwise("")
    relative = F.concat(root, F.lit("/"), F.array_join(steps, "/"), tail, rest)
    full = (
        F.when(raw.rlike(r"(?i)^https?://"), raw).when(root == "", "").when(raw.startswith("//"), F.concat(F.regexp_extract(_text(base), r"^(?i)(https?:)", 1), raw))
        .when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), "").otherwise(relative)
    )
    bad = (raw == "") | raw.rlike(r"(?i)^(mailto:|tel:|javascript:|data:|about:)")
    return F.when(bad, "").otherwise(F.regexp_replace(full, r"(?s)#.*$", ""))


def render_url(url: Column) -> Column:
    """SCA-33: without trailing punctuation; null unless http(s)."""
    u = F.regexp_replace(F.trim(_text(url)), r"[.,;:!?)\]}>'\"]+$", "")
    return F.when(u.rlike(r"(?i)^https?://"), u)


def search_url(base: Column, query: Column) -> Column:
    """SCA-35: a search request for a query."""
    return F.concat(F.regexp_replace(base, r"/+$", ""), F.lit("/search?q="), F.url_encode(query), F.lit("&format=json"))
