"""Identity of web addresses and accounts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Host prefixes that name the same site, and query parameters that only track.
PREFIXES = ("www", "m", "mobile", "old", "new", "vm")
TRACKING = ("si", "feature", "t", "lang", "is_from_webapp", "sender_device", "igsh", "igshid", "share_id", "ref", "ref_src", "context")

#: Where sites keep an item's id (host pattern, path pattern, name).
ITEMS = [
    (r"(^|\.)youtube(-nocookie)?\.com$", r"^/(?:shorts|embed|live|v)/([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", "youtube"),
    (r"^youtu\.be$", r"^/([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", "youtube"),
    (r"tiktok\.com$", r"/video/([0-9]+)", "tiktok"),
    (r"instagram\.com$", r"/(?:p|reels?|tv)/([^/?#&]+)", "instagram"),
    (r"reddit\.com$", r"/comments/([a-z0-9]+)", "reddit"),
    (r"^redd\.it$", r"^/([a-z0-9]+)", "reddit"),
]


def _absolute(url: Column) -> Column:
    u = F.trim(url)
    return F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u))


def host(url: Column) -> Column:
    """Lower-case host without a port."""
    return F.lower(F.regexp_extract(_absolute(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site(url: Column) -> Column:
    """The host without prefixes that name the same site."""
    out = host(url)
    for prefix in PREFIXES:
        out = F.regexp_replace(out, rf"^{prefix}\.", "")
    return out


def path(url: Column) -> Column:
    return F.regexp_extract(_absolute(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(_absolute(url), r"^[^?#]*\?([^#]*)", 1)


def _decoded(part: Column) -> Column:
    """A query's part without escapes; one that holds a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    """A query's part with escapes for all but letters, digits and _ . - ~, and + for a space."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_key(url: Column) -> Column:
    """Canonical identity: site:item where a site's item ids are known, else site and path, without a closing slash, with the query that doesn't track, sorted. Null for a blank address.

    Of a query parameters without a value are left out; names and values are compared without their escapes.
    """
    s, p, q = site(url), path(url), query(url)
    known = F.lit(None).cast("string")
    video = F.regexp_extract(q, r"(?:^|&)v=([A-Za-z0-9_-]{11})(?:&|$)", 1)
    for host_rx, path_rx, name in reversed(ITEMS):
        item = F.regexp_extract(p, path_rx, 1)
        known = F.when(F.rlike(s, F.lit(host_rx)) & (item != ""), F.concat(F.lit(f"{name}:"), item)).otherwise(known)
    known = F.when(F.rlike(s, F.lit(ITEMS[0][0])) & (video != ""), F.concat(F.lit("youtube:"), video)).otherwise(known)
    tracks = "^(utm_[^=]*|" + "|".join(TRACKING) + ")$"
    name, value = (lambda x, k=k: _decoded(F.regexp_extract(x, "^([^=]*)=(.*)$", k)) for k in (1, 2))
    pairs = F.transform(F.filter(F.split(q, "&"), lambda x: F.rlike(x, F.lit("^[^=]*=."))), lambda x: F.struct(name(x).alias("k"), value(x).alias("v")))
    kept = F.transform(F.array_sort(F.filter(pairs, lambda x: ~F.rlike(F.lower(x["k"]), F.lit(tracks)))), lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"])))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.trim(url) != "", F.coalesce(known, F.concat(s, F.regexp_replace(p, "/+$", ""), rest)))


def platform(url: Column) -> Column:
    """The platform that a host belongs to, or null."""
    h = host(url)
    return (
        F.when(F.rlike(h, F.lit(r"youtube(-nocookie)?\.com$|^youtu\.be$")), "youtube")
        .when(F.rlike(h, F.lit(r"tiktokv?\.com$")), "tiktok")
        .when(F.rlike(h, F.lit(r"instagram\.com$")), "instagram")
        .when(F.rlike(h, F.lit(r"reddit(media)?\.com$|^redd\.it$")), "reddit")
    )


#: First path parts that are no account.
RESERVED = ("p", "reel", "reels", "tv", "explore", "stories", "accounts", "direct", "about", "developer")


def handle(url: Column) -> Column:
    """The posting account that a platform's path names, or null."""
    h, parts = host(url), F.filter(F.split(path(url), "/"), lambda x: x != "")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    at = F.when(F.rlike(first, F.lit("^@.")), first)
    name = F.when(~F.lower(first).isin(*RESERVED) & F.rlike(first, F.lit("^[A-Za-z0-9_.]{1,30}$")), F.concat(F.lit("@"), first))
    user = F.when(F.lower(first).isin("user", "u"), F.concat(F.lit("u/"), second))
    return F.when(F.rlike(h, F.lit(r"(tiktok|youtube)\.com$")), at).when(F.rlike(h, F.lit(r"instagram\.com$")), name).when(F.rlike(h, F.lit(r"reddit\.com$")), user)


def profile(url: Column) -> Column:
    """The address up to and with the part that names the account, or null."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    n = F.when(F.lower(F.try_element_at(parts, F.lit(1))).isin("user", "u"), 2).otherwise(1)
    return F.when(handle(url).isNotNull(), F.concat(F.lit("https://"), site(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
