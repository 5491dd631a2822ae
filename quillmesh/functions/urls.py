"""URLs: canonical form, safety, kinds."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, beside all that begin with utm_; case does not matter: fixed values.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref_src", "ref_url")
#: Top-level names that are never public: fixed values.
RESERVED = ("localhost", "local", "internal", "lan", "test", "invalid", "example", "arpa")
#: IPv4 networks that are not public: fixed values.
CLOSED_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/16", "192.88.99.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3",
)
#: Global unicast, and what of it is not public (first two groups; null: any second one): fixed values.
OPEN_IPV6 = (0x2000, 0x3FFF)
CLOSED_IPV6 = ((0x2001, 0x0), (0x2001, 0xDB8), (0x2001, 0x10), (0x2001, 0x20), (0x2002, None))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def port(url: Column) -> Column:
    """":8080" where the url names a port other than its scheme's own; else empty."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:0*(\d+)", 1)
    own = (F.lower(F.substring(url, 1, 6)) == "https:") & (found == "443") | (F.lower(F.substring(url, 1, 5)) == "http:") & (found == "80")
    return F.when((found == "") | own, F.lit("")).otherwise(F.concat(F.lit(":"), found))


def _form(part: Column) -> Column:
    """A query name or value as a form writes it."""
    return F.coalesce(F.url_encode(F.try_url_decode(part)), part)


def clean_query(query: Column) -> Column:
    """The query without tracking parameters, sorted by name; parameters of one name keep their order."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p, i: F.struct(_form(F.regexp_extract(p, "^[^=]*", 0)).alias("name"), i.alias("at"), _form(F.regexp_extract(p, "=(.*)$", 1)).alias("value")),
    )
    tracks = lambda name: F.startswith(F.lower(name), F.lit("utm_")) | F.lower(name).isin(*TRACKING)
    kept = F.array_sort(F.filter(pairs, lambda p: ~tracks(p["name"])))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")


def web_canonical(url: Column) -> Column:
    """http or https in lower case, host in lower case, port, path without slashes at its end and cleaned query; no fragment."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    login = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)", 1)
    trimmed = F.regexp_replace(path(url), "/+$", "")
    query = clean_query(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    base = F.concat(scheme, F.lit("://"), login, host(url), port(url), F.when(trimmed == "", F.lit("/")).otherwise(trimmed))
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def post_url(url: Column) -> Column:
    """struct<kind, token, canonical> of a link to a post: post, share, short or other; null on other hosts."""
    part = F.filter(F.split(path(url), "/"), lambda x: x != "")
    at = lambda k: F.coalesce(F.get(part, F.lit(k)), F.lit(""))
    kind = (
        F.when((F.lower(at(0)) == "share") & (at(1) != ""), F.lit("share"))
        .when((F.lower(at(0)) == "t") & (at(1) != ""), F.lit("short"))
        .when(F.startswith(at(0), F.lit("@")) & (F.lower(at(1)) == "post") & (at(2) != ""), F.lit("post"))
        .otherwise(F.lit("other"))
    )
    token = F.when(kind.isin("share", "short"), at(1)).when(kind == "post", at(2))
    canonical = F.when(kind == "post", F.concat(F.lit("https://threads.com/"), at(0), F.lit("/post/"), at(2)))
    return F.when(host(url).rlike(r"(^|\.)threads\.(com|net)$"), F.struct(kind.alias("kind"), token.alias("token"), canonical.alias("canonical")))


def source_identity(url: Column) -> Column:
    """struct<provider, source_type, canonical, identity> of an http or https url; null where it names no source.

    A repository is its owner and name, whatever follows them; a post its short code. Share and
    short links to posts have no identity before they are resolved. All else is known by its canonical url.
    """
    given = F.trim(url)
    web = F.coalesce(given.rlike(r"^(?i)https?://[^/?#]"), F.lit(False))
    out = lambda provider, kind, canonical, identity: F.struct(F.lit(provider).alias("provider"), kind.alias("source_type"), canonical.alias("canonical"), identity.alias("identity"))
    name = F.when(host(given) == "www.github.com", F.lit("github.com")).otherwise(host(given))
    part = F.filter(F.split(path(given), "/"), lambda x: x != "")
    owner = F.try_url_decode(F.get(part, F.lit(0)))
    repo = F.regexp_replace(F.try_url_decode(F.get(part, F.lit(1))), r"(?i)\.git$", "")
    named = F.coalesce(owner.rlike("^[A-Za-z0-9_.-]+$") & repo.rlike("^[A-Za-z0-9_.-]+$"), F.lit(False))
    repository = out("github", F.lit("github"), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo), F.lower(F.concat(F.lit("github:"), owner, F.lit("/"), repo)))
    p = post_url(given)
    link = F.concat(F.lit("https://threads.com/"), F.when(p["kind"] == "share", F.lit("share/")).otherwise(F.lit("t/")), F.url_encode(F.coalesce(F.try_url_decode(p["token"]), p["token"])))
    post = out("threads", F.lit("article"), F.coalesce(p["canonical"], link), F.when(p["kind"] == "post", F.concat(F.lit("threads:"), p["token"])))
    page = out("generic", source_type(given), web_canonical(given), F.concat(F.lit("url:"), web_canonical(given)))
    return F.when(web & (name == "github.com") & named, repository).when(web & (name != "github.com") & p["kind"].isin("post", "share", "short"), post).when(web & (name != "github.com") & p.isNull(), page)


def canonical(url: Column) -> Column:
    return source_identity(url)["canonical"]


def is_safe_public(url: Column) -> Column:
    """http or https, without credentials or port, to a dotted name outside reserved domains and no address."""
    name = host(url)
    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    label = "[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
    return (
        url.rlike("^(?i)https?://")
        & ~F.contains(authority, F.lit("@"))
        & (port(url) == "")
        & name.rlike(rf"^{label}(\.{label})+$")
        & ~name.rlike(r"^[0-9.]+$")
        & ~F.element_at(F.split(name, r"\."), -1).isin(*RESERVED)
    )


def is_public_ipv4(address: Column) -> Column:
    """A dotted IPv4 address in none of CLOSED_IPV4."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    number = F.reduce(F.split(address, r"\."), F.lit(0).cast("long"), lambda n, x: n * 256 + x.cast("long"))
    closed = F.lit(False)
    for network in map(ip_network, CLOSED_IPV4):
        bits = 32 - network.prefixlen
        closed = closed | (F.shiftright(number, bits) == int(network.network_address) >> bits)
    wellformed = F.coalesce(address.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), F.lit(False))
    return F.when(wellformed, ~closed).otherwise(F.lit(False))


def is_public_ipv6(address: Column) -> Column:
    """A well-formed IPv6 address within OPEN_IPV6 and in none of CLOSED_IPV6; a last dotted part counts as two groups."""
    flat = F.regexp_replace(F.lower(address), r":(?:\d{1,3}\.){3}\d{1,3}$", ":0:0")
    groups = F.filter(F.split(flat, ":"), lambda g: g != "")
    short = F.contains(flat, F.lit("::"))
    wellformed = (
        flat.rlike("^[0-9a-f:]+$")
        & ~flat.rlike(":::|::.*::|^:[^:]|[^:]:$")
        & F.forall(groups, lambda g: F.length(g) <= 4)
        & F.when(short, F.size(groups) <= 7).otherwise(F.size(groups) == 8)
    )
    group = lambda k: F.coalesce(F.conv(F.when(F.get(F.split(flat, ":"), F.lit(k)) != "", F.get(F.split(flat, ":"), F.lit(k))), 16, 10).cast("int"), F.lit(0))
    closed = F.lit(False)
    for first, second in CLOSED_IPV6:
        closed = closed | ((group(0) == first) & ((group(1) == second) if second is not None else F.lit(True)))
    return F.coalesce(wellformed & group(0).between(*OPEN_IPV6) & ~closed, F.lit(False))


def is_public_address(address: Column) -> Column:
    return F.when(F.contains(address, F.lit(":")), is_public_ipv6(address)).otherwise(is_public_ipv4(address))


def source_type(url: Column) -> Column:
    """paper, video, documentation or article, by host and path."""
    name, where = host(url), F.lower(path(url))
    return (
        F.when(name.rlike(r"(^|\.)arxiv\.org$"), F.lit("paper"))
        .when(name.isin("youtube.com", "youtu.be"), F.lit("video"))
        .when(F.contains(where, F.lit("/docs/")) | F.startswith(name, F.lit("docs.")), F.lit("documentation"))
        .otherwise(F.lit("article"))
    )


def is_safe_path(p: Column) -> Column:
    """A relative path without parent steps, backslashes or NUL."""
    return (p != "") & ~F.startswith(p, F.lit("/")) & ~p.rlike(r"[\\\x00]") & ~F.exists(F.split(p, "/"), lambda s: s.isin("..", ".", ""))
