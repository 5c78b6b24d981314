"""URL columns: hosts, sites, canonical forms, product ids, keys and fetch safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewtrust.sources.rules import ANY, DEFAULT, RuleSet, literal

# Hosts, tracking parameters and path segments that name nothing.
METADATA_HOSTS = ["169.254.169.254", "metadata.google.internal", "metadata.goog", "100.100.100.200"]
TRACKING_PARAMETER = r"(?i)^(utm_|gclid|fbclid|ref_?|_encoding|psc|th|tag|linkCode)"
STRUCTURAL_SEGMENTS = [
    "dp", "gp", "product", "products", "itm", "item", "site", "p", "ip", "pd",
    "s", "aspx", "html", "htm", "www",
]


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def _nonempty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, null when there is none."""
    return _nonempty(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def netloc(url: Column) -> Column:
    return found(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")


def path(url: Column) -> Column:
    return F.coalesce(part(url, "PATH"), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(found(url, r"^([A-Za-z][A-Za-z0-9+.-]*):"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def source_name(url: Column, hint: Column) -> Column:
    """The platform label: the hint, else the host without www, else 'host'."""
    return F.coalesce(_nonempty(hint), _nonempty(bare_host(url)), F.lit("host"))


def host_labels(name: Column) -> Column:
    """The parts of a host name but the last."""
    labels = F.split(F.lower(F.coalesce(name, F.lit(""))), r"\.")
    return F.slice(labels, F.lit(1), F.size(labels) - 1)


def _first(values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def site_adapter(url: Column, hint: Column, rules: RuleSet = DEFAULT) -> Column:
    """Which retailer's rules apply: the first whose name the hint or whose label the host has, else generic."""
    labels, named = host_labels(netloc(url)), F.lower(F.coalesce(hint, F.lit("")))
    held = F.filter(literal(rules.of_field("adapter")), lambda r: (r["site"] == named) | F.array_contains(labels, r["pattern"]))
    return F.coalesce(F.get(held, F.lit(0))["site"], F.lit("generic"))


def listing_facts(url: Column) -> Column:
    """Scheme, domain and whether the scheme is https; null without both parts."""
    usable = scheme(url).isNotNull() & netloc(url).isNotNull()
    return F.when(
        usable,
        F.struct(
            scheme(url).alias("scheme"),
            netloc(url).alias("domain"),
            (scheme(url) == "https").alias("secure"),
        ),
    )


def bare_url(url: Column) -> Column:
    """Origin and path only."""
    origin = F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)))
    path_or_root = F.coalesce(_nonempty(path(url)), F.lit("/"))
    return F.when(
        scheme(url).isNotNull() & netloc(url).isNotNull(), F.concat(origin, path_or_root)
    ).otherwise(url)


def canonical_url(url: Column) -> Column:
    """Drop the fragment and every tracking parameter, keep the rest in order."""
    kept = F.filter(
        F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"),
        lambda p: (p != "") & ~p.rlike(TRACKING_PARAMETER),
    )
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(
        scheme(url).isNotNull() & netloc(url).isNotNull(), F.concat(bare_url(url), query)
    ).otherwise(url)


def _path_query(url: Column) -> Column:
    return F.concat(path(url), F.coalesce(F.concat(F.lit("?"), part(url, "QUERY")), F.lit("")))


def url_site_rules(url: Column, rules: RuleSet = DEFAULT) -> Column:
    """The sites whose host rule holds, in order."""
    labels = host_labels(host(url))
    held = F.filter(
        literal([r for r in rules.of_field("applies") if r.source == "host"]), lambda r: F.array_contains(labels, r["pattern"])
    )
    return F.array_distinct(F.transform(held, lambda r: r["site"]))


def shape_id(url: Column, rules: RuleSet = DEFAULT) -> Column:
    """An id by the generic shapes of product URLs."""
    full = _path_query(url)
    shapes = [r for r in rules.of_field("product_id", generic=True) if r.source in ("path", "path_query")]
    return _first(F.transform(literal(shapes), lambda r: F.call_function("regexp_extract", full, r["pattern"], F.lit(1))))


def product_id_from_url(url: Column, rules: RuleSet = DEFAULT) -> Column:
    """Site-specific id, else a generic path or query shape."""
    tail, sites = path(url), url_site_rules(url, rules)
    own = [r for r in rules.of_field("product_id", generic=False) if r.source == "path"]
    by_site = F.filter(literal(own), lambda r: F.array_contains(sites, r["site"]))
    return F.coalesce(_first(F.transform(by_site, lambda r: F.call_function("regexp_extract", tail, r["pattern"], F.lit(1)))), shape_id(url, rules))


def name_from_url(url: Column) -> Column:
    """The longest readable path segment (first on a tie) as a product name."""
    segments = F.transform(
        F.split(path(url), "/"), lambda s: F.trim(F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))
    )
    named = F.filter(segments, lambda s: (s != "") & ~F.lower(s).isin(STRUCTURAL_SEGMENTS))
    worded = F.transform(
        named,
        lambda s: F.filter(F.split(s, r"[-_+]+"), lambda w: (w != "") & ~w.rlike(r"^\d+$")),
    )
    candidates = F.transform(
        F.filter(worded, lambda w: F.size(w) >= 2),
        lambda w, i: F.struct(
            F.length(F.array_join(w, " ")).alias("n"), (-i).alias("first"), F.array_join(w, " ").alias("name")
        ),
    )
    return F.array_max(candidates)["name"]


def cache_key(product_id: Column, site: Column, url: Column, name: Column) -> Column:
    """Stable product identity: site and id, id, host and path, or a normalized name."""
    pid, place, link, title = (_nonempty(c) for c in (product_id, site, url, name))
    by_url = F.concat(
        F.lit("url:"),
        F.coalesce(bare_host(link), F.lit("")),
        F.regexp_replace(path(link), r"/+$", ""),
    )
    plain = F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "))
    basis = (
        F.when(
            pid.isNotNull() & place.isNotNull(),
            F.concat(F.lit("id:"), F.lower(F.trim(place)), F.lit(":"), F.upper(F.trim(pid))),
        )
        .when(pid.isNotNull(), F.concat(F.lit("id:"), F.upper(F.trim(pid))))
        .when(link.isNotNull(), by_url)
        .when(F.length(plain) >= 4, F.concat(F.lit("name:"), plain))
    )
    return F.left(F.sha2(basis, 256), F.lit(32))


def absolute_link(base: Column, href: Column) -> Column:
    """Resolve a link found on a page against the page's own URL."""
    origin = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(F.coalesce(_nonempty(path(base)), F.lit("/")), r"[^/]*$", "")
    return (
        F.when(href.isNull() | (href == ""), base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path(base), href))
        .when(href.startswith("#"), F.concat(F.substring_index(base, "#", 1), href))
        .otherwise(F.concat(origin, folder, href))
    )


# ---------------------------------------------------------------- fetch safety


# IPv4 and IPv6 ranges that must not be fetched.
V4_PATTERN = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
V4_LOOPBACK = r"^127\."
V4_PRIVATE = (
    r"^(0|10|169\.254|172\.(1[6-9]|2\d|3[01])|192\.168|192\.0\.[02]|198\.(1[89]|51\.100)"
    r"|203\.0\.113|2[45]\d)\."
)
V4_MULTICAST = r"^(22[4-9]|23\d)\."
V6_PRIVATE = r"^(f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|::$|2001:db8:)"
V6_MULTICAST = r"^ff[0-9a-f]{2}:"


def _let(value: Column, body) -> Column:
    """Compute ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def forbidden_address(address: Column) -> Column:
    """Why a literal IP must not be fetched; null if it may, or if it is not an IP.

    IPv6 is checked by its prefix, and an IPv4-mapped address by the IPv4 address in it.
    """
    plain = F.regexp_replace(F.lower(address), r"^\[?(::ffff:(?=\d+\.))?|\]$", "")

    def reason(ip: Column) -> Column:
        v4, v6 = ip.rlike(V4_PATTERN), ip.contains(":")
        return (
            F.when(v4 & ip.rlike(V4_LOOPBACK), "loopback address")
            .when(v4 & ip.rlike(V4_PRIVATE), "private network address")
            .when(v4 & ip.rlike(V4_MULTICAST), "multicast address")
            .when(ip == "::1", "loopback address")
            .when(v6 & ip.rlike(V6_PRIVATE), "private network address")
            .when(v6 & ip.rlike(V6_MULTICAST), "multicast address")
        )

    return _let(plain, reason)


def rejection_reason(url: Column) -> Column:
    """Why a URL must not be fetched, from its text alone; null when it may be.

    Resolved addresses can be joined in by the caller and passed to
    :func:`forbidden_address`.
    """
    authority = F.regexp_replace(F.coalesce(netloc(url), F.lit("")), r"^.*@", "")
    name = F.lower(F.regexp_replace(authority, r":\d*$", ""))

    def by_host(n: Column) -> Column:
        local = (n == "localhost") | n.endswith(".localhost") | n.endswith(".local")
        return F.coalesce(
            F.when(n == "", "URL has no host").when(n.isin(METADATA_HOSTS), "cloud metadata endpoint"),
            forbidden_address(n),
            F.when(local, "local hostname").when(
                ~n.contains(".") & ~n.contains(":"), "non-public hostname"
            ),
        )

    kind = F.coalesce(scheme(url), F.lit(""))
    refused = F.concat(
        F.lit("scheme '"), F.coalesce(_nonempty(kind), F.lit("(none)")), F.lit("' is not allowed")
    )
    return (
        F.when(url.isNull() | (url == ""), F.lit(None).cast("string"))
        .when(~kind.isin("http", "https"), refused)
        .otherwise(_let(name, by_host))
    )


def rejection_bucket(reason: Column) -> Column:
    """Can the user fix the URL, or will it never be fetched?"""
    lowered = F.lower(reason)
    fixable = (
        lowered.contains("could not be parsed") | lowered.contains("scheme") | lowered.contains("no host")
    )
    return F.when(reason.isNull(), F.lit(None).cast("string")).when(
        fixable, "invalid_url"
    ).otherwise("unsupported_target")


def entry_kind(value: Column) -> Column:
    """Is a typed entry a URL or a product name?"""
    typed = F.trim(F.coalesce(value, F.lit("")))
    return (
        F.when(typed == "", "empty")
        .when(typed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S*$"), "url")
        .otherwise("name")
    )


# ---------------------------------------------------------------- review pages


def _filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with its places filled; null if one it names is null."""
    for name, value in values.items():
        place = F.lit(f"{{{name}}}")
        template = F.when(F.contains(template, place), F.replace(template, place, value)).otherwise(template)
    return template


def _of_adapter(rules: RuleSet, field: str, adapter: Column) -> Column:
    """The rules of a field for a row's adapter; the generic ones where it has no rules at all."""
    named = sorted({r.site for r in rules.rules if r.field == "adapter"})
    site = F.when(adapter.isin(named), adapter).otherwise(F.lit(ANY))
    return F.filter(literal(rules.of_field(field)), lambda r: r["site"] == site)


def review_page_urls(url: Column, product_id: Column, adapter: Column, rules: RuleSet = DEFAULT) -> Column:
    """Where a listing's reviews may be found, best guess first."""

    def read(r: Column) -> Column:
        looked_at = F.when(r["source"] == "product_id", F.trim(product_id)).otherwise(url)
        value = F.call_function("regexp_extract", F.coalesce(looked_at, F.lit("")), r["pattern"], F.lit(1))
        return F.when(r["take"] == "upper", F.upper(value)).otherwise(value)

    home = F.get(_of_adapter(rules, "home", adapter), F.lit(0))["pattern"]
    places = {
        "url": url,
        "base": F.regexp_replace(F.substring_index(F.substring_index(url, "?", 1), "#", 1), r"/+$", ""),
        "netloc": F.coalesce(netloc(url), home),
        "id": _first(F.transform(_of_adapter(rules, "review_id", adapter), read)),
    }
    pages = F.transform(_of_adapter(rules, "review_page", adapter), lambda r: _filled(r["pattern"], places))
    return F.array_distinct(F.array_compact(pages))


def next_page_url(page_url: Column, page_number: Column, adapter: Column, advertised: Column, rules: RuleSet = DEFAULT) -> Column:
    """The following review page: counted up where the site counts, else as advertised."""
    following = (page_number + 1).cast("string")
    joiner = F.when(page_url.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    holding = F.filter(
        _of_adapter(rules, "next_page", adapter), lambda r: F.contains(page_url, F.coalesce(r["take"], F.lit("")))
    )

    def made(r: Column) -> Column:
        name = F.concat(r["pattern"], F.lit("="))
        added = F.concat(joiner, name, following)
        counted = F.when(
            F.contains(page_url, name), F.regexp_replace(page_url, F.concat(name, F.lit("\\d+")), F.concat(name, following))
        ).otherwise(F.concat(page_url, added))
        cut = F.get(F.split(page_url, F.concat(F.lit("&"), name)), F.lit(0))
        return F.when(r["source"] == "count", counted).when(r["source"] == "append", F.concat(cut, added))

    return F.when(F.size(holding) > 0, _let(F.get(holding, F.lit(0)), made)).otherwise(advertised)


def search_url(query: Column, adapter: Column, rules: RuleSet = DEFAULT) -> Column:
    """The retailer's own search page for a query."""
    template = F.get(_of_adapter(rules, "search", adapter), F.lit(0))["pattern"]
    return _filled(template, {"query": F.url_encode(query)})
