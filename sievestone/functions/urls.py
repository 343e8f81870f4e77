"""URL expressions.  All are native Columns that never fail on odd input: parts are cut by one lenient pattern, not by a
strict parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(url: Column, part: str) -> Column:
    """scheme, host (with port), path, query or fragment of a url, '' where it has none."""
    return F.regexp_extract(url, _PARTS, 1 + ["scheme", "host", "path", "query", "fragment"].index(part))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    """Percent-encoding with + for spaces, ~ left alone and * escaped."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_params(query: Column) -> Column:
    """Array of (k, i, v): decoded parameters with a value that isn't blank, i their place."""
    pairs = F.transform(F.split(query, "&"), lambda p, i: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), _decoded(F.substr(p, F.instr(p, "=") + 1))).alias("v")))
    return F.filter(pairs, lambda x: F.coalesce(x.v, F.lit("")) != "")


def query_keys(query: Column) -> Column:
    """Distinct parameter names in order of first appearance."""
    return F.array_distinct(F.transform(query_params(query), lambda x: x.k))


def normalize_url(url: Column) -> Column:
    """Lower case, no fragment, no tracking or blank parameters, the rest sorted by name, no slash at the end of a path."""
    low = F.lower(F.trim(url))
    keep = F.array_sort(F.filter(query_params(url_part(low, "query")), lambda x: ~x.k.isin(C.TRACKING_PARAMS)))
    query = F.array_join(F.transform(keep, lambda x: F.concat(_encoded(x.k), F.lit("="), _encoded(x.v))), "&")
    path = F.rtrim(url_part(low, "path"), F.lit("/"))
    head = F.concat(url_part(low, "scheme"), F.when(url_part(low, "scheme") != "", "://").otherwise(""), url_part(low, "host"))
    return F.concat(head, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def url_variant(url: Column) -> Column:
    """amp_url, print_url or mobile_url, else null."""
    return F.when(url.rlike(C.AMP_URL), "amp_url").when(url.rlike(C.PRINT_URL), "print_url").when(url.rlike(C.MOBILE_URL), "mobile_url")


def registered_domain(host: Column) -> Column:
    """The last two labels of a host: an approximation without a public-suffix list."""
    return F.regexp_extract(F.lower(host), r"([^.]+\.[^.]+)$|^([^.]*)$", 0)


def trap_reason(url: Column, depth: Column | int = 0, compat: bool = False) -> Column:
    """Why a url is a crawler trap, null if it isn't; the first rule that fits names it.

    compat leaves the first query parameter out of the search rule, as a pattern that asks for ? or & before it does."""
    path, query, low = url_part(url, "path"), url_part(url, "query"), F.lower(url)
    asked = query if compat else F.concat(F.lit("?"), query)
    by_param = F.regexp_extract(F.concat(F.lit("?"), query), C.TRAP_PAGE_PARAM, 2)
    pages = [by_param, *[F.regexp_extract(path, p, 1) for p in C.TRAP_PAGE_PATH]]
    page = F.coalesce(*[F.when(p != "", p) for p in pages])
    number = F.ltrim(page, F.lit("0"))
    keys = query_keys(query)
    trapped = F.filter(keys, lambda k: k.rlike(C.TRAP_PARAM))
    steps = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return (F.when(asked.rlike(C.TRAP_SEARCH), "search_result_url").when(path.rlike(C.TRAP_SCROLL), "infinite_scroll_or_ajax_endpoint").when(low.rlike(C.TRAP_COMMENT), "comment_pagination")
            .when((F.length(number) > 9) | (number.try_cast("long") > C.MAX_PAGE_NUMBER), F.concat(F.lit("pagination_depth_too_high_"), number)).when(path.rlike(C.TRAP_CALENDAR), "calendar_or_archive_url")
            .when(F.size(keys) > C.MAX_QUERY_PARAMS, F.concat(F.lit("too_many_query_params_"), F.size(keys).cast("string"))).when(F.size(trapped) >= 2, F.concat(F.lit("trap_params_"), F.array_join(F.slice(trapped, 1, 3), "_")))
            .when(steps > C.MAX_PATH_DEPTH, F.concat(F.lit("excessive_path_depth_"), steps.cast("string"))).when(depth > C.MAX_CRAWL_DEPTH, F.concat(F.lit("crawl_depth_too_high_"), depth.cast("string"))))


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    return F.transform(F.array(F.split(host, r"\.")), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))[0]


def trust(url: Column, compat: bool = False) -> Column:
    """(score, category, tier) of a url's source: the longest host suffix in the trust table, raised for investor pages.

    The table is a literal map: no join, no shuffle.  compat strips any of the characters w and . from the host's
    start, as some crawlers do, where the default strips only a leading www."""
    host = F.lower(url_part(url, "host"))
    host = F.ltrim(host, F.lit("w.")) if compat else F.regexp_replace(host, r"^www\.", "")
    kind = "struct<score:double,category:string,tier:int>"
    entry = lambda s, c, t: F.struct(F.lit(s).cast("double").alias("score"), F.lit(c).alias("category"), F.lit(t).alias("tier"))
    table = F.create_map(*[x for d, s, c, t in C.TRUST_TIERS for x in (F.lit(d), entry(s, c, t))])
    known = F.element_at(F.filter(F.transform(host_suffixes(host), lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()), 1)
    known = F.when(F.exists(host_suffixes(host), lambda s: F.map_contains_key(table, s)), known)
    raised = F.struct(F.least(F.round(known.score + 0.05, 10), F.lit(1.0)).alias("score"), F.lit("investor_relations").alias("category"), F.lit(1).alias("tier"))
    regulator = F.lower(url).contains("edgar") | F.lower(url).contains("sec.gov")
    return F.when(known.isNotNull() & url_part(url, "path").rlike(C.INVESTOR_PATHS), raised).when(known.isNotNull(), known).when(regulator, entry(1.0, "regulatory", 1)).otherwise(entry(*C.DEFAULT_TRUST)).cast(kind)


def tier_label(tier: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for t, name in C.TIER_LABELS.items() for x in (F.lit(t), F.lit(name))]), tier), F.lit(C.TIER_LABELS[5]))


def is_financial_source(source: Column) -> Column:
    """Whether a trust() result is of the three upper tiers or a financial category."""
    return (source.tier <= 3) | source.category.isin(C.FINANCIAL_CATEGORIES)


def robots_disallowed(url: Column, prefixes: Column) -> Column:
    """Whether the url's path starts with one of the disallowed prefixes."""
    return F.exists(prefixes, lambda p: (p != "") & F.startswith(url_part(url, "path"), p))


def followable(link: Column) -> Column:
    """Whether a resolved link is a page to fetch: http(s), no binary file."""
    return link.rlike("^https?://") & ~link.rlike(C.SKIP_LINK_EXTENSIONS)
