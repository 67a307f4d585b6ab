"""URL keys and host tests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that track visits and name no resource.
TRACKING = ("fbclid", "gclid")
# Query parameters whose values may be shown.
SHOWN = ("page", "paged", "offset", "start", "limit", "lang", "language", "department", "faculty", "school", "category", "group", "filter", "search", "q", "letter", "sort", "order")
# Query parameters that move about in a listing and name no person.
NAVIGATION = (
    "page", "paged", "pagenum", "page_num", "page-number", "offset", "start", "limit", "sort", "sortby", "sort_by", "order", "orderby", "order_by", "search", "q",
    "query", "keyword", "filter", "filters", "department", "faculty", "school", "college", "unit", "category", "role", "type", "letter",
)
# Query parameters that name a person wherever they stand; last parts of paths whose query names one; words of paths under which a number does.
IDENTITY = ("key", "page_id", "personid", "profileid", "staffid", "stref", "investigadorid")
ENDPOINTS = ("person", "persons", "profile", "profiles", "people", "employee", "employees", "staff", "faculty", "directory", "academic-staff", "academic_staff")
PROFILE_PATHS = ("people", "person", "profile", "profs", "faculty", "staff", "academic-staff", "academic_staff", "directory", "employees")
# Labels below a country's domain under which institutions have theirs.
SECOND_LEVEL = ("ac", "co", "edu", "gov", "org")

_ORIGIN = r"^\s*(?i)(https?://[^/?#\s]+)"


def origin(url: Column) -> Column:
    """Scheme and host in lower case, empty if the text is no http address."""
    return F.lower(F.regexp_extract(url, _ORIGIN, 1))


def host(url: Column) -> Column:
    """Host in lower case, without user and port."""
    return F.regexp_extract(origin(url), r"^https?://(?:[^@/]*@)?([^:/]+)", 1)


def page_key(url: Column) -> Column:
    """Origin in lower case, the rest as it is, without fragment and final slashes; empty if no http address."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), _ORIGIN, ""), "#.*$", "")
    return F.when(origin(url) == "", "").otherwise(F.concat(origin(url), F.regexp_replace(rest, "/+$", "")))


def query_pairs(url: Column) -> Column:
    """``name=value`` items of the query, tracking parameters left out."""
    items = F.split(F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"\?(.*)$", 1), "&")
    name = lambda x: F.lower(F.regexp_extract(x, "^([^=]*)", 1))
    return F.filter(items, lambda x: (x != "") & ~name(x).startswith("utm_") & ~name(x).isin(*TRACKING))


def identity_key(url: Column) -> Column:
    """``page_key`` with the query's items sorted and tracking parameters dropped."""
    pairs = F.array_sort(query_pairs(url))
    base = F.regexp_replace(F.regexp_replace(page_key(url), r"\?.*$", ""), "/+$", "")
    return F.when(page_key(url) == "", "").when(F.size(pairs) == 0, base).otherwise(F.concat(base, F.lit("?"), F.array_join(pairs, "&")))


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Origin and path without final slashes in lower case, and the query's items with a value, tracking left out. White space goes."""
    url = F.regexp_replace(url, r"(?U)\s+", "")
    bare = F.regexp_replace(url, "#.*$", "")
    path = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, _ORIGIN, ""), r"\?.*$", ""), "/+$", ""))
    return origin(url), path, F.filter(query_pairs(url), lambda x: F.trim(F.regexp_extract(x, "=(.*)$", 1)) != "")


def _with_query(base: Column, pairs: Column) -> Column:
    """The address with the items in lower case and in order."""
    ordered = F.array_sort(F.transform(pairs, lambda x: F.lower(x)))
    return F.when(F.size(ordered) == 0, base).otherwise(F.concat(base, F.lit("?"), F.array_join(ordered, "&")))


def visit_key(url: Column) -> Column:
    """What tells pages of a listing apart: everything but the fragment, in lower case."""
    return F.lower(F.regexp_replace(url, "#.*$", ""))


def opaque_key(url: Column) -> Column:
    """Origin, path and every query item with a value except tracking ones, in lower case; empty if no http address."""
    base, path, pairs = _parts(url)
    return F.when(base == "", "").otherwise(_with_query(F.concat(base, F.when(path == "", "/").otherwise(path)), pairs))


def record_key(url: Column) -> Column:
    """The address of a person's record: of the query only what names the person, and only where a query can.

    Tracking and navigation parameters and those without a value are dropped. The rest counts under a path that ends in a
    person endpoint, on detail pages, with a parameter that names a person, with a number below a profile path, or with an
    id of a page of markup. Values are compared as they are written. Empty if no http address.
    """
    base, path, pairs = _parts(url)
    name = lambda x: F.lower(F.regexp_extract(x, "^([^=]*)", 1))
    kept = F.filter(pairs, lambda x: ~name(x).isin(*NAVIGATION))
    last = F.regexp_extract(path, "([^/]*)$", 1)
    low = F.lower(F.regexp_replace(url, r"(?U)\s+", ""))
    named = (
        last.isin(*ENDPOINTS)
        | low.contains("person-detail")
        | low.contains("/persons/")
        | F.exists(kept, lambda x: name(x).isin(*IDENTITY))
        | (F.exists(kept, lambda x: x.rlike("=[0-9]+$")) & path.rlike("|".join(PROFILE_PATHS)))
        | (F.exists(kept, lambda x: name(x) == "id") & last.rlike(r"\.html?$") & ~last.isin("index.html", "index.htm"))
    )
    return F.when(base == "", "").otherwise(_with_query(F.concat(base, path), F.when(named, kept).otherwise(F.array().cast("array<string>"))))


def institution(host_: Column) -> Column:
    """The last two labels of a host, three below a country's second level for institutions."""
    labels = F.filter(F.split(F.regexp_replace(F.lower(host_), ":.*$", ""), r"\."), lambda x: x != "")
    n = F.size(labels)
    three = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    return F.array_join(F.slice(labels, F.greatest(n - F.when(three, 2).otherwise(1), F.lit(1)), F.lit(3)), ".")


def related(host_: Column, domain: Column) -> Column:
    """True if either host lies within the other."""
    return within(host_, domain) | within(domain, host_)


def without_www(domain: Column) -> Column:
    """A typed domain or address as a plain host."""
    raw = F.regexp_replace(F.lower(F.trim(domain)), r"^\.+", "")
    return F.regexp_replace(F.regexp_replace(F.when(raw.contains("://"), host(raw)).otherwise(raw), r"\.+$", ""), r"^www\.", "")


def within(host_: Column, domain: Column) -> Column:
    """True if the host is the domain or one below it."""
    h, d = F.lower(host_), F.regexp_replace(F.lower(domain), r"^www\.", "")
    return (d != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d)))


def redacted(url: Column) -> Column:
    """The address without user and fragment, query values hidden unless their parameter may be shown."""
    plain = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^((?i)https?://)[^@/]*@", "$1")
    items = F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&")
    name = lambda x: F.regexp_extract(x, "^([^=]*)", 1)
    hidden = F.transform(items, lambda x: F.when(F.lower(name(x)).isin(*SHOWN) | ~x.contains("="), x).otherwise(F.concat(name(x), F.lit("=<redacted>"))))
    return F.when(plain.contains("?"), F.concat(F.regexp_extract(plain, r"^([^?]*)", 1), F.lit("?"), F.array_join(hidden, "&"))).otherwise(plain)


def href_pattern(path: Column) -> Column:
    """Numbers in a path become ``<id>``; at most four segments."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"\d+", "<id>"), r"^((?:https?://[^/]+)?(?:/[^/]*){0,4})", 1)
