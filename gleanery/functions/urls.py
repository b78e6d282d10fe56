"""URL expressions by regular expressions, as dirty urls must neither fail nor vanish."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("gclid", "fbclid", "mc_cid", "mc_eid")
#: Fragments of hosts and paths that are not articles (the caller may pass others).
BLOCKED_HOSTS = ("register.", "events.", "conference.", "webinars.")
BLOCKED_PATHS = (
    "/tag/", "/tags/", "/category/", "/categories/", "/author/", "/authors/",
    "/search", "/topic/", "/topics/", "/video/", "/videos/", "/podcast/",
    "/podcasts/", "/gallery/", "/galleries/", "/live/", "/live-blog/", "/events/",
    "/newsletter", "/subscribe", "/privacy", "/terms",
    "/register", "/registration", "/roundtable", "/conference", "/summit",
    "/webinar", "/event-registration",
)
#: Path fragments of single publications that are not articles.
OWN_PATHS = {
    "Institutional Investor": ("/roundtable", "/events", "/awards", "/membership", "/subscribe"),
    "BBC": ("/live/", "/av/", "/iplayer", "/sounds", "/sport/", "/news/topics/", "/newsround/", "/reel/", "/worklife/"),
    "The Telegraph": ("/video/", "/podcast/", "/newsletters/", "/opinion/", "/business/live/", "/football/", "/rugby/", "/travel/"),
    "Evening Standard": ("/topic/", "/newsletters/", "/comment/", "/esmoney/", "/sport/", "/showbiz/", "/culture/"),
}
#: Section pages of a site, below its address.
SECTION_SITE = "https://nationaljeweler.com"
SECTIONS = (
    "", "/industry", "/industry/industry-other", "/industry/independents", "/industry/events-awards", "/industry/financials",
    "/industry/supplier-bulletin", "/industry/technology", "/industry/surveys", "/industry/policies-issues", "/industry/crime", "/industry/majors",
    "/diamonds-gems", "/diamonds-gems/diamonds-gems-other", "/diamonds-gems/lab-grown", "/diamonds-gems/grading", "/diamonds-gems/sourcing",
    "/style", "/style/style-other", "/style/trends", "/style/auctions", "/style/watches", "/style/collections",
    "/opinions", "/opinions/editors", "/opinions/columnists",
)
SECTION_PAGES = tuple(SECTION_SITE + s for s in SECTIONS)


def authority(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1)


def host(u: Column) -> Column:
    """Lower-case authority without a leading www., port kept; a scheme is supplied where none is."""
    full = F.when(F.contains(u, F.lit("://")), F.trim(u)).otherwise(F.concat(F.lit("https://"), F.trim(u)))
    return F.regexp_replace(F.lower(authority(full)), r"^www\.", "")


def form_encoded(c: Column) -> Column:
    """A decoded query part, encoded again as a form does."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalized(u: Column, drop_port: bool = False, keep_blank: bool = False) -> Column:
    """Identity of a page: no www., tracking parameters, trailing slash or fragment, and no blank values unless kept; a root path is "/".

    Query parts are decoded and encoded again, so that spellings of one value agree."""
    whole = F.regexp_replace(F.trim(F.coalesce(u, F.lit(""))), "#.*$", "")
    scheme = F.lower(F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    rest = F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    name = F.regexp_replace(F.lower(F.regexp_extract(rest, "^//([^/?]*)", 1)), r"^www\.", "")
    name = F.regexp_replace(name, r":\d+$", "") if drop_port else name
    path = F.regexp_replace(F.regexp_extract(rest, r"^(?://[^/?]*)?([^?]*)", 1), ";[^/]*$", "")
    path = F.regexp_replace(path, "/+$", "")
    path = F.when(path == "", "/").when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    params = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.startswith(key(p), F.lit("utm_")) & ~key(p).isin(*TRACKING) & (F.lit(True) if keep_blank else p.rlike("=.")))
    part = lambda x: form_encoded(F.coalesce(F.try_url_decode(x), x))
    params = F.transform(params, lambda p: F.concat(part(F.substring_index(p, "=", 1)), F.lit("="), part(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)))))
    query = F.array_join(params, "&")
    return F.when(whole == "", "").otherwise(F.concat(scheme, F.lit("://"), name, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def article_id(u: Column) -> Column:
    return F.sha2(normalized(u), 256)


def sanitized(u: Column) -> Column:
    """Without control characters and any white space."""
    return F.regexp_replace(F.trim(F.regexp_replace(u, r"[\x00-\x1f\x7f]", "")), r"(?U)\s+", "")


def is_valid(u: Column) -> Column:
    return F.coalesce(u.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def is_fetchable(u: Column) -> Column:
    """http or https, a host, and where a port is given a number from 1 to 65535; bracketed addresses are not checked."""
    a = authority(u)
    port = F.regexp_extract(a, r":([^:]*)$", 1)
    number = F.try_to_number(port, F.lit("99999"))
    checked = F.when(F.startswith(a, F.lit("[")) | ~F.contains(a, F.lit(":")), True).otherwise(F.when(port.rlike(r"^[0-9]{1,5}$"), number.between(1, 65535)).otherwise(False))
    return F.coalesce(is_valid(u) & checked, F.lit(False))


def publication_name(u: Column) -> Column:
    """First label of the host, hyphens and underscores as spaces, title case."""
    label = F.substring_index(host(u), ".", 1)
    return F.when(label == "", "Publication").otherwise(F.initcap(F.translate(label, "-_", "  ")))


def base(u: Column) -> Column:
    return F.concat(F.regexp_extract(u, r"^([^:/?#]+://[^/?#]*)", 1), F.lit("/"))


def resolved(u: Column, against: Column) -> Column:
    """A link against the page that has it: absolute, scheme-relative, rooted, a query alone, or relative to the folder; . and .. are followed."""
    origin = F.regexp_extract(against, r"^([^:/?#]+://[^/?#]*)", 1)
    path = F.regexp_extract(against, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, "^(.*/)", 1)
    joined = F.when(F.startswith(u, F.lit("/")), u).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), u))
    place, rest = F.regexp_extract(joined, "^([^?#]*)", 1), F.regexp_extract(joined, r"^[^?#]*(.*)$", 1)
    up = lambda done: F.slice(done, 1, F.greatest(F.lit(1), F.size(done) - 1))
    parts = F.aggregate(F.split(place, "/"), F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    # a last . or .. leaves its folder open
    clean = F.when(F.contains(place, F.lit("/.")), F.concat(F.array_join(parts, "/"), F.when(place.rlike(r"/\.{1,2}$"), "/").otherwise(""))).otherwise(place)
    whole = F.when(u == "", against).when(F.startswith(u, F.lit("#")), F.concat(F.regexp_replace(against, "#.*$", ""), u)).when(F.startswith(u, F.lit("?")), F.concat(origin, path, u)).otherwise(F.concat(origin, clean, rest))
    return F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(F.startswith(u, F.lit("//")), F.concat(F.regexp_extract(against, "^([^:]+:)", 1), u)).otherwise(whole)


def is_relevant(u: Column, blocked_hosts: Sequence[str] = BLOCKED_HOSTS, section_pages: Sequence[str] = SECTION_PAGES, blocked_paths: Sequence[str] = BLOCKED_PATHS, own_paths: Column | None = None, keywords: Sequence[str] | None = None) -> Column:
    """Not a blocked host, section page or path (nor one of the publication's own); with keywords, one must be in the url."""
    from gleanery.functions.text import contains_any

    low = F.regexp_replace(F.lower(u), "/+$", "")
    ok = ~contains_any(authority(low), blocked_hosts) & ~contains_any(low, blocked_paths)
    if section_pages:
        ok = ok & ~low.isin(*section_pages)
    if own_paths is not None:
        ok = ok & ~F.exists(F.coalesce(own_paths, F.array().cast("array<string>")), lambda t: F.contains(low, t))
    return ok & contains_any(low, [k.lower() for k in keywords]) if keywords is not None else ok


def own_paths(publication: Column, paths: Mapping[str, Sequence[str]] = OWN_PATHS) -> Column:
    """The path fragments that a publication's articles don't have; null for publications without."""
    out = F.lit(None).cast("array<string>")
    for name, fragments in paths.items():
        out = F.when(publication == name, F.array(*map(F.lit, fragments))).otherwise(out)
    return out
