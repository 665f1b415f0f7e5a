"""URL helpers. `parse_url` raises on bad input and loses the port, hence the patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions.text import col, contains_any, form_encode, non_blank, unquote

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def clean_url(url: Column | str, strip_slash: bool = False) -> Column:
    """The URL up to the first "?"."""
    cleaned = F.substring_index(col(url), "?", 1)
    return F.rtrim(cleaned, F.lit("/")) if strip_slash else cleaned


def url_domain(url: Column | str, lower: bool = False) -> Column:
    """Authority with its port, without a leading "www."."""
    authority = F.regexp_extract(col(url), AUTHORITY, 1)
    return F.regexp_replace(F.lower(authority) if lower else authority, r"^www\.", "")


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), SCHEME, 1))


def url_path(url: Column | str) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(col(url), PATH, 1), ";[^/]*$", "")


def canonical_url(url: Column | str) -> Column:
    """Scheme, authority and path; no trailing slash."""
    authority = F.regexp_extract(col(url), AUTHORITY, 1)
    return F.rtrim(F.concat(url_scheme(url), F.lit("://"), authority, url_path(url)), F.lit("/"))


def _without_dots(path: Column) -> Column:
    """Resolve "." and ".." segments of a rooted path."""
    segments = F.split(path, "/")
    kept = F.reduce(
        segments,
        F.array().cast("array<string>"),
        lambda done, part: F.when(
            part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    folder = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    resolved = F.regexp_replace(F.concat(F.array_join(kept, "/"), folder), "^(?!/)", "/")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), resolved).otherwise(path)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """`href` as an absolute URL seen from the page at `base`; null unless http or https."""
    base = col(base)
    ref = F.btrim(F.translate(col(href), "\t\r\n", ""))
    ref_scheme, base_scheme = url_scheme(ref), url_scheme(base)
    origin = F.concat(base_scheme, F.lit("://"), F.regexp_extract(base, AUTHORITY, 1))
    base_path = F.regexp_extract(base, PATH, 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    rest = F.regexp_extract(ref, r"^[^?#]*([?#].*)?$", 1)
    base_query = F.when(base.rlike(QUERY), F.concat(F.lit("?"), F.regexp_extract(base, QUERY, 1)))

    # A path relative to the folder of the base; doubled slashes collapse, as in a rooted path
    # they do not.
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    joined = F.concat(F.lit("/"), folder, ref_path)
    relative = _without_dots(F.regexp_replace(joined, "/{2,}", "/"))
    resolved = (
        F.when(ref_scheme.isin("http", "https"), F.regexp_replace(ref, "^[A-Za-z]+", ref_scheme))
        .when(ref_scheme != "", F.lit(None))
        .when(ref.startswith("//"), F.concat(base_scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, _without_dots(ref_path), rest))
        .when(
            ref_path == "",
            F.concat(
                origin,
                base_path,
                F.when(rest.startswith("?"), F.lit("")).otherwise(F.coalesce(base_query, F.lit(""))),
                rest,
            ),
        )
        .otherwise(F.concat(origin, relative, rest))
    )
    return F.when(url_scheme(resolved).isin("http", "https"), resolved)


def is_redirect(url: Column | str, markers: Sequence[str] = rules.REDIRECT_MARKERS) -> Column:
    return contains_any(url, markers)


def redirect_target(url: Column | str) -> Column:
    """Decoded target a redirect URL carries; null when only a visit could tell."""
    raw = F.regexp_extract(col(url), r"[?&]adurl=([^&#]+)", 1)
    spaced = F.replace(raw, F.lit("+"), F.lit(" "))
    return F.when(is_redirect(url), non_blank(unquote(spaced)))


def website_of(raw_url: Column | str) -> Column:
    """Website behind a listing link: the redirect target if it is one, without the query."""
    raw = non_blank(raw_url)
    return F.when(is_redirect(raw), clean_url(redirect_target(raw))).otherwise(clean_url(raw))


def place_token(url: Column | str) -> Column:
    """The "!1s" segment of a map listing URL."""
    return F.nullif(F.regexp_extract(unquote(url), r"!1s([^!]+)", 1), F.lit(""))


def search_url(
    keyword: Column | str,
    location: str = rules.SEARCH_LOCATION,
    age: str = rules.SEARCH_AGE,
    job_type: str | None = rules.SEARCH_JOB_TYPE,
    endpoint: str = rules.SEARCH_ENDPOINT,
) -> Column:
    fields = [("keywords", col(keyword)), ("location", F.lit(location)), ("f_TPR", F.lit(age))]
    if job_type:
        fields.append(("f_JT", F.lit(job_type)))
    pairs = [F.concat(F.lit(f"{name}="), form_encode(value)) for name, value in fields]
    return F.concat(F.lit(endpoint), F.concat_ws("&", *pairs))


def careers_query(company: Column | str) -> Column:
    return F.concat(col(company), F.lit(" careers jobs Germany"))
