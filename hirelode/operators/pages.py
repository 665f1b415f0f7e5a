"""Stored pages to relations: anchors, visible text, ranked subpages, profile links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions.text import (
    col,
    contains_any,
    contains_whole_word,
    let,
    text_or_blank,
    unescape_html,
    utrim,
)
from hirelode.functions.urls import (
    canonical_url,
    clean_url,
    is_redirect,
    resolve_url,
    url_domain,
    url_path,
)
from hirelode.operators.dedup import top_k_per_group, unseen
from hirelode.operators.order import previous_value

COMMENTS = r"(?s)<!--.*?(?:-->|\z)"
SCRIPTS = r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)"
UNSHOWN = r"(?is)<(noscript|template)\b.*?(?:</\1\s*>|\z)"
# What stands in these is text, whatever it looks like.
TEXT_ELEMENTS = r"(?is)<(textarea|title)\b.*?(?:</\1\s*>|\z)"
HEAD = r"(?is)<head\b.*?(?:</head\s*>|\z)"
ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
# An anchor ends at its closing tag, at the next anchor or with the page.
ANCHOR = rf"(?is)(<a\s{ATTRIBUTES}>.*?(?=</a\s*>|<a\s|\z))"
# The attributes before href are stepped over whole, so that "data-href" is not mistaken for it.
HREF = (
    r"""(?is)^<a(?:[\s/]*+(?!href\s*=)[^\s=>"'/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+"""
    r"""[\s/]*+href\s*=\s*"""
)
BLOCK_TAGS = (
    r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li"
    r"|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>"
)


def without_scripts(html: Column | str) -> Column:
    """Page source without comments, scripts and styles: all that can hold an anchor."""
    return F.regexp_replace(F.regexp_replace(col(html), COMMENTS, ""), SCRIPTS, "")


def page_text(shown: Column | str) -> Column:
    """Visible text of a page `without_scripts`; what a browser does not show goes as well.

    Block elements end a line, inline elements leave no trace.
    """
    body = F.regexp_replace(F.regexp_replace(col(shown), UNSHOWN, ""), HEAD, "")
    lines = F.regexp_replace(body, BLOCK_TAGS, "\n")
    return unescape_html(F.regexp_replace(lines, "<[^>]*>", ""))


def _href(tag: Column) -> Column:
    quoted = F.regexp_extract(tag, HREF + '"([^"]*)"', 1)
    single = F.regexp_extract(tag, HREF + "'([^']*)'", 1)
    bare = F.regexp_extract(tag, HREF + r"""([^\s"'>]+)""", 1)
    return F.coalesce(*[F.nullif(part, F.lit("")) for part in (quoted, single, bare)], F.lit(""))


def visible_text(html: Column | str) -> Column:
    return page_text(without_scripts(html))


def anchors(html: Column | str) -> Column:
    """array<struct(href, text)> of the anchors that have an href, in page order."""
    return anchors_of(without_scripts(html))


def anchors_of(shown: Column | str) -> Column:
    tags = F.regexp_extract_all(F.regexp_replace(col(shown), TEXT_ELEMENTS, ""), F.lit(ANCHOR))
    linked = F.filter(tags, lambda t: t.rlike(HREF))

    def link(tag: Column) -> Column:
        inner = F.regexp_replace(tag, rf"(?is)^<a\s{ATTRIBUTES}>", "")
        # Each piece of text is trimmed by itself, and the pieces are joined without a blank.
        joined = F.regexp_replace(inner, r"(?Us)\s*<[^>]*>\s*", "")
        return F.struct(
            unescape_html(_href(tag)).alias("href"),
            utrim(unescape_html(utrim(joined))).alias("text"),
        )

    return F.transform(linked, link)


def page_links(pages: DataFrame, *keep: str) -> DataFrame:
    """links(page_id, url, pos, href, text): one row per anchor."""
    columns = ["page_id", "url", *keep]
    return pages.select(*columns, F.posexplode(anchors("html")).alias("pos", "link")).select(
        *columns, "pos", F.col("link.href").alias("href"), F.col("link.text").alias("text")
    )


def is_sponsored(
    *texts: Column | str,
    words: Sequence[str] = rules.SPONSORED_WORDS,
    whole_word: bool = False,
) -> Column:
    """Any marker word in the card texts; as a substring unless `whole_word`."""
    joined = F.lower(F.concat_ws(" ", *[text_or_blank(t) for t in texts]))
    if whole_word:
        return contains_whole_word(joined, *words)
    return contains_any(joined, words)


def is_sponsored_page(html: Column | str, word: str = rules.PAGE_SPONSORED_WORD) -> Column:
    return F.lower(col(html)).contains(word)


def page_score(
    path: Column,
    tiers: Sequence[tuple[int, Sequence[str]]] = rules.PAGE_TIERS,
    shallow_points: int = rules.SHALLOW_POINTS,
    shallow_slashes: int = rules.SHALLOW_SLASHES,
) -> Column:
    """Sum of the points of every tier the path falls in, plus points for a shallow path."""

    def points(where: Column) -> Column:
        score = F.when(F.regexp_count(where, F.lit("/")) <= shallow_slashes, shallow_points)
        score = score.otherwise(0)
        for worth, words in tiers:
            score = score + F.when(contains_any(where, words), worth).otherwise(0)
        return score

    return let(path, points)


def best_score_per_url(links: DataFrame, *group: str) -> DataFrame:
    return links.groupBy(*group).agg(F.max("score").alias("score"))


def rank_relevant_pages(
    links: DataFrame,
    k: int = rules.MAX_RELEVANT_PAGES,
    keywords: Sequence[str] = rules.PAGE_KEYWORDS,
    tiers: Sequence[tuple[int, Sequence[str]]] = rules.PAGE_TIERS,
    website: str = "website",
    base: str = "url",
) -> DataFrame:
    """Best `k` subpages per website: (website, page_url, score, rank).

    Candidates are links on the same domain with a keyword in address or text.
    """
    wanted = contains_any(F.lower("href"), keywords) | contains_any(F.lower("text"), keywords)
    resolved = links.filter(wanted).withColumn("_target", resolve_url(base, "href"))
    scored = resolved.filter(
        F.col("_target").isNotNull()
        & (url_domain("_target", lower=True) == url_domain(base, lower=True))
    ).select(
        website,
        canonical_url("_target").alias("page_url"),
        page_score(F.lower(url_path("_target")), tiers).alias("score"),
    )
    best = best_score_per_url(scored, website, "page_url")
    order = [F.col("score").desc(), F.length(url_path("page_url")), F.col("page_url")]
    return top_k_per_group(best, [website], order, k)


def repeated_redirect(
    listings: DataFrame, group: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Flag a redirect link equal to the last link seen in the same search."""
    shown = listings.withColumn("_seen", F.nullif(F.col("raw_url"), F.lit("")))
    previous = previous_value(shown, group, order, "_seen", "previous_url")
    repeated = is_redirect("raw_url") & (F.col("raw_url") == F.col("previous_url"))
    return previous.withColumn("repeated", F.coalesce(repeated, F.lit(False))).drop("_seen")


def profile_urls(links: DataFrame, marker: str = rules.PROFILE_MARKER) -> DataFrame:
    """Distinct cleaned profile addresses among the links."""
    cleaned = clean_url("href", strip_slash=True)
    return (
        links.select(cleaned.alias("profile_url"))
        .filter(F.col("profile_url").contains(marker))
        .distinct()
    )


def harvest_profiles(
    links: DataFrame, seen: DataFrame, marker: str = rules.PROFILE_MARKER
) -> DataFrame:
    """Profile addresses not seen before, sorted."""
    found = profile_urls(links, marker)
    return unseen(found, seen, "profile_url", unique=True).orderBy("profile_url")
