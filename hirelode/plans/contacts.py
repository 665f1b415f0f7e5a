"""Website contacts from listings and stored pages, as one plan with one write at the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions.text import non_blank
from hirelode.functions.urls import canonical_url, url_domain, website_of
from hirelode.operators.contacts import page_emails, website_contacts
from hirelode.operators.pages import page_links, rank_relevant_pages


def with_website(listings: DataFrame) -> DataFrame:
    """Add website and domain; both are null for a listing without a link."""
    website = listings.withColumn("website", non_blank(website_of("raw_url")))
    return website.withColumn("domain", url_domain("website"))


def contacts_of(
    listings: DataFrame,
    pages: DataFrame,
    known: DataFrame,
    k: int = rules.MAX_RELEVANT_PAGES,
    keywords: Sequence[str] = rules.PAGE_KEYWORDS,
    tiers: Sequence[tuple[int, Sequence[str]]] = rules.PAGE_TIERS,
) -> DataFrame:
    """contacts(domain, email) of new websites.

    A stored page is a homepage if a listing names its URL. The ranked subpages are those its
    links lead to. Patterns run on homepages for links, and on homepages and ranked subpages for
    addresses: all other pages go first, by joins on their address alone.
    """
    sites = with_website(listings)
    homes = (
        sites.filter(F.col("domain").isNotNull())
        .select(canonical_url("website").alias("page_url"), "domain")
        .distinct()
    )
    located = pages.withColumn("page_url", canonical_url("url"))
    linked = page_links(located.join(homes, "page_url"), "domain")
    links = linked.select("domain", "url", "href", "text").distinct()
    ranked = rank_relevant_pages(links, k, keywords, tiers, website="domain")
    wanted = homes.withColumn("rank", F.lit(0)).unionByName(
        ranked.select("page_url", "domain", "rank")
    )
    read = located.join(wanted.select("page_url").distinct(), "page_url", "left_semi")
    emails = page_emails(read).select("page_url", "email").distinct()
    return website_contacts(sites, emails.join(wanted, "page_url"), known)
