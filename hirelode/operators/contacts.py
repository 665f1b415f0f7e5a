"""Addresses on pages, and the contacts of a website.

Addresses are extracted before any shuffle: what travels is an address, not a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelode.functions.emails import find_emails, mailto_address, normalize_email, screened
from hirelode.operators.dedup import new_domains
from hirelode.operators.pages import anchors_of, page_text, without_scripts


def page_emails(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per page and screened address; the page source is gone after this step.

    Addresses come from the source, the visible text and the mailto links.
    """
    kept = [c for c in pages.columns if c != html]
    # Each step reads the one before several times, so the steps are columns of their own.
    shown = pages.withColumn("_shown", without_scripts(html)).withColumn("_text", page_text("_shown"))
    none = F.array().cast("array<string>")
    # The page holds no mailto link unless the word occurs.
    links = F.when(F.col(html).rlike("(?i)mailto"), anchors_of("_shown"))
    mailto = F.array_compact(F.transform(links, lambda a: mailto_address(a["href"])))
    raw = F.concat(find_emails(html), find_emails("_text"), F.coalesce(mailto, none))
    return shown.select(*kept, F.explode(screened(F.array_distinct(raw))).alias("email"))


def text_emails(texts: DataFrame, text: str) -> DataFrame:
    """The same for plain text."""
    kept = [c for c in texts.columns if c != text]
    return texts.select(*kept, F.explode(screened(find_emails(text))).alias("email"))


def first_hit_page(emails: DataFrame, website: str = "website", rank: str = "rank") -> DataFrame:
    """Addresses of the first ranked page of each website that has any.

    Duplicates collapse first and the best rank is a combining aggregate. Joining on website and
    rank leaves the addresses of one page per key, and both sides are plain shuffles, which the
    adaptive skew join can split.
    """
    distinct = emails.select(website, rank, "email").distinct()
    best = distinct.groupBy(website).agg(F.min(rank).alias(rank))
    return distinct.join(best, [website, rank]).select(website, rank, "email")


def website_contacts(listings: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """contacts(domain, email) of the websites not known yet.

    `found(domain, rank, email)` holds the addresses on the pages of a website: rank 0 is the
    homepage, 1 and up its ranked subpages. Contacts are those of the homepage and of the first
    subpage with a hit; both parts combine before they are shuffled.
    """
    fresh = new_domains(listings, known).filter(F.col("domain").isNotNull()).select("domain")
    wanted = found.select("domain", "rank", "email").join(fresh, "domain", "left_semi")
    home = wanted.filter("rank = 0").select("domain", "email")
    sub = first_hit_page(wanted.filter("rank > 0"), "domain").select("domain", "email")
    return home.unionByName(sub).distinct()


def tracked_websites(contacts_listings: DataFrame, known: DataFrame) -> DataFrame:
    """Known domains together with those of the listings."""
    seen = contacts_listings.filter(F.col("domain").isNotNull()).select("domain")
    return known.select("domain").unionByName(seen).distinct()


def tracked_emails(contacts: DataFrame, known: DataFrame) -> DataFrame:
    """Known addresses together with the new ones, screened again."""
    both = known.select("email").unionByName(contacts.select("email"))
    return both.select(normalize_email("email").alias("email")).filter("email IS NOT NULL").distinct()
