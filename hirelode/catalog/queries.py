"""One registered query per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.catalog import fixtures as fx
from hirelode.functions import classify, emails, text, urls
from hirelode.operators import contacts, dedup, joins, matching, order, pages, ranking, report, rule_tables, strict_pages
from hirelode.plans import contacts as contacts_plan
from hirelode.plans import triage as triage_plan
from hirelode.session import materialize, scratch_path
from hirelode.sources import keyed
from hirelode.sources import keys as key_files
from hirelode.sources import rows as row_files
from hirelode.sources import runs as run_files
from hirelode.streaming import dedup as stream_ops
from hirelode.streaming import triage as stream_runs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def minutes(column: str):
    return F.date_format(column, rules.SCRAPED_FORMAT)


# --- whole runs --------------------------------------------------------------


def triaged(spark: SparkSession, sf: str) -> DataFrame:
    return triage_plan.triage(fx.new_postings(spark, sf), fx.history(spark, sf))


@query
def triage_zone_breakdown(spark, sf):
    return report.zone_breakdown(triaged(spark, sf))


@query
def triage_postings(spark, sf):
    return triaged(spark, sf).select(
        "posting_id", minutes("scraped_at").alias("scraped"), "keyword", "title", "company",
        "location", "location_zone", "apply_link", F.concat_ws(", ", "skills").alias("skills"),
        "german_level", "relevance_score", "relevance",
    )


@query
def triage_first_generation(spark, sf):
    fresh = triage_plan.triage_v1(fx.new_postings(spark, sf), fx.history(spark, sf))
    return fresh.select("posting_id", "apply_link", "title", "location", "relevance")


@query
def posting_rows(spark, sf):
    return triage_plan.to_posting_rows(triaged(spark, sf))


@query
def published_rows(spark, sf):
    graded = triage_plan.classify(triage_plan.clean_postings(fx.postings(spark, sf)))
    kept = "posting_id", "is_history"
    rows = triage_plan.to_posting_rows(graded, kept).withColumnRenamed("posting_id", "pos")
    zone = F.when(F.col("pos") % 2 == 0, "").otherwise(F.col("Location_Zone"))
    new = triage_plan.publish(
        rows.filter("NOT is_history").withColumn("Location_Zone", zone), rows.filter("is_history")
    )
    return new.select(
        "pos", F.col("Apply Link").alias("link"), F.col("Location_Zone").alias("zone")
    )


@query
def published_rows_v1(spark, sf):
    """The first generation's layout: fewer columns, the link at another place, some rows without one."""
    cleaned = fx.postings(spark, sf).withColumn("apply_link", urls.clean_url("apply_link"))
    labelled = triage_plan.with_relevance(cleaned)
    rows = triage_plan.to_posting_rows(labelled, ("posting_id", "is_history"), rules.POSTING_FIELDS_V1)
    rows = rows.withColumnRenamed("posting_id", "pos")
    new = triage_plan.publish(
        rows.filter("NOT is_history"), rows.filter("is_history"), rules.POSTING_FIELDS_V1
    )
    return new.select("pos", F.col("Apply Link").alias("link"), F.col("Relevance").alias("relevance"))


# --- A: files ----------------------------------------------------------------


def padded_lines(recipients: DataFrame) -> DataFrame:
    """Recipients as untidy lines: every seventh is blank, the others have outer blanks."""
    return recipients.select(
        F.when(F.col("pos") % 7 == 0, "   ")
        .otherwise(F.concat(F.lit("  "), "email", F.lit("\t")))
        .alias("value")
    )


@query
def read_keys(spark, sf):
    path = scratch_path(spark, "keys")
    padded_lines(fx.recipients(spark, sf)).write.text(path)
    return key_files.read_keys(spark, path)


@query
def read_keys_lower(spark, sf):
    path = scratch_path(spark, "keys")
    padded_lines(fx.recipients(spark, sf)).write.text(path)
    return key_files.read_keys(spark, path, lower=True)


@query
def read_recipients(spark, sf):
    path = scratch_path(spark, "recipients")
    padded_lines(fx.recipients(spark, sf).orderBy("pos")).write.text(path)
    read = key_files.read_recipients(spark, path)
    return order.global_rank(read, ["pos"], "position").select("position", "email")


@query
def read_clean_emails(spark, sf):
    path = scratch_path(spark, "emails")
    fx.raw_emails(spark, sf).select("value").write.text(path)
    return key_files.read_clean_emails(spark, path)


@query
def read_rows(spark, sf):
    path = scratch_path(spark, "rows")
    described = F.concat(F.col("title"), F.lit(' "quoted"\nsecond line, '), F.col("description"))
    source = fx.postings(spark, sf).select(
        F.col("posting_id").cast("string").alias("Keyword"),
        described.alias("Job Title"),
        F.nullif("location", F.lit("")).alias("Location"),
    )
    row_files.write_rows(source, path)
    back = row_files.read_rows(spark, path)
    return back.select(
        F.col("Keyword").cast("bigint").alias("posting_id"),
        F.col("Job Title").alias("title"),
        text.text_or_blank("Location").alias("location"),
        text.text_or_blank("Company").alias("company"),
    )


@query
def read_history(spark, sf):
    base = scratch_path(spark, "history")
    source = fx.postings(spark, sf).select(
        F.col("posting_id").cast("string").alias("Scraped Date"),
        F.col("time_filter").alias("Time Filter"),
        F.col("keyword").alias("Keyword"),
        F.col("title").alias("Job Title"),
        F.substring_index("apply_link", "?", 1).alias("Apply Link"),
        classify.it_related("title", "keyword").alias("Relevance"),
        "is_history",
    )
    parts = [
        (source.filter("is_history").drop("Time Filter", "Relevance"), "old"),
        (source.filter("NOT is_history"), "new"),
    ]
    paths = []
    for rows, name in parts:
        kept = [c for c in rows.columns if c != "is_history"]
        ordered = rows.orderBy(F.col("Scraped Date").cast("bigint"))
        row_files.write_rows(ordered, f"{base}/{name}", kept)
        paths.append(f"{base}/{name}")
    merged = row_files.read_history(spark, [paths[1], f"{base}/absent", paths[0]])
    # The two rows of a link are neighbours in one file, so the row kept is known as well.
    return merged.select(
        F.col("Scraped Date").cast("bigint").alias("posting_id"),
        F.col("Apply Link").alias("apply_link"),
        F.col("Time Filter").alias("time_filter"),
        F.col("Relevance").alias("relevance"),
        F.col("file").cast("int").alias("file"),
    )


@query
def write_sorted_keys(spark, sf):
    path = scratch_path(spark, "sorted")
    key_files.write_sorted_keys(fx.raw_emails(spark, sf), path, "value", emails=True)
    written = key_files.read_lines(spark, path).select("pos", F.col("value").alias("email"))
    return order.global_rank(written, ["pos"], "position").select("position", "email")


@query
def append_keys(spark, sf):
    path = scratch_path(spark, "log")
    everyone = fx.recipients(spark, sf)
    key_files.append_keys(everyone.filter("pos % 3 = 0"), path, "email", lower=True)
    key_files.append_keys(everyone.filter("pos % 3 = 1"), path, "email", lower=True)
    logged = spark.read.text(path)
    return logged.groupBy(F.col("value").alias("email")).agg(F.count(F.lit(1)).alias("times"))


@query
def write_run(spark, sf):
    path = scratch_path(spark, "runs")
    run_files.write_run(triaged(spark, sf), path, datetime(2026, 4, 1, 9, 30))
    first = spark.read.parquet(path).drop(*run_files.PARTITIONS)
    again = scratch_path(spark, "runs")
    for stamp in (datetime(2026, 4, 1, 9, 30), datetime(2026, 4, 2, 18, 5)) * 2:
        run_files.write_run(first, again, stamp)
    written = run_files.read_runs(spark, again)
    return written.select(*run_files.PARTITIONS, "posting_id", "relevance_score")


def order_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Postings as written runs: a day per order year, a time per keyword and page."""
    path = scratch_path(spark, "runs")
    rows = fx.postings(spark, sf).select(
        "posting_id",
        F.date_format("scraped_at", "yyyy").alias("run_day"),
        F.concat(F.lit("0"), "keyword_idx", F.lit("-0"), "page_num").alias("run_time"),
        classify.it_related("title", "keyword").alias("relevance"),
    )
    split = rows.withColumn("relevance_split", run_files.split_of())
    split.write.partitionBy(*run_files.PARTITIONS).parquet(path)
    return run_files.read_runs(spark, path)


@query
def latest_run(spark, sf):
    return run_files.latest_run(order_runs(spark, sf), "1998")


@query
def latest_run_fallback(spark, sf):
    some = order_runs(spark, sf).filter("relevance_split = 'relevant' OR run_day <> '1998'")
    found = run_files.latest_run(some, "1998")
    return found.select("posting_id", "relevance_split", "run_time")


# --- B: pages and URLs -------------------------------------------------------


@query
def page_links(spark, sf):
    return pages.page_links(fx.table(spark, sf, "pages")).drop("url")


@query
def page_links_strict(spark, sf):
    return strict_pages.page_links_strict(fx.table(spark, sf, "pages")).drop("url")


@query
def website_fallback(spark, sf):
    rows = fx.postings(spark, sf)
    company = F.when(F.col("posting_id") % 3 == 0, "  ").otherwise(F.col("company"))
    panel = F.when(F.col("posting_id") % 2 == 0, F.concat(F.lit(" Panel "), "page_num"))
    both = rows.select("posting_id", company.alias("card"), panel.alias("panel"), "location")
    return both.select(
        "posting_id",
        text.first_non_empty("card", "panel", default="Unknown Company").alias("company"),
        text.first_only("card", "Unknown Company").alias("company_first_only"),
        text.first_non_empty("location", default="Germany").alias("location"),
    )


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs in changing shapes."""
    shaped = fx.pick(
        ("", "?ref=1&x=2", "/", "//?a", "#top", ":8080/p?x", "/a;v=1?q"), "page_id"
    )
    return fx.table(spark, sf, "pages").select(
        "page_id", F.concat("url", shaped).alias("url"), F.col("url").alias("base")
    )


@query
def clean_urls(spark, sf):
    return page_urls(spark, sf).select(
        "page_id",
        urls.clean_url("url").alias("cleaned"),
        urls.clean_url("url", strip_slash=True).alias("stripped"),
    )


@query
def url_domains(spark, sf):
    authority = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    shaped = F.regexp_replace(
        "url",
        "^https?://[^/?#]*",
        F.concat(fx.pick(("https://", "http://WWW.", "https://www.", "//", ""), "page_id"),
                 authority, fx.pick(("", ":8080", "_x"), "page_id")),
    )
    return fx.table(spark, sf, "pages").select("page_id", shaped.alias("url")).select(
        "page_id",
        urls.url_domain("url").alias("domain"),
        urls.url_domain("url", lower=True).alias("domain_lower"),
    )


HREFS = (
    "/root/x", "sub/page", "../up", "./here", "?q=1", "#frag", "//cdn.example.org/y",
    "mailto:a@b.de", "tel:123", "HTTPS://Other.example/Z?x=1", "a/../b/./c", "/a/../../b/",
    "javascript:void(0)", "", "x//y", "..",
)


@query
def resolved_links(spark, sf):
    rows = fx.table(spark, sf, "pages").select("page_id", "url", fx.pick(HREFS, "page_id").alias("href"))
    return rows.select("page_id", urls.resolve_url("url", "href").alias("target"))


def listing_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Listing links: plain ones, redirects with and without a target, map places."""
    escaped = F.concat(F.lit("https%3A%2F%2F"), F.lit("site"), "page_id", F.lit(".org%2Fa%20b"))
    redirect = F.concat(F.lit("https://www.google.com/aclk?sa=l&adurl="), escaped, F.lit("%3Fx%3D1&z=2"))
    place = F.concat(F.lit("https://maps.example.org/place/data=!4m7!1s0x"), F.hex("page_id"),
                     F.lit("%3A0x1+2!8m2"))
    kind = F.col("page_id") % 5
    return fx.table(spark, sf, "pages").select(
        "page_id",
        F.when(kind == 0, redirect)
        .when(kind == 1, F.concat(F.lit("https://www.google.com/url?q="), "page_id"))
        .when(kind == 2, place)
        .when(kind == 3, F.concat(F.lit("https://www.google.com/url?adurl=bad+%zz&n="), "page_id"))
        .otherwise(F.concat("url", F.lit("?utm=1")))
        .alias("raw_url"),
    )


@query
def redirect_targets(spark, sf):
    return listing_urls(spark, sf).select(
        "page_id",
        urls.is_redirect("raw_url").alias("redirect"),
        urls.redirect_target("raw_url").alias("target"),
        urls.website_of("raw_url").alias("website"),
    )


@query
def place_tokens(spark, sf):
    return listing_urls(spark, sf).select("page_id", urls.place_token("raw_url").alias("token"))


@query
def sponsored_listings(spark, sf):
    return fx.listings(spark, sf).select(
        "listing_idx",
        pages.is_sponsored("card_text").alias("sponsored"),
        pages.is_sponsored("card_text", whole_word=True).alias("sponsored_word"),
    )


@query
def sponsored_pages(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id",
        pages.is_sponsored_page("html").alias("sponsored"),
        pages.is_sponsored_page("html", "anan").alias("marked"),
    )


def host_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every page of a host as a link on its homepage."""
    every = fx.table(spark, sf, "pages").select(
        "page_id", F.col("url").alias("href"), F.lit("").alias("text"),
        urls.url_domain("url").alias("domain"),
    )
    homes = fx.hosts(spark, sf)
    linked = every.join(homes, "domain")
    return linked.filter("page_id <> home_id").select(
        "domain", F.col("home_url").alias("url"), "href", "text"
    )


def ranked_host_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.rank_relevant_pages(
        host_links(spark, sf), keywords=fx.PAGE_WORDS + ("/",), tiers=fx.PAGE_POINTS, website="domain"
    )


@query
def ranked_subpages(spark, sf):
    links = pages.page_links(fx.table(spark, sf, "pages"))
    located = links.withColumn("domain", urls.url_domain("url"))
    ranked = pages.rank_relevant_pages(
        located, keywords=fx.PAGE_WORDS, tiers=fx.PAGE_POINTS, website="domain"
    )
    return ranked.withColumn("score", F.col("score").cast("int"))


@query
def ranked_host_subpages(spark, sf):
    return ranked_host_pages(spark, sf)


@query
def best_score_per_url(spark, sf):
    links = pages.page_links(fx.table(spark, sf, "pages"))
    scored = links.select(
        F.col("href").alias("page_url"), pages.page_score(F.lower("href"), fx.PAGE_POINTS).alias("score")
    )
    return pages.best_score_per_url(scored, "page_url")


def site_emails(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.page_emails(fx.pages_with_addresses(spark, sf))


@query
def page_addresses(spark, sf):
    return site_emails(spark, sf).drop("url")


@query
def document_addresses(spark, sf):
    documents = fx.table(spark, sf, "documents").select("doc_id", "text")
    return contacts.text_emails(documents, "text")


@query
def found_addresses(spark, sf):
    rows = fx.raw_emails(spark, sf)
    line = F.concat(F.lit("Write to "), "value", F.lit(", or call <b>"), "website", F.lit("</b>"))
    return rows.select("email_id", F.explode(emails.find_emails(line)).alias("email"))


@query
def mailto_addresses(spark, sf):
    scheme = fx.pick(("mailto:", "MAILTO:", "http:", "MailTo: "), "email_id")
    href = F.concat(scheme, F.replace("value", F.lit("@"), F.lit("%40")), F.lit("?subject=a@b.de"))
    return fx.raw_emails(spark, sf).select(
        "email_id", emails.mailto_address(href).alias("email")
    ).filter("email IS NOT NULL")


@query
def asset_addresses(spark, sf):
    shaped = F.concat(
        fx.pick(("0123456789abcdef01@sentry.io", "x@domain.com", "Y@Example.com", "a@b.PNG",
                 "ok@firma.org", "z@cdn.jpeg"), "email_id"),
        F.when(F.col("email_id") % 4 == 0, ".x").otherwise(""),
    )
    return fx.raw_emails(spark, sf).select("email_id", shaped.alias("email")).select(
        "email_id", "email", emails.is_asset_email("email").alias("asset")
    )


@query
def normalized_emails(spark, sf):
    raw = emails.undo_obfuscation("value")
    return fx.raw_emails(spark, sf).select(
        "email_id", emails.normalize_email(raw).alias("email")
    ).filter("email IS NOT NULL")


@query
def screened_raw_emails(spark, sf):
    shaped = F.concat(fx.pick(("", " ", "http://", "HTTP://", "x/"), "email_id"), "value")
    return fx.raw_emails(spark, sf).select("email_id", emails.normalize_email(shaped).alias("email"))


@query
def first_hit_pages(spark, sf):
    screened = fx.raw_emails(spark, sf).withColumn(
        "email", emails.normalize_email(emails.undo_obfuscation("value"))
    )
    return contacts.first_hit_page(screened.filter("email IS NOT NULL"))


@query
def website_contacts(spark, sf):
    emails = site_emails(spark, sf).withColumn("page_url", urls.canonical_url("url"))
    homes = fx.hosts(spark, sf).select(
        "domain", F.lit(0).alias("rank"), urls.canonical_url("home_url").alias("page_url")
    )
    wanted = homes.unionByName(ranked_host_pages(spark, sf).select("domain", "rank", "page_url"))
    found = emails.select("page_url", "email").distinct().join(wanted, "page_url")
    sites = fx.listings(spark, sf).withColumn("domain", urls.url_domain("raw_url"))
    return contacts.website_contacts(sites, found, fx.known_domains(spark, sf))


@query
def site_contacts(spark, sf):
    # Written first, as collected pages are: else every step would derive the addresses again.
    sites = materialize(fx.site_listings(spark, sf))
    known = sites.filter("listing_idx % 35 = 0").select(urls.url_domain("raw_url").alias("domain"))
    return contacts_plan.contacts_of(sites, materialize(fx.site_pages(spark, sf)), known)


@query
def tracked_websites(spark, sf):
    sites = fx.listings(spark, sf).withColumn("domain", urls.url_domain("raw_url"))
    known = fx.known_domains(spark, sf)
    gone = known.select(F.concat(F.lit("gone."), "domain").alias("domain"))
    return contacts.tracked_websites(sites, known.union(gone))


@query
def tracked_emails(spark, sf):
    raw = fx.raw_emails(spark, sf)
    new = raw.select(emails.undo_obfuscation("value").alias("email"), "email_id")
    untidy = F.concat(F.lit("HTTP://old."), emails.undo_obfuscation("value"), F.lit(" ")).alias("email")
    known = raw.filter("email_id % 5 = 0").select(untidy)
    return contacts.tracked_emails(new.filter("email_id % 5 > 0"), known)


@query
def repeated_redirects(spark, sf):
    rows = fx.search_listings(spark, sf)
    flagged = pages.repeated_redirect(rows, ["user_id"], ["ts", "event_id"])
    return flagged.select("event_id", "user_id", "raw_url", "repeated")


@query
def harvested_profiles(spark, sf):
    links = pages.page_links(fx.table(spark, sf, "pages"))
    known = fx.table(spark, sf, "pages").select(
        F.concat(F.lit("/d"), F.regexp_extract("html", '<a href="/d([^"?]*)"', 1)).alias("profile_url")
    ).filter(F.col("profile_url").endswith("n"))
    return order.numbered(pages.harvest_profiles(links, known, "/d"))


# --- C: text and rules -------------------------------------------------------


@query
def folded_text(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.fold_umlauts("text").alias("folded"))


@query
def location_zones(spark, sf):
    return fx.postings(spark, sf).select(
        "posting_id", "location", classify.location_zone("location").alias("zone"),
        classify.location_zone("location", whole_word=True).alias("zone_word"),
    )


@query
def zones_by_table(spark, sf):
    rows = fx.postings(spark, sf).select("posting_id", "location")
    places = rows.select(F.col("location").alias("key"), text.fold_umlauts("location").alias("text")).distinct()
    zones = rule_tables.first_labels(places, rule_tables.place_rules(spark, rules.ZONE_TIERS), rules.ZONE_DEFAULT)
    return rows.join(zones, F.col("location").eqNullSafe(F.col("key"))).select(
        "posting_id", "location", F.col("label").alias("zone")
    )


@query
def skills_by_table(spark, sf):
    read = F.lower(text.text_or_blank("description")).alias("text")
    texts = fx.postings(spark, sf).select(F.col("posting_id").alias("key"), read)
    dictionary = rule_tables.skill_rules(spark, rules.CORE_SKILLS + rules.SUPPORTING_SKILLS)
    return rule_tables.all_labels(texts, dictionary).select(
        F.col("key").alias("posting_id"), F.concat_ws(", ", "labels").alias("skills"), F.size("labels").alias("n_skills")
    )


@query
def region_filter(spark, sf):
    kept = fx.postings(spark, sf).filter(classify.is_in_region("location"))
    return kept.select("posting_id", "location")


@query
def extracted_skills(spark, sf):
    skills = classify.extract_skills("description")
    return fx.postings(spark, sf).select(
        "posting_id", F.concat_ws(", ", skills).alias("skills"), F.size(skills).alias("n_skills")
    )


@query
def german_levels(spark, sf):
    return fx.postings(spark, sf).select(
        "posting_id", classify.german_level("description").alias("german_level")
    )


@query
def relevance_labels(spark, sf):
    graded = classify.relevance("title", "description")
    return fx.postings(spark, sf).select(
        "posting_id", graded["label"].alias("relevance"), graded["score"].alias("score")
    )


@query
def document_skills(spark, sf):
    skills = classify.extract_skills("text")
    tagged = fx.table(spark, sf, "documents").select(
        "doc_id", F.concat_ws(", ", skills).alias("skills"),
        classify.german_level("text").alias("german_level"),
    )
    return tagged


@query
def kept_titles(spark, sf):
    return fx.postings(spark, sf).filter(classify.keep_title("title")).select("posting_id", "title")


@query
def it_related(spark, sf):
    return fx.postings(spark, sf).select(
        "posting_id", classify.it_related("title", "keyword").alias("relevance")
    )


@query
def whole_words(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        text.contains_whole_word(F.lower("text"), "the").alias("has_the"),
        text.contains_whole_word(F.lower("text"), "ai").alias("has_ai"),
        text.contains_whole_word(F.lower("text"), "für").alias("has_fuer"),
    )


@query
def relabelled_history(spark, sf):
    rows = fx.postings(spark, sf)
    old = rows.filter("is_history").withColumn("relevance", F.lit("unknown"))
    merged = dedup.merge_history(rows.filter("NOT is_history"), old)
    return triage_plan.with_relevance(merged).select("posting_id", "generation", "relevance")


def _keywords_of(mode: str) -> Query:
    return lambda spark, sf: dedup.unique_keywords(fx.keywords(spark, sf), mode)


REGISTRY["keywords_data"] = _keywords_of("data")
REGISTRY["keywords_devops"] = _keywords_of("devops")
REGISTRY["keywords_both"] = _keywords_of("both")


@query
def search_keywords(spark, sf):
    """The lists of the first generation, each keyword as often as parts ask for it."""
    return dedup.unique_keywords(fx.search_keywords(spark, sf), "both").select("pos", "keyword", "mode")


@query
def search_urls(spark, sf):
    odd = F.concat("keyword", F.lit(" ~*+&ü/"), "page_num")
    return fx.postings(spark, sf).select(
        "posting_id",
        urls.search_url("keyword").alias("url"),
        urls.search_url(odd, location="Germany", job_type="P").alias("url_v1"),
        urls.careers_query("company").alias("careers_query"),
    )


@query
def parsed_dates(spark, sf):
    stamp = F.col("scraped_at")
    written = fx.pick(("yyyy-MM-dd HH:mm", "yyyy-M-d H:m"), "posting_id")
    shaped = (
        F.when(F.col("posting_id") % 11 == 0, "  ")
        .when(F.col("posting_id") % 13 == 0, F.date_format(stamp, "dd.MM.yyyy"))
        .when(written == "yyyy-MM-dd HH:mm", F.date_format(stamp, "yyyy-MM-dd HH:mm"))
        .otherwise(F.date_format(stamp, "yyyy-M-d H:m"))
    )
    return fx.postings(spark, sf).select(
        "posting_id", F.date_format(classify.parse_scraped(shaped), "yyyy-MM-dd HH:mm").alias("parsed")
    )


FLAGS = ("has_pending", "has_message", "has_connect", "has_follow")


def with_status(spark: SparkSession, sf: str) -> DataFrame:
    status = classify.visit_status(*FLAGS, sent="sent_ok")
    return fx.visits(spark, sf).withColumn("status", status)


@query
def visit_statuses(spark, sf):
    return with_status(spark, sf).select(
        "event_id", "status",
        classify.visit_status(*FLAGS, sent="sent_ok", mode="connect").alias("status_connect"),
        classify.visit_status(*FLAGS, sent="sent_ok", mode="follow").alias("status_follow"),
        classify.visit_status(*FLAGS, mode="connect", states=3).alias("status_three"),
    )


@query
def cleaned_words(spark, sf):
    split = fx.table(spark, sf, "documents").select(
        "doc_id", "text", text.tokens("text").alias("words")
    )
    return split.select(
        "doc_id",
        F.size("words").alias("n_tokens"),
        F.md5(text.clean_text("text")).alias("cleaned"),
        F.md5(F.array_join(F.sort_array("words"), " ")).alias("tokens"),
    )


# --- D: joins ----------------------------------------------------------------


@query
def unseen_postings(spark, sf):
    rows = fx.new_postings(spark, sf).withColumn("apply_link", urls.clean_url("apply_link"))
    return dedup.unseen(rows, fx.history(spark, sf), "apply_link").select("posting_id", "apply_link")


@query
def new_domains(spark, sf):
    sites = fx.listings(spark, sf).select(
        "listing_idx",
        F.when(F.col("listing_idx") % 9 != 0, urls.url_domain("raw_url")).alias("domain"),
    )
    return dedup.new_domains(sites, fx.known_domains(spark, sf))


@query
def pending_recipients(spark, sf):
    return joins.pending_recipients(fx.recipients(spark, sf), fx.sent(spark, sf))


@query
def pending_recipients_distinct(spark, sf):
    return joins.pending_recipients(fx.recipients(spark, sf), fx.sent(spark, sf), distinct=True)


@query
def recipient_counts(spark, sf):
    return joins.recipient_counts(fx.recipients(spark, sf), fx.sent(spark, sf))


@query
def filled_careers(spark, sf):
    filled = joins.fill_from_lookup(fx.companies(spark, sf), fx.careers(spark, sf))
    return filled.withColumnRenamed("Career Page", "career_page")


@query
def prefilled_careers(spark, sf):
    """Fixed pages of two companies go before the lookup."""
    companies = fx.companies(spark, sf)
    name = F.when(F.col("nation").cast("int") % 5 == 0, "Google").otherwise(F.col("company"))
    filled = joins.fill_from_lookup(
        companies.withColumn("company", name), fx.careers(spark, sf), prefilled=rules.PREFILLED_CAREERS
    )
    return filled.withColumnRenamed("Career Page", "career_page")


@query
def backfilled_zones(spark, sf):
    zone = F.when(F.col("posting_id") % 2 == 0, "").when(F.col("posting_id") % 5 == 0, "Given")
    rows = fx.postings(spark, sf).withColumn("location_zone", zone)
    return report.backfill_zone(rows).select("posting_id", "location_zone")


@query
def merged_history(spark, sf):
    rows = fx.postings(spark, sf)
    merged = dedup.merge_history(rows.filter("NOT is_history"), rows.filter("is_history"))
    return merged.select("generation", "posting_id", "apply_link")


def attached(spark: SparkSession, sf: str) -> DataFrame:
    return matching.attach_pairs(
        fx.pairs(spark, sf),
        matching.prepare_jobs(fx.jobs(spark, sf)),
        matching.prepare_cvs(fx.cvs(spark, sf)),
    )


@query
def token_overlap(spark, sf):
    found = attached(spark, sf).select(
        "job_id", "cv_id", matching.keyword_match("job_tokens", "cv_tokens").alias("k")
    )
    return found.select(
        "job_id", "cv_id",
        F.array_join("k.matched_keywords", " ").alias("matched"),
        F.array_join("k.missing_keywords", " ").alias("missing"),
        F.col("k.matched_count").alias("matched_count"),
        F.col("k.total_keywords").alias("total_keywords"),
    )


@query
def job_cv_pairs(spark, sf):
    return attached(spark, sf).select(
        "job_id", "cv_id", F.size("job_tokens").alias("job_words"), F.size("cv_tokens").alias("cv_words")
    )


# --- E: de-duplication -------------------------------------------------------


@query
def first_seen(spark, sf):
    rows = triage_plan.clean_postings(fx.postings(spark, sf))
    return dedup.first_per_key(rows, ["apply_link"]).select("apply_link", "posting_id", "keyword_idx")


CELLS = ("keyword", "title", "company", "location", "page_num", "card_idx", "time_filter", "link")


def _upsert(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = fx.postings(spark, sf).withColumn("link", urls.clean_url("apply_link"))
    batch = rows.filter("NOT is_history")
    new = dedup.insert_if_absent(
        rows.filter("is_history"), batch, CELLS, "link", dedup.DISCOVERY_ORDER
    )
    return batch, new


@query
def inserted_rows(spark, sf):
    return _upsert(spark, sf)[1].select("posting_id", "link", "title")


@query
def upsert_counts(spark, sf):
    return dedup.upsert_counts(*_upsert(spark, sf))


@query
def upserted_run(spark, sf):
    """The history as a first run and the batch as a second, which is run twice."""
    rows = fx.postings(spark, sf).withColumn("link", urls.clean_url("apply_link"))
    path = scratch_path(spark, "upserted")

    def run(batch: DataFrame, number: int) -> dict[str, int]:
        return keyed.upsert(batch, path, number, CELLS, "link", dedup.DISCOVERY_ORDER, buckets=8)

    run(rows.filter("is_history"), 0)
    first, again = (run(rows.filter("NOT is_history"), 1) for _ in range(2))
    if first != again:
        raise ValueError("a run that is run again must give the same counts")
    counts = [F.lit(again[name]).cast("bigint").alias(name) for name in ("inserted", "skipped")]
    return spark.read.parquet(path).filter("run_id = 1").select("posting_id", "link", "title", *counts)


@query
def header_dropped(spark, sf):
    heading = F.array(F.lit(" Keyword"), F.lit("Job Title "), F.lit("more"))
    plain = F.array(F.col("keyword"), F.col("title"), F.col("location"))
    rows = fx.postings(spark, sf).select(
        F.col("posting_id").alias("pos"),
        F.when(F.col("posting_id") % 10 == 0, heading).otherwise(plain).alias("cells"),
    )
    kept = dedup.drop_header_row(rows, ["Keyword", "Job Title"])
    return kept.select("pos", F.array_join("cells", "|").alias("cells"))


@query
def new_listings(spark, sf):
    rows = fx.listings(spark, sf).withColumn(
        "href", F.when(F.col("listing_idx") % 11 == 0, " ").otherwise(F.col("href"))
    )
    processed = fx.listings(spark, sf).filter("listing_idx % 4 = 0").select("href")
    return dedup.new_listings(rows, processed, pages.is_sponsored("card_text")).select(
        "listing_idx", "href"
    )


# --- G: summaries ------------------------------------------------------------


@query
def run_summary(spark, sf):
    return report.run_summary(triaged(spark, sf))


def _summaries(spark: SparkSession, graded: DataFrame) -> DataFrame:
    """Partial summaries of runs of graded postings, a run per keyword, the second of which is run again late."""
    path, graded = scratch_path(spark, "summaries"), materialize(graded)
    for number in (0, 1, 2, 3, 4, 1):
        run = graded.filter(F.col("keyword_idx") == number)
        run_files.write_summary(report.partial_summary(run), path, number)
    return spark.read.parquet(path)


@query
def merged_run_summary(spark, sf):
    return report.merged_run_summary(_summaries(spark, triaged(spark, sf)))


@query
def merged_zone_breakdown(spark, sf):
    return report.merged_zone_breakdown(_summaries(spark, triage_plan.classify(fx.postings(spark, sf))))


@query
def zone_breakdown(spark, sf):
    return report.zone_breakdown(triage_plan.classify(fx.postings(spark, sf)))


@query
def relevance_share(spark, sf):
    labelled = fx.postings(spark, sf).select(
        (classify.it_related("title", "keyword") == "yes").alias("relevant")
    )
    return report.relevance_share(labelled)


@query
def relevance_split(spark, sf):
    labelled = fx.postings(spark, sf).select(
        "posting_id", (classify.it_related("title", "keyword") == "yes").alias("relevant")
    )
    yes, no = report.relevance_split(labelled)
    return yes.withColumn("split", F.lit("yes")).unionByName(no.withColumn("split", F.lit("no")))


@query
def visit_totals(spark, sf):
    return report.visit_totals(with_status(spark, sf))


@query
def visits_per_status(spark, sf):
    return report.visits_per_status(with_status(spark, sf))


# --- H: order and limits -----------------------------------------------------


@query
def ranked_postings(spark, sf):
    relevant = report.only_relevant(triaged(spark, sf))
    return order.rank_postings(relevant).select(
        "rank", "posting_id", "location_zone", "relevance_score"
    )


@query
def sorted_postings(spark, sf):
    relevant = report.only_relevant(triaged(spark, sf))
    columns = "posting_id", "location_zone", "relevance_score"
    return order.numbered(order.sort_postings(relevant).select(*columns))


@query
def top_postings_per_zone(spark, sf):
    graded = triage_plan.classify(fx.postings(spark, sf))
    best = [F.col("relevance_score").desc(), F.col("posting_id")]
    return dedup.top_k_per_group(graded, ["location_zone"], best, 8).select(
        "location_zone", "rank", "posting_id", "relevance_score"
    )


@query
def previous_redirect(spark, sf):
    rows = fx.search_listings(spark, sf)
    return order.previous_value(rows, ["user_id"], ["ts", "event_id"], "raw_url").select(
        "event_id", "previous"
    )


@query
def session_cap(spark, sf):
    profiles = fx.visits(spark, sf).select("profile_url", "event_id")
    page = F.concat("profile_url", F.lit("/"), F.col("event_id") % 7).alias("profile_url")
    urls_seen = profiles.filter("event_id % 3 = 0").select(page)
    fresh = dedup.unseen(profiles.select(page).distinct(), urls_seen, "profile_url", unique=True)
    return order.session_cap(fresh, rules.SESSION_LIMIT)


@query
def page_cap(spark, sf):
    return order.page_cap(fx.postings(spark, sf), 2).select("posting_id", "page_num")


@query
def sorted_distinct(spark, sf):
    links = pages.page_links(fx.table(spark, sf, "pages"))
    return order.numbered(order.sorted_distinct(links, "href"))


# --- J: matching -------------------------------------------------------------


@query
def keyword_match(spark, sf):
    found = attached(spark, sf).select(
        "job_id", "cv_id", matching.keyword_match("job_tokens", "cv_tokens").alias("k")
    )
    return found.select("job_id", "cv_id", F.col("k.match_percentage").alias("match_percentage"))


@query
def cosine_pct(spark, sf):
    return attached(spark, sf).select(
        "job_id", "cv_id", matching.cosine_of_units("job_unit", "cv_unit").alias("cosine")
    )


@query
def best_role(spark, sf):
    titled = matching.prepare_jobs(fx.jobs(spark, sf))
    found = matching.best_role(fx.offers(spark, sf), titled, fx.roles(spark, sf))
    return found.select("job_id", "title_match.*")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_report(
        fx.pairs(spark, sf), fx.jobs(spark, sf), fx.cvs(spark, sf), fx.offers(spark, sf),
        fx.roles(spark, sf),
    )


@query
def match_report(spark, sf):
    return reports(spark, sf).select(
        "job_id", "cv_id", "overall_similarity_percentage", "semantic_similarity_percentage",
        F.col("keyword_match.matched_count").alias("matched_count"),
        F.col("keyword_match.total_keywords").alias("total_keywords"),
        F.col("keyword_match.match_percentage").alias("match_percentage"),
        F.col("title_match.best_role").alias("best_role"),
        F.col("title_match.title_matched").alias("title_matched"),
        F.col("title_match.title_similarity_percentage").alias("title_percentage"),
    )


@query
def best_jobs_per_cv(spark, sf):
    return matching.best_jobs_per_cv(reports(spark, sf), 3).select(
        "cv_id", "rank", "job_id", "overall_similarity_percentage"
    )


@query
def top_jobs_per_cv(spark, sf):
    return ranking.top_jobs_per_cv(
        fx.jobs(spark, sf), fx.cvs(spark, sf), fx.offers(spark, sf), fx.roles(spark, sf), 10
    ).select("cv_id", "rank", "job_id", "overall_similarity_percentage")


# --- K: increments -----------------------------------------------------------

NOW = "2024-01-20 12:00:00"


@query
def retention(spark, sf):
    stamp = F.when(F.col("event_id") % 50 != 0, F.col("visited_at"))
    rows = fx.visits(spark, sf).withColumn("visited_at", stamp)
    now = F.lit(NOW).cast("timestamp")
    return stream_ops.within_retention(rows, "visited_at", now).select("event_id")


def _runs(spark: SparkSession, rows: DataFrame, column: str, values: range, start: Callable) -> None:
    """Feed a stream the rows of one value after the other, a run of the stream for each.

    The rows are written once, a folder per value; `start` begins a run over a source folder.
    """
    staged, source = scratch_path(spark, "staged"), scratch_path(spark, "stream")
    rows.write.partitionBy(column).parquet(staged)
    for value in values:
        part = spark.read.schema(rows.schema).parquet(staged).filter(F.col(column) == value)
        part.select(*rows.columns).write.mode("append").parquet(source)
        start(spark.readStream.schema(rows.schema).parquet(source)).awaitTermination()


@query
def stream_triage(spark, sf):
    target, state = scratch_path(spark, "triaged"), scratch_path(spark, "checkpoint")
    _runs(
        spark, fx.new_postings(spark, sf), "keyword_idx", range(5),
        lambda stream: stream_runs.stream_triage(stream, target, state),
    )
    return spark.read.parquet(target).select(
        "posting_id", "apply_link", "location_zone", "relevance", "relevance_score"
    )


@query
def stream_dedup(spark, sf):
    rows = fx.visits(spark, sf).select(
        "profile_url", "visited_at",
        F.floor((F.day("visited_at") - 1) / 8).cast("int").alias("slice"),
    )
    target, state = scratch_path(spark, "first"), scratch_path(spark, "checkpoint")

    def start(stream: DataFrame):
        # A slice is eight days in any order.
        first = stream_ops.stream_dedup(stream, ["profile_url"], "visited_at", lateness="8 days")
        writer = first.writeStream.format("parquet").option("path", target)
        return writer.option("checkpointLocation", state).trigger(availableNow=True).start()

    _runs(spark, rows, "slice", range(4), start)
    return spark.read.parquet(target).select("profile_url", minutes("window_start").alias("window_start"))


@query
def stream_first_seen(spark, sf):
    """Visits stamped with the start of their eight days: a profile is forgotten three slices on."""
    part = F.floor((F.day("visited_at") - 1) / 8).cast("int")
    begun = F.timestamp_add("DAY", part * 8, F.lit("2024-01-01").cast("timestamp"))
    rows = fx.visits(spark, sf).select("profile_url", begun.alias("seen_at"), part.alias("slice"))
    target, state = scratch_path(spark, "seen"), scratch_path(spark, "checkpoint")

    def start(stream: DataFrame):
        first = stream_ops.stream_first_seen(stream, ["profile_url"], "seen_at", hours=8 * 24)
        writer = first.writeStream.format("parquet").option("path", target)
        return writer.option("checkpointLocation", state).trigger(availableNow=True).start()

    _runs(spark, rows, "slice", range(4), start)
    return spark.read.parquet(target).select("profile_url", "slice")
