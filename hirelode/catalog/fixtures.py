"""Posting, page and contact tables derived from the given tables, one projection each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions.text import literal
from hirelode.functions.urls import url_domain
from hirelode.session import spread

TITLES = (
    "Working Student Data Engineer", "Werkstudent Marketing Data", "Intern Backend Developer",
    "Werkstudent People Service", "Working Student IT Support", "Werkstudentin Cloud",
    "Student Worker Logistik", "International Sales Manager", "Working Student Analytics",
    "Werkstudent Embedded Systems", "Working Student Generic Role",
)
PLACES = (
    "Berlin, Germany", "Remote (Berlin)", "Leipzig, Saxony", "Munich, Bavaria", "Kassel, Hessen",
    "Paris, France", "Potsdam", "Hamburg", "Koeln", "", "Home Office", "Vienna, Austria",
    "Frankfurt am Main",
)
TASKS = (
    "Python and SQL pipelines", "Excel and Power BI reports", "Tableau only",
    "Airflow on AWS with Linux", "General office tasks", "Machine learning research with pandas",
    "AI and Azure experience", "Data science with Python and NumPy", "ETL jobs", "Customer care",
    "Google Cloud and data analytics", "SQL", "GCP", "Data analysis in Excel with Tableau", "Linux",
    "Pipeline support", "No experience needed",
)
LANGUAGE = (
    "", "fliessend Deutsch", "German is a plus", "B2 level German expected",
    "gute Deutschkenntnisse", "sehr gute Deutschkenntnisse", "German required",
)
TERMS = (
    "Full time students welcome", "Start now", "Flexible hours", "20 hours per week",
    "Central office",
)
LOCAL_PARTS = (
    "info", "noreply", "a", "jobs", "dpo.office", "test12", "bounce-1", "karriere", "name",
    "my-unsubscribe", "hr", "datenschutz", "Team.Lead", "x+noreply", "support", "hello", "demo.",
    "contact", "api",
)
AT_SIGNS = ("@", " (at) ", "[at]", " at ")
MAIL_DOMAINS = (
    "firma.org", "example.com", "mail3.example.com", "lib.min.js", "host.local", "foo..org",
    "bar.test", "doe.com", "corp.de", "logo.png", "nodot", "personion.net", "good-site.eu",
)
LINK_BASE = "https://jobs.example.org/view/"
PAGE_WORDS = ("the", "der", "que", "nicht")
PAGE_POINTS = ((100, ("/de",)), (70, ("th",)), (40, ("/en",)))


# Tables whose rows take long: texts, page source, and the orders that become postings.
COSTLY = ("documents", "pages", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in COSTLY else rows


def pick(words: Sequence[str], number: Column | str) -> Column:
    """The word at a number counted from 0, wrapping around."""
    index = F.col(number) if isinstance(number, str) else number
    position = (index % len(words) + 1).cast("int")
    return F.element_at(F.expr(literal(words)), position)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one posting per order."""
    orders = table(spark, sf_dir, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    keyword = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    link = F.concat(F.lit(LINK_BASE), (key - key % 2).cast("string"), F.lit("?ref="), customer)
    return orders.select(
        key.alias("posting_id"),
        F.col("o_orderdate").cast("timestamp").alias("scraped_at"),
        F.lit(rules.SEARCH_AGE_LABEL).alias("time_filter"),
        pick(rules.SEARCH_KEYWORDS, keyword).alias("keyword"),
        keyword.alias("keyword_idx"),
        (customer % 3 + 1).cast("int").alias("page_num"),
        (key % 25 + 1).cast("int").alias("card_idx"),
        pick(TITLES, key).alias("title"),
        F.concat(F.lit("Company "), customer).alias("company"),
        pick(PLACES, customer).alias("location"),
        F.when(key % 97 == 0, "").otherwise(link).alias("apply_link"),
        F.concat_ws(". ", pick(TASKS, key), pick(LANGUAGE, customer), pick(TERMS, key)).alias(
            "description"
        ),
        (F.col("o_orderstatus") == "F").alias("is_history"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned links of the postings already seen."""
    seen = postings(spark, sf_dir).filter("is_history")
    return seen.select(F.substring_index("apply_link", "?", 1).alias("apply_link"))


def new_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).filter("NOT is_history").drop("is_history")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one listing per page; the card text is the ad block."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("listing_idx"),
        F.col("url").alias("href"),
        F.col("url").alias("raw_url"),
        F.regexp_extract("html", r'(?s)<div class="ad">(.*?)</div>', 1).alias("card_text"),
    )


def address(number: Column) -> Column:
    return F.concat(pick(LOCAL_PARTS, number), pick(AT_SIGNS, number), pick(MAIL_DOMAINS, number))


def pages_with_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 with the address of the customer that has the number of the page."""
    paragraph = F.concat(F.lit(" <p>"), address(F.col("page_id")), F.lit("</p>"))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.concat("html", paragraph).alias("html")
    )


# A website has this many pages; the first is its homepage and links to the others.
SITE_SIZE = 5
SITE_WORDS = ("kontakt", "jobs", "blog", "team", "about", "karriere", "news")


def site_url(number: Column) -> Column:
    """Address of a page by its number."""
    host = F.concat(F.lit("https://site"), F.floor(number / SITE_SIZE), F.lit(".example.org"))
    path = F.concat(F.lit("/"), pick(SITE_WORDS, number), F.lit("/"), number)
    return F.concat(host, F.when(number % SITE_SIZE == 0, "/").otherwise(path))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 as small websites: pages with an address, homepages with links to the other pages."""
    number = F.col("page_id")
    links = F.concat(*[
        F.concat(F.lit('<a href="'), site_url(number + i), F.lit('">page</a>')) for i in range(1, SITE_SIZE)
    ])
    return pages_with_addresses(spark, sf_dir).select(
        "page_id",
        site_url(number).alias("url"),
        F.concat("html", F.when(number % SITE_SIZE == 0, links).otherwise("")).alias("html"),
    )


def site_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The homepages, each with a tracking query."""
    homes = table(spark, sf_dir, "pages").filter(F.col("page_id") % SITE_SIZE == 0)
    return homes.select(
        F.col("page_id").alias("listing_idx"),
        F.concat(site_url(F.col("page_id")), F.lit("?utm=1")).alias("raw_url"),
    )


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each host is its homepage: (domain, home_id, home_url)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", url_domain("url").alias("domain"))
    return pages.groupBy("domain").agg(
        F.min("page_id").alias("home_id"), F.min_by("url", "page_id").alias("home_url")
    )


def known_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts(spark, sf_dir).filter("home_id % 5 = 0").select("domain")


def raw_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one raw address per customer."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("email_id"),
        address(key).alias("value"),
        F.concat(F.lit("site"), "c_nationkey", F.lit(".org")).alias("website"),
        (key % 8 + 1).cast("int").alias("rank"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every document, with a vector where there is one; the title vector is the same."""
    documents = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return documents.join(vectors, documents.doc_id == vectors.vec_id, "left").select(
        F.col("doc_id").alias("job_id"),
        F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("title"),
        F.col("text").alias("description"),
        "embedding",
        F.col("embedding").alias("title_embedding"),
    )


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return items.join(vectors, items.item_id == vectors.vec_id, "left").select(
        F.col("item_id").alias("cv_id"), "text", "embedding"
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label the vector with the lowest number."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.groupBy(F.col("label").alias("role_idx")).agg(
        F.concat(F.lit("role_"), F.first("label")).alias("role"),
        F.min_by("embedding", "vec_id").alias("embedding"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting is held against every role: (job_id, role_idx)."""
    indexes = roles(spark, sf_dir).agg(F.collect_set("role_idx")).scalar()
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("job_id"), F.explode(indexes).alias("role_idx")
    )


# Five CVs per posting, spread over all items.
PAIRS_PER_JOB = 5
CV_STEP = 8


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which CV was sent for which posting."""
    items = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1))).scalar()
    steps = F.explode(F.sequence(F.lit(0), F.lit(PAIRS_PER_JOB - 1))).alias("step")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), steps).select(
        "job_id", ((F.col("job_id") + F.col("step") * CV_STEP) % items).alias("cv_id")
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one profile visit per event."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("https://people.example.org/in/"), "user_id").alias("profile_url"),
        F.col("ts").cast("timestamp").alias("visited_at"),
        (kind == "error").alias("has_pending"),
        (F.col("user_id") % 2 == 0).alias("has_message"),
        kind.isin("click", "purchase").alias("has_connect"),
        (kind == "view").alias("has_follow"),
        (F.col("value") > 50).alias("sent_ok"),
    )


def search_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a redirect link per event, missing in every fifth."""
    link = F.concat(F.lit("https://www.google.com/url?q="), "event_type")
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.when(F.col("event_id") % 5 != 0, link).alias("raw_url"),
    )


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("pos"),
        F.concat(
            F.lit("User"), (key % 100).cast("string"), F.lit("@corp"), "c_nationkey", F.lit(".org")
        ).alias("email"),
    )


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipients(spark, sf_dir).filter("pos % 3 = 0").select(F.lower("email").alias("email"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    key = F.col("s_suppkey")
    page = F.concat(F.lit("https://"), key, F.lit(".example.org/jobs"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("company"),
        F.when(key % 2 == 0, "").otherwise(page).alias("Career Page"),
        F.col("s_nationkey").cast("string").alias("nation"),
    )


def careers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(key % 4 == 0).select(
        F.col("s_name").alias("company"),
        F.concat(F.lit("https://careers.example.org/"), key).alias("career_page"),
    )


def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search keyword of either list per part, in changing letter case."""
    data = pick(rules.DATA_KEYWORDS, "p_partkey")
    listed = F.when(F.col("p_size") % 2 == 0, data).otherwise(pick(rules.DEVOPS_KEYWORDS, "p_partkey"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"),
        F.when(F.col("p_partkey") % 3 == 0, F.upper(listed)).otherwise(listed).alias("keyword"),
        F.when(F.col("p_size") % 2 == 0, "data").otherwise("devops").alias("mode"),
    )


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as keywords in changing letter case, half of them per run mode."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(
        F.concat(F.lit(" "), "p_name")
    )
    mode = F.when(F.col("p_size") % 2 == 0, "data").otherwise("devops")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), name.alias("keyword"), mode.alias("mode")
    )
