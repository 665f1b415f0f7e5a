"""Posting triage: clean, drop what is known, classify, rank, summarise.

De-duplication comes before classification on purpose, and it looks at links and positions only:
most postings of a run have been seen before, and their descriptions are neither shuffled nor
matched to find that out. What is new is picked out of the postings where they lie, by a membership filter
of bounded size over links and positions, nulls included; a join, which sees only what the filter
lets through, makes it exact, and one row of each position is kept, since a posting may be repeated.
Postings without a link go first of all, so they never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions.classify import (
    extract_skills,
    german_level,
    is_excluded_title,
    is_in_region,
    it_related,
    keep_title,
    label_hits,
    location_zone,
    relevance_from_hits,
)
from hirelode.functions.text import first_non_empty, non_blank
from hirelode.functions.urls import clean_url
from hirelode.operators.dedup import DISCOVERY_ORDER, first_per_key, insert_if_absent, unseen
from hirelode.operators.joins import may_be_in

PLACEHOLDERS = {"title": "Unknown Title", "company": "Unknown Company", "location": "Germany"}


def clean_postings(postings: DataFrame) -> DataFrame:
    """Placeholders for blank fields, links without query; postings without a link go."""
    named = {name: first_non_empty(name, default=text) for name, text in PLACEHOLDERS.items()}
    if "company_panel" in postings.columns:
        named["company"] = first_non_empty("company", "company_panel", default="Unknown Company")
    cleaned = postings.withColumns({**named, "apply_link": clean_url(non_blank("apply_link"))})
    return cleaned.filter(F.col("apply_link") != "")


def classify(postings: DataFrame, keep_description: bool = False) -> DataFrame:
    """Add zone, skills, language level, score and label."""
    core, supporting = rules.CORE_SKILLS, rules.SUPPORTING_SKILLS
    # Columns of their own, because the next step refers to each of them more than once.
    tagged = postings.withColumns(
        {
            "location_zone": location_zone("location"),
            "german_level": german_level("description"),
            "skills": extract_skills("description", core + supporting),
            "_excluded": is_excluded_title("title"),
        }
    ).withColumns(
        {"_core": label_hits("skills", core), "_supporting": label_hits("skills", supporting)}
    )
    graded = relevance_from_hits(F.col("_excluded"), F.col("_core"), F.col("_supporting"))
    result = tagged.withColumns(
        {"relevance_score": graded["score"], "relevance": graded["label"]}
    ).drop("_excluded", "_core", "_supporting")
    return result if keep_description else result.drop("description")


def triage(
    postings: DataFrame, history: DataFrame, order=DISCOVERY_ORDER, keyed: bool = False
) -> DataFrame:
    """New classified postings: first of each link, unless the link is in `history`.

    `keyed` says that the history is laid out by link, so that it is not shuffled, see `unseen`.

    `order` names the columns of a total order, in which null comes first. Rows that are equal in
    all of them are one posting, of which one row stays, whichever order they come in.
    """
    cleaned = clean_postings(postings)
    first = first_per_key(cleaned.select("apply_link", *order), ["apply_link"], order)
    # A struct is never null, so positions with a null are compared like the others.
    at = F.struct("apply_link", *order).alias("_at")
    fresh = unseen(first, history, "apply_link", unique=True, keyed=keyed).select(at)
    # Positions are distinct, so the join adds no rows. A semi join would be moved ahead of the filter.
    found = may_be_in(cleaned.withColumn("_at", at), fresh, "_at").join(fresh, "_at")
    return classify(first_per_key(found, ["_at"], [F.xxhash64(*cleaned.columns)]).drop("_at"))


def triage_v1(postings: DataFrame, history: DataFrame, order=DISCOVERY_ORDER) -> DataFrame:
    """First generation: region and role filters, then yes/no by title and keyword."""
    kept = clean_postings(postings).filter(is_in_region("location") & keep_title("title"))
    first = first_per_key(kept.drop("description"), ["apply_link"], order)
    fresh = unseen(first, history, "apply_link", unique=True)
    return fresh.withColumn("relevance", it_related("title", "keyword"))


def with_relevance(rows: DataFrame) -> DataFrame:
    """Label new and old rows alike."""
    return rows.withColumn("relevance", it_related("title", "keyword"))


def to_posting_rows(
    triaged: DataFrame, keep: Sequence[str] = (), fields: Sequence[str] = rules.POSTING_FIELDS
) -> DataFrame:
    """Triaged postings in the layout of the output file, after the columns to `keep`.

    Columns that a layout does not have need not be in the postings either.
    """
    source = {
        "Scraped Date": F.date_format("scraped_at", rules.SCRAPED_FORMAT),
        "Time Filter": F.col("time_filter"),
        "Keyword": F.col("keyword"),
        "Job Title": F.col("title"),
        "Company": F.col("company"),
        "Location": F.col("location"),
        "Location_Zone": F.col("location_zone"),
        "Apply Link": F.col("apply_link"),
        "Skills Found": F.concat_ws(", ", "skills"),
        "German_Level": F.col("german_level"),
        "Relevance_Score": F.col("relevance_score").cast("string"),
        "Relevance": F.col("relevance"),
    }
    return triaged.select(*keep, *[source[name].alias(name) for name in fields])


def publish(
    batch: DataFrame,
    target: DataFrame,
    columns: Sequence[str] = rules.POSTING_FIELDS,
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Rows of a posting file that the target lacks; blank zones are filled from the location."""
    rows = batch
    if "Location_Zone" in columns:
        given = F.nullif("Location_Zone", F.lit(""))
        rows = batch.withColumn("Location_Zone", F.coalesce(given, location_zone("Location")))
    return insert_if_absent(target, rows, columns, "Apply Link", order)
