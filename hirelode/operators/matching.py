"""Posting/CV matching over given pairs.

One pair is one posting and one CV that somebody asked to compare, so pairs are an input table
and both sides are attached by id; which roles a posting's title is held against is such a table
too. Work grows with the pairs, never with postings times CVs. Every pair is reported: what lacks a
text has no words, and a score that lacks a vector is null. Text is cut into words and vectors are
normed once per posting and CV, before the joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions.text import col, let, round_half_even, tokens
from hirelode.operators.dedup import top_k_per_group


def keyword_match(job_tokens: Column | str, cv_tokens: Column | str) -> Column:
    """Matched and missing words of a posting, their number and the percentage matched."""
    none = F.array().cast("array<string>")
    job, cv = F.coalesce(col(job_tokens), none), F.coalesce(col(cv_tokens), none)
    matched = F.sort_array(F.array_intersect(job, cv))
    total = F.size(job)
    percentage = F.size(matched) / F.greatest(total, F.lit(1)) * 100
    return F.struct(
        matched.alias("matched_keywords"),
        F.sort_array(F.array_except(job, cv)).alias("missing_keywords"),
        F.size(matched).alias("matched_count"),
        total.alias("total_keywords"),
        round_half_even(percentage).alias("match_percentage"),
    )


def as_doubles(vector: Column | str) -> Column:
    return col(vector).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.reduce(products, F.lit(0.0), lambda total, x: total + x)


def unit(vector: Column | str) -> Column:
    """Vector of length 1; a zero vector stays as it is."""

    def scaled(values: Column) -> Column:
        norm = F.sqrt(dot(values, values))
        return let(
            norm, lambda n: F.when(n > 0, F.transform(values, lambda x: x / n)).otherwise(values)
        )

    return let(as_doubles(vector), scaled)


def cosine_of_units(a: Column | str, b: Column | str) -> Column:
    return round_half_even(dot(col(a), col(b)) * 100)


def cosine_pct(a: Column | str, b: Column | str) -> Column:
    """Cosine in percent, 0 for a zero vector."""
    return cosine_of_units(unit(a), unit(b))


def best_role(
    offers: DataFrame,
    titles: DataFrame,
    roles: DataFrame,
    vector: str = "title_unit",
    threshold: float = rules.TITLE_THRESHOLD,
) -> DataFrame:
    """(job_id, title_match): of the roles a posting is held against the closest to its title.

    `offers(job_id, role_idx)` says which; the first role wins a tie. The maximum is a combining
    aggregate, and only numbers travel to it. Postings without a vector or an offer have no row.
    """
    named = roles.select("role_idx", "role", unit("embedding").alias("_role"))
    held = offers.join(titles.select("job_id", vector).dropna(), "job_id").join(named, "role_idx")
    scored = held.select(
        "job_id",
        F.struct(
            cosine_of_units(vector, "_role").alias("score"),
            (-F.col("role_idx")).alias("earlier"),
            F.col("role"),
        ).alias("_offer"),
    )
    best = scored.groupBy("job_id").agg(F.max("_offer").alias("_best"))
    return best.select(
        "job_id",
        F.struct(
            (F.col("_best.score") >= threshold).alias("title_matched"),
            F.col("_best.role").alias("best_role"),
            F.col("_best.score").alias("title_similarity_percentage"),
        ).alias("title_match"),
    )


def final_score(semantic: Column, keyword: Column, title: Column) -> Column:
    return round_half_even(
        rules.SEMANTIC_WEIGHT * semantic + rules.KEYWORD_WEIGHT * keyword + rules.TITLE_WEIGHT * title
    )


def attach_pairs(pairs: DataFrame, jobs: DataFrame, cvs: DataFrame) -> DataFrame:
    """All pairs with the columns of their posting and CV, null where there is none.

    Both sides have one row per id. A posting or CV may be in any share of the pairs; the joins are
    plain shuffle joins, whose large partitions the adaptive skew join splits. The CVs, the narrower
    side, come first: what the second join shuffles is a CV for each pair and every posting once.
    """
    return pairs.join(cvs, "cv_id", "left").join(jobs, "job_id", "left")


def prepare_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "job_id",
        tokens("description").alias("job_tokens"),
        unit("embedding").alias("job_unit"),
        unit("title_embedding").alias("title_unit"),
    )


def prepare_cvs(cvs: DataFrame) -> DataFrame:
    return cvs.select("cv_id", tokens("text").alias("cv_tokens"), unit("embedding").alias("cv_unit"))


def match_report(
    pairs: DataFrame, jobs: DataFrame, cvs: DataFrame, offers: DataFrame, roles: DataFrame
) -> DataFrame:
    """Nested report of every pair: overall, semantic, keyword and title match.

    The overall score is null if one of its parts is.
    """
    prepared = prepare_jobs(jobs)
    titled = prepared.join(best_role(offers, prepared, roles), "job_id", "left").drop("title_unit")
    scored = attach_pairs(pairs, titled, prepare_cvs(cvs)).select(
        "job_id",
        "cv_id",
        cosine_of_units("job_unit", "cv_unit").alias("semantic_similarity_percentage"),
        keyword_match("job_tokens", "cv_tokens").alias("keyword_match"),
        "title_match",
    )
    overall = final_score(
        F.col("semantic_similarity_percentage"),
        F.col("keyword_match.match_percentage"),
        F.col("title_match.title_similarity_percentage"),
    )
    return scored.select(
        "job_id",
        "cv_id",
        overall.alias("overall_similarity_percentage"),
        "semantic_similarity_percentage",
        "keyword_match",
        "title_match",
    )


def best_jobs_per_cv(report: DataFrame, k: int) -> DataFrame:
    order: Sequence[Column] = (
        F.col("overall_similarity_percentage").desc_nulls_last(),
        F.col("job_id"),
    )
    return top_k_per_group(report, ["cv_id"], order, k)
