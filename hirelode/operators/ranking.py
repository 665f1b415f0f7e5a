"""The best k postings of every CV, over all postings and without a report of every pair.

Two parts of the score of a pair cost little: the title's is a number per posting, and the semantic one is
a product of two vectors. The third, which compares words, is bounded first. The most frequent words that
both sides use have a bit each; the common bits of a pair are words matched for sure, and the rarer words of
either side bound how many more there can be. The k-th best lower bound of a CV is a score it surely
reaches, so only pairs whose upper bound reaches it have their words compared. CVs are the queries: blocks of
them meet shards of postings, each pair of block and shard in a task of its own.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelode.functions.text import let, round_half_even
from hirelode.operators.dedup import top_k_per_group
from hirelode.operators.matching import (
    best_role,
    dot,
    final_score,
    keyword_match,
    prepare_cvs,
    prepare_jobs,
)
from hirelode.session import materialize

#: Frequent words with a bit of their own: so many longs of 64.
MASK_LONGS = 8
BLOCK_CVS, SHARD_JOBS = 1_024, 8_192


def shared_words(jobs: DataFrame, cvs: DataFrame, longs: int = MASK_LONGS) -> DataFrame:
    """(token, place): the words that postings and CVs have, the most frequent ones numbered from 0."""
    held = cvs.select(F.explode("cv_tokens").alias("token")).distinct()
    used = jobs.select(F.explode("job_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("jobs"))
    counts = materialize(used.join(held, "token"))
    first = counts.orderBy(F.desc("jobs"), "token").limit(64 * longs)
    # One task, of no more rows than there are bits.
    placed = first.select("token", (F.row_number().over(Window.orderBy(F.desc("jobs"), "token")) - 1).alias("place"))
    return materialize(counts.select("token").join(placed, "token", "left"))


def with_masks(rows: DataFrame, key: str, tokens: str, words: DataFrame, longs: int = MASK_LONGS) -> DataFrame:
    """Append the bits of a row's frequent words (mask_0 …), and how many shared words it has besides (rest)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place") % 64)
    masks = [
        F.bit_or(F.when(F.floor(F.col("place") / 64) == i, bit)).alias(f"mask_{i}") for i in range(longs)
    ]
    each = rows.select(key, F.explode(tokens).alias("token")).join(words, "token")
    made = each.groupBy(key).agg(*masks, F.count_if(F.col("place").isNull()).alias("rest"))
    joined = rows.join(made, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in made.columns if c != key})


def prepared(jobs: DataFrame, cvs: DataFrame, offers: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides cut into words and normed, with masks; only rows that can have a score."""
    cut = prepare_jobs(jobs)
    titles = best_role(offers, cut, roles).select(
        "job_id", F.col("title_match.title_similarity_percentage").alias("title")
    )
    postings = materialize(cut.filter("job_unit IS NOT NULL").drop("title_unit").join(titles, "job_id"))
    people = materialize(prepare_cvs(cvs).filter("cv_unit IS NOT NULL"))
    words = shared_words(postings, people)
    total = F.size("job_tokens").alias("total")
    return (
        materialize(with_masks(postings, "job_id", "job_tokens", words).select("*", total)),
        materialize(with_masks(people, "cv_id", "cv_tokens", words)),
    )


def parts(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def bounded_pairs(
    jobs: DataFrame, cvs: DataFrame, longs: int = MASK_LONGS, block: int = BLOCK_CVS, shard: int = SHARD_JOBS
) -> DataFrame:
    """(cv_id, job_id, semantic, title, lower, upper, least) of all pairs, made and looked at on the way.

    `least` is a column of `cvs`, of what a pair has to reach. A block of CVs is one row.
    """
    n_blocks = parts(cvs.count(), block)
    # Small tables are dealt over all cores, large ones over shards of bounded size.
    cores = jobs.sparkSession.sparkContext.defaultParallelism
    n_shards = max(parts(jobs.count(), shard), parts(2 * cores, n_blocks))
    masks = [f"mask_{i}" for i in range(longs)]
    person = F.struct("cv_id", "cv_unit", "rest", "least", *masks)
    blocks = cvs.withColumn("block", F.pmod(F.xxhash64("cv_id"), F.lit(n_blocks)).cast("int")).groupBy("block").agg(
        F.collect_list(person).alias("people")
    ).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    dealt = jobs.select("job_id", "job_unit", "title", "total", F.col("rest").alias("job_rest"), *masks).withColumn(
        "shard", F.pmod(F.xxhash64("job_id"), F.lit(n_shards)).cast("int")
    ).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    # The number is given, since the rows are few bytes for the work they make and would be put together.
    tasks = n_shards * n_blocks
    met = dealt.repartition(tasks, "shard", "block").join(blocks.repartition(tasks, "shard", "block"), ["shard", "block"])
    each = met.withColumn("cv", F.explode("people"))
    common = reduce(add, [F.bit_count(F.col(m).bitwiseAND(F.col(f"cv.{m}"))) for m in masks])
    more = F.least("job_rest", "cv.rest")

    def percentage(matched: Column) -> Column:
        return round_half_even(matched / F.greatest("total", F.lit(1)) * 100)

    sized = each.select(
        F.col("cv.cv_id").alias("cv_id"), "job_id", "title", F.col("cv.least").alias("least"),
        let(dot(F.col("job_unit"), F.col("cv.cv_unit")) * 100, lambda v: round_half_even(v)).alias("semantic"),
        percentage(common).alias("surely"), percentage(F.least("total", common + more)).alias("at_most"),
    )
    return sized.select(
        "cv_id", "job_id", "semantic", "title",
        final_score(F.col("semantic"), F.col("surely"), F.col("title")).alias("lower"),
        final_score(F.col("semantic"), F.col("at_most"), F.col("title")).alias("upper"), "least",
    )


def candidate_pairs(jobs: DataFrame, cvs: DataFrame, k: int) -> DataFrame:
    """(cv_id, job_id, semantic, title): pairs whose upper bound reaches the CV's k-th best lower bound.

    `jobs` and `cvs` are those of `prepared`. No pair of a best k is missing: k pairs of the CV score at
    least that bound, and the score only grows with the words matched.
    """
    open_cvs = cvs.withColumn("least", F.lit(None).cast("double"))
    first = top_k_per_group(
        bounded_pairs(jobs, open_cvs).select("cv_id", "job_id", "lower"), ["cv_id"], [F.desc("lower"), F.col("job_id")], k
    )
    reached = materialize(first.groupBy("cv_id").agg(
        F.when(F.count("*") == k, F.min("lower")).alias("least")
    ))
    asked = materialize(cvs.join(reached, "cv_id", "left"))
    return bounded_pairs(jobs, asked).filter(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select(
        "cv_id", "job_id", "semantic", "title"
    )


def top_jobs_per_cv(
    jobs: DataFrame, cvs: DataFrame, offers: DataFrame, roles: DataFrame, k: int = 10
) -> DataFrame:
    """(cv_id, rank, job_id, overall_similarity_percentage): exactly the best k of all postings per CV.

    Scores are those of `match_report`, ties go to the smaller job_id. Postings without a vector or an
    offered role and CVs without a vector have no score and take no part; a CV has fewer than k rows if
    there are fewer postings. Ids are distinct on either side.
    """
    postings, people = prepared(jobs, cvs, offers, roles)
    found = materialize(candidate_pairs(postings, people, k))
    scored = found.join(postings.select("job_id", "job_tokens"), "job_id").join(
        people.select("cv_id", "cv_tokens"), "cv_id"
    )
    percentage = keyword_match("job_tokens", "cv_tokens")["match_percentage"]
    overall = final_score(F.col("semantic"), percentage, F.col("title"))
    ranked = scored.select("cv_id", "job_id", overall.alias("overall_similarity_percentage"))
    order = [F.desc("overall_similarity_percentage"), F.col("job_id")]
    return top_k_per_group(ranked, ["cv_id"], order, k)
