"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelode.llm import (
    byte_bpe, decontamination, filter_audit, hnsw, maxscore, packing, quality, secrets, simhash, spelling,
    substring_dedup, token_counts, toxicity,
)
from hirelode.llm.common import fold, table
from hirelode.session import materialize

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


QUALITY_THRESHOLD, TOXIC_THRESHOLD = 0.3, 0.5


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents that a document of a smaller doc_id holds as well."""
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every 50th vector."""
    component = lambda x: F.floor(F.lit(256.0) * x)
    rows = hnsw.finite(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(
        F.col("key").alias("vec_id"), F.transform("vector", component).alias("weights")
    )
    queries = rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = maxscore.search(queries, rows, 5)
    return found.select("query_id", "rank", "vec_id", "score")


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found of every 20th vector."""
    vectors = table(spark, sf_dir, "embeddings")
    index = materialize(hnsw.build(vectors))
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return hnsw.search(index, queries).select("query_id", "rank", "vec_id", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word-piece lengths of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_RANKS, keep=["doc_id"])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return judged(quality.score_texts(docs, model, keep=["doc_id"]), QUALITY_THRESHOLD)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.train(docs), keep=["doc_id"])

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "network")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return judged(toxicity.score_texts(docs, model, keep=["doc_id"]), TOXIC_THRESHOLD)


def judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = packing.pack_texts(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    pattern = public_tokenizers.PATTERN
    encoded = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), BYTE_RANKS, pattern, keep=["doc_id"])
    decoded = byte_bpe.decode_texts(encoded, BYTE_RANKS, pattern)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


SLIP_EVERY = 199


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their frequent neighbours and the roots these lead to."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"), slip_every=SLIP_EVERY)
    return spelling.variants(words)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in every order."""
    counts = filter_audit.tabulate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(counts).drop("filter")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark items hold as well."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_maxscore": op2_maxscore,
    "op3_hnsw": op3_hnsw,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_packing": op9_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_spelling": op11_spelling,
    "op12_filter_audit": op12_filter_audit,
    "op13_decontamination": op13_decontamination,
}
ORACLE: dict[str, str] = {
    "op2_maxscore": """
        WITH v AS (
            SELECT row_number() OVER () AS place, vec_id,
                   [floor(256.0 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.place AS asked, q.vec_id AS query_id, c.vec_id,
                   CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM s
        QUALIFY rank <= 5
    """,
    "op11_spelling": r"""
        WITH RECURSIVE tab AS (
            SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k:
                CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), runs AS (
            SELECT doc_id, run, count(*) AS times
            FROM (SELECT doc_id, unnest(regexp_extract_all(
                      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
                  FROM documents)
            WHERE length(run) >= 6
            GROUP BY doc_id, run
        ), named AS (
            SELECT run, times, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS digits FROM runs
        ), sums AS (
            SELECT run, times, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(len(digits) // 2), lambda i:
                    16 * (instr('0123456789ABCDEF', digits[2 * i + 1]) - 1) + instr('0123456789ABCDEF', digits[2 * i + 2]) - 1)),
                lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1]))) AS h
            FROM named, tab
        ), slipped AS (
            SELECT times, CASE WHEN h % 199 = 0
                THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word
            FROM sums
        ), words AS (
            SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
        ), places AS (
            SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
        ), cut AS (
            SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM places
        ), pairs AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION
            SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
            UNION
            SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
        ), ranked AS (
            SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
                   row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place
            FROM pairs
        ), formed AS (
            SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
                   CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form,
                   CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n
            FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1
        ), walked AS (
            SELECT word, word AS root, form AS next FROM formed
            UNION ALL
            SELECT w.word, f.word, f.form FROM walked w JOIN formed f ON w.next = f.word
        )
        SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
        FROM formed f JOIN walked w ON f.word = w.word AND w.next IS NULL
    """,
    "op12_filter_audit": r"""
        WITH known AS (
            SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good,
                   max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic
            FROM labels GROUP BY doc_id
        ), texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
            FROM documents
        ), split AS (
            SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM texts
        ), sets AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   CAST(len(words) < 50 AS INTEGER)
                   + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER)
                   + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) AS INTEGER)
                   + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
                   + 16 * CAST(coalesce(split.doc_id > first, false) AS INTEGER) AS fails
            FROM split LEFT JOIN known ON split.doc_id = known.doc_id
        ), counts AS (
            SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM sets GROUP BY part, fails
        ), letters AS (
            SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v (letter, bit)
        ), orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
                   [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
        ), steps AS (
            SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(bits[1:step]) AS INTEGER) - bits[step] AS before
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
        ), taken AS (
            SELECT part, filter_order, step, bit,
                   CAST(sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
                   CAST(sum(CASE WHEN fails & bit > 0 AND fails & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
                   CAST(sum(CASE WHEN fails & bit > 0 AND fails & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
                   CAST(sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                   CAST(sum(CASE WHEN fails & bit > 0 AND fails & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
                   CAST(sum(CASE WHEN fails & bit > 0 AND fails & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
            FROM counts, steps GROUP BY part, filter_order, step, bit
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM taken
    """,
    "op13_decontamination": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
            FROM documents
        ), items AS (
            SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
            FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
        ), starts AS (
            SELECT item, words, least(len(words), 10) AS n, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i
            FROM items WHERE len(words) > 0
        ), windows AS (
            SELECT DISTINCT item, n, array_to_string(words[i:i + n - 1], ' ') AS piece FROM starts
        ), placed AS (
            SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs
        ), grams AS (
            SELECT rid, i, n, string_agg(word, ' ') OVER (
                PARTITION BY rid, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS piece
            FROM placed, (SELECT DISTINCT n FROM windows)
        ), hits AS (
            SELECT rid, i, n, item FROM grams JOIN windows USING (n, piece)
        ), hit_words AS (
            SELECT rid, count(DISTINCT place) AS n_hit
            FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid
        ), hit_items AS (
            SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
    """,
}
