"""The pipeline against plain versions of its stages, and the registration of the queries."""

import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from hirelode.llm import packing, quality, secrets, substring_dedup
from hirelode.llm.queries import ORACLE, QUALITY_THRESHOLD, REGISTRY, WORD_TOKENIZER
from tests.conftest import SMALL
from tests.llm.test_duplicates import brute_classes, brute_fingerprint

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_remove(rows):
    """Rows (id, text) in order of id, without what an earlier document holds."""
    chunks, holders = {}, defaultdict(set)
    for key, text in rows:
        _, first, size, high, low = substring_dedup.chunks_of([text.encode()])
        chunks[key] = list(zip(first.tolist(), size.tolist(), zip(high.tolist(), low.tolist(), strict=True), strict=True))
        for _, _, digest in chunks[key]:
            holders[digest].add(key)
    left = []
    for key, text in rows:
        spans = []
        for begin, length, digest in chunks[key]:
            if min(holders[digest]) < key:
                if spans and spans[-1][1] == begin:
                    spans[-1][1] = begin + length
                else:
                    spans.append([begin, begin + length])
        spans = [tuple(s) for s in spans if s[1] - s[0] >= substring_dedup.LEAST_SPAN]
        cleaned = substring_dedup.without(text, spans) if spans else text
        if not spans or cleaned.strip():
            left.append((key, cleaned))
    return left


def test_every_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    model = quality.train(docs, labels)
    rows = [r for r in rows if model.score([r[1].encode()])[0] >= QUALITY_THRESHOLD]
    fps = {key: brute_fingerprint(text) for key, text in rows}
    root = brute_classes(fps.values(), 3)
    seen = set()
    rows = [r for r in rows if root[fps[r[0]]] not in seen and not seen.add(root[fps[r[0]]])]
    rows = brute_remove(rows)
    finder = secrets.fit([t for _, t in rows])
    rows = [(k, secrets.redacted(t, secrets.spans_of(t, finder), "[REDACTED]")) for k, t in rows]
    library = Tokenizer.from_file(WORD_TOKENIZER)
    expected = {
        k: np.array(library.encode(t, add_special_tokens=False).ids + [packing.END_ID], dtype="<u4").tobytes()
        for k, t in rows
    }
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r.doc_id].append((r.start, bytes(r.ids)))
    assert {k: b"".join(ids for _, ids in sorted(v)) for k, v in got.items()} == expected


def test_stages_keep_the_columns_and_take_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = [(900, None, "en", "s", None), (901, "", None, None, 0), (901, "", None, None, 0), (None, "no key", "en", "s", 6),
           (902, "é" * 50_000, "fr", "s", 50_000)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    extra = docs.selectExpr("*", "doc_id AS __score", "text AS score", "1 AS start")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, extra, SMALL)
        assert made.columns == extra.columns, name
        assert stage(spark, docs, SMALL).columns == DOCUMENTS
        assert made.count() > 0
        assert stage(spark, docs.limit(0), SMALL).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SMALL).collect() == []


def test_every_operator_is_registered_once():
    names = [n for n in entry_points.queries() if n.startswith("op") and n.split("_")[0][2:].isdigit()]
    assert sorted(int(n.split("_")[0][2:]) for n in names) == list(range(1, 14))
    assert set(REGISTRY) | {"pipeline"} <= set(entry_points.queries())
    assert set(ORACLE) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = REGISTRY[name](spark, SMALL)
    result = connection.execute(ORACLE[name])
    assert [c[0] for c in result.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(result.fetchall())


def test_entry_points_work_without_this_subpackage():
    code = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("hirelode.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op1_") or n == "pipeline" for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
