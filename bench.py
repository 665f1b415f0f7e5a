"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Each query runs once to warm up and then three times; its time is the median, from building the
plan to the last row written to a sink that drops it. BENCH_ALL=1 times every registered query.
BENCH_LOOPS=1 adds what a loop in one Python process takes for some of them, on rows already read.
"""

from __future__ import annotations

import collections
import json
import operator
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hirelode import rules  # noqa: E402
from hirelode.catalog import fixtures as fx  # noqa: E402
from hirelode.catalog.queries import REGISTRY  # noqa: E402
from hirelode.session import build_session  # noqa: E402

HEADLINE = (
    "triage_zone_breakdown", "triage_postings", "triage_first_generation", "ranked_postings",
    "first_seen", "unseen_postings", "inserted_rows", "location_zones", "extracted_skills",
    "german_levels", "relevance_labels", "it_related", "document_skills", "cleaned_words",
    "page_links", "ranked_subpages", "page_addresses", "document_addresses", "normalized_emails",
    "website_contacts", "repeated_redirects", "pending_recipients", "recipient_counts",
    "visit_totals", "run_summary", "token_overlap", "best_role", "match_report",
    "best_jobs_per_cv", "retention",
)
RUNS = 3


def python_loops(spark, sf_dir: str) -> dict[str, float]:
    """Seconds of plain loops over rows in memory, for queries whose rule is a few lines."""
    postings = fx.postings(spark, sf_dir).toPandas().to_dict("records")
    texts = [r.text or "" for r in fx.table(spark, sf_dir, "documents").select("text").collect()]
    people = [r.email for r in fx.recipients(spark, sf_dir).orderBy("pos").collect()]
    visits = fx.visits(spark, sf_dir).collect()
    pairs = fx.pairs(spark, sf_dir).collect()
    cvs = {r.item_id: r.text for r in fx.table(spark, sf_dir, "benchmark").collect()}
    numbers = [r.doc_id for r in fx.table(spark, sf_dir, "documents").select("doc_id").collect()]
    words = re.compile("[^a-z0-9]+")
    order = operator.itemgetter("keyword_idx", "page_num", "card_idx", "posting_id")
    sent = {e.lower() for e in people[::3]}

    def cut(text: str) -> set[str]:
        return set(words.split(text.lower())) - {""}

    def zone(place: str) -> str:
        folded = place.strip().lower()
        for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
            folded = folded.replace(a, b)
        tiers = (label for label, places in rules.ZONE_TIERS if any(p in folded for p in places))
        return next(tiers, rules.ZONE_DEFAULT)

    def first_seen():
        first = {}
        for row in sorted((p for p in postings if p["apply_link"]), key=order):
            first.setdefault(row["apply_link"].split("?")[0], row["posting_id"])
        return first

    def token_overlap():
        job = dict(zip(numbers, map(cut, texts), strict=True))
        cv = {k: cut(t) for k, t in cvs.items()}
        return [(len(job[p.job_id] & cv[p.cv_id]), sorted(job[p.job_id] - cv[p.cv_id])) for p in pairs]

    loops = {
        "first_seen": first_seen,
        "location_zones": lambda: [zone(p["location"]) for p in postings],
        "cleaned_words": lambda: [words.sub(" ", t.lower()).strip() for t in texts],
        "pending_recipients": lambda: [e for e in people if e.lower() not in sent],
        "recipient_counts": lambda: len({e.lower() for e in people} & sent),
        "visit_totals": lambda: collections.Counter(
            (v.has_pending, v.has_message, v.has_connect, v.has_follow, v.sent_ok) for v in visits
        ),
        "token_overlap": token_overlap,
    }
    seconds = {}
    for name, loop in loops.items():
        start = time.perf_counter()
        loop()
        seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = tuple(REGISTRY) if os.environ.get("BENCH_ALL") else HEADLINE
    seconds = {}
    for name in names:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    loops = python_loops(spark, sf_dir) if os.environ.get("BENCH_LOOPS") else None
    spark.stop()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
        **({"python_loops": loops} if loops else {}),
    }))


if __name__ == "__main__":
    main()
