"""Micro-batches as runs: each batch is triaged against everything written before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from hirelode.operators.report import partial_summary
from hirelode.plans.triage import triage
from hirelode.session import materialize
from hirelode.sources.keyed import BUCKETS, keyed_table, other_runs, write_keyed
from hirelode.sources.runs import write_summary


def batch_plan(batch: DataFrame, batch_id: int, target: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The target, laid out by link, and the new postings of a batch against the older ones in it.

    The target's links are read bucket by bucket and joined in place; only the batch is shuffled.
    """
    layout = triage(batch, batch.select("apply_link").limit(0)).schema
    known = keyed_table(batch.sparkSession, target, layout, "apply_link", "batch_id", buckets)
    return known, triage(batch, other_runs(known, batch_id, "batch_id"), keyed=True)


def triage_batch(
    batch: DataFrame, batch_id: int, target: str, buckets: int = BUCKETS, summaries: str | None = None
) -> None:
    """Write the new postings of one batch to its own partition, and what they add to all summaries.

    The batch reads older partitions only and replaces its own, so a batch that is run again
    after a failure gives the same tables.
    """
    known, fresh = batch_plan(batch, batch_id, target, buckets)
    ready = materialize(fresh)
    write_keyed(known, ready, target, batch_id, "batch_id")
    if summaries:
        write_summary(partial_summary(ready), summaries, batch_id)


def stream_triage(
    stream: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS, summaries: str | None = None
) -> StreamingQuery:
    """Triage all data that is there, batch by batch, then stop.

    `summaries` is a folder for the partial summary of each batch, of which `report.merged_run_summary`
    and `report.merged_zone_breakdown` make those of all batches without reading a posting.

    `buckets` is how the target is divided by link if it is not there yet; give a large one as many as a
    shuffle has partitions.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, n: triage_batch(batch, n, target, buckets, summaries))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
