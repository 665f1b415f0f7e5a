"""Tables laid out by key: what they know is met without being shuffled, and runs insert into them.

A table is a folder of Parquet files, a partition per run and in it a file per bucket of the key. Registered
with that layout, it is joined by key in place: only the batch is shuffled, to the table's buckets. A run
writes its own partition and no other, so old rows are never rewritten, and running it again replaces
what it wrote before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelode.operators.dedup import first_per_key, row_key
from hirelode.session import materialize

BUCKETS = 64
LAYOUT = "_layout"


def _layout(spark: SparkSession, path: str, wanted: str) -> str:
    """The layout a folder was made with; `wanted`, written down, if it is new."""
    folder = f"{path.rstrip('/')}/{LAYOUT}"
    try:
        return spark.read.text(folder).first().value
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(folder)
    return wanted


def keyed_table(
    spark: SparkSession, path: str, schema: T.StructType, key: str, run: str = "run_id", buckets: int = BUCKETS
) -> DataFrame:
    """The table at `path`, made if it is not there: columns of `schema`, and the run as a partition.

    The number of buckets is that the table was made with. Whoever inserts reads it anew through this
    function, which looks for runs that others have written.
    """
    used, stored = _layout(spark, path, f"{buckets} {key}").split(" ", 1)
    if stored != key:
        raise ValueError(f"{path} is laid out by {stored}")
    name = _register(spark, path, schema, key, run, int(used))
    return spark.table(name)


def _name(path: str) -> str:
    return "keyed_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:24]


def _register(spark: SparkSession, path: str, schema: T.StructType, key: str, run: str, buckets: int) -> str:
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != run)
        where = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}, `{run}` bigint) USING parquet PARTITIONED BY (`{run}`) "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{where}'"
        )
    spark.sql(f"MSCK REPAIR TABLE {name}")
    spark.catalog.refreshTable(name)
    return name


def write_keyed(table: DataFrame, rows: DataFrame, path: str, run_id: int, run: str = "run_id") -> None:
    """Make `rows` the partition of a run, whatever it held before."""
    spark = rows.sparkSession
    view = f"{_name(path)}_rows"
    rows.select(*[c for c in table.columns if c != run]).createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT OVERWRITE TABLE {_name(path)} PARTITION (`{run}` = {int(run_id)}) SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


def other_runs(table: DataFrame, run_id: int, run: str = "run_id") -> DataFrame:
    """What a run has to know: the rows of the runs before it. Its own, if it ran before, do not count."""
    return table.filter(F.col(run) < run_id)


def stored_key(columns: Sequence[str], link: str, width: int = 8) -> Column:
    """The key of `row_key` as text, which tells links and rows without one apart."""
    key = row_key(columns, link, width)
    return F.concat(key["tag"], F.lit(":"), F.to_json(key["cells"]))


def upsert(
    batch: DataFrame, path: str, run_id: int, columns: Sequence[str], link: str,
    order: Sequence[Column | str], width: int = 8, buckets: int = BUCKETS,
) -> dict[str, int]:
    """Insert the rows of `batch` that no earlier run has and that are the first of their key in it.

    A key is the link of a row or else its first `width` cells. Returns how many rows were inserted and
    skipped, counted while they are written. A run that is run again gives the same table and counts; runs
    go in the order of their numbers.
    """
    keyed = batch.select("*", stored_key(columns, link, width).alias("_key"))
    table = keyed_table(batch.sparkSession, path, keyed.schema, "_key", buckets=buckets)
    if batch.isEmpty():
        # Its plan would be simplified until nothing is left to observe.
        write_keyed(table, keyed, path, run_id)
        return {"inserted": 0, "skipped": 0}
    seen, made = Observation(), Observation()
    first = first_per_key(keyed.observe(seen, F.count(F.lit(1)).alias("rows")), ["_key"], order)
    new = first.join(other_runs(table, run_id).select("_key"), "_key", "left_anti")
    # The table is read and written, so what goes in is made first.
    ready = materialize(new.observe(made, F.count(F.lit(1)).alias("rows")))
    write_keyed(table, ready, path, run_id)
    inserted = made.get["rows"]
    return {"inserted": inserted, "skipped": seen.get["rows"] - inserted}
