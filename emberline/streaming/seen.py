"""New detections of landed runs, as a stream that remembers every id: an extension, as a run here reads files that are added to.

Ids are spread over BUCKETS keys, and a key's state is its ids that were seen; so an id is reported once, whatever run or file
it comes in again. The first run reports nothing, as everything is new then. A run in which a provider fell silent is refused before it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.operators.facilities import guard_regressions
from emberline.sources.commits import _store

ROOT_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys over which ids are spread: a key's ids are read and written at once, a billion of them some 60,000 to each of so many.
BUCKETS = 16384


class FirstSight(StatefulProcessor):
    """Passes on the first row of each id of a bucket, and none after it."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getValueState("ids", "ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        seen = set(self.ids.get()[0]) if self.ids.exists() else set()
        before = len(seen)
        for batch in rows:
            names = batch[self.key].astype(str)
            fresh = ~names.isin(seen) & ~names.duplicated()
            seen.update(names[fresh])
            yield batch[fresh].drop(columns="bucket")
        if len(seen) > before:
            self.ids.update((sorted(seen),))

    def close(self) -> None:
        pass


def first_sights(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The first row of each key of a stream, once over all its runs."""
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)))
    return spread.groupBy("bucket").transformWithStateInPandas(statefulProcessor=FirstSight(key), outputStructType=rows.schema, outputMode="Append", timeMode="None")


def run_new_ids(spark: SparkSession, landed: str, table: str, schema: str, run: str, key: str = "plume_id", provider: str = "provider", buckets: int = BUCKETS) -> DataFrame:
    """Reads the files of landed/run=* that weren't read yet; the rows found new for this run, a row for each id, none for the first run.

    Files of several runs that landed at once count for the run that is asked for first. Progress, ids and counts are kept in
    table, so a run that was stopped goes on where it ended. Rows without an id are left out. Raises, and reads nothing, if a
    provider that had rows in the run before has none in this one.
    """
    store, place = _store(spark, table)
    counts = spark.read.schema(schema).parquet(f"{landed}/run={run}").groupBy(F.col(provider).alias("provider")).agg(F.count("*").alias("n"))
    if store.exists(place(f"{table}/counts/_SUCCESS")):
        guard_regressions(spark.read.schema("provider string, n bigint").parquet(f"{table}/counts"), counts)
    began = store.exists(place(f"{table}/first_run_done"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROOT_DB)
    try:
        rows = spark.readStream.schema(f"{schema}, run string").option("basePath", landed).parquet(f"{landed}/run=*").where(F.col(key).isNotNull())

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumns({"silent": F.lit(not began), "found_for": F.lit(run)}).write.mode("overwrite").parquet(f"{table}/rows/batch={number:012d}")

        stream = first_sights(rows, key, buckets).writeStream.outputMode("append").option("checkpointLocation", f"{table}/progress")
        stream.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    counts.write.mode("overwrite").parquet(f"{table}/counts")
    store.create(place(f"{table}/first_run_done"), True).close()
    found = spark.read.schema(f"{schema}, run string, silent boolean, found_for string").parquet(f"{table}/rows/batch=*")
    return found.where((F.col("found_for") == run) & ~F.col("silent")).drop("silent", "found_for")
