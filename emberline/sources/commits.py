"""Periods written one after the other, each visible only once it is whole.

path/data/period=<p>/<attempt> holds what an attempt wrote, path/index/<p>.json names the attempt that counts. The entry is
written beside the index and then renamed, which happens at once or not at all; so a run that ends anywhere leaves either no
entry, and the period is done again, or one whose attempt is whole.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ENTRY = "period string, attempt string, rows bigint"


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_attempt(df: DataFrame, path: str, period: str) -> dict:
    """Writes df as a new attempt at a period; its entry, which isn't in the index yet."""
    if not re.fullmatch(r"[A-Za-z0-9-]+", period):
        raise ValueError(f"{period!r} can't name a period")
    attempt, seen = uuid.uuid4().hex, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/data/period={period}/{attempt}")
    return {"period": period, "attempt": attempt, "rows": seen.get["rows"]}


def commit(spark: SparkSession, path: str, entry: dict) -> None:
    """Puts an entry into the index, in place of one of the same period."""
    store, place = _store(spark, path)
    waiting = place(f"{path}/index/.{entry['attempt']}")
    out = store.create(waiting, True)
    out.write(json.dumps(entry).encode())
    out.close()
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    kinds = spark.sparkContext._gateway.new_array(rename, 1)
    kinds[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(waiting, place(f"{path}/index/{entry['period']}.json"), kinds)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """period, attempt and rows of the periods that are whole."""
    store, place = _store(spark, path)
    found = store.globStatus(place(f"{path}/index/*.json"))
    return spark.read.schema(ENTRY).json(f"{path}/index/*.json") if found else spark.createDataFrame([], ENTRY)


def read_periods(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole periods, with their period; rows of attempts that don't count are never seen."""
    entries = read_index(spark, path).collect()
    if not entries:
        return spark.createDataFrame([], f"{schema}, period string")
    return spark.read.schema(f"{schema}, period string").option("basePath", f"{path}/data").parquet(*[f"{path}/data/period={e['period']}/{e['attempt']}" for e in entries])


def missing(spark: SparkSession, path: str, periods: Iterable[str]) -> list[str]:
    """Those of some periods that have no entry, or whose attempt is gone."""
    store, place = _store(spark, path)
    whole = {e["period"] for e in read_index(spark, path).collect() if store.exists(place(f"{path}/data/period={e['period']}/{e['attempt']}/_SUCCESS"))}
    return [p for p in dict.fromkeys(periods) if p not in whole]


def run_periods(spark: SparkSession, path: str, periods: Iterable[str], make: Callable[[str], DataFrame | None]) -> list[str]:
    """Makes, writes and commits each period that is missing, in order; those done. A period without a table (None) gets no entry.

    Periods are as few as a calendar's, so their names may be on the driver; their rows never are.
    """
    done = []
    for period in missing(spark, path, periods):
        df = make(period)
        if df is not None:
            commit(spark, path, write_attempt(df, path, period))
            done.append(period)
    return done


def drop_leftovers(spark: SparkSession, path: str) -> int:
    """Deletes attempts that don't count; how many. Not while a run writes."""
    store, place = _store(spark, path)
    counts = {(e["period"], e["attempt"]) for e in read_index(spark, path).collect()}
    gone = 0
    for status in store.globStatus(place(f"{path}/data/period=*/*")) or []:
        at = status.getPath()
        if (at.getParent().getName().removeprefix("period="), at.getName()) not in counts:
            gone += bool(store.delete(at, True))
    return gone
