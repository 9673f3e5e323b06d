"""Histories of facilities, keyed by layer and name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(facilities: DataFrame, plumes: DataFrame) -> DataFrame:
    """facilities with detections and, where there are any, dates, providers, rates and the closest distance.

    Rates of zero count as missing. Facilities of one layer and name share a history. The median rate is the upper
    middle one, found by ranks over a facility's different rates; none are gathered.
    """
    key = ["name", "layer"]
    rate = F.when(F.col("rate") != 0, F.col("rate"))
    own = plumes.where(F.col("facility_name").isNotNull()).withColumnsRenamed({"facility_name": "name", "facility_layer": "layer"})
    held = own.groupBy(*key).agg(
        F.count("*").alias("detections"), F.min("datetime_utc").alias("first_detection"), F.max("datetime_utc").alias("last_detection"), F.array_sort(F.collect_set("provider")).alias("providers"),
        F.max(rate).alias("max_rate"), F.min(F.coalesce("facility_km", F.lit(0.0))).alias("closest_km"),
    )
    each = own.where(rate.isNotNull()).groupBy(*key, "rate").agg(F.count("*").alias("k"))
    every = Window.partitionBy(*key)
    ranked = each.select(*key, "rate", "k", F.sum("k").over(every.orderBy("rate")).alias("upto"), F.sum("k").over(every).alias("n"))
    middle = ranked.where((F.col("upto") - F.col("k") <= F.floor(F.col("n") / 2)) & (F.floor(F.col("n") / 2) < F.col("upto"))).select(*key, F.col("rate").alias("median_rate"))
    out = facilities.join(held.join(middle, key, "left"), key, "left")
    return out.withColumn("detections", F.coalesce("detections", F.lit(0).cast("long")))


def stamp_back(layers: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """layers with the fields of the last record of the same layer and name, where that has a value.

    records: layer, name, ord and the fields.
    """
    last = records.groupBy("layer", "name").agg(F.max_by(F.struct(*fields), "ord").alias("new"))
    joined = layers.join(last, ["layer", "name"], "left")
    return joined.withColumns({f: F.coalesce(F.col(f"new.{f}"), F.col(f)) if f in layers.columns else F.col(f"new.{f}") for f in fields}).drop("new")


def plant_units(plants: DataFrame, prefix: str = "gas") -> DataFrame:
    """Plants that have a unit whose fuel starts with prefix, with capacity, fuels, status and subtype of those units.

    plants: units, an array of fuel, capacity and status.
    """
    held = plants.withColumn("own", F.filter("units", lambda u: u["fuel"].startswith(prefix))).where(F.size("own") > 0)
    statuses = F.array_sort(F.array_distinct(F.transform("own", lambda u: F.lower(F.coalesce(u["status"], F.lit(""))))))
    fuels = F.array_sort(F.array_distinct(F.transform("own", lambda u: u["fuel"])))
    held = held.withColumn("capacity_mw", F.aggregate("own", F.lit(0.0), lambda a, u: a + F.coalesce(u["capacity"], F.lit(0.0)))).withColumn("fuels", fuels)
    status = F.when(F.array_contains(statuses, "operating"), "operating").otherwise(F.coalesce(F.try_element_at(statuses, F.lit(1)), F.lit("unknown")))
    subtype = F.when(F.col("fuels") == F.array(F.lit("gas_wcmg")), "waste coal mine gas").otherwise("gas power station")
    return held.withColumn("status", status).withColumn("subtype", subtype).drop("own")


def new_ids(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Ids that weren't there before; none if nothing was, so a first run is silent."""
    some = previous.limit(1).select(F.lit(1).alias("any"))
    return current.join(previous, "plume_id", "left_anti").join(F.broadcast(some), F.lit(True), "left_semi")


def regressions(before: DataFrame, now: DataFrame) -> DataFrame:
    """Providers that had rows and have none; before and now: provider and n."""
    return before.where("n > 0").join(now.select("provider", F.col("n").alias("n_now")), "provider", "left").where("coalesce(n_now, 0) = 0").select("provider", "n")


def guard_regressions(before: DataFrame, now: DataFrame) -> None:
    """Refuses a run in which a provider fell silent: a ValueError that names them, before anything is written."""
    lost = [r["provider"] for r in regressions(before, now).sort("provider").limit(100).collect()]
    if lost:
        raise ValueError("providers without rows: " + ", ".join(map(str, lost)))


def upsert(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """index with the rows in place of those of the same key."""
    return index.join(rows.select(key), key, "left_anti").unionByName(rows)


def periods_to_do(requested: DataFrame, index: DataFrame, refresh: DataFrame | None = None) -> DataFrame:
    """Requested periods that the index hasn't, and those to refresh."""
    done = index.select("period") if refresh is None else index.select("period").join(refresh.select("period"), "period", "left_anti")
    return requested.join(done, "period", "left_anti")


def run_status(plumes: DataFrame, fresh: DataFrame, as_of: str) -> DataFrame:
    """One row: how many plumes there are, are new, and lie near something, and the newest detection with its age in days.

    plumes: plume_id, datetime_utc, nearest_km, facility_km, association. fresh: the new ones' plume_id. A time that
    can't be read is no detection's; of equally old ones the smallest plume_id is the newest.
    """
    age = F.datediff(F.lit(as_of).cast("date"), F.substring("datetime_utc", 1, 10).try_cast("date"))
    aged = plumes.withColumn("age", age).withColumn("first", F.struct("age", "plume_id"))
    held = aged.agg(
        F.count("*").alias("count"), F.min_by("datetime_utc", F.when(F.col("age").isNotNull(), F.col("first"))).alias("newest_detection"), F.min("age").alias("newest_days_old"),
        F.count("nearest_km").alias("near_infrastructure"), F.count("facility_km").alias("near_facility"), F.count_if(F.col("association") == "high").alias("high_confidence"),
    )
    return held.join(fresh.agg(F.count("*").alias("new_since_last_run")), F.lit(True))


def rated(records: DataFrame) -> DataFrame:
    """Facilities that report something and were seen emitting."""
    return records.where((F.col("reported_kg_hr") != 0) & (F.col("detections") > 0))


def union_layers(parts: list[DataFrame]) -> DataFrame:
    """Tables of one layout or with columns that others lack, put together."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
