"""The tables that queries run on, derived from the given ones, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import layers
from emberline.sources.shared import MANY, read_table

#: The part of the analysis grid that the derived soundings fill.
GRID_ROWS, GRID_COLS = 20, 30


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    layer = F.element_at(F.array(*[F.lit(x) for x in ("coal_mines", "gas_plants", "pipelines_gas", "pipelines_oil")]), (k % 4 + 1).cast("int"))
    state = F.element_at(F.array(*[F.lit(x) for x in ("QLD", "NSW", "")]), (k % 3 + 1).cast("int"))
    return read_table(spark, sf_dir, "part").select(
        k.alias("fac_id"), F.col("p_name").alias("name"), layer.alias("layer"), (k % 4).alias("layer_ord"), state.alias("state"),
        (F.lit(108) + ((k * 7919) % 52000) / F.lit(1e3)).alias("lon"), (F.lit(-45) + ((k * 104729) % 46000) / F.lit(1e3)).alias("lat"),
    )


def plumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections near a facility; every third is attributed to it, and those of a multiple of 11 have no rate."""
    fac = facilities(spark, sf_dir)
    n = fac.count()
    e = read_table(spark, sf_dir, "events").withColumn("fac_id", (F.col("event_id") * 31) % n)
    k = F.col("event_id")
    # Names compress so well that Spark would broadcast millions of facilities, by the size of their file.
    near = e.join(fac.hint("merge") if n > MANY else fac, "fac_id")
    third = k % 3 == 0
    return near.select(
        k.alias("plume_id"), F.col("event_type").alias("provider"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime_utc"),
        F.when(k % 11 != 0, F.col("value")).alias("rate"), (F.col("lon") + ((k * 17) % 401 - 200) / F.lit(2e3)).alias("lon"), (F.col("lat") + ((k * 29) % 401 - 200) / F.lit(2e3)).alias("lat"),
        F.when(third, F.col("name")).alias("facility_name"), F.when(third, F.col("layer")).alias("facility_layer"), F.when(third, ((k * 13) % 1000) / F.lit(1e2)).alias("facility_km"),
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of the facilities: one of a mine or plant, three of a pipeline."""
    k = F.explode(F.when(F.col("layer_ord") < 2, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2))))
    each = facilities(spark, sf_dir).withColumn("k", k)
    point = F.struct((F.col("lon") + F.col("k") * F.lit(1e-2)).alias("lon"), (F.col("lat") + F.col("k") * F.lit(5e-3)).alias("lat"))
    features = each.groupBy("fac_id", "name", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", point.alias("p")))), lambda x: x["p"]).alias("coords"))
    return layers.vertex_table(features.withColumnRenamed("fac_id", "feature_ord"))


#: The cell and value of a line's sounding, as the same text for Spark and the SQL: two thirds of them crowd a corner, and a lake has none over land.
_AT = (
    ("h", "l_partkey * 7919 + l_linenumber * 31"),
    ("c", "(l_partkey * 7919 + l_linenumber * 31) // 3 % CASE l_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 30 END"),
    ("r", "(l_orderkey * 104729 + l_suppkey * 17) // 5 % CASE l_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 20 END"),
)
_SOUNDING = (
    "108 + c * 5e-2 + 1e-2 + (h % 30) / 1e3 AS lon", "1 - r * 5e-2 - 1e-2 - (h % 31) / 1e3 AS lat", "l_discount * 10 + 3e-1 AS qa",
    "CASE WHEN r BETWEEN 13 AND 15 AND c BETWEEN 20 AND 24 OR l_linenumber = 3 THEN 1 ELSE 2 * l_linenumber END AS surface",
    "18e2 + sqrt(l_extendedprice) * 7 % 5e1 + CASE WHEN (r * 7 + c * 3) % 23 = 0 THEN 25e0 ELSE 0e0 END AS value",
)


def soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soundings of half-years."""
    half = F.floor((F.quarter("l_shipdate") + 1) / 2).cast("string")
    t = read_table(spark, sf_dir, "lineitem").withColumn("period", F.concat(F.date_format("l_shipdate", "yyyy"), F.lit("-H"), half))
    at = F.struct(*[F.expr(x.replace("//", "div")).alias(name) for name, x in _AT])
    return t.select("period", "l_discount", "l_linenumber", "l_extendedprice", F.inline(F.array(at))).selectExpr("period", *_SOUNDING)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stack of scenes a label: pixels are the vector's positions, in rows of 8."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("label").alias("site"), F.col("vec_id").alias("scene"), F.posexplode("embedding").alias("p", "v"))
    k = F.col("scene") * 7 + F.col("p") * 3
    return e.select("site", "scene", (F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).alias("col"), (F.col("v").cast("double") + 2).alias("b12"), F.lit(2.0).alias("b11"), (k % 12).cast("int").alias("scl"))


SQL = {
    "fac": """SELECT p_partkey AS fac_id, p_name AS name,
        CASE p_partkey % 4 WHEN 0 THEN 'coal_mines' WHEN 1 THEN 'gas_plants' WHEN 2 THEN 'pipelines_gas' ELSE 'pipelines_oil' END AS layer, p_partkey % 4 AS layer_ord,
        CASE p_partkey % 3 WHEN 0 THEN 'QLD' WHEN 1 THEN 'NSW' ELSE '' END AS state,
        108 + ((p_partkey * 7919) % 52000) / 1e3 AS lon, -45 + ((p_partkey * 104729) % 46000) / 1e3 AS lat FROM part""",
    "pl": """SELECT event_id AS plume_id, event_type AS provider, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS datetime_utc,
        CASE WHEN event_id % 11 <> 0 THEN value END AS rate, f.lon + ((event_id * 17) % 401 - 200) / 2e3 AS lon, f.lat + ((event_id * 29) % 401 - 200) / 2e3 AS lat,
        CASE WHEN event_id % 3 = 0 THEN f.name END AS facility_name, CASE WHEN event_id % 3 = 0 THEN f.layer END AS facility_layer,
        CASE WHEN event_id % 3 = 0 THEN ((event_id * 13) % 1000) / 1e2 END AS facility_km
        FROM events e JOIN fac f ON f.fac_id = (e.event_id * 31) % (SELECT count(*) FROM part)""",
    "vtx": """SELECT fac_id, name, layer, layer_ord, fac_id AS feature_ord, k AS vertex_ord, lon + k * 1e-2 AS lon, lat + k * 5e-3 AS lat
        FROM fac JOIN (SELECT unnest([0, 1, 2]) AS k) ON k = 0 OR layer_ord >= 2""",
    "snd": "SELECT strftime(l_shipdate, '%Y') || '-H' || ((quarter(l_shipdate) + 1) // 2)::VARCHAR AS period, " + ", ".join(_SOUNDING) + " FROM (SELECT *, " + ", ".join(f"{x} AS {name}" for name, x in _AT) + " FROM lineitem)",
    "usable": "SELECT * FROM snd WHERE qa >= 0.5 AND surface & 1 = 0 AND lon >= 108 AND lon < 160 AND lat >= -45 AND lat < 1",
    "cells": """SELECT period, least(greatest(trunc((1 - lat) / 0.05)::BIGINT, 0), 919) AS row, least(greatest(trunc((lon - 108) / 0.05)::BIGINT, 0), 1039) AS col,
        sum(value) AS total, count(*) AS n_obs, sum(value) / count(*) AS mean FROM usable GROUP BY ALL""",
    "bg": """SELECT r.period, r.row, CASE WHEN count(c.mean) >= 50 THEN quantile_cont(c.mean, 0.5) ELSE any_value(r.whole) END AS background
        FROM (SELECT period, whole, unnest(range(0, 20)) AS row FROM (SELECT period, quantile_cont(mean, 0.5) AS whole FROM cells GROUP BY period)) r
        LEFT JOIN cells c ON c.period = r.period AND c.row BETWEEN r.row - 20 AND r.row + 20 GROUP BY r.period, r.row""",
    "anom": "SELECT cells.*, background, CASE WHEN n_obs >= 3 THEN mean - background END AS anomaly FROM cells JOIN bg USING (period, row)",
    "stack": """SELECT row, col, count(anomaly) AS observed, count(*) FILTER (anomaly >= 18) AS elevated, avg(anomaly) AS mean_anomaly, max(anomaly) AS max_anomaly,
        avg(n_obs) AS mean_obs, stddev_pop(anomaly) AS sd FROM anom GROUP BY row, col""",
    "seen": "SELECT DISTINCT row, col FROM cells",
    "scn": """SELECT label AS site, vec_id AS scene, p // 8 AS row, p % 8 AS col, v::DOUBLE + 2 AS b12, 2.0::DOUBLE AS b11, (vec_id * 7 + p * 3) % 12 AS scl
        FROM (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS p FROM embeddings)""",
    "ratios": "SELECT *, CASE WHEN scl NOT IN (0, 1, 3, 6, 8, 9, 10, 11) AND b11 > 0 AND b12 > 0 THEN b12 / b11 END AS ratio FROM scn",
}
NEEDS = {"pl": ["fac"], "vtx": ["fac"], "usable": ["snd"], "cells": ["usable"], "bg": ["cells"], "anom": ["bg"], "stack": ["anom"], "seen": ["cells"], "ratios": ["scn"]}


def with_views(names: str, query: str) -> str:
    """query with the views it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + ",\n" * query.lstrip().startswith("+") + query.lstrip().removeprefix("+") if order else query


def spread(table: str, cell: float) -> str:
    """The rows of a table of places, once for each of the nine bins around their own."""
    return f"(SELECT s.*, floor(s.lon / {cell!r})::INT + dx AS bx, floor(s.lat / {cell!r})::INT + dy AS by FROM {table} s, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy))"


def binned(table: str, cell: float) -> str:
    """The rows of a table of places with their bin."""
    return f"(SELECT s.*, floor(s.lon / {cell!r})::INT AS bx, floor(s.lat / {cell!r})::INT AS by FROM {table} s)"


#: Decides the rows of nd (id) by the edges ed (before, after): vd has id and whether it is kept.
VERDICTS = """wk AS (SELECT id, 0 AS st, 0 AS k FROM nd UNION ALL
    SELECT wk.id, CASE WHEN wk.st <> 0 THEN wk.st WHEN bool_or(p.st = 1) THEN 2 WHEN count(p.id) FILTER (p.st = 0) = 0 THEN 1 ELSE 0 END, any_value(wk.k) + 1
    FROM wk LEFT JOIN ed ON ed.after = wk.id LEFT JOIN wk p ON p.id = ed.before WHERE (SELECT count(*) FROM wk WHERE st = 0) > 0 GROUP BY wk.id, wk.st),
    vd AS (SELECT id, st = 1 AS kept FROM wk WHERE k = (SELECT max(k) FROM wk))"""
