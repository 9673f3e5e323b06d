"""Registered queries on feeds, states and records: unions of providers, run states, winds, periods, what a map shows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import labels
from emberline.operators import facilities as fac_ops
from emberline.operators import grid, layers
from emberline.plans import views
from emberline.plans.queries import BAND, HISTORY, _associated, _associated_sql, _records, query, r
from emberline.sources import readers, sinks
from emberline.sources.shared import materialise, read_table, shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/emberline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def _write_feeds(spark: SparkSession, d: str) -> dict[str, str]:
    """The detections as four providers' feeds, by their type; those of the fifth type have no feed."""
    p, base = views.plumes(spark, d), _folder(spark)
    own = lambda name: p.where(F.col("provider") == name)
    pages = lambda rows, item: rows.groupBy((F.col("plume_id") / 500).cast("long").alias("page")).agg(F.collect_list(item).alias("items")).select(F.to_json(F.struct("items")).alias("value"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    item = F.struct(F.col("plume_id").cast("string").alias("plume_id"), geometry.alias("geometry_json"), F.lit("a").alias("instrument"), F.col("datetime_utc").alias("scene_timestamp"), F.col("rate").alias("emission_auto"))
    corner = F.struct(F.struct(F.struct(F.array(F.struct(F.col("lon").alias("Longitude"), F.col("lat").alias("Latitude"))).alias("Points")).alias("Geometry")).alias("HorizontalSpatialDomain"))
    granule = F.struct(F.struct(F.col("plume_id").cast("string").alias("GranuleUR"), corner.alias("SpatialExtent"), F.struct(F.col("datetime_utc").alias("SingleDateTime")).alias("TemporalExtent")).alias("umm"))
    # A page is a file, so its rows meet in one task; pages have 500 rows.
    pages(own("view"), item).repartition(F.xxhash64("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(f"{base}/cm")
    pages(own("click"), granule).write.option("maxRecordsPerFile", 1).text(f"{base}/emit")
    imeo = own("purchase").select(F.col("plume_id").alias("id_plume"), "lat", "lon", F.lit("b").alias("satellite"), F.col("datetime_utc").alias("tile_date"), F.col("rate").alias("ch4_fluxrate"), F.lit("").alias("ch4_fluxrate_std"), F.lit(" ").alias("sector"))
    imeo.write.option("header", True).csv(f"{base}/imeo")
    day = F.date_format(F.col("day").cast("date"), "yyyyMMdd")
    sron = own("signup").select(day.alias(" Date"), F.substring("datetime_utc", 12, 8).alias("time_utc "), (F.col("lat") + F.lit(2e-5)).alias("lat"), (F.col("lon") + F.lit(2e-5)).alias("lon"), (F.col("rate") / 1000).alias("source_rate_t/h"), F.lit("").alias("uncertainty_t/h"))
    sron.write.option("header", True).csv(f"{base}/sron")
    return {"Carbon Mapper": f"{base}/cm", "EMIT": f"{base}/emit", "IMEO": f"{base}/imeo/", "SRON": f"{base}/sron"}


@query("pl", """SELECT CASE provider WHEN 'view' THEN 'cm:' || plume_id::VARCHAR WHEN 'click' THEN 'emit:' || plume_id::VARCHAR WHEN 'purchase' THEN 'imeo:' || plume_id::VARCHAR ELSE 'sron:' || replace(day, '-', '') || '-' || printf('%.3f', lat + 2e-5) || '-' || printf('%.3f', lon + 2e-5) END AS plume_id,
    CASE provider WHEN 'view' THEN 'Carbon Mapper' WHEN 'click' THEN 'EMIT' WHEN 'purchase' THEN 'IMEO' ELSE 'SRON' END AS provider, datetime_utc, round_even(CASE WHEN provider = 'signup' THEN lon + 2e-5 ELSE lon END, 6) AS lon, round_even(CASE WHEN provider = 'signup' THEN lat + 2e-5 ELSE lat END, 6) AS lat, CASE WHEN provider <> 'click' THEN round_even(rate, 3) END AS emission_kg_hr
    FROM pl WHERE provider IN ('view', 'click', 'purchase', 'signup') AND lon BETWEEN 108 AND 160 AND lat BETWEEN -45 AND 1""")  # fmt: skip
def provider_union(spark: SparkSession, d: str) -> DataFrame:
    """Four providers' feeds, written and read, in one schema."""
    out, notes = readers.all_plumes(spark, _write_feeds(spark, d))
    if notes:
        raise ValueError(str(notes))
    return out.select("plume_id", "provider", "datetime_utc", r("lon", 6), r("lat", 6), r("emission_kg_hr", 3))


@query("pl", "SELECT plume_id, provider FROM pl WHERE day >= '2024-01-25'")
def seen_state(spark: SparkSession, d: str) -> DataFrame:
    """S26, K04, T-C, G07: a run's ids and counts kept as its state, and the next run's new ids; it is refused if a provider fell silent."""
    p, path = views.plumes(spark, d), _folder(spark)
    counted = lambda x: x.groupBy("provider").agg(F.count("*").alias("n"))
    before = p.where("day < '2024-01-25'")
    sinks.write_state(before.select("plume_id"), f"{path}/ids")
    sinks.write_state(counted(before), f"{path}/counts")
    fac_ops.guard_regressions(readers.read_state(spark, f"{path}/counts", "provider string, n bigint"), counted(p))
    fresh = fac_ops.new_ids(p.select("plume_id"), readers.read_state(spark, f"{path}/ids", "plume_id bigint"))
    return p.join(fresh, "plume_id", "left_semi").select("plume_id", "provider")


@query("pl vtx", "+ " + _associated_sql("pl") + f""", aa AS (SELECT pl.plume_id, day, datetime_utc, coalesce(p.km, a.km) AS nearest_km, p.km AS facility_km, {BAND} AS association FROM pl LEFT JOIN a ON a.plume_id = pl.plume_id AND a.k = 1 LEFT JOIN p ON p.plume_id = pl.plume_id AND p.k = 1)
    SELECT count(*) AS "count", min_by(datetime_utc, (DATE '2024-02-01' - day::DATE) * 1000000 + plume_id) AS newest_detection, min(DATE '2024-02-01' - day::DATE)::INT AS newest_days_old, count(nearest_km) AS near_infrastructure, count(facility_km) AS near_facility,
    count(*) FILTER (association = 'high') AS high_confidence, count(*) FILTER (day >= '2024-01-25') AS new_since_last_run FROM aa""")  # fmt: skip
def plume_status(spark: SparkSession, d: str) -> DataFrame:
    """The status of a run, with the newest detection."""
    p = views.plumes(spark, d)
    near = _associated(p.drop("facility_name", "facility_layer", "facility_km"), views.vertices(spark, d))
    return fac_ops.run_status(near, p.where("day >= '2024-01-25'").select("plume_id"), "2024-02-01")


@query("", """WITH w AS (SELECT user_id % 5 AS place, strftime(ts, '%Y-%m-%dT%H:00') AS hour, avg(value) + 137e-4 AS speed, avg(value) * 3 + 137e-4 AS direction FROM events GROUP BY ALL)
    SELECT event_id AS id, CASE WHEN DATE '2024-01-31' - ts::DATE > 10 THEN 'archive' ELSE 'forecast' END AS source, round_even(direction, 0) AS wind_from_deg, round_even((direction + 180) % 360, 0) AS plume_toward_deg, round_even(speed / 3.6, 1) AS wind_speed_ms
    FROM events LEFT JOIN (SELECT * FROM w WHERE hour[12:13]::INT % 6 <> 0) w ON place = user_id % 5 AND hour = strftime(ts, '%Y-%m-%dT%H:00')""")  # fmt: skip
def wind_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Hourly arrays of a place's day to hours, and the wind of each event's hour; every sixth hour has none."""
    e = read_table(spark, d, "events").withColumn("place", F.col("user_id") % 5).withColumn("hour", F.date_format("ts", "yyyy-MM-dd'T'HH':00'"))
    w = e.groupBy("place", "hour").agg((F.avg("value") + F.lit(137e-4)).alias("s"), (F.avg("value") * 3 + F.lit(137e-4)).alias("d"))
    told = F.substring("hour", 12, 2).cast("int") % 6 != 0
    days = w.groupBy("place", F.substring("hour", 1, 10).alias("day")).agg(F.array_sort(F.collect_list(F.struct("hour", F.when(told, F.col("s")).alias("s"), F.col("d").alias("d")))).alias("h"))
    part = lambda name: F.transform("h", lambda x: x[name])
    wind = readers.hourly(days.select("place", part("hour").alias("time"), part("s").alias("wind_speed_10m"), part("d").alias("wind_direction_10m")))
    plumes = e.select("event_id", "place", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime_utc"))
    return readers.wind_at(plumes, wind, "2024-01-31").select(F.col("event_id").alias("id"), "source", "wind_from_deg", "plume_toward_deg", "wind_speed_ms")


@query("", """WITH m AS (SELECT d, least(d + INTERVAL 1 MONTH, TIMESTAMP '2001-10-15') AS last FROM (SELECT unnest(generate_series(TIMESTAMP '1995-02-01', TIMESTAMP '2001-10-14', INTERVAL 1 MONTH)) AS d))
    SELECT strftime(d, '%Y-%m') AS label, d::DATE AS first, last::DATE AS last, count(l_orderkey) AS n FROM m LEFT JOIN lineitem ON l_shipdate >= d AND l_shipdate < last GROUP BY ALL""")  # fmt: skip
def period_join(spark: SparkSession, d: str) -> DataFrame:
    """The months from one day to another, and what falls into each; the first begins before the start."""
    day = lambda x: F.lit(x).cast("date")
    months = spark.range(1).select(F.inline(labels.month_periods(day("1995-02-10"), day("2001-10-15"))))
    t = read_table(spark, d, "lineitem").withColumn("ship", F.col("l_shipdate").cast("date"))
    # A day's month names its period, so the interval join is an equi-join; the last one ends early.
    counted = t.where((F.col("ship") >= F.trunc(day("1995-02-10"), "month")) & (F.col("ship") < day("2001-10-15"))).groupBy(labels.month_label(F.col("ship")).alias("label")).agg(F.count("*").alias("n"))
    return months.join(counted, "label", "left").select("label", "first", "last", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("", """WITH w AS (SELECT d, least(d + INTERVAL 7 DAY, TIMESTAMP '2024-01-28') AS last FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-27', INTERVAL 7 DAY)) AS d))
    SELECT printf('%04d-W%02d', isoyear(d), week(d)) AS label, d::DATE AS first, last::DATE AS last, count(event_id) AS n FROM w LEFT JOIN events ON ts >= d AND ts < last GROUP BY ALL""")  # fmt: skip
def week_join(spark: SparkSession, d: str) -> DataFrame:
    """the same for weeks."""
    day = lambda x: F.lit(x).cast("date")
    weeks = spark.range(1).select(F.inline(labels.week_periods(day("2024-01-04"), day("2024-01-28"))))
    e = read_table(spark, d, "events").withColumn("at", F.col("ts").cast("date")).where((F.col("at") >= F.trunc(day("2024-01-04"), "week")) & (F.col("at") < day("2024-01-28")))
    counted = e.groupBy(labels.iso_week_label(F.col("at")).alias("label")).agg(F.count("*").alias("n"))
    return weeks.join(counted, "label", "left").select("label", "first", "last", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("pl", HISTORY + ", q AS (SELECT *, CASE WHEN fac_id % 3 <> 0 THEN (fac_id * 37) % 2000 / 1e0 ELSE 0 END AS reported_kg_hr FROM st) SELECT fac_id, detections, reported_kg_hr FROM q WHERE reported_kg_hr <> 0 AND detections > 0")
def rated_facilities(spark: SparkSession, d: str) -> DataFrame:
    """Facilities that report and were seen, without fields that are no longer written."""
    records = _records(spark, d).withColumn("reported_kg_hr", F.when(F.col("fac_id") % 3 != 0, (F.col("fac_id") * 37) % 2000 / F.lit(1e0)).otherwise(0.0)).withColumn("imagery", F.lit("old"))
    return fac_ops.rated(layers.without_retired(records)).select("fac_id", "detections", "reported_kg_hr")


@query("pl", "SELECT plume_id, day FROM pl WHERE plume_id % 2 = 0 AND plume_id % 3 <> 1 AND datetime_utc >= '2024-01-10' AND facility_layer IN ('coal_mines', 'pipelines_oil')")
def map_filter(spark: SparkSession, d: str) -> DataFrame:
    """Detections with imagery and a direction since a day, of the layers that are switched on."""
    p = views.plumes(spark, d).withColumn("has_imagery", F.when(F.col("plume_id") % 2 == 0, 1)).withColumn("plume_toward_deg", F.when(F.col("plume_id") % 3 != 1, F.col("plume_id") % 360))
    held = p.where((F.col("has_imagery") == 1) & F.col("plume_toward_deg").isNotNull() & (F.col("datetime_utc") >= "2024-01-10"))
    return layers.shown(held.withColumn("layer", F.col("facility_layer")), ["coal_mines", "pipelines_oil"]).select("plume_id", "day")


@query("pl", HISTORY + "SELECT fac_id, CASE watch_status WHEN 'emitting' THEN '#d9480f' WHEN 'watched, no plume' THEN '#0b7285' WHEN 'under-observed' THEN '#b0851f' WHEN 'blind spot' THEN '#868e96' ELSE '#adb5bd' END AS colour, CASE WHEN detections > 0 THEN 4.0::DOUBLE ELSE 2.5 END AS far, CASE WHEN detections > 0 THEN 9.0::DOUBLE ELSE 5.0 END AS near FROM st")
def facility_marks(spark: SparkSession, d: str) -> DataFrame:
    """facilities' colours by status, and their circles' radii."""
    return _records(spark, d).select("fac_id", layers.status_colour(F.col("watch_status")).alias("colour"), layers.facility_radius(F.col("detections"), False).alias("far"), layers.facility_radius(F.col("detections"), True).alias("near"))


@query("", "SELECT event_id AS id, floor((epoch_ms(TIMESTAMP '2024-02-01 12:00:00') - epoch_ms(date_trunc('second', ts))) / 86400000)::BIGINT AS days FROM events")
def days_ago(spark: SparkSession, d: str) -> DataFrame:
    """whole days of 24 hours since each event."""
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    return read_table(spark, d, "events").select(F.col("event_id").alias("id"), labels.days_ago(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), now).alias("days"))


@query("", """WITH g AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'empty' ELSE 'ok' END AS status, value FROM events) SELECT id, status, CASE WHEN status = 'ok' THEN 2 ELSE 0 END AS n FROM g""")
def granule_status(spark: SparkSession, d: str) -> DataFrame:
    """T-E, S12: granules read each by itself: a broken one fails alone, and the preferred variable is taken."""
    k = F.col("event_id") % 4
    good = F.to_json(F.array(F.struct(F.col("value").alias("corrected"), F.col("user_id").alias("n")), F.struct(F.lit(1.5).alias("corrected"), F.lit(0).cast("long").alias("n"))))
    content = F.when(k == 0, F.lit('[{"corrected": ')).when(k == 1, F.lit("[]")).otherwise(good)
    soundings, status = readers.read_granules(read_table(spark, d, "events").select(F.col("event_id").alias("id"), content.alias("content")), "corrected: double, n: bigint")
    n = grid.preferred(soundings, ["destriped", "corrected", "raw"]).where("value IS NOT NULL").groupBy("id").agg(F.count("*").cast("int").alias("n"))
    return status.join(n, "id", "left").select("id", "status", F.coalesce("n", F.lit(0)).alias("n"))


@query("", """SELECT '{"type":"Feature","properties":{"id":' || o_orderkey::VARCHAR || CASE WHEN o_orderkey % 3 <> 0 THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || ',"notes":"a; b"},"geometry":{"type":"Point","coordinates":[' || (o_custkey % 50)::VARCHAR || ',' || (o_orderkey % 40)::VARCHAR || ']}}' AS value FROM orders""")
def feature_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows as GeoJSON features, without blank and null properties, lists joined."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderstatus")).alias("status"), F.array(F.lit("a"), F.lit("b")).alias("notes"), F.lit(None).cast("string").alias("none"), (F.col("o_custkey") % 50).alias("lon"), (F.col("o_orderkey") % 40).alias("lat"))
    return sinks.as_features(o)


@query("fac", "SELECT layer, count(*) AS n FROM fac GROUP BY layer")
def layer_files(spark: SparkSession, d: str) -> DataFrame:
    """Layers written as files of GeoJSON features and read again, counted by layer."""
    path = _folder(spark)
    f = views.facilities(spark, d)
    props = F.struct(F.col("fac_id").cast("string").alias("objectid"), "name", F.lit("Operating").alias("operational_status"), "state")
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array("lon", "lat"), F.array(F.col("lon") + 1, "lat")).alias("coordinates"))
    parts = []
    for layer in layers.LAYERS:
        own = f.where(F.col("layer") == layer).select((F.col("fac_id") / 4000).cast("long").alias("page"), F.struct(props.alias("properties"), line.alias("geometry")).alias("f"))
        own.groupBy("page").agg(F.collect_list("f").alias("features")).select(F.to_json(F.struct("features")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/{layer}")
        parts.append(readers.pipelines(spark, f"{path}/{layer}", layer))
    return sinks.write_layers(materialise(fac_ops.union_layers(parts), "layers"), f"{path}/written")
