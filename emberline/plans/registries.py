"""Registered queries on registries: their feeds are written from the given tables and read as those of a service are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import labels
from emberline.plans import views
from emberline.plans.queries import query
from emberline.plans.records import _folder, _write_feeds
from emberline.sources import readers, sinks
from emberline.sources.shared import read_table

#: Features of a collection, which is a file and so a task's.
PAGE = 500


def _collections(rows: DataFrame, path: str) -> None:
    """Writes features (ord, properties, geometry) as GeoJSON collections of PAGE features."""
    pages = rows.groupBy(F.floor(F.col("ord") / PAGE).alias("page")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "properties", "geometry"))), lambda f: F.struct(f["properties"].alias("properties"), f["geometry"].alias("geometry"))).alias("features"))).alias("value"))
    pages.select("value").write.option("maxRecordsPerFile", 1).text(path)


def _point(kind: str | None = "Point"):
    coordinates = F.array("lon", "lat").alias("coordinates")
    return F.struct(F.lit(kind).alias("type"), coordinates) if kind else F.struct(coordinates)


@query("fac", """SELECT 'ga:' || fac_id::VARCHAR AS id, CASE WHEN fac_id % 5 = 0 THEN '(unnamed)' ELSE name END AS name, CASE WHEN fac_id % 4 = 0 THEN 'closed' WHEN fac_id % 2 = 0 THEN 'historic' ELSE 'operating' END AS status, nullif(state, '') AS state, 'Point' AS geom_type, round_even(lon, 3) AS lon
    FROM fac WHERE fac_id % 3 = 0 AND fac_id % 7 <> 0""")  # fmt: skip
def coal_mine_feed(spark: SparkSession, d: str) -> DataFrame:
    """Mines of two layers, of which those of coal with a place stay; blank names, default and own states."""
    k, base = F.col("fac_id"), _folder(spark)
    group = F.when(k % 3 == 0, F.when(k % 2 == 0, " Coal ").otherwise("COAL")).otherwise("Iron")
    own = F.struct(k.alias("objectid"), F.when(k % 5 == 0, "  ").otherwise(F.col("name")).alias("name"), group.alias("commodity_group"), F.when(k % 4 == 0, "Closed").alias("status"), "state")
    rows = views.facilities(spark, d).select(k.alias("ord"), own.alias("properties"), F.when(k % 7 != 0, _point()).alias("geometry"))
    layers = {"operating": rows.where(F.col("ord") % 2 == 1), "historic": rows.where(F.col("ord") % 2 == 0)}
    for name, part in layers.items():
        _collections(part, f"{base}/{name}")
    mines = readers.coal_mines(spark, {name: f"{base}/{name}" for name in layers})
    return mines.select("id", "name", "status", "state", "geom_type", F.bround(F.element_at("coords", 1)["lon"], 3).alias("lon"))


@query("fac", """SELECT 'oe:' || CASE WHEN fac_id % 3 = 0 THEN 'S' ELSE 'F' END || fac_id::VARCHAR AS id, name, CASE WHEN fac_id % 4 = 0 THEN 0 ELSE 1 + fac_id % 3 END AS n_units,
    CASE WHEN fac_id % 4 = 0 THEN NULL ELSE (1 + fac_id % 3) * (fac_id % 100)::DOUBLE END AS capacity_mw, CASE WHEN fac_id % 4 = 0 THEN NULL ELSE 'gas_ocgt' END AS fuel FROM fac""")  # fmt: skip
def gas_plant_feed(spark: SparkSession, d: str) -> DataFrame:
    """Plants of a registry with their units, some without any, some with another key."""
    k, path = F.col("fac_id"), _folder(spark)
    unit = F.struct(F.lit("gas_ocgt").alias("fuel_tech"), (k % 100).cast("double").alias("capacity_registered"), F.lit("operating").alias("status"))
    units = F.when(k % 4 != 0, F.array_repeat(unit, (k % 3 + 1).cast("int")))
    own = F.struct(F.when(k % 3 != 0, F.concat(F.lit("F"), k)).alias("facility_id"), F.concat(F.lit("S"), k).alias("station_code"), "name", units.alias("duid_data"))
    _collections(views.facilities(spark, d).select(k.alias("ord"), own.alias("properties"), _point(None).alias("geometry")), path)
    capacity = F.when(F.size("units") > 0, F.aggregate("units", F.lit(0.0), lambda a, u: a + u["capacity"]))
    return readers.gas_plants(spark, path).select("id", "name", F.size("units").alias("n_units"), capacity.alias("capacity_mw"), F.try_element_at("units", F.lit(1))["fuel"].alias("fuel"))


@query("fac", """SELECT 'gem:P' || (fac_id // 100)::VARCHAR || ':' || CASE WHEN fac_id % 5 = 0 THEN '0' ELSE fac_id::VARCHAR END AS id, CASE WHEN fac_id % 3 = 0 THEN 'pipelines_gas' ELSE 'pipelines_oil' END AS layer, name,
    CASE WHEN fac_id % 2 = 0 THEN 'lng pipeline' WHEN fac_id % 3 = 0 THEN 'gas pipeline' ELSE 'liquid pipeline' END AS subtype, CASE WHEN fac_id % 7 <> 0 THEN (fac_id % 300)::DOUBLE END AS length_km
    FROM fac WHERE fac_id % 3 < 2 AND fac_id % 11 <> 0 AND (lon BETWEEN 108 AND 160 AND lat BETWEEN -45 AND 1 OR lon + 1 BETWEEN 108 AND 160 AND lat + 1 BETWEEN -45 AND 1) AND (lat > -10 AND lon > 140.8 OR lat + 1 > -10 AND lon + 1 > 140.8)""")  # fmt: skip
def route_archives(spark: SparkSession, d: str) -> DataFrame:
    """Routes in tar archives, a file each in the folder of its kind; others' folders, files that are no JSON and the south go."""
    k, path = F.col("fac_id"), _folder(spark)
    own = F.struct("name", F.when(k % 5 != 0, k).alias("OBJECTID"), F.when(k % 2 == 0, "LNG").alias("Product"), F.when(k % 7 != 0, k % 300).otherwise(F.lit(None)).alias("Length"))
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array("lon", "lat"), F.array(F.col("lon") + 1, F.col("lat") + 1)).alias("coordinates"))
    text = F.when(k % 11 == 0, "no json").otherwise(F.to_json(F.struct(F.array(F.struct(own.alias("properties"), line.alias("geometry"))).alias("features"))))
    folder = F.when(k % 3 == 0, "individual-routes/gas-pipelines").when(k % 3 == 1, "individual-routes/liquid-pipelines").otherwise("other")
    member = F.concat(F.lit("x/data/"), folder, F.lit("/P"), F.floor(k / 100), F.lit("-"), k, F.lit(".geojson"))
    members = views.facilities(spark, d).select(F.concat(F.lit("routes-"), F.floor(k / 100), F.lit(".tar")).alias("file"), member.alias("member"), text.alias("text"))
    sinks.write_archives(members, path, "tar").collect()
    return readers.gas_routes(spark, f"{path}/*.tar").select("id", "layer", "name", "subtype", "length_km")


@query("pl", """SELECT 'imeo:' || plume_id::VARCHAR AS plume_id, datetime_utc, round_even(lon, 6) AS lon, round_even(lat, 6) AS lat, round_even(rate, 3) AS emission_kg_hr, CASE WHEN plume_id % 2 = 0 THEN 'Oil, gas' END AS sector
    FROM pl WHERE provider = 'purchase' AND lon BETWEEN 108 AND 160 AND lat BETWEEN -45 AND 1""")  # fmt: skip
def detection_archives(spark: SparkSession, d: str) -> DataFrame:
    """Detections in CSV files in zip archives, among other files."""
    path, k = _folder(spark), F.col("plume_id")
    text = F.concat_ws(",", k.cast("string"), F.col("lat").cast("string"), F.col("lon").cast("string"), F.lit("sat"), "datetime_utc", F.coalesce(F.col("rate").cast("string"), F.lit("")), F.lit(""), F.when(k % 2 == 0, '"Oil, gas"').otherwise(""))
    head = "id_plume,lat,lon,satellite,tile_date,ch4_fluxrate,ch4_fluxrate_std,sector\n"
    part = (k / PAGE).cast("long")
    files = views.plumes(spark, d).where("provider = 'purchase'").groupBy(part.alias("part")).agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(text)), "\n"), F.lit("\n")).alias("text"))
    named = F.concat(F.lit("d-"), F.floor(F.col("part") / 4), F.lit(".zip")).alias("file")
    both = F.explode(F.array(F.struct(F.concat(F.lit("p"), "part", F.lit(".CSV")).alias("member"), "text"), F.struct(F.concat(F.lit("n"), "part", F.lit(".txt")).alias("member"), F.lit("note").alias("text")))).alias("m")
    sinks.write_archives(files.select(named, both).select("file", "m.*"), path, "zip").collect()
    return readers.imeo(spark, f"{path}/*.zip").select("plume_id", "datetime_utc", F.bround("lon", 6).alias("lon"), F.bround("lat", 6).alias("lat"), F.bround("emission_kg_hr", 3).alias("emission_kg_hr"), "sector")


@query("", """SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name || ', ' || chr(10) || '"west"' ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Café ' || s_suppkey::VARCHAR END AS operator, CASE WHEN s_suppkey % 2 = 0 THEN 'QLD' ELSE 'NSW' END AS state,
    CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN s_suppkey * 1000 + 0.5 WHEN 2 THEN s_suppkey ELSE 1234567 END::DOUBLE AS methane_tco2e, CASE WHEN s_suppkey % 2 = 0 THEN 7.0 END::DOUBLE AS covered_tco2e FROM supplier WHERE s_suppkey % 6 <> 0""")  # fmt: skip
def reported_feed(spark: SparkSession, d: str) -> DataFrame:
    """Tables of reported figures, each with lines before its header and columns in its own order; quotes, line breaks, marks for none."""
    k, path = F.col("s_suppkey"), _folder(spark)
    name = F.when(k % 6 == 0, " ").when(k % 3 == 0, F.concat(F.lit('"'), "s_name", F.lit(', \n""west"""'))).otherwise(F.col("s_name"))
    operator = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Café "), k))
    state = F.when(k % 2 == 0, "QLD").otherwise("NSW")
    methane = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, F.concat(F.lit('"$'), F.format_string("%,.1f", k * 1000 + F.lit(0.5)), F.lit('"'))).when(k % 5 == 2, k.cast("string")).otherwise('"1,234,567"')
    covered = F.when(k % 2 == 0, "7").otherwise("–")
    heads = {0: ["Facility name,Responsible emitter,State,ANZSIC,GHG Methane,Covered emissions,Baseline", [name, operator, state, F.lit("Coal"), methane, covered, F.lit("-")]], 1: ["State,Covered,GHG methane,Facility NAME,Emitter (responsible)", [state, covered, methane, name, operator]]}
    suppliers = read_table(spark, d, "supplier").select("s_suppkey", F.regexp_replace(F.trim("s_name"), ",", " ").alias("s_name"))
    for kind, (head, cells) in heads.items():
        rows = suppliers.where(F.floor(k / 50) % 2 == kind).select(F.floor(k / 50).alias("page"), F.concat_ws(",", *cells).alias("line"))
        pages = rows.groupBy("page").agg(F.concat(F.lit(f"Title, of a year\n\n{head}\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("value"))
        pages.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(path)
    found = readers.reported_figures(spark, f"{path}/*.txt")
    return found.select("name", "operator", "state", "methane_tco2e", "covered_tco2e")


@query("", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN o_orderkey * 1.5e0 WHEN 3 THEN NULL WHEN 4 THEN o_orderkey * 1e3 ELSE -o_orderkey END::DOUBLE AS number,
    CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 1000 + o_orderkey % 1000 WHEN 2 THEN o_orderkey * 1.5e0 WHEN 3 THEN NULL WHEN 4 THEN o_orderkey * 1e3 ELSE -o_orderkey END::DOUBLE AS reported FROM orders""")  # fmt: skip
def number_texts(spark: SparkSession, d: str) -> DataFrame:
    """numbers from text, with and without separators, signs and marks for none."""
    k = F.col("o_orderkey")
    text = F.when(k % 6 == 0, "N/A").when(k % 6 == 1, F.concat(F.lit("$1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 6 == 2, F.concat(F.lit(" "), (k * F.lit(1.5)).cast("string"), F.lit(" "))).when(k % 6 == 3, "–").when(k % 6 == 4, F.concat(k.cast("string"), F.lit("e3"))).otherwise(F.concat(F.lit("-"), k.cast("string")))
    t = read_table(spark, d, "orders").select(k.alias("id"), text.alias("text"))
    return t.select("id", labels.number(F.col("text")).alias("number"), labels.reported_number(F.col("text")).alias("reported"))


@query("", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' WHEN 3 THEN 'MultiPolygon' WHEN 4 THEN 'MultiPoint' END AS kind, CASE o_orderkey % 6 WHEN 5 THEN 0 ELSE 1 END AS n_vertices FROM orders""")
def geometry_types(spark: SparkSession, d: str) -> DataFrame:
    """a geometry's type, where it isn't named from how deep its coordinates lie."""
    k = F.col("o_orderkey")
    place = F.concat(F.lit("["), (k % 360).cast("string"), F.lit(", 1.5]"))
    depth = [F.lit('{"coordinates": '), F.lit('{"coordinates": ['), F.lit('{ "coordinates" : [[ '), F.lit('{"coordinates": [[[')]
    ends = ["}", "]}", "]]}", "]]]}"]
    text = F.when(k % 6 == 5, "{}").when(k % 6 == 4, F.concat(F.lit('{"type": "MultiPoint", "coordinates": ['), place, F.lit("]}")))
    for n, (begin, end) in enumerate(zip(depth, ends, strict=True)):
        text = text.when(k % 6 == n, F.concat(begin, place, F.lit(end)))
    g = read_table(spark, d, "orders").select(k.alias("id"), text.alias("g"))
    return g.select("id", readers.geometry_type(F.col("g")).alias("kind"), F.size(readers.coordinates(F.col("g"))).alias("n_vertices"))


#: A moment as seconds, against which tokens expire.
NOW = 1_700_000_000


@query("", f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE {NOW} + (c_custkey % 40 - 15) * 43200 + c_custkey % 7 END AS expires, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN (c_custkey % 40 - 15) * 43200 + c_custkey % 7 < 0 THEN 'expired'
    WHEN ((c_custkey % 40 - 15) * 43200 + c_custkey % 7) // 86400 <= 7 THEN 'expires in ' || (((c_custkey % 40 - 15) * 43200 + c_custkey % 7) // 86400)::VARCHAR || ' d' ELSE 'valid ' || (((c_custkey % 40 - 15) * 43200 + c_custkey % 7) // 86400)::VARCHAR || ' d' END AS note FROM customer""")  # fmt: skip
def token_notes(spark: SparkSession, d: str) -> DataFrame:
    """when web tokens expire, read from their payload, and what is said of it; some have no payload."""
    k = F.col("c_custkey")
    payload = F.to_json(F.struct(F.concat(F.lit("é>"), k.cast("string")).alias("sub"), (F.lit(NOW) + (k % 40 - 15) * 43200 + k % 7).alias("exp")))
    coded = F.regexp_replace(F.translate(F.regexp_replace(F.base64(payload.cast("binary")), r"\s", ""), "+/", "-_"), "=+$", "")
    token = F.when(k % 9 == 0, F.concat(F.lit("no"), k.cast("string"))).otherwise(F.concat(F.lit("h."), coded, F.lit(".s")))
    t = read_table(spark, d, "customer").select(k.alias("id"), labels.token_expiry(token).alias("expires"))
    return t.select("id", "expires", labels.expiry_note(F.col("expires"), F.lit(NOW)).alias("note"))


@query("", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN NULL ELSE 'v ' || c_custkey::VARCHAR END AS value FROM customer")
def config_values(spark: SparkSession, d: str) -> DataFrame:
    """F32: settings without blanks around them and without quotes; blank ones are null."""
    k = F.col("c_custkey")
    own = F.concat(F.lit("v "), k.cast("string"))
    text = F.when(k % 4 == 0, F.when(k % 8 == 0, '  ""  ').otherwise(" ")).when(k % 4 == 1, F.concat(F.lit(' "'), own, F.lit('" '))).when(k % 4 == 2, F.concat(F.lit("'"), own, F.lit("'"))).otherwise(F.concat(own, F.lit("\t")))
    return read_table(spark, d, "customer").select(k.alias("id"), labels.config_value(text).alias("value"))


@query("pl", """SELECT CASE provider WHEN 'view' THEN 'Carbon Mapper' WHEN 'purchase' THEN 'IMEO' ELSE 'SRON' END AS provider, count(*) AS n, NULL::BOOLEAN AS failed FROM pl WHERE provider IN ('view', 'purchase', 'signup') AND lon BETWEEN 108 AND 160 AND lat BETWEEN -45 AND 1 GROUP BY 1
    UNION ALL SELECT 'EMIT', 0, TRUE""")  # fmt: skip
def isolated_providers(spark: SparkSession, d: str) -> DataFrame:
    """T-D: a provider whose feed isn't there is noted, and the others give what they have."""
    paths = _write_feeds(spark, d)
    rows, notes = readers.all_plumes(spark, paths | {"EMIT": paths["EMIT"] + "-gone"})
    noted = spark.createDataFrame([(name, 0, True) for name in notes], "provider string, n bigint, failed boolean")
    return rows.groupBy("provider").agg(F.count("*").alias("n")).withColumn("failed", F.lit(None).cast("boolean")).unionByName(noted)
