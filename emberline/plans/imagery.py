"""Registered queries on images: scene metadata, windows, overpasses with their gates, clusters, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import labels
from emberline.operators import greedy, grid, imagestack, layers, quantiles, render, spatial
from emberline.plans import views
from emberline.plans.feeds import CLEAN
from emberline.plans.queries import HOTSPOTS, KM, _anomalies, _hotspots, query, r
from emberline.plans.views import GRID_COLS, GRID_ROWS
from emberline.sources import readers, sinks
from emberline.sources.shared import materialise, read_table, shared_dir

CATALOGUE = "cat AS (SELECT o_orderkey AS id, 'S2A_MSIL2A_20240101_N0500_' || CASE WHEN o_custkey % 7 = 0 THEN 'TXX' ELSE 'T' || printf('%02d', o_custkey % 60) || 'ABC' END || '_x' AS name, CASE o_orderkey % 3 WHEN 0 THEN '/eodata/S2/' || o_orderkey WHEN 1 THEN 'eodata/S2/' || o_orderkey END AS path, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS start FROM orders)"


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with their attributes: some have two of cloud cover, some none."""
    k = F.col("o_orderkey")
    tile = F.when(F.col("o_custkey") % 7 == 0, "TXX").otherwise(F.format_string("T%02dABC", F.col("o_custkey") % 60))
    text = lambda n: F.concat(F.lit(""), n.cast("string"))
    attribute = lambda name, n: F.struct(F.lit(name).alias("Name"), text(n).alias("Value"))
    attributes = F.when(k % 5 == 0, F.array(attribute("orbit", k % 143))).otherwise(F.array(attribute("cloudCover", k % 50), attribute("orbit", k % 143), attribute("cloudCover", k % 97)))
    path = F.when(k % 3 == 0, F.concat(F.lit("/eodata/S2/"), text(k))).when(k % 3 == 1, F.concat(F.lit("eodata/S2/"), text(k)))
    return read_table(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("S2A_MSIL2A_20240101_N0500_"), tile, F.lit("_x")).alias("Name"), path.alias("S3Path"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z")).alias("Start"), attributes.alias("Attributes"),
    )


@query("", "WITH " + CATALOGUE + " SELECT name, CASE WHEN path IS NULL THEN '' ELSE 'S2/' || id::VARCHAR END AS key, left(start, 19) AS start, CASE WHEN id % 5 <> 0 THEN (id % 97)::DOUBLE END AS cloud, nullif(regexp_extract(name, '_(T[0-9]{2}...)_', 1), '') AS tile FROM cat")
def scene_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with cloud cover from their attributes, the last of which counts, and the tile from the name."""
    return imagestack.scene_metadata(_catalogue(spark, d))


@query("fac", """+ b AS (SELECT fac_id, 5 / 110.57 AS dlat, 5 / (111.32 * cos(radians(lat))) AS dlon, lon, lat FROM fac) SELECT fac_id, round_even(lon - dlon, 6) AS west, round_even(lat - dlat, 6) AS south, round_even(lon + dlon, 6) AS east, round_even(lat + dlat, 6) AS north,
    printf('POLYGON((%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f))', lon - dlon, lat - dlat, lon + dlon, lat - dlat, lon + dlon, lat + dlat, lon - dlon, lat + dlat, lon - dlon, lat - dlat) AS wkt FROM b""")  # fmt: skip
def site_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box of five kilometres around each site, and that box as text."""
    box = imagestack.site_box(F.col("lon"), F.col("lat"), F.lit(5.0))
    shown = F.struct(*[F.format_string("%.6f", box[c]).alias(c) for c in ("west", "south", "east", "north")])
    return views.facilities(spark, d).select("fac_id", *[F.bround(box[c], 6).alias(c) for c in ("west", "south", "east", "north")], imagestack.box_wkt(shown).alias("wkt"))


#: Sites in an image of 8 by 8 pixels a scene: three a scene, of which one lies outside.
SITES = "st AS (SELECT DISTINCT site AS label, scene, (scene * 3 + k * 2) % 8 AS row, CASE WHEN k = 2 AND scene % 4 = 0 THEN 9 ELSE (scene + k * 3) % 8 END AS col, k AS place FROM scn, (SELECT unnest(range(0, 3)) AS k))"


def _sites(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").select(F.col("label").alias("label"), F.col("vec_id").alias("scene"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("place"))
    col = F.when((F.col("place") == 2) & (F.col("scene") % 4 == 0), 9).otherwise((F.col("scene") + F.col("place") * 3) % 8)
    return e.select("label", "scene", "place", ((F.col("scene") * 3 + F.col("place") * 2) % 8).alias("row"), col.alias("col"), F.lit(8).alias("height"), F.lit(8).alias("width"))


@query("ratios", "+ " + SITES + ", w AS (SELECT scene, place, greatest(row - 3, 0) AS r0, greatest(col - 3, 0) AS c0, least(row + 3, 8) AS r1, least(col + 3, 8) AS c1 FROM st), "
       "ok AS (SELECT *, (r1 - r0) * (c1 - c0) / 36.0::DOUBLE AS coverage FROM w WHERE r1 - r0 >= 4 AND c1 - c0 >= 4 AND (r1 - r0) * (c1 - c0) / 36.0::DOUBLE >= 0.5) "
       "SELECT ok.scene, place, round_even(any_value(coverage), 4) AS coverage, count(*) AS n, count(ratio) AS usable FROM ok JOIN ratios p ON p.scene = ok.scene AND p.row >= r0 AND p.row < r1 AND p.col >= c0 AND p.col < c1 GROUP BY ALL")  # fmt: skip
def site_windows(spark: SparkSession, d: str) -> DataFrame:
    """sites' windows clipped to the image, if enough of them is inside, and their pixels."""
    s = _sites(spark, d)
    windows = s.select("scene", "place", (F.col("row") - 3).alias("row0"), (F.col("col") - 3).alias("col0"), (F.col("row") + 3).alias("row1"), (F.col("col") + 3).alias("col1"), "height", "width")
    held = imagestack.clipped_windows(windows, 4, 0.5)
    pixels = imagestack.masked_ratio(views.scenes(spark, d)).select("scene", "row", "col", "ratio")
    inside = pixels.join(held, "scene").where("row >= r0 AND row < r1 AND col >= c0 AND col < c1")
    return inside.groupBy("scene", "place").agg(F.bround(F.first("coverage"), 4).alias("coverage"), F.count("*").alias("n"), F.count("ratio").alias("usable"))


PASSES = """+ """ + SITES + """, w AS (SELECT scene, place, greatest(row - 3, 0) AS r0, greatest(col - 3, 0) AS c0, least(row + 3, 8) AS r1, least(col + 3, 8) AS c1 FROM st WHERE col < 8),
    own AS (SELECT w.scene, place, ratio AS enh FROM w JOIN ratios p ON p.scene = w.scene AND p.row >= r0 AND p.row < r1 AND p.col >= c0 AND p.col < c1 WHERE r1 - r0 >= 4 AND c1 - c0 >= 4),
    stt AS (SELECT scene, place, count(enh) / count(*) AS valid, quantile_cont(enh, 0.5) AS site_median, max(enh) AS site_max FROM own GROUP BY ALL),
    md AS (SELECT scene, count(ratio) AS n, quantile_cont(ratio, 0.5) AS median FROM ratios WHERE ratio IS NOT NULL GROUP BY scene HAVING count(ratio) >= 12),
    ns AS (SELECT scene, any_value(median) AS median, 1.4826 * quantile_cont(abs(ratio - median), 0.5) AS sigma FROM ratios JOIN md USING (scene) WHERE ratio IS NOT NULL GROUP BY scene HAVING 1.4826 * quantile_cont(abs(ratio - median), 0.5) > 0),
    hot AS (SELECT own.scene, place, count(*) AS hot FROM own JOIN ns USING (scene) WHERE enh > median + 3 * sigma GROUP BY ALL),
    ps AS (SELECT stt.scene, stt.place, valid, valid >= 0.25 AS observed, site_median, site_max, CASE WHEN valid >= 0.25 THEN (site_median - median) / sigma END AS excess, CASE WHEN valid >= 0.25 AND sigma IS NOT NULL THEN coalesce(hot, 0) END AS hot FROM stt LEFT JOIN ns USING (scene) LEFT JOIN hot ON hot.scene = stt.scene AND hot.place = stt.place)"""  # fmt: skip


def _passes(spark: SparkSession, d: str) -> DataFrame:
    pixels = imagestack.masked_ratio(views.scenes(spark, d)).select(F.col("scene").alias("granule"), "row", "col", F.col("ratio").alias("enh"))
    sites = _sites(spark, d).select(F.col("scene").alias("granule"), F.col("place").alias("site"), "row", "col", "height", "width")
    return imagestack.overpasses(pixels, sites, 3, 12)


@query("ratios", PASSES + " SELECT scene AS granule, place AS site, round_even(valid, 4) AS valid, observed, round_even(site_median, 6) AS site_median, round_even(site_max, 6) AS site_max, round_even(excess, 3) AS excess_sigma, hot AS pixels_above_3sigma FROM ps")
def overpass_samples(spark: SparkSession, d: str) -> DataFrame:
    """sites' windows in images that contain them, against the wide box around them, with all gates."""
    return _passes(spark, d).select("granule", "site", r("valid"), "observed", r("site_median", 6), r("site_max", 6), r("excess_sigma", 3), F.col("pixels_above_3sigma").cast("long").alias("pixels_above_3sigma"))


SUMMARY = PASSES + """, al AS (SELECT st.scene, st.place AS site, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (st.scene % 5000), '%Y-%m-%dT%H:%M:%S') AS tm, st.col < 8 AS inside, coalesce(observed, FALSE) AS observed, excess, site_max, site_median FROM st LEFT JOIN ps ON ps.scene = st.scene AND ps.place = st.place),
    sm AS (SELECT site, count(*) FILTER (inside) AS containing, count(*) FILTER (observed) AS usable, min(tm) FILTER (observed) AS first_usable, max(tm) FILTER (observed) AS last_usable, max(excess) FILTER (observed) AS strongest, max(site_max) FILTER (observed) AS site_max, quantile_cont(site_median, 0.5) FILTER (observed) AS median_sensitivity FROM al GROUP BY site)"""


def _summary(spark: SparkSession, d: str) -> DataFrame:
    key = [F.col("granule"), F.col("site")]
    sites = _sites(spark, d).select(F.col("scene").alias("granule"), F.col("place").alias("site"), (F.col("col") < 8).alias("contains_site"))
    at = F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(granule % 5000 AS int), 0, 0)"), "yyyy-MM-dd'T'HH:mm:ss")
    passes = sites.join(_passes(spark, d), ["granule", "site"], "left").withColumns({"datetime": at, "observed": F.coalesce("observed", F.lit(False)), "sensitivity": F.col("site_median")})
    return imagestack.site_summary(passes.select(*key, "datetime", "contains_site", "observed", "excess_sigma", "site_max", "sensitivity"))


@query("ratios", SUMMARY + " SELECT site, containing, usable, round_even(usable / containing, 4) AS observability, first_usable, last_usable, round_even(strongest, 3) AS strongest, round_even(site_max, 6) AS site_max, round_even(median_sensitivity, 6) AS median_sensitivity FROM sm")
def site_summaries(spark: SparkSession, d: str) -> DataFrame:
    """How often each site could be seen, when first and last, and its strongest pass."""
    return _summary(spark, d).select("site", "containing", "usable", r("observability"), "first_usable", "last_usable", r("strongest", 3), r("site_max", 6), r("median_sensitivity", 6))


@query("ratios", SUMMARY + " SELECT count(*) AS sites, sum(containing)::BIGINT AS containing, sum(usable)::BIGINT AS usable, round_even(sum(usable) / sum(containing), 4) AS observability FROM sm")
def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    """The totals of all sites."""
    return imagestack.grand_totals(_summary(spark, d)).select("sites", "containing", "usable", r("observability"))


@query("ratios", PASSES + " SELECT place AS site, count(*) AS passes, string_agg(scene::VARCHAR || ':' || observed::VARCHAR, ',' ORDER BY scene) AS listed FROM ps GROUP BY place")
def overpasses_by_site(spark: SparkSession, d: str) -> DataFrame:
    """The overpasses keyed by site, in order."""
    held = sinks.keyed_by(_passes(spark, d).select("site", "granule", "observed"), "site", "granule")
    text = F.transform("items", lambda x: F.concat(x["granule"].cast("string"), F.lit(":"), x["observed"].cast("string")))
    return held.select("site", F.size("items").cast("long").alias("passes"), F.array_join(text, ",").alias("listed"))


@query("ratios", CLEAN + """, loo AS (SELECT a.site, a.scene, a.row, a.col, count(b.ratio) AS n_ref, CASE WHEN count(b.ratio) >= 3 THEN (any_value(a.ratio) - quantile_cont(b.ratio, 0.5)) / quantile_cont(b.ratio, 0.5) END AS change
      FROM ratios a LEFT JOIN ratios b ON a.site = b.site AND a.row = b.row AND a.col = b.col AND a.scene <> b.scene GROUP BY ALL),
    md AS (SELECT site, scene, quantile_cont(change, 0.5) AS median FROM loo WHERE change IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    ns AS (SELECT site, scene, any_value(median) AS median, 1.4826 * quantile_cont(abs(change - median), 0.5) AS sigma FROM loo JOIN md USING (site, scene) WHERE change IS NOT NULL GROUP BY ALL HAVING 1.4826 * quantile_cont(abs(change - median), 0.5) > 0),
    s AS (SELECT site, scene, cluster, count(*) AS pixels, avg(row) + 0.5 AS row, avg(col) + 0.5 AS col, avg(change) AS mean_change, min(change) AS min_change, trunc(quantile_cont(n_ref, 0.5))::INT AS reference_scenes FROM cs JOIN loo USING (site, scene, row, col) GROUP BY ALL)
    SELECT site, scene, cluster, pixels, round_even(row, 4) AS row, round_even(col, 4) AS col, round_even(pixels * 0.04::DOUBLE, 2) AS area_ha, round_even(mean_change, 5) AS mean_change, round_even(min_change, 5) AS min_change, reference_scenes, round_even(abs(mean_change - median) / sigma, 1) AS strength,
    round_even(110 + (col * 2e-4), 5) AS lon, round_even(-20 - (row * 2e-4), 5) AS lat FROM s JOIN ns USING (site, scene)""")  # fmt: skip
def detections_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of clean scenes with their figures and place, strongest first."""
    ratio = imagestack.masked_ratio(views.scenes(spark, d))
    changes = materialise(imagestack.leave_one_out(ratio), "changes")
    clean = imagestack.clean_scenes(greedy.label_clusters(ratio.where("ratio > 1"), 2), 4)
    own = clean.join(changes.select("site", "scene", "row", "col", "change", "n_ref"), ["site", "scene", "row", "col"])
    out = imagestack.cluster_stats(own, imagestack.robust_noise(changes, ["site", "scene"], "change", 10))
    place = imagestack.pixel_place(F.col("row"), F.col("col"), F.lit(110.0), F.lit(-20.0), F.lit(2e-4), F.lit(2e-4))
    out = out.select("site", "scene", "cluster", "pixels", r("row"), r("col"), "area_ha", r("mean_change", 5), r("min_change", 5), "reference_scenes", "strength", place["lon"].alias("lon"), place["lat"].alias("lat"))
    return out.orderBy(F.desc("strength"), "site", "scene", "cluster")


@query("", """SELECT l_orderkey AS granule, min('https://h/A_CH4ENH_.002/' || l_partkey::VARCHAR || '_CH4ENH_' || l_linenumber::VARCHAR || '.tif') FILTER (l_linenumber = 1) AS enh,
    min('https://h/A_CH4ENH_.002/' || l_partkey::VARCHAR || '_CH4SENS_' || l_linenumber::VARCHAR || '.tif') FILTER (l_linenumber = 2) AS sens, min('https://h/A_CH4ENH_.002/' || l_partkey::VARCHAR || '_CH4UNCERT_' || l_linenumber::VARCHAR || '.tif') FILTER (l_linenumber = 3) AS uncert
    FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber = 1) > 0""")  # fmt: skip
def enhancement_files(spark: SparkSession, d: str) -> DataFrame:
    """granules' files by the marks in their names, not in their folders' names."""
    mark = F.element_at(F.array(*[F.lit(x) for x in ("CH4ENH", "CH4SENS", "CH4UNCERT", "RGB")]), F.least("l_linenumber", F.lit(4)).cast("int"))
    url = F.concat(F.lit("https://h/A_CH4ENH_.002/"), F.col("l_partkey").cast("string"), F.lit("_"), mark, F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".tif"))
    g = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("granule")).agg(F.array_sort(F.collect_list(url)).alias("urls"))
    return imagestack.enhancement_files(g)


@query("anom", "SELECT period, count(*) AS n, count(anomaly) AS graded, round_even(max(anomaly), 4) AS top FROM anom GROUP BY period")
def composite_stack(spark: SparkSession, d: str) -> DataFrame:
    """Composites written by kind and period, and the stack of a kind read again."""
    path = f"{shared_dir(spark)}/emberline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}/composites"
    cells = _anomalies(spark, d).select("row", "col", "mean", "anomaly", "n_obs", F.lit("half").alias("kind"), "period")
    sinks.write_composites(cells, path)
    return sinks.load_stack(spark, path, "half").groupBy("period").agg(F.count("*").alias("n"), F.count("anomaly").alias("graded"), F.max("anomaly").alias("top")).select("period", "n", "graded", r("top"))


@query("anom", """+ t AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY row, col) AS k FROM anom WHERE anomaly IS NOT NULL) SELECT 'anomaly/' || period || '.png' AS url, period, 108.0::DOUBLE AS west, -45.0::DOUBLE AS south, 160.0::DOUBLE AS east, 1.0::DOUBLE AS north,
    (SELECT round_even(quantile_cont(abs(anomaly), 0.98), 1) FROM t WHERE (k - 1) % 37 = 0) AS top, round_even(100 * count(*) / 600.0::DOUBLE, 4) AS coverage_pct, round_even(max(anomaly), 4) AS max_anomaly FROM anom GROUP BY period ORDER BY period""")  # fmt: skip
def render_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the images of all periods show, by period."""
    cells = materialise(_anomalies(spark, d), "anomalies")
    limit = quantiles.quantiles(grid.every_nth(cells.where("anomaly IS NOT NULL")).withColumn("size", F.abs("anomaly")), "size", [0.98])[0]
    return render.manifest(cells, limit, GRID_ROWS * GRID_COLS).select("url", "period", "west", "south", "east", "north", "top", r("coverage_pct"), r("max_anomaly")).orderBy("period")


@query("stack vtx", HOTSPOTS + f""", f AS (SELECT hot.row, hot.col, v.name, v.layer, v.layer_ord, v.feature_ord, min({KM.format(a="hot", b="v")}) AS km FROM hot, vtx v GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY km, layer_ord, feature_ord) AS rank FROM f QUALIFY rank <= 3)
    SELECT hot.row, hot.col, hot.observed, hot.elevated, round_even(any_value(max_anomaly), 4) AS peak, string_agg(n.layer || '/' || n.name || '/' || round_even(km, 0)::BIGINT::VARCHAR, ',' ORDER BY rank) AS nearest FROM hot JOIN n USING (row, col) GROUP BY hot.row, hot.col, hot.observed, hot.elevated""")  # fmt: skip
def hotspot_records(spark: SparkSession, d: str) -> DataFrame:
    """Hotspots with their figures and the three nearest features as a nested array."""
    spots = materialise(_hotspots(spark, d).withColumn("point_id", F.struct("row", "col")), "hotspots")
    near = spatial.nearest_features(spots.select("point_id", "lon", "lat"), views.vertices(spark, d))
    nested = near.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("rank", "layer", "name", "km"))).alias("nearest_infrastructure"))
    text = F.transform("nearest_infrastructure", lambda x: F.concat_ws("/", x["layer"], x["name"], F.bround(x["km"], 0).cast("long").cast("string")))
    return spots.join(nested, "point_id").select("row", "col", "observed", "elevated", F.bround("max_anomaly", 4).alias("peak"), F.array_join(text, ",").alias("nearest"))


@query("", """SELECT id, round_even(value, 3) AS west, round_even(value + 3, 3) AS north FROM (SELECT event_id AS id, value FROM events WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (ORDER BY ts DESC, event_id) <= 200) WHERE id % 7 <> 0""")
def asset_queue(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 items with whole bounds, without those fetched before, and their images' upper left corners."""
    v, k = F.col("value"), F.col("event_id")
    bounds = F.when(k % 3 != 0, F.array(v, v + 1, v + 2, v + 3)).otherwise(F.array(v, v + 1))
    e = read_table(spark, d, "events").select(k.alias("key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("datetime_utc"), bounds.alias("bounds"))
    queue = readers.asset_queue(e, e.where("key % 7 = 0"))
    corner = F.element_at(labels.image_corners(F.col("bounds")), 1)
    return queue.select(F.col("key").alias("id"), F.bround(corner[0], 3).alias("west"), F.bround(corner[1], 3).alias("north"))


@query("fac", "SELECT layer, count(*) AS n, min(round_even(lon, 5)) AS west, max(round_even(lat, 5)) AS north FROM fac WHERE layer IN ('coal_mines', 'gas_plants') GROUP BY layer")
def point_facilities(spark: SparkSession, d: str) -> DataFrame:
    """The point features of mines and plants, to five decimals."""
    f = views.facilities(spark, d).withColumns({"coords": F.array(F.struct("lon", "lat")), "geom_type": F.when(F.col("layer_ord") < 2, "Point").otherwise("LineString")})
    held = layers.point_facilities(f.drop("lon", "lat"))
    return held.groupBy("layer").agg(F.count("*").alias("n"), F.min("lon").alias("west"), F.max("lat").alias("north"))


@query("vtx", "SELECT layer, feature_ord, vertex_ord, round_even(lon, 4) AS lon, round_even(lat, 4) AS lat FROM vtx")
def infrastructure_vertices(spark: SparkSession, d: str) -> DataFrame:
    """The ordered vertices of all layers' features."""
    return views.vertices(spark, d).select("layer", "feature_ord", F.col("vertex_ord").cast("long").alias("vertex_ord"), F.bround("r_lon", 4).alias("lon"), F.bround("r_lat", 4).alias("lat"))


@query("vtx", "SELECT feature_ord AS id, layer, count(*) AS n FROM vtx GROUP BY ALL HAVING bool_or(lon BETWEEN 108 AND 160 AND lat BETWEEN -45 AND 1) AND bool_or(lat > -10 AND lon > 140.8)")
def northern_routes(spark: SparkSession, d: str) -> DataFrame:
    """Features with a vertex in the region and one north and east of the split."""
    v = views.vertices(spark, d).groupBy(F.col("feature_ord").alias("id"), "layer").agg(F.collect_list(F.struct(F.col("r_lon").alias("lon"), F.col("r_lat").alias("lat"))).alias("coords"))
    return v.where(layers.northern(F.col("coords"))).select("id", "layer", F.size("coords").cast("long").alias("n"))


@query("scn", "SELECT label AS site, count(*) AS scenes, min(vec_id) AS first FROM (SELECT * FROM embeddings WHERE label < 5 UNION ALL SELECT * FROM embeddings WHERE label >= 5) WHERE label IN (1, 3, 7) GROUP BY label")
def selected_sites(spark: SparkSession, d: str) -> DataFrame:
    """Groups of sites put together, of which some are selected."""
    e = read_table(spark, d, "embeddings").select(F.col("label").alias("site"), "vec_id")
    both = e.where("site < 5").unionByName(e.where("site >= 5"))
    return both.where(F.col("site").isin(1, 3, 7)).groupBy("site").agg(F.count("*").alias("scenes"), F.min("vec_id").alias("first"))
