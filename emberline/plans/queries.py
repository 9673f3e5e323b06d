"""The registered queries of the core library, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import geo, labels
from emberline.operators import facilities as fac_ops
from emberline.operators import greedy, grid, imagestack, matching, quantiles, render, spatial
from emberline.plans import views
from emberline.plans.views import GRID_COLS, GRID_ROWS, VERDICTS, binned, spread, with_views
from emberline.sources import commits
from emberline.sources.shared import materialise, read_table, shared_dir
from emberline.streaming.weekly import run_weekly

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(names: str = "", sql: str | None = None):
    """Registers a query under its function's name, with the SQL and the views it needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(names, sql)
        return f

    return add


def r(column: str, digits: int = 4):
    return F.bround(column, digits).alias(column)


KM = "sqrt(pow(({a}.lon - {b}.lon) * 111.32 * cos(radians(({a}.lat + {b}.lat) / 2)), 2) + pow(({a}.lat - {b}.lat) * 110.57, 2))"


@query("pl", "SELECT plume_id FROM pl WHERE lon BETWEEN 108 AND 160 AND lat BETWEEN -45 AND 1")
def roi_filter(spark: SparkSession, d: str) -> DataFrame:
    """Detections in the closed region."""
    return views.plumes(spark, d).where(geo.in_region(F.col("lon"), F.col("lat"))).select("plume_id")


@query("usable", "SELECT period, count(*) AS n, round_even(sum(value), 2) AS total FROM usable GROUP BY period")
def land_qa_filter(spark: SparkSession, d: str) -> DataFrame:
    """Usable soundings by period."""
    return grid.usable(views.soundings(spark, d)).groupBy("period").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("period", "n", r("total", 2))


@query("", """SELECT l_orderkey AS route, count(*) AS n_vertices FROM lineitem GROUP BY l_orderkey
    HAVING bool_or(l_partkey % 90 BETWEEN 10 AND 12 AND l_suppkey % 50 BETWEEN 5 AND 9)""")  # fmt: skip
def any_vertex_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Routes with a vertex in a box; an order's lines are a route's vertices."""
    t = read_table(spark, d, "lineitem")
    routes = t.groupBy(F.col("l_orderkey").alias("route")).agg(F.collect_list(F.struct((F.col("l_partkey") % 90).alias("lon"), (F.col("l_suppkey") % 50).alias("lat"))).alias("coords"))
    return routes.where(geo.any_vertex_in(F.col("coords"), 10, 5, 12, 9)).select("route", F.size("coords").cast("long").alias("n_vertices"))


@query("", """SELECT l_orderkey AS plant, count(*) AS n_gas, sum(l_quantity) AS capacity_mw, string_agg(DISTINCT fuel, ',' ORDER BY fuel) AS fuels,
    CASE WHEN bool_or(l_linestatus = 'O') THEN 'operating' ELSE 'f' END AS status, CASE WHEN min(fuel) = 'gas_wcmg' THEN 'waste coal mine gas' ELSE 'gas power station' END AS subtype
    FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'gas_ocgt' WHEN l_linenumber % 3 = 1 THEN 'coal_black' ELSE 'gas_wcmg' END AS fuel FROM lineitem) WHERE fuel LIKE 'gas%' GROUP BY l_orderkey""")  # fmt: skip
def plant_units(spark: SparkSession, d: str) -> DataFrame:
    """Plants by their gas units; an order's lines are a plant's units."""
    k = F.col("l_linenumber") % 3
    fuel = F.when(k == 0, "gas_ocgt").when(k == 1, "coal_black").otherwise("gas_wcmg")
    status = F.when(F.col("l_linestatus") == "O", "operating").otherwise("f")
    plants = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plant")).agg(F.collect_list(F.struct(fuel.alias("fuel"), F.col("l_quantity").alias("capacity"), status.alias("status"))).alias("units"))
    out = fac_ops.plant_units(plants)
    own = F.filter("units", lambda u: u["fuel"].startswith("gas"))
    return out.select("plant", F.size(own).cast("long").alias("n_gas"), "capacity_mw", F.array_join("fuels", ",").alias("fuels"), "status", "subtype")


@query("cells", "SELECT period, row, col, n_obs, round_even(mean, 4) AS mean FROM cells")
def grid_bin_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean and count of each period's cells."""
    return _cells(spark, d).select("period", "row", "col", "n_obs", r("mean"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.means(grid.bin_soundings(grid.usable(views.soundings(spark, d))))


@query("cells", "SELECT period, row, col, n_obs, round_even(total, 2) AS total FROM cells")
def partial_merge(spark: SparkSession, d: str) -> DataFrame:
    """Grids of batches merged into the period's."""
    s = grid.usable(views.soundings(spark, d))
    parts = [grid.bin_soundings(s.where(F.col("surface") % 8 == k)) for k in range(0, 8, 2)]
    return grid.merge_bins(*parts).select("period", "row", "col", "n_obs", r("total", 2))


@query("bg", "SELECT period, row, round_even(background, 4) AS background FROM bg")
def latitude_background(spark: SparkSession, d: str) -> DataFrame:
    """The sliding median of each period's rows."""
    return grid.latitude_background(_cells(spark, d), GRID_ROWS).select("period", F.col("row").cast("long").alias("row"), r("background"))


def _anomalies(spark: SparkSession, d: str) -> DataFrame:
    cells = materialise(_cells(spark, d), "cells")
    return grid.with_anomaly(cells, grid.latitude_background(cells, GRID_ROWS))


@query("anom", "SELECT period, row, col, round_even(anomaly, 4) AS anomaly FROM anom")
def gated_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """The anomaly of cells with three observations or more."""
    return _anomalies(spark, d).select("period", "row", "col", r("anomaly"))


@query("anom", """+ s AS (SELECT period, 100 * count(*) / 600.0::DOUBLE AS coverage_pct, 100 * count(anomaly) / 600.0::DOUBLE AS anomaly_coverage_pct, avg(mean) AS mean_value, max(mean) AS max_value,
    max(anomaly) AS max_anomaly, quantile_cont(n_obs, 0.5)::DOUBLE AS median_obs, sum(n_obs)::BIGINT AS obs_total FROM anom GROUP BY period)
    SELECT s.period, round_even(coverage_pct, 4) AS coverage_pct, round_even(anomaly_coverage_pct, 4) AS anomaly_coverage_pct, round_even(mean_value, 4) AS mean_value, round_even(max_value, 4) AS max_value,
    round_even(max_anomaly, 4) AS max_anomaly, median_obs, obs_total, round_even(b.background, 4) AS background
    FROM s JOIN (SELECT period, quantile_cont(background, 0.5) AS background FROM bg GROUP BY period) b USING (period)""")  # fmt: skip
def period_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each period."""
    cells = materialise(_cells(spark, d), "cells")
    background = grid.latitude_background(cells, GRID_ROWS)
    out = grid.period_stats(grid.with_anomaly(cells, background), background, GRID_ROWS * GRID_COLS)
    return out.select("period", r("coverage_pct"), r("anomaly_coverage_pct"), r("mean_value"), r("max_value"), r("max_anomaly"), "median_obs", "obs_total", r("background"))


@query("stack", """SELECT row, col, observed, elevated, round_even(mean_anomaly, 4) AS mean_anomaly, round_even(max_anomaly, 4) AS max_anomaly, round_even(mean_obs, 4) AS mean_obs,
    round_even(CASE WHEN observed >= 8 THEN elevated / greatest(observed, 1) ELSE 0 END, 4) AS persistence FROM stack""")  # fmt: skip
def stack_persistence(spark: SparkSession, d: str) -> DataFrame:
    """How often each cell was elevated."""
    out = grid.stack(_anomalies(spark, d))
    return out.select("row", "col", "observed", "elevated", r("mean_anomaly"), r("max_anomaly"), r("mean_obs"), r("persistence"))


#: Cells farther than some cells from any that was never observed, as all() of the stack.
INSIDE = "grid AS (SELECT * FROM (SELECT unnest(range(0, 20)) AS row), (SELECT unnest(range(0, 30)) AS col)), gone AS (SELECT grid.* FROM grid ANTI JOIN (SELECT * FROM stack WHERE observed > 0) s ON s.row = grid.row AND s.col = grid.col)"


def _inside(cells: str, squared: int) -> str:
    return f"SELECT * FROM {cells} h WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE (g.row - h.row) * (g.row - h.row) + (g.col - h.col) * (g.col - h.col) <= {squared})"


CLIMATE = "+ " + INSIDE + ", clim AS (SELECT *, sd / sqrt(greatest(observed, 1)) AS stderr FROM (" + _inside("stack", 16) + ") WHERE observed >= 12)\n"


@query("stack", CLIMATE + "SELECT row, col, observed, round_even(mean_anomaly, 4) AS mean_anomaly, round_even(sd, 4) AS sd, round_even(stderr, 4) AS stderr FROM clim")
def climatology(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviation and standard error of inner cells with twelve periods."""
    return _climatology(spark, d).select("row", "col", "observed", r("mean_anomaly"), r("sd"), r("stderr"))


def _climatology(spark: SparkSession, d: str) -> DataFrame:
    return grid.climatology(grid.stack(_anomalies(spark, d)), GRID_ROWS, GRID_COLS)


def _one_row(spark: SparkSession, values: dict) -> DataFrame:
    return spark.range(1).select(*[F.bround(F.lit(v).cast("double"), 4).alias(k) for k, v in values.items()])


@query("stack", CLIMATE + """SELECT round_even(avg(mean_anomaly), 4) AS mean, round_even(stddev_pop(mean_anomaly), 4) AS sd, round_even(quantile_cont(mean_anomaly, 0.99), 4) AS p99,
    round_even(quantile_cont(stderr, 0.5), 4) AS median_stderr, round_even(quantile_cont(abs(mean_anomaly), 0.99), 4) AS limit_99 FROM clim""")  # fmt: skip
def climatology_pool(spark: SparkSession, d: str) -> DataFrame:
    """The average over all its cells, the typical error, and the limit of its colours."""
    c = materialise(_climatology(spark, d), "climatology")
    row = c.agg(F.avg("mean_anomaly").alias("mean"), F.stddev_pop("mean_anomaly").alias("sd")).first()
    limit = quantiles.quantiles(c.withColumn("size", F.abs("mean_anomaly")), "size", [0.99])[0]
    return _one_row(spark, {"mean": row["mean"], "sd": row["sd"], "p99": quantiles.quantiles(c, "mean_anomaly", [0.99])[0], "median_stderr": quantiles.quantiles(c, "stderr", [0.5])[0], "limit_99": limit})


@query("anom", "SELECT count(anomaly)::DOUBLE AS n, round_even(stddev_pop(anomaly), 4) AS sd, round_even(quantile_cont(anomaly, 0.95), 4) AS p95, round_even(quantile_cont(anomaly, 0.99), 4) AS p99 FROM anom")
def pooled_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Number, deviation and percentiles of the anomalies of all periods."""
    a = materialise(_anomalies(spark, d).select("anomaly"), "anomalies")
    row = a.agg(F.count("anomaly").alias("n"), F.stddev_pop("anomaly").alias("sd")).first()
    return _one_row(spark, {"n": row["n"], "sd": row["sd"]} | dict(zip(("p95", "p99"), quantiles.quantiles(a, "anomaly", [0.95, 0.99]), strict=True)))


@query("stack", "+ " + INSIDE + " SELECT row, col FROM (" + _inside("stack", 9) + ") WHERE observed > 0")
def interior_mask(spark: SparkSession, d: str) -> DataFrame:
    """Observed cells farther than three from any that never was."""
    return grid.interior(_observed(spark, d), GRID_ROWS, GRID_COLS)


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Cells with an anomaly in some period; others have too few observations, or a lake."""
    return materialise(_anomalies(spark, d).where("anomaly IS NOT NULL").select("row", "col").distinct(), "observed")


@query("stack", "+ " + INSIDE + """, held AS (SELECT row, col FROM stack WHERE observed > 0) SELECT h.row, h.col, round_even(1 - avg(CASE WHEN o.row IS NULL THEN 0 ELSE 1 END), 4) AS coastal FROM held h
    JOIN grid g ON g.row BETWEEN h.row - 4 AND h.row + 4 AND g.col BETWEEN h.col - 4 AND h.col + 4 LEFT JOIN held o ON o.row = g.row AND o.col = g.col GROUP BY h.row, h.col""")  # fmt: skip
def coastal_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Share of never-observed cells around each observed one."""
    held = _observed(spark, d)
    return grid.coastal_fraction(held, held, GRID_ROWS, GRID_COLS).select("row", "col", r("coastal"))


def _associated_sql(rows: str) -> str:
    """pairs of rows with vertices within 10 km, and their nearest ones: a of any layer, p of point layers."""
    return f"""pairs AS (SELECT q.plume_id, v.name, v.layer, v.layer_ord, v.feature_ord, v.vertex_ord, {KM.format(a="q", b="v")} AS km FROM {binned(rows, 0.2)} q JOIN {spread("vtx", 0.2)} v ON q.bx = v.bx AND q.by = v.by AND {KM.format(a="q", b="v")} <= 10),
    a AS (SELECT *, row_number() OVER (PARTITION BY plume_id ORDER BY km, layer_ord, feature_ord, vertex_ord) AS k FROM pairs),
    p AS (SELECT *, row_number() OVER (PARTITION BY plume_id ORDER BY km, layer_ord, feature_ord, vertex_ord) AS k FROM pairs WHERE layer IN ('coal_mines', 'gas_plants'))"""


BAND = "CASE WHEN a.km IS NULL THEN 'none within 10 km' WHEN p.km IS NULL THEN 'linear-only' WHEN p.km <= 1 THEN 'high' WHEN p.km <= 3 THEN 'medium' ELSE 'low' END"


@query("pl vtx", "+ " + _associated_sql("pl") + f"""
    SELECT pl.plume_id, coalesce(p.name, a.name) AS nearest_name, coalesce(p.layer, a.layer) AS nearest_layer, round_even(coalesce(p.km, a.km), 2) AS nearest_km, p.name AS facility_name, round_even(p.km, 2) AS facility_km,
    {BAND} AS association FROM pl LEFT JOIN a ON a.plume_id = pl.plume_id AND a.k = 1 LEFT JOIN p ON p.plume_id = pl.plume_id AND p.k = 1""")  # fmt: skip
def nearest_point_and_any(spark: SparkSession, d: str) -> DataFrame:
    """The nearest infrastructure of each detection, a point before a line, and its band."""
    return _associated(views.plumes(spark, d).select("plume_id", "lon", "lat"), views.vertices(spark, d)).select("plume_id", "nearest_name", "nearest_layer", r("nearest_km", 2), "facility_name", r("facility_km", 2), "association")


def _associated(plumes: DataFrame, vertices: DataFrame) -> DataFrame:
    out = spatial.nearest_two(plumes, vertices)
    band = labels.association(F.col("facility_km"), F.col("nearest_km"), F.col("nearest_layer"))
    first = lambda a, b: F.coalesce(a, b)
    return out.withColumn("association", band).withColumns({f"nearest_{k}": first(f"facility_{k}", f"nearest_{k}") for k in ("name", "layer", "km")})


@query("pl vtx", f"""+ q AS (SELECT plume_id, lon, lat FROM pl WHERE plume_id % 20 = 0), f AS (SELECT q.plume_id AS point_id, v.name, v.layer, v.layer_ord, v.feature_ord, min({KM.format(a="q", b="v")}) AS km FROM q, vtx v GROUP BY ALL)
    SELECT point_id, name, layer, rank, round_even(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, layer_ord, feature_ord) AS rank FROM f) WHERE rank <= 3""")  # fmt: skip
def knn3(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest features of points, at any distance; the queries are the detections whose id 20 divides."""
    points = views.plumes(spark, d).where("plume_id % 20 = 0").select(F.col("plume_id").alias("point_id"), "lon", "lat")
    return spatial.nearest_features(points, views.vertices(spark, d)).select("point_id", "name", "layer", F.col("rank").cast("long").alias("rank"), r("km", 3))


@query("pl", f"""+ n AS (SELECT f.fac_id, count(*) AS c FROM {binned("fac", 0.2)} f JOIN {spread("pl", 0.2)} p ON f.bx = p.bx AND f.by = p.by AND {KM.format(a="f", b="p")} <= 10
    AND NOT (p.facility_name IS NOT DISTINCT FROM f.name AND p.facility_layer IS NOT DISTINCT FROM f.layer) GROUP BY f.fac_id) SELECT fac.fac_id, coalesce(c, 0) AS nearby_other_facility FROM fac LEFT JOIN n USING (fac_id)""")  # fmt: skip
def nearby_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """Detections near each facility that are attributed elsewhere or to nothing."""
    p = views.plumes(spark, d).select(F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), "facility_name", "facility_layer")
    return spatial.nearby_elsewhere(views.facilities(spark, d), p).select("fac_id", "nearby_other_facility")


HISTORY = """+ h AS (SELECT facility_name AS name, facility_layer AS layer, count(*) AS detections, min(datetime_utc) AS first_detection, max(datetime_utc) AS last_detection,
    string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, max(nullif(rate, 0)) AS max_rate, list(rate ORDER BY rate) FILTER (rate <> 0) AS rates, min(coalesce(facility_km, 0)) AS closest_km
    FROM pl WHERE facility_name IS NOT NULL GROUP BY ALL),
    rec AS (SELECT fac.*, coalesce(detections, 0) AS detections, first_detection, last_detection, providers, max_rate, rates[len(rates) // 2 + 1] AS median_rate, closest_km,
    CASE WHEN fac_id % 7 <> 0 THEN fac_id % 13 END AS emit_overpasses FROM fac LEFT JOIN h USING (name, layer)),
    st AS (SELECT *, CASE WHEN detections > 0 AND fac_id % 5 <> 0 THEN 'emitting' WHEN emit_overpasses IS NULL THEN 'unknown' WHEN emit_overpasses = 0 THEN 'blind spot' WHEN emit_overpasses >= 10 THEN 'watched, no plume' ELSE 'under-observed' END AS watch_status FROM rec)
    """


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Facilities with their history, overpasses and status; a fifth are judged as without detections."""
    out = fac_ops.history(views.facilities(spark, d), views.plumes(spark, d))
    out = out.withColumn("emit_overpasses", F.when(F.col("fac_id") % 7 != 0, F.col("fac_id") % 13))
    return out.withColumn("watch_status", labels.watch_status(F.when(F.col("fac_id") % 5 != 0, F.col("detections")).otherwise(0), F.col("emit_overpasses")))


@query("pl", HISTORY + "SELECT fac_id, detections, first_detection, last_detection, providers, max_rate, median_rate, closest_km FROM rec")
def facility_history(spark: SparkSession, d: str) -> DataFrame:
    """History of each facility."""
    return _records(spark, d).select("fac_id", "detections", "first_detection", "last_detection", F.array_join("providers", ",").alias("providers"), "max_rate", "median_rate", "closest_km")


@query("pl", HISTORY + "SELECT fac_id, emit_overpasses, watch_status FROM st")
def watch_status(spark: SparkSession, d: str) -> DataFrame:
    """F16: status of each facility."""
    return _records(spark, d).select("fac_id", "emit_overpasses", "watch_status")


@query("pl", HISTORY + "SELECT watch_status, count(*) AS n FROM st GROUP BY 1")
def status_tally(spark: SparkSession, d: str) -> DataFrame:
    """Facilities by status."""
    return _records(spark, d).groupBy("watch_status").agg(F.count("*").alias("n"))


@query("pl", HISTORY + "SELECT fac_id, detections, emit_overpasses, row_number() OVER (ORDER BY detections DESC, coalesce(emit_overpasses, 0) DESC, fac_id) AS k FROM st QUALIFY k <= 15")
def top_facilities(spark: SparkSession, d: str) -> DataFrame:
    """A report of the fifteen facilities with most detections, then overpasses."""
    top = _records(spark, d).orderBy(F.desc("detections"), F.desc(F.coalesce("emit_overpasses", F.lit(0))), "fac_id").limit(15)
    k = F.row_number().over(Window.orderBy(F.desc("detections"), F.desc(F.coalesce("emit_overpasses", F.lit(0))), "fac_id"))
    return top.select("fac_id", "detections", "emit_overpasses", k.cast("long").alias("k"))


@query("pl", "SELECT provider, count(*) AS n, count(*) FILTER (facility_km <= 1) AS near, count(rate) AS rated FROM pl GROUP BY provider")
def provider_counts(spark: SparkSession, d: str) -> DataFrame:
    """Detections of each provider."""
    return views.plumes(spark, d).groupBy("provider").agg(F.count("*").alias("n"), F.count_if(F.col("facility_km") <= 1).alias("near"), F.count("rate").alias("rated"))


@query("pl", "SELECT plume_id FROM pl WHERE day >= '2024-01-25'")
def new_ids(spark: SparkSession, d: str) -> DataFrame:
    """J11, T-B: ids that the run before, up to a day, hadn't seen."""
    p = views.plumes(spark, d)
    return fac_ops.new_ids(p.select("plume_id"), p.where("day < '2024-01-25'").select("plume_id"))


@query("pl", "SELECT provider, count(*) AS n FROM pl WHERE provider IN ('view', 'click') GROUP BY provider")
def provider_regression(spark: SparkSession, d: str) -> DataFrame:
    """Providers that fell silent."""
    p = views.plumes(spark, d)
    count = lambda x: x.groupBy("provider").agg(F.count("*").alias("n"))
    return fac_ops.regressions(count(p), count(p.where(~F.col("provider").isin("view", "click"))))


@query("pl", "SELECT plume_id, rate FROM pl WHERE day >= '2024-01-25' ORDER BY coalesce(rate, 0) DESC, plume_id LIMIT 100")
def alert_feed(spark: SparkSession, d: str) -> DataFrame:
    """The hundred strongest new detections."""
    return views.plumes(spark, d).where("day >= '2024-01-25'").orderBy(F.desc(F.coalesce("rate", F.lit(0.0))), "plume_id").limit(100).select("plume_id", "rate")


@query("", "SELECT strftime(l_shipdate, '%Y-%m') AS label, count(*) AS n, min(date_trunc('month', l_shipdate))::DATE AS first_day FROM lineitem GROUP BY 1")
def period_labels_month(spark: SparkSession, d: str) -> DataFrame:
    """months."""
    t = read_table(spark, d, "lineitem")
    return t.groupBy(labels.month_label(F.col("l_shipdate")).alias("label")).agg(F.count("*").alias("n"), F.min(F.trunc("l_shipdate", "month")).alias("first_day"))


@query("", "SELECT printf('%04d-W%02d', isoyear(l_shipdate), week(l_shipdate)) AS label, count(*) AS n, min(date_trunc('week', l_shipdate))::DATE AS monday FROM lineitem GROUP BY 1")
def period_labels_isoweek(spark: SparkSession, d: str) -> DataFrame:
    """F13, T11, T-G: ISO weeks, which begin on Monday."""
    t = read_table(spark, d, "lineitem")
    return t.groupBy(labels.iso_week_label(F.col("l_shipdate")).alias("label")).agg(F.count("*").alias("n"), F.min(F.trunc("l_shipdate", "week")).alias("monday"))


@query("", "SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n, round_even(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2")
def weekly_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """T-G: tumbling weeks by event time."""
    e = read_table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("at", "7 days", "7 days", "4 days").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("w.start").cast("date").alias("week"), "event_type", "n", r("mean_value"))


def sql_tokens(name: str) -> str:
    noise = ", ".join(f"'{x}'" for x in matching.NOISE)
    clean = f"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim({name}), '^[A-Z]{{2,4}}\\d{{2,3}}\\b[\\s-]*', ''), '\\([^)]*\\)', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"
    return f"list_distinct(list_filter(string_split_regex({clean}, ' +'), lambda t: length(t) > 2 AND t NOT IN ({noise})))"


@query("", f"SELECT p_partkey AS id, array_to_string(list_sort({sql_tokens('label')}), ' ') AS words FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'APN01 ' || p_name || ' (no 3) Coal Mine' ELSE p_brand || ' ' || p_type || ' Pty Ltd' END AS label FROM part)")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    """words of facilities' names."""
    coded = F.concat(F.lit("APN01 "), "p_name", F.lit(" (no 3) Coal Mine"))
    name = F.when(F.col("p_partkey") % 4 == 0, coded).otherwise(F.concat("p_brand", F.lit(" "), "p_type", F.lit(" Pty Ltd")))
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(matching.tokens(name)), " ").alias("words"))


CER = f"""+ ft AS (SELECT DISTINCT layer || '::' || name AS a, layer, a_state, {sql_tokens("name")} AS ftok FROM (SELECT layer, state AS a_state, name || ' ' || (fac_id % 30)::VARCHAR || 'x' AS name FROM fac)),
    ct AS (SELECT cer_name AS b, any_value(b_ord) AS b_ord, any_value(b_state) AS b_state, any_value(industry) AS industry, any_value({sql_tokens("cer_name")}) AS ctok, any_value(operator) AS operator, any_value(methane) AS methane
           FROM (SELECT p_name || ' Pty Ltd ' || (s_suppkey % 50)::VARCHAR || 'x' AS cer_name, min(s_suppkey) OVER (PARTITION BY p_name, s_suppkey % 50) AS first, s_suppkey, s_suppkey AS b_ord, CASE s_suppkey % 3 WHEN 0 THEN 'qld' WHEN 1 THEN 'VIC' ELSE '' END AS b_state,
                 CASE s_suppkey % 2 WHEN 0 THEN 'Coal mining' ELSE 'Gas supply' END AS industry, CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE '' END AS operator, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal * 1e3 END AS methane
                 FROM supplier JOIN part ON p_partkey = s_suppkey) WHERE s_suppkey = first GROUP BY 1),
    fo AS (SELECT a, min(fac_id) AS a_ord FROM (SELECT layer || '::' || name || ' ' || (fac_id % 30)::VARCHAR || 'x' AS a, fac_id FROM fac) GROUP BY a),
    fk AS (SELECT f.* FROM ft f JOIN fo ON fo.a = f.a JOIN fac ON fac.fac_id = fo.a_ord AND fac.state = f.a_state),
    fw AS (SELECT *, unnest(ftok) AS w FROM fk), cw AS (SELECT *, unnest(ctok) AS w FROM ct),
    sc AS (SELECT fw.a, cw.b, a_ord, b_ord, layer, a_state, b_state, industry, count(*) AS overlap, max(length(w)) AS longest, any_value(least(len(ftok), len(ctok))) AS size FROM fw JOIN cw USING (w) JOIN fo ON fo.a = fw.a GROUP BY ALL),
    scored AS (SELECT a, b, a_ord, b_ord, CASE WHEN layer = 'coal_mines' AND NOT contains(lower(industry), 'coal') THEN 0 WHEN layer = 'gas_plants' AND NOT contains(lower(industry), 'gas') THEN 0
           ELSE overlap / size + CASE WHEN a_state = '' OR b_state = '' THEN 0 WHEN upper(a_state) = upper(b_state) THEN 0.25 ELSE -0.6 END + CASE WHEN layer IN ('coal_mines', 'gas_plants') THEN 0.2 ELSE 0 END - CASE WHEN overlap = 1 AND longest <= 4 THEN 0.3 ELSE 0 END END::DOUBLE AS score FROM sc),
    pairs AS (SELECT * FROM scored WHERE score >= 0.6),
    -- The best pair of both its sides is accepted, and what shares a side with it goes; st: 0 open, 1 accepted, 2 gone.
    mw AS (SELECT a, b, row_number() OVER (ORDER BY score DESC, a_ord, b_ord) AS rk, 0 AS st, 0 AS k FROM pairs WHERE score >= 0.95 UNION ALL
           SELECT a, b, rk, CASE WHEN st <> 0 THEN st WHEN ta OR tb THEN 2 WHEN rk = ra AND rk = rb THEN 1 ELSE 0 END, k + 1 FROM
           (SELECT *, min(rk) FILTER (st = 0) OVER (PARTITION BY a) AS ra, min(rk) FILTER (st = 0) OVER (PARTITION BY b) AS rb, bool_or(st = 1) OVER (PARTITION BY a) AS ta, bool_or(st = 1) OVER (PARTITION BY b) AS tb, count(*) FILTER (st = 0) OVER () AS left_ FROM mw) WHERE left_ > 0),
    accepted AS (SELECT a, b FROM mw WHERE st = 1 AND k = (SELECT max(k) FROM mw))
    """


def _facility_keys(spark: SparkSession, d: str) -> DataFrame:
    """Facilities by layer and name, the first of each, with their words."""
    name = F.concat("name", F.lit(" "), (F.col("fac_id") % 30).cast("string"), F.lit("x"))
    named = views.facilities(spark, d).withColumn("name", name)
    first = named.groupBy("layer", "name").agg(F.min_by(F.struct("fac_id", "state"), "fac_id").alias("f"))
    return first.select("layer", "name", F.concat("layer", F.lit("::"), "name").alias("a"), F.col("f.fac_id").alias("a_ord"), F.col("f.state").alias("a_state"), matching.tokens(F.col("name")).alias("a_tokens"))


def _reported(spark: SparkSession, d: str) -> DataFrame:
    """Reported rows by name, the first of each."""
    s = read_table(spark, d, "supplier").join(read_table(spark, d, "part"), F.col("p_partkey") == F.col("s_suppkey"))
    k = F.col("s_suppkey")
    state = F.element_at(F.array(F.lit("qld"), F.lit("VIC"), F.lit("")), (k % 3 + 1).cast("int"))
    name = F.concat("p_name", F.lit(" Pty Ltd "), (k % 50).cast("string"), F.lit("x"))
    row = F.struct(k.alias("b_ord"), state.alias("b_state"), F.when(k % 2 == 0, "Coal mining").otherwise("Gas supply").alias("industry"), F.when(k % 4 != 0, F.col("s_name")).otherwise("").alias("operator"), F.when(k % 5 != 0, F.col("s_acctbal") * F.lit(1e3)).alias("methane_tco2e"))
    first = s.groupBy(name.alias("b")).agg(F.min_by(row, k).alias("f"))
    return first.select("b", "f.*", matching.tokens(F.col("b")).alias("b_tokens"))


def _score_pairs(spark: SparkSession, d: str) -> DataFrame:
    return materialise(matching.score_pairs(_facility_keys(spark, d), _reported(spark, d)), "pairs")


@query("fac", CER + "SELECT a, b, round_even(score, 4) AS score FROM pairs")
def match_score(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of a facility and a reported name that score enough for a review."""
    return _score_pairs(spark, d).select("a", "b", r("score"))


@query("fac", CER + "SELECT a, b, round_even(score, 4) AS score FROM pairs JOIN accepted USING (a, b)")
def match_accepted(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one matches, best score first."""
    return greedy.match_one_to_one(_score_pairs(spark, d).where(F.col("score") >= matching.ACCEPT)).select("a", "b", r("score"))


@query("fac", CER + "SELECT a, b, round_even(score, 4) AS score FROM pairs WHERE score < 0.95 AND a NOT IN (SELECT a FROM accepted) AND b NOT IN (SELECT b FROM accepted) ORDER BY score DESC, a, b")
def review_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs for review, of sides that weren't accepted, best first."""
    pairs = _score_pairs(spark, d)
    return greedy.review_pairs(pairs, greedy.match_one_to_one(pairs.where(F.col("score") >= matching.ACCEPT))).select("a", "b", r("score")).orderBy(F.desc("score"), "a", "b")


@query("fac", CER + """SELECT f.a, m.b AS cer_name, round_even(m.score, 2) AS cer_match_score, coalesce(nullif(ct.operator, ''), 'own') AS operator, round_even(CASE WHEN methane > 0 THEN methane END, 0) AS reported_methane_tco2e,
    round_even(CASE WHEN methane > 0 THEN methane END / 28, 0) AS reported_ch4_tonnes_yr, round_even(CASE WHEN methane > 0 THEN methane END / 28 * 1000 / 8760, 0) AS reported_avg_kg_hr
    FROM fk f LEFT JOIN (SELECT a, b, score FROM pairs JOIN accepted USING (a, b)) m USING (a) LEFT JOIN ct ON ct.b = m.b""")  # fmt: skip
def reported_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Facilities with the figures of their accepted match."""
    accepted = greedy.match_one_to_one(_score_pairs(spark, d).where(F.col("score") >= matching.ACCEPT))
    fac = _facility_keys(spark, d).withColumn("operator", F.lit("own"))
    held = accepted.join(fac.select("a", "layer", "name"), "a").withColumnRenamed("b", "cer_name")
    reported = _reported(spark, d).withColumn("covered_tco2e", F.lit(None).cast("double")).withColumn("baseline", F.lit(None).cast("double")).withColumnRenamed("b", "cer_name")
    out = matching.apply_matches(fac, held, reported)
    return out.select("a", "cer_name", "cer_match_score", "operator", "reported_methane_tco2e", "reported_ch4_tonnes_yr", "reported_avg_kg_hr")


@query("", "SELECT o_orderkey AS id, round_even(o_totalprice / 28 * 1000 / 8760, 0) AS avg_kg_hr, round_even(o_totalprice / 7 * 1000, 1) AS kg_hr, round_even(o_totalprice / 7.3::DOUBLE / 3.6, 1) AS ms FROM orders")
def reported_units(spark: SparkSession, d: str) -> DataFrame:
    """conversions of reported figures."""
    v = F.col("o_totalprice")
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), labels.reported_kg_hr(v).alias("avg_kg_hr"), F.bround(labels.tonnes_to_kg_hr(v / 7), 1).alias("kg_hr"), F.bround(v / F.lit(7.3) / 3.6, 1).alias("ms"))


@query("pl", "SELECT facility_name, facility_layer, count(*) AS detections_in_period, max(nullif(rate, 0)) AS peak_in_period FROM pl WHERE facility_name IS NOT NULL AND day BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY ALL")
def in_period_obs(spark: SparkSession, d: str) -> DataFrame:
    """Detections of each facility within a period."""
    return matching.in_period(views.plumes(spark, d), "2024-01-05", "2024-01-20")


@query("pl", HISTORY + ", f AS (SELECT *, (fac_id * 37) % 2000 / 1e0 AS reported_kg_hr FROM st) SELECT fac_id, reported_kg_hr FROM f LEFT JOIN (SELECT facility_name AS name, facility_layer AS layer, count(*) AS n FROM pl WHERE facility_name IS NOT NULL AND day BETWEEN '2024-01-05' AND '2024-01-08' GROUP BY ALL) USING (name, layer) WHERE reported_kg_hr >= 500 AND coalesce(n, 0) = 0 AND watch_status = 'watched, no plume'")
def silent_reporters(spark: SparkSession, d: str) -> DataFrame:
    """Watched facilities that report much and showed nothing in the period."""
    seen = matching.in_period(views.plumes(spark, d), "2024-01-05", "2024-01-08").withColumnsRenamed({"facility_name": "name", "facility_layer": "layer"})
    records = _records(spark, d).withColumn("reported_kg_hr", (F.col("fac_id") * 37) % 2000 / F.lit(1e0)).join(seen, ["name", "layer"], "left")
    return matching.silent_reporters(records).select("fac_id", "reported_kg_hr")


@query("ratios", """+ m AS (SELECT site, scene, count(ratio) AS n, quantile_cont(ratio, 0.5) AS median FROM ratios WHERE ratio IS NOT NULL GROUP BY ALL)
    SELECT site, scene, any_value(n) AS n, round_even(any_value(median), 6) AS median, round_even(1.4826 * quantile_cont(abs(ratio - median), 0.5), 6) AS sigma FROM ratios JOIN m USING (site, scene) WHERE ratio IS NOT NULL GROUP BY ALL HAVING any_value(n) >= 10 AND 1.4826 * quantile_cont(abs(ratio - median), 0.5) > 0""")  # fmt: skip
def mad_sigma(spark: SparkSession, d: str) -> DataFrame:
    """Median and robust sigma of each scene."""
    return imagestack.robust_noise(imagestack.masked_ratio(views.scenes(spark, d)), ["site", "scene"], "ratio", 10).select("site", "scene", "n", r("median", 6), r("sigma", 6))


@query("ratios", """SELECT a.site, a.row, a.col, a.scene, count(b.ratio) AS n_ref, round_even(quantile_cont(b.ratio, 0.5), 6) AS reference,
    round_even(CASE WHEN count(b.ratio) >= 3 THEN (any_value(a.ratio) - quantile_cont(b.ratio, 0.5)) / quantile_cont(b.ratio, 0.5) END, 6) AS change
    FROM ratios a LEFT JOIN ratios b ON a.site = b.site AND a.row = b.row AND a.col = b.col AND a.scene <> b.scene GROUP BY ALL""")  # fmt: skip
def loo_median(spark: SparkSession, d: str) -> DataFrame:
    """Each pixel against the median of the site's other scenes."""
    out = imagestack.leave_one_out(imagestack.masked_ratio(views.scenes(spark, d)))
    return out.select("site", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "scene", F.col("n_ref").cast("long").alias("n_ref"), r("reference", 6), r("change", 6))


@query("ratios", "SELECT site, scene, round_even(avg((ratio IS NOT NULL)::INT), 4) AS valid FROM ratios GROUP BY ALL HAVING avg((ratio IS NOT NULL)::INT) >= 0.35")
def scene_gate(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with enough usable pixels."""
    return imagestack.usable_scenes(imagestack.masked_ratio(views.scenes(spark, d))).select("site", "scene", r("valid"))


@query("ratios", "+ x AS (SELECT site, scene, row, col, b12 / 2 - 1 AS d12, b12 / 20 - 0.1::DOUBLE AS d11 FROM ratios WHERE ratio IS NOT NULL) SELECT site, scene, count(*) AS n FROM x WHERE d12 <= -0.02 AND abs(d11) <= 0.03 GROUP BY ALL")
def physical_gate(spark: SparkSession, d: str) -> DataFrame:
    """Pixels darker in the one band and steady in the other."""
    x = imagestack.masked_ratio(views.scenes(spark, d)).where("ratio IS NOT NULL")
    return x.where(imagestack.physical_gate(F.col("b12") / 2 - 1, F.col("b12") / 20 - F.lit(0.1))).groupBy("site", "scene").agg(F.count("*").alias("n"))


@query("ratios", """+ c AS (SELECT site, scene, count(*) AS n, var_samp(row) AS a, covar_samp(row, col) AS b, var_samp(col) AS c FROM ratios WHERE ratio > 1 GROUP BY ALL)
    SELECT site, scene, n, round_even(CASE WHEN n < 3 THEN 1 ELSE sqrt(greatest((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 1e-9) / greatest((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 1e-9)) END, 3) AS elongation FROM c""")  # fmt: skip
def elongation(spark: SparkSession, d: str) -> DataFrame:
    """How long the set of bright pixels of each scene is."""
    x = imagestack.masked_ratio(views.scenes(spark, d)).where("ratio > 1")
    return imagestack.elongation(x, ["site", "scene"]).select("site", "scene", "n", r("elongation", 3))


CROWD = "crowd AS (SELECT * REPLACE (lon - ((plume_id * 17) % 401 - 200) / 2040.0::DOUBLE AS lon, lat - ((plume_id * 29) % 401 - 200) / 2040.0::DOUBLE AS lat) FROM pl)"
OWN_KM = "sqrt(pow((b.lon - a.lon) * 111.32 * cos(radians(b.lat)), 2) + pow((b.lat - a.lat) * 110.57, 2))"


@query("ratios", """+ px AS (SELECT site, scene, row, col, row * 1048576 + col AS me FROM ratios WHERE ratio > 1),
    lb AS (SELECT site, scene, me, row, col, me AS name, 0 AS k, TRUE AS changed FROM px UNION ALL
           SELECT site, scene, me, row, col, least(name, low), k + 1, bool_or(low < name) OVER () FROM
           (SELECT x.site, x.scene, x.me, x.row, x.col, x.name, any_value(x.k) AS k, min(y.name) AS low FROM lb x JOIN lb y ON x.site = y.site AND x.scene = y.scene AND y.row BETWEEN x.row - 1 AND x.row + 1 AND y.col BETWEEN x.col - 1 AND x.col + 1
            WHERE x.changed GROUP BY x.site, x.scene, x.me, x.row, x.col, x.name)),
    cl AS (SELECT site, scene, row, col, name AS cluster, count(*) OVER (PARTITION BY site, scene, name) AS size FROM lb WHERE k = (SELECT max(k) FROM lb))
    SELECT site, scene, cluster, count(*) AS n, avg(row) + 0.5 AS row, avg(col) + 0.5 AS col FROM cl WHERE size >= 3 GROUP BY site, scene, cluster""")  # fmt: skip
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of bright pixels of each scene, with their size and centre."""
    x = imagestack.masked_ratio(views.scenes(spark, d)).where("ratio > 1")
    return greedy.label_clusters(x, 3).groupBy("site", "scene", "cluster").agg(F.count("*").alias("n"), (F.avg("row") + 0.5).alias("row"), (F.avg("col") + 0.5).alias("col"))


def _crowd_edges(condition: str, cell: float, same: str) -> str:
    return f"ed AS MATERIALIZED (SELECT a.id AS before, b.id AS after, a.rk FROM {binned('nd', cell)} a JOIN {spread('nd', cell)} b ON a.bx = b.bx AND a.by = b.by AND {same} AND a.rk < b.rk AND {condition})"


@query("pl", "+ " + CROWD + ", nd AS (SELECT provider AS site, plume_id AS id, plume_id AS rk, day, lon, lat FROM crowd), " + _crowd_edges(f"{OWN_KM} < 0.25", 0.01, "a.site = b.site") + ", " + VERDICTS + """,
    an AS (SELECT nd.*, coalesce(x.first, nd.id) AS anchor FROM nd LEFT JOIN (SELECT after, arg_min(before, rk) AS first FROM ed JOIN vd p ON p.id = before AND p.kept JOIN vd q ON q.id = after AND NOT q.kept GROUP BY after) x ON x.after = nd.id)
    SELECT site, id AS ord, day AS date FROM an JOIN (SELECT anchor FROM an GROUP BY anchor HAVING min(day) = max(day)) USING (anchor)""")  # fmt: skip
def drop_recurring(spark: SparkSession, d: str) -> DataFrame:
    """Detections that don't come back at one place on another date."""
    x = crowded(spark, d).select(F.col("provider").alias("site"), F.col("plume_id").alias("ord"), F.col("day").alias("date"), "lon", "lat")
    return greedy.drop_recurring(x).select("site", "ord", "date")


def crowded(spark: SparkSession, d: str) -> DataFrame:
    """Detections drawn in to a few hundred metres around their facility."""
    k = F.col("plume_id")
    return views.plumes(spark, d).withColumn("lon", F.col("lon") - ((k * 17) % 401 - 200) / F.lit(2040.0)).withColumn("lat", F.col("lat") - ((k * 29) % 401 - 200) / F.lit(2040.0))


def _deduped(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("purchase", "signup", "view", "click")])
    p = crowded(spark, d).withColumn("day", F.concat(F.lit("2024-01-0"), (F.col("plume_id") % 3 + 1).cast("string"))).withColumn("priority", F.coalesce(F.nullif(F.array_position(names, F.col("provider")), F.lit(0)) - 1, F.lit(9)))
    return greedy.dedupe_events(p.select("plume_id", "provider", "priority", "day", "lon", "lat", "rate", "datetime_utc"))


DEDUPED = "+ " + CROWD + """, nd AS (SELECT * REPLACE ('2024-01-0' || (plume_id % 3 + 1)::VARCHAR AS day), plume_id AS id, row_number() OVER (ORDER BY coalesce(list_position(['purchase', 'signup', 'view', 'click'], provider) - 1, 9), plume_id) AS rk FROM crowd),
    """ + _crowd_edges(f"{KM.format(a='a', b='b')} <= 1 AND abs(a.lon - b.lon) <= 0.02 AND abs(a.lat - b.lat) <= 0.02", 0.02, "a.day = b.day") + ", " + VERDICTS + """,
    ab AS (SELECT after AS plume_id, arg_min(before, rk) AS absorbed_by FROM ed JOIN vd p ON p.id = before AND p.kept JOIN vd q ON q.id = after AND NOT q.kept GROUP BY after),
    notes AS (SELECT absorbed_by AS plume_id, string_agg(provider, '; ' ORDER BY rk) AS also_reported_by FROM ab JOIN nd USING (plume_id) GROUP BY 1),
    dd AS (SELECT nd.*, absorbed_by, also_reported_by FROM nd LEFT JOIN ab USING (plume_id) LEFT JOIN notes USING (plume_id))"""  # fmt: skip


@query("pl", DEDUPED + " SELECT plume_id, provider, absorbed_by, also_reported_by FROM dd")
def dedupe_events(spark: SparkSession, d: str) -> DataFrame:
    """What each detection was absorbed by, and who else reported the kept ones."""
    return _deduped(spark, d).select("plume_id", "provider", "absorbed_by", "also_reported_by")


@query("pl vtx", DEDUPED + ", kp AS (SELECT * FROM dd WHERE absorbed_by IS NULL), " + _associated_sql("kp") + f"""
    SELECT kp.plume_id, provider, datetime_utc, rate, coalesce(p.name, a.name) AS nearest_name, coalesce(p.layer, a.layer) AS nearest_layer, round_even(coalesce(p.km, a.km), 2) AS nearest_km, p.name AS facility_name, round_even(p.km, 2) AS facility_km,
    {BAND} AS association, also_reported_by FROM kp LEFT JOIN a ON a.plume_id = kp.plume_id AND a.k = 1 LEFT JOIN p ON p.plume_id = kp.plume_id AND p.k = 1""")  # fmt: skip
def plume_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Q4: detections of all providers without duplicates, with their nearest infrastructure."""
    return fused(spark, d).select("plume_id", "provider", "datetime_utc", "rate", "nearest_name", "nearest_layer", r("nearest_km", 2), "facility_name", r("facility_km", 2), "association", "also_reported_by")


def fused(spark: SparkSession, d: str) -> DataFrame:
    kept = materialise(_deduped(spark, d).where("absorbed_by IS NULL").drop("absorbed_by", "priority"), "kept")
    return _associated(kept, views.vertices(spark, d))


HOTSPOTS = "+ " + INSIDE + ", spot AS (SELECT *, 108 + (col + 0.5) * 5e-2 AS lon, 1 - (row + 0.5) * 5e-2 AS lat, elevated / greatest(observed, 1) AS persistence FROM (" + _inside("stack", 9) + """) WHERE observed >= 8 AND elevated / greatest(observed, 1) >= 0.5),
    nd AS (SELECT *, row_number() OVER (ORDER BY mean_anomaly DESC, row, col) AS id FROM spot),
    ed AS MATERIALIZED (SELECT a.id AS before, b.id AS after FROM nd a JOIN nd b ON a.id < b.id AND abs(round_even(a.lon, 3) - b.lon) < 0.35 AND abs(round_even(a.lat, 3) - b.lat) < 0.35), """ + VERDICTS + ", hot AS (SELECT * FROM nd JOIN vd USING (id) WHERE kept)"  # fmt: skip


def _hotspots(spark: SparkSession, d: str) -> DataFrame:
    """The persistent inner cells, the strongest of each neighbourhood."""
    stack = materialise(grid.stack(_anomalies(spark, d)), "stack")
    inside = grid.interior(stack.where("observed > 0").select("row", "col"), GRID_ROWS, GRID_COLS)
    spots = grid.persistent(stack).join(inside, ["row", "col"], "left_semi")
    return greedy.cluster_hotspots(materialise(spots.withColumn("lon", geo.cell_lon(F.col("col"))).withColumn("lat", geo.cell_lat(F.col("row"))), "spots"))


@query("stack", HOTSPOTS + " SELECT row, col, round_even(lon, 3) AS lon, round_even(lat, 3) AS lat, round_even(mean_anomaly, 4) AS mean_anomaly, round_even(persistence, 4) AS persistence FROM hot")
def cluster_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Persistent interior cells, the strongest of each neighbourhood."""
    return _hotspots(spark, d).select("row", "col", r("lon", 3), r("lat", 3), r("mean_anomaly"), r("persistence"))


@query("pl", "+ w AS (SELECT user_id % 5 AS place, date_trunc('hour', ts) AS hour, avg(value) * 3 AS wind_from FROM events GROUP BY ALL) SELECT event_id, round_even((wind_from + 180) % 360, 0) AS toward FROM events JOIN w ON place = user_id % 5 AND hour = date_trunc('hour', ts)")
def wind_hour_join(spark: SparkSession, d: str) -> DataFrame:
    """The wind of each event's place and hour."""
    e = read_table(spark, d, "events").withColumn("place", F.col("user_id") % 5).withColumn("hour", F.date_trunc("hour", "ts"))
    wind = e.groupBy("place", "hour").agg((F.avg("value") * 3).alias("wind_from"))
    return e.join(wind, ["place", "hour"]).select("event_id", labels.wind_toward(F.col("wind_from")).alias("toward"))


@query("", "SELECT o_orderkey AS id, c_name IS NOT NULL AND o_custkey % 3 = 0 AS has_imagery, CASE WHEN o_custkey % 3 = 0 THEN c_name END AS image FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def imagery_join(spark: SparkSession, d: str) -> DataFrame:
    """Imagery by what follows the first colon of an id."""
    o = read_table(spark, d, "orders").withColumn("plume_id", F.concat(F.lit("cm:"), F.col("o_custkey").cast("string")))
    index = read_table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("image"))
    out = o.withColumn("key", F.regexp_replace("plume_id", "^[^:]*:", "")).join(index, "key", "left")
    return out.select(F.col("o_orderkey").alias("id"), F.col("image").isNotNull().alias("has_imagery"), "image")


def _ramp_sql(share: str, anchors) -> str:
    n = len(anchors)
    at = f"(least(greatest({share}, 0), 1) * {n - 1})"
    low = f"least(floor({at}), {n - 2})::INT"
    return ", ".join(f"trunc(({v})[{low} + 1] + (({v})[{low} + 2] - ({v})[{low} + 1]) * ({at} - {low}))::INT AS {c}" for c, v in ((c, f"{[float(a[k]) for a in anchors]}::DOUBLE[]") for k, c in enumerate("rgb")))


@query("anom", f"SELECT period, row, col, {_ramp_sql('(mean - 1800) / (1870 - 1800)', render.SEQUENTIAL)}, 235 AS alpha FROM anom")
def colorize_mean(spark: SparkSession, d: str) -> DataFrame:
    """cells' colours on the sequential scale."""
    return render.colorize(_anomalies(spark, d), "mean", 1800.0, 1870.0).select("period", "row", "col", "r", "g", "b", "alpha")


@query("anom", f"SELECT period, row, col, {_ramp_sql('(anomaly / 40 + 1) / 2', render.DIVERGING)}, trunc(245 * pow(least(abs(anomaly) / 40, 1), 1.6))::INT AS alpha FROM anom WHERE anomaly IS NOT NULL UNION ALL SELECT period, row, col, 0, 0, 0, 0 FROM anom WHERE anomaly IS NULL")
def colorize_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """cells' colours on the diverging scale, which fades towards the background."""
    return render.colorize(_anomalies(spark, d), "anomaly", -40.0, 40.0, True).select("period", "row", "col", "r", "g", "b", "alpha")


@query("anom", """+ s AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY row, col) AS k FROM cells), t AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY row, col) AS k FROM anom WHERE anomaly IS NOT NULL)
    SELECT (SELECT round_even(quantile_cont(mean, 0.02), 4) FROM s WHERE (k - 1) % 37 = 0) AS low, (SELECT round_even(quantile_cont(mean, 0.98), 4) FROM s WHERE (k - 1) % 37 = 0) AS high,
    (SELECT round_even(quantile_cont(abs(anomaly), 0.98), 4) FROM t WHERE (k - 1) % 37 = 0) AS anomaly_limit""")  # fmt: skip
def subsample_scale(spark: SparkSession, d: str) -> DataFrame:
    """The scales of all periods' colours, from every 37th cell of each period that has a value."""
    cells = materialise(_anomalies(spark, d), "anomalies")
    low, high = quantiles.quantiles(grid.every_nth(cells), "mean", [0.02, 0.98])
    limit = quantiles.quantiles(grid.every_nth(cells.where("anomaly IS NOT NULL")).withColumn("size", F.abs("anomaly")), "size", [0.98])[0]
    return _one_row(spark, {"low": low, "high": high, "anomaly_limit": limit})


@query()
def render_images(spark: SparkSession, d: str) -> DataFrame:
    """An image of each period, with its size."""
    colored = render.colorize(_anomalies(spark, d), "anomaly", -40.0, 40.0, True)
    return render.images(colored, GRID_ROWS, GRID_COLS).select("period", F.octet_length("image").alias("bytes"), F.sha2("image", 256).alias("sha256"))


@query("pl", "SELECT days, count(*) FILTER (day >= strftime(DATE '2024-01-30' - days::INT, '%Y-%m-%d')) AS shown, count(*) FILTER (date_diff('day', day::DATE, DATE '2024-01-30') <= days) AS counted FROM pl, (SELECT unnest([3, 7, 14, 30]) AS days) GROUP BY days")
def recency_view(spark: SparkSession, d: str) -> DataFrame:
    """Detections by recency, once by text and once by age."""
    p = views.plumes(spark, d).withColumn("days", F.explode(F.array(*[F.lit(x) for x in (3, 7, 14, 30)])))
    shown = F.col("day") >= F.date_sub(F.lit("2024-01-30").cast("date"), F.col("days")).cast("string")
    return p.groupBy("days").agg(F.count_if(shown).alias("shown"), F.count_if(labels.age_days(F.col("day"), "2024-01-30") <= F.col("days")).alias("counted"))


@query("pl", "SELECT plume_id, CASE WHEN rate IS NOT NULL THEN least(9, 3 + rate / 400) ELSE 4 END AS far, CASE WHEN rate IS NOT NULL THEN least(22, 7 + rate / 150) ELSE 9 END AS near, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[floor(((plume_id * 7) % 360 + 22.5) % 360 / 45)::INT + 1] AS octant FROM pl")
def radius_and_compass(spark: SparkSession, d: str) -> DataFrame:
    """circles' radii and the octants of directions."""
    rate = F.col("rate")
    return views.plumes(spark, d).select("plume_id", labels.circle_radius(rate, False).alias("far"), labels.circle_radius(rate, True).alias("near"), labels.compass((F.col("plume_id") * 7) % 360).alias("octant"))


@query("", "+ t AS (SELECT 1) SELECT site, tile, coverage, n_scenes FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round_even(coverage, 3) DESC, n_scenes DESC, tile DESC) AS k FROM (SELECT o_orderpriority AS site, 'T' || (o_custkey % 90)::VARCHAR AS tile, round_even(avg((o_orderkey % 10) / 1e1), 2) AS coverage, count(*) AS n_scenes FROM orders GROUP BY ALL)) WHERE k = 1".replace("+ t AS (SELECT 1) ", ""))
def best_tile(spark: SparkSession, d: str) -> DataFrame:
    """The tile that covers each site best."""
    o = read_table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("site"), F.concat(F.lit("T"), (F.col("o_custkey") % 90).cast("string")).alias("tile"))
    tiles = o.agg(F.bround(F.avg((F.col("o_orderkey") % 10) / F.lit(1e1)), 2).alias("coverage"), F.count("*").alias("n_scenes"))
    return imagestack.best_tile(tiles)


@query("", "SELECT site, tile, scene, cloud FROM (SELECT *, row_number() OVER (PARTITION BY site, tile ORDER BY coalesce(cloud, 100), scene) AS k FROM (SELECT o_orderpriority AS site, o_custkey % 9 AS tile, o_orderkey AS scene, CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey * 37) % 1000 / 1e1 END AS cloud FROM orders) WHERE cloud IS NULL OR cloud <= 60) WHERE k <= 5")
def least_cloudy_n(spark: SparkSession, d: str) -> DataFrame:
    """The five least cloudy scenes of each tile."""
    cloud = F.when(F.col("o_orderkey") % 8 != 0, (F.col("o_orderkey") * 37) % 1000 / F.lit(1e1))
    s = read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("site"), (F.col("o_custkey") % 9).alias("tile"), F.col("o_orderkey").alias("scene"), cloud.alias("cloud"))
    return imagestack.least_cloudy(s, 5)


@query("fac", "SELECT layer, count(*) AS n, count(DISTINCT name) AS names FROM fac GROUP BY layer")
def layer_union(spark: SparkSession, d: str) -> DataFrame:
    """Layers read apart, put together and counted."""
    f = views.facilities(spark, d)
    parts = [f.where(F.col("layer_ord") == k) for k in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3].drop("state"), allowMissingColumns=True)
    return whole.groupBy("layer").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query("pl", HISTORY + ", last AS (SELECT name, layer, arg_max(watch_status, fac_id) AS watch_status, arg_max(fac_id, fac_id) AS from_id FROM st GROUP BY ALL) SELECT fac.fac_id, last.watch_status, from_id FROM fac LEFT JOIN last USING (name, layer)")
def stamp_back(spark: SparkSession, d: str) -> DataFrame:
    """Layers stamped with the last record of their key."""
    records = _records(spark, d).select("name", "layer", F.col("fac_id").alias("ord"), F.col("fac_id").alias("from_id"), "watch_status")
    return fac_ops.stamp_back(views.facilities(spark, d), records, ["watch_status", "from_id"]).select("fac_id", "watch_status", "from_id")


@query("", """SELECT strftime(l_shipdate, '%Y') AS period, count(*) AS n, 'new' AS state FROM lineitem WHERE strftime(l_shipdate, '%Y') >= '1999' GROUP BY 1
    UNION ALL SELECT strftime(l_shipdate, '%Y'), count(*) FILTER (l_linenumber = 1), 'old' FROM lineitem WHERE strftime(l_shipdate, '%Y') < '1999' GROUP BY 1""")  # fmt: skip
def resumed_periods(spark: SparkSession, d: str) -> DataFrame:
    """T-A, U06: periods missing in the index are computed and put into it; finished ones stay."""
    t = read_table(spark, d, "lineitem").withColumn("period", F.date_format("l_shipdate", "yyyy"))
    path = f"{shared_dir(spark)}/emberline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    own = lambda n, state: lambda p: t.where(F.col("period") == p).agg(n.alias("n"), F.lit(state).alias("state"))
    years = [x[0] for x in t.select("period").distinct().sort("period").collect()]
    commits.run_periods(spark, path, [y for y in years if y < "1999"], own(F.count_if(F.col("l_linenumber") == 1), "old"))
    commits.run_periods(spark, path, years, own(F.count("*"), "new"))
    return commits.read_periods(spark, path, "n bigint, state string").select("period", "n", "state")


@query("ratios", """+ m AS (SELECT scene, count(ratio) AS n, quantile_cont(ratio, 0.5) AS median FROM ratios WHERE ratio IS NOT NULL GROUP BY scene),
    s AS (SELECT scene, any_value(median) AS median, 1.4826 * quantile_cont(abs(ratio - median), 0.5) AS sigma FROM ratios JOIN m USING (scene) WHERE ratio IS NOT NULL AND n >= 10 GROUP BY scene),
    o AS (SELECT scene, site, avg((ratio IS NOT NULL)::INT) AS valid, quantile_cont(ratio, 0.5) AS mid, max(ratio) AS top FROM ratios WHERE row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5 GROUP BY ALL)
    SELECT o.scene AS granule, o.site, round_even(valid, 4) AS valid, round_even(mid, 6) AS enh_median, round_even(top, 6) AS enh_max, round_even((mid - median) / nullif(sigma, 0), 3) AS excess_sigma FROM o LEFT JOIN s ON s.scene = o.scene AND s.sigma > 0 WHERE valid >= 0.25""")  # fmt: skip
def overpass_audit(spark: SparkSession, d: str) -> DataFrame:
    """Each overpass's window against its scene's background."""
    x = imagestack.masked_ratio(views.scenes(spark, d)).withColumnRenamed("ratio", "enh").withColumn("granule", F.col("scene"))
    back = imagestack.robust_noise(x, ["granule", "site"], "enh", 10)
    own = x.where(F.col("row").between(2, 5) & F.col("col").between(2, 5))
    return imagestack.overpass_stats(own, back).select("granule", "site", r("valid"), r("enh_median", 6), r("enh_max", 6), r("excess_sigma", 3))


@query("", "SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n, round_even(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def weekly_stream(spark: SparkSession, d: str) -> DataFrame:
    """T-G: the weeks again, by a stream over the landed files; a pattern, as one file is no folder."""
    return run_weekly(spark, f"{d}/event[s].parquet").select("week", "event_type", "n", r("total", 2))
