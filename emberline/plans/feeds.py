"""Registered queries on metadata tables: searches, catalogues, pivots, roll-ups and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import geo, labels
from emberline.operators import greedy, imagestack, render, spatial
from emberline.plans import views
from emberline.plans.queries import CROWD, KM, crowded, query, r
from emberline.plans.views import binned, spread
from emberline.sources import readers
from emberline.sources.shared import read_table

GRANULES = "+ g AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/eodata/a/' || o_orderkey ELSE 'eodata/b/' || o_orderkey END AS path, o_orderdate AS start, o_totalprice AS bytes, o_orderstatus AS kind FROM orders)"


def _granules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("/eodata/a/"), k.cast("string"))).otherwise(F.concat(F.lit("eodata/b/"), k.cast("string")))
    return read_table(spark, d, "orders").select(k.alias("id"), path.alias("path"), F.col("o_orderdate").alias("start"), F.col("o_totalprice").alias("bytes"), F.col("o_orderstatus").alias("kind"))


@query("", GRANULES.removeprefix("+ ").replace("g AS", "WITH g AS") + " SELECT id, regexp_replace(path, '^/?eodata/', '') AS path, round_even(bytes / 1e6, 3) AS size_mb FROM g WHERE kind = 'O' AND path <> '' AND start > TIMESTAMP '1996-01-01' AND start < TIMESTAMP '1997-01-01'")
def granule_search(spark: SparkSession, d: str) -> DataFrame:
    """Granules of a kind between two moments, neither included, with a path inside the bucket."""
    g = _granules(spark, d).where((F.col("kind") == "O") & (F.col("path") != "") & (F.col("start") > F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("start") < F.lit("1997-01-01").cast("timestamp_ntz")))
    return g.select("id", F.regexp_replace("path", "^/?eodata/", "").alias("path"), F.bround(F.col("bytes") / 1e6, 3).alias("size_mb"))


@query("", GRANULES.removeprefix("+ ").replace("g AS", "WITH g AS") + " SELECT strftime(start, '%Y-%m') AS period, count(*) AS granules, count(*) FILTER (path = '') AS failed, round_even(count(*) FILTER (path = '') / count(*), 4) AS failure_rate, count(*) FILTER (path = '') / count(*) > 0.2 AS warned, round_even(sum(bytes) / 1e6, 3) AS volume_mb FROM g GROUP BY 1")
def granule_tally(spark: SparkSession, d: str) -> DataFrame:
    """Granules of each period, how many failed, and their volume."""
    failed = F.count_if(F.col("path") == "")
    g = _granules(spark, d).groupBy(labels.month_label(F.col("start")).alias("period")).agg(F.count("*").alias("granules"), failed.alias("failed"), (failed / F.count("*")).alias("rate"), (F.sum("bytes") / 1e6).alias("mb"))
    return g.select("period", "granules", "failed", F.bround("rate", 4).alias("failure_rate"), (F.col("rate") > 0.2).alias("warned"), F.bround("mb", 3).alias("volume_mb"))


BANDS = ("B11", "B12", "SCL")


@query("", """SELECT l_orderkey AS product, max(l_partkey) FILTER (l_linenumber = 1) AS "B11", max(l_partkey) FILTER (l_linenumber = 2) AS "B12", max(l_partkey) FILTER (l_linenumber = 3) AS "SCL" FROM lineitem GROUP BY 1
    HAVING count(*) FILTER (l_linenumber = 1) > 0 AND count(*) FILTER (l_linenumber = 2) > 0 AND count(*) FILTER (l_linenumber = 3) > 0""")  # fmt: skip
def band_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Products that have all three bands, a column each."""
    band = F.element_at(F.array(*[F.lit(b) for b in BANDS]), F.col("l_linenumber"))
    t = read_table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("product"), band.alias("band"), "l_partkey")
    return t.groupBy("product").pivot("band", list(BANDS)).agg(F.max("l_partkey")).where(" AND ".join(f"{b} IS NOT NULL" for b in BANDS))


@query("pl", "SELECT fac.fac_id, count(pl.plume_id) AS overpasses FROM fac LEFT JOIN pl ON abs(pl.lon - fac.lon) <= 0.03 AND abs(pl.lat - fac.lat) <= 0.03 GROUP BY fac.fac_id")
def overpass_count(spark: SparkSession, d: str) -> DataFrame:
    """Observations whose place lies in the box around each facility."""
    fac = views.facilities(spark, d).select("fac_id", "lon", "lat")
    p = views.plumes(spark, d).select("plume_id", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    near = spatial.radius_join(fac, p, 5.0).where((F.abs(F.col("lon") - F.col("r_lon")) <= 0.03) & (F.abs(F.col("lat") - F.col("r_lat")) <= 0.03))
    return fac.join(near.groupBy("fac_id").agg(F.count("*").alias("overpasses")), "fac_id", "left").select("fac_id", F.coalesce("overpasses", F.lit(0).cast("long")).alias("overpasses"))


@query("", "SELECT l_orderkey AS id, round_even(avg(l_partkey % 360), 4) AS lon, round_even(avg(l_suppkey % 90), 4) AS lat FROM lineitem GROUP BY 1")
def vertex_centroid(spark: SparkSession, d: str) -> DataFrame:
    """the mean of each geometry's vertices."""
    point = F.struct((F.col("l_partkey") % 360).cast("double").alias("lon"), (F.col("l_suppkey") % 90).cast("double").alias("lat"))
    g = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(point).alias("coords"))
    return g.select("id", F.bround(geo.vertex_mean(F.col("coords"), "lon"), 4).alias("lon"), F.bround(geo.vertex_mean(F.col("coords"), "lat"), 4).alias("lat"))


@query("", """SELECT event_id AS id, 'sron:' || strftime(ts, '%Y%m%d') || '-' || printf('%.3f', value / 7) || '-' || printf('%.3f', value / 3) AS plume_id, strftime(ts, '%Y-%m-%d') AS day,
    replace(replace('<' || event_type || '> & "x"', '&', '&amp;'), '<', '&lt;') AS part FROM events""")  # fmt: skip
def composite_ids(spark: SparkSession, d: str) -> DataFrame:
    """identifiers from date and place, ISO days, escaped text."""
    e = read_table(spark, d, "events")
    day = F.date_format("ts", "yyyyMMdd")
    key = F.concat(F.lit("sron:"), day, F.lit("-"), F.format_string("%.3f", F.col("value") / 7), F.lit("-"), F.format_string("%.3f", F.col("value") / 3))
    escaped = labels.html_escape(F.concat(F.lit("<"), "event_type", F.lit('> & "x"')))
    return e.select(F.col("event_id").alias("id"), key.alias("plume_id"), labels.iso_date(day).alias("day"), F.replace(F.replace(escaped, F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')).alias("part"))


@query("", "SELECT s_suppkey::VARCHAR AS id, 'u' || k::VARCHAR AS url, CASE WHEN k % 3 = 0 THEN 404 WHEN k % 3 = 1 THEN 200 ELSE 403 END AS status, CASE WHEN s_suppkey % 2 = 0 THEN k % 3 IN (1, 2) ELSE k % 3 = 1 END AS ok FROM (SELECT s_suppkey, unnest([s_suppkey, s_suppkey + 1]) AS k FROM supplier WHERE s_suppkey % 5 <> 0)")
def catalog_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each catalogue URL's status against what is expected; entries with an unmet requirement are skipped."""
    s = read_table(spark, d, "supplier")
    k = F.col("s_suppkey")
    url = lambda n: F.concat(F.lit("u"), n.cast("string")).alias("url")
    expect = F.when(k % 2 == 0, F.array(F.lit(200), F.lit(403))).alias("expect")
    requires = F.when(k % 5 == 0, "KEY").alias("requires")
    entries = s.select(k.cast("string").alias("id"), F.array(F.struct(url(k), expect, requires), F.struct(url(k + 1), expect, requires)).alias("urls"))
    n = s.select(k.alias("n")).unionAll(s.select((k + 1).alias("n"))).distinct()
    seen = n.select(url(F.col("n")), F.when(F.col("n") % 3 == 0, 404).when(F.col("n") % 3 == 1, 200).otherwise(403).alias("status"))
    return readers.catalog_checks(entries, seen)


@query("", "SELECT strftime(o_orderdate, '%Y') AS year, printf('%02d', week(o_orderdate)) AS week, max('https://h/w_' || strftime(o_orderdate, '%Y') || '_wk' || week(o_orderdate)::VARCHAR || '_v' || (20240000 + o_orderkey % 1000)::VARCHAR || '.csv') AS url FROM orders GROUP BY 1, 2")
def latest_weekly(spark: SparkSession, d: str) -> DataFrame:
    """The newest file of each week among links in text."""
    o = read_table(spark, d, "orders")
    link = F.concat(F.lit("see https://h/w_"), F.date_format("o_orderdate", "yyyy"), F.lit("_wk"), F.extract(F.lit("WEEK"), F.col("o_orderdate")).cast("string"), F.lit("_v"), (F.col("o_orderkey") % 1000 + 20240000).cast("string"), F.lit(".csv here"))
    return readers.latest_weekly(o.select(link.alias("text")))


@query("pl", "SELECT plume_id, row_number() OVER (ORDER BY datetime_utc DESC, plume_id) AS k FROM pl QUALIFY k <= 400")
def recency_rank(spark: SparkSession, d: str) -> DataFrame:
    """The 400 newest detections, which alone get wind; a top-k, so only those are ranked in one task."""
    newest = views.plumes(spark, d).orderBy(F.desc("datetime_utc"), "plume_id").limit(400)
    return newest.select("plume_id", F.row_number().over(Window.orderBy(F.desc("datetime_utc"), "plume_id")).cast("long").alias("k"))


@query("ratios", """+ o AS (SELECT scene, site, avg((ratio IS NOT NULL)::INT) AS valid, quantile_cont(ratio, 0.5) AS mid FROM ratios GROUP BY ALL)
    SELECT site, count(*) AS containing, count(*) FILTER (valid >= 0.4) AS usable, round_even(count(*) FILTER (valid >= 0.4) / count(*), 4) AS observability, round_even(max(mid) FILTER (valid >= 0.4), 6) AS strongest FROM o GROUP BY site""")  # fmt: skip
def site_rollup(spark: SparkSession, d: str) -> DataFrame:
    """How often each site could be seen, and its strongest pass."""
    o = imagestack.masked_ratio(views.scenes(spark, d)).groupBy("scene", "site").agg(F.avg(F.when(F.col("ratio").isNotNull(), 1).otherwise(0)).alias("valid"), F.expr("percentile(ratio, 0.5)").alias("mid"))
    ok = F.col("valid") >= 0.4
    out = o.groupBy("site").agg(F.count("*").alias("containing"), F.count_if(ok).alias("usable"), (F.count_if(ok) / F.count("*")).alias("observability"), F.max(F.when(ok, F.col("mid"))).alias("strongest"))
    return out.select("site", "containing", "usable", r("observability"), r("strongest", 6))


@query("ratios", "SELECT site, scene, row, col, trunc(least(greatest((b12 * 20 + b11 * 5 + scl - 6) / 60, 0), 1) * 255)::INT AS alpha FROM ratios")
def black_key(spark: SparkSession, d: str) -> DataFrame:
    """Opacity from brightness."""
    x = imagestack.masked_ratio(views.scenes(spark, d))
    return x.select("site", "scene", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), render.black_key_alpha(F.col("b12") * 20, F.col("b11") * 5, F.col("scl")).alias("alpha"))


#: Clusters of two pixels or more, of scenes with four at most: cs (site, scene, row, col, cluster).
CLEAN = """+ px AS (SELECT site, scene, row, col, row * 1048576 + col AS me FROM ratios WHERE ratio > 1),
    lb AS (SELECT site, scene, me, row, col, me AS name, 0 AS k, TRUE AS changed FROM px UNION ALL
           SELECT site, scene, me, row, col, least(name, low), k + 1, bool_or(low < name) OVER () FROM
           (SELECT x.site, x.scene, x.me, x.row, x.col, x.name, any_value(x.k) AS k, min(y.name) AS low FROM lb x JOIN lb y ON x.site = y.site AND x.scene = y.scene AND y.row BETWEEN x.row - 1 AND x.row + 1 AND y.col BETWEEN x.col - 1 AND x.col + 1
            WHERE x.changed GROUP BY x.site, x.scene, x.me, x.row, x.col, x.name)),
    cl AS (SELECT site, scene, row, col, name AS cluster, count(*) OVER (PARTITION BY site, scene, name) AS size FROM lb WHERE k = (SELECT max(k) FROM lb)),
    cs AS (SELECT * FROM cl WHERE size >= 2 AND (site, scene) NOT IN (SELECT (site, scene) FROM cl WHERE size >= 2 GROUP BY site, scene HAVING count(DISTINCT cluster) > 4))
    """


@query("ratios", CLEAN + """, c AS (SELECT site, scene, cluster, count(*) AS n, var_samp(row) AS a, covar_samp(row, col) AS b, var_samp(col) AS c FROM cs GROUP BY ALL)
    SELECT site, scene, cluster, n, round_even(CASE WHEN n < 3 THEN 1 ELSE sqrt(greatest((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 1e-9) / greatest((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 1e-9)) END, 3) AS elongation FROM c""")  # fmt: skip
def scene_contamination(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of scenes that aren't crowded with them, with their size and elongation."""
    x = imagestack.masked_ratio(views.scenes(spark, d)).where("ratio > 1")
    clean = imagestack.clean_scenes(greedy.label_clusters(x, 2), 4)
    return imagestack.elongation(clean, ["site", "scene", "cluster"]).select("site", "scene", "cluster", "n", r("elongation", 3))


@query("pl", f"""+ {CROWD}, c AS (SELECT plume_id, plume_id % 3 AS day, lon, lat FROM crowd)
    SELECT a.plume_id, b.plume_id AS other, round_even({KM.format(a='a', b='b')}, 3) AS km FROM {binned('c', 0.02)} a JOIN {spread('c', 0.02)} b ON a.bx = b.bx AND a.by = b.by AND a.day = b.day AND a.plume_id < b.plume_id AND {KM.format(a='a', b='b')} <= 1""")  # fmt: skip
def same_day_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of detections of one day within a kilometre."""
    return greedy.same_day_pairs(crowded(spark, d).withColumn("day", F.col("plume_id") % 3)).select("plume_id", "other", r("km", 3))
