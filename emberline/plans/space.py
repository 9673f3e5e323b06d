"""Registered queries on places: footprints, projected centres, rewritten images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import utm
from emberline.operators import footprints, imagestack, render
from emberline.plans import views
from emberline.plans.queries import _anomalies, _ramp_sql, query
from emberline.plans.views import GRID_COLS, GRID_ROWS
from emberline.sources import images
from emberline.sources.shared import materialise, read_table

#: Corners of an order's footprint go around its place in eight directions, as far as a line's quantity says; every third has a hole.
DX, DY = (1, 1, 0, -1, -1, -1, 0, 1), (0, 1, 1, 1, 0, -1, -1, -1)
FOOTPRINTS = f"""+ fl AS (SELECT l_orderkey AS foot_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity::DOUBLE / 25 + 5e-1 AS far FROM lineitem),
    fv AS (SELECT foot_id, ring, k, 108 + ((foot_id * 7919) % 52000) / 1e3 + ({list(DX)})[k * 8 // n + 1] * (far * share) AS x, -45 + ((foot_id * 104729) % 46000) / 1e3 + ({list(DY)})[k * 8 // n + 1] * (far * share) AS y
           FROM fl, (SELECT 0 AS ring, 1e0 AS share UNION ALL SELECT 1, 5e-1) WHERE n >= 3 AND (ring = 0 OR foot_id % 3 = 0)),
    fe AS (SELECT foot_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM fv WINDOW w AS (PARTITION BY foot_id, ring ORDER BY k))"""
ANSWERED = "CASE WHEN state <> '' THEN coalesce(n, 0) END AS overpasses"


def _footprints(spark: SparkSession, d: str) -> DataFrame:
    """foot_id, start and rings of the orders' footprints."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity").cast("double") / 25 + 0.5).alias("far"))))
    each = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("foot_id")).agg(lines.alias("lines"))
    lon = F.lit(108) + ((F.col("foot_id") * 7919) % 52000) / F.lit(1e3)
    lat = F.lit(-45) + ((F.col("foot_id") * 104729) % 46000) / F.lit(1e3)
    # Columns of an order are computed once, not for each of its corners.
    each = each.withColumns({"lon": lon, "lat": lat, "n": F.size("lines")})

    def ring(share: float):
        def corner(x, k):
            to = ((k * 8) / F.col("n")).cast("int") + 1
            place = lambda start, way: F.col(start) + F.element_at(F.array(*[F.lit(v) for v in way]), to) * (x["far"] * share)
            return F.struct(place("lon", DX).alias("lon"), place("lat", DY).alias("lat"))

        return F.transform("lines", corner)

    rings = F.when(F.col("foot_id") % 3 == 0, F.array(ring(1.0), ring(0.5))).otherwise(F.array(ring(1.0)))
    return each.select("foot_id", rings.alias("rings"))


@query("fac", FOOTPRINTS + f""", fb AS (SELECT *, unnest(range(floor(least(y1, y2))::INT, floor(greatest(y1, y2))::INT + 1)) AS band FROM fe),
    inside AS (SELECT fac_id, foot_id FROM fac JOIN fb ON band = floor(lat)::INT WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
    SELECT fac_id, {ANSWERED} FROM fac LEFT JOIN (SELECT fac_id, count(*) AS n FROM inside GROUP BY 1) USING (fac_id)""")  # fmt: skip
def footprint_overpasses(spark: SparkSession, d: str) -> DataFrame:
    """How many footprints hold each facility; null, not 0, where the catalogue doesn't answer, as for those without a state."""
    fac = views.facilities(spark, d).select("fac_id", "state", "lon", "lat")
    places = fac.select(F.col("fac_id").alias("box_id"), F.col("lon").alias("west"), F.col("lat").alias("south"), F.col("lon").alias("east"), F.col("lat").alias("north"))
    counts = footprints.counts_in_footprints(places, _footprints(spark, d), closed=False).withColumnRenamed("box_id", "fac_id")
    return footprints.with_counts(fac, counts, "fac_id", F.col("state") != "").select("fac_id", "overpasses")


#: Footprints that share a point with a box: an edge's line parts the box's corners where their extents meet, or a corner lies inside.
_SIDE = "(x2 - x1) * ({cy} - y1) - (y2 - y1) * ({cx} - x1)"


def _box_sql(box: str, keys: str) -> str:
    corners = ", ".join(_SIDE.format(cx=x, cy=y) for x in ("west", "east") for y in ("south", "north"))
    return f"""SELECT DISTINCT {keys} FROM (SELECT {keys} FROM {box} WHERE least(x1, x2) <= east AND greatest(x1, x2) >= west AND least(y1, y2) <= north AND greatest(y1, y2) >= south AND least({corners}) <= 0 AND greatest({corners}) >= 0
    UNION ALL SELECT {keys} FROM {box} WHERE (y1 > south) <> (y2 > south) AND west < (x2 - x1) * (south - y1) / (y2 - y1) + x1 GROUP BY {keys} HAVING count(*) % 2 = 1)"""


@query("", FOOTPRINTS.replace("+ fl", "WITH fl") + f", hit AS ({_box_sql('(SELECT *, 120 AS west, -30 AS south, 125 AS east, -25 AS north FROM fe)', 'foot_id')}) SELECT foot_id AS id, strftime(o_orderdate, '%Y-%m-%d') AS start FROM hit JOIN orders ON o_orderkey = foot_id WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def granules_over_region(spark: SparkSession, d: str) -> DataFrame:
    """Granules between two moments whose footprint shares a point with the region, by start."""
    edges = footprints.rings_edges(F.col("rings"))
    met = _footprints(spark, d).where(footprints.meets_box(edges, *[F.lit(float(v)) for v in (120, -30, 125, -25)]))
    start = F.col("o_orderdate")
    held = read_table(spark, d, "orders").where((start > F.lit("1996-01-01").cast("timestamp_ntz")) & (start < F.lit("1997-01-01").cast("timestamp_ntz")))
    return met.join(held, F.col("foot_id") == F.col("o_orderkey")).select(F.col("foot_id").alias("id"), F.date_format(start, "yyyy-MM-dd").alias("start")).orderBy("start", "id")


@query("fac", FOOTPRINTS + f""", bx AS (SELECT fac_id, lon - 3e-2 AS west, lat - 3e-2 AS south, lon + 3e-2 AS east, lat + 3e-2 AS north FROM fac),
    fb AS (SELECT *, unnest(range(floor(least(y1, y2))::INT, floor(greatest(y1, y2))::INT + 1)) AS band FROM fe), bb AS (SELECT *, unnest(range(floor(south)::INT, floor(north)::INT + 1)) AS band FROM bx),
    near AS (SELECT DISTINCT fac_id, west, south, east, north, foot_id, x1, y1, x2, y2 FROM bb JOIN fb USING (band)), hit AS ({_box_sql('near', 'fac_id, foot_id')})
    SELECT fac_id, {ANSWERED} FROM fac LEFT JOIN (SELECT fac_id, count(*) AS n FROM hit GROUP BY 1) USING (fac_id)""")  # fmt: skip
def box_overpasses(spark: SparkSession, d: str) -> DataFrame:
    """How many footprints share a point with the small box around each facility; null where the catalogue doesn't answer."""
    fac = views.facilities(spark, d).select("fac_id", "state", "lon", "lat")
    sides = {"west": F.col("lon") - 0.03, "south": F.col("lat") - 0.03, "east": F.col("lon") + 0.03, "north": F.col("lat") + 0.03}
    boxes = fac.select(F.col("fac_id").alias("box_id"), *[v.alias(k) for k, v in sides.items()])
    counts = footprints.counts_in_footprints(boxes, _footprints(spark, d)).withColumnRenamed("box_id", "fac_id")
    return footprints.with_counts(fac, counts, "fac_id", F.col("state") != "").select("fac_id", "overpasses")


def _utm_sql() -> str:
    """The inverse series in SQL, from xi and eta."""
    up = " - ".join(["xi", *[f"{b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(utm.BETA, 1)]])
    along = " - ".join(["eta", *[f"{b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(utm.BETA, 1)]])
    lat = " + ".join(["chi", *[f"{c!r} * sin({2 * j} * chi)" for j, c in enumerate(utm.DELTA, 1)]])
    return f"""uv AS (SELECT *, {up} AS u, {along} AS v FROM xe), uc AS (SELECT *, asin(sin(u) / cosh(v)) AS chi FROM uv),
    ll AS (SELECT *, zone * 6 - 183 + degrees(atan2(sinh(v), cos(u))) AS lon, degrees({lat}) AS lat FROM uc)"""


@query("ratios", f"""+ ce AS (SELECT site, scene, avg(row) AS row, avg(col) AS col, count(*) AS n FROM ratios WHERE ratio > 1 GROUP BY ALL),
    en AS (SELECT *, 50 + site % 7 AS zone, scene % 2 = 0 AS south, 300000 + (scene * 977) % 300000 + (col + 5e-1) * 20 AS e, CASE WHEN scene % 2 = 0 THEN 9000000 ELSE 1000000 END + (scene * 7919) % 900000 - (row + 5e-1) * 20 AS nn FROM ce),
    xe AS (SELECT *, (nn - CASE WHEN south THEN 1e7 ELSE 0 END) / {utm.RADIUS!r} AS xi, (e - 500000) / {utm.RADIUS!r} AS eta FROM en), {_utm_sql()}
    SELECT site, scene, n, round_even(lon, 5) AS lon, round_even(lat, 5) AS lat FROM ll""")  # fmt: skip
def utm_centres(spark: SparkSession, d: str) -> DataFrame:
    """Where each scene's bright pixels lie, from its image's corner in metres of its zone."""
    bright = imagestack.masked_ratio(views.scenes(spark, d)).where("ratio > 1").groupBy("site", "scene").agg(F.avg("row").alias("row"), F.avg("col").alias("col"), F.count("*").alias("n"))
    south = F.col("scene") % 2 == 0
    north = F.when(south, 9_000_000).otherwise(1_000_000) + (F.col("scene") * 7919) % 900_000
    lon, lat = utm.centre_degrees(F.col("row"), F.col("col"), 300_000 + (F.col("scene") * 977) % 300_000, north, 20.0, 50 + F.col("site") % 7, south)
    return bright.select("site", "scene", "n", F.bround(lon, 5).alias("lon"), F.bround(lat, 5).alias("lat"))


@query("anom", f"""+ px AS (SELECT period, {_ramp_sql('(anomaly / 40 + 1) / 2', render.DIVERGING)} FROM anom WHERE anomaly IS NOT NULL),
    al AS (SELECT period, r + g + b AS light, trunc(least(greatest((r + g + b - 6) / 60, 0), 1) * 255)::INT AS alpha FROM px)
    SELECT period, NULL::VARCHAR AS fault, {GRID_ROWS * GRID_COLS} AS n_pixels, coalesce(sum(light), 0)::BIGINT AS light, coalesce(sum(alpha), 0)::BIGINT AS alpha FROM (SELECT DISTINCT period FROM anom) LEFT JOIN al USING (period) GROUP BY period
    UNION ALL SELECT DISTINCT period || ' cut', 'ends inside a chunk', 0, 0, 0 FROM anom""")  # fmt: skip
def transparent_images(spark: SparkSession, d: str) -> DataFrame:
    """Pictures read, made transparent where they are black, written and read again; cut ones are faults."""
    colored = render.colorize(_anomalies(spark, d), "anomaly", -40.0, 40.0, True)
    drawn = materialise(render.images(colored, GRID_ROWS, GRID_COLS), "images")
    cut = drawn.select(F.concat("period", F.lit(" cut")).alias("period"), F.substring("image", 1, 60).alias("image"))
    again = images.rewrite_images(drawn.unionByName(cut))
    seen = images.pixels(again.drop("fault"), "period").groupBy("period").agg(
        F.max("fault").alias("fault"), F.count("row").alias("n_pixels"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(n) for c, n in ((F.col("r") + F.col("g") + F.col("b"), "light"), (F.col("alpha"), "alpha"))]
    )
    return seen.select("period", "fault", "n_pixels", "light", "alpha")
