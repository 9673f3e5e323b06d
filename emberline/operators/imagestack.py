"""Stacks of scenes as long pixel tables: leave-one-out medians, robust noise, gates and cluster shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.geo import KM_PER_LAT, KM_PER_LON
from emberline.sources.shared import materialise

#: Scene classes that hide the ground.
MASKED = (0, 1, 3, 6, 8, 9, 10, 11)
MAD = 1.4826


def masked_ratio(pixels: DataFrame) -> DataFrame:
    """pixels (b11, b12, scl) with ratio, b12 by b11, null where a pixel can't be used."""
    ok = ~F.col("scl").isin(*MASKED) & (F.col("b11") > 0) & (F.col("b12") > 0)
    return pixels.withColumn("ratio", F.when(ok, F.try_divide("b12", "b11")))


def usable_scenes(pixels: DataFrame, least: float = 0.35) -> DataFrame:
    """Scenes whose share of usable pixels is at least so much."""
    share = F.avg(F.when(F.col("ratio").isNotNull(), 1).otherwise(0))
    return pixels.groupBy("site", "scene").agg(share.alias("valid")).where(F.col("valid") >= least)


def leave_one_out(pixels: DataFrame, least: int = 3) -> DataFrame:
    """pixels (site, row, col, scene, ratio) with the median of the pixel's other scenes, their number, and the change.

    Usable ratios are ranked in a pixel's sorted window, which spills; without a scene's own ratios the median stands
    near the middle ranks, and only those are joined back. No row carries its pixel's scenes, and none are gathered.
    """
    pixel, usable = ["site", "row", "col"], F.col("ratio").isNotNull() & F.col("scene").isNotNull()
    order = [F.when(usable, 0).otherwise(1), "ratio"]
    every, own = Window.partitionBy(*pixel), Window.partitionBy(*pixel, "scene")
    ranked = pixels.select(*pixel, "scene", "ratio", usable.alias("usable")).withColumns({"rank": F.row_number().over(every.orderBy(*order)), "n": F.count_if("usable").over(every)})
    ranked = ranked.withColumns({"k": F.row_number().over(own.orderBy("rank")), "n_own": F.count_if("usable").over(own)}).withColumn("most", F.max("n_own").over(every))
    n_ref = F.when(F.col("scene").isNotNull(), F.col("n") - F.col("n_own")).otherwise(0)
    # The place of the rest's t-th ratio among all: t and how many of the scene's own come before it.
    at = lambda t: t + F.count_if(F.col("usable") & (F.col("rank") - F.col("k") < t)).over(own)
    each = ranked.withColumn("n_ref", n_ref).withColumns({"low": at(F.floor((F.col("n_ref") - 1) / 2) + 1), "high": at(F.floor(F.col("n_ref") / 2) + 1)}).select(*pixel, "scene", "ratio", "n_ref", "low", "high")
    middle = ranked.where(F.col("usable") & (F.abs(2 * F.col("rank") - F.col("n") - 1) <= F.col("most") + 1))
    for side in ("low", "high"):
        there = middle.select(*[F.col(c).alias(f"m_{c}") for c in pixel], F.col("rank").cast("long").alias("m_rank"), F.col("ratio").alias(f"{side}_ratio"))
        same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in pixel]
        each = each.join(there, [*same, F.col(side) == F.col("m_rank")], "left").drop(*[f"m_{c}" for c in pixel], "m_rank")
    reference = F.when(F.col("n_ref") > 0, (F.col("low_ratio") + F.col("high_ratio")) / 2)
    each = each.select(*pixel, "scene", "ratio", F.col("n_ref").cast("int").alias("n_ref"), reference.alias("reference"))
    return each.withColumn("change", F.when(F.col("n_ref") >= least, F.try_divide(F.col("ratio") - F.col("reference"), F.col("reference"))))


def robust_noise(values: DataFrame, keys: list[str], column: str, least: int = 400) -> DataFrame:
    """median and sigma (from the median absolute deviation) of each group with enough values and sigma over 0."""
    held = values.where(F.col(column).isNotNull())
    middle = held.groupBy(*keys).agg(F.count("*").alias("n"), F.expr(f"percentile({column}, 0.5)").alias("median"))
    spread = held.join(middle, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("median").alias("median"), (MAD * F.expr(f"percentile(abs({column} - median), 0.5)")).alias("sigma"))
    return spread.where((F.col("n") >= least) & (F.col("sigma") > 0))


def elongation(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Square root of the ratio of the covariance's eigenvalues over a cluster's cells; 1 for fewer than three."""
    stats = clusters.groupBy(*keys).agg(F.count("*").alias("n"), F.var_samp("row").alias("a"), F.covar_samp("row", "col").alias("b"), F.var_samp("col").alias("c"))
    mid, half = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.col("b") * F.col("b"))
    floor = lambda x: F.greatest(x, F.lit(1e-9))
    return stats.select(*keys, "n", F.when(F.col("n") < 3, 1.0).otherwise(F.sqrt(floor(mid + half) / floor(mid - half))).alias("elongation"))


def clean_scenes(clusters: DataFrame, most: int = 15) -> DataFrame:
    """Clusters of scenes that have at most so many, counted before the physical gate."""
    crowded = clusters.select("site", "scene", "cluster").distinct().groupBy("site", "scene").count().where(F.col("count") > most)
    return clusters.join(crowded.select("site", "scene"), ["site", "scene"], "left_anti")


def physical_gate(d12: Column, d11: Column) -> Column:
    return (d12 <= -0.02) & (F.abs(d11) <= 0.03)


def best_tile(tiles: DataFrame) -> DataFrame:
    """Each site's tile by coverage rounded to 3 decimals, number of scenes and name, all falling."""
    order = Window.partitionBy("site").orderBy(F.bround("coverage", 3).desc(), F.desc("n_scenes"), F.desc("tile"))
    return tiles.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def least_cloudy(scenes: DataFrame, n: int, most: float = 60.0) -> DataFrame:
    """Each site's and tile's n scenes with least cloud; unknown cloud passes and counts as 100."""
    order = Window.partitionBy("site", "tile").orderBy(F.coalesce("cloud", F.lit(100.0)), "scene")
    return scenes.where(F.col("cloud").isNull() | (F.col("cloud") <= most)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def overpass_stats(pixels: DataFrame, background: DataFrame, least: float = 0.25) -> DataFrame:
    """Each overpass's share of valid pixels, median and largest enhancement, and its excess over the background in sigmas.

    pixels: granule, site, enh. background: granule, site, median, sigma.
    """
    own = pixels.groupBy("granule", "site").agg(F.avg(F.when(F.col("enh").isNotNull(), 1).otherwise(0)).alias("valid"), F.expr("percentile(enh, 0.5)").alias("enh_median"), F.max("enh").alias("enh_max"))
    joined = own.where(F.col("valid") >= least).join(background.select("granule", "site", "median", "sigma"), ["granule", "site"], "left")
    return joined.withColumn("excess_sigma", F.try_divide(F.col("enh_median") - F.col("median"), F.col("sigma"))).drop("median", "sigma")


def site_box(lon: Column, lat: Column, half_km: Column) -> Column:
    """The box around a site: west, south, east and north."""
    dlat, dlon = half_km / KM_PER_LAT, half_km / (KM_PER_LON * F.cos(F.radians(lat)))
    return F.struct((lon - dlon).alias("west"), (lat - dlat).alias("south"), (lon + dlon).alias("east"), (lat + dlat).alias("north"))


def box_wkt(box: Column) -> Column:
    """A box as a closed polygon of well-known text."""
    corners = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    text = F.concat_ws(",", *[F.concat_ws(" ", box[x].cast("string"), box[y].cast("string")) for x, y in corners])
    return F.concat(F.lit("POLYGON(("), text, F.lit("))"))


def tile_code(product: Column) -> Column:
    """The part of a product's name that is T, two digits and three more characters; null for none."""
    return F.try_element_at(F.filter(F.split(product, "_"), lambda x: (F.length(x) == 6) & x.rlike("^T[0-9]{2}")), F.lit(1))


def scene_metadata(catalogue: DataFrame) -> DataFrame:
    """name, key, start, cloud and tile of catalogue rows Name, S3Path, Start and Attributes (Name, Value).

    The last attribute of cloud cover counts; without one, cloud is null. The key is the path without the bucket.
    """
    clouds = F.filter("Attributes", lambda a: a["Name"] == "cloudCover")
    key = F.regexp_replace(F.regexp_replace(F.coalesce("S3Path", F.lit("")), "^/+", ""), "^eodata/", "")
    return catalogue.select(F.col("Name").alias("name"), key.alias("key"), F.substring(F.coalesce("Start", F.lit("")), 1, 19).alias("start"), F.try_element_at(clouds, F.lit(-1))["Value"].try_cast("double").alias("cloud"), tile_code(F.col("Name")).alias("tile"))


def clipped_windows(windows: DataFrame, min_side: int = 24, min_coverage: float = 0.25) -> DataFrame:
    """windows (row0, col0, row1, col1, exclusive at the end, and height, width of the image) clipped to the image, with coverage.

    Windows of fewer than min_side pixels a side, or of which less than min_coverage is inside, are left out.
    """
    inside = windows.withColumns({"r0": F.greatest("row0", F.lit(0)), "c0": F.greatest("col0", F.lit(0)), "r1": F.least("row1", "height"), "c1": F.least("col1", "width")})
    asked = F.greatest((F.col("row1") - F.col("row0")) * (F.col("col1") - F.col("col0")), F.lit(1))
    out = inside.withColumn("coverage", (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0")) / asked)
    return out.where((F.col("r1") - F.col("r0") >= min_side) & (F.col("c1") - F.col("c0") >= min_side) & (F.col("coverage") >= min_coverage))


def sample(pixels: DataFrame, sites: DataFrame, keys: list[str], value: str, radius: int = 12, nodata: float | None = None, min_side: int = 4) -> DataFrame:
    """keys, site and value of the pixels around each site, up to radius before and one less after it, of images that contain it.

    pixels: keys, row, col, value. sites: keys, site, row, col, height, width. The image contains a site whose row and
    col it has; a window of fewer than min_side pixels a side has no rows. nodata becomes null.
    """
    held = sites.where(F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1))
    held = held.withColumns({"row0": F.col("row") - radius, "col0": F.col("col") - radius, "row1": F.col("row") + radius, "col1": F.col("col") + radius}).drop("row", "col")
    held = clipped_windows(held, min_side, 0.0).select(*keys, "site", "r0", "c0", "r1", "c1")
    own = pixels.select(*keys, "row", "col", value).join(held, keys).where((F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r1")) & (F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c1")))
    return own.select(*keys, "site", F.when(F.lit(nodata).isNull() | (F.col(value) != F.lit(nodata)), F.col(value)).alias(value))


def overpasses(pixels: DataFrame, sites: DataFrame, radius: int = 12, min_background: int = 2000, least: float = 0.25, nodata: float | None = None, min_side: int = 4) -> DataFrame:
    """Each granule and site in it: valid share, observed, median, maximum, excess over the scene in sigmas, hot pixels.

    pixels: granule, row, col, enh. sites: granule, site, row, col, height, width. The scene is a box twelve times as
    wide; with fewer than min_background valid pixels there, or no spread, it tells nothing.
    """
    key = ["granule", "site"]
    own = materialise(sample(pixels, sites, ["granule"], "enh", radius, nodata, min_side), "own")
    wide = sample(pixels, sites, ["granule"], "enh", radius * 12, nodata, min_side)
    noise = robust_noise(wide, key, "enh", min_background).select(*key, "median", "sigma")
    stats = own.groupBy(*key).agg((F.count("enh") / F.count("*")).alias("valid"), F.expr("percentile(enh, 0.5)").alias("site_median"), F.max("enh").alias("site_max"))
    joined = stats.withColumn("observed", F.col("valid") >= least).join(noise, key, "left")
    hot = own.join(noise, key).where(F.col("enh") > F.col("median") + 3 * F.col("sigma")).groupBy(*key).agg(F.count("*").alias("hot"))
    ok = F.col("observed") & F.col("sigma").isNotNull()
    out = joined.join(hot, key, "left").withColumns({"excess_sigma": F.when(ok, (F.col("site_median") - F.col("median")) / F.col("sigma")), "pixels_above_3sigma": F.when(ok, F.coalesce("hot", F.lit(0)))})
    return out.drop("hot", "median", "sigma")


def site_summary(passes: DataFrame) -> DataFrame:
    """Each site's passes: containing, usable, their share, first and last usable, strongest excess and highest value.

    passes: site, datetime, contains_site, observed, excess_sigma, site_max, sensitivity.
    """
    ok = F.col("observed")
    held = passes.groupBy("site").agg(
        F.count_if("contains_site").alias("containing"), F.count_if(ok).alias("usable"), F.min(F.when(ok, F.col("datetime"))).alias("first_usable"), F.max(F.when(ok, F.col("datetime"))).alias("last_usable"),
        F.max(F.when(ok, F.col("excess_sigma"))).alias("strongest"), F.max(F.when(ok, F.col("site_max"))).alias("site_max"), F.percentile(F.when(ok, F.col("sensitivity")), 0.5).alias("median_sensitivity"),
    )
    return held.withColumn("observability", F.coalesce(F.try_divide("usable", "containing"), F.lit(0.0)))


def grand_totals(summary: DataFrame) -> DataFrame:
    """The sums of all sites' counts, and the share that these give."""
    out = summary.agg(F.count("*").alias("sites"), F.sum("containing").alias("containing"), F.sum("usable").alias("usable"))
    return out.withColumn("observability", F.coalesce(F.try_divide("usable", "containing"), F.lit(0.0)))


def cluster_stats(pixels: DataFrame, noise: DataFrame) -> DataFrame:
    """Each cluster's pixels, centre, area in hectares, mean and least change, reference scenes and strength in sigmas.

    pixels: site, scene, cluster, row, col, change, n_ref. noise: site, scene, median, sigma of the scene's changes.
    """
    held = pixels.groupBy("site", "scene", "cluster").agg(
        F.count("*").alias("pixels"), (F.avg("row") + 0.5).alias("row"), (F.avg("col") + 0.5).alias("col"), F.avg("change").alias("mean_change"), F.min("change").alias("min_change"),
        F.percentile("n_ref", 0.5).cast("int").alias("reference_scenes"),
    )
    out = held.join(noise.select("site", "scene", "median", "sigma"), ["site", "scene"])
    return out.withColumns({"area_ha": F.bround(F.col("pixels") * 0.04, 2), "strength": F.bround(F.abs(F.col("mean_change") - F.col("median")) / F.col("sigma"), 1)}).drop("median", "sigma")


def pixel_place(row: Column, col: Column, west: Column, north: Column, lon_size: Column, lat_size: Column) -> Column:
    """Longitude and latitude of a place in an image by its affine transform, for images in geographic coordinates."""
    return F.struct(F.bround(west + col * lon_size, 5).alias("lon"), F.bround(north - row * lat_size, 5).alias("lat"))


def enhancement_files(granules: DataFrame) -> DataFrame:
    """granule with enh, sens and uncert, the first url whose file name has the mark of each; granules without enh are left out.

    granules: granule, urls (array).
    """
    marks = {"enh": "_CH4ENH_", "sens": "_CH4SENS_", "uncert": "_CH4UNCERT_"}
    name = lambda u: F.element_at(F.split(u, "/"), -1)
    pick = lambda mark: F.try_element_at(F.filter("urls", lambda u: u.endswith(".tif") & name(u).contains(mark)), F.lit(1))
    return granules.select("granule", *[pick(mark).alias(k) for k, mark in marks.items()]).where("enh IS NOT NULL")
