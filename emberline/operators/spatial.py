"""Joins by distance: an equi-join on grid bins, then the exact distance.

A radius join sends each left row to its own bin and each right row to the bins its circle touches, so both sides are
shuffled by bin and a bin's size, not the tables', bounds the comparisons. Both are always shuffled: Spark's statistics
know neither how often a row is sent nor what a compressed file holds, so it would broadcast, through the driver, tables
that are far larger than its threshold. A crowded bin's left rows are split over tasks by Spark's skew join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.geo import KM_PER_LAT, KM_PER_LON, NORTH, SOUTH, distance_km
from emberline.sources.shared import materialise, materialise_counted

BIN_DEG = 0.2


def _bin(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def radius_join(left: DataFrame, right: DataFrame, radius_km: float, bin_deg: float = BIN_DEG) -> DataFrame:
    """Pairs of rows within radius_km, with km. left has lon and lat, right has r_lon and r_lat; other names differ.

    Rows without a position have no pair. Bins are widened by what the radius spans at the region's far latitude, so
    none is lost. Repeated rows pair as often as they occur.
    """
    far = max(abs(SOUTH), abs(NORTH))
    span_lon = radius_km / (KM_PER_LON * math.cos(math.radians(far + 1)))
    span_lat = radius_km / KM_PER_LAT
    a = left.withColumn("bin_x", _bin(F.col("lon"), bin_deg)).withColumn("bin_y", _bin(F.col("lat"), bin_deg))
    b = right.where(F.col("r_lon").isNotNull() & F.col("r_lat").isNotNull())
    b = b.withColumn("bin_x", F.explode(F.sequence(_bin(F.col("r_lon") - span_lon, bin_deg), _bin(F.col("r_lon") + span_lon, bin_deg))))
    b = b.withColumn("bin_y", F.explode(F.sequence(_bin(F.col("r_lat") - span_lat, bin_deg), _bin(F.col("r_lat") + span_lat, bin_deg))))
    km = distance_km(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"))
    return a.join(b.hint("merge"), ["bin_x", "bin_y"]).drop("bin_x", "bin_y").withColumn("km", km).where(F.col("km") <= radius_km)


def nearest_two(plumes: DataFrame, vertices: DataFrame, radius_km: float = 10.0, point_layers: tuple[str, ...] = ("coal_mines", "gas_plants")) -> DataFrame:
    """Each plume with its nearest point feature and its nearest feature of any kind within the radius.

    plumes: plume_id, lon, lat. vertices: r_lon, r_lat, name, layer, layer_ord, feature_ord, vertex_ord. Of equal
    distances the first by layer, feature and vertex wins. Both winners come from one aggregation: a task's pairs are
    sorted by plume alone, which spills, and one row of each plume and task is shuffled.
    """
    pairs = radius_join(plumes.select("plume_id", "lon", "lat"), vertices, radius_km)
    key = F.struct("km", "layer_ord", "feature_ord", "vertex_ord", "name", "layer")
    best = pairs.groupBy("plume_id").agg(F.min(key).alias("any"), F.min(F.when(F.col("layer").isin(*point_layers), key)).alias("point"))
    out = plumes.join(best, "plume_id", "left")
    return out.withColumns({
        "nearest_name": F.col("any.name"), "nearest_layer": F.col("any.layer"), "nearest_km": F.col("any.km"),
        "facility_name": F.col("point.name"), "facility_layer": F.col("point.layer"), "facility_km": F.col("point.km"),
    }).drop("any", "point")


def crowded_radius(vertices: DataFrame, wanted: float, most_km: float, cell: float = BIN_DEG) -> float:
    """The radius whose circle around a vertex holds about wanted others on average, so crowded places count most; most_km at most.

    Vertices are counted by cell, and one row of sums reaches the driver.
    """
    counts = vertices.groupBy(_bin(F.col("r_lon"), cell).alias("x"), _bin(F.col("r_lat"), cell).alias("y")).agg(F.count("*").cast("double").alias("n"))
    row = counts.where("x IS NOT NULL AND y IS NOT NULL").agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("n")).first()
    if not row["n"]:
        return most_km
    area = cell * cell * KM_PER_LON * KM_PER_LAT
    return min(most_km, math.sqrt(wanted * area / (math.pi * row["squares"] / row["n"])))


def nearest_features(points: DataFrame, vertices: DataFrame, k: int = 3, first_km: float | None = None, last_km: float = 8000.0) -> DataFrame:
    """The k nearest features of each point, at any distance, with rank: ever wider radius joins.

    points: point_id, lon, lat. A point is done once k features lie within the radius; the others, and a table without
    as many features, go on to four times the radius, up to one that spans the region. What is left after each radius
    is written and counted, so the search ends with the last point, and no point meets all vertices unless it has to.
    Unless it is given, the first radius holds some four times k vertices where they are crowded, 50 km at most, so
    pairs grow with the points and not with the places' density.
    """
    order = Window.partitionBy("point_id").orderBy("km", "layer_ord", "feature_ord")
    vertices = materialise(vertices, "vertices")
    todo, done = points.select("point_id", "lon", "lat"), None
    radius = crowded_radius(vertices, 4 * k, 50.0) if first_km is None else first_km
    while True:
        pairs = radius_join(todo, vertices, radius, max(1e-3, radius / 50))
        feature = pairs.groupBy("point_id", "layer", "name", "layer_ord", "feature_ord").agg(F.min("km").alias("km"))
        ranked = materialise(feature.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
        full = ranked.where(F.col("rank") == k).select("point_id")
        if radius < last_km:
            todo, left = materialise_counted(todo.join(full.hint("merge"), "point_id", "left_anti"), "todo")
        if radius >= last_km or not left:
            return ranked if done is None else done.unionByName(ranked)
        found = ranked.join(full.hint("merge"), "point_id", "left_semi")
        done = found if done is None else done.unionByName(found)
        radius = min(last_km, radius * 4)


def nearby_elsewhere(facilities: DataFrame, plumes: DataFrame, radius_km: float = 10.0) -> DataFrame:
    """How many plumes lie within the radius of each facility but are attributed elsewhere, or to nothing.

    facilities: name, layer, lon, lat, and a key fac_id. plumes: r_lon, r_lat, facility_name, facility_layer.
    """
    pairs = radius_join(facilities, plumes, radius_km)
    same = F.col("facility_name").eqNullSafe(F.col("name")) & F.col("facility_layer").eqNullSafe(F.col("layer"))
    counts = pairs.where(~same).groupBy("fac_id").agg(F.count("*").alias("nearby_other_facility"))
    return facilities.join(counts, "fac_id", "left").withColumn("nearby_other_facility", F.coalesce("nearby_other_facility", F.lit(0).cast("long")))
