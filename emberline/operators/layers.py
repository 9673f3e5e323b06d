"""Layers of infrastructure: features to ordered vertices, points, and choices of what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import EAST, NORTH, SOUTH, WEST, any_vertex_in

#: The layers in the order in which equal distances are decided, and where a route counts as one of the north.
LAYERS = ("coal_mines", "gas_plants", "pipelines_gas", "pipelines_oil")
POINT_LAYERS = LAYERS[:2]
SPLIT_LAT, SPLIT_LON = -10.0, 140.8
#: Colours of watch statuses on a light map, and of any other.
STATUS_COLOURS = (("emitting", "#d9480f"), ("watched, no plume", "#0b7285"), ("under-observed", "#b0851f"), ("blind spot", "#868e96"))
OTHER_COLOUR = "#adb5bd"


def vertex_table(features: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """A row for each vertex of features (layer, feature_ord, name, coords), with layer_ord and vertex_ord.

    Layers that aren't named have no rows, nor have features without coordinates; a layer without features is left out.
    """
    order = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer")) - 1
    each = features.withColumn("layer_ord", order).where(F.col("layer_ord") >= 0)
    each = each.select("layer", "layer_ord", "feature_ord", "name", F.posexplode("coords").alias("vertex_ord", "p"))
    return each.select("layer", "layer_ord", "feature_ord", "name", "vertex_ord", F.col("p.lon").alias("r_lon"), F.col("p.lat").alias("r_lat"))


def point_facilities(features: DataFrame, layers: tuple[str, ...] = POINT_LAYERS) -> DataFrame:
    """Point features of the layers with lon and lat to five decimals. features: layer, geom_type, coords and others."""
    first = F.try_element_at("coords", F.lit(1))
    held = features.where(F.col("layer").isin(*layers) & (F.col("geom_type") == "Point") & (F.size("coords") > 0))
    return held.withColumn("lon", F.bround(first["lon"], 5)).withColumn("lat", F.bround(first["lat"], 5))


def northern(coords: Column) -> Column:
    """Whether a route has a vertex in the region, and one north and east of the split."""
    return any_vertex_in(coords, WEST, SOUTH, EAST, NORTH) & F.exists(coords, lambda p: (p["lat"] > SPLIT_LAT) & (p["lon"] > SPLIT_LON))


def shown(features: DataFrame, layers: list[str]) -> DataFrame:
    """Features of the layers that are switched on."""
    return features.where(F.col("layer").isin(layers))


def status_colour(status: Column) -> Column:
    """A status's colour; any other status, and none, has that of the unknown."""
    out = F.lit(OTHER_COLOUR)
    for name, colour in reversed(STATUS_COLOURS):
        out = F.when(status == name, F.lit(colour)).otherwise(out)
    return out


def facility_radius(detections: Column, near: bool) -> Column:
    """Radius of a facility's circle, at zoom 8 if near, else at zoom 3; larger where there are detections."""
    seen, other = (9.0, 5.0) if near else (4.0, 2.5)
    return F.when(F.coalesce(detections, F.lit(0)) > 0, F.lit(seen)).otherwise(F.lit(other))


def without_retired(rows: DataFrame, names: tuple[str, ...] = ("observed_vs_reported_ratio", "imagery", "imagery_bounds")) -> DataFrame:
    """rows without fields that earlier runs wrote and later ones no longer do."""
    return rows.drop(*names)
