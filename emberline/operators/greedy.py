"""Greedy choices in a total order, in rounds of joins.

Visiting rows in order and keeping each that no kept one excludes gives the same set as deciding, round by round, the
first open row of each cell of a grid. Rows of one cell exclude each other, so a cell has one kept row at most, and no
table of pairs is ever made: a dense spot costs its rows, not their square. No group has to fit a task. The longest
chain of cells with rising order bounds the number of rounds; it is short where the order isn't that of the places.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import KM_PER_LAT, KM_PER_LON, NORTH, SOUTH, distance_km
from emberline.operators.components import merged_names
from emberline.operators.spatial import radius_join
from emberline.sources.shared import MANY, materialise, materialise_counted


#: Cells a side of a bin. Bins are what joins meet in: the larger, the fewer bins a kept row is sent to.
SIDE = 8


def _sent(rows: DataFrame, reach: tuple[int, int]) -> DataFrame:
    """rows once for each bin that cells within reach of their own lie in, with the bin in x and y."""
    for cell, to, n in (("bx", "x", reach[0]), ("by", "y", reach[1])):
        rows = rows.withColumn(to, F.explode(F.sequence(F.floor((F.col(cell) - n) / SIDE), F.floor((F.col(cell) + n) / SIDE))))
    return rows


def first_kept(rows: DataFrame, cell: tuple[float, float], reach: tuple[int, int], excludes, kept_places: int | None = None) -> DataFrame:
    """id and absorbed_by, the first kept row that excludes it, of each of rows (id, part, rank, lon, lat) that isn't kept.

    Rows are visited by rank, each part by itself. excludes gives the condition that a kept row (k_lon, k_lat) excludes a
    row (lon, lat); it holds for none that are more than reach cells apart, and had better hold for any two places of
    one cell. kept_places: decimals to which kept places are rounded. Rows without a place are kept.

    In each round the first open row of each cell is kept unless a cell within reach has an earlier one, and what it
    excludes goes. Only first rows are compared with each other, so a bin costs no more than its cells' pairs.
    """
    key, bin_ = ["part", "bx", "by"], ["part", "x", "y"]
    index = lambda c, size: F.floor(F.col(c) / size).cast("int")
    rows = rows.select("id", F.coalesce("part", F.lit("")).alias("part"), "rank", "lon", "lat", index("lon", cell[0]).alias("bx"), index("lat", cell[1]).alias("by"))
    placed, left = materialise_counted(rows.where(F.col("bx").isNotNull() & F.col("by").isNotNull()).withColumn("x", F.floor(F.col("bx") / SIDE)).withColumn("y", F.floor(F.col("by") / SIDE)), "open")
    place = lambda c: F.bround(c, kept_places) if kept_places is not None else F.col(c)
    near = (F.abs(F.col("bx") - F.col("k_bx")) <= reach[0]) & (F.abs(F.col("by") - F.col("k_by")) <= reach[1])
    # Rows are few bytes in files and sent to several bins, so Spark would broadcast too many of them.
    some = lambda df, n: df.hint("merge") if n > MANY else df
    open_, kept, all_ = placed, [], left
    while True:
        first = open_.groupBy(*key, "x", "y").agg(F.min(F.struct("rank", "id", "lon", "lat")).alias("f")).select(*key, "x", "y", "f.*")
        others = _sent(first.select("part", F.col("bx"), F.col("by"), F.col("rank").alias("k_rank")), reach).withColumnsRenamed({"bx": "k_bx", "by": "k_by"})
        earlier = [*(first[c] == others[c] for c in bin_), F.col("k_rank") < F.col("rank"), near]
        new = first.join(some(others, left), earlier, "left_anti").select(*key, F.col("id").alias("k_id"), F.col("rank").alias("k_rank"), place("lon").alias("k_lon"), place("lat").alias("k_lat"))
        kept.append(materialise(new, "kept"))
        gone = _sent(kept[-1], reach)
        hit = [open_[c] == gone[c] for c in bin_]
        open_, left = materialise_counted(open_.join(some(gone, left), [*hit, (F.col("id") == F.col("k_id")) | excludes()], "left_anti"), "open")
        if not left:
            break
    gone = _sent(reduce(DataFrame.unionByName, kept), reach)
    met = placed.join(some(gone, all_), [placed[c] == gone[c] for c in bin_]).where((F.col("k_rank") < F.col("rank")) & excludes())
    return met.groupBy("id").agg(F.min_by("k_id", "k_rank").alias("absorbed_by"))


def _cells(radius_km: float) -> tuple[tuple[float, float], tuple[int, int]]:
    """A grid whose cells are less than radius_km across, and how many cells the radius reaches at the far latitude."""
    size = radius_km / KM_PER_LON * 0.66
    far = max(abs(SOUTH), abs(NORTH)) + 1
    return (size, size), (math.ceil(radius_km / (KM_PER_LON * math.cos(math.radians(far)) * size)), math.ceil(radius_km / (KM_PER_LAT * size)))


def dedupe_events(plumes: DataFrame, radius_km: float = 1.0, box_deg: float = 0.02) -> DataFrame:
    """plumes (plume_id, provider, priority, day, lon, lat) with absorbed_by, null for kept rows, and also_reported_by.

    The order is priority, then plume_id. A row is absorbed by the first kept one of its day within the radius and the
    box; a null day is a day of its own, and rows without a position are kept. Rows of one provider merge too.
    """
    near = lambda: (distance_km(F.col("lon"), F.col("lat"), F.col("k_lon"), F.col("k_lat")) <= radius_km) & (F.abs(F.col("lon") - F.col("k_lon")) <= box_deg) & (F.abs(F.col("lat") - F.col("k_lat")) <= box_deg)
    rows = plumes.select(F.col("plume_id").alias("id"), F.col("day").alias("part"), F.struct("priority", "plume_id").alias("rank"), "lon", "lat")
    by = materialise(first_kept(rows, *_cells(min(radius_km, box_deg * KM_PER_LAT)), near), "absorbed").withColumnRenamed("id", "plume_id")
    out = plumes.join(by, "plume_id", "left")
    notes = plumes.join(by, "plume_id").groupBy(F.col("absorbed_by").alias("plume_id")).agg(F.array_sort(F.collect_list(F.struct("priority", "plume_id", "provider"))).alias("n"))
    return out.join(notes, "plume_id", "left").withColumn("also_reported_by", F.array_join(F.transform("n", lambda x: x["provider"]), "; ")).drop("n")


def cluster_hotspots(cells: DataFrame, radius_deg: float = 0.35) -> DataFrame:
    """The cells (row, col, lon, lat, mean_anomaly) that stand for a cluster: strongest first, none within the box of a kept one.

    The box is open, and kept cells count with their position rounded to 3 decimals. Equal anomalies go in row-major order.
    """
    rank = F.struct((-F.col("mean_anomaly")).alias("m"), "row", "col")
    rows = cells.select(F.struct("row", "col").alias("id"), F.lit("").alias("part"), rank.alias("rank"), "lon", "lat")
    near = lambda: (F.abs(F.col("lon") - F.col("k_lon")) < radius_deg) & (F.abs(F.col("lat") - F.col("k_lat")) < radius_deg)
    by = first_kept(rows, (radius_deg * 0.98, radius_deg * 0.98), (2, 2), near, 3)
    return cells.join(by.select("id.row", "id.col"), ["row", "col"], "left_anti")


def drop_recurring(detections: DataFrame, radius_km: float = 0.25) -> DataFrame:
    """detections (site, ord, date, lon, lat) without those of a group that has more than one date.

    In the order of ord, a detection joins the first group whose anchor, its first member, is nearer than the radius,
    with the cosine of the detection's own latitude; else it starts a group.
    """
    own = lambda: F.sqrt(F.pow((F.col("lon") - F.col("k_lon")) * KM_PER_LON * F.cos(F.radians("lat")), 2) + F.pow((F.col("lat") - F.col("k_lat")) * KM_PER_LAT, 2)) < radius_km
    rows = detections.select(F.struct("site", "ord").alias("id"), F.col("site").cast("string").alias("part"), F.col("ord").alias("rank"), "lon", "lat")
    by = materialise(first_kept(rows, *_cells(radius_km), own), "grouped")
    out = detections.withColumn("id", F.struct("site", "ord")).join(by, "id", "left").withColumn("anchor", F.coalesce("absorbed_by", "id"))
    single = out.groupBy("anchor").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where(F.col("lo").eqNullSafe(F.col("hi")))
    return out.join(single.select("anchor"), "anchor", "left_semi").select(*detections.columns)


def match_one_to_one(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, score, a_ord, b_ord) that a greedy pass by falling score accepts, each a and b once.

    A pair that is the first left for both of its sides is accepted; those that share a side go; again until none is left.
    """
    rank = F.struct((-F.col("score")).alias("s"), "a_ord", "b_ord")
    left, accepted = materialise(pairs.withColumn("rank", rank), "pairs"), None
    while True:
        best = [left.groupBy(side).agg(F.min("rank").alias(f"best_{side}")) for side in ("a", "b")]
        new = left.join(best[0], "a").join(best[1], "b").where((F.col("rank") == F.col("best_a")) & (F.col("rank") == F.col("best_b"))).select(*left.columns)
        new, found = materialise_counted(new, "accepted")
        if not found:
            return (new if accepted is None else accepted).drop("rank")
        accepted = new if accepted is None else accepted.unionByName(new)
        left, open_ = materialise_counted(left.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti"), "pairs")
        if not open_:
            return accepted.drop("rank")


def review_pairs(pairs: DataFrame, accepted: DataFrame, low: float = 0.6, high: float = 0.95) -> DataFrame:
    """Pairs of a middling score neither of whose sides was accepted."""
    some = pairs.where((F.col("score") >= low) & (F.col("score") < high))
    return some.join(accepted.select("a"), "a", "left_anti").join(accepted.select("b"), "b", "left_anti")


def _tile_labels(table: pa.Table) -> pa.Table:
    """The pixels of a tile with label, the first pixel of their 8-connected cluster in the tile."""
    every = table["row"].to_numpy().astype(np.int64) << 20 | table["col"].to_numpy().astype(np.int64)
    key, which = np.unique(every, return_inverse=True)
    name, links = key.copy(), []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = key + (dr << 20) + dc
        at = np.minimum(np.searchsorted(key, other), len(key) - 1)
        hit = key[at] == other
        links.append(np.stack([np.flatnonzero(hit), at[hit]]))
    a, b = np.concatenate(links, axis=1)
    while True:
        low = name.copy()
        np.minimum.at(low, a, name[b])
        np.minimum.at(low, b, name[a])
        low = low[np.searchsorted(key, low)]
        if (low == name).all():
            return table.append_column("label", pa.array(name[which]))
        name = low


def label_clusters(pixels: DataFrame, min_pixels: int = 12, tile: int = 512) -> DataFrame:
    """pixels (site, scene, row, col) with cluster, for 8-connected clusters of at least min_pixels.

    A task labels a tile of a scene, whose side bounds what it holds; then the labels of pixels that touch over tiles' borders
    are merged, however many tiles a cluster crosses. cluster is the cluster's first pixel, row times 2**20 plus col; rows and
    cols are from 0 to 2**20 - 1. Repeated pixels count as often as they are given.
    """
    keys = ["site", "scene"]
    picked = pixels.select(*keys, "row", "col")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema)
    tiles = [F.floor(F.col(c) / tile).alias(f"tile_{c}") for c in ("row", "col")]
    labelled = materialise(picked.groupBy(*keys, *tiles).applyInArrow(_tile_labels, f"{kinds}, label bigint"), "labels")
    on_edge = lambda c: (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    border = labelled.where(on_edge("row") | on_edge("col")).select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "label").distinct()
    ways = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    moved = border.withColumn("d", ways).select(*keys, (F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col"), F.col("label").alias("other"))
    name = lambda c: F.struct(*keys, F.col(c).alias("label"))
    touching = moved.join(border, [*keys, "row", "col"]).where("label <> other")
    pairs = materialise(touching.select(name("label").alias("a"), name("other").alias("b")).distinct(), "touching")
    named = labelled.withColumn("cluster", F.col("label"))
    if pairs.limit(1).count():
        least = merged_names(pairs).select(*[F.col(f"name.{k}").alias(k) for k in (*keys, "label")], F.col("least.label").alias("least"))
        named = labelled.join(least, [*keys, "label"], "left").withColumn("cluster", F.coalesce("least", "label"))
    # Sizes are counted apart, as a cluster may be most of a scene.
    large = named.groupBy(*keys, "cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_pixels).drop("n")
    return named.join(large, [*keys, "cluster"], "left_semi").select(*keys, "row", "col", "cluster")


def same_day_links(plumes: DataFrame, radius_km: float = 1.0) -> DataFrame:
    """plume_id, links (other plumes of its day within the radius), nearest and km (the nearest of them, of equals the first) of plumes that have one.

    A pair is counted in the task that meets it, so a dense spot's pairs aren't shuffled or returned.
    """
    b = plumes.select(F.col("plume_id").alias("other"), F.col("day").alias("r_day"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    near = radius_join(plumes.select("plume_id", "day", "lon", "lat"), b, radius_km, 0.05).where((F.col("day") == F.col("r_day")) & (F.col("plume_id") != F.col("other")))
    return near.groupBy("plume_id").agg(F.count("*").alias("links"), F.min(F.struct("km", "other")).alias("n")).select("plume_id", "links", F.col("n.other").alias("nearest"), F.col("n.km").alias("km"))


def same_day_pairs(plumes: DataFrame, radius_km: float = 1.0) -> DataFrame:
    """Pairs (plume_id, other, km) of plumes of one day within the radius, smaller id first. A dense spot has its square of them."""
    b = plumes.select(F.col("plume_id").alias("other"), F.col("day").alias("r_day"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    near = radius_join(plumes.select("plume_id", "day", "lon", "lat"), b, radius_km, 0.05)
    return near.where((F.col("day") == F.col("r_day")) & (F.col("plume_id") < F.col("other"))).select("plume_id", "other", "km")
