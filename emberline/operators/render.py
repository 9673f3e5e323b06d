"""Colours of composites and encoded images."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import EAST, NORTH, SOUTH, WEST

#: Colours of the sequential and the diverging scale, low to high.
SEQUENTIAL = ((0, 0, 4), (28, 16, 68), (79, 18, 123), (129, 37, 129), (181, 54, 122), (229, 80, 100), (251, 135, 97), (254, 194, 135), (252, 253, 191))
DIVERGING = ((33, 102, 172), (103, 169, 207), (209, 229, 240), (247, 247, 247), (253, 219, 199), (239, 138, 98), (178, 24, 43))


def ramp(share: Column, anchors=SEQUENTIAL) -> list[Column]:
    """Red, green and blue between the anchors at a share from 0 to 1, clipped, as doubles."""
    n = len(anchors)
    at = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (n - 1)
    low = F.least(F.floor(at), F.lit(n - 2)).cast("int")
    out = []
    for k in range(3):
        values = F.array(*[F.lit(float(a[k])) for a in anchors])
        a, b = F.element_at(values, low + 1), F.element_at(values, low + 2)
        out.append(a + (b - a) * (at - low))
    return out


def colorize(cells: DataFrame, value: str, low: float, high: float, diverging: bool = False) -> DataFrame:
    """cells with r, g, b and alpha, truncated; all 0 where there is no finite value. A diverging scale is symmetric about 0 and fades towards it.

    A scale of no width is one unit wide.
    """
    v = F.col(value)
    limit = max(abs(low), abs(high)) or 1.0
    share = (v / limit + 1) / 2 if diverging else (v - low) / ((high - low) or 1.0)
    alpha = 245 * F.pow(F.least(F.abs(v) / limit, F.lit(1.0)), 1.6) if diverging else F.lit(235.0)
    cols = dict(zip("rgb", ramp(share, DIVERGING if diverging else SEQUENTIAL), strict=True)) | {"alpha": alpha}
    gone = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return cells.withColumns({k: F.when(gone, 0).otherwise(c.cast("int")) for k, c in cols.items()})


def black_key_alpha(r: Column, g: Column, b: Column) -> Column:
    """Opacity that grows with brightness, so that black vanishes."""
    return (F.least(F.greatest((r + g + b - 6) / 60, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def png(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA image of height, width and 4 as PNG."""
    height, width, _ = rgba.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, width * 4)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def images(colored: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = ("period",)) -> DataFrame:
    """An image for each key, of colored cells (row, col, r, g, b, alpha); the grid bounds what a task holds."""
    fields = ", ".join(f"{k} {colored.schema[k].dataType.simpleString()}" for k in keys)

    def paint(table: pa.Table) -> pa.Table:
        out = np.zeros((rows, cols, 4), np.uint8)
        at = table["row"].to_numpy(), table["col"].to_numpy()
        for k, c in enumerate(("r", "g", "b", "alpha")):
            out[(*at, k)] = table[c].to_numpy()
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "image": pa.array([png(out)], pa.binary())})

    return colored.select(*keys, "row", "col", "r", "g", "b", "alpha").groupBy(*keys).applyInArrow(paint, f"{fields}, image binary")


def manifest(cells: DataFrame, limit: float, grid_cells: int) -> DataFrame:
    """A row for each period's image of anomalies: its url, the bounds, the scale's end, coverage and the largest anomaly."""
    held = cells.groupBy("period").agg((100 * F.count("*") / F.lit(grid_cells)).alias("coverage_pct"), F.max("anomaly").alias("max_anomaly"))
    bounds = [F.lit(x).alias(n) for x, n in ((WEST, "west"), (SOUTH, "south"), (EAST, "east"), (NORTH, "north"))]
    return held.select(F.concat(F.lit("anomaly/"), "period", F.lit(".png")).alias("url"), "period", *bounds, F.bround(F.lit(limit), 1).alias("top"), "coverage_pct", "max_anomaly")
