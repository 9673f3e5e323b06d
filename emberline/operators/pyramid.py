"""Overviews of gridded composites: a pyramid of levels, each half as wide and high, cut into tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256


def halved(level: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The next level of cells (row, col): means of the up to four cells that have a value; null where none has."""
    return level.groupBy(*keys, F.shiftright("row", 1).alias("row"), F.shiftright("col", 1).alias("col")).agg(*[F.avg(v).alias(v) for v in values])


def pyramid(cells: DataFrame, rows: int, cols: int, keys: list[str], values: list[str], tile: int = TILE) -> DataFrame:
    """keys, level, tile_row, tile_col, row, col and values of every level from 0, the cells themselves, to the first that fits a tile.

    NaN counts as no value. Cells that aren't there have none; repeated cells weigh as many. Each level is made from the one
    before, a quarter of its size, so all of them cost a third more than the first.
    """
    level = cells.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.when(~F.isnan(v), F.col(v)).alias(v) for v in values])
    out, number = None, 0
    while True:
        tiled = level.select(*keys, F.lit(number).alias("level"), F.floor(F.col("row") / tile).alias("tile_row"), F.floor(F.col("col") / tile).alias("tile_col"), "row", "col", *values)
        out = tiled if out is None else out.unionByName(tiled)
        if rows <= tile and cols <= tile:
            return out
        level, rows, cols, number = halved(level, keys, values), (rows + 1) // 2, (cols + 1) // 2, number + 1


def write_pyramid(levels: DataFrame, path: str) -> None:
    """Levels as Parquet by level and tile, so that a view reads the tiles that it shows."""
    levels.repartition("level", "tile_row", "tile_col").write.mode("overwrite").partitionBy("level", "tile_row", "tile_col").parquet(path)
