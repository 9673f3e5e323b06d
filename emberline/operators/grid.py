"""Gridded composites: binning, latitude background, stacks of periods, and masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.geo import cell_col, cell_row, in_grid
from emberline.sources.shared import materialise

QA_MIN, MIN_OBS, ELEVATED, MIN_MONTHS, PERSISTENT = 0.5, 3, 18.0, 8, 0.5
HALF_ROWS, MIN_BACKGROUND = 20, 50
#: Rows of a task's block; with those around it, a task reads a third more than it gives.
BLOCK_ROWS = 120


def usable(soundings: DataFrame) -> DataFrame:
    """Soundings over land, of sufficient quality, inside the grid and without nulls or NaN."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("lon", "lat", "qa", "value")]
    return soundings.where(ok[0] & ok[1] & ok[2] & ok[3] & (F.col("qa") >= QA_MIN) & (F.col("surface").bitwiseAND(1) == 0) & in_grid(F.col("lon"), F.col("lat")))


#: A value is held as two whole numbers, of units of 2**-20 and of 2**-51, as sums of those don't depend on their order.
COARSE, FINE = float(1 << 20), float(1 << 31)
#: Values from which on the first would not hold the sum of a few thousand million.
TOO_LARGE = float(1 << 31)


def _limbs(value: Column) -> tuple[Column, Column]:
    """The two numbers of a value; exact from 1 on, else cut to 2**-51."""
    coarse = F.floor(value * COARSE)
    return coarse, F.floor((value * COARSE - coarse) * FINE)


def _total() -> Column:
    return F.col("coarse") / COARSE + F.col("fine") / (COARSE * FINE)


def bin_soundings(soundings: DataFrame) -> DataFrame:
    """Sum (total, and as coarse and fine) and count of each period's cells; partial sums are merged by merge_bins.

    The sums have the same bits in whatever order and parts they are taken. Values of TOO_LARGE or more raise.
    """
    value = F.when(F.abs("value") < TOO_LARGE, F.col("value")).otherwise(F.raise_error(F.lit("a value is too large to be summed exactly")))
    coarse, fine = _limbs(value)
    cells = soundings.select("period", cell_row(F.col("lat")).alias("row"), cell_col(F.col("lon")).alias("col"), coarse.alias("coarse"), fine.alias("fine"))
    return cells.groupBy("period", "row", "col").agg(F.sum("coarse").alias("coarse"), F.sum("fine").alias("fine"), F.count("*").alias("n_obs")).withColumn("total", _total())


def merge_bins(*parts: DataFrame) -> DataFrame:
    """Partial grids added cell by cell."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("period", "row", "col").agg(*[F.sum(c).alias(c) for c in ("coarse", "fine", "n_obs")]).withColumn("total", _total())


def means(bins: DataFrame) -> DataFrame:
    return bins.where("n_obs > 0").withColumn("mean", F.col("total") / F.col("n_obs"))


class _Counted:
    """How often each rank of a block's values is within the rows that are held now; sums of runs of ranks make a rank's place quick to find."""

    RUN = 512

    def __init__(self, ranks: int):
        self.each = np.zeros((ranks // self.RUN + 1) * self.RUN, np.int64)
        self.runs = np.zeros(ranks // self.RUN + 1, np.int64)

    def change(self, ranks: np.ndarray, by: int) -> None:
        np.add.at(self.each, ranks, by)
        np.add.at(self.runs, ranks // self.RUN, by)

    def find(self, k: int) -> int:
        """The rank of the k-th value, from 0."""
        ends = np.cumsum(self.runs)
        run = int(np.searchsorted(ends, k, side="right"))
        inside = np.cumsum(self.each[run * self.RUN : (run + 1) * self.RUN])
        return run * self.RUN + int(np.searchsorted(inside, k - (int(ends[run - 1]) if run else 0), side="right"))


def slide(row: np.ndarray, value: np.ndarray, first: int, last: int, half: int = HALF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """For each row from first to last how many values lie within half rows, and their median (NaN for none)."""
    order = np.argsort(row, kind="stable")
    row, levels = row[order], np.unique(value)
    ranks = np.searchsorted(levels, value[order])
    held, count = _Counted(len(levels)), 0
    numbers, medians = np.zeros(last - first + 1, np.int64), np.full(last - first + 1, np.nan)
    low = high = 0
    for k, r in enumerate(range(first, last + 1)):
        enter, leave = np.searchsorted(row, r + half, side="right"), np.searchsorted(row, r - half)
        held.change(ranks[high:enter], 1)
        held.change(ranks[low:leave], -1)
        count += int(enter - high) - int(leave - low)
        low, high = leave, enter
        numbers[k] = count
        if count:
            a, b = (levels[held.find(at)] for at in ((count - 1) // 2, count // 2))
            medians[k] = a + (b - a) * 0.5
    return numbers, medians


def latitude_background(cells: DataFrame, rows: int, block: int = BLOCK_ROWS) -> DataFrame:
    """background of each period's row: the median of all cells within HALF_ROWS rows, if there are MIN_BACKGROUND, else of the period.

    Every row from 0 to rows - 1 has one, also those without a cell. A task has a block of a period's rows with those around
    it, and moves down by adding a row's values to counts by rank and taking another's out. Values that aren't finite don't count.
    """
    last = (rows - 1) // block
    finite = cells.where(F.abs("mean") < F.lit(float("inf"))).select("period", F.col("row").cast("long").alias("row"), "mean")
    touched = F.sequence(F.greatest(F.floor((F.col("row") - HALF_ROWS) / block), F.lit(0)), F.least(F.floor((F.col("row") + HALF_ROWS) / block), F.lit(last)))
    near = finite.where(F.col("row").between(-HALF_ROWS, rows - 1 + HALF_ROWS)).withColumn("block", F.explode(touched))
    every = cells.select("period").distinct().select("period", F.lit(None).cast("long").alias("row"), F.lit(None).cast("double").alias("mean"), F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<bigint>")).alias("block"))

    def run(key, table):
        first = key[1].as_py() * block
        end = min(first + block, rows) - 1
        known = table.filter(table["mean"].is_valid())
        n, local = slide(known["row"].to_numpy(), known["mean"].to_numpy(), first, end)
        return pa.table({"period": pa.array([key[0].as_py()] * len(n), table.schema.field("period").type), "row": pa.array(np.arange(first, end + 1)), "n": pa.array(n), "local": pa.array(local)})

    kind = cells.schema["period"].dataType.simpleString()
    local = near.unionByName(every).select("period", "block", "row", "mean").groupBy("period", "block").applyInArrow(run, f"period {kind}, row bigint, n bigint, local double")
    whole = finite.groupBy("period").agg(F.expr("percentile(mean, 0.5)").alias("whole"))
    return local.join(whole, "period", "left").select("period", "row", F.when(F.col("n") >= MIN_BACKGROUND, F.col("local")).otherwise(F.col("whole")).alias("background"))


def with_anomaly(cells: DataFrame, background: DataFrame) -> DataFrame:
    """anomaly where a cell has MIN_OBS observations, else null."""
    joined = cells.join(background, ["period", "row"])
    return joined.withColumn("anomaly", F.when(F.col("n_obs") >= MIN_OBS, F.col("mean") - F.col("background")))


def stack(cells: DataFrame, elevated: float = ELEVATED, min_months: int = MIN_MONTHS) -> DataFrame:
    """Each cell over all periods: months observed and elevated, persistence, mean and largest anomaly, mean count."""
    a = F.col("anomaly")
    out = cells.groupBy("row", "col").agg(
        F.count(a).alias("observed"), F.count_if(a >= elevated).alias("elevated"), F.avg(a).alias("mean_anomaly"), F.max(a).alias("max_anomaly"),
        F.avg(F.when(F.col("n_obs") > 0, F.col("n_obs"))).alias("mean_obs"), F.stddev_pop(a).alias("sd"),
    )
    share = F.col("elevated") / F.greatest(F.col("observed"), F.lit(1))
    return out.withColumn("persistence", F.when(F.col("observed") >= min_months, share).otherwise(0.0)).withColumn("stderr", F.col("sd") / F.sqrt(F.greatest(F.col("observed"), F.lit(1))))


def disk(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


def interior(observed: DataFrame, rows: int, cols: int, buffer: int = 3) -> DataFrame:
    """Cells of the grid farther than buffer from any that was never observed; beyond the edge counts as observed.

    observed: row and col, each once. Only never-observed cells next to an observed one can reach one, so those alone
    are dilated.
    """
    spark = observed.sparkSession
    dense = spark.range(rows * cols).select((F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col"))
    empty = dense.join(observed.select("row", "col"), ["row", "col"], "left_anti")
    shifts = lambda kernel: F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in kernel]))
    moved = lambda df, kernel: df.withColumn("d", shifts(kernel)).select((F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col")).distinct()
    ring = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    edge = empty.join(moved(observed.select("row", "col"), ring), ["row", "col"], "left_semi")
    return observed.select("row", "col").join(moved(edge, disk(buffer)), ["row", "col"], "left_anti")


def coastal_fraction(candidates: DataFrame, observed: DataFrame, rows: int, cols: int, half: int = 4) -> DataFrame:
    """Share of never-observed cells in the box around each candidate, clipped at the grid's edge."""
    offsets = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-half, half + 1) for c in range(-half, half + 1)]))
    box = candidates.select("row", "col", offsets.alias("d")).select("row", "col", (F.col("row") + F.col("d.r")).alias("r"), (F.col("col") + F.col("d.c")).alias("c"))
    box = box.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))
    seen = observed.select(F.col("row").alias("r"), F.col("col").alias("c"), F.lit(1).alias("seen"))
    return box.join(seen, ["r", "c"], "left").groupBy("row", "col").agg((1 - F.avg(F.coalesce("seen", F.lit(0)))).alias("coastal"))


def period_stats(cells: DataFrame, background: DataFrame, grid_cells: int) -> DataFrame:
    """One row a period: coverage, unweighted mean of cells, medians and totals."""
    stats = cells.groupBy("period").agg(
        (100 * F.count("*") / F.lit(grid_cells)).alias("coverage_pct"), (100 * F.count("anomaly") / F.lit(grid_cells)).alias("anomaly_coverage_pct"), F.avg("mean").alias("mean_value"), F.max("mean").alias("max_value"),
        F.max("anomaly").alias("max_anomaly"), F.expr("percentile(n_obs, 0.5)").alias("median_obs"), F.sum("n_obs").alias("obs_total"),
    )
    rows = background.groupBy("period").agg(F.expr("percentile(background, 0.5)").alias("background"))
    return stats.join(rows, "period")


def every_nth(cells: DataFrame, n: int = 37) -> DataFrame:
    """Each period's 1st, (n+1)th ... cell in row-major order."""
    order = Window.partitionBy("period").orderBy("row", "col")
    return cells.withColumn("k", F.row_number().over(order)).where((F.col("k") - 1) % n == 0).drop("k")


def climatology(stacked: DataFrame, rows: int, cols: int, min_months: int = 12, buffer: int = 4) -> DataFrame:
    """The cells of a stack that lie inside and have enough months."""
    seen = materialise(stacked.where("observed > 0"), "stacked")
    return seen.where(F.col("observed") >= min_months).join(interior(seen, rows, cols, buffer), ["row", "col"], "left_semi")


def persistent(stacked: DataFrame) -> DataFrame:
    """The cells of a stack that were elevated often enough, of those observed often enough."""
    return stacked.where((F.col("observed") >= MIN_MONTHS) & (F.col("persistence") >= PERSISTENT))


def preferred(granules: DataFrame, names: list[str]) -> DataFrame:
    """granules with value, the first of the named variables that the table has."""
    held = [n for n in names if n in granules.columns]
    if not held:
        raise ValueError("none of the variables is there")
    return granules.withColumn("value", F.col(held[0]))
