"""Registered queries on intervals, exact sums and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.operators import greedy, grid, intervals, pyramid
from emberline.plans import views
from emberline.plans.queries import CER, _anomalies, _score_pairs, query, r
from emberline.plans.views import GRID_COLS, GRID_ROWS, VERDICTS
from emberline.sources.shared import materialise, read_table

DAY = "date_diff('day', DATE '1992-01-01', {})"
SPANS = f"""WITH l AS (SELECT o_orderkey AS id, {DAY.format('o_orderdate::DATE')} AS s, {DAY.format('o_orderdate::DATE')} + o_orderkey % 45 AS e FROM orders),
    w AS (SELECT s_suppkey AS period, s_suppkey * 977 % 2400 AS s, s_suppkey * 977 % 2400 + s_suppkey * 13 % 97 - 1 AS e FROM supplier)"""


@query("", SPANS + " SELECT period, count(*) AS n, sum(least(l.e, w.e) - greatest(l.s, w.s))::BIGINT AS shared_days FROM l JOIN w ON l.s < w.e AND w.s < l.e AND l.s < l.e AND w.s < w.e GROUP BY period")
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Granules of odd lengths, some of none, against overlapping periods of odd lengths."""
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    left = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day.alias("start"), (day + F.col("o_orderkey") % 45).alias("end"))
    begin = F.col("s_suppkey") * 977 % 2400
    right = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("period"), begin.alias("r_start"), (begin + F.col("s_suppkey") * 13 % 97 - 1).alias("r_end"))
    # A period's rows are added up, as in the SQL, should its number be given twice.
    return intervals.overlap_totals(left, right).groupBy("period").agg(F.sum("n").alias("n"), F.sum("shared").cast("long").alias("shared_days"))


#: Overviews for tiles of 8 cells: the grid of 20 by 30, then 10 by 15, then 5 by 8.
LEVELS = """+ l0 AS (SELECT period, row, col, mean AS v, anomaly AS a FROM anom), l1 AS (SELECT period, row >> 1 AS row, col >> 1 AS col, avg(v) AS v, avg(a) AS a FROM l0 GROUP BY ALL),
    l2 AS (SELECT period, row >> 1 AS row, col >> 1 AS col, avg(v) AS v, avg(a) AS a FROM l1 GROUP BY ALL), every AS (SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2)"""


@query("anom", LEVELS + " SELECT period, level, row // 8 AS tile_row, col // 8 AS tile_col, row, col, round_even(v, 4) AS mean, round_even(a, 4) AS anomaly FROM every")
def composite_overviews(spark: SparkSession, d: str) -> DataFrame:
    """Each period's composite and its overviews by level and tile, as means of what is there."""
    cells = materialise(_anomalies(spark, d).select("period", "row", "col", "mean", "anomaly"), "cells")
    return pyramid.pyramid(cells, GRID_ROWS, GRID_COLS, ["period"], ["mean", "anomaly"], 8).select("period", "level", "tile_row", "tile_col", "row", "col", r("mean"), r("anomaly"))


#: A value in units of 2**-51, exact from 1 on.
UNITS = "floor(value * 1048576)::HUGEINT * 2147483648 + floor((value * 1048576 - floor(value * 1048576)) * 2147483648)::HUGEINT"


@query("usable", f"""+ x AS (SELECT period, least(greatest(trunc((1 - lat) / 0.05)::BIGINT, 0), 919) AS row, least(greatest(trunc((lon - 108) / 0.05)::BIGINT, 0), 1039) AS col, sum({UNITS}) AS units, count(*) AS n_obs FROM usable GROUP BY ALL)
    SELECT period, row, col, n_obs, (units // 2147483648)::BIGINT AS whole, (units % 2147483648)::BIGINT AS rest FROM x""")  # fmt: skip
def exact_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums of batches merged without rounding, as whole units of 2**-20 and what is over in units of 2**-51."""
    s = grid.usable(views.soundings(spark, d))
    merged = grid.merge_bins(*[grid.bin_soundings(s.where(F.col("surface") % 8 == k)) for k in range(0, 8, 2)])
    fine = int(grid.FINE)
    return merged.select("period", "row", "col", "n_obs", (F.col("coarse") + F.floor(F.col("fine") / fine)).alias("whole"), (F.col("fine") % fine).alias("rest"))


@query("stack", """+ spot AS (SELECT row, col, mean_anomaly, 108 + (col + 0.5) * 5e-2 AS lon, 1 - (row + 0.5) * 5e-2 AS lat FROM stack WHERE observed > 0),
    nd AS (SELECT *, row_number() OVER (ORDER BY mean_anomaly DESC, row, col) AS id FROM spot),
    ed AS MATERIALIZED (SELECT a.id AS before, b.id AS after FROM nd a JOIN nd b ON a.id < b.id AND abs(round_even(a.lon, 3) - b.lon) < 0.12 AND abs(round_even(a.lat, 3) - b.lat) < 0.12), """ + VERDICTS + " SELECT row, col, round_even(mean_anomaly, 4) AS mean_anomaly FROM nd JOIN vd USING (id) WHERE kept")  # fmt: skip
def anomaly_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Of all observed cells, not the persistent ones alone, the strongest of each small neighbourhood."""
    stack = grid.stack(_anomalies(spark, d)).where("observed > 0")
    cells = stack.withColumn("lon", geo.cell_lon(F.col("col"))).withColumn("lat", geo.cell_lat(F.col("row")))
    return greedy.cluster_hotspots(materialise(cells, "cells"), 0.12).select("row", "col", r("mean_anomaly"))


#: A score from which on a pair is accepted when a reviewer is stricter.
STRICT = 1.4


@query("fac", CER.replace("WHERE score >= 0.95", f"WHERE score >= {STRICT}") + f"SELECT a, b, round_even(score, 4) AS score FROM pairs WHERE score < {STRICT} AND a NOT IN (SELECT a FROM accepted) AND b NOT IN (SELECT b FROM accepted)")
def strict_review(spark: SparkSession, d: str) -> DataFrame:
    """What is left to review when only the surest pairs are accepted."""
    pairs = _score_pairs(spark, d)
    accepted = greedy.match_one_to_one(pairs.where(F.col("score") >= STRICT))
    return greedy.review_pairs(pairs, accepted, high=STRICT).select("a", "b", r("score"))
