"""Exact sums, sliding medians, intervals, overviews and clusters over tiles, against brute force."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import components, greedy, grid, intervals, pyramid


def test_sums_have_the_same_bits_in_any_parts(spark):
    rng = random.Random(1)
    values = [rng.uniform(1, 2100) * rng.choice([1, -1]) for _ in range(4000)] + [1e8 + 1 / 3] * 50 + [0.0, -0.0]
    rows = [("p", 110.01, -20.01 - 0.05 * (k % 3), v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "period string, lon double, lat double, value double")
    found = set()
    for parts in (1, 4, 64):
        spread = df.orderBy(F.rand(parts)).repartition(parts)
        for batches in (1, 3):
            merged = grid.merge_bins(*[grid.bin_soundings(spread.where(F.pmod(F.xxhash64("value"), F.lit(batches)) == b)) for b in range(batches)])
            found.add(tuple(sorted((r.row, r.col, r.n_obs, r.coarse, r.fine, r.total.hex()) for r in merged.collect())))
    assert len(found) == 1
    for k, (row, _, n, _, _, total) in enumerate(next(iter(found))):
        exact = sum((Fraction(v) for j, v in enumerate(values) if j % 3 == k), Fraction(0))
        assert n == sum(j % 3 == k for j in range(len(values))) and abs(Fraction(float.fromhex(total)) - exact) <= abs(exact) * Fraction(1, 2**51)
    with pytest.raises(Exception, match="too large"):
        grid.bin_soundings(spark.createDataFrame([("p", 110.0, -20.0, 1e12)], "period string, lon double, lat double, value double")).collect()


@pytest.mark.parametrize("block", [7, 60, 400])
def test_background_is_the_sliding_median_in_any_blocks(spark, block):
    rng = random.Random(block)
    cells = [(p, r, c, rng.choice([rng.uniform(0, 9), float(rng.randrange(3))])) for p in ("a", "b") for r in range(130) for c in range(rng.choice([0, 0, 2, 9])) if not (p == "b" and 30 < r < 100)]
    cells += [("c", 3, 0, 5.0), ("d", 1, 0, math.nan), ("d", 2, 0, math.inf), ("d", 9, 0, None)]
    df = spark.createDataFrame(cells, "period string, row int, col int, mean double")
    got = {(r.period, r.row): r.background for r in grid.latitude_background(df, 130, block).collect()}
    assert set(got) == {(p, r) for p in "abcd" for r in range(130)}
    for (p, r), found in got.items():
        own = [(x[1], x[3]) for x in cells if x[0] == p and x[3] is not None and math.isfinite(x[3])]
        near = [v for row, v in own if abs(row - r) <= 20]
        want = np.median(near) if len(near) >= 50 else np.median([v for _, v in own]) if own else None
        assert found is None if want is None else math.isclose(found, want)
    assert grid.latitude_background(df.limit(0), 130, block).count() == 0


def test_a_dyadic_cover_is_the_interval(spark):
    rng = random.Random(2)
    spans = [(a, b) for a in range(-9, 10) for b in range(-9, 10)] + [(x := rng.randrange(-(10**15), 10**15), x + rng.randrange(10**9)) for _ in range(50)] + [(None, 3), (3, None)]
    df = spark.createDataFrame(spans, "start long, end long")
    for r in df.select("start", "end", intervals.dyadic_cover(F.col("start"), F.col("end")).alias("c")).collect():
        parts = sorted((n["at"] << n["level"], (n["at"] + 1) << n["level"]) for n in r.c)
        if None in (r.start, r.end) or r.start >= r.end:
            assert not parts
        else:
            assert (parts[0][0], parts[-1][1]) == (r.start, r.end) and all(a[1] == b[0] for a, b in itertools.pairwise(parts)) and len(parts) <= 2 * (r.end - r.start).bit_length()


def test_overlaps_are_those_of_every_pair(spark):
    rng = random.Random(3)
    some = lambda n: [(k, *rng.choice([(s := rng.randrange(-50, 50), s + rng.choice([0, 1, 2, 7, 64, 90])), (None, 4), (4, None), (5, 2), (0, 64)])) for k in range(n)]
    a, b = some(80), some(80)
    left, right = spark.createDataFrame(a, "x int, start long, end long"), spark.createDataFrame(b, "y int, r_start long, r_end long")
    real = lambda s, e: s is not None and e is not None and s < e
    want = sorted((x, y) for (x, s, e), (y, t, f) in itertools.product(a, b) if real(s, e) and real(t, f) and s < f and t < e)
    assert sorted((r.x, r.y) for r in intervals.overlapping(left, right).collect()) == want
    assert intervals.overlapping(left.limit(0), right).count() == 0



def test_totals_of_overlaps_are_those_of_every_pair(spark):
    rng = random.Random(4)
    some = lambda n: [(k, *rng.choice([(s := rng.randrange(-50, 50), s + rng.choice([0, 1, 2, 7, 64, 90])), (None, 4), (4, None), (5, 2), (0, 64), (-(10**15), 10**15)])) for k in range(n)]
    a, b = some(80), [*some(80), (3, 0, 64), (99, 2 * 10**15, 3 * 10**15)]
    left, right = spark.createDataFrame(a, "x int, start long, end long"), spark.createDataFrame(b, "y int, r_start long, r_end long")
    real = lambda s, e: s is not None and e is not None and s < e
    met = [(y, t, f, [min(e, f) - max(s, t) for _, s, e in a if real(s, e) and s < f and t < e]) for y, t, f in b if real(t, f)]
    totals = intervals.overlap_totals(left, right)
    assert sorted((r.y, r.r_start, r.r_end, r.n, int(r.shared)) for r in totals.collect()) == sorted((y, t, f, len(x), sum(x)) for y, t, f, x in met if x)
    assert intervals.overlap_totals(left.limit(0), right).count() == 0


def test_overviews_are_means_of_what_is_there(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.uniform(0, 9, (11, 21))
    base[rng.random(base.shape) < 0.4] = np.nan
    cells = [("p", r, c, None if r == 2 else float(base[r, c])) for r in range(11) for c in range(21) if c != 5]
    base[2], base[:, 5] = np.nan, np.nan
    levels = pyramid.pyramid(spark.createDataFrame(cells, "period string, row int, col int, v double"), 11, 21, ["period"], ["v"], 4)
    pyramid.write_pyramid(levels, str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).collect()
    assert {r.level for r in rows} == {0, 1, 2, 3} and all((r.tile_row, r.tile_col) == (r.row // 4, r.col // 4) for r in rows)
    now = base
    for level in range(4):
        got = np.full(now.shape, np.nan)
        for r in rows:
            if r.level == level:
                got[r.row, r.col] = math.nan if r.v is None else r.v
        assert np.allclose(got, now, equal_nan=True)
        padded = np.full(((now.shape[0] + 1) // 2 * 2, (now.shape[1] + 1) // 2 * 2), np.nan)
        padded[: now.shape[0], : now.shape[1]] = now
        with np.errstate(all="ignore"):
            four = padded.reshape(padded.shape[0] // 2, 2, -1, 2).transpose(0, 2, 1, 3).reshape(padded.shape[0] // 2, -1, 4)
            count = (~np.isnan(four)).sum(axis=2)
            now = np.where(count > 0, np.nansum(four, axis=2) / np.maximum(count, 1), np.nan)


def test_names_that_mean_the_same(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 530)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(7, 7)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.name: r.least for r in components.merged_names(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in p and p[0] != p[1] for p in pairs)}


@pytest.mark.parametrize("tile", [1, 3, 512])
def test_clusters_don_t_depend_on_tiles(spark, tile):
    rng = random.Random(6)
    dots = {(r, c) for r in range(25) for c in range(25) if rng.random() < 0.3}
    snake = {(r, c) for r in range(0, 25, 2) for c in range(25)} | {(r, 24 if r % 4 == 1 else 0) for r in range(1, 25, 2)}
    want = {}
    for scene, pixels in enumerate((dots, snake)):
        left = set(pixels)
        while left:
            todo = [min(left)]
            left.discard(todo[0])
            for p in todo:
                near = {(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            if len(todo) >= 3:
                want |= {(scene, *p): todo[0][0] << 20 | todo[0][1] for p in todo}
    rows = [("s", scene, *p, "own") for scene, pixels in enumerate((dots, snake)) for p in pixels]
    got = greedy.label_clusters(spark.createDataFrame(rows, "site string, scene int, row int, col int, label string"), 3, tile).collect()
    assert {(r.scene, r.row, r.col): r.cluster for r in got} == want and len(got) == len(want)
