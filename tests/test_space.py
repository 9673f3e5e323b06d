"""Footprints, projections, images and scales, against brute force and published figures."""

import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.functions import utm
from emberline.operators import footprint_tiles, footprints, quantiles, render
from emberline.sources import images

RINGS = "foot_id int, rings array<array<struct<lon:double,lat:double>>>"


def inside(rings, x, y):
    odd = False
    for ring in rings or []:
        ring = [p for p in ring or [] if p and None not in p]
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True) if len(ring) > 2 else []:
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return odd


def shapes(rng):
    star = lambda x, y, n, far: [(x + far * rng.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), y + far * rng.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    box = lambda x, y, s: [(x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s)]
    out = [[star(rng.uniform(0, 3), rng.uniform(-2, 1), rng.randint(3, 12), rng.choice([0.1, 0.6, 2.0]))] for _ in range(25)]
    out += [[box(1, 0, 1), box(1, 0, 0.5)], [box(1, 0, 1), box(1, 0, 0.5), box(1, 0, 0.25)], [[*box(0, 0, 0.5), (-0.5, -0.5)]], [box(0.125, 0.125, 0.01)]]
    return out + [[[(0, 0), (1, 1)]], [[]], [], None, [None], [[(0, 0), None, (1, 0), (None, 1.0), (0, 1)]], [[(0, 0), (2, 0), (0, 0)]]]


def as_rows(all_rings):
    return [(k, None if rings is None else [None if r is None else [None if p is None else (None if p[0] is None else float(p[0]), float(p[1])) for p in r] for r in rings]) for k, rings in enumerate(all_rings)]


def test_points_in_footprints_are_those_of_ray_casting(spark):
    rng = random.Random(6)
    all_rings = shapes(rng)
    places = [(rng.uniform(-2, 5), rng.uniform(-4, 3)) for _ in range(250)] + [(0.0, 0.0), (-0.5, -0.5), (0.5, 0.5), (0.5, -0.5), (-0.5, 0.5), (1.5, 0.0), (0.5, 0.0), (0.25, 0.25), (1.0, 0.5), (None, 1.0), (1.0, None)]
    points = spark.createDataFrame([(k, *p, "edges") for k, p in enumerate(places)], "pt int, lon double, lat double, note string")
    feet = spark.createDataFrame(as_rows(all_rings), RINGS)
    want = {(k, f) for k, (x, y) in enumerate(places) if x is not None and y is not None for f, rings in enumerate(all_rings) if inside(rings, x, y)}
    for cell in (0.25, 0.9):
        got = footprints.points_in_footprints(points, feet, cell)
        rows = [(r.pt, r.foot_id) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert footprints.points_in_footprints(points, feet.limit(0)).count() == 0
    far = spark.createDataFrame([(1, 1.0, 0.75), (2, 1.0, 0.0), (3, 9.0, 9.0)], "pt int, lon double, lat double").withColumn("up", F.col("pt") != 3)
    pairs = footprints.points_in_footprints(far.select("pt", "lon", "lat"), feet.where("foot_id = 25"))
    assert {r.pt: r.overpasses for r in footprints.observations(far, pairs, "pt", F.col("up")).collect()} == {1: 1, 2: 0, 3: None}


def meets(rings, west, south, east, north):
    """By many points of the box and of the edges."""
    near = lambda a, b: [a + (b - a) * k / 40 for k in range(41)]
    if any(inside(rings, x, y) for x in near(west, east) for y in near(south, north)):
        return True
    for ring in rings or []:
        ring = [p for p in ring or [] if p and None not in p]
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True) if len(ring) > 2 else []:
            if any(west <= x1 + (x2 - x1) * k / 4000 <= east and south <= y1 + (y2 - y1) * k / 4000 <= north for k in range(4001)):
                return True
    return False


def test_boxes_meeting_footprints(spark):
    rng = random.Random(7)
    all_rings = shapes(rng)
    boxes = [(x, y, x + w, y + h) for _ in range(25) for x, y, w, h in [(rng.uniform(-1, 4), rng.uniform(-3, 2), rng.choice([0.01, 0.3]), rng.choice([0.02, 0.5]))]]
    boxes += [(0.9, -0.1, 1.1, 0.1), (-1.0, -1.0, -0.5, -0.5), (-3.0, -3.0, 6.0, 4.0), (1.0, 0.5, 1.0, 0.5)]
    df = spark.createDataFrame([(k, *b) for k, b in enumerate(boxes)], "box_id int, west double, south double, east double, north double")
    rows = [(r.box_id, r.foot_id) for r in footprints.boxes_meeting_footprints(df, spark.createDataFrame(as_rows(all_rings), RINGS)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(k, f) for k, b in enumerate(boxes) for f, rings in enumerate(all_rings) if meets(rings, *b)}


@pytest.mark.parametrize(
    "easting, northing, zone, south, lon, lat",
    [
        (500000, 4982950.4003, 33, False, 15.0, 45.0),  # the meridian's arc to 45 degrees is 4,984,944.378 m
        (500000, 10000000 - 4982950.4003, 33, True, 15.0, -45.0),
        (833978.5569, 0.0, 52, False, 132.0, 0.0),  # a zone's edge at the equator
        (166021.4431, 10000000.0, 52, True, 126.0, 0.0),
        (500000, 9997964.9430, 1, False, -177.0, 90.0),  # a quarter of the meridian is 10,001,965.729 m
    ],
)
def test_projection_of_published_points(spark, easting, northing, zone, south, lon, lat):
    args = [F.lit(float(easting)), F.lit(float(northing)), F.lit(zone), F.lit(south)]
    got = spark.range(1).select(*utm.to_degrees(*args)).first()
    assert abs(got[1] - lat) < 1e-6 and (lat == 90.0 or abs(got[0] - lon) < 1e-6)


def test_projection_goes_there_and_back(spark):
    rng = random.Random(9)
    rows = [(rng.uniform(108, 160), rng.uniform(-80, 84)) for _ in range(400)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("zone", utm.zone_of(F.col("lon")))
    east, north = utm.from_degrees(F.col("lon"), F.col("lat"), F.col("zone"))
    x, y = utm.to_degrees(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    for r in df.select("*", east.alias("e"), north.alias("n")).select("*", x.alias("x"), y.alias("y")).collect():
        assert (r.x, r.y) == (None, None) if r.lon is None else abs(r.x - r.lon) < 1e-9 and abs(r.y - r.lat) < 1e-9 and 160_000 < r.e < 840_000


def filtered(rgba, kinds, step):
    """PNG lines of an image with filters in turn."""
    height, width = rgba.shape[:2]
    lines, above = b"", [0] * (width * step)
    for y in range(height):
        raw = rgba[y].reshape(-1).astype(int).tolist()
        kind = kinds[y % len(kinds)]
        out = []
        for k, v in enumerate(raw):
            a, b, c = raw[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        lines += bytes([kind, *out])
        above = raw
    return lines


def packed(width, height, colours, raw, extra=(), bits=8, laced=0):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = zlib.compress(raw)
    return images.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colours, 0, 0, laced)) + b"".join(part(*e) for e in extra) + part(b"IDAT", body[:7]) + part(b"IDAT", body[7:]) + part(b"IEND", b"")


@pytest.mark.parametrize("colours, step", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_of_all_filters(colours, step):
    pixels = np.random.default_rng(step).integers(0, 256, (11, 7, step)).astype(np.uint8)
    got = images.read_png(packed(7, 11, colours, filtered(pixels, [0, 1, 2, 3, 4, 4, 3], step)))
    assert (got[..., :3] == pixels[..., : 3 if step > 2 else 1]).all() and (got[..., 3] == (pixels[..., -1] if step in (2, 4) else 255)).all()


def test_images_are_rewritten(spark):
    rgba = np.zeros((4, 5, 4), np.uint8)
    rgba[1, 2] = (49, 21, 66, 255)
    rgba[2, 2] = (9, 9, 9, 255)
    good = render.png(rgba)
    table = packed(2, 1, 3, bytes([0, 1, 0]), [(b"PLTE", bytes([0, 0, 0, 200, 100, 50])), (b"tRNS", bytes([7]))])
    bad = {
        "null": None, "none": b"", "other": b"GIF89a", "cut": good[:-5], "short": good[:20], "flipped": good[:-20] + b"\0" + good[-19:], "few": packed(5, 4, 6, b"\0" * 9), "laced": packed(1, 1, 0, b"\0\0", laced=1), "deep": packed(1, 1, 0, b"\0" * 3, bits=16),
        "filter": packed(1, 1, 0, b"\x09\0"), "palette": packed(1, 1, 3, b"\0\5", [(b"PLTE", b"\1\2\3")]), "huge": packed(1 << 20, 1 << 20, 0, b""),
    }
    rows = [("good", good), ("table", table), *bad.items()]
    df = spark.createDataFrame([(k, None if v is None else bytearray(v), "own") for k, v in rows], "key string, image binary, fault string")
    again = images.rewrite_images(df)
    found = {r.key: r for r in again.collect()}
    assert {k for k, r in found.items() if r.fault} == set(bad) and found["cut"].image == bytearray(good[:-5]) and found["null"].image is None
    seen = {(r.key, r.row, r.col): (r.r, r.g, r.b, r.alpha) for r in images.pixels(again, "key").where("fault is null").collect()}
    assert len(seen) == 22 and seen["good", 1, 2] == (49, 21, 66, 255) and seen["good", 2, 2] == (9, 9, 9, 89) and seen["good", 0, 0] == (0, 0, 0, 0)
    assert seen["table", 0, 0] == (200, 100, 50, 255) and seen["table", 0, 1] == (0, 0, 0, 0)
    assert images.pixels(df, "key").where("fault is not null").count() == len(bad)


def test_colours_of_odd_values_and_scales(spark):
    values = [None, math.nan, math.inf, -math.inf, 0.0, 10.0, 20.0, -5.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    for low, high in ((-20.0, 20.0), (0.0, 0.0), (5.0, 5.0)):
        for diverging in (True, False):
            rows = {r.k: (r.r, r.g, r.b, r.alpha) for r in render.colorize(df, "v", low, high, diverging).collect()}
            assert all(rows[k] == (0, 0, 0, 0) for k in range(4))
            limit = max(abs(low), abs(high)) or 1.0
            for k in range(4, 8):
                assert rows[k][3] == (int(245 * min(abs(values[k]) / limit, 1.0) ** 1.6) if diverging else 235)
    faint, strong = (render.colorize(spark.createDataFrame([(x,)], "v double"), "v", -20.0, 20.0, True).first().alpha for x in (5.0, 20.0))
    assert faint < 45 and strong > 200 and strong > 4 * faint
    ends = [(r.r, r.g, r.b) for r in render.colorize(spark.createDataFrame([(1850.0,), (1900.0,)], "v double"), "v", 1850.0, 1900.0).collect()]
    assert ends[0] != ends[1]


def test_quantiles_leave_out_what_is_not_finite(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=20_000), [1.7e308, -1.7e308, 5e-324]])
    df = spark.createDataFrame([(float(v),) for v in [*values, math.inf, -math.inf, math.nan]] + [(None,)], "v double").repartition(4)
    got = quantiles.quantiles(df, "v", [0.0, 0.02, 0.5, 0.98, 1.0])
    assert np.allclose(got, [np.quantile(values, q) if 0 < q < 1 else values.min() if q == 0 else values.max() for q in (0.0, 0.02, 0.5, 0.98, 1.0)])
    assert quantiles.quantiles(df.where("v = double('inf')"), "v", [0.5]) == [None]


def test_footprints_are_counted_as_they_are_met(spark):
    rng = random.Random(8)
    all_rings = shapes(rng)
    feet = spark.createDataFrame(as_rows(all_rings), RINGS)
    places = [(rng.uniform(-2, 5), rng.uniform(-4, 3)) for _ in range(250)] + [(0.0, 0.0), (-0.5, -0.5), (0.5, 0.5), (0.5, -0.5), (1.5, 0.0), (0.25, 0.25), (None, 1.0)]
    boxes = [(x, y, x + w, y + h) for _ in range(40) for x, y, w, h in [(rng.uniform(-1, 4), rng.uniform(-3, 2), rng.choice([0.01, 0.3]), rng.choice([0.02, 0.5]))]] + [(0.9, -0.1, 1.1, 0.1), (-1.0, -1.0, -0.5, -0.5), (1.0, 0.5, 1.0, 0.5)]
    frame = lambda rows: spark.createDataFrame([(k, *b) for k, b in enumerate(rows)], "box_id int, west double, south double, east double, north double")
    small, large = frame([(x, y, x, y) for x, y in places]), frame([*boxes, (-3.0, -3.0, 6.0, 4.0)])
    want = [{k: n for k, b in enumerate(rows) if None not in b and (n := sum(holds(rings, *b) for rings in all_rings))} for rows, holds in ((places, inside), ([*boxes, (-3.0, -3.0, 6.0, 4.0)], meets))]
    for tile in (4.0, 0.7):
        got = [{r.box_id: r.n for r in footprints.counts_in_footprints(df, feet, closed, tile).collect()} for df, closed in ((small, False), (large, True))]
        assert got == want
    assert footprints.counts_in_footprints(small, feet.limit(0), False).count() == 0


def stars(rng, n, on):
    """Footprints around places, most of them with a hole, all of whose vertices lie on a grid of step on."""
    out = []
    for _ in range(n):
        x, y, k = rng.randrange(0, 200) * on, rng.randrange(0, 200) * on, rng.randint(3, 9)
        far = [rng.randint(12, 80) * 2 for _ in range(k)]
        ways = [[(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)][m * 8 // k] for m in range(k)]
        out.append([[(x + dx * f * share * on, y + dy * f * share * on) for (dx, dy), f in zip(ways, far, strict=True)] for share in (1, 0.5)[: rng.choice([1, 2, 2])]])
    return out


def tiles(all_rings, rows, pad, closed):
    """What deal sends to one tile, counted there."""
    kind = pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))
    rings = pa.array([[[{"lon": x, "lat": y} for x, y in ring] for ring in each] for each in all_rings], kind)
    sent = pa.Table.from_batches(footprint_tiles.deal(pa.table({"part": pa.array([0] * len(all_rings)), "rings": rings}), 4.0, pad))
    mine = [a == b == 0 for a, b in zip(*(sent[c].to_pylist() for c in ("tile_x", "tile_y")), strict=True)]
    return footprint_tiles.tile_counts(footprint_tiles.received(sent.filter(pa.array(mine))), [np.array(v) for v in zip(*rows, strict=True)], (0.0, 0.0), 4.0, pad, closed)


def test_boxes_of_dense_tiles_are_counted_without_testing_whole_footprints(monkeypatch):
    rng, tested = random.Random(11), []
    all_rings = stars(rng, 120, 0.01)
    boxes = [(x, y, x + 0.06, y + 0.06) for x, y in ((rng.randrange(0, 390) * 0.01, rng.randrange(0, 390) * 0.01) for _ in range(500))]
    for name in ("_met", "_holding"):
        real = getattr(footprint_tiles, name)
        monkeypatch.setattr(footprint_tiles, name, lambda e, *args, real=real: (tested.append(len(args[-2])), real(e, *args))[1])
    got = tiles(all_rings, boxes, (0.06 + 1e-12, 0.06 + 1e-12), True)
    e = [[(*p, *q) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1], strict=True)] for rings in all_rings]

    def enters(x1, y1, x2, y2, w, s, t, n):
        sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (w, t) for y in (s, n)]
        return min(x1, x2) <= t and max(x1, x2) >= w and min(y1, y2) <= n and max(y1, y2) >= s and min(sides) <= 0 <= max(sides)

    pairs = [[inside(rings, *b[:2]) or any(enters(*x, *b) for x in edges) for rings, edges in zip(all_rings, e, strict=True)] for b in boxes]
    assert got.tolist() == [sum(p) for p in pairs] and sum(tested) < 0.25 * sum(map(sum, pairs))


def test_places_of_dense_tiles_are_counted_without_testing_whole_footprints(monkeypatch):
    rng, tested = random.Random(12), []
    all_rings = stars(rng, 150, 0.01)
    # Places on vertices and edges too, where crossings are rounded; some twice.
    places = [(rng.randrange(0, 399) * 0.01, rng.randrange(0, 399) * 0.01) for _ in range(500)] + [v for rings in all_rings[:60] for v in rings[0] if 0 <= min(v) and max(v) < 4]
    places += places[:50]
    for name in ("_met", "_holding"):
        real = getattr(footprint_tiles, name)
        monkeypatch.setattr(footprint_tiles, name, lambda e, *args, real=real: (tested.append(len(args[-2])), real(e, *args))[1])
    pairs = [[inside(rings, *p) for rings in all_rings] for p in places]
    assert tiles(all_rings, [(*p, *p) for p in places], (0.0, 0.0), False).tolist() == [sum(p) for p in pairs] and sum(tested) < 0.25 * sum(map(sum, pairs))


def test_footprints_whose_edges_meet_are_told_from_others():
    box = lambda x, y, s: [(x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s)]
    plain = [[box(0, 0, 1)], [box(0, 0, 1), box(0, 0, 0.5)], [box(0, 0, 1)[::-1], box(5, 0, 1)], [[(0, 0), (0, 0), (2, 0), (2, 2), (0, 0)]]]
    other = [[[(0, 0), (1, 1), (1, 0), (0, 1)]], [box(0, 0, 1), box(1, 0, 1)], [box(0, 0, 1), box(0, 0, 1)], [[(0, 0), (2, 0), (1, 0)]], [[(1, 1)] * 3], [box(0, 0, 1), [(1, 0), (2, 1), (2, -1)]]]
    kind = pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))
    for shape, want in [(p, True) for p in plain] + [(p, False) for p in other]:
        x, y, sizes, row = footprint_tiles._rings(pa.array([[[{"lon": a, "lat": b} for a, b in ring] for ring in shape]], kind))
        left, got = footprint_tiles._inside(x, y, sizes, np.array([len(sizes)]))
        assert got[0] == want
        if want:
            assert left.tolist() == ([True], [True, False], [False, True], [True])[plain.index(shape)]
