"""Operators against brute force, on small rows made here."""

import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions import labels
from emberline.operators import facilities, greedy, grid, imagestack, layers, matching, quantiles, render, spatial


def km(a, b):
    return math.hypot((a[0] - b[0]) * 111.32 * math.cos(math.radians((a[1] + b[1]) / 2)), (a[1] - b[1]) * 110.57)


def test_radius_join_is_the_cross_join(spark):
    rng = random.Random(1)
    near = lambda lat: [(110 + rng.random() * 0.5, lat + rng.random() * 0.5) for _ in range(60)] + [(110.2, lat + 0.2), (None, lat)]
    left, right = near(-45.0) + near(0.4), near(-45.0) + near(0.4)
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(left)], "i int, lon double, lat double")
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(right)], "j int, r_lon double, r_lat double")
    for radius in (0.5, 10.0, 60.0):
        want = {(i, j) for (i, p), (j, q) in itertools.product(enumerate(left), enumerate(right)) if None not in p + q and km(p, q) <= radius}
        assert {(r.i, r.j) for r in spatial.radius_join(a, b, radius).collect()} == want


def test_nearest_features_at_any_distance(spark):
    rng = random.Random(2)
    points, places = [(rng.uniform(108, 160), rng.uniform(-45, 1)) for _ in range(20)], [(rng.uniform(108, 160), rng.uniform(-45, 1)) for _ in range(25)]
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "point_id int, lon double, lat double")
    b = spark.createDataFrame([(*p, f"n{i}", "l", 0, i, 0) for i, p in enumerate(places)], "r_lon double, r_lat double, name string, layer string, layer_ord int, feature_ord int, vertex_ord int")
    rows = spatial.nearest_features(a, b).collect()
    want = {(i, k + 1, f"n{j}") for i, p in enumerate(points) for k, j in enumerate(sorted(range(25), key=lambda j: km(p, places[j]))[:3])}
    assert {(r.point_id, r["rank"], r.name) for r in rows} == want
    assert spatial.nearest_features(a, b.limit(2)).groupBy("point_id").count().where("count = 2").count() == 20


def test_dedupe_is_the_greedy_pass(spark):
    rng = random.Random(3)
    rows = [(f"p{i:03d}", rng.choice("ab"), rng.randrange(3), rng.choice(["d1", "d2", None]), 110 + rng.randrange(60) / 1000, -20 + rng.randrange(60) / 1000) for i in range(150)]
    kept, by = [], {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = next((k for k in kept if k[3] == r[3] and abs(k[4] - r[4]) <= 0.02 and abs(k[5] - r[5]) <= 0.02 and km(k[4:], r[4:]) <= 1), None)
        by[r[0]] = hit[0] if hit else None
        kept += [] if hit else [r]
    df = spark.createDataFrame(rows, "plume_id string, provider string, priority int, day string, lon double, lat double")
    for shuffled in (df, df.orderBy(F.rand(5))):
        assert {r.plume_id: r.absorbed_by for r in greedy.dedupe_events(shuffled).collect()} == by


def test_hotspots_recurring_and_matches(spark):
    rng = random.Random(4)
    cells = [(r, c, 110 + c * 0.05 + 0.025, -20 - r * 0.05, float(rng.randrange(40))) for r in range(20) for c in range(20) if rng.random() < 0.3]
    kept = []
    for x in sorted(cells, key=lambda x: (-x[4], x[0], x[1])):
        if not any(abs(round(k[2], 3) - x[2]) < 0.35 and abs(round(k[3], 3) - x[3]) < 0.35 for k in kept):
            kept.append(x)
    df = spark.createDataFrame(cells, "row int, col int, lon double, lat double, mean_anomaly double")
    assert {(r.row, r.col) for r in greedy.cluster_hotspots(df).collect()} == {x[:2] for x in kept}

    found = [(rng.choice("ab"), i, f"d{rng.randrange(3)}", 110 + rng.randrange(12) / 1000, -20 + rng.randrange(12) / 1000) for i in range(60)]
    groups = []
    for x in found:
        near = lambda a, x=x: a[0] == x[0] and math.hypot((a[3] - x[3]) * 111.32 * math.cos(math.radians(x[4])), (a[4] - x[4]) * 110.57) < 0.25
        home = next((g for g in groups if near(g[0])), None)
        home.append(x) if home else groups.append([x])
    want = {x[1] for g in groups if len({m[2] for m in g}) == 1 for x in g}
    df = spark.createDataFrame(found, "site string, ord int, date string, lon double, lat double")
    assert {r.ord for r in greedy.drop_recurring(df).collect()} == want

    pairs = [(a, b, rng.randrange(6) / 5, a, b) for a in range(12) for b in range(12) if rng.random() < 0.5]
    left, right, accepted = set(), set(), set()
    for a, b, s, *_ in sorted(pairs, key=lambda p: (-p[2], p[3], p[4])):
        if a not in left and b not in right:
            accepted.add((a, b))
            left.add(a)
            right.add(b)
    df = spark.createDataFrame(pairs, "a int, b int, score double, a_ord int, b_ord int")
    assert {(r.a, r.b) for r in greedy.match_one_to_one(df).collect()} == accepted
    assert greedy.match_one_to_one(df.limit(0)).count() == 0


def test_clusters(spark):
    rng = random.Random(6)
    pixels = [("s", k, r, c) for k in (1, 2) for r in range(25) for c in range(25) if rng.random() < 0.35]
    rows = greedy.label_clusters(spark.createDataFrame(pixels, "site string, scene int, row int, col int"), 4).collect()
    want = set()
    for k in (1, 2):
        left = {(r, c) for s, q, r, c in pixels if q == k}
        while left:
            todo = [min(left)]
            own = set(todo)
            while todo:
                r, c = todo.pop()
                more = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left - own
                own |= more
                todo += more
            left -= own
            if len(own) >= 4:
                want.add((k, frozenset(own)))
    found = {}
    for r in rows:
        found.setdefault((r.scene, r.cluster), set()).add((r.row, r.col))
    assert {(k[0], frozenset(v)) for k, v in found.items()} == want


def test_interior_and_coast(spark):
    rng = random.Random(7)
    seen = {(r, c) for r in range(30) for c in range(30) if rng.random() > 0.02}
    df = spark.createDataFrame(sorted(seen), "row long, col long")
    gone = {(r, c) for r in range(30) for c in range(30)} - seen
    want = {x for x in seen if not any((x[0] - g[0]) ** 2 + (x[1] - g[1]) ** 2 <= 9 for g in gone)}
    assert {tuple(r) for r in grid.interior(df, 30, 30).collect()} == want
    rate = {(r.row, r.col): r.coastal for r in grid.coastal_fraction(df.limit(50), df, 30, 30).collect()}
    for (a, b), v in rate.items():
        box = [(r, c) for r in range(max(0, a - 4), min(29, a + 4) + 1) for c in range(max(0, b - 4), min(29, b + 4) + 1)]
        assert abs(v - sum(x in gone for x in box) / len(box)) < 1e-9


def test_scores_and_words(spark):
    words = lambda *names: [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(matching.tokens(F.col("n"))).collect()]
    assert words("APN01 Moranbah North (stage 2) Coal Mine", "No 3 Mine", None) == [["moranbah", "north"], [], None]
    f = spark.createDataFrame([("a", 1, ["moranbah"], "qld", "gas_plants"), ("b", 2, ["moranbah"], "QLD", "coal_mines"), ("c", 3, ["moranbah"], None, "pipelines_gas")], "a string, a_ord int, a_tokens array<string>, a_state string, layer string")
    c = spark.createDataFrame([("x", 1, ["moranbah", "mill"], "Qld", "Coal Mining"), ("y", 2, ["other"], "QLD", None)], "b string, b_ord int, b_tokens array<string>, b_state string, industry string")
    assert {(r.a, r.b): round(r.score, 2) for r in matching.score_pairs(f, c).collect()} == {("b", "x"): 1.45, ("c", "x"): 1.0}


def test_first_run_is_silent_and_regressions(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "plume_id string")
    assert facilities.new_ids(ids, ids.limit(0)).count() == 0 and facilities.new_ids(ids, ids.where("plume_id = 'a'")).count() == 1
    n = lambda rows: spark.createDataFrame(rows, "provider string, n int")
    assert [r.provider for r in facilities.regressions(n([("a", 3), ("b", 0), ("c", 1)]), n([("a", 0), ("b", 0)])).orderBy("provider").collect()] == ["a", "c"]


def test_labels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(labels.iso_week_label(F.lit("2027-01-01").cast("date"))) == "2026-W53"
    assert one(labels.reported_kg_hr(F.lit(2245885.0))) == 9156 and one(labels.wind_toward(F.lit(179.6))) == 360
    assert one(labels.compass(F.lit(350.0))) == "N" and one(labels.html_escape(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert [one(labels.reported_number(F.lit(x))) for x in ("1,234", "-", "–", "$5", "x", " N/A ")] == [1234.0, None, None, 5.0, None, None]
    assert one(labels.token_expiry(F.lit("x.eyJleHAiOiAxNzAwMDAwMDAwfQ.y"))) == 1700000000 and one(labels.token_expiry(F.lit("bad"))) is None
    assert one(labels.iso_date(F.lit("20260102"))) == "2026-01-02" and one(labels.config_value(F.lit(' " " '))) is None and one(labels.config_value(F.lit(" 'a b' "))) == "a b"
    for n, o, want in ((1, None, "emitting"), (0, None, "unknown"), (0, 0, "blind spot"), (0, 10, "watched, no plume"), (0, 9, "under-observed")):
        assert one(labels.watch_status(F.lit(n), F.lit(o).cast("int"))) == want
    assert [one(labels.expiry_note(F.lit(e), F.lit(1000))) for e in (999, 1000 + 86400 * 7, 1000 + 86400 * 8)] == ["expired", "expires in 7 d", "valid 8 d"]
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    assert [one(labels.days_ago(F.lit(t), now)) for t in ("2024-01-31T12:00:01Z", "2024-01-31T12:00:00Z", "x")] == [0, 1, None]
    assert one(labels.image_corners(F.array(*map(F.lit, (1, 2, 3, 4))))) == [[1, 4], [3, 4], [3, 2], [1, 2]]
    day = lambda x: F.lit(x).cast("date")
    assert [tuple(map(str, p)) for p in one(labels.month_periods(day("2024-01-15"), day("2024-03-02")))] == [("2024-01", "2024-01-01", "2024-02-01"), ("2024-02", "2024-02-01", "2024-03-01"), ("2024-03", "2024-03-01", "2024-03-02")]
    assert [tuple(map(str, p)) for p in one(labels.week_periods(day("2026-12-30"), day("2027-01-05")))] == [("2026-W53", "2026-12-28", "2027-01-04"), ("2027-W01", "2027-01-04", "2027-01-05")]
    assert one(imagestack.tile_code(F.lit("S2A_T5AB_T55HBU_TX1ABC"))) == "T55HBU" and one(imagestack.tile_code(F.lit("a_b"))) is None


def test_leave_one_out(spark):
    rng = random.Random(8)
    rows = [("s", r, 0, k, None if rng.random() < 0.3 else rng.random()) for r in range(6) for k in range(7)]
    df = spark.createDataFrame(rows, "site string, row int, col int, scene int, ratio double")
    for x in imagestack.leave_one_out(df).collect():
        others = [v for _, r, _, k, v in rows if r == x.row and k != x.scene and v is not None]
        assert x.n_ref == len(others) and (x.reference is None if not others else abs(x.reference - np.median(others)) < 1e-12)
        assert (x.change is None) == (len(others) < 3 or x.ratio is None)


def test_leave_one_out_gathers_no_scenes(spark, capsys):
    rng = random.Random(11)
    rows = [(rng.choice(["s", "t", None]), 0, rng.randrange(3), rng.choice([None, *range(6)]), rng.choice([None, 1.0, rng.random()])) for _ in range(200)]
    rows += [("hot", 0, 0, k, rng.random()) for k in range(20_001)] + [("one", 0, 0, 1, 2.0), ("two", 0, 0, 1, None), ("two", 0, 0, 2, 3.0)]
    df = spark.createDataFrame(rows, "site string, row int, col int, scene int, ratio double")
    out = imagestack.leave_one_out(df)
    found = out.collect()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(x)[:5]) for x in found)
    for x in found[:: len(found) // 300] + [x for x in found if x.site != "hot"]:
        others = [v for s, _, c, k, v in rows if (s, c) == (x.site, x.col) and None not in (k, x.scene, v) and k != x.scene]
        assert x.n_ref == len(others) and (x.reference is None if not others else abs(x.reference - np.median(others)) < 1e-12)
    out.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_history_takes_the_upper_median(spark):
    rng = random.Random(13)
    rows = [("p", str(i), rng.choice("ab"), "l", rng.choice([None, 0.0, 1.0, 2.0, 3.5, 7.0]), None, "t") for i in range(60)]
    plumes = spark.createDataFrame(rows, "plume_id string, k string, facility_name string, facility_layer string, rate double, facility_km double, datetime_utc string").withColumn("provider", F.lit("x"))
    fac = spark.createDataFrame([(x, "l") for x in "abc"], "name string, layer string")
    for x in facilities.history(fac, plumes).collect():
        rates = sorted(r[4] for r in rows if r[2] == x.name and r[4])
        assert x.median_rate == (rates[len(rates) // 2] if rates else None) and x.detections == sum(r[2] == x.name for r in rows)


def test_latitude_background(spark):
    rng = random.Random(14)
    cells = [("p", r, c, rng.random()) for r in range(60) for c in range(4) if rng.random() < 0.5 and r not in (7, 8)] + [("q", 3, 0, 1.0), ("q", 50, 0, 2.0)]
    rows = {(x.period, x.row): x.background for x in grid.latitude_background(spark.createDataFrame(cells, "period string, row long, col long, mean double"), 60).collect()}
    for p, r in [(p, r) for p in "pq" for r in range(60)]:
        near = [v for q, y, _, v in cells if q == p and abs(y - r) <= 20]
        assert abs(rows[p, r] - np.median(near if len(near) >= 50 else [v for q, *_, v in cells if q == p])) < 1e-12


@pytest.mark.parametrize("limit", [5, 10_000])
def test_quantiles(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "VALUES", limit)
    rng = random.Random(15)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [1e9, -1e9] + [0.25] * 2000
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    shares = [0.0, 0.02, 0.5, 0.98, 0.99, 1.0]
    assert np.allclose(quantiles.quantiles(df, "v", shares), np.quantile(values, shares), atol=1e-12)
    assert quantiles.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_a_dense_spot_makes_no_pairs(spark):
    rng = random.Random(16)
    rows = [(i, "p", 0, "d", 110 + rng.random() / 1000, -20 + rng.random() / 1000) for i in range(20_000)]
    df = spark.createDataFrame(rows, "plume_id long, provider string, priority int, day string, lon double, lat double")
    assert greedy.dedupe_events(df).where("absorbed_by = 0").count() == 19_999


def test_sites_in_images(spark):
    pixels = spark.createDataFrame([("g", r, c, float(r * 10 + c)) for r in range(10) for c in range(10)], "granule string, row int, col int, enh double")
    sites = spark.createDataFrame([("g", "in", 5, 5, 10, 10), ("g", "edge", 0, 9, 10, 10), ("g", "out", 10, 5, 10, 10)], "granule string, site string, row int, col int, height int, width int")
    n = {r.site: r["count"] for r in imagestack.sample(pixels, sites, ["granule"], "enh", 2, 55.0).groupBy("site").count().collect()}
    assert n == {"in": 16} and imagestack.sample(pixels, sites, ["granule"], "enh", 2, 55.0).where("enh IS NULL").count() == 1
    wide = {r.site: (r.valid, r.observed, r.excess_sigma is None) for r in imagestack.overpasses(pixels, sites, 4, 101).collect()}
    assert wide == {"in": (1.0, True, True), "edge": (1.0, True, True)}
    scenes = spark.createDataFrame([("A_T55HBU_x", "/eodata/k", "2024-01-01T00:00:00.000Z", [("cloudCover", "5"), ("cloudCover", "7.5")]), ("A", None, None, None)], "Name string, S3Path string, Start string, Attributes array<struct<Name string, Value string>>")
    assert [tuple(r) for r in imagestack.scene_metadata(scenes).collect()] == [("A_T55HBU_x", "k", "2024-01-01T00:00:00", 7.5, "T55HBU"), ("A", "", "", None, None)]


def test_routes_and_run_guard(spark):
    line = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in p])
    north = lambda *p: spark.range(1).select(layers.northern(line(*p))).first()[0]
    assert north((141, -5)) and not north((140, -5)) and not north((141, -11)) and not north((170, -5)) and north((110, -40), (141, -5))
    n = lambda rows: spark.createDataFrame(rows, "provider string, n int")
    facilities.guard_regressions(n([("a", 1)]), n([("a", 2)]))
    with pytest.raises(ValueError, match="a"):
        facilities.guard_regressions(n([("a", 1)]), n([]))


def test_colours_at_the_ends(spark):
    cells = spark.createDataFrame([("p", 0, 0, 1850.0), ("p", 0, 1, 1900.0), ("p", 1, 0, float("nan")), ("p", 1, 1, 5000.0)], "period string, row int, col int, v double")
    seen = {(r.row, r.col): (r.r, r.g, r.b, r.alpha) for r in render.colorize(cells, "v", 1850.0, 1900.0).collect()}
    assert seen == {(0, 0): (0, 0, 4, 235), (0, 1): (252, 253, 191, 235), (1, 0): (0, 0, 0, 0), (1, 1): (252, 253, 191, 235)}
    zero = render.colorize(cells.withColumn("v", F.lit(0.0)), "v", -20.0, 20.0, True).first()
    assert (zero.r, zero.g, zero.b, zero.alpha) == (247, 247, 247, 0)


def test_images(spark):
    cells = spark.createDataFrame([("p", 0, 0, -1.0), ("p", 0, 1, 0.25), ("p", 1, 0, 1.0), ("p", 1, 1, None)], "period string, row int, col int, v double")
    colored = {(r.row, r.col): (r.r, r.g, r.b, r.alpha) for r in render.colorize(cells, "v", -1.0, 1.0, True).collect()}
    assert colored[0, 0] == (33, 102, 172, 245) and colored[0, 1][3] == 26 and colored[1, 0][3] == 245 and colored[1, 1] == (0, 0, 0, 0)
    data = render.images(render.colorize(cells, "v", -1.0, 1.0, True), 2, 2).first().image
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and np.frombuffer(raw, np.uint8).reshape(2, 9)[:, 1:].reshape(2, 2, 4)[0, 0].tolist() == [33, 102, 172, 245]


@pytest.mark.parametrize("edge", ["qa", "lon", "nan"])
def test_soundings_at_edges(spark, edge):
    rows = {"qa": [(108.0, -45.0, 0.5, 0, 1.0), (108.0, -45.0, 0.49, 0, 1.0)], "lon": [(108.0, 0.0, 1.0, 2, 1.0), (160.0, 0.0, 1.0, 0, 1.0), (109.0, 1.0, 1.0, 0, 1.0)], "nan": [(109.0, 0.0, 1.0, 0, 1.0), (109.0, 0.0, 1.0, 0, float("nan")), (109.0, 0.0, None, 0, 1.0), (109.0, 0.0, 1.0, 1, 1.0)]}[edge]
    assert grid.usable(spark.createDataFrame(rows, "lon double, lat double, qa double, surface int, value double")).count() == 1


def test_names_meet_by_rare_words(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(40)] + ["hot"] * 12 + ["abc"] * 3
    name = lambda: sorted(set(rng.choices(words, k=rng.randint(0, 6))))
    states, layers_, trades = ["QLD", "qld", "NSW", "", None], ["coal_mines", "gas_plants", "pipelines_gas"], ["Coal mining", "Gas supply", "Coal seam gas", "other", None, "Electricity"]
    left = [(f"a{k}", k, name(), rng.choice(states), rng.choice(layers_)) for k in range(150)]
    right = [(f"b{k}", k, name(), rng.choice(states), rng.choice(trades)) for k in range(150)]
    right += [right[0][:2] + right[1][2:]]
    f, c = spark.createDataFrame(left, "a string, a_ord int, a_tokens array<string>, a_state string, layer string"), spark.createDataFrame(right, "b string, b_ord int, b_tokens array<string>, b_state string, industry string")

    def score(x, y):
        both = set(x[2]) & set(y[2])
        trade, s, t = (y[4] or "").lower(), (x[3] or "").upper(), (y[3] or "").upper()
        fits = {"coal_mines": "coal" in trade, "gas_plants": any(w in trade for w in ("gas", "electricity", "petroleum"))}.get(x[4])
        if not both or fits is False:
            return 0.0
        return len(both) / min(len(x[2]), len(y[2])) + ((0.25 if s == t else -0.6) if s and t else 0) + (0.2 if fits else 0) - (0.3 if len(both) == 1 and max(map(len, both)) <= 4 else 0)

    for least in (0.6, 0.95, 0.2):
        want = sorted((x[0], y[0]) for x in left for y in right if score(x, y) >= least - 1e-12)
        assert sorted((r.a, r.b) for r in matching.score_pairs(f, c, least).collect()) == want
    hot = lambda side, n, more: [(f"{side}{k}", k, ["hot", *[f"{side}{k}x{j}" for j in range(5)]], "", more) for k in range(n)]
    f, c = spark.createDataFrame(hot("a", 3000, "pipelines_gas"), f.schema), spark.createDataFrame(hot("b", 3000, "other"), c.schema)
    assert matching.candidates(f, c, 0.6).count() == 0
