"""What large tables need: joins by shuffles alone, and work that grows with the input."""

from pyspark.sql import functions as F

from emberline.operators import greedy, spatial
from emberline.plans import views
from emberline.registry import QUERIES

DIR = "/root/testdata/sf0.001"


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin")


def test_distance_joins_never_broadcast_what_they_send_to_bins(spark):
    places = spark.range(300).select(F.col("id").alias("i"), (F.lit(120) + F.col("id") / 100).alias("lon"), F.lit(-30.0).alias("lat"))
    right = places.select(F.col("i").alias("j"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    near = spatial.radius_join(places, right, 1.0)
    assert near.count() == 300 + 2 * 299 and not joins(near)


def test_many_facilities_are_not_broadcast(spark, monkeypatch):
    few = views.plumes(spark, DIR)
    assert joins(few) == 1
    monkeypatch.setattr(views, "MANY", 10)
    many = views.plumes(spark, DIR)
    assert not joins(many) and sorted(many.collect()) == sorted(few.collect())


def test_greedy_rounds_of_many_rows_are_not_broadcast(spark, monkeypatch):
    rows = spark.range(400).select("id", F.lit("a").alias("part"), ((F.col("id") * 37) % 401).alias("rank"), (F.col("id") / 100).alias("lon"), F.lit(0.0).alias("lat"))
    near = lambda: F.abs(F.col("lon") - F.col("k_lon")) < 0.025
    kept = lambda: greedy.first_kept(rows, (0.02, 0.02), (2, 2), near)
    few = kept()
    monkeypatch.setattr(greedy, "MANY", 10)
    many = kept()
    assert joins(few) == 1 and not joins(many) and sorted(few.collect()) == sorted(many.collect())


def test_the_first_radius_of_nearest_features_follows_their_density(spark):
    crowd = spark.range(20000).select(F.col("id").alias("feature_ord"), F.lit("a").alias("layer"), F.col("id").cast("string").alias("name"), F.lit(0).alias("layer_ord"), (F.lit(120) + F.col("id") % 200 / 1000).alias("r_lon"), (F.lit(-30) + F.floor(F.col("id") / 200) / 500).alias("r_lat"))
    assert 0.1 < spatial.crowded_radius(crowd, 12, 50.0) < 1.0
    assert spatial.crowded_radius(crowd.limit(0), 12, 50.0) == 50.0 == spatial.crowded_radius(crowd.where("feature_ord < 2"), 1200, 50.0)
    points = spark.createDataFrame([(0, 120.05, -29.95), (1, 131.0, -30.0), (2, 120.1, -29.9)], "point_id int, lon double, lat double")
    got = {(r.point_id, r["rank"]): (r.feature_ord, r.km) for r in spatial.nearest_features(points, crowd).collect()}
    assert got == {(r.point_id, r["rank"]): (r.feature_ord, r.km) for r in spatial.nearest_features(points, crowd, 3, 8000.0).collect()} and len(got) == 9


def test_same_day_links_are_the_pairs_themselves(spark):
    rows = [(1, 0, 120.0, -30.0), (2, 0, 120.005, -30.0), (3, 1, 120.0, -30.0), (4, 0, 120.0, -30.0), (5, 0, 121.0, -30.0), (6, None, 120.0, -30.0)]
    df = spark.createDataFrame(rows, "plume_id long, day int, lon double, lat double")
    assert sorted((r.plume_id, r.other) for r in greedy.same_day_pairs(df).collect()) == [(1, 2), (1, 4), (2, 4)]
    assert QUERIES["same_day_links"](spark, DIR).columns == ["plume_id", "other", "km"]
