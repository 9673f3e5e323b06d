"""Paged sources, period commits and the stream of new ids, with their failures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from emberline.sources import commits, pages
from emberline.streaming import seen

LANDED = "plume_id bigint, provider string"


def land(path, offset, items, text=None):
    folder = path / f"offset={offset}"
    folder.mkdir(parents=True)
    (folder / "page.json").write_text(json.dumps({"features": items}) if text is None else text)


def test_pages_end_at_the_first_short_one(spark, tmp_path):
    item = lambda k: {"id": k, "name": f"é{k}" if k % 3 else None}
    for k in range(4):
        land(tmp_path / "a", k * 3, [item(k * 3 + j) for j in range(3)])
    land(tmp_path / "a", 12, [item(12)])
    land(tmp_path / "a", 15, [item(99)] * 3)
    land(tmp_path / "a", 21, [item(77)] * 3)
    (tmp_path / "a" / "_SUCCESS").write_text("")
    read = lambda p, size=3: sorted(r.id for r in pages.read_pages(spark, str(tmp_path / p), "id long, name string", size).collect())
    assert read("a") == list(range(13))
    every = pages.all_pages(spark, str(tmp_path / "a"), 3)
    assert sorted({r.offset for r in every.collect()}) == [0, 3, 6, 9, 12, 15] and every.rdd.getNumPartitions() == 6
    part = every.where((F.col("offset") >= 3) & (F.col("offset") < 9) & (F.col("place") > 0))
    assert part.count() == 4 and part.rdd.getNumPartitions() == 2
    assert every.where(F.col("offset").isin(6, 99)).rdd.getNumPartitions() == 1
    assert [json.loads(r.item)["name"] for r in every.where("offset = 0").sort("place").collect()] == [None, "é1", "é2"]
    land(tmp_path / "full", 0, [item(0)] * 2)
    land(tmp_path / "none", 0, [])
    land(tmp_path / "none", 2, [item(1)])
    land(tmp_path / "gap", 2, [item(1)] * 2)
    assert read("full", 2) == [0, 0] and read("none", 2) == [] and read("gap", 2) == []


def test_many_pages_share_partitions(spark, tmp_path):
    for k in range(600):
        land(tmp_path, k * 2, [{"id": k * 2}, {"id": k * 2 + 1}] if k < 599 else [{"id": 1198}])
    every = pages.all_pages(spark, str(tmp_path), 2)
    assert every.rdd.getNumPartitions() == 200 and {(r.offset, r.place) for r in every.collect()} == {(k - k % 2, k % 2) for k in range(1199)}
    assert every.where("offset >= 1000").rdd.getNumPartitions() == 100
    assert sorted(r.id for r in pages.read_pages(spark, str(tmp_path), "id long", 2).collect()) == list(range(1199))


@pytest.mark.parametrize("text", ["", "<html>", '{"error": 1}', "[1]", '{"features": null}'])
def test_a_page_that_is_none_is_an_error(spark, tmp_path, text):
    land(tmp_path / "a", 0, [{"id": 1}] * 2)
    land(tmp_path / "a", 2, None, text)
    with pytest.raises(Exception, match="page 2"):
        pages.read_pages(spark, str(tmp_path / "a"), "id long", 2).collect()


def rows_of(spark, path):
    return sorted((r.period, r.n) for r in commits.read_periods(spark, path, "n long").collect())


def test_a_run_that_ends_anywhere_goes_on(spark, tmp_path, monkeypatch):
    path, made = str(tmp_path / "t"), []

    def make(period):
        made.append(period)
        return None if period == "p9" else spark.range(int(period[1])).select((F.col("id") + 10 * len(made)).alias("n"))

    assert rows_of(spark, path) == [] and commits.missing(spark, path, ["p1", "p1"]) == ["p1"]
    whole = commits.commit

    def killed(spark, path, entry):
        if entry["period"] == "p3":
            raise SystemExit("killed")
        whole(spark, path, entry)

    monkeypatch.setattr(commits, "commit", killed)
    with pytest.raises(SystemExit):
        commits.run_periods(spark, path, ["p1", "p2", "p3", "p4"], make)
    assert rows_of(spark, path) == [("p1", 10), ("p2", 20), ("p2", 21)] and len(os.listdir(f"{path}/data/period=p3")) == 1
    monkeypatch.setattr(commits, "commit", whole)
    assert commits.run_periods(spark, path, ["p1", "p2", "p9", "p3", "p4"], make) == ["p3", "p4"]
    assert made == ["p1", "p2", "p3", "p9", "p3", "p4"]
    assert rows_of(spark, path) == [("p1", 10), ("p2", 20), ("p2", 21), ("p3", 50), ("p3", 51), ("p3", 52), ("p4", 60), ("p4", 61), ("p4", 62), ("p4", 63)]
    assert commits.drop_leftovers(spark, path) == 1 and len(os.listdir(f"{path}/data/period=p3")) == 1
    commits.commit(spark, path, commits.write_attempt(spark.range(1).select(F.lit(7).cast("long").alias("n")), path, "p2"))
    assert [r for r in rows_of(spark, path) if r[0] == "p2"] == [("p2", 7)]
    index = {r.period: r.rows for r in commits.read_index(spark, path).collect()}
    assert index == {"p1": 1, "p2": 1, "p3": 3, "p4": 4} and not [f for f in os.listdir(f"{path}/index") if not f.endswith((".json", ".crc"))]
    os.remove(f"{path}/data/period=p1/{os.listdir(f'{path}/data/period=p1')[0]}/_SUCCESS")
    assert commits.missing(spark, path, ["p1", "p2"]) == ["p1"]
    with pytest.raises(ValueError, match="can't name"):
        commits.write_attempt(spark.range(1), path, "../x")


def test_new_ids_come_once(spark, tmp_path):
    landed, table = str(tmp_path / "landed"), str(tmp_path / "table")
    drop = lambda run, rows: spark.createDataFrame(rows, LANDED).write.parquet(f"{landed}/run={run}")
    new = lambda run: sorted((r.plume_id, r.provider) for r in seen.run_new_ids(spark, landed, table, LANDED, run, buckets=4).collect())
    drop("1", [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "a")])
    assert new("1") == [] and new("1") == []
    drop("2", [(2, "a"), (4, "a"), (4, "a"), (3, "b"), (5, "b")])
    assert new("2") == [(4, "a"), (5, "b")] and new("2") == [(4, "a"), (5, "b")]
    drop("3", [(1, "a"), (6, "a")])
    with pytest.raises(ValueError, match="b"):
        new("3")
    assert not os.path.exists(f"{table}/rows/batch=000000000002")
    drop("3b", [(7, "b")])
    spark.read.parquet(f"{landed}/run=3b").write.mode("append").parquet(f"{landed}/run=3")
    assert new("3") == [(6, "a"), (7, "b")]


def test_a_stopped_stream_goes_on(spark, tmp_path, monkeypatch):
    landed, table = str(tmp_path / "landed"), str(tmp_path / "table")
    spark.createDataFrame([(1, "a")], LANDED).write.parquet(f"{landed}/run=1")
    seen.run_new_ids(spark, landed, table, LANDED, "1", buckets=2)
    spark.createDataFrame([(1, "a"), (2, "a")], LANDED).write.parquet(f"{landed}/run=2")
    writer = type(spark.range(1).write)
    whole = writer.parquet

    def broken(self, path, *a, **k):
        if "/rows/batch=" in path:
            raise OSError("disk")
        return whole(self, path, *a, **k)

    monkeypatch.setattr(writer, "parquet", broken)
    with pytest.raises(Exception, match="disk"):
        seen.run_new_ids(spark, landed, table, LANDED, "2", buckets=2)
    monkeypatch.setattr(writer, "parquet", whole)
    assert [r.plume_id for r in seen.run_new_ids(spark, landed, table, LANDED, "2", buckets=2).collect()] == [2]
