"""Readers and sinks on files made here, and the stream."""

import io
import json
import tarfile
import zipfile

import pytest

from emberline.sources import readers, sinks
from emberline.streaming.weekly import SCHEMA, run_weekly


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": [{"properties": p, "geometry": g} for p, g in features]})


def test_geojson(spark, tmp_path):
    point, ring = {"type": "Point", "coordinates": [120.5, -20]}, {"coordinates": [[[120, -20], [121, -20.5], [120, -20]]]}
    (tmp_path / "m.json").write_text(collection(({"objectid": 1, "name": "A", "commodity_group": " Coal "}, point), ({"objectid": 2, "commodity_group": "Iron"}, point), ({"objectid": 3, "name": " ", "commodity_group": "coal", "status": "Closed"}, ring), ({"commodity_group": "coal"}, None)))
    rows = {r.id: r for r in readers.coal_mines(spark, {"operating": str(tmp_path / "m.json")}).collect()}
    assert set(rows) == {"ga:1", "ga:3"} and rows["ga:1"].status == "operating" and rows["ga:3"].name == "(unnamed)" and rows["ga:3"].status == "closed"
    assert rows["ga:3"].geom_type == "Polygon" and [tuple(p) for p in rows["ga:3"].coords] == [(120, -20), (121, -20.5), (120, -20)] and rows["ga:1"].geom_type == "Point"
    (tmp_path / "g.json").write_text(collection(({"facility_id": "F", "name": "G", "duid_data": [{"fuel_tech": "gas_ocgt", "capacity_registered": 3, "status": "operating"}]}, {"coordinates": [120, -20]})))
    plant = readers.gas_plants(spark, str(tmp_path / "g.json")).first()
    assert plant.id == "oe:F" and plant.units[0].fuel == "gas_ocgt" and plant.geom_type == "Point"


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "r.tar.gz", "w:gz") as t:
        for name, text in (
            ("x/data/individual-routes/gas-pipelines/P12-a.geojson", collection(({"name": "R", "OBJECTID": 7}, {"type": "LineString", "coordinates": [[141, -5], [142, -6]]}), ({}, {"type": "LineString", "coordinates": [[141, -5], [142, -6]]}), ({}, {"type": "Point", "coordinates": [120, -20]}))),
            ("x/data/individual-routes/liquid-pipelines/bad.geojson", "no"), ("x/data/other/P1-a.geojson", collection(({}, {"type": "Point", "coordinates": [141, -5]}))), ("x/y.txt", "z"),
        ):
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    rows = readers.gas_routes(spark, str(tmp_path / "r.tar.gz")).collect()
    assert [(r.id, r.layer, r.name, r.subtype, len(r.coords)) for r in rows] == [("gem:P12:7", "pipelines_gas", "R", "gas pipeline", 2), ("gem:P12:1", "pipelines_gas", "GEM pipeline P12", "gas pipeline", 2)]
    with zipfile.ZipFile(tmp_path / "i.zip", "w") as z:
        z.writestr("d.csv", "id_plume,lat,lon,satellite,tile_date,ch4_fluxrate,ch4_fluxrate_std,sector\n1,-20,120,S,2024-01-01,5,,\n2,-20,bad,S,d,1,1,x\n3,50,120,S,d,1,1,x\n")
    rows = readers.imeo(spark, str(tmp_path / "i.zip")).collect()
    assert [(r.plume_id, r.emission_kg_hr, r.uncertainty_kg_hr, r.sector) for r in rows] == [("imeo:1", 5.0, None, None)]


def test_feeds(spark, tmp_path):
    item = {"plume_id": "a", "geometry_json": {"type": "Point", "coordinates": [120, -20]}, "emission_auto": 0, "scene_timestamp": "t"}
    (tmp_path / "c.json").write_text(json.dumps({"items": [item, item | {"plume_id": None, "id": "b"}, item | {"geometry_json": {"type": "Point", "coordinates": [0, 0]}}]}))
    assert sorted(r.plume_id for r in readers.carbon_mapper(spark, str(tmp_path / "c.json")).collect()) == ["cm:a", "cm:b"]
    umm = lambda g, n: {"umm": {"GranuleUR": n, "SpatialExtent": {"HorizontalSpatialDomain": {"Geometry": g}}, "TemporalExtent": {"SingleDateTime": "t"}}}
    poly = {"GPolygons": [{"Boundary": {"Points": [{"Longitude": 120, "Latitude": -20}, {"Longitude": 122, "Latitude": -22}]}}]}
    box = {"BoundingRectangles": [{"WestBoundingCoordinate": 120, "EastBoundingCoordinate": 124, "SouthBoundingCoordinate": -20, "NorthBoundingCoordinate": -10}]}
    (tmp_path / "e.json").write_text(json.dumps({"items": [umm(poly, "p"), umm({"Points": [{"Longitude": 130, "Latitude": -5}]}, "q"), umm(box, "r"), umm({}, "s")]}))
    assert {r.plume_id: (r.lon, r.lat) for r in readers.emit(spark, str(tmp_path / "e.json")).collect()} == {"emit:p": (121, -21), "emit:q": (130, -5), "emit:r": (122, -15)}
    (tmp_path / "s.csv").write_text(" date ,Time_UTC,lat,lon,source_rate_t/h,uncertainty_t/h\n20240102,03:04:05,-20,120,2.5,x\n2024,,-20,120,,1\n")
    rows = {r.datetime_utc: r for r in readers.sron(spark, str(tmp_path / "s.csv")).collect()}
    assert set(rows) == {"2024-01-02T03:04:05Z", "2024"} and rows["2024-01-02T03:04:05Z"].emission_kg_hr == 2500 and rows["2024-01-02T03:04:05Z"].plume_id == "sron:20240102--20.000-120.000"
    whole, notes = readers.all_plumes(spark, {"SRON": str(tmp_path / "s.csv"), "EMIT": str(tmp_path / "none.json")})
    assert whole.count() == 2 and set(notes) == {"EMIT"}
    links = spark.createDataFrame([("https://h/a_2024_wk5_v20240101.csv https://h/a_2024_wk05_v20240109-2.csv",)], "text string")
    assert [tuple(r) for r in readers.latest_weekly(links).select("week", "url").collect()] == [("05", "https://h/a_2024_wk5_v20240101.csv")]


def test_reported_and_catalogue(spark, tmp_path):
    text = "Title,,\nnote\nFacility name,Responsible emitter,State,ANZSIC,GHG Methane,Covered emissions,Baseline emissions number\n\"A, B\",Caf\xe9,QLD,Coal mining,\"1,234\",-,N/A\n,x,,,,,\n"
    (tmp_path / "r.csv").write_bytes(text.encode("cp1252"))
    rows = readers.reported_figures(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.name, r.operator, r.methane_tco2e, r.covered_tco2e, r.baseline) for r in rows] == [("A, B", "Café", 1234.0, None, None)]
    (tmp_path / "q.csv").write_text("x\nState,GHG methane,Covered,Facility NAME\nQLD,5,7,Mine two\n")
    both = {r.name: (r.state, r.methane_tco2e, r.covered_tco2e, r.baseline) for r in readers.reported_figures(spark, str(tmp_path / "[qr].csv")).collect()}
    assert both == {"A, B": ("QLD", 1234.0, None, None), "Mine two": ("QLD", 5.0, 7.0, None)}
    text = 'Facility name,Emitter,State,Methane\r\n"Long\r\nname, ""x""",M\x81,QLD,1\r\n,,,\r\nShort\r\n'
    (tmp_path / "l.csv").write_bytes(text.encode("latin-1"))
    (tmp_path / "none.csv").write_text("a,b,c,d\n1,2,3,4\n")
    rows = readers.reported_figures(spark, str(tmp_path / "[ln]*.csv")).collect()
    assert [(r.name, r.operator, r.methane_tco2e) for r in rows] == [('Long\r\nname, "x"', "M\x81", 1.0), ("Short", None, None)]
    with pytest.raises(ValueError, match="header"):
        readers.reported_figures(spark, str(tmp_path / "none.csv"))
    (tmp_path / "h.csv").write_text("Facility name,Emitter,State,Methane\n")
    assert readers.reported_figures(spark, str(tmp_path / "h.csv")).count() == 0
    entries = spark.createDataFrame([("e", [("u1", None, None), ("u2", [200, 403], None), ("u3", None, "KEY")])], "id string, urls array<struct<url string, expect array<int>, requires string>>")
    seen = spark.createDataFrame([("u1", 404), ("u2", 403)], "url string, status int")
    assert {r.url: r.ok for r in readers.catalog_checks(entries, seen).collect()} == {"u1": False, "u2": True}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, " ", ["x", "y"], 120.0, -20.0), ("b", 2, "z", [], 121.0, -21.0)], "layer string, n int, s string, notes array<string>, lon double, lat double")
    sinks.write_features(df, str(tmp_path / "f"))
    rows = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "f")).collect()), key=lambda r: r["properties"]["layer"])
    assert rows[0]["properties"] == {"layer": "a", "notes": "x; y"} and rows[1]["properties"] == {"layer": "b", "n": 2, "s": "z"} and rows[0]["geometry"]["coordinates"] == [120, -20]
    assert {r.layer: r.n for r in sinks.write_layers(df, str(tmp_path / "l")).collect()} == {"a": 1, "b": 1}


def test_stream_goes_on(spark, tmp_path):
    land = lambda day, k: spark.sql(f"select {k} event_id, timestamp_ntz'2024-01-{day} 01:00:00' ts, 1L user_id, 'v' event_type, 2.0D value, '' props").write.mode("append").parquet(str(tmp_path / "in"))
    land("02", 1)
    table = str(tmp_path / "out")
    assert SCHEMA and [(str(r.week), r.n, r.total) for r in run_weekly(spark, str(tmp_path / "in"), table).collect()] == [("2024-01-01", 1, 2.0)]
    land("07", 2)
    land("08", 3)
    assert sorted((str(r.week), r.n) for r in run_weekly(spark, str(tmp_path / "in"), table).collect()) == [("2024-01-01", 2), ("2024-01-08", 1)]


def test_states_and_composites(spark, tmp_path):
    assert readers.read_state(spark, str(tmp_path / "none"), "plume_id string").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no")
    assert readers.read_state(spark, str(tmp_path / "bad"), "plume_id string").count() == 0
    cells = spark.createDataFrame([(1, 2, 3.0, None, 4, "k", "p"), (1, 2, 3.0, 1.0, 4, "k", "q")], "row long, col long, mean double, anomaly double, n_obs long, kind string, period string")
    assert {(r.period, r.cells, r.graded) for r in sinks.write_composites(cells, str(tmp_path / "c")).collect()} == {("p", 1, 0), ("q", 1, 1)}
    sinks.write_composites(cells.where("period = 'q'").withColumn("mean", cells.mean + 1), str(tmp_path / "c"))
    assert {(r.period, r.mean) for r in sinks.load_stack(spark, str(tmp_path / "c"), "k").collect()} == {("p", 3.0), ("q", 4.0)}
    granules = spark.createDataFrame([("a", "[]"), ("b", "["), ("c", '[{"v": 1}]'), ("d", None)], "id string, content string")
    rows, status = readers.read_granules(granules, "v: double")
    assert {r.id: r.status for r in status.collect()} == {"a": "empty", "b": "failed", "c": "ok", "d": "failed"} and [tuple(r) for r in rows.collect()] == [("c", 1.0)]


def test_tables_of_a_run_can_be_dropped(spark):
    from emberline.sources import shared

    held = shared.materialise(spark.range(3), "t")
    assert held.count() == 3 and shared.drop_tables(spark) >= 1
