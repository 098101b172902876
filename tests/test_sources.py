import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from weft.sources import files
from weft.sources.tables import forget, keep, shared_folder


def test_obj_round_trip(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# mesh\nv 0 0 0\nv 1 0 0.5\nvn 1 1 1\nv 0 1 0\nf 1/1 2/2 3/3\n")
    v, f = files.read_obj(spark, str(tmp_path / "a.obj"))
    assert sorted((r.id, r.x, r.y, r.z) for r in v.collect()) == [(1, 0, 0, 0), (2, 1, 0, 0.5), (3, 0, 1, 0)]
    assert [(r.a, r.b, r.c) for r in f.collect()] == [(1, 2, 3)]
    files.write_obj(v, f, str(tmp_path / "out"))
    v2, f2 = files.read_obj(spark, str(tmp_path / "out"))
    assert v2.drop("path").exceptAll(v.drop("path")).count() == 0 and f2.count() == 1


def test_csv_drops_bad_rows(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1.5,2.5\nbad,row\n3,4\n")
    assert sorted((r.lon, r.lat) for r in files.read_positions(spark, str(tmp_path / "p.csv")).collect()) == [(1.5, 2.5), (3, 4)]


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"name": "a"}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {}}]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    got = files.read_geojson(spark, str(tmp_path / "f.json")).orderBy("feature_no").collect()
    assert [(p.lon, p.lat) for p in got[0].ring] == [tuple(p) for p in ring] and got[1].ring is None


def test_tiles(spark, tmp_path):
    with sqlite3.connect(tmp_path / "t.mbtiles") as db:
        db.execute("create table tiles (zoom_level int, tile_column int, tile_row int, tile_data blob)")
        db.executemany("insert into tiles values (?, ?, ?, ?)", [(z, c, r, bytes([z, c])) for z in (1, 2) for c in range(70) for r in range(2)])
    tiles = files.read_tiles(spark, str(tmp_path / "t.mbtiles"))
    assert {(r.zoom_level, r.tiles, r["columns"], r["rows"]) for r in files.tile_summary(tiles).collect()} == {(1, 140, 70, 2), (2, 140, 70, 2)}


def test_varints():
    assert files.decode_varints(bytes([1, 0xAC, 0x02])) == [1, 300]
    assert [files.zigzag(n) for n in range(5)] == [0, -1, 1, -2, 2]


def test_packets(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0]), (2, [], [4.5])], "id long, u array<double>, v array<double>")
    back = files.unpack_arrays(files.pack_arrays(df, "id", ["u", "v"]), "id", ["u", "v"])
    assert back.exceptAll(df).count() == 0 and back.count() == 2


def test_results_and_settings(spark, tmp_path):
    df = spark.range(3)
    files.write_results(df, str(tmp_path / "j"))
    files.write_results(df, str(tmp_path / "c"), "csv")
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    assert files.read_settings("a: 1\nb:\n  c: true  # yes\n  d: text\n") == {"a": 1, "b": {"c": True, "d": "text"}}


def test_cities_are_repeatable(spark):
    assert files.city_grid(spark, 8, 80, 5).exceptAll(files.city_grid(spark, 8, 80, 5)).count() == 0
    assert files.city_fringe(spark, 64, 6, 600, 40).select(F.countDistinct("x")).first()[0] == 64


def test_kept_tables(spark):
    t = keep(spark.range(10).withColumn("k", F.col("id") % 2), "k")
    assert t.count() == 10 and t.columns == ["id", "k"]
    assert shared_folder(spark)
    forget(t)
    with pytest.raises(Exception):  # noqa: B017
        keep(spark.range(1)).sparkSession.read.parquet(t.inputFiles()[0]).count()
