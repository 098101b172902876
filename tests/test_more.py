import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from weft.operators import blocks, fusion, places, trajectory
from weft.sources.files import read_images


def test_series(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 4, 6, 2, 3, -1])] + [("b", 0, 1.0), ("b", 1, 2.0)], "k string, t int, v double")
    assert [(r.k, r.at, r.drop) for r in trajectory.largest_drop(df, "k", "t", "v").collect()] == [("a", 3, 4.0)]
    got = trajectory.recent(df, "k", "t", "v", 3).where("k = 'a' and t = 4").first()
    assert (got.recent_n, got.recent_max) == (3, 6.0) and got.recent_mean == pytest.approx(11 / 3)
    assert trajectory.running_share(df, "k", "t", "v").where("k = 'b' and t = 0").first().share == pytest.approx(1 / 3)
    stages = spark.createDataFrame([("a", 0, "wake"), ("a", 1, "rest")], "k string, epoch int, stage string")
    assert {r.t: r.stage for r in trajectory.stage_of(df.where("k = 'a'"), stages, "k", "t", 2.0).collect()} == {0: "wake", 1: "wake", 2: "rest", 3: "rest", 4: None, 5: None}


def test_solid_statistics(spark):
    ball = {"id": "b", "centre": (0, 0, 0), "scale": (1, 1, 1), "shape": (1, 1)}
    pts = spark.createDataFrame([(0.1, 0.0, 0.0, 2.0), (0.0, 0.1, 0.0, 4.0), (5.0, 0.0, 0.0, 9.0)], "x double, y double, z double, intensity double")
    r = places.solid_statistics(pts, [ball]).first()
    assert (r.solid, r.n, r["mean"]) == ("b", 2, 3.0) and r.density == pytest.approx(2 / (4 / 3 * math.pi))


def test_loops_of_meshes(spark):
    # a square of two triangles: its boundary is born with the last side and filled by the diagonal's faces
    square = [("s", 0, 1, 2, 1.0, 1.0, 1.5), ("s", 0, 2, 3, 1.5, 1.0, 1.0)]
    hollow = [("h", a, b, c, 1.0, 1.0, 1.0) for a, b, c in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]
    got = blocks.persistence_1d(spark.createDataFrame(square + hollow, "m string, a long, b long, c long, ab double, bc double, ca double"), "m").collect()
    assert [(r.m, r.birth, r.death) for r in got] == [("s", 1.0, 1.5)]


def test_kernel_adaptation_raises_the_evidence(spark):
    rows = [("g", i, x / 5, 0.0, math.sin(x / 5)) for i, x in enumerate(range(25))]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double, z double")
    none, some = (blocks.adapt_lengths(df, "g", steps=n).first().evidence for n in (0, 15))
    assert some > none


def test_weakening_a_bridge(spark):
    edges = [("g", a, b, 1.0, False) for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5))] + [("g", 2, 3, 1.0, True)]
    got = blocks.weakening_sweep(spark.createDataFrame(edges, "g string, src long, dst long, w double, weak boolean"), "g", "weak", [1.0, 0.1, 0.01]).orderBy("factor").collect()
    assert [r.fiedler for r in got] == sorted(r.fiedler for r in got) and got[0].fiedler < 0.02


def test_prompts_settle(spark):
    start = spark.createDataFrame([("a", "tree", 0.5), ("a", "car", 0.5)], "k string, label string, p double")
    found, n = fusion.prompts_until_stable(start, lambda t: t.select("k", "label", F.pow("p", 2).alias("confidence")).where("label = 'tree' or p > 0.1").withColumn("confidence", F.when(F.col("label") == "tree", 1.0).otherwise(F.col("confidence"))), "k")
    assert n < 10 and found.orderBy(F.desc("p")).first().label == "tree"


def test_images(spark, tmp_path):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    pixels = b"\x00" + bytes([255, 0, 0, 0, 255, 0]) + b"\x00" + bytes([0, 0, 255, 255, 255, 255])
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "bad.png").write_bytes(b"nothing")
    got = {(r.r, r.c): (r.red, r.green, r.blue) for r in read_images(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (1, 0, 0), (0, 1): (0, 1, 0), (1, 0): (0, 0, 1), (1, 1): (1, 1, 1)}
