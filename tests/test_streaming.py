import datetime as dt

import pytest
from pyspark.sql import functions as F

from weft.streaming.state import FrameTracker, call_back, running_prototypes, track_frames, track_frames_batch, windowed_moments

FRAME = "key string, frame long, vec array<double>"


def frames():
    rows = []
    for k in ("a", "b"):
        v = [0.0, 0.0, 0.0, 1.0]
        for n in range(40):
            v = [v[0] + 0.001 * n, v[1], v[2] + (3.0 if n == 25 else 0), v[3]]
            rows.append((k, n, list(v)))
    return rows


def stream(spark, rows, schema, tmp_path, name, parts):
    """Files of one micro-batch each."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").json(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))


def run(query_df, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_and_batch_agree(spark, tmp_path):
    rows = sorted(frames(), key=lambda r: r[1])
    run(track_frames(stream(spark, rows, FRAME, tmp_path, "f", 3), every=10, threshold=0.5), "frames", "append")
    live = spark.table("frames")
    done = track_frames_batch(spark.createDataFrame(rows, FRAME), every=10, threshold=0.5)
    assert live.count() == 80 and live.exceptAll(done).count() == 0
    keys = [r.frame for r in done.where("keyframe and key = 'a'").orderBy("frame").collect()]
    assert keys[0] == 0 and 25 in keys and keys[1] == 11


def test_tracker_phases():
    t = FrameTracker(100, 9.0, 3, 0.1)
    assert t.push([0.0])[4] == "insufficient_data"
    for v in (8.0, 4.0, 2.0):
        last = t.push([v])
    assert last[4] == "transient"
    for _ in range(4):
        last = t.push([2.0])
    assert last[4] == "stable_fp" and last[3] == 1.0
    assert t.push([1.0, 2.0])[0] == 0.0  # another size is no novelty


def test_prototypes(spark, tmp_path):
    rows = [("t", [1.0, 0.0]), ("t", [3.0, 0.0]), ("c", [0.0, 2.0]), (None, [1.0, 1.0]), ("t", [2.0, 3.0])]
    run(running_prototypes(stream(spark, rows, "label string, vec array<double>", tmp_path, "p", 2)), "protos", "update")
    best = {r.label: r for r in spark.table("protos").orderBy("n").collect()}
    assert best["t"].n == 3 and best["t"].vec == pytest.approx([2.0, 1.0])


def test_windows(spark, tmp_path):
    t0 = dt.datetime(2031, 3, 3)
    rows = [("a", t0 + dt.timedelta(seconds=10 * i), float(i)) for i in range(12)] + [("a", t0 + dt.timedelta(hours=3), 1.0)]
    s = stream(spark, rows, "k string, ts timestamp, v double", tmp_path, "w", 1)
    run(windowed_moments(s, "ts", "k", "v", "1 minute"), "moments", "append")
    got = spark.table("moments").orderBy("window").collect()
    assert [(r.n, r["mean"]) for r in got] == [(6, 2.5), (6, 8.5)]


def test_call_back(spark, tmp_path):
    seen = []
    s = stream(spark, [("a", 1.0)] * 4, "k string, v double", tmp_path, "c", 2)
    call_back(s, lambda df, n: seen.append(df.agg(F.count("*")).first()[0]), str(tmp_path / "check")).awaitTermination(120)
    assert sum(seen) == 4
