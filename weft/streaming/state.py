"""Stateful streams: novelty against the last frame, keyframes, convergence and running prototypes.

Each key's state is small: the last frame's vector, a few counters and the last
distances. Frames are taken in order within a micro-batch; a watermark bounds state
in time where a stream has one. The reference policies: the first frame is a keyframe,
so is every `every`-th after one, and one whose novelty reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME_SCHEMA = "key string, frame long, novelty double, keyframe boolean, since long, stability double, phase string"
_STATE = "last array<double>, count long, since long, recent array<double>"


class FrameTracker:
    """The recurrence of one key, the same for streams and for batches."""

    def __init__(self, every: int, threshold: float, window: int, tol: float, state: tuple | None = None):
        self.every, self.threshold, self.window, self.tol = every, threshold, window, tol
        self.last, self.count, self.since, self.recent = (list(state[0]) if state[0] is not None else None, state[1], state[2], list(state[3])) if state else (None, 0, 0, [])

    def push(self, vector: list[float]) -> tuple[float, bool, int, float, str]:
        v = np.asarray(vector, float)
        same = self.last is not None and len(self.last) == len(v)
        distance = float(np.linalg.norm(v - np.asarray(self.last)) / np.sqrt(len(v))) if same and len(v) else 0.0
        if self.count:
            self.recent = [*self.recent, distance][-self.window :]
        keyframe = self.count == 0 or self.since >= self.every or distance >= self.threshold
        self.since = 0 if keyframe else self.since + 1
        self.last, self.count = v.tolist(), self.count + 1
        return distance, keyframe, self.since, *self.verdict()

    def verdict(self) -> tuple[float, str]:
        r = self.recent
        if len(r) < self.window:
            return 0.0, "insufficient_data"
        stability = max(0.0, 1 - sum(r) / len(r) / self.tol)
        if all(d < self.tol for d in r):
            return stability, "stable_fp"
        return stability, "transient" if all(b <= a for a, b in zip(r, r[1:])) else "oscillating"

    def state(self) -> tuple:
        return self.last, self.count, self.since, self.recent


def track_frames(frames: DataFrame, every: int = 30, threshold: float = 0.5, window: int = 5, tol: float = 1e-2, timeout_ms: int | None = None) -> DataFrame:
    """Novelty, keyframe flag, stability and phase of each frame of each key, with state across micro-batches.

    frames: key, frame, vec. With a timeout, a key that was silent for so long starts afresh.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = FrameTracker(every, threshold, window, tol, state.get if state.exists else None)
        rows = []
        for row in pd.concat(list(batches)).sort_values("frame").itertuples(index=False):
            rows.append((key[0], row.frame, *tracker.push(row.vec)))
        state.update(tracker.state())
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=["key", "frame", "novelty", "keyframe", "since", "stability", "phase"])

    flat = frames.where("key is not null and vec is not null").select(F.col("key").cast("string").alias("key"), F.col("frame").cast("long").alias("frame"), F.col("vec").cast("array<double>").alias("vec"))
    return flat.groupBy("key").applyInPandasWithState(step, FRAME_SCHEMA, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def track_frames_batch(frames: DataFrame, every: int = 30, threshold: float = 0.5, window: int = 5, tol: float = 1e-2) -> DataFrame:
    """The same over a finished table, by windows, so that a long key is sorted (and spilled) but never held in one process.

    Every frame whose novelty reaches the threshold starts the count anew, so the others are keyframes at whole multiples
    of every + 1 after the last such frame, or after the first.
    """
    from pyspark.sql import Window

    from weft.operators.trajectory import array_distance

    w = Window.partitionBy("key").orderBy("frame")
    flat = frames.where("key is not null and vec is not null").select(F.col("key").cast("string").alias("key"), F.col("frame").cast("long").alias("frame"), F.col("vec").cast("array<double>").alias("vec"))
    d = flat.withColumn("n", F.row_number().over(w) - 1).withColumn("novelty", F.coalesce(array_distance(F.lag("vec").over(w), F.col("vec")), F.lit(0.0)))
    fresh = F.when((F.col("n") == 0) | (F.col("novelty") >= threshold), F.col("n"))
    d = d.withColumn("since", (F.col("n") - F.max(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0))) % (every + 1)).withColumn("d", F.when(F.col("n") > 0, F.col("novelty")))
    recent = w.rowsBetween(1 - window, 0)
    d = d.withColumn("rise", F.when(F.col("n") > 1, F.col("novelty") - F.lag("novelty").over(w)))
    d = d.withColumn("top", F.max("rise").over(w.rowsBetween(2 - window, 0))) if window > 1 else d.withColumn("top", F.lit(0.0))
    d = d.withColumns({"have": F.count("d").over(recent), "low": F.count(F.when(F.col("d") < tol, 1)).over(recent), "mean": F.avg("d").over(recent)})
    full = F.col("have") == window
    stability = F.when(full, F.greatest(F.lit(0.0), 1 - F.col("mean") / tol)).otherwise(0.0)
    phase = F.when(~full, "insufficient_data").when(F.col("low") == window, "stable_fp").when(F.coalesce("top", F.lit(0.0)) <= 0, "transient").otherwise("oscillating")
    return d.select("key", "frame", "novelty", (F.col("since") == 0).alias("keyframe"), F.col("since").cast("long").alias("since"), stability.alias("stability"), phase.alias("phase"))


def running_prototypes(labelled: DataFrame) -> DataFrame:
    """label, n, vec: the running mean of each label's vectors with state across micro-batches; another length starts afresh."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n = (np.array(state.get[0]), state.get[1]) if state.exists else (None, 0)
        for pdf in batches:
            for vec in pdf["vec"]:
                v = np.asarray(vec, float)
                total, n = (total + v, n + 1) if total is not None and len(total) == len(v) else (v, 1)
        state.update((total.tolist(), n))
        yield pd.DataFrame({"label": [key[0]], "n": [n], "vec": [(total / n).tolist()]})

    flat = labelled.where("label is not null and vec is not null").select(F.col("label").cast("string").alias("label"), F.col("vec").cast("array<double>").alias("vec"))
    return flat.groupBy("label").applyInPandasWithState(step, "label string, n long, vec array<double>", "total array<double>, n long", "update", GroupStateTimeout.NoTimeout)


def windowed_moments(stream: DataFrame, ts: str, key: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """key, window, n, mean, variance over event-time windows; readings later than the watermark are left out, as bounded state needs."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(key, window.alias("window")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def call_back(stream: DataFrame, on_batch, checkpoint: str, once: bool = True):
    """Runs a function on every micro-batch; with once, on what is there now."""
    writer = stream.writeStream.foreachBatch(lambda df, n: on_batch(df, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def store_keyframes(frames: DataFrame, most: int) -> DataFrame:
    """key, frame, stored: the frames that each key's store holds after each micro-batch's keyframes came in; beyond `most` the smallest goes.

    frames: key, frame, vec, keyframes only. State is the stored frames and their vectors, `most` at the most.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, list[float]] = {}
        if state.exists:
            kept, sizes, flat_values = state.get
            ends = np.cumsum(sizes)
            held = {f: list(flat_values[e - n : e]) for f, n, e in zip(kept, sizes, ends)}
        for pdf in batches:
            held |= {int(f): list(v) for f, v in zip(pdf["frame"], pdf["vec"])}
        held = {f: held[f] for f in sorted(held)[-most:]}
        state.update((list(held), [len(v) for v in held.values()], [float(x) for v in held.values() for x in v]))
        yield pd.DataFrame({"key": key[0], "frame": list(held), "stored": len(held)})

    flat = frames.where("key is not null and frame is not null and vec is not null").select(F.col("key").cast("string").alias("key"), F.col("frame").cast("long").alias("frame"), F.col("vec").cast("array<double>").alias("vec"))
    return flat.groupBy("key").applyInPandasWithState(step, "key string, frame long, stored int", "frames array<long>, sizes array<int>, vecs array<double>", "update", GroupStateTimeout.NoTimeout)


def stored_keyframes(frames: DataFrame, most: int) -> DataFrame:
    """What a store holds in the end, over a finished table: each key's `most` largest frames."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy(F.desc("frame"))
    return frames.where("key is not null and frame is not null and vec is not null").dropDuplicates(["key", "frame"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def analyse_rotations(rotations: DataFrame, modes: int, inputs: int, warm_up: int = 6, state_cost: float = 0.5, input_cost: float = 1.0, ridge: float = 1e-6) -> DataFrame:
    """key, rotation, status ('warmup', 'fitted', 'degraded'), residual, gain (row by row): drift and input map of each key's log weights from all rotations so far, and the Riccati gain that they ask for.

    rotations: key, rotation, t, h (array of weights), u (array of inputs). State is the sums of products
    that the fit needs, the last row and the first, so it doesn't grow with the rotations.
    """
    from weft.operators.blocks import solve_riccati

    size = modes + inputs

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            n, first, last, begun, ended, gram, cross = state.get
            gram, cross = np.reshape(gram, (size, size)), np.reshape(cross, (modes, size))
        else:
            n, first, last, begun, ended, gram, cross = 0, [], [], 0.0, 0.0, np.zeros((size, size)), np.zeros((modes, size))
        rows = []
        for row in pd.concat(list(batches)).sort_values("rotation").itertuples(index=False):
            h = np.log(np.maximum(np.asarray(row.h, float), 1e-12))
            first = list(h) if n == 0 else first
            x = h - np.asarray(first)
            if n:
                gram += np.outer(last, last)
                cross += np.outer(x, last)
            begun = row.t if n == 0 else begun
            n, ended, last = n + 1, row.t, [*x, *map(float, row.u)]
            if n < warm_up:
                rows.append((key[0], row.rotation, "warmup", None, None))
                continue
            dt = (ended - begun) / (n - 1) if ended > begun else 1.0
            theta = np.linalg.solve(gram + ridge * np.eye(size), cross.T).T
            a, b = (theta[:, :modes] - np.eye(modes)) / dt, theta[:, modes:] / dt
            q, r = state_cost * np.eye(modes), input_cost * np.eye(inputs)
            try:
                p = solve_riccati(a, b, q, r)
                rest = float(np.linalg.norm(a.T @ p + p @ a - p @ b @ np.linalg.inv(r) @ b.T @ p + q))
            except np.linalg.LinAlgError:
                p, rest = np.full((modes, modes), np.nan), float("inf")
            rows.append((key[0], row.rotation, "fitted" if rest < 1e-6 else "degraded", rest, p.ravel().tolist()))
        state.update((n, list(map(float, first)), list(map(float, last)), float(begun), float(ended), gram.ravel().tolist(), cross.ravel().tolist()))
        yield pd.DataFrame(rows, columns=["key", "rotation", "status", "residual", "gain"])

    kept = "n long, first array<double>, last array<double>, begun double, ended double, gram array<double>, cross array<double>"
    flat = rotations.where("key is not null and h is not null and u is not null").select(F.col("key").cast("string").alias("key"), F.col("rotation").cast("long").alias("rotation"), F.col("t").cast("double").alias("t"), F.col("h").cast("array<double>").alias("h"), F.col("u").cast("array<double>").alias("u"))
    return flat.groupBy("key").applyInPandasWithState(step, "key string, rotation long, status string, residual double, gain array<double>", kept, "append", GroupStateTimeout.NoTimeout)
