"""Claims of many sources about the same things, fused into one labelled scene."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.shapes import box_iou
from weft.sources.tables import dimension, forget, keep

#: States of a variable in belief propagation.
MOST_STATES = 200


def claims_of(nodes: DataFrame, *keep_columns: str) -> DataFrame:
    """One row for each claim of each node, with its place in the node's list."""
    return nodes.select(*keep_columns, F.posexplode("claims").alias("claim_no", "claim")).select(*keep_columns, "claim_no", "claim.*")


def filter_claims(claims: DataFrame, least: float = 0.0, sources: list[str] | None = None) -> DataFrame:
    kept = claims.where(F.col("score") >= least)
    return kept.where(F.col("source_id").isin(sources)) if sources is not None else kept


def confusion_prior(claims: DataFrame, categories: DataFrame, hit: float = 0.8) -> DataFrame:
    """source, label, cat, q: how likely a source says a label of a category; `hit` if it's the category's own name, the rest shared."""
    labels = claims.select(F.col("source_id").alias("source"), F.col("native_label").alias("label")).where("source is not null and label is not null").distinct()
    raw = labels.crossJoin(dimension(categories.select("cat"))).withColumn("raw", F.when(F.col("label") == F.col("cat"), hit).otherwise(1 - hit))
    return raw.select("source", "label", "cat", (F.col("raw") / F.sum("raw").over(Window.partitionBy("source", "cat"))).alias("q"))


def posteriors(claims: DataFrame, prior: DataFrame, weights: DataFrame | None, keys: list[str], categories: DataFrame, eps: float = 1e-12) -> DataFrame:
    """keys, cat, p: softmax over categories of the sum of weight * score * ln q over a group's claims.

    Claims of unknown sources or labels say nothing; a group without evidence is uniform. A null
    table of weights counts every source with 1.
    """
    groups = claims.select(*keys).distinct().crossJoin(dimension(categories.select("cat")))
    said = claims.select(*keys, F.col("source_id").alias("source"), F.col("native_label").alias("label"), "score").join(prior, ["source", "label"])
    said = said.withColumn("lam", F.lit(1.0)) if weights is None else said.join(weights, "source")
    logs = said.groupBy(*keys, "cat").agg(F.sum(F.col("lam") * F.col("score") * F.ln(F.greatest(F.col("q"), F.lit(eps)))).alias("s"))
    return softmax(groups.join(logs, [*keys, "cat"], "left").select(*keys, "cat", F.coalesce("s", F.lit(0.0)).alias("x")), keys, "x").withColumnRenamed("x", "log_score")


def softmax(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """rows with p, the softmax of x within keys."""
    w = Window.partitionBy(*keys)
    top = rows.withColumn("e", F.exp(F.col(x) - F.max(x).over(w)))
    return top.withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def argmax(rows: DataFrame, keys: list[str], value: str, item: str) -> DataFrame:
    """keys, item, value of each group's largest value, the first item of equals."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), item))
    return rows.withColumn("best", best).where("best = 1").select(*keys, item, value)


def _cells(box: Column, size: Column, pad: float) -> Column:
    """Cells of that size that a box with a margin touches."""
    low = lambda v: F.floor((v - pad) / size)
    high = lambda v: F.floor((v + pad) / size)
    return F.flatten(F.transform(F.sequence(low(box["x1"]), high(box["x2"])), lambda i: F.transform(F.sequence(low(box["y1"]), high(box["y2"])), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def box_pairs(boxes: DataFrame, frame: list[str], size: float, pad: float = 0.0) -> DataFrame:
    """frame, a, b, box_a, box_b: pairs a < b of boxes of one frame that touch a common cell, once each.

    Cells double in size from level to level. A box is filed at the level where it touches at
    most nine cells, and looked up there and at every larger level in use, so that a box over the
    whole frame costs no more than a small one and no pair is lost. A pair is made only in the
    first cell that both touch, and needs no distinct afterwards.
    """
    extent = F.greatest(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")) + 2 * pad
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(size)) / size))).cast("int")
    levelled = boxes.select(*frame, "id", "box", level.alias("own"))
    top = levelled.agg(F.max("own")).first()[0] or 0
    width = lambda lv: F.lit(size) * F.pow(F.lit(2.0), lv)

    filed = levelled.select(*frame, "id", "box", F.col("own").alias("level"), F.explode(_cells(F.col("box"), width(F.col("own")), pad)).alias("cell")).select(*frame, "level", "cell.cx", "cell.cy", F.col("id").alias("b"), F.col("box").alias("box_b"))
    every = levelled.select(*frame, "id", "box", "own", F.explode(F.sequence(F.col("own"), F.lit(top))).alias("level"))
    asked = every.select(*frame, "id", "box", "own", "level", F.explode(_cells(F.col("box"), width(F.col("level")), pad)).alias("cell")).select(*frame, "own", "level", "cell.cx", "cell.cy", F.col("id").alias("a"), F.col("box").alias("box_a"))
    first = lambda side: F.floor((F.greatest(F.col("box_a")[side], F.col("box_b")[side]) - pad) / width(F.col("level")))
    once = (F.col("own") < F.col("level")) | (F.col("a") < F.col("b"))
    met = asked.join(filed, [*frame, "level", "cx", "cy"]).where(once & (F.col("a") != F.col("b")) & (F.col("cx") == first("x1")) & (F.col("cy") == first("y1")))
    swap = F.col("a") > F.col("b")
    return met.select(*frame, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("box_b")).otherwise(F.col("box_a")).alias("box_a"), F.when(swap, F.col("box_a")).otherwise(F.col("box_b")).alias("box_b"))


def iou_pairs(boxes: DataFrame, frame: list[str], least: float, size: float = 0.05) -> DataFrame:
    """frame, a, b, iou of pairs whose overlap over union is at least `least`."""
    return box_pairs(boxes, frame, size).select(*frame, "a", "b", box_iou(F.col("box_a"), F.col("box_b")).alias("iou")).where(F.col("iou") >= least)


def association_pairs(boxes: DataFrame, frame: list[str], least: float, reach: float, size: float = 0.05) -> DataFrame:
    """frame, a, b, iou, distance of pairs that overlap by at least `least` or whose centres are within reach."""
    x, y = (lambda b: (b["x1"] + b["x2"]) / 2), (lambda b: (b["y1"] + b["y2"]) / 2)
    a, b = F.col("box_a"), F.col("box_b")
    # Cells are met within half the reach on each side, so no pair of near centres is missed.
    met = box_pairs(boxes, frame, size, reach / 2).select(*frame, "a", "b", box_iou(a, b).alias("iou"), F.sqrt(F.pow(x(a) - x(b), 2) + F.pow(y(a) - y(b), 2)).alias("distance"))
    return met.where((F.col("iou") >= least) | (F.col("distance") <= reach))


def segment(images: DataFrame, segmenter, schema: str, prompt: str | None = None) -> DataFrame:
    """Instances that a caller's segmenter finds in images: a function of a pandas table of images and a prompt that gives a table of the schema.

    It runs over Arrow batches where the images lie; anything that it loads should be held by itself
    between calls, as a worker process sees many batches.
    """

    def run(batches):
        for pdf in batches:
            yield segmenter(pdf, prompt)

    return images.mapInPandas(run, schema)


def mask_overlaps(left: DataFrame, right: DataFrame, frame: list[str]) -> DataFrame:
    """frame, a, b, iou of instances of two sets of masks that share a cell. A mask is a long table: frame, id, cell."""
    l, r = left.select(*frame, F.col("id").alias("a"), "cell").distinct(), right.select(*frame, F.col("id").alias("b"), "cell").distinct()
    both = l.join(r, [*frame, "cell"]).groupBy(*frame, "a", "b").agg(F.count("*").alias("n"))
    size = lambda m, k: m.groupBy(*frame, k).agg(F.count("*").alias(f"n_{k}"))
    return both.join(size(l, "a"), [*frame, "a"]).join(size(r, "b"), [*frame, "b"]).select(*frame, "a", "b", (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("iou"))


def unclaimed(instances: DataFrame, claimed: DataFrame, frame: list[str], most: float) -> DataFrame:
    """Masks (frame, id, cell) of instances that overlap no claimed one by more than `most`."""
    hit = mask_overlaps(instances, claimed, frame).where(F.col("iou") > most).select(*frame, F.col("a").alias("id")).distinct()
    return instances.join(hit, [*frame, "id"], "left_anti")


def merge_by_feature(nodes: DataFrame, node: str, feature: str) -> DataFrame:
    """node, entity: nodes that share an external feature's id are one entity, named by its smallest node; others are their own. A node of several features joins them."""
    from weft.operators.graph import components

    known = nodes.where(f"{node} is not null").select(F.col(node).alias("node"), F.col(feature).alias("feature")).distinct()
    # A star for each feature: each node with the feature's smallest.
    least = known.where("feature is not null").groupBy("feature").agg(F.min("node").alias("src"))
    stars = known.join(least, "feature").where("node <> src").select("src", F.col("node").alias("dst")).distinct()
    return components(known.select("node").distinct(), stars).select(F.col("node").alias(node), F.col("component").alias("entity"))


def adjacency(boxes: DataFrame, frame: list[str], reach: float = 0.05) -> DataFrame:
    """frame, a, b, distance, weight of pairs whose centres are within reach; weight falls from 1 to 0."""
    x, y = (F.col("box.x1") + F.col("box.x2")) / 2, (F.col("box.y1") + F.col("box.y2")) / 2
    centres = boxes.select(*frame, "id", F.struct(x.alias("x1"), y.alias("y1"), x.alias("x2"), y.alias("y2")).alias("box"))
    d = F.sqrt(F.pow(F.col("box_a.x1") - F.col("box_b.x1"), 2) + F.pow(F.col("box_a.y1") - F.col("box_b.y1"), 2))
    return box_pairs(centres, frame, 4 * reach, reach).select(*frame, "a", "b", d.alias("distance")).where(F.col("distance") <= reach).withColumn("weight", F.greatest(F.lit(0.0), 1 - F.col("distance") / reach))


def cluster_claims(claims: DataFrame, frame: list[str], iou: float = 0.5) -> DataFrame:
    """frame, claim_id, cluster: each claim, by area from the largest, joins the anchor it overlaps most (more than iou) or becomes one.

    The result depends on the order, so a frame (one tile or scene, of bounded size) is one worker's.
    """
    key_types = dict(claims.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["area", "claim_id"], ascending=[False, True])
        anchors, names, out = [], [], []
        for row in pdf.itertuples(index=False):
            b, best, at = row.box, iou, -1
            for n, a in enumerate(anchors):
                w, h = min(b["x2"], a["x2"]) - max(b["x1"], a["x1"]), min(b["y2"], a["y2"]) - max(b["y1"], a["y1"])
                if w > 0 and h > 0:
                    both = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) + (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) - w * h
                    if both > 0 and w * h / both > best:
                        best, at = w * h / both, n
            if at < 0:
                anchors.append(b), names.append(row.claim_id)
                at = len(anchors) - 1
            out.append(names[at])
        return pdf[[*frame, "claim_id"]].assign(cluster=out)

    return claims.groupBy(*frame).applyInPandas(run, ", ".join(f"{k} {key_types[k]}" for k in [*frame, "claim_id"]) + f", cluster {key_types['claim_id']}")


def representative(rows: DataFrame, keys: list[str], area: str, item: str) -> DataFrame:
    """keys, item, area of the largest region of each cluster."""
    return argmax(rows, keys, area, item)


def temporal_links(rows: DataFrame, entity: str, order: list[str], scene: str) -> DataFrame:
    """entity, a_scene, b_scene of consecutive observations of an entity in different scenes."""
    w = Window.partitionBy(entity).orderBy(*order)
    return rows.withColumn("a_scene", F.lag(scene).over(w)).where(F.col("a_scene").isNotNull() & (F.col("a_scene") != F.col(scene))).select(entity, "a_scene", F.col(scene).alias("b_scene"))


def category_distances(taxonomy: DataFrame) -> DataFrame:
    """a, b, d: 0 for the same category, 0.5 within a super-class, else 1. The taxonomy is a small dimension."""
    a, b = (taxonomy.select(F.col("cat").alias(s), F.col("super").alias(f"s{s}")) for s in "ab")
    d = F.when(F.col("a") == F.col("b"), 0.0).when(F.col("sa") == F.col("sb"), 0.5).otherwise(1.0)
    return a.crossJoin(dimension(b)).select("a", "b", d.alias("d"))


def capped_degree(edges: DataFrame, cap: int) -> DataFrame:
    """Edges that are among the `cap` heaviest of both their ends; ties by the other end. Order-free, unlike a greedy cap."""
    rank = lambda own, other: F.row_number().over(Window.partitionBy("frame", own).orderBy(F.desc("weight"), other))
    ways = edges.select("frame", "a", "b", "weight").unionByName(edges.select("frame", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    top = ways.withColumn("r", rank("a", "b")).where(F.col("r") <= cap)
    return top.select("frame", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("frame", "a", "b", "weight").count().where("count = 2").drop("count")


def _states_and_costs(unary: DataFrame, table: DataFrame) -> tuple[list, np.ndarray]:
    """The states in order, at most MOST_STATES, and the costs between them; pairs that the table lacks cost one."""
    states = sorted(r[0] for r in unary.select("state").distinct().limit(MOST_STATES + 1).collect())
    if len(states) > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} states")
    at, cost = {s: i for i, s in enumerate(states)}, np.ones((len(states), len(states)))
    for r in table.where(F.col("s").isin(states) & F.col("t").isin(states)).collect():
        cost[at[r.s], at[r.t]] = r.cost
    return states, cost


#: Bytes of factors that a worker holds for the pairs of one batch; beyond, they are worked out anew in each round.
FACTOR_BYTES = 256_000_000


def _factors(weight: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """exp(-weight * cost) of each pair, both ways, if they are few and none is so small that it may vanish."""
    if len(weight) * cost.size * 16 > FACTOR_BYTES or not len(weight) or float(np.abs(weight).max() * np.abs(cost).max()) > 300:
        return None
    there = np.exp(-weight[:, None, None] * cost)
    return there, there.transpose(0, 2, 1)


def _new_messages(at_a, at_b, to_b, to_a, weight, cost, damping, factors=None):
    """Messages of each pair after one round, and by how much they moved: from the beliefs at both ends without what came back from the other."""
    out, moved = [], np.zeros(len(weight))
    for way, (belief, back, old, potential) in enumerate(((at_a, to_a, to_b, cost), (at_b, to_b, to_a, cost.T))):
        told = belief - back
        new = np.empty_like(old)
        for i in range(0, len(weight), 4_096):
            part = slice(i, i + 4_096)
            if factors is not None:
                top = told[part].max(1, keepdims=True)
                y = np.log(np.matmul(np.exp(told[part] - top)[:, None, :], factors[way][part])[:, 0]) + top
            else:
                x = told[part, :, None] - weight[part, None, None] * potential
                peak = x.max(1, keepdims=True)
                y = np.log(np.exp(x - peak).sum(1)) + peak[:, 0]
            y = damping * old[part] + (1 - damping) * (y - _log_total(y))
            new[part] = y - _log_total(y)
        moved = np.maximum(moved, np.abs(new - old).max(1, initial=0))
        out.append(new)
    return out[0], out[1], moved


#: Variables of one frame whose messages one worker may pass; larger frames go through tables.
FRAME_VARIABLES = 20_000


def belief_propagation_in_frames(unary: DataFrame, pairs: DataFrame, table: DataFrame, rounds: int = 30, damping: float = 0.5, tol: float = 1e-4, most: int = FRAME_VARIABLES) -> DataFrame:
    """var, state, p, as belief_propagation() gives it, where pairs lie within frames: one shuffle brings a frame's variables and pairs together, and its rounds are one task's.

    unary: frame, var, state, x; pairs: frame, a, b, weight. A frame's rounds end when none of its own messages
    moves by more than tol. Frames of more than `most` variables, and variables without a frame, go
    through belief_propagation(). Pairs of unknown variables, self-pairs and pairs of two frames say nothing.
    """
    from weft.operators.grouped import large_groups, map_groups

    states, cost = _states_and_costs(unary, table)
    k = len(states)
    if not k:
        return unary.select("var", "state", F.lit(0.0).alias("p")).where(F.lit(False))
    own = keep(unary.groupBy("frame", "var").agg(F.array(*(F.coalesce(F.max(F.when(F.col("state") == s, F.col("x"))), F.lit(float("-inf"))) for s in states)).alias("x")))
    large = keep(large_groups(own.where("frame is not null"), "frame", most))
    some = not large.isEmpty()
    inside = own.where("frame is not null").join(large.select("frame"), "frame", "left_anti") if some else own.where("frame is not null")
    none = F.lit(None)
    rows = inside.select(F.col("frame").cast("string").alias("frame"), F.col("var").alias("a"), none.cast("string").alias("b"), "x", none.cast("double").alias("weight")).unionByName(
        pairs.where("a <> b").select(F.col("frame").cast("string").alias("frame"), "a", "b", none.cast("array<double>").alias("x"), F.col("weight").cast("double").alias("weight"))
    )

    def run(part, starts):
        names, others = (part.column(c).to_numpy() for c in ("a", "b"))
        x, known = part.column("x").combine_chunks(), part.column("b").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        frame = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        at, link = np.flatnonzero(known), np.flatnonzero(~known)
        if not len(at):
            return {"var": [], "p": [], "late": []}
        codes = pd.factorize(np.concatenate([names, others[link]]))[0].astype("int64")
        wide = codes.max() + 1
        keys = frame[at] * wide + codes[at]
        order = np.argsort(keys, kind="stable")

        def place(wanted):
            """Number of the variable of each frame and name, -1 if there is none."""
            pos = np.minimum(np.searchsorted(keys[order], wanted), len(order) - 1)
            return np.where(keys[order[pos]] == wanted, order[pos], -1)

        a, b = place(frame[link] * wide + codes[link]), place(frame[link] * wide + codes[len(names) :])
        good = (a >= 0) & (b >= 0) & (a != b)
        a, b, w, of = a[good], b[good], part.column("weight").to_numpy()[link][good], frame[link][good]
        base = x.take(at).flatten().to_numpy().reshape(-1, k)
        belief, late, mine = base.copy(), np.zeros(len(starts) - 1, bool), frame[at]
        to_b = to_a = np.full((len(w), k), -np.log(k))
        factors = _factors(w, cost)
        # All frames of the batch go together; a frame whose messages rest is left as it is.
        for turn in range(rounds):
            if not len(w):
                break
            to_b, to_a, moved = _new_messages(belief[a], belief[b], to_b, to_a, w, cost, damping, factors)
            most_moved = np.zeros(len(late))
            np.maximum.at(most_moved, of, moved)
            active = np.zeros(len(late), bool)
            active[of] = True
            touched = active[mine]
            belief[touched] = base[touched]
            np.add.at(belief, b, to_b), np.add.at(belief, a, to_a)
            go_on = most_moved[of] >= tol
            late = most_moved >= tol if turn == rounds - 1 else late
            if not go_on.all():
                a, b, w, of, to_b, to_a = (v[go_on] for v in (a, b, w, of, to_b, to_a))
                factors = factors and tuple(f[go_on] for f in factors)
        share = np.exp(belief - belief.max(1, keepdims=True))
        return {"var": names[at], "p": list(share / share.sum(1, keepdims=True)), "late": late[mine]}

    solved = keep(map_groups(rows, "frame", ["a"], run, "var string, p array<double>, late boolean"))
    left = solved.where("late").count()
    if left:
        warnings.warn(f"belief_propagation_in_frames: messages to {left} variables still move by {tol:.0e} or more after {rounds} rounds", RuntimeWarning, stacklevel=2)
    found = solved.select("var", F.explode(F.arrays_zip(F.array(*map(F.lit, states)).alias("state"), F.col("p").alias("p"))).alias("e")).select("var", "e.state", "e.p").where("p > 0")
    rest = unary.where("frame is null") if not some else unary.join(large.select("frame"), "frame", "left_semi").unionByName(unary.where("frame is null"), allowMissingColumns=True)
    if not some and rest.isEmpty():
        return found
    known = pairs.where("a <> b").join(large.select("frame"), "frame", "left_semi").select("a", "b", "weight")
    return found.unionByName(belief_propagation(rest.select("var", "state", "x"), known, table, rounds, damping, tol))


def belief_propagation(unary: DataFrame, pairs: DataFrame, table: DataFrame, rounds: int = 30, damping: float = 0.5, tol: float = 1e-4) -> DataFrame:
    """var, state, p: marginals by loopy sum-product in logs, all messages at once, damped.

    unary: var, state, x (log potentials; a state that a variable lacks is impossible for it);
    pairs: a, b, weight (a < b); table: s, t, cost, the pair potential being -weight * cost. A pair is
    one row with its two messages as arrays over the states, which are a dimension of at most
    MOST_STATES; a round is one aggregation by variable and a join for each end, and rounds end when
    no message moves by more than tol. It warns if they still do after the last.
    """
    states, cost = _states_and_costs(unary, table)
    k = len(states)
    own = keep(unary.groupBy("var").agg(F.array(*(F.coalesce(F.max(F.when(F.col("state") == s, F.col("x"))), F.lit(float("-inf"))) for s in states)).alias("x")))
    flat = F.array(*(F.lit(-float(np.log(max(1, k)))) for _ in states))
    message = keep(pairs.select("a", "b", F.col("weight").cast("double").alias("weight"), flat.alias("to_b"), flat.alias("to_a"), F.lit(0.0).alias("moved")))

    @F.pandas_udf("struct<to_b:array<double>,to_a:array<double>,moved:double>")
    def exchange(at_a: pd.Series, at_b: pd.Series, to_b: pd.Series, to_a: pd.Series, weight: pd.Series) -> pd.DataFrame:
        a, b, mb, ma = (np.stack(c.to_list()) if len(c) else np.zeros((0, k)) for c in (at_a, at_b, to_b, to_a))
        new_b, new_a, moved = _new_messages(a, b, mb, ma, weight.to_numpy(), cost, damping)
        return pd.DataFrame({"to_b": list(new_b), "to_a": list(new_a), "moved": moved})

    def beliefs(m: DataFrame) -> DataFrame:
        heard = m.select(F.col("b").alias("var"), F.col("to_b").alias("m")).unionByName(m.select(F.col("a").alias("var"), F.col("to_a").alias("m")))
        sums = heard.groupBy("var").agg(F.array(*(F.sum(F.col("m")[i]) for i in range(k))).alias("m"))
        return own.join(sums, "var", "left").select("var", F.when(F.col("m").isNull(), F.col("x")).otherwise(F.zip_with("x", "m", lambda x, y: x + y)).alias("x"))

    delta = float("inf")
    for _ in range(rounds):
        now = beliefs(message)
        a, b = (now.select(F.col("var").alias(s), F.col("x").alias(f"at_{s}")) for s in "ab")
        told = message.join(a, "a").join(b, "b").select("a", "b", "weight", exchange("at_a", "at_b", "to_b", "to_a", "weight").alias("n"))
        step = keep(told.select("a", "b", "weight", "n.to_b", "n.to_a", "n.moved"))
        forget(message)
        message = step
        delta = message.agg(F.max("moved")).first()[0]
        if delta is None or delta < tol:
            break
    else:
        warnings.warn(f"belief_propagation: messages still move by up to {delta:.1e} (tol {tol:.0e}) after {rounds} rounds", RuntimeWarning, stacklevel=2)
    each = beliefs(message).select("var", F.explode(F.arrays_zip(F.array(*map(F.lit, states)).alias("state"), F.col("x").alias("x"))).alias("e")).select("var", "e.state", "e.x")
    return softmax(each.where(F.col("x") > float("-inf")), ["var"], "x").select("var", "state", "p")


def _log_total(y: np.ndarray) -> np.ndarray:
    top = y.max(1, keepdims=True)
    return np.log(np.exp(y - top).sum(1, keepdims=True)) + top


def fit_sources(claims: DataFrame, prior: DataFrame, categories: DataFrame, key: str, rounds: int = 10, alpha: float = 10.0, step: float = 0.5) -> tuple[dict[str, float], DataFrame]:
    """Weights of sources on the simplex, and refitted confusion, by expectation maximisation.

    Each round: posteriors of every group under the present weights; the gradient of the expected
    log likelihood in each source's weight, one number for each source and so bounded, moved
    multiplicatively (which stays on the simplex); confusion refitted from soft counts. It warns if
    weights still move by 1e-5 or more in the last round.
    """
    from weft.operators.stats import dirichlet_refit

    spark = claims.sparkSession
    sources = sorted(r[0] for r in prior.select("source").distinct().collect())
    lam = {s: 1.0 / len(sources) for s in sources}
    q, moved = prior, float("inf")
    for _ in range(rounds):
        weights = spark.createDataFrame(list(lam.items()), "source string, lam double")
        soft = keep(posteriors(claims, q, weights, [key], categories).select(key, "cat", "p"))
        said = claims.select(key, F.col("source_id").alias("source"), F.col("native_label").alias("label"), "score").join(q, ["source", "label"]).join(soft, [key, "cat"])
        evidence = F.col("score") * F.ln(F.greatest(F.col("q"), F.lit(1e-12)))
        # The soft target is the posterior sharpened by its own argmax, else the gradient would vanish.
        best = argmax(soft, [key], "p", "cat").select(key, F.col("cat").alias("best"))
        grad = said.join(best, key).groupBy("source").agg(F.avg(F.when(F.col("cat") == F.col("best"), evidence).otherwise(0.0) - F.col("p") * evidence).alias("g")).collect()
        raw = {s: lam[s] * 2.718281828459045 ** (step * next((r.g for r in grad if r.source == s), 0.0)) for s in sources}
        total = sum(raw.values())
        moved = max(abs(raw[s] / total - lam[s]) for s in sources)
        lam = {s: raw[s] / total for s in sources}
        counts = said.groupBy("source", "label", "cat").agg(F.sum(F.col("p") * F.col("score")).alias("n"))
        q = keep(dirichlet_refit(prior, counts, alpha))
        if moved < 1e-5:
            break
    else:
        warnings.warn(f"fit_sources: weights still move by up to {moved:.1e} (tol 1e-05) after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return lam, q


def prompts_until_stable(start: DataFrame, detect, key: str, rounds: int = 10, tol: float = 1e-2) -> tuple[DataFrame, int]:
    """Label shares of each key after repeating detection with the labels found last, until no key's shares move by more than tol.

    start: key, label, p. detect takes such a table (what to look for) and returns key, label, confidence;
    it's the caller's, usually a pandas UDF around a model. Returns the shares and the rounds made.
    """
    from weft.operators.stats import label_distribution

    now = keep(start.select(key, "label", "p"))
    for n in range(1, rounds + 1):
        new = keep(label_distribution(detect(now), key, "label", F.col("confidence")))
        moved = now.withColumnRenamed("p", "p0").join(new, [key, "label"], "full").agg(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("p0", F.lit(0.0))))).first()[0]
        forget(now)
        now = new
        if moved is None or moved <= tol:
            return now, n
    return now, rounds
