"""Groups of everything that is linked, directly or through others.

Union-find runs within partitions of the edges as they lie, so that a hub's edges
never have to meet; each partition keeps only its spanning forest, as stars (node,
root) with the smallest member as root. Forests are merged through ever fewer
partitions, each of a bounded number of rows, keyed by node so that a node's roots
meet. Where all forests together fit the bound, the last merge is one partition. Where
they don't, the number of partitions stops shrinking and merging goes on by exchange:
roots are looked up in one another (pointer jumping) and merged again until no root
is any other's child. The driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.sources.tables import forget, keep

#: Rows of edges or forests in one partition; about 200 bytes of a Python worker each.
PARTITION_ROWS = 1_000_000
#: Forests merged into one at each level.
FAN_IN = 8
#: Keys that the members of one root are spread over when roots are looked up.
SALTS = 8

_STAR = "node string, root string"


class UnionFind:
    """Disjoint sets of strings, rooted at the smallest member."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.parent: list[int] = []

    def _slot(self, name: str) -> int:
        at = self.number.get(name)
        if at is None:
            at = self.number[name] = len(self.names)
            self.names.append(name)
            self.parent.append(at)
        return at

    def find(self, at: int) -> int:
        parent = self.parent
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    def union(self, a: str, b: str) -> None:
        x, y = self.find(self._slot(a)), self.find(self._slot(b))
        if x != y:
            if self.names[x] > self.names[y]:
                x, y = y, x
            self.parent[y] = x

    def stars(self):
        """node, root of every member that isn't its set's root."""
        for at, name in enumerate(self.names):
            root = self.find(at)
            if root != at:
                yield name, self.names[root]


def _forest_of(bound: int):
    """Stars of the union-find over a partition; beyond the bound of nodes the forest so far is handed on and a new one begun."""

    def stars(sets: UnionFind):
        import pyarrow as pa

        names, roots = [], []
        for node, root in sets.stars():
            names.append(node), roots.append(root)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(roots, pa.string())], names=["node", "root"])

    def run(batches):
        sets = UnionFind()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets.union(a, b)
            if len(sets.names) > bound:
                yield stars(sets)
                sets = UnionFind()
        yield stars(sets)

    return run


def _exchange(forest: DataFrame, parts: int, run) -> DataFrame:
    """Merging by pointer jumping, for forests too large for one partition. Exact; ends when each node has one root that is nobody's child."""
    while True:
        merged = keep(forest.repartition(parts, "node").mapInArrow(run, _STAR).distinct())
        # A giant group's root is one key for all its members: they are spread over several.
        salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
        up = merged.groupBy(F.col("node").alias("root")).agg(F.min("root").alias("above")).select("root", "above", salts)
        salted = merged.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        jumped = keep(salted.join(up, ["root", "salt"], "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        left = jumped.agg(F.count(F.when(F.col("moved"), 1)).alias("moved"), F.count("*").alias("rows"), F.countDistinct("node").alias("nodes")).first()
        forget(forest)
        # A node's other roots have to stay linked after the jump: each is kept as a row of its own.
        links = merged.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.collect_set("root").alias("roots")).where("low < high")
        extra = links.select("low", F.explode("roots").alias("other")).where("other > low").select(F.col("other").alias("node"), F.col("low").alias("root"))
        if left["moved"] == 0 and left["rows"] == left["nodes"]:
            forget(merged)
            return jumped.select("node", "root")
        forest = keep(jumped.select("node", "root").unionByName(extra).unionByName(merged).distinct())
        forget(merged), forget(jumped)


def linked_groups(pairs: DataFrame, a: str = "a", b: str = "b", partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """node, group_id of every node in a group of two or more; group_id is the group's smallest node in string order.

    Defined cases: rows with a null on either side and self-pairs link nothing; direction and
    repeats don't matter; an empty table gives no rows; other columns are not read.
    """
    edges = keep(pairs.select(F.col(a).cast("string").alias("node"), F.col(b).cast("string").alias("root")).where("node <> root"))
    parts = edges.rdd.getNumPartitions()
    forest = keep(edges.mapInArrow(_forest_of(partition_rows), _STAR))
    forget(edges)
    merged = parts <= 1 and forest.count() <= partition_rows
    while not merged:
        rows = forest.count()
        least = max(1, -(-rows // partition_rows))
        if least > 1 and least > parts // FAN_IN:
            forest = _exchange(forest, least, _forest_of(4 * partition_rows))
            break
        parts = max(least, parts // FAN_IN)
        # All of a partition's rows must meet: its bound is the two nodes that each row can bring.
        smaller = keep(forest.repartition(parts, "node").mapInArrow(_forest_of(2 * rows), _STAR))
        forget(forest)
        forest, merged = smaller, parts == 1
    return forest.select("node", F.col("root").alias("group_id")).unionByName(forest.select(F.col("root").alias("node"), F.col("root").alias("group_id")).distinct())


def tidy_id(column: Column) -> Column:
    """Lower case without surrounding blanks of any kind; blank ids are null."""
    plain = F.regexp_replace(F.lower(column.cast("string")), r"^[\s ​﻿]+|[\s ​﻿]+$", "")
    return F.when(plain != "", plain)


#: Side of the cells that boxes are looked up in; several times the tolerance, so that most boxes are in one.
_CELL = 0.008


def _corners(box: Column) -> Column:
    x1, y1, x2, y2 = (box[k] for k in ("x1", "y1", "x2", "y2"))
    return F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"))


def _cell_key(scene: Column, x: Column, y: Column) -> Column:
    return F.concat_ws(":", F.lit("b"), scene.cast("string"), F.floor(x / _CELL).cast("string"), F.floor(y / _CELL).cast("string"))


def resolve_pairs(matches: DataFrame, nodes: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """a, b: the node ids on both sides of each positive match that leads to a node on both.

    A side with an id is that node; one without is every node of its scene whose box agrees
    within the tolerance in each coordinate, corner order aside. Both look-ups are one equi
    join: a node is filed under its id and under the one to four cells its box's first
    corner may be written in, so that no scene is searched node by node.
    """
    box = _corners(F.col("bbox"))
    known = nodes.select(tidy_id(F.col("node_id")).alias("nid"), F.col("sg_idx").alias("sg"), box.alias("box")).where("nid is not null").distinct()
    x, y, t = F.col("box.x1"), F.col("box.y1"), tolerance * 1.001
    cells = F.array_distinct(F.array(*(_cell_key(F.col("sg"), x + dx, y + dy) for dx in (-t, t) for dy in (-t, t))))
    by_box = F.when(F.col("sg").isNotNull() & x.isNotNull() & y.isNotNull() & F.col("box.x2").isNotNull(), cells).otherwise(F.array().cast("array<string>"))
    by_id = known.select("nid").distinct().select(F.concat(F.lit("i:"), "nid").alias("key"), "nid", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>").alias("box"))
    filed = keep(by_id.unionByName(known.select(F.explode(by_box).alias("key"), "nid", "box")))

    def key(side: str) -> Column:
        own, b = tidy_id(F.col(f"node_{side}")), _corners(F.col(f"bbox_{side}"))
        return F.when(own.isNotNull(), F.concat(F.lit("i:"), own)).when(F.col(f"sg_{side}").isNotNull() & b["x1"].isNotNull(), _cell_key(F.col(f"sg_{side}"), b["x1"], b["y1"]))

    def side(df: DataFrame, s: str) -> DataFrame:
        near = F.lit(True)
        for c in ("x1", "y1", "x2", "y2"):
            near = near & (F.abs(F.col(f"box_{s}")[c] - F.col("box")[c]) <= tolerance)
        good = F.col("box").isNull() | near
        return df.join(filed.withColumnRenamed("key", f"key_{s}"), f"key_{s}").where(good).withColumnRenamed("nid", s).drop("box", f"key_{s}", f"box_{s}")

    sides = matches.where("matched").select(key("a").alias("key_a"), _corners(F.col("bbox_a")).alias("box_a"), key("b").alias("key_b"), _corners(F.col("bbox_b")).alias("box_b")).where("key_a is not null and key_b is not null")
    return side(side(sides, "a"), "b").select("a", "b")
