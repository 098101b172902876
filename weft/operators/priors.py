"""What outside maps say about the class of an entity: factors of a factor graph.

A source is a function of an entities table (var, lon, lat, base_alt, parent) that returns
factors: source, var, other (null for a factor of one variable), cat, other_cat, bonus, a
log-likelihood added where var is cat (and other is other_cat). A stack is a list of
sources; their factors are one union, added to log potentials by apply().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.geodesy import DEGREE_M
from weft.functions.shapes import segment_distance
from weft.operators import spatial
from weft.operators.sets import stack

Source = Callable[[DataFrame], DataFrame]

# Classes of the default sources, and which of a parent and a child go together or don't.
ROAD_CLASSES = ("road", "pavement", "vehicle")
GROUND_CLASSES = ("road", "pavement", "bare_ground", "water", "vegetation_other")
RAISED_CLASSES = ("building", "tree", "vehicle")
TOGETHER = (("tree", "tree"), ("tree", "vegetation_other"), ("building", "vehicle"), ("building", "building"), ("road", "vehicle"), ("road", "pavement"), ("pavement", "pavement"), ("vegetation_other", "vegetation_other"))
APART = (("water", "building"), ("water", "vehicle"), ("water", "tree"), ("building", "tree"), ("road", "tree"), ("road", "building"))


def _factors(rows: DataFrame, source: str, cats: tuple[str, ...] | Column, bonus: float) -> DataFrame:
    cat = cats if isinstance(cats, Column) else F.explode(F.array(*map(F.lit, cats)))
    none = F.lit(None).cast("string")
    return rows.select(F.lit(source).alias("source"), "var", none.alias("other"), cat.alias("cat"), none.alias("other_cat"), F.lit(float(bonus)).alias("bonus"))


def _placed(entities: DataFrame) -> DataFrame:
    return entities.where("lon is not null and lat is not null")


def buildings(footprints: DataFrame, cat: str = "building", bonus: float = 1.5) -> Source:
    """Entities inside a footprint (zone_id, geo_bbox, geo_polygon) are rather of a class; once each, however many footprints hold them."""

    def source(entities: DataFrame) -> DataFrame:
        at = _placed(entities).select(F.col("var").alias("id"), "lat", "lon")
        held = spatial.near_and_inside(at, spatial.zone_shapes(footprints), 0.01).where("kind = 'inside'")
        return _factors(held.select(F.col("left_id").alias("var")).distinct(), "buildings", (cat,), bonus)

    return source


def roads(segments: DataFrame, cats: tuple[str, ...] = ROAD_CLASSES, reach_m: float = 5.0, bonus: float = 1.0) -> Source:
    """Entities within reach of a segment (segment, lon1, lat1, lon2, lat2) are rather of the road's classes.

    Distances are in the plane around each entity. Segments are filed in all cells of latitude
    and longitude that they may be near to; long ones should be cut beforehand.
    """

    def source(entities: DataFrame) -> DataFrame:
        cell = max(8 * reach_m / DEGREE_M, 1e-4)
        pad = reach_m / DEGREE_M * 1.001
        steepest = F.greatest(F.abs("lat1"), F.abs("lat2")) + pad
        wide = F.lit(pad) / F.greatest(F.cos(F.radians(steepest)), F.lit(0.01))
        span = lambda a, b, p: F.sequence(F.floor((F.least(a, b) - p) / cell), F.floor((F.greatest(a, b) + p) / cell))
        filed = segments.withColumn("cx", F.explode(span(F.col("lon1"), F.col("lon2"), wide))).withColumn("cy", F.explode(span(F.col("lat1"), F.col("lat2"), F.lit(pad))))
        at = _placed(entities).select("var", "lon", "lat", F.floor(F.col("lon") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
        met = at.join(filed, ["cx", "cy"])
        kx = F.cos(F.radians("lat")) * DEGREE_M
        ax, ay, bx, by = (F.col("lon1") - F.col("lon")) * kx, (F.col("lat1") - F.col("lat")) * DEGREE_M, (F.col("lon2") - F.col("lon")) * kx, (F.col("lat2") - F.col("lat")) * DEGREE_M
        near = met.where(segment_distance(F.lit(0.0), F.lit(0.0), ax, ay, bx, by) <= reach_m)
        return _factors(near.select("var").distinct(), "roads", cats, bonus)

    return source


def _cell_of(box: tuple[float, float, float, float], rows: int, columns: int) -> tuple[Column, Column, Column]:
    """Whether an entity is on a raster over (west, south, east, north), and its row (0 the northernmost) and column; the far edges belong to the last ones."""
    west, south, east, north = box
    on = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    clip = lambda x, top: F.least(F.lit(top - 1), F.greatest(F.lit(0), F.floor(x).cast("int")))
    return on, clip((north - F.col("lat")) / (north - south) * rows, rows), clip((F.col("lon") - west) / (east - west) * columns, columns)


def land_cover(cells: DataFrame, box: tuple[float, float, float, float], rows: int, columns: int, classes: dict[int, str], bonus: float = 1.0) -> Source:
    """Entities on a raster (r, c, code) are rather of the class of their cell's code; codes without a class say nothing."""

    def source(entities: DataFrame) -> DataFrame:
        on, r, c = _cell_of(box, rows, columns)
        named = F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))[F.col("code")]
        met = _placed(entities).where(on).withColumns({"r": r, "c": c}).join(cells.select("r", "c", "code"), ["r", "c"]).withColumn("named", named)
        return _factors(met.where("named is not null"), "land_cover", F.col("named"), bonus)

    return source


def ground(cells: DataFrame, box: tuple[float, float, float, float], rows: int, columns: int, low: tuple[str, ...] = GROUND_CLASSES, high: tuple[str, ...] = RAISED_CLASSES, tolerance: float = 0.5, bonus: float = 1.0) -> Source:
    """Entities whose base is within tolerance of the terrain (r, c, z) are rather of the low classes, those above it of the high ones; those below get no factor."""

    def source(entities: DataFrame) -> DataFrame:
        on, r, c = _cell_of(box, rows, columns)
        met = _placed(entities).where(on & F.col("base_alt").isNotNull()).withColumns({"r": r, "c": c}).join(cells.select("r", "c", "z"), ["r", "c"]).withColumn("above", F.col("base_alt") - F.col("z"))
        return _factors(met.where(F.abs("above") <= tolerance), "ground", low, bonus).unionByName(_factors(met.where(F.col("above") > tolerance), "ground", high, bonus))

    return source


def parents(together: tuple = TOGETHER, apart: tuple = APART, bonus: float = 1.0, penalty: float = -1.5) -> Source:
    """For each entity whose parent is an entity too, pairs of classes that go together and that don't; var is the parent, other the child."""

    def source(entities: DataFrame) -> DataFrame:
        known = entities.select(F.col("var").alias("parent")).distinct()
        links = entities.where("parent is not null").select("parent", F.col("var").alias("child")).join(known, "parent", "left_semi")
        pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for group, w in ((together, bonus), (apart, penalty)) for p, c in group))).alias("e")
        return links.select("parent", "child", pairs).select(F.lit("parents").alias("source"), F.col("parent").alias("var"), F.col("child").alias("other"), F.col("e.p").alias("cat"), F.col("e.c").alias("other_cat"), F.col("e.w").alias("bonus"))

    return source


def factors(sources: list[Source], entities: DataFrame, categories: DataFrame) -> DataFrame:
    """Factors of all sources, of classes that are among the categories (cat)."""
    every = stack(*(s(entities) for s in sources))
    known = categories.select("cat").distinct()
    return every.join(known, "cat", "left_semi").join(known.select(F.col("cat").alias("other_cat")), "other_cat", "left_semi").unionByName(every.where("other is null").join(known, "cat", "left_semi")).select("source", "var", "other", "cat", "other_cat", "bonus")


def apply(unary: DataFrame, all_factors: DataFrame) -> DataFrame:
    """var, state, x: log potentials with the bonuses of the factors of one variable added; entities without factors keep theirs."""
    said = all_factors.where("other is null").groupBy("var", F.col("cat").alias("state")).agg(F.sum("bonus").alias("more"))
    return unary.join(said, ["var", "state"], "left").select("var", "state", (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("x"))


def pair_table(all_factors: DataFrame) -> DataFrame:
    """a, b, s, t, x: log potentials of pairs, summed over sources."""
    return all_factors.where("other is not null").groupBy(F.col("var").alias("a"), F.col("other").alias("b"), F.col("cat").alias("s"), F.col("other_cat").alias("t")).agg(F.sum("bonus").alias("x"))
