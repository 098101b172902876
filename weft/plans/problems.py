"""Queries for the general data-pipeline problems over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import grid, nested, spatial, spikes
from weft.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Every ring vertex of every region and claim, with its scene and node."""
    return nested.ring_vertices(nested.flatten_scenes(table(spark, root, "scene_raw")))


def p1_roots(spark: SparkSession, root: str) -> DataFrame:
    """Each arrival of a scene: the record, its place in it, and the scene's identity."""
    t = nested.flatten_scenes(table(spark, root, "scene_raw"))
    return t.roots.select("rec_id", "ordinal", F.lower(F.hex("oid")).alias("scene"))


def p1_bridge(spark: SparkSession, root: str) -> DataFrame:
    """Each occurrence of an object in a distinct parent: the parent's kind and identity, role, place and the child's identity."""
    t = nested.flatten_scenes(table(spark, root, "scene_raw"))
    name = lambda c: F.lower(F.hex(c)).alias(c.removesuffix("_oid"))
    kinds = [t.bridge(k).select(F.lit(k).alias("kind"), name("parent_oid"), "role", "ordinal", name("child_oid")) for k in ("scene", "node", "region", "claim")]
    return reduce(DataFrame.unionByName, kinds)


def p1_vertices(spark: SparkSession, root: str) -> DataFrame:
    """Each vertex of each distinct ring with its coordinates."""
    t = nested.flatten_scenes(table(spark, root, "scene_raw"))
    return t.vertices.select(F.lower(F.hex("oid")).alias("ring"), "vertex_no", "lon", "lat")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Nodes within 30 m of each other, and the survey zones that hold a node."""
    points = spatial.locate(table(spark, root, "scene_nodes"), "node_id", F.col("region.geo_bbox"), F.col("region.geo_polygon"))
    return spatial.near_and_inside(points, spatial.zone_shapes(table(spark, root, "survey_zones")), 30.0)


#: Stamps of this month are valid; others come from wrong clocks.
VALID = "timestamp >= timestamp_ntz'2031-03-03 00:00:00' and timestamp < timestamp_ntz'2031-03-31 00:00:00'"
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(timestamp as timestamp_ntz))"


def power_readings(spark: SparkSession, root: str, *monitor_columns: str) -> DataFrame:
    """Valid readings with columns of their monitors. The monitors are a dimension; Spark broadcasts it only under its threshold."""
    samples = table(spark, root, "power_samples").where(VALID).where("power_watts is not null and not isnan(power_watts)")
    monitors = table(spark, root, "power_monitors").groupBy("monitor_id").agg(*(F.min(c).alias(c) for c in monitor_columns))
    return samples.select("sample_id", "monitor_id", "session_id", F.expr(MICROS).alias("micros"), "power_watts").join(monitors, "monitor_id", "left")


def p4_grid(spark: SparkSession, root: str) -> DataFrame:
    """Each session on its monitor's grid: observed means exactly, gaps filled or marked."""
    readings = power_readings(spark, root, "interval_s").select(F.col("session_id").alias("source"), F.col("interval_s").alias("interval"), F.col("sample_id").alias("reading_id"), "micros", F.col("power_watts").alias("x"))
    return grid.regular_grid(readings).withColumnRenamed("source", "session_id")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Empty periods of each session."""
    return p4_grid(spark, root).where("state <> 'observed'").select("session_id", "period_start")


def p4_observed(spark: SparkSession, root: str) -> DataFrame:
    """Periods of each session that have readings, with their mean."""
    seen = p4_grid(spark, root).where("state = 'observed'")
    return seen.select("session_id", "period_start", (F.round("value", 5) + F.lit(0.0)).alias("value"))


def p5_flags(spark: SparkSession, root: str) -> DataFrame:
    """Implausible readings of power, speed and turn rate, with the reason."""
    power = power_readings(spark, root, "limit_watts").select(
        F.lit("power_samples").alias("src"), F.lit("power_watts").alias("field"), F.col("session_id").alias("source"), F.col("sample_id").alias("row_id"), F.col("micros").cast("double").alias("at"), F.col("power_watts").alias("x"),
        F.lit(0.0).alias("low"), F.col("limit_watts").alias("high"), F.lit(False).alias("zeros_rest"),
    )
    limits = table(spark, root, "rovers").groupBy("rover_id").agg(F.min("v_max").alias("v_max"), F.min("omega_max").alias("omega_max"))
    both = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("x"), F.col(f"{f}_max").alias("high")) for f in ("v", "omega")))).alias("r")
    states = table(spark, root, "rover_states").select("state_id", "rover_id", "run_id", "t", "v", "omega").join(limits, "rover_id", "left").select("state_id", "run_id", "t", both)
    rover = states.select(
        F.lit("rover_states").alias("src"), "r.field", F.col("run_id").alias("source"), F.col("state_id").alias("row_id"), F.col("t").alias("at"), "r.x",
        (-F.col("r.high")).alias("low"), "r.high", F.lit(True).alias("zeros_rest"),
    )
    return spikes.flag_spikes(power.unionByName(rover))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Implausible readings."""
    return p5_flags(spark, root).select("src", "row_id", "field")


QUERIES = {"p1_found": p1_found, "p1_roots": p1_roots, "p1_bridge": p1_bridge, "p1_vertices": p1_vertices, "p3_found": p3_found, "p4_found": p4_found, "p4_grid": p4_grid, "p4_observed": p4_observed, "p5_found": p5_found, "p5_flags": p5_flags}
SQL: dict[str, str] = {
    "p3_found": """
with b as (select node_id, region.geo_bbox g, region.geo_polygon p from scene_nodes),
l0 as (select node_id,
 case when g.west is not null and g.south is not null and g.east is not null and g.north is not null and not (g.west=0 and g.south=0 and g.east=0 and g.north=0) then (g.south+g.north)/2
  when len(p)>0 then (list_min(list_transform(p, lambda v: v.lat))+list_max(list_transform(p, lambda v: v.lat)))/2 end lat,
 case when g.west is not null and g.south is not null and g.east is not null and g.north is not null and not (g.west=0 and g.south=0 and g.east=0 and g.north=0) then (g.west+g.east)/2
  when len(p)>0 then (list_min(list_transform(p, lambda v: v.lon))+list_max(list_transform(p, lambda v: v.lon)))/2 end lon from b),
loc as (select distinct node_id, lat, lon, cast(floor(lat/0.0003) as bigint) r from l0 where lat is not null),
c as (select node_id, lat, lon, r+d.d r from loc, (values (-1),(0),(1)) d(d)),
near as (select a.node_id x, b.node_id y from loc a join c b on a.r=b.r and a.node_id<b.node_id and abs(a.lon-b.lon)<0.001
  where 2*6371000*asin(sqrt(least(1.0, pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))) <= 30),
z as (select distinct zone_id, geo_polygon p, geo_bbox g from survey_zones),
e as (select zone_id, p[i].lon x1, p[i].lat y1, p[i % len(p) + 1].lon x2, p[i % len(p) + 1].lat y2 from (select zone_id, p, unnest(range(1, len(p)+1)) i from z where len(p)>=3)),
poly as (select node_id, zone_id from loc join e on (y1>lat)<>(y2>lat) and lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 group by all having count(*)%2=1),
box as (select node_id, zone_id from loc, z where coalesce(len(p),0)<3 and not (g.west=0 and g.south=0 and g.east=0 and g.north=0) and lon between least(g.west,g.east) and greatest(g.west,g.east) and lat between least(g.south,g.north) and greatest(g.south,g.north))
select distinct 'near' kind, x left_id, y right_id from near union all select distinct 'inside', node_id, zone_id from (select * from poly union select * from box)
""",
    "p4_observed": """
with r as (select sample_id, session_id, interval_s i, cast(floor(epoch_us("timestamp") / (interval_s * 1000000.0)) as bigint) k, min(power_watts) x
  from power_samples join power_monitors using (monitor_id)
  where "timestamp" >= timestamp '2031-03-03' and "timestamp" < timestamp '2031-03-31' and power_watts is not null and not isnan(power_watts) and session_id is not null and interval_s > 0 group by all)
select session_id, cast(k * i as bigint) period_start, round(avg(x), 5) + 0.0 value from r group by session_id, i, k
""",
    "p4_found": """
with v as (select session_id, interval_s i, cast(floor(epoch_us("timestamp") / (interval_s * 1000000.0)) as bigint) k
  from power_samples join power_monitors using (monitor_id)
  where "timestamp" >= timestamp '2031-03-03' and "timestamp" < timestamp '2031-03-31' and power_watts is not null and not isnan(power_watts) and session_id is not null and interval_s > 0),
s as (select session_id, i, min(k) a, max(k) b from v group by all),
g as (select session_id, i, unnest(range(a, b + 1)) k from s)
select session_id, cast(k * i as bigint) period_start from g anti join v using (session_id, i, k)
""",
}
