"""More queries of the library's own operators, each with the DuckDB SQL it is compared with: joins by place, sets, series, columns and sources."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import coding, filters, geodesy, indices, information, modes, novelty, physics, shapes
from weft.operators import fusion, graph, kernels, maxcal, places, priors, raster, sets, stats, trajectory
from weft.plans.analytics import _boxes, _BOXES, _Q, _SMALL_GRID, _vectors, query, rounded
from weft.sources import files
from weft.sources.tables import keep, shared_folder, table

# ---- joins by place, over points that are a rule of the keys ----

_PTS = "p as (select p_partkey::bigint id, (p_partkey * 37 % 1000) / 10.0::double x, (p_partkey * 91 % 997) / 10.0::double y from part), s as (select s_suppkey::bigint id, (s_suppkey * 53 % 1000) / 10.0::double x, (s_suppkey * 29 % 1000) / 10.0::double y from supplier) "


def _parts(spark, root):
    return table(spark, root, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_partkey") * 37 % 1000 / 10.0).alias("x"), (F.col("p_partkey") * 91 % 997 / 10.0).alias("y"))


def _suppliers(spark, root):
    return table(spark, root, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), (F.col("s_suppkey") * 53 % 1000 / 10.0).alias("x"), (F.col("s_suppkey") * 29 % 1000 / 10.0).alias("y"))


@query(f"with {_PTS} select a.id a, b.id b, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) distance from p a, s b where sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 2.5")
def points_within(spark: SparkSession, root: str) -> DataFrame:
    return rounded(places.within(_parts(spark, root), _suppliers(spark, root), 2.5), 6, "distance")


@query(f"with {_PTS} select query, id, cast(r as int) rank, round(d, 6) distance from (select *, row_number() over (partition by query order by d, id) r from (select a.id query, b.id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) d from s a, p b where a.id <> b.id)) where r <= 4")
def nearest_points(spark: SparkSession, root: str) -> DataFrame:
    return rounded(places.nearest_in_plane(_suppliers(spark, root), _parts(spark, root), 4, 2.0), 6, "distance")


_SEGMENTS = "g as (select id segment, x x1, y y1, x + id % 7 - 3 x2, y + id % 5 - 2 y2 from s), d as (select p.id, segment, sqrt(power(x - x1 - t * (x2 - x1), 2) + power(y - y1 - t * (y2 - y1), 2)) d from (select p.*, g.*, case when power(x2 - x1, 2) + power(y2 - y1, 2) = 0 then 0 else least(1, greatest(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) end t from p, g) p) "


def _segment_table(spark, root):
    s = _suppliers(spark, root)
    return s.select(F.col("id").alias("segment"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("id") % 7 - 3).alias("x2"), (F.col("y") + F.col("id") % 5 - 2).alias("y2"))


@query(f"with {_PTS}, {_SEGMENTS} select id, segment, round(d, 5) distance from (select *, row_number() over (partition by id order by round(d, 9), segment) r from d where d <= 3) where r = 1")
def nearest_segments(spark: SparkSession, root: str) -> DataFrame:
    return rounded(places.nearest_segments(_parts(spark, root), _segment_table(spark, root), 3.0), 5, "distance")


@query(_SMALL_GRID + ", p as (select p_partkey id, (p_partkey * 37 % 1000) / 25.0::double lon, (p_partkey * 91 % 997) / 25.0::double lat from part) select id, lon, lat, round(z, 6) z from p join z on r = floor(40 - lat) and c = floor(lon)")
def raster_lookup(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 1000 / 25.0).alias("lon"), (F.col("p_partkey") * 91 % 997 / 25.0).alias("lat"))
    return rounded(places.raster_lookup(p, raster.valley_grid(spark, 40, 36), 0.0, 40.0, 1.0), 6, "z")


@query(f"with recursive {_PTS}, o as (select *, row_number() over (order by id) r from s), t(r, kept, id, x, y, taken) as (select 0::bigint, []::struct(x double, y double)[], null::bigint, null::double, null::double, false union all select o.r, case when ok then list_append(kept, {{'x': o.x, 'y': o.y}}) else kept end, o.id, o.x, o.y, ok from (select o.*, t.kept, len([1 for k in t.kept if sqrt(power(k.x - o.x, 2) + power(k.y - o.y, 2)) < 12]) = 0 ok from t join o on o.r = t.r + 1) o) select id, x, y from t where taken")
def thin_points(spark: SparkSession, root: str) -> DataFrame:
    return places.thin(_suppliers(spark, root), 12.0)


@query(f"with {_PTS}, m as (select a.id, b.id trait, row_number() over (partition by a.id order by sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.id) r from p a join s b on sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 4) select p.id, x, y, trait::double trait, trait is null imputed from p left join m on m.id = p.id and r = 1")
def matched_traits(spark: SparkSession, root: str) -> DataFrame:
    return places.match_traits(_parts(spark, root), _suppliers(spark, root), 4.0).withColumn("trait", F.col("trait").cast("double"))


_ROADS = "e as (select least(n_nationkey, (n_nationkey + 1) % 25)::bigint src, greatest(n_nationkey, (n_nationkey + 1) % 25)::bigint dst from nation union select n_nationkey, n_nationkey + 7 from nation where n_nationkey < 12), two as (select src i, dst j from e union all select dst, src from e)"


def _road_edges(spark, root):
    n = table(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    return graph.canonical(n.select(F.col("a").alias("src"), ((F.col("a") + 1) % 25).alias("dst")).unionByName(n.where("a < 12").select(F.col("a").alias("src"), (F.col("a") + 7).alias("dst"))))


@query(f"with recursive {_ROADS}, far(node, source, d) as (select n_nationkey::bigint, n_nationkey::bigint, 0 from nation union all select two.j, source, d + 1 from far join two on two.i = far.node where d < 3), way as (select node, source, min(d)::double d from far group by all), b as (select s_suppkey::bigint id, (s_suppkey % 25)::bigint node, sqrt(power(s_suppkey % 7 * 0.3::double, 2) + power(s_suppkey % 5 * 0.3::double, 2)) off from supplier), r as (select a.id query, b.id, d + a.off + b.off distance from way join b a on a.node = way.node join b on b.node = way.source where a.id <> b.id) select query, id, cast(k as int) rank, round(distance, 6) distance from (select *, row_number() over (partition by query order by round(distance, 9), id) k from r) where k <= 3")
def road_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The three suppliers nearest to each along roads between nations; places are rounded so that both engines break ties alike."""
    nodes = table(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 10.0).alias("x"), F.lit(0.0).alias("y"))
    homes = table(spark, root, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), (F.col("s_suppkey") % 25 * 10.0 + F.col("s_suppkey") % 7 * 0.3).alias("x"), (F.col("s_suppkey") % 5 * 0.3).alias("y"))
    return rounded(places.network_neighbours(homes, nodes, _road_edges(spark, root), 3, 3.0, 4.0, digits=9), 6, "distance")


_SOLIDS = [{"id": "ball", "centre": (20.0, 30.0, 0.0), "scale": (25.0, 25.0, 25.0), "shape": (1.0, 1.0)}, {"id": "egg", "centre": (60.0, 60.0, 5.0), "scale": (30.0, 20.0, 10.0), "shape": (1.0, 1.0)}]
_INSIDE = " + ".join(["power(({c} - {m}) / {s}, 2)"] * 3)
_BALL, _EGG = (_INSIDE.replace("{c}", "{}").replace("{m}", "{}").replace("{s}", "{}").format(*(v for c, m, h in zip("xyz", s["centre"], s["scale"]) for v in (c, m, h))) for s in _SOLIDS)
_CLOUD = "c as (select p_partkey id, (p_partkey * 37 % 1000) / 10.0::double x, (p_partkey * 91 % 997) / 10.0::double y, (p_partkey * 7 % 11 - 5)::double z, p_retailprice intensity from part) "


def _cloud(spark, root):
    k = F.col("p_partkey")
    return table(spark, root, "part").select(k.alias("id"), (k * 37 % 1000 / 10.0).alias("x"), (k * 91 % 997 / 10.0).alias("y"), (k * 7 % 11 - 5).cast("double").alias("z"), F.col("p_retailprice").alias("intensity"))


@query(f"with {_CLOUD} select id, case when {_BALL} <= 1 then 'ball' when {_EGG} <= 1 then 'egg' end solid from c")
def points_in_solids(spark: SparkSession, root: str) -> DataFrame:
    return places.in_solids(_cloud(spark, root), _SOLIDS).select("id", "solid")


@query(f"with {_CLOUD}, h as (select case when {_BALL} <= 1 then 'ball' when {_EGG} <= 1 then 'egg' end solid, intensity from c) select solid, count(*) n, round(avg(intensity), 4) mean, round(coalesce(stddev_samp(intensity), 0), 4) std, round(count(*) / (4 / 3.0::double * pi() * case solid when 'ball' then 15625 else 6000 end), 8) density from h where solid is not null group by solid")
def solid_summary(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rounded(places.solid_statistics(_cloud(spark, root), _SOLIDS), 4, "mean", "std"), 8, "density")


@query("""with r as (select s_suppkey id, -10.0::double ox, (s_suppkey * 29 % 100)::double oy, 0.5::double oz from supplier),
b as (select id, oy, 5.0::double lo_, 55.0::double hi_, oy >= 5 and oy <= 55 seen from r),
m as (select id, list_min([5 + 50.0 * k / 64 for k in range(0, 65) if power((5 + 50.0 * k / 64 - 10 - 20) / 25, 2) + power((oy - 30) / 25, 2) + power(0.5 / 25, 2) <= 1 + 1e-9]) t from b where seen)
select r.id, case when t is not null then 'ball' end solid, round(t, 6) t from r left join m using (id)""")
def ray_hits(spark: SparkSession, root: str) -> DataFrame:
    rays = table(spark, root, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(-10.0).alias("ox"), (F.col("s_suppkey") * 29 % 100).cast("double").alias("oy"), F.lit(0.5).alias("oz"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return rounded(places.first_hits(rays, _SOLIDS[:1]).select("id", "solid", "t"), 6, "t")


@query("select s_nationkey, s_suppkey, cast(r as int) rank from (select *, row_number() over (partition by s_nationkey order by case when s_suppkey % 10 = 0 then 0 else 1 end, s_acctbal desc, s_suppkey) r from supplier) where r <= 3")
def required_modes(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return places.required_modes(s, "s_nationkey", "s_suppkey", "s_acctbal", F.col("s_suppkey") % 10 == 0, 3).select("s_nationkey", "s_suppkey", "rank")


# ---- filters, sets and choices ----


@query("select p_partkey from part where p_retailprice / 2500 >= 0.5 and p_size * 10 >= 200")
def novelty_filter(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").where(novelty.worth_asking(F.col("p_retailprice") / 2500, F.col("p_size") * 10)).select("p_partkey")


_PLACED = "pl as (select distinct node_id, (region.geo_bbox.south + region.geo_bbox.north) / 2 lat, (region.geo_bbox.west + region.geo_bbox.east) / 2 lon, area from scene_nodes where node_id is not null and region.geo_bbox.west is not null and region.geo_bbox.south is not null and region.geo_bbox.east is not null and region.geo_bbox.north is not null) "


def _placed(spark, root):
    b = F.col("region.geo_bbox")
    return table(spark, root, "scene_nodes").where("node_id is not null and region.geo_bbox.west is not null and region.geo_bbox.south is not null and region.geo_bbox.east is not null and region.geo_bbox.north is not null").select("node_id", ((b["south"] + b["north"]) / 2).alias("lat"), ((b["west"] + b["east"]) / 2).alias("lon"), "area").distinct()


@query(f"with {_PLACED} select distinct node_id from pl where lat between -60 and 60 and area between 0.01 and 0.2")
def region_filter(spark: SparkSession, root: str) -> DataFrame:
    return _placed(spark, root).where(filters.in_region(F.col("lat"), F.col("lon"), F.col("area"), lats=(-60, 60), sizes=(0.01, 0.2))).select("node_id").distinct()


@query(f"with {_PTS} select id, x between 10 and 60.5 and y between 20 and 70 inside from p")
def box_test(spark: SparkSession, root: str) -> DataFrame:
    return _parts(spark, root).select("id", filters.in_box(F.col("x"), F.col("y"), (10, 20, 60.5, 70)).alias("inside"))


@query("with l as (select coalesce(tile_id, '<none>') t, count(*) load from scene_nodes group by 1) select distinct node_id, tile_id, load from scene_nodes join l on l.t = coalesce(tile_id, '<none>')")
def bucket_load(spark: SparkSession, root: str) -> DataFrame:
    return sets.bucket_load(table(spark, root, "scene_nodes").select("node_id", "tile_id"), "tile_id").distinct()


@query("select node_id, area from (select node_id, max(area) area from scene_nodes where area is not null and node_id is not null group by 1) order by area desc, node_id limit 25")
def largest_nodes(spark: SparkSession, root: str) -> DataFrame:
    nodes = table(spark, root, "scene_nodes").where("area is not null and node_id is not null").groupBy("node_id").agg(F.max("area").alias("area"))
    return sets.largest(nodes, 25, "area", "node_id")


@query()
def uniform_subsample(spark: SparkSession, root: str) -> DataFrame:
    """A hundred orders at random, a sampling operator's own limit; the hash has no SQL."""
    return sets.subsample(table(spark, root, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


@query("select s_suppkey id, s_name name, null::varchar part_type from supplier union all select p_partkey, p_name, p_type from part union all select c_custkey, c_name, null from customer")
def stacked_tables(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    p = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("part_type"))
    return sets.stack(s, p, table(spark, root, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("select distinct c.source_id, c.native_label from (select unnest(claims) c from scene_nodes) except select distinct c.source_id, c.native_label from (select unnest(claims) c from scene_nodes where area > 0.05)")
def missing_evidence(spark: SparkSession, root: str) -> DataFrame:
    c = fusion.claims_of(table(spark, root, "scene_nodes"), "area")
    return sets.missing_from(c, c.where("area > 0.05"), ["source_id", "native_label"])


@query("select distinct source_id from (select c.source_id from (select unnest(claims) c from scene_nodes) union all select source from documents) t(source_id) where source_id is not null")
def known_sources(spark: SparkSession, root: str) -> DataFrame:
    return sets.known_values("source_id", fusion.claims_of(table(spark, root, "scene_nodes")), table(spark, root, "documents").select(F.col("source").alias("source_id")))


_ENTITIES = f"{_PLACED}, en as (select node_id var, min(lat) lat, min(lon) lon from pl group by 1), fam as (select node_id var, min(sg_idx) sg, max(area) base from scene_nodes where node_id is not null group by 1), par as (select f.var, base, m.p parent from fam f left join (select sg, min(var) p from fam group by sg) m on m.sg = f.sg and m.p <> f.var) "


def _entities(spark, root):
    at = _placed(spark, root).groupBy(F.col("node_id").alias("var")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    kin = table(spark, root, "scene_nodes").where("node_id is not null").groupBy(F.col("node_id").alias("var")).agg(F.min("sg_idx").alias("sg"), F.max("area").alias("base_alt"))
    first = kin.groupBy("sg").agg(F.min("var").alias("parent"))
    return kin.join(first, "sg", "left").withColumn("parent", F.when(F.col("parent") != F.col("var"), F.col("parent"))).join(at, "var", "left").select("var", "lat", "lon", "base_alt", "parent")


_ZONED = """, b1 as (select distinct zone_id, geo_polygon p, geo_bbox g from survey_zones where zone_id is not null), e1 as (select zone_id, p[i].lon x1, p[i].lat y1, p[i % len(p) + 1].lon x2, p[i % len(p) + 1].lat y2 from (select zone_id, p, unnest(range(1, len(p) + 1)) i from b1 where len(p) >= 3)),
held as (select distinct var from (select var, zone_id from en join e1 on (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 group by all having count(*) % 2 = 1 union all
 select var, zone_id from en, b1 where coalesce(len(p), 0) < 3 and not (g.west = 0 and g.south = 0 and g.east = 0 and g.north = 0) and lon between least(g.west, g.east) and greatest(g.west, g.east) and lat between least(g.south, g.north) and greatest(g.south, g.north))) """


@query(f"with {_ENTITIES} {_ZONED}" + """, g1 as (select e.var, par.base - 0.05 above from en e join par using (var) where par.base is not null and lon between -180 and 180 and lat between -90 and 90),
lc as (select var, (greatest(0, least(9, floor((90 - lat) / 180 * 10))) + greatest(0, least(19, floor((lon + 180) / 360 * 20)))) % 4 code from en where lon between -180 and 180 and lat between -90 and 90),
kin as (select parent, var from par where parent is not null),
un as (select 'buildings' source, var, null other, 'building' cat, null other_cat, 1.5::double bonus from held
 union all select 'land_cover', var, null, case code when 1 then 'water' when 2 then 'road' end, null, 1.0 from lc where code in (1, 2)
 union all select 'ground', var, null, unnest(['road', 'water']), null, 1.0 from g1 where abs(above) <= 0.03 union all select 'ground', var, null, unnest(['building', 'tree', 'vehicle']), null, 1.0 from g1 where above > 0.03
 union all select 'parents', parent, var, c.p, c.c, c.w from kin, (values ('tree', 'tree', 1.0), ('building', 'vehicle', 1.0), ('building', 'building', 1.0), ('road', 'vehicle', 1.0), ('water', 'building', -1.5), ('water', 'vehicle', -1.5), ('water', 'tree', -1.5), ('building', 'tree', -1.5), ('road', 'tree', -1.5), ('road', 'building', -1.5)) c(p, c, w))
select source, cat, other_cat, count(*) n, count(distinct var) vars, round(sum(bonus), 3) bonus from un group by all""")
def prior_factors(spark: SparkSession, root: str) -> DataFrame:
    """Factors of a stack of prior sources over the placed nodes, counted by source and class."""
    e = keep(_entities(spark, root))
    box, rows, columns = (-180.0, -90.0, 180.0, 90.0), 10, 20
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("r"), (F.col("id") % columns).cast("int").alias("c")).withColumn("code", (F.col("r") + F.col("c")) % 4).withColumn("z", F.lit(0.05))
    sources = [priors.buildings(table(spark, root, "survey_zones")), priors.land_cover(cells, box, rows, columns, {1: "water", 2: "road"}), priors.ground(cells, box, rows, columns, tolerance=0.03), priors.parents()]
    found = priors.factors(sources, e, spark.createDataFrame([(c,) for c in ("building", "road", "water", "tree", "vehicle")], "cat string"))
    return rounded(found.groupBy("source", "cat", "other_cat").agg(F.count("*").alias("n"), F.countDistinct("var").alias("vars"), F.sum("bonus").alias("bonus")), 3, "bonus")


_MASKS = "a as (select s_nationkey img, s_suppkey id, unnest(range(s_suppkey % 10, s_suppkey % 10 + 4 + s_suppkey % 3)) cell from supplier where s_suppkey % 2 = 0), b as (select s_nationkey img, s_suppkey id, unnest(range(s_suppkey % 8, s_suppkey % 8 + 5)) cell from supplier where s_suppkey % 2 = 1), o as (select a.img, a.id a, b.id b, count(*) n from a join b using (img, cell) group by all), na as (select img, id, count(*) n from a group by all), nb as (select img, id, count(*) n from b group by all), iou as (select o.img, o.a, o.b, o.n / (na.n + nb.n - o.n) iou from o join na on na.img = o.img and na.id = o.a join nb on nb.img = o.img and nb.id = o.b) "


def _masks(spark, root):
    s, k = table(spark, root, "supplier"), F.col("s_suppkey")
    of = lambda low, size: F.explode(F.sequence(low, low + size - 1)).alias("cell")
    return s.where(k % 2 == 0).select(F.col("s_nationkey").alias("img"), k.alias("id"), of(k % 10, 4 + k % 3)), s.where(k % 2 == 1).select(F.col("s_nationkey").alias("img"), k.alias("id"), of(k % 8, F.lit(5)))


@query(f"with {_MASKS} select img, a, b, round(iou, 6) iou from iou")
def mask_overlaps(spark: SparkSession, root: str) -> DataFrame:
    return rounded(fusion.mask_overlaps(*_masks(spark, root), ["img"]), 6, "iou")


@query(f"with {_MASKS} select img, id, cell from a where not exists (select 1 from iou where iou.img = a.img and iou.a = a.id and iou > 0.4)")
def unclaimed_masks(spark: SparkSession, root: str) -> DataFrame:
    return fusion.unclaimed(*_masks(spark, root), ["img"], 0.4)


@query(_BOXES + """, p as (select sg_idx, a.node_id a, b.node_id b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) w, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) u, sqrt(power((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + power((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) d from b a join b using (sg_idx) where a.node_id < b.node_id)
select sg_idx, a, b, round(case when u > w then w / (u - w) else 0 end, 6) iou, round(d, 6) distance from p where (u > w and w / (u - w) >= 0.3) or d <= 0.1""")
def association_pairs(spark: SparkSession, root: str) -> DataFrame:
    return rounded(fusion.association_pairs(_boxes(spark, root), ["sg_idx"], 0.3, 0.1), 6, "iou", "distance")


@query("with recursive n as (select distinct node_id, osm_id from scene_nodes where node_id is not null), l as (select distinct a.node_id a, b.node_id b from n a join n b on a.osm_id = b.osm_id), reach(s, t) as (select node_id, node_id from n union select r.s, l.b from reach r join l on r.t = l.a) select s node_id, min(t) entity from reach group by s")
def merged_entities(spark: SparkSession, root: str) -> DataFrame:
    return fusion.merge_by_feature(table(spark, root, "scene_nodes"), "node_id", "osm_id")


# ---- aggregates and series ----


@query("with s as (select l_returnflag k, l_linenumber part, count(*) n, sum(l_quantity) w, sum(l_quantity * l_discount) wx from lineitem group by all), m as (select k, part, n, w, wx / w mean from s), q as (select l_returnflag k, sum(l_quantity) w, sum(l_quantity * l_discount) / sum(l_quantity) mean from lineitem group by 1), d as (select l_returnflag k, sum(l_quantity * power(l_discount - mean, 2)) m2 from lineitem join q on k = l_returnflag group by 1) select k, cast((select sum(n) from s where s.k = q.k) as bigint) n, round(w, 2) weight, round(mean, 8) mean, round(m2, 4) m2 from q join d using (k)")
def merged_moments(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "lineitem").groupBy(F.col("l_returnflag").alias("k"), "l_linenumber").agg(*stats.Moments.update(F.col("l_discount"), F.col("l_quantity")))
    return rounded(rounded(rounded(stats.merge_moments(parts, ["k"]).select("k", "n", "weight", "mean", "m2"), 2, "weight"), 8, "mean"), 4, "m2")


@query("with x as (select event_type k, count(*) n, sum(value) s, var_samp(value) v from events where value is not null group by 1) select k, n, round(s / n, 5) mean, round(v, 4) variance from x where k is not null")
def aggregate_protocol(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").where("value is not null and event_type is not null")
    parts = e.groupBy(F.col("event_type").alias("k"), (F.col("event_id") % 7).alias("part")).agg(*stats.Moments.update(F.col("value"), F.lit(1.0)))
    return rounded(rounded(stats.Moments.merge(parts, ["k"]).select("k", "n", *stats.Moments.finish()), 5, "mean"), 4, "variance")


_COUNTS = "c as (select user_id, [count(*) filter (event_type = 'click'), count(*) filter (event_type = 'error'), count(*) filter (event_type = 'purchase'), count(*) filter (event_type = 'signup'), count(*) filter (event_type = 'view')] n from events where user_id is not null group by 1), d as (select user_id, [x::double for x in n] n, list_sum(n)::double t from c where list_sum(n) > 0) "


def _counts(spark, root):
    e = table(spark, root, "events").where("user_id is not null").groupBy("user_id").agg(F.array(*(F.count(F.when(F.col("event_type") == k, 1)).cast("double") for k in ("click", "error", "purchase", "signup", "view"))).alias("n"))
    return e.where(F.aggregate("n", F.lit(0.0), lambda a, x: a + x) > 0)


@query(f"with {_COUNTS} select user_id, round(list_sum([case when x > 0 then x / t * (ln(x / t) - ln(i / 15.0::double)) else 0 end for x, i in n]), 6) + 0.0 kl, round(sqrt(list_sum([power(sqrt(x / t) - sqrt(i / 15.0::double), 2) for x, i in n]) / 2), 6) hellinger from d")
def path_entropy(spark: SparkSession, root: str) -> DataFrame:
    q = F.array(*(F.lit(float(i)) for i in range(1, 6)))
    return rounded(_counts(spark, root).select("user_id", information.relative_entropy(F.col("n"), q).alias("kl"), information.hellinger_distance(F.col("n"), q).alias("hellinger")), 6, "kl", "hellinger")


@query(f"with {_COUNTS}, o as (select user_id, t, list_reverse_sort(n) n from d), r as (select user_id, [x / t for x in n] p, t from o) select user_id, round(-list_sum([greatest(x, 1e-10) * ln(greatest(x, 1e-10)) for x in p]), 6) + 0.0 entropy, cast(len([k for k in range(1, 6) if list_sum(p[:k]) * t / (t + 1e-12) < 0.8]) + 1 as int) dimension from r")
def von_neumann_entropy(spark: SparkSession, root: str) -> DataFrame:
    """Entropy of each user's counts as a diagonal kernel, and how many modes make up 80 % of its trace."""
    return rounded(_counts(spark, root).select("user_id", information.von_neumann_entropy(F.col("n")).alias("entropy"), information.effective_dimension(F.col("n"), 0.8).cast("int").alias("dimension")), 6, "entropy")


@query(f"with {_COUNTS}, o as (select user_id, list_sort(n)[:3] n from d), r as (select user_id, n, list_sum(n) t from o) select user_id, round(case when t > 0 then -list_sum([x / t * ln(x / t + 1e-12) for x in n]) else 0 end, 6) + 0.0 entropy from r")
def head_entropy(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_counts(spark, root).select("user_id", information.head_entropy(F.col("n"), 3).alias("entropy")), 6, "entropy")


@query("with p as (select abs(c_acctbal) / (select sum(abs(c_acctbal)) from customer) p from customer) select round(-sum(case when p > 0 then p * ln(p) else 0 end), 8) entropy from p")
def shannon_entropy(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer").select(F.abs("c_acctbal").alias("a"))
    return rounded(maxcal.entropy(c.select((F.col("a") / F.lit(c.agg(F.sum("a")).first()[0])).alias("p"))), 8, "entropy")


_DAILY = "y as (select user_id, cast(date_diff('day', date '1970-01-01', cast(ts as date)) as int) d, avg(value) v from events where user_id is not null and ts is not null and value is not null group by all) "


def _daily(spark, root):
    return table(spark, root, "events").where("user_id is not null and ts is not null and value is not null").groupBy("user_id", F.unix_date(F.to_date("ts")).alias("d")).agg(F.avg("value").alias("v"))


@query(f"with {_DAILY}, f as (select user_id, d, lag(v) over (partition by user_id order by d) - v fall from y) select user_id, d as \"at\", round(fall, 5) as \"drop\" from (select *, row_number() over (partition by user_id order by fall desc, d) r from f where fall > 0) where r = 1")
def largest_drop(spark: SparkSession, root: str) -> DataFrame:
    return rounded(trajectory.largest_drop(_daily(spark, root), "user_id", "d", "v"), 5, "drop")


@query(f"with {_DAILY} select user_id, d, count(v) over w recent_n, round(avg(v) over w, 9) recent_mean, round(max(v) over w, 9) recent_max from y window w as (partition by user_id order by d rows between 59 preceding and current row)")
def rolling_buffer(spark: SparkSession, root: str) -> DataFrame:
    return rounded(trajectory.recent(_daily(spark, root), "user_id", "d", "v").drop("v"), 9, "recent_mean", "recent_max")


@query("with o as (select o_custkey k, o_orderkey i, o_totalprice v from orders) select k, i, round(sum(v) over (partition by k order by i), 2) running, round(sum(v) over (partition by k order by i) / sum(v) over (partition by k), 6) share from o")
def explained_share(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    return rounded(rounded(trajectory.running_share(o, "k", "i", "v").drop("v"), 2, "running"), 6, "share")


@query("with s as (select distinct state_id, run_id, t from rover_states where run_id is not null and t is not null), g as (select run_id, unnest(range(0, 40)) e from (select distinct run_id from s)) select s.state_id, s.run_id, case when e is null then null when e % 3 = 0 then 'wake' when e % 3 = 1 then 'rest' else 'dream' end stage from s left join g on g.run_id = s.run_id and g.e = floor(t / 5)")
def stage_lookup(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "rover_states").where("run_id is not null and t is not null").select("state_id", "run_id", "t").distinct()
    stages = s.select("run_id").distinct().withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("stage", F.when(F.col("epoch") % 3 == 0, "wake").when(F.col("epoch") % 3 == 1, "rest").otherwise("dream"))
    return trajectory.stage_of(s, stages, "run_id", "t", 5.0).select("state_id", "run_id", "stage")


_MOTION = "m as (select run_id, t, avg(v) v, avg(omega) o from rover_states where run_id is not null and t is not null and abs(v) <= 100 and abs(omega) <= 100 group by all) "


def _motion(spark, root):
    return table(spark, root, "rover_states").where("run_id is not null and t is not null and abs(v) <= 100 and abs(omega) <= 100").groupBy("run_id", "t").agg(F.avg("v").alias("v"), F.avg("omega").alias("omega"))


@query(f"with {_MOTION}, z as (select run_id, row_number() over (partition by run_id order by t) - 1 n, count(*) over (partition by run_id) a, (v - avg(v) over r) / case when stddev_pop(v) over r > 0 then stddev_pop(v) over r else 1 end v, (o - avg(o) over r) / case when stddev_pop(o) over r > 0 then stddev_pop(o) over r else 1 end o from m window r as (partition by run_id)), w as (select run_id, win, unnest(range(win * 50, win * 50 + 100)) n from (select run_id, unnest(range(0, greatest(0, (any_value(a) - 100) // 50 + 1))) win from z group by run_id)), j as (select w.run_id, cast(win as int) win, z.v, z.o from w join z on z.run_id = w.run_id and z.n = w.n) select run_id, win, 'omega' a, 'omega' b, round(covar_samp(o, o), 5) + 0.0 cov from j group by run_id, win union all select run_id, win, 'omega', 'v', round(covar_samp(o, v), 5) + 0.0 from j group by run_id, win union all select run_id, win, 'v', 'v', round(covar_samp(v, v), 5) + 0.0 from j group by run_id, win")
def sliding_covariance(spark: SparkSession, root: str) -> DataFrame:
    """Covariance of speed and turn rate of each run in windows of a hundred samples, fifty apart; incomplete windows are left out."""
    long = _motion(spark, root).select("run_id", "t", F.explode(F.map_from_arrays(F.array(F.lit("v"), F.lit("omega")), F.array("v", "omega"))).alias("c", "x"))
    return rounded(stats.sliding_covariance(long, "run_id", "t", "c", "x", 100, 50), 5, "cov")


@query(f"with {_MOTION}, p as (select run_id, v, o, lead(v) over (partition by run_id order by t) v1 from m), g as (select run_id, count(*) n, sum(v * v) + 1e-8 a, sum(v * o) b, sum(o * o) + 1e-8 d, sum(v1 * v) x, sum(v1 * o) y from p where v1 is not null group by run_id) select run_id, n, round(((x * d - y * b) / (a * d - b * b) - 1) / 0.1, 5) + 0.0 drift, round((y * a - x * b) / (a * d - b * b) / 0.1, 5) + 0.0 gain from g")
def driven_dynamics(spark: SparkSession, root: str) -> DataFrame:
    """How each run's speed follows itself and its turn rate as an input."""
    d = stats.driven_autoregression(_motion(spark, root), "run_id", ["t"], ["v"], ["omega"], 0.1)
    return rounded(d.select("run_id", "n", F.col("drift")[0].alias("drift"), F.col("gain")[0].alias("gain")), 5, "drift", "gain")


@query("with v as (select unnest(['en', 'de', 'fr', 'xx']) lang), k as (select distinct source from documents where source is not null), w as (select source, lang, sum(length(coalesce(text, '')))::double w from documents group by all), f as (select k.source, v.lang, coalesce(w, 0) w from k cross join v left join w on w.source = k.source and w.lang = v.lang) select source, lang, round(case when sum(w) over (partition by source) > 0 then w / sum(w) over (partition by source) else 0 end, 6) p from f")
def fixed_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "xx")], "label string")
    return rounded(stats.label_distribution(table(spark, root, "documents"), "source", "lang", F.length(F.coalesce("text", F.lit(""))).cast("double"), names), 6, "p")


@query("""with c as (select user_id k, event_type l, count(*)::double n from events where user_id is not null and event_type is not null group by all), d0 as (select k, l, n / sum(n) over (partition by k) p from c),
d1 as (select k, l, p * p / sum(p * p) over (partition by k) p from d0), d2 as (select k, l, p * p / sum(p * p) over (partition by k) p from d1), d3 as (select k, l, p * p / sum(p * p) over (partition by k) p from d2) select k, l, round(p, 6) p from d3""")
def prompt_fixed_point(spark: SparkSession, root: str) -> DataFrame:
    """Three rounds of a detector that is surer of what it was asked for most; the detector is the caller's function."""
    d = kernels.distributions(table(spark, root, "events"), "user_id", "event_type").select(F.col("user_id").alias("k"), F.col("event_type").alias("label"), "p")
    found, _ = fusion.prompts_until_stable(d, lambda asked: asked.select("k", "label", (F.col("p") * F.col("p")).alias("confidence")), "k", rounds=3, tol=-1.0)
    return rounded(found.select("k", F.col("label").alias("l"), "p"), 6, "p")


@query(_Q + "select i, j, round(exp(-list_sum([abs(x - w[n]) for x, n in v]) / 64), 6) k from q, r")
def gram_of_a_function(spark: SparkSession, root: str) -> DataFrame:
    """A kernel that is a function of the caller's: here of the sum of absolute differences."""
    import numpy as np

    def laplace(q, x, **_):
        return np.exp(-np.abs(q[:, None, :] - x[None, :, :]).sum(2) / 64)

    v = _vectors(spark, root)
    return rounded(kernels.gram(v.where("id % 100 = 0"), v, laplace), 6, "k")


# ---- rasters and graphs ----

_SHIFTS = sorted({(k, round(k * math.sin(2 * math.pi * a / 16)), round(k * math.cos(2 * math.pi * a / 16))) for k in (3, 5) for a in range(16)})


@query(_SMALL_GRID + f", e as (select r, c from z where (r * 7 + c * 13) % 11 = 0), s(k, a, b) as (values {', '.join(map(str, _SHIFTS))}) select 'valley' raster_id, e.r + s.a r, e.c + s.b c, s.k radius, count(*) votes from e, s group by all")
def circle_votes(spark: SparkSession, root: str) -> DataFrame:
    cells = raster.valley_grid(spark, 40, 36).where((F.col("r") * 7 + F.col("c") * 13) % 11 == 0)
    return raster.circle_votes(cells, [3, 5], 16)


@query(_SMALL_GRID + "select 'valley' raster_id, cast(r // 4 as bigint) r, cast(c // 4 as bigint) c, count(*) n, round(avg(z), 10) z from z group by all")
def coarsened_raster(spark: SparkSession, root: str) -> DataFrame:
    return rounded(raster.coarsen(raster.valley_grid(spark, 40, 36), 4), 10, "z")


@query(_SMALL_GRID + "select 'valley' raster_id, r // 4 r, c // 4 c, r2 // 4 r2, c2 // 4 c2, count(*) n, round(sum(s), 5) w from (select t.r, t.c, t.r2, t.c2, f.s from t join k on k.r = t.r and k.c = t.c join f on f.r = t.r and f.c = t.c and f.d = k.d) where r // 4 <> r2 // 4 or c // 4 <> c2 // 4 group by all")
def coarsened_edges(spark: SparkSession, root: str) -> DataFrame:
    """Flows between bins of four by four cells, parallel ones added up with their falls."""
    d = keep(raster.flow_direction(raster.valley_grid(spark, 40, 36)))
    z = d.select("raster_id", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("z").alias("z2"))
    length = F.when((F.col("r") != F.col("r2")) & (F.col("c") != F.col("c2")), math.sqrt(2.0)).otherwise(1.0)
    flows = raster.downstream(d).join(d.select("raster_id", "r", "c", "z"), ["raster_id", "r", "c"]).join(z, ["raster_id", "r2", "c2"]).withColumn("w", (F.col("z") - F.col("z2")) / length)
    return rounded(raster.coarsen_edges(flows, 4), 5, "w")


@query(_SMALL_GRID + "select 'valley' raster_id, a.r, a.c, b.r r2, b.c c2, round(a.z - b.z, 6) as \"drop\" from z a join z b on (b.r = a.r and b.c = a.c + 1) or (b.r = a.r + 1 and b.c - a.c in (-1, 0, 1))")
def terrain_edges(spark: SparkSession, root: str) -> DataFrame:
    return rounded(raster.terrain_edges(raster.valley_grid(spark, 40, 36), True), 6, "drop")


@query("""with recursive z as (select r, c, (r * r * 0.01 + c * c * 0.02 + r * c * 0.005)::double z from (select cast(i // 20 as int) r, cast(i % 20 as int) c from range(400) t(i)))
select 'bowl' raster_id, r, c, round(0.06::double, 6) planform, round((zx * zx * 0.04 + 2 * zx * zy * 0.005 + zy * zy * 0.02) / (zx * zx + zy * zy + 1e-12), 6) profile from (select r, c, c * 0.04::double + r * 0.005::double zx, r * 0.02::double + c * 0.005::double zy from z) where r between 2 and 17 and c between 2 and 17""")
def raster_curvature(spark: SparkSession, root: str) -> DataFrame:
    """Curvature of a quadratic surface inside its borders, which differences give exactly."""
    cells = spark.range(400).select(F.lit("bowl").alias("raster_id"), F.floor(F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c")).withColumn("z", F.col("r") * F.col("r") * 0.01 + F.col("c") * F.col("c") * 0.02 + F.col("r") * F.col("c") * 0.005)
    return rounded(raster.curvature(cells).where("r between 2 and 17 and c between 2 and 17"), 6, "planform", "profile")


# ---- columns ----


@query("select p_partkey, round((p_retailprice - p_size) / (p_retailprice + p_size), 6) ndre, round(case when p_size - 25 + 25 - p_size > 1e-6 then 1 else 0 end, 6) + 0.0 flat, round((p_retailprice - p_size * 2) / (p_retailprice + p_size * 2), 6) gndvi from part")
def more_vegetation_indices(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    return rounded(p.select("p_partkey", indices.ndre(F.col("p_retailprice"), F.col("p_size")).alias("ndre"), indices.ndvi(F.col("p_size") - 25, 25 - F.col("p_size")).alias("flat"), indices.gndvi(F.col("p_retailprice"), F.col("p_size") * 2).alias("gndvi")), 6, "ndre", "flat", "gndvi")


_E2, _A = 0.0066943799901413165, 6378137.0
_LAT0, _LON0, _ALT0 = 45.0, 10.0, 200.0
_N0 = _A / math.sqrt(1 - _E2 * math.sin(math.radians(_LAT0)) ** 2)
_X0, _Y0, _Z0 = ((_N0 + _ALT0) * math.cos(math.radians(_LAT0)) * math.cos(math.radians(_LON0)), (_N0 + _ALT0) * math.cos(math.radians(_LAT0)) * math.sin(math.radians(_LON0)), (_N0 * (1 - _E2) + _ALT0) * math.sin(math.radians(_LAT0)))


@query(f"""with {_PTS}, g as (select id, 45 + y / 1000 lat, 10 + x / 1000 lon from p), n as (select *, {_A} / sqrt(1 - {_E2} * power(sin(radians(lat)), 2)) n from g), e as (select id, lat, lon, (n + 100) * cos(radians(lat)) * cos(radians(lon)) - {_X0!r} dx, (n + 100) * cos(radians(lat)) * sin(radians(lon)) - {_Y0!r} dy, (n * (1 - {_E2}) + 100) * sin(radians(lat)) - {_Z0!r} dz from n)
select id, round(dy * cos(radians(10)) - dx * sin(radians(10)), 3) + 0.0 east, round(dz * cos(radians(45)) - (dx * cos(radians(10)) + dy * sin(radians(10))) * sin(radians(45)), 3) + 0.0 north, round(-((dx * cos(radians(10)) + dy * sin(radians(10))) * cos(radians(45)) + dz * sin(radians(45))), 3) + 0.0 down, round((lon - 10) * 111320 * cos(radians(45)), 3) + 0.0 x, round((lat - 45) * 111320, 3) + 0.0 y from e""")
def local_frames(spark: SparkSession, root: str) -> DataFrame:
    """Points in a local frame: east and north, down, and in the plane."""
    p = _parts(spark, root).select("id", (45 + F.col("y") / 1000).alias("lat"), (10 + F.col("x") / 1000).alias("lon"))
    at = p.select("id", geodesy.to_enu(F.col("lat"), F.col("lon"), F.lit(100.0), (_LAT0, _LON0, _ALT0)).alias("e"), geodesy.local_plane(F.col("lat"), F.col("lon"), _LAT0, _LON0).alias("q")).withColumn("n", geodesy.enu_to_ned(F.col("e")))
    return rounded(at.select("id", "n.east", "n.north", "n.down", "q.x", "q.y"), 3, "east", "north", "down", "x", "y")


@query("select p_partkey, round(p_retailprice + sqrt(2 * ln(50 * p_size * p_size * pi() * pi() / 0.6)) * p_size, 5) ucb, round(sqrt(power((p_size - 10) * 111320.0, 2) + power((p_retailprice / 1000 - 1) * 111320, 2)) * 50, 1) joules, round(p_retailprice / 1000 * ln(1 + greatest(p_size, 1)), 6) gain from part where p_size > 0")
def acquisition(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part").where("p_size > 0")
    out = p.select("p_partkey", coding.ucb(F.col("p_retailprice"), F.col("p_size"), coding.beta_schedule(F.col("p_size"), 50)).alias("ucb"), geodesy.travel_joules(F.col("p_size"), F.col("p_retailprice") / 1000, 10.0, 1.0).alias("joules"), novelty.information_gain(F.col("p_retailprice") / 1000, F.col("p_size")).alias("gain"))
    return rounded(rounded(rounded(out, 5, "ucb"), 1, "joules"), 6, "gain")


@query("select p_partkey, cast(round_even((least(2000, greatest(-1000, p_retailprice)) - 500) / 1500 * 32767, 0) as bigint) signed, cast(least(round_even(p_size * 7.5, 0), 200) as bigint) counted, cast(round_even((ln(greatest(p_retailprice, 0.01)) - ln(0.01)) / (ln(1e5) - ln(0.01)) * 255, 0) as bigint) logged from part")
def more_quantisers(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    return p.select("p_partkey", coding.quantise_signed(F.col("p_retailprice"), 2, -1000.0, 2000.0).alias("signed"), coding.quantise_count(F.col("p_size") * 7.5, 1, 200).alias("counted"), coding.log_code(F.col("p_retailprice"), 1, 0.01, 1e5).alias("logged"))


@query("with a as (select s_suppkey, radians(s_suppkey * 13 % 360 + 0.123)::double a from supplier) select s_suppkey, cast(0 as int) x, cast(0 as int) y, cast(round_even(case when cos(a / 2) < 0 then -1 else 1 end * sin(a / 2) * 32767, 0) as int) z, cast(round_even(abs(cos(a / 2)) * 32767, 0) as int) w, cast(round_even(s_suppkey * 1.2345::double / 0.001::double, 0) as int) t from a")
def pose_codes(spark: SparkSession, root: str) -> DataFrame:
    """Turns about the upright axis as coded quaternions, and a coded shift."""
    a = F.radians(F.col("s_suppkey") * 13 % 360 + 0.123)
    q = coding.quantise_quaternion(coding.quaternion_of(F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    s = table(spark, root, "supplier").select("s_suppkey", q.alias("q"), coding.quantise_translation(F.array(F.col("s_suppkey") * 1.2345)).alias("t"))
    return s.select("s_suppkey", *(F.col("q")[k].alias(c) for k, c in enumerate("xyzw")), F.col("t")[0].alias("t"))


@query(f"with {_CLOUD}, a as (select id, x, y, z, power(abs((x - 20) / 25), 2) + power(abs((y - 30) / 20), 2) + power(abs(z / 10), 2) f, radians(id % 90)::double t from c) select id, round(f, 6) f, round(sqrt(power(x - 20, 2) + power(y - 30, 2) + z * z) * (1 - power(greatest(f, 1e-12), -0.5)), 4) + 0.0 distance, round(x - (25 * cos(t) + 20 * sin(t)), 5) + 0.0 low_x, round(y + (25 * sin(t) + 20 * cos(t)), 5) + 0.0 high_y from a")
def solid_shapes(spark: SparkSession, root: str) -> DataFrame:
    """Inside-outside value and signed distance of points to an ellipsoid, and the box of a turned copy around each."""
    t = F.radians((F.col("id") % 90).cast("double"))
    x, y, z = F.col("x") - 20, F.col("y") - 30, F.col("z")
    turn = F.array(F.cos(t), -F.sin(t), F.lit(0.0), F.sin(t), F.cos(t), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    box = shapes.solid_box(F.array("x", "y", "z"), F.array(F.lit(25.0), F.lit(20.0), F.lit(10.0)), turn)
    out = _cloud(spark, root).select("id", shapes.solid_inside_outside(x, y, z, (25.0, 20.0, 10.0), (1.0, 1.0)).alias("f"), shapes.solid_signed_distance(x, y, z, (25.0, 20.0, 10.0), (1.0, 1.0)).alias("distance"), box.alias("b"))
    return rounded(rounded(rounded(out.select("id", "f", "distance", F.col("b.low")[0].alias("low_x"), F.col("b.high")[1].alias("high_y")), 6, "f"), 4, "distance"), 5, "low_x", "high_y")


@query("with l as (select user_id, event_type, count(*) n from events where user_id is not null and event_type is not null group by all), t as (select user_id, list(event_type order by n desc, event_type)[:3] l from l group by 1) select 'user-' || lpad(user_id::varchar, 6, '0') id, array_to_string(l, '. ') || '.' prompt, len(l) n from t")
def prompts(spark: SparkSession, root: str) -> DataFrame:
    """Each user's three most frequent labels as a prompt, taken apart again to count them."""
    e = table(spark, root, "events").where("user_id is not null").withColumn("one", F.lit(1))
    top = sets.top_labels(e, "user_id", "event_type", "one", 3)
    text = coding.prompt_of(F.col("labels"))
    return top.select(sets.format_id("user-", F.col("user_id"), 6).alias("id"), text.alias("prompt"), F.size(coding.labels_of(text)).alias("n"))


@query("with n as (select distinct node_id, region.id rid, len(region.geo_polygon) ring, claims[1].score score, claims from scene_nodes) select node_id, rid region, coalesce(ring, -1) ring, coalesce(len(claims), -1) claims, round(score, 6) score from n")
def json_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Nested nodes as JSON texts and back."""
    n = table(spark, root, "scene_nodes").select("node_id", "region", "claims")
    text = n.select("node_id", F.to_json(F.struct("region", "claims"), {"ignoreNullFields": "false"}).alias("j"))
    back = text.select("node_id", F.from_json("j", n.select("region", "claims").schema).alias("v")).select("node_id", "v.*")
    return rounded(back.select("node_id", F.col("region.id").alias("region"), F.coalesce(F.size("region.geo_polygon"), F.lit(-1)).alias("ring"), F.coalesce(F.size("claims"), F.lit(-1)).alias("claims"), F.get("claims", F.lit(0))["score"].alias("score")).distinct(), 6, "score")


@query("select p_partkey, round(1 - (1 - 1 / (1 + exp(-(p_size - 25) / 10.0 / 0.25))) * (1 - 1 / (1 + exp(-(p_retailprice - 1500) / 1000 / 0.25))) * (1 - 1 / (1 + exp(-abs(p_size % 3)))), 6) score from part where p_size >= 10 union all select p_partkey, 0.0 from part where p_size < 10")
def spectral_novelty(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    return rounded(p.select("p_partkey", novelty.spectral_signal((F.col("p_size") - 25) / 10, (F.col("p_retailprice") - 1500) / 1000, F.col("p_size") % 3, F.col("p_size") >= 10).alias("score")), 6, "score")


@query("select s_suppkey, round(log10(s_nationkey + 1.0) + log10(1.380649e-23 * 298.15), 6) bound, round((s_nationkey + 1) * ln(2), 8) nats, round((s_nationkey + 1) * 1e-20 / (1.380649e-23 * 298.15), 5) units, round(exp(-1.0) / (s_nationkey + 1), 8) vacuum, round(exp(-0.3 * (2 - 2 * cos(pi() * 1 / (s_nationkey + 2)))), 8) heat, round(exp(-1.0 + 0.5 * s_nationkey / 10), 8) geodesic from supplier")
def physics_table(spark: SparkSession, root: str) -> DataFrame:
    """Energy bounds and units, and the spectral columns that need no iteration."""
    s, k = table(spark, root, "supplier"), F.col("s_nationkey") + 1
    out = s.select(
        "s_suppkey", F.log10(physics.landauer_joules(k.cast("double"))).alias("bound"), physics.bits_to_nats(k.cast("double")).alias("nats"), physics.thermal_units(k * 1e-20).alias("units"), modes.vacuum(1.0 / k).alias("vacuum"),
        modes.heat_weight(modes.path_eigenvalue(F.lit(1.0), k + 1), 0.3).alias("heat"), modes.log_linear(F.lit(-1.0), F.col("s_nationkey") / 10, 0.5).alias("geodesic"),
    )
    return rounded(rounded(rounded(out, 6, "bound"), 5, "units"), 8, "nats", "vacuum", "heat", "geodesic")


# ---- sources ----


@query("select p_partkey + 1 id, (p_partkey * 37 % 1000) / 10.0::double x, (p_partkey * 91 % 997) / 10.0::double y, p_size::double z, 'v' what from part union all select p_partkey + 1, p_partkey + 2, p_partkey + 3, null, 'f' from part where p_partkey + 2 <= (select max(p_partkey) from part)")
def mesh_files(spark: SparkSession, root: str) -> DataFrame:
    """A mesh written as OBJ text and read again: its vertices and its faces' corners."""
    v = _parts(spark, root).join(table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("z")), "id").withColumn("id", F.col("id") + 1)
    top = v.agg(F.max("id")).first()[0]
    f = v.where(F.col("id") + 2 <= top).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    path = f"{shared_folder(spark)}/mesh-{spark.sparkContext.applicationId}"
    files.write_obj(v, f, path)
    back, faces = files.read_obj(spark, path)
    vertices = keep(back.select("id", "x", "y", "z", F.lit("v").alias("what")))
    return vertices.unionByName(faces.select(F.col("a").alias("id"), F.col("b").cast("double").alias("x"), F.col("c").cast("double").alias("y"), F.lit(None).cast("double").alias("z"), F.lit("f").alias("what")))


@query("select s_suppkey, s_name, round(s_acctbal, 2) balance from supplier")
def result_files(spark: SparkSession, root: str) -> DataFrame:
    """Results written as JSON lines and as CSV, and read again; where they differ, no row comes out."""
    s = table(spark, root, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("balance"))
    path = f"{shared_folder(spark)}/results-{spark.sparkContext.applicationId}"
    files.write_results(s, f"{path}-j"), files.write_results(s, f"{path}-c", "csv")
    j, c = spark.read.schema(s.schema).json(f"{path}-j"), spark.read.csv(f"{path}-c", schema=s.schema, header=True)
    return j.intersect(c)


@query("select zone_id, len(geo_polygon) n, round(list_sum([v.lon for v in geo_polygon]), 9) lon, round(list_sum([v.lat for v in geo_polygon]), 9) lat from (select zone_id, any_value(geo_polygon) geo_polygon from survey_zones where len(geo_polygon) >= 3 and zone_id is not null group by zone_id having count(distinct geo_polygon) = 1)")
def geojson_files(spark: SparkSession, root: str) -> DataFrame:
    """Zones written as a GeoJSON text and read again; zones of which only one ring is given."""
    z = table(spark, root, "survey_zones").where("size(geo_polygon) >= 3 and zone_id is not null").select("zone_id", "geo_polygon").distinct()
    z = z.groupBy("zone_id").agg(F.count("*").alias("n"), F.first("geo_polygon").alias("geo_polygon")).where("n = 1")
    ring = F.transform("geo_polygon", lambda v: F.array(v["lon"], v["lat"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct("zone_id").alias("properties"))
    path = f"{shared_folder(spark)}/zones-{spark.sparkContext.applicationId}"
    z.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value")).repartition(F.col("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
    back = files.read_geojson_lines(spark, path)
    total = lambda k: F.aggregate("ring", F.lit(0.0), lambda a, v: a + v[k])
    return rounded(back.select(F.get_json_object("properties", "$.zone_id").alias("zone_id"), F.size("ring").alias("n"), total("lon").alias("lon"), total("lat").alias("lat")), 9, "lon", "lat")


@query(f"with {_COUNTS} select user_id, 'n' as \"name\", len(n) size, round(list_sum(n), 6) total from d union all select user_id, 'share', len(n), 1.0 from d")
def array_packets(spark: SparkSession, root: str) -> DataFrame:
    """Arrays packed as compressed archives and unpacked by name."""
    c = _counts(spark, root)
    packed = files.pack_arrays(c.withColumn("share", F.transform("n", lambda x: x / F.aggregate("n", F.lit(0.0), lambda a, y: a + y))), "user_id", ["n", "share"])
    return rounded(files.unpack_archives(packed, "user_id").select("user_id", "name", F.size("data").alias("size"), F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total")), 6, "total")


@query("""with c as (select i, i // 30 r, i % 30 c, abs(i % 30 - 15) f from range(1200) t(i)),
n as (select r, c, f, least(f::double, case when c <= 15 then abs(r - 10 - f) / 2.0::double else f end, case when c >= 15 then abs(r - 20 - f) / 2.0::double else f end, case when c <= 15 then abs(r - 30 - f) / 2.0::double else f end) near from c)
select 'grid' what, r a, c b, 0 t, round(r * 0.1 + f * 0.05 + near * 0.5 + (r * 30 + c) * 1e-6, 7) v from n
union all select 'ring', i, 0, 0, round((1 + cos(2 * pi() * i / 20)) / 2 + 10 * i / 20 + 100 * (1 + sin(6 * pi() * i / 20)) / 2, 7) from range(20) t(i)
union all select 'field', i % 12, i // 12 % 12, i // 144, round(exp(-(power(i % 12 - (4 + i // 144 * 0.1), 2) + power(i // 12 % 12 - 8, 2)) / 2 - 0.02 * (i // 144)) + exp(-(power(i % 12 - (8 + i // 144 * 0.2), 2) + power(i // 12 % 12 - (4 - i // 144 * 0.05), 2)) / 8 - 0.02 * (i // 144)), 7) from range(720) t(i)""")
def generated_surfaces(spark: SparkSession, root: str) -> DataFrame:
    """The generators' surfaces: branching channels, a landscape round a ring, and a field that drifts."""
    grid = raster.branching_grid(spark, 40, 30, 3).select(F.lit("grid").alias("what"), F.col("r").alias("a"), F.col("c").alias("b"), F.lit(0).alias("t"), F.col("z").alias("v"))
    ring = raster.ring_landscape(spark, 20).select(F.lit("ring").alias("what"), F.col("node").cast("int").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("t"), (F.col("loss") + 10 * F.col("cost") + 100 * F.col("info")).alias("v"))
    field = raster.drifting_field(spark, 12, 5, 2).select(F.lit("field").alias("what"), F.col("x").alias("a"), F.col("y").alias("b"), "t", F.col("value").alias("v"))
    return rounded(grid.unionByName(ring).unionByName(field), 7, "v")
