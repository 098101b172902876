"""Queries for the problems of training-data pipelines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import groups, leaks, reading, tokens
from weft.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Each matched node with the id of its group."""
    pairs = groups.resolve_pairs(table(spark, root, "node_matches"), table(spark, root, "scene_nodes"))
    return groups.linked_groups(pairs).withColumnRenamed("node", "node_id")


def vocabulary_path(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> str:
    """The public tokenizers' file; the setting spark.weft.tokenizers names another folder."""
    folder = spark.conf.get("spark.weft.tokenizers", None)
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return f"{folder}/{name}"


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of each document."""
    return tokens.encode_corpus(table(spark, root, "documents"), vocabulary_path(spark))


def p6_decoded(spark: SparkSession, root: str) -> DataFrame:
    """Texts decoded from their ids: what was encoded, with an empty text for a null one."""
    return tokens.decode_corpus(p6_ids(spark, root), vocabulary_path(spark))


def p7_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold evaluation items, how many of an item's words, and where in the text."""
    return leaks.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold at least a third of an evaluation item."""
    return p7_leaks(spark, root).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Band of the reader of each document of running English text."""
    return reading.reading_bands(table(spark, root, "documents"), table(spark, root, "reading_labels"))


QUERIES = {"p2_found": p2_found, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found}

SQL: dict[str, str] = {
    "p2_found": """
with recursive n as (select distinct lower(trim(node_id, ' ' || chr(9) || chr(10) || chr(13))) id, node_id, sg_idx, least(bbox.x1,bbox.x2) x1, least(bbox.y1,bbox.y2) y1, greatest(bbox.x1,bbox.x2) x2, greatest(bbox.y1,bbox.y2) y2 from scene_nodes where node_id is not null),
m as (select match_id, sg_a sg, nullif(lower(trim(node_a, ' ' || chr(9) || chr(10) || chr(13))), '') id, bbox_a b, 'a' side from node_matches where matched union all
  select match_id, sg_b, nullif(lower(trim(node_b, ' ' || chr(9) || chr(10) || chr(13))), ''), bbox_b, 'b' from node_matches where matched),
r as (select match_id, side, n.id from m join n on m.id = n.id union
  select match_id, side, n.id from m join n on m.id is null and m.sg = n.sg_idx
   where abs(least(b.x1,b.x2)-n.x1)<=0.001 and abs(least(b.y1,b.y2)-n.y1)<=0.001 and abs(greatest(b.x1,b.x2)-n.x2)<=0.001 and abs(greatest(b.y1,b.y2)-n.y2)<=0.001),
e as (select distinct a.id u, b.id v from r a join r b using (match_id) where a.side='a' and b.side='b' and a.id<>b.id),
ee as (select u, v from e union select v, u from e),
reach(s, t) as (select u, u from ee union select r.s, ee.v from reach r join ee on r.t = ee.u)
select n.node_id, g.group_id from (select s id, min(t) group_id from reach group by s) g join (select distinct id, node_id from n) n using (id)
""",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
