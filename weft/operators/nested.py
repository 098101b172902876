"""Deeply nested records into related flat tables, by Merkle subtree identities.

Every object of a payload (scene, node, region, claim, ring, edge) is put into one
canonical form, whatever its sender's key names, key order, envelope or way of
writing rings and numbers. Objects are hashed bottom-up: an object's identity covers
its own attributes and the identities of its children in order. Identical objects
are stored once; every occurrence is kept as a parent-child bridge row with its
role and ordinal, and every arrival as a root row.

Parsing is the one imperative step (the payloads' shapes are not fixed, so no
schema could be declared) and runs in Arrow batches, one pass, no shuffle. One
shuffle on the identity then removes repeats between tasks; repeats within a task
are removed before it.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.sources.tables import keep

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_FIRST_RING = re.compile(r"\(\s*([^()]*?)\s*\)")
#: Steps of a degree in which rings are stored where they are written so; others stay doubles.
STEPS = 1e7
_ID_KEYS = {"node": ("id", "node_id"), "region": ("id", "region_id"), "claim": ("id", "claim_id")}


def _text_to_json(value):
    """A JSON text inside a JSON string is opened; other values stay."""
    while isinstance(value, str) and value.lstrip("﻿ \t\r\n")[:1] in ("{", "[", '"'):
        try:
            value = json.loads(value.lstrip("﻿ \t\r\n"))
        except ValueError:
            return value
    return value


def read_payload(text: str | None):
    """The parsed payload, or None if it's null, blank or unreadable. Several JSON values in a row are read as a list."""
    if text is None:
        return None
    text = text.lstrip("﻿").strip()
    if not text:
        return None
    try:
        return _text_to_json(json.loads(text))
    except ValueError:
        pass
    except RecursionError:
        return None
    decoder, at, found = json.JSONDecoder(), 0, []
    try:
        while at < len(text):
            value, at = decoder.raw_decode(text, at)
            found.append(value)
            while at < len(text) and text[at] in " \t\r\n,":
                at += 1
    except (ValueError, RecursionError):
        return None
    return found


def scenes_in(value) -> Iterator[dict]:
    """Every object that holds nodes, at whatever depth of envelope, in order."""
    value = _text_to_json(value)
    if isinstance(value, dict):
        if "nodes" in value:
            yield value
        else:
            for v in value.values():
                if isinstance(v, (dict, list, str)):
                    yield from scenes_in(v)
    elif isinstance(value, list):
        for v in value:
            if isinstance(v, (dict, list, str)):
                yield from scenes_in(v)


def members(value, keys: tuple[str, ...]) -> list[tuple[str | None, dict]]:
    """Objects of a collection written as a list, one object, an object keyed by id, an object with items, or JSON text."""
    value = _text_to_json(value)
    if isinstance(value, list):
        return [(None, v) for v in map(_text_to_json, value) if isinstance(v, dict)]
    if not isinstance(value, dict) or not value:
        return []
    if isinstance(value.get("items"), (list, dict, str)):
        return members(value["items"], keys)
    if any(k in value for k in (*keys, "geo_polygon", "source_id", "native_label", "region", "claims")):
        return [(None, value)]
    return [(k, v) for k, v in ((k, _text_to_json(v)) for k, v in value.items()) if isinstance(v, dict)]


def _flat(points, out: list[float]) -> None:
    for p in points:
        if isinstance(p, dict):
            lon = next((p[k] for k in ("lon", "lng", "longitude", "x") if k in p), None)
            lat = next((p[k] for k in ("lat", "latitude", "y") if k in p), None)
            if lon is None or lat is None:
                raise ValueError("a vertex without coordinates")
            out += (float(lon), float(lat))
        elif isinstance(p, list):
            out += (float(p[0]), float(p[1]))
        else:
            out.append(float(p))


def ring_of(value) -> list[float]:
    """A ring as lon, lat, lon, lat, ... in the order written; empty if there is none.

    Accepted are pairs, objects, a flat list, numbers written as text, WKT, GeoJSON
    geometries and features, and JSON text of any of these. Of a polygon with holes
    the outer ring counts, of a multipolygon the first.
    """
    value = _text_to_json(value)
    if value is None:
        return []
    if isinstance(value, str):
        m = _FIRST_RING.search(value)
        numbers = [float(x) for x in _NUMBER.findall(m[1] if m else value)]
        if m and "," in m[1]:  # a vertex may have a height beside lon and lat
            size = len(numbers) // (m[1].count(",") + 1)
            if size > 2:
                numbers = [x for i in range(0, len(numbers), size) for x in numbers[i : i + 2]]
        return numbers[: len(numbers) // 2 * 2]
    if isinstance(value, dict):
        for key in ("coordinates", "geometry", "geo_polygon", "vertices", "points", "ring"):
            if key in value:
                return ring_of(value[key])
        return []
    while value and isinstance(value[0], list) and value[0] and isinstance(value[0][0], (list, dict)):
        value = value[0]
    out: list[float] = []
    try:
        _flat(value, out)
    except (TypeError, ValueError, IndexError, OverflowError):
        return []
    return out[: len(out) // 2 * 2]


#: Attributes that hold numbers, alone or within lists and objects. Others (names, references) stay as written: "007" is no 7.
_NUMERIC = frozenset(("score", "area", "bbox", "geo_bbox", "viewport", "weight", "confidence", "iou"))


def _number(value):
    """Numbers written as text become numbers, at any depth, so that both ways of writing hash alike."""
    if type(value) is float:
        return value
    if isinstance(value, str) or isinstance(value, int) and not isinstance(value, bool):
        try:
            return float(value)
        except (ValueError, OverflowError):
            opened = _text_to_json(value)
            return _number(opened) if isinstance(opened, (list, dict)) else value
    if isinstance(value, list):
        return [_number(v) for v in value]
    if isinstance(value, dict):
        return {k: _number(v) for k, v in value.items()}
    return value


#: Kinds of rows as numbers: files are written by kind, and numbers need no other order for that than the one that removes repeats.
KINDS = {k: i for i, k in enumerate(("root", "scene", "node", "region", "claim", "ring", "edge"))}
#: Roles as they enter identities.
_ROLES = {r: r.encode() for r in ("ring", "region", "claim", "node", "edge")}
#: Attributes in one way of writing; made once, as json.dumps would make an encoder for each object.
_write = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def _identity(kind: str, own: str | None, attrs: str, children: list[tuple]) -> bytes:
    head = f"{kind}\x00{'' if own is None else '=' + own}\x00{attrs}\x00".encode("utf-8", "surrogatepass")
    return blake2b(head + b"".join([_ROLES[c[0]] + c[2] for c in children]), digest_size=16).digest()


def in_steps(numbers: list[float]) -> list[int] | None:
    """Coordinates as whole steps of 1e-7 degrees, half the size of doubles, if that loses nothing; else None."""
    try:
        steps = [round(x * STEPS) for x in numbers]
    except (ValueError, OverflowError):
        return None
    return steps if steps and min(steps) >= -(2**31) and max(steps) < 2**31 and [i / STEPS for i in steps] == numbers else None


class MerkleStore:
    """Canonicalises and hashes payload objects bottom-up; hands out each object once per store."""

    def __init__(self, bound: int = 400_000):
        self.rows: list[tuple] = []
        self.seen: set[bytes] = set()
        self.bound = bound

    def put(self, kind: str, oid: bytes, *rest) -> None:
        if oid not in self.seen:
            if len(self.seen) >= self.bound:  # repeats between two fillings are removed by the shuffle
                self.seen.clear()
            self.seen.add(oid)
            self.rows.append((KINDS[kind], oid, *rest, None, None))

    def ring(self, value, children: list) -> int:
        numbers = ring_of(value)
        if not numbers:
            return 0
        oid = blake2b(b"ring\x00" + struct.pack(f"<{len(numbers)}d", *numbers), digest_size=16).digest()
        n = len(numbers) // 2
        if oid not in self.seen:
            steps = in_steps(numbers)
            self.seen.add(oid)
            self.rows.append((KINDS["ring"], oid, None, None, None, numbers if steps is None else None, n, None, None, steps))
        children.append(("ring", 0, oid, n, None))
        return n

    def object(self, kind: str, value: dict, own: str | None, children: list, skip: tuple, n_vertices=None, sg_idx=None) -> tuple[bytes, str | None]:
        for key in _ID_KEYS.get(kind, ()):
            if value.get(key) is not None:
                own = str(value[key])
                break
        if own is not None and not own.isascii():
            own = own.encode("utf-8", "replace").decode()  # half a surrogate pair is no text
        attrs = _write({k: _number(v) if k in _NUMERIC else v for k, v in value.items() if v is not None and k not in skip})
        if not attrs.isascii():
            attrs = attrs.encode("utf-8", "replace").decode()
        oid = _identity(kind, own, attrs, children)
        self.put(kind, oid, own, sg_idx, attrs, None, n_vertices, children)
        return oid, own

    def leaf(self, kind: str, value: dict, own: str | None, into: list, ordinal: int, skip: tuple) -> None:
        children: list = []
        n = self.ring(value.get("geo_polygon"), children)
        oid, own = self.object(kind, value, own, children, skip, n)
        into.append((kind, ordinal, oid, n, own))

    def node(self, value: dict, own: str | None) -> tuple[bytes, str | None]:
        children: list = []
        region = _text_to_json(value.get("region"))
        claims = members(value.get("claims"), _ID_KEYS["claim"])
        if isinstance(region, dict) and region:
            self.leaf("region", region, None, children, 0, ("id", "region_id", "geo_polygon", "claims"))
            claims = claims + members(region.get("claims"), _ID_KEYS["claim"])
        for i, (key, claim) in enumerate(claims):
            self.leaf("claim", claim, key, children, i, ("id", "claim_id", "geo_polygon"))
        return self.object("node", value, own, children, ("id", "node_id", "region", "claims"))

    def scene(self, value: dict, sg_idx) -> bytes:
        given = value.get("sg_idx")
        try:
            sg_idx = int(given) if given is not None else sg_idx
        except (TypeError, ValueError, OverflowError):
            pass
        if sg_idx is not None and not -(2**31) <= sg_idx < 2**31:
            sg_idx = None
        children: list = []
        for i, (key, node) in enumerate(members(value["nodes"], _ID_KEYS["node"])):
            oid, own = self.node(node, key)
            children.append(("node", i, oid, None, own))
        edges = _text_to_json(value.get("edges"))
        for i, edge in enumerate(edges if isinstance(edges, list) else []):
            if isinstance(edge, dict):
                oid, _ = self.object("edge", edge, None, [], ())
                children.append(("edge", i, oid, None, None))
        return self.object("scene", {**value, "sg_idx": sg_idx}, None, children, ("nodes", "edges"), None, sg_idx)[0]


def _batches(source, size: int = 20_000):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_entry_type())
    store = MerkleStore()

    def children_of(lists):
        """Children as one flat table and where each object's begin."""
        starts = np.concatenate([[0], np.cumsum([len(c) if c else 0 for c in lists])]).astype("int32")
        kind = schema.field("children").type
        flat = list(zip(*(c for group in lists if group for c in group))) or [()] * kind.value_type.num_fields
        parts = [pa.array(v, kind.value_type.field(k).type) for k, v in enumerate(flat)]
        return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(parts, fields=list(kind.value_type)), type=kind)

    def flush():
        cols = list(zip(*store.rows)) or [()] * len(schema)
        store.rows = []
        return pa.RecordBatch.from_arrays([children_of(c) if f.name == "children" else pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

    for batch in source:
        for rec, idx, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            parsed = read_payload(text.as_py())
            if parsed is None:
                continue
            kids = []
            try:
                for i, scene in enumerate(scenes_in(parsed)):
                    kids.append(("scene", i, store.scene(scene, idx), None, None))
            except RecursionError:  # nested beyond what can be walked: unreadable
                continue
            store.rows.append((KINDS["root"], None, None, None, None, None, None, kids, rec, None))
            if len(store.rows) >= size:
                yield flush()
    yield flush()


def _entry_type():
    """The entry schema without a session, so that executors can build it."""
    from pyspark.sql import types as T

    child = T.StructType([T.StructField("role", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("oid", T.BinaryType()), T.StructField("n_vertices", T.IntegerType()), T.StructField("id", T.StringType())])
    kinds = [("kind", T.IntegerType()), ("oid", T.BinaryType()), ("id", T.StringType()), ("sg_idx", T.IntegerType()), ("attrs", T.StringType()), ("ring", T.ArrayType(T.DoubleType())), ("n_vertices", T.IntegerType()), ("children", T.ArrayType(child)), ("rec_id", T.LongType()), ("steps", T.ArrayType(T.IntegerType()))]
    return T.StructType([T.StructField(a, b) for a, b in kinds])


@dataclass
class NestedTables:
    """The flat tables. stored holds each distinct object once, by the number of its kind; the rest are views of it."""

    stored: DataFrame

    @property
    def entries(self) -> DataFrame:
        """Everything stored, kinds by name."""
        return self.stored.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1))

    def _kind(self, kind: str) -> DataFrame:
        return self.stored.where(F.col("kind") == KINDS[kind])

    @property
    def roots(self) -> DataFrame:
        """rec_id, ordinal, oid: each arrival of a scene."""
        return self._kind("root").select("rec_id", F.explode("children").alias("c")).select("rec_id", "c.ordinal", "c.oid")

    @property
    def scenes(self) -> DataFrame:
        return self._kind("scene").select("oid", "sg_idx", "attrs")

    @property
    def nodes(self) -> DataFrame:
        return self._kind("node").select("oid", F.col("id").alias("node_id"), "attrs")

    @property
    def regions(self) -> DataFrame:
        return self._kind("region").select("oid", F.col("id").alias("region_id"), "attrs", "n_vertices")

    @property
    def claims(self) -> DataFrame:
        return self._kind("claim").select("oid", F.col("id").alias("claim_id"), "attrs", "n_vertices")

    @property
    def edges(self) -> DataFrame:
        return self._kind("edge").select("oid", "attrs")

    @property
    def vertices(self) -> DataFrame:
        """oid of the ring, vertex_no, lon, lat."""
        at = F.explode(F.sequence(F.lit(0), F.col("n_vertices") - 1)).alias("vertex_no")
        number = lambda k: F.coalesce(F.get("ring", k), F.get("steps", k) / STEPS)
        return self._kind("ring").select("oid", "ring", "steps", at).select("oid", "vertex_no", number(F.col("vertex_no") * 2).alias("lon"), number(F.col("vertex_no") * 2 + 1).alias("lat"))

    def bridge(self, parent: str) -> DataFrame:
        """parent_oid, role, ordinal, child_oid: every occurrence of a child in a distinct parent of the kind named."""
        return self._kind(parent).select(F.col("oid").alias("parent_oid"), F.explode("children").alias("c")).select("parent_oid", "c.role", "c.ordinal", F.col("c.oid").alias("child_oid"))


def flatten_scenes(raw: DataFrame, rec: str = "rec_id", sg_idx: str = "sg_idx", payload: str = "payload") -> NestedTables:
    """Flat tables of the scene graphs in a column of JSON payloads.

    Defined cases: a null, blank, cut-off or endlessly nested payload gives no rows; a scene number
    that is no 32-bit integer is null; an empty table gives
    empty tables; other columns are not read, so their names cannot clash; an object
    without an id keeps a null id; a region that is null, absent or empty is none; a
    repeated object is stored once and each occurrence stays in the bridge; each row with a
    readable payload is an arrival with its own roots, if its record id is null or repeated too.
    """
    source = raw.select(F.col(rec).cast("long").alias("rec_id"), F.col(sg_idx).cast("int").alias("sg_idx"), F.col(payload).cast("string").alias("payload"))
    parsed = source.mapInArrow(_batches, _entry_type())
    # A root has no identity, it is an arrival: a number of its own keeps it apart from all others, whatever its record id.
    keyed = parsed.withColumn("oid", F.coalesce("oid", F.concat(F.lit("root"), F.monotonically_increasing_id().cast("string")).cast("binary")))
    # Repeats between tasks are few, so rows are sorted once, after the shuffle: by kind and identity, which is also the order they are written in.
    return NestedTables(keep(keyed.repartition(F.col("oid")).dropDuplicates(["kind", "oid"]), "kind"))


def ring_vertices(tables: NestedTables) -> DataFrame:
    """Each vertex of each region's and claim's ring with its scene and node: sg_idx, node_id, child_kind, child_id, vertex_no.

    A ring-less child is one row with vertex_no -1. Rings are not read: each child's
    row in the bridge has its vertex count, and rows are made distinct before they are
    spread over vertices.
    """
    placed = tables._kind("scene").select("sg_idx", F.explode("children").alias("c")).where("c.role = 'node'").select("sg_idx", F.col("c.oid").alias("oid")).distinct()
    kids = tables._kind("node").select("oid", F.col("id").alias("node_id"), F.explode("children").alias("c"))
    own = (
        placed.join(kids, "oid")
        .groupBy("sg_idx", "node_id", F.col("c.role").alias("child_kind"), F.col("c.id").alias("child_id"))
        .agg(F.max("c.n_vertices").alias("most"), F.min("c.n_vertices").alias("least"))
    )
    numbers: Column = F.when(F.col("most") == 0, F.array(F.lit(-1))).when(F.col("least") == 0, F.sequence(F.lit(-1), F.col("most") - 1)).otherwise(F.sequence(F.lit(0), F.col("most") - 1))
    return own.select("sg_idx", "node_id", "child_kind", "child_id", F.explode(numbers).alias("vertex_no"))
