"""Files: meshes, tables of positions, tiles, packets and results."""

from __future__ import annotations

import gzip
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (path, id, x, y, z) and faces (path, a, b, c) of OBJ files; ids start at 1 in each file, other lines are skipped.

    A vertex's id is its place among the file's vertex lines, so each file is read whole.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).select("path", "line", F.split(F.trim("text"), r"\s+").alias("w"))
    from pyspark.sql import Window

    v = lines.where("w[0] = 'v' and size(w) >= 4").withColumn("id", F.row_number().over(Window.partitionBy("path").orderBy("line")))
    index = lambda k: F.split(F.col("w")[k], "/")[0].cast("long")
    f = lines.where("w[0] = 'f' and size(w) >= 4").select("path", index(1).alias("a"), index(2).alias("b"), index(3).alias("c"))
    return v.select("path", "id", *(F.col("w")[k + 1].cast("double").alias(c) for k, c in enumerate("xyz"))), f


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One OBJ text of a mesh; vertex lines first, in order of id."""
    v = vertices.select(F.lit(0).alias("part"), F.col("id").alias("n"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    f = faces.select(F.lit(1).alias("part"), F.col("a").alias("n"), F.concat_ws(" ", F.lit("f"), "a", "b", "c").alias("value"))
    v.unionByName(f).repartitionByRange(1, "part", "n").sortWithinPartitions("part", "n").select("value").write.mode("overwrite").text(path)


def read_positions(spark: SparkSession, path: str, header: bool = False, schema: str = "lon double, lat double") -> DataFrame:
    """CSV of positions; rows that don't fit the schema are dropped."""
    return spark.read.csv(path, schema=schema, header=header, mode="DROPMALFORMED")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature_no, geometry type, ring of lon/lat and properties (JSON) of the features of GeoJSON files."""
    return _features(spark.read.option("wholetext", True).text(path))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one collection of features a line, which are split between tasks."""
    return _features(spark.read.text(path))


def _features(texts: DataFrame) -> DataFrame:
    kind = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:string>>"
    rows = texts.select(F.from_json("value", kind).alias("j")).select(F.posexplode("j.features").alias("feature_no", "f"))
    ring = F.when(F.col("f.geometry.type") == "Polygon", F.from_json("f.geometry.coordinates", "array<array<array<double>>>")[0])
    return rows.select("feature_no", F.col("f.geometry.type").alias("type"), F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("ring"), F.col("f.properties").alias("properties"))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """zoom_level, tile_column, tile_row, tile_data of an MBTiles (SQLite) file that all executors can read; one partition for each zoom level and band of columns."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        bands = db.execute("select distinct zoom_level, tile_column / 64 from tiles order by 1, 2").fetchall()

    def read(batches):
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for pdf in batches:
                for zoom, band in zip(pdf.zoom, pdf.band):
                    got = db.execute("select zoom_level, tile_column, tile_row, tile_data from tiles where zoom_level = ? and tile_column / 64 = ?", (int(zoom), int(band))).fetchall()
                    yield pd.DataFrame(got, columns=["zoom_level", "tile_column", "tile_row", "tile_data"])

    what = "zoom_level int, tile_column int, tile_row int, tile_data binary"
    if not bands:
        return spark.createDataFrame([], what)
    return spark.createDataFrame(bands, "zoom int, band int").repartition(len(bands)).mapInPandas(read, what)


def tile_summary(tiles: DataFrame) -> DataFrame:
    """zoom_level, tiles, columns, rows."""
    return tiles.groupBy("zoom_level").agg(F.count("*").alias("tiles"), F.countDistinct("tile_column").alias("columns"), F.countDistinct("tile_row").alias("rows"))


def decode_varints(data: bytes) -> list[int]:
    """Unsigned integers of seven bits a byte, the low ones first."""
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value)
            value, shift = 0, 0
    return out


def zigzag(n: int) -> int:
    """Signed integer of an unsigned code 0, -1, 1, -2, ..."""
    return n // 2 if n % 2 == 0 else -(n + 1) // 2


def pack_arrays(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, packet: named float arrays of each row as one compressed binary."""

    def run(batches):
        for pdf in batches:
            packets = []
            for row in pdf.itertuples(index=False):
                buffer = io.BytesIO()
                np.savez_compressed(buffer, **{c: np.asarray(getattr(row, c), float) for c in columns})
                packets.append(buffer.getvalue())
            yield pd.DataFrame({key: pdf[key], "packet": packets})

    return rows.select(key, *columns).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, packet binary")


def unpack_arrays(packets: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The arrays back."""

    def run(batches):
        for pdf in batches:
            out = {key: pdf[key], **{c: [] for c in columns}}
            for packet in pdf["packet"]:
                with np.load(io.BytesIO(packet)) as z:
                    for c in columns:
                        out[c].append(z[c].tolist())
            yield pd.DataFrame(out)

    return packets.select(key, "packet").mapInPandas(run, f"{key} {dict(packets.dtypes)[key]}, " + ", ".join(f"{c} array<double>" for c in columns))


def write_results(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A result as JSON lines or as CSV with a header."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def read_settings(text: str) -> dict:
    """A flat configuration of 'key: value' lines with JSON-like values and # comments; nested blocks are indented by two blanks."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        if not body.strip():
            continue
        depth = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if not value.strip():
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
        else:
            try:
                stack[-1][1][key] = json.loads(value)
            except ValueError:
                stack[-1][1][key] = value.strip()
    return root


def city_grid(spark: SparkSession, side: int, spacing: float, jitter: float, seed: int = 0) -> DataFrame:
    """id, x, y of buildings on a grid with seeded jitter."""
    noise = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003 - 0.5) * 2 * jitter
    return spark.range(side * side).select("id", (F.col("id") % side * spacing + noise(1)).alias("x"), (F.floor(F.col("id") / side) * spacing + noise(2)).alias("y"))


def city_fringe(spark: SparkSession, n: int, clusters: int, size: float, spread: float, seed: int = 0) -> DataFrame:
    """id, x, y of buildings in loose clusters."""
    u = lambda of, k: F.pmod(F.xxhash64(of, F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003
    c = F.col("id") % clusters
    angle, radius = 6.283185307179586 * u(F.col("id"), 3), spread * F.sqrt(-2 * F.ln(F.greatest(u(F.col("id"), 4), F.lit(1e-9))))
    return spark.range(n).select("id", (size * u(c, 1) + radius * F.cos(angle)).alias("x"), (size * u(c, 2) + radius * F.sin(angle)).alias("y"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels and pixels (r, c, red, green, blue from 0 to 1) of images, decoded by Spark's own source; unreadable files are dropped."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)[:, :, ::-1][:, :, -3:] / 255.0
                a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a
                r, c = np.divmod(np.arange(row.height * row.width), row.width)
                yield pd.DataFrame({"path": row.origin, "r": r, "c": c, "red": a[:, :, 0].ravel(), "green": a[:, :, 1].ravel(), "blue": a[:, :, 2].ravel()})

    return raw.mapInPandas(run, "path string, r int, c int, red double, green double, blue double")


# The graph stream file's mark, its header (mark, flags, number of arrays, nodes, rows, columns, beta0, beta1, modes), and its array types.
STREAM_MARK, STREAM_HEADER, STREAM_TYPES = b"KCG1", "<4sHHiiiiii", {1: "<i4", 2: "<f8", 3: "<f4"}


def pack_stream(head: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """One graph stream file: a header, then each array as name, type, shape and raw little-endian values."""
    codes = {v: k for k, v in STREAM_TYPES.items()}
    out = [struct.pack(STREAM_HEADER, STREAM_MARK, int("cell_index" in arrays), len(arrays), *(int(head.get(k, 0)) for k in ("nodes", "rows", "columns", "beta0", "beta1", "modes")))]
    for name, a in arrays.items():
        kind = np.asarray(a).dtype.newbyteorder("<").str
        if kind not in codes or not name.isascii() or len(name) > 255:
            raise ValueError(f"an array {name!r} of type {kind} can't be written")
        a = np.ascontiguousarray(a, kind)
        out += [struct.pack("<BBBH", len(name), codes[kind], a.ndim, 0), name.encode(), struct.pack(f"<{a.ndim}i", *a.shape), struct.pack("<Q", a.nbytes), a.tobytes()]
    return b"".join(out)


def unpack_stream(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """Header and arrays of a graph stream file; raises ValueError if it is cut short or of another kind."""
    try:
        mark, flags, count, *numbers = struct.unpack_from(STREAM_HEADER, data)
        if mark != STREAM_MARK:
            raise ValueError("not a graph stream file")
        at, arrays = struct.calcsize(STREAM_HEADER), {}
        for _ in range(count):
            size, code, dims, _ = struct.unpack_from("<BBBH", data, at)
            at += 5
            name = data[at : at + size].decode("ascii")
            shape = struct.unpack_from(f"<{dims}i", data, at + size)
            (nbytes,) = struct.unpack_from("<Q", data, at + size + 4 * dims)
            at += size + 4 * dims + 8
            values = np.frombuffer(data[at : at + nbytes], STREAM_TYPES[code])
            if len(data) < at + nbytes:
                raise ValueError("cut short")
            arrays[name] = values.reshape(shape)
            at += nbytes
    except (struct.error, KeyError, UnicodeDecodeError) as e:
        raise ValueError(f"not a whole graph stream file: {e}") from e
    return dict(zip(("nodes", "rows", "columns", "beta0", "beta1", "modes"), numbers), has_cells=bool(flags & 1)), arrays


def unpack_streams(packets: DataFrame, key: str, packet: str = "packet") -> DataFrame:
    """key, name, kind, shape, data (array of doubles) of every array of graph stream files held in a column; those that aren't whole give no rows."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, content in zip(pdf[key], pdf[packet]):
                try:
                    _, arrays = unpack_stream(bytes(content or b""))
                except ValueError:
                    continue
                rows += [(k, name, a.dtype.str, list(a.shape), a.astype(float).ravel().tolist()) for name, a in arrays.items()]
            yield pd.DataFrame(rows, columns=[key, "name", "kind", "shape", "data"])

    return packets.select(key, packet).mapInPandas(run, f"{key} {dict(packets.dtypes)[key]}, name string, kind string, shape array<int>, data array<double>")


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """path, name, kind, shape, data of every array of the graph stream files under a path; see unpack_streams."""
    return unpack_streams(spark.read.format("binaryFile").load(path).select("path", "content"), "path", "content")


def unpack_archives(packets: DataFrame, key: str, packet: str = "packet") -> DataFrame:
    """key, name, kind, shape, data of every array in compressed array archives, whatever their names and types; unreadable ones give no rows."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, content in zip(pdf[key], pdf[packet]):
                try:
                    with np.load(io.BytesIO(bytes(content))) as z:
                        rows += [(k, name, z[name].dtype.str, list(z[name].shape), np.asarray(z[name], float).ravel().tolist()) for name in z.files]
                except (ValueError, OSError, EOFError, TypeError, zipfile.BadZipFile):
                    continue
            yield pd.DataFrame(rows, columns=[key, "name", "kind", "shape", "data"])

    return packets.select(key, packet).mapInPandas(run, f"{key} {dict(packets.dtypes)[key]}, name string, kind string, shape array<int>, data array<double>")


def _fields(data: bytes):
    """Number, wire type and value of each field of a message of tagged fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            return
        yield number, wire, value


def tile_rings(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Parts of a tile's geometry: 1 moves and begins a part, 2 draws on, 7 closes it; steps are zigzag coded."""
    rings, ring, x, y, at = [], [], 0, 0, 0
    while at < len(commands):
        what, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if what == 7:
            if ring:
                rings.append(ring)
            ring = []
            continue
        if what not in (1, 2):
            break
        for _ in range(count):
            if at + 1 >= len(commands):
                break
            x, y, at = x + zigzag(commands[at]), y + zigzag(commands[at + 1]), at + 2
            if what == 1 and ring:
                rings.append(ring)
                ring = []
            ring.append((x, y))
    return [*rings, ring] if ring else rings


def decode_tile(data: bytes) -> list[tuple[str, int, int, int, list[tuple[float, float]]]]:
    """layer, feature, geometry type, part and its points (shares of the tile's side) of one vector tile, packed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out = []
    for number, wire, layer in _fields(data):
        if number != 3 or wire != 2:
            continue
        name, extent, features = "", 4096, []
        for n, w, value in _fields(layer):
            if n == 1 and w == 2:
                name = value.decode("utf-8", "replace")
            elif n == 5 and w == 0:
                extent = value
            elif n == 2 and w == 2:
                features.append(value)
        for k, feature in enumerate(features):
            kind, commands = 0, []
            for n, w, value in _fields(feature):
                if n == 3 and w == 0:
                    kind = value
                elif n == 4:
                    commands += decode_varints(value) if w == 2 else [value]
            out += [(name, k, kind, part, [(x / extent, y / extent) for x, y in ring]) for part, ring in enumerate(tile_rings(commands))]
    return out


def tile_features(tiles: DataFrame) -> DataFrame:
    """zoom_level, tile_column, tile_row, layer, feature, kind, part, ring (x, y as shares of the side, from the north-west) of vector tiles; tiles that can't be decoded give no rows."""

    def run(batches):
        for pdf in batches:
            rows = []
            for z, c, r, data in zip(pdf["zoom_level"], pdf["tile_column"], pdf["tile_row"], pdf["tile_data"]):
                try:
                    rows += [(z, c, r, layer, feature, kind, part, [{"x": x, "y": y} for x, y in ring]) for layer, feature, kind, part, ring in decode_tile(bytes(data))]
                except (IndexError, OSError, EOFError, zlib.error):
                    continue
            yield pd.DataFrame(rows, columns=["zoom_level", "tile_column", "tile_row", "layer", "feature", "kind", "part", "ring"])

    return tiles.select("zoom_level", "tile_column", "tile_row", "tile_data").mapInPandas(run, "zoom_level int, tile_column int, tile_row int, layer string, feature int, kind int, part int, ring array<struct<x:double,y:double>>")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (path, id, data) and edges (path, src, dst, data) of GraphML files; data maps attribute names to texts. A file is one task's."""
    import xml.etree.ElementTree as tree

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    root = tree.fromstring(bytes(content))
                except tree.ParseError:
                    continue
                bare = lambda e: e.tag.rsplit("}", 1)[-1]
                names = {e.get("id"): e.get("attr.name", e.get("id")) for e in root.iter() if bare(e) == "key"}
                for e in root.iter():
                    if bare(e) in ("node", "edge"):
                        held = {names.get(d.get("key"), d.get("key")): d.text or "" for d in e if bare(d) == "data"}
                        rows.append((file, bare(e), e.get("id"), e.get("source"), e.get("target"), held))
            yield pd.DataFrame(rows, columns=["path", "what", "id", "src", "dst", "data"])

    every = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, what string, id string, src string, dst string, data map<string,string>")
    return every.where("what = 'node'").select("path", "id", "data"), every.where("what = 'edge'").select("path", "src", "dst", "data")


def edf_samples(content: bytes) -> list[tuple[str, float, np.ndarray]]:
    """label, samples a second and values of each channel of a European Data Format recording."""
    texts = lambda at, size, n: [content[at + i * size : at + (i + 1) * size].decode("ascii", "replace").strip() for i in range(n)]
    records, seconds, n = int(content[236:244]), float(content[244:252]), int(content[252:256])
    # Widths of the header's columns, one block for each over all channels.
    widths, at, columns = (16, 80, 8, 8, 8, 8, 8, 80, 8, 32), 256, []
    for w in widths:
        columns.append(texts(at, w, n))
        at += w * n
    labels, low, high, least, most, sizes = columns[0], *([float(x) for x in columns[k]] for k in (3, 4, 5, 6)), [int(x) for x in columns[8]]
    raw = np.frombuffer(content[at:], "<i2")
    raw = raw[: len(raw) // sum(sizes) * sum(sizes)].reshape(-1, sum(sizes))[: records if records >= 0 else None]
    out, start = [], 0
    for k in range(n):
        part = raw[:, start : start + sizes[k]].ravel().astype(float)
        start += sizes[k]
        out.append((labels[k], sizes[k] / seconds, (part - least[k]) / (most[k] - least[k]) * (high[k] - low[k]) + low[k]))
    return out


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    """path, channel, label, sample, t (seconds into the recording), value of European Data Format files as a long table; a file is one task's, unreadable ones give no rows."""

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    channels = edf_samples(bytes(content))
                except (ValueError, IndexError, ZeroDivisionError):
                    continue
                for k, (label, rate, values) in enumerate(channels):
                    n = np.arange(len(values))
                    yield pd.DataFrame({"path": file, "channel": k, "label": label, "sample": n, "t": n / rate, "value": values})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, channel int, label string, sample long, t double, value double")
