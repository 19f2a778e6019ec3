"""Binary point formats: PLY, PCD, scanner messages and occupancy trees, decoded in Arrow batches.

Files come in through Spark's binaryFile (one record a file, split over executors); PLY is
also registered as a data source of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Type names and codes of the formats.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8"}
PLY_TYPES |= {"int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
FIELD_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def ply_header(data: bytes) -> tuple[int, int, list[tuple[str, str]], str]:
    """(bytes of the header, vertex rows, fields, format) of a PLY whose first element is its vertices."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("no PLY header")
    stop = data.index(b"\n", end) + 1
    fields, rows, form, inside = [], 0, "", False
    for line in data[:stop].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            rows = int(w[2]) if inside else rows
        elif w[:1] == ["property"] and inside:
            if w[1] == "list":
                raise ValueError("vertices with lists are not supported")
            fields.append((w[2], PLY_TYPES[w[1]]))
    return stop, rows, fields, form


def ply_vertices(data: bytes) -> pd.DataFrame:
    start, rows, fields, form = ply_header(data)
    names = [n for n, _ in fields]
    if form == "ascii":
        lines = data[start:].split(b"\n")[:rows]
        return pd.DataFrame([list(map(float, x.split()))[: len(names)] for x in lines], columns=names)
    order = ">" if form == "binary_big_endian" else "<"
    a = np.frombuffer(data, np.dtype([(n, order + t) for n, t in fields]), rows, start)
    return pd.DataFrame({n: a[n].astype(float) for n in names})


def ply_elements(data: bytes) -> dict[str, pd.DataFrame]:
    """All elements of a binary PLY, in order of the header; elements with lists are an error."""
    stop = data.index(b"\n", data.find(b"end_header")) + 1
    found: list[tuple[str, int, list[tuple[str, str]]]] = []
    order = "<"
    for line in data[:stop].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            if w[1] == "ascii":
                raise ValueError("only binary files have several elements here")
            order = ">" if w[1] == "binary_big_endian" else "<"
        elif w[:1] == ["element"]:
            found.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            if w[1] == "list":
                raise ValueError("elements with lists are not supported")
            found[-1][2].append((w[2], order + PLY_TYPES[w[1]]))
    out, at = {}, stop
    for name, rows, fields in found:
        a = np.frombuffer(data, np.dtype(fields), rows, at)
        out[name] = pd.DataFrame({n: a[n].astype(a[n].dtype.newbyteorder("=")) for n, _ in fields})
        at += a.nbytes
    return out


def pcd_points(data: bytes) -> pd.DataFrame:
    """Points of an ascii or binary PCD; of fields with several values the first is given, padding fields (_) are skipped. Compressed bodies are an error."""
    head: dict[str, list[str]] = {}
    at = 0
    while True:
        stop = data.index(b"\n", at)
        w = data[at:stop].decode("ascii", "replace").split()
        at = stop + 1
        if w and not w[0].startswith("#"):
            head[w[0]] = w[1:]
            if w[0] == "DATA":
                break
    names, n = head["FIELDS"], int(head["POINTS"][0])
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    places = np.cumsum([0, *counts])[:-1]
    wanted = {f: k for k, f in enumerate(names) if f != "_"}
    if head["DATA"][0] == "ascii":
        rows = [x.split() for x in data[at:].decode("ascii").splitlines()[:n]]
        return pd.DataFrame({f: [float(r[places[k]]) for r in rows] for f, k in wanted.items()}, columns=list(wanted))
    if head["DATA"][0] != "binary":
        raise ValueError("compressed PCD is not supported")
    kinds = [{"F": "f", "I": "i", "U": "u"}[t] + s for t, s in zip(head["TYPE"], head["SIZE"])]
    a = np.frombuffer(data, np.dtype([(f"f{k}", "<" + kind, (c,)) for k, (kind, c) in enumerate(zip(kinds, counts))]), n, at)
    return pd.DataFrame({f: a[f"f{k}"][:, 0].astype(float) for f, k in wanted.items()}, columns=list(wanted))


def _points(files: DataFrame, decode, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                d = decode(bytes(content))
                out = pd.DataFrame({"path": path, "row": np.arange(len(d))})
                for c in columns:
                    out[c] = d[c].to_numpy(float) if c in d else np.nan
                yield out

    return files.select("path", "content").mapInPandas(run, schema)


def read_ply(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(path, row, columns) of PLY files; columns a file lacks are null."""
    return _points(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), ply_vertices, columns)


def read_pcd(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return _points(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), pcd_points, columns)


def _head(uri: str, end: bytes, most: int = 1 << 20) -> bytes:
    """The start of a file up to `end`, read in small steps; an error if it is not within `most` bytes."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
    data = b""
    with system.open_input_stream(path) as f:
        while end not in data:
            part = f.read(1 << 14)
            if not part or len(data) > most:
                raise ValueError(f"no header in {uri}")
            data += part
    return data


def ply_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows) from the headers alone: the listing is Spark's, and of a file only its head is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "rows": [ply_header(_head(p, b"end_header\n"))[1] for p in b["path"]]})

    return files.mapInPandas(run, "path string, rows bigint")


def scan_points(messages: DataFrame, nearest: float, furthest: float) -> DataFrame:
    """(scan, x, y, z, r) of messages (scan, data, point_step, big_endian, fields: name, offset, datatype): finite and strictly within the range.

    Images of points (height, width, row_step given) may have padded rows, which is cut off.
    """
    padded = {"height", "width", "row_step"} <= set(messages.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m in b.itertuples():
                order = ">" if m.big_endian else "<"
                kinds = {f["name"]: (order + FIELD_TYPES[f["datatype"]], f["offset"]) for f in m.fields}
                dt = np.dtype({"names": list("xyz"), "formats": [kinds[c][0] for c in "xyz"], "offsets": [kinds[c][1] for c in "xyz"], "itemsize": m.point_step})
                data = m.data
                if padded and m.row_step > m.width * m.point_step:
                    rows = np.frombuffer(data, np.uint8)[: m.height * m.row_step].reshape(m.height, m.row_step)
                    data = np.ascontiguousarray(rows[:, : m.width * m.point_step]).tobytes()
                a = np.frombuffer(data, dt)
                p = np.stack([a[c].astype(float) for c in "xyz"], axis=1)
                r = np.sqrt((p * p).sum(axis=1))
                with np.errstate(invalid="ignore"):
                    ok = np.isfinite(r) & (r > nearest) & (r < furthest)
                yield pd.DataFrame({"scan": m.scan, "x": p[ok, 0], "y": p[ok, 1], "z": p[ok, 2], "r": r[ok]})

    return messages.mapInPandas(run, "scan bigint, x double, y double, z double, r double")


def octree_leaves(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(depth, state, kx, ky, kz) of a bit-packed occupancy tree, depth first, two bits a child: 1 free, 2 occupied, 3 inner, 0 unknown."""
    out: list[tuple[int, int, int, int, int]] = []
    at = 0
    stack = [(0, 0, 0, 0)]
    while stack:
        depth, x, y, z = stack.pop()
        if at + 2 > len(data):
            raise ValueError("the tree ends early")
        (bits,) = struct.unpack_from("<H", data, at)
        at += 2
        inner = []
        for child in range(8):
            state = bits >> (2 * child) & 3
            key = (depth + 1, x << 1 | child & 1, y << 1 | child >> 1 & 1, z << 1 | child >> 2 & 1)
            if state == 3:
                inner.append(key)
            elif state:
                out.append((key[0], state, *key[1:]))
        stack += reversed(inner)
    return out


def read_octrees(files: DataFrame) -> DataFrame:
    """(path, depth, state, kx, ky, kz) of files (path, content) with a text header that ends in a `data` line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                content = bytes(content)
                body = content[content.index(b"\ndata\n") + 6 :]
                yield pd.DataFrame([(path, *leaf) for leaf in octree_leaves(body)], columns=["path", "depth", "state", "kx", "ky", "kz"])

    return files.select("path", "content").mapInPandas(run, "path string, depth int, state int, kx bigint, ky bigint, kz bigint")


def _lerp_codes(word: Column, chunk: list[tuple[str, str, int, int]]) -> list[Column]:
    """Values of bit fields (low, high, shift, bits) of a 32-bit word, between the ends of their chunk."""
    w = word.cast("bigint").bitwiseAND(0xFFFFFFFF)
    share = [F.shiftrightunsigned(w, shift).bitwiseAND((1 << bits) - 1) / float((1 << bits) - 1) for _, _, shift, bits in chunk]
    return [F.col(lo) * (1 - t) + F.col(hi) * t for (lo, hi, _, _), t in zip(chunk, share)]


# Shifts and widths of the packed words of a compressed splat.
BITS_XYZ = ((21, 11), (11, 10), (0, 11))
BITS_RGB = ((24, 8), (16, 8), (8, 8))


def unpack_splats(rows: DataFrame, chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, row, x, y, z, scale_x.., r, g, b, opacity, q) of packed splats (row, position, scale, colour, rotation; words of 32 bits).

    chunks has the ends of every 256 rows: chunk, lo_x, hi_x, .., lo_scale_x, .., lo_r, ... Colours
    are 0 to 1 within their chunk's ends, opacity is the logit of the colour's last eight bits
    (infinite at the ends), q the quaternion of smallest three.
    """
    from sensorloom.functions.geometry import logit
    from sensorloom.functions.keys import unpack_quat

    by = by or []
    j = rows.withColumn("chunk", F.floor(F.col("row") / 256)).join(chunks, [*by, "chunk"])
    place = _lerp_codes(F.col("position"), [(f"lo_{c}", f"hi_{c}", *b) for c, b in zip("xyz", BITS_XYZ)])
    scale = _lerp_codes(F.col("scale"), [(f"lo_scale_{c}", f"hi_scale_{c}", *b) for c, b in zip("xyz", BITS_XYZ)])
    colour = _lerp_codes(F.col("colour"), [(f"lo_{c}", f"hi_{c}", *b) for c, b in zip("rgb", BITS_RGB)])
    a = F.col("colour").cast("bigint").bitwiseAND(255) / 255.0
    opacity = F.when(a <= 0, float("-inf")).when(a >= 1, float("inf")).otherwise(logit(a))
    named = [*zip("xyz", place), *zip(("scale_x", "scale_y", "scale_z"), scale), *zip("rgb", colour)]
    return j.select(*by, "row", *[v.alias(n) for n, v in named], opacity.alias("opacity"), unpack_quat(F.col("rotation")).alias("q"))


# Elements and properties of packed splat files.
PACKED_WORDS = {"position": "packed_position", "scale": "packed_scale", "colour": "packed_color", "rotation": "packed_rotation"}
PACKED_ENDS = [*"xyz", "scale_x", "scale_y", "scale_z", *"rgb"]


def read_packed_ply(spark: SparkSession, path: str) -> DataFrame:
    """unpack_splats of packed splat files, with their path. Files without ends of colours have 0 and 1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = [f"{e}_{c}" for c in PACKED_ENDS for e in ("lo", "hi")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                v = ply_elements(bytes(content))["vertex"]
                yield pd.DataFrame({"path": p, "row": np.arange(len(v)), **{k: v[n].to_numpy().astype(np.int64) for k, n in PACKED_WORDS.items()}})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                c = ply_elements(bytes(content))["chunk"]
                ends = {f"{e}_{a}": c[f"{n}_{a}"].to_numpy(float) if f"{n}_{a}" in c else np.full(len(c), float(n == "max")) for a in PACKED_ENDS for e, n in (("lo", "min"), ("hi", "max"))}
                yield pd.DataFrame({"path": p, "chunk": np.arange(len(c)), **ends})

    f = files.select("path", "content")
    r = f.mapInPandas(rows, "path string, row bigint, position bigint, scale bigint, colour bigint, rotation bigint")
    c = f.mapInPandas(chunks, "path string, chunk bigint, " + ", ".join(f"{n} double" for n in names))
    return unpack_splats(r, c, ["path"])


def unpack_chunks(rows: DataFrame, chunks: DataFrame, word: str = "position") -> DataFrame:
    """(row, x, y, z) of 11-10-11 bit words, lerped between the ends of their chunk of 256 rows (chunk, lo_*, hi_*)."""
    j = rows.withColumn("chunk", F.floor(F.col("row") / 256)).join(chunks, "chunk")
    xyz = _lerp_codes(F.col(word), [(f"lo_{c}", f"hi_{c}", *b) for c, b in zip("xyz", BITS_XYZ)])
    return j.select("row", *[v.alias(c) for c, v in zip("xyz", xyz)])


class PlySource(DataSource):
    """spark.read.format("ply").option("columns", "x,y,z").load(path): one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        columns = self.options.get("columns", "x,y,z").split(",")
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PlyReader(schema, self.options["path"])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _PlyReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str):
        self.schema, self.path = schema, path

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "**", "*.ply"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            d = ply_vertices(f.read())
        cols = [d[c].tolist() if c in d else [float("nan")] * len(d) for c in self.schema.names[2:]]
        for i, row in enumerate(zip(*cols)):
            yield (partition.path, i, *row)


def ply_bytes(points: pd.DataFrame, columns: list[str]) -> bytes:
    """A binary little-endian PLY of float columns, in the given order."""
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(points)}", *[f"property float {c}" for c in columns], "end_header", ""]
    a = np.zeros(len(points), np.dtype([(c, "<f4") for c in columns]))
    for c in columns:
        a[c] = points[c].to_numpy()
    return "\n".join(head).encode() + a.tobytes()


def write_ply_parts(points: DataFrame, folder: str, columns: list[str]) -> DataFrame:
    """(file, rows): writes each partition's points as one PLY into a folder that all executors share."""
    import os

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts = [b for b in batches if len(b)]
        if parts:
            d = pd.concat(parts)
            name = f"part-{TaskContext.get().partitionId():05d}.ply"
            os.makedirs(folder, exist_ok=True)
            temporary = os.path.join(folder, f".{name}.{TaskContext.get().taskAttemptId()}")
            with open(temporary, "wb") as f:
                f.write(ply_bytes(d, columns))
            os.replace(temporary, os.path.join(folder, name))  # a repeated task replaces its own file
            yield pd.DataFrame({"file": [name], "rows": [len(d)]})

    return points.select(*columns).mapInPandas(run, "file string, rows bigint")
