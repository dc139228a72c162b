"""File sinks: tables become (name, content) rows on the executors, and a data source writes each row as a file.

One file is made in one task; a PLY file comes in parts, others whole: what is larger belongs in Parquet.
"""

from __future__ import annotations

import io
import json
import struct
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from voxloom.sources.codecs import GLB_MAGIC, JSON_CHUNK, decode_ply, encode_ply, encode_png, ply_head, ply_rows

FILES = "name string, content binary"
#: File that marks a folder as whole; Spark's readers pass over names that begin so.
DONE = "_SUCCESS"
#: Fixed values of the GLB and glTF formats: the binary chunk's kind, and the codes of component types and buffer targets.
BIN_CHUNK, FLOAT32, UINT32, ARRAY_BUFFER, ELEMENT_BUFFER = 0x004E4942, 5126, 5125, 34962, 34963


class _FileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows) -> WriterCommitMessage:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path)
        # rows of one name that follow one another are parts of one file
        for name, parts in groupby(rows, key=lambda row: row.name):
            at = f"{folder.rstrip('/')}/{name}"
            store.create_dir(at.rsplit("/", 1)[0], recursive=True)
            # a task that runs again writes the same bytes to the same name
            with store.open_output_stream(at) as out:
                for row in parts:
                    out.write(bytes(row.content))
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        """Marks the folder as whole; a job that failed leaves none of its own, and ``write_files`` took the old one away."""
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder.rstrip('/')}/{DONE}"):
            pass


class FileSink(DataSource):
    """Writes (name, content) rows as files under the option ``path``: any store that Arrow opens by its URI."""

    @classmethod
    def name(cls) -> str:
        return "voxloom_files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options)


def qualified(spark: SparkSession, folder: str):
    """(file system, path) of a folder as Spark itself would read it: a path without a scheme is in the default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store, path.makeQualified(store.getUri(), store.getWorkingDirectory())


def write_files(files: DataFrame, folder: str) -> None:
    """Each row of (name, content) as a file under ``folder``; same names are replaced. DONE is there once all files are."""
    spark = files.sparkSession
    store, path = qualified(spark, folder)
    store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, DONE), False)
    spark.dataSource.register(FileSink)
    # file:/x is read by all, file:///x by Arrow too
    uri = path.toString()
    files.select("name", "content").write.format(FileSink.name()).mode("append").save(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def is_whole(spark: SparkSession, folder: str) -> bool:
    """Whether the last write to a folder came to its end."""
    store, path = qualified(spark, folder)
    return store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, DONE))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files of a folder, without their content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def _bytes(df: DataFrame, key: str, order: list[str], make) -> DataFrame:
    """One file per ``key``: ``make`` of its rows in ``order``."""

    def run(group, frame):
        return pd.DataFrame({"name": [group[0]], "content": [make(frame.sort_values(order).reset_index(drop=True))]})

    return df.groupBy(key).applyInPandas(run, FILES)


def ply_files(points: DataFrame) -> DataFrame:
    """Points (name, pid, x, y, z and any of r, g, b, nx, ny, nz) as PLY files, in order of pid.

    A file comes in parts, rows of one name in order in one partition, so that no task holds a file.
    """
    held = [c for c in ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz") if c in points.columns]
    counts = points.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    # a set number of partitions: others may be split where a name is large, and a file then lies in several
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one row a file
    ordered = points.select("name", "pid", *held).join(F.broadcast(counts), "name").repartition(n, "name").sortWithinPartitions("name", "pid")

    def run(frames):
        last = None
        for frame in frames:
            for name, f in frame.groupby("name", sort=False):
                head = b"" if name == last else ply_head(held, int(f["_n"].iloc[0]))
                last = name
                yield pd.DataFrame({"name": [name], "content": [head + ply_rows({c: f[c].to_numpy() for c in held})]})

    return ordered.mapInPandas(run, FILES)


def mesh_files(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Meshes (vertices: name, vid, x, y, z; faces: name, fid, v0, v1, v2) as PLY files; vids are numbered anew by order."""

    def run(key, v, f):
        v, f = v.sort_values("vid"), f.sort_values("fid")
        place = {k: i for i, k in enumerate(v["vid"].tolist())}
        body = encode_ply({c: v[c].to_numpy() for c in "xyz"}, [[place[k] for k in t] for t in f[["v0", "v1", "v2"]].to_numpy().tolist()])
        return pd.DataFrame({"name": [key[0]], "content": [body]})

    return vertices.groupBy("name").cogroup(faces.groupBy("name")).applyInPandas(run, FILES)


def read_mesh(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of all PLY files of a folder; faces of more corners become fans."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def corners(frames):
        for frame in frames:
            for name, data in zip(frame["name"], frame["content"], strict=True):
                v, _ = decode_ply(data)
                yield pd.DataFrame({"name": name, "vid": np.arange(len(v.get("x", []))), **{c: v.get(c, []) for c in "xyz"}})

    def triangles(frames):
        for frame in frames:
            for name, data in zip(frame["name"], frame["content"], strict=True):
                t = np.array([(f[0], f[i], f[i + 1]) for f in decode_ply(data)[1] for i in range(1, len(f) - 1)], dtype=np.int64).reshape(-1, 3)
                yield pd.DataFrame({"name": name, "fid": np.arange(len(t)), **{f"v{i}": t[:, i] for i in range(3)}})

    return files.mapInPandas(corners, "name string, vid long, x double, y double, z double"), files.mapInPandas(triangles, "name string, fid long, v0 long, v1 long, v2 long")


def label_files(labels: DataFrame) -> DataFrame:
    """Labels (name, fid, label) as raw unsigned 64-bit little-endian numbers in order of fid."""
    return _bytes(labels, "name", ["fid"], lambda f: f["label"].to_numpy(dtype="<u8").tobytes())


def npy_files(depth: DataFrame) -> DataFrame:
    """Rasters (name, v, u, d) as NPY files of 64-bit floats; places without a row are NaN."""

    def make(f):
        grid = np.full((int(f["v"].max()) + 1, int(f["u"].max()) + 1), np.nan)
        grid[f["v"].to_numpy(), f["u"].to_numpy()] = f["d"]
        out = io.BytesIO()
        np.save(out, grid, allow_pickle=False)
        return out.getvalue()

    return _bytes(depth, "name", ["v", "u"], make)


def read_npy(spark: SparkSession, folder: str) -> DataFrame:
    """(name, v, u, d) of all two-dimensional NPY files of a folder; NaN places are left out, pickled arrays refused."""

    def run(frames):
        for frame in frames:
            for name, data in zip(frame["name"], frame["content"], strict=True):
                grid = np.load(io.BytesIO(data), allow_pickle=False)
                v, u = np.nonzero(~np.isnan(grid))
                yield pd.DataFrame({"name": name, "v": v, "u": u, "d": grid[v, u]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInPandas(run, "name string, v int, u int, d double")


def png_files(pixels: DataFrame) -> DataFrame:
    """Pixels (name, u, v, r, g, b in 0..1) as PNG files; places without a row are black."""

    def make(f):
        image = np.zeros((int(f["v"].max()) + 1, int(f["u"].max()) + 1, 3), dtype=np.uint8)
        image[f["v"].to_numpy(), f["u"].to_numpy()] = np.clip(np.round(f[["r", "g", "b"]].to_numpy() * 255), 0, 255)
        return encode_png(image)

    return _bytes(pixels, "name", ["v", "u"], make)


def encode_glb(vertices: np.ndarray, faces: np.ndarray, uv: np.ndarray | None = None, texture: bytes | None = None, extras: dict | None = None) -> bytes:
    """A GLB of one mesh: positions, triangles, and texture coordinates with a double-sided textured material if given."""
    views, accessors, body = [], [], b""

    def add(data: bytes, target: int | None, **accessor) -> int:
        nonlocal body
        body += b"\0" * (-len(body) % 4)
        views.append({"buffer": 0, "byteOffset": len(body), "byteLength": len(data), **({"target": target} if target else {})})
        body += data
        if accessor:
            accessors.append({"bufferView": len(views) - 1, **accessor})
        return len(views) - 1

    v = np.asarray(vertices, dtype="<f4").reshape(-1, 3)
    add(v.tobytes(), ARRAY_BUFFER, componentType=FLOAT32, count=len(v), type="VEC3", min=v.min(axis=0).tolist() if len(v) else [0, 0, 0], max=v.max(axis=0).tolist() if len(v) else [0, 0, 0])
    attributes = {"POSITION": 0}
    if uv is not None:
        add(np.asarray(uv, dtype="<f4").tobytes(), ARRAY_BUFFER, componentType=FLOAT32, count=len(v), type="VEC2")
        attributes["TEXCOORD_0"] = 1
    f = np.asarray(faces, dtype="<u4").reshape(-1)
    add(f.tobytes(), ELEMENT_BUFFER, componentType=UINT32, count=len(f), type="SCALAR")
    part = {"attributes": attributes, "indices": len(accessors) - 1}
    doc = {"asset": {"version": "2.0", **({"extras": extras} if extras else {})}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [part]}], "accessors": accessors}
    if texture is not None:
        image = add(texture, None)
        part["material"] = 0
        doc |= {"images": [{"bufferView": image, "mimeType": "image/png"}], "textures": [{"source": 0}], "materials": [{"doubleSided": True, "pbrMetallicRoughness": {"baseColorTexture": {"index": 0}, "metallicFactor": 0.0}}]}
    body += b"\0" * (-len(body) % 4)
    doc |= {"bufferViews": views, "buffers": [{"byteLength": len(body)}]}
    text = json.dumps(doc, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<III", GLB_MAGIC, 2, 28 + len(text) + len(body)) + struct.pack("<II", len(text), JSON_CHUNK) + text + struct.pack("<II", len(body), BIN_CHUNK) + body


def glb_files(vertices: DataFrame, faces: DataFrame, extras: dict | None = None) -> DataFrame:
    """Meshes (vertices: name, vid, x, y, z; faces: name, fid, v0, v1, v2) as GLB files."""

    def run(key, v, f):
        v, f = v.sort_values("vid"), f.sort_values("fid")
        place = np.searchsorted(v["vid"].to_numpy(), f[["v0", "v1", "v2"]].to_numpy())
        return pd.DataFrame({"name": [key[0]], "content": [encode_glb(v[["x", "y", "z"]].to_numpy(), place, extras=extras)]})

    return vertices.groupBy("name").cogroup(faces.groupBy("name")).applyInPandas(run, FILES)


def glb_facts(files: DataFrame) -> DataFrame:
    """(name, vertices, triangles, unit) as the JSON chunk of GLB rows (name, content) says."""
    size = F.conv(F.hex(F.reverse(F.substring("content", 13, 4))), 16, 10).cast("int")
    doc = files.select("name", F.substring(F.col("content"), F.lit(21), size).cast("string").alias("doc"))
    at = lambda p: F.get_json_object("doc", p)
    return doc.select("name", at("$.accessors[0].count").cast("long").alias("vertices"), (at("$.accessors[1].count").cast("long") / 3).cast("long").alias("triangles"), at("$.asset.extras.unit").alias("unit"))


def layout_files(layouts: DataFrame) -> DataFrame:
    """Layouts (name, corners: array<struct<x, y>>, source) as JSON documents."""
    doc = F.to_json(F.struct(F.transform("corners", lambda p: F.array(p["x"], p["y"])).alias("layout_corners"), "source"))
    return layouts.select("name", doc.cast("binary").alias("content"))


def mtl_files(colours: DataFrame) -> DataFrame:
    """Materials (name, material, r, g, b) as MTL text, one file a name, in order of material."""
    rec = F.concat(F.lit("newmtl "), F.col("material"), F.format_string("\nKd %.6f %.6f %.6f\n", "r", "g", "b"))
    lines = colours.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("material", rec.alias("t")))), lambda s: s["t"]), "").alias("t"))
    return lines.select("name", F.col("t").cast("binary").alias("content"))


def load_config(spark: SparkSession, path: str | None) -> dict:
    """Settings of one JSON document; none where there is no path."""
    if not path:
        return {}
    # one document, read by the driver as any job's parameters are
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))
