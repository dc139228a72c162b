"""Binary formats decoded on executors from ``binaryFile`` rows: PLY, PNG, GLB.

Files are read by Spark, so any path that it can open works; one file is one row, and
large clouds are converted to Parquet once.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: PLY scalar types as NumPy codes, and the magic numbers of GLB.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
GLB_MAGIC, JSON_CHUNK = 0x46546C67, 0x4E4F534A
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
POINTS = "path string, pid long, x double, y double, z double, r double, g double, b double, nx double, ny double, nz double"


def decode_ply(data: bytes) -> tuple[dict[str, np.ndarray], list[list[int]]]:
    """(vertex columns, faces) of an ASCII or binary little-endian PLY."""
    head, _, body = data.partition(b"end_header\n")
    lines = [x.split() for x in head.decode("ascii", "replace").replace("\r", "").split("\n")]
    if not lines or lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    form, parts = "ascii", []
    for x in lines:
        if x[:1] == ["format"]:
            form = x[1]
        elif x[:1] == ["element"]:
            parts.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"]:
            parts[-1][2].append(x[1:])
    vertex, faces, at = {}, [], 0
    words = body.split() if form == "ascii" else None
    for name, n, props in parts:
        flat = all(p[0] != "list" for p in props)
        if name == "vertex" and flat:
            if words is not None:
                table = np.array(words[at : at + n * len(props)], dtype=float).reshape(n, len(props))
                vertex = {p[1]: table[:, i] for i, p in enumerate(props)}
                at += n * len(props)
            else:
                kind = np.dtype([(p[1], "<" + PLY_TYPES[p[0]]) for p in props])
                rows = np.frombuffer(body, dtype=kind, count=n, offset=at)
                vertex = {p[1]: rows[p[1]].astype(float) for p in props}
                at += n * kind.itemsize
        elif name == "face" and len(props) == 1 and not flat:
            count, item = np.dtype("<" + PLY_TYPES[props[0][1]]), np.dtype("<" + PLY_TYPES[props[0][2]])
            for _ in range(n):
                if words is not None:
                    k = int(words[at])
                    faces.append([int(w) for w in words[at + 1 : at + 1 + k]])
                    at += 1 + k
                else:
                    k = int(np.frombuffer(body, count, 1, at)[0])
                    at += count.itemsize
                    faces.append(np.frombuffer(body, item, k, at).tolist())
                    at += k * item.itemsize
        else:
            break
    return vertex, faces


#: Names of colours in PLY files.
COLOURS = {"r": "red", "g": "green", "b": "blue"}


def ply_head(columns: list[str], n: int, faces: int | None = None) -> bytes:
    """Header of a binary little-endian PLY of n vertices: doubles, colours as bytes."""
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}"] + [f"property {'uchar' if k in COLOURS else 'double'} {COLOURS.get(k, k)}" for k in columns]
    if faces is not None:
        head += [f"element face {faces}", "property list uchar int vertex_indices"]
    return ("\n".join(head) + "\nend_header\n").encode()


def ply_rows(vertex: dict[str, np.ndarray]) -> bytes:
    """Vertices as they stand behind ``ply_head``; colours (r, g, b) in 0..1."""
    kind = np.dtype([(COLOURS.get(k, k), "u1" if k in COLOURS else "<f8") for k in vertex])
    rows = np.zeros(len(next(iter(vertex.values()), [])), dtype=kind)
    for k, v in vertex.items():
        rows[COLOURS.get(k, k)] = np.clip(np.round(np.asarray(v) * 255), 0, 255) if k in COLOURS else v
    return rows.tobytes()


def encode_ply(vertex: dict[str, np.ndarray], faces: list[list[int]] | None = None) -> bytes:
    """Binary little-endian PLY: doubles, colours (r, g, b in 0..1) as bytes."""
    body = ply_head(list(vertex), len(next(iter(vertex.values()), [])), None if faces is None else len(faces)) + ply_rows(vertex)
    return body + b"".join(struct.pack(f"<B{len(f)}i", len(f), *f) for f in faces or [])


#: Bytes of a file that one task reads, the longest header of a file that is cut, and rows of a frame.
RANGE, HEAD, FRAME = 16 << 20, 1 << 16, 1 << 16


def _flat_vertices(head: bytes) -> tuple[int, int, np.dtype] | None:
    """(offset, count, row) of the vertices of a binary PLY that begins so; none where rows have no fixed place."""
    text, end, _ = head.partition(b"end_header\n")
    lines = [x.split() for x in text.decode("ascii", "replace").replace("\r", "").split("\n")]
    elements = [i for i, x in enumerate(lines) if x[:1] == ["element"]]
    if not end or ["format", "binary_little_endian", "1.0"] not in lines or not elements or lines[elements[0]][1] != "vertex":
        return None
    props = [x for x in lines[elements[0] : (elements + [len(lines)])[1]] if x[:1] == ["property"]]
    if not props or any(x[1] == "list" for x in props):
        return None
    return len(text) + len(end), int(lines[elements[0]][2]), np.dtype([(x[2], "<" + PLY_TYPES[x[1]]) for x in props])


def _opened(path: str):
    from pyarrow import fs

    store, at = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Points of all PLY files under a path; colours in 0..1, black where absent.

    Files over RANGE bytes are read by many tasks, each its own rows, if they are binary and begin with
    vertices of a fixed size; their store must be one that Arrow opens.
    """

    def points(name, v, n, first=0):
        for i in range(0, n, FRAME):
            k = slice(i, min(i + FRAME, n))
            get = lambda c, s=1.0: v[c][k].astype(float) / s if c in v else np.zeros(k.stop - k.start)  # noqa: B023, E731
            yield pd.DataFrame({"path": name, "pid": np.arange(first + k.start, first + k.stop), "x": get("x"), "y": get("y"), "z": get("z"), "r": get("red", 255), "g": get("green", 255), "b": get("blue", 255), "nx": get("nx"), "ny": get("ny"), "nz": get("nz")})

    def whole(frames):
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                v, _ = decode_ply(data)
                yield from points(name, v, len(v.get("x", [])))

    def part(frames):
        for frame in frames:
            for name, k in zip(frame["path"], frame["k"], strict=True):
                with _opened(name) as file:
                    flat = _flat_vertices(file.read_at(HEAD, 0))
                    if flat is None:
                        if k == 0:
                            v, _ = decode_ply(file.read_at(file.size(), 0))
                            yield from points(name, v, len(v.get("x", [])))
                        continue
                    begin, n, kind = flat
                    rows = max(1, RANGE // kind.itemsize)
                    first, last = min(n, int(k) * rows), min(n, (int(k) + 1) * rows)
                    got = np.frombuffer(file.read_at((last - first) * kind.itemsize, begin + first * kind.itemsize), dtype=kind, count=last - first)
                if "x" in kind.names:
                    yield from points(name, {c: got[c] for c in kind.names}, len(got), first)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path)
    small = files.where(F.col("length") <= RANGE).select("path", "content").mapInPandas(whole, POINTS)
    # rows of a whole size fill a range but for less than one, so one range more than the bytes ask for holds the rest
    cut = files.where(F.col("length") > RANGE).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / RANGE))).alias("k"))
    return small.unionByName(cut.repartition("path", "k").mapInPandas(part, POINTS))


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of an 8-bit grey, RGB or RGBA PNG without interlacing."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    w, h, depth, kind, _, _, laced = head
    if depth != 8 or laced or kind not in (0, 2, 4, 6):
        raise ValueError("this kind of PNG is not supported")
    bpp = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * bpp)
    out = np.zeros((h, w * bpp), dtype=np.uint8)
    for y in range(h):
        mode, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros(w * bpp, dtype=np.int32)
        if mode == 0:
            out[y] = line
        elif mode == 1:
            out[y] = np.cumsum(line.reshape(-1, bpp), axis=0).reshape(-1) & 255
        elif mode == 2:
            out[y] = (line + up) & 255
        else:
            for i in range(w * bpp):
                a, c = (int(out[y, i - bpp]), int(up[i - bpp])) if i >= bpp else (0, 0)
                b = int(up[i])
                if mode == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y, i] = (line[i] + guess) & 255
    return out.reshape(h, w, bpp)


def encode_png(image: np.ndarray) -> bytes:
    """8-bit PNG of (height, width[, channels])."""
    image = image if image.ndim == 3 else image[:, :, None]
    h, w, c = image.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = np.hstack([np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, w * c)])
    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(img, u, v, r, g, b in 0..1) of all PNG files under a path."""

    def run(frames):
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                p = decode_png(data)
                h, w, c = p.shape
                v, u = np.mgrid[0:h, 0:w]
                rgb = p[:, :, :3] if c >= 3 else np.repeat(p[:, :, :1], 3, axis=2)
                yield pd.DataFrame({"img": name, "u": u.ravel(), "v": v.ravel(), **{k: rgb[:, :, i].ravel() / 255 for i, k in enumerate("rgb")}})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content").mapInPandas(run, "img string, u int, v int, r double, g double, b double")


def patch_glb(data: bytes | None, extras: dict) -> bytes | None:
    """Adds asset.extras to a GLB's JSON chunk and mends all lengths; anything else comes back as it was."""
    if data is None or len(data) < 20 or struct.unpack("<I", data[:4])[0] != GLB_MAGIC:
        return data
    size, kind = struct.unpack("<II", data[12:20])
    if kind != JSON_CHUNK:
        return data
    doc = json.loads(data[20 : 20 + size])
    doc.setdefault("asset", {})["extras"] = {**doc.get("asset", {}).get("extras", {}), **extras}
    text = json.dumps(doc, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    rest = data[20 + size :]
    return struct.pack("<III", GLB_MAGIC, struct.unpack("<I", data[4:8])[0], 20 + len(text) + len(rest)) + struct.pack("<II", len(text), JSON_CHUNK) + text + rest


def with_glb_extras(files: DataFrame, column: str, extras: dict) -> DataFrame:
    """``column`` of GLB bytes with asset.extras set."""

    @F.pandas_udf("binary")
    def patched(content: pd.Series) -> pd.Series:
        return content.map(lambda d: patch_glb(d, extras))

    return files.withColumn(column, patched(column))
