"""Binary files: sizes, triangles and fixed records, from their contents as a column or, by byte ranges, from the files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources import ranges
from tidemill.sources.ranges import FACET, HEAD


def mesh_triage(spark: SparkSession, root: str, most: int = 500_000) -> DataFrame:
    """path, faces, large: the number of triangles from a file's size alone; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.stl").option("recursiveFileLookup", "true").load(root)
    return triage(files, most)


def triage(files: DataFrame, most: int = 500_000) -> DataFrame:
    """The same for an inventory of files (path, length)."""
    faces = F.floor((F.col("length") - HEAD) / FACET)
    return files.select("path", faces.alias("faces"), (faces > most).alias("large"))


def decode_mesh(files: DataFrame) -> DataFrame:
    """model, face_id, v (nine coordinates) of binary triangle files (path, content)."""
    kind = ranges.FACETS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, raw in zip(f["path"], f["content"], strict=True):
                n = int.from_bytes(raw[80:84], "little") if len(raw) >= HEAD else 0
                t = np.frombuffer(raw, kind, min(n, max(0, (len(raw) - HEAD) // FACET)), HEAD) if n else np.zeros(0, kind)
                yield pd.DataFrame({"model": path, "face_id": np.arange(len(t)), "v": list(t["v"].astype(float))})

    return files.select("path", "content").mapInPandas(run, "model string, face_id long, v array<double>")


def read_mesh_faces(spark: SparkSession, root: str) -> DataFrame:
    """The same of the files below a folder, read by byte ranges."""
    return ranges.read_facets(spark, root)


def indexed_mesh(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """faces (model, face_id, v of vertex keys) and vertices (model, v_id, x, y, z) of triangles; equal points are one vertex."""
    point = lambda k: F.struct(*[F.get("v", F.lit(3 * k + i)).alias(c) for i, c in enumerate("xyz")])
    key = lambda k: F.xxhash64(*[F.get("v", F.lit(3 * k + i)) + 0.0 for i in range(3)])
    faces = triangles.select("model", "face_id", F.array(*[key(k) for k in range(3)]).alias("v"))
    points = triangles.select("model", F.explode(F.array(*[F.struct(key(k).alias("v_id"), point(k).alias("p")) for k in range(3)])).alias("e"))
    return faces, points.select("model", "e.v_id", "e.p.*").dropDuplicates(["model", "v_id"])


def decode_records(files: DataFrame, magic: bytes, fields: list[tuple[str, str | tuple[str, int]]], stride: int = 72) -> DataFrame:
    """path, rec_no, offset and the fields of fixed little-endian records.

    The first record is where ``magic`` stands first with another one a stride later (or alone at the end); records
    follow while each begins with it. A field's kind is a NumPy code, or a pair of a code and a count.
    """
    kind = np.dtype([(n, *k) if isinstance(k, tuple) else (n, k) for n, k in fields])
    if kind.itemsize != stride:
        raise ValueError(f"the fields take {kind.itemsize} bytes, not {stride}")
    ddl = ["path string", "rec_no long", "offset long"]
    for n in kind.names:
        base, shape = kind[n].base, kind[n].shape
        name = "binary" if base.kind == "S" else "double" if base.kind == "f" else "long"
        ddl.append(f"{n} array<{name}>" if shape else f"{n} {name}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, raw in zip(f["path"], f["content"], strict=True):
                at = raw.find(magic)
                while at >= 0 and raw[at + stride : at + stride + len(magic)] != magic and at + 2 * stride <= len(raw):
                    at = raw.find(magic, at + 1)
                end = at
                while at >= 0 and end + stride <= len(raw) and raw.startswith(magic, end):
                    end += stride
                rows = np.frombuffer(raw, kind, (end - at) // stride, at) if end > at else np.zeros(0, kind)
                out = {"path": path, "rec_no": np.arange(len(rows)), "offset": at + stride * np.arange(len(rows))}
                for n in kind.names:
                    x = rows[n]
                    out[n] = [bytes(v) for v in x] if kind[n].kind == "S" else list(x.astype(float if kind[n].base.kind == "f" else np.int64))
                yield pd.DataFrame(out, columns=["path", "rec_no", "offset", *kind.names])

    return files.select("path", "content").mapInPandas(run, ", ".join(ddl))


def read_fixed_records(spark: SparkSession, path: str, magic: bytes, fields: list[tuple[str, str | tuple[str, int]]], stride: int = 72) -> DataFrame:
    """The same of a file, or of the files below a folder, read by byte ranges."""
    return ranges.read_records(spark, path, magic, fields, stride)
