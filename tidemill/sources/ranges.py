"""Binary files read by byte ranges: triangles and records as data sources whose tasks each take a part of a file.

Ranges are planned from names and sizes alone and end where a row ends, so a large file is many tasks, and a task holds one
piece of a few MB at a time. A task takes ranges one after the other, of one file or of many, up to ``SPLIT`` bytes, of which each file
counts for ``OPEN`` more: many small files are few tasks. Columns that the given schema leaves out are not decoded, and a
schema of none of a record's fields reads places only. Folders are opened by Arrow's file systems (``file``, ``hdfs``, ``s3``, …).

``tidemill_facets``: binary triangle files. ``tidemill_places``: every place at which a record may begin, whatever its
alignment. ``tidemill_blobs``: a sink of one file a row (name, content); a file appears whole or not at all.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemill.sources.store import written

# Sizes of the binary triangle format.
HEAD, FACET = 84, 50
SPLIT, PIECE, OPEN = 64 << 20, 4 << 20, 1 << 18


def opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """A folder's file system, its path there, and what stands before paths in its addresses."""
    scheme, found, rest = root.partition(":")
    if not found:
        return fs.LocalFileSystem(), root, "file://"
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file://"
    system, path = fs.FileSystem.from_uri(root)
    return system, path, root[: root.index(path)] if path in root else f"{scheme}://"


def files(root: str, glob: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files below a folder whose names match, or of the file itself."""
    system, path, _ = opened(root)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatchcase(f.base_name, glob) and not f.base_name.startswith((".", "_")))


class Range(NamedTuple):
    path: str
    size: int
    lo: int
    hi: int


class Ranges(InputPartition):
    """What one task reads: files, each from the beginning of a range to the end of the same one or a later."""

    def __init__(self, spans: list[tuple[str, int, int, int]]):
        self.spans = spans


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.root, self.glob, self.split = options["path"], options.get("glob", "*"), int(options.get("split", SPLIT))
        self.tasks = int(options.get("tasks", 1))  # so many at least, if there are as many ranges
        self.columns = schema.names
        self.types = {f.name: f.dataType.simpleString() for f in schema.fields}

    def partitions(self) -> list[InputPartition]:
        found = files(self.root, self.glob)
        most = min(SPLIT, -(-sum(size + OPEN for _, size in found) // self.tasks))
        out, held, spans = [], 0, []
        for path, size in found:
            for lo, hi in self.cut(size):
                goes_on = bool(spans) and spans[-1][0] == path
                cost = hi - lo + (0 if goes_on else OPEN)
                if spans and held + cost > most:
                    out.append(Ranges(spans))
                    held, spans, goes_on, cost = 0, [], False, hi - lo + OPEN
                if goes_on:
                    spans[-1] = (*spans[-1][:3], hi)
                else:
                    spans.append((path, size, lo, hi))
                held += cost
        return [*out, Ranges(spans)]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        system, _, before = opened(self.root)
        for path, size, first, last in part.spans:
            with system.open_input_file(path) as f:
                for lo, hi in self.cut(size):
                    if first <= lo < last:
                        yield from self.rows(f, Range(path, size, lo, hi), before + path)

    def cut(self, size: int) -> list[tuple[int, int]]:
        return [(lo, min(size, lo + self.split)) for lo in range(0, size, self.split)]

    def rows(self, f: pa.NativeFile, part: Range, name: str) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


FACETS = np.dtype([("normal", "<f4", 3), ("v", "<f4", 9), ("attr", "<u2")])


def _lists(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, x.shape[1]), pa.int32()), pa.array(flat))


class FacetReader(RangeReader):
    def cut(self, size: int) -> list[tuple[int, int]]:
        """Ranges of whole triangles; the header counts for none."""
        step = max(1, self.split // FACET) * FACET
        end = HEAD + max(0, size - HEAD) // FACET * FACET
        return [(lo, min(end, lo + step)) for lo in range(HEAD, end, step)]

    def rows(self, f: pa.NativeFile, part: Range, name: str) -> Iterator[pa.RecordBatch]:
        told = int.from_bytes(f.read_at(4, HEAD - 4), "little")
        hi = min(part.hi, HEAD + told * FACET)
        step = PIECE // FACET * FACET
        for at in range(part.lo, hi, step):
            x = np.frombuffer(f.read_at(min(step, hi - at), at), FACETS)
            made = {
                "model": lambda n: pa.array(np.full(n, name)),
                "face_id": lambda n, at=at: pa.array((at - HEAD) // FACET + np.arange(n)),
                "v": lambda n, x=x: _lists(x["v"].astype(float)),
                "normal": lambda n, x=x: _lists(x["normal"].astype(float)),
                "attr": lambda n, x=x: pa.array(x["attr"].astype(np.int32)),
            }
            yield pa.RecordBatch.from_arrays([made[c](len(x)) for c in self.columns], self.columns)


class FacetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_facets"

    def schema(self) -> str:
        return "model string, face_id long, v array<double>, normal array<double>, attr int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FacetReader(self.options, schema)


class Layout(NamedTuple):
    """Fixed little-endian records: the bytes each begins with, and its fields."""

    magic: bytes
    stride: int
    kind: np.dtype

    @classmethod
    def of(cls, magic: bytes, stride: int, fields: list) -> Layout:
        kind = np.dtype([(n, k[0], k[1]) if isinstance(k, (tuple, list)) else (n, k) for n, k in fields])
        if kind.itemsize != stride:
            raise ValueError(f"the fields take {kind.itemsize} bytes, not {stride}")
        return cls(magic, stride, kind)

    def ddl(self) -> list[str]:
        out = []
        for n in self.kind.names:
            base, shape = self.kind[n].base, self.kind[n].shape
            name = "binary" if base.kind == "S" else "double" if base.kind == "f" else "long"
            out.append(f"{n} array<{name}>" if shape else f"{n} {name}")
        return out

    def column(self, x: np.ndarray) -> pa.Array:
        if x.dtype.kind == "S":  # NumPy would take zero bytes off the end
            raw = np.ascontiguousarray(x).tobytes()
            return pa.array([raw[i : i + x.dtype.itemsize] for i in range(0, len(raw), x.dtype.itemsize)], pa.binary())
        x = x.astype(float if x.dtype.kind == "f" else np.int64)
        return _lists(x) if x.ndim > 1 else pa.array(x)


def places(raw: bytes, magic: bytes) -> np.ndarray:
    """All places of ``magic``, overlapping ones too."""
    x = np.frombuffer(raw, np.uint8)
    n = len(x) - len(magic) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(x[:n] == magic[0])
    for i, c in enumerate(magic[1:], 1):
        at = at[x[at + i] == c]
    return at


class PlaceReader(RangeReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        super().__init__(options, schema)
        self.layout = Layout.of(bytes.fromhex(options["magic"]), int(options["stride"]), json.loads(options["fields"]))

    def rows(self, f: pa.NativeFile, part: Range, name: str) -> Iterator[pa.RecordBatch]:
        magic, stride, kind = self.layout
        beyond = 2 * stride + len(magic)  # what a place at a piece's end has to see
        for lo in range(part.lo, part.hi, PIECE):
            raw = f.read_at(min(min(lo + PIECE, part.hi) + beyond, part.size) - lo, lo)
            all_ = places(raw, magic)
            at = all_[all_ < min(PIECE, part.hi - lo)]
            follows = np.isin(at + stride, all_)
            whole = lo + at + stride <= part.size
            made = {
                "path": lambda: pa.array(np.full(len(at), name)),  # noqa: B023
                "offset": lambda: pa.array(lo + at),  # noqa: B023
                "leads_": lambda: pa.array(follows | (lo + at + 2 * stride > part.size)),  # noqa: B023
                "whole_": lambda: pa.array(whole),  # noqa: B023
                "goes_on_": lambda: pa.array(follows & (lo + at + 2 * stride <= part.size)),  # noqa: B023
            }
            fields = [c for c in self.columns if c not in made]
            if fields:
                padded = np.frombuffer(raw + bytes(stride), np.uint8)
                rows = padded[at[:, None] + np.arange(stride)].reshape(-1).view(kind) if len(at) else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([made[c]() if c in made else self.layout.column(rows[c]) for c in self.columns], self.columns)


class PlaceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_places"

    def schema(self) -> str:
        layout = Layout.of(bytes.fromhex(self.options["magic"]), int(self.options["stride"]), json.loads(self.options["fields"]))
        return ", ".join(["path string, offset long, leads_ boolean, whole_ boolean, goes_on_ boolean", *layout.ddl()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlaceReader(self.options, schema)


class BlobWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def write(self, rows) -> WriterCommitMessage:
        system, path, _ = opened(self.root)
        last = None
        for r in rows:
            to = posixpath.join(path, r["name"])
            beside = posixpath.join(posixpath.dirname(to), f".{posixpath.basename(to)}-{uuid.uuid4().hex}")
            if posixpath.dirname(to) != last:
                last = posixpath.dirname(to)
                system.create_dir(last, recursive=True)
            with system.open_output_stream(beside) as f:
                f.write(bytes(r["content"] or b""))
            system.move(beside, to)  # a task that runs again makes the same file again
        return WriterCommitMessage()


class BlobSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_blobs"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BlobWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    for source in (FacetSource, PlaceSource, BlobSource):
        spark.dataSource.register(source)
    return spark


def _tasks(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def read_facets(spark: SparkSession, root: str, columns: str = "model string, face_id long, v array<double>", glob: str = "*.stl", split: int = SPLIT) -> DataFrame:
    """Triangles of the binary triangle files below ``root``; ``columns`` may also name normal and attr."""
    return registered(spark).read.format("tidemill_facets").schema(columns).options(glob=glob, split=split, tasks=_tasks(spark)).load(root)


def read_records(spark: SparkSession, root: str, magic: bytes, fields: list[tuple[str, str | tuple[str, int]]], stride: int = 72, glob: str = "*", split: int = SPLIT) -> DataFrame:
    """path, rec_no, offset and the fields of fixed little-endian records in the files below ``root``.

    A file's first record is where ``magic`` stands first with another one a stride later (or with no room for one); records
    follow while each begins with it. Where they begin and end are aggregates over the places that tasks have found.
    """
    layout = Layout.of(magic, stride, fields)
    reader = registered(spark).read.format("tidemill_places").options(magic=magic.hex(), stride=stride, fields=json.dumps(fields), glob=glob, split=split, tasks=_tasks(spark))
    found = written(reader.schema("path string, offset long, leads_ boolean, whole_ boolean, goes_on_ boolean").load(root), "places")
    start = found.where("leads_").groupBy("path").agg(F.min("offset").alias("first_"))
    # a row a file: hashed, as paths are slow to sort by
    in_line = lambda df, files: df.join(files.hint("shuffle_hash"), "path").where(F.col("whole_") & (F.col("offset") >= F.col("first_")) & ((F.col("offset") - F.col("first_")) % stride == 0))
    bounds = in_line(found.where("not goes_on_"), start).groupBy("path").agg(F.first("first_").alias("first_"), F.min("offset").alias("last_"))
    rows = in_line(reader.schema(", ".join(["path string, offset long, whole_ boolean", *layout.ddl()])).load(root), bounds).where("offset <= last_")
    return rows.select("path", F.floor((F.col("offset") - F.col("first_")) / stride).cast("long").alias("rec_no"), "offset", *layout.kind.names)


def write_files(df: DataFrame, root: str) -> None:
    """A file for each row (name, content), below ``root``."""
    registered(df.sparkSession)
    df.select("name", "content").write.format("tidemill_blobs").mode("append").save(root)
