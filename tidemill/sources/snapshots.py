"""Versioned Parquet tables: whole versions for readers, safe appends for writers, and an index that spares reading.

A table is a folder with ``data/<part>`` and ``index/<part>`` for every part that was ever written, and one small file a version in
``_versions`` that names the parts which make it up. Parts are never changed. A commit makes the next version's file, whole or
not at all, and only if no one else has: so a reader sees one version or another and never a mixture, and a job that is cut off
anywhere leaves nothing but a part that no version names. A writer who finds its version taken looks at what came in
between: rows of parts that were added are checked against its own, and it commits after them; after a rewrite it starts anew.

A part is sorted by a 64-bit hash of its keys, so each of its files covers a range of hashes. The index has a row a file: its
number of rows, the range of hashes, the range of the first key column, and a Bloom filter of the hashes. A batch reads the
files alone that may hold one of its keys by all three; the keys themselves decide then, so the index changes no result.
A batch of more than ``MOST_HASHES`` keys is compared by ranges alone: some key of so many would pass every filter.

Commits need a store where a new name can be made without replacing one that is there: a local disk (hard links) or a file
system with an atomic rename, such as HDFS.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.store import written

MOST_HASHES, BITS_A_KEY, MOST_BITS = 1_000_000, 16, 1 << 27
PROBES = 11  # for the fewest false hits at so many bits a key


class Store:
    """The few calls on the session's file systems that a commit needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> dict[str, int]:
        """What is in a folder, and when it was changed, in milliseconds."""
        at = self.path(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a file, whole or not at all; False if there is one of that name."""
        to, beside = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        self.fs.mkdirs(to.getParent())
        stream = self.fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
            stream.close()
            if self.fs.getUri().getScheme() == "file":
                local = lambda p: self.jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.gateway.new_array(self.jvm.java.lang.String, 0))
                self.jvm.java.nio.file.Files.createLink(local(to), local(beside))
            else:
                whole = self.fs.makeQualified(beside)
                options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.conf).rename(whole, self.fs.makeQualified(to), options)
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        finally:
            self.fs.delete(beside, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Version(NamedTuple):
    number: int
    files: dict[str, int]  # of each part
    keys: list[str]
    schema: T.StructType

    @property
    def parts(self) -> list[str]:
        return list(self.files)


class Part(NamedTuple):
    name: str
    rows: int
    files: int


class Report(NamedTuple):
    version: int
    rows: int  # that were added, or kept by a rewrite
    files: int  # of the version that was compared with
    files_read: int  # of those, for the comparison


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of 2**bits."""
    h = hashes.view(np.uint64)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (one[:, None] + np.arange(PROBES, dtype=np.uint64) * two[:, None]) & np.uint64((1 << bits) - 1)


def _filters(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A filter for each file's rows in this task, let go of when the next file begins."""
        now, held = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(held).tobytes()], pa.binary())], ["file", "bloom"])
        for b in batches:
            files, hashes = b["file"].to_numpy(zero_copy_only=False), b["hash"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], files[1:] != files[:-1]])).tolist() if len(files) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(files)], strict=True):
                if files[lo] != now:
                    if now is not None:
                        yield row()
                    now, held = files[lo], np.zeros(1 << bits, bool)
                held[positions(hashes[lo:hi], bits).ravel()] = True
        if now is not None:
            yield row()

    return build


def _both(t: pa.Table) -> pa.Table:
    """One filter of a file's several."""
    bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in t["bloom"]])
    return pa.table({"file": t["file"].slice(0, 1), "bloom": pa.array([bits.tobytes()], pa.binary())})


def may_hold(hashes: np.ndarray, low: int, high: int, bits: int, bloom: bytes) -> bool:
    """Whether a file may hold one of the (sorted) hashes."""
    some = hashes[np.searchsorted(hashes, low) : np.searchsorted(hashes, high, side="right")]
    if not len(some):
        return False
    at = positions(some, bits)
    held = np.frombuffer(bloom, np.uint8)
    return bool(((held[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(1).any())


def _maybe(shared):
    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_hold(shared.value, r["low"], r["high"], r["bits"], r["bloom"]) for r in b.to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_())).select(["part", "file"])

    return maybe


class Snapshots:
    """The versioned table at ``path``. ``at`` is called with the name of each step (tests stop the job there)."""

    def __init__(self, spark: SparkSession, path: str, at: Callable[[str], None] = lambda step: None):
        self.spark, self.path, self.at, self.store = spark, path.rstrip("/"), at, Store(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n[:20]) for n in self.store.names("_versions") if re.fullmatch(r"\d{20}\.json", n))

    def version(self, number: int | None = None) -> Version | None:
        """The newest version, or the one of that number."""
        if number is None:
            numbers = self.versions()
            if not numbers:
                return None
            number = numbers[-1]
        v = json.loads(self.store.text(f"_versions/{number:020d}.json"))
        return Version(number, v["parts"], v["keys"], T.StructType.fromJson(v["schema"]))

    def read(self, number: int | None = None) -> DataFrame:
        """The newest version's rows, or those of an earlier one; a reader keeps its version whatever is committed meanwhile."""
        v = self.version(number)
        if v is None:
            raise ValueError(f"there is no table at {self.path}")
        return self._rows(v.parts, v.schema)

    def append_once(self, df: DataFrame, keys: list[str], tries: int = 50) -> Report:
        """Adds the rows of ``df`` whose keys the table lacks, each key once; a null key is a key. Running again adds nothing."""
        batch = written(df.dropDuplicates(keys), "batch")
        self.at("batch written")
        seen, staged, files, read = None, None, 0, 0
        for _ in range(tries):
            now = self.version() or Version(0, {}, keys, batch.schema)
            if now.keys != keys:
                raise ValueError(f"the table's keys are {now.keys}")
            if staged is None or not set(seen) <= set(now.files):  # first of all, or after a rewrite
                rows, read = self._lacking(batch, now, now.parts)
                staged, files = self._stage(rows, keys, now.schema), sum(now.files.values())
            elif added := [p for p in now.files if p not in seen]:
                rows, also = self._lacking(self._rows([staged.name], now.schema), now, added)
                if also and rows.count() < staged.rows:
                    staged = self._stage(rows, keys, now.schema)
                files, read = files + sum(now.files[p] for p in added), read + also
            seen = now.files
            if not staged.rows:
                return Report(now.number, 0, files, read)
            if self._commit(now, {**now.files, staged.name: staged.files}):
                return Report(now.number + 1, staged.rows, files, read)
        raise RuntimeError(f"{tries} other commits came first")

    def rewrite(self, keep: Column, tries: int = 50) -> Report:
        """A version of those rows alone for which ``keep`` holds; rows that are added meanwhile are asked too."""
        made, seen = [], None
        for _ in range(tries):
            now = self.version()
            if now is None:
                raise ValueError(f"there is no table at {self.path}")
            if seen is None or not set(seen) <= set(now.files):
                made, seen = [], {}
            added = [p for p in now.files if p not in seen]
            made.append(self._stage(self._rows(added, now.schema).where(keep), now.keys, now.schema))
            seen = now.files
            if self._commit(now, {p.name: p.files for p in made if p.rows}):
                return Report(now.number + 1, sum(p.rows for p in made), sum(now.files.values()), sum(now.files.values()))
        raise RuntimeError(f"{tries} other commits came first")

    def files(self, df: DataFrame, keys: list[str], number: int | None = None) -> DataFrame:
        """(part, file) of the files that may hold a key of ``df``."""
        v = self.version(number)
        return self._files(df, v, v.parts) if v else self.spark.createDataFrame([], "part string, file string")

    def vacuum(self, versions: int = 2, older_than: int = 7 * 86_400) -> list[str]:
        """Deletes parts that none of the newest versions names and that are older than so many seconds, and older versions' files."""
        numbers = self.versions()
        kept = {p for n in numbers[-versions:] for p in self.version(n).parts}
        now = self.store.jvm.java.lang.System.currentTimeMillis()
        gone = []
        for n in numbers[:-versions]:
            self.store.delete(f"_versions/{n:020d}.json")  # first the names, then what they name
        for folder in ("index", "data"):
            for part, changed in self.store.names(folder).items():
                if part not in kept and now - changed >= older_than * 1000:
                    self.store.delete(f"{folder}/{part}")
                    gone.append(f"{folder}/{part}")
        return gone

    def _rows(self, parts: list[str], schema: T.StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{p}" for p in parts])

    def _index(self, parts: list[str], schema: T.StructType, keys: list[str]) -> DataFrame:
        kind = schema[keys[0]].dataType.simpleString()
        ddl = f"file string, rows long, low long, high long, nulls long, low_key {kind}, high_key {kind}, bloom binary, part string, bits int"
        return self.spark.read.schema(ddl).parquet(*[f"{self.path}/index/{p}" for p in parts])

    def _files(self, df: DataFrame, now: Version, parts: list[str]) -> DataFrame:
        keys, index = now.keys, self._index(parts, now.schema, now.keys)
        first, h = F.col(keys[0]), F.xxhash64(*keys)
        n, least, most, nulls, low, high = df.agg(F.count(F.lit(1)), F.min(first), F.max(first), F.count_if(first.isNull()), F.min(h), F.max(h)).first()
        if not n:
            return index.where("false").select("part", "file")
        kind = df.schema[keys[0]].dataType
        meets = (F.col("low_key") <= F.lit(most).cast(kind)) & (F.col("high_key") >= F.lit(least).cast(kind))
        near = index.where((F.col("low") <= high) & (F.col("high") >= low) & (F.coalesce(meets, F.lit(False)) | F.lit(nulls > 0) & (F.col("nulls") > 0)))
        if n > MOST_HASHES:
            return near.select("part", "file")
        hashes = np.sort(df.select(h.alias("h")).toArrow()["h"].to_numpy())
        return near.select("part", "file", "low", "high", "bits", "bloom").mapInArrow(_maybe(self.spark.sparkContext.broadcast(hashes)), "part string, file string")

    def _lacking(self, batch: DataFrame, now: Version, parts: list[str]) -> tuple[DataFrame, int]:
        """The batch's rows whose keys the parts lack, and the number of files that had to be read for it."""
        if not parts:
            return batch, 0
        names = [f"{self.path}/data/{r['part']}/{r['file']}" for r in self._files(batch, now, parts).collect()]  # at most as many as the table has files
        self.at("index asked")
        if not names:
            return batch, 0
        known = self.spark.read.schema(now.schema).parquet(*names).select(*[F.col(k).alias(f"{k}@") for k in now.keys])
        same = F.lit(True)
        for k in now.keys:
            same = same & batch[k].eqNullSafe(known[f"{k}@"])
        return batch.join(known, same, "left_anti"), len(names)

    def _stage(self, rows: DataFrame, keys: list[str], schema: T.StructType) -> Part:
        """Writes a part that no version names yet, with its index."""
        part, h = uuid.uuid4().hex, F.xxhash64(*keys)
        rows.select(*schema.names).withColumn("hash@", h).repartitionByRange("hash@").sortWithinPartitions("hash@").drop("hash@").write.parquet(f"{self.path}/data/{part}")
        self.at("data written")
        own = self._rows([part], schema).select(F.col("_metadata.file_name").alias("file"), h.alias("hash"), F.col(keys[0]).alias("first"))
        stats = own.groupBy("file").agg(
            F.count(F.lit(1)).alias("rows"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.count_if(F.col("first").isNull()).alias("nulls"), F.min("first").alias("low_key"), F.max("first").alias("high_key"))
        stats = written(stats, "stats")
        most, n, files = stats.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
        if n:
            bits = min(MOST_BITS, max(64, most * BITS_A_KEY)).bit_length()
            blooms = own.select("file", "hash").mapInArrow(_filters(bits), "file string, bloom binary").groupBy("file").applyInArrow(_both, "file string, bloom binary")
            stats.join(blooms, "file").withColumns({"part": F.lit(part), "bits": F.lit(bits)}).write.parquet(f"{self.path}/index/{part}")
        self.at("index written")
        return Part(part, n, files)

    def _commit(self, now: Version, files: dict[str, int]) -> bool:
        self.at("before commit")
        done = self.store.create(f"_versions/{now.number + 1:020d}.json", json.dumps({"parts": files, "keys": now.keys, "schema": json.loads(now.schema.json())}))
        if done:
            self.at("committed")
        return done
