"""State logs, tolerant JSON, file inventories, appending once, rewriting trimmed."""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import INSTANT, parse_instant
from tidemill.sources import ranges
from tidemill.sources.store import written

STATES = ("start", "on", "off")


def parse_state_log(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of log lines ``<instant> key=value… <state>``.

    Entries: iso, ts, session, state, kv. Three tokens at least, a real instant first, a known state last, a session,
    and for an off a valid for_start; the last of a repeated key wins.
    """
    tokens = F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda x: x != "")
    rows = lines.withColumn("t", tokens)
    rows = rows.withColumns({"iso": F.get("t", F.lit(0)), "state": F.try_element_at("t", F.lit(-1)), "mid": F.when(F.size("t") > 2, F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(1))))})
    pairs = F.transform(F.filter("mid", lambda x: F.instr(x, "=") > 1), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
    rows = rows.withColumn("p", pairs)
    rows = rows.withColumn("kv", F.map_from_entries(F.filter("p", lambda x, i: ~F.exists(F.slice("p", i + 2, F.size("p")), lambda y: y["key"] == x["key"]))))
    rows = rows.withColumns({"ts": parse_instant("iso"), "session": F.element_at("kv", "session")})
    good = (F.size("t") >= 3) & F.col("ts").isNotNull() & F.col("state").isin(*STATES) & (F.coalesce("session", F.lit("")) != "")
    good = good & ((F.col("state") != "off") | F.coalesce(F.element_at("kv", "for_start").rlike(INSTANT), F.lit(False)))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    return rows.where("good").select("iso", "ts", "session", "state", "kv"), rows.where("not good").select(line)


def read_state_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_state_log(spark.read.text(path))


def _children(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder; names that begin with a dot or an underscore are none of it."""
    kinds = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
    for b in tables:
        for folder in b["path"].to_pylist():
            system, path, _ = ranges.opened(folder)
            before = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
            itself = system.get_file_info(path)
            found = [itself] if itself.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path)) if not f.base_name.startswith((".", "_"))]
            for k in range(0, len(found), 10_000):
                some = found[k : k + 10_000]
                times = [(f.mtime_ns or 0) // 1_000_000 * 1000 for f in some]  # Hadoop's are of milliseconds
                yield pa.RecordBatch.from_arrays([pa.array([before + f.path for f in some], pa.string()), pa.array([f.type == fs.FileType.Directory for f in some]), pa.array(times, pa.timestamp("us", "UTC")), pa.array([f.size or 0 for f in some], pa.int64())], schema=kinds)


def files_below(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length of the files at any depth whose names match (as ``fnmatch`` has it): a round for each level, whose folders tasks list."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    home = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = home.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(home).toString()
    level, out = spark.createDataFrame([(base,)], "path string"), None
    while True:
        listed = written(level.repartition(tasks, "path").mapInArrow(_children, "path string, is_folder boolean, modificationTime timestamp, length long"), "listed")
        here = listed.where("not is_folder").drop("is_folder")
        out = here if out is None else out.unionByName(here)
        level = listed.where("is_folder").select("path")
        if level.isEmpty():
            return out.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(f"^(?:{fnmatch.translate(glob)[:-2]})$"))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files' whole texts, some MB at a time."""
    for b in batches:
        paths, texts, held = [], [], 0
        for path in b["path"].to_pylist():
            system, at, _ = ranges.opened(path)
            with system.open_input_stream(at) as f:
                texts.append(f.read().decode("utf-8", "replace"))
            paths.append(path)
            held += len(texts[-1])
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["file", "value"])
                paths, texts, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["file", "value"])


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None) -> DataFrame:
    """A record a file; a malformed one contributes nothing and hides no other. Pretty-printed files are fine.

    ``path`` is what Spark reads; with ``glob`` it is a folder of any number of files, at any depth, of which those whose names
    match are listed and read by tasks.
    """
    if glob is None:
        rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    else:
        files = files_below(spark, path, glob).select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path")
        rows = files.mapInArrow(_contents, "file string, value string")
    rows = rows.select("file", F.from_json(F.when(F.try_parse_json("value").isNotNull(), F.col("value")), schema).alias("r"))
    return rows.where("r is not null").select("file", "r.*")


def read_file_inventory(spark: SparkSession, root: str, glob: str = "*", rules: list[tuple[str, str, int, int | None]] = ()) -> DataFrame:
    """path, name, parent, session_id (the name without its ending), mtime, length, depth, category of files; contents are not read.

    A rule (category, glob of names, least depth, greatest depth or None) holds for names that it matches that many folders
    below the root; the first that holds gives the category, null where none does. Depth 1 is a file in the root itself.
    """
    files = files_below(spark, root, glob)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    home = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = home.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(home).toUri().getPath().rstrip("/")
    inner = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9+.-]+:/*", "/"), f"^{re.escape(base)}/", "")
    depth = F.size(F.split(inner, "/"))
    category = F.lit(None).cast("string")
    for kind, names, least, most in reversed(list(rules)):
        fits = name.rlike(f"^(?:{fnmatch.translate(names)[:-2]})$") & (depth >= least)
        category = F.when(fits if most is None else fits & (depth <= most), kind).otherwise(category)
    return files.select("path", name.alias("name"), F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("parent"), F.regexp_replace(name, r"\.[^.]*$", "").alias("session_id"), F.col("modificationTime").alias("mtime"), "length", depth.alias("depth"), category.alias("category"))


def append_once(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the Parquet table at ``path`` lacks, each key once; running again adds nothing. Returns the table."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.parquet(path).select(*[F.col(k).alias(f"{k}@") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & new[k].eqNullSafe(known[f"{k}@"])  # a null key is a key
        new = new.join(known, same, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def rewrite_trimmed(spark: SparkSession, path: str, keep: Column) -> DataFrame:
    """Replace the Parquet table at ``path`` by the rows that ``keep`` holds for: written beside, then swapped by renames.

    The rows set aside keep a name by which the next call finds them: if one was cut off between the two renames, the table is put
    back before anything else. Readers that come between the renames must wait; a catalogue table has no such gap.
    """
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old, beside = f"{path.rstrip('/')}.old", f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    if fs.exists(to(old)):
        if fs.exists(to(path)):
            fs.delete(to(old), True)
        elif not fs.rename(to(old), to(path)):
            raise OSError(f"{path} could not be put back; its rows are in {old}")
    spark.read.parquet(path).where(keep).write.parquet(beside)
    if not fs.rename(to(path), to(old)):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(to(beside), to(path)):
        fs.rename(to(old), to(path))
        raise OSError(f"{path} could not be swapped")
    fs.delete(to(old), True)
    return spark.read.parquet(path)
