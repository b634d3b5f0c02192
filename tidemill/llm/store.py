"""What the corpus operators share: tables, folds, and intermediate tables in the folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources import tables
from tidemill.sources.store import written as materialise

__all__ = ["fold", "materialise", "one_thread", "small_batches", "table", "texts"]

#: What goes to Python and comes back at a time: a task holds several copies of a batch, in the JVM and in Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def one_thread(spark: SparkSession) -> None:
    """Tasks multiply matrices with one thread each: Spark deals out the cores already, and idle threads of NumPy's spin."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of ``BATCH``, unless the session names sizes of its own."""
    named = spark.conf.getAll
    for key, value in BATCH.items():
        if key not in named:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one that its files would give to fewer tasks than there are cores is dealt to as many."""
    one_thread(spark)
    small_batches(spark)
    df, cores = tables.table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of a documents table; a null text is an empty one, other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
