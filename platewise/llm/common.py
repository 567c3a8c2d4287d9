"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals and their small letters; other letters keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lean(step: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A step over Arrow batches that gives freed memory back to the system at its end: a worker outlives its tasks."""

    @wraps(step)
    def run(*args, **kwargs) -> Iterator[pa.RecordBatch]:
        yield from step(*args, **kwargs)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """What is computed inside hands texts to Python in smaller batches than the session's."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what is made of a part stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between stages, which the session names in spark.checkpoint.dir.

    It must be one that the driver and all executors see. Only in local mode, where all are one process, an unset one is made.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="spark-")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a checkpoint in the shared folder of the cluster."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it to the shared folder and read it again.

    For loops: a checkpoint keeps the constraints that the optimizer has inferred, and these multiply with every turn.
    """
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_checked(left: DataFrame, right: DataFrame, on: Column | list[str], how: str, most: int) -> DataFrame:
    """Join with a broadcast of ``right`` if it has at most ``most`` rows, else with a shuffle on the keys.

    ``right`` is counted, so hand in a table that is cheap to read again (see ``cut``).
    """
    small = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if small else right, on, how)


#: A group is hot if it has over 1/HOT_SHARE of all rows; so there are fewer than HOT_SHARE hot groups.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Join ``rows`` with the one row that ``groups`` has for each value of ``key``; ``size`` is the group's number of rows.

    Hot groups are joined by a broadcast, which HOT_SHARE bounds, and never meet in one task; the rest by the key. Values
    of the key must not be null. ``groups`` is read thrice: hand in a table that is cheap to read again.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > total
    hot = groups.where(is_hot)
    mark = hot.select(F.col(key).alias("_platewise_hot"))
    in_hot = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(mark), F.col(key) == F.col("_platewise_hot"), "left_anti").join(groups.where(~is_hot), key)
    return in_hot.unionByName(rest)


#: Most row keys (16 bytes each) that are broadcast to drop rows.
BROADCAST_KEYS = 500_000


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart when some go: 128 bits of identifier and text. Rows alike in both share it."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))))


def keep_rows(docs: DataFrame, key: Column, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``marks`` has one row per row of ``docs``: key (see ``row_key``), chosen (the row is one that its group may keep) and
    group. One chosen row of each group stays: where several are chosen, they repeat identifier and group, and any one of
    them does. ``marks`` is read several times: hand in a table that is cheap to read again.
    """
    per = marks.where("chosen").groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    tied = cut(marks.where("chosen").join(per, "group").select(F.col("key").alias("_platewise_key"), F.col("group").alias("_platewise_group")).distinct())
    gone = marks.where("NOT chosen").select(F.col("key").alias("_platewise_key"))
    keyed = docs.withColumn("_platewise_key", key)
    left = join_checked(keyed, gone, ["_platewise_key"], "left_anti", BROADCAST_KEYS)
    if not tied.limit(1).count():
        return left.select(*docs.columns)
    alone = join_checked(left, tied.select("_platewise_key").distinct(), ["_platewise_key"], "left_anti", BROADCAST_KEYS).select(*docs.columns)
    # groups of alike rows are combined before the shuffle
    one = join_checked(left, tied, ["_platewise_key"], "inner", BROADCAST_KEYS).groupBy("_platewise_group").agg(F.first(F.struct(*docs.columns)).alias("_r")).select("_r.*")
    return alone.unionByName(one)
