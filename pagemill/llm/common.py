"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20


#: Rows and bytes that Spark hands to a Python worker at once, at most: texts are long, and both sides hold a whole batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Lowers the session's bounds of Arrow batches, which are made for short rows, if they are higher."""
    for key, most in BATCH.items():
        if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing on a single machine, as in tests, a temporary folder takes its place and goes at exit. On a
    cluster the setting must be there: executors don't see the driver's folders.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="pagemill-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts lineage, survives lost executors; goes when the driver ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**options).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Bins of a count for each doubling, by which a threshold is found.
COUNT_BINS = 16


def most_frequent(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """Rows of a written table whose count n is highest, at most `limit`: all rows above a threshold, which a histogram of counts gives.

    Rows of one bin of counts stay or go together, so there may be fewer; nothing is sorted, and the driver sees the bins only.
    """
    at = F.floor(F.log2(n) * COUNT_BINS).cast("int")
    left, least = limit, None
    for r in sorted(counts.groupBy(at.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["bin"]
    return counts.where(at >= least) if least is not None else counts.limit(0)


def fold_of(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys give null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(n)


def sample_by_hash(df: DataFrame, key: str, rows: int, stratum: str | None = None) -> DataFrame:
    """About `rows` rows (of each stratum, if given), chosen by a hash of the key; all rows if there are no more.

    The bound holds in expectation; the choice depends on the key alone, so a repeated run takes the same rows.
    """
    draw = (F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")
    if stratum is None:
        total = df.count()
        return df if total <= rows else df.where(draw < rows / total)
    shares = df.groupBy(stratum).count().select(F.col(stratum).alias("_stratum"), (F.lit(float(rows)) / F.col("count")).alias("_share"))
    return df.join(F.broadcast(shares), F.col(stratum) == F.col("_stratum")).where(draw < F.col("_share")).drop("_stratum", "_share")


#: Rows of a table that is sent to every task instead of dealt out, at most; parts of a key that is dealt out.
MAX_BROADCAST, SALTS = 200_000, 16


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int = MAX_BROADCAST) -> DataFrame:
    """Joins a table of few columns: sent to every task if it has at most `rows` rows, else dealt out.

    Keys may be hot on the left, so each is dealt out in SALTS parts and the right rows are repeated for each part.
    """
    if right.limit(rows + 1).count() <= rows:
        return left.join(F.broadcast(right), on, how)
    name = f"_salt_{uuid.uuid4().hex}"  # no column of the caller's
    parts = right.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    return left.withColumn(name, salt).join(parts.hint("merge"), [*on, name], how).drop(name)


def slices(batches: Iterable[pa.RecordBatch], *columns: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the columns hold at most `limit` bytes together, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(np.array(pa.compute.binary_length(batch.column(c)).fill_null(0), dtype=np.int64) for c in columns)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
