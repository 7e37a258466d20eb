"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set: a temporary one in local mode, which goes at exit, else one in the warehouse."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        name = f"pagetide-{uuid.uuid4().hex}"
        if spark.sparkContext.master.startswith("local"):
            got = os.path.join(tempfile.gettempdir(), name)
            atexit.register(shutil.rmtree, got, ignore_errors=True)
        else:
            got = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(got)
    return got


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, records: int = 2048, size: int = 16 << 20) -> None:
    """Keeps Arrow batches of whole texts small in this session, so that neither side of the pipe holds much at once."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", records), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = (spark.conf.get(name) or "").lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with the same key, as one table each; rows must come sorted by key."""
    held: list[pa.Table] = []
    for batch in batches:
        pa.default_memory_pool().release_unused()  # or each worker keeps what its largest group took
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        edges = [0, *(i + 1 for i in range(len(keys) - 1) if keys[i] != keys[i + 1]), len(keys)]
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:]):
            held.append(table.slice(a, b - a))
            if b < len(keys):
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


_PAGE = 1 << 15  # bits in a row of bitmap_construct_agg


def _sieve(keys: DataFrame, key: str, most_bits: int) -> tuple[DataFrame, Column]:
    """A bitmap of the keys' hashes, in pages, and the condition under which a row's key may be one of them."""
    bits = min(most_bits, max(_PAGE, 16 * keys.count()))
    at = F.pmod(F.xxhash64(F.col(key).cast(keys.schema[key].dataType)), F.lit(bits))  # one type, or equal keys have other hashes
    pages = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / _PAGE).alias("__page")).agg(F.bitmap_construct_agg(F.col("at") % _PAGE).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at % _PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.broadcast(pages), (F.floor(at / _PAGE) == F.col("__page")) & (F.getbit(byte, (at % 8).cast("int")) == 1)


def holding(df: DataFrame, keys: DataFrame, key: str, most_bits: int = 1 << 26) -> DataFrame:
    """df's rows whose key may be one of keys: all that are, and few others (more of them where keys outgrow 16 bits each of most_bits),
    so that an exact join need not move the rest. keys must be cheap to compute again."""
    return df.join(*_sieve(keys, key, most_bits), "left_semi")


def without(df: DataFrame, keys: DataFrame, key: str, most_bits: int = 1 << 26) -> DataFrame:
    """df's rows whose key is none of keys. Only those that a bitmap does not tell apart are joined by shuffle."""
    pages, may = _sieve(keys, key, most_bits)
    return df.join(pages, may, "left_anti").union(df.join(pages, may, "left_semi").join(keys, key, "left_anti").select(*df.columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
