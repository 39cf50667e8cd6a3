"""Shared helpers: tables staged in the cluster's shared folder, whole-row structs and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="proofloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


_open: list[list[tuple[SparkSession, str]]] = []  # staged tables of the blocks of `temporary` that are open


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, name: str, keep: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet, with the writer's options, into the shared folder and read it again: cuts lineage and survives lost
    executors. Within a block of `temporary` the table goes at its end; with keep, at the end of the next outer one, if there is
    one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    owners = _open[:-1] if keep else _open
    if owners:
        owners[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


@contextmanager
def temporary() -> Iterator[None]:
    """What is staged in this block is deleted at its end, but for tables that are kept."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            _delete(spark, path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    _delete(df.sparkSession, df.staged_path)


TEXT_BATCH = 1000  # rows of an Arrow batch of texts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; Python workers of the session then get texts in batches of TEXT_BATCH rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def wrapped(df: DataFrame, **extra: Column) -> DataFrame:
    """The whole row as struct `row` beside the named columns, so that no input column can clash with an operator's own."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in extra.items()])


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a column: sizes the number of chunks, reads only that column."""
    return int(df.select(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


BITMAP_BITS = 26


def filled_bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """2**bits bits, each set if keys[column], a bigint hash, has a value with these upper bits. At most 2**(bits - 6)
    aggregated rows come to the driver."""
    x = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = keys.select(x.alias("x")).select(F.shiftright("x", 6).alias("w"), F.expr("shiftleft(1L, CAST(x & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.uint64)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def key_bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS):
    """A predicate for bigint columns of hashes: false only for values that keys[column] does not hold.

    It is backed by a broadcast bitmap of 2**bits bits (8 MB) whatever the number of keys; a fuller bitmap passes more
    rows to the exact join that follows, never fewer.
    """
    shared = keys.sparkSession.sparkContext.broadcast(filled_bitmap(keys, column, bits))

    @F.pandas_udf("boolean")
    def may_hold(hashes: pd.Series) -> pd.Series:
        place = hashes.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)
        held = shared.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))
        return pd.Series((held & np.uint64(1)) == 1)

    return may_hold
