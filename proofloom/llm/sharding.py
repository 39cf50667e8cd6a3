"""Hilbert-curve sharding: quantise metadata dimensions, order rows by curve index, cut equal runs.

Each dimension becomes a cell number of `bits` bits: strings by hash (equal values share a cell), numbers on a
fixed logarithmic scale. Rows are ordered by (curve index, hash of the id, id), numbered without gaps, and cut
into shards whose row counts differ by one at most. Ranks come from counts per (index, salt) group, so a cell
with a third of all rows is spread over `SALTS` groups and no task ranks the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofloom.llm.common import documents, wrapped

BITS = 4
SALTS = 256
SHARDS = 16


def hilbert_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each point; cells holds one array of integers below 2**bits per dimension."""
    x = [np.asarray(c, dtype=np.int64).copy() for c in cells]
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.int64(1 << level)
        below = q - 1
        for i in range(dims):
            upper = (x[i] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(upper, below, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.int64(1 << level)
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for part in x:
            index = (index << 1) | (((part ^ flip) >> level) & 1)
    return index


def _cell(df: DataFrame, name: str, bits: int):
    """Cell number of a column: null is cell 0; strings by hash; numbers by log2 of 1 + |value|, 32 octaves."""
    kind = dict(df.dtypes)[name]
    cells = 1 << bits
    if kind in ("string", "boolean", "date", "timestamp", "binary"):
        cell = F.pmod(F.xxhash64(F.col(name)), F.lit(cells))
    else:
        value = F.abs(F.col(name).cast("double"))
        cell = F.least(F.floor(F.log2(F.lit(1.0) + value) * F.lit(cells / 32.0)), F.lit(cells - 1))
    return F.when(F.col(name).isNull(), F.lit(0)).otherwise(cell).cast("long")


TABLE_BITS = 14  # up to so many bits together, curve indices are looked up in an array of the plan


def curve_index(cells: Sequence[Column], bits: int) -> Column:
    """hilbert_index of columns of cell numbers: by an array of all points while there are few, else in Arrow batches."""
    dims = len(cells)
    if bits * dims <= TABLE_BITS:
        points = np.unravel_index(np.arange(1 << (bits * dims)), (1 << bits,) * dims)
        table = F.split(F.lit(",".join(map(str, hilbert_index(list(points), bits)))), ",").cast("array<long>")
        place = reduce(lambda a, c: a * F.lit(1 << bits) + c, cells, F.lit(0).cast("long"))
        return F.get(table, place.cast("int"))

    @F.pandas_udf("long")
    def curve(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([rows[c].to_numpy() for c in rows.columns], bits))

    return curve(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]))


def hilbert_shards(df: DataFrame, dims: Sequence[str], key: str, n_shards: int = SHARDS, bits: int = BITS, salts: int = SALTS) -> DataFrame:
    """All columns of df, plus hilbert (curve index), shard (0 to n_shards - 1) and slot (gapless within a shard).

    Columns of df named hilbert, shard or slot are replaced. Nulls in a dimension fall into cell 0, a null key is
    ordered first, rows of equal key by a hash of the whole row, repeated rows each get their own slot, and an empty table
    gives an empty result. Texts may have any length: they are only carried.
    """
    df = df.drop("hilbert", "shard", "slot")

    keyed = wrapped(df, key=F.col(key), h=curve_index([_cell(df, name, bits) for name in dims], bits)).withColumn("tie", F.xxhash64("row"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("key", "tie"), F.lit(salts)).cast("int"))
    counts = keyed.groupBy("h", "salt").agg(F.count("*").alias("n"))
    before_cell = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    before_salt = Window.partitionBy("h").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cell_start = counts.groupBy("h").agg(F.sum("n").alias("n_cell")).select("h", F.coalesce(F.sum("n_cell").over(before_cell), F.lit(0)).alias("cell_start"), F.sum("n_cell").over(Window.partitionBy()).alias("total"))
    starts = counts.withColumn("salt_start", F.coalesce(F.sum("n").over(before_salt), F.lit(0))).join(cell_start, "h").select("h", "salt", (F.col("cell_start") + F.col("salt_start")).alias("start"), "total")
    within = Window.partitionBy("h", "salt").orderBy(F.col("key").asc_nulls_first(), "tie")
    ranked = keyed.withColumn("r", F.row_number().over(within) - 1).join(starts, ["h", "salt"]).withColumn("rank", F.col("start") + F.col("r"))
    shard = F.expr(f"(rank * {int(n_shards)}) div total")
    first = F.expr(f"(shard * total + {int(n_shards) - 1}) div {int(n_shards)}")
    return ranked.withColumn("shard", shard.cast("long")).withColumn("slot", F.col("rank") - first).select("row.*", F.col("h").alias("hilbert"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write the rows of hilbert_shards, one folder per shard, in slot order: file statistics then prune on every dimension."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    narrow = docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    out = hilbert_shards(narrow, ["source", "lang", "size"], "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
