"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated Poisson(rate_s) times, rate_s = target share of s x total size / size of s.
The count inverts the Poisson distribution at a uniform number hashed from seed and id, so it needs no state, is
the same on every run and every retry, and no copy depends on another row. Copies are then ordered by a hash of
(seed, id, copy): a global shuffle that is repeatable too.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.common import documents, staged, wrapped

SEED = "mix-1"
TEMPERATURE = 0.5
MAX_RATE = 64.0  # above it a target that the caller gives asks for more than 64 copies of a text on average: refused
BROADCAST_STEPS = 400_000  # steps of all sources' distributions, of 8 bytes each, that are broadcast at most
TAIL = 200  # steps of the inverted distribution up to a rate of 64: P(count > 200) < 1e-35
COPIES = 1 << 16  # of a row that are made at once


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1): the first 13 hex digits of md5 over seed and parts, over 2**52."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(df: DataFrame, group: Column, size: Column, targets: Mapping[str, float] | None, temperature: float) -> DataFrame:
    """One row per source: grp, rate. Without targets a source's share is its size to the power of temperature."""
    sizes = df.select(group.alias("grp"), size.cast("long").alias("size")).groupBy("grp").agg(F.sum("size").alias("size")).filter("size > 0")
    if targets is None:
        weighed = sizes.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        given = F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))])
        weighed = sizes.withColumn("w", F.coalesce(given[F.col("grp")], F.lit(0.0)))
    sums = weighed.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w"))
    return weighed.crossJoin(sums).select("grp", (F.col("w") / F.col("all_w") * F.col("all_size") / F.col("size")).alias("rate"))


def poisson_cdf(rate: float) -> tuple[int, np.ndarray]:
    """first and the array of P(count <= k) for k = first, first + 1, ...: less than 1e-30 lies before or behind."""
    reach = 12 * math.sqrt(rate) + 40
    first = max(0, math.floor(rate - reach))
    last = max(TAIL, math.ceil(rate + reach))
    start = math.exp(first * math.log(rate) - rate - math.lgamma(first + 1)) if first else math.exp(-rate)
    cdf = np.cumsum(np.cumprod(np.r_[start, rate / np.arange(first + 1, last + 1)]))
    return first, cdf / cdf[-1] if first else cdf  # a large first number has no exact logarithm


def with_cdf(rates: DataFrame) -> DataFrame:
    """grp, first, cdf of rows (grp, rate)."""

    def run(batches):
        for batch in batches:
            first, cdf = zip(*map(poisson_cdf, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.int64()), pa.array([c.tolist() for c in cdf], pa.list_(pa.float64()))], ["grp", "first", "cdf"])

    return rates.select("grp", "rate").mapInArrow(run, "grp string, first long, cdf array<double>")


def mix_sources(df: DataFrame, key: str = "doc_id", group: str = "source", size: Column | None = None, targets: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """The rows of df, each as often as drawn, in globally shuffled order, plus mix_copy, mix_copies and mix_order.

    size weighs a row (default: 1 + UTF-8 bytes of text, so that empty and null texts count too). A null source is
    the source ''. Any rate is drawn, but a given target that asks for more than MAX_RATE copies of each document of a
    source is an error. A row whose source has target 0 goes; repeated rows and rows of equal key draw the same count
    and share their mix_order, so their order among each other is open. Texts of any length are copied whole.
    Columns named mix_copy, mix_copies or mix_order are replaced. An empty table gives an empty one.
    """
    df = df.drop("mix_copy", "mix_copies", "mix_order")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1 if size is None else size
    grp = F.coalesce(F.col(group).cast("string"), F.lit(""))
    rates = source_rates(df, grp, size, targets, temperature)
    if targets is not None:
        checked = F.when(F.col("rate") <= MAX_RATE, F.col("rate")).otherwise(F.raise_error(F.lit(f"a target asks for more than {MAX_RATE} copies of each document")).cast("double"))
        rates = rates.withColumn("rate", checked)
    rates = staged(with_cdf(rates), "rates")
    few = rates.agg(F.coalesce(F.sum(F.size("cdf")), F.lit(0))).first()[0] <= BROADCAST_STEPS
    # with few sources no row moves and a hot source is no hot partition; with more they join by shuffle
    rates = F.broadcast(rates) if few else rates
    # u is computed below the join: above it, it would be folded into the search and hashed again at every step
    drawn = wrapped(df, grp=grp, k=F.col(key), u=uniform(seed, F.col(key))).join(rates, "grp").withColumn("n", (F.col("first") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))).cast("int")).drop("cdf", "first")
    blocks = drawn.filter("n > 0").select("row", "k", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES))).alias("from"))
    copies = blocks.select("row", "k", "n", F.explode(F.sequence("from", F.least(F.col("n") - 1, F.col("from") + (COPIES - 1)))).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("k").cast("string"), F.lit("")), F.col("copy").cast("string")))
    placed = copies.select("row.*", F.col("copy").alias("mix_copy"), F.col("n").alias("mix_copies"), order.alias("mix_order"))
    return placed.repartitionByRange("mix_order").sortWithinPartitions("mix_order")


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = documents(spark, sf_dir).select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    out = mix_sources(narrow, size=F.col("size"))
    return out.select("doc_id", "source", "size", F.col("mix_copy").cast("long").alias("copy"), F.col("mix_copies").cast("long").alias("copies"), F.col("mix_order").alias("order_key"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS grp, coalesce(strlen(text), 0) + 1 AS size FROM documents),
s AS (SELECT grp, sum(size)::DOUBLE AS size FROM d GROUP BY grp),
r AS (SELECT grp, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate FROM s),
k AS (SELECT grp, rate, unnest(range(0, {TAIL + 1})) AS k FROM r),
p AS (SELECT grp, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM k),
c AS (SELECT grp, k, sum(p) OVER (PARTITION BY grp ORDER BY k) AS cdf FROM p),
u AS (SELECT d.*, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u FROM d),
n AS (SELECT u.doc_id, u.source, u.size, (SELECT count(*) FROM c WHERE c.grp = u.grp AND c.cdf <= u.u) AS copies FROM u),
e AS (SELECT *, unnest(range(0, copies)) AS copy FROM n)
SELECT doc_id, source, size::BIGINT AS size, copy::BIGINT AS copy, copies::BIGINT AS copies,
       md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS order_key
FROM e"""
