"""Vectors of a model over tables: each distinct text is asked for once, in batches and at a bounded rate, and kept.

A server is asked by `tasks` tasks at most, each of which makes `rate` calls a second at most, so its load does not grow with
the table or the cluster. What it does not answer after `tries` calls is not kept, stays null and is asked for again the next time.
Vectors of different models lie in one table under different names and are never compared.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.models import Client, ModelError, Offline, connect
from proofloom.operators.corpus import named


def patient(ask, tries: int = 3, wait: float = 0.5):
    """The answer of `ask`, asked up to `tries` times, each time after twice the wait; None without one."""
    for turn in range(tries):
        try:
            return ask()
        except ModelError:
            if turn + 1 < tries:
                time.sleep(wait * 2**turn)
    return None


def answered(texts: DataFrame, client: Client, batch: int = 32, rate: float = 10.0, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """texts (t, u, text) as t, u, vec: null without an answer. Calls of a task begin 1 / rate seconds apart; a batch without an
    answer is asked text by text, so that one text that the model refuses does not cost its neighbours theirs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = 0.0

        def paced(ask):
            def call():
                nonlocal due
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + (0.0 if isinstance(client, Offline) else 1.0 / rate)
                return ask()

            return patient(call, tries, wait)

        for frame in frames:
            made: list = []
            for lo in range(0, len(frame), batch):
                asked = frame["text"].iloc[lo : lo + batch].tolist()
                rows = paced(lambda asked=asked: client.embed_all(asked))
                if rows is None:
                    rows = [paced(lambda x=x: client.embed(x)) for x in asked] if len(asked) > 1 else [None]
                made += rows
            yield frame[["t", "u"]].assign(vec=[None if v is None else np.asarray(v, dtype=np.float64) for v in made])

    return texts.select("t", "u", "text").mapInPandas(run, "t long, u long, vec array<double>")


class VectorStore:
    """Vectors of texts as a table of the catalog, bucketed by text: name of the model, t, u (two hashes of the text), vec."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, table: str, settings: Mapping | None = None):
        self.spark, self.table = spark, table
        self.client = connect(settings)  # asked once here: tasks never change over to hashed vectors on their own
        self.model = "hashed" if isinstance(self.client, Offline) else f"{self.client.wire}/{self.client.model}"
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], "model string, t long, u long, vec array<double>"))

    def _append(self, rows: DataFrame) -> None:
        rows.repartition(self.BUCKETS, "t").write.bucketBy(self.BUCKETS, "t").sortBy("t").format("parquet").mode("append").saveAsTable(self.table)

    def held(self) -> DataFrame:
        """t, u, vec of this model; a text that two runs added is one."""
        return self.spark.table(self.table).filter(F.col("model") == self.model).dropDuplicates(["t", "u"]).select("t", "u", "vec")

    def add(self, texts: DataFrame, tasks: int = 8, waves: int = 1, **pace) -> int:
        """Ask for the texts (text) that the store lacks and keep the answers; how many came. Null texts are none. Each of the
        `waves` parts of the texts is kept when it is made: a job that dies costs one of them. pace: see `answered`."""
        lacking = named(texts.filter(F.col("text").isNotNull()).select("text").distinct())
        before = self.held().count()
        for part in range(waves):
            fresh = lacking.filter(F.pmod("t", F.lit(waves)) == part).join(self.held(), ["t", "u"], "left_anti")
            got = answered(fresh.repartition(tasks), self.client, **pace).filter("vec IS NOT NULL")
            self._append(got.select(F.lit(self.model).alias("model"), "t", "u", "vec"))
        return self.held().count() - before

    def of(self, rows: DataFrame, column: str = "text", out: str = "vec") -> DataFrame:
        """rows with the vector of a column's text as `out`, null where the store has none; every row once."""
        whole = rows.drop(out).select(F.struct("*").alias("row_"), F.col(column).alias("text"))
        joined = named(whole).join(self.held(), ["t", "u"], "left")
        return joined.select("row_.*", F.when(F.col("text").isNotNull(), F.col("vec")).alias(out))
