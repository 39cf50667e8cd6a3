"""Audits of documents as they arrive: an extension, as the engine's operators themselves keep no state.

Each micro-batch is audited by the same plan as a table and appended; a document is its own unit, so batches don't
depend on one another. The checkpoint makes the source exactly-once; the sink's batch id column makes a repeated batch
visible, and `latest_scores` keeps the newest row of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofloom.operators.score import latest
from proofloom.plans import audit
from proofloom.rules import LATIN, Pack


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def audit_stream(docs: DataFrame, out: str, checkpoint: str, pack: Pack = LATIN, engines: tuple[str, ...] = ("norm",)) -> StreamingQuery:
    """Start the stream; scores go to `out` as Parquet with the batch's number."""

    def write(batch: DataFrame, number: int) -> None:
        report = audit.audit(batch.select("doc_id", "text"), pack, engines)
        report.scores.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_scores(history: DataFrame) -> DataFrame:
    """One row per document, of its newest batch."""
    return latest(history, "doc_id", "batch", "overall")


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per event type and tumbling window, closed by a watermark."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
