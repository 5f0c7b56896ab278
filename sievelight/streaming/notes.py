"""Streaming extensions: notes as a stream against a stored index, and postings of a stream of records.

The batch engine has no streams of its own to match; these reuse its operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.index import Index, postings
from sievelight.operators.search import analyzed, search
from sievelight.schema import Config


def match_notes(stream: DataFrame, ix: Index, cfg: Config, path: str, checkpoint: str):
    """Ranks every micro-batch of notes (qid, note, age, sex) and appends the results as Parquet."""

    def run(batch: DataFrame, _: int) -> None:
        found = search(analyzed(batch, ix.stemmed), batch.select("qid", "age", "sex"), ix, cfg)
        found.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def append_records(stream: DataFrame, path: str, checkpoint: str, stemmed: bool = True):
    """Writes the postings of every micro-batch of new records; a batch that is run again overwrites its own folder.

    These are postings alone: statistics of documents and terms change with the whole
    corpus, so an index is built anew (``index.build``) from old and new records.
    """

    def run(batch: DataFrame, n: int) -> None:
        postings(batch, stemmed).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def first_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of a stream (or table) once each, as long as repeats are no later than the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows over de-duplicated events."""
    once = first_events(events, late)
    counted = once.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")
