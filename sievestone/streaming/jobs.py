"""Streaming jobs: windowed counts, running domain counters, incremental dedup, recrawl timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import constants as C
from ..functions.text import content_hash
from ..functions.urls import normalize_url


def daily_counts(events: DataFrame, ts: str, by: str, late: str = "2 days") -> DataFrame:
    """Rows by day and group; state of days older than the watermark is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), by).agg(F.count("*").alias("cnt")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), by, "cnt")


def domain_counters(pages: DataFrame) -> DataFrame:
    """Running counts for each domain, for update or complete mode."""
    status = lambda s: F.count_if(F.col("status") == s).alias(f"pages_{s}")
    return pages.groupBy("domain").agg(F.count("*").alias("pages_crawled"), status("blocked"), status("skipped"))


def distinct_pages(pages: DataFrame, ts: str, late: str, url: str = "url", text: str = "main_content") -> DataFrame:
    """Pages whose normalised url and content hash are new within the watermark: keyed state, no history table."""
    keyed = pages.withColumns({"norm_url": normalize_url(F.col(url)), "content_hash": content_hash(F.col(text))})
    return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["norm_url"]).dropDuplicatesWithinWatermark(["content_hash"])


RECRAWL_OUT = "url string, last_crawled double, interval double, next_crawl double, times_changed long, times_unchanged long"
RECRAWL_STATE = "last double, interval double, digest string, changed long, unchanged long"


def recrawl(observed: DataFrame) -> DataFrame:
    """Schedule rows from observations (url, t, digest): keyed state of one short tuple for each url, in update mode."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, interval, digest, changed, same = state.get if state.exists else (0.0, float(C.DEFAULT_INTERVAL), None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "digest"], kind="stable")
        for t, new in zip(rows["t"], rows["digest"], strict=True):
            if digest is not None:
                if new != digest:
                    changed, interval = changed + 1, max(interval / C.INTERVAL_FACTOR, float(C.MIN_INTERVAL))
                else:
                    same, interval = same + 1, min(interval * C.INTERVAL_FACTOR, float(C.MAX_INTERVAL))
            last, digest = float(t), new
        state.update((last, interval, digest, changed, same))
        yield pd.DataFrame([(key[0], last, interval, last + interval, changed, same)], columns=[c.split()[0] for c in RECRAWL_OUT.split(", ")])

    return observed.groupBy("url").applyInPandasWithState(update, RECRAWL_OUT, RECRAWL_STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_sink(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch to `merge`, once each by its number; what the stream has is processed, then it stops."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    """The rows of a stream after all input that is there now: each micro-batch is written under its number, so a batch that
    runs again replaces itself; with update or complete mode, the last row of each batch number counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(path)
