"""The crawl loop as a stream: keyed queues with politeness timers give out urls, and what a page links to comes back in.

    seeds -> frontier files -> HostQueue (state for each host) -> orders -> fetched pages -> their links -> frontier files

A host's queue, the urls it has seen and its next free moment are state of a streaming query, so they are partitioned by host,
checkpointed, and found again after a restart.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.html import links
from ..functions.urls import followable, normalize_url, trap_reason, url_part
from ..operators.frontier import allowed
from ..sources import http

#: What frontier files hold.  A higher priority goes first; within one, urls go in the order they came.
FRONTIER = "url string, depth int, priority int"
PRIORITIES = 3
ORDER = "host string, url string, depth int, kind string"
QUEUED, FETCH = "queued", "fetch"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


class HostQueue(StatefulProcessor):
    """State of one host.  The queue is a map from (priority, place) to the url with its ends kept beside it, so that taking the
    first or adding a last one touches one entry, however long the queue is; a list state would be read and written whole."""

    def __init__(self, delay: float, max_depth: int, max_pages: int) -> None:
        # At least a millisecond: a timer for the moment of the one that just expired would be deleted with it.
        self.delay, self.max_depth, self.max_pages = max(1, round(delay * 1000)), max_depth, max_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        long, text = T.LongType(), T.StringType()
        self.seen = handle.getMapState("seen", _struct(norm=text), _struct(depth=T.IntegerType()))
        self.queue = handle.getMapState("queue", _struct(priority=T.IntegerType(), place=long), _struct(url=text, depth=T.IntegerType()))
        self.ends = handle.getValueState("ends", _struct(accepted=long, free_at=long, armed=T.BooleanType(), **{f"{end}{p}": long for p in range(PRIORITIES) for end in ("head", "tail")}))

    def _load(self) -> dict:
        names = ["accepted", "free_at", "armed", *(f"{end}{p}" for p in range(PRIORITIES) for end in ("head", "tail"))]
        return dict(zip(names, self.ends.get(), strict=True)) if self.ends.exists() else {n: 0 for n in names} | {"armed": False}

    def _save(self, s: dict) -> None:
        self.ends.update(tuple(s.values()))

    @staticmethod
    def _row(host: str, url: str, depth: int, kind: str) -> tuple:
        return host, url, depth, kind

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """New urls of the host: each once, whatever page it is found on, within the limits of depth and pages."""
        s, taken = self._load(), []
        # A batch's rows come in the order of its shuffle; sorted, the queue is the same when a batch runs again.
        batch = pd.concat(list(rows)).sort_values(["depth", "priority", "norm", "url"], ascending=[True, False, True, True], kind="stable")
        for norm, url, depth, priority in zip(batch["norm"], batch["url"], batch["depth"], batch["priority"], strict=True):
            if depth > self.max_depth or s["accepted"] >= self.max_pages or self.seen.containsKey((norm,)):
                continue
            p = min(max(int(priority), 0), PRIORITIES - 1)
            self.seen.updateValue((norm,), (int(depth),))
            self.queue.updateValue((p, s[f"tail{p}"]), (url, int(depth)))
            s[f"tail{p}"] += 1
            s["accepted"] += 1
            taken.append(self._row(key[0], url, int(depth), QUEUED))
        if taken:
            if not s["armed"]:
                self.handle.registerTimer(max(timerValues.getCurrentProcessingTimeInMs(), s["free_at"]))
                s["armed"] = True
            self._save(s)
        yield pd.DataFrame(taken, columns=["host", "url", "depth", "kind"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The host is free: one url goes out, and the next one waits for the delay to pass."""
        s, out = self._load(), []
        left = {p: s[f"tail{p}"] - s[f"head{p}"] for p in range(PRIORITIES)}
        s["armed"] = False
        if p := next(((p,) for p in reversed(range(PRIORITIES)) if left[p]), None):
            at = (p[0], s[f"head{p[0]}"])
            url, depth = self.queue.getValue(at)
            self.queue.removeKey(at)
            s[f"head{p[0]}"] += 1
            s["free_at"] = timerValues.getCurrentProcessingTimeInMs() + self.delay
            out.append(self._row(key[0], url, depth, FETCH))
            if sum(left.values()) > 1:
                self.handle.registerTimer(s["free_at"])
                s["armed"] = True
        self._save(s)
        yield pd.DataFrame(out, columns=["host", "url", "depth", "kind"])

    def close(self) -> None:
        pass


def orders(found: DataFrame, delay: float, max_depth: int, max_pages: int) -> DataFrame:
    """A stream of (host, url, depth, kind) from a stream of frontier rows: a row of kind `queued` for every url that is new, and
    one of kind `fetch` when its turn has come: one for each host every `delay` seconds at most."""
    clean = found.filter("url IS NOT NULL").select("url", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("priority", F.lit(0)).alias("priority"))
    keyed = clean.filter(trap_reason(F.col("url"), F.col("depth")).isNull()).withColumns({"host": F.lower(url_part(F.col("url"), "host")), "norm": normalize_url(F.col("url"))})
    return keyed.filter("host <> ''").groupBy("host").transformWithStateInPandas(HostQueue(delay, max_depth, max_pages), ORDER, "append", "ProcessingTime")


@dataclass
class Loop:
    """A crawl in a folder that driver and executors share.

    frontier/  urls to be looked at: seeds, and for each batch the links of its pages
    orders/    for each batch what was queued and given out
    pages/     for each batch the responses, written once: a batch that runs again after a stop finds them
    robots/    for each batch the rules of hosts that were new in it
    checkpoint/ the stream's own state
    """

    spark: SparkSession
    folder: str
    delay: float = 1.0
    max_depth: int = 5
    max_pages: int = 1000
    #: Hosts whose links are followed; all if none is given.
    hosts: frozenset[str] = frozenset()
    fetch: Callable[[DataFrame], DataFrame] = field(default=lambda urls: http.fetch(urls, delay=0.0))
    robots: Callable[[DataFrame], DataFrame] = field(default=http.robots)
    queued: int = 0
    fetched: int = 0
    idle: bool = False

    def _path(self, name: str, batch: int | None = None) -> str:
        return f"{self.folder.rstrip('/')}/{name}" + ("" if batch is None else f"/batch={batch:09d}")

    def _there(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _table(self, name: str, schema: str | T.StructType) -> DataFrame:
        path = self._path(name)
        if not self._there(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def pages(self) -> DataFrame:
        """All responses so far."""
        return self._table("pages", http.RESPONSE + ", depth int")

    def add(self, urls: DataFrame) -> None:
        """More seeds: rows with url, and priority and depth if they have any.  Urls that the crawl has seen are passed over."""
        rows = urls.select("url", *[(F.col(c) if c in urls.columns else F.lit(0)).cast("int").alias(c) for c in ("depth", "priority")])
        rows.write.mode("append").parquet(self._path("frontier") + f"/seeds-{time.time_ns()}")

    def _rules(self, wanted: DataFrame, batch: int) -> DataFrame:
        """Robots rules of all hosts asked for; those of new hosts are fetched once and kept."""
        path = self._path("robots", batch)
        if not self._there(f"{path}/_SUCCESS"):
            known = self._table("robots", "host string, prefixes array<string>").select("host")
            new = wanted.withColumn("host", url_part(F.col("url"), "host")).join(known, "host", "left_anti").select("url")
            self.robots(new).select("host", "prefixes").write.mode("overwrite").parquet(path)
        return self._table("robots", "host string, prefixes array<string>").dropDuplicates(["host"])

    def batch(self, rows: DataFrame, number: int) -> None:
        """One micro-batch: what is given out is fetched, what is found goes back to the frontier.  Each step's rows are written
        under the batch's number before the next step reads them, and a step that is done is not done again."""
        spark = self.spark
        rows.write.mode("overwrite").parquet(self._path("orders", number))
        made = spark.read.schema(ORDER).parquet(self._path("orders", number))
        counts = {r["kind"]: r["count"] for r in made.groupBy("kind").count().collect()}
        if counts.get(FETCH):
            wanted = made.filter(F.col("kind") == FETCH).select("url", "depth")
            pages = self._path("pages", number)
            if not self._there(f"{pages}/_SUCCESS"):
                may = allowed(wanted, self._rules(wanted, number))
                got = self.fetch(may.select("url")).select(*[c.split()[0] for c in http.RESPONSE.split(", ")])
                got.join(F.broadcast(wanted), "url").write.mode("overwrite").parquet(pages)  # as many rows as hosts in the batch
            page = spark.read.schema(http.RESPONSE + ", depth int").parquet(pages).filter("html <> ''")
            out = page.select(F.explode(links(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")), F.col("html"))).alias("url"), (F.col("depth") + 1).alias("depth"), F.lit(0).alias("priority"))
            out = out.filter(followable(F.col("url")) & (F.col("depth") <= self.max_depth))
            if self.hosts:
                out = out.filter(F.lower(url_part(F.col("url"), "host")).isin(*self.hosts))
            out.write.mode("overwrite").parquet(self._path("frontier", number))
        self.queued += counts.get(QUEUED, 0)
        self.fetched += counts.get(FETCH, 0)
        self.idle = not counts and self.queued == self.fetched

    def run(self, every: str = "1 second", max_total: int | None = None, max_seconds: float = float("inf")) -> int:
        """Crawl until no host has a url left and no page has a new link, or until about max_total urls were given out or
        max_seconds are over.  Returns how many were, earlier runs in this folder included.  A run that was stopped goes on
        where it was."""
        provider = "spark.sql.streaming.stateStore.providerClass"
        before = self.spark.conf.get(provider, None)
        self.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        done = {r["kind"]: r["count"] for r in self._table("orders", ORDER).groupBy("kind").count().collect()}
        self.queued, self.fetched, self.idle = done.get(QUEUED, 0), done.get(FETCH, 0), False
        # The last batch may have written its orders and be run again: it is counted when it is.
        self._forget_open()
        # A query that starts again runs its first batch only for new input, and timers with it: an empty row wakes it.
        self.add(self.spark.createDataFrame([(None,)], "url string"))
        end = time.monotonic() + max_seconds
        source = self.spark.readStream.schema(FRONTIER).option("recursiveFileLookup", "true").parquet(self._path("frontier"))
        stream = orders(source, self.delay, self.max_depth, self.max_pages).writeStream.outputMode("append").foreachBatch(self.batch).option("checkpointLocation", self._path("checkpoint")).trigger(processingTime=every)
        query = stream.start()
        try:
            while query.isActive and not self.idle and time.monotonic() < end and (max_total is None or self.fetched < max_total):
                time.sleep(0.1)
        finally:
            query.stop()
            self.spark.conf.set(provider, before) if before is not None else self.spark.conf.unset(provider)
        if query.exception():
            raise query.exception()
        return self.fetched

    def _forget_open(self) -> None:
        """Take back the counts of batches that the checkpoint has not as done, since they will run again."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self._path("checkpoint") + "/commits")
        fs = path.getFileSystem(conf)
        names = [os.path.basename(f.getPath().getName()) for f in fs.listStatus(path)] if fs.exists(path) else []
        last = max((int(n) for n in names if n.isdecimal()), default=-1)
        path = jvm.org.apache.hadoop.fs.Path(self._path("orders"))
        for f in fs.listStatus(path) if fs.exists(path) else []:
            number = f.getPath().getName().removeprefix("batch=")
            if number.isdecimal() and int(number) > last:
                for r in self.spark.read.schema(ORDER).parquet(self._path("orders", int(number))).groupBy("kind").count().collect():
                    self.queued -= r["count"] * (r["kind"] == QUEUED)
                    self.fetched -= r["count"] * (r["kind"] == FETCH)
