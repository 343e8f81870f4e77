"""The crawl frontier, upserts and first-wins rules as set operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.urls import trap_reason, url_part
from ..session import materialize


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last version of each key: an upsert as an append-only table is read."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_k = 1").drop("_k")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by a partial aggregate rather than a window: hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def unseen(candidates: DataFrame, *known: DataFrame, key: str = "url") -> DataFrame:
    """Candidates, each key once, that no known table has."""
    out = candidates.dropDuplicates([key])
    for k in known:
        out = out.join(k.select(key), key, "left_anti")
    return out


def next_round(queue: DataFrame, n: int) -> DataFrame:
    """The pending rows that are to be fetched next: by priority, then age of entry."""
    return queue.filter("status = 'pending'").orderBy(F.desc("priority"), "id").limit(n)


def with_status(queue: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """queue with the status that done (key, new_status) gives."""
    return queue.join(done, key, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def prioritized(urls: DataFrame) -> DataFrame:
    """Sitemap rows by score: priority, news, change frequency and a date add up; place breaks ties."""
    score = F.col("priority") + F.when(F.col("is_news"), 0.5).otherwise(0.0) + F.when(F.col("changefreq").isin("hourly", "daily"), 0.2).otherwise(0.0) + F.when(F.coalesce("lastmod", F.lit("")) != "", 0.1).otherwise(0.0)
    return urls.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "ord")


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls that no robots prefix of their host disallows.  rules: (host, prefixes), one row for each host."""
    host = url_part(F.col(url), "host")
    joined = urls.withColumn("_h", host).join(rules.select(F.col("host").alias("_h"), "prefixes"), "_h", "left")
    return joined.filter(~F.exists(F.coalesce("prefixes", F.expr("array()").cast("array<string>")), lambda p: (p != "") & F.startswith(url_part(F.col(url), "path"), p))).drop("_h", "prefixes")


def reachable(seeds: DataFrame, links: DataFrame, depth: int, per_page: int | None = None) -> DataFrame:
    """(url, depth): breadth-first over a link table (src, dst, ord), each url at its least depth; traps are not entered.

    Every round joins only the new frontier with the links and drops what is known; per_page keeps each page's first links."""
    if per_page:
        links = links.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy("ord"))).filter(F.col("_k") <= per_page)
    known = materialize(seeds.select("url", F.lit(0).alias("depth")).dropDuplicates(["url"]))
    frontier = known
    for d in range(1, depth + 1):
        found = links.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        fresh = found.join(known.select("url"), "url", "left_anti").filter(trap_reason(F.col("url"), d).isNull())
        frontier = materialize(fresh.select("url", F.lit(d).alias("depth")))
        if not frontier.head(1):
            break
        known = known.unionByName(frontier)
    return known


def initial_interval(changefreq: Column, page_type: Column) -> Column:
    table = F.create_map(*[x for k, v in C.CHANGEFREQ.items() for x in (F.lit(k), F.lit(v))])
    usual = F.when(page_type.isin("wiki_page", "documentation"), 604800).otherwise(C.DEFAULT_INTERVAL)
    return F.coalesce(F.try_element_at(table, changefreq), usual).cast("double")


def adapted(interval: Column, changed: Column) -> Column:
    """The next interval: shorter after a change, longer without, within bounds."""
    return F.when(changed, F.greatest(interval / C.INTERVAL_FACTOR, F.lit(float(C.MIN_INTERVAL)))).otherwise(F.least(interval * C.INTERVAL_FACTOR, F.lit(float(C.MAX_INTERVAL))))


#: Exponents beyond which a map is constant on every interval of seconds: 1.5 ** 200 is 1e35.
_FAR = 200


def _scaled(x: np.ndarray, power: np.ndarray) -> np.ndarray:
    """x times the factor's power; for negative ones by division, so that what can be exact is."""
    f = C.INTERVAL_FACTOR ** np.abs(power).astype(np.float64)
    return np.where(power < 0, x / f, x * f)


def _composed(power: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maps x -> min(max(x * factor ** power, low), high), those of each run (a run begins at each place in start) made into one.

    The next map moves the bounds of the one before and keeps them within its own; neighbours of a run are joined in rounds."""
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(power))))
    while len(power) > len(start):
        first = np.searchsorted(run, run)
        even = (np.arange(len(run)) - first) % 2 == 0
        left = np.flatnonzero(even)
        right = np.minimum(left + 1, len(run) - 1)
        paired = (right > left) & (run[right] == run[left])
        l, r = left[paired], right[paired]
        low[l], high[l] = (np.clip(_scaled(edge[l], power[r]), low[r], high[r]) for edge in (low, high))
        power[l] += power[r]
        up, down = l[power[l] > _FAR], l[power[l] < -_FAR]
        low[up], high[down], power[up], power[down] = high[up], low[down], 0, 0
        power, low, high, run = power[left], low[left], high[left], run[left]
    return power, low, high


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of a batch in order: its first and last observation and all steps between them as one map."""
    part = TaskContext.get().partitionId()
    for number, b in enumerate(batches):
        key, t, digest = b.columns
        if not b.num_rows:
            continue
        same = lambda c: pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        one_key = same(key) | (pc.is_null(key[1:]).to_numpy(zero_copy_only=False) & pc.is_null(key[:-1]).to_numpy(zero_copy_only=False))
        changed = pc.fill_null(pc.not_equal(digest[1:], digest[:-1]), False).to_numpy(zero_copy_only=False)
        starts = np.append(True, ~one_key)
        start = np.flatnonzero(starts)
        last = np.append(start[1:], b.num_rows) - 1
        changed = np.append(False, changed) & ~starts
        power = np.where(starts, 0, np.where(changed, -1, 1)).astype(np.int64)
        low, high = np.where(changed, float(C.MIN_INTERVAL), 0.0), np.where(power > 0, float(C.MAX_INTERVAL), np.inf)
        changes = np.add.reduceat(changed.astype(np.int64), start)
        power, low, high = _composed(power, low, high, start)
        n, at = len(start), lambda c, places: c.take(pa.array(places))
        yield pa.RecordBatch.from_arrays(
            [at(key, start), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), at(digest, start), at(digest, last), at(t, last), pa.array(changes), pa.array(last - start - changes), pa.array(power), pa.array(low), pa.array(high)],
            ["key", "part", "number", "was", "digest", "t", "changed", "same", "power", "low", "high"])


def recrawl_fold(observed: DataFrame, key: str, ts: str, digest: str) -> DataFrame:
    """(key, last_crawled, interval, next_crawl, times_changed, times_unchanged): each key's observations in order of time.

    The first sets the interval; each later one adapts it.  A step is a clamped multiplication, and such maps compose: rows are dealt by
    ranges of (key, time, digest), so that a hot key lies in many tasks, each batch makes one map for each of its keys, and
    only those (a row for each key and batch) meet by key.  Rows without a time are left out; one without a digest is no change."""
    rows = observed.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").cast("double").alias("t"), F.col(digest).alias("digest")).filter("t IS NOT NULL")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = f"key {kind['key']}, part int, number int, was {kind['digest']}, digest {kind['digest']}, t double, changed long, same long, power long, low double, high double"
    runs = rows.repartitionByRange("key", "t", "digest").sortWithinPartitions("key", "t", "digest").mapInArrow(_runs, made)
    seen = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "number", "was", "digest", "t", "changed", "same", "power", "low", "high"))).alias("o"))
    start = F.struct(F.lit(float(C.DEFAULT_INTERVAL)).alias("i"), F.lit(None).cast(kind["digest"]).alias("h"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("u"), F.lit(True).alias("first"))
    factor = lambda r: F.pow(F.lit(float(C.INTERVAL_FACTOR)), F.abs(r.power))

    def step(a: Column, r: Column) -> Column:
        other = F.coalesce(a.h != r.was, F.lit(False))
        i = F.when(a.first, a.i).otherwise(adapted(a.i, other))
        moved = F.least(F.greatest(F.when(r.power < 0, i / factor(r)).otherwise(i * factor(r)), r.low), r.high)
        return F.struct(moved.alias("i"), r.digest.alias("h"), (a.c + r.changed + F.when(~a.first & other, 1).otherwise(0)).alias("c"), (a.u + r.same + F.when(a.first | other, 0).otherwise(1)).alias("u"), F.lit(False).alias("first"))

    done = seen.select(F.col("key").alias(key), F.element_at("o", -1).t.alias("last_crawled"), F.aggregate("o", start, step).alias("f"))
    return done.select(key, "last_crawled", F.col("f.i").alias("interval"), (F.col("last_crawled") + F.col("f.i")).alias("next_crawl"), F.col("f.c").alias("times_changed"), F.col("f.u").alias("times_unchanged"))


def due(schedule: DataFrame, now: Column, n: int) -> DataFrame:
    return schedule.filter(F.col("next_crawl") <= now).orderBy(F.desc("priority"), "next_crawl").limit(n)
