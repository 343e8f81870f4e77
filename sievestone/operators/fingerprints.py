"""A stored index of 64-bit fingerprints: each batch is looked up among those before it and becomes a part of it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, small_side
from .dedup import DISTANCE

#: Fingerprints under one key that one task compares with what asks for the key; more are dealt out over shares.
SHARE = 4096
#: Look-ups that one fingerprint may need.
LOOKUPS = 4096
#: A look-up is a row that is shuffled and sorted, a candidate two words that are compared: so many of these are as dear as one of those.
DEAR = 20
#: Comparisons of whole blocks in numpy that are as dear as a candidate; values whose candidates are counted to choose between the two.
CHEAP, SOME = 16, 128
#: Blocks of old and of new values at most, which is how often a value is shuffled; values of a block at least; values that are compared with ROWS others in one step.
GRID, LEAST, TILE, ROWS = 24, 8192, 8192, 8
#: Values of a bucket, as long as there are no more than 8,192 buckets.
BUCKET = 200_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _near(width: int, radius: int) -> int:
    return sum(comb(width, j) for j in range(radius + 1))


def shape(expected: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of the parts that 64 bits are cut into.

    Where the radii and the number of parts add up to distance + 1, values within the distance agree in some part up to its
    radius.  Few wide parts need more look-ups, many narrow ones give more candidates; taken is the number of parts with the least
    weighted sum of both for the expected number of values.  For 10^6 values that are spread evenly: 4 parts, 308 look-ups and about 4,700
    candidates, where pairs of 11 bands have 13,400."""

    def cut(m: int) -> list[tuple[int, int, int]]:
        radius, more = divmod(distance + 1 - m, m)
        edges = [64 * k // m for k in range(m + 1)]
        return [(edges[k], edges[k + 1] - edges[k], radius + (k < more)) for k in range(m)]

    able = [c for c in map(cut, range(3, distance + 2)) if sum(_near(w, r) for _, w, r in c) <= LOOKUPS]
    return min(able, key=lambda c: sum(_near(w, r) * (DEAR + expected / 2**w) for _, w, r in c))


def _pivot(values: np.ndarray) -> np.uint64:
    """The signs of the direction in which the values' bits vary most: distances to it tell more values apart than those to 0 do."""
    bits = np.unpackbits(values[:4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float)
    bits -= bits.mean(axis=0)
    return np.packbits(np.linalg.eigh(bits.T @ bits)[1][:, -1] > 0).view(">u8").astype(np.uint64)[0]


def _counter(distance: int):
    """For rows (p, q, x, y) of blocks: (value, how many values of the other block are within the distance); p = q is one block with itself.

    Values within the distance of one another have distances to a pivot that differ by no more, so only a range of y is compared with x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, bits, near = np.empty((ROWS, TILE), np.uint64), np.empty((ROWS, TILE), np.uint8), np.empty((ROWS, TILE), bool)
        for batch in batches:
            for k in range(batch.num_rows):
                # As unsigned: of a negative number numpy counts the absolute value's bits.
                x, y = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (2, 3))
                own, to_x, to_y = batch.column(0)[k].as_py() == batch.column(1)[k].as_py(), np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                pivot = _pivot(y)
                (x, to_pivot), (y, rising) = ((z[order], far[order]) for z in (x, y) for far in [np.bitwise_count(z ^ pivot).astype(np.int64)] for order in [np.argsort(far, kind="stable")])
                for at in range(0, len(x), ROWS):
                    some, far = x[at : at + ROWS], to_pivot[at : at + ROWS]
                    first, end = np.searchsorted(rising, (far[0] - distance, far[-1] + distance + 1)).tolist()
                    for low in range(first, end, TILE):
                        tile = y[low : min(low + TILE, end)]
                        a, b, c = (z[: len(some), : len(tile)] for z in (apart, bits, near))
                        np.bitwise_xor(some[:, None], tile, out=a)
                        np.less_equal(np.bitwise_count(a, out=b), distance, out=c)
                        hits = [np.count_nonzero(row) for row in c]
                        if any(hits):
                            to_x[at : at + ROWS] += hits
                            if not own:
                                to_y[low : low + len(tile)] += np.add.reduce(c.view(np.uint8), axis=0, dtype=np.uint8)
                for values, links in ((x, to_x - own), (y, to_y)):
                    some = links > 0
                    yield pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(links[some])], ["fingerprint", "links"])

    return run


@dataclass
class FingerprintIndex:
    """Tables under one folder, each with a partition for each batch, which a batch that runs again replaces:

    keys (key, salt, fingerprint) in buckets: a value once for each part, so that history is joined where it lies;
    hot (key, shares): keys with over SHARE values of a batch; classes (fingerprint, first, copies), in buckets;
    counts (fingerprint, links): how many links with values of the batch or before it a batch has brought to a value, old or new.

    Links are counted, not stored: a family of m values near one another has m²/2 of them.  pairs() looks them up where they are wanted.
    Documents with equal fingerprints are one class, named by the smallest id; they are never multiplied into pairs."""

    spark: SparkSession
    name: str
    parts: list[tuple[int, int, int]]
    distance: int
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, name: str, expected: int, distance: int = DISTANCE, buckets: int | None = None) -> FingerprintIndex:
        """The index at a path, new or with what it has; expected and buckets are the same at each opening."""
        buckets = buckets or max(8, min(8192, expected // BUCKET))
        columns = {
            "keys": ("key long, salt int, fingerprint long", "key, salt"), "hot": ("key long, shares int", None),
            "classes": ("fingerprint long, first long, copies long", "fingerprint"), "counts": ("fingerprint long, links long", None),
        }
        for table, (fields, by) in columns.items():
            clustered = f"CLUSTERED BY ({by}) INTO {buckets} BUCKETS" if by else ""
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{table} ({fields}, batch int) USING parquet PARTITIONED BY (batch) {clustered} LOCATION '{path}/{table}'")
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
            spark.sql(f"MSCK REPAIR TABLE {name}_{table}")
        return cls(spark, name, shape(expected, distance), distance, buckets)

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name}_{table} PARTITION (batch = {batch:d}) SELECT * FROM {{df}}", df=df)

    def _own(self, x: Column) -> list[Column]:
        """x's key in each part: the part's number above its bits."""
        return [F.shiftrightunsigned(x, low).bitwiseAND((1 << width) - 1).bitwiseOR(k << 32) for k, (low, width, _) in enumerate(self.parts)]

    def _asked(self, x: Column) -> Column:
        """The keys within a part's radius of x, of all parts."""
        flips = [[sum(1 << b for b in chosen) for j in range(radius + 1) for chosen in combinations(range(width), j)] for _, width, radius in self.parts]
        texts = [F.transform(F.split(F.lit(",".join(map(str, f))), ",").cast("array<long>"), own.bitwiseXOR) for f, own in zip(flips, self._own(x), strict=True)]
        return F.explode(F.concat(*texts))

    def _once(self, x: Column, y: Column) -> Column:
        """The first part in which x and y are within its radius: a pair is taken there and nowhere else."""
        apart = x.bitwiseXOR(y)
        return F.coalesce(*[F.when(F.bit_count(apart.bitwiseAND(_signed(((1 << w) - 1) << low))) <= r, k) for k, (low, w, r) in enumerate(self.parts)])

    def candidates(self, values: DataFrame, batch: int) -> DataFrame:
        """(x, y, distance) of the values of a batch with those that are indexed; only what asks is shuffled, by the buckets."""
        hot = self.table("hot").groupBy("key").agg(F.max("shares").alias("shares"))
        asked = values.select(F.col("fingerprint").alias("x"), self._asked(F.col("fingerprint")).alias("key")).join(small_side(hot), "key", "left")
        asked = asked.select("x", "key", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("salt"))
        held = self.table("keys").filter(F.col("batch") <= batch).withColumnRenamed("fingerprint", "y")
        x, y = F.col("x"), F.col("y")
        met = (asked["key"] == held["key"]) & (asked["salt"] == held["salt"]) & ((held["batch"] < batch) | (x < y))
        apart = F.bit_count(x.bitwiseXOR(y))
        return asked.join(held, met & (apart <= self.distance) & (self._once(x, y) == F.shiftright(asked["key"], 32))).select("x", "y", apart.alias("distance"))

    def _values(self, batches: Column) -> DataFrame:
        """The values that came with the batches, each once."""
        return self.table("keys").filter(batches & (F.shiftright("key", 32) == 0)).select("fingerprint")

    def _links(self, fresh: DataFrame, batch: int) -> DataFrame:
        """(fingerprint, links) of a batch's new values with one another and with older ones, for both ends.

        Candidates of a few values are counted.  Where families are so large that look-ups would cost more, all pairs are compared in blocks."""
        new, known = fresh.count(), self._values(F.col("batch") < batch)
        old = known.count()
        asked = fresh.orderBy(F.xxhash64("fingerprint")).limit(SOME).select(self._asked(F.col("fingerprint")).alias("key"))
        met = self.table("keys").filter(F.col("batch") <= batch).join(F.broadcast(asked), "key").count() / max(1, min(new, SOME))
        if DEAR * sum(_near(w, r) for _, w, r in self.parts) + met > (old + new / 2) / CHEAP:
            return self._in_blocks(fresh, new, known, old)
        ends = self.candidates(fresh, batch).select(F.explode(F.array("x", "y")).alias("fingerprint"))
        return materialize(ends.groupBy("fingerprint").agg(F.count("*").alias("links")))

    def _in_blocks(self, fresh: DataFrame, new: int, known: DataFrame, old: int) -> DataFrame:
        """The same by comparison: of new blocks with one another, each pair once, and with old blocks.

        However many values there are, one is shuffled for at most 2 * GRID pairs of blocks, as eight bytes there and a count back."""
        n, m = (min(GRID, -(-x // LEAST)) for x in (new, old))
        dealt = lambda v, count, first: v.groupBy((F.pmod(F.xxhash64("fingerprint"), F.lit(max(1, count))) + first).cast("int").alias("block")).agg(F.collect_list("fingerprint").alias("values"))
        blocks = materialize(dealt(fresh, n, 0).unionByName(dealt(known, m, n)))
        left = blocks.filter(F.col("block") < n).select(F.col("block").alias("p"), F.explode(F.sequence(F.col("block"), F.lit(n + m - 1))).alias("q"), F.col("values").alias("x"))
        paired = left.join(blocks.toDF("q", "y"), "q").repartition(max(1, n * (n + 1) // 2 + n * m), "p", "q").select("p", "q", "x", "y")
        counted = paired.mapInArrow(_counter(self.distance), "fingerprint long, links long")
        found = materialize(counted.groupBy("fingerprint").agg(F.sum("links").alias("links")), 1)
        discard(blocks)
        return found

    def add(self, rows: DataFrame, batch: int, key: str, fingerprint: str) -> None:
        """Index a batch and count its links.  Batches are numbered upwards; the last one may be repeated and replaces itself.

        Rows without a fingerprint are left out; an empty batch adds nothing; repeated rows count as copies."""
        classes = materialize(rows.filter(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("fingerprint")).agg(F.min(key).cast("long").alias("first"), F.count("*").alias("copies")))
        known = self.table("classes").filter(F.col("batch") < batch).select("fingerprint")
        fresh = materialize(classes.join(known, "fingerprint", "left_anti").select("fingerprint"))
        keyed = fresh.select(F.explode(F.array(*self._own(F.col("fingerprint")))).alias("key"), "fingerprint")
        self._write(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SHARE).select("key", F.ceil(F.col("n") / SHARE).cast("int")), "hot", batch)
        hot = self.table("hot").filter(F.col("batch") == batch).select("key", "shares")
        salted = keyed.join(small_side(hot), "key", "left").select("key", F.pmod(F.xxhash64("fingerprint"), F.coalesce("shares", F.lit(1))).cast("int").alias("salt"), "fingerprint")
        self._write(salted.repartition(self.buckets, "key", "salt"), "keys", batch)  # as it is bucketed: a file for each
        self._write(self._links(fresh, batch), "counts", batch)
        self._write(classes.repartition(self.buckets, "fingerprint"), "classes", batch)  # last: with it the batch is known

    def classes(self) -> DataFrame:
        """(fingerprint, class_id, copies, links): each value with the smallest id that has it, its rows, and the values linked with it."""
        held = self.table("classes").groupBy("fingerprint").agg(F.min("first").alias("class_id"), F.sum("copies").alias("copies"))
        ends = self.table("counts").groupBy("fingerprint").agg(F.sum("links").alias("links"))
        return held.join(ends, "fingerprint", "left").withColumn("links", F.coalesce("links", F.lit(0)))

    def pairs(self) -> DataFrame:
        """(a, b, distance): links between classes by their ids, a < b, each batch's values looked up anew."""
        batches = sorted(r["batch"] for r in self.table("classes").select("batch").distinct().collect())
        links = reduce(DataFrame.unionByName, [self.candidates(self._values(F.col("batch") == n), n) for n in batches or [0]])
        name = self.table("classes").groupBy("fingerprint").agg(F.min("first").alias("class_id"))
        named = links.join(name.toDF("x", "p"), "x").join(name.toDF("y", "q"), "y")
        return named.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")

    def drop(self) -> None:
        """Delete the index with its files."""
        for table in ("keys", "hot", "classes", "counts"):
            discard(self.table(table))
            self.spark.sql(f"DROP TABLE {self.name}_{table}")
