"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split again."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_broadcast, materialize

BITS = 60
SHARD_BYTES = 64 << 20


def directory_of(rows: DataFrame, limit: int, total: int) -> tuple[DataFrame, int]:
    """Leaf prefixes (at the returned number of bits) with the depth of the bucket that holds each.

    Leaves are counted once at a depth a few bits below the expected one; an ancestor's bytes are the sum of its
    leaves', so a bucket's split on one more bit needs no second look at rows.  Only leaves that are themselves
    too large go on to more bits.
    """
    found, at, left = None, min(BITS, 4 + max(0, math.ceil(math.log2(max(1, total / limit))))), rows
    while True:
        leaf = left.groupBy(F.expr(f"shiftright(h, {BITS - at})").alias("leaf")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
        up = leaf.select("leaf", "bytes", "docs", F.explode(F.sequence(F.lit(0), F.lit(at))).alias("depth")).withColumn("bucket", F.expr(f"shiftright(leaf, {at} - depth)"))
        sums = up.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = up.join(sums, ["depth", "bucket"]).groupBy("leaf").agg(F.min_by(F.struct("depth", "bucket", "shard_bytes", "shard_docs"), F.when(F.col("shard_bytes") <= limit, F.col("depth")).otherwise(2 * at + 1 - F.col("depth"))).alias("b"))
        fits = materialize(fits.withColumn("at", F.lit(at)).select("leaf", "at", "b.*"), "directory")
        done = fits if at == BITS else fits.filter(F.col("shard_bytes") <= limit)
        found = done if found is None else found.unionByName(done)
        large = fits.filter(F.col("shard_bytes") > limit)
        if at == BITS or not large.head(1):
            return found, at
        keys, was = large.select("leaf"), at
        left = left.withColumn("leaf", F.expr(f"shiftright(h, {BITS - was})")).join(bounded_broadcast(keys), "leaf", "left_semi").drop("leaf")
        at = min(BITS, at + 6)


def shards(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: (key, n_bytes, depth, shard, part, shard_bytes, shard_docs).

    shard is the bucket's first `depth` hash bits as a number; the hash is the first 60 bits of md5 of the key.
    Rows of one key share all bits; where they alone exceed the limit, `part` numbers runs of them that fit (ordered by
    text), which no further bit could part.  A document larger than the limit is alone in its part.  Null text counts
    0 bytes; null keys hash as the empty string.  Only ids, hashes and byte counts are shuffled, never texts.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64(F.col(text)).alias("tie"),
                       F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long").alias("h"))
    rows = materialize(rows, "hashes")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    directory, deepest = directory_of(rows, limit, total)
    levels = sorted(r[0] for r in directory.select("at").distinct().collect())
    out = None
    for at in levels:
        level = directory.filter(F.col("at") == at).drop("at")
        part = rows.withColumn("leaf", F.expr(f"shiftright(h, {BITS - at})")).join(bounded_broadcast(level), "leaf")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.withColumns({"leaf": F.lit(0), "depth": F.lit(0), "bucket": F.lit(0).cast("long"), "shard_bytes": F.lit(0).cast("long"), "shard_docs": F.lit(0).cast("long")})
    whole = out.filter(F.col("shard_bytes") <= limit).withColumn("part", F.lit(0).cast("long"))
    if deepest == BITS:
        run = Window.partitionBy("h").orderBy("tie", "n_bytes")
        # 2 * bytes before // limit: two neighbours' worth of a limit never meet in one part unless each fits half.
        tied = out.filter(F.col("shard_bytes") > limit).withColumn("part", F.sum("n_bytes").over(run.rowsBetween(Window.unboundedPreceding, -1)))
        tied = tied.withColumn("last", F.coalesce("part", F.lit(0)) + F.col("n_bytes")).withColumn("part", F.when(F.col("n_bytes") * 2 > limit, F.row_number().over(run) * 2 + 1).otherwise(2 * F.floor(2 * F.col("last") / F.lit(limit))).cast("long")).drop("last")
        sized = Window.partitionBy("h", "part")
        tied = tied.withColumns({"shard_bytes": F.sum("n_bytes").over(sized), "shard_docs": F.count("*").over(sized)})
        whole = whole.unionByName(tied.select(whole.columns))
    return whole.select(F.col("key").alias(key), "n_bytes", "depth", F.col("bucket").alias("shard"), "part", "shard_bytes", "shard_docs")


def query(spark, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle(limit: int = SHARD_BYTES) -> str:
    return f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
a AS (SELECT r.*, d.depth::INTEGER AS depth, h >> ({BITS} - d.depth)::INTEGER AS shard FROM r, (SELECT unnest(range(0, {BITS + 1})) AS depth) d),
s AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM a GROUP BY ALL),
b AS (SELECT a.*, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY a.depth) AS n FROM a JOIN s USING (depth, shard) WHERE shard_bytes <= {limit})
SELECT doc_id, n_bytes, depth, shard, 0::BIGINT AS part, shard_bytes, shard_docs FROM b WHERE n = 1
"""


ORACLE = oracle()
