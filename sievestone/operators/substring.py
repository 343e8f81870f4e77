"""Which rows contain which strings: an equi-join on each string's rarest part, with the whole string as proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_side

#: Characters of a part, and strings whose parts may be broadcast (some 100 bytes each).
PART, BROADCAST_NEEDLES = 6, 200_000


def _parts(text: Column, size: Column | int) -> Column:
    """All parts of a text with `size` characters; none of a shorter text."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size) if isinstance(size, int) else size))).otherwise(F.array().cast("array<string>"))


def containing(rows: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(needle, hits): for every distinct string of needles, how many rows have it anywhere in their text, without regard to case.

    Each string is known by the part of PART characters (all of it, if it is shorter) that the fewest other strings have.  A row's
    distinct parts are joined with those: a string can only be where its part is, and of the few candidates `contains`
    tells which are.  Rows are read once, whatever the number of strings, and no row is paired with all of them.

    A null string has no hits, the empty one is in every text that isn't null; null texts contain nothing.
    """
    given = materialize(needles.select(F.col(needle).alias("needle"), F.lower(needle).alias("low")).distinct())
    lows = given.filter("low <> ''").select("low").distinct()
    held = lows.select("low", F.explode(F.array_distinct(_parts(F.col("low"), F.least(F.length("low"), F.lit(PART))))).alias("part"))
    shared = held.groupBy("part").agg(F.count("*").alias("n"))
    known = materialize(held.join(shared, "part").groupBy("low").agg(F.min(F.struct("n", "part")).alias("p")).select("low", F.col("p.part").alias("part")))
    sizes = sorted(r[0] for r in known.select(F.length("part")).distinct().collect())  # at most PART numbers
    texts = rows.filter(F.col(text).isNotNull()).select(F.lower(text).alias("t"))
    found = texts.select("t", F.explode(F.array_distinct(F.concat(*[_parts(F.col("t"), s) for s in sizes]))).alias("part")) if sizes else None
    hits = texts.agg(F.lit("").alias("low"), F.count("*").alias("hits"))
    if found is not None:
        sure = found.join(small_side(known, BROADCAST_NEEDLES), "part").filter(F.col("t").contains(F.col("low")))
        hits = hits.unionByName(sure.groupBy("low").agg(F.count("*").alias("hits")))
    return given.join(hits, "low", "left").select(F.col("needle").alias(needle), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
