"""Places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: monotonically_increasing_id() has the partition above these bits and the row within it below.
ROW_BITS = 33


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `pos`, each row's place in ascending order of the columns `order` (nulls first, strings by bytes), and
    `part`, the sorted piece that holds it.  Rows are ranged by all of `order`, sorted and written with their place in
    the piece; the pieces' counts, one number for each, give where a piece begins.  Rows that are equal in all of
    `order` stay in one piece, so `order` should end in something that tells rows apart.  df is read twice (ranges are
    taken from a sample), so it should be a table."""
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("part", F.expr(f"shiftright(_m, {ROW_BITS})"))
    counts = sorted(map(tuple, placed.groupBy("part").count().collect()))  # one row for each piece
    begins, total = [], 0
    for part, n in counts:
        begins.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(begins, "part long, begin long")
    return placed.join(F.broadcast(offsets), "part").withColumn("pos", F.expr(f"begin + (_m & {(1 << ROW_BITS) - 1})")).drop("_m", "begin")
