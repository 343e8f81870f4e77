"""Quality rules: text statistics for each document, then host-level verdicts from shrunken failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_broadcast, materialize

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Host-level rules: a document fails with more symbols than this part of its words, or this part of its lines repeated.
SYMBOL_RATIO, DUP_LINE_RATIO = 0.5, 0.5
#: A host is rejected where the shrunken rate of any rule's failures lies so many standard deviations of the fitted prior above
#: its mean, and the rule fails most of the host's documents; above the last rate it always is.
HOST_DEVIATIONS, HOST_LOW, HOST_RATE = 3, 0.5, 0.9
RULES = ("base_failed", "symbols_failed", "lines_failed")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The statistics of every document's whole text: (key, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words).  Null text is like an empty one.  No shuffle: repeated windows are found within the row, by
    sorting (hash of window, position) and looking at neighbours."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.col(host), t.alias("t"), F.array_remove(F.split(t, f"{SPACE}+"), "").alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    windows = "if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS p)))"
    rows = rows.select(key, host, F.size("w").cast("long").alias("n_words"), F.char_length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                       (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"), F.size("l").cast("long").alias("n_lines"),
                       (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), F.array_sort(F.expr(windows)).alias("s"))
    repeated = "filter(transform(s, (x, i) -> if((i > 0 AND s[greatest(i - 1, 0)].h = x.h) OR (i < size(s) - 1 AND s[least(i + 1, size(s) - 1)].h = x.h), x.p, -1)), p -> p >= 0)"
    rows = rows.select("*", F.sort_array(F.expr(repeated)).alias("r")).drop("s")
    covered = "if(size(r) = 0, 0, aggregate(r, struct(0 AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n))"
    return rows.select("*", F.expr(covered).cast("long").alias("n_repeat_words")).drop("r")


def _share(a: str, part: float, b: str) -> Column:
    return F.col(a) > part * F.col(b)


def host_verdicts(stats: DataFrame, host: str = "source") -> DataFrame:
    """(host_key, host_rejected): each rule's failure rate for each host, shrunk toward a beta prior that is fitted to the
    hosts' own rates by moments, so that a host of few documents is judged mostly by what hosts are like.  What rate is too
    high comes from the prior too: where hosts are alike, one that fails in most of its documents is far off; where many
    hosts fail often, only one that almost always does is."""
    hosts = stats.groupBy(F.col(host).alias("host_key")).agg(F.count("*").alias("n"), *[F.count_if(F.col(r)).alias(r) for r in RULES])
    moments = hosts.agg(*[x for r in RULES for x in (F.avg(F.col(r) / F.col("n")).alias(f"{r}_m"), F.var_pop(F.col(r) / F.col("n")).alias(f"{r}_v"))])
    rejected = F.lit(False)
    joined = hosts.crossJoin(F.broadcast(moments))  # one row of moments
    for r in RULES:
        m, v = F.col(f"{r}_m"), F.col(f"{r}_v")
        weight = F.when((v > 0) & (m > 0) & (m < 1), F.greatest(m * (1 - m) / v - 1, F.lit(1.0))).otherwise(F.lit(1.0))
        bound = F.least(F.lit(HOST_RATE), F.greatest(F.lit(HOST_LOW), m + HOST_DEVIATIONS * F.sqrt(m * (1 - m) / (weight + 1))))
        rejected = rejected | ((F.col(r) + m * weight) / (F.col("n") + weight) > bound)
    return joined.select("host_key", F.coalesce(rejected, F.lit(False)).alias("host_rejected"))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row for each document: its statistics, base_failed, host_rejected and kept.

    base_failed: fewer than 50 words, or over half of the words in 3-word windows that the text has twice or more.
    kept: not base_failed, and the host's shrunken failure rates pass.  Statistics are written once and read for
    both the host aggregate and the join back.  A null host is a host of its own; null or empty text fails by its
    length; repeated rows each get a row.  Counting by host is pre-aggregated before its shuffle, and the join with
    the few verdict rows broadcasts them only if counted as few, so a host with a third of all rows makes no hot task.
    """
    stats = measured(docs, key, text, host)
    stats = stats.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbols_failed": _share("n_symbols", SYMBOL_RATIO, "n_words"),
        "lines_failed": _share("n_dup_lines", DUP_LINE_RATIO, "n_lines"),
    })
    stats = materialize(stats, "quality")
    verdicts = bounded_broadcast(host_verdicts(stats, host))
    out = stats.join(verdicts, F.col(host).eqNullSafe(F.col("host_key")), "left")
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.  Statistics go by row, so a text is read once for the rules and once to be kept.

    A verdict goes back to the rows of its doc_id, text (by hash) and source, nulls included: of several rows of one id
    those stay that the rules keep, and rows without an id stay like others.  Repeated rows all stay or all go."""
    # Equality of structs takes null fields as equal.
    rows = docs.withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("th"), "source"))
    verdict = quality(rows.select("_row", "text", "source"), "_row").filter("kept").select("_row").distinct()
    return rows.join(verdict, "_row", "left_semi").drop("_row")


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 3)) AS k) GROUP BY doc_id),
s AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols > 0.5 * n_words AS symbols_failed, n_dup_lines > 0.5 * n_lines AS lines_failed FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS b, count(*) FILTER (symbols_failed) AS y, count(*) FILTER (lines_failed) AS l FROM f GROUP BY source),
u AS (SELECT source, unnest([b, y, l]) AS k, unnest([1, 2, 3]) AS rule, n FROM h),
m AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM u GROUP BY rule),
p AS (SELECT rule, m, CASE WHEN v > 0 AND m > 0 AND m < 1 THEN greatest(m * (1 - m) / v - 1, 1) ELSE 1 END AS weight FROM m),
v AS (SELECT source, bool_or((k + m * weight) / (n + weight) > least(0.9, greatest(0.5, m + 3 * sqrt(m * (1 - m) / (weight + 1))))) AS host_rejected FROM u JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, NOT base_failed AND NOT host_rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
