"""URL filters: host-suffix x path-prefix expressions, an equi-join on short hash prefixes, then full digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_broadcast, lower_ascii

#: (verdict, host, path) of the production rule list.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """Host after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or no '://'."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; '' for null or no '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, key: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge each row's url: (key, host, path, rule, verdict), one row for each input row.

    A rule (verdict, host, path) fits its host and every subdomain of it, where the url's path starts with the rule's.
    The longest rule string wins; of equal strings, block wins.  Each url makes one expression for each host suffix
    and each path prefix of a length that some rule has, so a string prefix is found by equality.  The join is on the
    first 4 bytes of SHA-256 alone; the full digest is compared after it.  Urls are deduplicated to distinct
    (host, path) first, so a host with a third of all rows costs one look-up for each of its paths.

    Null or malformed urls: host and path '', no rule, the default verdict.  Suffixes with more labels than any
    rule's host and lengths no rule has are not made: no rule could equal them.  Rules of unbounded number are counted
    before a broadcast and joined by shuffle beyond the bound.  Empty rules or pages give no matches or no rows.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    rules = rules.toDF("verdict", "rule_host", "rule_path").select("verdict", "rule_host", "rule_path", F.concat("rule_host", "rule_path").alias("rule"))
    rules = rules.groupBy("rule_host", "rule_path", "rule").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    rules = rules.withColumn("digest", F.sha2(_joined("rule_host", "rule_path"), 256)).withColumn("prefix", F.substring("digest", 1, 8))
    shape = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    labels, lengths = shape["labels"] or 0, sorted(shape["lengths"] or [])

    split = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not lengths:
        return split.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.struct(F.substring("path", 1, n).alias("p"))) for n in lengths]), lambda p: p.isNotNull())
    distinct = split.select("host", "path").distinct()
    made = distinct.select("host", "path", F.explode(suffixes).alias("s")).select("host", "path", "s", F.explode(prefixes).alias("p"))
    made = made.select("host", "path", F.sha2(_joined("s", "p.p"), 256).alias("made_digest")).withColumn("prefix", F.substring("made_digest", 1, 8))
    hits = made.join(bounded_broadcast(rules), "prefix").filter("made_digest = digest")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("best"))
    # Keys of the join back are (host, path): a hot path is spread by AQE's skew split, since the right side has one row each.
    return split.join(best, ["host", "path"], "left").select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _joined(host: str, path: str) -> Column:
    return F.concat(F.col(host), F.lit("\n"), F.col(path))


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


ORACLE = """
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hit AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN hit ON hit.page_id = parts.page_id AND n = 1
"""
