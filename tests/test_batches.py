"""Pages go to Python in small batches, and are parsed once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from sievestone.functions import html as H
from sievestone.plans import crawl
from sievestone.plans.catalog import QUERIES
from sievestone.session import ROWS, materialize

PAGES = [(1, "http://e.com/a", "<body><h1>A</h1><p>one <a href='/b'>b</a></p></body>"), (2, None, "<p>x</p>"), (3, "http://e.com/c", None), (4, "http://e.com/d", ""), (5, "http://e.com/é", "<ul><li>é<li>😀</ul>")]


def test_batches_are_bounded(spark):
    @F.arrow_udf("int")
    def rows(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int32())

    before = spark.conf.get(ROWS)
    got = materialize(spark.range(0, 40, 1, 1).select(rows("id").alias("n")), 7)
    assert sorted({r["n"] for r in got.collect()}) == [5, 7] and spark.conf.get(ROWS) == before


def test_page_queries(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["page_markdown"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(i, H.page_markdown(u, h)) for i, u, h in PAGES}
    links = crawl.outlinks(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    assert [tuple(r) for r in links.collect()] == [("http://e.com/a", "http://e.com/b", 0)]
    others = [QUERIES[q](spark, str(tmp_path)) for q in ("html_extract", "main_text", "classify_pages")]
    for df in (got, links, *others):  # what they read is a table: the parse was under the limit, and is not repeated
        assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    assert [df.count() for df in others] == [5, 5, 5]
