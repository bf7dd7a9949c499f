"""Queries on ranges: what holds at each of many moments, spans on spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import chunking, intervals
from fathom.plans import data
from fathom.plans.catalogue import query


@query(
    "under_way",
    "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM d JOIN (lineitem JOIN orders ON l_orderkey = o_orderkey) ON CAST(o_orderdate AS DATE) <= day AND day < CAST(l_shipdate AS DATE) GROUP BY day",
)
def under_way(spark, d):
    """Lines ordered and not yet shipped on each day of an order: links with a beginning and an end, at every moment of a table."""
    days = data.table(spark, d, "orders").select(F.unix_date(F.col("o_orderdate").cast("date")).alias("t")).distinct()
    orders = data.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.unix_date(F.col("o_orderdate").cast("date")).alias("a"))
    rows = data.table(spark, d, "lineitem").join(orders, "l_orderkey").select("a", F.unix_date(F.col("l_shipdate").cast("date")).alias("b"), "l_linenumber")
    found = intervals.points_in(days, rows, "t", "a", "b")
    return found.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines")).select(F.date_from_unix_date("t").cast("string").alias("day"), "n", "lines")


_SPANS = """x AS (SELECT doc_id, text, length(text) AS size FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM x),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS n FROM w),
t AS (SELECT doc_id, n, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(word) - 1 AS a, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS b FROM p),
c AS (SELECT doc_id, unnest(range(0, size, 450)) AS lo, size FROM x)"""


@query(
    "tokens_on_chunks",
    f"WITH {_SPANS} SELECT c.doc_id, CAST(lo AS BIGINT) AS chunk, count(*) AS n_tokens, CAST(min(n) AS BIGINT) AS first_token, CAST(max(n) AS BIGINT) AS last_token FROM c JOIN t ON t.doc_id = c.doc_id AND a < least(lo + 500, size) AND lo < b WHERE a < b GROUP BY ALL",
)
def tokens_on_chunks(spark, d):
    """Words on chunks of 500 characters that overlap by 50, by their characters."""
    tokens = chunking.word_spans(data.table(spark, d, "documents"))
    found = tokens.select("doc_id", "n", F.explode(intervals.on_grid(F.col("a"), F.col("b"), F.col("size"), 450, 500)).alias("chunk"))
    return found.groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n_tokens"), F.min("n").alias("first_token"), F.max("n").alias("last_token"))
