"""Retrieval quality, latency and feedback figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_quality(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall, precision, f1, reciprocal_rank, dcg and ndcg at k. ranked: query_id, id, rank; judged: query_id, id, relevance (over 0 is relevant)."""
    cut = ranked.filter(F.col("rank") <= k)
    good = judged.filter("relevance > 0")
    gain = lambda rank, rel: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    hits = cut.join(good, ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(gain(F.col("rank"), F.col("relevance"))).alias("dcg"))
    ideal = good.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")))
    best = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") <= k, gain(F.col("r"), F.col("relevance")))).alias("idcg"))
    sizes = cut.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"))
    x = best.join(sizes, "query_id", "left").join(hits, "query_id", "left").na.fill(0, ["hits", "returned", "dcg"])
    recall, precision = F.col("hits") / F.col("relevant"), F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(0.0)
    return x.select(
        "query_id", recall.alias("recall"), precision.alias("precision"),
        F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0).alias("f1"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), "dcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
    )


def compare(now: DataFrame, baseline: DataFrame, slack: float = 0.05) -> DataFrame:
    """metric, now, baseline, verdict: regression, improvement or unchanged. Both: metric, value."""
    d = F.col("now") - F.col("baseline")
    x = now.select("metric", F.col("value").alias("now")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
    return x.withColumn("verdict", F.when(d < -slack, "regression").when(d > slack, "improvement").otherwise("unchanged"))


def nearest_rank(values: Column, share: float) -> Column:
    """Nearest-rank percentile of a group, by the exact discrete percentile."""
    return F.expr(f"percentile_disc({share}) within group (order by {values})") if isinstance(values, str) else F.element_at(F.array_sort(F.collect_list(values)), F.ceil(F.count(values) * share).cast("int"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, least, greatest, mean, and p50, p95, p99 with linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"), p.alias("p")).select(by, "n", "least", "greatest", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"))


def recall_stats(events: DataFrame) -> DataFrame:
    """Per memory: total, used, use rate, mean rank where used and where ignored."""
    used = F.col("was_used")
    return events.groupBy("memory_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum(used.cast("long")).alias("used"), F.avg(used.cast("double")).alias("use_rate"),
        F.avg(F.when(used, F.col("rank_position"))).alias("rank_used"), F.avg(F.when(~used, F.col("rank_position"))).alias("rank_ignored"),
    )


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input, output, cache_read, cache_write tokens) with its cost by prices per million tokens of the four classes."""
    kinds = ("input", "output", "cache_read", "cache_write")
    p = prices.select("model", *[F.col(k).alias(f"price_{k}") for k in kinds])
    return usage.join(F.broadcast(p), "model", "left").withColumn("cost", sum((F.col(k) * F.coalesce(f"price_{k}", F.lit(0.0)) for k in kinds), F.lit(0.0)) / 1e6).drop(*[f"price_{k}" for k in kinds])
