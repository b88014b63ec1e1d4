"""Fusing ranked sources, recency, and selection under a budget."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BM25, BUDGET_DEFAULT, GRAPH, K_DEFAULT, OPEN, TIME, VEC

DAY_MS = 86_400_000
#: The order in which sources are summed.
ORDER = (BM25, VEC, GRAPH, TIME)


def rrf(sources: dict[int, DataFrame], weights: dict[int, float], rrf_k: float = 60.0) -> DataFrame:
    """(query_id, fact_id, score, sources): sums of weight / (rrf_k + rank).

    Each source is (query_id, fact_id, rank), ranks from 1.  Terms are added in
    one order whatever order rows come in.
    """
    parts = [s.select("query_id", "fact_id", F.lit(ORDER.index(bit)).alias("at"), F.lit(bit).alias("bit"), (F.lit(weights[bit]) / (F.lit(rrf_k) + F.col("rank"))).alias("part")) for bit, s in sources.items()]
    summed = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "part"))), F.lit(0.0), lambda a, x: a + x["part"])
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "fact_id").agg(summed.alias("score"), F.bit_or("bit").alias("sources"))


def recency(score: Column, now: Column, recorded_at: Column, weight: float = 0.25, half_life_days: float = 180.0) -> Column:
    """The score raised by up to ``weight``, half of it gone each half-life."""
    age = F.greatest(now - recorded_at, F.lit(0))
    return score * (1 + weight * F.pow(F.lit(2.0), -age / (half_life_days * DAY_MS)))


def token_cost(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4) + 8


def select_within(ranked: DataFrame, k: int = K_DEFAULT, budget: int = BUDGET_DEFAULT) -> DataFrame:
    """The leading facts of each query, up to k and up to the first that passes
    the budget, with ``rank``, ``spent`` and whether the query was ``truncated``.

    Costs are positive, so spending rises and the kept rows are a prefix.
    """
    q = Window.partitionBy("query_id")
    order = q.orderBy(F.desc("score"), "fact_id")
    rows = ranked.withColumns({"rank": F.row_number().over(order), "spent": F.sum(token_cost(F.col("text"))).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    fits = (F.col("rank") <= k) & (F.col("spent") <= budget)
    return rows.withColumn("truncated", F.max((~fits).cast("int")).over(q) == 1).where(fits)


def month(ms: Column) -> Column:
    """YYYY-MM in UTC, whatever the session's time zone."""
    days = F.floor(ms / DAY_MS).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def fact_line() -> Column:
    """A fact as a line of the rendered block: columns fact_id, entity, text,
    tags, valid_from, valid_to."""
    closed = F.col("valid_to") != OPEN
    span = F.when(closed, F.concat(month(F.col("valid_from")), F.lit(" → "), month(F.col("valid_to")), F.lit("; closed"))).otherwise(F.concat(month(F.col("valid_from")), F.lit("; active")))
    entity = F.when(F.col("entity").isNotNull(), F.concat("entity", F.lit(": "))).otherwise("")
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit(" #"), t)), "")
    return F.concat(F.lit("- [f"), F.col("fact_id").cast("string"), F.lit("] "), entity, "text", F.lit(" ("), span, F.lit(")"), tags)
