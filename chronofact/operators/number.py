"""Gapless ids without a sort in one place."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, up to which one is not cut further.
ROWS_A_RANGE = 20_000


def numbered(rows: DataFrame, order: list[str], name: str, start: int, parts: int = 256) -> DataFrame:
    """``rows`` with gapless ids from ``start`` in ``order``, whose first column
    is a number.

    Rows are dealt into ranges between quantiles of that column and numbered
    within each; only the ranges' sizes, at most ``parts``, meet in one place.
    A row's range depends on its value alone, so every evaluation agrees.
    """
    seen = rows.agg(F.percentile_approx(order[0], [i / parts for i in range(1, parts)], 1000).alias("marks"), F.count("*").alias("n")).first()
    step = max(1, parts * ROWS_A_RANGE // max(seen["n"], 1))
    marks = sorted(set((seen["marks"] or [])[step - 1 :: step]))
    dealt = rows.withColumn("__range", range_of(F.col(order[0]), marks))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    out = dealt.withColumn("__nth", nth).join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")  # a row a range
    return out.withColumn(name, F.col("__nth") + F.col("__before") + start).drop("__range", "__nth", "__before")


def range_of(value: Column, marks: list[int]) -> Column:
    """How many of the sorted ``marks`` are not above ``value``, by two looks at
    some sixteen of them each."""
    groups = [marks[at : at + 16] for at in range(0, len(marks), 16)]
    if not groups:
        return F.lit(0)
    whole = lambda ms: F.array(*[F.lit(m).cast("long") for m in ms])
    upto = lambda ms: F.size(F.filter(ms, lambda m: m <= value))
    first = upto(whole([g[0] for g in groups]))
    return F.when(first == 0, 0).otherwise(16 * (first - 1) + upto(F.get(F.array(*map(whole, groups)), first - 1)))
