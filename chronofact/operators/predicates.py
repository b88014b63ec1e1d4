"""Row predicates that every source of recall shares."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import OPEN


def admit(as_of: int | Column, include_closed: bool = False) -> Column:
    """Known and true at ``as_of`` on both clocks, and not forgotten;
    ``include_closed`` drops the end of validity alone."""
    t = F.lit(as_of) if not isinstance(as_of, Column) else as_of
    p = ~F.col("tombstone") & (F.col("recorded_at") <= t) & (F.col("valid_from") <= t)
    return p if include_closed else p & (F.col("valid_to") > t)


def current() -> Column:
    """Neither forgotten nor closed."""
    return ~F.col("tombstone") & (F.col("valid_to") == OPEN)


def has_tags(wanted: list[str]) -> Column:
    """All of ``wanted``, each exact; none wanted is true."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), "tags")) == 0 if wanted else F.lit(True)


def recorded_in(start: int, end: int) -> Column:
    return (F.col("recorded_at") >= start) & (F.col("recorded_at") < end)


def with_all(lists: DataFrame, keys: list) -> DataFrame:
    """(fact_id) in the lists of every key of (key, fact_id); no keys give none."""
    want = sorted(set(keys))
    if not want:
        return lists.select("fact_id").where(F.lit(False))
    return lists.where(F.col("key").isin(want)).groupBy("fact_id").agg(F.countDistinct("key").alias("n")).where(F.col("n") == len(want)).select("fact_id")
