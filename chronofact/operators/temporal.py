"""The recorded-time source and views of facts and edges at an instant."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OPEN, SOURCE_CAP
from .predicates import admit, recorded_in

#: How time is cut for joins: the length of a span, the spans that an interval is
#: filed under before it counts as long, and the spans of the longest range.
SPAN_MS, MOST_SPANS, RANGE_SPANS = 86_400_000, 32, 64


def range_topk(facts: DataFrame, start: int, end: int, admitted: Column, k: int = SOURCE_CAP) -> DataFrame:
    """The k latest facts recorded in [start, end), ties to the larger id."""
    return facts.where(recorded_in(start, end) & admitted).orderBy(F.desc("recorded_at"), F.desc("fact_id")).limit(k).select("fact_id", "recorded_at")


def facts_as_of(facts: DataFrame, t: int, include_closed: bool = False) -> DataFrame:
    return facts.where(admit(t, include_closed))


def edges_current(history: DataFrame) -> DataFrame:
    return history.where(F.col("valid_to") == OPEN)


def edges_as_of(history: DataFrame, t: int) -> DataFrame:
    return history.where((F.col("valid_from") <= t) & (F.col("valid_to") > t))


def as_of_join(facts: DataFrame, probes: DataFrame, key: str = "entity_id", at: str = "t", width: int = SPAN_MS) -> DataFrame:
    """``probes`` with the facts of their entity that were live at their own
    instant.

    Life is an interval, from the later of a fact's two beginnings to its end.
    Intervals of up to ``MOST_SPANS`` spans of ``width`` are filed under each
    span that they touch and meet only probes of that span; longer ones, and
    those that are still open, meet the probes of their entity after their
    beginning.  A busy entity's rows thus spread over its spans, and pairs that
    are formed in vain are at most those of one span, or of facts that had ended
    many spans before.
    """
    span = lambda t: F.floor(t / width)
    own = facts.where(~F.col("tombstone")).select(key, "fact_id", F.greatest("recorded_at", "valid_from").alias("__from"), F.col("valid_to").alias("__to"))
    own = own.where(F.col("__from") < F.col("__to"))
    first, last = span(F.col("__from")), span(F.col("__to") - 1)
    short = last - first < MOST_SPANS
    live = (F.col("__from") <= F.col(at)) & (F.col("__to") > F.col(at))
    filed = own.where(short).withColumn("__span", F.explode(F.sequence(first, last)))
    near = probes.withColumn("__span", span(F.col(at))).join(filed, [key, "__span"]).where(live).drop("__span")
    far = probes.join(own.where(~short), key).where(live)
    order = [key, *[c for c in probes.columns if c != key], "fact_id"]
    return near.select(*order).unionByName(far.select(*order))


def ranges_topk(facts: DataFrame, ranges: DataFrame, admitted: Column, k: int = SOURCE_CAP, spans: int = RANGE_SPANS) -> DataFrame:
    """(query_id, fact_id, rank) of the k latest facts recorded in each query's
    [from_ms, to_ms); ``ranges`` has query_id, both ends and what ``admitted``
    needs.

    Both sides are filed under spans of time, of a length that cuts the longest
    range into at most ``spans``, so the join has a key and no side is repeated
    as a whole.
    """
    r = ranges.where(F.col("from_ms") < F.col("to_ms"))
    longest = r.agg(F.max(F.col("to_ms") - F.col("from_ms"))).first()[0] or 1
    width = max(1, -(-longest // spans))
    span = lambda c: F.floor(c / width)
    bounds = facts.agg(F.min("recorded_at").alias("lo"), F.max("recorded_at").alias("hi")).first()
    if bounds["lo"] is None:
        return ranges.sparkSession.createDataFrame([], "query_id long, fact_id long, rank int")
    # Outside the facts' own time there is nothing to find.
    r = r.withColumns({"__lo": F.greatest("from_ms", F.lit(bounds["lo"])), "__hi": F.least(F.col("to_ms") - 1, F.lit(bounds["hi"]))}).where(F.col("__lo") <= F.col("__hi"))
    filed = r.withColumn("__span", F.explode(F.sequence(span(F.col("__lo")), span(F.col("__hi"))))).drop("__lo", "__hi")
    hit = facts.withColumn("__span", span(F.col("recorded_at"))).join(filed, "__span")
    hit = hit.where((F.col("recorded_at") >= F.col("from_ms")) & (F.col("recorded_at") < F.col("to_ms"))).where(admitted)
    w = Window.partitionBy("query_id").orderBy(F.desc("recorded_at"), F.desc("fact_id"))
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "fact_id", "rank")
