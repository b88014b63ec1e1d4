"""The tag catalogue: counts over current facts, read page by page."""

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid, StaleCursor, TooLarge
from ..schema import OPEN, TAG_PAGE, TAG_PAGE_MAX
from .number import numbered
from .predicates import current


def catalogue(facts: DataFrame) -> DataFrame:
    """(tag, count) over current facts."""
    return facts.where(current()).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def with_prefix(tags: DataFrame, prefix: str) -> DataFrame:
    """Tags that begin with ``prefix``, byte for byte."""
    return tags.where(F.startswith("tag", F.lit(prefix))) if prefix else tags


def page(tags: DataFrame, prefix: str = "", after: str | None = None, limit: int = TAG_PAGE) -> DataFrame:
    """The next ``limit`` tags by bytes."""
    rows = with_prefix(tags, prefix)
    if after is not None:
        rows = rows.where(F.col("tag") > after)
    return rows.orderBy("tag").limit(limit)


def fingerprint(tags: DataFrame) -> int:
    """A number that changes with any count, whatever the order of rows."""
    row = tags.agg(F.coalesce(F.bit_xor(F.xxhash64("tag", "count")), F.lit(0)).alias("x"), F.count("*").alias("n")).first()
    return (row["x"] ^ (row["n"] * 0x9E3779B97F4A7C15)) & ((1 << 64) - 1)


def list_tags(tags: DataFrame, prefix: str = "", cursor: str | None = None, limit: int = 0, store: str = "") -> dict:
    """``{"items": [(tag, count)], "next_cursor": str | None}``.

    A cursor is good for one store, prefix and state of the catalogue.
    """
    if limit > TAG_PAGE_MAX:
        raise TooLarge("tag page", limit, TAG_PAGE_MAX)
    limit = limit or TAG_PAGE
    mark, after = fingerprint(tags), None
    if cursor is not None:
        try:
            c = json.loads(base64.urlsafe_b64decode(cursor.encode()))
            own, after = (c["store"], c["prefix"]), c["after"]
            seen = c["mark"]
        except (ValueError, KeyError, TypeError) as e:
            raise Invalid("not a tag cursor") from e
        if own != (store, prefix):
            raise Invalid("a cursor of another store or prefix")
        if seen != mark:
            raise StaleCursor("the tags have changed since this cursor was made")
    rows = page(tags, prefix, after, limit + 1).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    at = json.dumps({"store": store, "prefix": prefix, "after": rows[-1]["tag"], "mark": mark}) if more else None
    return {"items": [(r["tag"], r["count"]) for r in rows], "next_cursor": base64.urlsafe_b64encode(at.encode()).decode() if at else None}


def remove_tag(facts: DataFrame, tag: str, now: int, next_fact: int) -> DataFrame:
    """Every current fact with ``tag`` closed at ``now`` and made anew without it,
    new ids in the order of the old ones, numbered range by range."""
    hit = facts.where(current() & F.array_contains("tags", tag))
    new = numbered(hit, ["fact_id"], "new_id", next_fact)
    made = new.select(*[
        F.col("new_id").alias("fact_id") if c == "fact_id"
        else F.col("fact_id").alias("revises") if c == "revises"
        else F.lit(now).cast("long").alias(c) if c in ("recorded_at", "valid_from")
        else F.lit(OPEN).alias("valid_to") if c == "valid_to"
        else F.array_remove("tags", tag).alias("tags") if c == "tags"
        else F.col(c)
        for c in facts.columns
    ])
    closed = hit.withColumn("valid_to", F.lit(now).cast("long"))
    return closed.unionByName(made)
