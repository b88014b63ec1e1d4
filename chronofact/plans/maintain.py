"""Upkeep as whole-table rewrites, and checks as queries for violations."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.predicates import current
from ..operators.tags import catalogue
from ..schema import OPEN


def purge(facts: DataFrame) -> DataFrame:
    """Facts without the forgotten; ids are not used again."""
    return facts.where(~F.col("tombstone"))


def compact_postings(postings: DataFrame, facts: DataFrame) -> DataFrame:
    """Postings of facts that are still stored, without reading a text."""
    return postings.join(purge(facts).select("fact_id"), "fact_id", "left_semi")


def counters(facts: DataFrame) -> DataFrame:
    """One row of counts in one pass."""
    return facts.agg(
        F.count("*").alias("facts"),
        F.count_if(current()).alias("current"),
        F.count_if("tombstone").alias("tombstones"),
        F.countDistinct("entity_id").alias("entities"),
        (F.max("fact_id") + 1).alias("next_fact"),
    )


def violations(facts: DataFrame, entities: DataFrame, edges: DataFrame, tags: DataFrame) -> DataFrame:
    """(problem, rows): how many rows break each invariant."""

    def counted(problem, rows):
        return rows.agg(F.count("*").alias("rows")).select(F.lit(problem).alias("problem"), "rows")

    known = entities.select("entity_id").distinct()
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("entity_id"))
    again = catalogue(facts)
    found = [
        counted("dangling edge", ends.join(known, "entity_id", "left_anti").select("edge_id").distinct()),
        counted("open edge twice", edges.where(F.col("valid_to") == OPEN).groupBy("src", "rel", "dst").count().where("count > 1")),
        counted("catalogue", again.exceptAll(tags.select(*again.columns)).unionByName(tags.select(*again.columns).exceptAll(again))),
        counted("interval", facts.where("valid_to < valid_from")),
        counted("id twice", facts.groupBy("fact_id").count().where("count > 1")),
    ]
    return reduce(DataFrame.unionByName, found)


def faulty(facts: DataFrame, dim: int = 0) -> DataFrame:
    """(fact_id, fault): text that is not UTF-8, a vector of the wrong length or
    with a scale that is no number, metadata with a null key or value."""
    v = F.col("vector")
    bad_vector = v.isNotNull() & ((F.size(v["q"]) != dim) | ~(v["scale"] > 0) | F.isnan(v["scale"]))
    bad_meta = F.coalesce(F.exists(F.map_values("metadata"), lambda x: x.isNull()), F.lit(False))
    fault = F.when(~F.coalesce(F.is_valid_utf8("text"), F.lit(False)), "text").when(bad_vector, "vector").when(bad_meta, "metadata")
    return facts.select("fact_id", fault.alias("fault")).where("fault is not null")
