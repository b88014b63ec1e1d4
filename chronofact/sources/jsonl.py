"""JSON lines in and out: facts, then edges, told apart by ``kind``."""

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid
from ..operators.predicates import current
from ..operators.temporal import edges_current


def fact_lines(facts: DataFrame) -> DataFrame:
    """(id, line) of facts that have ``entity`` names; metadata by rising key."""
    pairs = F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))))
    shown = F.struct(
        F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), "text", "entity", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.map_from_entries(pairs).alias("metadata"), "recorded_at", "valid_from",
    )
    return facts.select(F.col("fact_id").alias("id"), F.to_json(shown).alias("line"))


def edge_lines(history: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, line) of current edges, ends by name; edges without an end are left out."""
    name = lambda side: entities.select(F.col("entity_id").alias(side), F.col("name").alias(f"{side}_name"))
    named = edges_current(history).join(name("src"), "src").join(name("dst"), "dst")
    shown = F.struct(F.lit("edge").alias("kind"), F.col("src_name").alias("src"), "rel", F.col("dst_name").alias("dst"), "provenance")
    return named.select(F.col("edge_id").alias("id"), F.to_json(shown).alias("line"))


def export(facts: DataFrame, history: DataFrame, entities: DataFrame, path: str) -> None:
    """Current facts by id, then current edges, as text files in order."""
    lines = fact_lines(facts.where(current())).withColumn("part", F.lit(0)).unionByName(edge_lines(history, entities).withColumn("part", F.lit(1)))
    lines.orderBy("part", "id").select("line").write.text(path)


def parse(lines: Iterable[str]):
    """Yield ("fact" or "edge", dict) of each line; blank lines are passed over
    and a line without ``kind`` is a fact."""
    for n, line in enumerate(lines, 1):
        if not line.strip():
            continue
        try:
            d = json.loads(line)
        except ValueError as e:
            raise Invalid(f"line {n}: {e}") from e
        kind = d.get("kind", "fact") if isinstance(d, dict) else None
        if kind not in ("fact", "edge"):
            raise Invalid(f"line {n}: unknown kind {kind!r}")
        yield kind, d
