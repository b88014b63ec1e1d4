"""Write verbs over whole tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokenizer import tokens_udf
from ..operators.number import numbered
from ..schema import OPEN


def entity_upsert(names: DataFrame, tokenizer=None, known: DataFrame | None = None, next_entity: int = 0) -> DataFrame:
    """(entity_id, norm_name, name, first_at) of the entities that ``names``
    (name, ordinal) brings in: the first spelling of each key, numbered in the
    order of first mention.  ``known`` (norm_name) are left out, as are names
    without a token.  A column norm_name in ``names`` is taken as their key."""
    key = F.col("norm_name") if "norm_name" in names.columns else F.array_join((tokenizer or tokens_udf())(F.col("name")), " ")
    new = names.select("name", "ordinal", key.alias("norm_name")).where("norm_name <> ''")
    new = new.groupBy("norm_name").agg(F.min_by("name", "ordinal").alias("name"), F.min("ordinal").alias("first_at"))
    if known is not None:
        new = new.join(known.select("norm_name"), "norm_name", "left_anti")
    return numbered(new, ["first_at", "norm_name"], "entity_id", next_entity)


def replay_links(ops: DataFrame) -> DataFrame:
    """Edge versions from (op, src, rel, dst, provenance, now, seq) rows.

    A link opens a version; one with the same provenance while it is open
    changes nothing, one with another closes it and opens the next; unlink
    closes it, never before it began.  Each (src, rel, dst) is folded alone by
    windows over its own operations.
    """
    w = Window.partitionBy("src", "rel", "dst").orderBy("seq")
    prior = ops.withColumns({"was": F.lag("op").over(w), "was_of": F.lag("provenance").over(w)})
    same = (F.col("op") == "link") & (F.col("was") == "link") & F.col("provenance").eqNullSafe(F.col("was_of"))
    idle = (F.col("op") == "unlink") & F.coalesce(F.col("was") == "unlink", F.lit(True))
    step = prior.where(~same & ~idle).withColumn("next", F.lead("now").over(w))
    end = F.when(F.col("next").isNull(), F.lit(OPEN)).otherwise(F.greatest("next", "now"))
    return step.where("op = 'link'").select("src", "rel", "dst", "provenance", F.col("now").alias("recorded_at"), F.col("now").alias("valid_from"), end.alias("valid_to"), "seq")


def close_revised(facts: DataFrame, revisions: DataFrame) -> DataFrame:
    """``facts`` with the targets of (target, valid_from) closed at that time."""
    ends = revisions.select(F.col("target").alias("fact_id"), F.col("valid_from").alias("__end"))
    return facts.join(ends, "fact_id", "left").withColumn("valid_to", F.coalesce("__end", "valid_to")).drop("__end").select(*facts.columns)


def forget(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """``facts`` with those of ``ids`` (fact_id) marked as forgotten."""
    marks = ids.select("fact_id", F.lit(True).alias("__gone")).distinct()
    return facts.join(marks, "fact_id", "left").withColumn("tombstone", F.col("tombstone") | F.coalesce("__gone", F.lit(False))).select(*facts.columns)
