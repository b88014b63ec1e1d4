"""Facts of the same entity that say nearly the same."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..schema import OPEN, SIMILAR_MOST, SIMILAR_RING


def jaccard(a, b):
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def similar(facts: DataFrame, new: DataFrame, least_jaccard: float = 0.5, least_cos: float = 0.85) -> DataFrame:
    """(new_id, fact_id, score, kind) hints for rows of ``new``.

    Both are (fact_id, entity_id, tokens, vector, tombstone, valid_to); ``new``
    needs the first four, vectors null where there are none.  Only the 32
    latest facts of an entity are looked at, forgotten and closed ones among
    them, which give no hint.  Of two measures the stronger counts, the lexical
    one if they tie.
    """
    ring = Window.partitionBy("entity_id").orderBy(F.desc("fact_id"))
    old = facts.where("entity_id is not null").withColumn("at", F.row_number().over(ring)).where(F.col("at") <= SIMILAR_RING)
    old = old.where(~F.col("tombstone") & (F.col("valid_to") == OPEN)).select("entity_id", "fact_id", F.array_distinct("tokens").alias("old_terms"), F.col("vector").alias("old_vector"))
    pairs = new.select("entity_id", F.col("fact_id").alias("new_id"), F.array_distinct("tokens").alias("terms"), "vector").join(old, "entity_id").where(F.col("fact_id") != F.col("new_id"))
    both = F.col("vector").isNotNull() & F.col("old_vector").isNotNull()
    scored = pairs.select("new_id", "fact_id", jaccard(F.col("terms"), F.col("old_terms")).alias("lexical"), F.when(both, F.round(cosine(F.col("vector"), F.col("old_vector")), 10)).alias("dense"))
    over = lambda name, least: F.when(F.col(name) > least, F.col(name)).alias(name)
    scored = scored.select("new_id", "fact_id", over("lexical", least_jaccard), over("dense", least_cos)).where("lexical is not null or dense is not null")
    by_words = F.col("dense").isNull() | (F.col("lexical") >= F.col("dense"))
    scored = scored.select("new_id", "fact_id", F.greatest("lexical", "dense").alias("score"), F.when(F.coalesce(by_words, F.lit(False)), "lexical").otherwise("vector").alias("kind"))
    best = Window.partitionBy("new_id").orderBy(F.desc("score"), "fact_id")
    return scored.withColumn("at", F.row_number().over(best)).where(F.col("at") <= SIMILAR_MOST).drop("at")
