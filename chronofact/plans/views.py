"""The driver's tables seen as facts, entities, edges and vectors."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import quantize
from ..schema import OPEN

NATION, SUPPLIER, CUSTOMER, ORDER = 100, 1_000_000, 10_000_000, 1_000_000_000
EDGE_OF_ORDER = 2_000_000_000
DAY_MS = 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def event_facts(spark, sf_dir) -> DataFrame:
    """A fact for each event, superseded by the user's next of its type."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    at = millis(F.col("ts"))
    return e.select(
        F.col("event_id").alias("fact_id"),
        F.col("user_id").alias("entity_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("entity"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("text"),
        F.array("event_type").alias("tags"),
        F.from_json("props", "map<string,string>").alias("metadata"),
        F.lag("event_id").over(w).alias("revises"),
        at.alias("recorded_at"),
        at.alias("valid_from"),
        F.coalesce(F.lead(at).over(w), F.lit(OPEN)).alias("valid_to"),
        F.lit(False).alias("tombstone"),
    )


def document_facts(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    at = F.col("doc_id") * 3_600_000
    return d.select(
        F.col("doc_id").alias("fact_id"), F.col("source").alias("entity"), "text", F.array("lang", "source").alias("tags"),
        at.alias("recorded_at"), at.alias("valid_from"), F.lit(OPEN).alias("valid_to"), F.lit(False).alias("tombstone"),
    )


def conversation_facts(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("fact_id"), F.col("conv_id").alias("entity_id"), "text", F.array("role").alias("tags"), F.col("turn").alias("recorded_at"), F.col("turn").alias("valid_from"), F.lit(OPEN).alias("valid_to"), F.lit(False).alias("tombstone"))


def order_facts(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    at = millis(F.col("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("fact_id"), (F.col("o_custkey") + CUSTOMER).alias("entity_id"), at.alias("recorded_at"), at.alias("valid_from"), F.lit(OPEN).alias("valid_to"), F.lit(False).alias("tombstone"))


def edge_history(spark, sf_dir) -> DataFrame:
    """Places (always valid) and orders, of which finished ones end after 90 days."""
    def inside(df, src, dst):
        return df.select(src.cast("long").alias("edge_id"), src.cast("long").alias("src"), F.lit("in").alias("rel"), F.lit(0).alias("rel_ord"), dst.cast("long").alias("dst"), F.lit(0).cast("long").alias("valid_from"), F.lit(OPEN).alias("valid_to"))

    t = lambda name: read(spark, sf_dir, name)
    places = inside(t("nation"), F.col("n_nationkey") + NATION, F.col("n_regionkey"))
    places = places.unionByName(inside(t("supplier"), F.col("s_suppkey") + SUPPLIER, F.col("s_nationkey") + NATION))
    places = places.unionByName(inside(t("customer"), F.col("c_custkey") + CUSTOMER, F.col("c_nationkey") + NATION))
    at = millis(F.col("o_orderdate"))
    end = F.when(F.col("o_orderstatus") == "F", at + 90 * DAY_MS).otherwise(F.lit(OPEN))
    placed = t("orders").select((F.col("o_orderkey") + EDGE_OF_ORDER).alias("edge_id"), (F.col("o_custkey") + CUSTOMER).alias("src"), F.lit("placed").alias("rel"), F.lit(1).alias("rel_ord"), (F.col("o_orderkey") + ORDER).alias("dst"), at.alias("valid_from"), end.alias("valid_to"))
    return places.unionByName(placed).withColumns({"provenance": F.lit(None).cast("long"), "recorded_at": F.col("valid_from")})


def quantized(spark, sf_dir) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("slot"), F.col("vec_id").alias("fact_id"), "label", quantize(F.col("embedding")).alias("vector")).where("vector is not null")
