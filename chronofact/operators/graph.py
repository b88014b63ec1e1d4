"""Bounded walks over a typed graph, and the facts they reach.

A walk is a loop over depths on the driver.  The frontier is at most 64
entities by the walk's own cap, so each depth is one join with a broadcast of
at most 64 ids, and what comes back is at most a few thousand rows: for each
frontier entity only the edges that the caps could still let in.  The caps are
then applied in order on the driver.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import GRAPH_EDGE_CAP, GRAPH_ENTITY_CAP, GRAPH_EXAMINE_CAP, GRAPH_FACT_CAP, OPEN, SOURCE_CAP


@dataclass
class Walk:
    """Visited (entity_id, weight) in order, and collected edges."""

    entities: list[tuple[int, float]] = field(default_factory=list)
    edges: list[tuple[int, str, int, int | None]] = field(default_factory=list)


def neighbours(history: DataFrame, ids: list[int], as_of: int | None = None) -> DataFrame:
    """(at, ord, src, rel, dst, provenance, other): edges of the entities ``ids``
    in the order in which a walk takes them.

    Without ``as_of`` current edges, outgoing before incoming, by relation and
    the other end; with it the edges valid then, the newest first.
    """
    spark = history.sparkSession
    frontier = F.broadcast(spark.createDataFrame([(i,) for i in ids], "at long"))  # at most the entity cap
    live = history.where(F.col("valid_to") == OPEN) if as_of is None else history.where((F.col("valid_from") <= as_of) & (F.col("valid_to") > as_of))
    out = live.join(frontier, F.col("src") == F.col("at")).withColumns({"side": F.lit(0), "other": F.col("dst")})
    back = live.join(frontier, F.col("dst") == F.col("at")).withColumns({"side": F.lit(1), "other": F.col("src")})
    return leading(out.unionByName(back), as_of)


def leading(rows: DataFrame, as_of: int | None) -> DataFrame:
    """Of the edges at each entity (``at``, ``other``, ``side``) those that the
    caps could let in, with their place ``ord`` in its order.

    A walk may hold 128 edges already and take as many more, so the first 256
    matter; beyond them only an entity's first edge to a neighbour does, and of
    those the first 128.  Both are the least by a key, which tasks keep for
    themselves before anything is shuffled, so a hub's edges never meet.
    """
    key = F.struct("side", "rel_ord", "other", "edge_id") if as_of is None else F.struct("side", (-F.col("valid_from")).alias("a"), (-F.col("edge_id")).alias("b"))
    rows = rows.withColumn("key", key).select("at", "key", "src", "rel", "dst", "provenance", "other")
    least = lambda df, n: df.withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy("key"))).where(F.col("nth") <= n).drop("nth")
    rest = [c for c in rows.columns if c not in ("at", "other")]
    each = rows.groupBy("at", "other").agg(F.min_by(F.struct(*rest), "key").alias("x")).select("at", "other", "x.*").select(*rows.columns)
    # An edge may be in both: the key tells rows apart.
    both = least(rows, 2 * GRAPH_EDGE_CAP).unionByName(least(each, 2 * GRAPH_ENTITY_CAP)).dropDuplicates(["at", "key"])
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("at").orderBy("key"))).drop("key")


def walk(history: DataFrame, anchors: list[int], depth: int = 2, decay: float = 0.5, as_of: int | None = None) -> Walk:
    """Breadth first from ``anchors`` for ``depth`` rounds, at most 64 entities
    and 128 edges; an entity first met at depth d weighs decay**d."""
    out = Walk([(a, 1.0) for a in dict.fromkeys(anchors)][:GRAPH_ENTITY_CAP])
    seen, known = {a for a, _ in out.entities}, set()
    frontier = [a for a, _ in out.entities]
    for d in range(1, depth + 1):
        if not frontier:
            break
        rows = neighbours(history, frontier, as_of).collect()
        by: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r["ord"]):
            by.setdefault(r["at"], []).append(r)
        reached = []
        for at in frontier:
            for r in by.get(at, ()):
                edge = (r["src"], r["rel"], r["dst"], r["provenance"])
                if edge not in known and len(out.edges) < GRAPH_EDGE_CAP:
                    known.add(edge)
                    out.edges.append(edge)
                if r["other"] not in seen and len(out.entities) < GRAPH_ENTITY_CAP:
                    seen.add(r["other"])
                    out.entities.append((r["other"], decay**d))
                    reached.append(r["other"])
            if len(out.edges) >= GRAPH_EDGE_CAP and len(out.entities) >= GRAPH_ENTITY_CAP:
                return out
        frontier = reached
    return out


def candidates(facts: DataFrame, found: Walk, admitted: Column, decay: float = 0.5, k: int = SOURCE_CAP) -> DataFrame:
    """(fact_id, weight) of the facts of a walk, heaviest first.

    The entities' facts are looked at in the order of the visit and of ids, at
    most 2048, and 256 taken; then the facts that vouch for edges, in the
    order of the edges, while there is room.
    """
    spark = facts.sparkSession
    visits = F.broadcast(spark.createDataFrame([(e, i, w) for i, (e, w) in enumerate(found.entities)], "entity_id long, visit int, weight double"))
    seq = Window.orderBy("visit", "fact_id")
    per = Window.partitionBy("entity_id").orderBy("fact_id")
    own = facts.join(visits, "entity_id").withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= GRAPH_EXAMINE_CAP)
    # At most 64 * 2048 rows are left for the one ordering over all entities.
    own = own.withColumn("at", F.row_number().over(seq)).where(F.col("at") <= GRAPH_EXAMINE_CAP).where(admitted)
    own = own.select("fact_id", "weight", "at").orderBy("at").limit(GRAPH_FACT_CAP)
    vouching = list(dict.fromkeys(p for *_, p in found.edges if p is not None))
    if vouching:
        v = F.broadcast(spark.createDataFrame([(p, GRAPH_EXAMINE_CAP + 1 + i) for i, p in enumerate(vouching)], "fact_id long, at int"))
        proof = facts.join(v, "fact_id").where(admitted).select("fact_id", F.lit(decay).alias("weight"), "at").join(own.select("fact_id"), "fact_id", "left_anti")
        own = own.unionByName(proof).orderBy("at").limit(GRAPH_FACT_CAP)
    return own.select("fact_id", "weight").orderBy(F.desc("weight"), "fact_id").limit(k)


def _steps(history: DataFrame, frontier: DataFrame, as_of: int | None) -> DataFrame:
    """(query_id, at, visit, ord, src, rel, dst, provenance, other) of the edges
    at each query's frontier (query_id, entity_id, visit)."""
    live = history.where(F.col("valid_to") == OPEN) if as_of is None else history.where((F.col("valid_from") <= as_of) & (F.col("valid_to") > as_of))
    ends = [("src", "dst", 0), ("dst", "src", 1)]
    out, back = (live.withColumns({"at": F.col(near), "other": F.col(far), "side": F.lit(side)}) for near, far, side in ends)
    # Each entity's edges are put in order once, whatever queries meet there.
    asked = frontier.select(F.col("entity_id").alias("at")).distinct()
    rows = leading(out.unionByName(back).join(asked, "at", "left_semi"), as_of)
    return rows.join(frontier.withColumnRenamed("entity_id", "at"), "at").select("query_id", "at", "visit", "ord", "src", "rel", "dst", "provenance", "other")


def walk_many(history: DataFrame, anchors: DataFrame, depth: int = 2, decay: float = 0.5, as_of: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``walk`` for a table of queries (query_id, entity_id, pos): frames of
    (query_id, entity_id, weight, visit) and (query_id, src, rel, dst,
    provenance, nth).

    A depth is a join keyed by entity and windows keyed by query.  Which
    entities a walk meets does not depend on its edge cap, and the edges it
    collects are the first by depth, visit and order, so both caps are windows.
    """
    q = Window.partitionBy("query_id")
    first = anchors.groupBy("query_id", "entity_id").agg(F.min("pos").alias("pos"))
    seen = first.withColumn("visit", F.row_number().over(q.orderBy("pos"))).where(F.col("visit") <= GRAPH_ENTITY_CAP).select("query_id", "entity_id", F.lit(1.0).alias("weight"), "visit")
    frontier, edges = seen, None
    for d in range(1, depth + 1):
        steps = _steps(history, frontier.select("query_id", "entity_id", "visit"), as_of)
        taken = steps.select("query_id", "src", "rel", "dst", "provenance", F.struct(F.lit(d).alias("d"), "visit", "ord").alias("place"))
        edges = taken if edges is None else edges.unionByName(taken)
        new = steps.groupBy("query_id", F.col("other").alias("entity_id")).agg(F.min(F.struct("visit", "ord")).alias("place"))
        new = new.join(seen.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti")
        held = seen.groupBy("query_id").agg(F.count("*").alias("held"))
        new = new.join(held, "query_id").withColumn("visit", F.col("held") + F.row_number().over(q.orderBy("place"))).where(F.col("visit") <= GRAPH_ENTITY_CAP)
        frontier = new.select("query_id", "entity_id", F.lit(decay**d).alias("weight"), F.col("visit").cast("int").alias("visit"))
        seen = seen.unionByName(frontier)
    if edges is None:
        edges = seen.sparkSession.createDataFrame([], "query_id long, src long, rel string, dst long, provenance long, place struct<d:int,visit:int,ord:int>")
    edges = edges.groupBy("query_id", "src", "rel", "dst", "provenance").agg(F.min("place").alias("place"))
    edges = edges.withColumn("nth", F.row_number().over(q.orderBy("place"))).where(F.col("nth") <= GRAPH_EDGE_CAP).drop("place")
    return seen, edges


def candidates_many(facts: DataFrame, visits: DataFrame, edges: DataFrame, admitted: Column, decay: float = 0.5, k: int = SOURCE_CAP) -> DataFrame:
    """``candidates`` for the frames of ``walk_many``: (query_id, fact_id,
    weight, rank).  ``admitted`` may use columns of facts and visits."""
    q = Window.partitionBy("query_id")
    per = Window.partitionBy("query_id", "entity_id").orderBy("fact_id")
    own = facts.join(visits, "entity_id").withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= GRAPH_EXAMINE_CAP)
    own = own.withColumn("at", F.row_number().over(q.orderBy("visit", "fact_id"))).where(F.col("at") <= GRAPH_EXAMINE_CAP).where(admitted).select("query_id", "fact_id", "weight", "at")
    proof = edges.where("provenance is not null").groupBy("query_id", F.col("provenance").alias("fact_id")).agg(F.min("nth").alias("nth"))
    extra = [c for c in visits.columns if c not in ("query_id", "entity_id", "weight", "visit")]
    known = visits.select("query_id", *extra).distinct()
    proof = facts.join(proof.join(known, "query_id"), "fact_id").where(admitted).select("query_id", "fact_id", F.lit(decay).alias("weight"), (F.col("nth") + GRAPH_EXAMINE_CAP).alias("at"))
    proof = proof.join(own.select("query_id", "fact_id"), ["query_id", "fact_id"], "left_anti")
    both = own.unionByName(proof).withColumn("turn", F.row_number().over(q.orderBy("at"))).where(F.col("turn") <= GRAPH_FACT_CAP)
    return both.withColumn("rank", F.row_number().over(q.orderBy(F.desc("weight"), "fact_id"))).where(F.col("rank") <= k).select("query_id", "fact_id", "weight", "rank")
