"""Recall: four ranked sources, fused, boosted, selected and rendered.

``recall`` answers one query over a store's frames; ``recall_many`` answers a
table of text queries at once, every step keyed by the query.
"""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokenizer import normalized_name, tokens
from ..functions.vectors import check_vector, cosine, quantized_literal
from ..operators import cells, fuse, graph, lexical, temporal, vector
from ..operators.predicates import admit, has_tags
from ..schema import BM25, BUDGET_DEFAULT, GRAPH, K_DEFAULT, K_MAX, SOURCE_CAP, TIME, VEC, Config


@dataclass(frozen=True)
class RecallQuery:
    now: int
    text: str | None = None
    vector: list[float] | None = None
    tags: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    as_of: int | None = None
    range: tuple[int, int] | None = None
    k: int = K_DEFAULT
    token_budget: int | None = None
    include_closed: bool = False
    ef: int | None = None  # more looks into more cells of the vector index
    graph_depth: int | None = None


@dataclass
class RecallResult:
    facts: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    rendered: str = ""
    truncated: bool = False


@dataclass(frozen=True)
class Frames:
    """What recall reads: facts (with ``entity`` names), entities, edge history,
    and optionally facts already tokenised, or their postings and
    the numbers of facts and of tokens."""

    facts: DataFrame
    entities: DataFrame
    edges: DataFrame
    tokenised: DataFrame | None = None
    postings: DataFrame | None = None
    corpus: tuple[int, int] | None = None
    cells: "CellIndex | None" = None


@dataclass(frozen=True)
class CellIndex:
    """Vectors by cell, the cells' centres, how many a query looks into, and the
    first id that may not be filed."""

    rows: DataFrame
    centres: np.ndarray
    probes: int
    below: int


#: ``ef`` of a query that looks into as many cells as were measured to be needed.
EF = 64


def near_in_cells(frames: Frames, q: RecallQuery, admitted, v) -> DataFrame:
    """(fact_id, score): the nearest by the index and, exactly, of what came since;
    ranked first, then admitted."""
    x = frames.cells
    probes = min(len(x.centres), -(-x.probes * (q.ef or EF) // EF))
    asked = frames.facts.sparkSession.range(1).select(F.col("id").alias("query_id"), v.alias("vector"))
    found = cells.search(x.rows, x.centres, asked, probes, 4 * SOURCE_CAP).select(F.col("slot").alias("fact_id"), "score")
    late = frames.facts.where((F.col("fact_id") >= x.below) & F.col("vector").isNotNull()).select("fact_id", F.round(cosine(F.col("vector"), v), 10).alias("score"))
    late = late.orderBy(F.desc("score"), "fact_id").limit(4 * SOURCE_CAP)
    return found.unionByName(late).join(frames.facts.where(admitted).select("fact_id"), "fact_id", "left_semi")


def query_terms(spark: SparkSession, queries: dict) -> DataFrame:
    """(query_id, pos, term) of texts by query id."""
    rows = [(q, i, t) for q, text in queries.items() for i, t in enumerate(tokens(text))]
    return spark.createDataFrame(rows, "query_id long, pos int, term string")


def one(ranked: DataFrame, score: str) -> DataFrame:
    return lexical.top_one(ranked.withColumn("query_id", F.lit(0).cast("long")), SOURCE_CAP, score)


def sources(frames: Frames, q: RecallQuery, config: Config) -> tuple[dict[int, DataFrame], graph.Walk]:
    """The ranked sources that a query asks for, and the walk of its anchors."""
    facts = frames.facts
    admitted = admit(q.now if q.as_of is None else q.as_of, q.include_closed) & has_tags(list(q.tags))
    live = facts.where(admitted).select("fact_id")
    out, walked = {}, graph.Walk()
    if q.text and (terms := tokens(q.text)):
        if frames.postings is not None:
            scored = lexical.bm25_stored(frames.postings, frames.corpus, terms, config.bm25_k1, config.bm25_b)
        else:
            rows = frames.tokenised if frames.tokenised is not None else lexical.tokenised(facts)
            scored = lexical.bm25_one(rows, terms, config.bm25_k1, config.bm25_b)
        out[BM25] = lexical.top_one(scored.join(live, "fact_id", "left_semi"))
    if q.vector is not None:
        v = quantized_literal(check_vector(q.vector, config.dim))
        if frames.cells is not None:
            out[VEC] = one(near_in_cells(frames, q, admitted, v), "score")
        else:
            slots = facts.where("vector is not null").withColumn("slot", F.col("fact_id"))
            out[VEC] = one(vector.flat_topk(slots, v, admitted), "score")
    if q.entities:
        names = list(dict.fromkeys(n for e in q.entities if (n := normalized_name(e))))
        ids = {r["norm_name"]: r["entity_id"] for r in frames.entities.where(F.col("norm_name").isin(names)).collect()}
        anchors = [ids[n] for n in names if n in ids]
        depth = config.graph_depth if q.graph_depth is None else q.graph_depth
        walked = graph.walk(frames.edges, anchors, depth, config.graph_decay, q.as_of)
        if anchors:
            out[GRAPH] = one(graph.candidates(facts, walked, admitted, config.graph_decay), "weight")
    if q.range is not None:
        latest = temporal.range_topk(facts, *q.range, admitted)
        w = F.row_number().over(Window.orderBy(F.desc("recorded_at"), F.desc("fact_id")))
        out[TIME] = latest.select(F.lit(0).cast("long").alias("query_id"), "fact_id", w.alias("rank"))
    return out, walked


def fused(facts: DataFrame, parts: dict[int, DataFrame], now, config: Config) -> DataFrame:
    """Facts with their fused, boosted score."""
    weights = {BM25: config.w_bm25, VEC: config.w_vec, GRAPH: config.w_graph, TIME: config.w_time}
    found = fuse.rrf(parts, weights, config.rrf_k).join(facts, "fact_id")
    return found.withColumn("score", F.round(fuse.recency(F.col("score"), F.lit(now) if isinstance(now, int) else now, F.col("recorded_at"), config.w_recency, config.half_life_days), 10))


def recall(frames: Frames, q: RecallQuery, config: Config = Config()) -> RecallResult:
    """One query.  A tag that no fact carries gives an empty result, edges and
    rendered text included."""
    if q.tags:
        # One pass for all of them.
        held = frames.facts.agg(*[F.bool_or(F.array_contains("tags", t)).alias(f"t{i}") for i, t in enumerate(q.tags)]).first()
        if not all(held):
            return RecallResult()
    parts, walked = sources(frames, q, config)
    rows = []
    truncated = False
    if parts:
        ranked = fused(frames.facts, parts, q.now, config)
        budget = BUDGET_DEFAULT if q.token_budget is None else q.token_budget
        picked = fuse.select_within(ranked, min(q.k, K_MAX), budget).withColumn("line", fuse.fact_line())
        rows = picked.orderBy("rank").collect()
        truncated = bool(rows[0]["truncated"]) if rows else not ranked.isEmpty()
    ends = {i for s, _, d, _ in walked.edges for i in (s, d)}
    names = {r["entity_id"]: r["name"] for r in frames.entities.where(F.col("entity_id").isin(sorted(ends))).collect()} if ends else {}
    edges = [{"src": names.get(s), "rel": r, "dst": names.get(d), "provenance": p} for s, r, d, p in walked.edges]
    lines = [r["line"] for r in rows] + [f"- links: {e['src']} —{e['rel']}→ {e['dst']}" for e in edges]
    rendered = "\n".join(["## memory", *lines]) + "\n" if lines else ""
    facts = [{k: r[k] for k in ("fact_id", "entity", "text", "tags", "score", "sources", "recorded_at", "valid_from", "valid_to")} for r in rows]
    return RecallResult(facts, edges, rendered, truncated)


def recall_many(facts: DataFrame, tokenised: DataFrame | tuple[DataFrame, DataFrame], queries: DataFrame, config: Config = Config(), k: int = K_DEFAULT, budget: int = BUDGET_DEFAULT, anchors: DataFrame | None = None, edges: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, fact_id, score, sources): a table of queries at once.

    ``queries`` is (query_id, now, terms array<string>[, from_ms, to_ms]): words
    and, where both ends are given, a range of recorded time.  ``anchors``
    (query_id, entity_id, pos) walk over the edge history ``edges``; ``vectors``
    (query_id, vector) are quantized.  ``tokenised`` is (fact_id, tokens), or a
    pair of postings and lengths as a store keeps them.  Each source and the
    selection run once, keyed by the query; no fact is collected.
    """
    terms = queries.select("query_id", F.posexplode("terms").alias("pos", "term"))
    when = queries.select("query_id", "now")
    live = (F.col("recorded_at") <= F.col("now")) & (F.col("valid_from") <= F.col("now")) & (F.col("valid_to") > F.col("now")) & ~F.col("tombstone")
    clocks = facts.select("fact_id", "recorded_at", "valid_from", "valid_to", "tombstone")
    if isinstance(tokenised, tuple):
        scored = lexical.bm25_of_postings(*tokenised, terms, config.bm25_k1, config.bm25_b)
    else:
        scored = lexical.bm25(tokenised, terms, config.bm25_k1, config.bm25_b)
    parts = {BM25: lexical.top(scored.join(when, "query_id").join(clocks, "fact_id").where(live).select("query_id", "fact_id", "score"))}
    if "from_ms" in queries.columns:
        span = queries.where("from_ms is not null and to_ms is not null").select("query_id", "now", "from_ms", "to_ms")
        parts[TIME] = temporal.ranges_topk(clocks, span, live)
    if anchors is not None:
        visits, taken = graph.walk_many(edges, anchors, config.graph_depth, config.graph_decay)
        known = facts.select("fact_id", "entity_id", "recorded_at", "valid_from", "valid_to", "tombstone")
        parts[GRAPH] = graph.candidates_many(known, visits.join(when, "query_id"), taken, live, config.graph_decay)
    if vectors is not None:
        slots = facts.where("vector is not null").withColumn("slot", F.col("fact_id")).select("slot", "vector", *clocks.columns)
        parts[VEC] = vector.flat_topk_many(slots, vectors.join(when, "query_id"), live)
    weights = {BM25: config.w_bm25, VEC: config.w_vec, GRAPH: config.w_graph, TIME: config.w_time}
    found = fuse.rrf(parts, weights, config.rrf_k).join(facts.select("fact_id", "text", "recorded_at"), "fact_id").join(when, "query_id")
    ranked = found.withColumn("score", F.round(fuse.recency(F.col("score"), F.col("now"), F.col("recorded_at"), config.w_recency, config.half_life_days), 10))
    return fuse.select_within(ranked, k, budget).select("query_id", "rank", "fact_id", "score", "sources")
