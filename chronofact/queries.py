"""The engine's operators on the driver's tables, each with its SQL twin."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.tokenizer import latin_tokens, tokens_udf
from .functions.vectors import cosine, quantized_literal
from .operators import cells, fuse, graph, lexical, predicates, similar, tags, temporal, vector
from .plans import recall, views
from .schema import BM25, GRAPH, OPEN, TIME
from .sources import jsonl

T = 1_705_708_800_000  # 2024-01-20
DAY = 86_400_000
ORDERS_T = 800_000_000_000
QUERY = "the that hand ention"
NATION, REGION = 106, 2
N_OPEN = str(OPEN)

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL of the views -------------------------------------------------------

EV = f"""ev AS (SELECT event_id AS fact_id, user_id AS entity_id, event_type AS tag, event_type || ' by user ' || user_id AS text,
 (epoch_us(ts) // 1000) AS recorded_at, (epoch_us(ts) // 1000) AS valid_from, coalesce(LEAD((epoch_us(ts) // 1000)) OVER w, {N_OPEN}) AS valid_to, LAG(event_id) OVER w AS revises
 FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""


def sql_tokens(text: str) -> str:
    """The tokenizer's rule for Latin text, as nested replacements."""
    t = f"lower(strip_accents({text}))"
    for _ in range(2):
        for pattern, to in ((r"(\p{L})[.,''’](\p{N})", r"\1 \2"), (r"(\p{N})[.,''’](\p{L})", r"\1 \2"), (r"(\p{L}),(\p{L})", r"\1 \2"), (r"(\p{N})[''’](\p{N})", r"\1 \2"), (r"_[.,''’]", "_ "), (r"[.,''’]_", " _")):
            t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    found = rf"regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+(?:[.,''’][\p{{L}}\p{{N}}_]+)*')"
    return f"list_filter(list_transform({found}, lambda x: trim(x, '_')), lambda x: x <> '')"


DOC = f"doc AS (SELECT doc_id AS fact_id, {sql_tokens('text')} AS toks FROM documents)"
QT = "qt AS (SELECT pos, term FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(QUERY.split())) + ") v(pos, term))"
BM = f"""{DOC}, {QT}, st AS (SELECT count(*) AS n, sum(len(toks)) AS total FROM doc),
 tf AS (SELECT fact_id, len, term, least(count(*), 255) AS tf FROM (SELECT fact_id, least(len(toks), 65535) AS len, unnest(toks) AS term FROM doc) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
 df AS (SELECT qt.term, count(tf.fact_id) AS df FROM (SELECT DISTINCT term FROM qt) qt LEFT JOIN tf ON tf.term = qt.term GROUP BY qt.term),
 qd AS (SELECT pos, term, df, (df > 1024 AND df * 8 > n) AS stop, bool_and(df > 1024 AND df * 8 > n) OVER () AS all_stop, row_number() OVER (ORDER BY df, pos) AS rarest, n, total FROM qt JOIN df USING (term), st),
 kept AS (SELECT * FROM qd WHERE NOT stop OR (all_stop AND rarest = 1)),
 parts AS (SELECT fact_id, pos, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (total / n))) AS part FROM kept JOIN tf USING (term)),
 bm AS (SELECT fact_id, round(list_sum(list(part ORDER BY pos)), 10) AS score FROM parts GROUP BY fact_id),
 bmtop AS (SELECT *, row_number() OVER (ORDER BY score DESC, fact_id) AS rank FROM bm QUALIFY rank <= 128)"""
VEC_SQL = """raw AS (SELECT vec_id AS fact_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings),
 un AS (SELECT fact_id, label, d, list_transform(d, lambda x: x / sqrt(list_sum(list_transform(d, lambda y: y * y)))) AS u FROM raw),
 sc AS (SELECT *, list_max(list_transform(u, lambda x: abs(x))) / 127 AS scale FROM un),
 vq AS (SELECT fact_id, label, scale, list_transform(u, lambda x: round(x / scale)::INTEGER) AS q, list_transform(d, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS sig FROM sc)"""
ED = f"""ed AS (SELECT n_nationkey + 100 AS edge_id, n_nationkey + 100 AS src, 'in' AS rel, 0 AS rel_ord, n_regionkey::BIGINT AS dst, 0 AS valid_from, {N_OPEN} AS valid_to FROM nation
 UNION ALL SELECT s_suppkey + 1000000, s_suppkey + 1000000, 'in', 0, s_nationkey + 100, 0, {N_OPEN} FROM supplier
 UNION ALL SELECT c_custkey + 10000000, c_custkey + 10000000, 'in', 0, c_nationkey + 100, 0, {N_OPEN} FROM customer
 UNION ALL SELECT o_orderkey + 2000000000, o_custkey + 10000000, 'placed', 1, o_orderkey + 1000000000, (epoch_us(o_orderdate) // 1000), CASE WHEN o_orderstatus = 'F' THEN (epoch_us(o_orderdate) // 1000) + 90::BIGINT * {DAY} ELSE {N_OPEN} END FROM orders)"""


def docs(spark, d) -> DataFrame:
    """Documents tokenised by built-in functions."""
    return lexical.tokenised(lexical.spread(views.document_facts(spark, d).select("fact_id", "text")), latin_tokens)


def index(spark, d) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of the documents, as a store makes them."""
    made = lexical.indexed(lexical.spread(views.document_facts(spark, d).select("fact_id", "text")))
    return lexical.stored_postings(made), made.select("fact_id", "n")


def terms(spark) -> DataFrame:
    return recall.query_terms(spark, {0: QUERY})


# --- predicates and time ----------------------------------------------------


@query(f"WITH {EV} SELECT fact_id, entity_id, recorded_at FROM ev WHERE recorded_at <= {T} AND valid_from <= {T} AND valid_to > {T}")
def fact_as_of(spark, d):
    return temporal.facts_as_of(views.event_facts(spark, d), T).select("fact_id", "entity_id", "recorded_at")


@query(f"WITH {EV} SELECT fact_id, valid_to FROM ev WHERE recorded_at <= {T} AND valid_from <= {T}")
def fact_include_closed(spark, d):
    return temporal.facts_as_of(views.event_facts(spark, d), T, include_closed=True).select("fact_id", "valid_to")


@query(f"WITH {EV} SELECT fact_id, entity_id, revises FROM ev WHERE valid_to = {N_OPEN}")
def fact_current(spark, d):
    return views.event_facts(spark, d).where(predicates.current()).select("fact_id", "entity_id", "revises")


@query(f"WITH {EV} SELECT entity_id, tag, count(*) AS versions, min(recorded_at) AS first_at, max(recorded_at) AS last_at, count(revises) AS revisions FROM ev GROUP BY entity_id, tag")
def revision_chain(spark, d):
    f = views.event_facts(spark, d).withColumn("tag", F.get("tags", F.lit(0)))
    return f.groupBy("entity_id", "tag").agg(F.count("*").alias("versions"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"), F.count("revises").alias("revisions"))


@query(f"WITH {EV} SELECT fact_id, recorded_at FROM ev WHERE recorded_at >= {T - 5 * DAY} AND recorded_at < {T} AND valid_from <= {T} AND valid_to > {T} ORDER BY recorded_at DESC, fact_id DESC LIMIT 128")
def time_range_topk(spark, d):
    return temporal.range_topk(views.event_facts(spark, d), T - 5 * DAY, T, predicates.admit(T))


@query(f"""WITH {EV}, p AS (SELECT event_id AS probe, user_id AS entity_id, (epoch_us(ts) // 1000) - 3600000 AS t FROM events WHERE event_type = 'purchase')
 SELECT probe, ev.entity_id, t, fact_id FROM p JOIN ev ON p.entity_id = ev.entity_id AND recorded_at <= t AND valid_from <= t AND t < valid_to""")
def fact_as_of_join(spark, d):
    e = views.read(spark, d, "events").where("event_type = 'purchase'")
    probes = e.select(F.col("event_id").alias("probe"), F.col("user_id").alias("entity_id"), (views.millis(F.col("ts")) - 3_600_000).alias("t"))
    return temporal.as_of_join(views.event_facts(spark, d), probes).select("probe", "entity_id", "t", "fact_id")


@query("SELECT doc_id AS fact_id FROM documents WHERE lang = 'en' AND source = 'src0'")
def tag_and_filter(spark, d):
    return views.document_facts(spark, d).where(predicates.has_tags(["en", "src0"])).select("fact_id")


@query("SELECT doc_id AS fact_id FROM documents WHERE lang = 'fr' AND source = 'src1'")
def tag_list_intersection(spark, d):
    lists = views.document_facts(spark, d).select("fact_id", F.explode("tags").alias("key"))
    return predicates.with_all(lists, ["fr", "src1", "fr"])


@query(f"WITH {EV} SELECT tag, count(*) AS count FROM ev WHERE valid_to = {N_OPEN} GROUP BY tag")
def tag_catalog(spark, d):
    return tags.catalogue(views.event_facts(spark, d))


@query("SELECT source AS tag, count(*) AS count FROM documents WHERE starts_with(source, 'src1') AND source > 'src11' GROUP BY source ORDER BY source LIMIT 5")
def tag_prefix_page(spark, d):
    return tags.page(tags.catalogue(views.document_facts(spark, d)), "src1", "src11", 5)


@query(f"""WITH {EV}, hit AS (SELECT * FROM ev WHERE tag = 'click' AND valid_to = {N_OPEN}), top AS (SELECT max(fact_id) + 1 AS n FROM ev)
 SELECT fact_id, recorded_at, {T + 30 * DAY} AS valid_to, 1 AS n_tags, revises FROM hit
 UNION ALL SELECT row_number() OVER (ORDER BY fact_id) - 1 + n, {T + 30 * DAY}, {N_OPEN}, 0, fact_id FROM hit, top""")
def remove_tag(spark, d):
    f = views.event_facts(spark, d)
    n = f.agg(F.max("fact_id")).first()[0] + 1
    return tags.remove_tag(f, "click", T + 30 * DAY, n).select("fact_id", "recorded_at", "valid_to", F.size("tags").alias("n_tags"), "revises")


# --- words ------------------------------------------------------------------


@query(f"WITH {DOC} SELECT fact_id, len(toks) AS n_tokens, array_to_string(list_slice(toks, 1, 12), ' ') AS head FROM doc")
def tokenize_latin(spark, d):
    return docs(spark, d).select("fact_id", F.size("tokens").alias("n_tokens"), F.array_join(F.slice("tokens", 1, 12), " ").alias("head"))


@query(f"WITH {DOC} SELECT fact_id, array_to_string(toks, ' ') AS tokens FROM doc")
def tokenize_full(spark, d):
    t = lexical.tokenised(views.document_facts(spark, d), tokens_udf())
    return t.select("fact_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {DOC} SELECT fact_id, least(len(toks), 65535) AS len, least(len(list_distinct(toks)), 65535) AS distinct_terms FROM doc")
def doc_stats(spark, d):
    return lexical.doc_stats(docs(spark, d)).withColumnRenamed("distinct", "distinct_terms")


@query(f"WITH {DOC} SELECT term, fact_id, least(count(*), 255) AS tf FROM (SELECT fact_id, unnest(toks) AS term FROM doc) GROUP BY ALL")
def postings(spark, d):
    return index(spark, d)[0].select("term", "fact_id", "tf")


@query(f"WITH {BM} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def bm25_idf(spark, d):
    t = docs(spark, d)
    n = t.agg(F.count("*").alias("n"))
    return lexical.term_frequencies(t, terms(spark)).crossJoin(F.broadcast(n)).select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {BM} SELECT pos, term, df FROM kept")
def stop_terms(spark, d):
    t = docs(spark, d)
    ts = terms(spark).crossJoin(F.broadcast(t.agg(F.count("*").alias("n"))))
    return lexical.kept_terms(ts, lexical.term_frequencies(t, ts), F.col("n")).select("pos", "term", "df")


@query(f"WITH {BM} SELECT fact_id, round(score, 6) AS score, rank FROM bmtop")
def bm25_topk(spark, d):
    return lexical.top(lexical.bm25_of_postings(*index(spark, d), terms(spark))).select("fact_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {BM} SELECT fact_id, round(score, 6) AS score, rank FROM bmtop")
def bm25_single_query(spark, d):
    from .functions.tokenizer import tokens

    postings, lengths = index(spark, d)
    return lexical.top_one(lexical.bm25_stored(postings, lexical.corpus_of(lengths), tokens(QUERY))).select("fact_id", F.round("score", 6).alias("score"), "rank")


# --- vectors ----------------------------------------------------------------


@query(f"WITH {VEC_SQL} SELECT fact_id, round(scale, 6) AS scale, array_to_string(q, ',') AS q FROM vq")
def vec_quantize(spark, d):
    v = views.quantized(spark, d)
    return v.select("fact_id", F.round("vector.scale", 6).alias("scale"), F.array_join(F.transform("vector.q", lambda x: x.cast("string")), ",").alias("q"))


def probe(spark, d):
    row = views.read(spark, d, "embeddings").where("vec_id = 7").first()
    return quantized_literal(row["embedding"])


HAM = "list_sum(list_transform(list_zip(v.sig, p.sig), lambda x: CASE WHEN x[1] = x[2] THEN 0 ELSE 1 END))"
SIEVE = f"p AS (SELECT * FROM vq WHERE fact_id = 7), sv AS (SELECT v.*, {HAM}::BIGINT AS ham FROM vq v, p ORDER BY ham, v.fact_id LIMIT 512)"
COS = "v.scale * p.scale * list_sum(list_transform(list_zip(v.q, p.q), lambda x: x[1] * x[2]))"


@query(f"WITH {VEC_SQL}, {SIEVE} SELECT fact_id, ham FROM sv")
def vec_sieve(spark, d):
    return vector.sieve(views.quantized(spark, d), probe(spark, d)).select("fact_id", F.col("ham").cast("long").alias("ham"))


@query(f"WITH {VEC_SQL}, {SIEVE} SELECT v.fact_id, round({COS}, 6) AS score FROM sv v, p WHERE v.label <> 3 ORDER BY round({COS}, 10) DESC, v.fact_id LIMIT 128")
def vec_flat_topk(spark, d):
    found = vector.flat_topk(views.quantized(spark, d), probe(spark, d), F.col("label") != 3)
    return found.select("fact_id", F.round("score", 6).alias("score"))


@query(f"""WITH {VEC_SQL}, p AS (SELECT * FROM vq WHERE fact_id % 20 = 0),
 sv AS (SELECT p.fact_id AS query_id, v.fact_id, v.label, round({COS}, 10) AS score FROM vq v, p QUALIFY row_number() OVER (PARTITION BY p.fact_id ORDER BY {HAM}, v.fact_id) <= 512)
 SELECT query_id, fact_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM sv WHERE label <> 3 QUALIFY rank <= 128""")
def vec_flat_topk_many(spark, d):
    v = views.quantized(spark, d)
    probes = v.where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "vector")
    return vector.flat_topk_many(v, probes, F.col("label") != 3).withColumn("score", F.round("score", 6))


@query(f"WITH {VEC_SQL}, p AS (SELECT * FROM vq WHERE fact_id = 7) SELECT v.fact_id, round({COS}, 6) AS cosine FROM vq v, p")
def vec_cosine(spark, d):
    return views.quantized(spark, d).select("fact_id", F.round(cosine(F.col("vector"), probe(spark, d)), 6).alias("cosine"))


@query(f"""WITH {VEC_SQL}, p AS (SELECT * FROM vq WHERE fact_id % 20 = 0), s AS (SELECT p.fact_id AS query_id, v.fact_id, round({COS}, 10) AS score FROM vq v, p)
 SELECT query_id, fact_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM s QUALIFY rank <= 10""")
def vec_cells_topk(spark, d):
    """The vector index with every cell looked into: the exact neighbours, so all
    vectors are filed.  Its recall with fewer cells is held in the tests."""
    v = views.quantized(spark, d)
    centres = cells.fit(v)
    asked = v.where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "vector")
    found = cells.search(cells.filed(v, centres), centres, asked, len(centres))
    return found.select("query_id", F.col("slot").alias("fact_id"), F.round("score", 6).alias("score"), "rank")


# --- graph ------------------------------------------------------------------


@query(f"WITH {ED} SELECT edge_id, src, rel, dst FROM ed WHERE valid_to = {N_OPEN}")
def edges_current(spark, d):
    return temporal.edges_current(views.edge_history(spark, d)).select("edge_id", "src", "rel", "dst")


@query(f"WITH {ED} SELECT edge_id, src, rel, dst FROM ed WHERE valid_from <= {ORDERS_T} AND valid_to > {ORDERS_T}")
def edges_as_of(spark, d):
    return temporal.edges_as_of(views.edge_history(spark, d), ORDERS_T).select("edge_id", "src", "rel", "dst")


D1 = f"""{ED}, out1 AS (SELECT dst AS entity_id, 1 AS side, 0 AS o FROM ed WHERE src = {NATION} UNION ALL SELECT src, 2, src FROM ed WHERE dst = {NATION} AND valid_to = {N_OPEN}),
 v AS (SELECT {NATION} AS entity_id, 1.0::DOUBLE AS weight, 0 AS visit UNION ALL SELECT entity_id, 0.5::DOUBLE, row_number() OVER (ORDER BY side, o) FROM out1 QUALIFY row_number() OVER (ORDER BY side, o) < 64)"""


def visited(spark, w) -> DataFrame:
    return spark.createDataFrame([(e, x, i) for i, (e, x) in enumerate(w.entities)], "entity_id long, weight double, visit int")


@query(f"WITH {D1} SELECT entity_id, weight, visit FROM v")
def graph_expand_d1(spark, d):
    return visited(spark, graph.walk(views.edge_history(spark, d), [NATION], 1))


@query(f"""WITH {ED}, n AS (SELECT src AS nation, row_number() OVER (ORDER BY src) AS visit FROM ed WHERE dst = {REGION} AND rel = 'in'),
 far AS (SELECT e.src AS entity_id, row_number() OVER (ORDER BY n.visit, e.src) AS o FROM ed e JOIN n ON e.dst = n.nation WHERE e.rel = 'in')
 SELECT {REGION} AS entity_id, 1.0::DOUBLE AS weight, 0 AS visit UNION ALL SELECT nation, 0.5::DOUBLE, visit FROM n
 UNION ALL SELECT entity_id, 0.25::DOUBLE, o + (SELECT count(*) FROM n) FROM far WHERE o + (SELECT count(*) FROM n) < 64""")
def graph_expand_d2(spark, d):
    return visited(spark, graph.walk(views.edge_history(spark, d), [REGION], 2))


CAND = f"""{D1}, fo AS (SELECT o_orderkey AS fact_id, o_custkey + 10000000 AS entity_id, (epoch_us(o_orderdate) // 1000) AS recorded_at FROM orders),
 ex AS (SELECT fact_id, weight, recorded_at, row_number() OVER (ORDER BY visit, fact_id) AS o FROM fo JOIN v USING (entity_id)),
 adm AS (SELECT fact_id, weight, o FROM ex WHERE o <= 2048 AND recorded_at <= {ORDERS_T} ORDER BY o LIMIT 256),
 cand AS (SELECT fact_id, weight, row_number() OVER (ORDER BY weight DESC, fact_id) AS rank FROM adm QUALIFY rank <= 128)"""


def order_candidates(spark, d):
    found = graph.walk(views.edge_history(spark, d), [NATION], 1)
    return graph.candidates(views.order_facts(spark, d), found, predicates.admit(ORDERS_T))


@query(f"WITH {CAND} SELECT fact_id, weight FROM cand")
def graph_candidates(spark, d):
    return order_candidates(spark, d)


@query(f"""WITH {ED}, out1 AS (SELECT src AS query_id, dst AS entity_id, 1 AS side, 0 AS o FROM ed WHERE rel = 'in' AND dst < 100 UNION ALL SELECT n.src, e.src, 2, e.src FROM ed e JOIN ed n ON e.dst = n.src AND n.dst < 100 AND n.rel = 'in' WHERE e.rel = 'in')
 SELECT src AS query_id, src AS entity_id, 1.0::DOUBLE AS weight, 1 AS visit FROM ed WHERE rel = 'in' AND dst < 100
 UNION ALL SELECT query_id, entity_id, 0.5::DOUBLE, 1 + row_number() OVER (PARTITION BY query_id ORDER BY side, o) FROM out1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY side, o) < 64""")
def graph_expand_many(spark, d):
    n = views.read(spark, d, "nation").select((F.col("n_nationkey") + views.NATION).cast("long").alias("query_id"), (F.col("n_nationkey") + views.NATION).cast("long").alias("entity_id"), F.lit(0).alias("pos"))
    return graph.walk_many(views.edge_history(spark, d), n, 1)[0]


@query(f"""WITH {ED}, one AS (SELECT min(src) AS c FROM ed WHERE rel = 'placed' AND valid_from <= {ORDERS_T} AND valid_to > {ORDERS_T})
 SELECT dst AS other, 'placed' AS rel, row_number() OVER (ORDER BY valid_from DESC, edge_id DESC) AS ord FROM ed, one WHERE src = c AND rel = 'placed' AND valid_from <= {ORDERS_T} AND valid_to > {ORDERS_T}""")
def graph_neighbours_as_of(spark, d):
    e = views.edge_history(spark, d)
    c = temporal.edges_as_of(e, ORDERS_T).where("rel = 'placed'").agg(F.min("src")).first()[0]
    return graph.neighbours(e, [c], ORDERS_T).where("rel = 'placed'").select("other", "rel", "ord")


# --- fusing -----------------------------------------------------------------

LATE = 10**13
DOCTIME = "(SELECT doc_id AS fact_id, doc_id * 3600000 AS recorded_at, text FROM documents)"
RRF = f"""{BM}, tm AS (SELECT fact_id, row_number() OVER (ORDER BY recorded_at DESC, fact_id DESC) AS rank FROM {DOCTIME} QUALIFY rank <= 128),
 al AS (SELECT fact_id, 1.0 / (60.0 + rank) AS part, 0 AS o, 1 AS bit FROM bmtop UNION ALL SELECT fact_id, 1.0 / (60.0 + rank), 3, 4 FROM tm),
 fu AS (SELECT fact_id, list_sum(list(part ORDER BY o)) AS score, bit_or(bit) AS sources FROM al GROUP BY fact_id)"""
NOW = 10**11
BOOST = f"fin AS (SELECT fu.fact_id, round(score * (1 + 0.25 * pow(2.0, -greatest({NOW} - recorded_at, 0) / (180.0 * {DAY}))), 10) AS score, sources, text, recorded_at FROM fu JOIN {DOCTIME} d USING (fact_id))"
PICK = "pick AS (SELECT *, row_number() OVER (ORDER BY score DESC, fact_id) AS rank, sum(strlen(text) // 4 + 8) OVER (ORDER BY score DESC, fact_id ROWS UNBOUNDED PRECEDING) AS spent FROM fin)"


def parts(spark, d):
    q = F.lit(0).cast("long").alias("query_id")
    w = Window.orderBy(F.desc("recorded_at"), F.desc("fact_id"))
    late = temporal.range_topk(views.document_facts(spark, d), 0, LATE, predicates.admit(LATE))
    return {BM25: lexical.top(lexical.bm25_of_postings(*index(spark, d), terms(spark))), TIME: late.select(q, "fact_id", F.row_number().over(w).alias("rank"))}


@query(f"WITH {RRF} SELECT fact_id, round(score, 8) AS score, sources FROM fu")
def rrf_fusion(spark, d):
    return fuse.rrf(parts(spark, d), {BM25: 1.0, TIME: 1.0}).select("fact_id", F.round("score", 8).alias("score"), "sources")


def boosted(spark, d):
    return recall.fused(views.document_facts(spark, d), parts(spark, d), NOW, recall.Config())


@query(f"WITH {RRF}, {BOOST} SELECT fact_id, round(score, 8) AS score FROM fin")
def recency_boost(spark, d):
    return boosted(spark, d).select("fact_id", F.round("score", 8).alias("score"))


@query(f"WITH {RRF}, {BOOST}, {PICK} SELECT fact_id, rank, spent, 1 AS truncated FROM pick WHERE rank <= 20 AND spent <= 20000")
def budget_select(spark, d):
    return fuse.select_within(boosted(spark, d), 20, 20000).select("fact_id", "rank", F.col("spent").cast("long").alias("spent"), F.col("truncated").cast("int").alias("truncated"))


ANCHOR = "src3"
FOUR = f"""{BM}, {VEC_SQL}, p AS (SELECT * FROM vq WHERE fact_id = 7),
 sv AS (SELECT v.*, {HAM}::BIGINT AS ham FROM (SELECT * FROM vq WHERE fact_id IN (SELECT doc_id FROM documents)) v, p ORDER BY ham, v.fact_id LIMIT 512),
 vt AS (SELECT v.fact_id, row_number() OVER (ORDER BY round({COS}, 10) DESC, v.fact_id) AS rank FROM sv v, p QUALIFY rank <= 128),
 own AS (SELECT doc_id AS fact_id, 1.0 AS weight, row_number() OVER (ORDER BY doc_id) AS nth FROM documents WHERE source = '{ANCHOR}' QUALIFY nth <= 256),
 proof AS (SELECT prov AS fact_id, 0.5 AS weight, 2048 + row_number() OVER (ORDER BY lang) AS nth FROM (SELECT lang, max(doc_id) AS prov FROM documents GROUP BY lang)
  WHERE lang IN (SELECT lang FROM documents WHERE source = '{ANCHOR}') AND prov NOT IN (SELECT fact_id FROM own)),
 gr AS (SELECT fact_id, row_number() OVER (ORDER BY weight DESC, fact_id) AS rank FROM (SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM proof) ORDER BY nth LIMIT 256) QUALIFY rank <= 128),
 tm AS (SELECT fact_id, row_number() OVER (ORDER BY recorded_at DESC, fact_id DESC) AS rank FROM {DOCTIME} QUALIFY rank <= 128),
 al AS (SELECT fact_id, 1.0 / (60.0 + rank) AS part, 0 AS o, 1 AS bit FROM bmtop UNION ALL SELECT fact_id, 1.0 / (60.0 + rank), 1, 8 FROM vt
  UNION ALL SELECT fact_id, 1.0 / (60.0 + rank), 2, 2 FROM gr UNION ALL SELECT fact_id, 1.0 / (60.0 + rank), 3, 4 FROM tm),
 fu AS (SELECT fact_id, list_sum(list(part ORDER BY o)) AS score, bit_or(bit) AS sources FROM al GROUP BY fact_id)"""


@query(f"WITH {FOUR}, {BOOST}, {PICK} SELECT fact_id, rank, round(score, 8) AS score, sources FROM pick WHERE rank <= 40 AND spent <= 200000")
def recall_hybrid(spark, d):
    """Words, vectors, graph (with facts that vouch for edges) and time."""
    e = views.read(spark, d, "documents")
    v = views.quantized(spark, d).select("fact_id", "vector")
    names = e.select(F.col("source").alias("name")).unionByName(e.select(F.col("lang").alias("name"))).distinct()
    entities = names.withColumn("entity_id", (F.row_number().over(Window.orderBy("name")) - 1).cast("long")).withColumn("norm_name", F.lower("name"))
    ids = lambda c: entities.select(F.col("name").alias(c), F.col("entity_id").alias(f"{c}_id"))
    f = views.document_facts(spark, d).withColumnRenamed("entity", "source").join(ids("source"), "source").withColumnRenamed("source_id", "entity_id").withColumnRenamed("source", "entity").join(v, "fact_id", "left")
    edges = e.select("source", "lang").distinct().join(e.groupBy("lang").agg(F.max("doc_id").alias("provenance")), "lang").join(ids("source"), "source").join(ids("lang"), "lang")
    edges = edges.select((F.col("source_id") * 1000 + F.col("lang_id")).alias("edge_id"), F.col("source_id").alias("src"), F.lit("writes").alias("rel"), F.lit(0).alias("rel_ord"), F.col("lang_id").alias("dst"), "provenance", *[F.lit(0).cast("long").alias(c) for c in ("recorded_at", "valid_from")], F.lit(OPEN).alias("valid_to"))
    near = views.read(spark, d, "embeddings").where("vec_id = 7").first()["embedding"]
    q = recall.RecallQuery(now=NOW, as_of=LATE, text=QUERY, vector=list(near), entities=(ANCHOR,), graph_depth=1, range=(0, LATE), k=40, token_budget=200000)
    postings, lengths = index(spark, d)
    got = recall.recall(recall.Frames(f, entities, edges, postings=postings, corpus=lexical.corpus_of(lengths)), q, recall.Config(dim=len(near)))
    rows = [(r["fact_id"], i + 1, round(r["score"], 8), r["sources"]) for i, r in enumerate(got.facts)]
    return spark.createDataFrame(rows, "fact_id long, rank int, score double, sources int")


MANY = f"""{DOC}, qs AS (SELECT item_id AS query_id, {sql_tokens('text')} AS terms FROM benchmark),
 qt AS (SELECT query_id, unnest(range(1, len(terms) + 1)) AS pos, unnest(terms) AS term FROM qs),
 st AS (SELECT count(*) AS n, sum(len(toks)) AS total FROM doc),
 tf AS (SELECT fact_id, len, term, least(count(*), 255) AS tf FROM (SELECT fact_id, least(len(toks), 65535) AS len, unnest(toks) AS term FROM doc) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
 df AS (SELECT q.term, count(tf.fact_id) AS df FROM (SELECT DISTINCT term FROM qt) q LEFT JOIN tf ON tf.term = q.term GROUP BY q.term),
 qd AS (SELECT *, (df > 1024 AND df * 8 > n) AS stop, bool_and(df > 1024 AND df * 8 > n) OVER (PARTITION BY query_id) AS all_stop, row_number() OVER (PARTITION BY query_id ORDER BY df, pos) AS rarest FROM qt JOIN df USING (term), st),
 pt AS (SELECT query_id, fact_id, pos, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (total / n))) AS part FROM qd JOIN tf USING (term) WHERE NOT stop OR (all_stop AND rarest = 1)),
 bm AS (SELECT query_id, fact_id, round(list_sum(list(part ORDER BY pos)), 10) AS score FROM pt WHERE fact_id * 3600000 <= {NOW} GROUP BY query_id, fact_id),
 tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS r FROM bm QUALIFY r <= 128),
 fu AS (SELECT query_id, fact_id, round(1.0 / (60.0 + r) * (1 + 0.25 * pow(2.0, -greatest({NOW} - fact_id * 3600000, 0) / (180.0 * {DAY}))), 10) AS score FROM tp),
 pk AS (SELECT f.*, row_number() OVER w AS rank, sum(strlen(d.text) // 4 + 8) OVER (PARTITION BY query_id ORDER BY score DESC, fact_id ROWS UNBOUNDED PRECEDING) AS spent FROM fu f JOIN documents d ON d.doc_id = f.fact_id WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, fact_id))"""


@query(f"WITH {MANY} SELECT query_id, rank, fact_id, round(score, 8) AS score, 1 AS sources FROM pk WHERE rank <= 8 AND spent <= 20000")
def recall_many(spark, d):
    q = views.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(NOW).alias("now"), latin_tokens(F.col("text")).alias("terms"))
    got = recall.recall_many(views.document_facts(spark, d), index(spark, d), q, budget=20000)
    return got.withColumn("score", F.round("score", 8))


@query(f"""WITH {EV} SELECT fact_id, '- [f' || fact_id || '] user ' || entity_id || ': ' || text || ' (' || strftime(make_timestamp(valid_from * 1000), '%Y-%m')
 || CASE WHEN valid_to = {N_OPEN} THEN '; active' ELSE ' → ' || strftime(make_timestamp(CASE WHEN valid_to = {N_OPEN} THEN 0 ELSE valid_to END * 1000), '%Y-%m') || '; closed' END || ') #' || tag AS line FROM ev""")
def render_block(spark, d):
    return views.event_facts(spark, d).select("fact_id", fuse.fact_line().alias("line"))


# --- writing ----------------------------------------------------------------

SIM = f"""cv AS (SELECT conv_id * 1000 + turn AS fact_id, conv_id AS entity_id, list_distinct({sql_tokens('text')}) AS terms FROM conversations),
 ring AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY fact_id DESC) AS o FROM cv QUALIFY o <= 32),
 pr AS (SELECT n.fact_id AS new_id, r.fact_id, len(list_intersect(n.terms, r.terms)) AS c, len(n.terms) + len(r.terms) AS s FROM cv n JOIN ring r ON n.entity_id = r.entity_id AND n.fact_id <> r.fact_id),
 js AS (SELECT new_id, fact_id, c / (s - c) AS score FROM pr WHERE s > c AND c / (s - c) > 0.1)"""


def conversation_terms(spark, d):
    f = views.conversation_facts(spark, d)
    return f.join(lexical.tokenised(f, latin_tokens), "fact_id").withColumn("vector", F.lit(None).cast("struct<scale:double,q:array<tinyint>,sig:array<bigint>>"))


@query(f"WITH {SIM} SELECT new_id, fact_id, round(score, 8) AS score FROM js QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY score DESC, fact_id) <= 8")
def similar_jaccard(spark, d):
    f = conversation_terms(spark, d)
    return similar.similar(f, f, least_jaccard=0.1).select("new_id", "fact_id", F.round("score", 8).alias("score"))


@query(f"WITH {SIM} SELECT fact_id, (fact_id IN (SELECT new_id FROM js WHERE fact_id < new_id))::INTEGER AS blocked FROM cv")
def guarded_remember(spark, d):
    f = conversation_terms(spark, d)
    hit = similar.similar(f, f, least_jaccard=0.1).where("fact_id < new_id").select(F.col("new_id").alias("fact_id")).distinct().withColumn("b", F.lit(1))
    return f.select("fact_id").join(hit, "fact_id", "left").select("fact_id", F.coalesce("b", F.lit(0)).alias("blocked"))


@query(f"""WITH {VEC_SQL}, ring AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY fact_id DESC) AS o FROM vq QUALIFY o <= 32),
 pr AS (SELECT v.fact_id AS new_id, p.fact_id, round({COS}, 10) AS score FROM vq v JOIN ring p ON v.label = p.label AND v.fact_id <> p.fact_id)
 SELECT new_id, fact_id, round(score, 6) AS score FROM pr WHERE score > 0.3 QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY score DESC, fact_id) <= 8""")
def similar_cosine(spark, d):
    v = views.quantized(spark, d).select("fact_id", F.col("label").cast("long").alias("entity_id"), F.array(F.col("fact_id").cast("string")).alias("tokens"), "vector", F.lit(False).alias("tombstone"), F.lit(OPEN).alias("valid_to"))
    return similar.similar(v, v, least_cos=0.3).select("new_id", "fact_id", F.round("score", 6).alias("score"))


@query("""SELECT norm_name, name, row_number() OVER (ORDER BY first_at) - 1 AS entity_id FROM
 (SELECT lower(source) AS norm_name, arg_min(source, doc_id) AS name, min(doc_id) AS first_at FROM documents GROUP BY lower(source))""")
def entity_upsert(spark, d):
    from .plans import write

    names = views.read(spark, d, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("ordinal"))
    return write.entity_upsert(names, latin_tokens).select("norm_name", "name", "entity_id")


@query("""WITH r AS (SELECT user_id AS src, event_type AS rel, (event_id % 3) AS dst, event_id AS prov, (epoch_us(ts) // 1000) AS now, event_id % 4 = 0 AS off FROM events),
 o AS (SELECT *, LAG(off) OVER w AS was_off FROM r WINDOW w AS (PARTITION BY src, rel, dst ORDER BY now, prov)),
 v AS (SELECT *, LEAD(now) OVER (PARTITION BY src, rel, dst ORDER BY now, prov) AS nxt FROM o WHERE NOT (off AND (was_off IS NULL OR was_off)))
 SELECT src, rel, dst, prov AS provenance, now AS valid_from, coalesce(nxt, 9223372036854775807) AS valid_to FROM v WHERE NOT off""")
def link_unlink_replay(spark, d):
    from .plans import write

    e = views.read(spark, d, "events")
    ops = e.select(F.when(F.col("event_id") % 4 == 0, "unlink").otherwise("link").alias("op"), F.col("user_id").alias("src"), F.col("event_type").alias("rel"), F.pmod("event_id", F.lit(3)).cast("long").alias("dst"), F.col("event_id").alias("provenance"), views.millis(F.col("ts")).alias("now"), F.struct(views.millis(F.col("ts")), F.col("event_id")).alias("seq"))
    return write.replay_links(ops).select("src", "rel", "dst", "provenance", "valid_from", "valid_to")


# --- upkeep -----------------------------------------------------------------


@query(f"""WITH {EV}, ct AS (SELECT tag, count(*) AS n FROM ev WHERE valid_to = {N_OPEN} GROUP BY tag), pl AS (SELECT o_custkey AS src, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
 SELECT 'dangling edge' AS problem, count(*) AS rows FROM orders WHERE o_custkey % 97 = 0
 UNION ALL SELECT 'open edge twice', count(*) FROM pl WHERE n > 1
 UNION ALL SELECT 'catalogue', 2 * count(*) FROM ct WHERE tag <> 'click' UNION ALL SELECT 'interval', count(*) FROM ev WHERE valid_to < valid_from
 UNION ALL SELECT 'id twice', count(*) FROM ev WHERE tag = 'click'""")
def verify_violations(spark, d):
    """Checks over tables with faults put in: customers without an entity, orders
    that all lead to one, a catalogue that counts too many, facts twice."""
    from .plans import maintain

    e = views.edge_history(spark, d)
    ents = e.select(F.col("src").alias("entity_id")).unionByName(e.select(F.col("dst").alias("entity_id"))).distinct()
    customer = F.col("entity_id").between(views.CUSTOMER, views.ORDER - 1)
    seeded = ents.where(~(customer & ((F.col("entity_id") - views.CUSTOMER) % 97 == 0)))
    one = e.where("rel = 'placed'").agg(F.min("dst")).first()[0]
    placed = e.where("rel = 'placed'").withColumn("dst", F.lit(one))
    facts = views.event_facts(spark, d)
    tag = F.get("tags", F.lit(0))
    stale = tags.catalogue(facts).withColumn("count", F.col("count") + F.when(F.col("tag") == "click", 0).otherwise(1))
    twice = facts.unionByName(facts.where(tag == "click").withColumn("tombstone", F.lit(True)))
    return maintain.violations(twice, seeded, placed, stale)


@query(f"WITH {EV} SELECT tag, count(*) AS kept, sum(CASE WHEN revises IS NOT NULL THEN 1 ELSE 0 END) AS chained FROM ev WHERE fact_id % 10 <> 3 GROUP BY tag")
def maintain_purge(spark, d):
    from .plans import maintain

    f = views.event_facts(spark, d).withColumn("tombstone", F.col("fact_id") % 10 == 3)
    return maintain.purge(f).groupBy(F.get("tags", F.lit(0)).alias("tag")).agg(F.count("*").alias("kept"), F.sum(F.col("revises").isNotNull().cast("long")).alias("chained"))


@query(f"WITH {EV} SELECT count(*) AS facts, count(*) FILTER (valid_to = {N_OPEN}) AS current, count(DISTINCT entity_id) AS entities, max(fact_id) + 1 AS next_fact FROM ev")
def stats(spark, d):
    from .plans import maintain

    return maintain.counters(views.event_facts(spark, d)).select("facts", "current", "entities", "next_fact")


@query(f"""WITH {EV} SELECT fact_id AS id, '{{"kind":"fact","id":' || fact_id || ',"text":"' || text || '","entity":"user ' || entity_id || '","tags":["' || tag || '"],"metadata":{{"k":"' || json_extract_string(e.props, '$.k') || '"}},"recorded_at":' || recorded_at || ',"valid_from":' || valid_from || '}}' AS line
 FROM ev JOIN events e ON e.event_id = ev.fact_id WHERE valid_to = {N_OPEN}""")
def export_jsonl(spark, d):
    return jsonl.fact_lines(views.event_facts(spark, d).where(predicates.current())).select("id", "line")
