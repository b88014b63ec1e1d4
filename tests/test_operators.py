import math
import random

import pytest
from pyspark.sql import functions as F

from chronofact.errors import Invalid, StaleCursor, TooLarge
from chronofact.functions.vectors import cosine, quantize, quantized_literal
from chronofact.operators import fuse, graph, lexical, number, predicates, similar, tags, temporal, vector
from chronofact.plans import maintain, write
from chronofact.schema import OPEN

CORPUS = {
    10: "rain rain wind hail", 11: "rain sun", 12: "wind wind wind fog fog sun", 13: "hail", 14: "", 15: "fog rain sun wind hail snow", 16: "snow snow", 17: "sun sun sun sun sun sun sun",
}
QUERIES = ["rain", "rain wind", "snow hail", "sun fog fog", "hail rain thunder"]


def scores(query, k1=1.2, b=0.75):
    """The formula of Okapi's BM25 with an idf that cannot be negative."""
    docs = {i: t.split() for i, t in CORPUS.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for term in query.split():
        has = {i: w.count(term) for i, w in docs.items() if term in w}
        idf = math.log(1 + (len(docs) - len(has) + 0.5) / (len(has) + 0.5))
        for i, tf in has.items():
            out[i] = out.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(docs[i]) / mean))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t.split()) for i, t in CORPUS.items()], "fact_id long, tokens array<string>").cache()


def terms(spark, *queries):
    return spark.createDataFrame([(q, i, t) for q, text in enumerate(queries) for i, t in enumerate(text.split())], "query_id long, pos int, term string")


def test_bm25_of_many_queries_is_the_formula(spark, corpus):
    got = lexical.top(lexical.bm25(corpus, terms(spark, *QUERIES))).orderBy("query_id", "rank").collect()
    for n, q in enumerate(QUERIES):
        want, rows = scores(q), [r for r in got if r["query_id"] == n]
        assert [r["fact_id"] for r in rows] == sorted(want, key=lambda d: (-round(want[d], 10), d))
        assert {r["fact_id"]: r["score"] for r in rows} == pytest.approx(want, abs=1e-9)


def test_bm25_of_one_query_is_the_same(spark, corpus):
    for q in (*QUERIES, "fog fog", "thunder", "sun thunder sun"):
        assert {r["fact_id"]: r["score"] for r in lexical.bm25_one(corpus, q.split()).collect()} == pytest.approx(scores(q), abs=1e-9)
    assert lexical.bm25_one(corpus.where("false"), ["rain"]).count() == 0
    plan = lexical.top_one(lexical.bm25_one(corpus, ["rain"]))._jdf.queryExecution().toString()
    assert "Join" not in plan and "TakeOrderedAndProject" in plan


def test_bm25_repeated_and_unknown_terms(spark, corpus):
    got = {(r["query_id"], r["fact_id"]): r["score"] for r in lexical.bm25(corpus, terms(spark, "snow", "snow snow", "thunder")).collect()}
    assert all(math.isclose(got[1, i], 2 * got[0, i], abs_tol=1e-9) for i in (15, 16))
    assert not any(q == 2 for q, _ in got)


def test_stop_terms_keep_the_rarest_when_all_are_frequent(spark):
    t = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c")], "query_id long, pos int, term string")
    df = spark.createDataFrame([("a", 3000), ("b", 2000), ("c", 5)], "term string, df long")
    kept = {(r["query_id"], r["term"]) for r in lexical.kept_terms(t, df, F.lit(4000)).collect()}
    assert kept == {(0, "b"), (1, "c")}


def test_postings_and_stats(spark):
    t = spark.createDataFrame([(1, ["a"] * 300 + ["b"]), (2, [])], "fact_id long, tokens array<string>")
    assert {(r["term"], r["tf"]) for r in lexical.postings(t).collect()} == {("a", 255), ("b", 1)}
    assert {(r["fact_id"], r["len"], r["distinct"]) for r in lexical.doc_stats(t).collect()} == {(1, 301, 2), (2, 0, 0)}


def test_tag_lists(spark):
    rng = random.Random(12)
    lists = {k: set(rng.sample(range(30), 12)) for k in "wxyz"}
    df = spark.createDataFrame([(k, f) for k, v in lists.items() for f in v], "key string, fact_id long")
    for keys in ("wx", "wxy", "zz", "zyxw", "y"):
        assert {r[0] for r in predicates.with_all(df, list(keys)).collect()} == set.intersection(*(lists[k] for k in keys))
    assert predicates.with_all(df, []).count() == predicates.with_all(df, ["w", "none"]).count() == 0


def test_quantize_and_cosine(spark):
    vs = {0: [3.0, -4.0, 12.0], 1: [-1.5, 2.0, -6.0], 2: [4.0, 3.0, 0.0], 3: [0.0, 0.0, 0.0], 4: [1.0, float("inf"), 0.0], 5: None, 6: [0.1, 0.7, -0.3]}
    v = spark.createDataFrame(list(vs.items()), "id int, v array<double>").select("id", quantize(F.col("v")).alias("q"))
    got = {r["id"]: r for r in v.withColumn("c", cosine(F.col("q"), quantized_literal(vs[0]))).collect()}

    def exact(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    assert all(abs(got[i]["c"] - exact(vs[0], vs[i])) < 0.01 for i in (0, 1, 2, 6))
    assert {i: got[i]["q"]["sig"] for i in (0, 1, 2, 6)} == {0: [5], 1: [2], 2: [7], 6: [3]}
    assert all(got[i]["q"] is None for i in (3, 4, 5))
    assert got[6]["q"]["q"] == spark.range(1).select(quantized_literal(vs[6]).alias("q")).first()["q"]["q"]


def history(spark, edges):
    return spark.createDataFrame([(i, s, r, 0, d, p, t, t, OPEN) for i, (s, r, d, p, t) in enumerate(edges)], "edge_id long, src long, rel string, rel_ord long, dst long, provenance long, recorded_at long, valid_from long, valid_to long")


def test_hub_caps_and_orders(spark):
    e = history(spark, [(9, "serves", 1000 - i, None, 5 * i) for i in range(333)])
    w = graph.walk(e, [9], 2)
    assert [d for _, _, d, _ in w.edges] == list(range(668, 668 + 128)) and [x for x, _ in w.entities] == [9, *range(668, 668 + 63)]
    late = graph.walk(e, [9], 2, as_of=5 * 200)
    assert [d for _, _, d, _ in late.edges] == list(range(800, 800 + 128))


def test_a_hub_of_repeated_edges_shows_its_other_neighbours(spark):
    """One neighbour fills the edge cap many times over; the others are still met."""
    rows = [(1, f"r{i:03}", 2, None, i) for i in range(900)] + [(1, "z", 100 + i, None, i) for i in range(90)]
    spread = [(r, n, (s, d)) for n, (s, r, d, _, _) in enumerate(rows)]
    e = spark.createDataFrame([(n, s, r, n if r != "z" else 900, d, None, 0, 0, OPEN) for r, n, (s, d) in spread], "edge_id long, src long, rel string, rel_ord long, dst long, provenance long, recorded_at long, valid_from long, valid_to long")
    w = graph.walk(e, [1], 1)
    assert [x for x, _ in w.entities] == [1, 2, *range(100, 162)] and len(w.edges) == 128
    visits, edges = graph.walk_many(e, spark.createDataFrame([(0, 1, 0)], "query_id long, entity_id long, pos int"), 1)
    assert [r["entity_id"] for r in visits.orderBy("visit").collect()] == [x for x, _ in w.entities] and edges.count() == 128


def test_depth_of_a_walk(spark):
    e = history(spark, [(n, "under", n // 2, None, 0) for n in range(2, 16)])
    f = spark.createDataFrame([(100 + i, i, 0, 0, OPEN, False) for i in range(1, 16)], "fact_id long, entity_id long, recorded_at long, valid_from long, valid_to long, tombstone boolean")
    for depth, want in ((0, {1}), (1, {1, 2, 3}), (2, set(range(1, 8))), (3, set(range(1, 16))), (20, set(range(1, 16)))):
        w = graph.walk(e, [1], depth)
        assert {x for x, _ in w.entities} == want
        assert {r["fact_id"] - 100 for r in graph.candidates(f, w, predicates.admit(1)).collect()} == want


def test_vouching_facts_come_last(spark):
    e = history(spark, [(0, "r", 1, 7, 0)])
    f = spark.createDataFrame([(7, None, 0, 0, OPEN, False), (8, 0, 0, 0, OPEN, False)], "fact_id long, entity_id long, recorded_at long, valid_from long, valid_to long, tombstone boolean")
    got = graph.candidates(f, graph.walk(e, [0], 1), predicates.admit(1)).collect()
    assert [(r["fact_id"], r["weight"]) for r in got] == [(8, 1.0), (7, 0.5)]


@pytest.mark.parametrize("as_of", [None, 50])
def test_many_walks_equal_single_ones(spark, as_of):
    rng = random.Random(4)
    e = history(spark, [(rng.randint(0, 60), rng.choice("ab"), rng.randint(0, 60), rng.choice((None, i)), i) for i in range(90)] + [(99, "hub", 1000 + i, None, i) for i in range(200)] + [(98, "to", 99, 3, 0)])
    f = spark.createDataFrame([(i, rng.randint(0, 60), i, 0, OPEN, i % 7 == 0) for i in range(300)], "fact_id long, entity_id long, recorded_at long, valid_from long, valid_to long, tombstone boolean")
    anchors = {0: [5], 1: [98, 7, 98], 2: [99], 3: [12345]}
    a = spark.createDataFrame([(q, x, i) for q, xs in anchors.items() for i, x in enumerate(xs)], "query_id long, entity_id long, pos int")
    visits, edges = graph.walk_many(e, a, 2, as_of=as_of)
    ranked = graph.candidates_many(f, visits, edges, predicates.admit(200)).collect()
    visits, edges = visits.orderBy("visit").collect(), edges.orderBy("nth").collect()
    for q, xs in anchors.items():
        one = graph.walk(e, xs, 2, as_of=as_of)
        assert [(r["entity_id"], r["weight"]) for r in visits if r["query_id"] == q] == one.entities
        assert [(r["src"], r["rel"], r["dst"], r["provenance"]) for r in edges if r["query_id"] == q] == one.edges
        want = [(r["fact_id"], r["weight"]) for r in graph.candidates(f, one, predicates.admit(200)).collect()]
        assert [(r["fact_id"], r["weight"]) for r in sorted(ranked, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_fusion_and_budget(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, fact_id long, rank int")
    b = spark.createDataFrame([(0, 2, 1)], "query_id long, fact_id long, rank int")
    got = {r["fact_id"]: r for r in fuse.rrf({1: a, 4: b}, {1: 1.0, 4: 1.0}).collect()}
    assert got[2]["sources"] == 5 and math.isclose(got[2]["score"], 1 / 62 + 1 / 61)
    ranked = spark.createDataFrame([(0, i, 1.0 - i / 10, "x" * n) for i, n in enumerate((8, 400, 8))], "query_id long, fact_id long, score double, text string")
    kept = fuse.select_within(ranked, 8, 30).collect()
    assert [r["fact_id"] for r in kept] == [0] and kept[0]["truncated"]  # stops, does not skip


def test_month_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert spark.range(1).select(fuse.month(F.lit(450 * 86_400_000)).alias("m")).first()["m"] == "1971-03"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_tag_pages_and_cursors(spark):
    c = spark.createDataFrame([("bird", 4), ("bird:owl", 1), ("birds", 2), ("fish", 9), ("Ant", 3)], "tag string, count long")
    seen, cursor = [], None
    while True:
        got = tags.list_tags(c, cursor=cursor, limit=2, store="s")
        seen += got["items"]
        if not (cursor := got["next_cursor"]):
            break
        at = cursor
    assert seen == [("Ant", 3), ("bird", 4), ("bird:owl", 1), ("birds", 2), ("fish", 9)]
    assert [t for t, _ in tags.list_tags(c, "bird:")["items"]] == ["bird:owl"]
    with pytest.raises(StaleCursor):
        tags.list_tags(c.where("tag <> 'fish'"), cursor=at, store="s")
    for wrong in ({"cursor": "?"}, {"cursor": at, "store": "other"}, {"cursor": at, "store": "s", "prefix": "b"}):
        with pytest.raises(Invalid):
            tags.list_tags(c, **wrong)
    with pytest.raises(TooLarge):
        tags.list_tags(c, limit=257)


def test_similar_ring_and_closed(spark):
    rows = [(i, 1, ["a", "b", "c"], False, OPEN) for i in range(40)] + [(40, 1, ["a", "b", "c", "d"], False, OPEN)]
    rows[39] = (39, 1, ["a", "b", "c"], False, 5)
    f = spark.createDataFrame(rows, "fact_id long, entity_id long, tokens array<string>, tombstone boolean, valid_to long").withColumn("vector", F.lit(None).cast("struct<scale:double,q:array<tinyint>,sig:array<long>>"))
    got = similar.similar(f, f.where("fact_id = 40")).orderBy("fact_id").collect()
    assert [r["fact_id"] for r in got] == list(range(9, 17)) and got[0]["score"] == 0.75


def test_entity_upsert_numbers_first_mentions(spark):
    names = spark.createDataFrame([("B b", 0), ("a", 1), ("b  B", 2), ("!", 3), ("c", 4)], "name string, ordinal long")
    known = spark.createDataFrame([("c",)], "norm_name string")
    got = {r["norm_name"]: (r["entity_id"], r["name"]) for r in write.entity_upsert(names, known=known, next_entity=5).collect()}
    assert got == {"b b": (5, "B b"), "a": (6, "a")}


def test_link_replay(spark):
    ops = [("link", 1, 10), ("link", 1, 20), ("link", 2, 30), ("unlink", None, 25), ("unlink", None, 40), ("link", 3, 50)]
    df = spark.createDataFrame([(op, 0, "r", 1, p, now, i) for i, (op, p, now) in enumerate(ops)], "op string, src long, rel string, dst long, provenance long, now long, seq long")
    got = [(r["provenance"], r["valid_from"], r["valid_to"]) for r in write.replay_links(df).orderBy("seq").collect()]
    assert got == [(1, 10, 30), (2, 30, 30), (3, 50, OPEN)]


def test_violations_are_found(spark):
    f = spark.createDataFrame([(1, ["x"], 5, 4, False, 1), (1, ["x"], 0, OPEN, False, 1)], "fact_id long, tags array<string>, valid_from long, valid_to long, tombstone boolean, entity_id long")
    e = history(spark, [(1, "r", 2, None, 0), (1, "r", 2, None, 1)])
    ents = spark.createDataFrame([(1,)], "entity_id long")
    got = {r["problem"]: r["rows"] for r in maintain.violations(f, ents, e, tags.catalogue(f).where("false")).collect()}
    assert got == {"dangling edge": 2, "open edge twice": 1, "catalogue": 1, "interval": 1, "id twice": 1}


def test_as_of_join_of_short_long_and_open_lives(spark):
    rng = random.Random(21)
    facts = []
    for i in range(400):
        begin, known = rng.randint(0, 3000), rng.randint(0, 3000)
        end = rng.choice((OPEN, begin + rng.randint(0, 40), begin + rng.randint(0, 3000)))
        facts.append((i, rng.randint(0, 5), known, begin, end, i % 11 == 0))
    probes = [(n, rng.randint(0, 6), rng.randint(-10, 3500)) for n in range(200)]
    f = spark.createDataFrame(facts, "fact_id long, entity_id long, recorded_at long, valid_from long, valid_to long, tombstone boolean")
    p = spark.createDataFrame(probes, "probe long, entity_id long, t long")
    want = sorted((e, n, t, i) for n, e, t in probes for i, x, known, begin, end, gone in facts if x == e and not gone and known <= t and begin <= t < end)
    got = sorted(tuple(r) for r in temporal.as_of_join(f, p, width=10).select("entity_id", "probe", "t", "fact_id").collect())
    assert got == want and len(want) > 1000
    assert "Cartesian" not in temporal.as_of_join(f, p)._jdf.queryExecution().toString()


def test_ranges_topk(spark):
    rng = random.Random(22)
    facts = [(i, rng.randint(0, 5000)) for i in range(500)]
    asked = [(q, a := rng.randint(-500, 5500), a + rng.choice((0, 1, 30, 900, 10**13))) for q in range(30)] + [(98, -(10**15), 10**15), (99, 7, 3)]
    got = {}
    found = temporal.ranges_topk(spark.createDataFrame(facts, "fact_id long, recorded_at long"), spark.createDataFrame(asked, "query_id long, from_ms long, to_ms long"), F.col("fact_id") % 3 != 0, k=5)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["fact_id"])
    for q, a, b in asked:
        assert got.get(q, []) == [i for _, i in sorted(((t, i) for i, t in facts if a <= t < b and i % 3), reverse=True)[:5]]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_many_vector_searches_equal_single_ones(spark):
    rng = random.Random(23)
    rows = [(i, [rng.gauss(0, 1) for _ in range(70)], i % 4) for i in range(600)]
    v = spark.createDataFrame(rows, "slot long, v array<double>, label int").select("slot", F.col("slot").alias("fact_id"), "label", quantize(F.col("v")).alias("vector"))
    v = v.unionByName(v.where("slot < 40").withColumns({"slot": F.col("slot") + 1000, "fact_id": F.col("slot") + 1000}))  # ties
    asked = v.where("slot % 97 = 0").select(F.col("slot").alias("query_id"), "vector", F.lit(3).alias("not_label"))
    for block in (None, 2):
        got = vector.flat_topk_many(v, asked, F.col("label") != F.col("not_label"), k=20, block=block).collect()
        for q in {r["query_id"] for r in asked.collect()}:
            one = vector.flat_topk(v, quantized_literal(rows[q][1]), F.col("label") != 3, k=20).collect()
            assert [(r["fact_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(r["fact_id"], pytest.approx(r["score"], abs=1e-9)) for r in one]
    assert vector.flat_topk_many(v.where("false"), asked, F.lit(True)).count() == 0 == vector.flat_topk_many(v, asked.where("false"), F.lit(True)).count()


def test_numbering(spark, monkeypatch):
    rng = random.Random(24)
    values = [rng.choice((rng.randint(-50, 50), rng.randint(-(10**12), 10**12))) for _ in range(3000)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "at long, i long")
    for size in (20_000, 1):
        monkeypatch.setattr(number, "ROWS_A_RANGE", size)
        got = {r["i"]: r["n"] for r in number.numbered(rows, ["at", "i"], "n", 7).collect()}
        assert [got[i] for _, i in sorted((v, i) for i, v in enumerate(values))] == list(range(7, 3007))
    assert number.numbered(rows.where("false"), ["at", "i"], "n", 0).count() == 0
    marks = sorted({rng.randint(0, 400) for _ in range(100)})
    probes = spark.range(-5, 410).select("id", number.range_of(F.col("id"), marks).alias("r")).collect()
    assert all(r["r"] == sum(m <= r["id"] for m in marks) for r in probes)
