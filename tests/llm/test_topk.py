import math
import random

from pyspark.sql import functions as F

from chronofact.llm import queries
from chronofact.llm.topk import integers, top_k


def brute(rows, wanted, k=10):
    vs = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in vs:
        if q in wanted:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vs if i != q and len(w) == len(v)))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def got(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()}


def test_query_against_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(queries.op7_top_k(spark, sf)) == brute(rows, {i for i, _ in rows if i % 100 == 0})


def test_blocks_shards_and_ties(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-1.0, 0.0, 0.5)) for _ in range(3)]) for i in range(700)] + [(1000 + i, [1.0, 1.0]) for i in range(5)]
    v = integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    q = v.where("vec_id % 50 = 0")
    assert got(top_k(v, q, k=7, block=4, shard_rows=150)) == brute(rows, {i for i, _ in rows if i % 50 == 0}, 7)


def test_queries_outside_the_candidates(spark):
    rng = random.Random(3)
    vs = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(240)]
    v = integers(spark.createDataFrame(vs, "vec_id long, embedding array<double>"))
    want = set()
    for q in range(40):
        own = [vs[q], *vs[40:]]
        want |= {r for r in brute(own, {q}) if r[2] >= 40}
    assert len(want) == 400 and got(top_k(v.where("vec_id >= 40"), v.where("vec_id < 40"), block=7, shard_rows=50)) == want
    assert top_k(v.where("false"), v).count() == 0


def whole(vs, q, k):
    best = sorted((-sum(a * b for a, b in zip(vs[q], w)), i) for i, w in vs.items() if i != q)[:k]
    return {(q, n + 1, i, max(-(2**63), min(-s, 2**63 - 1))) for n, (s, i) in enumerate(best)}


def test_scores_past_doubles_and_longs(spark):
    rng = random.Random(4)
    for bits in (20, 29, 30, 40, 62):
        vs = {i: [rng.randint(-(2**bits), 2**bits) for _ in range(4)] for i in range(400)}
        vs |= {400 + i: [2**bits - i % 3, 1, 0, 0] for i in range(40)}
        v = spark.createDataFrame(list(vs.items()), "vec_id long, v array<long>")
        assert got(top_k(v, v.where("vec_id in (0, 7, 405)"), shard_rows=150)) == set().union(*(whole(vs, q, 10) for q in (0, 7, 405)))
    vs = {0: [2**31, 2**31], 1: [2**30, -1], 2: [2**30, -1], 3: [2**30, 0]}
    v = spark.createDataFrame(list(vs.items()), "vec_id long, v array<long>")
    assert got(top_k(v, v.where("vec_id = 0"), k=2)) == whole(vs, 0, 2)


def test_ties_among_repeated_ids_and_long_vectors(spark):
    rows = [(i % 7, [float(i % 3)] * 300) for i in range(60)] + [(9, [1.0] * 300)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = integers(d.withColumn("query_id", F.lit("x")).withColumn("rank", F.lit(1)))
    rest = sorted((-1024 * 1024 * 300 * (i % 3), i % 7) for i in range(60))[:10]
    assert got(top_k(v, v.where("vec_id = 9"), shard_rows=8)) == {(9, n + 1, i, -s) for n, (s, i) in enumerate(rest)}


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (None, [1.0, 1.0]), (1, [float("inf"), 1.0]), (2, [3.0, 3.0]), (3, [1.0]), (400, []), (500, [1e6, -1e6])]
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, v string")
    v = integers(d)
    assert got(top_k(v, v.where("vec_id % 100 = 0"))) == brute(rows, {0, 400, 500})
    assert top_k(v.where("false"), v.where("false")).count() == 0
    twice = v.unionByName(v.where("vec_id in (0, 2)"))
    assert sorted((r["rank"], r["vec_id"]) for r in top_k(twice, twice.where("vec_id = 0")).collect()) == [(1, 2), (2, 2), (3, 500)]
