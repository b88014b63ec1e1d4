import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronofact.llm import queries
from chronofact.llm._text import mix
from chronofact.llm.components import connected_components
from chronofact.llm.near_dup import BANDS, ROWS, SHINGLE, first_of_class, near_duplicates, signatures, signer

from .conftest import brute_words


def brute(docs, similarity=0.8):
    sets = {}
    for i, t in docs:
        w = brute_words(t, lower=True)
        if w:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    up = {i: i for i, _ in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and n / (len(sets[a]) + len(sets[b]) - n) >= similarity:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: top(i) for i in up}


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r["doc_id"]: r["class_id"] for r in queries.op5_near_duplicates(spark, sf).collect()} == brute(docs)


def test_a_large_group_whose_members_link_only_in_part(spark, odd):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(140)]
    texts = [" ".join(base)]
    for n in range(250):
        w = list(base)
        for at in rng.sample(range(140), rng.choice((1, 2, 3, 4, 6))):
            w[at] = f"x{rng.randint(0, 40 if n % 3 else 9999)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(odd(*texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_chains_of_edits_of_one_class(spark, odd):
    texts = []
    for n in range(40):
        a = [f"c{n}w{i}" for i in range(230)]
        b = a[:-1] + [f"c{n}y"]
        c = [f"c{n}x{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(b)]
        texts += [" ".join(x) for x in (a, b, c)]
    want = brute(list(enumerate(texts)))
    assert set(want.values()) == set(range(0, 120, 3))
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(odd(*texts)).collect()} == want


@pytest.mark.parametrize("few", [0, 10**9])
def test_pages_of_one_template(spark, odd, few):
    """Texts of many classes in the same bands, some of them linked across."""
    rng = random.Random(11)
    template, texts = [f"t{i}" for i in range(200)], []
    for n in range(120):
        own = [f"p{n}w{i}" for i in range(rng.choice((18, 20, 22, 24)))]
        texts.append(" ".join(template + own))
        if n % 4 == 0:
            texts.append(" ".join(template + own[:-2] + ["z"]))
        if n % 6 == 0:
            texts.append(" ".join(template[:150] + own + [f"q{n}r{i}" for i in range(40)]))
    for n in range(60):
        texts.append(" ".join(w if rng.random() > 0.04 else f"m{rng.randint(0, 9)}" for w in template))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(odd(*texts), few=few).collect()}
    assert got == brute(list(enumerate(texts)))


@pytest.mark.parametrize("times", [1, 20, 1000])
def test_no_link_is_lost_where_lines_repeat(spark, odd, times):
    rng, texts = random.Random(times), []
    for n in range(60):
        w = [f"r{n}w{i}" for i in range(100)]
        other = list(w)
        other[rng.randrange(10, 90)] = "x"
        texts += [" ".join(w + [f"l{n}k{i}" for i in range(8)] * times), " ".join(other + [f"l{n}k{i}" for i in range(8)])]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(odd(*texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_repeated_lines_do_not_part_near_copies():
    texts = []
    for n in range(100):
        w = [f"r{n}w{i}" for i in range(100)]
        texts += [" ".join(w), " ".join(w[:30] * 20 + w[30:])]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts})
    keys = [set(k) for b in signer(SHINGLE, BANDS, ROWS)([batch]) for k in b.column("keys").to_pylist()]
    assert all(keys[i] & keys[i + 1] for i in range(0, 200, 2))


def test_registers_agree_as_often_as_sets_overlap():
    a = mix(np.arange(1, 2001, dtype=np.uint64))
    text = np.repeat([0, 1], [1800, 1800])
    sig = signatures(text, np.concatenate([a[:1800], a[200:]]), np.ones(3600), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - 1600 / 2000) < 0.03


def test_edges(spark, odd):
    d = odd(None, "", " ", "one two", "One  two", "one two three", "A b c d e f g h i j", "a b c d e f g h i j", "a b c d e f g h i j" * 3000)
    d = d.unionByName(d.where("doc_id = 7")).unionByName(d.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    got = [(r["doc_id"], r["class_id"]) for r in near_duplicates(d).collect()]
    assert sorted(got, key=str) == sorted([(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (7, 6), (8, 8), (None, None)], key=str)
    kept = first_of_class(d)
    assert kept.columns == d.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([0, 1, 2, 3, 5, 6, 8, None], key=str)
    assert near_duplicates(d.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)] + [(200 + i, 200) for i in range(1, 50)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
