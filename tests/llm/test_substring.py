import hashlib

import pytest
from pyspark.sql import functions as F

from chronofact.llm import queries
from chronofact.llm.substring import level_lengths, remove_repeats

from .conftest import brute_words


def brute(docs, window):
    first, out = {}, {}
    for i, t in docs:
        w = brute_words(t)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, i), i)
    for i, t in docs:
        w, gone = brute_words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, 13)
    got = queries.op2_substring_dedup(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("window", [3, 8, 13, 40])
def test_windows_of_any_length(spark, odd, window):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), "x " + " ".join(base[5:50]), " ".join(base[:20] + ["y"] + base[21:]), " ".join(base * 2), "a " * 50, "a " * 45, " ".join(base)]
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept"]) for r in remove_repeats(odd(*texts), window).collect()}
    assert got == brute(list(enumerate(texts)), window)


def test_levels():
    assert level_lengths(13) == [7, 13] and level_lengths(50) == [7, 14, 28, 50] and level_lengths(5) == [5, 5] and level_lengths(1) == [1, 1]


def test_edges(spark, odd):
    long = " ".join(f"v{i}" for i in range(20_000))
    d = odd(None, "", "  ", "short", "short", long, "é\u00a0ü\u2003 " * 13, "é\u00a0ü\u2003 " * 13, long)
    d = d.unionByName(d.where("doc_id = 5")).unionByName(d.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    got = remove_repeats(d).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_words"], sum(s["end"] - s["start"] for s in r["removed"])))
    assert by[0] == by[1] == by[2] == [(0, 0)] and by[3] == by[4] == [(1, 0)]
    assert by[5] == [(20_000, 0)] * 2 and by[8] == [(20_000, 20_000)] and by[None] == [(20_000, 0)]
    assert by[6] == [(13, 0)] and by[7] == [(13, 13)]
    assert remove_repeats(d.where("false")).count() == 0
