import zlib

import numpy as np
from pyspark.sql import functions as F

from chronofact.llm import queries
from chronofact.llm.quality import score as quality_score
from chronofact.llm.quality import strengths
from chronofact.llm.toxicity import drop_toxic, fit, score
from chronofact.llm.trees import BoostedTrees, Isotonic, Logistic

BIG = "/root/testdata/sf0.1"


def auc(y, s):
    r = np.empty(len(s))
    order = np.argsort(s, kind="stable")
    r[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        r[s == v] = r[s == v].mean()
    return (r[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = BoostedTrees().fit(x[:1500], y[:1500]).margin(x[1500:])
    assert auc(y[1500:], m) > 0.97
    p = Isotonic().fit(m, y[1500:]).predict(np.sort(m))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1
    assert auc((x[:, 0] > 0.3).astype(float), Logistic().fit(x, (x[:, 0] > 0.3).astype(float)).margin(x)) > 0.99


def test_toxicity_held_out(spark):
    rows = queries.op6_toxicity(spark, BIG).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    out = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    y, s, p = (np.array(v, float) for v in zip(*out))
    assert auc(y, s) > 0.95 and y[p == 1].mean() > 0.95 and p[y == 1].mean() > 0.75


def test_toxicity_edges(spark, odd):
    d = odd(None, "", "you are a stupid worthless idiot", "a kind word", "x" * 200_000)
    d = d.unionByName(d.where("doc_id = 2")).unionByName(d.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(None, 1), (2, None), (3, 0)], "doc_id long, toxic int")
    for ls in (labels, labels.where("false")):
        got = score(d, fit(d, ls)).collect()
        assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert drop_toxic(d, fit(d, labels)).columns == d.columns
    assert score(d.where("false"), fit(d.where("false"), labels)).count() == 0


def test_quality_held_out(spark, sf):
    d, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    other = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = quality_score(d, labels.where(~other)).collect()
    unseen = {r["doc_id"]: r["quality"] for r in labels.where(other).collect()}
    y, s, keep = (np.array(v, float) for v in zip(*[(unseen[r["doc_id"]], r["score"], r["keep"]) for r in rows if r["doc_id"] in unseen]))
    assert len(rows) == 10_000 and len(y) > 1000 and auc(y, s) > 0.97 and keep[y == 1].mean() > 0.99 and keep[y == 0].mean() < 0.15


def brute_quality(docs, known, weight=0.3):
    """Posteriors and scores from each document's (host, path, evidence)."""
    p = np.array([round(1e6 * known.get(i, e)) / 1e6 for i, _, _, e in docs])
    n, mean, one = len(docs), p.mean(), 0.0
    by_host, by_path = {}, {}
    for k, (_, h, q, _) in enumerate(docs):
        by_host.setdefault(h, []).append(k)
        by_path.setdefault((h, q), []).append(k)
    one = sum(((p[a] - p[a].mean()) ** 2).sum() for a in by_path.values()) / (n - len(by_path))
    between = sum(len(a) * (p[a].mean() - p[by_host[h]].mean()) ** 2 for (h, _), a in by_path.items())
    share = sum(len(a) ** 2 / len(by_host[h]) for (h, _), a in by_path.items())
    path = max(0, (between - (len(by_path) - len(by_host)) * one) / (n - share))
    between = sum(len(a) * (p[a].mean() - mean) ** 2 for a in by_host.values())
    host = max(0, (between - (len(by_host) - 1) * one - (share - sum(len(a) ** 2 for a in by_path.values()) / n) * path) / (n - sum(len(a) ** 2 for a in by_host.values()) / n))
    kh, kp = (min(max(one / v, 1), 1e9) if v else 1e9 for v in (host, path))
    out = {}
    for k, (i, h, q, e) in enumerate(docs):
        a, b = by_host[h], by_path[h, q]
        hp = (p[a].sum() - p[k] + kh * mean) / (len(a) - 1 + kh)
        pp = (p[b].sum() - p[k] + kp * hp) / (len(b) - 1 + kp)
        out[i] = hp, pp, 1 / (1 + np.exp(-(np.log(e / (1 - e)) + weight * (np.log(pp / (1 - pp)) - np.log(mean / (1 - mean))))))
    return out, kh, kp


def test_quality_against_brute_force(spark, sf):
    d, labels = (spark.read.parquet(f"{BIG}/{t}.parquet").where("doc_id < 3000") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_score(d, labels).collect()}
    docs = [(r["doc_id"], r["source"], r["lang"], got[r["doc_id"]]["evidence"]) for r in d.collect()]
    want, of_host, of_path = brute_quality(docs, {r["doc_id"]: float(r["quality"]) for r in labels.collect()})
    assert of_host > 1 and of_path > 1
    for i, (h, p, s) in want.items():
        assert abs(got[i]["host_posterior"] - h) < 1e-4 and abs(got[i]["path_posterior"] - p) < 1e-4 and abs(got[i]["score"] - s) < 1e-3


def test_quality_shrinks_sparse_sites(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "big" if i else "tiny", "en") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 0 if i == 0 else 1) for i in range(200)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_score(d, labels, host_strength=50, path_strength=50).collect()}
    mean = 199 / 200
    assert abs(got[0]["host_posterior"] - mean) < 1e-6  # its own label says nothing of its site
    assert abs(got[1]["host_posterior"] - (198 + 50 * mean) / 248) < 1e-6
    assert abs(got[1]["path_posterior"] - (198 + 50 * got[1]["host_posterior"]) / 248) < 1e-6


def test_quality_strengths_follow_the_sites(spark):
    rng = np.random.default_rng(5)

    def of(spread):
        rows = [(h, p, rng.random() < q) for h in range(60) for q in [np.clip(0.5 + spread * rng.normal(), 0.02, 0.98)] for p in range(3) for _ in range(20)]
        d = spark.createDataFrame([(f"h{h}", f"p{p}", float(y)) for h, p, y in rows], "host string, path string, y double")
        return strengths(d.groupBy("host", "path").agg(F.sum("y").alias("sum"), F.sum("y").alias("squares"), F.count("*").alias("n")))

    alike, unlike = of(0.0), of(0.3)
    assert alike[1] > 50 and unlike[1] < 10 and unlike[2] > 50
    empty = spark.createDataFrame([], "host string, path string, sum double, squares double, n long")
    assert strengths(empty) == (0.5, 1e9, 1e9)


def test_quality_edges(spark, odd):
    d = odd(None, "", "a b", "a b", "long word " * 100_000).withColumn("source", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    got = quality_score(d, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality_score(d.where("false"), labels.where("false")).count() == 0
