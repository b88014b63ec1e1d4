"""Document quality by hierarchical empirical Bayes.

A logistic classifier over features of the whole text gives each document
evidence of its own.  Hosts and the paths under them get posteriors from
grouped sums: a host's mean is shrunk toward the global mean, a path's toward
its host's, each by as many pseudo-documents as the data call for: the variance
inside paths over the variance between sites, both estimated by moments from
the grouped sums.  Where sites do not differ they say nothing; where they do,
sparse ones say little.  Labels, where there are any, count as documents of
known quality in these sums, and a document's own part is taken out of the
posteriors that it is judged by.  Its score adds to its own logit
``site_weight`` times its path's shift from the global logit.  Sums are partial
before the shuffle and the posteriors are a written table, so one large host is
neither gathered nor repeated.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Hasher, byte_class, not_space, slices
from .store import saved
from .trees import Logistic

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_ROWS, THRESHOLD = 20_000, 0.5
STRENGTHS = 1.0, 1e9
UNIT = 1e6  # sums are of whole millionths, so they do not depend on the order of rows
NAMES = "words symbols capitals digits bars distinct word_length long_words repeated shouted".split()


class Features:
    def __init__(self):
        self.hasher = Hasher(not_space(), fold_case=False)
        self.symbol = byte_class((0x21, 0x21), (0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
        self.upper, self.lower = byte_class((0x41, 0x5A)), byte_class((0x61, 0x7A))
        self.digit, self.bar = byte_class((0x30, 0x39)), byte_class((0x7C, 0x7C))

    def of(self, data, offs):
        n = len(offs) - 1
        w = self.hasher.words(data, offs)
        words = np.diff(w.bounds).astype(float)
        many, size = np.maximum(words, 1), np.maximum(np.diff(offs), 1)
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[data])])[offs]).astype(float)
        order = np.lexsort((w.hash, w.text_of))
        t, h = w.text_of[order], w.hash[order]
        new = np.ones(len(h), bool)
        new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
        distinct = np.bincount(t[new], minlength=n) / many
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text_of[1:] == w.text_of[:-1])
        length = w.ends - w.starts
        caps, small = count(self.upper), count(self.lower)
        loud = np.cumsum(np.concatenate([[0], self.upper[data]]))
        quiet = np.cumsum(np.concatenate([[0], self.lower[data]]))
        shouted = (loud[w.ends] - loud[w.starts] > 0) & (quiet[w.ends] == quiet[w.starts])
        per = lambda x: np.bincount(w.text_of, x, n)
        return np.column_stack([
            np.log1p(words), np.minimum(count(self.symbol) / many, 4), caps / np.maximum(caps + small, 1), count(self.digit) / size,
            np.minimum(count(self.bar) / many, 1), distinct, np.minimum(per(length) / many, 20), per(length > 20) / many, per(same) / many, per(shouted) / many,
        ])


def featurise(carry, model=None):
    """Columns ``carry`` and x, or with a model its ``logit``."""

    def run(batches):
        features = Features()
        for b in batches:
            rows = [features.of(data, offs) for _, data, offs in slices(b.column("text"))]
            x = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))
            last = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64())) if model is None else pa.array(np.clip(model.margin(x), -12, 12))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), last], names=[*carry, "x" if model is None else "logit"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Logistic:
    """The document classifier, from at most ``max_rows`` labelled rows by the
    order of a hash of their ids; of several labels of one id the least.  Without
    labels it says 1/2."""
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("y"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y"))
    ids = saved(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = d.join(F.broadcast(ids), "doc_id").mapInArrow(featurise(["doc_id", "y"]), "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(NAMES)))
    return Logistic().fit(x, rows["y"].to_numpy(float))


def strengths(paths: DataFrame) -> tuple[float, float, float]:
    """(global mean, pseudo-documents of a host, of a path) from ``paths``
    (host, path, sum, squares, n).

    Nested analysis of variance: what is left inside paths estimates the
    variance of one document, the excess between paths of a host and between
    hosts that of the sites.
    """
    hosts = paths.groupBy("host").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.sum(F.col("sum") * F.col("sum") / F.col("n")).alias("between"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum("squares").alias("squares"), F.count("*").alias("paths"))
    r = hosts.agg(
        F.sum("sum").alias("s"), F.sum("n").alias("n"), F.sum("squares").alias("q"), F.sum("paths").alias("paths"), F.count("*").alias("hosts"), F.sum("between").alias("in_paths"),
        F.sum(F.col("sum") * F.col("sum") / F.col("n")).alias("in_hosts"), F.sum(F.col("nn") / F.col("n")).alias("c"), F.sum("nn").alias("nn"), F.sum(F.col("n").cast("double") * F.col("n")).alias("hh"),
    ).first()
    if not r["n"]:
        return 0.5, STRENGTHS[1], STRENGTHS[1]
    n, mean = float(r["n"]), r["s"] / r["n"]
    one = max(r["q"] - r["in_paths"], 0.0) / max(n - r["paths"], 1)
    path = (r["in_paths"] - r["in_hosts"] - (r["paths"] - r["hosts"]) * one) / max(n - r["c"], 1e-9)
    path = max(path, 0.0) if r["paths"] > r["hosts"] else 0.0
    host = (r["in_hosts"] - r["s"] * mean - (r["hosts"] - 1) * one - (r["c"] - r["nn"] / n) * path) / max(n - r["hh"] / n, 1e-9)
    host = max(host, 0.0) if r["hosts"] > 1 else 0.0
    count = lambda between: float(np.clip(one / between if between > 0 else np.inf, *STRENGTHS))
    return min(max(mean, 1e-4), 1 - 1e-4), count(host), count(path)


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", host_strength: float | None = None, path_strength: float | None = None, site_weight: float = 0.3, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, score, keep) for each row.

    Strengths are pseudo-documents; those not given are estimated, between 1 and
    10**9.  Null hosts and paths are groups of their own; a null or empty text
    is scored as a text without words.  Repeated rows stay, each of them a
    document.  Other columns of either table are ignored, whatever their names.
    """
    model = fit(docs, labels, max_rows)
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.coalesce(docs[host].cast("string"), F.lit("")).alias("host"), F.coalesce(docs[path].cast("string"), F.lit("")).alias("path"))
    logit = saved(d.mapInArrow(featurise(["doc_id", "host", "path"], model), "doc_id long, host string, path string, logit double"))
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y"))
    p = F.round(UNIT * F.coalesce("y", 1 / (1 + F.exp(-F.col("logit"))))).cast("long")
    rows = saved(logit.join(known, "doc_id", "left").select("doc_id", "host", "path", "logit", p.alias("p")))
    square = F.round(F.col("p") * F.col("p") / UNIT).cast("long")
    paths = rows.groupBy("host", "path").agg(F.sum("p").alias("sum"), F.sum(square).alias("squares"), F.count("*").alias("n"))
    paths = saved(paths.withColumns({"sum": F.col("sum") / UNIT, "squares": F.col("squares") / UNIT}))
    mean, of_host, of_path = strengths(paths)
    of_host = of_host if host_strength is None else host_strength
    of_path = of_path if path_strength is None else path_strength
    hosts = paths.groupBy("host").agg(F.sum("sum").alias("host_sum"), F.sum("n").alias("host_n"))
    sites = saved(paths.join(hosts, "host").select("host", "path", "sum", "n", "host_sum", "host_n"))
    own = F.col("p") / UNIT
    host_p = (F.col("host_sum") - own + of_host * mean) / (F.col("host_n") - 1 + of_host)
    path_p = (F.col("sum") - own + of_path * F.col("host_posterior")) / (F.col("n") - 1 + of_path)
    out = rows.join(sites, ["host", "path"]).withColumn("host_posterior", host_p).withColumn("path_posterior", path_p)
    held = F.greatest(F.least("path_posterior", F.lit(1 - 1e-4)), F.lit(1e-4))
    shift = F.ln(held / (1 - held)) - float(np.log(mean / (1 - mean)))
    out = out.withColumn("score", F.round(1 / (1 + F.exp(-(F.col("logit") + site_weight * shift))), 9))
    return out.select("doc_id", F.round(1 / (1 + F.exp(-F.col("logit"))), 9).alias("evidence"), F.round("host_posterior", 9).alias("host_posterior"), F.round("path_posterior", 9).alias("path_posterior"), "score", (F.col("score") >= threshold).alias("keep"))
