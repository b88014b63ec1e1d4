"""Near-duplicates by ProbMinHash, banding and verification.

A text's shingles are its distinct runs of five words (fewer words: all of
them), each of weight 1, as links are of plain sets.  A shingle is a Poisson
process whose rate is its weight; each arrival falls on one of the registers at random, and a
register keeps the shingle that arrives first.  A shingle's process is stopped
as soon as its next arrival is later than every register's first, so most end
after one arrival.  Two texts agree in a register with the Jaccard similarity
of their shingle sets.

Registers are joined into bands; texts that share a band are candidates.  Links
are verified on whole shingle sets: |A and B| / |A or B| >= ``similarity``.
All pairs of a band are never formed.  First each is compared with the text of
smallest id only, and linked texts become one class.  Where a band still holds
several classes, bounds strike out the texts that cannot link to another class
of it, again and again while that thins them out.  Of texts that are alike
enough the rarest shingles of each must have one in common: pairs are formed
inside bands or inside groups of texts with such a shingle, whichever are fewer.
"""

import hashlib
import itertools
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import Hasher, grams, mix, not_space, signed, slices, whole
from .components import connected_components
from .store import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 48, 7
FEW = 16  # pairs for each row of a band, up to which they are formed without more ado


def shingles(words, k):
    """(text, shingle) of each text's distinct shingles."""
    at = whole(words, k)
    text, g = words.text_of[at], grams(words.hash, k)[at]
    counts = np.diff(words.bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    for n in range(1, k):
        own = short[counts[short] == n]
        if len(own):
            text = np.concatenate([text, own])
            g = np.concatenate([g, grams(words.hash, n, seed=n)[words.bounds[own]]])
    order = np.lexsort((g, text))
    text, g = text[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (text[1:] != text[:-1]) | (g[1:] != g[:-1])
    return text[new], g[new]


def signatures(text, shingle, weight, n, registers):
    """An n x registers matrix of the shingles that arrive first."""
    q = np.full(n * registers, np.inf)
    sig = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(shingle))
    live = np.arange(len(shingle))
    most = np.full(n, np.inf)
    for i in itertools.count(1):
        u = mix(shingle[live] + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        t = time[live] - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        early = t < most[text[live]]
        live, t, u = live[early], t[early], u[early]
        if not len(live):
            return sig.reshape(n, registers)
        time[live] = t
        slot = text[live] * registers + ((mix(u ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(q, slot, t)
        won = q[slot] == t
        sig[slot[won]] = shingle[live[won]]
        own = np.unique(text[live])
        most[own] = q.reshape(n, registers)[own].max(1)


def signer(k, bands, rows):
    def run(batches):
        hasher = Hasher(not_space())
        for b in batches:
            for row, data, offs in slices(b.column("text")):
                n = len(offs) - 1
                text, g = shingles(hasher.words(data, offs), k)
                size = np.bincount(text, minlength=n)
                sig = signatures(text, g, np.ones(len(g)), n, bands * rows)
                band = np.full((n, bands), 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    band = mix(band * np.uint64(0xD1342543DE82EF95) + sig[:, r * bands : (r + 1) * bands])
                raw = memoryview(data)
                md5 = [hashlib.md5(raw[x:y]).digest() for x, y in itertools.pairwise(offs.tolist())]
                has = size > 0
                ends = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(band[has].ravel())))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, n), pa.array(md5, pa.binary()), pa.array(size.astype(np.int32)), keys], names=["doc_id", "md5", "size", "keys"])

    return run


def verifier(k, similarity):
    def run(batches):
        hasher = Hasher(not_space())
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = []
                for side in ("text_a", "text_b"):
                    rows = []
                    for row, data, offs in slices(part.column(side)):
                        t, g = shingles(hasher.words(data, offs), k)
                        rows.append((t + row, g))
                    sets.append([np.concatenate(x) for x in zip(*rows)])
                n = part.num_rows
                row, g = (np.concatenate(x) for x in zip(*sets))
                order = np.lexsort((g, row))
                row, g = row[order], g[order]
                twice = np.flatnonzero((row[1:] == row[:-1]) & (g[1:] == g[:-1]))
                common = np.bincount(row[twice], minlength=n)
                union = np.bincount(row, minlength=n) - common
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(common.astype(np.int32)), pa.array((common > 0) & (common / np.maximum(union, 1) >= similarity))], names=["a", "b", "common", "linked"])

    return run


def exploded(k):
    def run(batches):
        hasher = Hasher(not_space())
        for b in batches:
            for row, data, offs in slices(b.column("text")):
                t, g = shingles(hasher.words(data, offs), k)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row + t)), pa.array(signed(g))], names=["doc_id", "shingle"])

    return run


def compared(pairs: DataFrame, d: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b, common, linked) of ``pairs`` (a, b): the shingles that both texts
    have, and whether they reach the similarity."""
    b = d.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    a = d.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = saved(pairs).join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return saved(both.mapInArrow(verifier(k, similarity), "a long, b long, common int, linked boolean"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, few: int = FEW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of every row: ``class_id`` is the smallest id that
    links of at least ``similarity``, or equality, lead to.

    Words are lower-cased (A-Z) runs between white space.  Texts without words,
    null ones too, are alike to nothing and each a class.  Rows without an id
    get a null class.  Repeated rows stay, in one class; an id should stand for
    one text.  Other columns are ignored, whatever their names.  ``few`` decides
    how pairs are formed, not which texts are linked.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    ids = d.select("doc_id")
    d = d.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sig = saved(d.mapInArrow(signer(k, bands, rows), "doc_id long, md5 binary, size int, keys array<long>")).where("size > 0")
    groups = saved(sig.groupBy("md5").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("md5", "first"))
    copies = saved(sig.select("doc_id", "md5").join(groups, "md5").where("doc_id > first").select("doc_id", "first").distinct())
    reps = sig.join(copies.select("doc_id"), "doc_id", "left_anti")
    buckets = saved(reps.select("doc_id", "size", F.explode("keys").alias("key")))
    stars = buckets.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"), F.min_by("size", "doc_id").alias("size_a"), F.min("size").alias("least"))
    stars = saved(stars.where("a < last").select("key", "a", "size_a", "least"))
    shared = buckets.join(stars, "key")
    fits = F.least("size", "size_a") >= F.greatest("size", "size_a") * similarity - 1e-9
    pairs = shared.where(F.col("doc_id") > F.col("a")).where(fits).select("a", F.col("doc_id").alias("b")).distinct()
    seen = compared(pairs, d, k, similarity)
    links = seen.where("linked").select("a", "b")
    links = links.unionByName(crossing(shared, seen, d, k, similarity, few))
    label = connected_components(links)
    # A copy takes its text's class; a text without links is its own.
    of_copy = copies.join(label.withColumnRenamed("id", "first"), "first", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "first").alias("component"))
    label = saved(label.unionByName(of_copy))
    return ids.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))


def crossing(shared, seen, d, k, similarity, few=FEW) -> DataFrame:
    """Links (a, b) across the classes that a band still holds when each of its
    texts has been compared (``seen``) with the band's first text.

    ``shared``: (key, doc_id, size, a, size_a, least) of bands of several texts,
    where ``a`` is the first and ``least`` the size of the smallest set.  Bounds
    strike texts out, each from counts of its own and two numbers of its band:

    * A text of which only m shingles stand in other classes too shares at most
      m with a text of another class, which has at least ``least``.
    * Let D be what a text and the first do not have in common, d its size.
      Two texts differ in d + d' - 2 |D and D'| shingles, which may be at most
      f (size + size'), f = (1 - similarity) / (1 + similarity).  Of u shingles
      that neither the first nor another text has, all lie in D and none in D'.
      So s = d - 2 u + f size of the one must not be less than t = d - f size of
      the other, both ways round.
    """
    f = (1 - similarity) / (1 + similarity)
    label = connected_components(seen.where("linked").select("a", "b"))
    met = seen.select("a", F.col("b").alias("doc_id"), "common")
    rows = saved(shared.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    rows = of_several(rows)
    grams = exploded_of(rows, d, k)
    own = grams.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last").groupBy("doc_id").agg(F.count("*").alias("own"))
    # The first text has been compared with all that fit it in size.
    rows = foreign_enough(rows, grams, similarity).where("doc_id <> a")
    rows = rows.join(saved(own), "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(0))).join(saved(met), ["a", "doc_id"], "left")
    differ = F.col("size") + F.col("size_a") - 2 * F.col("common")
    # Texts too unlike in size to be compared with the first get no bound.
    s = F.coalesce(differ - 2 * F.col("own") + f * F.col("size"), F.lit(1e18))
    t = F.coalesce(differ - f * F.col("size"), F.lit(-1e18))
    rows = saved(rows.select("key", "doc_id", "size", "least", "component", s.alias("s"), t.alias("t")))
    band = rows.groupBy("key").agg(F.min(F.struct("t", "component")).alias("low"), F.max(F.struct("s", "component")).alias("high"))
    rows = saved(rows.join(saved(band), "key"))
    other = rows.groupBy("key").agg(F.min(F.when(F.col("component") != F.col("low.component"), F.col("t"))).alias("low2"), F.max(F.when(F.col("component") != F.col("high.component"), F.col("s"))).alias("high2"))
    rows = rows.join(saved(other), "key")
    low = F.when(F.col("component") != F.col("low.component"), F.col("low.t")).otherwise(F.col("low2"))
    high = F.when(F.col("component") != F.col("high.component"), F.col("high.s")).otherwise(F.col("high2"))
    rows = of_several(saved(rows.where((F.col("s") >= low - 1e-6) & (F.col("t") <= high + 1e-6)).select("key", "doc_id", "size", "least", "component", "s", "t")))
    pairs = None
    while pairs is None:
        n, many = in_classes(rows)
        if many > few * n:
            grams = exploded_of(rows, d, k)
            left = of_several(saved(foreign_enough(rows, grams, similarity)))
            if left.count() <= 0.8 * n:
                rows = left
                continue
            first = rarest(grams, similarity)
            if in_classes(first)[1] < many:
                pairs = group_pairs(first, similarity)
        if pairs is None:
            pairs = group_pairs(rows, similarity, (F.col("s_a") >= F.col("t_b") - 1e-6) & (F.col("s_b") >= F.col("t_a") - 1e-6))
    return compared(pairs.distinct(), d, k, similarity).where("linked").select("a", "b")


def of_several(rows):
    """``rows`` of bands that hold several classes, with the least size there."""
    several = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("size").alias("least")).where("x < y").select("key", "least")
    return saved(rows.drop("least").join(saved(several), "key"))


def in_classes(rows):
    """(rows, pairs of one band and different classes), from sums by class."""
    one = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    band = one.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"))
    got = band.agg(F.sum("n").alias("n"), F.sum((F.col("n").cast("double") * F.col("n") - F.col("nn")) / 2).alias("pairs")).first()
    return got["n"] or 0, got["pairs"] or 0.0


def exploded_of(rows, d, k):
    """(doc_id, component, size, shingle) of the texts of ``rows``."""
    texts = saved(rows.groupBy("doc_id").agg(F.first("component").alias("component"), F.first("size").alias("size")))
    grams = d.join(texts.select("doc_id"), "doc_id", "left_semi").mapInArrow(exploded(k), "doc_id long, shingle long").distinct()
    return saved(grams.join(texts, "doc_id").select("doc_id", "component", "size", "shingle"))


def foreign_enough(rows, grams, similarity):
    """``rows`` of texts that share enough with other classes to link to one."""
    classes = grams.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("shingle")
    most = grams.join(classes, "shingle", "left_semi").groupBy("doc_id").agg(F.count("*").alias("most"))
    m = F.col("most")
    return rows.join(saved(most), "doc_id").where(m / (F.greatest(m, "least") + F.col("size") - m) >= similarity - 1e-9).drop("most")


def rarest(grams, similarity):
    """(key, doc_id, size, component), ``key`` one of the rarest shingles of each
    text.  Of two texts that are alike enough, the one with n shingles shares at
    least similarity * n, so one shared shingle is among its first
    n - similarity * n + 1, in any order that is the same for all texts."""
    spread = grams.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("x"), F.max("component").alias("y"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "shingle"))
    first = grams.join(saved(spread), "shingle").withColumn("rank", rank)
    first = first.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).where("x < y")
    return saved(first.select(F.col("shingle").alias("key"), "doc_id", "size", "component"))


def group_pairs(rows, similarity, also=None):
    """(a, b) of one ``key`` and different classes that fit each other in size."""
    side = lambda x: rows.select("key", F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c not in ("key", "doc_id")])
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-9
    pairs = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & fits)
    return (pairs if also is None else pairs.where(also)).select("a", "b")


def first_of_class(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without rows whose id is not their class's smallest; rows
    without an id stay."""
    found = near_duplicates(docs, **options)
    gone = saved(found.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
