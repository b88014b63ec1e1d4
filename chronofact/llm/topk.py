"""Exact top-k inner-product search with a KD-tree over each shard of vectors.

Queries are taken in blocks of ``BLOCK_BYTES``, in the order of their ids; a
block is small whatever the table, and one scan of the candidates serves a whole
block.  A task cuts its candidates into shards of at most
``shard_rows``, builds a tree by median splits of the widest dimension with
tight bounding boxes, and searches it best first: a box's bound is the largest
inner product that any point in it could have with the query, and the search of
a tree ends when the best bound left is below the query's k-th score.  That
score is handed on from shard to shard, and starts, for every task alike, from
the k-th score among ``SEEDS`` of the candidates.  Boxes that can still tie are
opened, since ties go to the smaller id.

Numbers are whole.  They are held as doubles where those hold every product
exactly, else as 64-bit integers, else as Python's, so scores are exact
whatever their size.
"""

import decimal
import heapq
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES, SHARD_ROWS, LEAF = 1 << 24, 16_384, 128
SEEDS, AT_ONCE = 1024, 2048
SCORE_MOST = 10**38 - 1
LONG = np.iinfo(np.int64)


def number_type(a, b):
    """A type that holds every inner product of rows of ``a`` and ``b`` exactly."""
    most = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    product = most(a) * most(b) * max(a.shape[1], 1)
    return np.float64 if product < 1 << 53 else np.int64 if product < 1 << 63 else object


def whole_numbers(scores):
    return scores.astype(np.int64) if scores.dtype == np.float64 else scores


class Tree:
    """``points`` reordered so that each node's are a run; children of a node
    stand at ``child`` and ``child + 1``, and a leaf has none (0)."""

    def __init__(self, ids, points):
        order, self.lo, self.hi, self.span, self.child = np.arange(len(ids)), [], [], [], []
        todo = [(0, len(ids))]
        at = 0
        while at < len(todo):
            a, b = todo[at]
            own = points[order[a:b]]
            lo, hi = own.min(0), own.max(0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.span.append((a, b))
            wide = int((hi.astype(float) - lo.astype(float)).argmax()) if own.shape[1] else 0
            if b - a > LEAF and own.shape[1] and hi[wide] > lo[wide]:
                m = (b - a) // 2
                column = own[:, wide]
                order[a:b] = order[a:b][np.argsort(column, kind="stable") if column.dtype == object else np.argpartition(column, m)]
                self.child.append(len(todo))
                todo += [(a, a + m), (a + m, b)]
            else:
                self.child.append(0)
            at += 1
        self.lo, self.hi = np.stack(self.lo), np.stack(self.hi)
        self.ids, self.points = ids[order], points[order]

    def bounds(self, queries):
        """The largest inner product of each query with each node's box."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T


class Best:
    """The k best (score, id) so far of one query; ``least``: what a score must
    reach, a Python integer, or None."""

    __slots__ = ("k", "scores", "ids", "least")

    def __init__(self, k, least):
        self.k, self.scores, self.ids, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), least

    def short_of(self, bound):
        return self.least is not None and bound < self.least

    def offer(self, scores, ids):
        scores = whole_numbers(scores)
        if self.least is not None:
            good = scores >= self.least if LONG.min <= self.least <= LONG.max else scores.astype(object) >= self.least
            if not good.any():
                return
            scores, ids = scores[good], ids[good]
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        # ~s falls as s rises and, unlike -s, is there for the least long too.
        order = np.lexsort((i, ~s))[: self.k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[: self.k], int)
        self.scores, self.ids = s[order], i[order]
        if self.k and len(order) == self.k:
            least = int(self.scores[-1])
            self.least = least if self.least is None else max(self.least, least)


def search(tree, query_ids, queries, best):
    for a in range(0, len(queries), AT_ONCE):
        bounds = tree.bounds(queries[a : a + AT_ONCE])
        for n, b in enumerate(bounds, a):
            own, q, top = query_ids[n], queries[n], best[n]
            heap = [(-b[0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if top.short_of(-bound):
                    break
                if c := tree.child[node]:
                    for child in (c, c + 1):
                        if not top.short_of(b[child]):
                            heapq.heappush(heap, (-b[child], child))
                else:
                    lo, hi = tree.span[node]
                    ids = tree.ids[lo:hi]
                    other = ids != own
                    top.offer((tree.points[lo:hi] @ q)[other], ids[other])


def starting(ids, vectors, seed_ids, seeds, k):
    """For each query a score that its k-th best cannot be below: the k-th among
    ``seeds``, rows of the candidates; None where they are too few."""
    out = [None] * len(ids)
    if len(seed_ids) > k > 0:
        kind = number_type(vectors, seeds)
        t = seeds.astype(kind).T
        for a in range(0, len(ids), 512):
            s = whole_numbers(vectors[a : a + 512].astype(kind) @ t)
            for n, row in enumerate(s, a):
                row = row[seed_ids != ids[n]]
                if len(row) >= k:
                    out[n] = int(np.sort(row)[-k]) if row.dtype == object else int(np.partition(row, len(row) - k)[len(row) - k])
    return out


def matrices(batches, rows):
    """(ids, integer matrix) of at most ``rows`` vectors of one length each."""
    held = {}
    for b in batches:
        ids, lists = b.column("vec_id").to_numpy(zero_copy_only=False), b.column("v")
        n = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(n)
        for size in np.unique(n):
            at = np.flatnonzero(n == size)
            m = flat[(ends[at] - size)[:, None] + np.arange(size)] if size else np.zeros((len(at), 0), np.int64)
            kept = held.setdefault(int(size), [[], []])
            kept[0].append(ids[at])
            kept[1].append(m)
            while sum(map(len, kept[0])) >= rows:
                i, v = np.concatenate(kept[0]), np.concatenate(kept[1])
                yield i[:rows], v[:rows]
                held[int(size)] = kept = [[i[rows:]], [v[rows:]]]
    for i, v in held.values():
        i, v = np.concatenate(i), np.concatenate(v)
        if len(i):
            yield i, v


def searcher(blocks, k, shard_rows):
    """``blocks``: (ids, vectors, starting scores) of each vector length."""

    def run(batches):
        best = {size: [Best(k, s) for s in start] for size, (_, _, start) in blocks.value.items()}
        for ids, points in matrices(batches, shard_rows):
            if points.shape[1] in best:
                own, q, _ = blocks.value[points.shape[1]]
                kind = number_type(points, q)
                search(Tree(ids, points.astype(kind)), own, q.astype(kind), best[points.shape[1]])
        for size, tops in best.items():
            own = blocks.value[size][0]
            n = [len(t.ids) for t in tops]
            if sum(n):
                scores = [decimal.Decimal(max(-SCORE_MOST, min(int(s), SCORE_MOST))) for t in tops for s in t.scores]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.concatenate([t.ids for t in tops])), pa.array(scores, pa.decimal128(38, 0))], names=["query_id", "vec_id", "score"])

    return run


def integers(vectors: DataFrame, scale: int = 1024, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each vector that has only
    finite components; other rows, and rows without an id, take no part.
    Components past the range of a long become its ends.  Other columns are
    ignored, whatever their names."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each
    query with candidates of another id and the same length, ties to the
    smaller id; all of them, if fewer.

    Both tables are as from ``integers``; queries need not be candidates.
    Repeated candidate rows are candidates each; a query repeated by id is asked
    once, with the least of its vectors.  Ranks are exact for scores of up to 38
    digits; one past the range of a long is shown as its end.  ``block`` is the
    number of queries that go to the executors at a time, by default as many as
    ``BLOCK_BYTES`` hold.
    """
    spark = candidates.sparkSession
    queries = saved(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    if block is None:
        longest = queries.agg(F.max(F.size("v"))).first()[0] or 1
        block = max(64, BLOCK_BYTES // (8 * longest))
    # Any candidates do: what they reach, the best of all reach.
    seeds = {v.shape[1]: (ids, v) for ids, v in matrices(candidates.limit(SEEDS).toArrow().to_batches(), SEEDS)}
    found, last = [], None
    while True:
        rows = queries if last is None else queries.where(F.col("vec_id") > last)
        rows = rows.orderBy("vec_id").limit(block).toArrow()
        if not rows.num_rows:
            break
        last = rows.column("vec_id")[-1].as_py()
        none = np.zeros(0, np.int64), None
        own = {v.shape[1]: (ids, v, starting(ids, v, *seeds.get(v.shape[1], none), k)) for ids, v in matrices(rows.to_batches(), block)}
        hits = candidates.mapInArrow(searcher(spark.sparkContext.broadcast(own), k, shard_rows), "query_id long, vec_id long, score decimal(38,0)")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        shown = F.greatest(F.least("score", F.lit(int(LONG.max)).cast("decimal(38,0)")), F.lit(int(LONG.min)).cast("decimal(38,0)")).cast("long")
        found.append(saved(hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", shown.alias("score"))))
        if rows.num_rows < block:
            break
    out = found.pop() if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for f in found:
        out = out.unionByName(f)
    return out
