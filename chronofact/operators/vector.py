"""Flat search over quantized vectors in two steps."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, hamming
from ..schema import SOURCE_CAP


def sieve_size(k: int) -> int:
    return max(4 * k, 64)


def sieve(vectors: DataFrame, query: Column, k: int = SOURCE_CAP) -> DataFrame:
    """The vectors whose signs differ least from the query's, ties to the
    smaller slot: the candidates, before any of them is admitted."""
    near = vectors.withColumn("ham", hamming(F.col("vector.sig"), query["sig"]))
    return near.orderBy("ham", "slot").limit(sieve_size(k))


def flat_topk(vectors: DataFrame, query: Column, admitted: Column, k: int = SOURCE_CAP) -> DataFrame:
    """(fact_id, score) of the k nearest by quantized cosine.

    ``vectors`` is (slot, fact_id, vector, ...) with what ``admitted`` needs;
    ``query`` a quantized literal.  Admission comes after the sieve, so a
    narrow one may leave fewer than k.
    """
    found = sieve(vectors, query, k).where(admitted).select("fact_id", F.round(cosine(F.col("vector"), query), 10).alias("score"))
    return found.orderBy(F.desc("score"), "fact_id").limit(k)


#: Bytes of queries that go to the executors at a time, and rows of vectors that
#: a task compares with them at a time.
BLOCK_BYTES, ROWS = 1 << 24, 8192


def matrices(batch):
    """(signs as bits, quantized numbers, scales) of a batch's column ``vector``."""
    v = batch.column(batch.schema.get_field_index("vector"))
    scale, q, sig = (v.field(i) for i in range(3))
    n = len(v)
    q = q.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return sig.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1), q, scale.to_numpy(zero_copy_only=False)


def nearest(block, sieve_rows):
    """Of each query of ``block`` the ``sieve_rows`` vectors of a task whose signs
    differ least: (query_id, slot, ham, score), ties to the smaller slot."""

    def run(batches):
        ids, sig, q, scale = block.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                slots, (own, numbers, own_scale) = part.column(0).to_numpy(zero_copy_only=False), matrices(part)
                if own.shape[1] != sig.shape[1] or numbers.shape[1] != q.shape[1]:
                    continue
                numbers = numbers.astype(np.float32 if numbers.shape[1] <= 1024 else np.float64)  # whole below 2**24
                for i in range(len(ids)):
                    ham = np.bitwise_count(own ^ sig[i]).sum(1, dtype=np.int64)
                    had = best[i]
                    if len(had[0]) == sieve_rows:
                        near = np.flatnonzero(ham <= had[1][-1])
                    else:
                        near = np.arange(len(ham))
                    if not len(near):
                        continue
                    if len(near) > sieve_rows:
                        edge = np.partition(ham[near], sieve_rows - 1)[sieve_rows - 1]
                        near = near[ham[near] <= edge]
                    score = own_scale[near] * scale[i] * (numbers[near] @ q[i].astype(numbers.dtype)).astype(np.float64)
                    s, h, c = (np.concatenate(x) for x in zip(had, (slots[near], ham[near], score)))
                    order = np.lexsort((s, h))[:sieve_rows]
                    best[i] = s[order], h[order], c[order]
        n = [len(b[0]) for b in best]
        if sum(n):
            s, h, c = (np.concatenate(x) for x in zip(*best))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(s), pa.array(h), pa.array(c)], names=["query_id", "slot", "ham", "score"])

    return run


def flat_topk_many(vectors: DataFrame, queries: DataFrame, admitted: Column, k: int = SOURCE_CAP, block: int | None = None) -> DataFrame:
    """(query_id, fact_id, score, rank): ``flat_topk`` for a table of queries
    (query_id, vector and what else ``admitted`` needs).

    Every query meets every signature, which is the search itself, as matrices
    in Arrow batches; queries go in blocks of ``BLOCK_BYTES`` (or ``block``
    rows), so what is broadcast is bounded, and each task keeps only its own
    best of the sieve.  Slots are ids of rows.
    """
    spark = vectors.sparkSession
    last, out = None, None
    if block is None:
        longest = queries.agg(F.max(F.size("vector.q"))).first()[0] or 1
        block = max(64, BLOCK_BYTES // (9 * longest))
    extra = [c for c in queries.columns if c not in ("query_id", "vector")]
    while True:
        part = (queries if last is None else queries.where(F.col("query_id") > last)).orderBy("query_id").limit(block)
        rows = part.select("query_id", "vector").toArrow().combine_chunks()
        if not rows.num_rows:
            break
        ids, batch = rows.column(0).to_numpy(), rows.to_batches()[0]
        last = int(ids[-1])
        sent = spark.sparkContext.broadcast((ids, *matrices(batch)))
        near = vectors.select("slot", "vector").mapInArrow(nearest(sent, sieve_size(k)), "query_id long, slot long, ham long, score double")
        closest = Window.partitionBy("query_id").orderBy("ham", "slot")
        near = near.withColumn("at", F.row_number().over(closest)).where(F.col("at") <= sieve_size(k))
        if extra:
            near = near.join(part.select("query_id", *extra), "query_id")
        near = near.join(vectors.drop("vector"), "slot").where(admitted)
        scored = near.select("query_id", "fact_id", F.round("score", 10).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")
        found = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out = found if out is None else out.unionByName(found)
        if len(ids) < block:
            break
    return out if out is not None else spark.createDataFrame([], "query_id long, fact_id long, score double, rank int")
