"""Approximate vector search by cells.

Vectors are filed under the nearest of a set of centres; a query looks only into
the cells whose centres are nearest to it, and scores what it finds there by the
same quantized cosine as the flat search.  Centres are fitted by k-means on at
most ``SAMPLE_ROWS`` vectors, by the order of a hash of their slots; every vector
is filed.  How many cells a query needs is measured, not set: ``calibrate``
searches a sample of the vectors exactly and takes the fewest cells that hold
the wanted share of what they should find.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vector import BLOCK_BYTES, ROWS, matrices

SAMPLE_ROWS, MOST_CELLS, ROUNDS = 20_000, 4096, 10
CALIBRATION_ROWS, RECALL = 256, 0.95


def units(q, scale):
    x = q.astype(np.float32) * scale[:, None].astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def sample(vectors: DataFrame, rows: int):
    """(slots, quantized numbers, scales) of at most ``rows`` vectors."""
    t = vectors.select("slot", "vector").orderBy(F.xxhash64("slot"), "slot").limit(rows).toArrow().combine_chunks()
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int8), np.zeros(0)
    _, q, scale = matrices(t.to_batches()[0])
    return t.column(0).to_numpy(), q, scale


def fit(vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres of length 1, a row each; by default as many as the root of the
    number of vectors, at most ``MOST_CELLS``."""
    _, q, scale = sample(vectors, sample_rows)
    if cells is None:
        cells = int(np.ceil(np.sqrt(vectors.count())))
    x = units(q, scale)
    cells = max(min(cells, MOST_CELLS, len(x)), min(len(x), 1))
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)] if cells else x
    for _ in range(ROUNDS if cells else 0):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def filed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` (slot, vector) with the ``cell`` of each."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                _, q, scale = matrices(part)
                cell = (units(q, scale) @ sent.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], names=["slot", "vector", "cell"])

    kind = vectors.select("vector").schema["vector"].dataType.simpleString()
    return vectors.select("slot", "vector").mapInArrow(run, f"slot long, vector {kind}, cell int")


def cell_order(centres, q, scale):
    return np.argsort(-(units(q, scale) @ centres.T), axis=1, kind="stable")


def in_cells(sent, k):
    """Of each query the k nearest vectors of a task, among those of its cells."""

    def run(batches):
        ids, q, scale, asked = sent.value  # asked: {cell: indices of queries}
        best = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                slots, cells = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
                _, numbers, own = matrices(part)
                for cell in np.unique(cells):
                    who = asked.get(int(cell))
                    if who is None:
                        continue
                    rows = np.flatnonzero(cells == cell)
                    dots = numbers[rows].astype(np.float64) @ q[who].astype(np.float64).T
                    scores = np.round(own[rows, None] * scale[None, who] * dots, 10)
                    for j, i in enumerate(who):
                        had = best.get(i, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)))
                        s, c, x = np.concatenate([had[0], slots[rows]]), np.concatenate([had[1], scores[:, j]]), np.concatenate([had[2], cells[rows]])
                        order = np.lexsort((s, -c))[:k]
                        best[i] = s[order], c[order], x[order]
        if best:
            n = [len(v[0]) for v in best.values()]
            s, c, x = (np.concatenate(v) for v in zip(*best.values()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[list(best)], n)), pa.array(s), pa.array(c), pa.array(x)], names=["query_id", "slot", "score", "cell"])

    return run


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, probes: int, k: int = 10, block: int | None = None) -> DataFrame:
    """(query_id, slot, score, cell, rank): the k nearest of each query of
    (query_id, vector), ties to the smaller slot, in its ``probes`` nearest
    cells; all cells make it exact.

    ``index`` is as from ``filed``.  Queries go in blocks of bounded size; cells
    that none of a block asks for are not read where the index is kept in
    folders by cell.
    """
    spark = index.sparkSession
    last, out = None, None
    if block is None:
        block = max(64, BLOCK_BYTES // (16 * max(centres.shape[1], probes, 1)))
    while True:
        rows = (queries if last is None else queries.where(F.col("query_id") > last)).orderBy("query_id").limit(block).select("query_id", "vector").toArrow().combine_chunks()
        if not rows.num_rows or not len(centres):
            break
        ids = rows.column(0).to_numpy()
        last = int(ids[-1])
        _, q, scale = matrices(rows.to_batches()[0])
        order = cell_order(centres, q, scale)[:, : max(1, probes)]
        asked: dict[int, list[int]] = {}
        for i, own in enumerate(order.tolist()):
            for c in own:
                asked.setdefault(c, []).append(i)
        sent = spark.sparkContext.broadcast((ids, q, scale, {c: np.array(v) for c, v in asked.items()}))
        wanted = index if len(asked) == len(centres) else index.where(F.col("cell").isin(sorted(asked)))
        hits = wanted.select("slot", "vector", "cell").mapInArrow(in_cells(sent, k), "query_id long, slot long, score double, cell int")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "slot")
        found = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = found if out is None else out.unionByName(found)
        if len(ids) < block:
            break
    return out if out is not None else spark.createDataFrame([], "query_id long, slot long, score double, cell int, rank int")


def calibrate(index: DataFrame, centres: np.ndarray, recall: float = RECALL, k: int = 10, rows: int = CALIBRATION_ROWS) -> int:
    """The fewest cells a query must look into for ``recall`` of its k nearest,
    measured on at most ``rows`` of the index's own vectors against all of them."""
    slots, q, scale = sample(index, rows)
    if not len(slots):
        return 1
    own = index.select("slot").sparkSession.createDataFrame([(int(s),) for s in slots], "slot long")
    asked = index.join(F.broadcast(own), "slot").select(F.col("slot").alias("query_id"), "vector")
    exact = search(index, centres, asked, len(centres), k + 1).where("slot <> query_id").select("query_id", "cell").toPandas()
    place = {int(s): np.argsort(o) for s, o in zip(slots, cell_order(centres, q, scale))}  # cell -> its turn
    turns = np.sort([place[i][c] for i, c in zip(exact["query_id"], exact["cell"])])
    return int(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))) - 1)]) + 1 if len(turns) else 1
