"""Substring de-duplication by level-wise doubling.

A window is a run of consecutive words of one text.  Short windows that stand
in more than one text are found first; only where they stand is the text looked
at again with windows of twice the length, and so on up to the length asked
for, or until no candidates survive, which ends the search.

The shortest level is thinned without loss: of the short windows inside each
window of the next level only the one with the least hash is an anchor, so two
texts that share the longer window share its anchor, and about a quarter of
all positions are compared.  Exact copies of a text are dealt with as a whole:
the one with the smallest id stands for them.

Every level shuffles hashes, ids and places only.  Windows are counted with
partial aggregation; the repeated ones are a written table, joined back to
their places by a join that splits large keys, so a passage that a third of all
texts share is spread over tasks.
"""

import hashlib
import itertools
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bits
from ._text import Hasher, grams, not_space, release, signed, slices, whole
from .store import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, SHORTEST = 13, 8


def level_lengths(window: int) -> list[int]:
    """A short length, then twice the last each time, ending with ``window``."""
    short = window
    while short > SHORTEST:
        short = -(-short // 2)
    out = [short]
    while out[-1] < window or len(out) < 2:
        out.append(min(2 * out[-1], window))
    return out


def anchors(words, short, length):
    """(starts of windows of ``length``, the word at which each one's anchor
    starts, hashes of all short windows)."""
    g = grams(words.hash, short)
    at = whole(words, length)
    if not len(at):
        return at, at, g
    inside = np.lib.stride_tricks.sliding_window_view(g, length - short + 1)
    last = length - short - inside[at, ::-1].argmin(1)
    return at, at + last, g


def first_level(short, length, table=None):
    """Anchors of each text: rows (hash, key of the text), or with the bit table
    of repeated hashes rows (hash, doc_id, pos)."""

    def run(batches):
        hasher = Hasher(not_space(), fold_case=False)
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for row, data, offs in slices(texts):
                w = hasher.words(data, offs)
                at = np.unique(anchors(w, short, length)[1])
                g = grams(w.hash, short)[at]
                if table is None:
                    raw = memoryview(data)
                    key = [int.from_bytes(hashlib.md5(raw[x:y]).digest()[:8], "little", signed=True) for x, y in itertools.pairwise(offs.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(np.array(key, np.int64)[w.text_of[at]])], names=["h", "key"])
                else:
                    hit = _bits.passes(np.frombuffer(table.value, np.uint8), g)
                    at, g = at[hit], g[hit]
                    text = w.text_of[at]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(g)), ids.take(pa.array(row + text)), pa.array((at - w.bounds[text]).astype(np.int32))], names=["h", "doc_id", "pos"])

    return run


def next_level(short, length, first):
    """Windows of ``length`` where shorter ones at ``places`` allow them: rows
    (h, g, doc_id, pos), of 96 bits of hash."""

    def run(batches):
        hasher = Hasher(not_space(), fold_case=False)
        for b in batches:
            ids, places = b.column("doc_id"), b.column("places")
            for row, data, offs in slices(b.column("text")):
                w = hasher.words(data, offs)
                own = places.slice(row, len(offs) - 1)
                n = np.diff(own.offsets.to_numpy())
                flag = np.zeros(len(w.hash) + 1, bool)
                spot = own.flatten().to_numpy() + np.repeat(w.bounds[:-1], n)
                flag[np.minimum(spot, len(w.hash))] = True
                if first:
                    at, anchor, _ = anchors(w, short, length)
                    at = at[flag[anchor]]
                else:
                    at = whole(w, length)
                    at = at[flag[at] & flag[at + length - short]]
                text = w.text_of[at]
                g = grams(w.hash, length, seed=1)[at] >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams(w.hash, length)[at])), pa.array(g.astype(np.uint32).view(np.int32)), ids.take(pa.array(row + text)), pa.array((at - w.bounds[text]).astype(np.int32))], names=["h", "g", "doc_id", "pos"])

    return run


def remover(window, rows=500):
    """Texts without what is repeated, some rows at a time."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(text, places, copy):
        words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        n = len(words)
        edge = np.zeros(n + 1, np.int64)
        if copy and n >= window:
            edge[0] = 1
        elif places.is_valid:
            at = np.asarray(places.values.to_numpy())
            at = np.unique(at[at + window <= n])
            np.add.at(edge, at, 1)
            np.subtract.at(edge, at + window, 1)
        gone = edge.cumsum()[:n] > 0
        step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())]
        return n, spans, b" ".join(itertools.compress(words, ~gone) if spans else words)

    def run(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, rows):
                b = whole_batch.slice(at, rows)
                count, spans, kept = zip(*map(one, b.column("text"), b.column("places"), b.column("copy").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "removed", "kept"])
            release()

    return run


def repeated_places(d: DataFrame, copies: DataFrame, window: int) -> DataFrame:
    """(doc_id, places): starts of windows that start in a text of smaller id
    too.  ``d`` has doc_id and text, ``copies`` the ids to leave out."""
    spark = d.sparkSession
    lengths = level_lengths(window)
    keys = d.mapInArrow(first_level(*lengths[:2]), "h long, key long")
    found = saved(keys.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("h"))
    table = spark.sparkContext.broadcast(_bits.bit_table(found))
    spots = d.mapInArrow(first_level(*lengths[:2], table), "h long, doc_id long, pos int").join(found, "h", "left_semi")
    places = None
    none = spark.createDataFrame([], "doc_id long, places array<int>")
    for short, length in itertools.pairwise(lengths):
        if found.isEmpty():
            return none  # no candidates survive
        places = saved(spots.groupBy("doc_id").agg(F.collect_list("pos").alias("places")).join(copies, "doc_id", "left_anti"))
        level = saved(d.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(next_level(short, length, short == lengths[0]), "h long, g int, doc_id long, pos int"))
        found = level.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        found = saved(found.where("least < most").select("h", "g", "least"))
        spots = level.join(found, ["h", "g"])
    return saved(spots.where("doc_id > least").groupBy("doc_id").agg(F.collect_list("pos").alias("places")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, removed array<struct<start,end>>, kept) for each row.

    Words are runs of other characters than blanks and control-character white
    space, unchanged.  A word goes if a window of ``window`` words that covers
    it also starts in a text of smaller id; windows are judged on the input.
    ``kept`` joins the words that stay by single spaces.

    A null text has no words.  A row without an id keeps everything and takes
    nothing from others; rows repeated with one id and text keep what either
    would.  An id should stand for one text.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    named = d.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    same = saved(named.select("doc_id", F.unhex(F.md5("text")).alias("md5")))
    groups = saved(same.groupBy("md5").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("md5", "least"))
    copies = saved(same.join(groups, "md5").where("doc_id > least").select("doc_id").distinct())
    gone = repeated_places(named, copies, window).withColumn("copy", F.lit(False))
    gone = gone.unionByName(copies.select("doc_id", F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("copy")))
    return d.join(gone, "doc_id", "left").select("doc_id", "text", "places", "copy").mapInArrow(remover(window), "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string")
