"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a run of words: words under its zeros are ignored,
so a passage in which single words were exchanged still shares seeds with the
benchmark item.  Hashes of all masked runs of the items are joined to those of
the documents; a hit at word p of a document and q of an item puts the item at
p - q.  Around every such place the item is compared with the document word by
word, and is reported if at least ``min_overlap`` of its words stand there.

Beside the two masks of span 12 stand all of weight 4 and span 6 or less.  A run
of n words none of them hits keeps at most 3 of every 6 words, which is less
than 0.7 n from n = 5 on: wherever substitutions fall, an item that stands with
0.7 of its words has a hit.  Items of 4 words get masks of weight 3, shorter ones
a mask of their own length without zeros.  Before
the join, document hashes pass two bit tables of fixed size made from the items'
hashes: they drop only hashes that no item has, and when items are so many that
they fill up the join still does the whole work.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bits
from ._text import Hasher, letters_digits, mix, signed, slices, whole
from .store import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Two masks of span 12 and weight 8.
MASKS = ("110110010111", "111010110011")
# All masks of weight 4 and span 6 or less.
LIGHT = tuple(m for m in map("{:b}".format, range(1, 64, 2)) if m.count("1") == 4)


def exact_masks(n):
    """Masks for items of exactly ``n`` words, too few for those of weight 4."""
    return ("111", "1101", "1011") if n == 4 else ("1" * n,)


def least_hits(n: int, min_overlap: float, masks=LIGHT) -> int:
    """The fewest hits of ``masks`` in any item of ``n`` words of which at least
    ``min_overlap`` stands, over all ways to exchange the others; at least 1
    means that no such item is missed.

    Word by word, over the states (which of the last words stand, how many do).
    """
    span = max(map(len, masks))
    wanted = [(int(m[::-1], 2) << (span - len(m)), len(m)) for m in masks]
    fewest = {(0, 0): 0}
    for i in range(n):
        step = {}
        for (last, stand), hits in fewest.items():
            for here in (0, 1):
                seen = (last >> 1) | here << (span - 1)
                more = hits + sum(m <= i + 1 and seen & w == w for w, m in wanted)
                key = seen, stand + here
                step[key] = min(step.get(key, more), more)
        fewest = step
    return min(hits for (_, stand), hits in fewest.items() if stand >= min_overlap * n)


def masked(words, mask):
    """(indices of words, hash) of each run of one text under ``mask``."""
    at = whole(words, len(mask))
    out = np.full(len(at), int(mask, 2) + (len(mask) << 40), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0xD1342543DE82EF95) + words.hash[at + j]
    return at, mix(out)


def seeds(masks, lengths, tables=()):
    """Rows (id, pos, seed[, item words]) of all texts; ``tables``: which to keep.

    ``lengths``: those of items of 4 words or fewer, which have masks of their own.
    """
    own_masks = [(mask, n) for n in lengths for mask in exact_masks(n)]
    if tables:
        own_masks = [(mask, None) for mask in dict.fromkeys(mask for mask, _ in own_masks)]
    own_masks = [(mask, None) for mask in masks] + own_masks

    def run(batches):
        hasher = Hasher(letters_digits())
        keep = [np.frombuffer(table, np.uint8) for table in tables]
        for b in batches:
            ids = b.column(0)
            for row, data, offs in slices(b.column(1)):
                w = hasher.words(data, offs)
                for mask, n in own_masks:
                    at, seed = masked(w, mask)
                    if n is not None:
                        own = np.diff(w.bounds)[w.text_of[at]] == n
                        at, seed = at[own], seed[own]
                    for i, bits in enumerate(keep):
                        hit = _bits.passes(bits, seed << np.uint64(i * _bits.TABLE_BITS))
                        at, seed = at[hit], seed[hit]
                    if len(at):
                        text = w.text_of[at]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + text)), pa.array(at - w.bounds[text]), pa.array(signed(seed))], names=["id", "pos", "seed"])

    return run


def item_words(batches):
    hasher = Hasher(letters_digits())
    for b in batches:
        for row, data, offs in slices(b.column(1)):
            w = hasher.words(data, offs)
            cut = [w.hash[w.bounds[i] : w.bounds[i + 1]].tobytes() for i in range(len(offs) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(cut)), pa.array(cut, pa.binary()), pa.array(np.diff(w.bounds))], names=["item_id", "item", "n"])


def verifier(min_overlap, slack):
    """Of each text its items that stand in it, each with its best place."""

    def run(batches):
        hasher = Hasher(letters_digits())
        for b in batches:
            out = {"doc_id": [], "item_id": [], "start": [], "matched": [], "overlap": []}
            ids, items = b.column("doc_id").to_pylist(), b.column("items")
            for row, data, offs in slices(b.column("text")):
                w = hasher.words(data, offs)
                for i in range(len(offs) - 1):
                    own = w.hash[w.bounds[i] : w.bounds[i + 1]]
                    for x in items[row + i].values:
                        item = np.frombuffer(x["item"].as_py(), np.uint64)
                        places = x["places"].values.to_numpy()
                        got, _, place = max((*_aligned(own, item, int(p), slack), -int(p)) for p in places)
                        if got >= min_overlap * len(item):
                            for k, v in zip(out, (ids[row + i], x["item_id"].as_py(), max(0, -place), got, got / len(item))):
                                out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("matched", pa.int64()), ("overlap", pa.float64())]))

    return run


def _aligned(own, item, place, slack):
    """(words of ``item`` found at ``place``, or moved by at most ``slack`` where
    a word was put in or left out before them, those at ``place`` alone)."""
    got, there = np.zeros(len(item), bool), 0
    for d in range(place - slack, place + slack + 1):
        lo, hi = max(0, -d), min(len(item), len(own) - d)
        if lo < hi:
            same = own[lo + d : hi + d] == item[lo:hi]
            if d == place:
                there = int(same.sum())
            else:  # off the diagonal only runs of words count
                run = same.copy()
                run[1:] &= same[:-1]
                run[:-1] |= run[1:]
                same = run
            got[lo:hi] |= same
    return int(got.sum()), there


def find_leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, min_overlap: float = 0.7, slack: int = 2, id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """(doc_id, item_id, start, matched, overlap): a row for each document and
    item of which at least ``min_overlap`` stands in the document in one place.
    With ``min_overlap`` of 0.7 or more no item with words exchanged is missed;
    with less, or where words were put in or left out too, one without four
    words of a run of six in place, and without a hit of ``masks``, can be.

    ``start`` is the item's first word in the document (0 if before it).  Texts
    that are null, empty or without words match nothing, nor do rows without an
    id.  Rows repeated in either table give one row; where one id has several
    texts, their best overlap, of equal ones the first place.  Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null")
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text].alias("text")).where("item_id is not null")
    masks = tuple(dict.fromkeys((*masks, *LIGHT)))
    words = saved(items.mapInArrow(item_words, "item_id long, item binary, n long").where("n > 0").distinct())
    short = sorted(r["n"] for r in words.where("n <= 4").select("n").distinct().collect())
    seed = "id long, pos long, seed long"
    tests = saved(items.mapInArrow(seeds(masks, short), seed).select(F.col("id").alias("item_id"), F.col("pos").alias("at"), "seed").distinct())
    # Of the hashes that pass one table by chance the second, of their next bits, lets few through.
    bits = spark.sparkContext.broadcast([_bits.bit_table(tests.select(F.shiftleft("seed", i * _bits.TABLE_BITS).alias("seed"))) for i in range(2)])
    hits = (
        d.mapInArrow(lambda batches: seeds(masks, short, bits.value)(batches), seed)
        .join(tests, "seed")
        .select(F.col("id").alias("doc_id"), "item_id", (F.col("pos") - F.col("at")).alias("place"))
        .distinct()
    )
    hits = saved(hits)
    # Ids alone are small: most documents are left out before texts are shuffled.
    d = d.join(saved(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    # An item's words go once to each document that it may stand in, whatever
    # the number of places there.
    places = hits.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_list("place")).alias("places")).join(words, "item_id")
    items = places.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item", "places")).alias("items"))
    found = d.join(saved(items), "doc_id").select("doc_id", "text", "items").mapInArrow(verifier(min_overlap, slack), "doc_id long, item_id long, start long, matched long, overlap double")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", (-F.col("start")).alias("back"), "matched")).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.back")).alias("start"), "x.matched", "x.overlap")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows in which an item stands; rows without an id stay."""
    gone = saved(find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs[options.get("id_col", "doc_id")] == gone["__gone"], "left_anti")
