"""License scan by diagonal voting.

Every rolling word k-gram of every text is hashed and joined to the positions
of the same k-gram in the license templates.  A hit at word p of a text and
word q of a template lies on diagonal p - q; votes are counted by (text,
template, diagonal) with partial aggregation before the shuffle, neighbouring
diagonals are merged, and each merged span is verified word for word against
the text.  A template of up to ``WHOLE`` words must stand whole; the share that
must stand then falls with the template's length, to ``min_cover``.

The templates are a list given by the caller, a few thousand rows whatever the
corpus, and so are broadcast.
"""

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Hasher, grams, letters_digits, signed, slices, whole
from .store import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE, MATRIX = 12, 1 << 20


@dataclass(frozen=True)
class Template:
    """``phrase`` templates are the base: their places are counted."""

    label: str
    text: str
    phrase: bool = False


# Phrases and labels of the contract.
PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
# The opening passages of widely used licenses and notices.
PASSAGES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc", "licensed under cc by"),
    Template("cc", "this work is licensed under a creative commons attribution"),
)
DEFAULT_TEMPLATES = PHRASES + PASSAGES


def _words(text):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]


def template_grams(templates, k):
    """(hash, template, position) of every k-gram of the templates."""
    hasher, out = Hasher(letters_digits()), []
    for i, t in enumerate(templates):
        if len(_words(t.text)) < k:
            raise ValueError(f"template of fewer than {k} words: {t.text!r}")
        out += [(int(h), i, p) for p, h in enumerate(signed(grams(hasher.one(t.text), k)))]
    return out


def rolling(k):
    def run(batches):
        hasher = Hasher(letters_digits())
        for b in batches:
            ids = b.column("doc_id")
            for row, data, offs in slices(b.column("text")):
                w = hasher.words(data, offs)
                at = whole(w, k)
                if len(at):
                    text = w.text_of[at]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + text)), pa.array(at - w.bounds[text]), pa.array(signed(grams(w.hash, k)[at]))], names=["doc_id", "pos", "gram"])

    return run


def cover_needed(n, min_cover):
    """The share of a passage of ``n`` words that must stand in a text."""
    return 1.0 if n <= WHOLE else max(min_cover, 1 - (n - WHOLE) / WHOLE / 3)


def spans_of(own, want, diagonals, slack):
    """(start, end, cover) of each run of neighbouring ``diagonals`` (sorted) on
    which words of the text ``own`` are those of the template ``want``."""
    if not len(own):
        return []
    first = np.flatnonzero(np.diff(diagonals, prepend=diagonals[0] - slack - 1) > slack)
    got = np.zeros((len(first), len(want)), bool)
    lo, hi = np.full(len(first), len(own)), np.full(len(first), -1)
    rows = max(1, MATRIX // len(want))
    for at in range(0, len(diagonals), rows):
        d = diagonals[at : at + rows]
        place = d[:, None] + np.arange(len(want))
        there = (place >= 0) & (place < len(own))
        same = there & (own[np.where(there, place, 0)] == want)
        run, start = np.unique(np.searchsorted(first, np.arange(at, at + len(d)), side="right") - 1, return_index=True)
        got[run] |= np.logical_or.reduceat(same, start)
        lo[run] = np.minimum(lo[run], np.minimum.reduceat(np.where(same, place, len(own)).min(1), start))
        hi[run] = np.maximum(hi[run], np.maximum.reduceat(np.where(same, place, -1).max(1), start))
    return [(x, y + 1, c) for x, y, c in zip(lo.tolist(), hi.tolist(), got.mean(1).tolist()) if c]


def verifier(templates, slack, min_cover):
    """Per text: words and verified spans, from its candidate diagonals."""

    def run(batches):
        hasher = Hasher(letters_digits())
        want = [hasher.one(t.text) for t in templates]
        need = [1.0 if t.phrase else cover_needed(len(w), min_cover) for t, w in zip(templates, want)]
        for b in batches:
            n, spans = [], []
            hits = b.column("hits")
            for row, data, offs in slices(b.column("text")):
                w = hasher.words(data, offs)
                n.append(np.diff(w.bounds))
                for i in range(len(offs) - 1):
                    found, h = [], hits[row + i].values
                    if h is not None:
                        own = w.hash[w.bounds[i] : w.bounds[i + 1]]
                        t, d = (np.asarray(h.field(c)) for c in ("template", "diagonal"))
                        order = np.lexsort((d, t))
                        t, d = t[order], d[order]
                        for k in np.unique(t).tolist():
                            at = np.unique(d[np.searchsorted(t, k) : np.searchsorted(t, k, side="right")])
                            got = spans_of(own, want[k], at, -1 if templates[k].phrase else slack)
                            found += [{"template": k, "start": s, "end": e, "cover": c} for s, e, c in got if c >= need[k]]
                    spans.append(found)
            kind = pa.list_(pa.struct([("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), pa.array(spans, kind)], names=["doc_id", "n_words", "spans"])

    return run


def scan_licenses(docs: DataFrame, templates=DEFAULT_TEMPLATES, k: int = 2, slack: int = 3, min_cover: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans array<struct<template,start,end,cover>>) for each row.

    ``template`` is the index in ``templates``; start and end are words.  Null
    and empty texts have no words and no spans.  Repeated rows stay; rows that
    share an id share candidates, and each is verified on its own text.  Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    table = spark.createDataFrame(template_grams(templates, k), "gram long, template int, at long")
    # A phrase must have all its k-grams on a diagonal, a passage any two of them.
    need = F.array(*[F.lit(len(_words(t.text)) - k + 1 if t.phrase else 2) for t in templates])
    votes = (
        d.mapInArrow(rolling(k), "doc_id long, pos long, gram long")
        .join(F.broadcast(table), "gram")
        .groupBy("doc_id", "template", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.count("*").alias("votes"))
        .where(F.col("votes") >= F.get(need, F.col("template")))
    )
    hits = saved(votes.groupBy("doc_id").agg(F.collect_list(F.struct("template", "diagonal")).alias("hits")))
    joined = d.join(hits.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(verifier(templates, slack, min_cover), "doc_id long, n_words long, spans array<struct<template:int,start:long,end:long,cover:double>>")
