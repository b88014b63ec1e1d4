"""Toxicity: boosted trees over dense features of whole texts, calibrated.

Features are densities and counts of abusive words (a fixed list, and at most
``LEARNT_HEADS`` beginnings of words learnt from labelled rows), how near such
words stand to second-person words, capitals, punctuation, and obfuscated
spellings.  At most ``max_rows`` labelled rows are cut into three parts that
share no row.  Trees grow on the driver from the first two, each part with the
beginnings of words learnt from the other, so that no row's own label is in its
features.  The model has those learnt from both, and isotonic regression on the
third part, which neither step has seen, turns its margins into probabilities.
Scoring is one pass over the texts without a shuffle.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Hasher, byte_class, letters_digits, slices
from .store import saved
from .trees import BoostedTrees, Isotonic

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_ROWS, LEARNT_HEADS, THRESHOLD = 20_000, 2_000, 0.7
HEADS = range(3, 9)
FOLDS = 4, 4, 2  # of ten, those of each part
# Abusive words, second-person words, look-alike characters.
ABUSIVE = (
    "arsehole ass asshole bastard bitch brainless bullshit clown coward crap creep cretin cunt damn degenerate despicable "
    "dickhead dirtbag disgrace disgusting dumb dumbass dunce fag filth filthy fool freak fuck fucking garbage hate hideous "
    "idiot idiotic imbecile jackass jerk kill lame liar loser lowlife lunatic maggot moron moronic nasty nazi parasite "
    "pathetic pig prick psycho rat retard retarded revolting scum scumbag shit shut sick sicko slime slut stupid sucker "
    "trash twat ugly useless vermin vile waste whore worm worthless wretch"
).split()
SECOND_PERSON = "you your yours yourself yourselves u ur ya du dich dir dein deine tu te toi ton ta tes vous votre ti tus usted ustedes".split()
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
NAMES = "words abusive abusive_share learnt learnt_share near_second second_share capitals shouted exclaimed punctuated digits obfuscated looks_abusive".split()


class Features:
    def __init__(self, learnt=()):
        self.plain = Hasher(letters_digits())
        signs = letters_digits() | byte_class(*((ord(c), ord(c)) for c in "@$!*"))
        self.look = Hasher(signs, replace=LOOKALIKES)
        self.abusive, self.second = (np.sort(self.plain.one(" ".join(w))) for w in (ABUSIVE, SECOND_PERSON))
        self.look_abusive = np.sort(self.look.one(" ".join(ABUSIVE)))
        self.learnt = np.sort(np.asarray(learnt, np.int64).view(np.uint64))
        self.upper, self.lower = byte_class((0x41, 0x5A)), byte_class((0x61, 0x7A))
        self.digit = byte_class((0x30, 0x39))
        self.punct = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))

    @staticmethod
    def among(hashes, known):
        if not len(known) or not len(hashes):
            return np.zeros(len(hashes), bool)
        return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes

    def of(self, data, offs):
        n = len(offs) - 1
        size = np.maximum(np.diff(offs), 1)
        w = self.plain.words(data, offs)
        per = lambda at, which: np.bincount(at[which], minlength=n).astype(float)
        words = np.diff(w.bounds).astype(float)
        many = np.maximum(words, 1)
        bad, you = self.among(w.hash, self.abusive), self.among(w.hash, self.second)
        learnt = np.zeros(len(w.hash), bool)
        for k in HEADS if len(self.learnt) else ():
            at, head = self.plain.heads(w, k)
            learnt[at] |= self.among(head, self.learnt)
        near = np.zeros(len(w.hash), bool)
        at_you, at_bad = np.flatnonzero(you), np.flatnonzero(bad | learnt)
        if len(at_you) and len(at_bad):
            k = np.searchsorted(at_you, at_bad)
            for side in (np.maximum(k - 1, 0), np.minimum(k, len(at_you) - 1)):
                y = at_you[side]
                near[at_bad] |= (np.abs(y - at_bad) <= 5) & (w.text_of[y] == w.text_of[at_bad])
        byte_count = lambda flags: self._sums(flags[data], offs)
        caps, small = byte_count(self.upper), byte_count(self.lower)
        cut = np.cumsum(np.concatenate([[0], self.upper[data]]))
        length = w.ends - w.starts
        shouted = (cut[w.ends] - cut[w.starts] == length) & (length > 2)
        x = self.look.words(data, offs)
        alpha = np.cumsum(np.concatenate([[0], self.upper[data] | self.lower[data]]))
        other = np.cumsum(np.concatenate([[0], self.digit[data] | np.isin(data, np.frombuffer(b"@$*", np.uint8))]))
        a, o = alpha[x.ends] - alpha[x.starts], other[x.ends] - other[x.starts]
        looks = self.among(x.hash, self.look_abusive)
        bads, learnts = per(w.text_of, bad), per(w.text_of, learnt)
        return np.column_stack([
            np.log1p(words), bads, bads / many, learnts, learnts / many, per(w.text_of, near), per(w.text_of, you) / many,
            caps / np.maximum(caps + small, 1), per(w.text_of, shouted) / many, byte_count(byte_class((0x21, 0x21))) / many,
            byte_count(self.punct) / size, byte_count(self.digit) / size, per(x.text_of, (a > 1) & (o > 0)) / many, per(x.text_of, looks),
        ])

    @staticmethod
    def _sums(flags, offs):
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def featurise(learnt, carry):
    """mapInArrow function: columns ``carry`` and ``x`` (array of features)."""

    def run(batches):
        features = Features(learnt)
        for b in batches:
            rows = [features.of(data, offs) for _, data, offs in slices(b.column("text"))]
            x = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], names=[*carry, "x"])

    return run


class Model:
    def __init__(self, learnt, trees, isotonic):  # learnt: see learn_heads
        self.learnt, self.trees, self.isotonic = learnt, trees, isotonic

    def score(self, x):
        m = self.trees.margin(x)
        # A share of the margin's own order keeps apart what one step joins.
        return np.clip(0.98 * self.isotonic.predict(m) + 0.02 / (1 + np.exp(-m)), 0.0, 1.0)


def held_out(doc_id):
    return (F.crc32(doc_id.cast("string")) % 3 == 1) & doc_id.isNotNull()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label: str = "toxic") -> Model:
    """Learn from labelled rows that are not held out, at most ``max_rows`` of
    them by the order of a hash of their ids; of several labels of one id the
    greatest.  Without rows of both labels the model says the labels' share, and
    a part that lacks one of them is made up from all rows."""
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = saved(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(sum(FOLDS)))
    part = F.when(fold < FOLDS[0], 0).when(fold < FOLDS[0] + FOLDS[1], 1).otherwise(2)
    sample = saved(d.join(F.broadcast(ids), "doc_id").withColumn("part", part))  # the side has at most max_rows rows
    first, second, learnt = learn_heads(sample.where("part < 2"), LEARNT_HEADS)
    rows = []
    for own, words in enumerate((second, first, learnt)):
        own = sample.where(F.col("part") == own)
        rows.append(own.mapInArrow(featurise(words, ["doc_id", "y", "part"]), "doc_id long, y int, part int, x array<double>"))
    rows = rows[0].unionByName(rows[1]).unionByName(rows[2]).toPandas()
    if not len(rows):
        return Model(learnt, BoostedTrees().fit(np.zeros((0, len(NAMES))), np.zeros(0)), Isotonic().fit(np.zeros(0), np.zeros(0)))
    rows = rows.sort_values("doc_id", kind="stable")
    x, y, part = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float), rows["part"].to_numpy()
    both = lambda which: which if len(set(y[which])) > 1 else np.ones(len(y), bool)
    grow, tune = both(part < 2), both(part == 2)
    trees = BoostedTrees().fit(x[grow], y[grow])
    return Model(learnt, trees, Isotonic().fit(trees.margin(x[tune]), y[tune]))


def heads(batches):
    """(y, part, head) for every distinct beginning of a word of each text."""
    hasher = Hasher(letters_digits())
    for b in batches:
        for row, data, offs in slices(b.column("text")):
            w = hasher.words(data, offs)
            found = [hasher.heads(w, k) for k in HEADS]
            text = np.concatenate([w.text_of[at] for at, _ in found])
            head = np.concatenate([h for _, h in found])
            order = np.lexsort((head, text))
            text, head = text[order], head[order]
            new = np.ones(len(head), bool)
            new[1:] = (text[1:] != text[:-1]) | (head[1:] != head[:-1])
            of = pa.array(row + text[new])
            yield pa.RecordBatch.from_arrays([b.column("y").take(of), b.column("part").take(of), pa.array(head[new].view(np.int64))], names=["y", "part", "head"])


def learn_heads(sample: DataFrame, most: int, least: int = 6) -> tuple[list[int], list[int], list[int]]:
    """Hashes of beginnings of words that stand in toxic rows far more often
    than chance allows, at most ``most``: from the rows of part 0, of part 1,
    and from both."""
    n = {(r["part"], r["y"]): r["count"] for r in sample.groupBy("part", "y").count().collect()}
    rows = sample.select("y", "part", "text").mapInArrow(heads, "y int, part int, head long")
    sums = [F.sum(F.when(F.col("part") == p, x)).alias(f"{name}{p}") for p in (0, 1) for name, x in (("a", F.col("y")), ("c", F.lit(1)))]
    counts = saved(rows.groupBy("head").agg(F.count("*").alias("c"), *sums).where(F.col("c") >= least).fillna(0))
    out = []
    for parts in ((0,), (1,), (0, 1)):
        toxic, clean = (sum(n.get((p, y), 0) for p in parts) for y in (1, 0))
        if not toxic or not clean:
            out.append([])
            continue
        share = toxic / (toxic + clean)
        a, c = (sum((F.col(f"{x}{p}") for p in parts), F.lit(0)) for x in "ac")
        z = F.round((a - c * share) / F.sqrt(c * share * (1 - share)), 6)
        good = counts.where((c >= least) & (a * 4 > c * 3)).withColumn("z", z).where("z > 5").orderBy(F.desc("z"), "head").limit(most)
        out.append([r["head"] for r in good.collect()])
    return tuple(out)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row, repeated ones too; null and empty
    texts are scored as texts without words.  Other columns are ignored,
    whatever their names."""

    def run(batches):
        rows = featurise(model.learnt, ["doc_id"])
        for b in rows(batches):
            x = b.column("x")
            p = model.score(np.asarray(x.flatten()).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return d.mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; all columns stay.
    Python gets the texts and gives back flags, so rows stay where they are."""

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features(model.learnt)
        for column in texts:
            p = [model.score(features.of(data, offs)) for _, data, offs in slices(column)]
            yield pa.array(np.concatenate(p) < threshold if p else np.zeros(0, bool))

    return docs.where(clean(docs["text"]))
