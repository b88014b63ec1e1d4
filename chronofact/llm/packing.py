"""Best-fit packing of token sequences, improved by swap-based local search.

A document's tokens (and an end token) are cut into pieces of the sequence
length only where it is longer than that.  Whole pieces fill a sequence each.
The rest, at most one a document, are dealt in turn into shards of about
``shard_rows`` pieces, whatever their ids, and a task packs one shard:

1. best fit, longest piece first: each goes where it leaves the least room;
2. local search between underfull sequences: a piece moves to another sequence,
   or is exchanged for one smaller piece or for two pieces, whenever that makes
   the sum of squared fills grow; the emptier sequence of the two gets emptier
   until it is gone.  Fills are integers, so every step adds to a bounded sum
   and the search ends by itself; should it take more than ``WORK`` looks at an
   exchange (about half a minute), what it has reached by then stands.

A shard leaves at most about one sequence underfull for want of small pieces,
so the loss from sharding falls with ``shard_rows``.
"""

import json
import os
import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import release
from .store import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, END, SHARD_ROWS = 2048, 0, 16_384
CACHED_WORDS, PAIR_PIECES = 400_000, 24
WORK, AT_ONCE = 1 << 31, 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


# How a tokenizer must prepare texts for the table of words.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PROBES = (
    "", " ", "a", "A", "Abc aBC", "one two  three\n\nfour\tfive\r\nsix", "end. Next, more; (brackets) [x] {y} a-b a_b a.b,c", "it's don't 've we'll I'M",
    "x1 22 3.14 1,000", "caf\u00e9 \u00dcber stra\u00dfe na\u00efve", "\u041f\u0440\u0438\u0432\u0435\u0442, \u043c\u0438\u0440!", "\u6771\u4eac\u90fd\u3000\u5927\u962a", "e\u0301 a\u0300b \u212b", "\u03a3\u0391\u03a3 \u0130x",
    "!!! ... ,, ?! @#$%^&*()", "<|endoftext|>", "a <|endoftext|> b", "word*** bar%%%. ...x", "\u00a0\u2003x\u2028y", "\U0001f980 ok \U0001f44d\U0001f3fd", "unbelievablylongwordthatsplits antidisestablishmentarianism",
)


def process_cache(path):
    """A dictionary for ``path`` that lasts as long as this Python process.

    Functions come to the executors by value, so what their own module holds is
    new in every task; a module of the process's own is not.
    """
    name = "chronofact_process_cache"
    module = sys.modules.setdefault(name, types.ModuleType(name, "Words met by this process's tokenizers."))
    return vars(module).setdefault("words", {}).setdefault(path, {})


class Tokens:
    """Token ids of texts, where the tokenizer allows it through a table of
    stretches between spaces, else text by text.

    It allows it if it lower-cases, drops white space and never joins tokens
    across it, so that a text's ids are those of its stretches in order.  A run
    of letters and a run of signs after it are then tokens apart, so texts are
    lower-cased as a whole and cut between the two, which leaves few different
    stretches.  New runs of letters are encoded in two calls a batch, others one
    by one.  Whether it does is read from its file, and tried on ``PROBES``.
    """

    SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"  # without ' and <, which may start other tokens

    def __init__(self, path):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # For words of a-z the normalizer and the patterns have nothing to do.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        last = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.ends_word = last
        self.tail = re.compile(rf"([a-z\u00df-\u00f6\u00f8-\u00ff])([{re.escape(self.SIGNS)}]+)(?=[ \t\r])")
        self.words, self.by_words = {}, True
        self.by_words = self.prepares(path) and [self.one(t) for t in PROBES] == self.texts(PROBES)
        # The table outlives a task where Spark keeps its Python worker.
        self.words = process_cache(path)

    @staticmethod
    def prepares(path):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        norm = made.get("normalizer") or {}
        pre = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        signs = [t["content"] for t in made.get("added_tokens") or ()]
        return (
            tuple(n["type"] for n in norm.get("normalizers", ())) == NORMALIZERS
            and (pre[0].get("pattern") or {}).get("Regex") == SPLIT
            and made["model"].get("end_of_word_suffix") == "</w>"
            and all(s.startswith("<|") and s.endswith("|>") for s in signs)
        )

    def one(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def lowered(text):
        """``text`` in lower case, or None where that depends on a letter's
        place (capital sigma) or makes more than letters."""
        low = text.lower()
        return low if "\u03a3" not in text and len(low) == len(text) else None

    def cut(self, text):
        low = None if "<|" in text else self.lowered(text)
        if low is None:
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        low = low.replace("\n", " ") + " "
        plain = low.replace(" ", "").replace(".", "").replace(",", "").isalnum()
        if plain and not (".." in low or ",," in low or ".," in low or ",." in low):
            return low.replace(". ", " . ").replace(", ", " , ").split(" ")
        return self.tail.sub(r"\1 \2", low).split(" ")

    def learn(self, missing):
        """Add stretches to the table."""
        words, new, split = self.words, [], []
        for w in missing:
            if w.isalpha() and w.islower():
                new.append(w)
                continue
            core = w.rstrip(self.SIGNS)
            if core.isalpha() and (low := self.lowered(core)) is not None and low.isalpha():
                split.append((w, low, w[len(core) :]))
            else:
                words[w] = self.one(w)
        new += {low for _, low, _ in split} - words.keys() - set(new)
        for tokenizer, ws in ((self.plain, [w for w in new if w.isascii()]), (self.tokenizer, [w for w in new if not w.isascii()])):
            ids = np.array(tokenizer.encode_batch_fast([" ".join(ws)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(ws):
                raw, at = ids.tobytes(), (4 * ends).tolist()
                words.update((w, raw[a:b]) for w, a, b in zip(ws, [0, *at], at))
            else:
                words.update((w, self.one(w)) for w in ws)
        for w, low, tail in split:
            if tail and tail not in words:
                words[tail] = self.one(tail)
            words[w] = words[low] + words[tail] if tail else words[low]

    def texts(self, texts):
        """The ids of each text, as little-endian 32-bit bytes."""
        if not self.by_words:
            return [self.one(t) for t in texts]
        cut = [self.cut(t) for t in texts]
        if len(self.words) > CACHED_WORDS:
            # The words met first are the frequent ones; the last go.
            for _ in range(len(self.words) - CACHED_WORDS * 7 // 8):
                self.words.popitem()
        self.words[""] = b""
        self.learn(set().union(*cut) - self.words.keys())
        return [b"".join(map(self.words.__getitem__, c)) for c in cut]


def cutter(path, length):
    def run(batches):
        tokens, end = Tokens(path), np.array([END], "<u4").tobytes()
        for b in batches:
            out = [[] for _ in range(5)]
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for i, ids in zip(doc_ids, (x for at in range(0, len(texts), 300) for x in tokens.texts([t or "" for t in texts.slice(at, 300).to_pylist()]))):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    for o, v in zip(out, (i, p, at // 4, len(own) // 4, zlib.crc32(own))):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            release()

    return run


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row.

    A null or empty text is its end token alone.  Repeated rows, and rows without
    an id, are each a document.  Other columns are ignored, whatever their names.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return d.mapInArrow(cutter(tokenizer_path, length), PIECES)


def best_fit(lengths, capacity):
    """Sequences as lists of indices, for ``lengths`` sorted downwards."""
    room, free, out = [[] for _ in range(capacity + 1)], 0, []
    for i, n in enumerate(lengths):
        at = free >> n
        if at:
            r = n + (at & -at).bit_length() - 1
            j = room[r].pop()
            if not room[r]:
                free ^= 1 << r
            out[j].append(i)
        else:
            r, j = capacity, len(out)
            out.append([i])
        r -= n
        if r:
            if not room[r]:
                free |= 1 << r
            room[r].append(j)
    return out


def improve(bins, lengths, capacity, work=WORK):
    """Local search between underfull sequences; ``bins`` without the emptied.

    Rounds go on until one changes nothing, no fewer sequences are possible, or
    ``work`` exchanges have been looked at in all.  Pairs are tried inside
    sequences of at most ``PAIR_PIECES`` pieces.  Only the quality of the
    packing depends on the two bounds.
    """
    lengths = np.asarray(lengths, np.int64)
    bins, done = [list(b) for b in bins], []
    least = -(-int(lengths.sum()) // capacity)
    changed = True
    while changed and work > 0:
        fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
        done += [b for b, f in zip(bins, fill) if f == capacity]
        bins = [b for b, f in zip(bins, fill) if 0 < f < capacity]
        if len(done) + len(bins) <= least:
            break  # no packing has fewer
        fill = fill[(fill > 0) & (fill < capacity)]
        table, changed = _Table(bins, fill, lengths, capacity), False
        for v in np.argsort(fill, kind="stable").tolist():
            for x in sorted(bins[v], key=lambda i: -lengths[i]):
                changed |= table.place(v, [x])
            own = bins[v]
            if 2 <= len(own) <= PAIR_PIECES:
                for a in range(len(own)):
                    for b in range(a + 1, len(own)):
                        changed |= b < len(own) and table.place(v, [own[a], own[b]])
            if table.looked > work:
                break
        work -= table.looked
    return done + [b for b in bins if b]


class _Table:
    """Exchanges open to a sequence: (sequence, pieces given up, their length),
    in the order of the length that the sequence can then take in."""

    def __init__(self, bins, fill, lengths, capacity):
        self.bins, self.fill, self.lengths, self.capacity = bins, fill, lengths, capacity
        where, gives = [], []
        for j, b in enumerate(bins):
            give = [()] + [(i,) for i in b]
            if len(b) <= PAIR_PIECES:
                give += [(b[x], b[y]) for x in range(len(b)) for y in range(x + 1, len(b))]
            where += [j] * len(give)
            gives += give
        w = np.array(where, np.int64)
        s = np.array([sum(int(lengths[i]) for i in g) for g in gives], np.int64)
        fits = capacity - fill[w] + s
        order = np.argsort(fits, kind="stable")
        self.w, self.s, self.fits = w[order], s[order], fits[order]
        self.few = np.array([len(g) < 2 for g in gives], bool)[order]
        self.gives = [gives[i] for i in order.tolist()]
        self.room = int((capacity - fill).max(initial=0))
        self.fresh = np.ones(len(bins), bool)
        self.looked = 0

    def place(self, v, xs):
        """Put ``xs`` of sequence ``v`` into another one for smaller pieces, if
        that makes the squares grow; the one that ends up fullest is taken."""
        if any(x not in self.bins[v] for x in xs):
            return False
        total = sum(int(self.lengths[x]) for x in xs)
        # What is given up must be smaller, so no more than the room is left over.
        at, end = np.searchsorted(self.fits, (total, total + self.room)).tolist()
        step = AT_ONCE
        while at < end:
            part = slice(at, min(at + step, end))
            w, gain = self.w[part], total - self.s[part]
            self.looked += len(w)
            # Squares grow by 2*gain*(other's fill - own fill + gain), gain > 0.
            ok = (gain > 0) & (w != v) & self.fresh[w] & (self.fill[w] + gain > self.fill[v])
            if len(xs) > 1:
                ok &= self.few[part]
            if ok.any():
                at += int(ok.argmax())
                return self._exchange(v, xs, at, total - int(self.s[at]))
            at, step = part.stop, 8 * step
        return False

    def _exchange(self, v, xs, at, gain):
        j, give = int(self.w[at]), self.gives[at]
        self.bins[j] = [i for i in self.bins[j] if i not in give] + list(xs)
        self.bins[v] = [i for i in self.bins[v] if i not in xs] + list(give)
        self.fill[j] += gain
        self.fill[v] -= gain
        self.room = max(self.room, self.capacity - int(self.fill[v]))
        # What the two may give has changed; they are listed anew next round.
        self.fresh[j] = self.fresh[v] = False
        return True


def pack_lengths(lengths, capacity):
    """Sequence number and offset of each piece; lengths need no order."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    bins = improve(best_fit(lengths[order].tolist(), capacity), lengths[order], capacity)
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for s, b in enumerate(bins):
        at = 0
        for i in b:
            seq[order[i]], off[order[i]] = s, at
            at += int(lengths[order[i]])
    return seq, off


def packer(length):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        seq, off = pack_lengths(t.column("length").to_numpy(), length)
        t = t.append_column("sequence_id", pa.array(seq + (TaskContext.get().partitionId() << 40))).append_column("offset", pa.array(off))
        yield from t.to_batches(10_000)

    return run


def pack(parts: DataFrame, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``parts`` (as from ``pieces``) with sequence_id and offset.

    Ties among equal lengths go by doc_id and piece; repeated rows are packed
    each for itself; an empty table gives none.
    """
    parts = saved(parts)
    rest = parts.where(F.col("length") < length)
    shards = max(1, -(-rest.count() // shard_rows))
    full = parts.where(F.col("length") >= length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    # In turn, not by a hash: rows that are alike spread over the shards.  Spark
    # sorts a task's rows first, so a task that is run again deals them as before.
    packed = rest.repartition(shards).mapInArrow(packer(length), PACKED)
    return saved(packed).unionByName(saved(full))
