"""Secret scan: keyword automaton, anchored patterns at its hits, checksums.

One pass over the texts, no shuffle.  An Aho-Corasick automaton over ASCII-
lower-cased text finds the places where a keyword stands; the pattern of the
keyword's kind is then matched at that place alone.  Kinds that embed a
checksum are kept only if it holds.  Runs of hexadecimal digits have no
keyword; they are found as runs of a class of bytes, many texts at once.

Kinds, in the order used to break ties: assign, access, hex, github, npm.
"""

import binascii
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import byte_class, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "github", "npm")
# Keywords, patterns and least lengths of the scan's kinds.
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
ACCESS = r"AKIA[A-Z0-9]+"
HEX = byte_class((0x30, 0x39), (0x61, 0x66))
GITHUB = r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"
NPM = r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """Six base-62 digits of the CRC-32 of ``body``."""
    n, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def hex_runs(data, offs):
    """{text: [(start, end), ...]} of long enough runs of hexadecimal digits, in
    code points of the text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = HEX[data]
    edge = inside[1:] != inside[:-1]
    edge[offs] = inside[1:][offs] | inside[:-1][offs]  # runs end where texts do
    at = np.flatnonzero(edge)
    # Between two edges all bytes are alike, so a run is an edge and the next.
    start, end = at[:-1], at[1:]
    run = inside[1:][start] & (end - start >= HEX_LENGTH)
    out = {}
    if run.any():
        start, end = start[run], end[run]
        text = np.searchsorted(offs, start, side="right") - 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for i, s, e in zip(text.tolist(), (points[start] - points[offs[text]]).tolist(), (points[end] - points[offs[text]]).tolist()):
            out.setdefault(i, []).append((s, e))
    return out


class Scanner:
    """Spans are sorted (start, kind index, end) in code points, end exclusive."""

    def __init__(self):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for w in ASSIGN_KEYWORDS:
            self.auto.add_word(w, (len(w), 0))
        self.auto.add_word("akia", (4, 1))
        for c in "pousr":
            self.auto.add_word(f"gh{c}_", (4, 3))
        self.auto.add_word("npm_", (4, 4))
        self.auto.make_automaton()
        self.anchored = {0: re.compile(ASSIGN, re.I | re.A), 1: re.compile(ACCESS), 3: re.compile(GITHUB), 4: re.compile(NPM)}

    @staticmethod
    def valid(kind, m):
        if kind == 0:
            return len(m[2]) >= ASSIGN_VALUE
        if kind == 1:
            return m.end() - m.start() >= ACCESS_LENGTH
        return checksum62(m[1]) == m[2]

    def column(self, texts):
        """Spans of each text of an Arrow column; nulls have none."""
        for row, data, offs in slices(texts):
            hexes = hex_runs(data, offs)
            for i in range(len(offs) - 1):
                yield self.spans(texts[row + i].as_py() or "", hexes.get(i, ()))

    def spans(self, text, hexes):
        """Spans of one text; ``hexes``: where its runs of digits stand."""
        out = [(s, 2, e) for s, e in hexes]
        # Bytes lower-case A-Z alone, which keeps every code point's place.
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        hits = sorted((end - n + 1, kind) for end, (n, kind) in self.auto.iter(low))
        passed = dict.fromkeys(self.anchored, 0)
        for at, kind in hits:
            if at >= passed[kind] and (m := self.anchored[kind].match(text, at)):
                passed[kind] = m.end()  # what is dropped below still takes its place
                if self.valid(kind, m):
                    out.append((at, kind, m.end()))
        out.sort()
        return out


def _scan(batches):
    scanner = Scanner()
    for b in batches:
        rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in scanner.column(b.column("text"))]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>), a row for each input row.

    Null and empty texts have no spans; repeated rows are scanned each for
    itself; other columns are ignored, whatever their names.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return d.mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text, spans, mark="[SECRET]"):
    """``text`` with every span, overlapping ones joined, replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` masked and ``n_chars`` brought up to date.

    No row goes; a null text stays null, with the ``n_chars`` it has.  Python
    gives back the texts that it changes, and nulls for the others.
    """

    @F.arrow_udf("string")
    def changed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner()
        for column in texts:
            yield pa.array([redacted(t.as_py(), spans) if spans else None for t, spans in zip(column, scanner.column(column))], pa.string())

    out = docs.withColumn("text", F.coalesce(changed(docs["text"]), docs["text"]))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return out.select(*docs.columns)
