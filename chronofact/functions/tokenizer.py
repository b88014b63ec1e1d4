"""The lexical tokenizer.

``tokens`` is the full rule in Python; ``tokens_udf`` runs it in Arrow batches.
``latin_tokens`` is the same rule as built-in functions for texts of Latin
letters, digits and punctuation, and stays in generated code.

A text is brought to NFKC and lower case; format characters go; an ASCII letter
or digit loses the marks on it (and, by the search policy, Cyrillic io becomes
ie).  Tokens are then runs of letters, digits and marks.  An underscore joins
any of them, an apostrophe two letters, a full stop two letters or two digits,
a comma two digits.  Ideographs and Hiragana give overlapping pairs; Katakana
runs stand alone.  A token is cut to 64 bytes at a character's end.  The words
of Thai, Khmer and their like are not told apart: that needs a dictionary.
"""

import re
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKEN_BYTES = 64

_IGNORED = regex.compile(r"\p{Default_Ignorable_Code_Point}")
_MARKED = regex.compile(r"([a-z0-9])\p{M}+")
_CJK = r"[\p{Ideographic}\p{Script=Hiragana}--\p{M}]"
_KANA = r"[\p{Script=Katakana}ーｰ]"
# What a full stop or an apostrophe joins: letters of scripts that write words apart.
_LETTER, _DIGIT = rf"[\p{{L}}\p{{Alphabetic}}--\p{{N}}--\p{{M}}--{_CJK}--{_KANA}]", r"\p{Nd}"
_RUN = regex.compile(
    rf"(?V1)(?P<cjk>{_CJK}+)|(?P<kana>{_KANA}+)"
    rf"|(?:[[\p{{L}}\p{{N}}\p{{M}}_]--{_CJK}--{_KANA}]"
    rf"|(?<={_LETTER}\p{{M}}*)['’.](?=\p{{M}}*{_LETTER})|(?<={_DIGIT}\p{{M}}*)[.,](?=\p{{M}}*{_DIGIT}))+"
)
_EDGES = regex.compile(r"(?V1)^[_\p{M}]+(?=.)|_[_\p{M}]*$")
_LEXICAL = regex.compile(r"[\p{L}\p{N}\p{Alphabetic}]")


def _base(c: str) -> str:
    """An ASCII letter or digit for a precomposed Latin character on it."""
    if c < "\x80":
        return c
    parts = unicodedata.normalize("NFD", c)
    return "".join(p for p in parts if not unicodedata.category(p).startswith("M")) if parts[0].isascii() and parts[0].isalnum() else c


def _folded(text: str, search: bool) -> str:
    """``text`` normalised until another round changes nothing."""
    while True:
        t = _IGNORED.sub("", unicodedata.normalize("NFKC", text).lower())
        if search:
            t = _MARKED.sub(r"\1", "".join(map(_base, t)) if not t.isascii() else t).replace("ё", "е")
        if t == text:
            return t
        text = t


def _cut(token: str) -> str:
    b = token.encode()
    return token if len(b) <= MAX_TOKEN_BYTES else _EDGES.sub("", b[:MAX_TOKEN_BYTES].decode(errors="ignore"))


# Latin letters with marks and the letters under them, by the rule above.
_WITH = "".join(chr(c) for c in range(0xC0, 0x180) if _base(chr(c).lower()) != chr(c).lower() and len(_base(chr(c).lower())) == 1 and len(chr(c).lower()) == 1)
_UNDER = "".join(_base(c.lower()) for c in _WITH)
# Texts of these characters alone need no rounds of folding: letters that are one
# character in every form, ASCII, and the quotes and dashes of Latin prose.
_LATIN = re.compile(r"[\t\n\r\x20-\x7eßæøœ" + _WITH + r"ÆØŒ«»¿¡–—‘’“”]*")
_LATIN_FOLD = str.maketrans(_WITH, _UNDER)
_LATIN_RUN = re.compile(r"\w+(?:(?:['’.](?<=[^\W\d_].)(?=[^\W\d_])|[.,](?<=\d.)(?=\d))\w+)*")


def _latin(text: str) -> list[str]:
    """``tokens`` of a text that ``_LATIN`` fits."""
    found = _LATIN_RUN.findall(text.lower())
    if not text.isascii():  # a letter stands for one letter, so runs stay as they are
        found = [t if t.isascii() else t.translate(_LATIN_FOLD) for t in found]
    if "_" in text:
        found = [t for w in found if (t := w.strip("_"))]
    return [t if len(t) <= MAX_TOKEN_BYTES // 2 else t if len(t.encode()) <= MAX_TOKEN_BYTES else _cut(t) for t in found]


def tokens(text: str | None, search: bool = True) -> list[str]:
    """The tokens of a text, in order, with repeats; null gives none."""
    if text and (search or text.isascii()) and _LATIN.fullmatch(text):
        return _latin(text)
    out = []
    for m in _RUN.finditer(_folded(text or "", search)):
        t = m[0]
        if m["cjk"]:
            out += [t[i : i + 2] for i in range(len(t) - 1)] or [t]
        else:
            t = _cut(_EDGES.sub("", t))
            if t and _LEXICAL.search(t):
                out.append(t)
    return out


def normalized_name(name: str | None) -> str:
    """The key of an entity's name: its tokens joined by single spaces."""
    return " ".join(tokens(name))


def tokens_udf(search: bool = True):
    """An Arrow-batched function of a string column: array<string>."""
    import pandas as pd

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokens(t, search))

    return run


def latin_tokens(text: Column) -> Column:
    """``tokens`` for composed Latin text, as built-in functions: array<string>."""
    low = F.translate(F.lower(text), "­", "")
    found = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]++(?:(?:['’.](?<=\p{L}.)(?=\p{L})|[.,](?<=\p{Nd}.)(?=\p{Nd}))[\p{L}\p{N}_]++)*+)"), 1)
    # A letter stands for one letter, so runs stay as they are.
    bare = lambda t: F.when(F.octet_length(t) > F.char_length(t), F.translate(t, _WITH, _UNDER)).otherwise(t)
    found = F.when(F.octet_length(low) > F.char_length(low), F.transform(found, bare)).otherwise(found)
    bare = F.filter(F.transform(found, lambda t: F.btrim(t, F.lit("_"))), lambda t: t != "")
    found = F.when(F.contains(low, F.lit("_")), bare).otherwise(found)
    cut = F.transform(found, lambda t: F.when(F.octet_length(t) > MAX_TOKEN_BYTES, F.substring(t, 1, MAX_TOKEN_BYTES)).otherwise(t))
    # Most texts have no long run: they are not looked at word by word.
    found = F.when(F.rlike(low, F.lit(rf"[\p{{L}}\p{{N}}_.,'’]{{{MAX_TOKEN_BYTES // 2},}}+")), cut).otherwise(found)
    return F.coalesce(found, F.array().cast("array<string>"))
