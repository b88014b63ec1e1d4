import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofact.functions import tokenizer
from chronofact.functions.tokenizer import latin_tokens, normalized_name, tokens, tokens_udf

RULES = {
    "nothing but signs": {"¿?—…": [], "\r\n (/) ~": []},
    "an apostrophe joins two letters": {"the ship's crew' at 6'2": ["the", "ship's", "crew", "at", "6", "2"], "l’orage": ["l’orage"]},
    "a full stop joins letters, or digits": {"e.g. 10.25 kg": ["e.g", "10.25", "kg"], "stop.Start 7.x x.7": ["stop.start", "7", "x", "x", "7"]},
    "a comma joins digits alone": {"12,500 red,green 8,z": ["12,500", "red", "green", "8", "z"]},
    "underscores join, and go at the ends": {"max_depth_2 __init__ _": ["max_depth_2", "init"]},
    "letters and digits are one run": {"b52 mp3s re-2x": ["b52", "mp3s", "re", "2x"]},
    "compatibility forms": {"ｋｍ² ①": ["km2", "1"], "ﬂow Ⅷ": ["flow", "viii"]},
    "invisible characters": {"so­nett zero‍width": ["sonett", "zerowidth"]},
    "marks on ASCII letters go": {"señal Ångström crème": ["senal", "angstrom", "creme"], "ὥρα": ["ὥρα"]},
    "Cyrillic io": {"щётка край": ["щетка", "край"]},
    "pairs of ideographs and Hiragana": {"山川湖 火": ["山川", "川湖", "火"], "そらの色": ["そら", "らの", "の色"], "湖lake山川": ["湖", "lake", "山川"]},
    "runs of Katakana and Hangul": {"ラジオ カー": ["ラジオ", "カー"], "서울 사람": ["서울", "사람"]},
    "pictures are no words": {"tea☕time 🚲": ["tea", "time"]},
    "64 bytes, whole characters": {"z" * 70: ["z" * 64], "щ" * 40: ["щ" * 32], "ह" * 30: ["ह" * 21], "ab" + "ß" * 40: ["ab" + "ß" * 31]},
}
TEXTS = [t for group in RULES.values() for t in group]


@pytest.mark.parametrize("rule", RULES)
def test_rule(rule):
    assert {t: tokens(t) for t in RULES[rule]} == RULES[rule]


def test_policies_null_and_names():
    assert tokens("щётка señal", search=False) == ["щётка", "señal"]
    assert tokens(None) == tokens("") == []
    assert normalized_name(" Old   Mill, (Señor) ") == "old mill senor"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_tokens_are_a_fixed_point(text):
    for t in tokens(text):
        assert tokens(t) == [t]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aZ09_ .,'’\n-ßæÆœøÉñçŁžİıŠ–“*", max_size=40))
def test_latin_texts_take_a_short_way_to_the_same_tokens(text):
    assert tokenizer.tokens(text) == full(text)


def full(text):
    fits, tokenizer._LATIN = tokenizer._LATIN, re.compile("(?!)")
    try:
        return tokenizer.tokens(text)
    finally:
        tokenizer._LATIN = fits


def test_every_latin_letter_takes_the_same_way():
    for c in (chr(i) for i in range(0x20, 0x250)):
        for t in (c, f"a{c}b", f"1{c}2", f"a.{c}", f"{c}'b", c * 70):
            assert tokens(t) == full(t), (hex(ord(c)), t)


def test_columns_agree_with_python(spark):
    texts = [*TEXTS, None, "Señor_x l'été 1.a a.1 1'2 a_.b x..y 3.,4 _'a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = rows.select("i", tokens_udf()("text").alias("full"), latin_tokens(rows.text).alias("latin")).orderBy("i").collect()
    for t, r in zip(texts, got):
        assert r["full"] == tokens(t)
        if t is None or t.isascii() or "Señor" in t:
            assert r["latin"] == tokens(t)
