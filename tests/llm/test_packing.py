import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronofact.llm import queries
from chronofact.llm.packing import Tokens, best_fit, improve, pack, pack_lengths, pieces

PATH = queries.tokenizer_path()


def check(rows, length=2048):
    """Pieces tile their documents, sequences are gapless and not too long."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for own in by_doc.values():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [length * i for i in range(len(own))]
        assert all(r["length"] == length for r in own[:-1]) and 0 < own[-1]["length"] <= length
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return by_doc, by_seq


def test_query_against_the_tokenizer(spark, sf):
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    by_doc, by_seq = check(rows)
    tk = Tokenizer.from_file(PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(docs) == set(by_doc)
    for i, t in docs.items():
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for r in by_doc[i]:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert by_doc[i][-1]["start"] + by_doc[i][-1]["length"] == len(ids)
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 2048) + 1


def test_token_table_equals_the_tokenizer():
    tk, table, rng = Tokenizer.from_file(PATH), Tokens(PATH), random.Random(1)
    texts = ["", " ", "\n\n", "it's don't 've <|endoftext|>x <|ENDOFTEXT|>", "ΑΣ ΣΑΣ.", "日本語　テスト", "e\u0301 a\u0300b", "a..b, c.,d ,e. foo*** bar%%%. \x1c\x0b"]
    texts += ["".join(rng.choice(" \n\tab'sΣİé\u0301\u200d １1.!,<|>中*_") for _ in range(40)) for _ in range(400)]
    for t, ids in zip(texts, table.texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_are_used_as_they_are(tmp_path):
    import json

    text = "Two  Words, and_more THINGS.\n\nx"
    other = queries.tokenizer_path().replace("word_bpe_49k", "byte_bpe_50k")
    cased = json.load(open(PATH))
    cased["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(cased))
    for path in (other, str(tmp_path / "cased.json")):
        t = Tokens(path)
        assert not t.by_words
        assert np.frombuffer(t.texts([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert Tokens(PATH).by_words and Tokens(PATH).words is Tokens(PATH).words


def test_the_search_goes_on_until_nothing_changes():
    rng = random.Random(6)
    lengths = sorted((rng.randint(600, 760) for _ in range(1500)), reverse=True)
    start = best_fit(lengths, 2048)
    short, end = (improve([list(b) for b in start], lengths, 2048, work=w) for w in (10_000_000, 1 << 31))
    assert len(start) > len(short) > len(end)
    assert sorted(i for b in end for i in b) == list(range(1500)) and max(sum(lengths[i] for i in b) for b in end) <= 2048
    again = improve([list(b) for b in end], lengths, 2048)
    assert len(again) == len(end)


def test_rows_alike_do_not_meet_in_one_shard(spark, odd):
    nobody = odd(*["a b c"] * 900).withColumn("doc_id", F.lit(None).cast("long"))
    rows = pack(pieces(nobody, PATH), shard_rows=100).collect()
    shards = {r["sequence_id"] >> 40 for r in rows}
    assert len(rows) == 900 and len(shards) == 9


def test_local_search_empties_sequences():
    lengths = [6, 5, 5, 4, 4, 3, 3]  # best fit needs 4 of 10, three are enough
    assert len(improve([[0, 3], [1, 2], [4, 5, 6]], lengths, 10)) == 3
    assert len(improve([[0], [1, 3], [2, 4], [5, 6]], [6, 5, 5, 4, 4, 3, 3], 10)) == 3
    rng = random.Random(3)
    many = [rng.randint(500, 1500) for _ in range(2000)]
    seq, off = pack_lengths(many, 2048)
    fill = np.bincount(seq, weights=many)
    assert fill.max() <= 2048 and seq.max() + 1 <= len(best_fit(sorted(many, reverse=True), 2048))


def test_edges(spark, odd):
    d = odd(None, "", " ", "word " * 9000, "tie a", "tie b")
    d = d.unionByName(d.where("doc_id = 4"))
    rows = pack(pieces(d, PATH)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["length"])
    assert by[0] == by[1] == by[2] == [1] and sorted(by[3]) == [809, 2048, 2048, 2048, 2048] and by[4] == [3, 3]
    assert pack(pieces(d.where("false"), PATH)).count() == 0
    nobody = d.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))
    assert pack(pieces(nobody, PATH)).first()["length"] == 3


@pytest.mark.parametrize("shard", [1, 3])
def test_shards(spark, odd, shard):
    check(pack(pieces(odd(*["a b c"] * 10), PATH), shard_rows=shard).collect())
