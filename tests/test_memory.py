import json
import os

import numpy as np
import pytest

from chronofact.errors import AlreadyClosed, Corrupt, DimMismatch, Invalid, Locked, NeedsCheckpoint, NotFound, StorageError, TooLarge, VectorSpaceMismatch
from chronofact.plans.memory import Memory, recover
from chronofact.schema import OPEN, Config
from chronofact.sources.embed import EmbedderGate, HashingEmbedder

DAY = 86_400_000


@pytest.fixture
def memory(spark, tmp_path):
    with Memory(spark, str(tmp_path / "m")) as m:
        m.remember("keeps bees behind the orchard", entity="Marta", tags=["hobby"], now=10 * DAY)
        m.remember("repaired the sluice gate", entity="Marta", links=[("employed_by", "Old Mill")], now=40 * DAY)
        m.remember("grinds rye on Fridays", entity="Old Mill", tags=["place:river"], now=90 * DAY)
        m.remember("frost came early this year", now=130 * DAY)
        yield m


def ids(r):
    return [f["fact_id"] for f in r.facts]


def test_recall_by_each_source(memory):
    now = 150 * DAY
    assert ids(memory.recall("bees orchard", now)) == [0]
    assert ids(memory.recall("early frost", now)) == [3]
    walked = memory.recall(now=now, entities=["old MILL"])
    assert ids(walked)[0] == 2 and set(ids(walked)) == {0, 1, 2}
    assert walked.edges == [{"src": "Marta", "rel": "employed_by", "dst": "Old Mill", "provenance": 1}]
    assert ids(memory.recall(now=now, entities=["Old Mill"], graph_depth=0)) == [2]
    both = memory.recall("rye", now, entities=["Marta"])
    assert {f["fact_id"]: f["sources"] for f in both.facts} == {0: 2, 1: 2, 2: 3}
    assert ids(memory.recall(now=now, range=(40 * DAY, 130 * DAY))) == [2, 1]
    assert ids(memory.recall(now=now, tags=["hobby"], range=(0, 200 * DAY))) == [0]
    assert ids(memory.recall("gate", now, tags=["hobby"])) == []
    nothing = memory.recall("bees", now, tags=["unheard"], entities=["Marta"])
    assert not nothing.facts and not nothing.edges and nothing.rendered == ""
    assert ids(memory.recall("rye", now, as_of=89 * DAY)) == [] and ids(memory.recall("rye", now, as_of=90 * DAY)) == [2]
    few = memory.recall("bees gate rye frost", now, k=2)
    assert len(few.facts) == 2 and few.truncated


def test_rendered_block(memory):
    memory.revise(0, "sold the hives", entity="Marta", now=140 * DAY)
    r = memory.recall("hives", 150 * DAY, entities=["Marta"], include_closed=True, graph_depth=0)
    lines = r.rendered.splitlines()
    assert lines[0] == "## memory" and lines[1] == "- [f4] Marta: sold the hives (1970-05; active)"
    assert set(lines[2:]) == {"- [f0] Marta: keeps bees behind the orchard (1970-01 → 1970-05; closed) #hobby", "- [f1] Marta: repaired the sluice gate (1970-02; active)"}
    linked = memory.recall("hives", 150 * DAY, entities=["Marta"], graph_depth=1).rendered
    assert linked.endswith("- links: Marta —employed_by→ Old Mill\n") and "[f0]" not in linked
    assert ids(memory.recall("orchard", 150 * DAY)) == [] and ids(memory.recall("orchard", 150 * DAY, include_closed=True)) == [0]
    small = memory.recall("hives gate", 150 * DAY, token_budget=15)
    assert len(small.facts) == 1 and small.truncated


def test_verbs_and_errors(memory):
    assert memory.revise(2, "grinds wheat", entity="Old Mill", now=145 * DAY)["id"] == 4
    with pytest.raises(AlreadyClosed):
        memory.revise(2, "grinds oats")
    with pytest.raises(NotFound):
        memory.revise(77, "nothing")
    assert memory.forget_many([1, 3, 1]) == [True, True, False]
    assert memory.get(3) is None and memory.get(2)["valid_to"] == 145 * DAY
    with pytest.raises(NotFound):
        memory.forget(77)
    with pytest.raises(NotFound):
        memory.forget_many([0, 77])
    assert memory.get(0) is None  # what comes before the first error stays done
    memory.remember("back again", now=146 * DAY)
    for bad in ({"tags": ["ok", ""]}, {"links": [("near", "weir")]}, {"entity": "--"}, {"metadata": [("k", "1"), ("k", "2")]}, {"vector": [0.5]}):
        with pytest.raises(Invalid):
            memory.remember("anything", **bad)
    with pytest.raises(TooLarge):
        memory.remember("ö" * 2049)
    with pytest.raises(TooLarge):
        memory.remember("anything", tags=[f"t{i}" for i in range(33)])
    memory.remember("a sack of flour", metadata={"weight": "50", "sort": "rye"}, tags=["stock", "stock"])
    assert list(memory.metadata_of(6)) == ["sort", "weight"] and memory.tags_of(6) == ["stock"]
    memory.verify()


def test_similar_and_guarded(memory):
    memory.remember("parks the van on Elm street", entity="Otto")
    hint = memory.remember("parks the van on Oak street", entity="Otto")["similar"]
    assert hint == [(4, pytest.approx(5 / 7))]
    assert memory.remember("parks the van on Oak street", entity="Ida")["similar"] == []
    memory.remember("red green blue teal", entity="palette")
    n = memory.next_fact
    got = memory.remember_guarded("red green blue teal pink", entity="palette")
    assert not got["stored"] and got["similar"] == [(n - 1, pytest.approx(0.8))] and memory.next_fact == n
    memory.forget(n - 1)
    assert memory.remember_guarded("red green blue teal pink", entity="palette")["stored"]
    assert memory.remember_guarded("of nobody")["checked"] is False


def test_many_at_once_equal_one_by_one(spark, tmp_path):
    rows = [{"text": f"note {i} of the {['mill', 'weir', 'barn'][i % 3]}", "entity": f"E {i % 4}", "tags": [f"t{i % 2}"], "links": [("near", f"e  {(i + 1) % 5}")], "now": i} for i in range(20)]
    with Memory(spark, str(tmp_path / "a"), Config(dim=8), HashingEmbedder(8)) as a, Memory(spark, str(tmp_path / "b"), Config(dim=8), HashingEmbedder(8)) as b:
        calls = []
        keep = a.embedder.embed
        a.embedder.embed = lambda texts: calls.append(len(texts)) or keep(texts)
        assert [r["id"] for r in a.remember_many(rows)] == list(range(20)) and calls == [20]
        for r in rows:
            b.remember(r["text"], **{k: v for k, v in r.items() if k != "text"})
        state = lambda m: [sorted(map(str, t.collect())) for t in (m.facts, m.entities, m.edges)]
        assert state(a) == state(b)
        lines = (tmp_path / "a" / "ops.jsonl").read_text().count("\n")
        assert a.forget_many([3, 4, 3]) == [True, True, False] and (tmp_path / "a" / "ops.jsonl").read_text().count("\n") == lines + 2
        with pytest.raises(Invalid):
            a.remember_many([{"text": "fine"}, {"text": "x", "tags": [""]}, {"text": "never"}])
        assert a.next_fact == 21  # what came before the first error stays


def test_links_have_versions(memory):
    memory.link("a", "knows", "b", now=10)
    memory.link("a", "knows", "b", now=20)  # nothing new
    memory.link("A", "knows", "b", provenance=0, now=30)
    assert memory.unlink("a", "knows", "b", now=5) and not memory.unlink("a", "knows", "b") and not memory.unlink("q", "knows", "b")
    got = [(r["provenance"], r["valid_from"], r["valid_to"]) for r in memory.edges.where("rel = 'knows'").orderBy("edge_id").collect()]
    assert got == [(None, 10, 30), (0, 30, 30)]


def test_reopen_replays_and_generations_agree(spark, tmp_path):
    path = str(tmp_path / "m")
    with Memory(spark, path) as m:
        m.remember("one", entity="E", tags=["x", "y"], now=1)
        m.revise(0, "two", entity="E", tags=["x"], now=2)
        m.link("E", "r", "F", provenance=1, now=3)
        with pytest.raises(Locked):
            Memory(spark, path)
        before = [sorted(map(str, t.collect())) for t in (m.facts, m.entities, m.edges)]
    with open(f"{path}/ops.jsonl", "a") as f:
        f.write('{"op": "reme')
    with pytest.raises(NeedsCheckpoint):
        Memory(spark, path, read_only=True)
    with Memory(spark, path) as m:
        assert m.replayed == 3 and m.truncated_tail
        assert [sorted(map(str, t.collect())) for t in (m.facts, m.entities, m.edges)] == before
        m.checkpoint()
        assert m.generation == 1 and not m.store.log_size()
        assert [sorted(map(str, t.collect())) for t in (m.facts, m.entities, m.edges)] == before
        with Memory(spark, path, read_only=True) as reader:
            with pytest.raises(StorageError):
                reader.remember("no")
            m.remember("three", now=4)
            assert reader.facts.count() == 2 and not reader.refresh()
            m.checkpoint()
            assert reader.facts.count() == 2 and reader.refresh() and reader.facts.count() == 3
        m.forget(0)
        assert m.maintain()["purged"] == 1 and m.maintain()["no_op"]
        assert m.remember("four")["id"] == 3  # ids are not used again
        assert [d for d, _ in m.scrub()]


def tables(m):
    return [sorted(map(str, t.collect())) for t in (m.facts, m.entities, m.edges)]


def test_a_crash_between_naming_and_clearing(spark, tmp_path):
    """The log is still there when the generation that holds it is named."""
    path = tmp_path / "m"
    with Memory(spark, str(path)) as m:
        m.remember("first", entity="A", links=[("r", "B")], now=1)
        m.link("A", "r", "B", provenance=None, now=2)
        m.unlink("A", "r", "B", now=3)
        m.link("A", "r", "B", provenance=0, now=4)
        m.forget(0, now=5)
        log = (path / "ops.jsonl").read_text()
        m.checkpoint()
        before = tables(m)
    (path / "ops.jsonl").write_text(log)
    with Memory(spark, str(path)) as m:
        assert m.replayed == 0 and tables(m) == before and not m.store.log_size()
        m.link("A", "r", "C", now=6)
        after = tables(m)
    (path / "ops.jsonl").write_text(log + (path / "ops.jsonl").read_text())
    with Memory(spark, str(path)) as m:
        assert m.replayed == 1 and tables(m) == after


def test_generations_add_folders_until_they_are_merged(spark, tmp_path):
    path = tmp_path / "m"
    with Memory(spark, str(path)) as m:
        for i in range(4):
            m.remember(f"line {i} of the ledger", entity=f"E{i % 2}", links=[("near", "F")], now=i)
            if i:
                m.revise(m.next_fact - 2, f"line {i} anew", entity="E0", now=i)
            m.checkpoint()
        m.forget(1)
        m.unlink("E0", "near", "F", now=9)
        before, found = tables(m), ids(m.recall("ledger anew line", 100))
        assert len(m.store.folders["facts"]) == 4 and len(m.store.folders["fact_changes"]) == 3
        m.checkpoint()
        assert tables(m) == before and ids(m.recall("ledger anew line", 100)) == found
        kept = {f: (path / f).stat().st_mtime_ns for f in m.store.manifest["files"]}
        got = m.maintain("compact")
        assert got["purged"] == 1 and got["edges_compacted"] and got["folders"] == 1 and not any((path / f).exists() for f in kept)
        assert [r for r in before[0] if "fact_id=1," not in r] == tables(m)[0] and before[1:] == tables(m)[1:]
        assert ids(m.recall("ledger anew line", 100)) == found
        m.verify()
        assert [d for d, _ in m.scrub()] and m.stats()["terms"] == 9
    with Memory(spark, str(path)) as m:
        assert ids(m.recall("ledger anew line", 100)) == found


def test_forgetting_often_enough_maintains(spark, tmp_path):
    with Memory(spark, str(tmp_path / "m"), maintain_forgets=2) as m:
        m.remember_many([{"text": f"t{i}", "entity": "E", "links": [("r", f"F{i}")]} for i in range(5)])
        m.forget(0)
        assert m.stats()["tombstones"] == 1 and m.generation == 0
        m.forget(3)
        got = m.stats()
        assert (got["tombstones"], got["facts"], got["next_fact"]) == (0, 3, 5) and got["pool_bytes"] > 0 and got["shards"]["facts"] >= 1
        report = m.maintain("full")
        assert report["edges_before"] == report["edge_versions_before"] == 5 and report["bytes_before"] > 0 < report["bytes_after"]


def test_pins_of_dead_processes_do_not_count(spark, tmp_path):
    import socket
    import subprocess
    import sys

    path = tmp_path / "m"
    with Memory(spark, str(path)) as m:
        m.remember("a")
        m.checkpoint()
        gone = subprocess.Popen([sys.executable, "-c", ""])
        gone.wait()
        for pid, host in ((gone.pid, socket.gethostname()), (1, "elsewhere")):
            (path / "pins" / f"1-{pid}-x").write_text(json.dumps({"host": host, "folders": ["gen=1/facts" if pid == 1 else "gen=1/edges"]}))
        m.maintain("full")
        assert (path / "gen=1" / "facts").exists() and not (path / "gen=1" / "edges").exists()
        assert not (path / "pins" / f"1-{gone.pid}-x").exists()


def test_executors_need_no_copy_of_the_package(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1g").getOrCreate()
from chronofact.plans.memory import Memory
with Memory(spark, {str(tmp_path / "m")!r}) as m:
    m.remember("one fact", entity="E")
    m.checkpoint()
    m.load(spark.createDataFrame([(0, "two", "F")], "ordinal long, text string, entity string"))
    print("found", [f["fact_id"] for f in m.recall("two").facts])
"""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(__import__("pyspark").__file__)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_HOME": home}
    got = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found [1]" in got.stdout, got.stderr[-3000:]


def test_log_damage_and_scrub(spark, tmp_path):
    path = tmp_path / "m"
    with Memory(spark, str(path)) as m:
        m.remember("a")
        m.checkpoint()
        part = next(path.rglob("facts/*.parquet"))
        part.write_bytes(part.read_bytes()[:-9] + b"x" * 9)
        with pytest.raises(Corrupt):
            list(m.scrub())
    (path / "ops.jsonl").write_text("{broken\n" + json.dumps({"op": "forget", "now": 1, "id": 0}) + "\n")
    with pytest.raises(Corrupt):
        Memory(spark, str(path))


def test_remove_tag(spark, tmp_path):
    with Memory(spark, str(tmp_path / "m")) as m:
        m.remember("a", tags=["remove-me", "keep"], now=1)
        m.remember("b", tags=["keep", "remove-me"], now=2)
        assert m.remove_tag("remove-me", now=10) == {"affected": 2} and m.remove_tag("nope") == {"affected": 0}
        assert m.next_fact == 4 and m.list_tags()["items"] == [("keep", 2)]
        assert ids(m.recall("a", 20, tags=["remove-me"], as_of=5)) == [0]
        with pytest.raises(Invalid):
            m.remove_tag("")


def test_bulk_load_equals_single_verbs(spark, tmp_path):
    rows = [(i, f"text {i}", ["Ann", "bob", "ANN", None][i % 4], ["t"]) for i in range(12)]
    with Memory(spark, str(tmp_path / "a")) as a, Memory(spark, str(tmp_path / "b")) as b:
        a.remember("first", entity="bob", now=1)
        b.remember("first", entity="bob", now=1)
        assert a.load(spark.createDataFrame(rows, "ordinal long, text string, entity string, tags array<string>"), now=5) == 1
        for _, text, entity, tags in rows:
            b.remember(text, entity=entity, tags=tags, now=5)
        x, y = ({r["fact_id"]: (r["text"], r["entity"], r["entity_id"]) for r in m.facts.collect()} for m in (a, b))
        assert x == y and a.remember("next")["id"] == b.remember("next")["id"] == 13


def test_vectors_and_reembedding(spark, tmp_path):
    e = HashingEmbedder(16)
    with Memory(spark, str(tmp_path / "m"), Config(dim=16), embedder=e) as m:
        m.remember("red apples", now=1)
        m.remember("blue sky", now=2)
        assert m.vector_space == "hashing-16"
        with pytest.raises(VectorSpaceMismatch):
            m.claim_vector_space("other")
        with pytest.raises(DimMismatch):
            m.remember("x", vector=[1.0] * 3)
        assert ids(m.recall("zzz", 10, vector=e.embed(["red apples"])[0]))[0] == 0
        assert m.reembed(HashingEmbedder(8)) == {"reembedded": 2, "dim": 8}
        assert m.config.dim == 8 and m.vector_space == "hashing-8"
        m.verify()


def test_recall_many_equals_single_recalls(spark, tmp_path):
    from chronofact.functions.tokenizer import tokens
    from chronofact.plans.memory import stored_vector
    from chronofact.plans.recall import recall_many

    e = HashingEmbedder(16)
    with Memory(spark, str(tmp_path / "m"), Config(dim=16)) as m:
        for i in range(30):
            text = f"note {i} about {['rivers', 'hills', 'towns'][i % 3]}"
            m.remember(text, entity=f"E{i % 5}", links=[("near", f"E{(i + 1) % 5}")], vector=e.embed([text])[0], now=i * DAY)
        m.forget(4)
        m.checkpoint()
        asked = [("rivers towns", ["E1"], (5 * DAY, 20 * DAY)), ("hills note", ["E3", "E0"], (0, 9 * DAY)), ("nothing here", [], (40 * DAY, 50 * DAY))]
        q = spark.createDataFrame([(i, 25 * DAY, tokens(t), *r) for i, (t, _, r) in enumerate(asked)], "query_id long, now long, terms array<string>, from_ms long, to_ms long")
        anchors = spark.createDataFrame([(i, m.entity(n), p) for i, (_, ns, _) in enumerate(asked) for p, n in enumerate(ns)], "query_id long, entity_id long, pos int")
        made = [(i, stored_vector(e.embed([t])[0])) for i, (t, _, _) in enumerate(asked)]
        vectors = spark.createDataFrame(made, "query_id long, vector struct<scale:double,q:array<tinyint>,sig:array<long>>")
        got = recall_many(m.facts, (m.postings, m.lengths), q, m.config, anchors=anchors, edges=m.edges, vectors=vectors).orderBy("query_id", "rank").collect()
        for i, (t, ns, r) in enumerate(asked):
            one = m.recall(t, 25 * DAY, e.embed([t])[0], entities=ns, range=r)
            assert [(x["fact_id"], x["sources"]) for x in got if x["query_id"] == i] == [(f["fact_id"], f["sources"]) for f in one.facts]
            assert [x["score"] for x in got if x["query_id"] == i] == pytest.approx([f["score"] for f in one.facts], abs=1e-8)


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    near = lambda i: (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()
    with Memory(spark, str(tmp_path / "m"), Config(dim=16, flat_to_hnsw=200)) as m:
        flat = {}
        m.remember_many([{"text": f"n{i}", "vector": near(i), "now": i} for i in range(400)])
        asked = [near(i) for i in range(6)]
        for n, v in enumerate(asked):
            flat[n] = ids(m.recall(vector=v, now=10**6, k=10, token_budget=10**6))
        got = m.maintain("optimize_vectors")
        assert got["hnsw_rebuilt"] and got["hnsw_indexed_after"] == 400 == m.stats()["hnsw_indexed"] and not got["no_op"]
        assert m.maintain("optimize_vectors")["no_op"] and 1 <= m.cells["probes"] < len(m._nearest().centres) == 20
        for n, v in enumerate(asked):
            assert len(set(ids(m.recall(vector=v, now=10**6, k=10, token_budget=10**6))) & set(flat[n])) >= 9
        late = m.remember("late", vector=asked[0], now=500)["id"]
        m.forget(flat[0][0])
        assert ids(m.recall(vector=asked[0], now=10**6, k=3))[0] == late and flat[0][0] not in ids(m.recall(vector=asked[0], now=10**6))
        assert ids(m.recall(vector=asked[0], now=10**6, ef=10**6, k=10, token_budget=10**6))[1:] == flat[0][1:10]
        assert m.maintain("full")["hnsw_indexed_after"] == 400
        m.verify()


def test_recall_of_cells(spark):
    from chronofact.operators import cells
    from chronofact.plans import views

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    v = views.quantized(spark, folder).select("slot", "fact_id", "vector")
    centres = cells.fit(v)
    index = cells.filed(v, centres).cache()
    probes = cells.calibrate(index, centres)
    asked = v.where("slot % 20 = 0").select(v.slot.alias("query_id"), "vector")
    exact, found = ({(r["query_id"], r["slot"]) for r in cells.search(index, centres, asked, n).collect()} for n in (len(centres), probes))
    assert index.count() == v.count() and len(exact) == 10 * asked.count()
    print("cells", len(centres), "looked into", probes, "recall", len(exact & found) / len(exact))
    assert len(exact & found) >= 0.9 * len(exact)


def test_embedder_policy():
    class Broken:
        dim, space_id = 1, "b"

        def embed(self, texts):
            raise OSError("down")

    t = [0.0]
    g = EmbedderGate(Broken(), "degrade", lambda: t[0])
    assert g.embed(["x"]) is None and g.state == "backoff" and g.wait == 1
    for want in (2, 4, 8, 16, 32, 60, 60):
        t[0] = g.until
        g.embed(["x"])
        assert g.wait == want
    g.suspend()
    assert g.state == "suspended"
    g.resume()
    assert g.state == "ready"


def test_jsonl_round_trip(spark, tmp_path, memory):
    memory.forget(3)
    out = tmp_path / "x.jsonl"
    memory.export_jsonl(str(out))
    lines = [x for p in sorted(out.glob("part-*")) for x in p.read_text().splitlines()]
    assert [json.loads(x)["kind"] for x in lines] == ["fact"] * 3 + ["edge"]
    with Memory(spark, str(tmp_path / "copy")) as c:
        assert c.import_lines(["", *lines, '{"text": "no kind"}'], now=7) == {"facts": 4, "edges": 1}
        e = c.edges.first()
        assert c.get(e["provenance"])["text"] == "repaired the sluice gate" and c.get(0)["valid_to"] == OPEN
        with pytest.raises(Invalid, match="line 1"):
            c.import_lines(['{"kind": "x"}'])


def test_recover_and_pages(spark, tmp_path, memory):
    assert [f["fact_id"] for f in memory.export_page(1, 2)["facts"]] == [1, 2]
    assert memory.export_page(3, 2)["next_cursor"] is None
    seen = []
    assert memory.export_each(lambda f: seen.append((f["fact_id"], f["entity"]))) == 4 and seen == [(0, "Marta"), (1, "Marta"), (2, "Old Mill"), (3, None)]
    memory.checkpoint()
    got = recover(spark, str(memory.store.path), str(tmp_path / "new"))
    assert got == {"kept": 4, "dropped_text": 0, "dropped_vector": 0, "dropped_metadata": 0}
    with Memory(spark, str(tmp_path / "new")) as m:
        assert m.stats()["facts"] == 4 and m.remember("x")["id"] == 4
    with pytest.raises(Invalid):
        recover(spark, str(memory.store.path), str(memory.store.path))
