import json

import pytest

from chronofact import cli, settings
from chronofact.errors import AtCapacity, BadName, ConfigMismatch, InUse, Invalid, NoSuchDatabase
from chronofact.plans.memory import Memory
from chronofact.schema import Config
from chronofact.server import Server
from chronofact.streaming import oplog
from chronofact.workspace import OPEN_MAX, Workspace, checked_name


def call(spark, tmp_path, *argv, lines=None):
    return cli.main(["--database", str(tmp_path / "db"), *argv], spark, lines)


def test_cli(spark, tmp_path, capsys):
    assert call(spark, tmp_path, "remember", "likes green tea", "--entity", "Ann", "--tag", "pref", "--link", "knows:Bob", "--meta", "a=1") == 0
    assert json.loads(capsys.readouterr().out)["id"] == 0
    assert call(spark, tmp_path, "recall", "green tea") == 0
    assert "- [f0] Ann: likes green tea" in capsys.readouterr().out
    assert call(spark, tmp_path, "revise", "0", "likes black tea", "--entity", "Ann") == 0
    assert call(spark, tmp_path, "revise", "0", "x") == 1 and call(spark, tmp_path, "show", "9") == 1
    assert call(spark, tmp_path, "nonsense") == 2 and call(spark, tmp_path, "remember", "x", "--entity", "!") == 2
    capsys.readouterr()
    for argv in (["tags"], ["stats"], ["verify"], ["maintain", "--mode", "full"], ["scrub"], ["link", "Ann", "likes", "tea"], ["unlink", "Ann", "likes", "tea"], ["checkpoint"], ["export", str(tmp_path / "out")], ["forget", "1"], ["remove-tag", "pref"]):
        assert call(spark, tmp_path, *argv) == 0, argv
    assert call(spark, tmp_path, "repl", lines=["remember 'from the loop'", "bad", "stats"]) == 0
    assert call(spark, tmp_path, "recover", str(tmp_path / "copy")) == 0
    with Memory(spark, str(tmp_path / "copy")) as m:
        assert m.get(2)["text"] == "from the loop"


def test_cli_workspace(spark, tmp_path, capsys):
    w = ["--workspace", str(tmp_path / "w"), "workspace"]
    assert cli.main([*w, "use", "notes"], spark) == 0
    assert cli.main([*w, "verify"], spark) == 1
    assert cli.main([*w, "describe", "notes", "notes about rivers", "--owner", "me"], spark) == 0
    assert cli.main([*w, "verify"], spark) == 0
    capsys.readouterr()
    assert cli.main([*w, "find", "rivers"], spark) == 0
    assert json.loads(capsys.readouterr().out) == [{"name": "notes", "exists": True}]
    assert cli.main([*w, "archive", "notes"], spark) == 0 and cli.main([*w, "archive", "notes"], spark) == 1


def test_workspace_issues(spark, tmp_path):
    w = Workspace(spark, str(tmp_path))
    w.describe("a", "about rivers")
    w.describe("b", "about hills")
    w.describe("c", "gone")
    w.get("a").remember("about lakes", entity="self")
    for text in ("about hills", "about dales"):
        w.get("b").remember(text, entity="self")
    w.get("d").remember("x")
    assert {(i["name"], i["issue"]) for i in w.verify()} == {("a", "stale"), ("b", "ambiguous self"), ("c", "missing"), ("d", "undescribed")}
    w.close_all()


def test_names():
    for bad in ("", "A", "-a", "con", "lpt1", "a.b", "x" * 65):
        with pytest.raises(BadName):
            checked_name(bad)
    assert checked_name("a-1_b") == "a-1_b"


def test_pool(spark, tmp_path):
    t = [0.0]
    w = Workspace(spark, str(tmp_path), clock=lambda: t[0])
    with pytest.raises(NoSuchDatabase):
        w.get("a", create=False)
    for i in range(OPEN_MAX):
        t[0] += 1
        w.lease(f"s{i}")
    with pytest.raises(AtCapacity):
        w.get("more")
    with pytest.raises(InUse):
        w.close("s0")
    w.release("s1")
    w.get("more")
    assert "s1" not in w.open and len(w.open) == OPEN_MAX
    t[0] += 100
    assert w.close_idle() == 1 and w.reindex() == OPEN_MAX + 1
    w.close_all()


def test_settings(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('database = "file"\nodd = 1\n[engine]\ndim = 8\nwrong = 2\n[recall]\nrrf_k = 10.0\n')
    s = settings.load({}, str(f), {})
    assert (s.database, s.config().dim, s.config().rrf_k) == ("file", 8, 10.0) and len(s.warnings) == 2
    assert settings.load({}, str(f), {"CHRONOFACT_DATABASE": "env"}).database == "env"
    assert settings.load({"database": "flag"}, str(f), {"CHRONOFACT_DATABASE": "env"}).database == "flag"
    with pytest.raises(Invalid):
        settings.load({}, str(tmp_path / "none.toml"), {})
    for bad in ({"CHRONOFACT_EMBEDDER_POLICY": "shrug"}, {"CHRONOFACT_CHECKPOINT_OPS": "0"}):
        with pytest.raises(Invalid):
            settings.load({}, str(f), bad)
    assert settings.load({}, str(f), {"CHRONOFACT_CHECKPOINT_OPS": "5"}).checkpoint_ops == 5
    with pytest.raises(Invalid):
        Config(bm25_b=2).validate()
    assert Config(rrf_k=5).reconciled(Config(dim=4)).dim == 4
    with pytest.raises(ConfigMismatch):
        Config(dim=3).reconciled(Config(dim=4))


def test_streams(spark, tmp_path):
    ops = [(0, "remember", {"text": "a", "entity": "E", "tags": ["x"]}), (1, "revise", {"target": 0, "text": "b", "entity": "E"}), (2, "link", {"src": "E", "rel": "r", "dst": "F"})]
    (tmp_path / "in").mkdir()
    for n in range(2):  # the same file twice: nothing is applied again
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"seq": s, "op": o, "now": s + 1, "payload": json.dumps(p)}) + "\n" for s, o, p in ops))
    with Memory(spark, str(tmp_path / "m")) as m:
        q = oplog.apply_stream(m, oplog.read_ops(spark, str(tmp_path / "in"), 1), str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()
        assert m.next_fact == 2 and m.edges.count() == 1
        one = spark.createDataFrame([(s, o, s + 1, json.dumps(p)) for s, o, p in ops], oplog.OPS)
    with Memory(spark, str(tmp_path / "m")) as m:  # opened again, from its log
        assert oplog.apply_batch(m, one) == 0 and m.next_fact == 2
        m.checkpoint()
    with Memory(spark, str(tmp_path / "m")) as m:  # and from its tables
        more = spark.createDataFrame([(4, "remember", 5, '{"text": "d"}'), (3, "remember", 4, '{"text": "c"}'), (2, "link", 3, "{}")], oplog.OPS)
        assert oplog.apply_batch(m, more) == 2 and [m.get(i)["text"] for i in (2, 3)] == ["c", "d"] and m.stream_seq == 4
    rows = spark.createDataFrame([(0, ["x", "y"]), (1000, ["x"]), (90_000_000, ["x"])], "recorded_at long, tags array<string>")
    rows.write.parquet(str(tmp_path / "facts"))
    s = oplog.tag_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "facts"))).writeStream.format("memory").queryName("tag_counts").outputMode("complete").start()
    s.processAllAvailable()
    s.stop()
    assert sorted((r["tag"], r["count"]) for r in spark.table("tag_counts").collect()) == [("x", 1), ("x", 2), ("y", 1)]


def tool(server, name, **arguments):
    r = server.handle({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})["result"]
    return r["content"][0]["text"] if r["isError"] else json.loads(r["content"][0]["text"])


def test_server(spark, tmp_path):
    path = str(tmp_path / "m")
    with Memory(spark, path) as m:
        s = Server(m)
        out = []
        s.serve(['{"id": 1, "method": "initialize"}', "", "{", '{"method": "notifications/initialized"}', '{"id": 2, "method": "ping"}', '{"id": 3, "method": "nope"}'], out.append)
        answers = [json.loads(x) for x in out]
        assert answers[0]["result"]["capabilities"] == {"tools": {}} and [a.get("error", {}).get("code") for a in answers] == [None, -32700, None, -32601]
        assert len(s.handle({"id": 1, "method": "tools/list"})["result"]["tools"]) == 17
        assert tool(s, "remember", text="owns a boat", entity="Ann", tags=["t"])["id"] == 0
        assert tool(s, "recall", text="boat", entities=["ann"])["facts"][0]["fact_id"] == 0
        assert tool(s, "revise", target=0, text="owns two boats", entity="Ann")["id"] == 1
        assert tool(s, "link", src="Ann", rel="has", dst="boat") is None and tool(s, "unlink", src="Ann", rel="has", dst="boat") == {"closed": True}
        assert tool(s, "show", id=1)["text"] == "owns two boats" and len(tool(s, "export")["facts"]) == 1
        assert "NotFound" in tool(s, "forget", ids=[9]) and "Invalid" in tool(s, "refresh") and "needs text" in tool(s, "remember") and "has no x" in tool(s, "stats", x=1)
        for name in ("tags", "stats", "verify", "checkpoint", "maintain", "version", "about", "settings_help"):
            assert "Error" not in str(tool(s, name))
        with Memory(spark, path, read_only=True) as r:
            ro = Server(r)
            assert "Invalid" in tool(ro, "remember", text="x") and tool(ro, "generation") == {"generation": 1} and tool(ro, "refresh") == {"newer": False}
    w = Workspace(spark, str(tmp_path / "w"))
    ws = Server(workspace=w, default="notes")
    assert "NoSuchDatabase" in tool(ws, "stats", db="none") and tool(ws, "remember", text="hi")["id"] == 0
    assert tool(ws, "workspace_list") == ["notes"] and tool(ws, "workspace_find", query="hi") == []
    w.close_all()
