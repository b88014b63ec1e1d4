"""A memory, or a workspace of them, as tools over JSON-RPC lines.

One request a line on standard input, one answer a line on standard output; the
methods are those of the Model Context Protocol: initialize, ping, tools/list
and tools/call.  A server that only reads offers no write verbs.
"""

import argparse
import json
import sys

from . import settings as settings_
from .errors import EngineError, Invalid
from .plans.memory import Memory
from .schema import Config
from .workspace import Workspace

PROTOCOL = "2024-11-05"
TEXT, NUMBER, FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
TEXTS, NUMBERS, FLOATS = ({"type": "array", "items": t} for t in (TEXT, NUMBER, {"type": "number"}))
FACT = {"text": TEXT, "entity": TEXT, "tags": TEXTS, "links": {"type": "array"}, "metadata": {"type": "object"}, "vector": FLOATS, "valid_from": NUMBER, "now": NUMBER}
EDGE = {"src": TEXT, "rel": TEXT, "dst": TEXT}

#: name: (description, arguments, required ones, whether it only reads)
TOOLS = {
    "remember": ("Store a fact; guarded refuses near repeats.", FACT | {"guarded": FLAG}, ["text"], False),
    "recall": ("Find facts by words, vector, entities and time.", {"text": TEXT, "vector": FLOATS, "tags": TEXTS, "entities": TEXTS, "as_of": NUMBER, "range": NUMBERS, "k": NUMBER, "token_budget": NUMBER, "include_closed": FLAG, "graph_depth": NUMBER, "ef": NUMBER, "now": NUMBER}, [], True),
    "revise": ("Close a fact and store its successor.", {"target": NUMBER} | FACT, ["target", "text"], False),
    "forget": ("Hide facts from every instant.", {"ids": NUMBERS}, ["ids"], False),
    "remove_tag": ("Make all current facts with a tag anew without it.", {"tag": TEXT}, ["tag"], False),
    "link": ("Open an edge between entities.", EDGE | {"provenance": NUMBER, "now": NUMBER}, ["src", "rel", "dst"], False),
    "unlink": ("Close an edge.", EDGE | {"now": NUMBER}, ["src", "rel", "dst"], False),
    "show": ("One fact.", {"id": NUMBER}, ["id"], True),
    "stats": ("Counts.", {}, [], True),
    "tags": ("A page of tags with counts.", {"prefix": TEXT, "cursor": TEXT, "limit": NUMBER}, [], True),
    "export": ("A page of current facts by id.", {"cursor": NUMBER, "limit": NUMBER}, [], True),
    "maintain": ("Purge what was forgotten.", {"mode": TEXT}, [], False),
    "checkpoint": ("Write the log as a generation.", {}, [], False),
    "verify": ("Check every invariant.", {}, [], True),
    "generation": ("The generation that is read.", {}, [], True),
    "refresh": ("Move to what is published now.", {}, [], True),
    "version": ("The library's version.", {}, [], True),
    "about": ("What this server is.", {}, [], True),
    "settings_help": ("The settings and their defaults.", {}, [], True),
}
ONLY_READERS = {"generation", "refresh"}
OF_WORKSPACE = {
    "workspace_list": ("Names of stores.", {}, [], True),
    "workspace_find": ("Stores whose descriptions match.", {"query": TEXT, "k": NUMBER}, ["query"], True),
}
VERSION = "0.1.0"


def call(m: Memory, name: str, a: dict):
    """What a tool answers."""
    a = dict(a)
    if name == "remember":
        return (m.remember_guarded if a.pop("guarded", False) else m.remember)(**a)
    if name == "recall":
        return m.recall(a.pop("text", None), a.pop("now", None), a.pop("vector", None), **{k: tuple(v) if isinstance(v, list) else v for k, v in a.items()}).__dict__
    if name == "forget":
        return {"forgotten": m.forget_many(a["ids"])}
    if name == "unlink":
        return {"closed": m.unlink(**a)}
    if name == "show":
        f = m.get(a["id"])
        return f and {k: v for k, v in f.items() if k != "vector"}
    if name == "tags":
        return m.list_tags(a.get("prefix", ""), a.get("cursor"), a.get("limit", 0))
    if name == "export":
        page = m.export_page(a.get("cursor"), a.get("limit", 1000))
        return page | {"facts": [{k: v for k, v in f.items() if k != "vector"} for f in page["facts"]]}
    if name == "version":
        return {"version": VERSION}
    if name == "about":
        return {"about": __doc__.split("\n")[0], "path": str(m.store.path), "read_only": m.store.read_only}
    if name == "settings_help":
        return Config().to_dict()
    if name == "generation":
        return {"generation": m.generation}
    if name == "refresh":
        return {"newer": m.refresh()}
    return {"revise": m.revise, "remove_tag": m.remove_tag, "link": m.link, "stats": m.stats, "maintain": m.maintain, "checkpoint": m.checkpoint, "verify": m.verify}[name](**a)


class Server:
    def __init__(self, memory: Memory | None = None, workspace: Workspace | None = None, default: str | None = None):
        self.memory, self.workspace, self.default = memory, workspace, default

    def tools(self) -> dict:
        reads = self.memory is not None and self.memory.store.read_only
        out = {n: t for n, t in TOOLS.items() if (t[3] if reads else n not in ONLY_READERS)}
        if self.workspace is not None:
            out = {n: (d, {"db": TEXT} | a, ([] if self.default else ["db"]) + r, o) for n, (d, a, r, o) in out.items()} | OF_WORKSPACE
        return out

    def run(self, name: str, a: dict):
        tools = self.tools()
        if name not in tools:
            raise Invalid(f"unknown tool, or one that writes: {name!r}")
        _, known, required, reads = tools[name]
        if missing := [r for r in required if a.get(r) is None]:
            raise Invalid(f"{name} needs {', '.join(missing)}")
        if odd := set(a) - set(known):
            raise Invalid(f"{name} has no {', '.join(sorted(odd))}")
        if name == "workspace_list":
            return self.workspace.list()
        if name == "workspace_find":
            return self.workspace.find(a["query"], a.get("k", 8))
        if self.workspace is None:
            return call(self.memory, name, a)
        db = a.pop("db", None) or self.default
        return call(self.workspace.get(db, create=not reads), name, a)  # reading makes no store

    def handle(self, request: dict) -> dict | None:
        """The answer to one request; None to a notification."""
        if "id" not in request:
            return None
        out = {"jsonrpc": "2.0", "id": request["id"]}
        method, params = request.get("method"), request.get("params") or {}
        if method == "initialize":
            return out | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "chronofact", "version": VERSION}}}
        if method == "ping":
            return out | {"result": {}}
        if method == "tools/list":
            shown = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": a, "required": r}} for n, (d, a, r, _) in self.tools().items()]
            return out | {"result": {"tools": shown}}
        if method == "tools/call":
            try:
                text, bad = json.dumps(self.run(params.get("name"), dict(params.get("arguments") or {})), ensure_ascii=False, default=str), False
            except (EngineError, TypeError) as e:
                text, bad = f"{type(e).__name__}: {e}", True
            return out | {"result": {"content": [{"type": "text", "text": text}], "isError": bad}}
        return out | {"error": {"code": -32601, "message": "method not found"}}

    def serve(self, lines, write):
        for line in lines:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
            if answer is not None:
                write(json.dumps(answer, ensure_ascii=False) + "\n")


def main(argv=None):
    p = argparse.ArgumentParser(prog="chronofact-server")
    for f in ("--database", "--workspace", "--config", "--db"):
        p.add_argument(f)
    p.add_argument("--read-only", action="store_true")
    a = p.parse_args(argv)
    s = settings_.load({"database": a.database, "workspace": a.workspace}, a.config)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(s.master).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if s.workspace:
        server = Server(workspace=Workspace(spark, s.workspace, s.config()), default=a.db)
    else:
        server = Server(Memory(spark, s.database, s.config(), read_only=a.read_only))

    def write(line):
        sys.stdout.write(line)
        sys.stdout.flush()

    server.serve(sys.stdin, write)


if __name__ == "__main__":
    main()
