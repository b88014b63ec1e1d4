"""The command line: one verb a call, or a loop of verbs (``repl``).

Exit codes: 0 done, 1 not found, locked or a workspace that disagrees, 2 usage,
damage or any other failure.
"""

import argparse
import json
import shlex
import sys

from . import settings as settings_
from .errors import AlreadyClosed, EngineError, Locked, NoSuchDatabase, NotFound
from .plans.memory import Memory, recover
from .sources.embed import EmbedderGate, HashingEmbedder
from .workspace import Workspace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronofact")
    p.add_argument("--database")
    p.add_argument("--workspace")
    p.add_argument("--config")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name, *args, **flags):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for f, kind in flags.items():
            opts = {"action": "store_true"} if kind is bool else {"action": "append", "default": []} if kind is list else {"type": kind}
            s.add_argument("--" + f.replace("_", "-"), **opts)
        return s

    fact = {"entity": str, "tag": list, "link": list, "meta": list, "valid_from": int, "vector": str}
    verb("remember", "text", guarded=bool, **fact)
    revise = sub.add_parser("revise")
    revise.add_argument("id", type=int)
    revise.add_argument("text")
    for f, kind in fact.items():
        revise.add_argument("--" + f.replace("_", "-"), **({"action": "append", "default": []} if kind is list else {"type": kind}))
    r = sub.add_parser("recall")
    r.add_argument("query", nargs="?")
    for f, kind in {"tag": list, "entity": list, "as_of": int, "k": int, "token_budget": int, "ef": int, "graph_depth": int, "vector": str}.items():
        r.add_argument("--" + f.replace("_", "-"), **({"action": "append", "default": []} if kind is list else {"type": kind}))
    r.add_argument("--range", nargs=2, type=int)
    r.add_argument("--closed", action="store_true")
    sub.add_parser("forget").add_argument("ids", nargs="+", type=int)
    verb("tags", prefix=str, cursor=str, limit=int)
    verb("remove-tag", "tag")
    verb("link", "src", "rel", "dst", provenance=int)
    verb("unlink", "src", "rel", "dst")
    sub.add_parser("show").add_argument("id", type=int)
    for name in ("stats", "checkpoint", "verify", "scrub"):
        verb(name)
    verb("maintain", mode=str, reembed=bool, batch_size=int)
    verb("recover", "dst")
    verb("export", "path")
    verb("import", "file", batch=int)
    verb("repl", read_only=bool)
    w = sub.add_parser("workspace").add_subparsers(dest="action", required=True)
    for name in ("list", "reindex", "verify"):
        w.add_parser(name)
    f = w.add_parser("find")
    f.add_argument("query")
    f.add_argument("--k", type=int, default=8)
    d = w.add_parser("describe")
    d.add_argument("name")
    d.add_argument("text")
    d.add_argument("--tag", action="append", default=[])
    d.add_argument("--owner")
    for name in ("archive", "use"):
        w.add_parser(name).add_argument("name")
    return p


def numbers(text):
    return [float(x) for x in text.split(",")] if text else None


def fact_of(a) -> dict:
    pairs = [m.partition("=") for m in a.meta]
    links = [tuple(x.split(":", 1)) for x in a.link]
    return {"entity": a.entity, "tags": a.tag, "links": links, "metadata": [(k, v) for k, _, v in pairs], "valid_from": a.valid_from, "vector": numbers(a.vector)}


def run(a, m: Memory, spark):
    """What a verb answers: text or JSON-like data."""
    v = a.verb
    if v == "remember":
        return (m.remember_guarded if a.guarded else m.remember)(a.text, **fact_of(a))
    if v == "revise":
        return m.revise(a.id, a.text, **fact_of(a))
    if v == "recall":
        q = {"tags": tuple(a.tag), "entities": tuple(a.entity), "as_of": a.as_of, "range": tuple(a.range) if a.range else None, "include_closed": a.closed, "token_budget": a.token_budget, "ef": a.ef, "graph_depth": a.graph_depth}
        got = m.recall(a.query, vector=numbers(a.vector), **({"k": a.k} if a.k else {}), **q)
        return got.__dict__ if a.json else got.rendered
    if v == "forget":
        return {"forgotten": m.forget_many(a.ids)}
    if v == "tags":
        return m.list_tags(a.prefix or "", a.cursor, a.limit or 0)
    if v == "remove-tag":
        return m.remove_tag(a.tag)
    if v == "link":
        return m.link(a.src, a.rel, a.dst, a.provenance)
    if v == "unlink":
        return {"closed": m.unlink(a.src, a.rel, a.dst)}
    if v == "show":
        if (f := m.get(a.id)) is None:
            raise NotFound(f"fact {a.id}")
        return {k: x for k, x in f.items() if k != "vector"}
    if v == "maintain":
        return m.reembed(HashingEmbedder(m.config.dim or 64), a.batch_size or 256) if a.reembed else m.maintain(a.mode or "auto")
    if v == "scrub":
        done = list(m.scrub())
        return {"bytes": done[-1][1] if done else 0}
    if v == "export":
        return m.export_jsonl(a.path)
    if v == "import":
        with open(a.file) as f:
            return m.import_lines(f, a.batch or 128)
    return {"stats": m.stats, "checkpoint": m.checkpoint, "verify": m.verify}[v]()


def in_workspace(a, w: Workspace):
    act = a.action
    if act == "list":
        return w.list()
    if act == "find":
        return w.find(a.query, a.k)
    if act == "describe":
        return w.describe(a.name, a.text, a.tag, a.owner)
    if act == "archive":
        if not w.archive(a.name):
            raise NoSuchDatabase(a.name)
        return None
    if act == "reindex":
        return {"described": w.reindex()}
    if act == "use":
        return {"path": str(w.get(w.path_of(a.name).name).store.path)}
    issues = w.verify()
    if issues:
        raise NotFound(json.dumps(issues))
    return issues


def show(answer):
    if answer is not None:
        print(answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False, default=str))


def main(argv=None, spark=None, lines=None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        s = settings_.load({"database": a.database, "workspace": a.workspace}, a.config)
        for w in s.warnings:
            print(f"warning: {w}", file=sys.stderr)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.master(s.master).config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if a.verb == "workspace":
            w = Workspace(spark, s.workspace or "workspace", s.config())
            try:
                show(in_workspace(a, w))
            finally:
                w.close_all()
            return 0
        if a.verb == "recover":
            show(recover(spark, s.database, a.dst))
            return 0
        embedder = EmbedderGate(HashingEmbedder(s.embedder_dim), s.embedder_policy) if s.embedder_dim else None
        with Memory(spark, s.database, s.config(), embedder, read_only=getattr(a, "read_only", False), checkpoint_ops=s.checkpoint_ops, maintain_forgets=s.maintain_forgets) as m:
            if a.verb != "repl":
                show(run(a, m, spark))
                return 0
            for line in lines if lines is not None else sys.stdin:
                try:
                    if line.strip():
                        show(run(parser().parse_args(shlex.split(line)), m, spark))
                except (EngineError, SystemExit) as e:
                    print(f"error: {e}", file=sys.stderr)
            if not m.store.read_only:
                m.checkpoint()
        return 0
    except (NotFound, AlreadyClosed, Locked, NoSuchDatabase) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except (EngineError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
