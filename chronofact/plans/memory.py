"""A memory: one store, its write verbs, recall and upkeep.

What is stored stays in DataFrames.  What was written since the last
generation is a small delta on the driver, replayed from the log when the store
is opened; frames are the stored tables with the delta over them.  A checkpoint
adds the delta's rows, and the changes it makes to older ones, as folders of
their own; maintenance merges them.  Verbs look up single rows, batches of verbs
all their rows at once; whatever touches an unbounded set (bulk loads, tag
removal, maintenance) is one set-based step to the next generation.

Operations are numbered.  A generation knows the last one it holds, and the last
one of a stream, so neither is applied twice after a crash.
"""

import time
import uuid
from collections import Counter
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyClosed, Corrupt, Invalid, NotFound, ReembedBusy, StorageError, TooLarge, UntrackedVectorSpace, VectorSpaceMismatch
from ..functions.tokenizer import normalized_name, tokens, tokens_udf
from ..functions.vectors import check_vector, quantize
from ..operators import cells, lexical
from ..operators import tags as tag_ops
from ..operators.predicates import current
from ..schema import CELLS, CENTRES, EDGE_CHANGES, EDGES, ENTITIES, FACT_CHANGES, FACTS, LENGTHS, MAX_LINKS, MAX_TAGS, OPEN, POSTINGS, SIMILAR_MOST, SIMILAR_RING, SPACE_ID_MAX, Config
from ..sources import jsonl
from ..sources.store import Store
from . import maintain as upkeep
from . import recall as recalls
from . import write

AUTO_BYTES = 4 << 20
SCHEMAS = {"facts": FACTS, "entities": ENTITIES, "edges": EDGES}
KEYS = {"facts": "fact_id", "entities": "entity_id", "edges": "edge_id"}
#: Folders of changes, from which on a checkpoint merges them into their tables.
MERGE_FROM = 16
#: Postings of so many new facts go to one file of a folder.
FACTS_A_FILE = 2_000_000


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def stored_vector(v: list[float]) -> dict:
    """The stored form of one vector, as ``quantize`` makes it of a column."""
    n = sum(x * x for x in v) ** 0.5
    scale = max(abs(x) / n for x in v) / 127
    words = [sum((x >= 0) << i for i, x in enumerate(v[a : a + 64])) for a in range(0, len(v), 64)]
    q = [int(abs(x) / n / scale + 0.5) * (1 if x >= 0 else -1) for x in v]
    return {"scale": scale, "q": q, "sig": [w - (1 << 64) if w >> 63 else w for w in words]}


def similarity(a: dict | None, b: dict | None) -> float:
    return a["scale"] * b["scale"] * sum(x * y for x, y in zip(a["q"], b["q"])) if a and b else 0.0


class Memory:
    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), embedder=None, read_only: bool = False, checkpoint_ops: int = 1024, maintain_forgets: int = 0):
        self.checkpoint_ops, self.maintain_forgets, self.forgets, self.mark = checkpoint_ops, maintain_forgets, 0, None
        self.spark, self.store, self.embedder = spark, Store(spark, path, read_only), embedder
        try:
            stored = self.store.config()
            config = config.validate() if stored is None else config.reconciled(stored)
            self.config = config if config.db_uuid else replace(config, db_uuid=uuid.uuid4().hex)
            self._load()
            self.replayed, self.truncated_tail = 0, False
            if not read_only:
                ops, self.truncated_tail = self.store.ops()
                held = self.seq
                for op in ops:
                    if op.get("seq", held + 1) > held:
                        self.replayed += self._apply(op)
                if ops and not self.pending:
                    self.store.clear_log()
        except Exception:
            self.store.close()
            raise
        self.busy = False

    def _load(self):
        m = self.store.manifest
        self.next_fact, self.next_entity, self.next_edge = (m.get(k, 0) for k in ("next_fact", "next_entity", "next_edge"))
        self.vector_space, self.rels = m.get("vector_space"), dict(m.get("rels", {}))
        self.cells = m.get("cells", {"indexed": 0, "below": 0, "probes": 0})
        self._centres = self._corpus = None
        self.seq, self.stream_seq = m.get("seq", 0), m.get("stream_seq", -1)
        self.held = {"entities": self.next_entity, "edges": self.next_edge}
        self.base = {t: self._stored(t) for t in SCHEMAS}
        self.new = {"facts": {}, "entities": {}, "edges": {}}
        self.changed = {"facts": {}, "edges": {}}
        self.names: dict[str, int | None] = {}
        self.open_edges: dict[tuple, dict | None] = {}
        self.pending = 0

    # Frames -----------------------------------------------------------------

    def _stored(self, name: str) -> DataFrame:
        """A table of the generation with the changes of later folders in it."""
        df, changes = self.store.table(name), f"{name[:-1]}_changes"
        if self.store.folders.get(changes):
            # A row is closed once and forgotten once.
            last = self.store.table(changes).groupBy(KEYS[name]).agg(F.max("valid_to").alias("valid_to"), *([F.max("tombstone").alias("tombstone")] if name == "facts" else []))
            df = self._over(df, last, name)
        return df

    @staticmethod
    def _over(df: DataFrame, changes: DataFrame, name: str) -> DataFrame:
        over = changes.select(KEYS[name], *[F.col(c).alias(f"__{c}") for c in ("valid_to", "tombstone") if c in changes.columns])
        out = df.join(over, KEYS[name], "left").withColumn("valid_to", F.coalesce("__valid_to", "valid_to"))
        if name == "facts":
            out = out.withColumn("tombstone", F.coalesce("__tombstone", "tombstone"))
        return out.select(*df.columns)

    def _changes(self, name: str) -> DataFrame:
        rows = [(k, c.get("valid_to"), c.get("tombstone"))[: 3 if name == "facts" else 2] for k, c in self.changed[name].items()]
        return self.spark.createDataFrame(rows, FACT_CHANGES if name == "facts" else EDGE_CHANGES)

    def _added(self, name: str) -> DataFrame:
        schema = SCHEMAS[name]
        columns = self.base[name].columns
        return self.spark.createDataFrame([{c: r.get(c) for c in columns} for r in self.new[name].values()], schema)

    def _table(self, name: str) -> DataFrame:
        df = self.base[name]
        if self.changed.get(name):
            df = self._over(df, F.broadcast(self._changes(name)), name)  # at most the operations of one log
        return df.unionByName(self._added(name)) if self.new[name] else df

    @property
    def facts(self) -> DataFrame:
        """Stored facts, the forgotten among them, with ``entity`` names."""
        names = self._table("entities").select("entity_id", F.col("name").alias("entity"))
        return self._table("facts").join(names, "entity_id", "left")

    @property
    def entities(self) -> DataFrame:
        return self._table("entities")

    @property
    def edges(self) -> DataFrame:
        return self._table("edges")

    @property
    def postings(self) -> DataFrame:
        """(term, fact_id, tf, len, bucket) of every stored fact, the forgotten
        too until they are purged: those of the generation as written, those of
        the delta counted now."""
        stored = self.store.table("postings")
        rows = []
        for i, f in self.new["facts"].items():
            found = tokens(f["text"])
            rows += [(t, i, min(n, 255), min(len(found), 65535), lexical.bucket_of(t)) for t, n in Counter(found).items()]
        return stored.unionByName(self.spark.createDataFrame(rows, POSTINGS)) if rows else stored

    @property
    def lengths(self) -> DataFrame:
        stored = self.store.table("lengths")
        new = [(i, len(tokens(f["text"]))) for i, f in self.new["facts"].items()]
        return stored.unionByName(self.spark.createDataFrame(new, LENGTHS)) if new else stored

    @property
    def corpus(self) -> tuple[int, int]:
        """Stored facts and their tokens, those of the generation counted once."""
        if self._corpus is None:
            self._corpus = lexical.corpus_of(self.store.table("lengths"))
        new = [len(tokens(f["text"])) for f in self.new["facts"].values()]
        return self._corpus[0] + len(new), self._corpus[1] + sum(new)

    # Single rows ------------------------------------------------------------

    def _found(self, ids) -> dict[int, dict]:
        """Facts of ``ids`` by id, those of the generation by one look-up."""
        out = {i: self.new["facts"][i] for i in ids if i in self.new["facts"]}
        rest = sorted({i for i in ids if i not in out and 0 <= i < self.next_fact})
        if len(rest) == 1:
            rows = self.base["facts"].where(F.col("fact_id") == rest[0]).collect()
        else:
            rows = self.base["facts"].join(F.broadcast(self.spark.createDataFrame([(i,) for i in rest], "fact_id long")), "fact_id", "left_semi").collect() if rest else []
        return out | {r["fact_id"]: r.asDict(recursive=True) | self.changed["facts"].get(r["fact_id"], {}) for r in rows}

    def _fact(self, fact_id: int) -> dict:
        f = self._found([fact_id]).get(fact_id)
        if f is None:
            raise NotFound(f"fact {fact_id}")
        return f

    def _know(self, names) -> None:
        """Look up all of ``names`` that are not known yet at once."""
        norms = sorted({n for name in names if name is not None and (n := normalized_name(name)) and n not in self.names})
        if norms and self.held["entities"]:
            if len(norms) == 1:
                hits = self.base["entities"].where(F.col("norm_name") == norms[0])
            else:
                hits = self.base["entities"].join(F.broadcast(self.spark.createDataFrame([(n,) for n in norms], "norm_name string")), "norm_name", "left_semi")
            self.names |= dict.fromkeys(norms) | {r["norm_name"]: r["entity_id"] for r in hits.select("norm_name", "entity_id").collect()}

    def _entity(self, name: str) -> int | None:
        norm = normalized_name(name)
        if norm and norm not in self.names:
            self._know([name])
        return self.names.get(norm)

    def _know_edges(self, keys) -> None:
        """Look up the open edges of ``keys`` (src, rel, dst) at once."""
        wanted = sorted({k for k in keys if k not in self.open_edges and None not in k and max(k[0], k[2]) < self.held["entities"]})
        self.open_edges |= {k: None for k in keys if k not in self.open_edges}
        if wanted and self.held["edges"]:
            live = self.base["edges"].where(F.col("valid_to") == OPEN)
            rows = live.join(F.broadcast(self.spark.createDataFrame(wanted, "src long, rel string, dst long")), ["src", "rel", "dst"], "left_semi").collect()
            self.open_edges |= {(r["src"], r["rel"], r["dst"]): r.asDict() for r in rows if r["edge_id"] not in self.changed["edges"]}

    def _open_edge(self, src, rel, dst) -> dict | None:
        key = src, rel, dst
        if key not in self.open_edges:
            self._know_edges([key])
        return self.open_edges[key]

    # Applying operations ----------------------------------------------------

    def _upsert(self, name: str, now: int) -> int:
        found = self._entity(name)
        if found is not None:
            return found
        norm = normalized_name(name)
        if not norm:
            raise Invalid(f"an entity's name without a word: {name!r}")
        i, self.next_entity = self.next_entity, self.next_entity + 1
        self.new["entities"][i] = {"entity_id": i, "name": name, "norm_name": norm, "created_at": now}
        self.names[norm] = i
        return i

    def _set(self, table: str, key: int, **values):
        own = self.new[table].get(key)
        if own is not None:
            own.update(values)
        else:
            self.changed[table].setdefault(key, {}).update(values)

    def _apply(self, op: dict) -> bool:
        kind, now = op["op"], op["now"]
        if kind == "remember":
            if op["id"] < self.next_fact:
                return False
            if op["id"] != self.next_fact:
                raise Corrupt(f"the log skips from fact {self.next_fact} to {op['id']}")
            self.next_fact += 1
            entity = self._upsert(op["entity"], now) if op["entity"] is not None else None
            if op.get("target") is not None:
                self._set("facts", op["target"], valid_to=op["valid_from"])
            self.new["facts"][op["id"]] = {
                "fact_id": op["id"], "entity_id": entity, "text": op["text"], "tags": op["tags"], "metadata": op["metadata"], "revises": op.get("target"),
                "recorded_at": now, "valid_from": op["valid_from"], "valid_to": OPEN, "tombstone": False, "vector": op.get("vector"),
            }
            for rel, dst in op["links"]:
                self._link(entity, rel, self._upsert(dst, now), op["id"], now)
        elif kind == "forget":
            self._set("facts", op["id"], tombstone=True)
        elif kind == "link":
            self._link(self._upsert(op["src"], now), op["rel"], self._upsert(op["dst"], now), op["provenance"], now)
        elif kind == "unlink":
            e = self._open_edge(self._entity(op["src"]), op["rel"], self._entity(op["dst"]))
            if e:
                self._set("edges", e["edge_id"], valid_to=max(now, e["valid_from"]))
                self.open_edges[e["src"], e["rel"], e["dst"]] = None
        elif kind == "space":
            self.vector_space = op["space"]
        else:
            raise Corrupt(f"the log holds an unknown operation {kind!r}")
        self.pending += 1
        self.seq = op.get("seq", self.seq + 1)
        self.stream_seq = max(self.stream_seq, op.get("stream", -1))
        return True

    def _link(self, src, rel, dst, provenance, now):
        e = self._open_edge(src, rel, dst)
        if e:
            if e["provenance"] == provenance:
                return
            now = max(now, e["valid_from"])
            self._set("edges", e["edge_id"], valid_to=now)
        i, self.next_edge = self.next_edge, self.next_edge + 1
        order = self.rels.setdefault(rel, len(self.rels))
        self.new["edges"][i] = self.open_edges[src, rel, dst] = {"edge_id": i, "src": src, "rel": rel, "rel_ord": order, "dst": dst, "provenance": provenance, "recorded_at": now, "valid_from": now, "valid_to": OPEN}

    def _do(self, *ops: dict):
        if self.store.read_only:
            raise StorageError("this handle only reads")
        if self.busy:
            raise ReembedBusy("vectors are being made anew")
        for op in ops:
            op["seq"] = self.seq + 1
            if self.mark is not None:
                op["stream"] = self.mark
            self._apply(op)
        self.store.append(list(ops))
        self.forgets += sum(op["op"] == "forget" for op in ops)
        if self.maintain_forgets and self.forgets >= self.maintain_forgets:
            self.maintain()
        elif self.pending >= self.checkpoint_ops or self.store.log_size() >= AUTO_BYTES:
            self.checkpoint()

    # Write verbs ------------------------------------------------------------

    def _checked(self, text, entity=None, tags=(), links=(), metadata=None, vector=None, valid_from=None, now=None) -> dict:
        c, now = self.config, now_ms() if now is None else now
        if (n := len(text.encode())) > c.max_text:
            raise TooLarge("text", n, c.max_text)
        tags = list(dict.fromkeys(tags))
        if len(tags) > MAX_TAGS:
            raise TooLarge("tags", len(tags), MAX_TAGS)
        if len(links) > MAX_LINKS:
            raise TooLarge("links", len(links), MAX_LINKS)
        if not all(tags):
            raise Invalid("an empty tag")
        if links and entity is None:
            raise Invalid("links need an entity")
        for name in ([entity] if entity is not None else []) + [d for _, d in links]:
            if not normalized_name(name):
                raise Invalid(f"an entity's name without a word: {name!r}")
        pairs = list(metadata.items() if isinstance(metadata, dict) else metadata or ())
        if len({k for k, _ in pairs}) < len(pairs):
            raise Invalid("a metadata key twice")
        if (n := sum(len(k.encode()) + len(v.encode()) for k, v in pairs)) > c.max_blob:
            raise TooLarge("metadata", n, c.max_blob)
        v = stored_vector(check_vector(vector, c.dim)) if vector is not None else None
        return {"op": "remember", "now": now, "text": text, "entity": entity, "tags": tags, "links": [list(x) for x in links], "metadata": dict(sorted(pairs)), "vector": v, "valid_from": now if valid_from is None else valid_from}

    def _embedded(self, ops: list[dict]) -> list[dict]:
        """``ops`` with vectors where they have none, by one call."""
        bare = [op for op in ops if op["vector"] is None]
        if bare and self.embedder is not None and self.config.dim:
            made = self.embedder.embed([op["text"] for op in bare])
            if made is not None:
                self.claim_vector_space(getattr(self.embedder, "embedder", self.embedder).space_id, bare[0]["now"])
                for op, v in zip(bare, made):
                    op["vector"] = stored_vector(check_vector(v, self.config.dim))
        return ops

    def _similar(self, op: dict, below: int) -> list[tuple[int, float]]:
        """Hints for a fact: those of its entity's 32 latest before ``below``
        that are current and say nearly the same."""
        entity = self._entity(op["entity"]) if op["entity"] is not None else None
        if entity is None:
            return []
        own = [f for f in self.new["facts"].values() if f["entity_id"] == entity and f["fact_id"] < below]
        old = self.base["facts"].where((F.col("entity_id") == entity) & (F.col("fact_id") < below)).orderBy(F.desc("fact_id")).limit(SIMILAR_RING).collect()
        rows = own + [r.asDict(recursive=True) | self.changed["facts"].get(r["fact_id"], {}) for r in old]
        terms, out = set(tokens(op["text"])), []
        for f in sorted(rows, key=lambda f: -f["fact_id"])[:SIMILAR_RING]:
            if f["tombstone"] or f["valid_to"] != OPEN:
                continue
            other = set(tokens(f["text"]))
            j = len(terms & other) / len(terms | other) if terms | other else 0.0
            c = similarity(op["vector"], f["vector"])
            best = max(j if j > self.config.similar_jaccard else 0.0, c if c > self.config.similar_cos else 0.0)
            if best:
                out.append((f["fact_id"], best))
        return sorted(out, key=lambda x: (-x[1], x[0]))[:SIMILAR_MOST]

    def remember(self, text: str, skip_similar: bool = False, **fact) -> dict:
        return self.remember_many([{"text": text} | fact], skip_similar)[0]

    def remember_many(self, inputs: list[dict], skip_similar: bool = True, marks: list[int] | None = None) -> list[dict]:
        """In order; the first error ends it and what came before stays.  Texts are
        embedded by one call, names and links looked up at once, and the log is
        made durable once.  ``marks``: the numbers that inputs have in a stream."""
        ops, failed = [], None
        for n, i in enumerate(inputs):
            try:
                ops.append(self._checked(**i) | ({"stream": marks[n]} if marks else {}))
            except Exception as e:
                failed = e
                break
        self._embedded(ops)
        for n, op in enumerate(ops):
            op["id"] = self.next_fact + n
        self._know([n for op in ops for n in (op["entity"], *(d for _, d in op["links"]))])
        self._know_edges({(self._entity(op["entity"]), r, self._entity(d)) for op in ops for r, d in op["links"]} - {(None, None, None)})
        if ops:
            self._do(*ops)
        if failed is not None:
            raise failed
        hints = [[] if skip_similar else self._similar(op, op["id"]) for op in ops]
        return [{"id": op["id"], "entity": self._entity(op["entity"]) if op["entity"] is not None else None, "similar": h} for op, h in zip(ops, hints)]

    def remember_guarded(self, text: str, **fact) -> dict:
        """Stored, unless a current fact of the entity says nearly the same."""
        (op,) = self._embedded([self._checked(text, **fact)])
        hints = self._similar(op, self.next_fact)
        if hints:
            return {"stored": False, "similar": hints}
        self._do(op | {"id": self.next_fact})
        entity = self._entity(op["entity"]) if op["entity"] is not None else None
        return {"stored": True, "checked": op["entity"] is not None, "id": self.next_fact - 1, "entity": entity, "similar": []}

    def revise(self, target: int, text: str, **fact) -> dict:
        old = self._fact(target)
        if old["tombstone"]:
            raise NotFound(f"fact {target}")
        if old["valid_to"] != OPEN:
            raise AlreadyClosed(f"fact {target}")
        (op,) = self._embedded([self._checked(text, **fact)])
        op |= {"id": self.next_fact, "target": target}
        self._do(op)
        return {"id": op["id"], "entity": self._entity(op["entity"]) if op["entity"] is not None else None, "similar": []}

    def forget(self, fact_id: int, now: int | None = None) -> bool:
        return self.forget_many([fact_id], now)[0]

    def forget_many(self, ids: list[int], now: int | None = None) -> list[bool]:
        """In order; an unknown id ends it and those before stay forgotten."""
        facts, ops, out, failed = self._found(ids), [], [], None
        gone = {i for i, f in facts.items() if f["tombstone"]}
        for i in ids:
            if i not in facts:
                failed = NotFound(f"fact {i}")
                break
            out.append(i not in gone)
            if i not in gone:
                gone.add(i)
                ops.append({"op": "forget", "now": now_ms() if now is None else now, "id": i})
        if ops:
            self._do(*ops)
        if failed:
            raise failed
        return out

    def link(self, src: str, rel: str, dst: str, provenance: int | None = None, now: int | None = None):
        if not rel or not normalized_name(src) or not normalized_name(dst):
            raise Invalid("a link needs two names and a relation")
        if provenance is not None:
            self._fact(provenance)
        self._do({"op": "link", "now": now_ms() if now is None else now, "src": src, "rel": rel, "dst": dst, "provenance": provenance})

    def unlink(self, src: str, rel: str, dst: str, now: int | None = None) -> bool:
        s, d = self._entity(src), self._entity(dst)
        if s is None or d is None or self._open_edge(s, rel, d) is None:
            return False
        self._do({"op": "unlink", "now": now_ms() if now is None else now, "src": src, "rel": rel, "dst": dst})
        return True

    def remove_tag(self, tag: str, now: int | None = None) -> dict:
        """Every current fact with ``tag`` closed and made anew without it."""
        if not tag:
            raise Invalid("an empty tag")
        n = self._table("facts").where(current() & F.array_contains("tags", tag)).count()
        if n:
            self.checkpoint()
            both = tag_ops.remove_tag(self.base["facts"], tag, now_ms() if now is None else now, self.next_fact)
            made = both.where(F.col("fact_id") >= self.next_fact)
            closed = both.where(F.col("fact_id") < self.next_fact).select("fact_id", "valid_to", F.lit(None).cast("boolean").alias("tombstone"))
            self.next_fact += n
            self._commit({"facts": made, "fact_changes": closed}, n=n)
        return {"affected": n}

    def load(self, rows: DataFrame, now: int | None = None) -> int:
        """The bulk way of remembering: a table of (ordinal, text[, entity, tags,
        metadata, recorded_at, valid_from]) becomes facts in the order of
        ``ordinal``, all set-based, as the next generation."""
        at = F.lit(now_ms() if now is None else now).cast("long")
        default = {"entity": F.lit(None).cast("string"), "tags": F.array().cast("array<string>"), "metadata": F.create_map().cast("map<string,string>"), "recorded_at": at, "valid_from": at}
        for c, v in default.items():
            rows = rows.withColumn(c, F.coalesce(c, v) if c in rows.columns else v)
        if self.pending:
            self.checkpoint()
        # Names are brought to their form once; everything after reads this table.
        path = self.store.staging("rows")
        rows.select("ordinal", "text", *default).withColumn("norm_name", F.array_join(tokens_udf()(F.col("entity")), " ")).write.parquet(path)
        rows = self.spark.read.parquet(path)
        nameless = F.col("entity").isNotNull() & (F.col("norm_name") == "")
        seen = rows.agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("longest"), F.count_if(nameless).alias("nameless"), F.count_if(F.col("text").isNull()).alias("null")).first()
        if (seen["longest"] or 0) > self.config.max_text:
            raise TooLarge("text", seen["longest"], self.config.max_text)
        if seen["nameless"] or seen["null"]:
            raise Invalid(f"{seen['nameless']} entities' names without a word, {seen['null']} rows without a text")
        known = self.base["entities"]
        made = write.entity_upsert(rows.where("entity is not null").select(F.col("entity").alias("name"), "ordinal", "norm_name"), known=known, next_entity=self.next_entity)
        path = self.store.staging("entities")
        made.select("entity_id", "name", "norm_name", at.alias("created_at")).write.parquet(path)
        made = self.spark.read.parquet(path)
        entities = known.unionByName(made)
        keyed = write.numbered(rows, ["ordinal"], "fact_id", self.next_fact)
        keyed = keyed.join(entities.select("entity_id", "norm_name"), "norm_name", "left")
        new = keyed.select("fact_id", "entity_id", "text", "tags", "metadata", F.lit(None).cast("long").alias("revises"), "recorded_at", "valid_from", F.lit(OPEN).alias("valid_to"), F.lit(False).alias("tombstone"), F.lit(None).cast("struct<scale:double,q:array<tinyint>,sig:array<long>>").alias("vector"))
        before = self.next_fact
        self.next_fact += seen["n"]
        self.next_entity += made.count()
        path = self.store.staging("facts")
        new.write.parquet(path)
        self._commit({"facts": path, "entities": made}, n=seen["n"])
        return before

    # Vector spaces ----------------------------------------------------------

    def claim_vector_space(self, space: str, now: int | None = None):
        if not space or len(space.encode()) > SPACE_ID_MAX or any(ord(c) < 32 or ord(c) == 127 for c in space):
            raise Invalid("not a vector space's name")
        if self.vector_space == space:
            return
        if self.vector_space is not None:
            raise VectorSpaceMismatch(self.vector_space, space)
        if not self._table("facts").where("vector is not null").isEmpty():
            raise UntrackedVectorSpace("vectors of an unknown space are stored")
        self._do({"op": "space", "now": now_ms() if now is None else now, "space": space})

    def embedder_state(self) -> str:
        return getattr(self.embedder, "state", "ready") if self.embedder else "none"

    def suspend_embedder(self):
        self.embedder.suspend()

    def resume_embedder(self):
        self.embedder.resume()

    def reembed(self, embedder, batch_size: int = 256) -> dict:
        """New vectors for all facts that are not forgotten, closed ones too, as
        one generation; the embedder runs on the executors, batch by batch."""
        self.checkpoint()
        self.busy = True
        try:
            facts = self.base["facts"]

            def run(frames):
                for f in frames:
                    for at in range(0, len(f), batch_size):
                        part = f.iloc[at : at + batch_size]
                        yield part[["fact_id"]].assign(v=embedder.embed(part["text"].tolist()))

            probe = embedder.embed([""])
            dim = len(probe[0])
            made = facts.where(~F.col("tombstone")).select("fact_id", "text").mapInPandas(run, "fact_id long, v array<double>")
            made = made.select("fact_id", quantize(F.col("v")).alias("__v"))
            out = facts.drop("vector").join(made, "fact_id", "left").withColumnRenamed("__v", "vector").select(*facts.columns)
            self.config = replace(self.config, dim=dim)
            self.vector_space = embedder.space_id
            self.cells = {"indexed": 0, "below": 0, "probes": 0}
            none = {t: self.spark.createDataFrame([], x) for t, x in (("fact_changes", FACT_CHANGES), ("cells", CELLS), ("centres", CENTRES))}
            self._commit({}, {"facts": out} | none)
            return {"reembedded": self.base["facts"].where("vector is not null").count(), "dim": dim}
        finally:
            self.busy = False

    def optimize_vectors(self) -> bool:
        """File the vectors under cells if they are ``flat_to_hnsw`` or more and
        some are not filed; whether it did."""
        v = self.base["facts"].where("vector is not null").select(F.col("fact_id").alias("slot"), "vector")
        n = v.count()
        if n < max(1, self.config.flat_to_hnsw) or (self.cells["indexed"] == n and self.cells["below"] == self.next_fact):
            return False
        path = self.store.staging("vectors")
        v.write.parquet(path)
        v = self.spark.read.schema(v.schema).parquet(path)
        centres = cells.fit(v)
        path = self.store.staging("cells")
        cells.filed(v, centres).write.parquet(path)
        index = self.spark.read.schema(CELLS).parquet(path)
        self.cells = {"indexed": n, "below": self.next_fact, "probes": cells.calibrate(index, centres)}
        rows = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], CENTRES)  # at most MOST_CELLS
        self._commit({}, {"cells": index.repartition("cell"), "centres": rows})
        return True

    def _nearest(self) -> recalls.CellIndex | None:
        """The vector index, if there is one; vectors that came since are told
        apart by their ids."""
        if not self.cells["indexed"]:
            return None
        if self._centres is None:
            self._centres = np.array([r["centre"] for r in self.store.table("centres").orderBy("cell").collect()], np.float32)
        return recalls.CellIndex(self.store.table("cells"), self._centres, self.cells["probes"], self.cells["below"])

    # Reading ----------------------------------------------------------------

    def recall(self, text: str | None = None, now: int | None = None, vector=None, **q) -> recalls.RecallResult:
        if vector is None and text and self.embedder is not None and self.config.dim and self.vector_space:
            made = self.embedder.embed([text])
            vector = made[0] if made else None
        q = {k: tuple(v) if isinstance(v, list) else v for k, v in q.items()}
        query = recalls.RecallQuery(now=now_ms() if now is None else now, text=text, vector=vector, **q)
        return recalls.recall(recalls.Frames(self.facts, self.entities, self.edges, postings=self.postings, corpus=self.corpus, cells=self._nearest()), query, self.config)

    def get(self, fact_id: int) -> dict | None:
        try:
            f = self._fact(fact_id)
        except NotFound:
            return None
        return None if f["tombstone"] else f

    def tags_of(self, fact_id: int) -> list[str]:
        return list((self.get(fact_id) or {}).get("tags") or [])

    def metadata_of(self, fact_id: int) -> dict:
        return dict(sorted(((self.get(fact_id) or {}).get("metadata") or {}).items()))

    def entity(self, name: str) -> int | None:
        return self._entity(name)

    def entity_name(self, entity_id: int) -> str | None:
        row = self.entities.where(F.col("entity_id") == entity_id).first()
        return row["name"] if row else None

    def list_tags(self, prefix: str = "", cursor: str | None = None, limit: int = 0) -> dict:
        return tag_ops.list_tags(tag_ops.catalogue(self._table("facts")), prefix, cursor, limit, self.config.db_uuid)

    def stats(self) -> dict:
        f, e = self._table("facts"), self.edges
        row, sizes = upkeep.counters(f).first(), self.store.sizes()
        terms = self.postings.select("term").distinct().count()
        return {
            "facts": row["facts"], "entities": self.entities.count(), "terms": terms, "edges": e.where(F.col("valid_to") == OPEN).count(), "edge_versions": e.count(),
            "vectors": f.where("vector is not null").count(), "tombstones": row["tombstones"], "hnsw_indexed": self.cells["indexed"],
            "next_fact": self.next_fact, "next_entity": self.next_entity, "next_edge": self.next_edge, "db_uuid": self.config.db_uuid,
            "pool_bytes": sum(b for _, b in sizes.values()), "shards": {t: n for t, (n, _) in sizes.items()},
        }

    def export(self) -> DataFrame:
        return self.facts.where(current()).orderBy("fact_id")

    def export_each(self, visit) -> int:
        """``visit(fact)`` for each current fact in order of id, one partition of
        them at a time on the driver; how many."""
        n = 0
        for row in self.export().toLocalIterator():
            visit(row.asDict(recursive=True))
            n += 1
        return n

    def export_page(self, cursor: int | None = None, limit: int = 1000) -> dict:
        """Current facts among the next ``limit`` ids, and where to go on."""
        at = cursor or 0
        rows = self.facts.where(current() & (F.col("fact_id") >= at) & (F.col("fact_id") < at + limit)).orderBy("fact_id").collect()
        return {"facts": [r.asDict(recursive=True) for r in rows], "next_cursor": at + limit if at + limit < self.next_fact else None}

    def export_edges(self) -> DataFrame:
        return jsonl.edge_lines(self.edges, self.entities)

    def export_jsonl(self, path: str):
        jsonl.export(self.facts, self.edges, self.entities, path)

    def import_lines(self, lines, batch: int = 128, now: int | None = None) -> dict:
        """Facts get new ids and the times of this load; edges' provenance is
        mapped to the new ids, or dropped if it is unknown.  Runs of facts are
        remembered ``batch`` at a time; an error ends it and what came before
        stays."""
        ids, count, held = {}, {"facts": 0, "edges": 0}, []

        def flush():
            facts, held[:] = list(held), []
            rows = [{"text": d["text"], "entity": d.get("entity"), "tags": d.get("tags") or [], "metadata": d.get("metadata") or {}, "valid_from": d.get("valid_from"), "now": now} for d in facts]
            for d, got in zip(facts, self.remember_many(rows)):
                count["facts"] += 1
                if d.get("id") is not None:
                    ids[d["id"]] = got["id"]

        try:
            for kind, d in jsonl.parse(lines):
                if kind == "fact":
                    held.append(d)
                    if len(held) >= batch:
                        flush()
                else:
                    flush()
                    self.link(d["src"], d["rel"], d["dst"], ids.get(d.get("provenance")), now)
                    count["edges"] += 1
        finally:
            flush()
        return count

    # Upkeep -----------------------------------------------------------------

    def _commit(self, added: dict[str, DataFrame | str], replaced: dict[str, DataFrame] | None = None, n: int = 0, reindex: bool = False):
        """Write the next generation.  ``added`` facts, ``n`` or so, are indexed by
        one pass over their texts; ``replaced`` ones keep the postings they have,
        by a semi-join, unless they are to be indexed anew."""
        if self.store.read_only:
            raise StorageError("this handle only reads")
        added, replaced = dict(added), dict(replaced or {})
        if "facts" in added:
            facts = added["facts"]
            lengths, rows = self._index(self.spark.read.schema(FACTS).parquet(facts) if isinstance(facts, str) else facts, n)
            added |= {"lengths": lengths, "postings": rows}
        if "facts" in replaced:
            ids = replaced["facts"].select("fact_id")
            if reindex:
                lengths, rows = self._index(replaced["facts"], n)
            else:
                lengths = self.store.table("lengths").join(ids, "fact_id", "left_semi")
                rows = self._dealt(self.store.table("postings").join(ids, "fact_id", "left_semi"), n)
            replaced |= {"lengths": lengths, "postings": rows}
        state = {
            "next_fact": self.next_fact, "next_entity": self.next_entity, "next_edge": self.next_edge, "vector_space": self.vector_space, "rels": self.rels, "config": self.config.to_dict(),
            "seq": self.seq, "stream_seq": self.stream_seq, "cells": self.cells,
        }
        self.store.commit(added, replaced, state)
        self._load()

    def _index(self, facts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        path = self.store.staging("index")
        lexical.indexed(facts).write.parquet(path)
        index = self.spark.read.parquet(path)
        return index.select("fact_id", "n"), self._dealt(lexical.stored_postings(index), n)

    @staticmethod
    def _dealt(postings: DataFrame, n: int) -> DataFrame:
        """In folders by bucket and files in the order of terms; a frequent term's
        postings are spread over files by fact."""
        files = 1 + n // FACTS_A_FILE
        return postings.repartition("bucket", F.pmod("fact_id", F.lit(files))).sortWithinPartitions("bucket", "term", "fact_id")

    def checkpoint(self):
        """Write what the log holds as the next generation."""
        if self.store.read_only or (not self.pending and self.store.generation):
            return
        added = {t: self._added(t) for t in SCHEMAS if self.new[t] or not self.store.generation}
        added |= {f"{t[:-1]}_changes": self._changes(t) for t in ("facts", "edges") if self.changed[t]}
        self._commit(added, n=len(self.new["facts"]))
        if self._folders() >= MERGE_FROM:
            self._merge(self.base["facts"])

    def _folders(self) -> int:
        return max((len(f) for f in self.store.folders.values()), default=0)

    def _merge(self, facts: DataFrame, reindex: bool = False):
        """Every table as one folder, with all changes in it and ``facts`` as its facts."""
        none = {"fact_changes": self.spark.createDataFrame([], FACT_CHANGES), "edge_changes": self.spark.createDataFrame([], EDGE_CHANGES)}
        self._commit({}, {"facts": facts, "entities": self.base["entities"], "edges": self.base["edges"]} | none, self.next_fact, reindex)

    def maintain(self, mode: str = "auto") -> dict:
        """Purge the forgotten; ids stay used, revisions and edge versions stay."""
        if mode not in ("auto", "compact", "reindex_text", "optimize_vectors", "full"):
            raise Invalid(f"maintain mode {mode!r}")
        self.checkpoint()
        self.forgets = 0
        sizes, pool = self.store.sizes(), lambda sizes: sum(b for _, b in sizes.values())
        edges_now = self.base["edges"].agg(F.count_if(F.col("valid_to") == OPEN).alias("open"), F.count("*").alias("all")).first()
        counts = lambda f: f.agg(F.count("*").alias("facts"), F.count_if("tombstone").alias("tombstones"), F.count("vector").alias("vectors")).first()
        before = counts(self.base["facts"])
        anew = mode in ("full", "reindex_text")
        apart = self._folders() > 1 or any(self.store.folders.get(t) for t in ("fact_changes", "edge_changes"))
        edges = mode != "auto" and (len(self.store.folders.get("edges", ())) > 1 or bool(self.store.folders.get("edge_changes")))
        idle = not anew and not before["tombstones"] and not (apart and mode != "auto")
        filed = self.cells["indexed"]
        if not idle and mode != "optimize_vectors":
            self._merge(upkeep.purge(self.base["facts"]), anew)
        else:
            idle = True
        rebuilt = mode != "reindex_text" and self.optimize_vectors()
        after = before if idle else counts(self.base["facts"])
        return {
            "purged": 0 if idle else before["tombstones"], "no_op": idle and not rebuilt, "tombstones_before": before["tombstones"], "facts_before": before["facts"], "facts_after": after["facts"],
            "vectors_before": before["vectors"], "vectors_after": after["vectors"], "hnsw_indexed_before": filed, "hnsw_indexed_after": self.cells["indexed"],
            "structural_compacted": not idle, "bm25_compacted": not idle, "bm25_reindexed": anew and not idle, "hnsw_rebuilt": rebuilt, "edges_compacted": not idle and edges,
            "hnsw_remapped": False, "hnsw_inserted": self.cells["indexed"] if rebuilt else 0, "edges_before": edges_now["open"], "edge_versions_before": edges_now["all"],
            "bytes_before": pool(sizes), "bytes_after": pool(self.store.sizes()), "shards_before": {t: n for t, (n, _) in sizes.items()}, "shards_after": {t: n for t, (n, _) in self.store.sizes().items()},
            "generation": self.generation, "folders": self._folders(),
        }

    def verify(self):
        """Raise Corrupt with the first invariant that does not hold."""
        f = self._table("facts")
        found = upkeep.violations(f, self.entities, self.edges, tag_ops.catalogue(f)).where("rows > 0").orderBy("problem").first()
        if found:
            raise Corrupt(f"{found['problem']}: {found['rows']} rows")
        if bad := upkeep.faulty(f, self.config.dim).first():
            raise Corrupt(f"fact {bad['fact_id']}: {bad['fault']}")

    def scrub(self, budget: int | None = None):
        return self.store.scrub(budget)

    @property
    def generation(self) -> int:
        return self.store.generation

    def refresh(self) -> bool:
        newer = self.store.refresh()
        if newer:
            self._load()
        return newer

    def close(self):
        self.store.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def recover(spark: SparkSession, src: str, dst: str) -> dict:
    """The sound facts of ``src`` as a new store at ``dst``; ``src`` stays."""
    import os

    if os.path.abspath(src) == os.path.abspath(dst):
        raise Invalid("recover into another place")
    old = Memory(spark, src, read_only=True)
    try:
        facts = old._table("facts").where(~F.col("tombstone"))
        bad = upkeep.faulty(facts, old.config.dim)
        lost = {r["fault"]: r["count"] for r in bad.groupBy("fault").count().collect()}
        kept = facts.join(bad.select("fact_id"), "fact_id", "left_anti").select(*facts.columns)
        with Memory(spark, dst, old.config) as new:
            new.next_fact, new.next_entity, new.next_edge = old.next_fact, old.next_entity, old.next_edge
            new.vector_space, new.rels = old.vector_space, old.rels
            new._commit({"facts": kept, "entities": old.entities, "edges": old.edges}, n=old.next_fact)
            n = new.base["facts"].count()
        return {"kept": n} | {f"dropped_{k}": lost.get(k, 0) for k in ("text", "vector", "metadata")}
    finally:
        old.close()
