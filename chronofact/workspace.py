"""A folder of named stores and a registry store that describes them."""

from __future__ import annotations

import re
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import AtCapacity, BadName, InUse, NoSuchDatabase
from .operators.predicates import current
from .plans.memory import Memory
from .schema import Config

#: The entity under which a store may describe itself.
SELF = "self"
NAME_MAX, OPEN_MAX, IDLE_SECONDS = 64, 16, 60.0
# Names that some file systems keep for devices.
DEVICES = {"con", "prn", "aux", "nul"} | {f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)}


def checked_name(name: str) -> str:
    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", name) or len(name.encode()) > NAME_MAX or name in DEVICES:
        raise BadName(name)
    return name


class Workspace:
    """Stores under ``root/db``; the folder says which exist, the registry what
    they are for.  Results are never merged across stores."""

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), clock=time.monotonic):
        self.spark, self.root, self.config, self.clock = spark, Path(root), config, clock
        (self.root / "db").mkdir(parents=True, exist_ok=True)
        self.registry = Memory(spark, str(self.root / "registry"))
        self.open: dict[str, Memory] = {}
        self.used: dict[str, float] = {}
        self.leased: dict[str, int] = {}

    def path_of(self, name: str) -> Path:
        return self.root / "db" / checked_name(name)

    def exists(self, name: str) -> bool:
        return self.path_of(name).is_dir()

    def list(self) -> list[str]:
        return sorted(p.name for p in (self.root / "db").iterdir() if p.is_dir())

    # Handles ----------------------------------------------------------------

    def get(self, name: str, create: bool = True) -> Memory:
        """The store of a name; the longest unused gives way when 16 are open."""
        if not create and not self.exists(name):
            raise NoSuchDatabase(name)
        if name not in self.open:
            if len(self.open) >= OPEN_MAX:
                free = [n for n in self.open if not self.leased.get(n)]
                if not free:
                    raise AtCapacity(f"{OPEN_MAX} stores are in use")
                self._drop(min(free, key=self.used.get))
            self.open[name] = Memory(self.spark, str(self.path_of(name)), self.config)
        self.used[name] = self.clock()
        return self.open[name]

    def lease(self, name: str) -> Memory:
        m = self.get(name)
        self.leased[name] = self.leased.get(name, 0) + 1
        return m

    def release(self, name: str):
        self.leased[name] = max(0, self.leased.get(name, 0) - 1)

    def _drop(self, name: str):
        self.open.pop(name).close()
        self.used.pop(name, None)

    def close_idle(self, seconds: float = IDLE_SECONDS) -> int:
        old = [n for n in self.open if not self.leased.get(n) and self.clock() - self.used[n] >= seconds]
        for n in old:
            self._drop(n)
        return len(old)

    def close(self, name: str):
        if self.leased.get(name):
            raise InUse(name)
        if name in self.open:
            self._drop(name)

    def close_all(self):
        for n in list(self.open):
            self._drop(n)
        self.registry.close()

    # Registry ---------------------------------------------------------------

    def _entry(self, name: str) -> dict | None:
        return next((e for e in self.entries() if e["name"] == name), None)

    def entries(self) -> list[dict]:
        rows = self.registry.export().where("entity is not null").collect()
        return [{"name": r["entity"], "text": r["text"], "tags": list(r["tags"]), "owner": (r["metadata"] or {}).get("owner"), "fact_id": r["fact_id"]} for r in rows]

    def describe(self, name: str, text: str, tags=(), owner: str | None = None) -> dict:
        fact = {"entity": checked_name(name), "tags": list(tags), "metadata": {"owner": owner} if owner else {}}
        old = self._entry(name)
        return self.registry.revise(old["fact_id"], text, **fact) if old else self.registry.remember(text, **fact)

    def archive(self, name: str) -> bool:
        old = self._entry(name)
        return bool(old) and self.registry.forget(old["fact_id"])

    def find(self, query: str, k: int = 8) -> list[dict]:
        """Names of stores in the order in which their descriptions match."""
        found = self.registry.recall(query, entities=[query], k=k).facts
        names = list(dict.fromkeys(f["entity"] for f in found if f["entity"]))
        return [{"name": n, "exists": self.exists(n)} for n in names]

    def reindex(self) -> int:
        """Describe what is on disk and not in the registry."""
        new = set(self.list()) - {e["name"] for e in self.entries()}
        for n in sorted(new):
            self.describe(n, n)
        return len(new)

    def verify(self) -> list[dict]:
        """What registry and disk disagree on; reported, not repaired."""
        names = [e["name"] for e in self.entries()]
        out = [{"name": n, "issue": "missing"} for n in names if not self.exists(n)]
        out += [{"name": n, "issue": "ambiguous"} for n in sorted({n for n in names if names.count(n) > 1})]
        for n in self.list():
            if n not in names:
                out.append({"name": n, "issue": "undescribed"})
            try:
                m = self.get(n)
                own = m.facts.where(current() & (F.col("entity") == SELF)).orderBy("fact_id").limit(2).collect()
                said = next((e["text"] for e in self.entries() if e["name"] == n), None)
                if len(own) > 1:
                    out.append({"name": n, "issue": "ambiguous self", "facts": m.facts.where(current() & (F.col("entity") == SELF)).count()})
                elif own and said is not None and own[0]["text"] != said:
                    out.append({"name": n, "issue": "stale"})
                m.verify()
            except Exception as e:
                out.append({"name": n, "issue": f"unreadable: {e}"})
        return out
