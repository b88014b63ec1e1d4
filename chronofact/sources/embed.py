"""Embedders: the protocol, a deterministic one, and the failure policy."""

import hashlib
import math
import time
from typing import Protocol

from ..errors import EmbedError
from ..functions.tokenizer import tokens


class Embedder(Protocol):
    space_id: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed token hashing; needs no model and no network."""

    def __init__(self, dim: int = 64):
        self.dim, self.space_id = dim, f"hashing-{dim}"

    def embed(self, texts):
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in tokens(t) or [""]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v] if any(v) else [1.0 / math.sqrt(self.dim)] * self.dim)
        return out


class EmbedderGate:
    """Failure policy around an embedder: ``fail`` raises, ``degrade`` goes
    without vectors and waits 1 s, then twice as long each time up to 60 s."""

    def __init__(self, embedder: Embedder, policy: str = "fail", clock=time.monotonic):
        self.embedder, self.policy, self.clock = embedder, policy, clock
        self.wait, self.until, self.suspended = 0.0, 0.0, False

    @property
    def state(self) -> str:
        if self.suspended:
            return "suspended"
        return "backoff" if self.clock() < self.until else "ready"

    def suspend(self):
        self.suspended = True

    def resume(self):
        self.suspended, self.wait, self.until = False, 0.0, 0.0

    def embed(self, texts: list[str]) -> list[list[float]] | None:
        if self.state != "ready":
            if self.policy == "fail":
                raise EmbedError(f"embedder: {self.state}")
            return None
        try:
            out = self.embedder.embed(texts)
        except Exception as e:
            self.wait = min(60.0, self.wait * 2 or 1.0)
            self.until = self.clock() + self.wait
            if self.policy == "fail":
                raise EmbedError(str(e)) from e
            return None
        self.wait = 0.0
        return out
