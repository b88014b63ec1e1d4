"""Settings: flag, then environment, then TOML file, then default."""

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from .errors import Invalid
from .schema import Config

PREFIX = "CHRONOFACT_"


@dataclass
class Settings:
    database: str = "memory"
    workspace: str | None = None
    master: str = "local[*]"
    embedder_dim: int = 0
    embedder_policy: str = "fail"
    checkpoint_ops: int = 1024
    maintain_forgets: int = 0
    engine: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def checked(self) -> "Settings":
        if self.embedder_policy not in ("fail", "degrade"):
            raise Invalid(f"embedder_policy = {self.embedder_policy!r}")
        if self.checkpoint_ops < 1:
            raise Invalid(f"checkpoint_ops = {self.checkpoint_ops}")
        return self

    def config(self) -> Config:
        return Config.from_dict(self.engine)


def load(flags: dict | None = None, config_path: str | None = None, environ=os.environ) -> Settings:
    """An explicit file must exist; keys that mean nothing become warnings."""
    out, known = Settings(), {f.name for f in fields(Settings)} - {"engine", "warnings"}
    path = Path(config_path or environ.get(PREFIX + "CONFIG", "chronofact.toml"))
    if config_path and not path.exists():
        raise Invalid(f"{path}: no such file")
    if path.exists():
        for key, value in tomllib.loads(path.read_text()).items():
            if key in ("engine", "recall", "index") and isinstance(value, dict):
                names = {f.name for f in fields(Config)}
                out.engine |= {k: v for k, v in value.items() if k in names}
                out.warnings += [f"unknown key {key}.{k}" for k in value if k not in names]
            elif key in known:
                setattr(out, key, value)
            else:
                out.warnings.append(f"unknown key {key}")
    for name in known:
        kind = type(getattr(out, name)) if getattr(out, name) is not None else str
        if (v := environ.get(PREFIX + name.upper())) is not None:
            setattr(out, name, kind(v))
        if flags and flags.get(name) is not None:
            setattr(out, name, flags[name])
    return out.checked()
