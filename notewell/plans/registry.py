"""Driver-side registries: vaults, models, configuration, and a cache of loaded indexes."""

from __future__ import annotations

import json
import os
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Model:
    name: str
    dimensions: int
    use_case: str = ""


# Public sentence encoders and their vector sizes.
MODELS = (
    Model("all-MiniLM-L6-v2", 384, "general, fast"),
    Model("all-MiniLM-L12-v2", 384, "general"),
    Model("all-mpnet-base-v2", 768, "general, accurate"),
    Model("multi-qa-mpnet-base-cos-v1", 768, "questions"),
    Model("paraphrase-albert-small-v2", 768, "paraphrases"),
)


def model_named(name: str, models: Sequence[Model] = MODELS) -> Model:
    for m in models:
        if m.name == name:
            return m
    raise KeyError(f"no model {name!r}; known: {', '.join(m.name for m in models)}")


def compatible(a: str, b: str) -> bool:
    """Whether vectors of one model can be compared with the other's index."""
    return model_named(a).dimensions == model_named(b).dimensions


def alternatives(name: str, models: Sequence[Model] = MODELS) -> list[Model]:
    return [m for m in models if m.name != name and m.dimensions == model_named(name, models).dimensions]


@dataclass(frozen=True)
class Vault:
    name: str
    path: str
    is_default: bool = False


def find_vault(vaults: Sequence[Vault], key: str | None = None) -> Vault:
    """By name in any case, then by path; without a key the default one, else the first."""
    if not vaults:
        raise LookupError("no vaults")
    if key is None:
        return next((v for v in vaults if v.is_default), vaults[0])
    for v in vaults:
        if v.name.lower() == key.lower():
            return v
    for v in vaults:
        if Path(v.path).expanduser().resolve() == Path(key).expanduser().resolve():
            return v
    raise LookupError(f"no vault {key!r}")


@dataclass(frozen=True)
class Config:
    vault_path: str
    index_path: str | None = None
    default_model: str = MODELS[0].name
    default_limit: int = 10
    max_limit: int = 100
    vaults: tuple[Vault, ...] = field(default_factory=tuple)


def load_config(path: str | None = None, places: Sequence[str] = (), variable: str = "NOTEWELL_CONFIG") -> Config:
    """From an explicit path, else the environment's, else the first place that exists."""
    wanted = path or os.environ.get(variable)
    found = [wanted] if wanted else [p for p in places if Path(p).expanduser().exists()]
    if not found:
        raise FileNotFoundError("no configuration file")
    raw = json.loads(Path(found[0]).expanduser().read_text())
    if not raw.get("vault_path"):
        raise ValueError("vault_path is missing")
    vault = Path(raw["vault_path"]).expanduser()
    if not vault.exists():
        raise ValueError(f"the vault {vault} does not exist")
    search = raw.get("search", {})
    vaults = tuple(Vault(v["name"], v["path"], bool(v.get("is_default"))) for v in raw.get("vaults", []))
    return Config(
        str(vault),
        str(Path(raw["index_path"]).expanduser()) if raw.get("index_path") else None,
        raw.get("default_model", MODELS[0].name),
        search.get("default_limit", 10),
        search.get("max_limit", 100),
        vaults,
    )


def storage_dir(config: Config | None, vault_path: str) -> str:
    """Where a vault's index lies: for the configured vault the configured folder, else a hidden folder of the vault."""
    own = Path(vault_path).expanduser().resolve()
    if config and config.index_path and own == Path(config.vault_path).resolve():
        return config.index_path
    return str(own / ".notewell")


def known_vaults(config: Config) -> tuple[Vault, ...]:
    """The listed vaults; without a list the configured one alone."""
    return config.vaults or (Vault(Path(config.vault_path).name, config.vault_path, True),)


def bounded_limit(config: Config | None, asked: int | None) -> int:
    """How many results a search gives: as asked or by default, the configured maximum at most."""
    config_default, most = (config.default_limit, config.max_limit) if config else (10, None)
    limit = config_default if asked is None else asked
    return limit if most is None else min(limit, most)


class ResidentIndexes:
    """Keeps the most recently used few of what `load` makes; `release` is called for the others (e.g. unpersist)."""

    def __init__(self, capacity: int, load: Callable[[str], Any], release: Callable[[Any], None] = lambda x: None):
        self.capacity, self.load, self.release = capacity, load, release
        self.held: OrderedDict[str, Any] = OrderedDict()

    def get(self, key: str) -> Any:
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        value = self.held[key] = self.load(key)
        while len(self.held) > self.capacity:
            self.release(self.held.popitem(last=False)[1])
        return value

    def drop(self, key: str) -> None:
        if key in self.held:
            self.release(self.held.pop(key))
