"""Settings: defaults, then a JSON file, then the environment, then flags."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Corpus:
    roots: tuple[str, ...] = ()


@dataclass(frozen=True)
class Search:
    fuzzy_limit: int = 25
    pool: int = 200

    def __post_init__(self):
        if self.pool < self.fuzzy_limit:
            object.__setattr__(self, "pool", 5 * self.fuzzy_limit)


@dataclass(frozen=True)
class RateLimit:
    rpm: float = 60
    burst: float = 20
    exempt_privileged: bool = True


@dataclass(frozen=True)
class Server:
    read_timeout: float = 15
    write_timeout: float = 30


@dataclass(frozen=True)
class Config:
    store: str = "formulas"
    corpus: Corpus = field(default_factory=Corpus)
    search: Search = field(default_factory=Search)
    rate_limit: RateLimit = field(default_factory=RateLimit)
    server: Server = field(default_factory=Server)


def load(path: str | None = None, store: str | None = None, fuzzy_limit: int | None = None, pool: int | None = None) -> Config:
    """Unknown settings are ignored; ``AXIOMATA_STORE`` names the store. What is given here as a flag goes over all else."""
    config = Config()
    if path:
        with open(path) as f:
            given = json.load(f)
        for part in fields(config):
            value = given.get(part.name)
            if isinstance(value, dict):
                kind = type(getattr(config, part.name))
                known = {x.name for x in fields(kind)}
                config = replace(config, **{part.name: kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items() if k in known})})
            elif value is not None:
                config = replace(config, **{part.name: value})
    config = replace(config, store=store or os.environ.get("AXIOMATA_STORE", config.store))
    flags = {k: v for k, v in (("fuzzy_limit", fuzzy_limit), ("pool", pool)) if v is not None}
    return replace(config, search=replace(config.search, **flags))
