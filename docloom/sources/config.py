"""Settings from a TOML file, with defaults, and the errors of this package."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


class EngineError(Exception):
    """Base of all errors: config, network, parse, storage, enrichment, io, validation and conversion."""


class ConfigError(EngineError):
    pass


class ParseError(EngineError):
    pass


class StorageError(EngineError):
    pass


class ValidationError(EngineError):
    pass


@dataclass
class CrawlConfig:
    """Limits of a traversal. Defaults: three links deep, four pages at once, 200 ms between requests."""

    depth: int = 3
    concurrency: int = 4
    delay_ms: int = 200
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    mode: str = "auto"


@dataclass
class Config:
    crawl: CrawlConfig = field(default_factory=CrawlConfig)
    model: str = "offline"
    key_variable: str = "MODEL_API_KEY"


def load(path: str | Path) -> Config:
    """Settings of a file; defaults where it or a key is absent. Unknown crawl keys are errors."""
    p = Path(path)
    if not p.exists():
        return Config()
    try:
        data = tomllib.loads(p.read_text())
        return Config(CrawlConfig(**data.get("crawl", {})), data.get("model", "offline"), data.get("key_variable", "MODEL_API_KEY"))
    except (tomllib.TOMLDecodeError, TypeError) as e:
        raise ConfigError(f"{p}: {e}") from e


def init(path: str | Path) -> Config:
    """Write the defaults to a new file; an existing one is an error."""
    p, c = Path(path), CrawlConfig()
    if p.exists():
        raise ConfigError(f"{p} exists")
    p.write_text(f'model = "offline"\nkey_variable = "MODEL_API_KEY"\n\n[crawl]\ndepth = {c.depth}\nconcurrency = {c.concurrency}\ndelay_ms = {c.delay_ms}\nmode = "{c.mode}"\ninclude = []\nexclude = []\n')
    return load(p)


def require_key(config: Config) -> str:
    """The key of the model service from the environment; an empty one is an error."""
    key = os.environ.get(config.key_variable, "")
    if not key:
        raise ConfigError(f"set {config.key_variable}")
    return key
