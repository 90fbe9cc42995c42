"""Settings: defaults, then the user's file, then the collection's file, then the environment (LARKSPUR_<NAME>)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    source_dirs: tuple[str, ...] = ("",)
    ignore_patterns: tuple[str, ...] = ()
    #: Whether the root's .gitignore and .larkspurignore say what isn't indexed.
    ignore_files: bool = True
    chunk_max_tokens: int = 512
    chunk_overlap_tokens: int = 50
    embedding_dims: int = 64
    embedding_batch: int = 100
    #: Batches that one task has with the provider at once.
    embedding_at_once: int = 1
    #: A provider behind HTTP (see sources.embedding.Http); without a URL the mock embeds.
    embedding_url: str = ""
    embedding_model: str = ""
    embedding_shape: str = "data"
    embedding_key_env: str = ""
    search_mode: str = "hybrid"
    search_limit: int = 10
    stemming: bool = True
    decay: bool = False
    decay_half_life: float = 90.0
    boost_links: bool = False
    boost_weight: float = 0.15
    boost_hops: int = 1
    watch_debounce_ms: int = 300
    cluster_granularity: float = 1.0
    topic_threshold: float = 0.30

    def checked(self) -> Config:
        if self.chunk_max_tokens < 1 or not 0 <= self.chunk_overlap_tokens < self.chunk_max_tokens:
            raise ValueError("chunk_overlap_tokens is at least 0 and less than chunk_max_tokens")
        if self.search_mode not in ("hybrid", "semantic", "lexical", "edge"):
            raise ValueError(f"unknown search mode {self.search_mode}")
        if self.embedding_at_once < 1 or self.embedding_shape not in ("data", "embeddings"):
            raise ValueError("embedding_at_once is positive, embedding_shape is data or embeddings")
        if self.decay_half_life <= 0 or self.embedding_dims < 1 or self.embedding_batch < 1:
            raise ValueError("half-life, dimensions and batch size are positive")
        if not 1 <= self.boost_hops <= 3 or not 0 <= self.topic_threshold <= 1:
            raise ValueError("boost_hops is 1 to 3, topic_threshold 0 to 1")
        return self


def _typed(name: str, raw: object) -> object:
    default = getattr(Config(), name)
    if isinstance(default, bool):
        return raw if isinstance(raw, bool) else str(raw).lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        return tuple(x.strip() for x in raw.split(",") if x.strip()) if isinstance(raw, str) else tuple(raw)
    return type(default)(raw)


def load(project: str | None = None, user: str | None = None, env: dict[str, str] | None = None) -> Config:
    import yaml

    env = os.environ if env is None else env
    known = {f.name for f in fields(Config)}
    out: dict[str, object] = {}
    for path in (user, project):
        if path and Path(path).exists():
            raw = yaml.safe_load(Path(path).read_text()) or {}
            if unknown := set(raw) - known:
                raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
            out |= raw
    out |= {n: env[k] for n in known if (k := f"LARKSPUR_{n.upper()}") in env}
    return Config(**{k: _typed(k, v) for k, v in out.items()}).checked()


def dump(config: Config) -> str:
    """The settings as YAML that `load` reads."""
    import yaml

    return yaml.safe_dump({f.name: list(v) if isinstance(v := getattr(config, f.name), tuple) else v for f in fields(Config)}, sort_keys=False)
