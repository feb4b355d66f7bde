"""Settings of a run."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Defaults are what a run uses that sets nothing."""

    base_url: str = "http://localhost:1234/v1"
    api_key: str = "lm-studio"
    model: str = ""
    max_tokens: int = 4096
    retries: int = 3
    temperature: float = 0.1
    timeout_s: int = 120
    chunk_size: int = 6000
    chunk_overlap: int = 500
    use_token_chunking: bool = False
    workers: int = 1
    enrich_batch: int = 30
    verify_batch: int = 20
    fuzzy_threshold: int = 90
    output_dir: str = "."
    #: A tokenizer's file, for token chunks.
    tokenizer_file: str = ""
    #: A shared folder where answers stay, for later runs to go on from; empty: a run keeps them for itself.
    answers_dir: str = ""

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and less than chunk_size")
        if self.workers < 1 or self.retries < 1:
            raise ValueError("workers and retries must be positive")
        if self.use_token_chunking and not (self.tokenizer_file and self.chunk_overlap // 4 < self.max_tokens):
            raise ValueError("token chunks need tokenizer_file, and a fourth of chunk_overlap below max_tokens")

    def answers_hash(self, provider: str = "", prompt: str = "") -> str:
        """A name for all that an answer depends on besides its text: the provider with its model, the prompt, the settings."""
        parts = [provider, prompt, self.base_url, self.model, self.max_tokens, self.temperature, self.chunk_size, self.chunk_overlap, self.use_token_chunking, self.tokenizer_file]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:16]

    def model_settings(self) -> str:
        """A name for the settings on which a reply about edges depends."""
        return json.dumps([self.base_url, self.model, self.max_tokens, self.temperature])

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "GRAPHLOOM_", dotenv: str | None = None, **over) -> Config:
        """From variables like GRAPHLOOM_CHUNK_SIZE, then a .env file's lines, then ``over`` (None is left out)."""
        values = dict(os.environ if env is None else env)
        if dotenv and os.path.exists(dotenv):
            for line in open(dotenv, encoding="utf-8"):
                k, eq, v = line.strip().partition("=")
                if eq and not k.startswith("#"):
                    values.setdefault(k.strip(), v.strip().strip("\"'"))
        got = {}
        for f in fields(cls):
            raw = values.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(getattr(cls, f.name))
                got[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return replace(cls(**got), **{k: v for k, v in over.items() if v is not None})


_current: Config | None = None


def get_config() -> Config:
    """The settings that calls without a config use: those set last, else those of the environment."""
    return _current or Config.from_env()


def set_config(config: Config | None) -> None:
    """Sets them; None goes back to the environment's."""
    global _current
    _current = config
