"""Run parameters: a frozen dataclass and the reader of ``key = value`` files."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Parameters of preparation, training and evaluation."""

    min_count: int = 5
    max_tokens: int = 512
    block_size: int = 250
    topics: int = 8
    alpha: float = 0.2
    beta: float = 0.01
    ll_alpha: float = 0.01
    mh_steps: int = 2
    staleness: int = 0
    iterations: int = 10
    seed: int = 42
    load_factor: int = 2
    clients: int = 4
    dump_every: int = -1
    llh_every: int = -1


def parse_params(text: str) -> dict[str, str]:
    """``key = value`` lines; ``#`` starts a comment; quotes around values go; later lines win."""
    out = {}
    for line in text.splitlines():
        key, eq, value = line.partition("#")[0].partition("=")
        if eq and key.strip():
            out[key.strip()] = value.strip().strip("\"'")
    return out


def load_config(texts: Iterable[str], base: Config | None = None) -> Config:
    """Defaults, overridden by each text in turn; keys that no field has are an error."""
    base, kinds = base or Config(), {f.name: type(getattr(Config(), f.name)) for f in fields(Config)}
    for text in texts:
        given = parse_params(text)
        if unknown := set(given) - set(kinds):
            raise KeyError(f"unknown parameters: {sorted(unknown)}")
        base = replace(base, **{k: kinds[k](v) for k, v in given.items()})
    return base


def due(iteration: int, every: int) -> bool:
    """Whether a task of every n-th iteration (from 0) is due; 0 or less is never."""
    return every > 0 and (iteration + 1) % every == 0
