"""Typed settings of a run, with environment overrides, and unique run ids."""

from __future__ import annotations

import dataclasses
import os
import uuid
from datetime import UTC, datetime


@dataclasses.dataclass(frozen=True)
class Settings:
    """Every field may be set by an environment variable ``LINK_<FIELD>``."""

    input_dir: str = "data"
    output_dir: str = "output"
    block_cap: int = 250
    threshold: float = 0.9
    per_source: int = 3
    passes: tuple[str, ...] = ("exact", "prefix6", "first_token", "postal")
    seed: str = "42"

    @classmethod
    def from_env(cls, env=os.environ) -> Settings:
        found = {}
        for f in dataclasses.fields(cls):
            raw = env.get(f"LINK_{f.name.upper()}")
            if raw is not None:
                found[f.name] = tuple(raw.split(",")) if f.name == "passes" else type(f.default)(raw)
        return cls(**found)


def run_id() -> str:
    """Names an output folder; written with ``errorifexists`` it never overwrites a run."""
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
