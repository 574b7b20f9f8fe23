"""Settings of a run with their defaults; options of the command line replace them."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


def _cache_dir() -> str:
    return os.environ.get("CLADEWORKS_CACHE_DIR") or str(Path.home() / ".cache" / "cladeworks")


@dataclass(frozen=True)
class Config:
    cache_dir: str = ""
    #: Seconds after which a stored table is computed anew.
    cache_max_age: int = 604_800
    output_format: str = "parquet"
    #: Names that one call of the verifier program gets.
    batch_size: int = 10_000
    jobs: int = 1
    all_matches: bool = True
    capitalize: bool = True
    fuzzy_uninomial: bool = False
    fuzzy_relaxed: bool = False
    species_group: bool = False
    higher_rank_fallback: bool = True

    def __post_init__(self):
        if not self.cache_dir:
            object.__setattr__(self, "cache_dir", _cache_dir())

    def updated(self, **options) -> Config:
        """A copy with the options that are known and not None."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in options.items() if k in known and v is not None})

    def verifier_options(self) -> dict:
        return {k: getattr(self, k) for k in ("jobs", "all_matches", "capitalize", "fuzzy_uninomial", "fuzzy_relaxed", "species_group")}

    def summary(self) -> str:
        return "\n".join(["Current configuration:", *[f"{k}: {v}" for k, v in asdict(self).items()]])
