"""Settings, their presets, and reading and checking them from TOML."""

from __future__ import annotations

import dataclasses
import tomllib
from pathlib import Path

from .operators.qc import PRESETS

#: Where a configuration is looked for when none is named.
SEARCH = ("seqlake.toml", "config/seqlake.toml")


@dataclasses.dataclass(frozen=True)
class Config:
    k: int = 15
    least_coverage: int = 2
    least_contig: int = 63
    preset: str = "standard"
    similarity: float = 0.6
    partitions: int = 200
    peel: bool = True

    def checked(self) -> Config:
        """Itself, or an error that names every bad value."""
        bad = []
        if not 3 <= self.k <= 30:
            bad.append(f"k = {self.k} is not within 3 and 30")
        if self.least_coverage < 1 or self.least_contig < 1 or self.partitions < 1:
            bad.append("least_coverage, least_contig and partitions start at 1")
        if self.preset not in PRESETS:
            bad.append(f"preset {self.preset!r} is not one of {', '.join(PRESETS)}")
        if not 0 <= self.similarity <= 1:
            bad.append(f"similarity = {self.similarity} is not within 0 and 1")
        if bad:
            raise ValueError("; ".join(bad))
        return self


TEMPLATES = {"minimal": Config(), "high_performance": Config(partitions=2000), "low_memory": Config(partitions=4000, least_coverage=3)}


def load(path: str | None = None) -> Config:
    """From a TOML file, or the first of SEARCH that is there, or the defaults. Unknown names are errors."""
    found = path or next((p for p in SEARCH if Path(p).is_file()), None)
    if not found:
        return Config()
    values = tomllib.loads(Path(found).read_text())
    unknown = set(values) - {f.name for f in dataclasses.fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**values).checked()


def dump(config: Config) -> str:
    """The configuration as TOML."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else str(v)
    return "".join(f"{k} = {show(v)}\n" for k, v in dataclasses.asdict(config).items())


def parse_range(text: str) -> tuple[int, int]:
    """'15-31' or '21'."""
    lo, _, hi = text.partition("-")
    a, b = int(lo), int(hi or lo)
    if a > b:
        raise ValueError(f"an empty range: {text}")
    return a, b


def short(n: float) -> str:
    """1234567 as 1.2M."""
    for size, unit in ((1e9, "G"), (1e6, "M"), (1e3, "k")):
        if n >= size:
            return f"{n / size:.1f}{unit}"
    return f"{n:g}"
