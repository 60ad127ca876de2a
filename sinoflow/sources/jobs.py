"""Job configuration: JSON in, a checked dataclass out."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Job:
    """What one reconstruction reads, solves and writes. ``slices`` is [begin, end), all where None."""

    filename: str
    dataset: str
    angles: str
    output: str
    axis: float | None = None
    slices: tuple[int, int] | None = None
    num_iters: int = 100
    sigma: float = 100.0
    tol: float = 0.001
    xtol: float = 0.001

    def __post_init__(self) -> None:
        if self.sigma <= 0:
            raise ValueError("sigma must be above 0")
        if self.num_iters < 0:
            raise ValueError("num_iters must not be below 0")
        if self.slices is not None and not 0 <= self.slices[0] < self.slices[1]:
            raise ValueError("slices must be [begin, end) with 0 <= begin < end")


def parse_job(text: str) -> Job:
    """A job from JSON. The solver's settings stand under ``MBIR``; ``tol`` and ``xtol`` are 0.001 where missing."""
    raw = json.loads(text)
    missing = [k for k in ("filename", "dataset", "angles", "output", "MBIR") if k not in raw]
    missing += [f"MBIR.{k}" for k in ("num_iters", "sigma") if k not in raw.get("MBIR", {})]
    if missing:
        raise ValueError(f"the job lacks {', '.join(missing)}")
    solver = raw["MBIR"]
    return Job(
        raw["filename"], raw["dataset"], raw["angles"], raw["output"], raw.get("axis"),
        tuple(raw["slices"]) if raw.get("slices") else None,
        int(solver["num_iters"]), float(solver["sigma"]), float(solver.get("tol", 0.001)), float(solver.get("xtol", 0.001)),
    )


def load_job(path: str) -> Job:
    return parse_job(Path(path).read_text(encoding="utf-8"))
