"""Repeated timing of a piece of work."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from .functions.aggs import list_mean, list_sd


@dataclass(frozen=True)
class Timing:
    name: str
    seconds: tuple[float, ...]

    @property
    def mean(self) -> float:
        return list_mean(self.seconds)

    @property
    def sd(self) -> float | None:
        return list_sd(self.seconds)

    def __str__(self) -> str:
        spread = f" ± {self.sd:.4f} SD" if self.sd is not None else ""
        return f"{self.name}: {self.mean:.4f}{spread} s, N={len(self.seconds)}"


def measure(name: str, work: Callable[[], object], runs: int = 5, warm_up: int = 1) -> Timing:
    for _ in range(warm_up):
        work()
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        work()
        took.append(time.perf_counter() - began)
    return Timing(name, tuple(took))
