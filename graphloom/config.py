"""Configuration: the logical process grid and the engine switches."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class GridConfig:
    """A three-axis layout. Only a data-placement concept here: it bounds shards and feeds the cost models."""

    x: int = 1
    y: int = 1
    z: int = 1

    def __post_init__(self) -> None:
        if min(self.x, self.y, self.z) < 1:
            raise ValueError("every axis needs at least one part")

    @property
    def world(self) -> int:
        return self.x * self.y * self.z

    def ranks(self) -> list[tuple[int, int, int]]:
        return list(product(range(self.x), range(self.y), range(self.z)))

    def groups(self, axes: list[str], rank: tuple[int, int, int] = (0, 0, 0)) -> list[tuple[str, int, int]]:
        """(axis, size, rank on that axis) for each letter named; letters are case-insensitive and distinct."""
        letters = [a.lower() for a in axes]
        if bad := [a for a in letters if a not in AXES]:
            raise ValueError(f"unknown axis {bad[0]!r}")
        if len(set(letters)) != len(letters):
            raise AssertionError("axes must differ")
        return [(a, getattr(self, a), rank[AXES.index(a)]) for a in letters]


@dataclass(frozen=True)
class EngineConfig:
    """Grid and aggregation mode. The modes change scheduling in a tensor runtime, never results."""

    grid: GridConfig = field(default_factory=GridConfig)
    block_aggregation: bool = False
    overlap: bool = False
    tune_gemms: bool = False

    def __post_init__(self) -> None:
        if self.overlap and not self.block_aggregation:
            raise AssertionError("overlap needs block aggregation")
