"""Run options, checked once instead of being read key by key."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from typing import Any

METRICS = ("cosine", "ip", "l2")
POLICIES = ("hard", "easy", "random")


def check_metric(metric: str, spherical: bool = False) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    if metric == "l2" and spherical:
        raise ValueError("metric 'l2' cannot be combined with spherical k-means")


def check_policy(which: str) -> None:
    if which not in POLICIES:
        raise ValueError(f"which must be one of {POLICIES}, got {which!r}")


def check_eps(eps_list) -> list[float]:
    """A non-empty list of distinct eps values, each in (0, 1]."""
    eps_list = [float(e) for e in eps_list]
    if not eps_list or len(set(eps_list)) != len(eps_list):
        raise ValueError("eps_list must hold at least one value, each of them once")
    for eps in eps_list:
        if not 0.0 < eps <= 1.0:
            raise ValueError(f"eps must lie in (0, 1], got {eps}")
    return eps_list


@dataclasses.dataclass(frozen=True)
class DedupOptions:
    """Options of a whole run; ``from_mapping`` takes a parsed flat config."""

    k: int = 599
    niter: int = 100
    seed: int = 1234
    spherical: bool = True
    metric: str = "cosine"
    eps_list: tuple[float, ...] = (0.05,)
    which: str = "hard"
    keep_hard: bool = True
    max_cluster_size: int | None = None
    block: int = 8192

    def __post_init__(self) -> None:
        check_metric(self.metric, self.spherical)
        check_policy(self.which)
        object.__setattr__(self, "eps_list", tuple(check_eps(self.eps_list)))
        if self.k < 1 or self.niter < 0 or self.block < 1:
            raise ValueError("k and block must be positive, niter must not be negative")
        if self.max_cluster_size is not None and self.max_cluster_size < 1:
            raise ValueError("max_cluster_size must be positive")

    @classmethod
    def from_mapping(cls, config: Mapping[str, Any]) -> DedupOptions:
        known = {f.name for f in dataclasses.fields(cls)}
        unknown = sorted(set(config) - known)
        if unknown:
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        return cls(**config)
