"""Options of the engine, from arguments or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from .matrix import Matrix
from .storage import materialize

PREFIX = "TILEWRIGHT_"


@dataclass(frozen=True)
class Settings:
    """``tile``: user's tile size, 0 for the default; ``devices``: how many places tiles are
    mapped to; ``threshold``: operations per byte from which a call runs over tiles, and
    ``thresholds``: the same for single kernels, from ``TILEWRIGHT_THRESHOLD_<KERNEL>``."""

    tile: int = 0
    devices: int = 8
    threshold: float = 32.0
    thresholds: tuple[tuple[str, float], ...] = ()

    @staticmethod
    def from_environment(env: dict[str, str] | None = None) -> "Settings":
        env = os.environ if env is None else env
        read = {k: env[PREFIX + k.upper()] for k in ("tile", "devices", "threshold") if env.get(PREFIX + k.upper())}
        kinds = {"tile": int, "devices": int, "threshold": float}
        each = PREFIX + "THRESHOLD_"
        per = tuple(sorted((k[len(each) :].upper(), float(v)) for k, v in env.items() if k.startswith(each) and v))
        return Settings(**{k: kinds[k](v) for k, v in read.items()}, thresholds=per)

    def threshold_of(self, kernel: str) -> float:
        return dict(self.thresholds).get(kernel.upper(), self.threshold)

    def with_tile(self, tile: int) -> "Settings":
        if tile < 0:
            raise ValueError("a tile size is not negative")
        return replace(self, tile=tile)

    def with_devices(self, devices: int, available: int) -> "Settings":
        """At most what is available; more than that is cut, less than one is an error."""
        if devices < 1:
            raise ValueError("at least one device is needed")
        return replace(self, devices=min(devices, available))


def sync(*matrices: Matrix) -> list[Matrix]:
    """Compute the matrices now: each becomes a reader of its written entries."""
    return [m.with_df(materialize(m.df, "matrix")) for m in matrices]


def keep(m: Matrix) -> Matrix:
    """Keep the entries with the executors, spilling to disk, for the next readers."""
    return m.with_df(m.df.persist())


def release(*frames: Matrix | DataFrame) -> None:
    """Drop what was kept."""
    for x in frames:
        (x.df if isinstance(x, Matrix) else x).unpersist()
