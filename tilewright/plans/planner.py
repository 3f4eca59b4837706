"""Domain rules Catalyst does not know: quick returns and the product's form."""

from __future__ import annotations

from .matrix import Matrix
from .settings import Settings

#: Stored share of the entries from which a large product runs over tiles.
TILE_DENSITY = 0.1


def gemm_is_noop(m: int, n: int, k: int, alpha, beta) -> bool:
    """Whether C stays as it is."""
    return m == 0 or n == 0 or ((alpha == 0 or k == 0) and beta == 1)


def rank_is_noop(n: int, k: int, alpha, beta) -> bool:
    return n == 0 or ((alpha == 0 or k == 0) and beta == 1)


def product_method(kernel: str, method: str, a: Matrix, b: Matrix, settings: Settings | None = None) -> str:
    """``coo`` or ``tile``, both of equal results.  With ``auto`` a call whose operations per
    byte stay below the kernel's threshold goes over coordinates; beyond it the entries of
    both operands are counted, and dense operands go over tiles."""
    if method in ("coo", "tile"):
        return method
    if method != "auto":
        raise ValueError(f"unknown method {method!r}")
    m, n, k = a.nrows, b.ncols, a.ncols
    size, each = (16, 8.0) if a.is_complex else (8, 2.0)
    settings = settings or Settings.from_environment()
    if offload(kernel, each * m * n * k, size * (m * n + m * k + k * n), settings) == "local":
        return "coo"
    na = a.df.count()
    nb = na if b.df is a.df else b.df.count()
    dense = min(na / max(m * k, 1), nb / max(k * n, 1))
    return "tile" if dense > TILE_DENSITY else "coo"


def offload(kernel: str, flops: float, bytes_moved: float, settings: Settings | None = None) -> str:
    """Where a call runs by its arithmetic intensity and the kernel's threshold:
    ``distributed`` over tiles, or ``local`` to one join of coordinates."""
    settings = settings or Settings.from_environment()
    return "distributed" if bytes_moved and flops / bytes_moved >= settings.threshold_of(kernel) else "local"
