"""Triangular solve by panels of rows.

All eight cases of the solve are one of two here: a lower system forward or
an upper one backward.  Columns of the right-hand side are independent of one
another, so a panel is solved by one job in which each task streams the tiles
of the triangle past its own block of columns (``tiles.solve``).  Systems of at
most ``panel`` rows are one panel.  Beyond that the solve is left-looking: the
panels already solved are taken off the next panel's rows by one product, and
each row of B and X is read and written once.  Solved panels are written to
the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.matrix import Matrix, scaled
from ..plans.settings import Settings
from ..plans.storage import materialize
from . import tiles

#: Bytes of the solution a task holds at once.
HELD_BYTES = 1 << 28


def solve_triangular(a: Matrix, b: Matrix, lower: bool, unit: bool, alpha, panel: int, method: str = "auto", tile: int = 0) -> Matrix:
    from .blas3 import _update

    n, vals = a.nrows, a.values
    side = tile or Settings.from_environment().tile or tiles.TILE
    panel = max(side, panel // side * side)  # panels begin at tiles
    triangle = a.triangle("L" if lower else "U", strict=unit)
    rhs = b.with_df(b.doubles().select("i", "j", *scaled(vals, alpha)))
    starts = list(range(0, n, panel))
    order = starts if lower else starts[::-1]
    if len(order) > 1:
        triangle, rhs = triangle.with_df(materialize(triangle.doubles(), "triangle")), rhs.with_df(materialize(rhs.df, "rhs"))
    lanes = int(b.spark.conf.get("spark.sql.shuffle.partitions"))
    solved: Matrix | None = None
    for lo in order:
        hi = min(lo + panel, n)
        own = F.col("i").between(lo, hi - 1)
        part = rhs.with_df(rhs.df.where(own))
        if solved is not None:
            before = triangle.with_df(triangle.df.where(own & (F.col("j") < lo if lower else F.col("j") >= hi)))
            part = part.with_df(_update("trsm", [tiles.Term(before, solved, -1.0)], part, 1.0, solved, method=method, tile=tile))
        block = triangle.with_df(triangle.df.where(own & F.col("j").between(lo, hi - 1)))
        most = HELD_BYTES // ((16 if a.is_complex else 8) * (hi - lo))
        width = max(1, min(most, -(-b.ncols // lanes)))
        x = tiles.solve(block, part, lower, unit, lo, hi, side, width)
        if len(order) > 1:
            x = materialize(x, "panel")
        double = "z" if a.is_complex else "d"
        solved = Matrix(x if solved is None else solved.df.unionByName(x), n, b.ncols, double)
    return b.with_df(rhs.df if solved is None else solved.df)
