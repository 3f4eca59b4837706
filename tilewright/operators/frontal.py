"""Helpers of frontal-matrix factorizations: copy-and-scale, extend-add, column swap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.matrix import ArgumentError, Matrix
from . import blas3


def _reciprocal(values: list[str]) -> dict[str, Column]:
    """1/d as IEEE would have it: a zero gives infinity of its sign, not an error."""
    inf = F.lit(float("inf"))
    if values == ["v"]:
        inf = F.when(F.col("dv").cast("string").startswith("-"), -inf).otherwise(inf)
        return {"r": F.when(F.col("dv") == 0, inf).otherwise(F.lit(1.0) / F.nullif(F.col("dv"), F.lit(0.0)))}
    size = F.col("dre") * F.col("dre") + F.col("dim") * F.col("dim")
    safe = F.nullif(size, F.lit(0.0))
    return {"r": F.when(size == 0, inf).otherwise(F.col("dre") / safe), "s": F.when(size == 0, F.lit(0.0)).otherwise(-F.col("dim") / safe)}


def copyscale(d: Matrix, l: Matrix, u: Matrix | None = None, should_copy: bool = True) -> tuple[Matrix, Matrix | None]:
    """(L, U): U := L^T as it was, if ``should_copy``, else U as given; then row j of L times 1/D[j,j].

    D is N x N (its diagonal counts; an absent one is 0), L is N x M, U is M x N.
    """
    if d.nrows != d.ncols or d.nrows != l.nrows:
        raise ArgumentError("copyscale", "D", -5)
    if u is not None and (u.nrows, u.ncols) != (l.ncols, l.nrows):
        raise ArgumentError("copyscale", "U", -9)
    vals = l.values
    diagonal = d.doubles().where(F.col("i") == F.col("j")).select(F.col("i").alias("_d"), *[F.col(v).alias(f"d{v}") for v in vals])
    joined = l.doubles().join(diagonal, F.col("i") == F.col("_d"), "left").fillna(0.0, subset=[f"d{v}" for v in vals])
    r = _reciprocal(vals)
    if vals == ["v"]:
        cols = [(F.col("v") * r["r"]).alias("v")]
    else:
        cols = [(F.col("re") * r["r"] - F.col("im") * r["s"]).alias("re"), (F.col("re") * r["s"] + F.col("im") * r["r"]).alias("im")]
    scaled = l.with_df(l.cast(joined.select("i", "j", *cols)))
    return scaled, (l.transposed() if should_copy else u)


def extend_add(a: Matrix, son: DataFrame, index: DataFrame, packed: bool = False, nelim: int = 0) -> Matrix:
    """Add a son's lower triangle into a front: A[idx(i), idx(j)] += son(i, j) for j <= i.

    ``index`` is (pos from 0, idx from 1).  ``son`` is (i, j, values), or
    (id, values) with id = i(i+1)/2 + j where ``packed``.  Positions the index
    lacks are left out.  Only ``nelim`` 0 is defined.
    """
    if nelim != 0:
        raise ArgumentError("extend_add", "nelim", -1)
    vals = a.values
    if packed:
        root = F.floor((F.sqrt(8 * F.col("id").cast("double") + 1) - 1) / 2).cast("long")
        # the square root may be off by one for very large ids
        row = F.when(root * (root + 1) / 2 > F.col("id"), root - 1).when((root + 1) * (root + 2) / 2 <= F.col("id"), root + 1).otherwise(root)
        son = son.withColumn("i", row).withColumn("j", F.col("id") - (F.col("i") * (F.col("i") + 1) / 2).cast("long"))
    son = son.where(F.col("j") <= F.col("i"))
    rows = index.select(F.col("pos").alias("_pi"), (F.col("idx") - 1).cast("long").alias("_ri"))
    cols = index.select(F.col("pos").alias("_pj"), (F.col("idx") - 1).cast("long").alias("_rj"))
    moved = (
        son.join(rows, F.col("i") == F.col("_pi")).join(cols, F.col("j") == F.col("_pj"))
        .select(F.col("_ri").alias("i"), F.col("_rj").alias("j"), *[F.col(v).cast("double").alias(v) for v in vals])
    )
    summed = a.doubles().unionByName(moved).groupBy("i", "j").agg(*[F.sum(v).alias(v) for v in vals])
    return a.with_df(a.cast(summed))


def swap_columns(c: Matrix, p: int, q: int) -> Matrix:
    """C with columns p and q exchanged; a projection."""
    if not 0 <= p < c.ncols:
        raise ArgumentError("swap", "i", -5)
    if not 0 <= q < c.ncols:
        raise ArgumentError("swap", "j", -8)
    j = F.when(F.col("j") == p, F.lit(q)).when(F.col("j") == q, F.lit(p)).otherwise(F.col("j")).cast("long")
    return c.with_df(c.df.withColumn("j", j))


def frontal_update(d: Matrix, l: Matrix, g: Matrix, panel: int = 1024) -> tuple[Matrix, Matrix, Matrix]:
    """(L, U, G) of a front: solve with the unit upper triangle of D transposed,
    copy and scale, then G := L^T U^T + G."""
    solved = blas3.trsm(d, l, "L", "U", "T", "U", 1.0, panel)
    scaled, u = copyscale(d, solved)
    return scaled, u, blas3.gemm(scaled, u, g, 1.0, 1.0, "T", "T")
