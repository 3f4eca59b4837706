"""Level-3 matrix operators as joins and sums.

``op`` is a column swap.  A product has two forms of equal results.  Over
coordinates it is one equi-join on the inner index with the output triangle in
the join condition, summed with map-side combine; the old C joins the same
aggregate as one more branch of a union, so beta costs no extra shuffle.  Over
tiles (``operators.tiles``) the output stays in place and operand tiles are
sent to it, once each per block of the output that needs them.  ``method`` is
``coo``, ``tile`` or ``auto``, which decides by operations per byte and density.

Contracts.  Illegal arguments raise ``ArgumentError`` with the documented
code.  With beta 0 the updated part of C is never read, with alpha 0 neither
are A and B.  An inner dimension of 0 scales C by beta.  Operators with
``uplo`` write that triangle alone and leave the other one of C as it is.
The opposite triangle of A, and a unit diagonal, are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import planner
from ..plans.matrix import ArgumentError, Matrix, scaled, upper_letter
from ..plans.settings import Settings
from . import tiles


def _pairs(a: Matrix, b: Matrix, alpha: complex | float, region: str | None = None) -> DataFrame:
    """The summands alpha * a(i,k) * b(k,j), (i,j) in the region, not yet summed."""
    vals = a.values
    left = a.doubles().select(F.col("i"), F.col("j").alias("_k"), *[F.col(c).alias(f"a{c}") for c in vals])
    right = b.doubles().select(F.col("i").alias("_q"), F.col("j"), *[F.col(c).alias(f"b{c}") for c in vals])
    on = F.col("_k") == F.col("_q")
    if region:
        on = on & (F.col("i") >= F.col("j") if region == "L" else F.col("i") <= F.col("j"))
    joined = left.join(right, on)
    if vals == ["v"]:
        product = [(F.col("av") * F.col("bv")).alias("v")]
    else:
        ar, ai, br, bi = (F.col(c) for c in ("are", "aim", "bre", "bim"))
        product = [(ar * br - ai * bi).alias("re"), (ar * bi + ai * br).alias("im")]
    joined = joined.select("i", "j", *product)
    return joined if alpha == 1 else joined.select("i", "j", *scaled(vals, alpha))


def _inside(region: str | None) -> Column:
    if not region:
        return F.lit(True)
    return F.col("i") >= F.col("j") if region == "L" else F.col("i") <= F.col("j")


def _real(df: DataFrame, on: bool) -> DataFrame:
    """With ``on``, the imaginary part of the diagonal is 0, as it is by definition."""
    return df.withColumn("im", F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.col("im"))) if on else df


def _update(
    kernel: str,
    terms: list[tiles.Term],
    c: Matrix | None,
    beta,
    like: Matrix,
    region: str | None = None,
    real_diagonal: bool = False,
    method: str = "auto",
    tile: int = 0,
    left_is: str | None = None,
    right_is: str | None = None,
) -> DataFrame:
    """Sum of the terms and beta * C inside the region; C itself outside it."""
    vals = like.values
    old = outside = None
    if c is not None and beta != 0:
        old = _real(c.doubles(), real_diagonal).where(_inside(region)).select("i", "j", *scaled(vals, beta))
    if c is not None and region:
        outside = c.doubles().where(~_inside(region))
    right = lambda t: t.right.transposed(t.flip == "C") if t.flip else t.right
    if terms and planner.product_method(kernel, method, terms[0].left, right(terms[0])) == "tile":
        side = tile or Settings.from_environment().tile or tiles.TILE
        summed = tiles.multiply(terms, None if old is None else c.with_df(old), region, left_is, right_is, side)
        summed = _real(summed.where(_inside(region)), real_diagonal)
    else:
        parts = [_pairs(t.left, right(t), t.alpha, region) for t in terms] + ([] if old is None else [old])
        if not parts:
            return like.cast(like.doubles().limit(0) if outside is None else outside)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if terms:  # C alone holds an entry once
            out = out.groupBy("i", "j").agg(*[F.sum(v).alias(v) for v in vals])
        summed = _real(out, real_diagonal)
    return like.cast(summed if outside is None else summed.unionByName(outside))


def _check(op: str, condition: bool, argument: str, code: int) -> None:
    if not condition:
        raise ArgumentError(op, argument, code)


def _types(op: str, *operands: Matrix | None) -> None:
    kinds = {m.dtype for m in operands if m is not None}
    if len(kinds) > 1:
        raise ArgumentError(op, "element types", -99)


def gemm(a: Matrix, b: Matrix, c: Matrix | None = None, alpha=1.0, beta=0.0, transa="N", transb="N", method: str = "auto", tile: int = 0) -> Matrix:
    """C := alpha op(A) op(B) + beta C."""
    ta, tb = upper_letter("gemm", "transA", transa, "NTC", -1), upper_letter("gemm", "transB", transb, "NTC", -2)
    left, right = a.op(ta), b.op(tb)
    _types("gemm", a, b, c)
    m, n, k = left.nrows, right.ncols, left.ncols
    for value, name, code in ((m, "M", -3), (n, "N", -4), (k, "K", -5)):
        _check("gemm", value >= 0, name, code)
    _check("gemm", right.nrows == k, "B", -10)
    _check("gemm", c is None or (c.nrows, c.ncols) == (m, n), "C", -13)
    if planner.gemm_is_noop(m, n, k, alpha, beta) and c is not None:
        return c
    terms = [] if alpha == 0 or k == 0 else [tiles.Term(left, right, alpha)]
    return Matrix(_update("gemm", terms, c, beta, a, method=method, tile=tile), m, n, a.dtype)


def gemmt(a: Matrix, b: Matrix, c: Matrix | None = None, uplo="L", alpha=1.0, beta=0.0, transa="N", transb="N", method: str = "auto", tile: int = 0) -> Matrix:
    """GEMM with a square result of which only the ``uplo`` triangle is computed; ``uplo`` 0 is all of it."""
    ta, tb = upper_letter("gemmt", "transA", transa, "NTC", -1), upper_letter("gemmt", "transB", transb, "NTC", -2)
    region = None if uplo in (0, "0", None) else upper_letter("gemmt", "uplo", uplo, "LU", -3)
    left, right = a.op(ta), b.op(tb)
    _types("gemmt", a, b, c)
    _check("gemmt", left.nrows == right.ncols, "N", -4)
    _check("gemmt", left.ncols == right.nrows, "K", -5)
    _check("gemmt", c is None or (c.nrows, c.ncols) == (left.nrows, left.nrows), "C", -13)
    n, k = left.nrows, left.ncols
    if c is not None and planner.gemm_is_noop(n, n, k, alpha, beta):
        return c
    terms = [] if alpha == 0 or k == 0 else [tiles.Term(left, right, alpha)]
    return Matrix(_update("gemmt", terms, c, beta, a, region, method=method, tile=tile), n, n, a.dtype)


def _symmetric(op: str, hermitian: bool, a, b, c, side, uplo, alpha, beta, method, tile) -> Matrix:
    s, u = upper_letter(op, "side", side, "LR", -1), upper_letter(op, "uplo", uplo, "LU", -2)
    _types(op, a, b, c)
    order = b.nrows if s == "L" else b.ncols
    _check(op, a.nrows == a.ncols == order, "A", -7)
    _check(op, c is None or (c.nrows, c.ncols) == (b.nrows, b.ncols), "C", -12)
    full = a.mirrored(u, hermitian)
    if c is not None and planner.gemm_is_noop(b.nrows, b.ncols, order, alpha, beta):
        return c
    terms = [] if alpha == 0 else [tiles.Term(full, b, alpha) if s == "L" else tiles.Term(b, full, alpha)]
    return Matrix(_update(op, terms, c, beta, a, method=method, tile=tile), b.nrows, b.ncols, a.dtype)


def symm(a: Matrix, b: Matrix, c: Matrix | None = None, side="L", uplo="L", alpha=1.0, beta=0.0, method: str = "auto", tile: int = 0) -> Matrix:
    """C := alpha A B + beta C or alpha B A + beta C, A symmetric, one triangle stored."""
    return _symmetric("symm", False, a, b, c, side, uplo, alpha, beta, method, tile)


def hemm(a: Matrix, b: Matrix, c: Matrix | None = None, side="L", uplo="L", alpha=1.0, beta=0.0, method: str = "auto", tile: int = 0) -> Matrix:
    """``symm`` with a Hermitian A."""
    _check("hemm", a.is_complex, "A", -7)
    return _symmetric("hemm", True, a, b, c, side, uplo, alpha, beta, method, tile)


def _rank_k(op: str, hermitian: bool, a, c, uplo, trans, alpha, beta, method, tile) -> Matrix:
    u = upper_letter(op, "uplo", uplo, "LU", -1)
    t = upper_letter(op, "trans", trans, "NC" if hermitian else "NT", -2)
    _types(op, a, c)
    left = a.op(t)
    _check(op, c is None or (c.nrows, c.ncols) == (left.nrows, left.nrows), "C", -10)
    if c is not None and planner.rank_is_noop(left.nrows, left.ncols, alpha, beta):
        return c
    terms = [] if alpha == 0 or left.ncols == 0 else [tiles.Term(left, left, alpha, "C" if hermitian else "T")]
    return Matrix(_update(op, terms, c, beta, a, u, hermitian, method, tile), left.nrows, left.nrows, a.dtype)


def syrk(a: Matrix, c: Matrix | None = None, uplo="L", trans="N", alpha=1.0, beta=0.0, method: str = "auto", tile: int = 0) -> Matrix:
    """C := alpha op(A) op(A)^T + beta C on the ``uplo`` triangle."""
    return _rank_k("syrk", False, a, c, uplo, trans, alpha, beta, method, tile)


def herk(a: Matrix, c: Matrix | None = None, uplo="L", trans="N", alpha: float = 1.0, beta: float = 0.0, method: str = "auto", tile: int = 0) -> Matrix:
    """C := alpha op(A) op(A)^H + beta C on the ``uplo`` triangle; alpha and beta are real."""
    _check("herk", a.is_complex, "A", -7)
    _check("herk", complex(alpha).imag == 0, "alpha", -5)
    _check("herk", complex(beta).imag == 0, "beta", -8)
    return _rank_k("herk", True, a, c, uplo, trans, alpha, beta, method, tile)


def _rank_2k(op: str, hermitian: bool, a, b, c, uplo, trans, alpha, beta, method, tile) -> Matrix:
    u = upper_letter(op, "uplo", uplo, "LU", -1)
    t = upper_letter(op, "trans", trans, "NC" if hermitian else "NT", -2)
    _types(op, a, b, c)
    x, y = a.op(t), b.op(t)
    _check(op, (x.nrows, x.ncols) == (y.nrows, y.ncols), "B", -9)
    _check(op, c is None or (c.nrows, c.ncols) == (x.nrows, x.nrows), "C", -12)
    if c is not None and planner.rank_is_noop(x.nrows, x.ncols, alpha, beta):
        return c
    second, flip = (complex(alpha).conjugate(), "C") if hermitian else (alpha, "T")
    terms = [] if alpha == 0 or x.ncols == 0 else [tiles.Term(x, y, alpha, flip), tiles.Term(y, x, second, flip)]
    return Matrix(_update(op, terms, c, beta, a, u, hermitian, method, tile), x.nrows, x.nrows, a.dtype)


def syr2k(a: Matrix, b: Matrix, c: Matrix | None = None, uplo="L", trans="N", alpha=1.0, beta=0.0, method: str = "auto", tile: int = 0) -> Matrix:
    """C := alpha (op(A) op(B)^T + op(B) op(A)^T) + beta C on the ``uplo`` triangle."""
    return _rank_2k("syr2k", False, a, b, c, uplo, trans, alpha, beta, method, tile)


def her2k(a: Matrix, b: Matrix, c: Matrix | None = None, uplo="L", trans="N", alpha=1.0, beta: float = 0.0, method: str = "auto", tile: int = 0) -> Matrix:
    """C := alpha op(A) op(B)^H + conj(alpha) op(B) op(A)^H + beta C, beta real."""
    _check("her2k", a.is_complex, "A", -7)
    _check("her2k", complex(beta).imag == 0, "beta", -10)
    return _rank_2k("her2k", True, a, b, c, uplo, trans, alpha, beta, method, tile)


def _triangular_args(op: str, a: Matrix, b: Matrix, side, uplo, transa, diag) -> tuple[str, str, str, str]:
    s, u = upper_letter(op, "side", side, "LR", -1), upper_letter(op, "uplo", uplo, "LU", -2)
    t, d = upper_letter(op, "transA", transa, "NTC", -3), upper_letter(op, "diag", diag, "NU", -4)
    _types(op, a, b)
    _check(op, a.nrows == a.ncols == (b.nrows if s == "L" else b.ncols), "A", -8)
    return s, u, t, d


def trmm(a: Matrix, b: Matrix, side="L", uplo="L", transa="N", diag="N", alpha=1.0, method: str = "auto", tile: int = 0) -> Matrix:
    """B := alpha op(A) B or alpha B op(A), A triangular."""
    s, u, t, d = _triangular_args("trmm", a, b, side, uplo, transa, diag)
    tri = a.triangular(u, d).op(t)
    if alpha == 0:
        return b.with_df(b.cast(b.doubles().select("i", "j", *[F.lit(0.0).alias(v) for v in b.values])))
    shape = "L" if (u == "L") == (t == "N") else "U"
    if s == "L":
        return b.with_df(_update("trmm", [tiles.Term(tri, b, alpha)], None, 0.0, b, method=method, tile=tile, left_is=shape))
    return b.with_df(_update("trmm", [tiles.Term(b, tri, alpha)], None, 0.0, b, method=method, tile=tile, right_is=shape))


def trsm(a: Matrix, b: Matrix, side="L", uplo="L", transa="N", diag="N", alpha=1.0, panel: int = 32_768, method: str = "auto", tile: int = 0) -> Matrix:
    """X with op(A) X = alpha B or X op(A) = alpha B, A triangular."""
    from .solve import solve_triangular

    s, u, t, d = _triangular_args("trsm", a, b, side, uplo, transa, diag)
    if alpha == 0:
        return b.with_df(b.cast(b.doubles().select("i", "j", *[F.lit(0.0).alias(v) for v in b.values])))
    effective, lower = a.op(t), (u == "L") == (t == "N")
    rhs = b
    if s == "R":  # X op(A) = alpha B  is  op(A)^T X^T = alpha B^T
        effective, lower, rhs = effective.transposed(), not lower, b.transposed()
    x = solve_triangular(effective, rhs, lower, d == "U", alpha, panel, method, tile)
    x = x if s == "L" else x.transposed()
    return b.with_df(b.cast(x.df))
