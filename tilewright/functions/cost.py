"""Arithmetic and data volume of the operators, as column expressions.

Dimensions may be columns or numbers; results are double columns.  A complex
multiplication counts 6 operations and a complex addition 2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of one element.
SIZES = {"s": 4, "d": 8, "c": 8, "z": 16}


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _left(side) -> Column:
    side = side if isinstance(side, Column) else F.lit(side)
    return F.upper(F.substring(side, 1, 1)) == "L"


def _total(muls: Column, adds: Column, dtype: str) -> Column:
    return 6.0 * muls + 2.0 * adds if dtype in "cz" else muls + adds


def flops_gemm(m, n, k, dtype: str = "d") -> Column:
    each = _d(m) * _d(n) * _d(k)
    return _total(each, each, dtype)


def flops_gemmt(n, k, dtype: str = "d") -> Column:
    return 0.5 * flops_gemm(n, n, k, dtype)


def flops_symm(side, m, n, dtype: str = "d") -> Column:
    """Also of HEMM."""
    return F.when(_left(side), flops_gemm(m, m, n, dtype)).otherwise(flops_gemm(m, n, n, dtype))


def flops_syrk(k, n, dtype: str = "d") -> Column:
    """Also of HERK."""
    each = 0.5 * _d(k) * _d(n) * (_d(n) + 1.0)
    return _total(each, each, dtype)


def flops_syr2k(k, n, dtype: str = "d") -> Column:
    """Also of HER2K."""
    muls = _d(k) * _d(n) * _d(n)
    return _total(muls, muls + _d(n), dtype)


def _trmm(m, n) -> tuple[Column, Column]:
    half = 0.5 * _d(n) * _d(m)
    return half * (_d(m) + 1.0), half * (_d(m) - 1.0)


def flops_trmm(side, m, n, dtype: str = "d") -> Column:
    return F.when(_left(side), _total(*_trmm(m, n), dtype)).otherwise(_total(*_trmm(n, m), dtype))


def flops_trsm(side, m, n, dtype: str = "d") -> Column:
    """Additions are counted like multiplications."""
    left, right = _trmm(m, n)[0], _trmm(n, m)[0]
    return F.when(_left(side), _total(left, left, dtype)).otherwise(_total(right, right, dtype))


def flops_copyscale(m, n, dtype: str = "d") -> Column:
    return (4.0 if dtype in "cz" else 1.0) * _d(m) * _d(n)


# Counts of the factorizations and solves that have no operator here (LAPACK working note 41).


def flops_potrf(n, dtype: str = "d") -> Column:
    n = _d(n)
    return _total(n * n * n / 6 + n * n / 2 + n / 3, n * n * n / 6 - n / 6, dtype)


def flops_potri(n, dtype: str = "d") -> Column:
    n = _d(n)
    return _total(n * n * n / 3 + n * n + 2 * n / 3, n * n * n / 3 - n * n / 2 + n / 6, dtype)


def flops_potrs(n, nrhs, dtype: str = "d") -> Column:
    n, r = _d(n), _d(nrhs)
    return _total(r * n * (n + 1), r * n * (n - 1), dtype)


def flops_getrf(m, n, dtype: str = "d") -> Column:
    lo, hi = F.least(_d(m), _d(n)), F.greatest(_d(m), _d(n))
    muls = hi * lo * lo / 2 - lo * lo * lo / 6 - lo * lo / 2 + hi * lo / 2 + 2 * lo / 3
    adds = hi * lo * lo / 2 - lo * lo * lo / 6 - hi * lo / 2 + lo / 6
    return _total(muls, adds, dtype)


def flops_getri(n, dtype: str = "d") -> Column:
    n = _d(n)
    return _total(2 * n * n * n / 3 + n * n / 2 + 5 * n / 6, 2 * n * n * n / 3 - 3 * n * n / 2 + 5 * n / 6, dtype)


def flops_getrs(n, nrhs, dtype: str = "d") -> Column:
    n, r = _d(n), _d(nrhs)
    return _total(r * n * n, r * n * (n - 1), dtype)


def flops_trtri(n, dtype: str = "d") -> Column:
    n = _d(n)
    return _total(n * n * n / 6 + n * n / 2 + n / 3, n * n * n / 6 - n * n / 2 + n / 3, dtype)


def flops_gemv(m, n, dtype: str = "d") -> Column:
    m, n = _d(m), _d(n)
    return _total(m * n + 2 * m, m * n, dtype)


def flops_symv(n, dtype: str = "d") -> Column:
    """Also of HEMV."""
    return flops_gemv(n, n, dtype)


def flops_sytrf(n, dtype: str = "d") -> Column:
    return flops_potrf(n, dtype)


def _ends(m, n) -> tuple[Column, Column, Column]:
    """(smaller, larger, whether m is the larger one)."""
    m, n = _d(m), _d(n)
    return F.least(m, n), F.greatest(m, n), m > n


def flops_geqrf(m, n, dtype: str = "d") -> Column:
    """Also of GEQLF."""
    lo, hi, tall = _ends(m, n)
    cubic = lo * lo * (hi - lo / 3)
    sign = F.when(tall, 0.5).otherwise(-0.5)
    muls = cubic + sign * lo * lo + F.when(tall, 1.0).otherwise(2.0) * lo * hi + 23 * lo / 6
    adds = cubic + sign * lo * lo + F.when(tall, 0.0).otherwise(1.0) * lo * hi + 5 * lo / 6
    return _total(muls, adds, dtype)


def flops_gerqf(m, n, dtype: str = "d") -> Column:
    """Also of GELQF."""
    lo, hi, tall = _ends(m, n)
    cubic = lo * lo * (hi - lo / 3)
    sign = F.when(tall, 0.5).otherwise(-0.5)
    muls = cubic + sign * lo * lo + F.when(tall, 1.0).otherwise(2.0) * lo * hi + 29 * lo / 6
    adds = cubic - sign * lo * lo + F.when(tall, 1.0).otherwise(0.0) * lo * hi + 5 * lo / 6
    return _total(muls, adds, dtype)


def _orthogonal(m, n, k, dtype: str, muls: Column, adds: Column) -> Column:
    m, n, k = _d(m), _d(n), _d(k)
    base = 2 * m * n * k + 2 * k * k * k / 3 - k * k * (m + n)
    return _total(base - k * k + k * muls, base + k * (adds + 1 / 3), dtype)


def flops_ungqr(m, n, k, dtype: str = "d") -> Column:
    """Also of UNGQL, ORGQR and ORGQL."""
    return _orthogonal(m, n, k, dtype, 2 * _d(n) - 5 / 3, _d(n) - _d(m))


def flops_ungrq(m, n, k, dtype: str = "d") -> Column:
    """Also of UNGLQ, ORGRQ and ORGLQ."""
    return _orthogonal(m, n, k, dtype, _d(m) + _d(n) - 2 / 3, _d(m) - _d(n))


def flops_geqrs(m, n, nrhs, dtype: str = "d") -> Column:
    m, n, r = _d(m), _d(n), _d(nrhs)
    base = r * n * (2 * m - n / 2)
    return _total(base + 2.5 * r * n, base + 0.5 * r * n, dtype)


def flops_gehrd(n, dtype: str = "d") -> Column:
    n = _d(n)
    cubic = 5 * n * n * n / 3
    return _total(cubic + n * n / 2 - 7 * n / 6 - 13, cubic - n * n - 2 * n / 3 - 8, dtype)


def flops_hetrd(n, dtype: str = "d") -> Column:
    """Also of SYTRD."""
    n = _d(n)
    cubic = 2 * n * n * n / 3
    return _total(cubic + 2.5 * n * n - n / 6 - 15, cubic + n * n - 8 * n / 3 - 4, dtype)


def flops_gebrd(m, n, dtype: str = "d") -> Column:
    lo, hi, _ = _ends(m, n)
    base = 2 * lo * lo * (hi - lo / 3)
    return _total(base + 2 * lo * lo + 20 * lo / 3, base + lo * lo - hi * lo + 5 * lo / 3, dtype)


def bytes_gemm(m, n, k, dtype: str = "d") -> Column:
    m, n, k = _d(m), _d(n), _d(k)
    return SIZES[dtype] * (m * n + m * k + k * n)


def bytes_gemmt(n, k, dtype: str = "d") -> Column:
    n, k = _d(n), _d(k)
    return SIZES[dtype] * (0.5 * n * n + 2 * n * k)


def bytes_symm(side, m, n, dtype: str = "d") -> Column:
    """Also of HEMM."""
    return F.when(_left(side), bytes_gemm(m, m, n, dtype)).otherwise(bytes_gemm(m, n, n, dtype))


def bytes_syrk(n, k, dtype: str = "d") -> Column:
    """Also of HERK."""
    n, k = _d(n), _d(k)
    return SIZES[dtype] * (0.5 * n * n + n * k)


def bytes_syr2k(n, k, dtype: str = "d") -> Column:
    """Also of HER2K."""
    n, k = _d(n), _d(k)
    return SIZES[dtype] * (0.5 * n * n + 2 * n * k)


def bytes_trsm(side, m, n, dtype: str = "d") -> Column:
    """Also of TRMM."""
    m, n = _d(m), _d(n)
    return SIZES[dtype] * (F.when(_left(side), 0.5 * m * m).otherwise(0.5 * n * n) + 2 * m * n)


def bytes_copyscale(m, n, dtype: str = "d") -> Column:
    """Both dimensions change places before the formula is applied, as callers expect."""
    m, n = _d(m), _d(n)
    return SIZES[dtype] * (m * m + 2 * m * n)


def intensity(flops: Column, bytes_moved: Column) -> Column:
    """Operations per byte; null where nothing is moved."""
    return flops / F.nullif(bytes_moved, F.lit(0.0))


def is_offloaded(flops: Column, bytes_moved: Column, threshold: float = 1600.0) -> Column:
    return F.coalesce(intensity(flops, bytes_moved) >= threshold, F.lit(False))


def auto_tile(kernel, m, n, devices, user: int = 0) -> Column:
    """Tile size a kernel would choose: ``user`` where set, else by the larger
    dimension over the devices; null for no devices.

    Fixed values: the bounds 512, 1024, 2048, 4096 and 16384, and the unit of 64.
    """
    if user:
        return F.lit(user).cast("long")
    kernel = F.upper(kernel if isinstance(kernel, Column) else F.lit(kernel))
    col = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    size, g = F.greatest(col(m), col(n)), F.nullif(col(devices), F.lit(0).cast("long"))

    def per(f) -> Column:
        """size / (f * devices), whole."""
        return F.floor(size / (f * g))

    def down(x: Column, unit: int) -> Column:
        return F.floor(x / unit) * unit

    def up64(x: Column) -> Column:
        return F.ceil(x / 64) * 64

    def rank_one(f: int) -> Column:
        return F.when(per(f) >= 2048, down(per(f), 2048)).otherwise(per(f))

    f = F.when(rank_one(2) <= 1024, 1).otherwise(2)
    nb = F.when(rank_one(2) <= 1024, rank_one(1)).otherwise(rank_one(2))
    rank_k = F.greatest(F.when(nb > 4096, per(2 * f)).otherwise(nb), F.lit(512))
    f2 = F.when(up64(per(4)) > 2048, 4).when(up64(per(3)) > 2048, 3).otherwise(2)
    nb2 = up64(per(f2))
    rank_2k = F.greatest(F.when(nb2 > 4096, per(2 * f2)).otherwise(nb2), F.lit(512))
    base = F.greatest(down(per(1), 1024), F.lit(1024))
    symmetric = F.when(base < 4096, base * 2).otherwise(base)
    triangular = F.greatest(up64(per(2)), F.lit(2048))
    first = F.when((size > g) & (size > 16384) & (per(1) < 2048), F.lit(2048)).otherwise(per(1))
    general = up64(F.greatest(F.when(first > 4096, per(2)).otherwise(first), F.lit(512)))
    other = up64(F.greatest(F.when(per(1) >= 4096, per(2)).otherwise(per(1)), F.lit(1024)))
    return F.when(
        g.isNotNull(),
        F.when(kernel.isin("HERK", "SYRK"), rank_k)
        .when(kernel.isin("HER2K", "SYR2K"), rank_2k)
        .when(kernel.isin("HEMM", "SYMM"), symmetric)
        .when(kernel.isin("TRMM", "TRSM"), triangular)
        .when(kernel.isin("GEMM", "GEMMT"), general)
        .otherwise(other)
        .cast("long"),
    )
