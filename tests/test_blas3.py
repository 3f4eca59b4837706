"""Matrix operators against numpy: flags, ragged sizes, element types, edge contracts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import blas3, frontal, tiles
from tilewright.operators.tiles import Block, substitute
from tilewright.plans.matrix import ArgumentError, Matrix, from_table

TYPES = {"s": np.float32, "d": np.float64, "c": np.complex64, "z": np.complex128}


def make(spark, x, dtype="d"):
    cplx = dtype in "cz"
    rows = [(int(i), int(j), *((float(v.real), float(v.imag)) if cplx else (float(v),))) for (i, j), v in np.ndenumerate(x)]
    kind = "float" if dtype in "sc" else "double"
    cols = f"re {kind}, im {kind}" if cplx else f"v {kind}"
    return Matrix(spark.createDataFrame(rows, f"i long, j long, {cols}"), x.shape[0], x.shape[1], dtype)


def dense(m):
    out = np.zeros((m.nrows, m.ncols), complex if m.is_complex else float)
    for r in m.df.collect():
        out[r.i, r.j] = complex(r.re, r.im) if m.is_complex else r.v
    return out


def ints(rng, shape, dtype="d"):
    x = rng.integers(-4, 5, shape).astype(float)
    return x + 1j * rng.integers(-4, 5, shape) if dtype in "cz" else x


def op(x, t):
    return {"N": x, "T": x.T, "C": x.conj().T}[t]


@pytest.fixture()
def rng():
    return np.random.default_rng(5)


@pytest.mark.parametrize("dtype", "sdcz")
def test_gemm_types(spark, rng, dtype):
    a, b, c = ints(rng, (5, 4), dtype), ints(rng, (4, 3), dtype), ints(rng, (5, 3), dtype)
    alpha = 2 - 1j if dtype in "cz" else 2.0
    got = blas3.gemm(make(spark, a, dtype), make(spark, b, dtype), make(spark, c, dtype), alpha, 3.0)
    assert np.array_equal(dense(got), alpha * a @ b + 3 * c)
    assert got.df.schema[2].dataType.simpleString() == ("float" if dtype in "sc" else "double")


@pytest.mark.parametrize("ta,tb", list(itertools.product("NTC", repeat=2)))
def test_gemm_flags_and_tiles(spark, rng, ta, tb):
    a, b = ints(rng, (7, 5), "z"), ints(rng, (5, 6), "z")
    x, y = (a if ta == "N" else op(a, ta)), (b if tb == "N" else op(b, tb))
    x, y = make(spark, x, "z"), make(spark, y, "z")
    for method in ("coo", "tile"):
        assert np.array_equal(dense(blas3.gemm(x, y, None, 1.0, 0.0, ta, tb, method)), a @ b)


FORMS = [("coo", 0), ("tile", 2)]


@pytest.mark.parametrize("n,side,splits", [(1, None, None), (3, None, None), (4, 1, 2), (5, 2, 1), (9, 2, 3), (9, 1, 1)])
def test_tiles_ragged(spark, rng, n, side, splits):
    a, b, c = ints(rng, (n, n + 1)), ints(rng, (n + 1, n + 2)), ints(rng, (n, n + 2))
    terms = [tiles.Term(make(spark, a), make(spark, b), 2.0), tiles.Term(make(spark, a), make(spark, b.T), 1.0, "T")]
    got = Matrix(tiles.multiply(terms, make(spark, c), tile=4, side=side, splits=splits), n, n + 2)
    assert np.array_equal(dense(got), 3 * a @ b + c)
    packed = tiles.pack(make(spark, a), 4)
    assert np.array_equal(dense(Matrix(tiles.unpack(packed, False, 4), n, n + 1)), a)


@pytest.mark.parametrize("form", FORMS[1:])
def test_absent_entries_and_nan(spark, form):
    """Both forms give the same rows: absent pairs give none, and NaN meets only what it is multiplied with."""
    entries = [(0, 0, float("nan")), (1, 1, 2.0), (3, 2, float("inf")), (4, 4, 0.0)]
    a = Matrix(spark.createDataFrame(entries, "i long, j long, v double"), 5, 5)
    b = Matrix(spark.createDataFrame([(0, 0, 1.0), (1, 1, 3.0), (2, 0, 1.0), (4, 3, 5.0)], "i long, j long, v double"), 5, 5)
    rows = lambda m: sorted((r.i, r.j, repr(r.v)) for r in m.df.collect())
    for run in (lambda m: blas3.gemm(a, b, method=m, tile=form[1]), lambda m: blas3.syrk(a, b, "L", "T", 2.0, 3.0, m, form[1])):
        assert rows(run(form[0])) == rows(run("coo"))


def test_blocks_and_tasks():
    assert tiles.block_side(16, 16, 8, False) == 5 and tiles.block_side(1, 1, 8, False) == 1
    for mt in (1, 7, 64, 1000):
        for lanes in (4, 200):
            side = tiles.block_side(mt, mt, lanes, True)
            assert side == 1 or (-(-mt // side)) * (-(-mt // side) + 1) // 2 >= lanes


def test_gemm_contracts(spark, rng):
    a, b = ints(rng, (3, 2)), ints(rng, (2, 3))
    bad = np.full((3, 3), np.nan)
    A, B, C = make(spark, a), make(spark, b), make(spark, bad)
    assert np.array_equal(dense(blas3.gemm(A, B, C, 1.0, 0.0)), a @ b)  # old C is not read
    c = make(spark, np.ones((3, 3)))
    nan_a = make(spark, np.full((3, 2), np.nan))
    assert np.array_equal(dense(blas3.gemm(nan_a, B, c, 0.0, 2.0)), 2 * np.ones((3, 3)))  # A is not read
    empty = Matrix(A.df.limit(0), 3, 0)
    assert np.array_equal(dense(blas3.gemm(empty, Matrix(B.df.limit(0), 0, 3), c, 1.0, 2.0)), 2 * np.ones((3, 3)))  # K = 0
    assert blas3.gemm(A, B, c, 0.0, 1.0) is c
    assert np.array_equal(dense(blas3.gemm(empty, Matrix(B.df.limit(0), 0, 3))), np.zeros((3, 3)))


@pytest.mark.parametrize("uplo,form", list(itertools.product(["L", "U", 0], FORMS)))
def test_gemmt(spark, rng, uplo, form):
    a, b, c = ints(rng, (5, 3)), ints(rng, (3, 5)), ints(rng, (5, 5))
    full = 2 * a @ b + 3 * c
    expected = {"L": np.tril(full) + np.triu(c, 1), "U": np.triu(full) + np.tril(c, -1), 0: full}[uplo]
    assert np.array_equal(dense(blas3.gemmt(make(spark, a), make(spark, b), make(spark, c), uplo, 2.0, 3.0, "N", "N", *form)), expected)


@pytest.mark.parametrize("uplo,trans,form", list(itertools.product("LU", "NT", FORMS)))
def test_syrk_syr2k(spark, rng, uplo, trans, form):
    a, b, c = ints(rng, (5, 3)), ints(rng, (5, 3)), ints(rng, (5, 5))
    part = (lambda f: np.tril(f) + np.triu(c, 1)) if uplo == "L" else (lambda f: np.triu(f) + np.tril(c, -1))
    x, y = (make(spark, m if trans == "N" else m.T) for m in (a, b))
    assert np.array_equal(dense(blas3.syrk(x, make(spark, c), uplo, trans, 2.0, 3.0, *form)), part(2 * a @ a.T + 3 * c))
    assert np.array_equal(dense(blas3.syr2k(x, y, make(spark, c), uplo, trans, 2.0, 3.0, *form)), part(2 * (a @ b.T + b @ a.T) + 3 * c))


@pytest.mark.parametrize("uplo,trans,form", list(itertools.product("LU", "NC", FORMS[:2])))
def test_herk_her2k(spark, rng, uplo, trans, form):
    a, b, c = ints(rng, (4, 3), "z"), ints(rng, (4, 3), "z"), ints(rng, (4, 4), "z")
    c0 = c - 1j * np.diag(c.diagonal().imag)  # the diagonal of C is real
    part = (lambda f: np.tril(f) + np.triu(c, 1)) if uplo == "L" else (lambda f: np.triu(f) + np.tril(c, -1))
    x, y = (make(spark, m if trans == "N" else m.conj().T, "z") for m in (a, b))
    C = make(spark, c, "z")
    assert np.array_equal(dense(blas3.herk(x, C, uplo, trans, 2.0, 3.0, *form)), part(2 * a @ a.conj().T + 3 * c0))
    al = 2 + 1j
    full = al * a @ b.conj().T + al.conjugate() * b @ a.conj().T + 3 * c0
    assert np.array_equal(dense(blas3.her2k(x, y, C, uplo, trans, al, 3.0, *form)), part(full))


@pytest.mark.parametrize("side,uplo,form", list(itertools.product("LR", "LU", FORMS[:2])))
def test_symm_hemm(spark, rng, side, uplo, form):
    s = ints(rng, (4, 4), "z")
    tri = np.tril(s) if uplo == "L" else np.triu(s)
    strict = tri - np.diag(tri.diagonal())
    sym, her = tri + strict.T, strict + strict.conj().T + np.diag(tri.diagonal().real)
    other = np.where(tri == 0, np.nan, tri)  # the other triangle is never read
    b = ints(rng, (4, 3) if side == "L" else (3, 4), "z")
    mul = (lambda m: m @ b) if side == "L" else (lambda m: b @ m)
    A = make(spark, np.where(np.tril(np.ones((4, 4))) if uplo == "L" else np.triu(np.ones((4, 4))), tri, other), "z")
    assert np.array_equal(dense(blas3.symm(A, make(spark, b, "z"), None, side, uplo, 1 + 1j, 0.0, *form)), (1 + 1j) * mul(sym))
    assert np.array_equal(dense(blas3.hemm(A, make(spark, b, "z"), make(spark, b, "z"), side, uplo, 2.0, 3.0, *form)), 2 * mul(her) + 3 * b)


CASES = list(itertools.product("LR", "LU", "NTC", "NU"))


@pytest.mark.parametrize("side,uplo,trans,diag", CASES)
def test_trmm_trsm(spark, rng, side, uplo, trans, diag):
    n = 7
    a = ints(rng, (n, n), "z")
    np.fill_diagonal(a, np.nan if diag == "U" else 2.0 ** (np.arange(n) % 3))  # a unit diagonal is never read
    tri = np.tril(a, -1) if uplo == "L" else np.triu(a, 1)
    tri = tri + (np.eye(n) if diag == "U" else np.diag(a.diagonal()))
    x = ints(rng, (n, 3) if side == "L" else (3, n), "z")
    b = op(tri, trans) @ x if side == "L" else x @ op(tri, trans)
    A = make(spark, a, "z")
    for form in (("coo", 0), ("tile", 3)):
        assert np.array_equal(dense(blas3.trmm(A, make(spark, x, "z"), side, uplo, trans, diag, 2.0, *form)), 2 * b)
    for panel, method, tile in ((3, "tile", 3), (4, "coo", 2), (64, "auto", 0)) if diag == "U" and trans == "N" else ((64, "auto", 3),):
        assert np.allclose(dense(blas3.trsm(A, make(spark, b, "z"), side, uplo, trans, diag, 2.0, panel, method, tile)), 2 * x, atol=1e-9)


def test_trsm_alpha_zero(spark, rng):
    a, b = make(spark, ints(rng, (4, 4))), make(spark, ints(rng, (2, 4)))
    assert not dense(blas3.trsm(a, b, "R", "U", "T", "N", 0.0)).any()
    assert not dense(blas3.trmm(a, b, "R", "U", "T", "N", 0.0)).any()


def test_singular_solve_is_ieee():
    x = substitute(Block(np.array([[0.0, 0], [1, 1]])), np.array([[1.0], [1]]), True, False)
    assert np.isinf(x[0, 0])


@pytest.mark.parametrize("lower,unit", list(itertools.product([True, False], repeat=2)))
def test_substitute_by_halves(rng, lower, unit):
    t = rng.integers(-1, 2, (80, 80)).astype(float) / 8
    np.fill_diagonal(t, 1.0 if unit else 2.0)
    tri, b = (np.tril(t) if lower else np.triu(t)), rng.random((80, 3))
    assert np.allclose(tri @ substitute(Block(t), b, lower, unit), b)
    t[40, 40], b[0, 0] = (1.0, np.inf) if unit else (0.0, 1.0)  # one column turns infinite, the others stay
    x = substitute(Block(t, np.eye(80, dtype=bool)), b, lower, unit)
    assert np.isfinite(x).sum() == (239 if unit else 237)


@pytest.mark.parametrize(
    "call,code",
    [
        (lambda m: blas3.gemm(m, m, transa="X"), -1),
        (lambda m: blas3.gemm(m, m, transb=""), -2),
        (lambda m: blas3.gemm(m, Matrix(m.df, 3, 2)), -10),
        (lambda m: blas3.gemm(m, m, Matrix(m.df, 1, 1)), -13),
        (lambda m: blas3.gemmt(m, m, uplo="X"), -3),
        (lambda m: blas3.trsm(m, m, side="X"), -1),
        (lambda m: blas3.trsm(m, m, uplo="X"), -2),
        (lambda m: blas3.trmm(m, m, diag="X"), -4),
        (lambda m: blas3.symm(m, m, side="?"), -1),
        (lambda m: blas3.syrk(m, trans="C"), -2),
        (lambda m: blas3.syr2k(m, m, uplo="?"), -1),
        (lambda m: blas3.herk(m), -7),
        (lambda m: frontal.swap_columns(m, 0, 2), -8),
        (lambda m: frontal.swap_columns(m, -1, 1), -5),
        (lambda m: frontal.copyscale(Matrix(m.df, 2, 3), m), -5),
        (lambda m: frontal.extend_add(m, m.df, m.df, nelim=1), -1),
    ],
)
def test_illegal_arguments(spark, call, code):
    with pytest.raises(ArgumentError) as e:
        call(make(spark, np.eye(2)))
    assert e.value.code == code


def test_herk_wants_real_scalars(spark):
    m = make(spark, np.eye(2), "z")
    with pytest.raises(ArgumentError):
        blas3.herk(m, alpha=1j)
    with pytest.raises(ArgumentError):
        blas3.herk(m, trans="T")


def test_copyscale(spark, rng):
    d = np.diag([2.0, 4.0, 0.0])
    l = np.array([[1.0, 2], [4, 8], [1, -1]])
    scaled, u = frontal.copyscale(make(spark, d), make(spark, l))
    assert np.array_equal(dense(scaled), np.array([[0.5, 1], [1, 2], [np.inf, -np.inf]]))
    assert np.array_equal(dense(u), l.T)
    old = make(spark, np.ones((2, 3)))
    assert frontal.copyscale(make(spark, d), make(spark, l), old, False)[1] is old
    z = np.diag([1 + 1j, 2.0])
    lz = np.array([[2 + 0j], [4j]])
    assert np.allclose(dense(frontal.copyscale(make(spark, z, "z"), make(spark, lz, "z"))[0]), lz / z.diagonal()[:, None])


def test_extend_add(spark, rng):
    a, son, iw = ints(rng, (6, 6)), ints(rng, (3, 3)), np.array([2, 4, 5])
    expected = a.copy()
    for i in range(3):
        for j in range(i + 1):
            expected[iw[i] - 1, iw[j] - 1] += son[i, j]
    index = spark.createDataFrame([(k, int(v)) for k, v in enumerate(iw)], "pos long, idx long")
    assert np.array_equal(dense(frontal.extend_add(make(spark, a), make(spark, son).df, index)), expected)
    packed = spark.createDataFrame([(i * (i + 1) // 2 + j, float(son[i, j])) for i in range(3) for j in range(i + 1)], "id long, v double")
    assert np.array_equal(dense(frontal.extend_add(make(spark, a), packed, index, packed=True)), expected)


def test_from_table_cleans(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 1.0), (1, None, 2.0), (1, 1, None), (9, 0, 5.0)], "i int, j int, v double")
    m = from_table(df, 2, 2)
    assert dense(m).tolist() == [[1.0, 0.0], [0.0, 0.0]]
    assert m.df.where(F.col("i") == 0).count() == 1
    with pytest.raises(ValueError):
        from_table(df, 2, 2, "q")
