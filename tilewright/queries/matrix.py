"""Queries of the matrix operators, on integer-valued fixtures so that sums are exact."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cost
from ..operators import blas3, distribution, frontal, tiles
from ..plans.matrix import Matrix, from_table
from ..sources.tables import read_table

# -- fixtures over lineitem: (name, rows, columns, row index, column index, value)

FIXTURES = {
    "a": (37, 29, "l_orderkey % 37", "l_partkey % 29", "l_quantity"),
    "a2": (37, 29, "l_orderkey % 37", "l_partkey % 29", "l_linenumber"),
    "b": (29, 23, "l_partkey % 29", "(l_orderkey * 7 + l_linenumber) % 23", "l_linenumber"),
    "b2": (29, 23, "l_partkey % 29", "(l_orderkey * 7 + l_linenumber) % 23", "l_quantity"),
    "c": (37, 23, "l_orderkey % 37", "l_suppkey % 23", "l_linenumber"),
    "s": (31, 31, "l_orderkey % 31", "l_partkey % 31", "round(l_discount * 100)"),
    "s2": (31, 31, "l_orderkey % 31", "l_partkey % 31", "l_linenumber"),
    "r": (31, 31, "l_partkey % 31", "l_suppkey % 31", "l_linenumber"),
    "q": (37, 37, "l_orderkey % 37", "l_suppkey % 37", "l_linenumber"),
    "q2": (37, 37, "l_orderkey % 37", "l_suppkey % 37", "l_quantity"),
}


def fixture(spark: SparkSession, sf: str, name: str) -> Matrix:
    rows, cols, i, j, v = FIXTURES[name]
    table = read_table(spark, sf, "lineitem")
    df = table.groupBy(F.expr(i).alias("i"), F.expr(j).alias("j")).agg(F.sum(F.expr(v)).cast("double").alias("v"))
    return Matrix(df, rows, cols)


def fixture_z(spark: SparkSession, sf: str, real: str, imag: str) -> Matrix:
    """A complex matrix from two fixtures over the same indices, in one scan."""
    rows, cols, i, j, v = FIXTURES[real]
    w = FIXTURES[imag][4]
    table = read_table(spark, sf, "lineitem")
    df = table.groupBy(F.expr(i).alias("i"), F.expr(j).alias("j")).agg(
        F.sum(F.expr(v)).cast("double").alias("re"), F.sum(F.expr(w)).cast("double").alias("im")
    )
    return Matrix(df, rows, cols, "z")


def _fixture_sql(name: str) -> str:
    _, _, i, j, v = FIXTURES[name]
    return f"{name} AS (SELECT {i} AS i, {j} AS j, CAST(sum({v}) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)"


def _fixture_z_sql(name: str, real: str, imag: str) -> str:
    _, _, i, j, v = FIXTURES[real]
    return f"{name} AS (SELECT {i} AS i, {j} AS j, CAST(sum({v}) AS DOUBLE) AS re, CAST(sum({FIXTURES[imag][4]}) AS DOUBLE) AS im FROM lineitem GROUP BY 1, 2)"


def _op_sql(name: str, trans: str, cplx: bool = False) -> str:
    if trans == "N":
        return f"(SELECT * FROM {name})"
    vals = ("re, -im AS im" if trans == "C" else "re, im") if cplx else "v"
    return f"(SELECT j AS i, i AS j, {vals} FROM {name})"


def _product_sql(x: str, y: str, alpha, where: str = "TRUE", cplx: bool = False) -> str:
    """Summands of alpha x y, not grouped."""
    if not cplx:
        return f"SELECT x.i AS i, y.j AS j, {alpha} * x.v * y.v AS v FROM {x} x JOIN {y} y ON x.j = y.i WHERE {where}"
    ar, ai = complex(alpha).real, complex(alpha).imag
    return (
        f"SELECT i, j, {ar} * pr - ({ai}) * pi AS re, {ar} * pi + ({ai}) * pr AS im FROM (SELECT x.i AS i, y.j AS j,"
        f" x.re * y.re - x.im * y.im AS pr, x.re * y.im + x.im * y.re AS pi FROM {x} x JOIN {y} y ON x.j = y.i WHERE {where})"
    )


def _sum_sql(ctes: list[str], parts: list[str], cplx: bool = False, real_diagonal: bool = False) -> str:
    im = "CASE WHEN i = j THEN 0.0 ELSE sum(im) END" if real_diagonal else "sum(im)"
    vals = f"CAST(sum(re) AS DOUBLE) AS re, CAST({im} AS DOUBLE) AS im" if cplx else "CAST(sum(v) AS DOUBLE) AS v"
    return f"WITH {', '.join(ctes)} SELECT i, j, {vals} FROM ({' UNION ALL '.join(parts)}) GROUP BY i, j"


QUERIES: dict = {}
SQL: dict = {}


#: Queries that are registered over tiles of 8 as well: ragged edges, several tiles along every dimension.
TILED = {
    "gemm_nn", "gemmt_l", "gemmt_u", "gemmt_0", "syrk_ln", "syrk_ut", "syr2k_ln", "syr2k_ut", "herk_ln", "herk_uc", "her2k_ln", "her2k_uc",
    "symm_ll", "symm_ru", "hemm_lu", "hemm_rl", "trmm_llnn", "trmm_lutu", "trmm_runn", "trmm_rltu", "trmm_z_luc", "trsm_lln", "trsm_lut", "trsm_run", "trsm_z_rlc",
}


def _register(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql
    if name in TILED:
        QUERIES[f"{name}_tiled"] = functools.partial(run, method="tile", tile=8)
        QUERIES[f"{name}_tiled"].__doc__ = f"{name} over tiles of 8."
        SQL[f"{name}_tiled"] = sql


# -- gemm in every pair of flags; beta 3 reads C, beta 0 does not


def _gemm_case(ta: str, tb: str):
    # fixtures whose op() dimensions fit: op(A) is 37 x 29, op(B) is 29 x 23
    def run(spark: SparkSession, sf: str, **form) -> DataFrame:
        a, b, c = (fixture(spark, sf, n) for n in "abc")
        a = a if ta == "N" else a.transposed()
        b = b if tb == "N" else b.transposed()
        return blas3.gemm(a, b, c, 2.0, 3.0, ta, tb, **form).df

    return run


_GEMM_SQL = _sum_sql(
    [_fixture_sql(n) for n in "abc"], [_product_sql("a", "b", 2.0), "SELECT i, j, 3.0 * v AS v FROM c"]
)
for _ta in "NTC":
    for _tb in "NTC":
        _register(f"gemm_{_ta.lower()}{_tb.lower()}", _gemm_case(_ta, _tb), _GEMM_SQL)

_register(
    "gemm_beta0",
    lambda spark, sf: blas3.gemm(fixture(spark, sf, "a"), fixture(spark, sf, "b"), fixture(spark, sf, "c"), -1.0, 0.0).df,
    _sum_sql([_fixture_sql(n) for n in "ab"], [_product_sql("a", "b", -1.0)]),
)
_register(
    "gemm_alpha0",
    lambda spark, sf: blas3.gemm(fixture(spark, sf, "a"), fixture(spark, sf, "b"), fixture(spark, sf, "c"), 0.0, 3.0).df,
    f"WITH {_fixture_sql('c')} SELECT i, j, 3.0 * v AS v FROM c",
)
# the bench's name for the product over the default tiles of 512
_register("gemm_tiled", functools.partial(_gemm_case("N", "N"), method="tile"), _GEMM_SQL)


def gemm_float(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (fixture(spark, sf, n) for n in "ab")
    single = lambda m: from_table(m.df, m.nrows, m.ncols, "s")
    return blas3.gemm(single(a), single(b)).df


_register("gemm_float", gemm_float, f"SELECT i, j, CAST(v AS FLOAT) AS v FROM ({_sum_sql([_fixture_sql(n) for n in 'ab'], [_product_sql('a', 'b', 1.0)])})")


def gemm_complex(spark: SparkSession, sf: str, trans: str = "N") -> DataFrame:
    a, b = fixture_z(spark, sf, "a", "a2"), fixture_z(spark, sf, "b", "b2")
    return blas3.gemm(a.transposed(conjugate=trans == "C") if trans != "N" else a, b, None, 2 - 1j, 0.0, trans, "N").df


_Z_AB = [_fixture_z_sql("a", "a", "a2"), _fixture_z_sql("b", "b", "b2")]
_register("gemm_complex", gemm_complex, _sum_sql(_Z_AB, [_product_sql("a", "b", 2 - 1j, cplx=True)], True))
_register("gemm_complex_c", lambda spark, sf: gemm_complex(spark, sf, "C"), _sum_sql(_Z_AB, [_product_sql("a", "b", 2 - 1j, cplx=True)], True))



def _gemm_z_case(ta: str, tb: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        a, b = fixture_z(spark, sf, "a", "a2"), fixture_z(spark, sf, "b", "b2")
        turn = lambda m, t: m.transposed() if t == "C" else m.transposed(conjugate=t == "T")
        return blas3.gemm(turn(a, ta), turn(b, tb), None, 1.0, 0.0, ta, tb).df

    return run


# the operands are stored so that the flags give conjugates: op(A) is conj(A) for T and C alike
_Z_CONJ = [f"{n}c AS (SELECT i, j, re, -im AS im FROM {n})" for n in "ab"]
for _ta, _tb in (("T", "T"), ("C", "C"), ("T", "C")):
    _register(f"gemm_z_{_ta}{_tb}".lower(), _gemm_z_case(_ta, _tb), _sum_sql([*_Z_AB, *_Z_CONJ], [_product_sql("ac", "bc", 1.0, cplx=True)], True))

# -- the largest stored matrix of the coordinate table times its transpose


def gram_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Per stored matrix M, the lower triangle of M M^T, in one call.

    Row i of the m-th matrix is row m S + i of one block-diagonal matrix, whose
    product with its transpose is block-diagonal again.
    """
    t = read_table(spark, sf, "coo_real").where(F.col("mat").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    order, size = t.agg(F.max(F.greatest("i", "j"))).first()[0], t.select("mat").distinct().count()
    stride = int(order or 0) + 1
    number = t.select("mat").distinct().select("mat", (F.row_number().over(Window.orderBy("mat")) - 1).cast("long").alias("_m"))  # a row per matrix
    placed = t.join(number, "mat").select((F.col("_m") * stride + F.col("i")).alias("i"), (F.col("_m") * stride + F.col("j")).alias("j"), "v")
    gram = blas3.syrk(from_table(placed, size * stride, size * stride)).df
    back = gram.select(F.expr(f"i div {stride}").alias("_g"), (F.col("i") % stride).alias("i"), (F.col("j") % stride).alias("j"), "v")
    return back.join(number, F.col("_g") == F.col("_m")).select("mat", "i", "j", "v")


_register(
    "syrk_stored",
    gram_matrix,
    """WITH t AS (SELECT DISTINCT mat, i, j, v FROM coo_real WHERE mat IS NOT NULL AND i IS NOT NULL AND j IS NOT NULL AND v IS NOT NULL AND NOT isnan(v))
SELECT x.mat, x.i, y.i AS j, sum(x.v * y.v) AS v FROM t x JOIN t y ON x.mat = y.mat AND x.j = y.j AND x.i >= y.i GROUP BY 1, 2, 3""",
)


def syrk_float(spark: SparkSession, sf: str) -> DataFrame:
    a = fixture(spark, sf, "a")
    return blas3.syrk(from_table(a.df, a.nrows, a.ncols, "s")).df


_register("syrk_float", syrk_float, f"SELECT i, j, CAST(v AS FLOAT) AS v FROM ({_sum_sql([_fixture_sql('a')], [_product_sql('a', _op_sql('a', 'T'), 1.0, 'x.i >= y.j')])})")

# -- gemmt, syrk, syr2k, herk, her2k on either triangle

_register(
    "gemmt_0",
    lambda spark, sf, **form: blas3.gemmt(*(fixture(spark, sf, n) for n in ("a", "a2", "q")), 0, 2.0, 3.0, "N", "T", **form).df,
    _sum_sql([_fixture_sql(n) for n in ("a", "a2", "q")], [_product_sql("a", _op_sql("a2", "T"), 2.0), "SELECT i, j, 3.0 * v AS v FROM q"]),
)
for _u in "LU":
    _in = "x.i >= y.j" if _u == "L" else "x.i <= y.j"
    _out = "i < j" if _u == "L" else "i > j"
    _stays = f"SELECT i, j, v FROM q WHERE {_out}"
    _scaled = f"SELECT i, j, 3.0 * v AS v FROM q WHERE NOT ({_out})"

    def _gemmt(spark, sf, u=_u, **form):
        a, a2, q = (fixture(spark, sf, n) for n in ("a", "a2", "q"))
        return blas3.gemmt(a, a2, q, u, 2.0, 3.0, "N", "T", **form).df

    _register(
        f"gemmt_{_u.lower()}", _gemmt,
        _sum_sql([_fixture_sql(n) for n in ("a", "a2", "q")], [_product_sql("a", _op_sql("a2", "T"), 2.0, _in), _scaled, _stays]),
    )
    for _t in "NT":
        _ta, _tb = ("a", _op_sql("a", "T"))

        def _syrk(spark, sf, u=_u, t=_t, **form):
            a, q = fixture(spark, sf, "a"), fixture(spark, sf, "q")
            return blas3.syrk(a if t == "N" else a.transposed(), q, u, t, 2.0, 3.0, **form).df

        _register(
            f"syrk_{_u.lower()}{_t.lower()}", _syrk,
            _sum_sql([_fixture_sql("a"), _fixture_sql("q")], [_product_sql("a", _op_sql("a", "T"), 2.0, _in), _scaled, _stays]),
        )

        def _syr2k(spark, sf, u=_u, t=_t, **form):
            a, a2, q = (fixture(spark, sf, n) for n in ("a", "a2", "q"))
            turn = (lambda m: m) if t == "N" else (lambda m: m.transposed())
            return blas3.syr2k(turn(a), turn(a2), q, u, t, 2.0, 3.0, **form).df

        _register(
            f"syr2k_{_u.lower()}{_t.lower()}", _syr2k,
            _sum_sql(
                [_fixture_sql(n) for n in ("a", "a2", "q")],
                [_product_sql("a", _op_sql("a2", "T"), 2.0, _in), _product_sql("a2", _op_sql("a", "T"), 2.0, _in), _scaled, _stays],
            ),
        )
    _zc = [_fixture_z_sql("a", "a", "a2"), _fixture_z_sql("e", "a2", "a"), _fixture_z_sql("q", "q", "q2")]
    _zstays = f"SELECT i, j, re, im FROM q WHERE {_out}"
    _zscaled = f"SELECT i, j, 3.0 * re AS re, 3.0 * CASE WHEN i = j THEN 0 ELSE im END AS im FROM q WHERE NOT ({_out})"
    for _t in "NC":

        def _herk(spark, sf, u=_u, t=_t, **form):
            a, q = fixture_z(spark, sf, "a", "a2"), fixture_z(spark, sf, "q", "q2")
            return blas3.herk(a if t == "N" else a.transposed(conjugate=True), q, u, t, 2.0, 3.0, **form).df

        _register(
            f"herk_{_u.lower()}{_t.lower()}", _herk,
            _sum_sql([_zc[0], _zc[2]], [_product_sql("a", _op_sql("a", "C", True), 2.0, _in, True), _zscaled, _zstays], True, True),
        )

        def _her2k(spark, sf, u=_u, t=_t, **form):
            a, e, q = fixture_z(spark, sf, "a", "a2"), fixture_z(spark, sf, "a2", "a"), fixture_z(spark, sf, "q", "q2")
            turn = (lambda m: m) if t == "N" else (lambda m: m.transposed(conjugate=True))
            return blas3.her2k(turn(a), turn(e), q, u, t, 2 + 1j, 3.0, **form).df

        _register(
            f"her2k_{_u.lower()}{_t.lower()}", _her2k,
            _sum_sql(
                _zc,
                [_product_sql("a", _op_sql("e", "C", True), 2 + 1j, _in, True), _product_sql("e", _op_sql("a", "C", True), 2 - 1j, _in, True), _zscaled, _zstays],
                True, True,
            ),
        )

# -- symm and hemm on either side and triangle

for _s in "LR":
    for _u in "LU":
        _keep, _strict = ("i >= j", "i > j") if _u == "L" else ("i <= j", "i < j")
        _full = f"f AS (SELECT * FROM s WHERE {_keep} UNION ALL SELECT j, i, v FROM s WHERE {_strict})"
        _pair = ("f", "r") if _s == "L" else ("r", "f")

        def _symm(spark, sf, s=_s, u=_u, **form):
            a, r, c = (fixture(spark, sf, n) for n in ("s", "r", "s2"))
            return blas3.symm(a, r, c, s, u, 2.0, 3.0, **form).df

        _register(
            f"symm_{_s.lower()}{_u.lower()}", _symm,
            _sum_sql([*[_fixture_sql(n) for n in ("s", "r", "s2")], _full], [_product_sql(*_pair, 2.0), "SELECT i, j, 3.0 * v AS v FROM s2"]),
        )
        _zfull = f"f AS (SELECT i, j, re, CASE WHEN i = j THEN 0 ELSE im END AS im FROM s WHERE {_keep} UNION ALL SELECT j, i, re, -im FROM s WHERE {_strict})"

        def _hemm(spark, sf, s=_s, u=_u, **form):
            a, r, c = (fixture_z(spark, sf, *n) for n in (("s", "s2"), ("r", "r"), ("s2", "s")))
            return blas3.hemm(a, r, c, s, u, 1 + 2j, 3.0, **form).df

        _register(
            f"hemm_{_s.lower()}{_u.lower()}", _hemm,
            _sum_sql(
                [_fixture_z_sql("s", "s", "s2"), _fixture_z_sql("r", "r", "r"), _fixture_z_sql("c", "s2", "s"), _zfull],
                [_product_sql(*_pair, 1 + 2j, cplx=True), "SELECT i, j, 3.0 * re AS re, 3.0 * im AS im FROM c"], True,
            ),
        )

# -- trmm and trsm in all cases of side, triangle, transposition and diagonal


def _tri_sql(u: str, d: str) -> str:
    keep = {("L", "N"): "i >= j", ("U", "N"): "i <= j", ("L", "U"): "i > j", ("U", "U"): "i < j"}[u, d]
    ones = " UNION ALL SELECT range, range, 1.0 FROM range(31)" if d == "U" else ""
    return f"t AS (SELECT i, j, v FROM s WHERE {keep}{ones})"


def unit_solution(spark: SparkSession, rows: int, cols: int) -> Matrix:
    """The whole-numbered X[i, c] = (5i + c) % 17 - 8."""
    x = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("i"), F.expr(f"id % {cols}").alias("j"))
    return Matrix(x.withColumn("v", ((5 * F.col("i") + F.col("j")) % 17 - 8).cast("double")), rows, cols)


for _s in "LR":
    for _u in "LU":
        for _t in "NT":
            for _d in "NU":
                _tri = _op_sql("t", _t)
                _pair = (_tri, "r") if _s == "L" else ("r", _tri)

                def _trmm(spark, sf, s=_s, u=_u, t=_t, d=_d, **form):
                    return blas3.trmm(fixture(spark, sf, "s"), fixture(spark, sf, "r"), s, u, t, d, 2.0, **form).df

                _register(
                    f"trmm_{_s}{_u}{_t}{_d}".lower(), _trmm,
                    _sum_sql([_fixture_sql("s"), _fixture_sql("r"), _tri_sql(_u, _d)], [_product_sql(*_pair, 2.0)]),
                )
            # the right-hand side is made from a known X, which the solve must give back
            _rows, _cols = (31, 5) if _s == "L" else (5, 31)

            def _trsm(spark, sf, s=_s, u=_u, t=_t, rows=_rows, cols=_cols, method="coo", tile=8):
                a = fixture(spark, sf, "s")
                small = a.with_df(a.df.withColumn("v", F.col("v") % 3 - 1))
                x = unit_solution(spark, rows, cols)
                rhs = blas3.trmm(small, x, s, u, t, "U", 0.5)
                return blas3.trsm(small, rhs, s, u, t, "U", 2.0, panel=16, method=method, tile=tile).df

            _solution = f"SELECT range // {_cols} AS i, range % {_cols} AS j, CAST((5 * (range // {_cols}) + range % {_cols}) % 17 - 8 AS DOUBLE) AS v FROM range({_rows * _cols})"
            _register(f"trsm_{_s}{_u}{_t}".lower(), _trsm, _solution)

            def _trsm_nonunit(spark, sf, s=_s, u=_u, t=_t, rows=_rows, cols=_cols):
                """Pivots are powers of two, so that every quotient is exact."""
                a = fixture(spark, sf, "s")
                value = F.when(F.col("i") == F.col("j"), F.pow(F.lit(2.0), F.col("i") % 3)).otherwise(F.col("v") % 3 - 1)
                full = a.with_df(a.df.withColumn("v", value))
                rhs = blas3.trmm(full, unit_solution(spark, rows, cols), s, u, t, "N", 0.5)
                return blas3.trsm(full, rhs, s, u, t, "N", 2.0, tile=8).df

            _register(f"trsm_{_s}{_u}{_t}_nonunit".lower(), _trsm_nonunit, _solution)

# -- the same with complex elements and conjugate transposes


def _complex_solution(spark: SparkSession, rows: int, cols: int) -> Matrix:
    x = unit_solution(spark, rows, cols).df.select("i", "j", F.col("v").alias("re"), ((3 * F.col("i") + 2 * F.col("j")) % 11 - 5).cast("double").alias("im"))
    return Matrix(x, rows, cols, "z")


for _s in "LR":
    for _u in "LU":
        _keep = "i > j" if _u == "L" else "i < j"
        _ones = " UNION ALL SELECT range, range, 1.0, 0.0 FROM range(31)"
        _tri = f"t AS (SELECT i, j, re, im FROM s WHERE {_keep}{_ones})"
        _pair = (_op_sql("t", "C", True), "r") if _s == "L" else ("r", _op_sql("t", "C", True))

        def _trmm_z(spark, sf, s=_s, u=_u, **form):
            return blas3.trmm(fixture_z(spark, sf, "s", "s2"), fixture_z(spark, sf, "r", "r"), s, u, "C", "U", 1 + 2j, **form).df

        _register(
            f"trmm_z_{_s}{_u}c".lower(), _trmm_z,
            _sum_sql([_fixture_z_sql("s", "s", "s2"), _fixture_z_sql("r", "r", "r"), _tri], [_product_sql(*_pair, 1 + 2j, cplx=True)], True),
        )
        _rows, _cols = (31, 5) if _s == "L" else (5, 31)

        def _trsm_z(spark, sf, s=_s, u=_u, rows=_rows, cols=_cols, method="coo", tile=8):
            a = fixture_z(spark, sf, "s", "s2")
            small = a.with_df(a.df.select("i", "j", (F.col("re") % 3 - 1).alias("re"), (F.col("im") % 3 - 1).alias("im")))
            rhs = blas3.trmm(small, _complex_solution(spark, rows, cols), s, u, "C", "U", 0.5)
            return blas3.trsm(small, rhs, s, u, "C", "U", 2.0, panel=16, method=method, tile=tile).df

        _register(
            f"trsm_z_{_s}{_u}c".lower(), _trsm_z,
            f"""SELECT i, j, CAST((5 * i + j) % 17 - 8 AS DOUBLE) AS re, CAST((3 * i + 2 * j) % 11 - 5 AS DOUBLE) AS im
FROM (SELECT range // {_cols} AS i, range % {_cols} AS j FROM range({_rows * _cols}))""",
        )

# -- copy-and-scale, extend-add, column swap, frontal update


def _pivots(spark: SparkSession, n: int) -> Matrix:
    k = spark.range(n)
    return Matrix(k.select(F.col("id").alias("i"), F.col("id").alias("j"), F.pow(F.lit(2.0), F.col("id") % 4).alias("v")), n, n)


_register(
    "copyscale_l",
    lambda spark, sf: frontal.copyscale(_pivots(spark, 37), fixture(spark, sf, "a"))[0].df,
    f"WITH {_fixture_sql('a')} SELECT i, j, v / pow(2.0, i % 4) AS v FROM a",
)
_register(
    "copyscale_u",
    lambda spark, sf: frontal.copyscale(_pivots(spark, 37), fixture(spark, sf, "a"))[1].df,
    f"WITH {_fixture_sql('a')} SELECT j AS i, i AS j, v FROM a",
)


def copyscale_zeros(spark: SparkSession, sf: str) -> DataFrame:
    """Pivots 2, 0 and -0.0 in turn; what is divided by zero is infinite with its sign."""
    k = spark.range(37)
    pivot = F.when(F.col("id") % 3 == 0, F.lit(2.0)).when(F.col("id") % 3 == 1, F.lit(0.0)).otherwise(F.lit(-0.0))
    d = Matrix(k.select(F.col("id").alias("i"), F.col("id").alias("j"), pivot.alias("v")), 37, 37)
    scaled = frontal.copyscale(d, fixture(spark, sf, "a"))[0].df
    return scaled.select("i", "j", F.when(F.abs("v") == float("inf"), F.signum("v") * 1e300).otherwise(F.col("v")).alias("v"))


_register(
    "copyscale_zeros",
    copyscale_zeros,
    f"WITH {_fixture_sql('a')} SELECT i, j, CASE i % 3 WHEN 0 THEN v / 2 WHEN 1 THEN 1e300 ELSE -1e300 END AS v FROM a",
)


def copyscale_complex(spark: SparkSession, sf: str, part: int = 0) -> DataFrame:
    """Complex pivots 2^k (1 + i), whose reciprocals are exact; U is given and kept."""
    k = spark.range(37)
    size = F.pow(F.lit(2.0), F.col("id") % 4)
    d = Matrix(k.select(F.col("id").alias("i"), F.col("id").alias("j"), size.alias("re"), size.alias("im")), 37, 37, "z")
    l, u = fixture_z(spark, sf, "a", "a2"), fixture_z(spark, sf, "a2", "a").transposed()
    return frontal.copyscale(d, l, u, should_copy=False)[part].df


_register(
    "copyscale_complex",
    copyscale_complex,
    f"WITH {_fixture_z_sql('a', 'a', 'a2')} SELECT i, j, (re + im) / (2 * pow(2.0, i % 4)) AS re, (im - re) / (2 * pow(2.0, i % 4)) AS im FROM a",
)
_register("copyscale_kept", lambda spark, sf: copyscale_complex(spark, sf, 1), f"WITH {_fixture_z_sql('a', 'a2', 'a')} SELECT j AS i, i AS j, re, im FROM a")
_INDEX = "SELECT range AS pos, (range * 7) % 31 + 1 AS idx FROM range(31)"


def extend_add(spark: SparkSession, sf: str, packed: bool = False) -> DataFrame:
    """The whole 31 x 31 son, its index being a permutation of the front."""
    index = spark.range(31).select(F.col("id").alias("pos"), ((F.col("id") * 7) % 31 + 1).alias("idx"))
    son = fixture(spark, sf, "r").df
    if packed:
        son = son.where("j <= i").select((F.col("i") * (F.col("i") + 1) / 2 + F.col("j")).cast("long").alias("id"), "v")
    return frontal.extend_add(fixture(spark, sf, "s"), son, index, packed=packed).df


_EXTEND_SQL = f"""WITH {_fixture_sql('s')}, {_fixture_sql('r')}, iw AS ({_INDEX})
SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM s UNION ALL
 SELECT x.idx - 1, y.idx - 1, r.v FROM r JOIN iw x ON r.i = x.pos JOIN iw y ON r.j = y.pos WHERE r.j <= r.i) GROUP BY i, j"""
_register("extend_add", extend_add, _EXTEND_SQL)
_register("extend_add_packed", functools.partial(extend_add, packed=True), _EXTEND_SQL)
_register(
    "swap_columns",
    lambda spark, sf: frontal.swap_columns(fixture(spark, sf, "a"), 3, 28).df,
    f"WITH {_fixture_sql('a')} SELECT i, CASE j WHEN 3 THEN 28 WHEN 28 THEN 3 ELSE j END AS j, v FROM a",
)


def frontal_update(spark: SparkSession, sf: str, part: int = 2) -> DataFrame:
    """Front with pivots 2^k, unit upper triangle of -1, 0 and 1, and L = op(D) X for a known X."""
    a = fixture(spark, sf, "s")
    small = a.with_df(a.df.where("i < j").withColumn("v", F.col("v") % 3 - 1))
    d = a.with_df(small.df.unionByName(_pivots(spark, 31).df))
    x = unit_solution(spark, 31, 5)
    l = blas3.trmm(small, x, "L", "U", "T", "U")
    g = Matrix(spark.range(25).select(F.expr("id div 5").alias("i"), F.expr("id % 5").alias("j"), F.col("id").cast("double").alias("v")), 5, 5)
    return frontal.frontal_update(d, l, g)[part].df


_X = "x AS (SELECT range // 5 AS i, range % 5 AS j, CAST((5 * (range // 5) + range % 5) % 17 - 8 AS DOUBLE) AS v FROM range(155))"
_register(
    "frontal_update",
    frontal_update,
    f"""WITH {_X}, g AS (SELECT range // 5 AS i, range % 5 AS j, CAST(range AS DOUBLE) AS v FROM range(25))
SELECT i, j, sum(v) AS v FROM (SELECT a.j AS i, b.j AS j, a.v / pow(2.0, a.i % 4) * b.v AS v FROM x a JOIN x b ON a.i = b.i UNION ALL SELECT i, j, v FROM g) GROUP BY i, j""",
)
_register("frontal_l", lambda spark, sf: frontal_update(spark, sf, 0), f"WITH {_X} SELECT i, j, v / pow(2.0, i % 4) AS v FROM x")

# -- distribution


def _grid(spark: SparkSession) -> DataFrame:
    return distribution.tile_grid(spark, 1000, 700, 64, 48)


def block_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    ti, tj = F.col("ti"), F.col("tj")
    return _grid(spark).select(
        "ti", "tj", "rows", "cols",
        distribution.block_cyclic_2d(ti, tj, 2, 3, 2, 4, 8).cast("int").alias("map2d"),
        distribution.block_cyclic_1d(ti, tj, 2, 8, False, 8).cast("int").alias("by_column"),
        distribution.block_cyclic_1d(ti, tj, 2, 8, True, 8).cast("int").alias("by_row"),
        distribution.cyclic(ti, tj, 15, 8).cast("int").alias("cyclic"),
        distribution.diagonal_cyclic(ti, tj, 8).cast("int").alias("diagonal"),
        distribution.single(ti, tj, 5, 8).cast("int").alias("single"),
    )


_GRID_SQL = """g AS (SELECT range // 15 AS ti, range % 15 AS tj FROM range(240)),
 t AS (SELECT ti, tj, CAST(least(64, 1000 - ti * 64) AS INT) AS rows, CAST(least(48, 700 - tj * 48) AS INT) AS cols FROM g)"""
_register(
    "block_cyclic",
    block_cyclic,
    f"""WITH {_GRID_SQL} SELECT ti, tj, rows, cols, CAST((((ti // 2) % 2) * 4 + (tj // 3) % 4) % 8 AS INT) AS map2d,
 CAST((tj // 2) % 8 AS INT) AS by_column, CAST((ti // 2) % 8 AS INT) AS by_row, CAST((ti * 15 + tj) % 8 AS INT) AS cyclic, CAST((ti + tj) % 8 AS INT) AS diagonal, 5 AS single FROM t""",
)


def distributed_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles per device once they are placed by the automatic grid of six devices."""
    gp, gq = distribution.auto_grid(6)
    placed = distribution.assign(_grid(spark), distribution.block_cyclic_2d(F.col("ti"), F.col("tj"), 1, 1, gp, gq, 6))
    at = distribution.distribute(placed, 6).withColumn("partition", F.spark_partition_id())
    return at.groupBy("pid", "partition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rows") * F.col("cols")).alias("entries"))


_register(
    "distribute",
    distributed_tiles,
    f"WITH {_GRID_SQL} SELECT CAST((ti % 3) * 2 + tj % 2 AS INT) AS pid, CAST((ti % 3) * 2 + tj % 2 AS INT) AS partition, count(*) AS n, CAST(sum(rows * cols) AS BIGINT) AS entries FROM t GROUP BY 1, 2",
)
_register(
    "coherent_upper",
    lambda spark, sf: distribution.coherent(fixture(spark, sf, "s"), 8, 8, "U")[0],
    f"WITH {_fixture_sql('s')} SELECT i, j, v FROM s WHERE i // 8 <= j // 8",
)
_register(
    "coherent_dropped",
    lambda spark, sf: distribution.coherent(fixture(spark, sf, "s"), 8, 8, "L", True)[1],
    f"WITH {_fixture_sql('s')} SELECT i, j, v FROM s WHERE i // 8 < j // 8",
)
_register(
    "tiles",
    lambda spark, sf: tiles.pack(fixture(spark, sf, "a"), 8).select("ti", "tj", "rows", "cols", (F.length("data") / 8).cast("int").alias("entries")),
    f"""WITH {_fixture_sql('a')} SELECT i // 8 AS ti, j // 8 AS tj, CAST(least(8, 37 - i // 8 * 8) AS INT) AS rows, CAST(least(8, 29 - j // 8 * 8) AS INT) AS cols,
 CAST(least(8, 37 - i // 8 * 8) * least(8, 29 - j // 8 * 8) AS INT) AS entries FROM a GROUP BY 1, 2""",
)
_register(
    "load_statistics",
    lambda spark, sf: distribution.load_statistics(read_table(spark, sf, "kaapi_event").where("kid IS NOT NULL").groupBy("kid").agg((F.sum((F.col("kind") == 0).cast("long")) - F.sum((F.col("kind") == 3).cast("long"))).alias("load")), "kid")
    .select("min_load", "max_load", "avg_load", "n_idle", F.round("deviation", 6).alias("deviation"), F.concat_ws(",", "busiest").alias("busiest")),
    """WITH l AS (SELECT kid, CAST(count(*) FILTER (kind = 0) - count(*) FILTER (kind = 3) AS DOUBLE) AS x FROM kaapi_event WHERE kid IS NOT NULL GROUP BY 1),
 s AS (SELECT min(x) AS a, max(x) AS b, avg(x) AS m, count(*) FILTER (x = 0) AS z FROM l)
SELECT a AS min_load, b AS max_load, m AS avg_load, z AS n_idle, round(sum(abs(x - m)), 6) AS deviation,
 string_agg(CASE WHEN x = b THEN CAST(kid AS VARCHAR) END, ',' ORDER BY kid) AS busiest FROM l, s GROUP BY a, b, m, z""",
)


def affinity(spark: SparkSession, sf: str) -> DataFrame:
    """Best processor of each copy's target by what the copies put where."""
    copies = read_table(spark, sf, "kaapi_event").where("evtno = 7 AND kind = 0 AND kid > 0 AND date > 0 AND d0 IS NOT NULL AND d2 IS NOT NULL AND d1 IS NOT NULL")
    kinds = read_table(spark, sf, "kproc").where("kid IS NOT NULL").groupBy("kid").agg(F.coalesce(F.min("ptype"), F.lit(-1)).alias("kind"))
    target = F.col("d1").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    rows = copies.select(F.col("file_id").alias("task"), target.alias("device"), F.col("d2").alias("bytes"), (F.col("kid") % 2 == 0).alias("readwrite"))
    rows = rows.join(kinds, F.col("device") == F.col("kid")).select("task", "device", "kind", "bytes", "readwrite")
    return distribution.affinity(rows, kinds.select(F.col("kid").alias("device"), "kind"))


_register(
    "affinity",
    affinity,
    """WITH k AS (SELECT kid AS device, coalesce(min(ptype), -1) AS kind FROM kproc WHERE kid IS NOT NULL GROUP BY 1),
 r AS (SELECT e.file_id AS task, k.device, k.kind, e.d2 * CASE WHEN e.kid % 2 = 0 THEN 2 ELSE 1 END AS w FROM kaapi_event e JOIN k ON CAST(e.d1 & 4294967295 AS INT) = k.device
  WHERE evtno = 7 AND e.kind = 0 AND e.kid > 0 AND date > 0 AND d0 IS NOT NULL AND d2 IS NOT NULL AND d1 IS NOT NULL),
 s AS (SELECT task, k.device, sum(CASE WHEN r.device = k.device THEN w ELSE 0 END) AS a, sum(CASE WHEN r.device <> k.device AND r.kind = k.kind THEN w ELSE 0 END) AS b,
  sum(CASE WHEN r.device <> k.device AND r.kind <> k.kind THEN w ELSE 0 END) AS c FROM r, k GROUP BY 1, 2)
SELECT task, device, CAST(a AS BIGINT) AS local, CAST(b AS BIGINT) AS same_kind, CAST(c AS BIGINT) AS other
FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY a DESC, b DESC, c DESC, device) AS n FROM s) WHERE n = 1""",
)
_register(
    "task_graph",
    lambda spark, sf: distribution.task_graph(spark, "gemm", 5, 4, 3),
    """SELECT 'gemm_' || m || '_' || n || '_' || k AS task, m, n, k, CASE WHEN k > 0 THEN 'gemm_' || m || '_' || n || '_' || (k - 1) END AS after
FROM (SELECT range // 12 AS m, (range // 3) % 4 AS n, range % 3 AS k FROM range(60))""",
)
_register(
    "task_graph_dot",
    lambda spark, sf: distribution.to_dot(distribution.task_graph(spark, "gemm", 5, 4, 3)),
    """SELECT '"gemm_' || m || '_' || n || '_' || (k - 1) || '" -> "gemm_' || m || '_' || n || '_' || k || '";' AS line
FROM (SELECT range // 12 AS m, (range // 3) % 4 AS n, range % 3 AS k FROM range(60)) WHERE k > 0""",
)

# -- cost formulas over dimensions taken from orders and parts


def _dims(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", (F.col("o_orderkey") % 997 + 1).alias("m"), (F.col("o_custkey") % 499 + 1).alias("n"), (F.col("o_orderkey") % 251 + 1).alias("k"))


_DIMS = "d AS (SELECT o_orderkey, CAST(o_orderkey % 997 + 1 AS DOUBLE) AS m, CAST(o_custkey % 499 + 1 AS DOUBLE) AS n, CAST(o_orderkey % 251 + 1 AS DOUBLE) AS k FROM orders)"


def cost_flops(spark: SparkSession, sf: str) -> DataFrame:
    m, n, k = F.col("m"), F.col("n"), F.col("k")
    return _dims(spark, sf).select(
        "o_orderkey", cost.flops_gemm(m, n, k).alias("gemm"), cost.flops_gemm(m, n, k, "z").alias("gemm_z"), cost.flops_gemmt(n, k).alias("gemmt"),
        cost.flops_symm("L", m, n).alias("symm_l"), cost.flops_symm("R", m, n, "c").alias("symm_r_c"), cost.flops_syrk(k, n).alias("syrk"),
        cost.flops_syr2k(k, n).alias("syr2k"), cost.flops_syr2k(k, n, "z").alias("her2k"), cost.flops_trmm("L", m, n).alias("trmm_l"),
        cost.flops_trmm("R", m, n, "z").alias("trmm_r_z"), cost.flops_trsm("L", m, n).alias("trsm_l"), cost.flops_trsm("R", m, n).alias("trsm_r"),
        cost.flops_copyscale(m, n, "z").alias("copyscale_z"),
    )


_register(
    "cost_flops",
    cost_flops,
    f"""WITH {_DIMS} SELECT o_orderkey, 2 * m * n * k AS gemm, 8 * m * n * k AS gemm_z, n * n * k AS gemmt, 2 * m * m * n AS symm_l, 8 * m * n * n AS symm_r_c,
 k * n * (n + 1) AS syrk, 2 * k * n * n + n AS syr2k, 8 * k * n * n + 2 * n AS her2k, n * m * m AS trmm_l, 3 * m * n * (n + 1) + m * n * (n - 1) AS trmm_r_z,
 n * m * (m + 1) AS trsm_l, m * n * (n + 1) AS trsm_r, 4 * m * n AS copyscale_z FROM d""",
)


def cost_bytes(spark: SparkSession, sf: str) -> DataFrame:
    m, n, k = F.col("m"), F.col("n"), F.col("k")
    flops, moved = cost.flops_gemm(m, n, k), cost.bytes_gemm(m, n, k)
    return _dims(spark, sf).select(
        "o_orderkey", moved.alias("gemm"), cost.bytes_gemmt(n, k, "s").alias("gemmt_s"), cost.bytes_symm("R", m, n, "z").alias("symm_z"),
        cost.bytes_syrk(n, k).alias("syrk"), cost.bytes_syr2k(n, k, "c").alias("syr2k_c"), cost.bytes_trsm("L", m, n).alias("trsm_l"),
        cost.bytes_trsm("R", m, n).alias("trsm_r"), cost.bytes_copyscale(m, n).alias("copyscale"),
        F.floor(cost.intensity(flops, moved)).alias("whole_intensity"), cost.is_offloaded(flops, moved, 16.0).alias("offloaded"),
    )


_register(
    "cost_bytes",
    cost_bytes,
    f"""WITH {_DIMS} SELECT o_orderkey, 8 * (m * n + m * k + k * n) AS gemm, 4 * (n * n / 2 + 2 * n * k) AS gemmt_s, 16 * (m * n + m * n + n * n) AS symm_z,
 8 * (n * n / 2 + n * k) AS syrk, 8 * (n * n / 2 + 2 * n * k) AS syr2k_c, 8 * (m * m / 2 + 2 * m * n) AS trsm_l, 8 * (n * n / 2 + 2 * m * n) AS trsm_r,
 8 * (m * m + 2 * m * n) AS copyscale, CAST(floor(2 * m * n * k / (8 * (m * n + m * k + k * n))) AS BIGINT) AS whole_intensity,
 2 * m * n * k / (8 * (m * n + m * k + k * n)) >= 16 AS offloaded FROM d""",
)


def cost_factorizations(spark: SparkSession, sf: str) -> DataFrame:
    m, n, k = F.col("m"), F.col("n"), F.col("k")
    whole = lambda c: F.round(c).cast("long")
    return _dims(spark, sf).select(
        "o_orderkey", whole(cost.flops_potrf(n)).alias("potrf"), whole(cost.flops_potri(n)).alias("potri"), whole(cost.flops_potrs(n, k)).alias("potrs"),
        whole(cost.flops_getri(n)).alias("getri"), whole(cost.flops_getrs(n, k)).alias("getrs"), whole(cost.flops_trtri(n)).alias("trtri"), whole(cost.flops_gemv(m, n)).alias("gemv"),
        whole(cost.flops_getrf(m, n)).alias("getrf"), whole(cost.flops_symv(n, "z")).alias("hemv_z"), whole(cost.flops_sytrf(n)).alias("sytrf"),
        whole(cost.flops_geqrf(m, n)).alias("geqrf"), whole(cost.flops_gerqf(m, n)).alias("gerqf"), whole(cost.flops_ungqr(m, n, k)).alias("ungqr"),
        whole(cost.flops_ungrq(m, n, k)).alias("ungrq"), whole(cost.flops_geqrs(m, n, k)).alias("geqrs"), whole(cost.flops_gehrd(n)).alias("gehrd"),
        whole(cost.flops_hetrd(n)).alias("hetrd"), whole(cost.flops_gebrd(m, n)).alias("gebrd"),
    )


_register(
    "cost_factorizations",
    cost_factorizations,
    f"""WITH {_DIMS} SELECT o_orderkey, CAST(round(n * (2 * n * n + 3 * n + 1) / 6) AS BIGINT) AS potrf, CAST(round(n * (4 * n * n + 3 * n + 5) / 6) AS BIGINT) AS potri,
 CAST(round(2 * k * n * n) AS BIGINT) AS potrs, CAST(round(n * (4 * n * n - 3 * n + 5) / 3) AS BIGINT) AS getri, CAST(round(k * n * (2 * n - 1)) AS BIGINT) AS getrs,
 CAST(round(n * (n * n + 2) / 3) AS BIGINT) AS trtri, CAST(round(2 * m * n + 2 * m) AS BIGINT) AS gemv,
 CAST(round((6 * l * l * h - 2 * l * l * l - 3 * l * l + 5 * l) / 6) AS BIGINT) AS getrf, CAST(round(8 * n * n + 12 * n) AS BIGINT) AS hemv_z,
 CAST(round(n * (2 * n * n + 3 * n + 1) / 6) AS BIGINT) AS sytrf,
 CAST(round(CASE WHEN m > n THEN (6 * l * l * h - 2 * l * l * l + 3 * l * l + 3 * l * h + 14 * l) / 3 ELSE (6 * l * l * h - 2 * l * l * l - 3 * l * l + 9 * l * h + 14 * l) / 3 END) AS BIGINT) AS geqrf,
 CAST(round(CASE WHEN m > n THEN (6 * l * l * h - 2 * l * l * l + 6 * l * h + 17 * l) / 3 ELSE (6 * l * l * h - 2 * l * l * l + 6 * l * h + 17 * l) / 3 END) AS BIGINT) AS gerqf,
 CAST(round(4 * m * n * k + 4 * k * k * k / 3 - 2 * k * k * (m + n) - k * k + k * (3 * n - m) - 4 * k / 3) AS BIGINT) AS ungqr,
 CAST(round(4 * m * n * k + 4 * k * k * k / 3 - 2 * k * k * (m + n) - k * k + 2 * k * m - k / 3) AS BIGINT) AS ungrq,
 CAST(round(k * n * (4 * m - n + 3)) AS BIGINT) AS geqrs, CAST(round((20 * n * n * n - 3 * n * n - 11 * n) / 6 - 21) AS BIGINT) AS gehrd,
 CAST(round((8 * n * n * n + 21 * n * n - 17 * n) / 6 - 19) AS BIGINT) AS hetrd,
 CAST(round(4 * l * l * h - 4 * l * l * l / 3 + 3 * l * l - h * l + 25 * l / 3) AS BIGINT) AS gebrd
 FROM (SELECT *, least(m, n) AS l, greatest(m, n) AS h FROM d)""",
)

KERNELS = ("GEMM", "GEMMT", "SYMM", "HEMM", "SYRK", "HERK", "SYR2K", "HER2K", "TRMM", "TRSM", "SWAP", "COPYSCALE")


def tile_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Automatic tile sizes of every kernel for sizes from the parts."""
    p = read_table(spark, sf, "part").select(((F.col("p_partkey") * 37) % 40000 + 1).alias("m"), ((F.col("p_partkey") * 11) % 20000 + 1).alias("n"), (F.col("p_size") % 8 + 1).alias("g")).distinct()
    p = p.withColumn("kernel", F.explode(F.array(*[F.lit(k) for k in KERNELS])))
    return p.select("m", "n", "g", "kernel", cost.auto_tile(F.col("kernel"), F.col("m"), F.col("n"), F.col("g")).alias("nb"))


_register(
    "tile_sizes",
    tile_sizes,
    """WITH p AS (SELECT DISTINCT (p_partkey * 37) % 40000 + 1 AS m, (p_partkey * 11) % 20000 + 1 AS n, p_size % 8 + 1 AS g FROM part),
 s AS (SELECT *, greatest(m, n) AS x FROM p), q AS (SELECT *, x // g AS p1, x // (2 * g) AS p2, x // (3 * g) AS p3, x // (4 * g) AS p4 FROM s),
 r AS (SELECT *, CASE WHEN p2 >= 2048 THEN p2 // 2048 * 2048 ELSE p2 END AS a2, CASE WHEN p1 >= 2048 THEN p1 // 2048 * 2048 ELSE p1 END AS a1,
  (p4 + 63) // 64 * 64 AS u4, (p3 + 63) // 64 * 64 AS u3, (p2 + 63) // 64 * 64 AS u2 FROM q),
 t AS (SELECT *, CASE WHEN a2 <= 1024 THEN CASE WHEN a1 > 4096 THEN p2 ELSE a1 END ELSE CASE WHEN a2 > 4096 THEN p4 ELSE a2 END END AS k1,
  CASE WHEN u4 > 2048 THEN CASE WHEN u4 > 4096 THEN x // (8 * g) ELSE u4 END WHEN u3 > 2048 THEN CASE WHEN u3 > 4096 THEN x // (6 * g) ELSE u3 END
   ELSE CASE WHEN u2 > 4096 THEN p4 ELSE u2 END END AS k2,
  greatest(p1 // 1024 * 1024, 1024) AS h, CASE WHEN x > g AND x > 16384 AND p1 < 2048 THEN 2048 ELSE p1 END AS e FROM r)
SELECT m, n, g, kernel, CAST(CASE WHEN kernel IN ('SYRK', 'HERK') THEN greatest(k1, 512) WHEN kernel IN ('SYR2K', 'HER2K') THEN greatest(k2, 512)
  WHEN kernel IN ('SYMM', 'HEMM') THEN CASE WHEN h < 4096 THEN 2 * h ELSE h END WHEN kernel IN ('TRMM', 'TRSM') THEN greatest(u2, 2048)
  WHEN kernel IN ('GEMM', 'GEMMT') THEN (greatest(CASE WHEN e > 4096 THEN p2 ELSE e END, 512) + 63) // 64 * 64
  ELSE (greatest(CASE WHEN p1 >= 4096 THEN p2 ELSE p1 END, 1024) + 63) // 64 * 64 END AS BIGINT) AS nb
FROM t, (SELECT unnest(['GEMM', 'GEMMT', 'SYMM', 'HEMM', 'SYRK', 'HERK', 'SYR2K', 'HER2K', 'TRMM', 'TRSM', 'SWAP', 'COPYSCALE']) AS kernel)""",
)
