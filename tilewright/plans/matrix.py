"""Matrices as DataFrames of coordinates.

A real matrix is (i LONG, j LONG, v), a complex one (i, j, re, im); an absent
entry is 0.  Element types follow the usual letters: s and d are float and
double, c and z pairs of them.  Arithmetic is done in double and cast once at
the end of an operator.  Operators are lazy and return new matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DTYPES = ("s", "d", "c", "z")


class ArgumentError(ValueError):
    """An illegal argument; ``code`` is minus its place in the documented call."""

    def __init__(self, operator: str, argument: str, code: int):
        super().__init__(f"{operator}: illegal value of {argument} ({code})")
        self.operator, self.argument, self.code = operator, argument, code


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    nrows: int
    ncols: int
    dtype: str = "d"

    @property
    def is_complex(self) -> bool:
        return self.dtype in "cz"

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.is_complex else ["v"]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_df(self, df: DataFrame, nrows: int | None = None, ncols: int | None = None) -> "Matrix":
        return Matrix(df, self.nrows if nrows is None else nrows, self.ncols if ncols is None else ncols, self.dtype)

    def doubles(self) -> DataFrame:
        """The entries with values in double, whatever the element type."""
        return self.df.select("i", "j", *[F.col(c).cast("double").alias(c) for c in self.values])

    def transposed(self, conjugate: bool = False) -> "Matrix":
        """A projection: no data moves."""
        vals = [(-F.col(c)).alias(c) if conjugate and c == "im" else F.col(c) for c in self.values]
        return Matrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), *vals), self.ncols, self.nrows, self.dtype)

    def conjugated(self) -> "Matrix":
        return self.with_df(self.df.withColumn("im", -F.col("im"))) if self.is_complex else self

    def op(self, trans: str) -> "Matrix":
        return self if trans == "N" else self.transposed(conjugate=trans == "C")

    def triangle(self, uplo: str, strict: bool = False) -> "Matrix":
        i, j = F.col("i"), F.col("j")
        keep = (i > j if strict else i >= j) if uplo == "L" else (i < j if strict else i <= j)
        return self.with_df(self.df.where(keep))

    def triangular(self, uplo: str, diag: str) -> "Matrix":
        """The referenced triangle of A; with a unit diagonal, A's own is not read."""
        if diag == "N":
            return self.triangle(uplo)
        ones = self.spark.range(self.nrows).select(F.col("id").alias("i"), F.col("id").alias("j"), *[F.lit(1.0 if c != "im" else 0.0).alias(c) for c in self.values])
        return self.with_df(self.triangle(uplo, strict=True).doubles().unionByName(ones))

    def mirrored(self, uplo: str, hermitian: bool = False) -> "Matrix":
        """The full symmetric (Hermitian) matrix of which only one triangle is stored."""
        tri = self.triangle(uplo)
        if hermitian and self.is_complex:  # the diagonal is real by definition
            tri = tri.with_df(tri.df.withColumn("im", F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.col("im"))))
        other = self.triangle(uplo, strict=True).transposed(conjugate=hermitian and self.is_complex)
        return self.with_df(tri.doubles().unionByName(other.doubles()))

    def cast(self, df: DataFrame) -> DataFrame:
        """Values of an operator's result in this matrix's element type."""
        kind = "float" if self.dtype in "sc" else "double"
        return df.select("i", "j", *[F.col(c).cast(kind).alias(c) for c in self.values])


def from_table(
    df: DataFrame, nrows: int, ncols: int, dtype: str = "d", i: str = "i", j: str = "j", values: tuple[str, ...] | None = None
) -> Matrix:
    """A matrix from a table of entries: null indices and values are left out,
    repeated rows count once, entries outside the dimensions are an error
    of the caller's and are left out."""
    if dtype not in DTYPES:
        raise ValueError(f"unknown element type {dtype!r}")
    names = ["re", "im"] if dtype in "cz" else ["v"]
    values = values or tuple(names)
    kind = "float" if dtype in "sc" else "double"
    rows = df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), *[F.col(c).cast(kind).alias(n) for c, n in zip(values, names)])
    rows = rows.dropna().where(F.col("i").between(0, nrows - 1) & F.col("j").between(0, ncols - 1)).distinct()
    return Matrix(rows, nrows, ncols, dtype)


def upper_letter(operator: str, name: str, value: str, allowed: str, code: int) -> str:
    letter = str(value).upper()[:1] if value not in (None, "") else ""
    if letter not in allowed or not letter:
        raise ArgumentError(operator, name, code)
    return letter


def scaled(values: list[str], factor: complex | float, prefix: str = "") -> list[Column]:
    """The value columns times a scalar."""
    if values == ["v"]:
        return [(F.col(f"{prefix}v") * F.lit(float(factor))).alias("v")]
    f = complex(factor)
    re, im = F.col(f"{prefix}re"), F.col(f"{prefix}im")
    if f.imag == 0:
        return [(re * f.real).alias("re"), (im * f.real).alias("im")]
    return [(re * f.real - im * f.imag).alias("re"), (re * f.imag + im * f.real).alias("im")]
