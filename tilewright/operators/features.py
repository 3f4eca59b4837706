"""One wide row per entity from events: counts, first and last times, totals.

Events are bucketed by ranges of (entity, type, time) and sorted within them
(``plans.ranges``); each sorted run of one type is streamed into a counter, a
total and the earliest and latest time, and the entity's row leaves the same
task.  There is one shuffle.  An entity that goes on in the next range leaves
a partial row there; only the first and last row of a range can be partial,
and these are added up.

The rows are written in a sparse form (the types an entity has, and their
values) before they are read twice: once for the types that occur, which
become columns, and once to be made wide, slice by slice.  ``feature_cells``
gives the same as (entity, type) rows, for any number of types.

Defined results.  Rows with a null entity column, type or time are not
events.  Equal deliveries of one record (same entity, type, time and
``record`` columns) count once; without ``record`` every row counts.  Null
values add 0 to totals.  Types the entity lacks have count 0 and null times
and totals.  An empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranges import in_ranges
from ..plans.storage import materialize

#: Types that become columns; ``feature_cells`` has no such bound.
MAX_TYPES = 4096
#: Cells of a wide slice that are held at once.
_CELLS = 1 << 21


@dataclass
class FeatureTable:
    """The wide table and, for each type, the names of its columns."""

    df: DataFrame
    types: list[tuple]
    columns: dict[tuple, dict[str, str]] = field(default_factory=dict)


@dataclass
class _Sparse:
    """Rows (entity, n_events, first_time, last_time, lists over the entity's types, _edge) and their columns."""

    df: DataFrame
    entity: list[str]
    types: list[str]
    parts: list[str]

    @property
    def lists(self) -> list[str]:
        return [*self.types, *self.parts]


def _sparse(df: DataFrame, entity: list[str], type_cols: list[str], time: str, totals: list[str], record: list[str]) -> _Sparse:
    e, t, v, r = ([f"_{p}{i}" for i in range(len(c))] for p, c in (("e", entity), ("y", type_cols), ("v", totals), ("r", record)))
    picked = [F.col(c).cast("long").alias(n) for c, n in zip([*entity, *type_cols, *record, *totals], [*e, *t, *r, *v])]
    rows = df.select(*picked, F.col(time).cast("long").alias("_time")).dropna(subset=[*e, *t, "_time"])
    parts = ["n", "first", "last", *[f"sum{i}" for i in range(len(totals))]]
    heads = [*e, "n_events", "first_time", "last_time"]
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in heads]
        + [T.StructField(n, T.ArrayType(T.LongType())) for n in (*t, *parts)]
        + [T.StructField("_edge", T.BooleanType())]
    )
    # totals take no part in the order: deliveries of one record are equal in them
    ordered = in_ranges(rows.select(*e, *t, "_time", *r, *v), [*e, *t, "_time", *r])
    fold = _Folder(len(e), len(t), len(r), len(v))
    return _Sparse(materialize(ordered.mapInArrow(fold, schema), "features"), e, t, parts)


def _cells(table: _Sparse) -> DataFrame:
    """(entity, types, parts) rows of a sparse table, partial rows not yet added up."""
    zipped = table.df.select(*table.entity, "_edge", F.explode(F.arrays_zip(*table.lists)).alias("c"))
    return zipped.select(*table.entity, "_edge", *[F.col(f"c.{x}").alias(x) for x in table.lists])


def _combined(part: str):
    """The aggregate that adds up a part, by its name."""
    if part.endswith("first") or part == "first_time":
        return F.min(part)
    return F.max(part) if part.endswith("last") or part == "last_time" else F.sum(part)


def feature_cells(df: DataFrame, entity: list[str], type_cols: list[str], time: str, totals: list[str] = (), record: list[str] = ()) -> DataFrame:
    """(entity, type, n, first, last, sum_<column>), a row per type an entity has; any number of types."""
    table = _sparse(df, entity, type_cols, time, list(totals), list(record))
    cells = _cells(table)
    whole = cells.where(~F.col("_edge")).drop("_edge")
    edges = cells.where("_edge").groupBy(*table.entity, *table.types).agg(*[_combined(p).alias(p) for p in table.parts])
    names = {**dict(zip(table.entity, entity)), **dict(zip(table.types, type_cols)), **{f"sum{i}": f"sum_{c}" for i, c in enumerate(totals)}}
    both = whole.unionByName(edges)
    return both.select(*[F.col(c).cast(df.schema[names[c]].dataType).alias(names[c]) if c in (*table.entity, *table.types) else F.col(c).alias(names.get(c, c)) for c in both.columns])


def feature_table(
    df: DataFrame,
    entity: list[str],
    type_cols: list[str],
    time: str,
    totals: list[str] = (),
    record: list[str] = (),
    types: list[tuple] | None = None,
    parts: tuple[str, ...] = ("n", "first", "last", "sum"),
) -> FeatureTable:
    """Wide rows (entity, n_events, first_time, last_time, then per type ``e<type>_n``,
    ``_first``, ``_last`` and ``_sum_<column>``).

    Entity, type, time and total columns are integers.  ``types`` fixes the
    columns; types outside it still count in the entity's own columns.
    ``parts`` chooses which columns are made per type.  Without ``types`` those
    that occur are taken; more than ``MAX_TYPES`` of them is an error.
    """
    totals = list(totals) if "sum" in parts else []
    table = _sparse(df, entity, type_cols, time, totals, list(record))
    if types is None:
        found = _cells(table).select(*table.types).distinct().limit(MAX_TYPES + 1).collect()
        if len(found) > MAX_TYPES:
            raise ValueError(f"more than {MAX_TYPES} event types: too many for columns, see feature_cells")
        types = sorted(tuple(int(x) for x in r) for r in found)
    kept = {p: p for p in ("n", "first", "last") if p in parts} | {f"sum{i}": f"sum_{c}" for i, c in enumerate(totals)}
    names = {y: {out: f"e{'_'.join(map(str, y))}_{out}" for out in kept.values()} for y in types}
    heads = [*table.entity, "n_events", "first_time", "last_time"]
    columns = [*heads, *[names[y][out] for out in kept.values() for y in types]]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in columns])

    def wide(rows: DataFrame) -> DataFrame:
        return rows.select(*heads, *table.types, *kept).mapInArrow(_Widener(len(heads), len(table.types), list(kept), types, columns), schema)

    edges = wide(table.df.where("_edge")).groupBy(*table.entity).agg(*[_combined(c).alias(c) for c in columns[len(table.entity) :]])
    out = wide(table.df.where(~F.col("_edge"))).unionByName(edges)
    back = [F.col(x).cast(df.schema[c].dataType).alias(c) for x, c in zip(table.entity, entity)]
    return FeatureTable(out.select(*back, *columns[len(entity) :]), list(types), names)


def _starts(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Where a row begins another combination of the columns' values."""
    new = np.zeros(n, bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class _Folder:
    """Folds sorted rows into one row per entity, batch by batch.

    Of a batch, runs of equal (entity, type) are reduced with numpy.  The runs of
    the last entity, at most one per type, stay open until another one shows.
    """

    def __init__(self, n_e: int, n_t: int, n_r: int, n_v: int):
        self.n_e, self.n_t, self.n_r, self.n_v = n_e, n_t, n_r, n_v

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the batch made last: its first and last row may be partial
        first = True
        for rows in self._rows(batches):
            if held is not None:
                yield self._flagged(held, first, False)
                first = False
            held = rows
        if held is not None:
            yield self._flagged(held, first, True)

    def _flagged(self, b: pa.RecordBatch, first: bool, last: bool) -> pa.RecordBatch:
        edge = np.zeros(b.num_rows, bool)
        edge[0] |= first
        edge[-1] |= last
        return b.append_column("_edge", pa.array(edge))

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = self.n_e + self.n_t
        runs = None  # columns: keys, n, first, last, sums
        last = None  # the last record, to know a repeated delivery
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = [c.to_numpy(zero_copy_only=False) for c in b.columns[: k + 1]]
            records = [c.fill_null(-(2**63)).to_numpy(zero_copy_only=False) for c in b.columns[k + 1 : k + 1 + self.n_r]]
            values = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in b.columns[k + 1 + self.n_r :]]
            if self.n_r:
                every = [*keys, *records]
                at = _starts(every, n)
                if last is not None and all(x[0] == y for x, y in zip(every, last)):
                    at = at[1:]
                last = [x[-1] for x in every]
                if len(at) < n:
                    keys, values = [x[at] for x in keys], [x[at] for x in values]
                if not len(at):
                    continue
            time = keys.pop()
            made = self._reduced([*keys, np.ones(len(time), np.int64), time, time, *values])
            runs = made if runs is None else self._reduced([np.concatenate([x, y]) for x, y in zip(runs, made)])
            ents = _starts(runs[: self.n_e], len(runs[0]))
            if len(ents) > 1:
                cut = ents[-1]
                yield self._made([x[:cut] for x in runs], ents[:-1])
                runs = [x[cut:] for x in runs]
        if runs is not None:
            yield self._made(runs, np.array([0]))

    def _reduced(self, cols: list[np.ndarray]) -> list[np.ndarray]:
        k = self.n_e + self.n_t
        at = _starts(cols[:k], len(cols[0]))
        if len(at) == len(cols[0]):
            return cols
        n, first, last, *sums = cols[k:]
        return [*[x[at] for x in cols[:k]], np.add.reduceat(n, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at), *[np.add.reduceat(x, at) for x in sums]]

    def _made(self, runs: list[np.ndarray], ents: np.ndarray) -> pa.RecordBatch:
        k, e = self.n_e + self.n_t, self.n_e
        offsets = pa.array(np.append(ents, len(runs[0])).astype(np.int32))
        own = [np.add.reduceat(runs[k], ents), np.minimum.reduceat(runs[k + 1], ents), np.maximum.reduceat(runs[k + 2], ents)]
        arrays = [pa.array(x) for x in [*[x[ents] for x in runs[:e]], *own]]
        arrays += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in runs[e:]]
        names = [*[f"_e{i}" for i in range(e)], "n_events", "first_time", "last_time", *[f"_y{i}" for i in range(self.n_t)], "n", "first", "last"]
        return pa.RecordBatch.from_arrays(arrays, [*names, *[f"sum{i}" for i in range(self.n_v)]])


class _Widener:
    """Spreads an entity's lists over the columns of all types, in slices of bounded size."""

    def __init__(self, n_heads: int, n_t: int, parts: list[str], types: list[tuple], columns: list[str]):
        self.n_heads, self.n_t, self.parts, self.types, self.columns = n_heads, n_t, parts, types, columns

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {y: i for i, y in enumerate(self.types)}
        width = max(1, len(self.types))
        step = max(1, _CELLS // (width * max(1, len(self.parts))))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                n, lists = b.num_rows, b.columns[self.n_heads :]
                row = np.repeat(np.arange(n), np.diff(lists[0].offsets.to_numpy()))
                keys = np.stack([x.flatten().to_numpy() for x in lists[: self.n_t]], 1)
                distinct, inverse = np.unique(keys, axis=0, return_inverse=True)
                col = np.array([place.get(tuple(u), -1) for u in distinct.tolist()], np.int64)[inverse.reshape(-1)]
                ok = col >= 0
                at = row[ok], col[ok]
                has = np.zeros((n, width), bool)
                has[at] = True
                arrays = list(b.columns[: self.n_heads])
                for part, values in zip(self.parts, lists[self.n_t :]):
                    cells = np.zeros((n, width), np.int64)
                    cells[at] = values.flatten().to_numpy()[ok]
                    for i in range(len(self.types)):
                        arrays.append(pa.array(cells[:, i], mask=None if part == "n" else ~has[:, i]))
                yield pa.RecordBatch.from_arrays(arrays, self.columns)
