"""Products and solves over dense tiles.

A coordinate product of dense matrices makes M*N*K joined rows.  Here entries
are packed into tiles (ragged at the edges) and the output stays where it is:
output tiles are grouped into square blocks, each operand tile is sent to the
blocks that need it, and a task sums over the inner index in place, in
ascending order, so that every output tile leaves its task once.  Blocks and
tiles outside a wanted triangle, and inner tiles that a triangular operand
leaves empty, are never sent.  The old C arrives as one more tile.  Where the
output has fewer blocks than there are tasks, the inner index is cut into
parts as well, and only then are partial tiles summed in a second step.

Absent entries.  A tile keeps a mask of the entries that exist, unless all
do.  An output entry exists where some pair of existing entries meets, and a
NaN or infinity touches only the sums it is a term of: the same rule as for
coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.matrix import Matrix

TILE = 512
#: Output tiles along one side of a block: a task holds at most its square.
BLOCK = 8
_TILE_SCHEMA = "ti long, tj long, rows int, cols int, data binary, mask binary"


class Block:
    """A dense tile: values, the mask of existing entries (None: all), and whether all values are finite."""

    __slots__ = ("x", "mask", "finite")

    def __init__(self, x: np.ndarray, mask: np.ndarray | None = None):
        self.x, self.mask = x, mask
        self.finite = bool(np.isfinite(x).all())

    @staticmethod
    def read(rows: int, cols: int, data, mask, kind) -> "Block":
        x = np.frombuffer(data, kind).reshape((rows, cols), order="F")
        if mask is None:
            return Block(x)
        bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=rows * cols).astype(bool)
        return Block(x, bits.reshape((rows, cols), order="F"))

    def known(self) -> np.ndarray:
        return np.ones(self.x.shape, bool) if self.mask is None else self.mask

    def masked(self) -> bytes | None:
        return None if self.mask is None or self.mask.all() else np.packbits(self.mask.ravel(order="F")).tobytes()


def times(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray | None]:
    """(values, mask) of the product of two tiles."""
    if a.mask is None and b.mask is None:
        return a.x @ b.x, None
    ka, kb = a.known(), b.known()
    mask = (ka.astype(np.float32) @ kb.astype(np.float32)) > 0.5
    if a.finite and b.finite:
        return a.x @ b.x, mask
    out = np.zeros(mask.shape, np.result_type(a.x, b.x))
    for k in range(ka.shape[1]):
        r, c = np.flatnonzero(ka[:, k]), np.flatnonzero(kb[k])
        if len(r) and len(c):
            out[np.ix_(r, c)] += np.outer(a.x[r, k], b.x[k, c])
    return out, mask


def pack(m: Matrix, tile: int = TILE, tile_cols: int | None = None) -> DataFrame:
    """(ti, tj, rows, cols, data, mask): column-major tiles; absent tiles stay absent.

    Entries are shuffled by tile once and streamed in order, a tile at a time.
    """
    width, cplx = tile_cols or tile, m.is_complex
    kind = complex if cplx else float
    placed = m.doubles().select(
        F.expr(f"i div {tile}").alias("ti"), F.expr(f"j div {width}").alias("tj"),
        F.expr(f"cast(i % {tile} as int)").alias("r"), F.expr(f"cast(j % {width} as int)").alias("c"), *m.values,
    )
    nrows, ncols = m.nrows, m.ncols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x, seen = None, None, None

        def done() -> pa.RecordBatch:
            return _row(*key, Block(x, None if seen.all() else seen))

        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            ti, tj, r, c = cols[:4]
            v = cols[4] + 1j * cols[5] if cplx else cols[4]
            cut = np.flatnonzero((ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(ti)]):
                at = (int(ti[lo]), int(tj[lo]))
                if at != key:
                    if key is not None:
                        yield done()
                    key = at
                    shape = min(tile, nrows - at[0] * tile), min(width, ncols - at[1] * width)
                    x, seen = np.zeros(shape, kind, order="F"), np.zeros(shape, bool, order="F")
                x[r[lo:hi], c[lo:hi]] = v[lo:hi]
                seen[r[lo:hi], c[lo:hi]] = True
        if key is not None:
            yield done()

    return placed.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(run, _TILE_SCHEMA)


def _row(ti: int, tj: int, block: Block) -> pa.RecordBatch:
    rows, cols = block.x.shape
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ti], pa.int64()), pa.array([tj], pa.int64()), pa.array([rows], pa.int32()), pa.array([cols], pa.int32()),
            pa.array([block.x.tobytes(order="F")], pa.binary()), pa.array([block.masked()], pa.binary()),
        ],
        ["ti", "tj", "rows", "cols", "data", "mask"],
    )


def unpack(tiles: DataFrame, cplx: bool, tile: int = TILE, tile_cols: int | None = None) -> DataFrame:
    """The existing entries of tiles."""
    width, kind = tile_cols or tile, complex if cplx else float

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, (ti, tj, r, c) in enumerate(zip(*[x.to_pylist() for x in b.columns[:4]])):
                mask = b.column(5)[row].as_buffer() if b.column(5)[row].is_valid else None
                block = Block.read(r, c, b.column(4)[row].as_buffer(), mask, kind)
                yield _entries(ti * tile, tj * width, block, cplx)

    values = "re double, im double" if cplx else "v double"
    return tiles.select("ti", "tj", "rows", "cols", "data", "mask").mapInArrow(run, f"i long, j long, {values}")


def _entries(i0: int, j0: int, block: Block, cplx: bool) -> pa.RecordBatch:
    r, c = block.x.shape
    flat = block.x.ravel(order="F")
    i, j = i0 + np.tile(np.arange(r), c), j0 + np.repeat(np.arange(c), r)
    if block.mask is not None:
        keep = block.mask.ravel(order="F")
        flat, i, j = flat[keep], i[keep], j[keep]
    values = [flat.real, flat.imag] if cplx else [flat]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, *values)], ["i", "j", *(["re", "im"] if cplx else ["v"])])


def _lanes(m: Matrix) -> int:
    return int(m.spark.conf.get("spark.sql.shuffle.partitions"))


def block_side(mt: int, nt: int, lanes: int, half: bool) -> int:
    """Tiles along the side of an output block: the largest that still gives every task a block."""
    for side in range(BLOCK, 1, -1):
        rows, cols = -(-mt // side), -(-nt // side)
        if (rows * cols + rows) // 2 * 2 >= 4 * lanes if half else rows * cols >= 2 * lanes:
            return side
    return 1


def _sequence(lo, hi):
    """The numbers from lo to hi, none where hi is below lo."""
    lo, hi = (x if not isinstance(x, int) else F.lit(x) for x in (lo, hi))
    return F.when(lo.cast("long") <= hi.cast("long"), F.sequence(lo.cast("long"), hi.cast("long"))).otherwise(F.array().cast("array<bigint>"))


@dataclass(frozen=True)
class Term:
    """alpha * left * right; ``flip`` T or C: the right operand is the transpose (conjugate) of ``right``,
    so that a matrix which stands on both sides is packed by one shuffle."""

    left: Matrix
    right: Matrix
    alpha: complex | float = 1.0
    flip: str | None = None


def multiply(
    terms: list[Term],
    c: Matrix | None = None,
    region: str | None = None,
    left_is: str | None = None,
    right_is: str | None = None,
    tile: int = TILE,
    side: int | None = None,
    splits: int | None = None,
) -> DataFrame:
    """Entries of C + the sum of A B over the terms, within the triangle ``region``.

    ``left_is`` (``right_is``) tells that every A (B) is lower or upper
    triangular, so that tiles which meet none of its are not sent.
    """
    a0, b0 = terms[0].left, terms[0].right
    cplx, kind = a0.is_complex, complex if a0.is_complex else float
    mt, nt, kt = (max(1, -(-d // tile)) for d in (a0.nrows, b0.nrows if terms[0].flip else b0.ncols, a0.ncols))
    alphas = [complex(t.alpha) if cplx else float(t.alpha) for t in terms]
    lanes = _lanes(a0)
    side = side or block_side(mt, nt, lanes, bool(region))
    rows_b, cols_b = -(-mt // side), -(-nt // side)
    blocks, inner = rows_b * cols_b, kt * len(terms)
    if splits is None:
        splits = max(1, min(inner, lanes // blocks))
    part = lambda k: F.expr(f"cast(({k}) * {splits} div {inner} as int)")
    sent = []
    for t, term in enumerate(terms):
        left = pack(term.left, tile).withColumn("k", F.col("tj") + t * kt).withColumn("bi", F.expr(f"ti div {side}"))
        lo, hi = F.lit(0), F.lit(cols_b - 1)
        if region == "L":
            hi = F.least(hi, F.col("bi"))
        elif region == "U":
            lo = F.col("bi")
        if right_is == "L":
            hi = F.least(hi, F.expr(f"tj div {side}"))
        elif right_is == "U":
            lo = F.greatest(lo, F.expr(f"tj div {side}"))
        sent.append(
            left.select("bi", F.explode(_sequence(lo, hi)).alias("bj"), part("k").alias("part"), "k", F.lit(0).alias("role"), F.col("ti").alias("at"), "rows", "cols", "data", "mask")
        )
        right, role = pack(term.right, tile), 1
        if term.flip:
            role = 3 if term.flip == "C" else 2
            right = right.select(F.col("tj").alias("ti"), F.col("ti").alias("tj"), "rows", "cols", "data", "mask")
        right = right.withColumn("k", F.col("ti") + t * kt).withColumn("bj", F.expr(f"tj div {side}"))
        lo, hi = F.lit(0), F.lit(rows_b - 1)
        if region == "L":
            lo = F.col("bj")
        elif region == "U":
            hi = F.least(hi, F.col("bj"))
        if left_is == "L":
            lo = F.greatest(lo, F.expr(f"ti div {side}"))
        elif left_is == "U":
            hi = F.least(hi, F.expr(f"ti div {side}"))
        sent.append(
            right.select(F.explode(_sequence(lo, hi)).alias("bi"), "bj", part("k").alias("part"), "k", F.lit(role).alias("role"), F.col("tj").alias("at"), "rows", "cols", "data", "mask")
        )
    if c is not None:
        old = pack(c, tile).select(
            F.expr(f"ti div {side}").alias("bi"), F.expr(f"tj div {side}").alias("bj"), F.lit(0).alias("part"), F.lit(-1).cast("long").alias("k"),
            F.lit(9).alias("role"), (F.col("ti") * nt + F.col("tj")).alias("at"), "rows", "cols", "data", "mask",
        )
        sent.append(old)
    rows = sent[0]
    for s in sent[1:]:
        rows = rows.unionByName(s)
    # a block's place among all blocks, spread evenly and without hash collisions
    place = ((F.col("bi") * cols_b + F.col("bj")) * splits + F.col("part")).cast("int")
    if region:  # half of the blocks do not exist: number those that do
        far, near = F.greatest("bi", "bj"), F.least("bi", "bj")
        place = ((far * (far + 1) / 2).cast("long") + near).cast("int") * splits + F.col("part")
    tasks = max(1, min(blocks * splits, lanes))
    placed = rows.withColumn("_p", place).repartitionById(tasks, F.pmod(F.col("_p"), F.lit(tasks)).cast("int"))
    ordered = placed.sortWithinPartitions("_p", "k", "role", "at").select("_p", "k", "role", "at", "rows", "cols", "data", "mask")

    def outside(ti: int, tj: int) -> bool:
        return (region == "L" and ti < tj) or (region == "U" and ti > tj)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = inner_k = None
        held: dict[tuple[int, int], list] = {}
        lefts: dict[int, Block] = {}
        for batch in batches:
            heads = list(zip(*[x.to_pylist() for x in batch.columns[:6]]))
            data, masks = batch.column(6), batch.column(7)
            for row, (p, k, role, at, r, cl) in enumerate(heads):
                if p != block:
                    yield from _emit(held)
                    block, inner_k, held = p, None, {}
                if k != inner_k:
                    inner_k, lefts = k, {}
                mask = masks[row].as_buffer() if masks[row].is_valid else None
                x = Block.read(r, cl, data[row].as_buffer(), mask, kind)
                if role == 0:
                    alpha = alphas[k // kt]
                    lefts[at] = x if alpha == 1 else Block(x.x * alpha, x.mask)
                elif role == 9:
                    held[at // nt, at % nt] = [x.x.copy(order="F"), None if x.mask is None else x.mask.copy()]
                else:
                    if role > 1:
                        x = Block(x.x.conj().T if role == 3 else x.x.T, None if x.mask is None else x.mask.T)
                    for ti, y in lefts.items():
                        if not outside(ti, at):
                            _add(held, (ti, at), *times(y, x))
        yield from _emit(held)

    out = ordered.mapInArrow(run, _TILE_SCHEMA)
    if splits > 1:
        out = _sum_tiles(out, kind)
    return unpack(out, cplx, tile)


def _add(held: dict, key: tuple[int, int], x: np.ndarray, mask: np.ndarray | None) -> None:
    old = held.get(key)
    if old is None:
        held[key] = [x, mask]
        return
    old[0] += x
    old[1] = None if old[1] is None or mask is None else old[1] | mask


def _emit(held: dict) -> Iterator[pa.RecordBatch]:
    for (ti, tj), (x, mask) in held.items():
        yield _row(ti, tj, Block(x, mask))


def _sum_tiles(tiles: DataFrame, kind) -> DataFrame:
    """Partial tiles of one place added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for row, (ti, tj, r, c) in enumerate(zip(*[x.to_pylist() for x in batch.columns[:4]])):
                if held and (ti, tj) not in held:
                    yield from _emit(held)
                    held = {}
                mask = batch.column(5)[row].as_buffer() if batch.column(5)[row].is_valid else None
                b = Block.read(r, c, batch.column(4)[row].as_buffer(), mask, kind)
                _add(held, (ti, tj), b.x.copy(order="F"), b.mask)
        yield from _emit(held)

    return tiles.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(run, _TILE_SCHEMA)


def substitute(t: Block, b: np.ndarray, lower: bool, unit: bool) -> np.ndarray:
    """X with T X = B for one diagonal tile; IEEE results for zero pivots.

    While all is finite, halves are solved and the second one updated by a
    product; otherwise row by row, so that absent entries never meet Inf or NaN.
    """
    n, x = t.x.shape[0], np.array(b, dtype=np.result_type(t.x, b))
    pivots = unit or bool((t.x.diagonal() != 0).all())
    if n > 32 and t.finite and pivots and np.isfinite(x).all():
        whole = np.tril(t.x) if lower else np.triu(t.x)
        if _halves(whole, x, lower, unit):
            return x
        x = np.array(b, dtype=np.result_type(t.x, b))
    known = t.known()
    with np.errstate(all="ignore"):
        for r in range(n) if lower else range(n - 1, -1, -1):
            done = slice(0, r) if lower else slice(r + 1, n)
            at = np.flatnonzero(known[r, done])
            if len(at):
                x[r] -= t.x[r, done][at] @ x[done][at]
            if not unit:
                x[r] = x[r] / t.x[r, r]
    return x


def _halves(t: np.ndarray, x: np.ndarray, lower: bool, unit: bool) -> bool:
    """Solve in place; False as soon as a value is not finite."""
    n = len(t)
    if n <= 32:
        with np.errstate(all="ignore"):
            for r in range(n) if lower else range(n - 1, -1, -1):
                done = slice(0, r) if lower else slice(r + 1, n)
                x[r] -= t[r, done] @ x[done]
                if not unit:
                    x[r] /= t[r, r]
        return bool(np.isfinite(x).all())
    h = n // 2
    one, two = (slice(0, h), slice(h, n)) if lower else (slice(h, n), slice(0, h))
    if not _halves(t[one, one], x[one], lower, unit):
        return False
    x[two] -= t[two, one] @ x[one]
    return _halves(t[two, two], x[two], lower, unit)


def solve(t: Matrix, b: Matrix, lower: bool, unit: bool, lo: int, hi: int, tile: int, width: int) -> DataFrame:
    """Entries of rows lo to hi of X with T X = B, where T and B hold those rows and columns alone.

    Columns of B are independent: each block of ``width`` of them is one
    stream, in which the tiles of T pass in the order of the substitution while
    the block of X (``hi - lo`` rows) is held.  ``lo`` is a multiple of ``tile``.
    """
    cplx, kind = t.is_complex, complex if t.is_complex else float
    n, ncols, first, last = b.nrows, b.ncols, lo // tile, -(-hi // tile) - 1
    streams = max(1, -(-ncols // width))
    order = lambda c: F.col(c) if lower else F.lit(last) - F.col(c)
    left = pack(t, tile).select(
        F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("s"), order("ti").cast("long").alias("o"), order("tj").cast("long").alias("k"),
        "ti", "tj", "rows", "cols", "data", "mask",
    )
    right = pack(b, tile, width).select(
        F.col("tj").cast("int").alias("s"), order("ti").cast("long").alias("o"), F.lit(-1).cast("long").alias("k"), "ti", F.lit(-1).cast("long").alias("tj"), "rows", "cols", "data", "mask"
    )
    tasks = max(1, min(streams, _lanes(b)))
    ordered = left.unionByName(right).repartitionById(tasks, F.pmod(F.col("s"), F.lit(tasks)).cast("int")).sortWithinPartitions("s", "o", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = row_tile = None
        x: dict[int, Block] = {}
        acc, live = None, None

        def rows_of(ti: int) -> int:
            return min(tile, n - ti * tile)

        def close(s: int, ti: int, diagonal: Block | None) -> None:
            if diagonal is None:
                m = rows_of(ti)
                diagonal = Block(np.zeros((m, m), kind), np.zeros((m, m), bool))
            x[ti] = Block(substitute(diagonal, acc, lower, unit))

        def finish() -> Iterator[pa.RecordBatch]:
            keep = np.flatnonzero(live)  # a column of B without entries is one of X
            for ti in sorted(x):
                m = rows_of(ti)
                whole = np.zeros(x[ti].x.shape, bool)
                whole[:, keep] = True
                if m and len(keep):
                    yield _entries(ti * tile, stream * width, Block(x[ti].x, whole), cplx)

        def blank(s: int, ti: int) -> np.ndarray:
            return np.zeros((rows_of(ti), min(width, ncols - s * width)), kind)

        path = range(first, last + 1) if lower else range(last, first - 1, -1)
        todo: Iterator[int] = iter(())
        solved = True
        for batch in batches:
            heads = list(zip(*[c.to_pylist() for c in batch.columns[:7]]))
            for row, (s, _o, k, ti, tj, r, c) in enumerate(heads):
                if s != stream:
                    if stream is not None:
                        if not solved:
                            close(stream, row_tile, None)
                        for rest in todo:
                            acc = blank(stream, rest)
                            close(stream, rest, None)
                        yield from finish()
                    stream, x, todo, solved, row_tile = s, {}, iter(path), True, None
                    live = np.zeros(min(width, ncols - s * width), bool)
                while row_tile != ti:
                    if not solved:
                        close(stream, row_tile, None)
                    row_tile = next(todo)
                    acc, solved = blank(stream, row_tile), False
                mask = batch.column(8)[row].as_buffer() if batch.column(8)[row].is_valid else None
                block = Block.read(r, c, batch.column(7)[row].as_buffer(), mask, kind)
                if k < 0:
                    acc = acc + block.x
                    live |= block.known().any(axis=0)
                elif ti == tj:
                    close(stream, ti, block)
                    solved = True
                else:
                    acc = acc - times(block, x[tj])[0]
        if stream is not None:
            if not solved:
                close(stream, row_tile, None)
            for rest in todo:
                acc = blank(stream, rest)
                close(stream, rest, None)
            yield from finish()

    values = "re double, im double" if cplx else "v double"
    return ordered.mapInArrow(run, f"i long, j long, {values}")
