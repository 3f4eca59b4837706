"""Reader of binary trace files.

A file is a header of ``header_bytes`` bytes and then records of 48 bytes, in
little-endian order: one byte that holds the event's number in its lower six
bits and the kind in the upper two, one byte unused, the processor in two
bytes, four bytes unused, the date in eight, and four payload fields of eight.
The begin of a call carries its name in the first payload field.

Files are read side by side, each by one task in slices of bounded size; a file
has at most 2 GB, the limit of Spark's binary files.  An incomplete last record
is left out, a file shorter than its header has no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# fixed values: the layout of a record
RECORD = np.dtype(
    [("event", "u1"), ("_a", "u1"), ("kid", "<u2"), ("_b", "<u4"), ("date", "<u8"), ("d0", "<i8"), ("d1", "<i8"), ("d2", "<i8"), ("d3", "<i8")]
)
CALL = 13
_SLICE = 65_536
SCHEMA = "path string, rpos long, evtno int, kind int, kid int, date long, d0 long, d1 long, d2 long, d3 long, name string"


def decode(content: bytes, header_bytes: int) -> np.ndarray:
    """The records of one file's bytes."""
    n = max(0, (len(content) - header_bytes) // RECORD.itemsize)
    return np.frombuffer(content, RECORD, n, header_bytes) if n else np.zeros(0, RECORD)


def read_binary(spark: SparkSession, paths: str | list[str], header_bytes: int) -> DataFrame:
    """(path, rpos, evtno, kind, kid, date, d0, d1, d2, d3, name), a row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                records = decode(content.as_buffer().to_pybytes() if content.is_valid else b"", header_bytes)
                for lo in range(0, len(records), _SLICE):
                    r = records[lo : lo + _SLICE]
                    evtno, kind = (r["event"] & 63).astype(np.int32), (r["event"] >> 6).astype(np.int32)
                    named = (evtno == CALL) & (kind == 0)
                    names = [x.tobytes().split(b"\0")[0].decode("ascii", "replace") if y else None for x, y in zip(np.ascontiguousarray(r["d0"]), named)]
                    cols = [pa.array([path] * len(r), pa.string()), pa.array(np.arange(lo, lo + len(r))), pa.array(evtno), pa.array(kind), pa.array(r["kid"].astype(np.int32))]
                    cols += [pa.array(np.ascontiguousarray(r[c]).astype(np.int64)) for c in ("date", "d0", "d1", "d2", "d3")]
                    fields = [f.split(" ")[0] for f in SCHEMA.split(", ")]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string())], fields)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, SCHEMA)
