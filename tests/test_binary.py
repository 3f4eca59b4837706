import struct

from tilewright.sources import trace
from tilewright.sources.binary import read_binary


def record(evtno, kind, kid, date, d0, d1=0, d2=0, d3=0):
    first = d0 if isinstance(d0, bytes) else struct.pack("<q", d0)
    return struct.pack("<BxHxxxxQ", evtno | kind << 6, kid, date) + first + struct.pack("<qqq", d1, d2, d3)


def test_records_of_binary_files(spark, tmp_path):
    head = b"h" * 100
    one = [record(2, 2, 3, 10, 7), record(2, 3, 3, 25, 7, 99), record(13, 0, 65535, 2**62, b"zgemm\0\0\0", -1, 2, 3)]
    (tmp_path / "a").write_bytes(head + b"".join(one) + b"cut")
    (tmp_path / "b").write_bytes(head + record(63, 1, 0, 1, -5))
    (tmp_path / "c").write_bytes(b"short")
    (tmp_path / "d").write_bytes(b"")
    got = sorted((r.path[-1], *tuple(r)[1:]) for r in read_binary(spark, str(tmp_path), 100).collect())
    name = struct.unpack("<q", b"zgemm\0\0\0")[0]
    assert got == [
        ("a", 0, 2, 2, 3, 10, 7, 0, 0, 0, None), ("a", 1, 2, 3, 3, 25, 7, 99, 0, 0, None), ("a", 2, 13, 0, 65535, 2**62, name, -1, 2, 3, "zgemm"),
        ("b", 0, 63, 1, 0, 1, -5, 0, 0, 0, None),
    ]
    events = read_binary(spark, str(tmp_path), 100).selectExpr("1L as file_id", "*")
    assert [tuple(r) for r in trace.intervals(events).collect()] == [(1, 3, 2, 7, 10, 25, 99)]
