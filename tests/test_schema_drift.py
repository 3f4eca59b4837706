import datetime as dt
import json
import random

import pytest

from tilewright.functions.tree_edit import Node, cost, edit_script
from tilewright.operators import schema_drift

SCHEMA = "file_id long, fileset_id long, file_name string, written_ts timestamp, header string, perfcounter_name string, fmtdefs string"


def file(i, header=None, counters=None, fmt=None, fileset=1, at=None):
    ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i if at is None else at)
    enc = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    return (i, fileset, f"f{i}", ts, enc(header), enc(counters), enc(fmt))


def changes(spark, files, **kw):
    df = spark.createDataFrame(files, SCHEMA)
    return sorted(tuple(r) for r in schema_drift.schema_changes(df, **kw).select("file_id", "section", "field", "change").collect())


def test_each_change(spark):
    files = [
        file(1, {"a": 1, "b": "x", "c": 1.5}, {"0": "work ", "1": "idle"}, [{"id": 1, "name": "p"}, {"id": 2, "name": "q"}]),
        file(2, {"a": 2, "host": "x", "c": None, "d": True}, {"0": "work", "1": "Idle", "5": "new"}, [{"id": 1, "label": "p"}, {"id": 2, "label": "q"}]),
        file(3, "", '{"0": "wor', "   "),
        file(4, {"a": "2", "c": [1]}, {"0": "work"}, [{"id": "1", "label": "p"}]),
    ]
    assert changes(spark, files + files[:2]) == [
        (2, "fmtdefs", "label", "renamed"), (2, "header", "d", "added"), (2, "header", "host", "renamed"),
        (2, "perfcounter_name", "Idle", "renamed"), (2, "perfcounter_name", "new", "added"),
        (4, "fmtdefs", "id", "retyped"), (4, "header", "a", "retyped"), (4, "header", "c", "retyped"), (4, "header", "d", "removed"),
        (4, "header", "host", "removed"), (4, "perfcounter_name", "Idle", "removed"), (4, "perfcounter_name", "new", "removed"),
    ]


def test_order_is_by_time_and_null_keeps_what_is_known(spark):
    files = [file(9, {"a": 1}, at=1), file(3, {"a": None}, at=2), file(5, {"z": 1}, at=3), file(4, {"z": None}, at=4), file(2, {"z": 2.5}, at=5)]
    assert changes(spark, files) == [(2, "header", "z", "retyped"), (5, "header", "z", "renamed")]
    never = [file(1, {"a": None}), file(2, {"a": 1}), file(3, {"b": None})]
    assert changes(spark, never) == [(3, "header", "a", "removed"), (3, "header", "b", "added")]


def random_files(seed, n):
    r = random.Random(seed)
    fields = {"a": 1, "b": "x"}
    files = []
    for i in range(n):
        if r.random() < 0.4:
            what = r.choice(["add", "drop", "type", "rename"])
            name = r.choice(sorted(fields)) if fields else None
            if what == "add" or name is None:
                fields[f"n{i}"] = r.choice([1, "s", 2.5, [1], True]) if r.random() < 0.9 else i
            elif what == "drop":
                fields.pop(name)
            elif what == "type":
                fields[name] = [i] if not isinstance(fields[name], list) else str(i)
            else:
                fields[f"r{i}"] = fields.pop(name)
        shown = {k: (None if r.random() < 0.1 else v) for k, v in fields.items()}
        files.append(file(i, shown if r.random() < 0.9 else '{"cut', {str(k): k for k in shown}, [shown, shown], fileset=1 if r.random() < 0.8 else 2))
    return files


def brute(files):
    """Changes file by file, without ranges."""
    out, states = [], {}
    for f in sorted(set(files), key=lambda f: (f[1], f[3], f[0])):
        state = states.setdefault(f[1], {})
        for section, text in zip(schema_drift.SECTIONS, f[4:]):
            new = schema_drift.read_section(section, text)
            if new is None:
                continue
            old = state.get(section)
            state[section] = new = schema_drift.carry(old, new)
            if old is not None:
                out += [(f[0], section, *c[:2]) for c in schema_drift.compare(section, old, new)]
    return sorted(out)


@pytest.mark.parametrize("seed,ranges", [(1, 1), (1, 4), (2, 4), (1, 23), (2, 23), (3, 60)])
def test_huge_fileset_over_ranges_gives_the_same(spark, seed, ranges):
    files = random_files(seed, 300)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        assert changes(spark, files) == brute(files)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_empty_null_and_odd(spark):
    assert changes(spark, []) == []
    files = [file(1, "null", "[]", "{}"), file(2, "3", '"x"', "[1]"), file(3, {}, {}, []), file(4, {"a": 1}, {"1": None}, [{}])]
    assert changes(spark, files) == [(4, "header", "a", "added"), (4, "perfcounter_name", "1", "added")]
    nulls = [(None, 1, None, None, "{}", None, None), (5, None, None, None, None, None, None)]
    assert changes(spark, nulls) == []


def test_consistent_table(spark):
    files = [file(1, {"a": 1, "b": "x"}), file(2, {"a": 2, "host": "x"}), file(3, '{"a": 1')]
    rows = {r.file_id: r.asDict() for r in schema_drift.consistent_table(spark.createDataFrame(files, SCHEMA)).collect()}
    assert rows[1]["header_host"] == rows[2]["header_host"] == "x" and rows[3]["header_a"] is None and rows[2]["header_a"] == 2


def test_consistent_table_holds_each_section(spark):
    files = [
        file(1, {"a": 1}, {"0": " work ", "10": "idle"}, [{"id": 1, "name": "p"}, {"id": 2, "name": None}]),
        file(2, {"a": 2}, {"0": "Work\t", "2": None}, [{"id": 3, "label": "p", "x": [1]}, {"id": 4, "label": None, "x": {"y": 2}}]),
        file(3, '{"a": 3} x', '{"0": "wor', '[{"id": 1}'),
        file(4, {}, '{"0": "x"}}', "[1]"),
        file(5, None, "[]", []),
    ]
    table = schema_drift.consistent_table(spark.createDataFrame(files + files[:2], SCHEMA))
    assert table.columns[4:] == [
        "header_a", "perfcounter_name_0", "perfcounter_name_2", "perfcounter_name_10", "fmtdefs_id", "fmtdefs_label", "fmtdefs_x"
    ]
    rows = {r.file_id: tuple(r)[4:] for r in table.collect()}
    assert rows.pop(1) == (1, "work", None, "idle", [1, 2], ["p", None], None)
    assert rows.pop(2) == (2, "Work", None, None, [3, 4], ["p", None], ["[1]", '{"y":2}'])
    assert rows == {i: (None,) * 7 for i in (3, 4, 5)}


def test_renames_hold_within_their_fileset(spark):
    files = [
        file(1, {"a": "x"}, None, [{"p": 1}]), file(2, {"b": "x"}, None, [{"q": 1}]), file(3, {"c": "x"}, None, [{"q": 1}]),
        file(4, {"a": 1, "b": 2}, None, [{"p": 3, "q": 4}], fileset=2), file(5, {"a": "y"}, fileset=3),
    ]
    table = schema_drift.consistent_table(spark.createDataFrame(files, SCHEMA))
    assert table.columns[4:] == ["header_a", "header_b", "header_c", "fmtdefs_p", "fmtdefs_q"]
    rows = {r.file_id: tuple(r)[4:] for r in table.collect()}
    assert rows[1] == rows[2] == rows[3] == (None, None, "x", None, [1])
    assert rows[4] == ("1", 2, None, [3], [4]) and rows[5] == ("y", None, None, None, None)


def test_no_value_is_lost_where_names_are_used_again(spark):
    """a becomes b, while an earlier file held another b, and a later one a new a."""
    files = [file(1, {"a": "x", "b": "z"}), file(2, {"a": "x"}), file(3, {"b": "x"}), file(4, {"b": "x", "a": 5}), file(5, {"b": "x", "n": 5})]
    cells = schema_drift.consistent_cells(spark.createDataFrame(files, SCHEMA)).collect()
    by = {}
    for r in cells:
        by.setdefault(r.file_id, {})[r.field] = r.value
    assert by == {1: {"a": "x", "b": "z"}, 2: {"b": "x"}, 3: {"b": "x"}, 4: {"b": "x", "n": "5"}, 5: {"b": "x", "n": "5"}}


@pytest.mark.parametrize(
    "values,kind,shown",
    [
        ([1, 2], "bigint", [1, 2]), ([1, 2.5], "double", [1.0, 2.5]), ([1, 2**60], "bigint", [1, 2**60]), ([2.5, 2**60], "string", ["2.5", str(2**60)]),
        ([2**70, 1], "string", [str(2**70), "1"]), ([True, False], "boolean", [True, False]), ([True, 1], "string", ["true", "1"]), ([[1], None], "string", ["[1]", None]),
    ],
)
def test_types_are_reconciled(spark, values, kind, shown):
    table = schema_drift.consistent_table(spark.createDataFrame([file(i, {"a": v}) for i, v in enumerate(values)], SCHEMA), ("header",))
    assert dict(table.dtypes)["header_a"] == kind
    assert [r.header_a for r in table.orderBy("file_id").collect()] == shown


@pytest.mark.parametrize("section", schema_drift.SECTIONS)
def test_p2_table_has_the_section(spark, section):
    """Every readable text of the smallest tables comes out, field by field."""
    from tilewright.queries.general import p2_table

    sf = "/root/testdata/sf0.001"
    rows = {r.file_id: {c: v for c, v in r.asDict().items() if c.startswith(f"{section}_")} for r in p2_table(spark, sf).collect()}
    texts = {r.file_id: r[section] for r in spark.read.parquet(f"{sf}/event_file.parquet").collect()}
    read = {i: schema_drift.parse(section, t) for i, t in texts.items()}
    assert rows.keys() == read.keys() and any(read.values())
    for i, value in read.items():
        known = [v for v in rows[i].values() if v is not None]
        if section == "fmtdefs":
            assert len(known) == len({k for e in value or () for k in e}) and {len(v) for v in known} <= {len(value or ())}
        else:
            assert len(known) == sum(v is not None for v in (value or {}).values())
        if section == "header" and value:
            assert sorted(map(str, known)) == sorted(str(v) for v in value.values() if v is not None)


def leaf(name, kind="integer", content="1"):
    return Node(name, kind, content)


def tree(name, *children):
    return Node(name, "object", None, {c.name: c for c in children})


def least_cost(old, new):
    """Cost of the cheapest script by trying every matching of the subtrees that vanish and appear."""
    from tilewright.functions import tree_edit as te

    gone, come = [], []
    fixed = cost(te._walk(old, new, (), (), gone, come))

    def best(i, free):
        if i == len(gone):
            return sum(come[j].node.size() for j in free)
        a = gone[i]
        costs = [a.node.size() + best(i + 1, free)]
        for j in free:
            if te.can_match(a.node) and te.shape(a.node) == te.shape(come[j].node):
                costs.append(te.match_cost(a, come[j]) + best(i + 1, free - {j}))
        return min(costs)

    return fixed + best(0, frozenset(range(len(come))))


def random_tree(r, name="", depth=2):
    children = []
    for n in r.sample("abcdef", r.randint(0, 4)):
        children.append(random_tree(r, n, depth - 1) if depth and r.random() < 0.4 else leaf(n, r.choice(["integer", "string"]), r.choice("uv")))
    return tree(name, *children)


@pytest.mark.parametrize("seed", range(8))
def test_scripts_are_of_least_cost(seed):
    r = random.Random(seed)
    for _ in range(60):
        old, new = random_tree(r), random_tree(r)
        assert cost(edit_script(old, new)) == least_cost(old, new)


def test_nested_edit_scripts():
    old = tree("", tree("p", leaf("x", "string", "u"), leaf("y")), leaf("q", "string", "z"))
    new = tree("", tree("p", leaf("x2", "string", "u")), tree("o", leaf("y")), leaf("q", "list", "z"))
    script = {(e.change, ".".join(e.path)) for e in edit_script(old, new)}
    assert script == {("renamed", "p.x2"), ("retyped", "q"), ("added", "o"), ("removed", "p.y")}
    moved = edit_script(tree("", tree("p", leaf("y")), tree("o")), tree("", tree("p"), tree("o", leaf("y"))))
    assert [(e.change, e.path, e.old) for e in moved] == [("moved", ("o", "y"), ("p", "y"))]
    assert cost(edit_script(old, old)) == 0
    assert cost(edit_script(tree(""), old)) == old.size() - 1
