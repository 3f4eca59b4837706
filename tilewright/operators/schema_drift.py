"""Schemas that drift between the files of a fileset.

Each file carries JSON sections; their fields come, go, change names and
types.  ``schema_changes`` reports every change against the last earlier
file in which the section is readable.  ``consistent_table`` compiles the
renames of each fileset into a projection per file and reads all files into
one table; ``consistent_cells`` is its long form, for any number of fields.

Files are taken in ranges of (fileset, time) (``plans.ranges``) and streamed;
the schema of a section is a tree, and the change from one tree to the next is
a minimum-cost edit script (``functions.tree_edit``).  The first fileset of a
range may go on from the range before: its files are passed on, with the state
in which each range closes, and streamed once the states are folded into
each range's opening state.  There is one such fileset a range, so a fileset
of any size is read by as many tasks as it has ranges.

Defined results.  Repeated rows of a file count once (of differing ones, the
least).  A file with a null fileset or time belongs to no series and is left
out of the changes.  Null, blank, cut-off or wrongly shaped JSON is not
readable.  A null value keeps the type and content last known while the field
stays.  Files written at the same instant are taken by file_id.  An empty
table gives no changes.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tree_edit import Node, edit_script
from ..plans.ranges import in_ranges, range_number
from ..plans.storage import materialize

SECTIONS = ("header", "perfcounter_name", "fmtdefs")
#: Fields that become columns of the wide table; ``consistent_cells`` has no such bound.
MAX_FIELDS = 2000
_CHANGE = ("fileset_id", "file_id", "written", "section", "field", "change", "old_field")
CHANGE_SCHEMA = "fileset_id long, file_id long, written long, section string, field string, change string, old_field string"


def type_of(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "fraction"
    if isinstance(v, str):
        return "string"
    return "list" if isinstance(v, list) else "object"


def parse(section: str, text):
    """The JSON value of a readable section, or None."""
    if not isinstance(text, str) or not text.strip():
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if section == "fmtdefs":
        return value if isinstance(value, list) and all(isinstance(e, dict) for e in value) else None
    return value if isinstance(value, dict) else None


def _content(v):
    """What tells two values of one type apart."""
    return json.dumps(v, sort_keys=True) if isinstance(v, (list, dict)) else v


def read_section(section: str, text) -> dict | None:
    """{key: [name, type, content, nested fields]} of a readable section, or None.

    In the header a field is known by its name; of a counter table by the
    counter's number, its name without blanks around being what may change; of
    a list of entries by its name, its content being the list of its values.
    """
    value = parse(section, text)
    if value is None:
        return None
    if section == "fmtdefs":
        names = dict.fromkeys(k for e in value for k in e)
        out = {}
        for k in names:
            column = [e.get(k) for e in value]
            kind = next((type_of(v) for v in column if v is not None), None)
            out[k] = [k, kind, json.dumps(column, sort_keys=True) if kind else None, None]
        return out
    if section == "perfcounter_name":
        return {k: [str(v).strip() if v is not None else None, "counter", None, None] for k, v in value.items()}
    return {k: [k, type_of(v), _content(v), v if isinstance(v, dict) else None] for k, v in value.items()}


def _tree(name: str, fields: dict) -> Node:
    root = Node(name, "object")
    for k, (label, kind, content, nested, *_) in fields.items():
        child = Node(label if label is not None else k, kind, content)
        if isinstance(nested, dict):
            child = _tree(k, {n: [n, type_of(v), _content(v), v if isinstance(v, dict) else None] for n, v in nested.items()})
            child.content = content
        root.children[k] = child
    return root


def compare(section: str, old: dict, new: dict) -> list[tuple[str, str, str | None]]:
    """(field, change, old field) of a section between two successive states: the edit script between their trees.

    A counter whose name is not known yet takes its name without a change.
    """
    if old.keys() == new.keys() and all(a[0] == b[0] and a[1] == b[1] and not a[3] and not b[3] for a, b in zip(old.values(), map(new.get, old))):
        return []
    if section == "perfcounter_name":
        old = {k: [new[k][0], *v[1:]] if v[0] is None and k in new else v for k, v in old.items()}
    out = []
    for e in edit_script(_tree(section, old), _tree(section, new)):
        field = ".".join(e.path)
        out.append((field, e.change, ".".join(e.old) if e.old else field if e.change == "removed" else None))
    return out


def carry(old: dict | None, new: dict) -> dict:
    """``new`` with nulls filled by what was last known of the field.

    A fifth entry marks fields that were null since the series began: what an
    earlier part of the series knew of them is theirs.
    """
    if old is None:
        return {k: [*v[:4], _unknown(v)] for k, v in new.items()}
    return {k: old[k] if k in old and _unknown(v) else [*v[:4], False] for k, v in new.items()}


def _unknown(v: list) -> bool:
    return v[0] is None if v[1] == "counter" else v[1] is None


def resume(opening: dict | None, closing: dict | None) -> dict | None:
    """The state after a part of a series, given the state before it."""
    if closing is None or opening is None:
        return opening if closing is None else closing
    return {k: opening[k] if v[4] and k in opening else [*v[:4], False] for k, v in closing.items()}


class _Series:
    """Streams sorted files, fileset by fileset.

    In the first step (``final`` False) changes are given of all filesets but
    the range's first one, whose files are passed on; the state in which the
    range's last fileset closes is given too.  In the second step files come by
    (fileset, range), led by the opening state.
    """

    def __init__(self, sections: tuple[str, ...], final: bool):
        self.sections, self.final = sections, final
        self.names = ["tag", "at", *_CHANGE, "state", *sections]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = range_number()
        key = first = file_id = None
        state: dict = {}
        texts: dict = {}
        rows: list = []
        for b in batches:
            for tag, part, fileset, fid, written, opening, *values in zip(*[c.to_pylist() for c in b.columns]):
                own = (fileset, part if self.final else None)
                if own != key:
                    if first is None:
                        first = own
                    key, state, texts, file_id = own, {}, {}, None
                if tag == "state":
                    state = json.loads(opening)
                    continue
                if fid == file_id:
                    continue
                file_id = fid
                head = not self.final and key == first
                if head:
                    rows.append(("row", at, fileset, fid, written, None, None, None, None, None, *values))
                for section, text in zip(self.sections, values):
                    if text is None or text == texts.get(section):
                        continue  # the same text again changes nothing
                    new = read_section(section, text)
                    if new is None:
                        continue
                    texts[section] = text
                    old = state.get(section)
                    new = state[section] = carry(old, new)
                    if old is not None and not head:
                        rows += [("change", at, fileset, fid, written, section, *c, None, *[None] * len(self.sections)) for c in compare(section, old, new)]
            if rows:
                yield self._batch(rows)
                rows = []
        if key is not None and not self.final:
            yield self._batch([("state", at, key[0], None, None, None, None, None, None, json.dumps(state), *[None] * len(self.sections))])

    def _batch(self, rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * (5 + len(self.sections))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], self.names)


def _open(pdf: pd.DataFrame) -> pd.DataFrame:
    """Opening states of the ranges of one fileset: the closing states before each, folded in order."""
    pdf = pdf.sort_values("at")
    state: dict = {}
    out = []
    fileset = pdf["fileset_id"].iloc[0]
    for at, text in zip(pdf["at"], pdf["state"]):
        if state:
            out.append((int(fileset), int(at), json.dumps(state)))
        if isinstance(text, str):
            closing = json.loads(text)
            state = {s: resume(state.get(s), closing.get(s)) for s in {*state, *closing}}
    return pd.DataFrame(out, columns=["fileset_id", "at", "state"])


def schema_changes(files: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(fileset_id, file_id, written, section, field, change, old_field), one row per change."""
    rows = files.select(
        "fileset_id", F.unix_micros(F.col("written_ts").cast("timestamp")).alias("written"), "file_id", *sections
    ).dropna(subset=["fileset_id", "file_id", "written"])
    texts = ", ".join(f"{s} string" for s in sections)
    schema = f"tag string, at long, {CHANGE_SCHEMA}, state string, {texts}"
    none = lambda kind: F.lit(None).cast(kind)
    ordered = in_ranges(rows, ["fileset_id", "written", "file_id"], list(sections))
    ordered = ordered.select(none("string").alias("tag"), none("long").alias("at"), "fileset_id", "file_id", "written", none("string").alias("state"), *sections)
    local = materialize(ordered.mapInArrow(_Series(sections, False), schema), "series")
    passed = local.where("tag = 'row'").select("tag", "at", "fileset_id", "file_id", "written", "state", *sections)
    # a row per range, with its first fileset: where that one's opening state belongs
    states = local.where("tag = 'state'").select("fileset_id", "at", "state")
    heads = passed.select("fileset_id", "at").distinct()
    wanted = states.unionByName(heads.join(states, ["fileset_id", "at"], "left_anti").withColumn("state", none("string")))
    opening = wanted.groupBy("fileset_id").applyInPandas(_open, "fileset_id long, at long, state string")
    opening = opening.join(heads, ["fileset_id", "at"], "left_semi").select(
        F.lit("state").alias("tag"), "at", "fileset_id", none("long").alias("file_id"), none("long").alias("written"), "state", *[none("string").alias(s) for s in sections]
    )
    resumed = (
        passed.unionByName(opening)
        .repartition("fileset_id", "at")
        .sortWithinPartitions("fileset_id", "at", F.col("tag").desc(), "written", "file_id")
        .mapInArrow(_Series(sections, True), schema)
    )
    return local.where("tag = 'change'").select(*_CHANGE).unionByName(resumed.select(*_CHANGE))


# -- one table


def _shown(v) -> str | None:
    """A value as text; fractions and lists in JSON's notation."""
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, separators=(",", ":"))


def _kind(v) -> str:
    """The type a column needs to hold the value without loss."""
    kind = type_of(v)
    if kind == "integer" and abs(v) >= 1 << 53:
        return "long" if -(1 << 63) <= v < 1 << 63 else "string"
    return "string" if kind in ("list", "object") else kind


def column_type(kinds: set[str]) -> str:
    """The narrowest type that holds values of all these kinds without loss."""
    if kinds and kinds <= {"integer", "long"}:
        return "bigint"
    if kinds and kinds <= {"integer", "fraction"}:
        return "double"
    return "boolean" if kinds == {"boolean"} else "string"


class _Projection:
    """Reads the sections of each file, fields under their lasting names.

    ``renames`` of the file's fileset are (written, file_id, section, old, new)
    in order; those after the file apply to it, one after another.  A field
    keeps its own name where the file holds another field of, or renamed to, the
    new one: no two fields of a file share a column.
    """

    def __init__(self, sections: tuple[str, ...]):
        self.sections = sections

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict = {}
        for b in batches:
            out: list = [[] for _ in self.sections for _ in range(2)]
            for fileset, fid, written, renames, *texts in zip(*[c.to_pylist() for c in b.columns[_IDS:]]):
                if fid is None or written is None:
                    renames = None
                for i, (section, text) in enumerate(zip(self.sections, texts)):
                    values, kinds = self._read(section, text)
                    if values and renames and section != "perfcounter_name":
                        names = self._names(maps, fileset, section, renames, written, fid, values)
                        values, kinds = ({names[k]: v for k, v in x.items()} for x in (values, kinds))
                    out[2 * i].append(None if values is None else list(values.items()))
                    out[2 * i + 1].append(None if values is None else list(kinds.items()))
            cols = []
            for i, section in enumerate(self.sections):
                text = pa.list_(pa.string()) if section == "fmtdefs" else pa.string()
                cols += [pa.array(out[2 * i], pa.map_(pa.string(), text)), pa.array(out[2 * i + 1], pa.map_(pa.string(), pa.string()))]
            names = [*b.schema.names[:_IDS], *[n for s in self.sections for n in (f"_{s}", f"_k_{s}")]]
            yield pa.RecordBatch.from_arrays([*b.columns[:_IDS], *cols], names)

    def _read(self, section: str, text) -> tuple[dict | None, dict | None]:
        value = parse(section, text)
        if value is None:
            return None, None
        if section == "fmtdefs":
            fields = {k: [e.get(k) for e in value] for k in dict.fromkeys(k for e in value for k in e)}
            kinds = {k: ",".join(sorted({_kind(v) for v in column if v is not None})) for k, column in fields.items()}
            return {k: [_shown(v) for v in column] for k, column in fields.items()}, kinds
        if section == "perfcounter_name":
            return {k: None if v is None else str(v).strip() for k, v in value.items()}, {k: "string" for k in value}
        return {k: _shown(v) for k, v in value.items()}, {k: "" if v is None else _kind(v) for k, v in value.items()}

    def _names(self, maps: dict, fileset, section: str, renames: list, written, fid, own: dict) -> dict:
        at = bisect_right([(r["written"], r["file_id"]) for r in renames], (written, fid))
        key = (fileset, section, at)
        if key not in maps:
            if len(maps) > 10_000:
                maps.clear()
            lasting: dict[str, str] = {}
            for r in reversed(renames[at:]):
                if r["section"] == section:
                    lasting[r["old_field"]] = lasting.get(r["field"], r["field"])
                    lasting.pop(r["field"], None)  # before this rename that name was another field's, or nobody's
            maps[key] = lasting
        lasting = maps[key]
        wanted = {k: lasting.get(k, k) for k in own}
        taken: dict[str, int] = {}
        for n in wanted.values():
            taken[n] = taken.get(n, 0) + 1
        return {k: n if n == k or (taken[n] == 1 and n not in own) else k for k, n in wanted.items()}


_ID_COLUMNS = ("file_id", "fileset_id", "file_name", "written_ts")
_IDS = len(_ID_COLUMNS)


def _read_files(files: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """(file_id, fileset_id, file_name, written_ts, then per section the map of its values and of their kinds)."""
    changes = schema_changes(files, sections)
    # an array per fileset: as long as the fileset has renames, however many files it has
    step = F.struct("written", "file_id", "section", "old_field", "field")
    renames = changes.where((F.col("change") == "renamed") & (F.col("section") != "perfcounter_name"))
    renames = renames.groupBy(F.col("fileset_id").alias("_f")).agg(F.sort_array(F.collect_list(step)).alias("_renames"))
    whole = F.struct(*_ID_COLUMNS[1:], *sections)
    once = files.groupBy("file_id").agg(F.min(whole).alias("_r")).select("file_id", "_r.*")
    written = F.unix_micros(F.col("written_ts").cast("timestamp"))
    joined = once.join(renames, F.col("fileset_id") == F.col("_f"), "left").select(
        *_ID_COLUMNS, F.col("fileset_id").alias("_fs"), F.col("file_id").alias("_id"), written.alias("_w"), "_renames", *sections
    )
    schema = [f"{c} {once.schema[c].dataType.simpleString()}" for c in _ID_COLUMNS]
    for s in sections:
        schema += [f"_{s} map<string,{'array<string>' if s == 'fmtdefs' else 'string'}>", f"_k_{s} map<string,string>"]
    return materialize(joined.mapInArrow(_Projection(sections), ", ".join(schema)), "files")


def consistent_cells(files: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(file_id, section, field, value), a row per field a file holds, under its lasting name.

    Values are text, those of entry fields JSON lists of text.
    """
    read = _read_files(files, sections)
    out: DataFrame | None = None
    for s in sections:
        value = F.to_json("value") if s == "fmtdefs" else F.col("value")
        part = read.select("file_id", F.explode(f"_{s}").alias("field", "value")).select("file_id", F.lit(s).alias("section"), "field", value.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def consistent_table(files: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """One row per file, one column per field of each section, of the narrowest type that holds all its values.

    Counters come by their number as the name without blanks around, fields of
    the entries as the list of their values in the order of the entries.  A
    field that is renamed within a fileset has the column of its last name there,
    unless the same file also holds another field of that name: then both keep
    their own, so that no value is lost.  Files in which a section is not
    readable have nulls throughout it, fields a file lacks are null.  Columns are
    prefixed with the section's name; more than ``MAX_FIELDS`` are an error.
    """
    read = _read_files(files, sections)
    named = read.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.map_entries(f"_k_{s}").alias("e")) for s in sections])).alias("_f"))
    kinds = named.select("_f.s", F.explode("_f.e").alias("e")).groupBy("s", F.col("e.key").alias("n"))
    found = kinds.agg(F.collect_set("e.value").alias("kinds")).limit(MAX_FIELDS + 1).collect()
    if len(found) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields in {', '.join(sections)}: too many for columns, see consistent_cells")
    columns = []
    for s in sections:
        for r in sorted((r for r in found if r.s == s), key=lambda r: (r.n.isdecimal() and len(r.n), r.n)):
            kind = column_type({k for joined in r.kinds for k in joined.split(",") if k})
            value = F.try_element_at(f"_{s}", F.lit(r.n))
            columns.append(value.cast(f"array<{kind}>" if s == "fmtdefs" else kind).alias(f"{s}_{r.n}"))
    return read.select(*_ID_COLUMNS, *columns)
