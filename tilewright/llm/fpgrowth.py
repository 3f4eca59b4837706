"""Class-association rules by parallel frequent-pattern growth.

A transaction is a set of items and the set of its classes.  Items are ranked
by support and dealt to groups; of each transaction, a group gets the part up
to its last item of that group (the group-dependent transactions of parallel
FP-growth), so groups grow their trees independently of each other.  A tree
node keeps, per class, the cases whose transactions end their way at or below
it.  An item's paths to the root are its conditional pattern base; a
conditional tree is built of the items that stay frequent in it, and grown in
turn.  Of sets of more than two items that the same transactions hold, the
shortest and the longest grown stand for those between, which say the same; so
a long sentence repeated does not give 2^n sets.  That gives the frequent sets of items together with the classes: the
rules ``items -> class`` with support and confidence, each from exactly one group.

Support is a number of cases: transactions of one case count once for a set of
items, whatever their number.  A transaction without a ``case_id`` is its own case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE_SCHEMA = "left array<string>, class string, freq long, total long"
#: Per class the cases that hold it, and all cases under None.
Cases = dict[str | None, set[int]]


class _Node:
    __slots__ = ("item", "parent", "children", "cases")

    def __init__(self, item: int, parent: "_Node | None"):
        self.item, self.parent, self.children, self.cases = item, parent, {}, {}


def _join(into: Cases, more: Cases) -> None:
    for c, cases in more.items():
        held = into.get(c)
        if held is None:
            into[c] = set(cases)
        else:
            held |= cases


class Tree:
    """A prefix tree of transactions, with the nodes of each item."""

    def __init__(self):
        self.root, self.nodes = _Node(-1, None), {}

    def add(self, items: list[int], cases: Cases) -> None:
        """Count transactions whose items come in order of rank."""
        at = self.root
        for i in items:
            child = at.children.get(i)
            if child is None:
                child = at.children[i] = _Node(i, at)
                self.nodes.setdefault(i, []).append(child)
            at = child
            _join(at.cases, cases)

    def grow(self, item: int, least: int, longest: int | None = None) -> Iterator[tuple[tuple[int, ...], Cases]]:
        """(items, cases) of the item, and of it with every set of items above it that ``least`` cases hold."""
        held: Cases = {}
        for node in self.nodes.get(item, ()):
            _join(held, node.cases)
        if len(held.get(None, ())) < least:
            return
        yield (item,), held
        if longest == 1:
            return
        base, above = [], {}
        for node in self.nodes[item]:
            path, up = [], node.parent
            while up.item >= 0:
                path.append(up.item)
                above.setdefault(up.item, set()).update(node.cases[None])
                up = up.parent
            base.append((path[::-1], node.cases))
        frequent = {i for i, cases in above.items() if len(cases) >= least}
        if not frequent:
            return
        always: set[int] = set()  # items of every transaction: with or without them a set is held by the same ones
        if longest is None:
            always = frequent.intersection(*(path for path, _ in base))
            for other in sorted(always):
                yield (other, item), held
            if len(always) > 1:
                yield (*sorted(always), item), held
        grown = frequent - always
        conditional = Tree()
        for path, cases in base:
            conditional.add([i for i in path if i in grown], cases)
        for other in sorted(grown):
            for items, cases in conditional.grow(other, least, longest and longest - 1):
                yield (*items, item), cases
                if always:
                    yield (*sorted(always), *items, item), cases


def class_rules(
    transactions: DataFrame,
    ranks: dict[str, int],
    least: int,
    keep: Callable[[tuple[str, ...], str, int, int], bool] | None = None,
    longest: int | None = 2,
    expected: Callable[[tuple[str, ...]], set[str]] | None = None,
) -> DataFrame:
    """(left, class, freq, total): rules with support of at least ``least`` and up to ``longest`` items (None: of any number).

    ``transactions``: (items, classes), arrays of strings, and maybe a
    ``case_id``.  ``ranks``: the frequent items, the most frequent being 0;
    other items are left out.  ``keep`` tells which rules are passed on, and
    ``expected`` the classes of a left side to tell of even if no case holds them.
    """
    groups = int(transactions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = sorted(ranks, key=ranks.__getitem__)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to, parts, tags, ids = [], [], [], []
            for items, classes, case in zip(*[c.to_pylist() for c in b.columns]):
                path = sorted({ranks[i] for i in items or () if i in ranks})
                last: dict[int, int] = {}
                for k, r in enumerate(path):
                    last[r % groups] = k + 1
                for g, k in last.items():
                    to.append(g)
                    parts.append(path[:k])
                    tags.append(sorted({c for c in classes or () if c is not None}))
                    ids.append(case)
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((to, parts, tags, ids), kinds)], ["g", "path", "classes", "case_id"])

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Tree] = {}
        numbers: dict[str, int] = {}
        for b in batches:
            for g, path, classes, ids in zip(*[c.to_pylist() for c in b.columns]):
                cases = {numbers.setdefault(i, len(numbers)) for i in ids}
                trees.setdefault(g, Tree()).add(path, dict.fromkeys([None, *classes], cases))
        for g, tree in trees.items():
            for item in sorted(i for i in tree.nodes if i % groups == g):
                rows = []
                for items, cases in tree.grow(item, least, longest):
                    left, total = tuple(sorted(names[i] for i in items)), len(cases[None])
                    counts = dict.fromkeys(expected(left) if expected else (), 0) | {c: len(held) for c, held in cases.items() if c is not None}
                    found = sorted(counts.items())
                    rows += [(list(left), c, n, total) for c, n in found if keep is None or keep(left, c, n, total)]
                kinds = (pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["left", "class", "freq", "total"])

    own = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
    case = F.coalesce(F.concat(F.lit("="), "case_id"), own) if "case_id" in transactions.columns else own
    dealt = transactions.select("items", "classes", case.alias("case_id"))
    dealt = dealt.mapInArrow(deal, "g int, path array<int>, classes array<string>, case_id string")
    # the cases of equal parts are put together before they are moved
    joined = dealt.groupBy("g", "path", "classes").agg(F.collect_set("case_id").alias("cases"))
    return joined.repartitionById(groups, F.col("g")).mapInArrow(mine, RULE_SCHEMA)
