"""Minimum-cost edit scripts between nested schemas.

A schema is an unordered tree of fields.  A field is known by its key under
its parent (mostly its name); a field whose key stays is the same field.  Of
the subtrees whose key vanishes or appears, ``edit_script`` finds the matching
of least total cost: a rename costs 1, a move to another parent 1, both
together 2, a retype 1, an add or delete of a subtree its number of fields.
Only subtrees of equal type, content and shape can be matched.  That is an
assignment problem, solved exactly (shortest augmenting paths); of several
scripts of least cost, the one whose matched names are most alike is taken.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from difflib import SequenceMatcher


@dataclass
class Node:
    """A field: its name, its type, a content fingerprint, and its children by key."""

    name: str
    type: str | None = None
    content: object = None
    children: dict[str, "Node"] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())


@dataclass(frozen=True)
class Edit:
    change: str  # added | removed | renamed | retyped | moved
    path: tuple[str, ...]  # of the new field; of the old one for removed
    old: tuple[str, ...] | None = None
    cost: int = 1


@dataclass(frozen=True)
class _Subtree:
    """A subtree that vanished or appeared: its parent's keys, its path of names."""

    parent: tuple[str, ...]
    path: tuple[str, ...]
    node: Node


def shape(n: Node) -> tuple:
    """What is equal for subtrees that may be one another under another name; values 1, 1.0 and True differ."""
    return (n.type, type(n.content).__name__, n.content, tuple(sorted((c.name, shape(c)) for c in n.children.values())))


def can_match(n: Node) -> bool:
    """Whether enough is known of a subtree to find it again."""
    return n.type is not None and (n.content is not None or bool(n.children))


def match_cost(a: _Subtree, b: _Subtree) -> int:
    """Cost of taking ``a`` for ``b``, both of equal shape."""
    return int(a.parent != b.parent) + int(a.path[-1] != b.path[-1])


def edit_script(old: Node, new: Node, moves: bool = True) -> list[Edit]:
    """The cheapest script that turns ``old``'s fields into ``new``'s."""
    gone: list[_Subtree] = []
    come: list[_Subtree] = []
    script = _walk(old, new, (), (), gone, come)
    matched_a, matched_b = set(), set()
    for i, j in _matching(gone, come, moves):
        a, b = gone[i], come[j]
        matched_a.add(i)
        matched_b.add(j)
        if a.parent != b.parent:
            script.append(Edit("moved", b.path, a.path, match_cost(a, b)))
        else:
            script.append(Edit("renamed", b.path, a.path))
    script += [Edit("removed", a.path, cost=a.node.size()) for i, a in enumerate(gone) if i not in matched_a]
    script += [Edit("added", b.path, cost=b.node.size()) for j, b in enumerate(come) if j not in matched_b]
    return script


def _walk(old: Node, new: Node, keys: tuple, names: tuple, gone: list, come: list) -> list[Edit]:
    script: list[Edit] = []
    gone += [_Subtree(keys, (*names, old.children[k].name), old.children[k]) for k in sorted(old.children.keys() - new.children.keys())]
    come += [_Subtree(keys, (*names, new.children[k].name), new.children[k]) for k in sorted(new.children.keys() - old.children.keys())]
    for key in sorted(old.children.keys() & new.children.keys()):
        a, b = old.children[key], new.children[key]
        if a.name != b.name:
            script.append(Edit("renamed", (*names, b.name), (*names, a.name)))
        if a.type is not None and b.type is not None and a.type != b.type:
            script.append(Edit("retyped", (*names, b.name)))
        if a.children or b.children:
            script += _walk(a, b, (*keys, key), (*names, b.name), gone, come)
    return script


def _matching(gone: list[_Subtree], come: list[_Subtree], moves: bool) -> list[tuple[int, int]]:
    """Pairs of places in ``gone`` and ``come``; subtrees of different shape cannot match, so each shape is solved by itself."""
    by: dict[tuple, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for side, trees in enumerate((gone, come)):
        for i, t in enumerate(trees):
            if can_match(t.node):
                by[shape(t.node)][side].append(i)
    out = []
    for left, right in by.values():
        if not left or not right:
            continue
        worth = []  # what a match saves against deleting and adding, then likeness of the names
        for i in left:
            row = []
            for j in right:
                a, b = gone[i], come[j]
                saved = 2 * a.node.size() - match_cost(a, b) if moves or a.parent == b.parent else 0
                alike = 1.0 if len(left) == len(right) == 1 else SequenceMatcher(None, a.path[-1], b.path[-1]).ratio()
                row.append(saved * 1_000_000 + round(alike * 1000) if saved > 0 else 0)
            worth.append(row)
        out += [(left[i], right[j]) for i, j in best_assignment(worth) if worth[i][j] > 0]
    return out


def best_assignment(worth: list[list[int]]) -> list[tuple[int, int]]:
    """The one-to-one pairs (row, column) of greatest total worth; worths are not negative."""
    n, m = len(worth), len(worth[0])
    if n > m:
        return [(i, j) for j, i in best_assignment([list(c) for c in zip(*worth)])]
    price_r, price_c, owner = [0] * n, [0] * m, [-1] * m
    for row in range(n):
        # cheapest path from ``row`` over assigned columns to a free one, in reduced costs
        dist, came, done = [None] * m, [-1] * m, [False] * m
        at, base = row, 0
        while True:
            best = -1
            for j in range(m):
                if not done[j]:
                    d = base - worth[at][j] - price_r[at] - price_c[j]
                    if dist[j] is None or d < dist[j]:
                        dist[j], came[j] = d, at
                    if best < 0 or dist[j] < dist[best]:
                        best = j
            done[best], base = True, dist[best]
            if owner[best] < 0:
                break
            at = owner[best]
        price_r[row] += base
        for j in range(m):
            if done[j] and j != best:
                price_r[owner[j]] += base - dist[j]
                price_c[j] -= base - dist[j]
        j = best
        while True:  # shift the owners along the path
            i = came[j]
            previous = next((c for c in range(m) if owner[c] == i), -1)
            owner[j] = i
            if i == row:
                break
            j = previous
    return sorted((i, j) for j, i in enumerate(owner) if i >= 0)


def cost(script: list[Edit]) -> int:
    return sum(e.cost for e in script)
