"""Subject areas of documents by class-association rules.

Fit.  Labelled documents (a sample of at most ``max_labelled``, chosen by a
hash of the id) are cut into the sentences of their numbered paragraphs: the
transactions, their classes being the areas of the document.  Items are word
n-grams and the sentence's opening (its first two words).  The first scan of
frequent-pattern growth counts items alone and with each class, by cases, so
that the versions of one ruling count once; an item that reaches neither the
least support nor, with any class, the least confidence is not grown, and
neither is an n-gram that says no more than a shorter one inside it.  Parallel
FP-growth (``llm.fpgrowth``) then mines all rules used, with their confidences:
``phrase -> area`` and ``several items -> area``, of any number of items and
counted by cases, and ``opening -> agrees``, counted by sentences, which tells
how often a sentence that opens so is about its own document's areas at all
(comparisons with other cases and remarks about the hearing are not).  All items
of a sentence take part.  Areas that several items never go with, though one of
them does, give a rule too.  A rule of several items that says about what the
most specific ones inside it do is pruned.  Confidences are smoothed.

Score.  Every paragraph of every document is matched against all rules at
once (Aho-Corasick).  A sentence goes to the area with the most evidence,
the sum of the log odds of its most specific rules; its certainty is the
confidence of the best of them times the reliability of the opening.  A
paragraph states facts of an area when a sentence of it reaches ``theta``,
and a document has the areas that ``min_paragraphs`` paragraphs state.

Defined results.  Null, empty and blank texts have no area.  Without labels
there are no rules and no areas.  Text before the first numbered paragraph
(headnotes, parties) is not looked at; a paragraph goes on over lines, whatever
ends them, up to a blank one.  A number that is not the next one begins no
paragraph in the middle of a sentence.  Text that looks like special tokens is
taken out.  Repeated labels count once, contradicting ones all count.
Documents without a case are their own case.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Set
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import materialize
from .fpgrowth import RULE_SCHEMA, class_rules

MAX_LABELLED = 20_000
NO_AREA = "none"
#: The classes of a sentence whose phrases speak, or do not, for one of its document's areas.
AGREES, DIFFERS = "#agrees", "#differs"
THETA = 0.7
MIN_PARAGRAPHS = 2
MIN_CONFIDENCE = 0.5
#: A rule must be this much more (or less) confident than a more general one.
GAIN = 0.05
PRIOR = 0.1
KNOWN_SENTENCES = 200_000

_N = r"\d{1,4}(?:\.\d{1,3}){0,4}"
#: [1]  (1)  § 1  ¶ 1  1.  1)  1.)  1:  with or without a blank after, or alone on the line; 1 with a blank; and 1.1 for 1.
_NUMBER = re.compile(
    rf"\s*(?:(?:[§¶]{{1,2}} ?{_N}\.?|\[ ?{_N} ?\]|\( ?{_N} ?\)|{_N}(?:\.\)?|[):]))(?:\s+|(?=[^\W\d_])|$)|(?P<bare>{_N})\s+(?=\S))"
)
_DIGITS = re.compile(r"\d+")
_PAGE_BREAK = re.compile("(?<=[\n\r\v\x85  ])\f+")
#: Text that looks like special tokens, inside words and numbers too.
_TOKENS = r"(?:<\|\w{1,40}\|>|</?s>|<unk>|<pad>)"
_MARKUP = re.compile(rf"{_TOKENS}(?: ?{_TOKENS})*")
_FINISHED = re.compile(r"(?:^|[.;:?!…][\"'”’»)\]]*)\s*$")
_SENTENCE = re.compile(r"(?<=[.;?!])\s+(?=\S)")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_BREAK = "\x01"
_TOKEN = re.compile(_WORD.pattern + r"|[.;?!](?=\s|\x01|$)|\x01")
_END = re.compile(r"[.;?!\x01](?= )")
_INVISIBLE = re.compile("[­​-‏⁠︎️﻿]")


def _begins(m: re.Match, number: tuple[int, ...], last: tuple[int, ...] | None, before: str | None) -> bool:
    """Whether a line with a number at its head begins a paragraph.  The number after ``last`` does; another one
    does not where the line goes on an unfinished sentence (``before``): "... in" / "1998 the loan ..."."""
    if last is None:
        return len(number) == 1 or number[-1] == 1
    k = len(number) - 1
    if number == (*last, 1) or (k < len(last) and number == (*last[:k], last[k] + 1)):
        return True
    if m.end() == len(m.string) or (k and m["bare"]):  # a page number; a decimal fraction
        return False
    return before is None or bool(_FINISHED.search(before))


def paragraphs(text: str | None) -> Iterator[str]:
    """The numbered paragraphs of a text, without their numbers, in lower case."""
    if not text or text.isspace():
        return
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = _MARKUP.sub("", text)
    if "\f" in text:
        text = _PAGE_BREAK.sub("", text)
    current: list[str] | None = None
    last: tuple[int, ...] | None = None
    for line in text.lower().splitlines():
        m = _NUMBER.match(line)
        number = tuple(map(int, _DIGITS.findall(m[0]))) if m else ()
        if m and _begins(m, number, last, current and current[-1]):
            if current is not None:
                yield " ".join(current)
            current, last = [line[m.end() :]], number
        elif current is not None:
            if line.strip():
                current.append(line)
            elif any(current):  # else the number stands alone above its text
                yield " ".join(current)
                current = None
    if current is not None:
        yield " ".join(current)


def sentences(paragraph: str) -> Iterator[list[str]]:
    """The words of each sentence of at least three words."""
    for s in _SENTENCE.split(paragraph):
        words = _WORD.findall(s)
        if len(words) >= 3:
            yield words


def ngrams(words: list[str]) -> set[str]:
    return set(words) | {" ".join(w) for n in (2, 3) for w in zip(*[words[i:] for i in range(n)])}


@dataclass
class Rules:
    """What scoring needs: rules by their phrases, and openings by reliability."""

    single: dict[str, dict[str, float]] = field(default_factory=dict)  # phrase -> area -> confidence
    joint: dict[tuple[str, ...], dict[str, float]] = field(default_factory=dict)  # sorted items -> ...
    openings: dict[str, float] = field(default_factory=dict)
    base: float = 1.0

    def __post_init__(self) -> None:
        self.by_item: dict[str, list[tuple[str, ...]]] = {}  # left sides of ``joint`` by their first item
        for left in self.joint:
            self.by_item.setdefault(left[0], []).append(left)

    def join(self, left: tuple[str, ...], area: str, confidence: float) -> None:
        if left not in self.joint:
            self.by_item.setdefault(left[0], []).append(left)
        self.joint.setdefault(left, {})[area] = confidence

    def inside(self, items: Set[str]) -> list[tuple[str, ...]]:
        """The left sides of ``joint`` that these items hold."""
        return [left for i in items for left in self.by_item.get(i, ()) if items.issuperset(left)]

    def matcher(self):
        """Aho-Corasick automaton over all phrases, each with its blanks around."""
        import ahocorasick

        phrases = set(self.single) | {i for left in self.joint for i in left if not i.startswith("o:")}
        machine = ahocorasick.Automaton()
        for p in phrases:
            machine.add_word(f" {p} ", p)
        if phrases:
            machine.make_automaton()
        return machine if phrases else None


def matches(text: str | None, machine) -> Iterator[tuple[int, str, frozenset]]:
    """(paragraph, opening, phrases found) of each sentence in which a phrase occurs.

    The paragraphs become one string of words and sentence ends, over which the
    automaton runs once; only sentences with a match are looked at one by one.
    """
    tokens = _TOKEN.findall(_BREAK.join(p.replace(_BREAK, " ") for p in paragraphs(text)))
    if not tokens:
        return
    line = f" {' '.join(tokens)} "
    hits = list(machine.iter(line))
    if not hits:
        return
    ends = [m.start() for m in _END.finditer(line)]
    ends.append(len(line))
    paragraph, k, start, at, n = 0, 0, 0, 0, len(hits)
    while k < n:
        end = ends[at]
        if hits[k][0] <= end:
            found = set()
            while k < n and hits[k][0] <= end:
                found.add(hits[k][1])
                k += 1
            words = line[start + 1 : end].split(" ", 3)
            if len(words) > 3 or (len(words) == 3 and words[2]):
                yield paragraph, f"{words[0]} {words[1]}", frozenset(found)
        if end < len(line) and line[end] == _BREAK:
            paragraph += 1
        start, at = end + 1, at + 1


def judge(first: str, found: frozenset, rules: Rules) -> tuple[str, float] | None:
    """(area, certainty) of a sentence with this opening and these phrases."""
    evidence: dict[str, float] = defaultdict(float)
    best: dict[str, float] = {}
    special: dict[tuple[str, str], tuple[int, float]] = {}  # (phrase, area) -> minus length and confidence of its most specific rule
    if rules.joint:
        for left in rules.inside(found | {"o:" + first}):
            for area, c in rules.joint[left].items():
                for p in left:
                    special[p, area] = min((-len(left), c), special.get((p, area), (0, 1.0)))
    for p in found:
        for area, c in rules.single.get(p, {}).items():
            c = special.get((p, area), (0, c))[1]
            evidence[area] += math.log(c / (1 - c)) * (1 + p.count(" "))
            best[area] = max(best.get(area, 0.0), c)
    if not evidence:
        return None
    area = max(sorted(evidence), key=evidence.__getitem__)
    return area, best[area] * min(1.0, rules.openings.get(first, rules.base) / rules.base)


def areas(
    text: str | None, rules: Rules, machine, theta: float = THETA, least: int = MIN_PARAGRAPHS, known: dict | None = None
) -> list[str]:
    """The areas of one whole text, sorted.  ``known`` keeps verdicts on sentences alike."""
    known = {} if known is None else known
    stated = set()
    for paragraph, first, found in matches(text, machine):
        key = (first, found)
        verdict = known.get(key, 0)
        if verdict == 0:
            if len(known) >= KNOWN_SENTENCES:
                known.clear()
            verdict = known[key] = judge(first, found, rules)
        if verdict and verdict[1] >= theta:
            stated.add((verdict[0], paragraph))
    count = Counter(a for a, _ in stated)
    return sorted(a for a, n in count.items() if n >= least)


# -- fitting


def _smooth(hits: int, n: int) -> float:
    return (hits + PRIOR) / (n + 1)


def _labelled(documents: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(case_id, text, areas) of the sample; the sample's ids are at most
    ``max_labelled`` rows and are what is sent to all executors."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isNotNull())
    known = known.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.trim("subject"))).alias("areas"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("_id"), "areas")
    case = F.coalesce(F.col("docket"), F.concat(F.lit("#"), F.col("doc_id").cast("string")))
    return (
        documents.select("doc_id", case.alias("case_id"), "text")
        .join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
        .select("case_id", "text", "areas")
        .repartition("case_id")
        .sortWithinPartitions("case_id")
    )


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, area, n): in how many cases of this partition each n-gram occurs, with
    an empty area for all cases.  A case lies in one partition, in one stretch."""
    totals: Counter = Counter()
    case, seen, n_cases = None, set(), 0
    for b in batches:
        for c, text, found in zip(*[x.to_pylist() for x in b.columns]):
            if c != case:
                totals.update(seen)
                case, seen, n_cases = c, set(), n_cases + 1
            grams = set()
            for p in paragraphs(text):
                for words in sentences(p):
                    grams |= ngrams(words)
            for g in grams:
                seen.add((g, ""))
                seen.update((g, a) for a in found)
    totals.update(seen)
    totals["", ""] = n_cases
    once = [(g, a, n) for (g, a), n in totals.items()]
    for k in range(0, len(once), 50_000):
        part = once[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["gram", "area", "n"])


def _grown(counts: DataFrame, least: int) -> DataFrame:
    """(gram, area, confidence) of the items to grow: of n-grams, those more confident than any shorter one inside them."""
    whole = counts.where((F.col("area") == "") & (F.col("gram") != "") & (F.col("n") >= least)).select("gram", F.col("n").alias("total"))
    confidence = (F.col("n") + PRIOR) / (F.col("total") + 1)
    rows = counts.where((F.col("area") != "") & (F.col("area") != NO_AREA)).join(whole, "gram").select("gram", "area", confidence.alias("confidence"))
    rows = materialize(rows.where(F.col("confidence") >= MIN_CONFIDENCE), "items")
    w = lambda k: F.get(F.col("_w"), F.lit(k))
    pair = lambda k: F.concat_ws(" ", w(k), w(k + 1))
    inside = F.when(F.size("_w") == 2, F.array(w(0), w(1))).when(F.size("_w") == 3, F.array(w(0), w(1), w(2), pair(0), pair(1)))
    parts = rows.withColumn("_w", F.split("gram", " ")).select("gram", "area", F.explode(inside).alias("_part"))
    shorter = rows.select(F.col("gram").alias("_part"), "area", F.col("confidence").alias("_c"))
    best = parts.join(shorter, ["_part", "area"]).groupBy("gram", "area").agg(F.max("_c").alias("_c"))
    kept = rows.join(best, ["gram", "area"], "left").where(F.col("_c").isNull() | (F.col("confidence") > F.col("_c") + GAIN / 2))
    return kept.select("gram", "area", "confidence")


def _transactions(batches: Iterator[pa.RecordBatch], items: dict[str, dict[str, float]]) -> Iterator[pa.RecordBatch]:
    """(case_id, items, classes) of each sentence that holds items: these and its
    opening, its document's areas and whether it agrees with them."""
    rules = Rules(single=items)
    machine = rules.matcher()
    for b in batches:
        cases, baskets, classes = [], [], []
        for case, text, found in zip(*[x.to_pylist() for x in b.columns]):
            for _, first, held in matches(text, machine):
                verdict = judge(first, held, rules)
                if verdict is None:
                    continue
                cases.append(case)
                baskets.append([*sorted(held), "o:" + first])
                classes.append([*found, AGREES if verdict[0] in found else DIFFERS])
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(cases, pa.string()), pa.array(baskets, strings), pa.array(classes, strings)], ["case_id", "items", "classes"])


def _surprise(items: dict[str, dict[str, float]], times: float) -> Callable[[tuple[str, ...], str, int, int], bool]:
    """Whether a rule of several items differs from what its single items say by more than chance; single ones are all passed on."""

    def keep(left: tuple[str, ...], area: str, freq: int, total: int) -> bool:
        if len(left) == 1:
            return area in (AGREES, DIFFERS) or area in items.get(left[0], {})
        if area == NO_AREA:
            return False
        general = [items[p][area] for p in left if area in items.get(p, {})]
        if not general:
            return False
        g = max(general)
        return total * abs(_smooth(freq, total) - g) > times * math.sqrt(total * g * (1 - min(g, 0.98)))

    return keep


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Rules:
    """Mine the rules from ``labels`` (doc_id, subject) and the documents they name."""
    sample = materialize(_labelled(documents, labels, max_labelled), "labelled")
    sample = sample.repartition("case_id").sortWithinPartitions("case_id")
    counts = sample.mapInArrow(_count_ngrams, "gram string, area string, n long").groupBy("gram", "area").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    n_cases = counts.where(F.col("gram") == "").agg(F.sum("n")).first()[0] or 0
    least = max(2, n_cases // 2000)
    items: dict[str, dict[str, float]] = defaultdict(dict)
    for gram, area, confidence in _grown(counts, least).collect():  # pruned; as many as the bounded sample has associated items
        items[gram][area] = confidence
    items = dict(items)
    if not items:
        return Rules()
    baskets = sample.mapInArrow(lambda it: _transactions(it, items), "case_id string, items array<string>, classes array<string>")
    baskets = materialize(baskets.distinct(), "baskets")
    # phrases are counted by cases, what a sentence's opening says by sentences
    marks = F.array(F.lit(AGREES), F.lit(DIFFERS))
    said = F.transform(F.filter("items", lambda i: i.startswith("o:")), lambda i: F.concat(F.lit("s"), i))
    transactions = baskets.select("case_id", "items", F.array_except("classes", marks).alias("classes"))
    transactions = transactions.unionByName(baskets.select(F.lit(None).cast("string").alias("case_id"), said.alias("items"), F.array_intersect("classes", marks).alias("classes")))
    # openings of the least support, in cases or in sentences, are items too
    found = transactions.select(F.coalesce("case_id", F.monotonically_increasing_id().cast("string")).alias("case"), F.explode("items").alias("i"))
    found = found.groupBy("i").agg(F.countDistinct("case").alias("n")).where(F.col("n") >= least)
    ranked = [r.i for r in found.orderBy(F.desc("n"), "i").collect()]  # the phrases known and the frequent openings
    # what no case of several items has, though they say so one by one, is a rule as well
    expected = lambda left: {area for p in left for area in items.get(p, ())}
    mined = class_rules(transactions, {i: k for k, i in enumerate(ranked)}, least, _surprise(items, 2.0), None, expected)
    mined = materialize(mined, "rules")
    rules = prune([tuple(r) for r in mined.where(F.size("left") <= 2).collect()])
    # longer rules are pruned where they lie; what is settled for one length is what the next are compared with
    size = 2
    while True:
        longer = mined.where(F.size("left") > size).mapInArrow(partial(_differing, rules=rules), RULE_SCHEMA)
        found = [tuple(r) for r in longer.collect()]  # few, being pruned
        if not found:
            return rules
        size = min(len(left) for left, *_ in found)
        first = [r for r in found if len(r[0]) == size]
        rules = prune(first, rules)


def _differs(rules: Rules, left: tuple[str, ...], area: str, conf: float, total: int) -> bool:
    """Whether a rule says other than the most specific rules inside it."""
    parts = [part for part in rules.inside(frozenset(left)) if len(part) < len(left) and area in rules.joint[part]]
    if parts:
        most = max(map(len, parts))
        general = [rules.joint[part][area] for part in parts if len(part) == most]
    else:
        general = [rules.single[p].get(area, 0.0) for p in left if p in rules.single]
        # the opening's own reliability already explains most of what such a rule says
        for p in left:
            if p.startswith("o:"):
                general = [g * min(1.0, rules.openings.get(p[2:], rules.base) / rules.base) for g in general]
    if not general or max(general) <= 0:
        return False
    g = max(general)
    chance = 3 * math.sqrt(total * g * (1 - min(g, 0.98))) + 1  # what sampling alone may give
    return abs(conf - g) > GAIN and total * abs(conf - g) > chance


def _differing(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*[c.to_pylist() for c in b.columns])
        yield b.filter(pa.array([_differs(rules, tuple(left), area, _smooth(n, total), total) for left, area, n, total in rows], pa.bool_()))


def prune(mined: list[tuple[list[str], str, int, int]], rules: Rules | None = None) -> Rules:
    """Rules without the redundant ones, and the openings' reliability; ``rules`` holds those settled before."""
    agree: dict[str, tuple[int, int]] = {}
    if rules is None:
        rules = Rules()
        for (first, *rest), then, freq, total in mined:
            if rest:
                continue
            if first.startswith("so:"):
                agree[first[3:]] = (freq if then == AGREES else total - freq, total)
            else:
                rules.single.setdefault(first, {})[then] = _smooth(freq, total)
        hits, n = (sum(v[k] for v in agree.values()) for k in (0, 1))
        rules.base = hits / n if n and hits else 1.0
        rules.openings = {o: (h + 2 * rules.base) / (t + 2) for o, (h, t) in agree.items()}
    # the shorter are judged before
    for left, area, freq, total in sorted((r for r in mined if len(r[0]) > 1), key=lambda r: (len(r[0]), r)):
        conf = _smooth(freq, total)
        if _differs(rules, tuple(left), area, conf, total):
            rules.join(tuple(left), area, min(max(conf, 0.02), 0.98))
    return rules


def subject_areas(
    documents: DataFrame, rules: Rules, theta: float = THETA, least: int = MIN_PARAGRAPHS
) -> DataFrame:
    """(doc_id, subject), a row per area of each document."""
    machine_box: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not machine_box:
            machine_box.append(rules.matcher())
        machine = machine_box[0]
        known: dict = {}
        for b in batches:
            ids, subjects = [], []
            if machine is not None:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for area in areas(text, rules, machine, theta, least, known):
                        ids.append(doc_id)
                        subjects.append(area)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(subjects, pa.string())], ["doc_id", "subject"])

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("subject", T.StringType())])
    return documents.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull()).mapInArrow(run, out)


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, n_docs, share): the corpus by area; ``none`` holds documents without one."""
    total = documents.agg(F.count(F.lit(1)).alias("total"))
    having = found.agg(F.countDistinct("doc_id").alias("having"))
    by = found.groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"))
    rest = total.join(having).select(F.lit(NO_AREA).alias("subject"), (F.col("total") - F.col("having")).alias("n_docs"))
    return by.unionByName(rest).join(F.broadcast(total)).select("subject", "n_docs", (F.col("n_docs") / F.nullif(F.col("total"), F.lit(0))).alias("share"))
