import math

import pytest

from tilewright.llm import mixing


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copies string")


@pytest.fixture(scope="module")
def sized(spark):
    rows = [(i, ["a", " A", "a\t"][i % 3], 10 + i % 7, None) for i in range(3000)]
    rows += [(5000 + i, "B ", 20, None) for i in range(100)] + [(6000 + i, "c", 5, None) for i in range(10)]
    rows += [(7000, None, 50, None), (7001, "other", 500, None), (7002, "b", None, None), (7003, "b", 0, None), (7003, "b", 0, None)]
    return table(spark, rows)


@pytest.fixture(scope="module")
def targets(spark):
    rows = [("a", 0.5, 1), ("B", 0.3, 4), ("c", 0.15, 3), ("gone", 0.05, 9), (None, 0.0, None)]
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_plan(sized, targets):
    plan = {r.source: r for r in mixing.source_plan(sized, targets).collect()}
    total = sum((r.n_tokens or 0) for r in sized.collect())
    assert plan["a"].total == total and not plan["a"].short
    assert plan["c"].short and plan["c"].copies == 3.0
    assert plan["gone"].short and plan["gone"].size == 0 and plan["gone"].copies == 0.0
    assert plan["B"].n_docs == 103 and plan["B"].size == 2000


@pytest.mark.parametrize("seed", [0, 1])
def test_mix_meets_its_expectations(sized, targets, seed):
    plan = {mixing_key: r for r in mixing.source_plan(sized, targets).collect() for mixing_key in [str(r.source).strip().lower()]}
    got = mixing.mix(sized, targets, seed=seed).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r.copies)
    for source, copies in by.items():
        p = plan[source]
        assert abs(sum(copies) - p.copies * p.n_docs) <= 1
        assert max(copies) <= min(math.ceil(p.copies), p.max_repeats)
    assert set(by) == {"a", "b", "c"}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(sized, targets, seed=seed).collect()))


def test_shares(sized, targets):
    plan = mixing.source_plan(sized, targets)
    shares = {r.source: r for r in mixing.actual_shares(mixing.mix(sized, targets), plan).collect()}
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert shares["gone"].tokens == 0 and len(shares) == 5


def test_empty(spark, targets):
    none = table(spark, [])
    assert mixing.mix(none, targets).count() == 0
    assert {r.copies for r in mixing.source_plan(none, targets).collect()} == {0.0}
    assert mixing.actual_shares(mixing.mix(none, targets), mixing.source_plan(none, targets)).where("actual_share is not null").count() == 0
