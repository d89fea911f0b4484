from random import Random

from hypothesis import given, settings
from hypothesis import strategies as st
from tallyforge.llm.mixing import WINDOW, fit, mix, shares


def test_small_budgets_are_met_as_nearly_as_any_choice_can():
    rng = Random(1)
    for _ in range(200):
        lengths = rng.sample(range(1, 60), rng.randint(1, 8))
        counts = [rng.randint(1, 6) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randint(0, total)
        take = fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        reach = {0}
        for a, c in zip(lengths, counts):
            reach = {r + a * i for r in reach for i in range(c + 1) if r + a * i <= budget}
        assert sum(a * b for a, b in zip(lengths, take)) == max(reach)


def best(lengths, counts, budget):
    reach = {0}
    for a, c in zip(lengths, counts):
        reach = {r + a * i for r in reach for i in range(c + 1) if r + a * i <= budget}
    return max(reach)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100_000), st.integers(1, 3)), min_size=1, max_size=7, unique_by=lambda x: x[0]), st.floats(0, 1.1))
def test_long_items_are_fitted_as_nearly_as_any_choice_can(items, share):
    lengths, counts = [a for a, _ in items], [c for _, c in items]
    budget = int(share * sum(a * c for a, c in items))
    take = fit(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts)) and sum(a * b for a, b in zip(lengths, take)) == best(lengths, counts, budget)


def test_budgets_that_long_items_reach():
    for lengths, counts, budget in (([30_000, 40_000, 50_000], [2, 2, 1], 110_000), ([25_000, 30_001, 7], [9, 9, 9], 100_000 + 7), ([25_000, 30_001, 7], [4, 1, 1], 100_000)):
        assert sum(a * b for a, b in zip(lengths, fit(lengths, counts, budget))) == budget


def test_large_budgets():
    rng = Random(2)
    lengths = list(range(20, 3000))
    counts = [rng.randint(1, 50) for _ in lengths]
    for budget in (20_001, 4_000_001, 77_777_777):
        assert sum(a * b for a, b in zip(lengths, fit(lengths, counts, budget))) == budget
    assert fit([50_000], [10], 120_000) == [2] and fit([], [], 5) == [] and fit([3], [2], 99) == [2]
    lengths = [rng.randint(1, 100_000) for _ in range(300)]
    counts = [rng.randint(1, 10_000) for _ in lengths]
    budget = 7 * WINDOW + 12_345
    assert sum(a * b for a, b in zip(lengths, fit(lengths, counts, budget))) == budget
    assert sum(a * b for a, b in zip([60, 90], fit([60, 90], [10**7, 10**7], 10**9 + 29))) == (10**9 + 29) // 30 * 30  # by their common divisor


def test_shares_caps_and_seed(spark):
    rng = Random(3)
    rows = [(i, s, rng.choice([7, 7, 7, rng.randint(1, 900)]), "x") for i, s in enumerate(["a"] * 3000 + ["b"] * 900 + ["c"] * 60 + ["d"] * 50)]
    rows += [(9001, None, 50, "x"), (9002, "a", 0, "x"), (9003, "zz", 50, "x")]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int, uses string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("gone", 0.0, 3)], "source string, target_share double, max_repeats int")
    got = mix(sizes, targets, 5)
    used = got.collect()
    assert len({r.doc_id for r in used}) == len(used) and not {9001, 9002, 9003} & {r.doc_id for r in used} and not any(r.source == "d" for r in used)
    assert all(1 <= r.uses <= {"a": 1, "b": 2, "c": 4}[r.source] for r in used)
    s = {r.source: r for r in shares(got, sizes, targets).collect()}
    assert set(s) == {"a", "b", "c"} and all(abs(r.actual_share - r.target_share) < 1e-3 and r.budget - r.tokens_used <= 5 for r in s.values())
    assert sorted(used) == sorted(mix(sizes.repartition(7), targets, 5).collect()) and sorted(used) != sorted(mix(sizes, targets, 6).collect())


def test_hot_length_is_ranked_in_ranges(spark):
    sizes = spark.range(60_000).selectExpr("id AS doc_id", "if(id < 50000, 'a', 'b') AS source", "cast(10 as int) AS n_tokens")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mix(sizes, targets)
    assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == {"a": 10_000, "b": 10_000}


def test_empty(spark):
    sizes = spark.createDataFrame([], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix(sizes, targets).count() == 0
    assert [(r.source, r.tokens_used, r.actual_share) for r in shares(mix(sizes, targets), sizes, targets).collect()] == [("a", 0, 0.0)]
