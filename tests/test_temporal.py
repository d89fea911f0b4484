"""Propagation of temporal constraints on small networks with known results."""

from tallyforge.operators import temporal as M

INF = float("inf")


def edges(spark, pairs, doc="d"):
    return spark.createDataFrame([(doc, a, b) for a, b in pairs], "doc string, src string, tgt string")


def chain(n):
    return [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(n)]


def test_closure_of_a_long_chain_a_diamond_and_a_cycle(spark):
    got = {(r.src, r.tgt) for r in M.closure(edges(spark, chain(70)), ["doc"]).collect()}
    assert len(got) == 70 * 71 // 2 and ("n00", "n70") in got
    got = [(r.src, r.tgt) for r in M.closure(edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), (None, "a")]), ["doc"]).collect()]
    assert sorted(got) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("c", "d")]
    assert {(r.src, r.tgt) for r in M.closure(edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]), ["doc"]).collect()} == {(x, y) for x in "abc" for y in "abc"}
    assert M.closure(edges(spark, chain(3)).limit(0), ["doc"]).count() == 0


def test_tightening_reaches_the_ends_and_stops_at_contradictions(spark):
    b = edges(spark, chain(19)).selectExpr("*", "1D AS lo", "2D AS hi")
    far = M.tighten(b, ["doc"]).filter("src = 'n00' and tgt = 'n19'").collect()[0]
    assert (far.lo, far.hi, far.consistent) == (19.0, 38.0, True)
    wrong = spark.createDataFrame([("x", "a", "b", 5.0, 10.0), ("x", "b", "a", 5.0, 10.0), ("y", "a", "b", 5.0, 10.0), ("y", "a", "b", 7.0, INF)], "doc string, src string, tgt string, lo double, hi double")
    got = M.tighten(wrong, ["doc"]).collect()
    assert any(not r.consistent for r in got if r.doc == "x") and [(r.lo, r.hi, r.consistent) for r in got if r.doc == "y"] == [(7.0, 10.0, True)]


def test_shortest_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("a", "x"), ("x", "y")])
    asked = edges(spark, [("a", "e"), ("e", "a"), ("a", "a"), ("nowhere", "a")])
    assert {(r.src, r.tgt): r.path for r in M.shortest_paths(e, asked, ["doc"]).collect()} == {("a", "e"): ["a", "b", "d", "e"], ("a", "a"): ["a"]}


def test_conflicts_and_cycles(spark):
    rows = [("d", "a", "b", "before"), ("d", "b", "c", "meets"), ("d", "a", "c", "after"), ("e", "p", "q", "before"), ("e", "q", "p", "before"), ("e", "r", "r", "during")]
    got = {(r.doc, r.src, r.tgt, r.problem) for r in M.conflicts(spark.createDataFrame(rows, "doc string, src string, tgt string, rel string"), ["doc"]).collect()}
    assert got == {("d", x, x, "before cycle") for x in "abc"} | {("e", x, x, "before cycle") for x in "pq"} | {("e", "p", "q", "conflicting precedence"), ("e", "r", "r", "self loop")}


def test_propagation_of_five_nodes(spark):
    rows = [("d", a, b, "before", 0.9) for a, b in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"))]
    got = M.propagated(spark.createDataFrame(rows, "doc string, src string, tgt string, rel string, confidence double"), ["doc"])
    assert [r.node for r in got["order"].orderBy("place").collect()] == list("abcde") and got["problems"].count() == 0
    assert {(r.src, r.tgt) for r in got["edges"].filter("hop = 2").collect()} == {("a", "c"), ("b", "d"), ("c", "e")}
    assert got["bounds"].filter("src = 'a' and tgt = 'e'").collect()[0].lo == 0.0


def test_sequences_and_union_of_relations(spark):
    s = spark.createDataFrame([(1, "First, the group sold its rail unit, and then it bought a shipping line."), (1, "Nothing here."), (2, "The 2019 restructuring of plants came before the 2021 launch of the range."), (3, None)], "doc int, sentence string")
    got = M.sequence_relations(s, ["doc"]).collect()
    assert [(r.doc, r.right) for r in got] == [(1, "it bought a shipping line")]
    every = {(r.doc, r.rel, r.origin) for r in M.all_event_relations(s, ["doc"]).collect()}
    assert (1, "before", "sequence") in every and (2, "before", "signal") in every
