"""The pipeline and causal reasoning on small examples."""

import math

from tallyforge.operators import answering as A
from tallyforge.operators import causal_reasoning as K
from tallyforge.operators import evidence as V

SCHEMA = "row_id long, question string, table_cells array<array<string>>, pre_text array<string>, post_text array<string>, answer string, loaded string"
TABLE = [["", "2019", "2020"], ["revenue", "100", "120"], ["net income", "10", "15"]]
ROWS = [
    (1, "what was the percentage change in revenue from 2019 to 2020?", TABLE, ["Revenue rose in 2020 because demand was strong."], ["Costs fell in 2019."], "20", "x"),
    (2, "why did revenue increase in 2020?", TABLE, ["Higher demand led to revenue growth in 2020.", "Revenue growth resulted in higher margin."], None, "demand", "x"),
    (3, "what was the difference?", None, None, None, None, "x"),
    (4, "", TABLE, ["Nothing."], None, "1", "x"),
    (5, None, TABLE, None, None, None, "x"),
]


def test_every_question_goes_through_the_pipeline(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.row_id: r for r in A.answered(df).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].method == "induced_program" and got[1].predicted == "20" and got[1].matched and got[1].termination == "threshold_met_initial" and got[1].iterations == 1
    assert got[3].predicted == "" and 2 <= got[3].iterations <= 4 and got[3].termination in ("plateau", "max_iterations")
    assert "causal" in got[2].modules and abs(sum(got[1].attention) - 1) < 1e-4 and got[1].backward.reconstructed
    assert A.answered(df.limit(0)).count() == 0


def test_a_model_refines_and_answers(spark):
    df = spark.createDataFrame([(1, "how many depots were there?", [["", "a"], ["x", "y"]], ["There were depots."], None, "7", "x")], SCHEMA)

    def generate(prompts):
        return ["```python\nadd(3, 4)\n```" if "program" in p else "The answer is 9." for p in prompts]

    got = A.answered(df, generate).collect()[0]
    assert got.method == "program_of_thought" and got.predicted == "7" and got.matched


def test_vote_prefers_plausible_members_of_the_largest_cluster(spark):
    tries = [(1, 0, 5.0, "5", True), (1, 1, 100.0, "100", False), (1, 2, 100.4, "100.4", True), (2, 0, None, "yes", True), (2, 1, None, "no", True), (2, 2, None, "no", False)]
    df = spark.createDataFrame(tries, "row_id long, at int, result_num double, value string, plausible boolean")
    assert {r.row_id: r.refined for r in A.voted(df).collect()} == {1: "100.4", 2: "no"}


def test_loop_ends_at_threshold_plateau_and_most(spark):
    base = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.5), (4, 0.1)], "k int, confidence double")

    def again(rows, i):
        from pyspark.sql import functions as F

        gain = F.expr(f"case k when 2 then 0.3 when 3 then if({i} = 1, 0.05, 0.0) else 0.05 end")
        return rows.withColumn("confidence", F.col("previous") + gain)

    got = {r.k: (r.termination, r.iterations) for r in V.rounds(base, again).collect()}
    assert got == {1: ("threshold_met_initial", 1), 2: ("threshold_met", 2), 3: ("plateau", 3), 4: ("max_iterations", 4)}


def test_graph_chains(spark):
    rels = [("d", "A", "b", 0.5), ("d", "b", "c", 0.8), ("d", "c", "a", 0.5), ("d", "c", "e", 0.25), ("e", "x", "y", 1.0)]
    df = spark.createDataFrame(rels, "doc string, cause string, effect string, confidence double")
    got = {(r.path, r.length): r.confidence for r in K.graph_chains(df, ["doc"]).collect()}
    assert got[("a > b > c > e", 3)] == round(0.5 * 0.8 * 0.92 * 0.25 * 0.92**2, 6) and got[("x > y", 1)] == 1.0
    assert ("a > b", 1) not in got and all(len(set(p.split(" > "))) == n + 1 for p, n in got)


def test_series_of_tables_paths_and_questions(spark):
    years = [str(y) for y in range(2010, 2020)]
    table = [["", *years], ["revenue", *[str(100 + i * i) for i in range(10)]], ["capex", *[str(10 + math.sin(i) * 5) for i in range(10)]]]
    df = spark.createDataFrame([(1, "why did net_income?", table, None, None, None, "x"), (2, "why did revenue instead of costs change?", TABLE, None, None, None, "x")], SCHEMA)
    rels = spark.createDataFrame([(1, "capex rise", "Revenue growth", 0.5), (1, "unknown", "revenue", 0.5), (1, "", "revenue", 0.5)], "row_id long, cause string, effect string, confidence double")
    got = K.granger_from_tables(rels, df.select("row_id", "table_cells"), ["row_id"]).collect()
    assert [(r.cause, r.n) for r in got] == [("capex rise", 10)]
    paths = K.ranked_paths(df, rels).collect()
    assert paths and all(r.path.endswith("net_income") for r in paths) and [r.support for r in paths] == sorted((r.support for r in paths), reverse=True)
    asked = spark.sql("select 'what if revenue increased by 20%?' as q, map('revenue', 100D, 'capex', 5D) as o union all select 'what would remain without the revenue?', map('revenue', 100D, 'capex', 5D) union all select 'why did capex instead of debt?', map('revenue', 100D) union all select 'how much?', map('revenue', 100D)")
    got = [r.x for r in asked.selectExpr(f"{K.asked_counterfactual('q', 'o')} AS x").collect()]
    assert [(x and (x.kind, x.var, x.val)) for x in got] == [("interventional", "revenue", 120.0), ("retrospective", "revenue", 0.0), ("contrastive", "capex", None), None]


def test_batch_of_measures(spark):
    df = spark.createDataFrame(ROWS[:3], SCHEMA)
    s = spark.createDataFrame([(1, 0, 0, "Revenue rose in 2020 because demand was strong."), (2, 0, 0, "Higher demand led to revenue growth in 2020."), (2, 1, 0, "Revenue growth resulted in higher margin.")], "row_id long, para int, pos int, sentence string")
    reason = K.reasoned(df, s)
    rows = {r.row_id: r for r in reason.collect()}
    assert rows[2].n_chains >= 1 and rows[2].overlap >= 1 and rows[3].num_edges == 0 and rows[2].is_causal
    means = {r.measure: r["mean"] for r in K.batch(K.measured(reason)).collect()}
    assert means["detection_rate"] == 1.0 and len(means) >= 28
