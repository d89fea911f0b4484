import math

import numpy as np
from pyspark.sql import functions as F

from tallyforge.functions import expressions as X
from tallyforge.operators import evaluation, programs, scm, series, temporal
from tallyforge.operators import causal_text as C
from tallyforge.operators import table_ops as T


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in columns.values())], ", ".join(f"{k} {t}" for k, t in zip(columns, [_kind(v) for v in columns.values()]))) if columns else spark.range(1)
    return df.selectExpr(f"{expr} AS v").collect()[0].v


def _kind(v):
    return "double" if isinstance(v, float) else "array<array<string>>" if isinstance(v, list) and v and isinstance(v[0], list) else "array<string>" if isinstance(v, list) else "array<double>" if isinstance(v, tuple) else "string"


def test_numbers(spark):
    for text, want in {"$1,234": 1234.0, "(123)": -123.0, "-13 ( 13 )": -13.0, "11.4% ( 11.4 % )": 11.4, "1.2m": 1.2e6, "3 k": 3e3, "5B": 5e9, "12.5%": 12.5, "-": None, "": None, "n/a": None, "abc": None, "£ 7": 7.0, "--5": None, "5f": None}.items():
        assert one(spark, X.financial_number("t"), t=text) == want, text
    assert one(spark, X.parse_number("t"), t="12.5%") == 0.125 and one(spark, X.parse_number("t"), t="($ 5)") == -5.0
    assert one(spark, X.financial_number("cast(null as string)")) is None


def test_answers_match(spark):
    for p, g, want in [("25.0", "0.25", True), ("0.25", "25", True), ("-5", "5", True), ("1,000", "$1000", True), ("yes", "TRUE", True), ("no", "yes", False), ("", "", True), ("a", "b", False), ("0.001", "0", True), ("10", "11", False)]:
        assert one(spark, X.answers_match("p", "g"), p=p, g=g) is want, (p, g)
    assert one(spark, X.answers_match("cast(null as string)", "'x'")) is False


def test_format_answer_against_python(spark):
    def python(v):
        if v != v or math.isinf(v):
            return "0"
        if v == int(v) and abs(v) < 1e12:
            return str(int(v))
        if abs(v) < 1e-4:
            one_digit = f"{v:.1g}"
            return one_digit if abs(float(one_digit) - v) / max(abs(v), 1e-15) < 0.05 else f"{v:.2g}"
        return f"{v:.5f}".rstrip("0").rstrip(".") if abs(v) < 1 else f"{v:.5g}"

    for v in [0.123456, 12.34567, 99.99951, 12345.67, 123456.7, 1234567.5, 0.00005, 0.000012, -0.5, -17.25, 3.0, float("inf"), float("nan"), 1e13 + 0.5]:
        assert one(spark, X.format_answer("v"), v=v) == python(v), v


def test_units_years_keywords(spark):
    assert one(spark, X.header_unit("h"), h="2019 (in millions)").label == "million" and one(spark, X.header_unit("h"), h="2019").scale == 1.0
    assert one(spark, X.years("t"), t="2021 and 2019, again 2021; 1850") == [2019, 2021]
    assert one(spark, X.keywords("t"), t="What was the net sales in 2019?") == ["net", "sales"]


TABLE = [["Item", "2021", "2022", "2023"], ["Revenue", "$1,000", "$1,200", "$1,500"], ["Margin", "60%", "62%", "65%"], ["Units", "10", "(5)", "—"], ["short"]]


def test_cells_and_tables(spark):
    e = spark.createDataFrame([(1, "what was revenue in 2022?", TABLE), (2, None, None), (3, "q", []), (4, "q", [["only header"]])], "row_id long, question string, table_cells array<array<string>>")
    kinds = {(r.row_idx, r.col_idx): r.cell_type for r in T.typed_cells(e).collect()}
    assert kinds[1, 1] == "currency" and kinds[2, 1] == "percentage" and kinds[3, 1] == "numeric" and kinds[3, 3] == "empty" and kinds[1, 0] == "text"
    assert one(spark, X.cell_type("t"), t="2021") == "numeric" and one(spark, X.cell_type("t"), t="Dec 31, 2021") == "date"
    assert T.profile(e).filter("col_idx = 1").collect()[0].num_count == 3
    text = e.filter("row_id = 1").selectExpr(f"{T.linearize_structured()} AS t").collect()[0].t
    assert text.startswith('row "Revenue" : col "2021" = $1,000')
    ready = T.prepared(e.filter("row_id = 1"))
    got = ready.selectExpr(f"{T.row_values(repr('revenue'))} AS r", f"{T.column_values(repr('2022'))} AS c", f"{T.single_value()} AS s", f"{T.table_value(repr('unit'), repr('2022'))} AS u").collect()[0]
    assert got.r == [1000.0, 1200.0, 1500.0] and got.c == [1200.0, 62.0, -5.0] and got.s == 1200.0 and got.u == -5.0


def test_programs(spark):
    def run(program, table=TABLE):
        e = spark.createDataFrame([(1, "q", table, program)], "row_id long, question string, table_cells array<array<string>>, program array<string>")
        r = programs.executed(T.prepared(e)).collect()[0]
        return (r.result_str or r.result_num) if r.success else None

    assert run(["subtract(5829, 5735)", "divide(#0, 5735)", "multiply(#1, const_100)"]) == (5829 - 5735) / 5735 * 100
    assert run(["subtract(5829, 5735), divide(#0, 5735)"]) == (5829 - 5735) / 5735
    assert run(["greater(3, 2)"]) == "yes" and run(["divide(1, 0)"]) == math.inf and run(["exp(2, 3)"]) == 8.0
    assert run(["table_average(revenue, none)"]) == 3700 / 3 and run(["table_max(2022, none)"]) == 2022.0
    assert run(["add(#3, 1)"]) is None and run([]) is None and run(None) is None
    assert run(["greater(3, 2)", "add(#0, 1)"]) is None


def test_operation(spark):
    for q, want in {"what was the percentage change in x?": "pct_change", "what portion of x did y represent?": "pct_of", "was x greater than y?": "greater", "what is the total of x?": "add", "what is the difference between x and y?": "subtract", "what was x?": "unknown", "what is the average of x": "table_agg"}.items():
        assert one(spark, programs.operation("q"), q=q) == want, q


def test_majority(spark):
    assert one(spark, programs.majority("transform(v, x -> named_struct('x', x, 'n', 1L))"), v=(1.0, 2.0, 1.005, 2.0, 2.001)) == 2.0


def test_allen_table_against_intervals():
    table = temporal.composition()
    assert len(table) == 169 and table["before", "before"] == {"before"} and table["equal", "during"] == {"during"}
    for (a, b), c in table.items():
        assert {temporal.INVERSE[x] for x in c} == table[temporal.INVERSE[b], temporal.INVERSE[a]]
    assert sum(len(v) == 13 for v in table.values()) == 3


def test_allen_inference_and_bounds(spark):
    e = spark.createDataFrame([("d", "a", "b", "before", 0.9), ("d", "b", "c", "before", 0.8), ("d", "c", "e", "before", 0.5)], "d string, src string, tgt string, rel string, confidence double")
    got = {(r.src, r.tgt): (r.rel, r.confidence) for r in temporal.inferred_relations(e, ["d"]).collect()}
    assert got["a", "c"] == ("before", 0.612) and ("a", "e") in got
    b = spark.createDataFrame([("d", "a", "b", 5.0, 10.0), ("d", "b", "a", 5.0, 10.0)], "d string, src string, tgt string, lo double, hi double")
    assert temporal.tighten(b, ["d"]).filter("not consistent").count() > 0
    cyc = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "c", "a")], "d string, src string, tgt string")
    assert temporal.closure(cyc, ["d"]).count() == 9


def test_event_relations(spark):
    r = one(spark, temporal.event_relation("t"), t="After the acquisition, revenue increased sharply.")
    assert (r.left, r.right, r.rel) == ("revenue increased sharply", "acquisition", "after")
    assert one(spark, temporal.event_relation("t"), t="Costs fell just before the merger closed.").rel == "meets"
    assert one(spark, temporal.event_relation("t"), t="Nothing here.") is None


def test_timex_and_trend(spark):
    got = {(x.phrase, x.value) for x in one(spark, temporal.timex("t", "2021"), t="Last year and two... 3 years ago; over the past 4 quarters, first half of 2019, YTD")}
    assert {("last year", "2020"), ("3 years ago", "2018"), ("over the past 4 quarters", "P4Q"), ("first half", "2019-H1"), ("year-to-date", "2021-YTD")} <= got
    assert one(spark, temporal.timex("cast(null as string)", "2021")) == []
    t = one(spark, temporal.trend("v"), v=(100.0, 120.0, 150.0))
    assert t.trend == "increasing" and abs(t.cagr - (1.5**0.5 - 1)) < 1e-6
    assert one(spark, temporal.trend("v"), v=(5.0,)).trend == "insufficient_data" and one(spark, temporal.trend("v"), v=(100.0, 100.5, 100.2)).trend == "stable"
    assert one(spark, temporal.trend("v"), v=(1.0, 1.0, 1.0, 1.0, 1.0, 50.0)).outliers == [5]


def test_causal_relations(spark):
    r = one(spark, C.relation("t"), t="Revenue declined due to weaker demand in Europe.")
    assert (r.cause, r.effect, r.mechanism) == ("weaker demand in Europe", "Revenue declined", "attribution")
    late = one(spark, C.relation("t"), t="Revenue in 2018 fell because of the cost shock in 2021.")
    assert "temporal_violation" in late.flags
    assert one(spark, C.relation("t"), t="The sky is blue.") is None
    s = spark.createDataFrame([(1, "Higher rates caused weaker demand, which in turn reduced revenue.")], "d long, sentence string")
    assert [(x.cause, x.effect) for x in C.multi_hop(s, ["d"]).orderBy("hop").collect()] == [("Higher rates", "weaker demand"), ("weaker demand", "revenue")]
    rels = spark.createDataFrame([(1, "a", "higher rates", "weaker loan demand", 0.8), (1, "b", "weaker loan demand", "lower revenue", 0.5)], "d long, rid string, cause string, effect string, confidence double")
    assert [(x.path, x.confidence) for x in C.chains(rels, ["d"]).collect()] == [("higher rates > weaker loan demand > lower revenue", 0.368)]
    assert C.transitive(rels, ["d"]).collect()[0].confidence == 0.34
    d = one(spark, C.discourse("a", "b"), a="The company restructured its operations.", b="Its revenue grew and margins improved.")
    assert not d.explicit and d.direction == "forward" and 0 < d.score < 1
    assert one(spark, C.discourse("a", "b"), a="Sales fell.", b="However, costs fell too.").connective == "however"


def test_granger():
    rng = np.random.default_rng(42)
    x = np.cumsum(rng.normal(size=100))
    y = np.zeros(100)
    for t in range(1, 100):
        y[t] = 0.8 * y[t - 1] + 0.5 * x[t - 1] + rng.normal() * 0.1
    a = series.analysis(x, y)
    assert a["significant"] and a["strength"] > 0.5 and a["p_value"] < 0.001
    assert series.analysis(x[:3], y[:3])["dominant"] == "insufficient_data"
    # the tail of F with one and d degrees is that of t squared: 2 * P(t > 2.228) at 10 degrees is 0.05
    assert abs(series.beta_tail(10 / (10 + 2.2281388**2), 5, 0.5) - 0.05) < 1e-6
    assert series.transfer(x, np.ones(100)) == 0.0


def test_model(spark):
    assert len(scm.NODES) == 27 and len(scm.EDGES) == 33
    place = {n: i for i, n in enumerate(scm.order())}
    assert all(place[a] < place[b] for a, b in scm.EDGES)
    assert scm.separated("capex", "tax_rate", set()) and not scm.separated("capex", "tax_rate", {"net_income"})
    assert scm.backdoor("gross_profit", "net_income")[0] == ["input_costs", "revenue"]
    obs = {"interest_rate": 0.05, "inflation": 0.03, "revenue": 1000.0, "input_costs": 400.0, "capex": 100.0, "debt": 500.0, "tax_rate": 0.21, "share_count": 100.0, "sga_expense": 100.0, "gross_profit": 600.0, "depreciation": 20.0, "operating_income": 480.0, "ebit": 480.0, "interest_expense": 25.0, "net_income": 359.45, "eps": 3.5945}
    df = spark.createDataFrame([(1, obs)], "row_id long, observed map<string, double>")
    o = scm.observed_columns(df).withColumn("do_var", F.lit("revenue")).withColumn("do_val", F.lit(1200.0))
    r = scm.intervened(o).collect()[0]
    assert r.d_revenue == 1200 and r.d_gross_profit == 800 and r.d_operating_income == 680 and abs(r.d_net_income - (680 - 25) * 0.79) < 1e-9 and r.d_capex == 100
    ask = df.selectExpr(f"{scm.intervention(repr('What if revenue increased by 20%?'))} AS i", f"{scm.intervention(repr('what if we cut input costs by 10%?'))} AS j", f"{scm.intervention(repr('hello'))} AS k").collect()[0]
    assert (ask.i.var, ask.i.val) == ("revenue", 1200.0) and (ask.j.var, ask.j.val) == ("input_costs", 360.0) and ask.k is None
    c = scm.observed_columns(df)
    assert scm.necessity(c, "revenue", "gross_profit", ["row_id"]).collect()[0].necessity == 1.0
    assert scm.robustness(c, "revenue", "gross_profit", ["row_id"]).collect()[0].monotonic


def test_step_match_and_context(spark):
    assert one(spark, evaluation.step_match("p", "g"), p=["add(1, 2)", "divide(#0, 3)"], g=["ADD(1.0, 2)", "divide(#0, 4)"]) == 0.5
    e = spark.createDataFrame([(1, ["net sales 2020 were 17", "nothing"], ["net sales 2020"])], "k int, retrieved array<string>, gold_evidence array<string>")
    r = evaluation.context_quality(e).collect()[0]
    assert (r.precision, r.recall) == (0.5, 1.0)


def test_streams(spark, data, tmp_path):
    from tallyforge.streaming import windows

    batch = windows.windowed(spark.read.parquet(f"{data}/events.parquet")).collect()
    stream = windows.run_to_table(windows.windowed(windows.read_events(spark, data)), "daily").collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, stream)) and batch


def test_json_dataset(spark, tmp_path):
    import json

    from tallyforge.sources import json_dataset

    pages = [{"id": "a", "pre_text": ["x"], "post_text": [], "table": [["", "2020"], ["b", "1"]], "qa": {"question": "q", "program": "add(1, 2), divide(#0, 3)", "exe_ans": 1.5, "gold_inds": {"table_1": "t"}}}, {"pre_text": [], "qa": {"question": "r", "answer": "7"}}]
    (tmp_path / "dev.json").write_text(json.dumps(pages))
    r = {x.question: x for x in json_dataset.load_dataset(spark, str(tmp_path)).collect()}
    assert r["q"].program == ["add(1, 2)", "divide(#0, 3)"] and r["q"].answer == "1.5" and r["q"].gold_evidence == ["t"] and r["q"].split == "dev"
    assert r["r"].answer == "7" and r["r"].id.startswith("finqa_") and r["r"].program == []
    assert json_dataset.load_dataset(spark, str(tmp_path / "none")).count() == 0


def test_router_fit(spark):
    from tallyforge.operators import routing

    rows = [("why did revenue fall because of costs?", "causal"), ("what was the percentage change in sales?", "numerical")] * 20
    model = routing.fit_router(spark.createDataFrame(rows, "question string, label string"))
    out = model.transform(spark.createDataFrame([(rows[0][0], "causal"), (rows[1][0], "numerical")], "question string, label string").withColumn("features", __import__("pyspark").ml.functions.array_to_vector(F.expr(routing.features()))))
    assert [r.prediction == r.y for r in out.collect()] == [True, True]


def test_pairs_cells_and_scenario(spark):
    from tallyforge.sources import json_dataset

    e = spark.createDataFrame([("sales in 2020", "revenue of 2020", ["cost 2019", "cost 2020", "none", "late 2018"])], "anchor string, positive string, negatives array<string>")
    assert [(r.other, r.label) for r in json_dataset.contrastive_pairs(e).collect()] == [("revenue of 2020", 1), ("cost 2019", 0), ("none", 0)]
    v = spark.createDataFrame([(1, 2, [1.0, 0.0, 0.0, 0.0])], "row_idx int, col_idx int, embedding array<double>")
    got = T.place_cells(v, 4).collect()[0].embedding
    want = np.array([1, 0, 0, 0]) + 0.1 * np.array([math.sin(1), math.cos(1 / 10000**0.25), math.sin(2 / 10000**0.5), math.cos(2 / 10000**0.75)])
    assert np.allclose(got, want / np.linalg.norm(want))
    o = scm.observed_columns(spark.createDataFrame([(1, {"revenue": 100.0, "input_costs": 40.0, "gross_profit": 60.0})], "row_id long, observed map<string, double>"))
    s = scm.scenario(o, {"revenue": F.lit(200.0), "input_costs": F.lit(50.0)}).collect()[0]
    assert s.s_gross_profit == 150.0 and s.s_operating_income == 150.0
    d = o.withColumn("do_var", F.lit("revenue")).withColumn("do_val", F.lit(120.0))
    assert scm.explained(scm.intervened(d), ["row_id"]).collect()[0].explanation.startswith("Setting revenue to 120.0000 changes gross_profit by 33.33%")


def test_loop_over_rows(spark):
    from tallyforge.operators import evidence

    names = "success has_result has_program is_pot implausible n_entities has_trend has_temporal_context has_constraints n_relations has_causal_context has_discourse has_granger modules".split()
    kinds = {"n_entities": "int", "n_relations": "int", "modules": "array<string>"}
    schema = "k int, " + ", ".join(f"{n} {kinds.get(n, 'boolean')}" for n in names)
    full, none = (True, True, True, True, False, 3, True, True, True, 2, True, True, True), (False, False, False, False, False, 0, False, False, False, 0, False, False, False)
    rows = spark.createDataFrame([(1, *full, ["numerical", "temporal"]), (2, *none, ["numerical"]), (3, *none, ["temporal", "causal"]), (4, *none, [])], schema)
    a = {r.k: (r.confidence, r.gaps) for r in evidence.assessed(rows).collect()}
    assert a[1] == (1.0, []) and a[2] == (0.0, ["execution_failure", "no_result"]) and a[4] == (0.5, []) and a[3][1] == ["insufficient_entities", "no_trend", "no_relations"]

    def again(left, i):
        return evidence.assessed(left.drop("confidence", "gaps").withColumn("success", F.lit(i >= 2) & (F.col("k") == 2)).withColumn("has_result", F.lit(i >= 2) & (F.col("k") == 2)))

    out = {r.k: (r.termination, r.iterations) for r in evidence.rounds(evidence.assessed(rows), again).collect()}
    assert out == {1: ("threshold_met_initial", 1), 2: ("threshold_met", 3), 3: ("plateau", 3), 4: ("plateau", 3)}


def test_exact_median(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i % 3), float(x)) for i, x in enumerate(np.round(rng.normal(size=5001), 3))] + [(None, 1.0), (None, 4.0), ("0", None), ("9", None)] + [("h", 7.0)] * 2000
    got = {r.k: r.m for r in evaluation.exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m").collect()}
    for k in ("0", "1", "2", "h", None):
        assert abs(got[k] - np.median([v for a, v in rows if a == k and v is not None])) < 1e-12
    assert "9" not in got


def test_replies_with_any_white_space(spark, data):
    from tallyforge.functions import expressions as X

    def published(t):
        line = t.strip().split("\n")[0].strip()
        for prefix in ("the answer is", "answer:", "result:", "the result is"):
            if line.lower().startswith(prefix):
                line = line[len(prefix) :].strip()
        return line.rstrip(".")

    texts = ["The answer is\u00a05.\r\nmore", "\r\nAnswer: result: 7..\r", "\u00a0x\u00a0", "a\rb\nc", "\u2003 The result is\t-3 \u3000\n", "."]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").selectExpr("i", f"{X.reply_answer('text')} AS a").collect()
    assert {r.i: r.a for r in got} == {i: published(t) for i, t in enumerate(texts)}
    import __spark_entry__ as entry

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() if r.text and r.text.strip()}
    assert {r.doc_id: r.answer for r in entry.queries()["reply_answers_whole"](spark, data).collect()} == {k: published(t) for k, t in docs.items()}


def test_answers_of_every_size_are_returned(spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["123456.7", "0.00002", "2500000000000", "12.5", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pred_id long, predicted string").write.parquet(f"{tmp_path}/predictions.parquet")
    got = {r.pred_id: r.answer for r in entry.queries()["format_answer_whole"](spark, str(tmp_path)).collect()}
    assert got == {0: "1.2346e+05", 1: "2e-05", 2: "2.5e+12", 3: "12.5"}


def test_every_executed_program_is_judged(spark, data):
    import __spark_entry__ as entry

    q = entry.queries()
    assert {r.row_id for r in q["dsl_accuracy_whole"](spark, data).collect()} == {r.row_id for r in q["dsl_eval_all"](spark, data).collect()}
