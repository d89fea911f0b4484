from decimal import Decimal

from tallyforge.operators.unit_conversion import Metrics, convert_units, measured, read_number, stated_unit, text_scale

M = Metrics([("net sales", "money", "dollars"), ("total debt", "money", "dollars"), ("effective tax rate", "rate", "basis points"), ("employees", "count", "employees"), ("ore shipped", "mass", "kg"), ("steam generated", "energy", "kWh"), ("average lease term", "duration", "months"), ("dividend per share", "per_share", "dollars per share")])


def table(*rows):
    return [list(r) for r in rows]


def got(question, cells, pre=None, answer=None, program=None):
    return {(x[0], x[1], x[2]): (x[6], x[7], x[9]) for x in measured(question, cells, pre, answer, program, M)}


def test_numbers():
    assert read_number("$ ( 4.12 )", "money").value == Decimal("-4.12")
    assert read_number("-229,959 ( 229,959 )", "money").value == Decimal("-229959")
    assert read_number("($ 12.5 mm)", "money")[:2] == (Decimal("-12.5"), "million")
    assert read_number("-$ 7K", "money")[:2] == (Decimal("-7"), "thousand")
    assert read_number("$ -16 thousand", "money")[:2] == (Decimal("-16"), "thousand")
    assert read_number("5.1 (a)", "money").value == Decimal("5.1")
    assert read_number("7†", "money").value == Decimal("7")
    assert read_number("4,530 bps", "rate").unit == "bp"
    assert read_number("nm", "money") is None and read_number(None, "money") is None and read_number("—", "money") is None


def test_nearest_statement_holds():
    cells = table(["in millions", "2020 $ thousands", "2021"], ["net sales, $bn", "1.5", "2m"], ["total debt", "7", "8"], ["employees", "9", "10k"])
    r = got(None, cells, ["All dollar figures shown are rounded and given in billions."])
    assert r["table", 1, 1] == ("billion", "label", 1_500_000_000)
    assert r["table", 1, 2] == ("million", "number", 2_000_000)
    assert r["table", 2, 1] == ("thousand", "header", 7_000)
    assert r["table", 2, 2] == ("million", "corner", 8_000_000)
    assert r["table", 3, 1] == ("one", "none", 9)  # headers and corners speak of dollars only
    assert r["table", 3, 2] == ("thousand", "number", 10_000)


def test_text_statements_and_those_about_other_things():
    for s, u in [("(Dollars in thousands, except per share amounts.)", "thousand"), ("The schedule that follows is presented in US$ '000.", "thousand"), ("For readability, the dollar amounts shown next have been divided by 1,000,000.", "million"), ("Dollar columns have been rounded to the nearest billion and are shown on that basis.", "billion"), ("the table sets out our results for the periods indicated ( in millions ).", "million")]:
        assert text_scale(["Debt fell by $5 million in 2020.", None, s]) == u
    for s in ("Our peer group discloses its results in millions.", "Charts elsewhere in this report are drawn in billions.", "The investor fact sheet, issued separately, is in thousands.", "The segment map on page 3 uses millions of units shipped.", "Net sales rose to $ 5.7 billion in the schedule."):
        assert text_scale([s]) is None


def test_other_quantities():
    cells = table(["", "2020", "2019"], ["effective tax rate (as a fraction)", "0.2339", ""], ["ore shipped", "547.3 kt", "12 tonnes"], ["steam generated [MWh]", "7", "8 GWh"], ["average lease term", "36 months", "1.5 years"], ["dividend per share", "3", "4"], ["unknown thing (in millions)", "3", "4"])
    r = got(None, cells)
    assert r["table", 1, 1] == ("fraction", "label", 2339)
    assert r["table", 2, 1][2] == 547_300_000 and r["table", 2, 2][2] == 12_000
    assert r["table", 3, 1][2] == 7_000 and r["table", 3, 2][2] == 8_000_000
    assert r["table", 4, 1] == ("month", "number", 36) and r["table", 4, 2][2] == 18
    assert not any(k[1] in (5, 6) for k in r)


def test_answers():
    cells = table(["in millions", "2020", "2019"], ["total debt", "7.5", "5"])
    q = "what was the change in total debt from 2019 to 2020"
    assert got(q + "?", cells, None, "2.5")["answer", -1, -1] == ("million", "cells", 2_500_000)
    assert got(q + " (in thousands)?", cells, None, "2500")["answer", -1, -1] == ("thousand", "question", 2_500_000)
    assert got(q + ", in dollars, please?", cells, None, "$ 2500000")["answer", -1, -1] == ("one", "question", 2_500_000)
    assert got(q + "?", cells, None, "$-0.0025 billion")["answer", -1, -1] == ("billion", "number", -2_500_000)
    for q in ("by what percent did total debt change between 2019 and 2020?", "was total debt greater in 2020 than in 2019?", "what was the ratio of total debt to net sales in 2020?", "why did total debt change in 2020?"):
        assert ("answer", -1, -1) not in got(q, cells, None, "2.5")


def test_mixed_units_are_settled_by_the_identity():
    cells = table(["", "2009", "2007"], ["total debt", "29767860", "25m"])
    r = list(measured("what is the difference between 2009 and 2007 total debt?", cells, None, "4767860", None, M))[-1]
    assert (r[6], r[9], r[12]) == ("one", 4767860, True)


def test_units_in_statements():
    assert stated_unit("($000)", "money") == stated_unit("[k$]", "money") == "thousand"
    assert stated_unit("US$ m", "money") == stated_unit("- $mm", "money") == "million"
    assert stated_unit(", in percent", "rate") == "percent" and stated_unit("(decimal fraction)", "rate") == "fraction"
    assert stated_unit("", "money") is None and stated_unit(None, "money") is None


def test_frame_cases(spark, data):
    schema = "row_id long, question string, table_cells array<array<string>>, pre_text array<string>, answer string, program array<string>, amount string"
    rows = [(1, None, None, None, None, None, "x"), (2, "", [], [], "", [], "x"), (3, "q", [["a"], None, [], [None], ["net sales"]], [None], "1", ["x"], "x"), (4, "q", [["", "2020"], ["net sales", "9" * 30]], None, None, None, "x")]
    df = spark.createDataFrame(rows, schema)
    units = spark.createDataFrame([("net sales", "money", "dollars"), (None, None, None)], "metric string, quantity string, common_unit string")
    out = convert_units(df, units).collect()
    assert [(r.row_id, r.amount) for r in out] == [(4, None)]
    assert convert_units(df.limit(0), units).count() == 0


def test_identities_hold_over_the_whole_table(spark, data):
    out = convert_units(spark.read.parquet(f"{data}/finqa_examples.parquet"), spark.read.parquet(f"{data}/metric_units.parquet"))
    answers = out.filter("field = 'answer'")
    assert answers.count() > 20
    assert answers.filter("residual > 0.001").count() == 0 and out.filter("not exact").count() == 0


def test_a_wrong_statement_is_overruled_by_the_row():
    years = ["", "2017", "2018", "2019", "2020"]
    cells = table(years, ["net sales", "5.1m", "5,200,000", "5.3k", "5.5m"], ["total debt", "7m", "8k"], ["employees", "9", "10k", "0", "11"])
    r = {x[:3]: (x[6], x[7], x[9], x[12]) for x in measured(None, cells, None, None, None, M)}
    assert r["table", 1, 3] == ("million", "identity", 5_300_000, True) and r["table", 1, 2] == ("one", "none", 5_200_000, True)
    assert r["table", 2, 1][:2] == ("million", "number") and r["table", 2, 2][:2] == ("thousand", "number")  # two numbers: either may be wrong
    assert r["table", 3, 2][:3] == ("one", "identity", 10) and r["table", 3, 3][2] == 0
    cells = table(["in thousands", "2018", "2019 in millions", "2020"], ["net sales", "5", "5", "6"])
    r = {x[:3]: (x[6], x[7], x[9]) for x in measured(None, cells, None, None, None, M)}
    assert r["table", 1, 2] == ("thousand", "identity", 5_000)
    few = list(measured(None, table(["", "2018", "2019"], ["total debt", "7m", "8k"]), None, None, None, M))
    assert not all(x[12] for x in few)
