import re
from random import Random

from tallyforge.operators.packed_values import packed_values, split_packed, split_values

STEPS = ['add(1, 2)', 'table_max("cost of sales; net", none)', 'divide(subtract(3, 4), 5%)', 'table_sum(pension plan no. 2, none)', 'table_min("plant and equipment (net)", none)', 'exp(#0, const_m1)']


def values(s):
    return [v for _, v, _, _ in split_packed(s)]


def test_every_house_style_round_trips():
    rng = Random(3)
    for _ in range(300):
        steps = [rng.choice(STEPS) for _ in range(rng.randint(1, 5))]
        for glue in (", ", ",", ";", " | ", "||", "\n", "\r\n", "\t", " then ", ", then ", "->", " => ", " & ", " + ", " / ", " > ", "  ;", ""):
            assert values(glue.join(steps)) == steps
        assert values(" ".join(f"{i + 1}) {s};" for i, s in enumerate(steps))) == steps
        assert values("\n".join(f"step {i + 1}: {s}" for i, s in enumerate(steps))) == steps
        assert values("; ".join(f"[{i + 1}] {s}" for i, s in enumerate(steps))) == steps
        import json

        assert values(json.dumps(steps)) == steps
        assert values(repr(steps)) == steps
        assert values(";".join('"' + s.replace('"', '""') + '"' for s in steps)) == steps


def test_quoted_labels_are_plain_text_and_nested_calls_stay():
    assert values('table_max("see add(1, 2), then", none), add(divide(1,2),3)') == ['table_max("see add(1, 2), then", none)', "add(divide(1,2),3)"]


def test_errors_and_empties():
    assert list(split_packed(None)) == list(split_packed("")) == list(split_packed("  \n")) == list(split_packed("[]")) == []
    assert list(split_packed("add(1, 2"))[0][1:] == ("add(1, 2", "bare", "unclosed")
    assert [v[3] for v in split_packed('"add(1,2), subtract(#0, 3)')] == ["quote", "quote"]
    assert values("add(1, (2) , multiply(3, 4)")[-1] == "multiply(3, 4)"


def test_unclosed_calls_take_linear_time():
    got = list(split_packed("add(" * 50_000))
    assert len(got) == 50_000 and {v[3] for v in got} == {"unclosed"} and got[0][1] == "add("
    got = list(split_packed("add(1, 2), divide(3, " + "multiply(5, 6), " * 3))
    assert [v[1] for v in got] == ["add(1, 2)", "divide(3"] + ["multiply(5, 6)"] * 3
    assert len(list(split_packed('"' * 100_000 + "add(1, 2)"))) == 1


def test_long_field_takes_linear_time():
    s = ", ".join(["add(1, 2)"] * 20_000)
    assert len(values(s)) == 20_000


def test_frame(spark, data):
    df = spark.createDataFrame([(1, "add(1, 2), add(3, 4)", "x"), (2, None, "x"), (3, "", "x"), (1, "add(1, 2)", "x")], "k long, f string, pos string")
    rows = packed_values(df, "k", "f").orderBy("k", "n_values", "pos").collect()
    assert [(r.k, r.pos, r.value, r.n_values) for r in rows] == [(1, 0, "add(1, 2)", 1), (1, 0, "add(1, 2)", 2), (1, 1, "add(3, 4)", 2)]
    assert packed_values(df.limit(0), "k", "f").count() == 0


def test_positions_against_a_plain_count(spark, data):
    t = spark.read.parquet(f"{data}/program_annotations.parquet")
    got = {r.annotation_id: r.n for r in packed_values(t, "annotation_id", "program").groupBy("annotation_id").agg({"pos": "count"}).withColumnRenamed("count(pos)", "n").collect()}
    for r in t.collect():
        # calls that aren't inside another's brackets, counted without the grammar
        text = re.sub(r'\\?""?[^"()]*(?:\([^"()]*\))?[^"()]*\\?""?(?=, *none)', "L", r.program or "")
        depth = n = 0
        for m in re.finditer(r"[a-z_]+\(|\(|\)", text):
            if m[0] == ")":
                depth = max(0, depth - 1)
            else:
                n += depth == 0 and len(m[0]) > 1
                depth += 1
        assert got.get(r.annotation_id, 0) == n, r.program


def test_characters_written_as_two_escapes_meet(spark):
    assert values('["table_sum(\\"\\ud83d\\ude00\\", none)"]') == ['table_sum("\U0001f600", none)']
    df = spark.createDataFrame([(1, '["add(\\ud83d, 1)", "add(2, 3)"]'), (2, "'add(\\ud83d, 1)'")], "k long, f string")
    assert [r.value for r in packed_values(df, "k", "f").orderBy("k", "pos").collect()][:2] == ["add(\ufffd, 1)", "add(2, 3)"]


def plain(s):
    return [v for _, v, _, _ in split_values(s)]


def test_quoted_bracketed_and_bare_values():
    assert plain('a; "b,c"; d') == ["a", "b,c", "d"]
    assert plain('[1, 2, "x"]') == ["1", "2", "x"]
    assert plain("a,,b,") == ["a", "", "b"] and plain(" a | 'it''s' ,b") == ["a", "'it''s'", "b"]
    assert plain("1,234; 5|6") == ["1,234", "5", "6"] and plain("[100,200,300]") == ["100", "200", "300"]
    assert plain("f(1, 2); [3, 4], {a: 1; b: 2}\r\nx") == ["f(1, 2)", "[3, 4]", "{a: 1; b: 2}", "x"]
    assert plain('"a ""b"" c"; "d \\"e\\" f"; \'g, h\'') == ['a "b" c', 'd "e" f', "g, h"]
    assert plain(None) == plain("") == plain(" \n") == plain("[]") == []
    assert [v[2:] for v in split_values('"x", y, (z')] == [("json", None), ("bare", None), ("bare", "unclosed")]
    assert [v[1:] for v in split_values('"a, b; c"d')] == [('"a, b; c"d'.split(",")[0], "bare", "quote"), ("b", "bare", None), ('c"d', "bare", None)]
    assert len(plain('"' * 50_000)) == 1 and len(plain("(" * 50_000)) == 1 and len(plain("a;" * 50_000)) == 50_000


def test_quoted_values_round_trip():
    import csv
    import io
    import json
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text("ab ,;|\"'()[]\\\n1", max_size=8), min_size=1, max_size=5))
    def check(items):
        assert plain(json.dumps(items)) == items
        out = io.StringIO()
        items = [x.replace("\\", "") for x in items]
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(items)
        assert plain(out.getvalue()) == items

    check()
