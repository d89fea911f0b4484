import json

from tallyforge.operators.nested_records import call_arguments, every_node, flatten_records, label, linked, load, nested_nodes, node_tables


def rows(payload):
    return [(p, q, x.kind, x.pos1, x.pos2, x.item) for p, q, x in linked(label(payload))]


PAGE = {"id": "a", "pre_text": [], "table": [["", "2020"], ["net sales", None]], "qa": [{"question": "q", "program": "subtract(5, 4), divide(#0, 4)", "gold_inds": {"table_1": "x", "text_0": "y"}}, {"question": "r", "program": {"steps": [{"operation": "table_max", "args": [{"type": "string", "value": "a, b"}, {"type": "reference", "step": 0}, {"type": "table_ref", "ref": "table_sum"}]}]}, "gold_inds": {"table": {"2": "t"}, "text": {"5": "u"}}}]}


def test_children_keep_their_links():
    got = rows(json.dumps(PAGE))
    assert [r for r in got if r[2] == "cell"] == [(0, -1, "cell", 0, 0, ""), (0, -1, "cell", 0, 1, "2020"), (0, -1, "cell", 1, 0, "net sales"), (0, -1, "cell", 1, 1, "")]
    assert [r[1:] for r in got if r[2] == "arg"] == [(0, "arg", 0, 0, "5"), (0, "arg", 0, 1, "4"), (0, "arg", 1, 0, "#0"), (0, "arg", 1, 1, "4"), (1, "arg", 0, 0, "a, b"), (1, "arg", 0, 1, "#0"), (1, "arg", 0, 2, "table_sum")]
    assert [r[1:] for r in got if r[2] == "evidence"] == [(0, "evidence", 0, -1, "table_1"), (0, "evidence", 1, -1, "text_0"), (1, "evidence", 0, -1, "table_2"), (1, "evidence", 1, -1, "text_5")]


def test_other_shapes_give_the_same_cells():
    want = [r[3:] for r in rows(json.dumps(PAGE)) if r[2] == "cell"]
    a = {"id": "a", "table": {"header": ["", 2020], "rows": [{"label": "net sales", "values": [None]}]}}
    b = {"id": "a", "table": {"columns": [{"name": ""}, {"name": "2020"}], "rows": [{"cells": [{"raw": "net sales", "note": "n"}, {"raw": None}]}]}}
    c = {"filing": {}, "pages": [{"id": "a", "table": a["table"]}, {"id": "b", "table": b["table"]}]}
    assert [r[3:] for r in rows(json.dumps(a))] == [r[3:] for r in rows(json.dumps(b))] == want
    assert [r[0] for r in rows(json.dumps(c))] == [0] * 4 + [1] * 4
    assert rows(json.dumps(json.dumps(a))) == rows(json.dumps(a))


def test_intervals_nest():
    nodes = label(json.dumps(PAGE))
    assert [n.pre for n in nodes] == sorted(n.pre for n in nodes)
    for a in nodes:
        for b in nodes:
            assert a is b or a.post < b.pre or b.post < a.pre or (a.pre < b.pre and b.post < a.post) or (b.pre < a.pre and a.post < b.post) or ({a.kind, b.kind} == {"record", "page"} and a[1:3] == b[1:3])


def test_numbers_stand_as_written_and_broken_ones_are_nothing():
    assert rows('{"id": "x", "table": [[962131719, 5.10]]}') == [(0, -1, "cell", 0, 0, "962131719"), (0, -1, "cell", 0, 1, "5.10")]
    for bad in (None, "", "null", "{}", '{"id": "x", "table": [["a"', "[1, 2]", '"text"', "17", '{"id": "x", "table": null, "qa": null}', '{"pages": null}'):
        assert rows(bad) == []
    assert label("[" * 100_000)[0].kind == "broken" and label('{"id": "x", "table": [["a"')[0].kind == "broken" and label("[1, 2]")[0].kind == "unread"


def test_call_arguments():
    assert call_arguments("table_max(Inventories, $ thousands, none)") == ["Inventories, $ thousands", "none"]
    assert call_arguments('table_max("a, b", none)') == ["a, b", "none"]
    assert call_arguments("add()") == [] and call_arguments("divide(add(1, 2), 3)") == ["add(1, 2)", "3"]


def test_frames(spark, data):
    df = spark.createDataFrame([(1, json.dumps(PAGE), 5), (2, None, 5), (3, "", 5), (1, json.dumps(PAGE), 5)], "record_no long, payload string, kind int")
    assert flatten_records(df).count() == 2 * len(rows(json.dumps(PAGE)))
    assert flatten_records(df.limit(0)).count() == 0
    n = nested_nodes(df.limit(1))
    inner, outer = n.filter("kind = 'arg'").alias("a"), n.filter("kind = 'question'").alias("q")
    assert inner.join(outer, "record_no").filter("q.pre < a.pre and a.post < q.post").count() == 7


def test_payloads_wrapped_often_and_nested_deep():
    payload = json.dumps({"id": "x", "table": [["a"]], "deep": json.loads("[" * 400 + "]" * 400)})
    deep = payload.replace("[" * 400 + "]" * 400, '[{"k": ' * 60_000 + "null" + "}]" * 60_000)
    assert rows(deep) == rows(payload) == [(0, -1, "cell", 0, 0, "a")]
    for _ in range(11):
        payload = json.dumps(payload)
    assert rows(payload) == [(0, -1, "cell", 0, 0, "a")]


def test_shapes_that_no_source_sends_are_read_or_flagged():
    kinds = lambda v: [(n.kind, n.item) for n in label(json.dumps(v)) if n.kind in ("cell", "unread", "arg")]
    assert kinds({"id": "x", "table": {"grid": [["a", 1]]}}) == [("cell", "a"), ("cell", "1")]
    assert kinds({"id": "x", "table": {"grid": "a"}}) == [("unread", "table as object")] and kinds({"id": "x", "table": 5}) == [("unread", "table as text")]
    assert kinds({"id": "x", "qa": {"program": [{"operation": "exp", "args": 12}]}}) == [("arg", "12")]
    assert kinds({"id": "x", "qa": "why"}) == [("unread", "question as text")]


def test_every_node_is_labelled_and_no_record_stops_a_task(spark):
    payload = '{"id": "\\ud83d", "note": {"a": [1, null, {"b": true}]}, "qa": {"program": "add(1, 2)"}}'
    df = spark.createDataFrame([(1, payload), (2, "{"), (3, None)], "record_no long, payload string")
    n = {(r.type, r.name, r.value) for r in every_node(df).collect()}
    assert n == {("object", None, None), ("text", "id", "\ufffd"), ("object", "note", None), ("array", "a", None), ("text", None, "1"), ("null", None, None), ("object", None, None), ("boolean", "b", "true"), ("object", "qa", None), ("text", "program", "add(1, 2)"), ("call", None, "add(1, 2)"), ("argument", None, "1"), ("argument", None, "2")}
    tables = node_tables(df)
    assert [(r.page_id, r.record_no) for r in tables["page"].collect()] == [("\ufffd", 1)]
    assert [(r.step, r.argument, r.text, r.qa_idx) for r in tables["arg"].orderBy("argument").collect()] == [(0, 0, "1", 0), (0, 1, "2", 0)]
    assert [r.record_no for r in tables["broken"].collect()] == [2] and tables["unread"].count() == 0
