"""Deeply nested records flattened into related tables by interval labels.

First every node of a record, whatever its name, gets the numbers of entering (pre) and leaving (post) it in a depth-first
traversal: objects, arrays, scalars, and the calls and arguments that a program's text packs. A node lies within another
exactly if its interval lies within the other's. Then nodes get the kinds that the data model knows (page, question, table,
row, cell, step, argument, evidence, paragraph), and the flat tables of each kind are linked to their page and question by
interval containment, not by the shape the source happened to use.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from json.decoder import scanstring
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.arrowmap import flat_map
from tallyforge.operators.packed_values import split_packed
from tallyforge.session import cut_lineage


class Node(NamedTuple):
    kind: str
    pre: int
    post: int
    depth: int
    pos1: int
    pos2: int
    item: str | None


class Broken(ValueError):
    """A payload that is no whole JSON value; its text says why."""


SPACE = re.compile(r"[ \t\n\r]*")
ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")
ATOMS = {"true": True, "false": False, "null": None}


def _parse_deep(s: str) -> Any:
    """JSON of any depth, without recursion; numbers stay as written."""
    out: list = []
    holders: list[tuple[Any, Any]] = [(out, None)]  # open containers with the key their next value gets
    i = SPACE.match(s, 0).end()
    while True:
        if i >= len(s):
            raise ValueError("ends early")
        holder, key = holders[-1]
        c = s[i]
        if c in "[{":
            value: Any = [] if c == "[" else {}
            i = SPACE.match(s, i + 1).end()
        elif c == '"':
            value, i = scanstring(s, i + 1)
        elif m := ATOM.match(s, i):
            value, i = ATOMS.get(m[0], m[0]), m.end()
        else:
            raise ValueError("no value")
        holder.append(value) if key is None else holder.__setitem__(key, value)
        fresh = c in "[{"
        if fresh:
            holders.append((value, None))
        while True:  # what follows a value
            i = SPACE.match(s, i).end()
            holder, _ = holders[-1]
            if len(holders) == 1:
                if i < len(s):
                    raise ValueError("goes on")
                return out[0]
            close = "]" if isinstance(holder, list) else "}"
            if s[i : i + 1] == close:
                holders.pop()
                i, fresh = i + 1, False
                continue
            if not fresh:
                if s[i : i + 1] != ",":
                    raise ValueError("no comma")
                i = SPACE.match(s, i + 1).end()
            if close == "}":
                if s[i : i + 1] != '"':
                    raise ValueError("no name")
                name, i = scanstring(s, i + 1)
                i = SPACE.match(s, i).end()
                if s[i : i + 1] != ":":
                    raise ValueError("no colon")
                i = SPACE.match(s, i + 1).end()
                holders[-1] = (holder, name)
            break


def load(payload: str | None) -> Any:
    """The payload's JSON with numbers as written, unwrapped from JSON strings however often; Broken if it isn't whole."""
    value: Any = payload
    while isinstance(value, str):  # each unwrapping is shorter than what it was in
        try:
            value = json.loads(value, parse_int=str.__str__, parse_float=str.__str__, parse_constant=str.__str__)
        except RecursionError:
            try:
                value = _parse_deep(value)
            except ValueError as e:
                raise Broken(f"broken off: {e}") from None
        except ValueError as e:
            raise Broken(f"broken off: {e}") from None
        if isinstance(value, str) and re.fullmatch(ATOM, value.strip()):
            raise Broken("no object")
    return value


def _text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return "<nested>"


def call_arguments(call: str) -> list[str]:
    """Arguments of a call as written; a table operation has its label, commas included, before its last argument."""
    name, _, inside = call.partition("(")
    inside = inside[:-1] if inside.endswith(")") else inside
    cuts, depth, quoted = [], 0, False
    for i, c in enumerate(inside):
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 0:
                cuts.append(i)
    if name.strip().startswith("table_") and len(cuts) > 1:
        cuts = cuts[-1:]
    edges = [-1, *cuts, len(inside)]
    args = [inside[a + 1 : b].strip() for a, b in zip(edges, edges[1:])]
    return [a[1:-1] if len(a) > 1 and a[0] == a[-1] == '"' else a for a in args] if inside.strip() else []


class Tree:
    """Every node of one record with its interval; nodes are numbered in order of entering."""

    def __init__(self, value: Any) -> None:
        self.type: list[str] = []
        self.key: list[str | None] = []
        self.index: list[int] = []
        self.value: list[Any] = []
        self.pre: list[int] = []
        self.post: list[int] = []
        self.depth: list[int] = []
        self.children: list[list[int]] = []
        self._label(value)

    def _label(self, value: Any) -> None:
        clock = 0
        todo: list[tuple] = [("enter", value, None, 0, 0, -1, False)]
        while todo:
            what, x, key, index, depth, parent, program = todo.pop()
            clock += 1
            if what == "leave":
                self.post[x] = clock
                continue
            at = len(self.type)
            program = program or key == "program"
            inner: list[tuple] = []
            if what == "call":
                kind = "call"
                inner = [("argument", a, None, i, depth + 1, at, False) for i, a in enumerate(call_arguments(x))]
            elif what == "argument":
                kind = "argument"
            elif isinstance(x, dict):
                kind = "object"
                inner = [("enter", v, k, i, depth + 1, at, program) for i, (k, v) in enumerate(x.items())]
            elif isinstance(x, list):
                kind = "array"
                inner = [("enter", v, None, i, depth + 1, at, program) for i, v in enumerate(x)]
            else:
                kind = "null" if x is None else "boolean" if isinstance(x, bool) else "text"
                if program and kind == "text" and (key is None or key == "program"):
                    inner = [("call", call, None, i, depth + 1, at, False) for i, call, _, _ in split_packed(x)]
            self.type.append(kind)
            self.key.append(key)
            self.index.append(index)
            self.value.append(x)
            self.pre.append(clock)
            self.post.append(0)
            self.depth.append(depth)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(at)
            todo.append(("leave", at, None, 0, 0, -1, False))
            todo.extend(reversed(inner))

    def child(self, at: int, *names: str) -> int | None:
        """The first child by any of the names, in the order of the names."""
        for name in names:
            for c in self.children[at]:
                if self.key[c] == name:
                    return c
        return None

    def items(self, at: int | None) -> list[int]:
        """Elements of an array; any other node but null stands for itself."""
        if at is None or self.type[at] == "null":
            return []
        return self.children[at] if self.type[at] == "array" else [at]


class Kinds:
    """Gives nodes of a tree the kinds of the data model; ``nodes`` are in order of their pre number."""

    def __init__(self, tree: Tree) -> None:
        self.tree, self.nodes = tree, []
        self._record()
        self.nodes.sort(key=lambda x: x.pre)

    def mark(self, at: int, kind: str, pos1: int, pos2: int = -1, item: str | None = None) -> None:
        t = self.tree
        self.nodes.append(Node(kind, t.pre[at], t.post[at], t.depth[at], pos1, pos2, item))

    def _record(self) -> None:
        t = self.tree
        if t.type[0] != "object" or not t.children[0]:
            self.mark(0, "unread", 0, item=f"record as {t.type[0]}")
            return
        self.mark(0, "record", 0)
        pages = t.child(0, "pages")
        for i, at in enumerate([0] if pages is None else t.items(pages)):
            if t.type[at] == "object" and t.children[at]:
                self._page(at, i)
            elif t.type[at] != "null":
                self.mark(at, "unread", i, item=f"page as {t.type[at]}")

    def _page(self, at: int, i: int) -> None:
        t = self.tree
        own = t.child(at, "id")
        self.mark(at, "page", i, item=_text(None if own is None else t.value[own]))
        for side, name in enumerate(("pre_text", "post_text")):
            for j, p in enumerate(t.items(t.child(at, name))):
                self.mark(p, "paragraph", side, j, _text(t.value[p]))
        table = t.child(at, "table")
        if table is not None and t.type[table] != "null":
            self._table(table)
        for j, qa in enumerate(t.items(t.child(at, "qa"))):
            if t.type[qa] == "object":
                self._question(qa, j)
            elif t.type[qa] != "null":
                self.mark(qa, "unread", j, item=f"question as {t.type[qa]}")

    def _cell(self, at: int, r: int, c: int) -> None:
        t = self.tree
        held = t.child(at, "raw", "value", "text", "name") if t.type[at] == "object" else at
        self.mark(at, "cell", r, c, "" if held is None else _text(t.value[held]))

    def _table(self, at: int) -> None:
        t = self.tree
        self.mark(at, "table", 0)
        rows: list[tuple[int, list[int]]] = []
        if t.type[at] == "array":
            rows = [(r, t.items(r)) for r in t.children[at] if t.type[r] != "null"]
        elif t.type[at] == "object":
            head, body = t.child(at, "header", "columns"), t.child(at, "rows")
            if head is not None and t.type[head] == "array":
                rows.append((head, t.children[head]))
            if head is None and body is None:  # under any other name: what holds arrays holds the rows
                body = next((c for c in t.children[at] if t.type[c] == "array" and t.children[c] and all(t.type[x] in ("array", "object") for x in t.children[c])), None)
            for r in t.items(body):
                if t.type[r] == "object":
                    label, own = t.child(r, "label"), t.child(r, "values", "cells")
                    rows.append((r, [*([] if label is None else [label]), *t.items(own)]))
                elif t.type[r] == "array":
                    rows.append((r, t.children[r]))
                elif t.type[r] != "null":
                    self.mark(r, "unread", len(rows), item=f"row as {t.type[r]}")
        if not rows and (t.type[at] != "array" or t.children[at]):
            self.mark(at, "unread", 0, item=f"table as {t.type[at]}")
        for i, (r, cells) in enumerate(rows):
            self.mark(r, "row", i)
            for c, cell in enumerate(cells):
                self._cell(cell, i, c)

    def _question(self, at: int, j: int) -> None:
        t = self.tree
        text = t.child(at, "question")
        self.mark(at, "question", j, item=_text(None if text is None else t.value[text]))
        answer = t.child(at, "exe_ans", "answer")
        if answer is not None and t.type[answer] != "null":
            self.mark(answer, "answer", j, item=_text(t.value[answer]))
        self._program(t.child(at, "program"))
        self._evidence(t.child(at, "gold_inds"))

    def _program(self, at: int | None) -> None:
        t = self.tree
        if at is not None and t.type[at] == "object":
            at = t.child(at, "steps")
        s = 0
        for step in t.items(at):
            if t.type[step] == "object":
                name = t.child(step, "operation")
                self.mark(step, "step", s, item=_text(None if name is None else t.value[name]))
                for a, arg in enumerate(t.items(t.child(step, "args"))):
                    self.mark(arg, "arg", s, a, self._argument(arg))
                s += 1
            elif t.type[step] == "text":
                for call in t.children[step]:
                    self.mark(call, "step", s, item=t.value[call].partition("(")[0])
                    for a, arg in enumerate(t.children[call]):
                        self.mark(arg, "arg", s, a, t.value[arg])
                    s += 1
            elif t.type[step] != "null":
                self.mark(step, "unread", s, item=f"step as {t.type[step]}")

    def _argument(self, at: int) -> str:
        t = self.tree
        if t.type[at] != "object":
            return _text(t.value[at])
        held = t.value[at]
        if held.get("type") == "reference":
            return f"#{_text(held.get('step'))}"
        return _text(held["value"] if "value" in held else held.get("ref"))

    def _evidence(self, at: int | None) -> None:
        t = self.tree
        if at is None:
            return
        found: list[tuple[int, str]] = []
        if t.type[at] == "object":
            for c in t.children[at]:
                if t.type[c] == "object":
                    found += [(x, f"{t.key[c]}_{t.key[x]}") for x in t.children[c]]
                else:
                    found.append((c, t.key[c] or ""))
        else:
            for c in t.items(at):
                if t.type[c] == "object":
                    ref = t.child(c, "ref")
                    found.append((c, _text(None if ref is None else t.value[ref])))
                elif t.type[c] != "null":
                    found.append((c, _text(t.value[c])))
        for i, (c, name) in enumerate(found):
            self.mark(c, "evidence", i, -1, name)


def label(payload: str | None) -> list[Node]:
    """The nodes of known kinds of a record, and a node ``broken`` or ``unread`` for each part that can't be read."""
    if payload is None or not payload.strip():
        return []
    try:
        value = load(payload)
    except Broken as e:
        return [Node("broken", 1, 2, 0, 0, -1, str(e))]
    return [] if value is None or value == {} else Kinds(Tree(value)).nodes


def linked(nodes: list[Node], kinds: tuple[str, ...] = ("cell", "arg", "evidence")) -> Iterator[tuple[int, int, Node]]:
    """(page, question, node) of every node of ``kinds``, found by containment of intervals; -1 for what lies in none."""
    outer = {}
    for kind in ("page", "question"):
        own = [x for x in nodes if x.kind == kind]
        outer[kind] = ([x.pre for x in own], own)

    def holder(kind: str, x: Node) -> int:
        starts, own = outer[kind]
        i = bisect_right(starts, x.pre) - 1
        return own[i].pos1 if i >= 0 and own[i].post >= x.post else -1

    for x in nodes:
        if x.kind in kinds:
            yield holder("page", x), holder("question", x), x


def every_node(records: DataFrame) -> DataFrame:
    """(record_no, pre, post, depth, type, name, place, value) of every node of every record, known or not.

    type is object, array, text, boolean, null, call or argument; name is the key it stands under, place its position
    there; scalars, calls and arguments have their text as value. Null, blank and broken-off payloads have no nodes.
    """

    def make() -> Callable[..., Iterator[tuple]]:
        def each(no: int, payload: str | None) -> Iterator[tuple]:
            try:
                value = load(payload)
            except Broken:
                return
            if value is not None:
                t = Tree(value)
                for i, kind in enumerate(t.type):
                    yield no, t.pre[i], t.post[i], t.depth[i], kind, t.key[i], t.index[i], None if kind in ("object", "array", "null") else _text(t.value[i])

        return each

    return flat_map(records, ["record_no", "payload"], make, "record_no bigint, pre int, post int, depth int, type string, name string, place int, value string", 8192)


def nested_nodes(records: DataFrame) -> DataFrame:
    """The nodes of known kinds: (record_no, kind, pre, post, depth, pos1, pos2, item).

    Kinds are record, page, paragraph, table, row, cell, question, answer, step, arg, evidence; a payload that is broken
    off has one node ``broken``, and a part whose shape isn't known one ``unread``, both saying what they are. Null, blank
    and empty payloads have none. Node b is within node a of its record if a.pre < b.pre and b.post < a.post; a node of two
    kinds (a record that is its only page) has the same interval under both. One pass where the records lie.
    """

    def make() -> Callable[..., Iterator[tuple]]:
        def each(no: int, payload: str | None) -> Iterator[tuple]:
            for x in label(payload):
                yield no, *x

        return each

    return flat_map(records, ["record_no", "payload"], make, "record_no bigint, kind string, pre int, post int, depth int, pos1 int, pos2 int, item string", 8192)


#: Columns of each kind's table beside record_no, page_idx, qa_idx and the interval.
TABLES = {
    "page": ["item AS page_id"],
    "paragraph": ["if(pos1 = 0, 'pre', 'post') AS side", "pos2 AS para_idx", "item AS text"],
    "cell": ["pos1 AS row_idx", "pos2 AS col_idx", "item AS text"],
    "question": ["item AS question"],
    "answer": ["item AS answer"],
    "step": ["pos1 AS step", "item AS operation"],
    "arg": ["pos1 AS step", "pos2 AS argument", "item AS text"],
    "evidence": ["pos1 AS place", "item AS name"],
    "broken": ["item AS reason"],
    "unread": ["item AS reason"],
}


def node_tables(records: DataFrame) -> dict[str, DataFrame]:
    """A flat table per kind, with record_no, page_idx, qa_idx (-1 outside a page or question), pre and post.

    The records are parsed once, into a table in the shared folder that those returned read.
    """
    nodes = cut_lineage(_linked_nodes(records, tuple(TABLES)))
    return {kind: nodes.filter(F.col("kind") == kind).selectExpr("record_no", "page_idx", "qa_idx", "pre", "post", *columns) for kind, columns in TABLES.items()}


def _linked_nodes(records: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    def make() -> Callable[..., Iterator[tuple]]:
        def each(no: int, payload: str | None) -> Iterator[tuple]:
            nodes = label(payload)
            ids = {x.pos1: x.item for x in nodes if x.kind == "page"}
            for page, question, x in linked(nodes, kinds):
                yield no, page, question, x.kind, x.pre, x.post, x.pos1, x.pos2, x.item, ids.get(page)

        return each

    return flat_map(records, ["record_no", "payload"], make, "record_no bigint, page_idx int, qa_idx int, kind string, pre int, post int, pos1 int, pos2 int, item string, page_id string", 8192)


def flatten_records(records: DataFrame) -> DataFrame:
    """Child rows with their links: (record_no, page_idx, qa_idx, kind, pos1, pos2, item, page_id).

    kind is cell, arg or evidence; a cell has qa_idx -1. Null, broken-off and empty payloads give no rows; a record sent
    twice gives its rows under both numbers; null cells have the item ''; a scalar where an array is expected counts as
    an array of one. Records are flattened where they lie, without a shuffle.
    """
    return _linked_nodes(records, ("cell", "arg", "evidence")).drop("pre", "post")
