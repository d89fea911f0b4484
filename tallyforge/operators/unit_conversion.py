"""Quantities recorded in different units, converted to the common unit of their metric.

Every number has candidate units: those stated near it, nearest first, the other units of its quantity, and for a bare
answer those of the cells it is made of. Identities tie the numbers together: a row is one quantity over time, an answer is
one cell, the highest, the sum or the difference of cells of its metric. Of all combinations of candidate units the one
with the least sum of log residuals and of prices is chosen; the nearest statement costs nothing, so it holds unless the
other numbers of the row speak against it by more than its price. Numbers for which another unit does as well are flagged as not
unique.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from decimal import Decimal, InvalidOperation
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.arrowmap import flat_map

METRICS_AT_MOST = 100_000  #: rows of the metric table that are sent to the tasks

# Factors to the common unit of each quantity.
SCALES = {"one": Decimal(1), "thousand": Decimal(1000), "million": Decimal(10**6), "billion": Decimal(10**9)}
FACTORS = {
    "money": SCALES,
    "count": SCALES,
    "mass": {"kg": Decimal(1), "tonne": Decimal(1000), "kt": Decimal(10**6)},
    "energy": {"kwh": Decimal(1), "mwh": Decimal(1000), "gwh": Decimal(10**6)},
    "duration": {"month": Decimal(1), "quarter": Decimal(3), "year": Decimal(12)},
    "rate": {"bp": Decimal(1), "percent": Decimal(100), "fraction": Decimal(10000)},
}
COMMON = {"money": "one", "count": "one", "mass": "kg", "energy": "kwh", "duration": "month", "rate": "bp"}

# How units are written beside a number and in statements.
BESIDE = {
    "scale": [("thousand", r"k|thousands?|000s?"), ("million", r"m|mm|mn|millions?"), ("billion", r"b|bn|billions?")],
    "mass": [("kg", r"kgs?|kilograms?"), ("tonne", r"t|tonnes?|tons?"), ("kt", r"kt|kilotonnes?")],
    "energy": [("kwh", r"kwh"), ("mwh", r"mwh"), ("gwh", r"gwh")],
    "duration": [("month", r"months?|mos?"), ("quarter", r"quarters?|qtrs?"), ("year", r"years?|yrs?|y")],
    "rate": [("percent", r"%|pct|percent|per cent"), ("bp", r"bps?|basis points?")],
}
STATED = {
    "scale": [
        ("thousand", r"\bthousands?\b|\bk\b|k\$|\$\s*k\b|\$?\s*'?\b000s?\b"),
        ("million", r"\bmillions?\b|\bmm\b|\bmn\b|\bm\b|\$\s*mm?\b"),
        ("billion", r"\bbillions?\b|\bbn\b|\bb\b|\$\s*bn?\b"),
        ("one", r"\bactual\b|\bunits?\b|\bwhole\b|\bones\b|\bdollars\b"),
    ],
    "mass": [("kg", r"\bkgs?\b|\bkilograms?\b"), ("tonne", r"\btonnes?\b"), ("kt", r"\bkt\b|\bkilotonnes?\b")],
    "energy": [("kwh", r"\bkwh\b"), ("mwh", r"\bmwh\b"), ("gwh", r"\bgwh\b")],
    "duration": [("month", r"\bmonths?\b"), ("quarter", r"\bquarters?\b"), ("year", r"\byears?\b|\byrs?\b")],
    "rate": [("bp", r"\bbps?\b|\bbasis points?\b"), ("fraction", r"\bfractions?\b|\bdecimals?\b"), ("percent", r"%|\bpct\b|\bpercent(?:age)?\b|\bper cent\b")],
}
BESIDE_RE = {k: [(u, re.compile(rf"\s*(?:{p})(?![a-z])", re.I)) for u, p in v] for k, v in BESIDE.items()}
STATED_RE = {k: [(u, re.compile(p, re.I)) for u, p in v] for k, v in STATED.items()}
NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?|\.\d+")
NAMED = re.compile(r"(?:\bin|\bnearest|\(|\bdivided by)\s*\(?\s*(?:(?:u\.?s\.? ?)?\$ ?)?(thousands?|millions?|billions?|mm|mn|bn|m|'?000s?|1,000,000,000|1,000,000|1,000)(?!\w|,\d)", re.I)
SUBJECT = re.compile(r"\b(?:table|tabular|tables|dollars?|figures|amounts|columns|schedule|summary)\b|us\$", re.I)
WORD_SCALE = {"1,000": "thousand", "1,000,000": "million", "1,000,000,000": "billion"}
NOT_AMOUNT = re.compile(r"\b(?:percent(?:age)?|per cent|growth rate|ratio|portion|share of|fraction of|greater|exceed(?:ed)?|why|caused?|average|margin of)\b", re.I)
ASKED_UNIT = re.compile(r"(?:\(\s*in|,?\s*expressed in|,\s*in|\bin)\s+((?:whole |actual )?dollars|thousands?|millions?|billions?|basis points|percent|months|years|quarters|kg|tonnes|kt|kwh|mwh|gwh)\b(?: of (?:u\.s\. )?dollars)?\s*\)?[\s,?.!]*(?:please|overall)?[\s?.!]*$", re.I)
FOOTNOTE = re.compile(r"\(\s*[a-z]\s*\)|[*†‡§]+", re.I)


LOGS = {q: {u: math.log10(f) for u, f in units.items()} for q, units in FACTORS.items()}
STATED_PRICE, UNSTATED_PRICE = 2.0, 2.5  #: decades of residual that a farther statement, or a unit nothing states, must save


class Number(NamedTuple):
    value: Decimal
    unit: str | None
    only_in_brackets: bool


def family(quantity: str) -> str:
    return "scale" if quantity in ("money", "count") else quantity


def read_number(text: str | None, quantity: str) -> Number | None:
    """The first number of a text with the unit beside it; negative if signed or if no number stands outside brackets."""
    if not text:
        return None
    s = FOOTNOTE.sub(" ", text)
    m = NUMBER.search(s)
    if not m:
        return None
    try:
        value = Decimal(m[0].replace(",", ""))
    except InvalidOperation:
        return None
    before = s[: m.start()]
    bracketed = before.count("(") > before.count(")") and ")" in s[m.end() :]
    if bracketed or re.search(r"[-−–]\s*[$€£¥]?\s*$|[-−–]\s*(?:us)?\s*\$\s*$", before, re.I):
        value = -value
    unit = next((u for u, p in BESIDE_RE[family(quantity)] if p.match(s, m.end())), None)
    return Number(value, unit, bracketed)


def stated_unit(text: str | None, quantity: str) -> str | None:
    """The unit a label, header or corner cell states."""
    if not text:
        return None
    return next((u for u, p in STATED_RE[family(quantity)] if p.search(text)), None)


def text_scale(pre_text: list | None) -> str | None:
    """The scale that the running text states for the table's dollars; the last such statement holds."""
    found = None
    for paragraph in pre_text or []:
        if not paragraph or not NAMED.search(paragraph):
            continue
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph.replace("\xa0", " ")):
            m = NAMED.search(sentence)
            if m and SUBJECT.search(sentence):
                found = WORD_SCALE.get(m[1]) or stated_unit(m[1], "money") or found
    return found


class Metrics:
    """Metrics by name; a label's metric is the longest name it begins with, a question's are those named in it."""

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        self.by_name = {" ".join(m.lower().split()): (m, q, c) for m, q, c in rows if m and q}
        self.longest = max((len(x.split()) for x in self.by_name), default=0)
        names = sorted(self.by_name, key=len, reverse=True)
        self.named = re.compile(r"\b(?:" + "|".join(map(re.escape, names)) + r")\b") if names else re.compile(r"(?!)")

    def of_label(self, label: str | None) -> tuple[str, str, str] | None:
        parts = re.sub(r"[,:;(\[*†]|\s-\s", " \x00 ", (label or "").lower().replace("\xa0", " ")).split("\x00")[0].split()
        for n in range(min(len(parts), self.longest), 0, -1):
            if got := self.by_name.get(" ".join(parts[:n])):
                return got
        return None


class Cell(NamedTuple):
    row: int
    col: int
    metric: str
    quantity: str
    common: str
    value: Decimal
    unit: str
    source: str
    header: str
    others: tuple[str, ...] = ()  #: units stated farther away, nearest first


def table_cells(table: list | None, pre_text: list | None, metrics: Metrics) -> list[Cell]:
    """Every number of the table with the unit that holds for it."""
    out: list[Cell] = []
    if not table:
        return out
    head = table[0] or []
    corner = stated_unit(head[0] if head else None, "money")
    headers = [stated_unit(re.sub(r"\b(?:FY)?(?:19|20)\d\d\b", " ", h or ""), "money") for h in head]
    text: str | None = None
    for r, row in enumerate(table):
        if r == 0 or not row:
            continue
        got = metrics.of_label(row[0])
        if got is None or got[1] not in FACTORS:
            continue
        name, quantity, common = got
        rest = re.sub(r"\s+", " ", (row[0] or "").lower().replace("\xa0", " ")).strip()[len(name) :]
        label = stated_unit(rest, quantity)
        for c in range(1, len(row)):
            number = read_number(row[c], quantity)
            if number is None:
                continue
            stated = [(number.unit, "number"), (label, "label")]
            if quantity == "money":
                stated += [(headers[c] if c < len(headers) else None, "header"), (corner, "corner")]
                if not any(u for u, _ in stated):
                    text = text if text is not None else text_scale(pre_text) or ""
                    stated.append((text or None, "text"))
            stated = [x for x in stated if x[0]] or [(COMMON[quantity], "none")]
            unit, source = stated[0]
            others = tuple(dict.fromkeys(u for u, _ in stated[1:] if u != unit))
            out.append(Cell(r, c, name, quantity, common, number.value, unit, source, (head[c] or "") if c < len(head) else "", others))
    return out


def log_size(c: Cell, unit: str) -> float:
    """Log10 of the cell's amount in a unit; the cell isn't zero."""
    return math.log10(abs(c.value)) + LOGS[c.quantity][unit]


def settle_row(cells: list[Cell]) -> list[tuple[Cell, float | None, bool]]:
    """(cell, residual, unique) of one row's cells with the units that cost least together.

    The cost is the distance of every cell from a middle size plus the prices of its units. The nearest statements are
    returned where they cost no more than the least price, as nothing else can then cost less, and where several
    combinations cost the same. A cell is unique if no other unit brings it as near to the middle of the row; zeros and
    cells that stand alone say nothing.
    """
    sized = [c for c in cells if c.value]
    logs = sorted(log_size(c, c.unit) for c in sized)
    if not logs:
        return [(c, None, True) for c in cells]
    middle = logs[len(logs) // 2]
    cost = sum(abs(x - middle) for x in logs)
    if cost > STATED_PRICE and len(sized) > 2:
        options = [[(log_size(c, u), 0.0 if u == c.unit else STATED_PRICE * (1 + c.others.index(u)) if u in c.others else UNSTATED_PRICE * (1 + len(c.others)), u) for u in FACTORS[c.quantity]] for c in sized]
        found = {}
        for m in {size for o in options for size, _, _ in o}:
            best = [min((abs(size - m) + price, u) for size, price, u in o) for o in options]
            found[tuple(u for _, u in best)] = min(found.get(tuple(u for _, u in best), math.inf), sum(x for x, _ in best))
        least = min(found.values())
        ties = [units for units, x in found.items() if x < least + 1e-6]
        if least < cost - 1e-6 and len(ties) == 1:
            chosen = {id(c): u for c, u in zip(sized, ties[0])}
            cells = [c._replace(unit=u, source="identity") if (u := chosen.get(id(c), c.unit)) != c.unit else c for c in cells]
            logs = sorted(log_size(c, c.unit) for c in cells if c.value)
            middle = logs[len(logs) // 2]
    out = []
    for c in cells:
        if not c.value:
            out.append((c, None, True))
            continue
        size = log_size(c, c.unit)
        off, own = abs(size - middle), LOGS[c.quantity][c.unit]
        out.append((c, off, len(logs) > 1 and not any(abs(size - own + x - middle) <= off + 1e-9 for u, x in LOGS[c.quantity].items() if u != c.unit) or len(logs) == 1))
    return out


def amount(value: Decimal, quantity: str, unit: str) -> Decimal:
    return value * FACTORS[quantity][unit]


def residual(a: Decimal, b: Decimal) -> float:
    """Absolute log10 ratio of two amounts; the signs of a difference may be either way round."""
    if a == 0 or b == 0:
        return 0.0 if a == b else 99.0
    return abs(math.log10(abs(a) / abs(b)))


def expected(question: str, cells: list[Cell]) -> list[Decimal]:
    """What the identity named by the question gives from cells of its metric: candidates in base units."""
    years = re.findall(r"\b(?:19|20)\d\d\b", question)
    of = {y: [amount(c.value, c.quantity, c.unit) for c in cells if y in c.header] for y in years}
    if re.search(r"\bhighest\b|\bpeak\b|\bmaximum\b|\blargest\b", question):
        return [max(amount(c.value, c.quantity, c.unit) for c in cells)] if cells else []
    if len(years) >= 2:
        pairs = [(a, b) for a in of[years[0]] for b in of[years[1]]]
        if re.search(r"\btotal\b|\bcombined\b|\badded\b|\bsum\b|\btogether\b", question):
            return [a + b for a, b in pairs]
        return [a - b for a, b in pairs]
    return of[years[0]] if years else [amount(c.value, c.quantity, c.unit) for c in cells]


class Answer(NamedTuple):
    metric: str
    quantity: str
    common: str
    value: Decimal
    unit: str
    source: str
    residual: float | None
    unique: bool


def read_answer(question: str | None, answer: str | None, program: list | None, cells: list[Cell], metrics: Metrics) -> Answer | None:
    """The answer's amount if the question asks for one amount, the highest, or the sum or difference of two of one metric."""
    if not question or not answer:
        return None
    q = " ".join(question.lower().replace("\xa0", " ").split())
    named = set(metrics.named.findall(q))
    if len(named) != 1:
        return None
    name, quantity, common = metrics.by_name[named.pop()]
    if quantity not in FACTORS or NOT_AMOUNT.search(metrics.named.sub("it", q)):
        return None
    if any(re.match(r"\s*(?:greater\(|divide\((?!.*const_))", s or "") for s in program or []):
        return None
    number = read_number(answer, quantity)
    if number is None or (quantity != "rate" and "%" in answer):
        return None
    own = [c for c in cells if c.metric == name]
    if number.unit:
        unit, source, candidates = number.unit, "number", [number.unit]
    elif m := ASKED_UNIT.search(q):
        unit, source = stated_unit(m[1], quantity) or COMMON[quantity], "question"
        candidates = [unit]
    else:
        years = re.findall(r"\b(?:19|20)\d\d\b", q)
        used = [c for c in own if any(y in c.header for y in years)] or own
        candidates = list(dict.fromkeys([*(c.unit for c in used), COMMON[quantity]]))
        unit, source = candidates[0], "cells" if used else "none"
    wanted = expected(metrics.named.sub("it", q), own)
    scores = {u: min((residual(amount(number.value, quantity, u), w) for w in wanted), default=0.0) for u in candidates}
    if source == "cells" and wanted:
        unit = min(candidates, key=lambda u: (round(scores[u], 6), candidates.index(u)))
    ties = sum(abs(s - scores[unit]) < 1e-6 for s in scores.values())
    return Answer(name, quantity, common, number.value, unit, source, scores[unit] if wanted else None, ties == 1)


def measured(question: str | None, table: list | None, pre_text: list | None, answer: str | None, program: list | None, metrics: Metrics) -> Iterator[tuple]:
    """(field, row_idx, col_idx, metric, quantity, recorded, unit, stated_by, common_unit, amount, exact, residual, unique) of every number."""
    rows: dict[int, list[Cell]] = {}
    for c in table_cells(table, pre_text, metrics):
        rows.setdefault(c.row, []).append(c)
    settled = [x for row in rows.values() for x in settle_row(row)]
    for c, off, unique in settled:
        yield "table", c.row, c.col, c.metric, c.quantity, str(c.value), c.unit, c.source, c.common, *whole(amount(c.value, c.quantity, c.unit)), off, unique
    cells = [c for c, _, _ in settled]
    got = read_answer(question, answer, program, cells, metrics)
    if got:
        yield "answer", -1, -1, got.metric, got.quantity, str(got.value), got.unit, got.source, got.common, *whole(amount(got.value, got.quantity, got.unit)), got.residual, got.unique


def whole(a: Decimal) -> tuple[int | None, bool]:
    n = int(a.to_integral_value(rounding="ROUND_HALF_UP"))
    return (n, n == a) if abs(n) < 1 << 63 else (None, False)


def convert_units(examples: DataFrame, metric_units: DataFrame) -> DataFrame:
    """Every number of table_cells and answer in the common unit of its metric.

    Columns: row_id, field (table or answer), row_idx, col_idx (from 0 with header and label; -1 for answers), metric,
    quantity, recorded, unit, stated_by (number, label, header, corner, text, question, cells, none, or identity where the row overrules its statements), common_unit,
    amount BIGINT, exact, residual (log10 distance from what the identities give), unique, converted (recorded in
    another unit than the common one). Per-share metrics, unknown labels, cells without a number, null tables, texts and
    answers give no rows; an amount beyond BIGINT is null; one that isn't whole is rounded and not exact. Repeated rows
    are each converted. One pass without a shuffle; the metric table goes to the tasks after a check of its size.
    """
    listed = [tuple(r) for r in metric_units.select("metric", "quantity", "common_unit").take(METRICS_AT_MOST + 1)]
    if len(listed) > METRICS_AT_MOST:
        raise ValueError(f"more than {METRICS_AT_MOST} metrics")
    shared = examples.sparkSession.sparkContext.broadcast(listed)

    def make() -> Callable[..., Iterator[tuple]]:
        metrics = Metrics(shared.value)

        def each(row: int, question: str | None, table: Any, pre: Any, answer: str | None, program: Any) -> Iterator[tuple]:
            for x in measured(question, table, pre, answer, program, metrics):
                yield row, *x

        return each

    out = flat_map(
        examples,
        ["row_id", "question", "table_cells", "pre_text", "answer", "program"],
        make,
        "row_id bigint, field string, row_idx int, col_idx int, metric string, quantity string, recorded string, unit string, stated_by string, common_unit string, amount bigint, exact boolean, residual double, unique boolean",
        8192,
    )
    common = F.create_map(*[F.lit(x) for kv in COMMON.items() for x in kv])
    return out.withColumn("converted", F.col("unit") != common[F.col("quantity")])
