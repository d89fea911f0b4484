"""Table operators: cell typing, profiles, linearisation, relevance and value lookup.

A table is ARRAY<ARRAY<STRING>> with its header in row 0 and labels in column 0; rows may be short. Lookups are
higher-order expressions over the row that holds the table, so they need neither explode nor shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import expressions as X

TABLE = "table_cells"

# Names of model variables and the labels they go by, in order of precedence.
ALIASES = [
    ("revenue", ["revenue", "total revenue", "net revenue", "sales", "total sales"]),
    ("input_costs", ["cost of goods sold", "cogs", "cost of revenue", "cost of sales", "input costs"]),
    ("gross_profit", ["gross profit", "gross margin", "gross income"]),
    ("operating_income", ["operating income", "operating profit", "income from operations"]),
    ("net_income", ["net income", "net profit", "net earnings", "profit"]),
    ("eps", ["eps", "earnings per share", "diluted eps"]),
    ("interest_expense", ["interest expense", "interest cost", "finance costs"]),
    ("depreciation", ["depreciation", "depreciation and amortization", "d&a"]),
    ("sga_expense", ["sga", "sg&a", "selling general", "operating expenses"]),
    ("debt", ["total debt", "long-term debt", "borrowings", "debt"]),
    ("capex", ["capex", "capital expenditure", "capital expenditures"]),
    ("tax_rate", ["tax rate", "effective tax rate"]),
    ("share_count", ["shares outstanding", "diluted shares", "share count", "weighted average shares"]),
    ("equity", ["total equity", "shareholders equity", "stockholders equity"]),
    ("total_assets", ["total assets"]),
]


def cells(examples: DataFrame) -> DataFrame:
    """(row_id, row_idx, col_idx, header, label, raw) of every body cell; null cells are empty text.

    Null tables, empty tables and header-only tables give no rows. One generate step, no shuffle.
    """
    rows = examples.select("row_id", F.expr(X.header_of(TABLE)).alias("head"), F.expr(f"explode({X.rows_of(TABLE)})").alias("row"))
    out = rows.select("row_id", "head", F.col("row.i").alias("row_idx"), F.expr(X.row_label("row.r")).alias("label"), F.posexplode("row.r").alias("col_idx", "cell"))
    return out.select("row_id", "row_idx", "col_idx", F.expr("coalesce(get(head, col_idx), '')").alias("header"), "label", F.expr(X.cell_text("cell")).alias("raw"))


def typed_cells(examples: DataFrame) -> DataFrame:
    """``cells`` with cell_type and num (null for text, dates and empty cells)."""
    c = cells(examples).withColumn("cell_type", F.expr(X.cell_type("raw")))
    return c.withColumn("num", F.expr(f"case when cell_type in ('numeric','percentage','currency') then {X.financial_number('raw')} end"))


def profile(examples: DataFrame) -> DataFrame:
    """A row per table column: dominant type, flags, unit and range.

    dominant_type follows the published rule (numeric if any plain number, else text if any text, else empty);
    corrected_type also counts currency and percentage cells as numeric. Aggregates of a table stay in one group of its
    row_id and column, so the shuffle carries partial sums only.
    """
    t = typed_cells(examples)
    agg = t.groupBy("row_id", "col_idx", "header").agg(
        F.max((F.col("cell_type") == "numeric").cast("int")).alias("has_numeric"),
        F.max((F.col("cell_type") == "text").cast("int")).alias("has_text"),
        F.count("num").alias("num_count"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
        F.round(F.avg("num"), 6).alias("mean"),
        F.round(F.sum("num"), 4).alias("sum"),
    )
    kind = "case when has_numeric = 1 then 'numeric' when has_text = 1 then 'text' else 'empty' end"
    return agg.select(
        "row_id",
        "col_idx",
        "header",
        F.expr(kind).alias("dominant_type"),
        F.expr("case when num_count > 0 then 'numeric' when has_text = 1 then 'text' else 'empty' end").alias("corrected_type"),
        F.expr(X.is_temporal("header")).alias("is_temporal"),
        F.expr(f"col_idx = 0 and ({kind}) = 'text'").alias("is_label"),
        "num_count",
        F.expr(f"{X.header_unit('header')}.label").alias("unit_label"),
        F.expr(f"{X.header_unit('header')}.scale").alias("unit_scale"),
        "min",
        "max",
        "mean",
        "sum",
    )


def linearize_tagged(table: str = TABLE) -> str:
    """'[H] …' and a line '[R1] [C]$1 | …' per row, each cell tagged with the first letter of its type."""
    tag = f"concat('[', upper(left({X.cell_type('v')}, 1)), ']', {X.cell_text('v')})"
    body = f"transform({X.rows_of(table)}, x -> concat('[R', x.i, '] ', array_join(transform(x.r, v -> {tag}), ' | ')))"
    return f"array_join(concat(array(concat('[H] ', array_join({X.header_of(table)}, ' | '))), {body}), '\\n')"


def linearize_html(table: str = TABLE) -> str:
    head = f"array_join(transform({X.header_of(table)}, h -> concat('<th>', h, '</th>')), '')"
    body = f"array_join(transform({X.rows_of(table)}, x -> concat('<tr>', array_join(transform(x.r, v -> concat('<td>', {X.cell_text('v')}, '</td>')), ''), '</tr>')), '')"
    return f"concat('<table><thead><tr>', {head}, '</tr></thead><tbody>', {body}, '</tbody></table>')"


def _pairs(table: str, pattern: str, blanks: str, first: int) -> str:
    """Per row, its label and the non-blank cells from column ``first`` written by ``pattern`` of h (header) and v (text)."""
    value = X.cell_text("v")
    made = f"filter(transform(x.r, (v, j) -> if(j < {first} or {value} in ('', {blanks}), null, {pattern.replace('{h}', f'coalesce(get({X.header_of(table)}, j), concat(\'col\', j))').replace('{v}', value)})), p -> p is not null)"
    return f"transform({X.rows_of(table)}, x -> named_struct('i', x.i, 'label', {X.cell_text('get(x.r, 0)')}, 'pairs', {made}))"


def linearize_structured(table: str = TABLE) -> str:
    """'row "L" : col "H" = v , …' for every row with a value."""
    pairs = _pairs(table, "concat('col \"', {h}, '\" = ', {v})", "'-', '—', 'n/a'", 1)
    return f"array_join(transform(filter({pairs}, p -> size(p.pairs) > 0), p -> concat('row \"', p.label, '\" : ', array_join(p.pairs, ' , '))), ' ; ')"


def row_docs(examples: DataFrame) -> DataFrame:
    """(row_id, row_index, text) of one document per table row: 'label - header: value, …'."""
    pairs = _pairs(TABLE, "concat({h}, ': ', {v})", "'-', '—'", 0)
    d = examples.select("row_id", F.expr(f"explode(filter({pairs}, p -> size(p.pairs) > 0))").alias("p"))
    return d.select("row_id", F.col("p.i").alias("row_index"), F.expr("concat(p.label, ' - ', array_join(p.pairs, ', '))").alias("text"))


def summary(table: str = TABLE) -> str:
    """Columns, up to 15 row labels, periods, and the range of up to four numeric columns."""
    head = X.header_of(table)
    labels = f"array_join(transform(slice({X.rows_of(table)}, 1, 15), x -> {X.cell_text('get(x.r, 0)')}), ', ')"
    periods = f"filter({head}, h -> {X.is_temporal('h')})"
    kinds = f"transform({X.rows_of(table)}, x -> {X.cell_type('get(x.r, j)')})"
    nums = f"filter(transform({X.rows_of(table)}, x -> if({X.cell_type('get(x.r, j)')} in ('numeric','percentage','currency'), {X.financial_number('get(x.r, j)')}, null)), v -> v is not null)"
    label_column = f"(j = 0 and not array_contains({kinds}, 'numeric') and array_contains({kinds}, 'text'))"
    columns = f"slice(filter(transform({head}, (h, j) -> named_struct('h', h, 'n', {nums}, 'label', {label_column})), c -> size(c.n) > 0 and not c.label), 1, 4)"
    mean = "aggregate(c.n, 0D, (s, v) -> s + v) / size(c.n)"
    ranges = f"transform({columns}, c -> format_string('%s: range [%.2f, %.2f], mean=%.2f', c.h, array_min(c.n), array_max(c.n), {mean}))"
    parts = f"concat(array(concat('Table columns: ', array_join({head}, ', '))), if(size({table}) > 1, array(concat('Row items: ', {labels})), array()), if(size({periods}) > 0, array(concat('Time periods: ', array_join({periods}, ', '))), array()), {ranges})"
    return f"array_join({parts}, ' | ')"


def table_docs(examples: DataFrame) -> DataFrame:
    """(row_id, type, row_index, text): summary, structured form and row documents of every table."""
    t = examples.filter(f"size({TABLE}) > 0")
    one = t.select("row_id", F.expr(f"explode(array(named_struct('type', 'table_summary', 'text', {summary()}), named_struct('type', 'table_structured', 'text', {linearize_structured()})))").alias("d"))
    return one.select("row_id", "d.type", F.lit(None).cast("int").alias("row_index"), "d.text").unionByName(row_docs(t).select("row_id", F.lit("table_row").alias("type"), "row_index", "text"))


def markdown(table: str = TABLE, most: int = 30) -> str:
    """A table as text with rows padded or cut to the header's width, at most ``most`` rows shown."""
    width = f"size({table}[0])"
    line = f"concat('| ', array_join(transform(sequence(0, {width} - 1), j -> coalesce(get(r, j), if(j < size(r), 'None', ''))), ' | '), ' |')"
    body = f"transform(slice({table}, 2, {most}), r -> {line})"
    head = f"concat('| ', array_join(transform({table}[0], h -> coalesce(h, 'None')), ' | '), ' |'), concat('| ', array_join(transform({table}[0], h -> '---'), ' | '), ' |')"
    more = f"if(size({table}) > {most + 1}, array(concat('... (', size({table}) - {most + 1}, ' more rows)')), array())"
    return f"if({table} is null or size({table}) = 0 or coalesce(size({table}[0]), 0) = 0, 'No table data available.', array_join(concat(array({head}), {body}, {more}), '\\n'))"


def cell_positions(dim: int = 8) -> str:
    """Sinusoidal position of a cell (row_idx, col_idx): d mod 4 picks the sine or cosine of row or column."""
    return (
        f"transform(sequence(0, {dim - 1}), d -> case d % 4 when 0 then sin(row_idx / power(10000D, d / {dim}D)) when 1 then cos(row_idx / power(10000D, d / {dim}D)) "
        f"when 2 then sin(col_idx / power(10000D, d / {dim}D)) else cos(col_idx / power(10000D, d / {dim}D)) end)"
    )


def place_cells(vectors: DataFrame, dim: int, weight: float = 0.1) -> DataFrame:
    """Cell embeddings (row_idx, col_idx, embedding) with their position added and scaled to length 1."""
    moved = f"zip_with(embedding, {cell_positions(dim)}, (a, b) -> a + {weight}D * b)"
    norm = "sqrt(aggregate(moved, 0D, (s, v) -> s + v * v))"
    return vectors.withColumn("moved", F.expr(moved)).withColumn("embedding", F.expr(f"transform(moved, v -> v / greatest({norm}, 1e-10D))")).drop("moved")


# Relevance

def row_relevance(question: str = "question", table: str = TABLE) -> str:
    """Array of (score, row_index) of the rows that have to do with the question, best first, at most five."""
    text = f"array_join(transform(x.r, v -> lower({X.cell_text('v')})), ' ')"
    numbers = r"array_distinct(regexp_extract_all({0}, r'[0-9]+\.?[0-9]*', 0))"
    words = X.words3(question)
    score = (
        f"0.3D * size(array_intersect({words}, {X.words3(text)})) + 0.5D * size(array_intersect({numbers.format(question)}, {numbers.format(text)})) "
        f"+ if(exists({words}, w -> length(w) > 3 and contains({X.row_label('x.r')}, w)), 0.4D, 0D)"
    )
    scored = f"filter(transform({X.rows_of(table)}, x -> named_struct('score', round({score}, 6), 'at', -x.i)), s -> s.score > 0)"
    return f"transform(slice(reverse(array_sort({scored})), 1, 5), s -> named_struct('row_index', -s.at, 'score', s.score))"


def column_relevance(question: str = "question", table: str = TABLE) -> str:
    """Array of (col_index, score) likewise; a year counts only where the header holds that whole year."""
    words = X.words3(question)
    asked = f"lower({question}) rlike r'\\b(?:year|quarter|trend|change|growth)\\b'"
    score = (
        f"0.4D * size(array_intersect({words}, {X.words3('h')})) + if({X.is_temporal('h')} and {asked}, 0.3D, 0D) "
        f"+ if(exists(regexp_extract_all({question}, r'((?:19|20)[0-9]{{2}})', 1), y -> contains(h, y)), 0.5D, 0D)"
    )
    scored = f"filter(transform({X.header_of(table)}, (h, i) -> named_struct('score', round({score}, 6), 'at', -i)), s -> s.score > 0)"
    return f"transform(slice(reverse(array_sort({scored})), 1, 5), s -> named_struct('col_index', -s.at, 'score', s.score))"


def subtable(question: str = "question", table: str = TABLE, rows: int = 10, columns: int = 8) -> str:
    """The header row and label column with the relevant rows and columns; the first ones where none is relevant."""
    picked_rows = f"transform({row_relevance(question, table)}, s -> s.row_index)"
    picked_cols = f"filter(transform({column_relevance(question, table)}, s -> s.col_index), c -> c <> 0)"
    r = f"if(size({picked_rows}) = 0, sequence(0, least(size({table}), {rows + 1}) - 1), slice(array_sort(concat(array(0), {picked_rows})), 1, {rows + 1}))"
    c = f"if(size({picked_cols}) = 0, sequence(0, greatest(least(size({table}[0]), {columns}) - 1, 0)), slice(array_sort(concat(array(0), {picked_cols})), 1, {columns}))"
    return f"case when {table} is null or size({table}) < 2 then coalesce({table}, array()) else transform({r}, i -> transform({c}, j -> coalesce(get(get({table}, i), j), ''))) end"


# Lookups


def prepared(examples: DataFrame) -> DataFrame:
    """``examples`` with what the lookups share, each parsed once a row: head, body, ys, hy and kw.

    head: lower-case headers; body: data rows as (i from 1, label in lower case, n: number of each cell or null);
    ys: years of the question in written order; hy: distinct years of the header; kw: the question's keywords.
    """
    return examples.select("*", *[F.expr(value).alias(name) for name, value in shared_parts()])


def shared_parts() -> list[tuple[str, str]]:
    """The names and values of ``prepared``, to be bound as columns or within an expression."""
    return [
        ("head", f"transform({X.header_of(TABLE)}, h -> lower(h))"),
        ("body", f"transform({X.rows_of(TABLE)}, x -> named_struct('i', x.i, 'label', {X.row_label('x.r')}, 'n', transform(x.r, v -> {X.financial_number('v')})))"),
        ("ys", question_years("question")),
        ("hy", header_years()),
        ("kw", X.keywords("question")),
    ]


def header_years(table: str = TABLE) -> str:
    return f"array_sort(array_distinct(flatten(transform({X.header_of(table)}, h -> regexp_extract_all(h, r'\\b((?:19|20)[0-9]{{2}})\\b', 1)))))"


def question_years(question: str = "question") -> str:
    """Years of a question in written order, with repetitions."""
    return f"regexp_extract_all({question}, r'\\b((?:19|20)[0-9]{{2}})\\b', 1)"


def column_of(text: str) -> str:
    """Index from 0 of the first header that contains ``text``; null if none. An expression over ``prepared`` rows, as all that follow."""
    return f"nullif(array_position(transform(head, h -> contains(h, {text})), true), 0) - 1"


def _numbers(n: str) -> str:
    return f"filter(slice({n}, 2, greatest(size({n}) - 1, 0)), v -> v is not null)"


def row_values(label: str) -> str:
    """Numbers of the row labelled ``label`` (lower case): the exact row, else the first whose label contains it or is contained."""
    found = f"coalesce(get(filter(body, x -> size(x.n) > 0 and x.label = {label}), 0), get(filter(body, x -> size(x.n) > 0 and (contains(x.label, {label}) or contains({label}, x.label))), 0))"
    return f"coalesce(transform(array({found}), f -> {_numbers('f.n')})[0], array())"


def column_values(name: str) -> str:
    """Numbers of the column headed ``name`` (lower case): exact header, else the first containing it, else an index."""
    at = f"coalesce(nullif(array_position(head, {name}), 0) - 1, {column_of(name)}, try_cast({name} as int))"
    return f"coalesce(filter(flatten(transform(array({at}), c -> transform(body, x -> get(x.n, cast(c as int))))), v -> v is not null), array())"


def table_value(row: str, column: str) -> str:
    """Value at a row label and a header that contains ``column``: the exact label, else the shortest label containing it."""
    able = f"filter(body, x -> c < size(x.n) and contains(x.label, {row}))"
    best = f"array_min(transform({able}, x -> named_struct('other', x.label <> {row}, 'len', length(x.label), 'i', x.i, 'v', get(x.n, c)))).v"
    return f"transform(array(cast({column_of(column)} as int)), c -> {best})[0]"


def fuzzy_value(row: str, column: str) -> str:
    """Value by hints: the header equal to the column hint, else the one sharing most words; the first row that fits."""
    overlap = f"size(array_intersect(array_distinct(split({column}, r'\\s+')), array_distinct(split(h, r'\\s+'))))"
    scored = f"transform(head, (h, i) -> named_struct('s', if(h = {column}, 1000, if(contains(h, {column}) or contains({column}, h), {overlap}, 0)), 'at', -i))"
    best = f"filter(array(array_max({scored})), s -> s.s > 0)"
    value = f"get(get(filter(body, x -> -s.at < size(x.n) and (contains(x.label, {row}) or contains({row}, x.label))), 0).n, -s.at)"
    return f"get(transform({best}, s -> {value}), 0)"


def values_for_years(year1: str, year2: str) -> str:
    """struct(score, v1, v2) of the row that fits the keywords best and has numbers under both years; null if none has.

    Rows that fit equally come in table order; if none fits, the first total, net, gross, revenue or income row, else the
    first row.
    """
    score = "size(filter(kw, k -> contains(x.label, k))) + size(array_intersect(" + X.letters("x.label") + ", array_distinct(kw))) + 0.5D * size(filter(kw, k -> length(k) > 3 and contains(x.label, k)))"
    # at equal scores the order is by total rows, then by place, which the struct's fields give
    made = f"transform(filter(body, x -> get(x.n, c.a) is not null and get(x.n, c.b) is not null), x -> named_struct('score', cast({score} as double), 'total', if(x.label rlike 'total|net|gross|revenue|income', 1, 0), 'at', -x.i, 'v1', get(x.n, c.a), 'v2', get(x.n, c.b)))"
    best = f"transform(array(array_max({made})), m -> if(m is null, null, named_struct('score', m.score, 'v1', m.v1, 'v2', m.v2)))[0]"
    return f"transform(array(named_struct('a', cast({column_of(year1)} as int), 'b', cast({column_of(year2)} as int))), c -> {best})[0]"


def two_values(context: str = "cast(null as string)") -> str:
    """struct(v_new, v_old, source), or null.

    The last two years of the question, else its first two the other way, else the newest two of the header, else two
    numbers of the question (for tables of three rows or more), else two of the context.
    """

    def free(text: str) -> str:
        return f"filter({X.numbers(text)}, n -> not (n = floor(n) and array_contains(transform(ys, y -> cast(y as double)), n)))"

    two = (
        "case when last2 is not null then named_struct('v_new', last2.v1, 'v_old', last2.v2, 'source', 'years') "
        "when first2 is not null then named_struct('v_new', first2.v1, 'v_old', first2.v2, 'source', 'years reversed') "
        "when newest is not null then named_struct('v_new', newest.v1, 'v_old', newest.v2, 'source', 'header') "
        f"when size({TABLE}) >= 3 and size(written) >= 2 then named_struct('v_new', written[0], 'v_old', written[1], 'source', 'question') "
        "when size(around) >= 2 then named_struct('v_new', around[0], 'v_old', around[1], 'source', 'context') end"
    )
    return X.lets(
        [
            ("last2", f"if(size(ys) >= 2, {values_for_years('try_element_at(ys, -1)', 'try_element_at(ys, -2)')}, null)"),
            ("first2", f"if(size(ys) >= 2, {values_for_years('get(ys, 0)', 'get(ys, 1)')}, null)"),
            ("newest", f"if(size(ys) < 2 and size(hy) >= 2, {values_for_years('try_element_at(hy, -1)', 'try_element_at(hy, -2)')}, null)"),
            ("written", free("question")),
            ("around", free(f"coalesce({context}, '')")),
        ],
        two,
    )


CONTENT_STOP = "what was the is are were how much did in of for from to and a as percentage percent total due".split()
SAME_ROW_STOP = "what was the is are were how much did in of for from to and a as percentage percent average per ratio".split()


def _content(question: str, stop: list[str]) -> str:
    return f"array_except({X.letters(f'lower({question})')}, array({','.join(repr(w) for w in stop)}))"


def part_of_total() -> str:
    """struct(part, total) from two rows of one column, or null.

    The column is the one of the last year named, else a total column, else the first. The part is the row that fits
    best; the total is the first total row of another size, else the row named after 'of', else the runner-up.
    """
    by_total = "nullif(array_position(transform(head, (h, i) -> i > 0 and contains(h, 'total')), true), 0) - 1"
    by_year = column_of("try_element_at(ys, -1)")
    of = r"regexp_extract(lower(question), r'(?:percent(?:age)?|share|portion|fraction)\s+of\s+(.+?)(?:\s+(?:is|was|are|were|that|due)|\s*\?|$)', 1)"
    score = "-(size(array_intersect(" + X.letters("x.label") + ", words)) + 0.5D * size(filter(words, k -> contains(x.label, k))))"
    total = "get(filter(fit, s -> contains(s.l, 'total') and abs(s.v) <> abs(fit[0].v)), 0).v"
    shared = "size(array_intersect(" + X.letters("s.l") + ", aim))"
    named = f"array_max(transform(filter(fit, s -> abs(s.v) <> abs(fit[0].v) and {shared} > 0), s -> named_struct('m', {shared}, 's', -s.s, 'at', -s.i, 'v', s.v))).v"
    return X.lets(
        [
            ("at_year", f"cast({by_year} as int)"),
            ("place", f"cast(if(coalesce(at_year, 1) <> 1, at_year, coalesce({by_total}, 1)) as int)"),
            ("words", _content("question", CONTENT_STOP)),
            ("aim", _content(of, CONTENT_STOP)),
            ("fit", f"array_sort(transform(filter(body, x -> get(x.n, place) is not null), x -> named_struct('s', cast({score} as double), 'i', x.i, 'v', get(x.n, place), 'l', x.label)))"),
        ],
        f"if(size({TABLE}) >= 3 and size(fit) >= 2, named_struct('part', fit[0].v, 'total', coalesce({total}, {named}, fit[1].v)), null)",
    )


REVENUE_TERMS = "net revenue|total revenue|revenue|net sales|total sales|sales"


def margin_values() -> str:
    """struct(numerator, denominator), or null.

    The numerator is the row that fits the keywords best; the denominator the first row named after 'of', else the first
    revenue row, else the largest other row, of the same column.
    """
    known = f"get(filter(transform(reverse(ys), y -> {column_of('y')}), c -> c is not null), 0)"
    hint = r"regexp_extract(lower(question), r'(?:percent(?:age)?|margin|rate)\s+of\s+(.+?)(?:\s*\?|$|\s+in\b|\s+for\b)', 1)"
    score = "size(array_intersect(" + X.letters("x.label") + ", array_distinct(kw))) + 0.8D * size(filter(array_distinct(kw), k -> length(k) > 3 and contains(x.label, k)))"
    named = "get(filter(others, s -> size(array_intersect(" + X.letters("s.l") + ", hint)) > 0), 0).v"
    revenue = f"get(filter(others, s -> s.l rlike '{REVENUE_TERMS}'), 0).v"
    largest = "array_max(transform(others, s -> named_struct('a', abs(s.v), 'v', s.v))).v"
    return X.lets(
        [
            ("place", f"cast(if(size(ys) > 0, coalesce({known}, 1), coalesce({column_of('try_element_at(hy, -1)')}, 1)) as int)"),
            ("hint", X.letters(hint)),
            ("fit", f"transform(filter(body, x -> get(x.n, place) is not null), x -> named_struct('s', round(cast({score} as double), 6), 'at', -x.i, 'v', get(x.n, place), 'l', x.label))"),
            ("top", "array_max(fit)"),
            ("others", "filter(fit, s -> s.l <> top.l)"),
            ("below", f"coalesce({named}, {revenue}, {largest})"),
        ],
        f"if(size({TABLE}) >= 3 and size(fit) >= 2 and below <> 0, named_struct('numerator', top.v, 'denominator', below), null)",
    )


def same_row_values() -> str:
    """struct(a, b): the first two numbers of the row that shares most words with the question, or null."""
    score = "size(array_intersect(" + X.letters("x.label") + ", words))"
    best = f"array_max(filter(transform(body, x -> named_struct('s', {score}, 'at', -x.i, 'n', x.n)), s -> s.s > 0 and size(s.n) >= 3)).n"
    return X.lets(
        [("words", _content("question", SAME_ROW_STOP)), ("best", best), ("found", _numbers("best"))],
        "if(size(found) >= 2, named_struct('a', found[0], 'b', found[1]), null)",
    )


def single_value() -> str:
    """The value of the best row under the last year named, else under the last column with a number."""
    known = f"get(filter(transform(reverse(ys), y -> {column_of('y')}), c -> c is not null), 0)"
    numeric = "array_max(filter(sequence(0, size(head)), j -> j > 0 and j < size(head) and exists(body, x -> get(x.n, j) is not null)))"
    score = "size(array_intersect(" + X.letters("x.label") + ", array_distinct(kw))) + 0.5D * size(filter(kw, k -> contains(x.label, k)))"
    best = f"array_max(filter(transform(body, x -> named_struct('s', cast({score} as double), 'at', -x.i, 'fits', place < size(x.n), 'v', get(x.n, place))), s -> s.s > 0 and s.fits)).v"
    return X.lets([("place", f"cast(coalesce({known}, {numeric}) as int)")], best)


def looked_up(expression: str) -> str:
    """A lookup expression over the table and question columns of a row, with what it shares bound once."""
    return X.lets(shared_parts(), expression)


def alignment(text: str, table: str = TABLE) -> str:
    """struct(score, mismatched): share of the text's years that the header has; below one half, or without years, mismatched."""
    ty, hy = X.years(text), f"transform({header_years(table)}, y -> cast(y as int))"
    score = f"size(array_intersect({ty}, {hy})) / greatest(size({ty}), 1)"
    return f"named_struct('score', round({score}, 6), 'mismatched', {score} < 0.5)"


def _bare_float(x: str) -> str:
    return X.plain_float(f"translate({x}, ',$%', '')")


def observed_entries(table: str = TABLE) -> str:
    """Array of (var, val): the number under the last header of every row whose label an alias fits; its first variable counts."""
    names = " ".join(f"when l rlike {X.quoted('|'.join(aliases))} then '{v}'" for v, aliases in ALIASES)
    last = f"if(size({table}[0]) > 1, size({table}[0]) - 1, 1)"
    made = f"transform({X.rows_of(table)}, x -> named_struct('var', transform(array({X.row_label('x.r')}), l -> case {names} end)[0], 'val', {_bare_float(f'get(x.r, {last})')}))"
    return f"if(size({table}) >= 2, filter({made}, e -> e.var is not null and e.val is not null), array())"


def observed_variables(table: str = TABLE) -> str:
    """Map of model variable to value; of rows with one variable the last wins."""
    able = observed_entries(table)
    keys = f"array_distinct(transform({able}, e -> e.var))"
    return f"map_from_arrays({keys}, transform({keys}, k -> element_at(filter({able}, e -> e.var = k), -1).val))"


def table_series(keyword: str, table: str = TABLE) -> str:
    """Numbers of the first row whose label contains ``keyword`` under at least four year columns; null unless all parse."""
    cols = f"filter(transform({X.header_of(table)}, (h, i) -> if(h rlike r'(?:19|20)[0-9]{{2}}', i, null)), i -> i is not null)"
    found = f"get(filter({X.rows_of(table)}, x -> size(x.r) > 0 and contains({X.row_label('x.r')}, {keyword})), 0).r"
    values = f"transform({cols}, j -> {_bare_float(f'get({found}, j)')})"
    return f"if(size({table}) >= 3 and size({cols}) >= 4 and {found} is not null and not exists({values}, v -> v is null), {values}, null)"
