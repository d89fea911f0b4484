"""The arithmetic program language: parsing, execution over tables, unit propagation, checks and induction.

A program is ARRAY<STRING> of steps ``op(a, b)``; ``#n`` is the result of step n, ``const_x`` a constant. Programs are
executed by a fold over their steps within the row, so thousands of programs a second run without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import expressions as X
from tallyforge.operators import table_ops as T

# Named constants of the language.
CONSTANTS = {"m1": -1, "m2": -2, "m3": -3, "m4": -4, "m5": -5, "pi": 3.14159265, "e": 2.71828183}
SCALAR_OPS = ("add", "subtract", "multiply", "divide", "greater", "exp")
TABLE_OPS = ("table_sum", "table_average", "table_max", "table_min")


def split_program(text: str) -> str:
    """A program sent as one text, cut after each closing bracket that a comma follows."""
    return f"filter(transform(split({text}, r'(?<=\\)),\\s+'), s -> trim(s)), s -> s <> '')"


def steps(program: str = "program") -> str:
    """Array of (op, args, raw); lines that aren't calls are left out."""
    whole = f"if(size({program}) = 1, {split_program(f'{program}[0]')}, {program})"
    made = r"named_struct('op', regexp_extract(trim(s), r'^(\w+)\((.+)\)', 1), 'args', transform(split(regexp_extract(trim(s), r'^(\w+)\((.+)\)', 2), ','), a -> trim(a)), 'raw', trim(s))"
    return f"filter(transform({whole}, s -> {made}), s -> s.op <> '')"


def argument(a: str) -> str:
    """struct(kind, step, num): reference, constant, table_ref, number or string (whose number is 0)."""
    constants = " ".join(f"when 'const_{k}' then {v}D" for k, v in CONSTANTS.items())
    number = X.financial_number("a")
    form = (
        f"case when startswith(a, '#') then named_struct('kind', 'reference', 'step', try_cast(substr(a, 2) as int), 'num', cast(null as double)) "
        f"when startswith(a, 'const_') then named_struct('kind', 'constant', 'step', cast(null as int), 'num', coalesce(case a {constants} end, {X.financial_number('substr(a, 7)')}, 0D)) "
        f"when startswith(a, 'table_') then named_struct('kind', 'table_ref', 'step', cast(null as int), 'num', 0D) "
        f"when {number} is not null then named_struct('kind', 'number', 'step', cast(null as int), 'num', {number}) "
        f"else named_struct('kind', 'string', 'step', cast(null as int), 'num', 0D) end"
    )
    return f"transform(array({a}), a -> {form})[0]"


def parsed(ready: DataFrame) -> DataFrame:
    """``prepared`` rows with code: array of (op, args as argument structs, label, nums), nums of a table step's row or column.

    A table step reads the row its first text argument other than 'none' names, else the column, else its literal numbers.
    """
    staged = ready.withColumn("_steps", F.expr(steps()))
    staged = staged.withColumn("_code", F.expr(f"transform(_steps, s -> named_struct('op', s.op, 'raw', s.raw, 'text', s.args, 'args', transform(s.args, a -> {argument('a')})))"))
    label = "lower(get(filter(transform(s.args, (x, i) -> if(x.kind = 'string' and lower(s.text[i]) <> 'none', s.text[i], null)), x -> x is not null), 0))"
    staged = staged.withColumn("_code", F.expr(f"transform(_code, s -> named_struct('op', s.op, 'raw', s.raw, 'args', s.args, 'label', if(startswith(s.op, 'table_'), {label}, null)))"))
    found = f"transform(array(named_struct('r', {T.row_values('s.label')}, 'c', {T.column_values('s.label')})), f -> if(size(f.r) > 0, f.r, f.c))[0]"
    nums = f"case when not startswith(s.op, 'table_') then cast(array() as array<double>) when s.label is not null and size({T.TABLE}) > 0 then {found} else transform(s.args, x -> coalesce(x.num, 0D)) end"
    return staged.withColumn("code", F.expr(f"transform(_code, s -> named_struct('op', s.op, 'raw', s.raw, 'args', s.args, 'label', s.label, 'nums', {nums}))")).drop("_steps", "_code")


_VALUE = "struct<num: double, str: string, unit: string, ok: boolean, warn: int, a: double, b: double>"


def executed(ready: DataFrame) -> DataFrame:
    """``parsed`` rows with trace (a struct per step), result_num, result_str and success.

    Division by zero gives infinity; ``greater`` gives yes or no; one argument is the identity; a table step over nothing
    gives 0; a missing reference or arithmetic on yes/no fails the program. Programs without a step, or null, don't succeed.
    Units: add and subtract keep the first operand's, divide makes a ratio (warned above 1000), times 100 a percentage
    (warned outside -200 to 10000), other products are scaled.
    """
    ref = "get(acc, {0}.step)"

    def value(i: int) -> str:
        x = f"get(s.args, {i})"
        return f"if({x}.kind = 'reference', {ref.format(x)}.num, {x}.num)"

    def unit(i: int) -> str:
        x = f"get(s.args, {i})"
        return f"if({x} is null, null, if({x}.kind = 'reference', coalesce({ref.format(x)}.unit, 'unknown'), 'scalar'))"

    total = "aggregate(s.nums, 0D, (t, v) -> t + v)"
    compute = (
        "case when s.op = 'table_sum' then " + total + " "
        f"when s.op = 'table_average' then if(size(s.nums) = 0, 0D, {total} / greatest(size(s.nums), 1)) "
        "when s.op = 'table_max' then coalesce(array_max(s.nums), 0D) when s.op = 'table_min' then coalesce(array_min(s.nums), 0D) "
        "when size(s.args) = 0 then 0D when size(s.args) = 1 then o.a "
        "when s.op = 'add' then o.a + o.b when s.op = 'subtract' then o.a - o.b when s.op = 'multiply' then o.a * o.b "
        "when s.op = 'divide' then if(o.b = 0, double('Infinity'), o.a / if(o.b = 0, 1D, o.b)) "
        "when s.op = 'exp' then power(o.a, o.b) when s.op = 'greater' then null else o.a end"
    )
    bad = "exists(s.args, x -> x.kind = 'reference' and (x.step is null or x.step >= size(acc) or get(acc, x.step).str is not null)) or exists(acc, v -> not v.ok)"
    known = "filter(array(o.ua, o.ub), u -> not u in ('scalar', 'unknown'))"
    hundred = "(abs(o.a - 100) < 1e-6D or abs(o.b - 100) < 1e-6D)"
    units = f"case when s.op in ('add', 'subtract') then coalesce(get({known}, 0), 'scalar') when s.op = 'divide' then 'ratio' when s.op = 'multiply' then if(coalesce({hundred}, false), 'percentage', 'scaled') when startswith(s.op, 'table_') then 'scalar' else coalesce(o.ua, 'unknown') end"
    warn = f"case when s.op in ('add', 'subtract') and size(array_distinct({known})) > 1 then 1 when s.op = 'divide' and abs(r) > 1000 then 1 when s.op = 'multiply' and coalesce({hundred}, false) and not r between -200 and 10000 then 1 else 0 end"
    made = (
        f"transform(array(named_struct('a', {value(0)}, 'b', {value(1)}, 'ua', {unit(0)}, 'ub', {unit(1)})), o -> transform(array(cast({compute} as double)), r -> "
        f"cast(named_struct('num', r, 'str', if(s.op = 'greater' and size(s.args) > 1, if(o.a > o.b, 'yes', 'no'), null), 'unit', {units}, 'ok', not ({bad}), 'warn', {warn}, 'a', o.a, 'b', o.b) as {_VALUE}))[0])[0]"
    )
    fold = f"aggregate(code, cast(array() as array<{_VALUE}>), (acc, s) -> concat(acc, array({made})))"
    staged = parsed(ready).withColumn("trace", F.expr(f"if(code is null, cast(array() as array<{_VALUE}>), {fold})"))
    return staged.select(
        "*",
        F.expr("size(trace) > 0 and try_element_at(trace, -1).ok").alias("success"),
        F.expr("if(try_element_at(trace, -1).ok, try_element_at(trace, -1).num, null)").alias("result_num"),
        F.expr("if(try_element_at(trace, -1).ok, try_element_at(trace, -1).str, null)").alias("result_str"),
    )


def dimensional(question: str = "question") -> str:
    """Reason why a trace looks dimensionally wrong, or 'ok': a product by 100 of no ratio, a ratio over 1000 before it, or a large negative difference without a word of change."""
    q = f"lower({question})"
    last = "size(code) - 1"
    by100 = "(abs(t.a - 100) < 1e-6D) <> (abs(t.b - 100) < 1e-6D)"
    other = "if(abs(t.a - 100) < 1e-6D, t.b, t.a)"
    flags = (
        f"transform(trace, (t, i) -> case when t.num is null then 0 when code[i].op = 'multiply' and i = {last} and coalesce({by100}, false) and abs({other}) > 1000 then 1 "
        "when code[i].op = 'divide' and abs(t.num) > 1000 and get(code, i + 1).op = 'multiply' and coalesce(abs(get(trace, i + 1).a - 100) < 1e-6D or abs(get(trace, i + 1).b - 100) < 1e-6D, false) then 2 "
        f"when code[i].op = 'subtract' and t.num < 0 and {q} rlike 'revenue|asset|income|sales|profit' and not {q} rlike 'change|increase|decrease|growth|decline' and greatest(abs(t.a), abs(t.b)) > 0 and abs(t.num) / greatest(abs(t.a), abs(t.b)) > 0.5 then 3 else 0 end)"
    )
    first = f"get(filter({flags}, f -> f > 0), 0)"
    return f"case {first} when 1 then 'multiply by 100' when 2 then 'ratio before multiply' when 3 then 'negative difference' else 'ok' end"


# How questions ask for an operation, in order of precedence.
OPERATIONS = [
    ("margin", r"\b(?:net\s+(?:profit\s+)?margin|gross\s+margin|operating\s+margin|profit\s+margin|ebit\s+margin|ebitda\s+margin|effective\s+tax\s+rate|tax\s+rate|expense\s+ratio|cost\s+ratio|payout\s+ratio|return\s+on\s+(?:equity|assets|investment|capital|sales)|(?:as\s+a\s+)?percent(?:age)?\s+of\s+(?:revenue|sales|net\s+revenue|total))\b"),
    ("pct_of", r"(?:percent(?:age)?|portion|share|fraction)\s+of\b|as a percent(?:age)?\s+of|what (?:percent|percentage|portion|share|fraction)\s+(?:of|is|was|are|were|did)"),
    ("pct_change", r"(?:percentage|percent|%)\s*(?:change|increase|decrease|growth|decline|difference|rise|drop|reduction|improvement|gain|loss)"),
    ("what_pct", r"what (?:is|was|were|are)\s+the\s+(?:percentage|percent)\b"),
    ("greater", r"(?:greater|more|larger|higher|bigger|less|lower|smaller|exceed)\s+than|(?:is|was|were)\s+.+?\s+(?:greater|more|less|higher|lower)\s+than"),
    ("add", r"(?:\btotal\b|\bsum\b|combined|aggregate|altogether|in total|cumulative)\b"),
    ("table_agg", r"\b(?:average|mean)\b"),
    ("divide", r"\b(?:ratio\b|divided\s+by|proportion|times\b|multiplied)\b"),
    ("subtract", r"(?:change|difference|increase|decrease|decline|growth|net change|how much (?:did|more|less|higher|lower|greater|was)|by how much|what was the .+? (?:increase|decrease|change|growth|decline))"),
]
NOT_SUM = r"percent(?:age)?\s+of|as\s+a\s+(?:percent|share|fraction)"
CHANGE_WORDS = r"\b(?:change|increase|decrease|growth|decline|rise|drop)\b"


def operation(question: str = "question") -> str:
    """The operation a question asks for; the first kind that fits wins, 'unknown' if none does."""
    q = f"lower(trim({question}))"
    whens = []
    for name, pattern in OPERATIONS:
        test = f"{q} rlike {X.quoted(pattern)}"
        if name == "what_pct":
            whens += [f"when {test} and {q} rlike {X.quoted(CHANGE_WORDS)} then 'pct_change'", f"when {test} then 'pct_of'"]
        elif name == "add":
            whens.append(f"when {test} and not {q} rlike {X.quoted(NOT_SUM)} then 'add'")
        else:
            whens.append(f"when {test} then '{name}'")
    return f"(case {' '.join(whens)} else 'unknown' end)"


def induced(examples: DataFrame, context: str = "cast(null as string)") -> DataFrame:
    """``examples`` with op and induced: the operation a question asks for and the program that rules make of it, or null.

    The operation named by the question picks the operands: margin rows, part and total, the values of two years, or a
    single value; where it can't be served, a difference over the years at hand, a lookup, or numbers of the question.
    """
    q = "asked"

    def text(v: str) -> str:
        return f"regexp_replace(regexp_replace(cast(cast({v} as decimal(30, 6)) as string), r'0+$', ''), r'\\.$', '')"

    def call(op: str, a: str, b: str) -> str:
        return f"concat('{op}(', {text(a)}, ', ', {text(b)}, ')')"

    def share(a: str, b: str) -> str:
        return f"array({call('divide', a, b)}, 'multiply(#0, const_100)')"

    def growth(a: str, b: str) -> str:
        return f"array({call('subtract', a, b)}, concat('divide(#0, ', {text(b)}, ')'), 'multiply(#1, const_100)')"

    lo, hi = "if(abs(two.v_new) > abs(two.v_old), two.v_old, two.v_new)", "if(abs(two.v_new) > abs(two.v_old), two.v_new, two.v_old)"
    p, t = "if(abs(part.part) > abs(part.total) and part.total <> 0, part.total, part.part)", "if(abs(part.part) > abs(part.total) and part.total <> 0, part.part, part.total)"
    down = f"{q} rlike 'decrease|decline|drop|loss|reduction|fell|lower'"
    average = r"regexp_extract(lower(trim(question)), r'(?:average|mean)\s+(?:of|for|in|value\s+of)\s+(.+?)(?:\s*\?|$)', 1)"
    column = r"regexp_extract(lower(trim(question)), r'total\s+(?:of\s+)?(.+?)(?:\s*\?|$)', 1)"
    found = "two.source in ('years', 'years reversed', 'header')"
    by_op = (
        f"case when op = 'margin' and margin is not null then {share('margin.numerator', 'margin.denominator')} "
        f"when op in ('pct_of', 'margin') and part is not null then {share(p, t)} "
        f"when op in ('pct_of', 'margin') and two is not null and {hi} <> 0 then {share(lo, hi)} "
        f"when op = 'pct_change' and two.v_old <> 0 then {growth('two.v_new', 'two.v_old')} "
        f"when op = 'subtract' and two is not null then if({down}, array({call('subtract', 'two.v_old', 'two.v_new')}), array({call('subtract', 'two.v_new', 'two.v_old')})) "
        f"when op = 'add' and two is not null then array({call('add', 'two.v_new', 'two.v_old')}) "
        f"when op = 'add' and size({T.TABLE}) > 0 and {column} <> '' then array(concat('table_sum(', {column}, ', none)')) "
        f"when op = 'table_agg' and size({T.TABLE}) > 0 and {average} <> '' then array(concat('table_average(', {average}, ', none)')) "
        f"when op = 'divide' and two.v_old <> 0 then array({call('divide', 'two.v_new', 'two.v_old')}) "
        f"when op = 'divide' and part.total <> 0 then array({call('divide', 'part.part', 'part.total')}) "
        f"when op = 'divide' and same.b <> 0 then array({call('divide', 'same.a', 'same.b')}) "
        f"when op = 'greater' and two is not null then array({call('greater', 'two.v_new', 'two.v_old')}) "
        f"when {found} and {q} rlike 'percentage|percent|%' and two.v_old <> 0 then {growth('two.v_new', 'two.v_old')} "
        f"when {found} and {q} rlike r'ratio|divided|per\\b|times|proportion' and two.v_old <> 0 then array({call('divide', 'two.v_new', 'two.v_old')}) "
        f"when {found} and {q} rlike 'total|sum|combined|and' then array({call('add', 'two.v_new', 'two.v_old')}) "
        f"when {found} then array({call('subtract', 'two.v_new', 'two.v_old')}) "
        f"when single is not null and {q} rlike r'(?:what (?:is|was|were|are)|how (?:much|many))\\b' and not {q} rlike 'change|difference|increase|decrease|percentage|percent|ratio|growth|decline|total|sum|average|compared|more|less' then array(concat('add(', {text('single')}, ', const_0)')) "
        f"when two.source = 'question' then array({call('subtract', 'two.v_new', 'two.v_old')}) end"
    )
    found_all = T.looked_up(
        f"named_struct('two', {T.two_values(context)}, 'part', {T.part_of_total()}, 'margin', {T.margin_values()}, 'same', {T.same_row_values()}, 'single', {T.single_value()})"
    )
    bound = [("s", "_found"), *((n, f"s.{n}") for n in ("two", "part", "margin", "same", "single")), ("asked", "lower(trim(question))"), ("op", operation())]
    out = examples.withColumn("_found", F.expr(found_all)).withColumn("_i", F.expr(X.lets(bound, f"named_struct('op', op, 'program', {by_op})")))
    return out.select("*", F.col("_i.op").alias("op"), F.col("_i.program").alias("induced")).drop("_i", "_found")


def majority(values: str, tolerance: float = 0.01) -> str:
    """The first member of the largest cluster of an array of (x, n), numbers and how often they stand; a member is within the tolerance of its cluster's first.

    Equal numbers always meet the same cluster, so they may be counted before.
    """
    near = f"if(abs(c.ref) < 1e-9D, abs(v.x) < 1e-9D, abs(c.ref - v.x) / abs(c.ref) < {tolerance}D)"
    hit = f"get(filter(transform(acc, (c, i) -> if({near}, i, null)), i -> i is not null), 0)"
    put = f"if({hit} is null, concat(acc, array(named_struct('ref', v.x, 'n', cast(v.n as bigint)))), transform(acc, (c, i) -> if(i = {hit}, named_struct('ref', c.ref, 'n', c.n + v.n), c)))"
    clusters = f"aggregate(filter({values}, v -> v.x is not null), cast(array() as array<struct<ref: double, n: bigint>>), (acc, v) -> {put})"
    return f"transform(array({clusters}), k -> get(filter(k, c -> c.n = array_max(transform(k, x -> x.n))), 0).ref)[0]"


def constrained(raw: str, most: int = 6) -> str:
    """The valid steps at the start of a model's output: known operations, right number of arguments, numbers or earlier steps."""
    ops = "|".join((*SCALAR_OPS, *TABLE_OPS))
    found = f"slice(filter(transform(regexp_extract_all(lower({raw}), r'([a-z_]+\\([^\\n)]*\\))', 1), s -> regexp_replace(s, r'\\s+', '')), s -> s rlike r'^(?:{ops})\\(' and length(replace(s, '(', '')) = length(replace(s, ')', ''))), 1, {most})"
    args = r"split(regexp_extract(s, r'^[a-z_]+\((.+)\)$', 1), ',')"
    good = f"(a rlike r'^#\\d+$' and try_cast(substr(a, 2) as int) < i) or (not startswith(a, '#') and ({X.financial_number('a')} is not null or a rlike r'^-?\\d[\\d,.]*%?$'))"
    valid = f"regexp_extract(s, r'^[a-z_]+\\((.+)\\)$', 1) <> '' and (not s rlike r'^(?:{'|'.join(SCALAR_OPS)})\\(' or size({args}) = 2) and forall({args}, a -> {good})"
    flags = f"transform({found}, (s, i) -> named_struct('s', s, 'ok', {valid}))"
    return f"transform(array({flags}), f -> transform(slice(f, 1, coalesce(nullif(array_position(transform(f, x -> x.ok), false), 0) - 1, size(f))), x -> x.s))[0]"


def pot_prompt(question: str = "question", table: str = T.TABLE, context: str = "array_join(pre_text, ' ')") -> str:
    """Prompt that asks a model for a program of thought."""
    return f"concat('Answer the question by a short Python program that sets answer.\\n\\nTable:\\n', {T.markdown(table)}, '\\n\\nText:\\n', left(coalesce({context}, ''), 2000), '\\n\\nQuestion: ', {question}, '\\n')"
