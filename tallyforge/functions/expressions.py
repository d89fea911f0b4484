"""Scalar functions on financial text as Catalyst SQL expressions: all of them stay inside code generation.

Every function takes SQL text of its argument and returns SQL text, so that it can stand in ``expr``, in a lambda of a
higher-order function, or in a query.
"""

from __future__ import annotations

# Words without meaning for a table lookup.
STOPWORDS = (
    "what was the is are were how much many did does in of for from to and or a an on by as at be it its this that "
    "between change percentage percent increase decrease difference compared during year years ended ending fiscal quarter period"
).split()

# Units written in column headers, in order of precedence.
HEADER_UNITS = [
    (r"\bin\s+billions?\b", "billion", 1e9),
    (r"\bin\s+millions?\b", "million", 1e6),
    (r"\bin\s+thousands?\b", "thousand", 1e3),
    (r"\bin\s+hundreds?\b", "hundred", 1e2),
    (r"\$\s*(?:in\s+)?billions?\b", "billion", 1e9),
    (r"\$\s*(?:in\s+)?millions?\b", "million", 1e6),
    (r"\$\s*(?:in\s+)?thousands?\b", "thousand", 1e3),
    (r"\bbn\b", "billion", 1e9),
    (r"\bmm\b|\bm\b", "million", 1e6),
    (r"\bk\b", "thousand", 1e3),
]

# Words that mark a question's kind, found anywhere in it.
NUMERICAL_WORDS = "percentage|percent|ratio|growth|increase|decrease|change|difference|total|sum|average|how much|how many|what was the|calculate|compute|net|margin|rate|proportion"
PROGRAM_WORDS = "add|subtract|multiply|divide|greater|exp|table_"
TEMPORAL_WORDS = (
    "year|quarter|month|period|fiscal|from|to|between|prior|previous|subsequent|trend|over time|growth rate|yoy|year-over-year|"
    "q1|q2|q3|q4|2018|2019|2020|2021|2022|2023|highest|lowest|most recent"
)
CAUSAL_WORDS = "why|cause|because|due to|result of|led to|driven by|attributed to|impact|effect|consequence|reason|factor|explain|what caused|what led"
LOOKUP_WORDS = "table|row|column|value of|what is the|what was the|list|which|how many items"

FLOAT = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def quoted(text: str) -> str:
    """A Spark SQL raw string literal."""
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"'


def lets(bindings: list[tuple[str, str]], body: str) -> str:
    """``body`` with names bound to values one after another.

    A bound name is evaluated once and stays one when the optimizer moves the expression, where a chain of columns would be
    substituted into each of its uses.
    """
    for name, value in reversed(bindings):
        body = f"transform(array({value}), {name} -> {body})[0]"
    return body


def blank_trim(x: str) -> str:
    return f"trim(translate({x}, '\\u00a0\\t\\n\\r', '    '))"


def parse_number(x: str) -> str:
    """Number of a text; a trailing percent sign divides by 100, brackets make it negative, nulls and non-numbers are null."""
    core = f"regexp_replace(regexp_replace({blank_trim(x)}, r'[$, ]', ''), r'^\\((.*)\\)$', '-$1')"
    digits = f"regexp_extract({core}, r'^({FLOAT})%?$', 1)"
    return f"(try_cast({digits} as double) / if(endswith({core}, '%'), 100D, 1D))"


def _financial_core(x: str) -> str:
    plain = f"trim(regexp_replace({blank_trim(x)}, r'[$€£¥,]', ''))"
    once = f"regexp_replace({plain}, r'^(-?\\s*[0-9.]+%?)\\s*\\(\\s*[0-9.]+\\s*%?\\s*\\)$', '$1')"
    return f"regexp_replace(replace({once}, ' ', ''), r'^\\((.*)\\)$', '-$1')"


def financial_number(x: str) -> str:
    """Number of a text with currency signs, thousands separators, brackets, the form '-13 ( 13 )', %, and a suffix k, m, b or t.

    A percent sign is dropped without dividing. Nulls and non-numbers are null.
    """
    core = _financial_core(x)
    pattern = f"r'^({FLOAT})([kKmMbBtT]?)%?$'"
    scale = f"case lower(regexp_extract({core}, {pattern}, 2)) when 'k' then 1e3D when 'm' then 1e6D when 'b' then 1e9D when 't' then 1e12D else 1D end"
    return f"(try_cast(regexp_extract({core}, {pattern}, 1) as double) * {scale})"


def header_unit(x: str) -> str:
    whens = " ".join(f"when {x} rlike {quoted('(?i)' + p)} then named_struct('label', '{u}', 'scale', {s:.1f}D)" for p, u, s in HEADER_UNITS)
    return f"(case {whens} else named_struct('label', 'raw', 'scale', 1.0D) end)"


def normalize_answer(x: str) -> str:
    return f"trim(translate(lower(trim(coalesce({x}, ''))), '%$,', ''))"


def plain_float(x: str) -> str:
    """Text as a float if it is nothing else."""
    return f"try_cast(regexp_extract({x}, r'^\\s*({FLOAT})\\s*$', 1) as double)"


def answers_match(predicted: str, gold: str, tolerance: float = 0.01) -> str:
    """Equal text, or numbers within the tolerance up to a factor of 100 and the sign, or yes/true and no/false alike."""
    p, g = normalize_answer(predicted), normalize_answer(gold)
    a, b = plain_float(p), plain_float(g)
    near = (
        f"case when {b} = 0 then abs({a}) < {tolerance}D else "
        f"abs({a} - {b}) / greatest(abs({b}), 1e-10D) < {tolerance}D "
        f"or ({a} <> 0 and (abs({a} / {b} - 100) / 100 < {tolerance}D or abs({a} / {b} - 0.01D) / 0.01D < {tolerance}D)) "
        f"or abs(abs({a}) - abs({b})) / greatest(abs({b}), 1e-10D) < {tolerance}D end"
    )

    def truth(v: str) -> str:
        return f"case {v} when 'yes' then 'true' when 'no' then 'false' else {v} end"

    booleans = f"({p} in ('yes','no','true','false') and {g} in ('yes','no','true','false') and {truth(p)} = {truth(g)})"
    return f"(case when {p} = {g} then true when {a} is not null and {b} is not null then {near} else {booleans} end)"


def years(x: str) -> str:
    """Distinct years 1900 to 2099 of a text, ascending."""
    return f"array_sort(array_distinct(transform(regexp_extract_all({x}, r'\\b((?:19|20)[0-9]{{2}})\\b', 1), y -> cast(y as int))))"


def numbers(x: str) -> str:
    """Numbers of a text in order."""
    found = f"regexp_extract_all({x}, r'[-+]?\\$?[0-9][0-9,]*\\.?[0-9]*%?', 0)"
    return f"filter(transform({found}, n -> {financial_number('n')}), n -> n is not null)"


def keywords(x: str) -> str:
    """Words of a question that may name a table row: no years, numbers, stop words or single letters."""
    plain = f"regexp_replace(regexp_replace(lower({x}), r'\\b[0-9]{{4}}\\b', ''), r'\\$?[0-9][0-9,.]*%?', '')"
    parts = f"transform(split({plain}, r'\\s+'), w -> regexp_replace(w, r'^[?.,!;:()]+|[?.,!;:()]+$', ''))"
    stop = ",".join(f"'{w}'" for w in STOPWORDS)
    return f"filter({parts}, w -> length(w) > 1 and not w in ({stop}))"


def words3(x: str) -> str:
    """Distinct runs of three or more letters a to z."""
    return f"array_distinct(regexp_extract_all(lower({x}), r'[a-z]{{3,}}', 0))"


def letters(x: str) -> str:
    return f"array_distinct(regexp_extract_all({x}, r'[a-z]+', 0))"


def sentences(x: str) -> str:
    return f"filter(split(trim({x}), r'(?<=[.!?])\\s+'), s -> s <> '')"


def clean_span(x: str) -> str:
    """A span with single spaces and without a leading article."""
    return f"regexp_replace(trim(regexp_replace({x}, r'\\s+', ' ')), r'(?i)^(?:the|a|an)\\s+', '')"


def format_significant(x: str, digits: int) -> str:
    """A positive or negative float rounded to so many significant digits, in plain notation below 10^digits."""
    unit = f"power(10D, {digits} - 1 - floor(log10(abs({x}))))"
    return f"(round({x} * {unit}) / {unit})"


def format_answer(x: str) -> str:
    """An answer's text: whole numbers plain, below 1 at most 5 decimals, else 5 significant digits (with an exponent from 1e5).

    NaN and infinities are '0'; null stays null. Below 1e-4 one significant digit where it is within 5 percent, else two.
    """
    # bound once each: v the number, e its decimal exponent, m its mantissa rounded to so many digits
    trimmed = "regexp_replace(regexp_replace({0}, r'(\\.[0-9]*?)0+$', '$1'), r'\\.$', '')"

    def scientific(digits: int) -> str:
        m, e = f"if(abs(m) >= 10, m / 10, m)", "(d + if(abs(m) >= 10, 1, 0))"
        text = trimmed.format(f"format_string('%.{digits}f', {m})")
        form = f"concat({text}, 'e', if({e} < 0, '-', '+'), lpad(cast(abs({e}) as string), greatest(2, length(cast(abs({e}) as string))), '0'))"
        return f"transform(array(round(v / power(10D, d), {digits})), m -> {form})[0]"

    near = "abs(round(v / power(10D, d), 0) * power(10D, d) - v) / greatest(abs(v), 1e-15D) < 0.05D"
    form = (
        f"case when abs(v) < 1e-4D then if({near}, {scientific(0)}, {scientific(1)}) "
        f"when abs(v) < 1 then {trimmed.format("format_string('%.5f', round(v, 5))")} "
        f"when abs({format_significant('v', 5)}) < 1e5D then {trimmed.format(f"format_string('%.5f', {format_significant('v', 5)})")} else {scientific(4)} end"
    )
    return (
        f"transform(array({x}), v -> case when v is null then null when isnan(v) or abs(v) = double('Infinity') then '0' "
        f"when v = floor(v) and abs(v) < 1e12D then cast(cast(v as bigint) as string) "
        f"else transform(array(cast(floor(log10(abs(v))) as int)), d -> {form})[0] end)[0]"
    )


def plausible(x: str, question: str) -> str:
    """Whether a numeric result is plausible for its question: struct(ok, reason)."""
    q = f"lower({question})"
    percent = f"{q} rlike 'percent|%'"
    change = f"{q} rlike 'change|increase|decrease|growth|decline|difference'"

    def no(reason: str) -> str:
        return f"named_struct('ok', false, 'reason', '{reason}')"

    return (
        f"case when {x} is null then {no('none')} "
        f"when isnan({x}) or abs({x}) = double('Infinity') then {no('not finite')} "
        f"when {percent} and {q} rlike 'change|increase|decrease|growth' and ({x} < -100 or {x} > 10000) then {no('percentage change')} "
        f"when {percent} and not {q} rlike 'change|increase|decrease|growth' and {q} rlike 'of|portion|share' and ({x} < 0 or {x} > 100) then {no('percentage of total')} "
        f"when {percent} and not {q} rlike 'change|increase|decrease|growth|of|portion|share' and ({x} < -1000 or {x} > 10000) then {no('percentage')} "
        f"when {q} rlike 'revenue|income|sales|profit' and not {change} and not {q} rlike 'loss|decline' and {x} < 0 then {no('negative')} "
        f"when {q} rlike 'ratio|multiple|times' and abs({x}) > 1000 then {no('ratio')} "
        f"when abs({x}) > 1e15D then {no('magnitude')} "
        f"when {x} = 0 and not {q} rlike 'zero|none|no change' then {no('zero')} "
        f"else named_struct('ok', true, 'reason', 'plausible') end"
    )


def verify(computed: str, gold: str, tolerance: float = 1e-4) -> str:
    """Whether a computed number equals a gold answer: struct(match, reason)."""
    g = f"trim({gold})"
    b = plain_float(g)
    return (
        f"case when {computed} is null then named_struct('match', false, 'reason', 'no_result') "
        f"when lower({g}) in ('yes','no','true','false') then named_struct('match', lower({computed}) = lower({g}), 'reason', 'boolean_comparison') "
        f"when {plain_float(computed)} is not null and {b} is not null then named_struct('match', "
        f"if({b} = 0, abs({plain_float(computed)}) < {tolerance}D, abs({plain_float(computed)} - {b}) / greatest(abs({b}), 1e-10D) < {tolerance}D), 'reason', 'numerical_comparison') "
        f"else named_struct('match', lower(trim({computed})) = lower({g}), 'reason', 'string_comparison') end"
    )


def question_kind(question: str, program: str) -> str:
    """struct(numerical, temporal, causal, table_lookup) by words anywhere in the question or program."""
    q = f"lower({question})"
    return (
        f"named_struct('numerical', {q} rlike '{NUMERICAL_WORDS}' or coalesce(lower(array_join({program}, ' ')) rlike '{PROGRAM_WORDS}', false), "
        f"'temporal', {q} rlike '{TEMPORAL_WORDS}', 'causal', {q} rlike '{CAUSAL_WORDS}', 'table_lookup', {q} rlike '{LOOKUP_WORDS}')"
    )


def first_line_answer(x: str) -> str:
    """First line of a model's reply without its prefix and final full stops."""
    line = f"trim(split(trim({x}), '\\n')[0])"
    return f"regexp_replace(trim(regexp_replace({line}, r'(?i)^(?:the answer is|answer:|result:|the result is)', '')), r'\\.+$', '')"


def strip(x: str) -> str:
    """Without white space of any kind at both ends, line breaks and no-break spaces included."""
    codes = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    return f"trim(BOTH '{''.join(rf'\u{c:04x}' for c in codes)}' FROM {x})"


def reply_answer(x: str) -> str:
    """First line of a model's reply, whatever white space it holds, without its prefixes and final full stops."""
    line = strip(f"split({strip(x)}, '\\n')[0]")
    for prefix in ("the answer is", "answer:", "result:", "the result is"):
        line = strip(f"regexp_replace({line}, r'(?i)^{prefix}', '')")
    return f"regexp_replace({line}, r'\\.+\\z', '')"


def code_block(x: str) -> str:
    """Code of the first fenced block of a model's reply, else the whole reply."""
    return f"if({x} rlike r'(?s)```(?:python)?\\s*(.*?)```', trim(regexp_extract({x}, r'(?s)```(?:python)?\\s*(.*?)```', 1)), trim({x}))"


# Cells

def cell_type(x: str) -> str:
    """empty, currency, percentage, date, numeric or text; a bare year is numeric."""
    v = blank_trim(f"coalesce({x}, '')")
    bare = f"translate({v}, ',$()', '')"
    number = r"^[\s($]*-?[0-9][0-9,]*\.?[0-9]*\s*[)%]?\s*$"
    return (
        f"case when {v} in ('', '-', '—', 'n/a', 'N/A', 'nan', 'None') then 'empty' "
        f"when {v} rlike r'^\\s*[$€£¥]' then 'currency' "
        f"when {v} rlike r'[0-9]+\\.?[0-9]*\\s*%' then 'percentage' "
        f"when {v} rlike r'\\b(?:19|20)[0-9]{{2}}\\b|Q[1-4]|FY[0-9]{{2,4}}' and not replace({v}, ',', '') rlike {quoted(number)} then 'date' "
        f"when {bare} rlike {quoted(number)} then 'numeric' else 'text' end"
    )


def is_temporal(header: str) -> str:
    return f"coalesce({header} rlike r'\\b(?:19|20)[0-9]{{2}}\\b|Q[1-4]|FY[0-9]{{2,4}}', false)"


def cell_text(x: str) -> str:
    return blank_trim(f"coalesce({x}, '')")


def rows_of(table: str) -> str:
    """Data rows of a table as structs (i, r) with i from 1; null rows are empty."""
    return f"transform(slice({table}, 2, greatest(size({table}) - 1, 0)), (r, i) -> named_struct('i', i + 1, 'r', coalesce(r, array())))"


def row_label(r: str) -> str:
    return f"lower({cell_text(f'get({r}, 0)')})"


def header_of(table: str) -> str:
    return f"transform(coalesce(get({table}, 0), array()), h -> {cell_text('h')})"


def column_for(table: str, text: str) -> str:
    """Index from 0 of the first header that contains ``text``; null if none."""
    return f"get(filter(transform({header_of(table)}, (h, i) -> if(contains(lower(h), {text}), i, null)), i -> i is not null), 0)"
