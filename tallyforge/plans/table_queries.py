"""Registered queries of scalar and table functions, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.functions import expressions as X
from tallyforge.operators import table_ops as T
from tallyforge.plans import duck as D
from tallyforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def examples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "finqa_examples")


@register(f"WITH {D.CELLS} SELECT row_id, row_idx, col_idx, {D.financial('raw')} AS value FROM cells WHERE col_idx > 0")
def parse_financial_number(spark: SparkSession, folder: str) -> DataFrame:
    return T.cells(examples(spark, folder)).filter("col_idx > 0").selectExpr("row_id", "row_idx", "col_idx", f"{X.financial_number('raw')} AS value")


@register(f"WITH {D.CELLS} SELECT row_id, row_idx, col_idx, {D.number('raw')} AS value FROM cells WHERE col_idx > 0")
def parse_number_pct(spark: SparkSession, folder: str) -> DataFrame:
    return T.cells(examples(spark, folder)).filter("col_idx > 0").selectExpr("row_id", "row_idx", "col_idx", f"{X.parse_number('raw')} AS value")


def _duck_unit(x: str) -> str:
    whens = [f"WHEN regexp_matches({x}, '(?i){pattern}') THEN '{label}'" for pattern, label, _ in X.HEADER_UNITS]
    return "CASE " + " ".join(whens) + " ELSE 'raw' END"


@register(
    f"""WITH h AS (SELECT row_id, unnest(range(len(table_cells[1]))) AS col_idx, trim(replace(coalesce(unnest(table_cells[1]), ''), chr(160), ' ')) AS header
        FROM finqa_examples WHERE table_cells IS NOT NULL AND len(table_cells) > 0),
    u AS (SELECT row_id, CAST(col_idx AS INTEGER) AS col_idx, {_duck_unit('header')} AS unit_label FROM h)
    SELECT row_id, col_idx, unit_label, CASE unit_label WHEN 'billion' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'thousand' THEN 1e3 WHEN 'hundred' THEN 1e2 ELSE 1.0 END AS unit_scale FROM u"""
)
def unit_scale(spark: SparkSession, folder: str) -> DataFrame:
    h = examples(spark, folder).selectExpr("row_id", f"posexplode({X.header_of('table_cells')}) AS (col_idx, header)")
    return h.selectExpr("row_id", "col_idx", f"{X.header_unit('header')}.label AS unit_label", f"{X.header_unit('header')}.scale AS unit_scale")


@register(
    f"""WITH p AS (SELECT q.pred_id, {D.normalize('q.predicted')} AS p, {D.normalize('e.answer')} AS g FROM predictions q JOIN finqa_examples e USING (row_id))
    SELECT pred_id, {D.match('p', 'g')} AS matched FROM p"""
)
def answers_match_flags(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "predictions").select("pred_id", "row_id", "predicted")
    return p.join(examples(spark, folder).select("row_id", "answer"), "row_id").selectExpr("pred_id", f"{X.answers_match('predicted', 'answer')} AS matched")


@register(f"SELECT row_id, {D.normalize('answer')} AS answer FROM finqa_examples")
def normalize_answer(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{X.normalize_answer('answer')} AS answer")


@register(
    f"""WITH v AS (SELECT pred_id, {D.financial('predicted')} AS x FROM predictions),
    w AS (SELECT pred_id, x, CAST(floor(log10(abs(x))) AS INTEGER) AS e FROM v WHERE x IS NOT NULL AND x <> floor(x)),
    s AS (SELECT pred_id, x, round(x, 4 - e) AS r, e FROM w)
    SELECT pred_id, CASE WHEN abs(x) < 1e12 THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE '?' END AS answer FROM v WHERE x = floor(x) AND abs(x) < 1e12
    UNION ALL
    SELECT pred_id, regexp_replace(regexp_replace(CASE WHEN abs(x) < 1 THEN printf('%.5f', round(x, 5)) ELSE printf('%.5f', r) END, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') FROM s WHERE abs(x) >= 1e-4 AND abs(r) < 1e5"""
)
def format_answer(spark: SparkSession, folder: str) -> DataFrame:
    """Answers in the range that has one notation in every engine; the exponent forms are checked by tests."""
    v = table(spark, folder, "predictions").selectExpr("pred_id", f"{X.financial_number('predicted')} AS x").filter("x is not null")
    plain = v.filter(f"(x = floor(x) and abs(x) < 1e12D) or (x <> floor(x) and abs(x) >= 1e-4D and abs({X.format_significant('x', 5)}) < 1e5D)")
    return plain.selectExpr("pred_id", f"{X.format_answer('x')} AS answer")


@register()
def format_answer_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of every size, those in exponent form included; ``format_answer`` is the share that its SQL can say."""
    v = table(spark, folder, "predictions").selectExpr("pred_id", f"{X.financial_number('predicted')} AS x").filter("x is not null")
    return v.selectExpr("pred_id", f"{X.format_answer('x')} AS answer")


@register(
    f"""WITH t AS (SELECT row_id, coalesce(question, '') || ' ' || coalesce(array_to_string(pre_text, ' '), '') AS t FROM finqa_examples)
    SELECT row_id, {D.years('t')} AS years FROM t"""
)
def extract_years(spark: SparkSession, folder: str) -> DataFrame:
    t = examples(spark, folder).selectExpr("row_id", "concat(coalesce(question, ''), ' ', coalesce(array_join(pre_text, ' '), '')) AS t")
    return t.selectExpr("row_id", f"{X.years('t')} AS years")


@register(
    f"""WITH t AS (SELECT row_id, unnest(regexp_extract_all(array_to_string(pre_text, ' '), '[-+]?\\$?[0-9][0-9,]*\\.?[0-9]*%?')) AS n FROM finqa_examples),
    v AS (SELECT row_id, {D.financial('n')} AS v FROM t)
    SELECT row_id, CAST(count(*) AS INTEGER) AS n, max(v) AS largest, min(v) AS smallest FROM v WHERE v IS NOT NULL GROUP BY row_id"""
)
def extract_numbers(spark: SparkSession, folder: str) -> DataFrame:
    t = examples(spark, folder).selectExpr("row_id", f"{X.numbers('array_join(pre_text, \" \")')} AS n").filter("size(n) > 0")
    return t.selectExpr("row_id", "size(n) AS n", "array_max(n) AS largest", "array_min(n) AS smallest")


@register(f"SELECT row_id, {D.keywords('question')} AS keywords FROM finqa_examples WHERE question IS NOT NULL")
def question_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).filter("question is not null").selectExpr("row_id", f"{X.keywords('question')} AS keywords")


@register(
    rf"""SELECT row_id, regexp_matches(lower(question), '{X.NUMERICAL_WORDS}') OR coalesce(regexp_matches(lower(array_to_string(program, ' ')), '{X.PROGRAM_WORDS}'), false) AS numerical,
        regexp_matches(lower(question), '{X.TEMPORAL_WORDS}') AS temporal, regexp_matches(lower(question), '{X.CAUSAL_WORDS}') AS causal,
        regexp_matches(lower(question), '{X.LOOKUP_WORDS}') AS table_lookup FROM finqa_examples"""
)
def keyword_question_type(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{X.question_kind('question', 'program')} AS k").select("row_id", "k.*")


@register(
    r"""WITH p AS (SELECT row_id, unnest(range(len(w))) AS para, unnest(w) AS t FROM (SELECT row_id, list_concat(coalesce(pre_text, []), coalesce(post_text, [])) AS w FROM finqa_examples)),
    s AS (SELECT row_id, para, list_filter(string_split(regexp_replace(trim(t), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM p WHERE t IS NOT NULL),
    u AS (SELECT row_id, CAST(para AS INTEGER) AS para, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM s)
    SELECT row_id, para, CAST(pos AS INTEGER) AS pos, regexp_replace(trim(regexp_replace(sentence, '\s+', ' ', 'g')), '(?i)^(?:the|a|an)\s+', '') AS span FROM u"""
)
def sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    p = examples(spark, folder).selectExpr("row_id", "posexplode(concat(coalesce(pre_text, array()), coalesce(post_text, array()))) AS (para, t)").filter("t is not null")
    s = p.selectExpr("row_id", "para", f"posexplode({X.sentences('t')}) AS (pos, sentence)")
    return s.selectExpr("row_id", "para", "pos", f"{X.clean_span('sentence')} AS span")


_P = f"SELECT p.pred_id, lower(e.question) AS q, {D.financial('p.predicted')} AS x FROM predictions p JOIN finqa_examples e USING (row_id)"


@register(
    f"""WITH p AS ({_P}),
    f AS (SELECT *, regexp_matches(q, 'percent|%') AS pct, regexp_matches(q, 'change|increase|decrease|growth') AS chg FROM p)
    SELECT pred_id, CASE WHEN x IS NULL THEN 'none'
        WHEN pct AND chg AND (x < -100 OR x > 10000) THEN 'percentage change'
        WHEN pct AND NOT chg AND regexp_matches(q, 'of|portion|share') AND (x < 0 OR x > 100) THEN 'percentage of total'
        WHEN pct AND NOT chg AND NOT regexp_matches(q, 'of|portion|share') AND (x < -1000 OR x > 10000) THEN 'percentage'
        WHEN regexp_matches(q, 'revenue|income|sales|profit') AND NOT regexp_matches(q, 'change|increase|decrease|growth|decline|difference|loss') AND x < 0 THEN 'negative'
        WHEN regexp_matches(q, 'ratio|multiple|times') AND abs(x) > 1000 THEN 'ratio'
        WHEN abs(x) > 1e15 THEN 'magnitude' WHEN x = 0 AND NOT regexp_matches(q, 'zero|none|no change') THEN 'zero' ELSE 'plausible' END AS reason
    FROM f"""
)
def plausibility(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "predictions").select("pred_id", "row_id", "predicted").join(examples(spark, folder).select("row_id", "question"), "row_id")
    return p.selectExpr("pred_id", "question", f"{X.financial_number('predicted')} AS x").selectExpr("pred_id", f"{X.plausible('x', 'question')}.reason AS reason")


@register(
    f"""WITH p AS (SELECT pred_id, p.predicted AS c, trim(e.answer) AS g, {D.plain_float('p.predicted')} AS a, {D.plain_float('trim(e.answer)')} AS b
        FROM predictions p JOIN finqa_examples e USING (row_id))
    SELECT pred_id, CASE WHEN c IS NULL THEN 'no_result' WHEN lower(g) IN ('yes','no','true','false') THEN 'boolean_comparison'
            WHEN a IS NOT NULL AND b IS NOT NULL THEN 'numerical_comparison' ELSE 'string_comparison' END AS reason,
        CASE WHEN c IS NULL THEN false WHEN lower(g) IN ('yes','no','true','false') THEN lower(c) = lower(g)
            WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN b = 0 THEN abs(a) < 1e-4 ELSE abs(a - b) / greatest(abs(b), 1e-10) < 1e-4 END
            ELSE lower(trim(c)) = lower(g) END AS matched FROM p"""
)
def verify_result(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "predictions").select("pred_id", "row_id", "predicted").join(examples(spark, folder).select("row_id", "answer"), "row_id")
    return p.selectExpr("pred_id", f"{X.verify('predicted', 'answer')} AS v").selectExpr("pred_id", "v.reason", "v.match AS matched")


# Tables

@register(f"WITH {D.CELLS} SELECT row_id, row_idx, col_idx, {D.cell_type('raw')} AS cell_type FROM cells")
def cell_types(spark: SparkSession, folder: str) -> DataFrame:
    return T.typed_cells(examples(spark, folder)).select("row_id", "row_idx", "col_idx", "cell_type")


@register(
    f"""WITH {D.CELLS}, t AS (SELECT *, {D.cell_type('raw')} AS ct FROM cells), n AS (SELECT *, CASE WHEN ct IN ('numeric','percentage','currency') THEN {D.financial('raw')} END AS num FROM t),
    g AS (SELECT row_id, col_idx, header, bool_or(ct = 'numeric') AS hn, bool_or(ct = 'text') AS ht, count(num) AS num_count, min(num) AS min, max(num) AS max, round(avg(num), 6) AS mean, round(sum(num), 4) AS sum
        FROM n GROUP BY row_id, col_idx, header)
    SELECT row_id, col_idx, header, CASE WHEN hn THEN 'numeric' WHEN ht THEN 'text' ELSE 'empty' END AS dominant_type, CASE WHEN num_count > 0 THEN 'numeric' WHEN ht THEN 'text' ELSE 'empty' END AS corrected_type,
        regexp_matches(header, '\\b(19|20)[0-9][0-9]\\b|Q[1-4]|FY[0-9][0-9]') AS is_temporal, col_idx = 0 AND NOT hn AND ht AS is_label, num_count,
        {_duck_unit('header')} AS unit_label, CASE {_duck_unit('header')} WHEN 'billion' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'thousand' THEN 1e3 WHEN 'hundred' THEN 1e2 ELSE 1.0 END AS unit_scale, min, max, mean, sum FROM g"""
)
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return T.profile(examples(spark, folder))


@register(
    f"""WITH {D.CELLS}, l AS (SELECT row_id, row_idx, '[R' || row_idx || '] ' || string_agg('[' || upper(left({D.cell_type('raw')}, 1)) || ']' || raw, ' | ' ORDER BY col_idx) AS line FROM cells GROUP BY row_id, row_idx),
    b AS (SELECT row_id, string_agg(line, chr(10) ORDER BY row_idx) AS body FROM l GROUP BY row_id)
    SELECT row_id, '[H] ' || array_to_string(head, ' | ') || chr(10) || body AS text FROM heads JOIN b USING (row_id)"""
)
def linearize_tagged(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).filter("size(table_cells) > 1").selectExpr("row_id", f"{T.linearize_tagged()} AS text")


@register(
    f"""WITH {D.CELLS}, l AS (SELECT row_id, row_idx, '<tr>' || string_agg('<td>' || raw || '</td>', '' ORDER BY col_idx) || '</tr>' AS line FROM cells GROUP BY row_id, row_idx),
    b AS (SELECT row_id, string_agg(line, '' ORDER BY row_idx) AS body FROM l GROUP BY row_id)
    SELECT row_id, '<table><thead><tr>' || array_to_string(list_transform(head, lambda h: '<th>' || h || '</th>'), '') || '</tr></thead><tbody>' || body || '</tbody></table>' AS text FROM heads JOIN b USING (row_id)"""
)
def linearize_html(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).filter("size(table_cells) > 1").selectExpr("row_id", f"{T.linearize_html()} AS text")


_STRUCTURED = f"""WITH {D.CELLS}, k AS (SELECT row_id, row_idx, trim(replace(coalesce(r[1], ''), chr(160), ' ')) AS name FROM trows WHERE row_idx > 0),
    l AS (SELECT c.row_id, c.row_idx, k.name, string_agg('col "' || CASE WHEN col_idx < len(h.head) THEN c.header ELSE 'col' || col_idx END || '" = ' || raw, ' , ' ORDER BY col_idx) AS line
        FROM cells c JOIN k USING (row_id, row_idx) JOIN heads h USING (row_id) WHERE col_idx > 0 AND raw NOT IN ('', '-', '—', 'n/a') GROUP BY ALL)
    SELECT row_id, string_agg('row "' || name || '" : ' || line, ' ; ' ORDER BY row_idx) AS text FROM l GROUP BY row_id"""


@register(_STRUCTURED)
def linearize_structured(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{T.linearize_structured()} AS text").filter("text <> ''")


@register(
    f"""WITH {D.CELLS}, k AS (SELECT row_id, row_idx, trim(replace(coalesce(r[1], ''), chr(160), ' ')) AS name FROM trows WHERE row_idx > 0)
    SELECT c.row_id, c.row_idx AS row_index, k.name || ' - ' || string_agg(CASE WHEN col_idx < len(h.head) THEN c.header ELSE 'col' || col_idx END || ': ' || raw, ', ' ORDER BY col_idx) AS text
    FROM cells c JOIN k USING (row_id, row_idx) JOIN heads h USING (row_id) WHERE raw NOT IN ('', '-', '—') GROUP BY c.row_id, c.row_idx, k.name"""
)
def row_docs(spark: SparkSession, folder: str) -> DataFrame:
    return T.row_docs(examples(spark, folder))


@register()
def table_docs(spark: SparkSession, folder: str) -> DataFrame:
    return T.table_docs(examples(spark, folder))


@register(
    """WITH t AS (SELECT row_id, table_cells AS t, len(table_cells[1]) AS w FROM finqa_examples WHERE table_cells IS NOT NULL AND len(table_cells) > 0),
    l AS (SELECT row_id, w, len(t) AS n, list_transform(t[2:31], lambda r: '| ' || array_to_string(list_transform(range(w), lambda j: CASE WHEN j >= len(r) THEN '' ELSE coalesce(r[j + 1], 'None') END), ' | ') || ' |') AS body,
        '| ' || array_to_string(list_transform(t[1], lambda h: coalesce(h, 'None')), ' | ') || ' |' AS head FROM t)
    SELECT row_id, array_to_string(list_concat([head, '|' || repeat(' --- |', CAST(w AS INTEGER))], body, CASE WHEN n > 31 THEN ['... (' || (n - 31) || ' more rows)'] ELSE [] END), chr(10)) AS text FROM l
    UNION ALL SELECT row_id, 'No table data available.' FROM finqa_examples WHERE table_cells IS NULL OR len(table_cells) = 0"""
)
def table_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{T.markdown()} AS text")


@register(
    f"""WITH {D.CELLS}, q AS (SELECT row_id, {D.words3('question')} AS w, list_distinct(regexp_extract_all(question, '[0-9]+\\.?[0-9]*')) AS n FROM finqa_examples),
    t AS (SELECT row_id, row_idx, any_value(label) AS label, lower(string_agg(raw, ' ' ORDER BY col_idx)) AS txt FROM cells GROUP BY row_id, row_idx),
    s AS (SELECT t.row_id, t.row_idx, round(0.3 * len(list_intersect(q.w, {D.words3('t.txt')})) + 0.5 * len(list_intersect(q.n, list_distinct(regexp_extract_all(t.txt, '[0-9]+\\.?[0-9]*'))))
        + CASE WHEN len(list_filter(q.w, lambda x: length(x) > 3 AND contains(t.label, x))) > 0 THEN 0.4 ELSE 0 END, 6) AS score FROM t JOIN q USING (row_id))
    SELECT row_id, row_idx AS row_index, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, row_idx) <= 5"""
)
def table_relevance_topk(spark: SparkSession, folder: str) -> DataFrame:
    r = examples(spark, folder).selectExpr("row_id", f"explode({T.row_relevance()}) AS r")
    return r.selectExpr("row_id", "r.row_index", "cast(r.score as double) AS score")


@register(
    f"""WITH {D.CELLS}, h AS (SELECT row_id, unnest(range(len(head))) AS col_index, unnest(head) AS header FROM heads),
    q AS (SELECT row_id, question, {D.words3('question')} AS w, regexp_matches(lower(question), '\\b(year|quarter|trend|change|growth)\\b') AS asked FROM finqa_examples),
    s AS (SELECT h.row_id, h.col_index, round(0.4 * len(list_intersect(q.w, {D.words3('h.header')})) + CASE WHEN q.asked AND regexp_matches(h.header, '\\b(19|20)[0-9][0-9]\\b|Q[1-4]|FY[0-9][0-9]') THEN 0.3 ELSE 0 END
        + CASE WHEN len(list_filter(regexp_extract_all(q.question, '((?:19|20)[0-9][0-9])', 1), lambda y: contains(h.header, y))) > 0 THEN 0.5 ELSE 0 END, 6) AS score FROM h JOIN q USING (row_id))
    SELECT row_id, CAST(col_index AS INTEGER) AS col_index, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, col_index) <= 5"""
)
def column_relevance_topk(spark: SparkSession, folder: str) -> DataFrame:
    r = examples(spark, folder).selectExpr("row_id", f"explode({T.column_relevance()}) AS r")
    return r.selectExpr("row_id", "r.col_index", "cast(r.score as double) AS score")


@register(
    f"""WITH {D.CELLS}, q AS (SELECT row_id, question, table_cells AS t, {D.words3('question')} AS w, list_distinct(regexp_extract_all(question, '[0-9]+\\.?[0-9]*')) AS n, regexp_matches(lower(question), '\\b(year|quarter|trend|change|growth)\\b') AS asked FROM finqa_examples),
    tx AS (SELECT row_id, row_idx, any_value(label) AS label, lower(string_agg(raw, ' ' ORDER BY col_idx)) AS txt FROM cells GROUP BY row_id, row_idx),
    rs AS (SELECT tx.row_id, tx.row_idx, round(0.3 * len(list_intersect(q.w, {D.words3('tx.txt')})) + 0.5 * len(list_intersect(q.n, list_distinct(regexp_extract_all(tx.txt, '[0-9]+\\.?[0-9]*')))) + CASE WHEN len(list_filter(q.w, lambda x: length(x) > 3 AND contains(tx.label, x))) > 0 THEN 0.4 ELSE 0 END, 6) AS score FROM tx JOIN q USING (row_id)),
    rp AS (SELECT row_id, list(row_idx) AS rows FROM (SELECT row_id, row_idx FROM rs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, row_idx) <= 5) GROUP BY row_id),
    h AS (SELECT row_id, unnest(range(len(head))) AS col_idx, unnest(head) AS header FROM heads),
    cs AS (SELECT h.row_id, h.col_idx, round(0.4 * len(list_intersect(q.w, {D.words3('h.header')})) + CASE WHEN q.asked AND regexp_matches(h.header, '\\b(19|20)[0-9][0-9]\\b|Q[1-4]|FY[0-9][0-9]') THEN 0.3 ELSE 0 END + CASE WHEN len(list_filter(regexp_extract_all(q.question, '((?:19|20)[0-9][0-9])', 1), lambda y: contains(h.header, y))) > 0 THEN 0.5 ELSE 0 END, 6) AS score FROM h JOIN q USING (row_id)),
    cp AS (SELECT row_id, list(col_idx) FILTER (col_idx <> 0) AS cols FROM (SELECT row_id, col_idx FROM cs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, col_idx) <= 5) GROUP BY row_id),
    p AS (SELECT q.row_id, q.t, CASE WHEN rp.rows IS NULL THEN range(least(len(t), 11)) ELSE list_sort(list_concat([0], rp.rows))[1:11] END AS r, CASE WHEN cp.cols IS NULL THEN range(least(len(t[1]), 8)) ELSE list_sort(list_concat([0], cp.cols))[1:8] END AS c FROM q LEFT JOIN rp USING (row_id) LEFT JOIN cp USING (row_id) WHERE len(q.t) >= 2)
    SELECT row_id, CAST(len(r) AS INTEGER) AS n_rows, array_to_string(list_transform(r, lambda i: array_to_string(list_transform(c, lambda j: coalesce(t[i + 1][j + 1], '')), '|')), ' / ') AS sub FROM p"""
)
def subtable(spark: SparkSession, folder: str) -> DataFrame:
    e = examples(spark, folder).filter("size(table_cells) >= 2").selectExpr("row_id", f"{T.subtable()} AS sub")
    return e.selectExpr("row_id", "size(sub) AS n_rows", "array_join(transform(sub, r -> array_join(r, '|')), ' / ') AS sub")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Examples with the row label that the question asks for."""
    label = r"trim(regexp_extract(lower(question), r'(?:value of|highest|annual|much|change in|total of|amounts of|lower was) ([a-z ]+?)(?: (?:did|in|from|for|across|added)|[?,(]|$)', 1))"
    return T.prepared(examples(spark, folder)).selectExpr("*", f"{label} AS asked").filter("asked <> '' and size(table_cells) > 1")


_ASKED = r"""asked AS (SELECT row_id, fiscal_year, trim(regexp_extract(lower(question), '(?:value of|highest|annual|much|change in|total of|amounts of|lower was) ([a-z ]+?)(?: (?:did|in|from|for|across|added)|[?,(]|$)', 1)) AS asked
    FROM finqa_examples WHERE table_cells IS NOT NULL AND len(table_cells) > 1)"""


@register(
    f"""WITH {D.CELLS}, {_ASKED}, m AS (SELECT DISTINCT c.row_id, c.row_idx, c.label = a.asked AS exact FROM cells c JOIN asked a USING (row_id)
        WHERE a.asked <> '' AND (c.label = a.asked OR contains(c.label, a.asked) OR contains(a.asked, c.label))),
    b AS (SELECT row_id, row_idx FROM m QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY exact DESC, row_idx) = 1),
    v AS (SELECT row_id, {D.financial('raw')} AS v FROM cells JOIN b USING (row_id, row_idx) WHERE col_idx > 0)
    SELECT a.row_id, CAST(count(v.v) AS INTEGER) AS n, max(v.v) AS largest, min(v.v) AS smallest FROM asked a LEFT JOIN v USING (row_id) WHERE a.asked <> '' GROUP BY a.row_id"""
)
def row_lookup(spark: SparkSession, folder: str) -> DataFrame:
    v = _asked(spark, folder).selectExpr("row_id", f"{T.row_values('asked')} AS v")
    return v.selectExpr("row_id", "size(v) AS n", "array_max(v) AS largest", "array_min(v) AS smallest")


@register(
    f"""WITH {D.CELLS}, h AS (SELECT row_id, unnest(range(len(head))) AS col_idx, lower(unnest(head)) AS header FROM heads),
    m AS (SELECT h.row_id, h.col_idx FROM h JOIN finqa_examples e USING (row_id) WHERE contains(h.header, CAST(e.fiscal_year AS VARCHAR))
        QUALIFY row_number() OVER (PARTITION BY h.row_id ORDER BY h.header = CAST(e.fiscal_year AS VARCHAR) DESC, h.col_idx) = 1),
    v AS (SELECT c.row_id, {D.financial('c.raw')} AS v FROM cells c JOIN m USING (row_id, col_idx))
    SELECT row_id, CAST(count(v) AS INTEGER) AS n, max(v) AS largest, min(v) AS smallest FROM v GROUP BY row_id HAVING count(v) > 0"""
)
def column_lookup(spark: SparkSession, folder: str) -> DataFrame:
    v = T.prepared(examples(spark, folder)).selectExpr("row_id", f"{T.column_values('cast(fiscal_year as string)')} AS v").filter("size(v) > 0")
    return v.selectExpr("row_id", "size(v) AS n", "array_max(v) AS largest", "array_min(v) AS smallest")


@register(
    f"""WITH {D.CELLS}, {_ASKED}, h AS (SELECT row_id, unnest(range(len(head))) AS col_idx, lower(unnest(head)) AS header FROM heads),
    c AS (SELECT h.row_id, min(h.col_idx) AS col_idx FROM h JOIN asked a USING (row_id) WHERE contains(h.header, CAST(a.fiscal_year AS VARCHAR)) GROUP BY h.row_id),
    m AS (SELECT k.row_id, {D.financial('k.raw')} AS value FROM cells k JOIN asked a USING (row_id) JOIN c USING (row_id, col_idx) WHERE a.asked <> '' AND contains(k.label, a.asked)
        QUALIFY row_number() OVER (PARTITION BY k.row_id ORDER BY k.label = a.asked DESC, length(k.label), k.row_idx) = 1)
    SELECT row_id, value FROM m WHERE value IS NOT NULL"""
)
def table_value(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder).selectExpr("row_id", f"{T.table_value('asked', 'cast(fiscal_year as string)')} AS value").filter("value is not null")


@register(
    f"""WITH {D.CELLS}, {_ASKED}, h AS (SELECT row_id, unnest(range(len(head))) AS col_idx, lower(unnest(head)) AS header FROM heads), w AS (SELECT row_id, row_idx, len(r) AS w FROM trows),
    c AS (SELECT h.row_id, h.col_idx FROM h JOIN asked a USING (row_id) WHERE h.header = CAST(a.fiscal_year AS VARCHAR) OR (contains(h.header, CAST(a.fiscal_year AS VARCHAR)) AND list_contains(regexp_split_to_array(h.header, '\\s+'), CAST(a.fiscal_year AS VARCHAR)))
        QUALIFY row_number() OVER (PARTITION BY h.row_id ORDER BY h.header = CAST(a.fiscal_year AS VARCHAR) DESC, h.col_idx) = 1),
    r AS (SELECT k.row_id, k.row_idx, c.col_idx FROM cells k JOIN asked a USING (row_id) JOIN c USING (row_id) JOIN w USING (row_id, row_idx) WHERE k.col_idx = 0 AND a.asked <> '' AND c.col_idx < w.w AND (contains(k.label, a.asked) OR contains(a.asked, k.label))
        QUALIFY row_number() OVER (PARTITION BY k.row_id ORDER BY k.row_idx) = 1)
    SELECT row_id, {D.financial('raw')} AS value FROM cells JOIN r USING (row_id, row_idx, col_idx) WHERE {D.financial('raw')} IS NOT NULL"""
)
def fuzzy_value(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder).selectExpr("row_id", f"{T.fuzzy_value('asked', 'cast(fiscal_year as string)')} AS value").filter("value is not null")


@register(f"WITH {D.CELLS} SELECT row_id, list_sort(list_distinct(flatten(list_transform(head, lambda h: regexp_extract_all(h, '\\b((?:19|20)[0-9][0-9])\\b', 1))))) AS years FROM heads")
def header_years(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).filter("size(table_cells) > 0").selectExpr("row_id", f"{T.header_years()} AS years")


_YEARS2 = r"""yq AS (SELECT row_id, question, regexp_extract_all(question, '\b((?:19|20)[0-9][0-9])\b', 1) AS ys FROM finqa_examples)"""


@register(
    f"""WITH {D.CELLS}, {_YEARS2}, h AS (SELECT row_id, unnest(range(len(head))) AS col_idx, unnest(head) AS header FROM heads),
    y AS (SELECT row_id, ys[len(ys)] AS y1, ys[len(ys) - 1] AS y2, {D.keywords('question')} AS kw FROM yq WHERE len(ys) >= 2),
    k AS (SELECT y.row_id, (SELECT min(col_idx) FROM h WHERE h.row_id = y.row_id AND contains(h.header, y.y1)) AS c1, (SELECT min(col_idx) FROM h WHERE h.row_id = y.row_id AND contains(h.header, y.y2)) AS c2, kw FROM y),
    r AS (SELECT k.row_id, a.row_idx, a.label, {D.financial('a.raw')} AS v1, {D.financial('b.raw')} AS v2, k.kw FROM k JOIN cells a ON a.row_id = k.row_id AND a.col_idx = k.c1 JOIN cells b ON b.row_id = k.row_id AND b.row_idx = a.row_idx AND b.col_idx = k.c2),
    s AS (SELECT *, len(list_filter(kw, lambda x: contains(label, x))) + len(list_intersect({D.letters('label')}, list_distinct(kw))) + 0.5 * len(list_filter(kw, lambda x: length(x) > 3 AND contains(label, x))) AS score FROM r WHERE v1 IS NOT NULL AND v2 IS NOT NULL)
    SELECT row_id, CAST(score AS DOUBLE) AS score, v1, v2 FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, CASE WHEN regexp_matches(label, 'total|net|gross|revenue|income') THEN 0 ELSE 1 END, row_idx) = 1"""
)
def values_for_years(spark: SparkSession, folder: str) -> DataFrame:
    e = T.prepared(examples(spark, folder)).filter("size(ys) >= 2 and size(table_cells) > 1")
    return e.selectExpr("row_id", f"{T.values_for_years('element_at(ys, -1)', 'element_at(ys, -2)')} AS v").filter("v is not null").select("row_id", "v.*")


@register(
    f"""WITH {D.CELLS}, {_YEARS2}, h AS (SELECT row_id, unnest(range(len(head))) AS col_idx, lower(unnest(head)) AS header FROM heads),
    hy AS (SELECT row_id, list_sort(list_distinct(flatten(list_transform(head, lambda h: regexp_extract_all(h, '\\b((?:19|20)[0-9][0-9])\\b', 1))))) AS hy FROM heads),
    q AS (SELECT yq.row_id, ys, hy, {D.keywords('question')} AS kw, question FROM yq LEFT JOIN hy USING (row_id)),
    y AS (SELECT row_id, 1 AS pr, 'years' AS source, ys[len(ys)] AS y1, ys[len(ys) - 1] AS y2, kw FROM q WHERE len(ys) >= 2 UNION ALL SELECT row_id, 2, 'years reversed', ys[1], ys[2], kw FROM q WHERE len(ys) >= 2
        UNION ALL SELECT row_id, 3, 'header', hy[len(hy)], hy[len(hy) - 1], kw FROM q WHERE len(ys) < 2 AND len(hy) >= 2),
    k AS (SELECT y.*, (SELECT min(col_idx) FROM h WHERE h.row_id = y.row_id AND contains(h.header, y.y1)) AS c1, (SELECT min(col_idx) FROM h WHERE h.row_id = y.row_id AND contains(h.header, y.y2)) AS c2 FROM y),
    r AS (SELECT k.row_id, k.pr, k.source, a.row_idx, a.label, {D.financial('a.raw')} AS v1, {D.financial('b.raw')} AS v2, k.kw FROM k JOIN cells a ON a.row_id = k.row_id AND a.col_idx = k.c1 JOIN cells b ON b.row_id = k.row_id AND b.row_idx = a.row_idx AND b.col_idx = k.c2),
    s AS (SELECT *, len(list_filter(kw, lambda x: contains(label, x))) + len(list_intersect({D.letters('label')}, list_distinct(kw))) + 0.5 * len(list_filter(kw, lambda x: length(x) > 3 AND contains(label, x))) AS score FROM r WHERE v1 IS NOT NULL AND v2 IS NOT NULL),
    b AS (SELECT row_id, pr, v1, v2, source FROM s QUALIFY row_number() OVER (PARTITION BY row_id, pr ORDER BY score DESC, CASE WHEN regexp_matches(label, 'total|net|gross|revenue|income') THEN 0 ELSE 1 END, row_idx) = 1),
    n AS (SELECT q.row_id, list_filter(list_transform(regexp_extract_all(q.question, '[-+]?\\$?[0-9][0-9,]*\\.?[0-9]*%?'), lambda n: {D.financial('n')}), lambda n: n IS NOT NULL AND NOT (n = floor(n) AND list_contains(list_transform(ys, lambda y: CAST(y AS DOUBLE)), n))) AS f FROM q JOIN finqa_examples e ON e.row_id = q.row_id AND len(e.table_cells) >= 3),
    u AS (SELECT * FROM b UNION ALL SELECT row_id, 9, f[1], f[2], 'question' FROM n WHERE len(f) >= 2)
    SELECT row_id, v1 AS v_new, v2 AS v_old, source FROM u QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY pr) = 1"""
)
def two_values(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{T.looked_up(T.two_values())} AS v").filter("v is not null").select("row_id", "v.*")


_CONTENT = ",".join(f"'{w}'" for w in T.CONTENT_STOP)


@register(
    f"""WITH {D.CELLS}, {_YEARS2}, h AS (SELECT row_id, unnest(range(len(head))) AS col_idx, lower(unnest(head)) AS header FROM heads),
    q AS (SELECT yq.row_id, (SELECT min(col_idx) FROM h WHERE h.row_id = yq.row_id AND contains(h.header, ys[len(ys)])) AS by_year, (SELECT min(col_idx) FROM h WHERE h.row_id = yq.row_id AND col_idx > 0 AND contains(h.header, 'total')) AS by_total,
        list_filter({D.letters('lower(question)')}, lambda w: w NOT IN ({_CONTENT})) AS words, list_filter({D.letters("regexp_extract(lower(question), '(?:percent(?:age)?|share|portion|fraction)\\s+of\\s+(.+?)(?:\\s+(?:is|was|are|were|that|due)|\\s*\\?|$)', 1)")}, lambda w: w NOT IN ({_CONTENT})) AS aim
        FROM yq JOIN (SELECT row_id AS rid FROM finqa_examples WHERE len(table_cells) >= 3) ON rid = yq.row_id),
    p AS (SELECT *, CASE WHEN coalesce(by_year, 1) <> 1 THEN by_year ELSE coalesce(by_total, 1) END AS place FROM q),
    f AS (SELECT p.row_id, c.row_idx, c.label, {D.financial('c.raw')} AS v, len(list_intersect({D.letters('c.label')}, p.words)) + 0.5 * len(list_filter(p.words, lambda x: contains(c.label, x))) AS s, len(list_intersect({D.letters('c.label')}, p.aim)) AS m FROM p JOIN cells c ON c.row_id = p.row_id AND c.col_idx = p.place),
    g AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, row_idx) AS n FROM f WHERE v IS NOT NULL), t AS (SELECT row_id, v FROM g WHERE n = 1),
    a AS (SELECT g.row_id, g.v FROM g JOIN t USING (row_id) WHERE contains(g.label, 'total') AND abs(g.v) <> abs(t.v) QUALIFY row_number() OVER (PARTITION BY g.row_id ORDER BY g.n) = 1),
    b AS (SELECT g.row_id, g.v FROM g JOIN t USING (row_id) WHERE m > 0 AND abs(g.v) <> abs(t.v) QUALIFY row_number() OVER (PARTITION BY g.row_id ORDER BY g.m DESC, g.n) = 1)
    SELECT t.row_id, t.v AS part, coalesce(a.v, b.v, r.v) AS total FROM t JOIN g r ON r.row_id = t.row_id AND r.n = 2 LEFT JOIN a ON a.row_id = t.row_id LEFT JOIN b ON b.row_id = t.row_id"""
)
def part_of_total(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{T.looked_up(T.part_of_total())} AS v").filter("v is not null").select("row_id", "v.*")


@register(
    f"""WITH {D.CELLS}, {_YEARS2}, h AS (SELECT row_id, unnest(range(len(head))) AS col_idx, lower(unnest(head)) AS header FROM heads),
    hy AS (SELECT row_id, list_sort(list_distinct(flatten(list_transform(head, lambda h: regexp_extract_all(h, '\\b((?:19|20)[0-9][0-9])\\b', 1))))) AS hy FROM heads),
    q AS (SELECT yq.row_id, ys, hy, list_distinct({D.keywords('question')}) AS kw, {D.letters("regexp_extract(lower(question), '(?:percent(?:age)?|margin|rate)\\s+of\\s+(.+?)(?:\\s*\\?|$|\\s+in\\b|\\s+for\\b)', 1)")} AS hint FROM yq LEFT JOIN hy USING (row_id)),
    o AS (SELECT row_id, unnest(range(len(ys))) AS n, unnest(ys) AS y FROM q), k AS (SELECT o.row_id, h.col_idx FROM o JOIN h USING (row_id) WHERE contains(h.header, o.y) QUALIFY row_number() OVER (PARTITION BY o.row_id ORDER BY o.n DESC, h.col_idx) = 1),
    p AS (SELECT q.*, CASE WHEN len(ys) > 0 THEN coalesce(k.col_idx, 1) ELSE coalesce((SELECT min(col_idx) FROM h WHERE h.row_id = q.row_id AND contains(h.header, hy[len(hy)])), 1) END AS place FROM q LEFT JOIN k USING (row_id) JOIN finqa_examples e ON e.row_id = q.row_id AND len(e.table_cells) >= 3),
    f AS (SELECT p.row_id, c.row_idx, c.label, {D.financial('c.raw')} AS v, p.hint, round(len(list_intersect({D.letters('c.label')}, p.kw)) + 0.8 * len(list_filter(p.kw, lambda x: length(x) > 3 AND contains(c.label, x))), 6) AS s FROM p JOIN cells c ON c.row_id = p.row_id AND c.col_idx = p.place),
    g AS (SELECT * FROM f WHERE v IS NOT NULL), c2 AS (SELECT row_id FROM g GROUP BY row_id HAVING count(*) >= 2), t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY s DESC, row_idx) = 1),
    d AS (SELECT g.row_id, g.v, CASE WHEN len(list_intersect({D.letters('g.label')}, g.hint)) > 0 THEN 1 WHEN regexp_matches(g.label, '{T.REVENUE_TERMS}') THEN 2 ELSE 3 END AS kind, g.row_idx FROM g JOIN t USING (row_id) WHERE g.label <> t.label),
    b AS (SELECT row_id, v FROM d QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY kind, CASE WHEN kind < 3 THEN row_idx ELSE 0 END, CASE WHEN kind = 3 THEN -abs(v) ELSE 0 END, CASE WHEN kind = 3 THEN -v ELSE 0 END) = 1)
    SELECT t.row_id, t.v AS numerator, b.v AS denominator FROM t JOIN c2 USING (row_id) JOIN b USING (row_id) WHERE b.v <> 0"""
)
def margin_values(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{T.looked_up(T.margin_values())} AS v").filter("v is not null").select("row_id", "v.*")


_SAME = ",".join(f"'{w}'" for w in T.SAME_ROW_STOP)


@register(
    f"""WITH {D.CELLS}, q AS (SELECT row_id, list_filter({D.letters('lower(question)')}, lambda w: w NOT IN ({_SAME})) AS w FROM finqa_examples),
    n AS (SELECT row_id, row_idx FROM trows WHERE row_idx > 0 AND len(r) >= 3),
    s AS (SELECT c.row_id, c.row_idx, len(list_intersect({D.letters('c.label')}, q.w)) AS score FROM cells c JOIN n USING (row_id, row_idx) JOIN q USING (row_id) WHERE c.col_idx = 0),
    b AS (SELECT row_id, row_idx FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, row_idx) = 1),
    v AS (SELECT row_id, list({D.financial('raw')} ORDER BY col_idx) FILTER ({D.financial('raw')} IS NOT NULL) AS v FROM cells JOIN b USING (row_id, row_idx) WHERE col_idx > 0 GROUP BY row_id)
    SELECT row_id, v[1] AS a, v[2] AS b FROM v WHERE len(v) >= 2"""
)
def same_row_values(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{T.looked_up(T.same_row_values())} AS v").filter("v is not null").select("row_id", "v.*")


@register(
    f"""WITH {D.CELLS}, {_YEARS2}, h AS (SELECT row_id, unnest(range(len(head))) AS col_idx, lower(unnest(head)) AS header FROM heads), q AS (SELECT row_id, ys, {D.keywords('question')} AS kw FROM yq), o AS (SELECT row_id, unnest(range(len(ys))) AS n, unnest(ys) AS y FROM q),
    k AS (SELECT o.row_id, h.col_idx FROM o JOIN h USING (row_id) WHERE contains(h.header, o.y) QUALIFY row_number() OVER (PARTITION BY o.row_id ORDER BY o.n DESC, h.col_idx) = 1),
    m AS (SELECT c.row_id, max(c.col_idx) AS col_idx FROM cells c JOIN heads USING (row_id) WHERE c.col_idx > 0 AND c.col_idx < len(head) AND {D.financial('c.raw')} IS NOT NULL GROUP BY c.row_id),
    p AS (SELECT q.row_id, q.kw, coalesce(k.col_idx, m.col_idx) AS place FROM q LEFT JOIN k USING (row_id) LEFT JOIN m USING (row_id)),
    s AS (SELECT t.row_id, t.row_idx, p.place, len(list_intersect({D.letters('c.label')}, list_distinct(p.kw))) + 0.5 * len(list_filter(p.kw, lambda x: contains(c.label, x))) AS score FROM trows t JOIN cells c ON c.row_id = t.row_id AND c.row_idx = t.row_idx AND c.col_idx = 0 JOIN p ON p.row_id = t.row_id WHERE p.place < len(t.r)),
    b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, row_idx) = 1)
    SELECT b.row_id, {D.financial('c.raw')} AS value FROM b JOIN cells c ON c.row_id = b.row_id AND c.row_idx = b.row_idx AND c.col_idx = b.place WHERE {D.financial('c.raw')} IS NOT NULL"""
)
def single_value(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{T.looked_up(T.single_value())} AS value").filter("value is not null")


@register(
    f"""WITH {D.CELLS}, t AS (SELECT row_id, {D.years("coalesce(array_to_string(pre_text, ' '), '')")} AS ty FROM finqa_examples),
    h AS (SELECT row_id, list_distinct(flatten(list_transform(head, lambda h: list_transform(regexp_extract_all(h, '\\b((?:19|20)[0-9][0-9])\\b', 1), lambda y: CAST(y AS INTEGER))))) AS hy FROM heads)
    SELECT row_id, round(len(list_intersect(ty, hy)) / greatest(len(ty), 1), 6) AS score, len(list_intersect(ty, hy)) / greatest(len(ty), 1) < 0.5 AS mismatched FROM t JOIN h USING (row_id)"""
)
def temporal_alignment(spark: SparkSession, folder: str) -> DataFrame:
    e = examples(spark, folder).filter("size(table_cells) > 0").selectExpr("row_id", "table_cells", "coalesce(array_join(pre_text, ' '), '') AS txt")
    return e.selectExpr("row_id", f"{T.alignment('txt')} AS a").select("row_id", "a.*")


def _alias_case(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{'|'.join(a)}') THEN '{v}'" for v, a in T.ALIASES) + " END"


_BARE = "translate(raw, ',$%', '')"


@register(
    f"""WITH {D.CELLS}, v AS (SELECT c.row_id, c.row_idx, {_alias_case('c.label')} AS var, {D.plain_float(_BARE)} AS val
        FROM cells c JOIN heads h USING (row_id) WHERE c.col_idx = CASE WHEN len(h.head) > 1 THEN len(h.head) - 1 ELSE 1 END)
    SELECT row_id, var, val FROM v WHERE var IS NOT NULL AND val IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id, var ORDER BY row_idx DESC) = 1"""
)
def observed_variables(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"explode({T.observed_variables()}) AS (var, val)")


@register(
    f"""WITH {D.CELLS}, y AS (SELECT row_id, unnest(range(len(head))) AS col_idx, unnest(head) AS h FROM heads), c AS (SELECT * FROM y WHERE regexp_matches(h, '(19|20)[0-9][0-9]')),
    n AS (SELECT row_id, count(*) AS n FROM c GROUP BY row_id HAVING count(*) >= 4), t AS (SELECT row_id FROM finqa_examples WHERE len(table_cells) >= 3),
    b AS (SELECT row_id, min(row_idx) AS row_idx FROM cells WHERE contains(label, 'income') AND col_idx = 0 GROUP BY row_id),
    v AS (SELECT k.row_id, k.col_idx, {D.plain_float(_BARE)} AS v FROM cells k JOIN b USING (row_id, row_idx) JOIN c USING (row_id, col_idx))
    SELECT v.row_id, list(v.v ORDER BY v.col_idx) AS series FROM v JOIN n USING (row_id) JOIN t USING (row_id) GROUP BY v.row_id, n.n HAVING count(v.v) = n.n"""
)
def table_series(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{T.table_series(repr('income'))} AS series").filter("series is not null")


@register(
    f"""WITH {D.CELLS} SELECT row_id, row_idx, col_idx, round(sin(row_idx / pow(10000.0, 0 / 8.0)), 6) AS p0, round(cos(row_idx / pow(10000.0, 1 / 8.0)), 6) AS p1,
        round(sin(col_idx / pow(10000.0, 2 / 8.0)), 6) AS p2, round(cos(col_idx / pow(10000.0, 7 / 8.0)), 6) AS p7 FROM cells"""
)
def cell_positions(spark: SparkSession, folder: str) -> DataFrame:
    c = T.cells(examples(spark, folder)).selectExpr("row_id", "row_idx", "col_idx", f"{T.cell_positions(8)} AS p")
    return c.selectExpr("row_id", "row_idx", "col_idx", "round(p[0], 6) AS p0", "round(p[1], 6) AS p1", "round(p[2], 6) AS p2", "round(p[7], 6) AS p7")
