"""Registered queries of programs, routing, retrieval and evaluation, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import expressions as X
from tallyforge.operators import evaluation as E
from tallyforge.operators import programs as P
from tallyforge.operators import retrieval as R
from tallyforge.operators import routing as G
from tallyforge.operators import table_ops as T
from tallyforge.plans import duck as D
from tallyforge.plans.table_queries import Query, examples
from tallyforge.sources.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# Programs

_CONST = " ".join(f"WHEN 'const_{k}' THEN {v}" for k, v in P.CONSTANTS.items())


def _arg(a: str) -> str:
    return f"""CASE WHEN starts_with({a}, '#') THEN NULL WHEN starts_with({a}, 'const_') THEN coalesce(CASE {a} {_CONST} END, {D.financial(f'{a}[7:]')}, 0)
        WHEN starts_with({a}, 'table_') THEN 0 ELSE coalesce({D.financial(a)}, 0) END"""


_STEPS = rf"""
whole AS (SELECT row_id, CASE WHEN len(program) = 1 THEN list_filter(string_split(regexp_replace(program[1], '\)(,\s+)', ')' || chr(1), 'g'), chr(1)), lambda x: x <> '') ELSE program END AS p FROM finqa_examples),
lines AS (SELECT row_id, unnest(range(len(p))) AS i, trim(unnest(p)) AS s FROM whole WHERE p IS NOT NULL),
parts AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS i, regexp_extract(s, '^(\w+)\((.+)\)', 1) AS op,
    list_transform(string_split(regexp_extract(s, '^(\w+)\((.+)\)', 2), ','), lambda x: trim(x)) AS args FROM lines WHERE regexp_matches(s, '^\w+\(.+\)')),
code AS (SELECT row_id, CAST(i AS INTEGER) AS i, op, args, len(args) AS n, CASE WHEN starts_with(args[1], '#') THEN TRY_CAST(args[1][2:] AS INTEGER) END AS ra, CASE WHEN starts_with(args[2], '#') THEN TRY_CAST(args[2][2:] AS INTEGER) END AS rb,
    {_arg('args[1]')} AS va, {_arg('args[2]')} AS vb,
    lower(list_filter(args, lambda a: NOT starts_with(a, '#') AND NOT starts_with(a, 'const_') AND NOT starts_with(a, 'table_') AND lower(a) <> 'none' AND {D.financial('a')} IS NULL)[1]) AS label FROM parts)
"""


@register(
    f"""WITH {D.CELLS}, {_STEPS},
    m AS (SELECT c.row_id, c.i, k.row_idx, k.label = c.label AS exact FROM code c JOIN cells k ON k.row_id = c.row_id AND k.col_idx = 0 WHERE starts_with(c.op, 'table_') AND (contains(k.label, c.label) OR contains(c.label, k.label))),
    b AS (SELECT row_id, i, row_idx FROM m QUALIFY row_number() OVER (PARTITION BY row_id, i ORDER BY exact DESC, row_idx) = 1),
    v AS (SELECT b.row_id, b.i, {D.financial('raw')} AS v FROM b JOIN cells USING (row_id, row_idx) WHERE col_idx > 0)
    SELECT c.row_id, c.i AS step, CASE c.op WHEN 'table_sum' THEN round(coalesce(sum(v.v), 0), 4) WHEN 'table_average' THEN round(coalesce(avg(v.v), 0), 4) WHEN 'table_max' THEN coalesce(max(v.v), 0) ELSE coalesce(min(v.v), 0) END AS value
    FROM code c JOIN v USING (row_id, i) WHERE starts_with(c.op, 'table_') GROUP BY c.row_id, c.i, c.op HAVING count(v.v) > 0"""
)
def dsl_table_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Table steps whose row holds numbers."""
    code = P.executed(T.prepared(examples(spark, folder))).selectExpr("row_id", "posexplode(arrays_zip(code, trace)) AS (step, s)")
    rows = code.filter("startswith(s.code.op, 'table_') and size(s.code.nums) > 0 and s.code.label is not null")
    return rows.selectExpr("row_id", "step", "if(s.code.op in ('table_sum', 'table_average'), round(s.trace.num, 4), s.trace.num) AS value")


_EXEC = f"""WITH RECURSIVE {D.CELLS}, {_STEPS},
    m AS (SELECT c.row_id, c.i, k.row_idx, k.label = c.label AS exact FROM code c JOIN cells k ON k.row_id = c.row_id AND k.col_idx = 0 WHERE starts_with(c.op, 'table_') AND (contains(k.label, c.label) OR contains(c.label, k.label))),
    b AS (SELECT row_id, i, row_idx FROM m QUALIFY row_number() OVER (PARTITION BY row_id, i ORDER BY exact DESC, row_idx) = 1),
    tv AS (SELECT b.row_id, b.i, sum({D.financial('raw')}) AS s, avg({D.financial('raw')}) AS a, max({D.financial('raw')}) AS mx, min({D.financial('raw')}) AS mn FROM b JOIN cells USING (row_id, row_idx) WHERE col_idx > 0 GROUP BY b.row_id, b.i),
    full_code AS (SELECT c.*, coalesce(CASE c.op WHEN 'table_sum' THEN s WHEN 'table_average' THEN a WHEN 'table_max' THEN mx WHEN 'table_min' THEN mn END, 0) AS t FROM code c LEFT JOIN tv USING (row_id, i)),
    last AS (SELECT row_id, max(i) AS n FROM code GROUP BY row_id),
    run AS (
        SELECT row_id, -1 AS i, CAST([] AS DOUBLE[]) AS res, CAST(NULL AS VARCHAR) AS str FROM last
        UNION ALL
        SELECT r.row_id, c.i, list_append(r.res, CASE WHEN starts_with(c.op, 'table_') THEN c.t WHEN c.n = 1 THEN x.a WHEN c.op = 'add' THEN x.a + x.b WHEN c.op = 'subtract' THEN x.a - x.b WHEN c.op = 'multiply' THEN x.a * x.b
                WHEN c.op = 'divide' THEN CASE WHEN x.b = 0 THEN CAST('inf' AS DOUBLE) ELSE x.a / x.b END WHEN c.op = 'exp' THEN pow(x.a, x.b) END),
            CASE WHEN c.op = 'greater' THEN CASE WHEN x.a > x.b THEN 'yes' ELSE 'no' END END
        FROM run r JOIN full_code c ON c.row_id = r.row_id AND c.i = r.i + 1, LATERAL (SELECT CASE WHEN c.ra IS NULL THEN c.va ELSE r.res[c.ra + 1] END AS a, CASE WHEN c.rb IS NULL THEN c.vb ELSE r.res[c.rb + 1] END AS b) x)
"""


@register(f"{_EXEC} SELECT r.row_id, CASE WHEN abs(res[len(res)]) < 1e15 THEN round(res[len(res)], 4) END AS result_num, str AS result_str FROM run r JOIN last l ON l.row_id = r.row_id AND l.n = r.i")
def dsl_eval_all(spark: SparkSession, folder: str) -> DataFrame:
    """Results of every gold program that can be executed."""
    r = P.executed(T.prepared(examples(spark, folder))).filter("success")
    return r.selectExpr("row_id", "if(abs(result_num) < 1e15D, round(result_num, 4), null) AS result_num", "result_str")


@register(
    f"""{_EXEC}, fin AS (SELECT r.row_id, coalesce(r.str, CAST(r.res[len(r.res)] AS VARCHAR)) AS p, r.res[len(r.res)] AS x FROM run r JOIN last l ON l.row_id = r.row_id AND l.n = r.i),
    g AS (SELECT f.row_id, f.x, lower(f.p) AS p, {D.normalize('e.answer')} AS g FROM fin f JOIN finqa_examples e USING (row_id) WHERE f.x IS NULL OR abs(f.x) < 1e15)
    SELECT row_id, {D.match('p', 'g')} AS matched FROM g"""
)
def dsl_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a gold program's result matches the gold answer."""
    r = P.executed(T.prepared(examples(spark, folder))).filter("success and (result_num is null or abs(result_num) < 1e15D)")
    return r.selectExpr("row_id", f"{X.answers_match('coalesce(result_str, cast(result_num as string))', 'answer')} AS matched")


@register()
def dsl_accuracy_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The same for every program that can be executed, results of 1e15 or more and infinities included."""
    r = P.executed(T.prepared(examples(spark, folder))).filter("success")
    return r.selectExpr("row_id", f"{X.answers_match('coalesce(result_str, cast(result_num as string))', 'answer')} AS matched")


@register()
def dsl_units(spark: SparkSession, folder: str) -> DataFrame:
    r = P.executed(T.prepared(examples(spark, folder))).filter("size(trace) > 0")
    return r.selectExpr("row_id", "transform(trace, t -> t.unit) AS units", "aggregate(trace, 0, (s, t) -> s + t.warn) AS warnings", f"{P.dimensional()} AS dimensional")


def _operation_sql() -> str:
    whens = []
    for name, pattern in P.OPERATIONS:
        test = f"regexp_matches(q, '{pattern}')"
        if name == "what_pct":
            whens += [f"WHEN {test} AND regexp_matches(q, '{P.CHANGE_WORDS}') THEN 'pct_change'", f"WHEN {test} THEN 'pct_of'"]
        elif name == "add":
            whens.append(f"WHEN {test} AND NOT regexp_matches(q, '{P.NOT_SUM}') THEN 'add'")
        else:
            whens.append(f"WHEN {test} THEN '{name}'")
    return f"SELECT row_id, CASE {' '.join(whens)} ELSE 'unknown' END AS op FROM (SELECT row_id, lower(trim(question)) AS q FROM finqa_examples)"


@register(_operation_sql())
def dsl_detect_op(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{P.operation()} AS op")


@register()
def dsl_induce(spark: SparkSession, folder: str) -> DataFrame:
    return P.induced(examples(spark, folder)).filter("induced is not null").select("row_id", "op", "induced")


@register(
    rf"""WITH s AS (SELECT annotation_id, regexp_extract_all(lower(program), '([a-z_]+\([^\n)]*\))') AS c FROM program_annotations),
    u AS (SELECT annotation_id, unnest(range(len(c))) AS k, regexp_replace(unnest(c), '\s+', '', 'g') AS step FROM s),
    f AS (SELECT annotation_id, row_number() OVER (PARTITION BY annotation_id ORDER BY k) - 1 AS i, step FROM u WHERE regexp_matches(step, '^(add|subtract|multiply|divide|greater|exp|table_sum|table_average|table_max|table_min)\(')
        AND length(replace(step, '(', '')) = length(replace(step, ')', ''))),
    a AS (SELECT annotation_id, i, step, string_split(regexp_extract(step, '^[a-z_]+\((.+)\)$', 1), ',') AS args FROM f WHERE i < 6),
    v AS (SELECT annotation_id, i, step, regexp_extract(step, '^[a-z_]+\((.+)\)$', 1) <> '' AND (starts_with(step, 'table_') OR len(args) = 2)
        AND len(list_filter(args, lambda x: NOT ((regexp_matches(x, '^#\d+$') AND TRY_CAST(x[2:] AS INTEGER) < i) OR (NOT starts_with(x, '#') AND ({D.financial('x')} IS NOT NULL OR regexp_matches(x, '^-?\d[\d,.]*%?$')))))) = 0 AS ok FROM a),
    w AS (SELECT annotation_id, step, i, bool_and(ok) OVER (PARTITION BY annotation_id ORDER BY i) AS good FROM v)
    SELECT annotation_id, string_agg(step, ' ; ' ORDER BY i) AS steps FROM w WHERE good GROUP BY annotation_id"""
)
def dsl_validate(spark: SparkSession, folder: str) -> DataFrame:
    """The valid steps at the start of every annotator's text."""
    a = table(spark, folder, "program_annotations").filter("program is not null")
    return a.selectExpr("annotation_id", f"{P.constrained('program')} AS s").filter("size(s) > 0").selectExpr("annotation_id", "array_join(s, ' ; ') AS steps")


@register()
def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The most consistent prediction per example, clustered in the order of pred_id."""
    p = table(spark, folder, "predictions").selectExpr("row_id", "pred_id", f"{X.financial_number('predicted')} AS x").filter("x is not null")
    # counted by value first: one example may hold a third of all predictions, but few different answers
    counted = p.groupBy("row_id", "x").agg(F.count("*").alias("n"), F.min("pred_id").alias("first"))
    g = counted.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("first", "x", "n"))).alias("v"))
    return g.selectExpr("row_id", f"{P.majority('v')} AS answer", "aggregate(v, 0L, (s, e) -> s + e.n) AS votes")


# Routing

def _probe_sql() -> str:
    def has(p: str, x: str = "q") -> str:
        return f"CAST(regexp_matches({x}, '(?i){p}') AS INTEGER)"

    feats = [" + ".join(has(p) for p in G.PATTERNS[r]) for r in G.ROUTES]
    feats += [has(G.NUMBER), has(G.MARKER), "CAST(starts_with(lower(q), 'why') AS INTEGER)", r"least(len(regexp_extract_all(q, '\b(19\d{2}|20\d{2})\b')), 4)", has(G.PERCENT), f"{has(G.CAUSE)} * {has(G.TIME)}", r"least(1.0, len(regexp_split_to_array(q, '\s+')) / 20.0)", has(G.COMPARISON)]
    cols = ", ".join(f"CAST({f} AS DOUBLE) AS f{i}" for i, f in enumerate(feats))
    logits = ", ".join(" + ".join(f"({w}) * f{i} / (1 + 1e-8)" for i, w in enumerate(G.WEIGHTS[r][:12]) if w) + f" AS l_{r}" for r in G.ROUTES)
    exps = ", ".join(f"exp(l_{r} - greatest({', '.join(f'l_{x}' for x in G.ROUTES)})) AS e_{r}" for r in G.ROUTES)
    total = " + ".join(f"e_{r}" for r in G.ROUTES)
    probs = ", ".join(f"e_{r} / ({total} + 1e-10) AS p_{r}" for r in G.ROUTES)
    return f"""WITH q AS (SELECT row_id, trim(question) AS q FROM finqa_examples WHERE trim(question) <> ''), f AS (SELECT row_id, {cols} FROM q), l AS (SELECT row_id, f9, {logits} FROM f), e AS (SELECT row_id, f9, {exps} FROM l), p AS (SELECT row_id, f9, {probs} FROM e),
        j AS (SELECT *, greatest(least(1.0, p_temporal * p_causal * 16), CASE WHEN f9 > 0.5 THEN 0.6 ELSE 0 END) AS joint, greatest(p_numerical, p_temporal, p_causal, p_factual) AS top FROM p)"""


@register(
    _probe_sql()
    + " SELECT row_id, round(p_numerical, 6) AS p_numerical, round(p_temporal, 6) AS p_temporal, round(p_causal, 6) AS p_causal, round(p_factual, 6) AS p_factual, round(joint, 6) AS joint, CASE WHEN p_numerical = top THEN 'numerical' WHEN p_temporal = top THEN 'temporal' WHEN p_causal = top THEN 'causal' ELSE 'factual' END AS primary_type FROM j"
)
def route_questions(spark: SparkSession, folder: str) -> DataFrame:
    r = G.routed(examples(spark, folder).filter("trim(question) <> ''").select("row_id", "question"))
    return r.selectExpr("row_id", *[f"round(p_{x}, 6) AS p_{x}" for x in G.ROUTES], "round(joint, 6) AS joint", "primary_type")


@register(
    _probe_sql()
    + """, b AS (SELECT row_id, joint, list_filter([CASE WHEN p_numerical >= greatest(0.15, 0.5 * top) THEN 'numerical' END, CASE WHEN p_temporal >= greatest(0.15, 0.5 * top) THEN 'temporal' END,
        CASE WHEN p_causal >= greatest(0.15, 0.5 * top) THEN 'causal' END, CASE WHEN p_factual >= greatest(0.15, 0.5 * top) THEN 'factual' END], lambda m: m IS NOT NULL) AS m FROM j)
    SELECT row_id, array_to_string(CASE WHEN joint >= 0.3 THEN list_concat(m, list_filter(['temporal', 'causal'], lambda x: NOT list_contains(m, x)), ['temporal_causal_joint']) WHEN len(m) = 0 THEN ['factual'] ELSE m END, ',') AS modules FROM b"""
)
def active_modules(spark: SparkSession, folder: str) -> DataFrame:
    r = G.routed(examples(spark, folder).filter("trim(question) <> ''").select("row_id", "question"))
    return r.selectExpr("row_id", "array_join(modules, ',') AS modules")


# Retrieval

_TOK = r"regexp_extract_all(lower({x}), '[\p{L}\p{N}_]+')"


def _tok(x: str) -> str:
    return _TOK.replace("{x}", x)


@register(
    f"""WITH d AS (SELECT doc_id, {_tok("coalesce(text, '')")} AS t FROM documents), s AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avg FROM d),
    p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT row_id AS query_id, unnest({_tok('question')}) AS term FROM finqa_examples WHERE row_id % 20 = 0), qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
    c AS (SELECT query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))), 6) AS score FROM qt JOIN df USING (term) JOIN tf USING (term), s GROUP BY query_id, doc_id),
    z AS (SELECT e.row_id AS query_id, d.doc_id, coalesce(c.score, 0.0) AS score FROM finqa_examples e CROSS JOIN documents d LEFT JOIN c ON c.query_id = e.row_id AND c.doc_id = d.doc_id WHERE e.row_id % 20 = 0)
    SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM z QUALIFY rank <= 10"""
)
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Documents for the questions whose row_id is divisible by 20, against all documents."""
    q = examples(spark, folder).filter("row_id % 20 = 0").selectExpr("row_id AS query_id", "question AS text")
    return R.bm25(table(spark, folder, "documents"), q, 10)


@register(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
    s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.e, d.e), 6) AS score FROM n q, n d WHERE q.vec_id % 20 = 0)
    SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""
)
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return R.cosine_topk(v, v.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding"), 10)


_PASSAGES = f"""{D.CELLS}, k AS (SELECT row_id, row_idx, trim(replace(coalesce(r[1], ''), chr(160), ' ')) AS name FROM trows WHERE row_idx > 0),
    nm AS (SELECT c.*, k.name, CASE WHEN col_idx < len(h.head) THEN c.header ELSE 'col' || col_idx END AS h FROM cells c JOIN k USING (row_id, row_idx) JOIN heads h USING (row_id)),
    sl AS (SELECT row_id, row_idx, 'row "' || name || '" : ' || string_agg('col "' || h || '" = ' || raw, ' , ' ORDER BY col_idx) AS line FROM nm WHERE col_idx > 0 AND raw NOT IN ('', '-', '—', 'n/a') GROUP BY row_id, row_idx, name),
    st AS (SELECT e.row_id, 0 AS a, 0 AS b, 'table' AS type, coalesce((SELECT string_agg(line, ' ; ' ORDER BY row_idx) FROM sl WHERE sl.row_id = e.row_id), '') AS text FROM finqa_examples e WHERE len(table_cells) > 0),
    rd AS (SELECT row_id, 1 AS a, row_idx AS b, 'table' AS type, name || ' - ' || string_agg(h || ': ' || raw, ', ' ORDER BY col_idx) AS text FROM nm WHERE raw NOT IN ('', '-', '—') GROUP BY row_id, row_idx, name),
    pr AS (SELECT row_id, 2 AS a, unnest(range(len(pre_text))) AS b, 'text' AS type, trim(unnest(pre_text)) AS text FROM finqa_examples UNION ALL SELECT row_id, 3, unnest(range(len(post_text))), 'text', trim(unnest(post_text)) FROM finqa_examples),
    docs AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY a, b) - 1 AS doc_idx, type, text FROM (SELECT * FROM st UNION ALL SELECT * FROM rd UNION ALL SELECT * FROM pr WHERE text <> ''))"""


@register(
    f"""WITH {_PASSAGES}, d AS (SELECT row_id, doc_idx, type, {_tok('text')} AS t FROM docs), s AS (SELECT row_id, count(*) AS n, avg(len(t)) AS avg FROM d GROUP BY row_id),
    tf AS (SELECT row_id, doc_idx, dl, term, count(*) AS tf FROM (SELECT row_id, doc_idx, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT row_id, term, count(*) AS df FROM tf GROUP BY ALL),
    qt AS (SELECT row_id, term, count(*) AS qtf FROM (SELECT row_id, unnest({_tok('question')}) AS term FROM finqa_examples) GROUP BY ALL),
    c AS (SELECT row_id, doc_idx, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))) AS bm25, sum(CAST(qtf * tf AS DOUBLE)) AS dot FROM qt JOIN df USING (row_id, term) JOIN tf USING (row_id, term) JOIN s USING (row_id) GROUP BY ALL),
    nd AS (SELECT row_id, doc_idx, sqrt(sum(tf * tf)) AS nd FROM tf GROUP BY ALL), nq AS (SELECT row_id, sqrt(sum(qtf * qtf)) AS nq FROM qt GROUP BY ALL),
    sc AS (SELECT d.row_id, d.doc_idx, d.type, round(coalesce(c.bm25, 0), 6) AS bm25, round(coalesce(c.dot / (nd.nd * nq.nq), 0), 6) AS cosine FROM d LEFT JOIN c USING (row_id, doc_idx) LEFT JOIN nd USING (row_id, doc_idx) LEFT JOIN nq USING (row_id)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY cosine DESC, doc_idx) - 1 AS rd, row_number() OVER (PARTITION BY row_id ORDER BY bm25 DESC, doc_idx) - 1 AS rb, count(*) FILTER (type = 'text') OVER (PARTITION BY row_id) AS nt FROM sc),
    fu AS (SELECT r.row_id, doc_idx, round(CASE WHEN rd < greatest(25, nt) THEN 0.7 / (20 + rd) ELSE 0 END + CASE WHEN rb < greatest(25, nt) THEN 0.3 * CASE WHEN regexp_matches(e.question, '\\d[\\d,.]+') THEN 1.3 ELSE 1 END / (20 + rb) ELSE 0 END, 9) AS score
        FROM rk r JOIN finqa_examples e USING (row_id) WHERE type = 'text' AND (rd < greatest(25, nt) OR rb < greatest(25, nt)))
    SELECT row_id, CAST(doc_idx AS INTEGER) AS doc_idx, score, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, doc_idx) AS INTEGER) AS rank FROM fu QUALIFY rank <= 5"""
)
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """The five best text passages of every example by rank fusion."""
    return R.fused(R.scored_passages(examples(spark, folder)), "text", 5).drop("type")


@register(f"WITH {_PASSAGES} SELECT row_id, CAST(doc_idx AS INTEGER) AS doc_idx, type, text FROM docs")
def example_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of every example as it is indexed."""
    return R.passages(examples(spark, folder))


@register()
def retrieve_again(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval for a query widened by the first gap of an answer, as the loop does."""
    from tallyforge.operators import evidence as V

    years = r"regexp_extract_all(question, r'\b((?:19|20)\d{2})\b', 1)"
    e = examples(spark, folder).withColumn("widened", F.expr(V.reformulated("question", "'no_result'", years, "cast(array() as array<string>)", 1)))
    return R.retrieve(e, "widened")


@register(
    r"""SELECT doc_id, regexp_replace(trim(regexp_replace(trim(string_split(trim(text), chr(10))[1]), '(?i)^(?:the answer is|answer:|result:|the result is)', '')), '\.+$', '') AS answer FROM documents WHERE trim(text) <> '' AND NOT contains(text, chr(13)) AND NOT contains(text, chr(160))"""
)
def reply_answers(spark: SparkSession, folder: str) -> DataFrame:
    """First lines of texts as a model's reply is read."""
    d = table(spark, folder, "documents").filter("trim(text) <> '' and not contains(text, '\r') and not contains(text, '\u00a0')")
    return d.selectExpr("doc_id", f"{X.first_line_answer('text')} AS answer")


@register()
def reply_answers_whole(spark: SparkSession, folder: str) -> DataFrame:
    """First lines of all texts that aren't blank; those of ``reply_answers`` are the share that its SQL can say."""
    d = table(spark, folder, "documents").filter(f"{X.strip('text')} <> ''")
    return d.selectExpr("doc_id", f"{X.reply_answer('text')} AS answer")


@register(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?s)```(?:python)?\s*(.*?)```') THEN trim(regexp_extract(text, '(?s)```(?:python)?\s*(.*?)```', 1), ' ') ELSE trim(text, ' ') END AS code FROM documents WHERE text IS NOT NULL""")
def reply_code(spark: SparkSession, folder: str) -> DataFrame:
    """Code of texts as a model's reply is read."""
    return table(spark, folder, "documents").filter("text is not null").selectExpr("doc_id", f"{X.code_block('text')} AS code")


@register()
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).filter("question is not null").selectExpr("row_id", f"{P.pot_prompt()} AS prompt")


@register()
def retrieve_all(spark: SparkSession, folder: str) -> DataFrame:
    return R.retrieve(examples(spark, folder))


@register(
    """WITH RECURSIVE e AS (SELECT row_id, list_filter(coalesce(pre_text, []), lambda p: p IS NOT NULL) AS a, list_filter(coalesce(post_text, []), lambda p: p IS NOT NULL) AS b FROM finqa_examples),
    u AS (SELECT row_id, a, unnest(range(len(b))) AS i, unnest(b) AS f FROM e), v AS (SELECT row_id, i, trim(f) AS f FROM u WHERE trim(f) <> '' AND NOT list_contains(list_transform(a, lambda x: left(lower(trim(x)), 200)), left(lower(trim(f)), 200))
        QUALIFY row_number() OVER (PARTITION BY row_id, left(lower(trim(f)), 200) ORDER BY i) = 1), n AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) AS k, f FROM v),
    r AS (SELECT row_id, 0 AS k, array_to_string(a, ' ') AS t, false AS full_up FROM e
        UNION ALL SELECT r.row_id, n.k, CASE WHEN length(r.t) + length(n.f) + 1 <= 3500 THEN r.t || ' ' || n.f WHEN 3500 - length(r.t) - 1 > 50 THEN r.t || ' ' || left(n.f, 3500 - length(r.t) - 1) ELSE r.t END, length(r.t) + length(n.f) + 1 > 3500 FROM r JOIN n ON n.row_id = r.row_id AND n.k = r.k + 1 WHERE NOT r.full_up)
    SELECT row_id, CAST(length(trim(t, ' ')) AS INTEGER) AS n_chars, trim(t, ' ') AS context FROM r QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY k DESC) = 1"""
)
def context_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Leading paragraphs with those after the table appended."""
    e = examples(spark, folder).selectExpr("row_id", "filter(coalesce(pre_text, array()), p -> p is not null) AS a", "filter(coalesce(post_text, array()), p -> p is not null) AS b")
    return e.selectExpr("row_id", f"{R.merged_context('a', 'b')} AS context").selectExpr("row_id", "length(context) AS n_chars", "context")


@register()
def hashed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"{R.hashed_vector('question', 32)} AS v")


# Evaluation

_SCORED = f"""s AS (SELECT p.*, coalesce(p.predicted, '') <> '' AND coalesce(e.answer, '') <> '' AS answered, {D.normalize('p.predicted')} AS np, {D.normalize('e.answer')} AS ng FROM predictions p LEFT JOIN finqa_examples e USING (row_id)),
    m AS (SELECT *, {D.match('np', 'ng')} AS matched, {D.plain_float('np')} AS a, {D.plain_float('ng')} AS b FROM s), sc AS (SELECT *, CASE WHEN b = 0 THEN abs(a) ELSE abs(a - b) / abs(b) END AS re FROM m)"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return E.scored(table(spark, folder, "predictions"), examples(spark, folder).select("row_id", "answer", "program"))


@register(
    f"""WITH {_SCORED} SELECT CASE GROUPING(run_name) * 2 + GROUPING(primary_type) WHEN 3 THEN 'overall' WHEN 2 THEN 'type' WHEN 1 THEN 'run' ELSE 'run and type' END AS level, run_name, primary_type, count(*) AS count, CAST(sum(CAST(answered AS INT)) AS BIGINT) AS total,
        CAST(sum(CAST(answered AND matched AS INT)) AS BIGINT) AS correct, round(avg(CASE WHEN answered THEN CAST(matched AS DOUBLE) END), 6) AS accuracy, round(avg(confidence), 9) AS mean_confidence, round(avg(n_iterations), 9) AS mean_iterations, round(avg(time_seconds), 9) AS mean_seconds
    FROM sc GROUP BY GROUPING SETS ((), (run_name), (primary_type), (run_name, primary_type))"""
)
def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    return E.report(_scored(spark, folder))


@register(
    f"""WITH {_SCORED} SELECT primary_type, count(*) AS count, CAST(sum(CAST(matched AS INT)) AS BIGINT) AS all_correct, CAST(sum(CAST(answered AS INT)) AS BIGINT) AS total, CAST(sum(CAST(answered AND matched AS INT)) AS BIGINT) AS correct,
        round(avg(CASE WHEN answered THEN CAST(matched AS DOUBLE) END), 6) AS accuracy, round(avg(CASE WHEN answered THEN re END), 4) AS mean_relative_error, round(quantile_cont(CASE WHEN answered THEN re END, 0.5), 6) AS median_relative_error FROM sc GROUP BY primary_type"""
)
def eval_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return E.accuracy(_scored(spark, folder), ["primary_type"])


@register(
    f"""WITH {_SCORED}, r AS (SELECT coalesce(method, 'unknown') AS method, count(*) AS count, round(avg(CAST(answered AS DOUBLE)), 6) AS success_rate FROM sc GROUP BY 1) SELECT method, count, round(count / sum(count) OVER (), 4) AS share, success_rate FROM r"""
)
def method_rates(spark: SparkSession, folder: str) -> DataFrame:
    return E.method_rates(_scored(spark, folder).withColumnRenamed("answered", "success"))


@register(
    f"""WITH {_SCORED}, w AS (SELECT CASE WHEN row_id IS NULL THEN 'retrieval_failure' WHEN method IS NULL THEN 'program_generation_failure' WHEN n_iterations IS NULL OR confidence IS NULL THEN 'execution_failure' ELSE 'reasoning_error' END AS cause FROM sc WHERE answered AND NOT matched)
    SELECT cause, count(*) AS errors, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM w GROUP BY cause"""
)
def error_attribution(spark: SparkSession, folder: str) -> DataFrame:
    s = _scored(spark, folder).selectExpr("answered", "matched", "row_id is not null AS has_context", "method is not null AS has_program", "n_iterations is not null and confidence is not null AS success")
    return E.error_attribution(s)


@register()
def program_match(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the gold program's steps that the induced program has."""
    return P.induced(examples(spark, folder)).selectExpr("row_id", f"{E.step_match('induced', 'program')} AS step_match").filter("step_match is not null")


def _ev(x: str) -> str:
    return f"list_distinct(list_concat(regexp_extract_all(lower({x}), '[a-z][a-z][a-z]+'), regexp_extract_all({x}, '-?[0-9][0-9,.]*')))"


@register(
    f"""WITH d AS (SELECT row_id, unnest(range(len(pre_text))) AS j, unnest(pre_text) AS d FROM finqa_examples WHERE pre_text IS NOT NULL), dt AS (SELECT row_id, j, {_ev('d')} AS t FROM d WHERE d IS NOT NULL),
    g AS (SELECT row_id, unnest(range(len(gold_evidence))) AS i, unnest(gold_evidence) AS g FROM finqa_examples WHERE gold_evidence IS NOT NULL), gt AS (SELECT row_id, i, {_ev('g')} AS t FROM g WHERE coalesce(g, '') <> ''),
    n AS (SELECT dt.row_id, j, i, len(list_intersect(dt.t, gt.t)) / greatest(1, len(gt.t)) >= 0.4 AS near FROM dt JOIN gt USING (row_id)),
    p AS (SELECT row_id, avg(CAST(r AS DOUBLE)) AS precision FROM (SELECT row_id, j, bool_or(near) AS r FROM n GROUP BY ALL) GROUP BY row_id), r AS (SELECT row_id, avg(CAST(r AS DOUBLE)) AS recall FROM (SELECT row_id, i, bool_or(near) AS r FROM n GROUP BY ALL) GROUP BY row_id)
    SELECT e.row_id, round(coalesce(p.precision, 0), 6) AS precision, round(coalesce(r.recall, 0), 6) AS recall, round(coalesce(CASE WHEN p.precision + r.recall > 0 THEN 2 * p.precision * r.recall / (p.precision + r.recall) END, 0), 6) AS f1
    FROM finqa_examples e LEFT JOIN p USING (row_id) LEFT JOIN r USING (row_id)"""
)
def context_prf(spark: SparkSession, folder: str) -> DataFrame:
    e = examples(spark, folder).selectExpr("row_id", "gold_evidence", "filter(pre_text, p -> p is not null) AS retrieved")
    return E.context_quality(e).selectExpr("row_id", "round(precision, 6) AS precision", "round(recall, 6) AS recall", "round(f1, 6) AS f1")


@register(
    f"""WITH c AS (SELECT row_id, array_to_string(pre_text, ' ') AS ctx, coalesce(question, '') AS q, coalesce(answer, '') AS a FROM finqa_examples)
    SELECT row_id, round(CASE WHEN coalesce(ctx, '') = '' THEN 0 ELSE least(1.0, 0.5 * len(list_intersect({_ev('ctx')}, {_ev('q')})) / greatest(1, len({_ev('q')})) + 0.5 * len(list_intersect({_ev('ctx')}, {_ev('a')})) / greatest(1, len({_ev('a')}))) END, 6) AS sufficiency FROM c"""
)
def context_sufficiency(spark: SparkSession, folder: str) -> DataFrame:
    e = examples(spark, folder).selectExpr("row_id", "array_join(pre_text, ' ') AS ctx", "question", "answer")
    return e.selectExpr("row_id", f"round({E.sufficiency('ctx', 'question', 'answer')}, 6) AS sufficiency")


@register(
    f"""WITH {_SCORED}, k AS (SELECT run_name, CASE WHEN n_iterations >= 5 THEN '5+' ELSE CAST(n_iterations AS VARCHAR) END AS bucket, answered, matched FROM sc)
    SELECT run_name, bucket, count(*) AS count, round(avg(CASE WHEN answered THEN CAST(matched AS DOUBLE) END), 6) AS accuracy FROM k GROUP BY ALL"""
)
def accuracy_by_iterations(spark: SparkSession, folder: str) -> DataFrame:
    s = _scored(spark, folder).selectExpr("run_name", "if(n_iterations >= 5, '5+', cast(n_iterations as string)) AS bucket", "answered", "matched")
    return s.groupBy("run_name", "bucket").agg(F.count("*").alias("count"), F.round(F.avg(F.expr("if(answered, cast(matched as double), null)")), 6).alias("accuracy"))


@register(
    f"""WITH {_SCORED} SELECT primary_type, count(*) FILTER (answered AND matched) AS correct, count(*) FILTER (answered AND NOT matched) AS wrong, count(*) FILTER (NOT answered) AS unanswered FROM sc GROUP BY primary_type"""
)
def error_matrix(spark: SparkSession, folder: str) -> DataFrame:
    s = _scored(spark, folder).selectExpr("primary_type", "case when not answered then 'unanswered' when matched then 'correct' else 'wrong' end AS outcome")
    return s.groupBy("primary_type").pivot("outcome", ["correct", "wrong", "unanswered"]).agg(F.count(F.lit(1))).na.fill(0)


@register(
    _probe_sql()
    + f""", b AS (SELECT row_id, joint, list_filter([CASE WHEN p_numerical >= greatest(0.15, 0.5 * top) THEN 'numerical' END, CASE WHEN p_temporal >= greatest(0.15, 0.5 * top) THEN 'temporal' END,
        CASE WHEN p_causal >= greatest(0.15, 0.5 * top) THEN 'causal' END, CASE WHEN p_factual >= greatest(0.15, 0.5 * top) THEN 'factual' END], lambda m: m IS NOT NULL) AS m FROM j),
    mods AS (SELECT row_id, unnest(CASE WHEN joint >= 0.3 THEN list_concat(m, list_filter(['temporal', 'causal'], lambda x: NOT list_contains(m, x)), ['temporal_causal_joint']) WHEN len(m) = 0 THEN ['factual'] ELSE m END) AS module FROM b), {_SCORED}
    SELECT module, count(*) AS count, CAST(sum(CAST(answered AND matched AS INT)) AS BIGINT) AS correct, round(avg(CASE WHEN answered THEN CAST(matched AS DOUBLE) END), 6) AS accuracy FROM sc JOIN mods USING (row_id) GROUP BY module"""
)
def module_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    mods = G.routed(examples(spark, folder).filter("trim(question) <> ''").select("row_id", "question")).select("row_id", "modules")
    return E.module_accuracy(_scored(spark, folder).join(mods, "row_id"))
