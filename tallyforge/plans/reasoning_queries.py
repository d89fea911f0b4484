"""Registered queries of temporal, causal and statistical operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import expressions as X
from tallyforge.operators import answering as A
from tallyforge.operators import causal_reasoning as K
from tallyforge.operators import causal_text as C
from tallyforge.operators import evaluation as E
from tallyforge.operators import evidence as V
from tallyforge.operators import programs as P
from tallyforge.operators import routing as G
from tallyforge.operators import scm as S
from tallyforge.operators import series as I
from tallyforge.operators import table_ops as T
from tallyforge.operators import temporal as M
from tallyforge.plans import duck as D
from tallyforge.plans.table_queries import SQL as TABLE_SQL
from tallyforge.plans.table_queries import Query, examples
from tallyforge.session import cut_lineage
from tallyforge.sources import json_dataset
from tallyforge.sources.tables import table
from tallyforge.streaming import windows

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


WHOLE = "concat(coalesce(pre_text, array()), coalesce(post_text, array()))"


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, para, pos, sentence) of all paragraphs, those after the table numbered on from those before it."""
    p = examples(spark, folder).selectExpr("row_id", f"posexplode({WHOLE}) AS (para, t)").filter("t is not null")
    return p.selectExpr("row_id", "para", f"posexplode({X.sentences('t')}) AS (pos, sentence)")


_SENT = r"""p AS (SELECT row_id, unnest(range(len(w))) AS para, unnest(w) AS t FROM (SELECT row_id, list_concat(coalesce(pre_text, []), coalesce(post_text, [])) AS w FROM finqa_examples)), s0 AS (SELECT row_id, para, list_filter(string_split(regexp_replace(trim(t), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM p WHERE t IS NOT NULL),
    sent AS (SELECT row_id, CAST(para AS INTEGER) AS para, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS sentence FROM s0)"""


def _q(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


# Temporal

_TXT = "SELECT row_id, fiscal_year AS a, lower(coalesce(question, '') || ' ' || coalesce(array_to_string(list_concat(coalesce(pre_text, []), coalesce(post_text, [])), ' '), '')) AS q FROM finqa_examples"


def _timex_sql() -> str:
    parts = [f"SELECT row_id, '{p}' AS phrase, 'DATE' AS ttype, CAST(a + {d} AS VARCHAR) AS value FROM t WHERE contains(q, '{p}')" for p, d in M.RELATIVE_YEARS.items()]
    parts += [f"SELECT row_id, '{p}', 'DATE', ((a * 4 + 3 + {d}) // 4) || '-Q' || ((a * 4 + 3 + {d}) % 4 + 1) FROM t WHERE contains(q, '{p}')" for p, d in M.RELATIVE_QUARTERS.items()]
    parts.append("SELECT row_id, 'prior period', 'DATE', NULL FROM t WHERE regexp_matches(q, 'prior period|previous period|the period before')")
    parts.append("SELECT row_id, 'same period last year', 'DATE', (a - 1) || '-Q4' FROM t WHERE regexp_matches(q, 'same period last year|comparable quarter|year-ago quarter|same quarter last year')")
    ago = r"(\d+)\s+years?\s+ago"
    parts.append(f"SELECT row_id, regexp_extract(q, '{ago}'), 'DATE', CAST(a - CAST(regexp_extract(q, '{ago}', 1) AS INTEGER) AS VARCHAR) FROM t WHERE regexp_matches(q, '{ago}')")
    ago = r"(\d+)\s+quarters?\s+ago"
    n = f"(a * 4 + 3 - CAST(regexp_extract(q, '{ago}', 1) AS INTEGER))"
    parts.append(f"SELECT row_id, regexp_extract(q, '{ago}'), 'DATE', ({n} // 4) || '-Q' || ({n} % 4 + 1) FROM t WHERE regexp_matches(q, '{ago}')")
    for unit, letter in (("years?", "Y"), ("quarters?", "Q")):
        past = rf"(?:over|during|in)\s+the\s+(?:past|last|previous)\s+(\d+)\s+{unit}"
        parts.append(f"SELECT row_id, regexp_extract(q, '{past}'), 'DURATION', 'P' || CAST(regexp_extract(q, '{past}', 1) AS INTEGER) || '{letter}' FROM t WHERE regexp_matches(q, '{past}')")
    parts.append("SELECT row_id, 'year-to-date', 'DURATION', a || '-YTD' FROM t WHERE regexp_matches(q, 'year-to-date|ytd')")
    for p, h in M.HALVES.items():
        parts.append(f"SELECT row_id, '{p}', 'DATE', coalesce(nullif(regexp_extract(q, '{p}\\s+(?:of\\s+)?(\\d\\d\\d\\d)', 1), ''), CAST(a AS VARCHAR)) || '-H{h}' FROM t WHERE contains(q, '{p}')")
    for p, h in M.ORDINAL_QUARTERS.items():
        parts.append(f"SELECT row_id, '{p}', 'DATE', coalesce(nullif(regexp_extract(q, '{p}\\s+(?:of\\s+)?(\\d\\d\\d\\d)', 1), ''), CAST(a AS VARCHAR)) || '-Q{h}' FROM t WHERE contains(q, '{p}')")
    parts.append("SELECT row_id, 'TTM/LTM', 'DURATION', 'P1Y' FROM t WHERE regexp_matches(q, '\\b(?:ttm|ltm)\\b')")
    since = r"(?:since|following|after)\s+the\s+(merger|acquisition|restructuring|ipo|spin-?off)"
    parts.append(f"SELECT row_id, regexp_extract(q, '{since}'), 'DURATION', a || '/present' FROM t WHERE regexp_matches(q, '{since}')")
    return f"WITH t AS ({_TXT}) " + " UNION ALL ".join(parts)


@register(_timex_sql())
def timex_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Expressions of time of every example, from its fiscal year and the fourth quarter."""
    t = examples(spark, folder).selectExpr("row_id", "fiscal_year AS a", f"concat(coalesce(question, ''), ' ', coalesce(array_join({WHOLE}, ' '), '')) AS q0")
    return t.selectExpr("row_id", f"inline({M.timex('q0', 'a')})")


@register(
    r"""WITH t AS (SELECT row_id, coalesce(array_to_string(list_concat(coalesce(pre_text, []), coalesce(post_text, [])), ' '), '') AS t FROM finqa_examples), y AS (SELECT row_id, unnest(regexp_extract_all(t, '\b((?:19|20)\d\d)\b', 1)) AS l FROM t), q AS (SELECT row_id, unnest(regexp_extract_all(t, '(?i)Q[1-4]\s*(?:\d\d\d\d)?')) AS m FROM t),
    f AS (SELECT row_id, CAST(regexp_extract(unnest(regexp_extract_all(t, '(?i)(?:fiscal\s*(?:year|quarter)?\s*\d\d\d\d|fy\s*''?\s*\d\d\d?\d?\b)')), '(\d+)$', 1) AS INTEGER) AS y FROM t), h AS (SELECT row_id, unnest(regexp_extract_all(t, '(?i)\b(h[12]\s*(?:of\s+)?\d\d\d\d)\b', 1)) AS m FROM t),
    a AS (SELECT row_id, 'year' AS etype, l AS label FROM y UNION ALL SELECT row_id, 'quarter', rtrim('Q' || m[2] || ' ' || regexp_extract(m, '(\d\d\d\d)$', 1)) FROM q UNION ALL SELECT row_id, 'fiscal_year', 'FY' || CASE WHEN y < 50 THEN y + 2000 WHEN y < 100 THEN y + 1900 ELSE y END FROM f
        UNION ALL SELECT row_id, 'range', 'H' || m[2] || ' ' || regexp_extract(m, '(\d\d\d\d)$', 1) FROM h UNION ALL SELECT row_id, 'range', 'TTM/LTM' FROM t WHERE regexp_matches(t, '(?i)\b(?:ttm|ltm)\b'))
    SELECT row_id, etype, label, count(*) AS n FROM a GROUP BY ALL"""
)
def temporal_entities(spark: SparkSession, folder: str) -> DataFrame:
    t = examples(spark, folder).selectExpr("row_id", f"coalesce(array_join({WHOLE}, ' '), '') AS t")
    return t.selectExpr("row_id", f"explode({M.entities('t')}) AS e").groupBy("row_id", "e.etype", "e.label").agg(F.count("*").alias("n"))


_DEICTIC = "|".join([*M.RELATIVE_YEARS, *M.RELATIVE_QUARTERS])


@register(
    rf"""WITH q AS (SELECT row_id, lower(question) AS q, len(regexp_extract_all(question, '\b(?:19|20)\d\d\b')) AS n FROM finqa_examples WHERE question IS NOT NULL),
    f AS (SELECT *, regexp_matches(q, '{_DEICTIC}') AS de, regexp_matches(q, 'same period last year|comparable quarter|year-ago quarter|same quarter last year') AS sa, regexp_matches(q, '(?:over|during|in)\s+the\s+(?:past|last|previous)\s+\d+\s+(?:years?|quarters?|months?)') AS du FROM q)
    SELECT row_id, regexp_matches(q, 'compared to|versus|vs|relative to|from|change') OR sa AS comparison, regexp_matches(q, 'trend|growth|over time|year-over-year|consistently') AS trend, n = 1 AS point_lookup,
        regexp_matches(q, 'previous|prior|preceding|last|next|following|subsequent|current|this') OR de AS relative, (regexp_matches(q, 'between|from|during|throughout') AND n >= 2) OR regexp_matches(q, 'year-to-date|ytd|first half|second half|h1|h2') OR du AS "range",
        regexp_matches(q, 'highest|lowest|maximum|minimum|most|least|best|worst') AS extreme, de OR sa AS deictic, du AS duration FROM f"""
)
def temporal_qtype(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).filter("question is not null").selectExpr("row_id", f"{M.question_flags()} AS f").select("row_id", "f.*")


_EVENT = "CASE " + " ".join(f"WHEN regexp_matches(sentence, {_q('(?i)' + p)}) THEN '{t}'" for t, p in M.EVENT_TYPES) + " ELSE 'other' END"


@register(f"WITH {_SENT} SELECT row_id, para, pos, {_EVENT} AS event_type FROM sent")
def event_types(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(spark, folder).selectExpr("row_id", "para", "pos", f"{M.event_type('sentence')} AS event_type")


def _clean(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(regexp_replace({x}, '[\s\x{{A0}}]+', ' ', 'g'), '^[\s,;:.]+|[\s,;:.]+$', '', 'g')), '(?i)^(?:the|a|an)\s+', '')"


_SIG_K = "CASE " + " ".join(f"WHEN regexp_matches(sentence, {_q('(?i)' + p)}) THEN {i + 1}" for i, (_, p, _) in enumerate(M.BY_LENGTH)) + " END"
_SIG_L = "CASE k " + " ".join(f"WHEN {i + 1} THEN regexp_extract(sentence, {_q('(?is)^(.*?)' + p)}, 1)" for i, (_, p, _) in enumerate(M.BY_LENGTH)) + " END"
_SIG_R = "CASE k " + " ".join(f"WHEN {i + 1} THEN regexp_replace(sentence, {_q('(?is)^.*?' + p)}, '')" for i, (_, p, _) in enumerate(M.BY_LENGTH)) + " END"
_RELS = f"""{_SENT}, k AS (SELECT *, {_SIG_K} AS k FROM sent), x AS (SELECT row_id, para, pos, k, {_clean(_SIG_L)} AS l0, {_clean(_SIG_R)} AS r0 FROM k WHERE k IS NOT NULL),
    y AS (SELECT *, length(l0) < 5 AND length(r0) >= 10 AND contains(r0, ',') AS sw FROM x),
    z AS (SELECT row_id, para, pos, k, CASE WHEN sw THEN {_clean("substr(r0, instr(r0, ',') + 1)")} ELSE l0 END AS l, CASE WHEN sw THEN {_clean("substr(r0, 1, instr(r0, ',') - 1)")} ELSE r0 END AS r FROM y),
    er AS (SELECT *, [{', '.join(_q(s[0]) for s in M.BY_LENGTH)}][k] AS signal, [{', '.join(_q(s[2]) for s in M.BY_LENGTH)}][k] AS rel FROM z WHERE length(l) >= 5 AND length(r) >= 3)"""
_ANCH = r"regexp_matches({0}, '\b(?:19|20)\d\d\b|(?i)\bQ[1-4]\b')"
_FIN = " + ".join(f"CASE WHEN contains(lower(l || ' ' || r), '{w}') THEN 1 ELSE 0 END" for w in M.FINANCE_WORDS)


@register(
    f"""WITH {_RELS}, c AS (SELECT row_id, l, r, rel, signal, round(least(1.0, 0.6 + CASE WHEN signal IN ({', '.join(_q(s) for s in M.STRONG)}) THEN 0.15 ELSE 0 END
        + CASE CAST({_ANCH.format('l')} AS INT) + CAST({_ANCH.format('r')} AS INT) WHEN 2 THEN 0.15 WHEN 1 THEN 0.05 ELSE 0 END + least(0.1, 0.02 * ({_FIN}))), 4) AS confidence FROM er)
    SELECT row_id, l AS "left", r AS "right", rel, signal, confidence FROM (SELECT DISTINCT * FROM c) QUALIFY row_number() OVER (PARTITION BY row_id, left(lower(l), 40), left(lower(r), 40), rel ORDER BY l, r, rel, signal, confidence) = 1"""
)
def event_relations(spark: SparkSession, folder: str) -> DataFrame:
    return M.relations(sentences(spark, folder), ["row_id"]).select("row_id", "left", "right", "rel", "signal", "confidence")


@register(
    rf"""WITH {_SENT}, e AS (SELECT row_id, para || '.' || pos AS event, CAST(nullif(regexp_extract(sentence, '\b((?:19|20)\d\d)\b', 1), '') AS INTEGER) AS period FROM sent)
    SELECT a.row_id, a.event AS "first", b.event AS second FROM e a JOIN e b ON a.row_id = b.row_id AND a.period < b.period"""
)
def anchor_before_pairs(spark: SparkSession, folder: str) -> DataFrame:
    year = r"try_cast(regexp_extract(sentence, r'\b((?:19|20)\d{2})\b', 1) as int)"
    e = sentences(spark, folder).selectExpr("row_id", "concat(para, '.', pos) AS event", f"{year} AS period").filter("period is not null")
    return M.anchored_before(e, ["row_id"])


@register("SELECT issuer, fiscal_year AS value, n AS next FROM (SELECT issuer, fiscal_year, lead(fiscal_year) OVER (PARTITION BY issuer ORDER BY fiscal_year) AS n FROM (SELECT DISTINCT issuer, fiscal_year FROM finqa_examples)) WHERE n IS NOT NULL")
def year_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return M.sequence(examples(spark, folder).selectExpr("issuer", "fiscal_year AS value"), ["issuer"])


@register("WITH y AS (SELECT DISTINCT issuer, fiscal_year AS y FROM finqa_examples) SELECT a.issuer, a.y AS src, b.y AS tgt FROM y a JOIN y b ON a.issuer = b.issuer AND a.y < b.y")
def before_closure(spark: SparkSession, folder: str) -> DataFrame:
    edges = year_sequence(spark, folder).selectExpr("issuer", "value AS src", "next AS tgt")
    return M.closure(edges, ["issuer"])


@register("WITH y AS (SELECT DISTINCT issuer, fiscal_year AS y FROM finqa_examples) SELECT issuer, y AS node, row_number() OVER (PARTITION BY issuer ORDER BY y) - 1 AS level, false AS cyclic FROM y")
def event_timeline(spark: SparkSession, folder: str) -> DataFrame:
    s = year_sequence(spark, folder)
    nodes = examples(spark, folder).selectExpr("issuer", "fiscal_year AS node")
    return M.timeline(nodes, s.selectExpr("issuer", "value AS src", "next AS tgt"), ["issuer"])


_SPANS = "sp AS (SELECT o_custkey AS k, o_orderpriority AS e, min(o_orderdate) AS s, max(o_orderdate) AS f FROM orders GROUP BY ALL HAVING min(o_orderdate) < max(o_orderdate))"
_ALLEN = """CASE WHEN a.f < b.s THEN 'before' WHEN b.f < a.s THEN 'after' WHEN a.f = b.s THEN 'meets' WHEN b.f = a.s THEN 'met_by' WHEN a.s = b.s AND a.f = b.f THEN 'equal' WHEN a.s = b.s AND a.f < b.f THEN 'starts' WHEN a.s = b.s THEN 'started_by'
    WHEN a.f = b.f AND a.s > b.s THEN 'finishes' WHEN a.f = b.f THEN 'finished_by' WHEN a.s > b.s AND a.f < b.f THEN 'during' WHEN a.s < b.s AND a.f > b.f THEN 'contains' WHEN a.s < b.s THEN 'overlaps' ELSE 'overlapped_by' END"""


def _intervals(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("e")).agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("f"))
    return o.filter("s < f")


@register(f"WITH {_SPANS} SELECT a.k, a.e AS src, b.e AS tgt, {_ALLEN} AS rel FROM sp a JOIN sp b ON a.k = b.k AND a.e <> b.e")
def allen_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Relations of a customer's spans of orders by priority."""
    s = _intervals(spark, folder)
    a, b = s.selectExpr("k", "e AS src", "s AS s1", "f AS f1"), s.selectExpr("k", "e AS tgt", "s AS s2", "f AS f2")
    return a.join(b, "k").filter("src <> tgt").selectExpr("k", "src", "tgt", f"{M.allen_relation('s1', 'f1', 's2', 'f2')} AS rel")


@register(
    f"""WITH {_SPANS}, r AS (SELECT a.k, a.e AS src, b.e AS tgt, {_ALLEN} AS rel FROM sp a JOIN sp b ON a.k = b.k AND a.e <> b.e) SELECT x.k, x.src, x.tgt, x.rel, y.rel AS inverse FROM r x JOIN r y ON y.k = x.k AND y.src = x.tgt AND y.tgt = x.src"""
)
def allen_inverse(spark: SparkSession, folder: str) -> DataFrame:
    """Relations with their inverses, which the SQL takes from the spans the other way round."""
    inverse = F.create_map(*[F.lit(x) for kv in M.INVERSE.items() for x in kv])
    return allen_intervals(spark, folder).withColumn("inverse", inverse[F.col("rel")])


@register(
    rf"""WITH {_SENT} SELECT row_id, para, pos, CAST(nullif(regexp_extract(sentence, '\b((?:19|20)\d\d)\b', 1), '') AS INTEGER) AS year, CAST(nullif(regexp_extract(sentence, '(?i)\bQ([1-4])\b', 1), '') AS INTEGER) AS quarter FROM sent"""
)
def span_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(spark, folder).selectExpr("row_id", "para", "pos", f"{M.span_anchor('sentence')} AS a").select("row_id", "para", "pos", "a.*")


_COMP = ", ".join(f"('{a}', '{b}', [{', '.join(_q(x) for x in sorted(v))}])" for (a, b), v in sorted(M.composition().items()))


@register(
    f"""WITH {_SPANS}, r AS (SELECT a.k, a.e AS src, b.e AS tgt, {_ALLEN} AS rel FROM sp a JOIN sp b ON a.k = b.k AND a.e <> b.e), c(r1, r2, possible) AS (VALUES {_COMP})
    SELECT x.k, x.src, y.src AS mid, y.tgt, len(c.possible) AS n_possible, list_contains(c.possible, z.rel) AS holds FROM r x JOIN r y ON x.k = y.k AND x.tgt = y.src AND x.src <> y.tgt JOIN r z ON z.k = x.k AND z.src = x.src AND z.tgt = y.tgt JOIN c ON c.r1 = x.rel AND c.r2 = y.rel"""
)
def allen_compose(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every composition of two relations holds the third."""
    r = allen_intervals(spark, folder)
    x, y, z = r.selectExpr("k", "src", "tgt AS mid", "rel AS r1"), r.selectExpr("k", "src AS mid", "tgt", "rel AS r2"), r.selectExpr("k", "src", "tgt", "rel")
    j = x.join(y, ["k", "mid"]).filter("src <> tgt").join(z, ["k", "src", "tgt"]).join(F.broadcast(M.composition_table(spark)), ["r1", "r2"])
    return j.selectExpr("k", "src", "mid", "tgt", "cast(size(possible) as bigint) AS n_possible", "array_contains(possible, rel) AS holds")


@register()
def allen_infer(spark: SparkSession, folder: str) -> DataFrame:
    """Relations that follow for customers when only those between neighbouring priorities are known."""
    r = allen_intervals(spark, folder).filter("substr(tgt, 1, 1) = cast(substr(src, 1, 1) as int) + 1").withColumn("confidence", F.lit(0.9))
    return M.inferred_relations(r, ["k"])


@register(
    """WITH RECURSIVE f AS (SELECT o_custkey AS k, CAST(left(o_orderpriority, 1) AS INTEGER) AS e, min(o_orderdate) AS d FROM orders GROUP BY ALL), g AS (SELECT a.k, a.e AS src, b.e AS tgt, date_diff('day', a.d, b.d) AS x FROM f a JOIN f b ON a.k = b.k AND b.e = a.e + 1),
    r AS (SELECT k, src, tgt, CAST(x - 5 AS DOUBLE) AS lo, CAST(x + 5 AS DOUBLE) AS hi FROM g), p AS (SELECT * FROM r UNION ALL SELECT p.k, p.src, r.tgt, p.lo + r.lo, p.hi + r.hi FROM p JOIN r ON p.k = r.k AND p.tgt = r.src)
    SELECT * FROM p"""
)
def stn_tighten(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of days between a customer's first orders of each priority, from those between neighbouring ones."""
    f = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k"), F.expr("cast(left(o_orderpriority, 1) as int)").alias("e")).agg(F.min("o_orderdate").alias("d"))
    g = f.selectExpr("k", "e AS src", "d AS d1").join(f.selectExpr("k", "e AS tgt", "e - 1 AS src", "d AS d2"), ["k", "src"])
    b = g.selectExpr("k", "src", "tgt", "cast(datediff(d2, d1) - 5 as double) AS lo", "cast(datediff(d2, d1) + 5 as double) AS hi")
    return M.tighten(b, ["k"]).drop("consistent")


@register(
    """WITH RECURSIVE y AS (SELECT DISTINCT issuer, fiscal_year AS y FROM finqa_examples), e AS (SELECT issuer, y, lead(y) OVER (PARTITION BY issuer ORDER BY y) AS n FROM y),
    r AS (SELECT issuer, y AS src, y AS tgt, 0 AS length, CAST(y AS VARCHAR) AS path FROM (SELECT issuer, min(y) AS y FROM y GROUP BY issuer) UNION ALL SELECT r.issuer, r.src, e.n, r.length + 1, r.path || ' > ' || e.n FROM r JOIN e ON e.issuer = r.issuer AND e.y = r.tgt WHERE e.n IS NOT NULL)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY tgt DESC) = 1"""
)
def temporal_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The shortest way from the first to the last year of each issuer."""
    y = examples(spark, folder).selectExpr("issuer", "fiscal_year AS y")
    asked = y.groupBy("issuer").agg(F.min("y").alias("src"), F.max("y").alias("tgt"))
    edges = year_sequence(spark, folder).selectExpr("issuer", "value AS src", "next AS tgt")
    return M.shortest_paths(edges, asked, ["issuer"]).selectExpr("issuer", "src", "tgt", "length", "array_join(path, ' > ') AS path")


@register()
def all_event_relations(spark: SparkSession, folder: str) -> DataFrame:
    return M.all_event_relations(sentences(spark, folder), ["row_id"])


@register()
def temporal_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """Order of the kinds of events of every example, from all relations told, with the problems of each example counted."""
    e = _typed_edges(spark, folder).filter("src <> tgt").groupBy("row_id", "src", "tgt", "rel").agg(F.max("confidence").alias("confidence"))
    got = M.propagated(e, ["row_id"])
    n = got["problems"].groupBy("row_id").agg(F.count("*").alias("problems"))
    return got["order"].join(n, "row_id", "left").na.fill(0, ["problems"])


_TYPED = f"{_RELS}, ty AS (SELECT DISTINCT row_id, {_EVENT.replace('sentence', 'l')} AS src, {_EVENT.replace('sentence', 'r')} AS tgt, rel FROM er)"
_PREC = "CASE {0} WHEN 'before' THEN 1 WHEN 'meets' THEN 1 WHEN 'overlaps' THEN 1 WHEN 'after' THEN -1 WHEN 'met_by' THEN -1 WHEN 'overlapped_by' THEN -1 ELSE 0 END"


def _typed_edges(spark: SparkSession, folder: str) -> DataFrame:
    r = sentences(spark, folder).selectExpr("row_id", f"{M.event_relation('sentence')} AS x").filter("x is not null").select("row_id", "x.*")
    return r.selectExpr("row_id", f"{M.event_type('left')} AS src", f"{M.event_type('right')} AS tgt", "rel", "confidence")


@register(
    f"""WITH RECURSIVE {_TYPED}, so AS (SELECT row_id, src AS a, tgt AS b FROM ty WHERE rel IN ('before', 'meets') AND src <> tgt UNION SELECT row_id, tgt, src FROM ty WHERE rel IN ('after', 'met_by') AND src <> tgt),
    rc AS (SELECT * FROM so UNION SELECT rc.row_id, rc.a, so.b FROM rc JOIN so ON so.row_id = rc.row_id AND so.a = rc.b) SELECT a.row_id, a.src, a.tgt, a.rel, b.rel AS back, 'conflicting precedence' AS problem FROM ty a JOIN ty b ON a.row_id = b.row_id AND a.src = b.tgt AND a.tgt = b.src WHERE a.src < a.tgt AND {_PREC.format('a.rel')} * {_PREC.format('b.rel')} = 1
    UNION ALL SELECT row_id, src, tgt, rel, rel, 'self loop' FROM ty WHERE src = tgt AND rel <> 'equal'
    UNION ALL SELECT DISTINCT row_id, a, b, 'before', 'before', 'before cycle' FROM rc WHERE a = b"""
)
def precedence_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return M.conflicts(_typed_edges(spark, folder).select("row_id", "src", "tgt", "rel").distinct(), ["row_id"])


@register(
    f"""WITH {_RELS}, te AS (SELECT row_id, {_EVENT.replace('sentence', 'l')} AS src, {_EVENT.replace('sentence', 'r')} AS tgt, rel, round(least(1.0, 0.6 + CASE WHEN signal IN ({', '.join(_q(s) for s in M.STRONG)}) THEN 0.15 ELSE 0 END
        + CASE CAST({_ANCH.format('l')} AS INT) + CAST({_ANCH.format('r')} AS INT) WHEN 2 THEN 0.15 WHEN 1 THEN 0.05 ELSE 0 END + least(0.1, 0.02 * ({_FIN}))), 4) AS confidence FROM er),
    g AS (SELECT row_id, src, tgt, rel, max(confidence) AS confidence FROM te GROUP BY ALL),
    bad AS (SELECT DISTINCT a.row_id, a.src AS x, a.tgt AS y FROM g a JOIN g b ON a.row_id = b.row_id AND a.src = b.tgt AND a.tgt = b.src WHERE a.src < a.tgt AND {_PREC.format('a.rel')} * {_PREC.format('b.rel')} = 1),
    lose AS (SELECT g.row_id, g.src, g.tgt FROM g JOIN bad ON bad.row_id = g.row_id AND bad.x = least(g.src, g.tgt) AND bad.y = greatest(g.src, g.tgt) QUALIFY row_number() OVER (PARTITION BY g.row_id, bad.x, bad.y ORDER BY g.confidence, g.src DESC, g.rel) = 1)
    SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM lose l WHERE l.row_id = g.row_id AND l.src = g.src AND l.tgt = g.tgt)"""
)
def pruned_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = _typed_edges(spark, folder).groupBy("row_id", "src", "tgt", "rel").agg(F.max("confidence").alias("confidence"))
    return M.pruned(e, ["row_id"])


_SERIES = rf"""{D.CELLS}, n AS (SELECT row_id, row_idx, label, col_idx, TRY_CAST(nullif(regexp_extract(header, '\b(?:FY)?((?:19|20)\d\d)\b', 1), '') AS INTEGER) AS year, CASE WHEN {D.cell_type('raw')} IN ('numeric','percentage','currency') THEN {D.financial('raw')} END AS v FROM cells WHERE col_idx > 0),
    t AS (SELECT row_id, row_idx, label, list(v ORDER BY year, col_idx, v) AS v FROM n WHERE year IS NOT NULL AND v IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)"""


@register(
    rf"""WITH {_SENT}, {_SERIES}, {_RELS.replace(_SENT + ", ", "")}, ev AS (SELECT row_id, l, r, rel, round(least(1.0, 0.6 + CASE WHEN signal IN ({', '.join(_q(s) for s in M.STRONG)}) THEN 0.15 ELSE 0 END
        + CASE CAST({_ANCH.format('l')} AS INT) + CAST({_ANCH.format('r')} AS INT) WHEN 2 THEN 0.15 WHEN 1 THEN 0.05 ELSE 0 END + least(0.1, 0.02 * ({_FIN}))), 4) AS confidence, signal FROM er),
    ed AS (SELECT * FROM (SELECT DISTINCT * FROM ev) QUALIFY row_number() OVER (PARTITION BY row_id, left(lower(l), 40), left(lower(r), 40), rel ORDER BY l, r, rel, signal, confidence) = 1),
    me AS (SELECT n.row_id, n.label, n.year, n.v FROM n JOIN t USING (row_id, row_idx, label) WHERE n.year IS NOT NULL AND n.v IS NOT NULL),
    ys AS (SELECT row_id, year AS y FROM me UNION SELECT row_id, unnest({D.years('sentence')}) FROM sent), nx AS (SELECT row_id, y, lead(y) OVER (PARTITION BY row_id ORDER BY y) AS z FROM ys)
    SELECT row_id, 'measured' AS kind, label AS src, CAST(year AS VARCHAR) AS tgt, 'in' AS rel, v AS value FROM me UNION ALL SELECT row_id, 'event', lower(l), lower(r), rel, confidence FROM ed UNION ALL SELECT row_id, 'precedes', CAST(y AS VARCHAR), CAST(z AS VARCHAR), 'before', NULL FROM nx WHERE z IS NOT NULL"""
)
def temporal_graph(spark: SparkSession, folder: str) -> DataFrame:
    return M.temporal_graph(examples(spark, folder), sentences(spark, folder))


@register(
    f"""WITH {_SERIES}, c AS (SELECT *, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS c, list_sum(v) / len(v) AS m FROM t), g AS (SELECT *, greatest(abs(m), 1e-9) AS g, list_sum(c) / len(c) AS a FROM c)
    SELECT row_id, row_idx, CASE WHEN len(list_filter(c, lambda x: abs(x) / g >= 0.02)) = 0 THEN 'stable' WHEN len(list_filter(c, lambda x: x <= 0)) = 0 THEN 'increasing' WHEN len(list_filter(c, lambda x: x >= 0)) = 0 THEN 'decreasing' WHEN abs(a) / g < 0.02 THEN 'stable' ELSE 'fluctuating' END AS trend,
        round(v[len(v)] - v[1], 4) AS total_change, CASE WHEN v[1] <> 0 AND v[len(v)] / v[1] > 0 THEN round(pow(v[len(v)] / v[1], 1.0 / (len(v) - 1)) - 1, 6) END AS cagr FROM g"""
)
def trend_cagr(spark: SparkSession, folder: str) -> DataFrame:
    t = M.table_trends(examples(spark, folder)).selectExpr("row_id", "row_idx", f"{M.trend('`values`')} AS t")
    return t.selectExpr("row_id", "row_idx", "t.trend", "round(t.total_change, 4) AS total_change", "t.cagr")


@register(
    f"""WITH {_SERIES}, s AS (SELECT row_id, row_idx, v, list_sum(v) / len(v) AS m, sqrt(list_sum(list_transform(v, lambda x: (x - list_sum(v) / len(v)) * (x - list_sum(v) / len(v)))) / len(v)) AS sd FROM t WHERE len(v) >= 3), u AS (SELECT row_id, row_idx, unnest(range(len(v))) AS i, unnest(v) AS x, m, sd FROM s WHERE sd > 0)
    SELECT row_id, row_idx, CAST(i AS INTEGER) AS place FROM u WHERE abs(x - m) / sd > 1.4"""
)
def trend_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers more than 1.4 deviations from their row's mean; two deviations can't be reached by rows of four."""
    t = M.table_trends(examples(spark, folder)).filter("size(`values`) >= 3")
    z = X.lets([("m", "aggregate(`values`, 0D, (s, x) -> s + x) / size(`values`)"), ("sd", "sqrt(aggregate(`values`, 0D, (s, x) -> s + (x - m) * (x - m)) / size(`values`))")], "if(sd = 0, array(), filter(sequence(0, size(`values`) - 1), i -> abs(`values`[i] - m) / sd > 1.4))")
    return t.selectExpr("row_id", "row_idx", f"explode({z}) AS place")


@register(
    f"""WITH {_SERIES}, u AS (SELECT row_id, row_idx, unnest(range(len(v))) AS i, unnest(v) AS x FROM t), d AS (SELECT *, x - lag(x) OVER w AS c FROM u WINDOW w AS (PARTITION BY row_id, row_idx ORDER BY i)), e AS (SELECT *, c - lag(c) OVER w AS s FROM d WINDOW w AS (PARTITION BY row_id, row_idx ORDER BY i)),
    f AS (SELECT *, lag(s) OVER w AS p FROM e WINDOW w AS (PARTITION BY row_id, row_idx ORDER BY i)) SELECT row_id, row_idx, CAST(i - 1 AS INTEGER) AS place FROM f WHERE s * p < 0"""
)
def trend_inflections(spark: SparkSession, folder: str) -> DataFrame:
    t = M.table_trends(examples(spark, folder)).selectExpr("row_id", "row_idx", f"{M.trend('`values`')} AS t")
    return t.selectExpr("row_id", "row_idx", "explode(t.inflections) AS place")


# Causal text

_PK = "CASE " + " ".join(f"WHEN regexp_matches(sentence, {_q('(?i)' + p)}) THEN {i + 1}" for i, (p, _, _) in enumerate(C.PATTERNS)) + " END"


def _group(n: int) -> str:
    return "CASE k " + " ".join(f"WHEN {i + 1} THEN regexp_extract(sentence, {_q('(?i)' + p)}, {n})" for i, (p, w, _) in enumerate(C.PATTERNS) if n < 3 or w == "m") + " END"


def _span(x: str) -> str:
    return rf"trim(regexp_replace(trim(regexp_replace(regexp_replace(trim({x}), '[.,;:]+$', ''), '\s+', ' ', 'g')), '(?i)^(?:the|a|an|and|or|but|that|this|which|to)\s+', ''))"


def _cnt(words, x: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({x}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


_WAY = "[" + ", ".join(f"'{w}'" for _, w, _ in C.PATTERNS) + "]"
_MECH = "[" + ", ".join(f"'{m}'" for _, _, m in C.PATTERNS) + "]"
_KNOWN = ", ".join(sorted({f"'{a}>{b}'" for a in S.NODES for b in S.DESCENDANTS[a] if S.paths(a, b)}))
_NODE = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
_METRIC = "len(list_intersect(regexp_extract_all(lower({0}), '\\w+'), [" + ", ".join(f"'{w}'" for w in C.METRIC_WORDS) + "])) > 0"
_LAG = "coalesce(" + ", ".join(f"nullif(regexp_extract(sentence, {_q('(?i)' + p)}, {g}), '')" for p, g in C.LAGS) + ")"
_LEN = r"CASE WHEN len(regexp_split_to_array({0}, '\s+')) < 2 THEN 0.08 WHEN len(regexp_split_to_array({0}, '\s+')) > 28 THEN 0.06 ELSE 0 END"
_CAUSAL = f"""{_SENT}, k AS (SELECT *, {_PK} AS k FROM sent), g AS (SELECT *, {_WAY}[k] AS w, {_MECH}[k] AS mechanism, {_group(1)} AS g1, {_group(2)} AS g2, {_group(3)} AS g3 FROM k WHERE k IS NOT NULL),
    ce AS (SELECT row_id, para, pos, sentence, mechanism, {_span("CASE WHEN w = 'c' THEN g1 ELSE g2 END")} AS c, {_span("CASE WHEN w = 'e' THEN g1 WHEN w = 'm' THEN g3 ELSE g2 END")} AS e FROM g),
    fl AS (SELECT *, CASE WHEN ({_NODE.format('c')} || '>' || {_NODE.format('e')}) IN ({_KNOWN}) THEN 1 WHEN ({_NODE.format('e')} || '>' || {_NODE.format('c')}) IN ({_KNOWN}) THEN -1 ELSE 0 END AS way,
        coalesce(list_min({D.years('c')}) > list_max({D.years('e')}), false) AS late, NOT ({_METRIC.format('c')}) AND NOT ({_METRIC.format('e')}) AS dull FROM ce WHERE c <> '' AND e <> ''),
    rel AS (SELECT row_id, para, pos, CASE WHEN way = -1 THEN e ELSE c END AS cause, CASE WHEN way = -1 THEN c ELSE e END AS effect, mechanism, {_LAG} AS lag,
        CASE sign({_cnt(C.POSITIVE, "lower(c || ' ' || e)")} - {_cnt(C.NEGATIVE, "lower(c || ' ' || e)")}) WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS polarity,
        round(greatest(0.0, least(1.0, 0.35 + least(0.25, 0.05 * {_cnt(C.STRONG, 'lower(sentence)')}) - least(0.12, 0.04 * {_cnt(C.WEAK, 'lower(sentence)')}) + least(0.2, 0.03 * {_cnt(C.SUBJECTS, "lower(c || ' ' || e)")})
            + CASE WHEN mechanism IN ('direct', 'attribution', 'logical', 'conditional') THEN 0.08 ELSE 0 END + CASE WHEN {_LAG} IS NOT NULL THEN 0.05 ELSE 0 END - {_LEN.format('c')} - {_LEN.format('e')}))
            * CASE WHEN late THEN 0.05 ELSE 1.0 END * CASE WHEN dull THEN 0.1 ELSE 1.0 END * CASE WHEN way = 0 THEN 0.7 ELSE 1.0 END, 6) AS confidence FROM fl)"""


@register(f"WITH {_CAUSAL} SELECT row_id, para, pos, cause, effect, mechanism, lag, polarity, confidence FROM rel")
def causal_spans(spark: SparkSession, folder: str) -> DataFrame:
    return C.relations(sentences(spark, folder), ["row_id", "para", "pos"]).select("row_id", "para", "pos", "cause", "effect", "mechanism", "lag", "polarity", "confidence")


@register(f"WITH {_CAUSAL} SELECT row_id, lower(trim(cause)) AS cause, lower(trim(effect)) AS effect, max(confidence) AS confidence FROM rel GROUP BY ALL HAVING max(confidence) >= 0.3")
def causal_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return C.merged(C.relations(sentences(spark, folder), ["row_id"]), ["row_id"], 0.3)


@register(
    f"""WITH {_CAUSAL}, en AS (SELECT row_id, confidence, lower(trim(cause)) AS c, lower(trim(effect)) AS e FROM rel), nn AS (SELECT row_id, count(DISTINCT n) AS num_nodes FROM (SELECT row_id, c AS n FROM en UNION ALL SELECT row_id, e FROM en) WHERE n <> '' GROUP BY row_id),
    ed AS (SELECT row_id, count(*) AS num_edges, round(avg(confidence), 8) AS mean_confidence FROM en GROUP BY row_id) SELECT ed.row_id, num_edges, mean_confidence, num_nodes, round(num_edges / greatest(1, num_nodes * (num_nodes - 1)), 6) AS density FROM ed JOIN nn USING (row_id)"""
)
def causal_graph_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return E.graph_metrics(C.relations(sentences(spark, folder), ["row_id"]), ["row_id"])


def _identified(spark: SparkSession, folder: str) -> DataFrame:
    r = cut_lineage(C.relations(sentences(spark, folder), ["row_id", "para", "pos"]))
    return r.selectExpr("row_id", "concat(para, '.', pos) AS rid", "cause", "effect", "confidence")


@register(
    f"""WITH RECURSIVE {_CAUSAL}, eg AS (SELECT row_id, lower(trim(cause)) AS a, lower(trim(effect)) AS b, confidence AS c FROM rel), st AS (SELECT DISTINCT row_id, a FROM eg),
    w AS (SELECT row_id, [a] AS path, a AS last, CAST(1 AS DOUBLE) AS m, 0 AS n FROM st UNION ALL SELECT w.row_id, list_append(w.path, eg.b), eg.b, w.m * eg.c * pow(0.92, w.n), w.n + 1 FROM w JOIN eg ON eg.row_id = w.row_id AND eg.a = w.last WHERE w.n < 3 AND NOT list_contains(w.path, eg.b))
    SELECT row_id, array_to_string(path, ' > ') AS path, n AS length, round(m, 6) AS confidence FROM w WHERE n > 0 AND (n = 3 OR NOT EXISTS (SELECT 1 FROM st WHERE st.row_id = w.row_id AND st.a = w.last))"""
)
def causal_graph_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of the graph of each example's relations."""
    return K.graph_chains(C.relations(sentences(spark, folder), ["row_id"]), ["row_id"])


@register()
def causal_reason(spark: SparkSession, folder: str) -> DataFrame:
    """What text, table and question of every example tell of causes."""
    return K.reasoned(examples(spark, folder), sentences(spark, folder)).selectExpr("*", "cf.kind AS cf_kind", "cf.var AS cf_var").drop("cf")


@register()
def causal_measures(spark: SparkSession, folder: str) -> DataFrame:
    return K.measured(K.reasoned(examples(spark, folder), sentences(spark, folder)))


@register()
def causal_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Means of all measures of causality over the examples."""
    return K.batch(causal_measures(spark, folder))


@register()
def granger_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Series of a table tested where a relation names two of its rows."""
    rels = C.relations(sentences(spark, folder), ["row_id"])
    return K.granger_from_tables(rels, examples(spark, folder).select("row_id", "table_cells"), ["row_id"])


_HEAD = "trim(regexp_replace(lower(trim(coalesce(h, ''))), '[^a-z0-9]+', '_', 'g'), '_')"
_IN = "(" + ", ".join(f"'{n}'" for n in S.NODES) + ")"


@register(
    f"""WITH h AS (SELECT DISTINCT row_id, {_HEAD} AS n FROM (SELECT row_id, unnest(table_cells[1]) AS h FROM finqa_examples WHERE len(table_cells) > 0)), f AS (SELECT row_id, n, trim(regexp_replace(n, '_?growth_?', '', 'g'), '_') AS b FROM h WHERE n <> '' AND n NOT IN {_IN}),
    g AS (SELECT row_id, n, CASE WHEN contains(n, 'margin') THEN ['revenue', 'operating_income'] WHEN contains(n, 'growth') THEN [CASE WHEN b IN {_IN} THEN b ELSE 'revenue' END] WHEN (contains(n, 'expense') OR contains(n, 'cost')) AND contains(n, 'interest') THEN []
        WHEN (contains(n, 'expense') OR contains(n, 'cost')) AND regexp_matches(n, 'sga|selling|general|admin') THEN ['sga_expense'] WHEN contains(n, 'expense') OR contains(n, 'cost') THEN ['gross_profit'] WHEN contains(n, 'income') THEN ['ebit']
        WHEN contains(n, 'earnings') OR contains(n, 'profit') THEN ['net_income'] WHEN contains(n, 'per_share') OR contains(n, 'eps') THEN ['eps'] ELSE [] END AS p FROM f)
    SELECT row_id, unnest(p) AS src, n AS tgt FROM g"""
)
def document_model(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that labels and headers of each table add to the structural model: the table is read by its first column as well as its first row."""
    return examples(spark, folder).selectExpr("row_id", f"inline({K.document_edges()})")


@register()
def causal_chains(spark: SparkSession, folder: str) -> DataFrame:
    return C.chains(_identified(spark, folder), ["row_id"])


@register()
def transitive_causes(spark: SparkSession, folder: str) -> DataFrame:
    return C.transitive(_identified(spark, folder), ["row_id"], 0.2)


@register()
def nested_causes(spark: SparkSession, folder: str) -> DataFrame:
    return C.nested(sentences(spark, folder), ["row_id"])


@register()
def multi_hop_causes(spark: SparkSession, folder: str) -> DataFrame:
    return C.multi_hop(sentences(spark, folder), ["row_id"])


_CK = "CASE " + " ".join(f"WHEN regexp_matches(t, {_q(chr(92) + 'b' + c + chr(92) + 'b')}) THEN {i + 1}" for i, (c, _) in enumerate(C.BY_LENGTH)) + " END"


@register(
    f"""WITH {_SENT}, n AS (SELECT row_id, para, pos, sentence, lead(sentence) OVER (PARTITION BY row_id, para ORDER BY pos) AS s2 FROM sent), t AS (SELECT row_id, para, pos, lower(sentence || ' ' || s2) AS t FROM n WHERE s2 IS NOT NULL), k AS (SELECT *, {_CK} AS k FROM t)
    SELECT row_id, para, pos, [{', '.join(_q(c) for c, _ in C.BY_LENGTH)}][k] AS connective, [{', '.join(_q(s) for _, s in C.BY_LENGTH)}][k] AS relation FROM k WHERE k IS NOT NULL"""
)
def discourse_connectives(spark: SparkSession, folder: str) -> DataFrame:
    return C.pairs(sentences(spark, folder), ["row_id", "para"]).filter("explicit").select("row_id", "para", "pos", "connective", "relation")


@register()
def discourse_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return C.pairs(sentences(spark, folder), ["row_id", "para"])


@register(f"WITH {_CAUSAL} SELECT row_id, para, pos, 'If ' || cause || ' had not happened, would ' || effect || ' still have changed?' AS question FROM rel")
def counterfactual_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The question that each relation raises."""
    return C.relations(sentences(spark, folder), ["row_id", "para", "pos"]).selectExpr("row_id", "para", "pos", f"{C.counterfactual_question('cause', 'effect')} AS question")


@register(f"SELECT row_id, regexp_matches(question, {_q(C.CAUSAL_QUESTION)}) AS is_causal FROM finqa_examples")
def causal_questions(spark: SparkSession, folder: str) -> DataFrame:
    return examples(spark, folder).selectExpr("row_id", f"question rlike {X.quoted(C.CAUSAL_QUESTION)} AS is_causal")


# Series

_POINTS = "pts AS (SELECT o_orderpriority AS k, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS t, CAST(count(*) AS DOUBLE) AS x, CAST(avg(o_totalprice) AS DOUBLE) AS y FROM orders GROUP BY 1, 2)"


def _points(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly counts and mean prices of orders by priority."""
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.expr("year(o_orderdate) * 12 + month(o_orderdate)").alias("t")).agg(F.count("*").cast("double").alias("x"), F.avg("o_totalprice").alias("y"))


@register(
    f"""WITH {_POINTS}, d AS (SELECT k, y, lag(y) OVER w AS b, lag(x) OVER w AS a FROM pts WINDOW w AS (PARTITION BY k ORDER BY t)), e AS (SELECT * FROM d WHERE a IS NOT NULL),
    g AS (SELECT k, count(*) AS n, var_pop(y) * count(*) AS syy, var_pop(b) * count(*) AS sbb, var_pop(a) * count(*) AS saa, covar_pop(y, b) * count(*) AS syb, covar_pop(y, a) * count(*) AS sya, covar_pop(a, b) * count(*) AS sab FROM e GROUP BY k),
    r AS (SELECT k, n, syy, syy - syb * syb / sbb AS small, syy - (syb * syb * saa - 2 * syb * sya * sab + sya * sya * sbb) / (sbb * saa - sab * sab) AS full_rss FROM g)
    SELECT k, n, round((small - full_rss) / (full_rss / (n - 3)), 4) AS f, round((small - full_rss) / syy, 6) AS gain FROM r"""
)
def granger_lag1(spark: SparkSession, folder: str) -> DataFrame:
    return I.granger_lag1(_points(spark, folder), ["k"])


@register(
    f"""WITH {_POINTS}, c AS (SELECT k, quantile_cont(x, [1.0 / 3, 2.0 / 3]) AS cx, quantile_cont(y, [1.0 / 3, 2.0 / 3]) AS cy FROM pts GROUP BY k), b AS (SELECT k, t, len(list_filter(cx, lambda c: x >= c)) AS bx, len(list_filter(cy, lambda c: y >= c)) AS ybin FROM pts JOIN c USING (k)),
    r AS (SELECT k, ybin AS a, lag(ybin) OVER w AS b, lag(bx) OVER w AS c FROM b WINDOW w AS (PARTITION BY k ORDER BY t)), j AS (SELECT k, a, b, c, count(*) AS n FROM r WHERE b IS NOT NULL GROUP BY ALL),
    p AS (SELECT k, n, sum(n) OVER (PARTITION BY k, b, c) AS bc, sum(n) OVER (PARTITION BY k, a, b) AS ab, sum(n) OVER (PARTITION BY k, b) AS pb, sum(n) OVER (PARTITION BY k) AS total FROM j)
    SELECT k, round(greatest(0.0, sum(n / total * ln((n / bc) / (ab / pb)))), 6) AS te FROM p GROUP BY k"""
)
def transfer_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return I.transfer_entropy(_points(spark, folder), ["k"])


@register()
def granger_full(spark: SparkSession, folder: str) -> DataFrame:
    return I.granger(_points(spark, folder), ["k"])


# The structural model

_EDGE_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in S.EDGES)


@register(f"WITH RECURSIVE e(a, b) AS (VALUES {_EDGE_VALUES}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS node, 'descendant' AS relation, b AS other FROM r UNION ALL SELECT b, 'ancestor', a FROM r")
def scm_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return S.graph_table(spark)


@register(
    f"""WITH RECURSIVE e(a, b) AS (VALUES {_EDGE_VALUES}), r(s, t, p) AS (SELECT a, b, [a, b] FROM e UNION ALL SELECT r.s, e.b, list_append(r.p, e.b) FROM r JOIN e ON e.a = r.t WHERE len(r.p) < 6 AND NOT list_contains(r.p, e.b))
    SELECT s AS source, t AS target, array_to_string(p, ' > ') AS path, CAST(len(p) AS INTEGER) AS length FROM r"""
)
def scm_paths(spark: SparkSession, folder: str) -> DataFrame:
    return S.paths_table(spark)


@register(f"WITH e(a, b) AS (VALUES {_EDGE_VALUES}), n AS (SELECT a AS n FROM e UNION SELECT b FROM e) SELECT CAST(count(*) AS INTEGER) AS num_nodes, {len(S.EDGES)} AS num_edges, {len(S.EQUATIONS)} AS num_equations, CAST(count(*) FILTER (n NOT IN (SELECT b FROM e)) AS INTEGER) AS num_exogenous FROM n")
def scm_structure(spark: SparkSession, folder: str) -> DataFrame:
    return S.structure(spark)


def _observed(spark: SparkSession, folder: str) -> DataFrame:
    """Examples with their observed variables as columns; written once, as the expressions over them are long."""
    o = examples(spark, folder).selectExpr("row_id", f"{T.observed_variables()} AS observed").filter("size(observed) > 0")
    return S.observed_columns(cut_lineage(o)).drop("observed")


_OBS = f"""{D.CELLS}, ov AS (SELECT c.row_id, c.row_idx, CASE {' '.join(f"WHEN regexp_matches(c.label, '{'|'.join(a)}') THEN '{v}'" for v, a in T.ALIASES)} END AS var, {D.plain_float("translate(raw, ',$%', '')")} AS val
    FROM cells c JOIN heads h USING (row_id) WHERE c.col_idx = CASE WHEN len(h.head) > 1 THEN len(h.head) - 1 ELSE 1 END), ol AS (SELECT row_id, var, val FROM ov WHERE var IS NOT NULL AND val IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id, var ORDER BY row_idx DESC) = 1),
    o AS (SELECT row_id, {', '.join(f"max(val) FILTER (var = '{n}') AS {n}" for n in S.NODES)} FROM ol GROUP BY row_id)"""
_Z = {n: f"coalesce({n}, 0)" for n in S.NODES}


@register(
    f"""WITH {_OBS}, d AS (SELECT *, revenue * 1.2 AS x FROM o WHERE revenue IS NOT NULL), e AS (SELECT *, x - {_Z['input_costs']} AS gp FROM d), f AS (SELECT *, gp - {_Z['depreciation']} - {_Z['sga_expense']} AS oi FROM e), g AS (SELECT *, (oi - {_Z['interest_expense']}) * (1 - {_Z['tax_rate']}) AS ni FROM f)
    SELECT row_id, round(x, 4) AS revenue, round(gp, 4) AS gross_profit, round(oi, 4) AS operating_income, round(ni, 4) AS net_income, round(oi / greatest(abs(x), 1e-10), 6) AS operating_margin FROM g"""
)
def scm_do(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts if revenue were a fifth higher."""
    o = _observed(spark, folder).filter("o_revenue is not null").withColumn("do_var", F.lit("revenue")).withColumn("do_val", F.col("o_revenue") * 1.2)
    return S.intervened(o).selectExpr("row_id", "round(d_revenue, 4) AS revenue", "round(d_gross_profit, 4) AS gross_profit", "round(d_operating_income, 4) AS operating_income", "round(d_net_income, 4) AS net_income", "round(d_operating_margin, 6) AS operating_margin")


@register(
    f"""WITH {_OBS}, u AS (SELECT *, gross_profit - ({_Z['revenue']} - {_Z['input_costs']}) AS ug, operating_income - ({_Z['gross_profit']} - {_Z['depreciation']} - {_Z['sga_expense']}) AS uo FROM o WHERE input_costs IS NOT NULL),
    c AS (SELECT row_id, {_Z['revenue']} - input_costs * 0.9 + coalesce(ug, 0) AS gp, {_Z['capex']} * 0.2 + coalesce(depreciation - {_Z['capex']} * 0.2, 0) AS dep, {_Z['sga_expense']} AS sga, coalesce(uo, 0) AS uo FROM u)
    SELECT row_id, round(gp, 4) AS gross_profit, round(gp - dep - sga + uo, 4) AS operating_income FROM c"""
)
def scm_counterfactual(spark: SparkSession, folder: str) -> DataFrame:
    """Profits had costs of sales been a tenth lower, all else as it was."""
    o = _observed(spark, folder).filter("o_input_costs is not null").withColumn("do_var", F.lit("input_costs")).withColumn("do_val", F.col("o_input_costs") * 0.9)
    return S.counterfactual(o).selectExpr("row_id", "round(c_gross_profit, 4) AS gross_profit", "round(c_operating_income, 4) AS operating_income")


@register(
    f"""WITH {_OBS}, b AS (SELECT row_id, revenue, input_costs, {_Z['revenue']} - {_Z['input_costs']} AS gp FROM o)
    SELECT row_id, 'revenue' AS variable, round((revenue * 1.1 - {_Z['input_costs']} - gp) / gp / 0.1, 4) AS elasticity FROM b WHERE revenue <> 0 AND gp <> 0
    UNION ALL SELECT row_id, 'input_costs', round(({_Z['revenue']} - input_costs * 1.1 - gp) / gp / 0.1, 4) FROM b WHERE input_costs <> 0 AND gp <> 0"""
)
def scm_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """Elasticities of gross profit to the two variables of its equation; ``scm_sensitivity_whole`` has all variables."""
    return S.sensitivity(_observed(spark, folder), "gross_profit", ["row_id"]).filter("variable in ('revenue', 'input_costs')").select("row_id", "variable", "elasticity")


@register()
def scm_sensitivity_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Elasticities of net income to every variable above it."""
    return S.sensitivity(_observed(spark, folder), "net_income", ["row_id"])


@register()
def scm_adjustment(spark: SparkSession, folder: str) -> DataFrame:
    """Backdoor and frontdoor sets of every pair, with whether they hold."""
    return S.identification_table(spark)


@register(f"WITH {_OBS} SELECT row_id, delta, round((1 + delta) * revenue - {_Z['input_costs']}, 6) AS outcome FROM o, (VALUES (-0.5), (-0.25), (0.0), (0.25), (0.5)) d(delta) WHERE revenue <> 0".replace("SELECT row_id, delta", "SELECT row_id, CAST(delta AS DOUBLE) AS delta"))
def scm_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return S.sweep(_observed(spark, folder), "revenue", "gross_profit", ["row_id"])


@register(f"WITH {_OBS} SELECT row_id, round(revenue - {_Z['input_costs']}, 4) AS base_outcome, revenue - {_Z['input_costs']} <> 0 AND 0.25 * abs(revenue) > 0.5 * abs(revenue - {_Z['input_costs']}) AS fragile FROM o WHERE revenue <> 0")
def scm_fragile(spark: SparkSession, folder: str) -> DataFrame:
    return S.fragile(S.sweep(_observed(spark, folder), "revenue", "gross_profit", ["row_id"]), ["row_id"])


@register(f"WITH {_OBS} SELECT row_id, round(CASE WHEN {_Z['revenue']} = 0 THEN 0 WHEN gross_profit = 0 THEN CASE WHEN gross_profit - {_Z['revenue']} = 0 THEN 1 ELSE 0 END ELSE least(1.0, abs(revenue) / abs(gross_profit)) END, 6) AS necessity FROM o WHERE gross_profit IS NOT NULL")
def cf_necessity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether gross profit needs revenue."""
    return S.necessity(_observed(spark, folder), "revenue", "gross_profit", ["row_id"])


@register()
def cf_sufficiency(spark: SparkSession, folder: str) -> DataFrame:
    return S.sufficiency(_observed(spark, folder), "revenue", "gross_profit", ["row_id"])


@register()
def cf_robustness(spark: SparkSession, folder: str) -> DataFrame:
    return S.robustness(_observed(spark, folder), "revenue", "gross_profit", ["row_id"])


@register(
    f"""WITH {_OBS} SELECT row_id, round(revenue * 1.1 - input_costs * 0.95, 4) AS gross_profit, round(revenue * 1.1 - input_costs * 0.95 - coalesce(depreciation, {_Z['capex']} * 0.2) - {_Z['sga_expense']}, 4) AS operating_income FROM o WHERE revenue IS NOT NULL AND input_costs IS NOT NULL"""
)
def scm_scenario(spark: SparkSession, folder: str) -> DataFrame:
    """Profits with revenue a tenth higher and costs of sales a twentieth lower."""
    o = _observed(spark, folder).filter("o_revenue is not null and o_input_costs is not null")
    s = S.scenario(o, {"revenue": F.col("o_revenue") * 1.1, "input_costs": F.col("o_input_costs") * 0.95})
    return s.selectExpr("row_id", "round(s_gross_profit, 4) AS gross_profit", "round(s_operating_income, 4) AS operating_income")


@register(f"WITH {_OBS} SELECT row_id, round(((coalesce(revenue, 0) + 0.01 * greatest(1, abs(coalesce(revenue, 0))) - {_Z['input_costs']}) - (coalesce(revenue, 0) - {_Z['input_costs']})) / (0.01 * greatest(1, abs(coalesce(revenue, 0)))), 4) AS marginal FROM o")
def scm_marginal(spark: SparkSession, folder: str) -> DataFrame:
    """What a unit of revenue brings of gross profit."""
    return S.marginal(_observed(spark, folder), "revenue", "gross_profit", ["row_id"])


@register(
    f"""WITH RECURSIVE e(a, b) AS (VALUES {_EDGE_VALUES}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), n AS (SELECT a AS n FROM e UNION SELECT b FROM e)
    SELECT x.n AS treatment, y.n AS outcome, coalesce((SELECT string_agg(e.a, ',' ORDER BY e.a) FROM e WHERE e.b = x.n AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = x.n AND r.b = e.a)), '') AS backdoor,
        NOT EXISTS (SELECT 1 FROM (SELECT a, b FROM r UNION SELECT n, n FROM n) p JOIN (SELECT a, b FROM r UNION SELECT n, n FROM n) q ON p.a = q.a WHERE p.b = x.n AND q.b = y.n) AS separated
    FROM n x, n y WHERE x.n <> y.n"""
)
def scm_identification(spark: SparkSession, folder: str) -> DataFrame:
    """Adjustment sets of every pair, and whether nothing links it: two variables are linked if one is above both or they are one."""
    return S.identification_table(spark).select("treatment", "outcome", "backdoor", "separated")


@register(
    f"""WITH {_OBS}, d AS (SELECT *, revenue * 1.2 - {_Z['input_costs']} AS gp FROM o WHERE revenue IS NOT NULL), f AS (SELECT *, gp - {_Z['depreciation']} - {_Z['sga_expense']} AS oi FROM d), g AS (SELECT *, (oi - {_Z['interest_expense']}) * (1 - {_Z['tax_rate']}) AS ni FROM f)
    SELECT row_id, 'gross_profit' AS variable, round(gross_profit, 4) AS baseline, round(gp, 4) AS counterfactual FROM g WHERE gross_profit <> 0 UNION ALL SELECT row_id, 'operating_income', round(operating_income, 4), round(oi, 4) FROM g WHERE operating_income <> 0
    UNION ALL SELECT row_id, 'net_income', round(net_income, 4), round(ni, 4) FROM g WHERE net_income <> 0"""
)
def cf_effects(spark: SparkSession, folder: str) -> DataFrame:
    """What a fifth more revenue changes among the observed profits."""
    o = _observed(spark, folder).filter("o_revenue is not null").withColumn("do_var", F.lit("revenue")).withColumn("do_val", F.col("o_revenue") * 1.2)
    return S.effects(S.intervened(o), ["row_id"]).filter("variable in ('gross_profit', 'operating_income', 'net_income')").drop("change_pct")


@register()
def cf_explanations(spark: SparkSession, folder: str) -> DataFrame:
    o = _observed(spark, folder).filter("o_revenue is not null").withColumn("do_var", F.lit("revenue")).withColumn("do_val", F.col("o_revenue") * 1.2)
    return S.explained(cut_lineage(S.intervened(o)), ["row_id"])


@register()
def cf_contrast(spark: SparkSession, folder: str) -> DataFrame:
    """What tells revenue from costs of sales as a cause."""
    return S.contrast(_observed(spark, folder), "revenue", "input_costs", ["row_id"])


@register(
    "WITH "
    + _SPANS
    + f""", r AS (SELECT a.k, a.e AS src, b.e AS tgt, {_ALLEN} AS rel FROM sp a JOIN sp b ON a.k = b.k AND a.e <> b.e)
    SELECT k, src, tgt, CASE WHEN rel IN ('before','meets','overlaps') THEN 1 WHEN rel IN ('after','met_by','overlapped_by') THEN -1 ELSE 0 END AS precedence,
        CASE WHEN rel IN ('before','meets','overlaps','during','equal','starts','started_by') THEN 0.0 END AS lo, CASE WHEN rel IN ('after','met_by','overlapped_by','contains','equal','starts','started_by') THEN 0.0 END AS hi FROM r"""
)
def allen_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Precedence and bounds that the relations of spans give; open bounds are null."""
    order = "case rel " + " ".join(f"when '{k}' then {v}" for k, v in M.PRECEDENCE.items()) + " else 0 end"
    b = allen_intervals(spark, folder).selectExpr("k", "src", "tgt", f"{order} AS precedence", f"{M.stn_bounds('rel')} AS b")
    return b.selectExpr("k", "src", "tgt", "precedence", "if(b.lo = double('-Infinity'), null, b.lo) AS lo", "if(b.hi = double('Infinity'), null, b.hi) AS hi")


@register()
def causal_priors(spark: SparkSession, folder: str) -> DataFrame:
    return C.priors(table(spark, folder, "documents"), ["doc_id"])


@register()
def cf_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Interventions on every example's accounts as parsed from what-if questions about them."""
    o = examples(spark, folder).selectExpr("row_id", f"{T.observed_variables()} AS observed").filter("size(observed) > 0")
    asks = "explode(transform(map_keys(observed), k -> concat('what if ', translate(k, '_', ' '), ' increased by 20%?'))) AS ask"
    return o.selectExpr("row_id", "observed", asks).selectExpr("row_id", "ask", f"{S.intervention('ask')} AS i", f"{S.counterfactual_kind('ask')} AS kind").selectExpr("row_id", "ask", "kind", "i.var", "round(i.val, 4) AS val", "i.action")


# Control of the loop

_SIG = f"""ca AS (SELECT row_id, count(*) AS n FROM (WITH {_CAUSAL} SELECT row_id FROM rel) GROUP BY row_id), ord AS (SELECT DISTINCT row_id FROM (WITH {_RELS} SELECT row_id FROM er)), tr AS (SELECT DISTINCT row_id FROM (WITH {_SERIES} SELECT row_id FROM t)),
    dc AS (SELECT DISTINCT row_id FROM ({SQL["discourse_connectives"]}) WHERE relation = 'contingency.cause'), pl AS ({TABLE_SQL["plausibility"]}),
    sig AS (SELECT p.pred_id, coalesce(p.predicted, '') <> '' AS success, p.predicted IS NOT NULL AS has_result, p.method IS NOT NULL AS has_program, coalesce(p.method = 'pot_prompt', false) AS is_pot, coalesce(pl.reason NOT IN ('plausible', 'none'), false) AND coalesce(p.predicted, '') <> '' AS implausible,
    p.n_iterations AS ni, p.confidence AS c, len(regexp_extract_all(coalesce(e.question, ''), '\\b(?:19|20)\\d\\d\\b')) AS n_entities, tr.row_id IS NOT NULL AS has_trend, ord.row_id IS NOT NULL AS has_constraints, coalesce(regexp_matches(lower(e.question), 'why|caus'), false) AS causal, coalesce(ca.n, 0) AS n_relations, dc.row_id IS NOT NULL AS has_discourse
    FROM predictions p JOIN finqa_examples e USING (row_id) LEFT JOIN pl ON pl.pred_id = p.pred_id LEFT JOIN ca ON ca.row_id = p.row_id LEFT JOIN ord ON ord.row_id = p.row_id LEFT JOIN tr ON tr.row_id = p.row_id LEFT JOIN dc ON dc.row_id = p.row_id)"""


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    """What a run's prediction, and the table and text of its example, show: the signals that the loop reads."""
    s = sentences(spark, folder)
    e = examples(spark, folder)
    parts = [
        C.relations(s, ["row_id"]).groupBy("row_id").agg(F.count("*").cast("int").alias("n_relations")),
        M.relations(s, ["row_id"]).select("row_id").distinct().withColumn("has_constraints", F.lit(True)),
        M.table_trends(e).select("row_id").distinct().withColumn("has_trend", F.lit(True)),
        C.pairs(s, ["row_id", "para"]).filter("explicit and relation = 'contingency.cause'").select("row_id").distinct().withColumn("has_discourse", F.lit(True)),
        K.granger_from_tables(C.relations(s, ["row_id"]), e.select("row_id", "table_cells"), ["row_id"]).select("row_id").distinct().withColumn("has_granger", F.lit(True)),
    ]
    shown = e.selectExpr("row_id", "question", r"regexp_count(coalesce(question, ''), r'\b(?:19|20)\d{2}\b') AS n_entities", "coalesce(lower(question) rlike 'why|caus', false) AS causal")
    for part in parts:
        shown = shown.join(part, "row_id", "left")
    shown = cut_lineage(shown.na.fill(0, ["n_relations"]).na.fill(False, ["has_constraints", "has_trend", "has_discourse", "has_granger"]))
    p = table(spark, folder, "predictions").selectExpr("pred_id", "row_id", "coalesce(predicted, '') <> '' AS success", "predicted is not null AS has_result", "method is not null AS has_program", "coalesce(method = 'pot_prompt', false) AS is_pot", f"{X.financial_number('predicted')} AS x")
    j = p.join(shown, "row_id").withColumn("implausible", F.expr(f"success and x is not null and not coalesce({X.plausible('x', 'question')}.ok, false)"))
    j = j.withColumn("has_temporal_context", F.expr("n_entities > 0 or has_trend")).withColumn("has_causal_context", F.expr("n_relations > 0"))
    return j.withColumn("modules", F.expr("if(causal, array('numerical', 'temporal', 'causal'), array('numerical', 'temporal'))")).drop("x")


@register(
    f"""WITH {_SIG}, s AS (SELECT *, 0.40 * CAST(success AS INT) + 0.30 * CAST(has_result AS INT) + 0.15 * CAST(has_program AS INT) + 0.15 * CAST(is_pot AS INT) - 0.25 * CAST(implausible AS INT) AS nu,
        0.25 * CAST(n_entities > 0 AS INT) + 0.20 * CAST(n_entities >= 2 AS INT) + 0.25 * CAST(has_trend AS INT) + 0.15 * CAST(n_entities > 0 OR has_trend AS INT) + 0.15 * CAST(has_constraints AS INT) AS te,
        0.50 * CAST(n_relations > 0 AS INT) + 0.15 * CAST(n_relations >= 2 AS INT) + 0.15 * CAST(has_discourse AS INT) AS cu FROM sig)
    SELECT pred_id, round(CASE WHEN causal THEN (nu + te + cu) / 3 ELSE (nu + te) / 2 END, 6) AS confidence,
        array_to_string(list_filter([CASE WHEN NOT success THEN 'execution_failure' END, CASE WHEN NOT has_result THEN 'no_result' END, CASE WHEN implausible THEN 'implausible_result' END, CASE WHEN n_entities < 2 THEN 'insufficient_entities' END, CASE WHEN NOT has_trend THEN 'no_trend' END, CASE WHEN causal AND n_relations = 0 THEN 'no_relations' END], lambda g: g IS NOT NULL), ',') AS gaps FROM s"""
)
def confidence_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return V.assessed(_signals(spark, folder)).selectExpr("pred_id", "confidence", "array_join(gaps, ',') AS gaps")


@register()
def reformulated_queries(spark: SparkSession, folder: str) -> DataFrame:
    a = V.assessed(_signals(spark, folder))
    years = r"regexp_extract_all(question, r'\b((?:19|20)\d{2})\b', 1)"
    return a.selectExpr("pred_id", f"{V.reformulated('question', 'get(gaps, 0)', years, 'cast(array() as array<string>)', 2)} AS query")


@register(
    f"""WITH {_SIG}, r AS (SELECT pred_id, CASE WHEN success AND has_result THEN 0.9 ELSE 0 END AS n, least(0.85, 0.2 + 0.08 * n_entities) AS t, CASE WHEN n_relations > 0 THEN 0.35 ELSE 0 END AS c, least(0.8, coalesce(c, 0)) AS q FROM sig)
    SELECT pred_id, round(n / (n + t + c + q), 6) AS numerical, round(t / (n + t + c + q), 6) AS temporal, round(c / (n + t + c + q), 6) AS causal, round(q / (n + t + c + q), 6) AS retrieval FROM r"""
)
def cross_attention(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "predictions").selectExpr("pred_id", "confidence AS retrieval_score")
    s = _signals(spark, folder).drop("causal").withColumn("causal_strength", F.lit(0.0)).join(p, "pred_id")
    return s.selectExpr("pred_id", f"{V.attention()} AS a").select("pred_id", "a.*")


def _answered(spark: SparkSession, folder: str) -> DataFrame:
    return A.answered(examples(spark, folder))


@register()
def ircot_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Rounds of retrieval and reasoning that each question took."""
    return _answered(spark, folder).select("row_id", "iterations", "final_confidence", "termination", "converged", "improvement")


@register()
def iteration_report(spark: SparkSession, folder: str) -> DataFrame:
    return E.iteration_metrics(_answered(spark, folder))


@register()
def answer_all(spark: SparkSession, folder: str) -> DataFrame:
    """The pipeline without a model, for every example: routes, retrieval, reasoning, loop, answer, its evidence and whether it matches."""
    out = _answered(spark, folder)
    return out.select("row_id", "primary_type", "modules", "op", "method", "iterations", "final_confidence", "termination", "predicted", "matched", "attention.*", "backward.reconstructed", F.col("backward.confidence").alias("backward_confidence"))


@register()
def answer_report(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy and iterations of the pipeline by primary type and overall."""
    a = _answered(spark, folder).withColumn("answered", F.expr("predicted <> ''"))
    return a.rollup("primary_type").agg(F.count("*").alias("n"), F.sum(F.expr("cast(answered as int)")).alias("answered"), F.sum(F.expr("cast(answered and matched as int)")).alias("correct"), F.round(F.avg("iterations"), 6).alias("mean_iterations"), F.round(F.avg("final_confidence"), 6).alias("mean_confidence"))


@register()
def induction_report(spark: SparkSession, folder: str) -> DataFrame:
    """How often the pipeline makes a program, and how often it runs."""
    a = _answered(spark, folder)
    return E.induction_rates(a.selectExpr("coalesce(size(program), 0) > 0 AS has_program", "success", "iterations AS attempts"))


@register()
def temporal_report(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of what questions and tables tell of time."""
    e = examples(spark, folder).filter("trim(question) <> ''")
    r = G.routed(e.select("row_id", "question", "fiscal_year", "table_cells")).join(A.question_trends(e), "row_id", "left")
    found = M.timex("question", "fiscal_year")
    return E.temporal_metrics(
        r.selectExpr(
            f"array_distinct(transform({M.entities('question')}, e -> e.label)) AS labels", "trend", f"cast(size(array_intersect(transform({X.years('question')}, y -> cast(y as string)), {T.header_years()})) as int) AS overlap", "joint",
            f"size({found}) AS deictic_found", f"size(filter({found}, t -> t.value is not null)) AS deictic_resolved",
        )
    )


@register()
def answer_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules alone, without retrieval and loop: the induced program, its execution, and whether it matches."""
    e = P.induced(examples(spark, folder).select("row_id", "question", "table_cells", "pre_text", "answer")).filter("question is not null")
    ready = cut_lineage(e.select("row_id", "question", "table_cells", "answer", "op", F.col("induced").alias("program")))
    done = P.executed(T.prepared(ready)).select("row_id", "question", "answer", "op", "program", "success", "result_num", "result_str")
    routed = G.routed(done).drop("joint", *[f"p_{r}" for r in G.ROUTES])
    out = routed.withColumn("refined", F.lit(None).cast("string")).withColumn("generated", F.lit(None).cast("string"))
    out = out.withColumn("predicted", F.expr(V.aggregated_answer()))
    return out.selectExpr("row_id", "op", "primary_type", "modules", "program", "predicted", f"{X.answers_match('predicted', 'answer')} AS matched")


# Sources and streams


@register(
    """SELECT record_no, json_extract_string(payload, '$.id') AS id, json_extract_string(payload, '$.qa.question') AS question, coalesce(json_extract_string(payload, '$.qa.exe_ans'), json_extract_string(payload, '$.qa.answer')) AS answer, CAST(json_array_length(payload, '$.pre_text') AS INTEGER) AS n_pre
    FROM raw_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND json_extract_string(payload, '$.id') IS NOT NULL AND coalesce(json_type(payload, '$.qa'), 'OBJECT') IN ('OBJECT', 'NULL') AND coalesce(json_type(payload, '$.table'), 'ARRAY') IN ('ARRAY', 'NULL')"""
)
def json_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records that are one page in the published shape."""
    r = table(spark, folder, "raw_records")
    shaped = json_dataset.from_payloads(r.filter("coalesce(substr(ltrim(get_json_object(payload, '$.qa')), 1, 1), '{') = '{' and coalesce(substr(ltrim(get_json_object(payload, '$.table')), 1, 1), '[') = '['"))
    return shaped.selectExpr("record_no", "id", "question", "answer", "cast(size(pre_text) as int) AS n_pre")


@register(r"SELECT row_id, array_to_string(list_transform(list_filter(program, lambda s: trim(s) <> ''), lambda s: regexp_replace(lower(trim(s)), '\s+', '', 'g')), ' ; ') AS target FROM finqa_examples WHERE trim(question) <> '' AND len(list_filter(program, lambda s: trim(s) <> '')) > 0")
def training_targets(spark: SparkSession, folder: str) -> DataFrame:
    return json_dataset.training_records(examples(spark, folder)).select("row_id", "target")


@register("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts and sums by event type: the batch form of the streaming query."""
    return windows.windowed(table(spark, folder, "events"))


@register(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return windows.sessions(table(spark, folder, "events"))
