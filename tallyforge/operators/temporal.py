"""Temporal operators: expressions of time, events and their order, interval algebra, bounds, and trends."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import expressions as X
from tallyforge.functions.expressions import quoted
from tallyforge.session import cut_lineage

# Phrases relative to an anchor year or quarter.
RELATIVE_YEARS = {
    "last year": -1, "prior year": -1, "previous year": -1, "preceding year": -1, "the year before": -1,
    "this year": 0, "current year": 0, "the current year": 0, "next year": 1, "the following year": 1,
}
RELATIVE_QUARTERS = {
    "last quarter": -1, "prior quarter": -1, "previous quarter": -1, "preceding quarter": -1, "the quarter before": -1,
    "this quarter": 0, "current quarter": 0, "next quarter": 1, "the following quarter": 1,
}
HALVES = {"first half": 1, "1st half": 1, "h1": 1, "second half": 2, "2nd half": 2, "h2": 2}
ORDINAL_QUARTERS = {"first quarter": 1, "1st quarter": 1, "second quarter": 2, "2nd quarter": 2, "third quarter": 3, "3rd quarter": 3, "fourth quarter": 4, "4th quarter": 4}

# Words of each kind of event, in order of precedence.
EVENT_TYPES = [
    ("acquisition", r"\b(acqui(?:red?|sition)|bought|purchased|takeover)\b"),
    ("merger", r"\b(merg(?:er|ed|ing)|consolidat(?:ed|ion))\b"),
    ("divestiture", r"\b(divest(?:ed|iture|ing)|sold\s+(?:its|the)|spin-?off|spun off|dispos(?:ed|al|ition))\b"),
    ("restructuring", r"\b(restructur(?:ed|ing)|reorganiz(?:ed|ation)|transformation|turnaround)\b"),
    ("ipo", r"\b(ipo|initial public offering|went public|public listing)\b"),
    ("dividend", r"\b(dividend|distribut(?:ed|ion)|payout|special dividend)\b"),
    ("buyback", r"\b(buyback|repurchas(?:ed?|ing)|share repurchase|stock repurchase)\b"),
    ("debt_issuance", r"\b(debt issuance|bond offering|borrowed|refinanc(?:ed|ing)|credit facility)\b"),
    ("guidance", r"\b(guidance|outlook|forecast|project(?:ed|ion)|expect(?:ed|ation))\b"),
    ("regulatory", r"\b(regulat(?:ory|ion)|compliance|approv(?:ed|al)|sanction|fine|penalt(?:y|ies)|litigation|settlement)\b"),
    ("product_launch", r"\b(launch(?:ed)?|introduc(?:ed|tion)|new product|roll(?:ed)?\s*out|debut(?:ed)?)\b"),
    ("cost_action", r"\b(cost(?:\s+|-)?cut(?:ting)?|layoff|headcount reduction|efficiency|savings program|workforce reduction)\b"),
    ("impairment", r"\b(impairment|write(?:\s*|-)?(?:down|off)|goodwill charge)\b"),
    ("earnings", r"\b(earnings|profit(?:ability)?|income|loss(?:es)?|beat|miss(?:ed)?)\b"),
    ("revenue", r"\b(revenue|sales|top(?:\s*|-)?line)\b"),
]

# Signal words and the relation of what stands before them to what stands after.
SIGNALS = [
    ("before", r"\bbefore\b", "before"), ("prior to", r"\bprior to\b", "before"), ("ahead of", r"\bahead of\b", "before"), ("preceding", r"\bpreceding\b", "before"),
    ("leading up to", r"\bleading up to\b", "before"), ("in advance of", r"\bin advance of\b", "before"),
    ("after", r"\bafter\b", "after"), ("following", r"\bfollowing\b", "after"), ("subsequent to", r"\bsubsequent(?:ly)? to\b", "after"), ("in the wake of", r"\bin the wake of\b", "after"), ("post", r"\bpost\b", "after"),
    ("during", r"\bduring\b", "during"), ("throughout", r"\bthroughout\b", "during"), ("in the course of", r"\bin the course of\b", "during"), ("amid", r"\bamid(?:st)?\b", "during"), ("while", r"\bwhile\b", "during"),
    ("simultaneously", r"\bsimultaneously\b", "equal"), ("at the same time", r"\bat the same time\b", "equal"), ("coincided with", r"\bcoincid(?:ed|ing) with\b", "equal"), ("alongside", r"\balongside\b", "equal"), ("concurrently", r"\bconcurrently\b", "equal"),
    ("overlapped with", r"\boverlap(?:ped|ping)?\s+with\b", "overlaps"), ("partially during", r"\bpartially during\b", "overlaps"),
    ("immediately before", r"\bimmediately (?:before|prior to)\b", "meets"), ("just before", r"\bjust before\b", "meets"), ("on the eve of", r"\bon the eve of\b", "meets"),
    ("immediately after", r"\bimmediately after\b", "met_by"), ("just after", r"\bjust after\b", "met_by"), ("right after", r"\bright after\b", "met_by"),
    ("since", r"\bsince\b", "after"), ("until", r"\buntil\b", "before"), ("when", r"\bwhen\b", "equal"), ("as soon as", r"\bas\s+(?:soon\s+as)\b", "met_by"),
]
#: The longest signal present decides, so that 'just before' isn't read as 'before'; equals in the order above.
BY_LENGTH = sorted(SIGNALS, key=lambda s: -len(s[0]))
STRONG = ("before", "after", "prior to", "following", "subsequently", "during", "simultaneously", "immediately before", "immediately after")
FINANCE_WORDS = ("revenue", "earnings", "acquisition", "restructuring", "merger", "dividend", "guidance", "launch", "margin", "growth")

# Patterns of a sequence of two events, in order of precedence.
SEQUENCES = [
    r"(.{10,80}?)\s*(?:,\s*)?(?:and\s+)?then\s+(.{10,80})",
    r"first[,\s]+(.{10,60}?)[,;]\s*(?:and\s+)?then\s+(.{10,60})",
    r"(.{10,80}?)\s*,\s*followed by\s+(.{10,80})",
    r"(.{10,80}?)\s*(?:,\s*)?which\s+(?:was\s+)?followed by\s+(.{10,80})",
    r"(.{10,80}?)\s*,\s*(?:and\s+)?subsequently\s+(.{10,80})",
    r"(.{10,80}?)\s*,\s*(?:and\s+)?later\s+(.{10,80})",
]

ALLEN = ("before", "after", "meets", "met_by", "overlaps", "overlapped_by", "starts", "started_by", "during", "contains", "finishes", "finished_by", "equal")
INVERSE = dict(zip(ALLEN, ("after", "before", "met_by", "meets", "overlapped_by", "overlaps", "started_by", "starts", "contains", "during", "finished_by", "finishes", "equal")))
PRECEDENCE = {"before": 1, "meets": 1, "overlaps": 1, "after": -1, "met_by": -1, "overlapped_by": -1}


def advance(year: str, quarter: str, delta: str) -> str:
    """struct(y, q) of a quarter moved by ``delta`` quarters."""
    total = f"({year} * 4 + {quarter} - 1 + ({delta}))"
    return f"named_struct('y', cast(floor({total} / 4) as int), 'q', cast(pmod({total}, 4) + 1 as int))"


def entities(text: str) -> str:
    """Array of (etype, y1, q1, label): years, quarters, fiscal years, halves and trailing twelve months of a text."""
    none = "cast(null as int)"
    years = f"transform(regexp_extract_all({text}, r'\\b((?:19|20)\\d{{2}})\\b', 1), y -> named_struct('etype', 'year', 'y1', cast(y as int), 'q1', {none}, 'label', y))"
    quarters = (
        f"transform(regexp_extract_all({text}, r'(?i)Q[1-4]\\s*(?:\\d{{4}})?', 0), q -> named_struct('etype', 'quarter', 'y1', try_cast(regexp_extract(q, r'(\\d{{4}})$', 1) as int), 'q1', cast(substr(q, 2, 1) as int), "
        f"'label', rtrim(concat('Q', substr(q, 2, 1), ' ', regexp_extract(q, r'(\\d{{4}})$', 1)))))"
    )
    wide = "if(y < 100, y + if(y < 50, 2000, 1900), y)"
    found = "regexp_extract_all({0}, {1}, 0)".format(text, quoted(r"(?i)(?:fiscal\s*(?:year|quarter)?\s*\d{4}|fy\s*'?\s*\d{2,4}\b)"))
    fiscal = f"transform({found}, m -> transform(array(cast(regexp_extract(m, r'(\\d+)$', 1) as int)), y -> named_struct('etype', 'fiscal_year', 'y1', {wide}, 'q1', {none}, 'label', concat('FY', {wide})))[0])"
    halves = f"transform(regexp_extract_all({text}, r'(?i)\\b(h[12]\\s*(?:of\\s+)?\\d{{4}})\\b', 1), h -> named_struct('etype', 'range', 'y1', cast(regexp_extract(h, r'(\\d{{4}})$', 1) as int), 'q1', if(substr(h, 2, 1) = '1', 1, 3), 'label', concat('H', substr(h, 2, 1), ' ', regexp_extract(h, r'(\\d{{4}})$', 1))))"
    trailing = f"if({text} rlike r'(?i)\\b(?:ttm|ltm)\\b', array(named_struct('etype', 'range', 'y1', {none}, 'q1', {none}, 'label', 'TTM/LTM')), array())"
    return f"concat({years}, {quarters}, {fiscal}, {halves}, {trailing})"


def timex(text: str, anchor: str, quarter: str = "4") -> str:
    """Array of (phrase, ttype, value): expressions of a text as absolute dates and durations from an anchor year and quarter.

    Empty for a null text or anchor.
    """
    q, parts = "q", []

    def entry(when: str, phrase: str, ttype: str, value: str) -> str:
        return f"if({when}, array(named_struct('phrase', {phrase}, 'ttype', '{ttype}', 'value', {value})), array())"

    for phrase, d in RELATIVE_YEARS.items():
        parts.append(entry(f"contains({q}, '{phrase}')", f"'{phrase}'", "DATE", f"cast({anchor} + {d} as string)"))
    for phrase, d in RELATIVE_QUARTERS.items():
        moved = f"transform(array({advance(anchor, quarter, str(d))}), a -> concat(a.y, '-Q', a.q))[0]"
        parts.append(entry(f"contains({q}, '{phrase}')", f"'{phrase}'", "DATE", moved))
    parts.append(entry(f"{q} rlike 'prior period|previous period|the period before'", "'prior period'", "DATE", "cast(null as string)"))
    parts.append(entry(f"{q} rlike 'same period last year|comparable quarter|year-ago quarter|same quarter last year'", "'same period last year'", "DATE", f"concat({anchor} - 1, '-Q', {quarter})"))

    def first(pattern: str) -> str:
        return f"try_cast(regexp_extract({q}, {quoted(pattern)}, 1) as int)"

    ago = r"(\d+)\s+years?\s+ago"
    parts.append(entry(f"{first(ago)} is not null", f"regexp_extract({q}, {quoted(ago)}, 0)", "DATE", f"cast({anchor} - {first(ago)} as string)"))
    ago = r"(\d+)\s+quarters?\s+ago"
    moved = f"transform(array({advance(anchor, quarter, '-' + first(ago))}), a -> concat(a.y, '-Q', a.q))[0]"
    parts.append(entry(f"{first(ago)} is not null", f"regexp_extract({q}, {quoted(ago)}, 0)", "DATE", moved))
    for unit, letter in (("years?", "Y"), ("quarters?", "Q")):
        past = rf"(?:over|during|in)\s+the\s+(?:past|last|previous)\s+(\d+)\s+{unit}"
        parts.append(entry(f"{first(past)} is not null", f"regexp_extract({q}, {quoted(past)}, 0)", "DURATION", f"concat('P', {first(past)}, '{letter}')"))
    parts.append(entry(f"{q} rlike 'year-to-date|ytd'", "'year-to-date'", "DURATION", f"concat({anchor}, '-YTD')"))
    for phrase, half in HALVES.items():
        year = first(rf"{phrase}\s+(?:of\s+)?(\d{{4}})")
        parts.append(entry(f"contains({q}, '{phrase}')", f"'{phrase}'", "DATE", f"concat(coalesce({year}, {anchor}), '-H{half}')"))
    for phrase, n in ORDINAL_QUARTERS.items():
        year = first(rf"{phrase}\s+(?:of\s+)?(\d{{4}})")
        parts.append(entry(f"contains({q}, '{phrase}')", f"'{phrase}'", "DATE", f"concat(coalesce({year}, {anchor}), '-Q{n}')"))
    parts.append(entry(f"{q} rlike r'\\b(?:ttm|ltm)\\b'", "'TTM/LTM'", "DURATION", "'P1Y'"))
    since = r"(?:since|following|after)\s+the\s+(merger|acquisition|restructuring|ipo|spin-?off)"
    parts.append(entry(f"{q} rlike {quoted(since)}", f"regexp_extract({q}, {quoted(since)}, 0)", "DURATION", f"concat({anchor}, '/present')"))
    return f"if({text} is null or {anchor} is null, array(), {X.lets([('q', f'lower({text})')], f'concat({", ".join(parts)})')})"


def question_flags(question: str = "question") -> str:
    """struct of eight flags of a temporal question: comparison, trend, point_lookup, relative, range, extreme, deictic, duration."""
    q, n = f"lower({question})", f"regexp_count({question}, r'\\b(?:19|20)\\d{{2}}\\b')"
    deictic = f"{q} rlike '{'|'.join([*RELATIVE_YEARS, *RELATIVE_QUARTERS])}'"
    same = f"{q} rlike 'same period last year|comparable quarter|year-ago quarter|same quarter last year'"
    duration = f"{q} rlike r'(?:over|during|in)\\s+the\\s+(?:past|last|previous)\\s+\\d+\\s+(?:years?|quarters?|months?)'"
    return (
        f"named_struct('comparison', {q} rlike 'compared to|versus|vs|relative to|from|change' or {same}, 'trend', {q} rlike 'trend|growth|over time|year-over-year|consistently', "
        f"'point_lookup', {n} = 1, 'relative', {q} rlike 'previous|prior|preceding|last|next|following|subsequent|current|this' or {deictic}, "
        f"'range', ({q} rlike 'between|from|during|throughout' and {n} >= 2) or {q} rlike 'year-to-date|ytd|first half|second half|h1|h2' or {duration}, "
        f"'extreme', {q} rlike 'highest|lowest|maximum|minimum|most|least|best|worst', 'deictic', {deictic} or {same}, 'duration', {duration})"
    )


def event_type(text: str) -> str:
    whens = " ".join(f"when {text} rlike {quoted('(?i)' + p)} then '{t}'" for t, p in EVENT_TYPES)
    return f"(case {whens} else 'other' end)"


def event_span(text: str) -> str:
    return f"regexp_replace(trim(regexp_replace(regexp_replace({text}, r'[\\s\\u00a0]+', ' '), r'^[\\s,;:.]+|[\\s,;:.]+$', '')), r'(?i)^(?:the|a|an)\\s+', '')"


def event_relation(sentence: str) -> str:
    """struct(left, right, rel, signal, confidence) of a sentence by its longest signal word; null without one or with too short spans.

    Where the sentence begins with the signal, what follows its first comma is the left event. rel is the relation of
    left to right; confidence grows with strong signals, anchors in time and words of finance.
    """
    which = "case " + " ".join(f"when s rlike {quoted('(?i)' + p)} then {i}" for i, (_, p, _) in enumerate(BY_LENGTH)) + " end"
    names, rels = (f"array({', '.join(repr(x[j]) for x in BY_LENGTH)})" for j in (0, 2))
    patterns = f"array({', '.join(quoted(x[1]) for x in BY_LENGTH)})"
    swap = "length(l0) < 5 and length(r0) >= 10 and contains(r0, ',')"
    anchored = r"({0} rlike r'\b(?:19|20)\d{{2}}\b|(?i)\bQ[1-4]\b')"
    a, b = (f"cast({anchored.format(x)} as int)" for x in ("l", "r"))
    words = " + ".join(f"if(contains(lower(concat(l, ' ', r)), '{w}'), 1, 0)" for w in FINANCE_WORDS)
    strong = ", ".join(f"'{s}'" for s in STRONG)
    confidence = f"least(1D, 0.6D + if(g in ({strong}), 0.15D, 0D) + case {a} + {b} when 2 then 0.15D when 1 then 0.05D else 0D end + least(0.1D, 0.02D * ({words})))"
    body = X.lets(
        [
            ("l0", event_span("regexp_extract(s, concat('(?is)^(.*?)', p), 1)")),
            ("r0", event_span("regexp_replace(s, concat('(?is)^.*?', p), '')")),
            ("l", f"if({swap}, {event_span('substr(r0, instr(r0, chr(44)) + 1)')}, l0)"),
            ("r", f"if({swap}, {event_span('substr(r0, 1, instr(r0, chr(44)) - 1)')}, r0)"),
        ],
        f"if(length(l) >= 5 and length(r) >= 3, named_struct('left', l, 'right', r, 'rel', get({rels}, k), 'signal', g, 'confidence', round({confidence}, 4)), null)",
    )
    return X.lets([("s", sentence), ("k", which), ("p", f"get({patterns}, k)"), ("g", f"get({names}, k)")], f"if(k is null, null, {body})")


def relations(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, right, rel, signal, confidence, left_type, right_type, left_year, right_year) of (keys, sentence).

    One row for each different pair of spans and relation of a document, whose keys are ``keys``.
    """
    r = sentences.select(*keys, F.expr(event_relation("sentence")).alias("x")).filter("x is not null").select(*keys, "x.*")
    r = r.withColumn("_k", F.expr("concat_ws('|', left(lower(left), 40), left(lower(right), 40), rel)"))
    one = r.groupBy(*keys, "_k").agg(F.min(F.struct("left", "right", "rel", "signal", "confidence")).alias("x")).select(*keys, "x.*")
    year = r"try_cast(regexp_extract({0}, r'\b((?:19|20)\d{{2}})\b', 1) as int)"
    return one.select("*", F.expr(event_type("left")).alias("left_type"), F.expr(event_type("right")).alias("right_type"), F.expr(year.format("left")).alias("left_year"), F.expr(year.format("right")).alias("right_year"))


def sequence_relation(sentence: str) -> str:
    """struct(left, right) of the first sequence pattern whose two spans have five characters or more, or null."""
    spans = ", ".join(f"if(s rlike {quoted('(?i)' + p)}, named_struct('left', {event_span(f'regexp_extract(s, {quoted("(?i)" + p)}, 1)')}, 'right', {event_span(f'regexp_extract(s, {quoted("(?i)" + p)}, 2)')}), null)" for p in SEQUENCES)
    # a word that each pattern needs is looked for first: most sentences have none
    return X.lets([("s", sentence)], f"if(s rlike r'(?i)then|followed by|subsequently|later', get(filter(array({spans}), x -> x is not null and length(x.left) >= 5 and length(x.right) >= 5), 0), null)")


def sequence_relations(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, right, confidence 0.65) of sentences that tell of one event and then another; left is the earlier."""
    r = sentences.select(*keys, F.expr(sequence_relation("sentence")).alias("x")).filter("x is not null").select(*keys, "x.*")
    one = r.groupBy(*keys, F.expr("left(lower(left), 40)").alias("_l"), F.expr("left(lower(right), 40)").alias("_r")).agg(F.min(F.struct("left", "right")).alias("x"))
    return one.select(*keys, "x.*", F.lit(0.65).alias("confidence"))


def span_anchor(text: str) -> str:
    """struct(year, quarter) that a span names first; quarter is null without one."""
    return f"named_struct('year', try_cast(regexp_extract({text}, r'\\b((?:19|20)\\d{{2}})\\b', 1) as int), 'quarter', try_cast(regexp_extract({text}, r'(?i)\\bQ([1-4])\\b', 1) as int))"


def anchored_before(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, second) of all events (keys, event, period) with an earlier and a later period: an inequality join within the keys."""
    a, b = events.select(*keys, F.col("event").alias("first"), F.col("period").alias("p1")), events.select(*keys, F.col("event").alias("second"), F.col("period").alias("p2"))
    return a.join(b, keys).filter("p1 < p2 and first <> second").select(*keys, "first", "second").distinct()


def closure(edges: DataFrame, keys: list[str]) -> DataFrame:
    """All (keys, src, tgt) reachable from edges, by doubling to the fixpoint; cycles give pairs of a node with itself.

    Each round joins what the round before found with all paths so far on (keys, middle), and keeps what is new; it ends
    when nothing is, after about log2 of the longest path. Null ends take no part.
    """
    fresh = cut_lineage(edges.select(*keys, "src", "tgt").na.drop(subset=["src", "tgt"]).distinct())
    paths = fresh
    while not fresh.isEmpty():
        left = fresh.select(*keys, "src", F.col("tgt").alias("mid")).join(paths.select(*keys, F.col("src").alias("mid"), "tgt"), [*keys, "mid"])
        right = paths.select(*keys, "src", F.col("tgt").alias("mid")).join(fresh.select(*keys, F.col("src").alias("mid"), "tgt"), [*keys, "mid"])
        made = left.select(*keys, "src", "tgt").unionByName(right.select(*keys, "src", "tgt")).distinct()
        fresh = cut_lineage(made.join(paths, [*keys, "src", "tgt"], "left_anti"))
        paths = paths.unionByName(fresh)
    return paths


def timeline(nodes: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, level, cyclic): level is the number of nodes known to come before a node, cyclic whether it comes before itself.

    Levels are a topological order: an edge leads to a higher one, except within a cycle, whose nodes share theirs.
    """
    reach = cut_lineage(closure(before, keys))
    earlier = reach.filter("src <> tgt").groupBy(*keys, F.col("tgt").alias("node")).agg(F.count("*").alias("level"))
    cyclic = reach.filter("src = tgt").select(*keys, F.col("src").alias("node"), F.lit(True).alias("cyclic"))
    return nodes.select(*keys, "node").distinct().join(earlier, [*keys, "node"], "left").join(cyclic, [*keys, "node"], "left").na.fill({"level": 0, "cyclic": False})


def shortest_paths(edges: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, tgt, length, path) of the shortest way along edges for each asked (keys, src, tgt), the first by name among equals.

    A way of a node to itself has length 0; pairs without a way give no row. Breadth first: each round goes one edge on
    from the nodes reached last and ends when no new node is reached.
    """
    starts = asked.select(*keys, F.col("src").alias("root")).distinct()
    fresh = cut_lineage(starts.select(*keys, "root", F.col("root").alias("node"), F.lit(0).alias("length"), F.array("root").alias("path")))
    seen = fresh
    hop = edges.select(*keys, F.col("src").alias("node"), F.col("tgt").alias("to")).distinct()
    while not fresh.isEmpty():
        made = fresh.join(hop, [*keys, "node"]).select(*keys, "root", F.col("to").alias("node"), F.expr("length + 1").alias("length"), F.expr("array_append(path, to)").alias("path"))
        made = made.groupBy(*keys, "root", "node").agg(F.min("length").alias("length"), F.min("path").alias("path"))
        fresh = cut_lineage(made.join(seen.select(*keys, "root", "node"), [*keys, "root", "node"], "left_anti"))
        seen = seen.unionByName(fresh)
    found = seen.select(*keys, F.col("root").alias("src"), F.col("node").alias("tgt"), "length", "path")
    return found.join(asked.select(*keys, "src", "tgt").distinct(), [*keys, "src", "tgt"])


# Interval algebra


def _allen(a: tuple[int, int], b: tuple[int, int]) -> str:
    (s, e), (u, v) = a, b
    if e < u:
        return "before"
    if v < s:
        return "after"
    if e == u:
        return "meets"
    if v == s:
        return "met_by"
    if s == u:
        return "equal" if e == v else "starts" if e < v else "started_by"
    if e == v:
        return "finishes" if s > u else "finished_by"
    if s > u and e < v:
        return "during"
    if s < u and e > v:
        return "contains"
    return "overlaps" if s < u else "overlapped_by"


def composition() -> dict[tuple[str, str], frozenset[str]]:
    """Every composition of two relations, enumerated over all triples of intervals with ends 0 to 5."""
    spans = [(a, b) for a, b in product(range(6), repeat=2) if a < b]
    out: dict[tuple[str, str], set[str]] = {}
    for a, b, c in product(spans, repeat=3):
        out.setdefault((_allen(a, b), _allen(b, c)), set()).add(_allen(a, c))
    return {k: frozenset(v) for k, v in out.items()}


def composition_table(spark: SparkSession) -> DataFrame:
    """(r1, r2, possible ARRAY<STRING>): 169 rows, whatever the data."""
    return spark.createDataFrame([(a, b, sorted(v)) for (a, b), v in sorted(composition().items())], "r1 string, r2 string, possible array<string>")


def allen_relation(s1: str, e1: str, s2: str, e2: str) -> str:
    """Relation of interval [s1, e1] to [s2, e2]."""
    return (
        f"case when {e1} < {s2} then 'before' when {e2} < {s1} then 'after' when {s1} = {s2} and {e1} = {e2} then 'equal' when {e1} = {s2} then 'meets' when {e2} = {s1} then 'met_by' "
        f"when {s1} = {s2} then if({e1} < {e2}, 'starts', 'started_by') when {e1} = {e2} then if({s1} > {s2}, 'finishes', 'finished_by') "
        f"when {s1} > {s2} and {e1} < {e2} then 'during' when {s1} < {s2} and {e1} > {e2} then 'contains' when {s1} < {s2} then 'overlaps' else 'overlapped_by' end"
    )


def inferred_relations(edges: DataFrame, keys: list[str], hops: int = 3) -> DataFrame:
    """(keys, src, tgt, rel, confidence, possible, hop) that follow from edges (keys, src, tgt, rel, confidence).

    A pair with edges of its own is left alone. A composition of one relation is taken at 0.85 of the product of
    confidences, one of two or three at 0.7 of that with the first by name as rel; wider ones say nothing. Of several
    derivations the most confident wins, then the first middle by name.
    """
    spark = edges.sparkSession
    table = F.broadcast(composition_table(spark))  # 169 rows
    known = edges.select(*keys, "src", "tgt", "rel", "confidence")
    found = None
    for hop in range(2, hops + 1):
        a = known.select(*keys, "src", F.col("tgt").alias("mid"), F.col("rel").alias("r1"), F.col("confidence").alias("c1"))
        b = known.select(*keys, F.col("src").alias("mid"), "tgt", F.col("rel").alias("r2"), F.col("confidence").alias("c2"))
        made = a.join(b, [*keys, "mid"]).filter("src <> tgt").join(table, ["r1", "r2"]).filter("size(possible) <= 3")
        made = made.withColumn("confidence", F.expr("round(c1 * c2 * 0.85D * if(size(possible) = 1, 1D, 0.7D), 4)")).join(known.select(*keys, "src", "tgt").distinct(), [*keys, "src", "tgt"], "left_anti")
        w = Window.partitionBy(*keys, "src", "tgt").orderBy(F.desc("confidence"), "mid")
        new = made.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*keys, "src", "tgt", F.col("possible")[0].alias("rel"), "confidence", "possible", F.lit(hop).alias("hop"))
        new = cut_lineage(new)
        known = known.unionByName(new.select(*keys, "src", "tgt", "rel", "confidence"))
        found = new if found is None else found.unionByName(new)
    return found


def stn_bounds(rel: str) -> str:
    """struct(lo, hi): bounds of the start of the second event less that of the first under a relation."""
    inf, low = "double('Infinity')", "double('-Infinity')"
    return (
        f"case when {rel} in ('before', 'meets', 'overlaps', 'during') then named_struct('lo', 0D, 'hi', {inf}) when {rel} in ('after', 'met_by', 'overlapped_by', 'contains') then named_struct('lo', {low}, 'hi', 0D) "
        f"when {rel} in ('equal', 'starts', 'started_by') then named_struct('lo', 0D, 'hi', 0D) else named_struct('lo', {low}, 'hi', {inf}) end"
    )


def tighten(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds (keys, src, tgt, lo, hi) with all paths composed, to the fixpoint.

    Several bounds of a pair are intersected. A network is inconsistent where lo passes hi, or a node must come before or
    after itself; ``consistent`` says so for each row's own pair. Each round composes what the round before changed with
    all bounds so far. A network found inconsistent isn't tightened on, as its bounds would never come to rest.
    """
    own = [*keys, "src", "tgt"]
    low, inf = "double('-Infinity')", "double('Infinity')"
    sound = "lo <= hi and not (src = tgt and (lo > 0 or hi < 0))"
    paths = cut_lineage(bounds.groupBy(*own).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")))
    fresh = paths
    while True:
        broken = paths.filter(f"not ({sound})").select(*keys).distinct()
        fresh, live = fresh.join(broken, keys, "left_anti"), paths.join(broken, keys, "left_anti")
        made = None
        for first, second in ((fresh, live), (live, fresh)):
            a = first.select(*keys, "src", F.col("tgt").alias("mid"), F.col("lo").alias("l1"), F.col("hi").alias("h1"))
            b = second.select(*keys, F.col("src").alias("mid"), "tgt", F.col("lo").alias("l2"), F.col("hi").alias("h2"))
            lo, hi = f"if(l1 = {low} or l2 = {low}, {low}, l1 + l2)", f"if(h1 = {inf} or h2 = {inf}, {inf}, h1 + h2)"
            one = a.join(b, [*keys, "mid"]).select(*own, F.expr(lo).alias("lo"), F.expr(hi).alias("hi"))
            made = one if made is None else made.unionByName(one)
        made = made.groupBy(*own).agg(F.max("lo").alias("lo2"), F.min("hi").alias("hi2"))
        both = paths.join(made, own, "full")
        after = both.select(*own, F.expr("greatest(lo, lo2)").alias("lo"), F.expr("least(hi, hi2)").alias("hi"), F.expr("lo is null or lo2 > lo or hi2 < hi").alias("_new"))
        after = cut_lineage(after.withColumn("_new", F.coalesce("_new", F.lit(False))))
        paths, fresh = after.drop("_new"), after.filter("_new").drop("_new")
        if fresh.isEmpty():
            return paths.withColumn("consistent", F.expr(sound))


def conflicts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, tgt, rel, back, problem): pairs whose two directions contradict each other, and events before themselves.

    An event that stands before itself by a chain of before and meets, and not by an edge of its own, is a before cycle.
    """
    order = "case {0} " + " ".join(f"when '{k}' then {v}" for k, v in PRECEDENCE.items()) + " else 0 end"
    a = edges.select(*keys, "src", "tgt", "rel")
    b = edges.select(*keys, F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.col("rel").alias("back"))
    both = a.join(b, [*keys, "src", "tgt"]).filter("src < tgt")
    wrong = both.filter(F.expr(f"{order.format('rel')} * {order.format('back')} = 1")).withColumn("problem", F.lit("conflicting precedence"))
    loops = a.filter("src = tgt and rel <> 'equal'").withColumn("back", F.col("rel")).withColumn("problem", F.lit("self loop"))
    return wrong.unionByName(loops.select(*wrong.columns)).unionByName(cycles(edges, keys).select(*wrong.columns))


def strict_order(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, tgt) of what before, meets and their inverses say comes first."""
    ahead = edges.filter("rel in ('before', 'meets')").select(*keys, "src", "tgt")
    return ahead.unionByName(edges.filter("rel in ('after', 'met_by')").select(*keys, F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()


def cycles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, tgt, rel, back, problem) of every event that a chain of two or more different events puts before itself."""
    order = strict_order(edges, keys).filter("src <> tgt")
    node = closure(order, keys).filter("src = tgt").select(*keys, "src", "tgt")
    return node.select("*", F.lit("before").alias("rel"), F.lit("before").alias("back"), F.lit("before cycle").alias("problem"))


def propagated(edges: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """What follows from relations (keys, src, tgt, rel, confidence): frames edges, bounds, problems and order.

    edges are those given and those inferred (with hop, 1 for given), bounds their tightened bounds, problems what
    ``conflicts`` finds and bounds that contradict each other, order (keys, node, level, cyclic, place) the events in
    topological order, ties by name and those of cycles last.
    """
    given = cut_lineage(edges.select(*keys, "src", "tgt", "rel", "confidence"))
    more = inferred_relations(given, keys).select(*keys, "src", "tgt", "rel", "confidence", "hop")
    every = cut_lineage(given.withColumn("hop", F.lit(1)).unionByName(more))
    bounds = tighten(every.select(*keys, "src", "tgt", F.expr(f"inline(array({stn_bounds('rel')}))")), keys)
    wrong = conflicts(given, keys)
    off = bounds.filter("not consistent").select(*keys, "src", "tgt", F.lit(None).cast("string").alias("rel"), F.lit(None).cast("string").alias("back"), F.expr("if(src = tgt, 'positive self loop', 'bound contradiction')").alias("problem"))
    nodes = given.select(*keys, F.col("src").alias("node")).union(given.select(*keys, "tgt")).distinct()
    order = timeline(nodes, strict_order(every, keys), keys)
    # the events of one document are ranked together
    order = order.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("cyclic", "level", "node")))
    return {"edges": every, "bounds": bounds, "problems": wrong.unionByName(off.select(*wrong.columns)), "order": order}


def all_event_relations(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, tgt, rel, confidence, origin): relations told (signal, sequence), by years (anchor, 0.75) and by transitivity (transitive, 0.55).

    Events are their lower-case spans. A pair and relation found in several ways keeps the first origin in that order.
    """
    told = cut_lineage(relations(sentences, keys))
    named = told.select(*keys, F.lower("left").alias("src"), F.lower("right").alias("tgt"), "rel", "confidence", F.lit("signal").alias("origin"))
    then = sequence_relations(sentences, keys).select(*keys, F.lower("left").alias("src"), F.lower("right").alias("tgt"), F.lit("before").alias("rel"), "confidence", F.lit("sequence").alias("origin"))
    dated = told.select(*keys, F.lower("left").alias("event"), F.expr(span_anchor("left")).alias("a")).union(told.select(*keys, F.lower("right"), F.expr(span_anchor("right")))).filter("a.year is not null")
    dated = dated.select(*keys, "event", F.expr("a.year * 5 + coalesce(a.quarter, 0)").alias("period")).groupBy(*keys, "event").agg(F.min("period").alias("period"))
    anchor = anchored_before(dated, keys).select(*keys, F.col("first").alias("src"), F.col("second").alias("tgt"), F.lit("before").alias("rel"), F.lit(0.75).alias("confidence"), F.lit("anchor").alias("origin"))
    base = cut_lineage(named.unionByName(then).unionByName(anchor))
    far = closure(base.filter("rel = 'before'"), keys).select(*keys, "src", "tgt", F.lit("before").alias("rel"), F.lit(0.55).alias("confidence"), F.lit("transitive").alias("origin"))
    rank = F.expr("array_position(array('signal', 'sequence', 'anchor', 'transitive'), origin)")
    every = base.unionByName(far).groupBy(*keys, "src", "tgt", "rel").agg(F.min(F.struct(rank.alias("at"), (-F.col("confidence")).alias("c"), "origin")).alias("x"))
    return every.select(*keys, "src", "tgt", "rel", (-F.col("x.c")).alias("confidence"), "x.origin")


def temporal_graph(examples: DataFrame, sentences: DataFrame) -> DataFrame:
    """(row_id, kind, src, tgt, rel, value) edges of each example's graph of time.

    kind precedes joins each year that table or text name to the next one, event joins events by their relation, and
    measured joins a table row's label to each year it has a number for.
    """
    measured = table_trends(examples).select("row_id", "label", F.expr("inline(arrays_zip(years, `values`))")).select("row_id", F.lit("measured").alias("kind"), F.col("label").alias("src"), F.col("years").cast("string").alias("tgt"), F.lit("in").alias("rel"), F.col("values").alias("value"))
    told = relations(sentences, ["row_id"]).select("row_id", F.lit("event").alias("kind"), F.lower("left").alias("src"), F.lower("right").alias("tgt"), "rel", F.col("confidence").alias("value"))
    years = measured.select("row_id", F.col("tgt").cast("int").alias("value")).union(sentences.select("row_id", F.explode(F.expr(X.years("sentence"))).alias("value")))
    then = sequence(years, ["row_id"]).select("row_id", F.lit("precedes").alias("kind"), F.col("value").cast("string").alias("src"), F.col("next").cast("string").alias("tgt"), F.lit("before").alias("rel"), F.lit(None).cast("double").alias("value"))
    return measured.unionByName(told).unionByName(then)


def pruned(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` (keys, src, tgt, rel, confidence) without the less confident direction of conflicting pairs; at a tie the first by src stays."""
    bad = conflicts(edges, keys).filter("problem = 'conflicting precedence'").select(*keys, F.col("src").alias("a"), F.col("tgt").alias("b"))
    own = edges.withColumn("a", F.least("src", "tgt")).withColumn("b", F.greatest("src", "tgt")).join(bad.distinct(), [*keys, "a", "b"])
    w = Window.partitionBy(*keys, "a", "b").orderBy("confidence", F.desc("src"), "rel")
    losers = own.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*keys, "src", "tgt")
    return edges.join(losers, [*keys, "src", "tgt"], "left_anti")


# Trends


def trend(values: str, stable: float = 0.02) -> str:
    """struct(trend, average_change, total_change, cagr, inflections, outliers) of an array of numbers in order.

    insufficient_data below two values; stable if all changes are within ``stable`` of the mean, or their average is and
    they don't go one way. cagr is null if the ends' ratio isn't positive. inflections and outliers are places from 0.
    """
    changes = f"transform(sequence(1, greatest(size(v) - 1, 1)), i -> v[i] - v[i - 1])"
    body = X.lets(
        [
            ("c", changes),
            ("m", "aggregate(v, 0D, (s, x) -> s + x) / size(v)"),
            ("g", "greatest(abs(m), 1e-9D)"),
            ("avg", "aggregate(c, 0D, (s, x) -> s + x) / size(c)"),
            ("d", "if(size(c) < 2, array(), transform(sequence(1, size(c) - 1), i -> c[i] - c[i - 1]))"),
            ("sd", "sqrt(aggregate(v, 0D, (s, x) -> s + (x - m) * (x - m)) / size(v))"),
        ],
        f"named_struct('trend', case when forall(c, x -> abs(x) / g < {stable}D) then 'stable' when forall(c, x -> x > 0) then 'increasing' when forall(c, x -> x < 0) then 'decreasing' when abs(avg) / g < {stable}D then 'stable' else 'fluctuating' end, "
        "'average_change', round(avg, 6), 'total_change', round(v[size(v) - 1] - v[0], 6), "
        "'cagr', case when v[0] <> 0 and v[size(v) - 1] / v[0] > 0 then round(power(v[size(v) - 1] / v[0], 1D / (size(v) - 1)) - 1, 6) end, "
        "'inflections', if(size(d) < 2, cast(array() as array<int>), transform(filter(sequence(1, size(d) - 1), i -> d[i] * d[i - 1] < 0), i -> i + 1)), "
        "'outliers', if(size(v) < 3 or sd = 0, cast(array() as array<int>), filter(sequence(0, size(v) - 1), i -> abs(v[i] - m) / sd > 2)))",
    )
    return X.lets([("v", values)], f"if(size(v) < 2, named_struct('trend', 'insufficient_data', 'average_change', cast(null as double), 'total_change', cast(null as double), 'cagr', cast(null as double), 'inflections', cast(array() as array<int>), 'outliers', cast(array() as array<int>)), {body})")


def sequence(entities_of: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, next): consecutive different values of (keys, value), the precedes relation of years or quarters."""
    d = entities_of.select(*keys, "value").distinct()
    return d.withColumn("next", F.lead("value").over(Window.partitionBy(*keys).orderBy("value"))).filter("next is not null")


def table_trends(examples: DataFrame) -> DataFrame:
    """(row_id, row_idx, label, years, values) of every table row with two numbers or more under year columns, in the order of years."""
    from tallyforge.operators import table_ops as T

    c = T.typed_cells(examples).filter("col_idx > 0 and num is not null")
    y = c.withColumn("year", F.expr(r"try_cast(regexp_extract(header, r'\b(?:FY)?((?:19|20)\d{2})\b', 1) as int)")).filter("year is not null")
    # a table row has as many numbers as the table has columns
    g = y.groupBy("row_id", "row_idx", "label").agg(F.sort_array(F.collect_list(F.struct("year", "col_idx", "num"))).alias("p"))
    return g.filter("size(p) >= 2").selectExpr("row_id", "row_idx", "label", "transform(p, x -> x.year) AS years", "transform(p, x -> x.num) AS `values`")
