"""Causal relations in text: patterns, strength, gates, chains and discourse between sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import expressions as X
from tallyforge.functions.expressions import quoted
from tallyforge.operators import scm

# Patterns of a cause and an effect in a sentence, in order of precedence; e: effect first, c: cause first, m: cause in the middle.
PATTERNS = [
    (r"(.+?)\s+(?:due to|because of|as a result of|owing to|attributed to)\s+(.+)", "e", "attribution"),
    (r"(.+?)\s+(?:caused|led to|resulted in|contributed to|triggered|drove)\s+(.+)", "c", "direct"),
    (r"(?:because|since|as)\s+(.+?),\s*(.+)", "c", "premise"),
    (r"(.+?),\s*which\s+(?:led to|caused|resulted in|drove)\s+(.+)", "c", "relative_clause"),
    (r"(.+?)\s+(?:was|were)\s+(?:driven by|caused by|impacted by|affected by|pressured by)\s+(.+)", "e", "passive"),
    (r"(?:following|after)\s+(.+?),\s*(.+)", "c", "temporal_trigger"),
    (r"(.+?)\s+(?:therefore|thus|hence),\s*(.+)", "c", "logical"),
    (r"(.+?)\s+(?:which in turn|thereby)\s+(?:caused|led to|resulted in)\s+(.+)", "c", "mediated"),
    (r"(.+?)\s+(?:amid|under)\s+(.+?),\s*(.+)", "m", "contextual"),
    (r"(.+?)\s+(?:accelerated|slowed|weakened|boosted)\s+(.+)", "c", "modulation"),
    (r"(.+?)\s+(?:offset|mitigated|buffered)\s+(.+)", "c", "mitigation"),
    (r"(.+?)\s+(?:stemming from|arising from|originating from)\s+(.+)", "e", "origin"),
    (r"(.+?)\s+(?:in response to)\s+(.+)", "e", "response"),
    (r"(.+?)\s+(?:corresponded with|coincided with)\s+(.+)", "c", "association"),
    (r"(.+?)\s+(?:put pressure on|lifted)\s+(.+)", "c", "pressure"),
    (r"(.+?)\s+(?:supporting|hurting)\s+(.+)", "c", "impact"),
    (r"(.+?)\s+(?:enabled|allowed|helped)\s+(.+)", "c", "enablement"),
    (r"(.+?)\s+(?:prevented|limited|constrained)\s+(.+)", "c", "constraint"),
    (r"if\s+(.+?),\s*(?:then\s+)?(.+)", "c", "conditional"),
    (r"(.+?)\s+(?:transmitted to|spilled over to)\s+(.+)", "c", "spillover"),
    (r"(.+?)\s+(?:raising|reducing)\s+(.+)", "c", "directional"),
    (r"(.+?)\s+(?:as|while)\s+(.+?)\s+(?:increased|decreased),\s*(.+)", "m", "co_movement"),
]
# Hints at a lag, with the group that holds it.
LAGS = [
    (r"with a lag of\s+(\d+\s+(?:day|days|week|weeks|month|months|quarter|quarters|year|years))", 1),
    (r"(\d+\s+(?:day|days|week|weeks|month|months|quarter|quarters|year|years))\s+later", 1),
    (r"in the following\s+(quarter|year|month)", 1),
    (r"subsequently", 0),
    (r"thereafter", 0),
]
# Cues of strength, direction and subject.
STRONG = ("because", "due to", "led to", "resulted in", "caused", "therefore")
WEAK = ("coincided", "associated", "amid")
SUBJECTS = ("revenue", "cost", "margin", "earnings", "cash", "debt", "demand", "price", "guidance")
POSITIVE = ("increase", "improve", "growth", "expand", "boost", "higher", "gain", "strong")
NEGATIVE = ("decrease", "decline", "drop", "weak", "lower", "loss", "pressure", "fall")
# Words of metrics, and what known causes bring about.
METRIC_WORDS = [
    "revenue", "sales", "income", "profit", "loss", "earnings", "ebitda", "ebit", "margin", "expense", "expenses", "cost", "costs", "depreciation",
    "amortization", "interest", "tax", "gross", "assets", "liabilities", "equity", "debt", "capital", "cash", "inventory", "receivables", "payables",
    "goodwill", "impairment", "cashflow", "capex", "dividends", "buyback", "roe", "roa", "roic", "eps", "ratio", "multiple", "yield", "shares", "nim",
    "inflation", "gdp", "loan", "pricing", "volume", "demand", "operating", "sga", "spending", "production", "capacity",
]
PRIORS = {
    "rate hike": ["loan demand decline", "net interest margin expansion", "valuation compression"],
    "inflation": ["input cost increase", "margin pressure", "pricing actions"],
    "supply chain disruption": ["revenue shortfall", "working capital increase", "cost inflation"],
    "fx headwind": ["revenue decline", "earnings volatility"],
    "share buyback": ["eps increase", "share count reduction"],
    "capex increase": ["depreciation increase", "future capacity growth"],
}
# Patterns of chains of three.
_VERBS = r"(?:caused|led to|resulted in|drove|triggered|reduced|increased|lowered|raised|boosted|weakened|compressed|expanded)"
_ING = r"(?:causing|leading to|resulting in|driving|triggering|reducing|increasing|lowering|raising)"
HOPS = [
    rf"(.+?)\s+{_VERBS}\s+(.+?),\s*which\s+(?:in turn|then|subsequently)\s+{_VERBS}\s+(.+)",
    rf"(.+?)\s+{_VERBS}\s+(.+?),\s*(?:thereby|thus)\s+{_ING}\s+(.+)",
    rf"(.+?)\s+{_VERBS}\s+(.+?)\s+(?:and|which)\s+(?:in turn|subsequently|then)\s+{_VERBS}\s+(.+)",
    rf"(.+?)\s+{_VERBS}\s+(.+?),\s*(?:ultimately|eventually)\s+{_ING}\s+(.+)",
]
# Connectives and the sense they give a pair of sentences.
CONNECTIVES = {
    "because": "contingency.cause",
    "since": "contingency.cause",
    "as a result": "contingency.cause",
    "consequently": "contingency.cause",
    "therefore": "contingency.cause",
    "thus": "contingency.cause",
    "hence": "contingency.cause",
    "so": "contingency.cause",
    "accordingly": "contingency.cause",
    "for this reason": "contingency.cause",
    "as such": "contingency.cause",
    "due to": "contingency.cause",
    "owing to": "contingency.cause",
    "led to": "contingency.cause",
    "resulted in": "contingency.cause",
    "caused": "contingency.cause",
    "contributed to": "contingency.cause",
    "triggered": "contingency.cause",
    "drove": "contingency.cause",
    "stemming from": "contingency.cause",
    "if": "contingency.condition",
    "provided that": "contingency.condition",
    "unless": "contingency.negative_condition",
    "in order to": "contingency.purpose",
    "so that": "contingency.purpose",
    "before": "temporal",
    "after": "temporal",
    "during": "temporal",
    "while": "temporal",
    "meanwhile": "temporal",
    "subsequently": "temporal",
    "following": "temporal",
    "preceding": "temporal",
    "however": "comparison.contrast",
    "but": "comparison.contrast",
    "on the other hand": "comparison.contrast",
    "conversely": "comparison.contrast",
    "in contrast": "comparison.contrast",
    "although": "comparison.concession",
    "despite": "comparison.concession",
    "even though": "comparison.concession",
    "nevertheless": "comparison.concession",
    "also": "expansion.conjunction",
    "moreover": "expansion.conjunction",
    "furthermore": "expansion.conjunction",
    "in addition": "expansion.conjunction",
    "for example": "expansion.instantiation",
    "for instance": "expansion.instantiation",
    "specifically": "expansion.detail",
    "in particular": "expansion.detail",
    "indeed": "expansion.restatement",
    "in fact": "expansion.restatement",
}
BY_LENGTH = sorted(CONNECTIVES.items(), key=lambda x: (-len(x[0]), x[0]))
# Verbs of causes and effects with their weights.
CAUSE_VERBS = {
    "reported": 0.4,
    "disclosed": 0.4,
    "announced": 0.5,
    "increased": 0.65,
    "strengthened": 0.65,
    "decreased": 0.65,
    "weakened": 0.65,
    "deployed": 0.65,
    "raised": 0.7,
    "lifted": 0.7,
    "expanded": 0.7,
    "reduced": 0.7,
    "lowered": 0.7,
    "compressed": 0.7,
    "implemented": 0.7,
    "adopted": 0.7,
    "invested": 0.7,
    "introduced": 0.7,
    "consolidated": 0.7,
    "streamlined": 0.7,
    "prompted": 0.7,
    "spurred": 0.7,
    "boosted": 0.75,
    "accelerated": 0.75,
    "cut": 0.75,
    "slashed": 0.75,
    "launched": 0.75,
    "eliminated": 0.75,
    "transformed": 0.75,
    "overhauled": 0.75,
    "sparked": 0.75,
    "drove": 0.75,
    "fueled": 0.75,
    "restructured": 0.8,
    "acquired": 0.8,
    "divested": 0.8,
    "disrupted": 0.8,
    "triggered": 0.8,
}
EFFECT_VERBS = {
    "exceeded": 0.55,
    "missed": 0.55,
    "stabilized": 0.6,
    "outperformed": 0.6,
    "underperformed": 0.6,
    "climbed": 0.65,
    "rose": 0.65,
    "gained": 0.65,
    "recovered": 0.65,
    "grew": 0.7,
    "improved": 0.7,
    "jumped": 0.7,
    "declined": 0.7,
    "fell": 0.7,
    "dropped": 0.7,
    "shrank": 0.7,
    "tumbled": 0.7,
    "slumped": 0.7,
    "rebounded": 0.7,
    "benefited": 0.7,
    "suffered": 0.7,
    "surged": 0.75,
    "soared": 0.75,
    "plummeted": 0.75,
    "deteriorated": 0.75,
    "plunged": 0.75,
    "collapsed": 0.8,
}
# What a sentence that tells a cause, or an outcome, speaks of.
CAUSE_TOPICS = [
    r"rate\s+hike",
    r"rate\s+cut",
    r"policy\s+change",
    r"regulation",
    r"deregulation",
    r"acquisition",
    r"merger",
    r"divestiture",
    r"spin-?off",
    r"IPO",
    r"buyback",
    r"restructuring",
    r"cost[- ]cutting",
    r"layoff",
    r"headcount\s+reduction",
    r"supply\s+chain",
    r"disruption",
    r"shortage",
    r"bottleneck",
    r"product\s+launch",
    r"new\s+product",
    r"innovation",
    r"R&D",
    r"price\s+increase",
    r"price\s+decrease",
    r"pricing\s+action",
    r"tariff",
    r"market\s+entry",
    r"expansion",
    r"geographic\s+expansion",
    r"new\s+market",
    r"capital\s+allocation",
    r"investment",
    r"capex\s+increase",
    r"capex\s+decrease",
    r"management\s+change",
    r"CEO\s+change",
    r"leadership\s+transition",
    r"debt\s+issuance",
    r"refinancing",
    r"credit\s+downgrade",
    r"credit\s+upgrade",
]
OUTCOMES = [
    r"(?:revenue|sales|top[- ]line)\s+(?:grew|increased|declined|fell|rose|dropped)",
    r"(?:margin|profitability)\s+(?:improved|expanded|compressed|contracted|declined)",
    r"(?:earnings|EPS|net\s+income|profit)\s+(?:grew|increased|declined|fell|rose|beat|missed)",
    r"(?:cash\s+flow|free\s+cash\s+flow|FCF)\s+(?:improved|increased|declined|decreased)",
    r"(?:share\s+price|stock|valuation)\s+(?:rose|fell|surged|dropped|rallied|crashed)",
    r"(?:market\s+share)\s+(?:grew|increased|declined|lost)",
    r"(?:guidance|outlook|forecast)\s+(?:raised|lowered|maintained|revised)",
    r"(?:costs?|expenses?)\s+(?:rose|increased|declined|fell|were\s+higher|were\s+lower)",
    r"(?:demand)\s+(?:increased|decreased|weakened|strengthened|remained)",
    r"(?:growth)\s+(?:accelerated|decelerated|slowed|stalled)",
]
# Patterns of continuity between sentences, terms of finance, and questions about causes.
CONTINUITY = r"(?i)\b(?:the\s+company|the\s+firm|it|this|its|they|their|the\s+bank|the\s+fund|management)\b"
ADJACENCY = r"(?i)\b(?:next\s+quarter|the\s+following|subsequently|in\s+turn|as\s+a\s+result|in\s+the\s+same\s+period|quarter-over-quarter|year-over-year|thereafter)\b"
TERMS = [
    "revenue", "cost", "margin", "earnings", "profit", "debt", "cash", "growth", "demand", "supply", "price", "share", "interest", "rate", "tax",
    "capex", "dividend", "equity",
]
CAUSAL_QUESTION = r"(?i)\b(?:why|cause[ds]?|because|due to|reason|led to|driver|drove|impact|effect|result(?:ed)? in|explain|what if|suppose)\b"


def span(text: str) -> str:
    """A span with single spaces, without closing punctuation and leading small words."""
    return f"trim(regexp_replace(trim(regexp_replace(regexp_replace(trim({text}), r'[.,;:]+$', ''), r'\\s+', ' ')), r'(?i)^(?:the|a|an|and|or|but|that|this|which|to)\\s+', ''))"


def lag_hint(text: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {quoted('(?i)' + p)}, {g}), '')" for p, g in LAGS) + ")"


def _count(words: tuple[str, ...] | list[str], text: str) -> str:
    return "(" + " + ".join(f"if(contains({text}, '{w}'), 1, 0)" for w in words) + ")"


def polarity(text: str) -> str:
    return f"case sign({_count(POSITIVE, text)} - {_count(NEGATIVE, text)}) when 1 then 'positive' when -1 then 'negative' else 'neutral' end"


def has_metric(text: str) -> str:
    return f"arrays_overlap(regexp_extract_all(lower({text}), r'\\w+', 0), array({', '.join(repr(w) for w in METRIC_WORDS)}))"


def strength(cause: str, effect: str, evidence: str, mechanism: str) -> str:
    """Strength of a relation in [0, 1] from its cues, subjects, mechanism, lag and the length of its spans."""
    both, ev = f"lower(concat({cause}, ' ', {effect}))", f"lower({evidence})"

    def length(x: str) -> str:
        n = f"size(split({x}, r'\\s+'))"
        return f"if({n} < 2, 0.08D, if({n} > 28, 0.06D, 0D))"

    return (
        f"greatest(0D, least(1D, 0.35D + least(0.25D, 0.05D * {_count(STRONG, ev)}) - least(0.12D, 0.04D * {_count(WEAK, ev)}) + least(0.2D, 0.03D * {_count(SUBJECTS, both)}) "
        f"+ if({mechanism} in ('direct', 'attribution', 'logical', 'conditional'), 0.08D, 0D) + if({lag_hint(evidence)} is not null, 0.05D, 0D) - {length(cause)} - {length(effect)}))"
    )


def _node(text: str) -> str:
    return f"regexp_replace(regexp_replace(lower({text}), r'[^a-z0-9]+', '_'), r'^_|_$', '')"


def cue(pattern: str) -> str:
    """A pattern without the open groups at its ends: what any match of it must hold."""
    return pattern.removeprefix("(.+?)").removesuffix("(.+)")


def relation(sentence: str) -> str:
    """struct(cause, effect, mechanism, confidence, lag, polarity, flags) of the first pattern found in a sentence, or null.

    Causes dated after their effects keep a twentieth of the strength, pairs without a metric word a tenth, pairs the
    model doesn't link 0.7; a pair it links the other way is turned round.
    """
    # the cue alone is looked for first: most sentences have none, and it is found without backtracking
    which = "case " + " ".join(f"when s rlike {quoted('(?i)' + cue(p))} and s rlike {quoted('(?i)' + p)} then {i}" for i, (p, _, _) in enumerate(PATTERNS)) + " end"
    patterns = f"array({', '.join(quoted('(?i)' + p) for p, _, _ in PATTERNS)})"
    ways, kinds = (f"array({', '.join(repr(x[j]) for x in PATTERNS)})" for j in (1, 2))
    known = ", ".join(sorted({f"'{a}>{b}'" for a in scm.NODES for b in scm.DESCENDANTS[a] if scm.paths(a, b)}))
    years = X.years
    late = f"size({years('c')}) > 0 and size({years('e')}) > 0 and array_min({years('c')}) > array_max({years('e')})"
    body = X.lets(
        [
            ("w", f"get({ways}, k)"),
            ("mech", f"get({kinds}, k)"),
            ("g", "array(regexp_extract(s, p, 1), regexp_extract(s, p, 2), if(w = 'm', regexp_extract(s, p, if(w = 'm', 3, 2)), ''))"),
            ("c", span("if(w = 'c', g[0], g[1])")),
            ("e", span("if(w = 'e', g[0], if(w = 'm', g[2], g[1]))")),
            ("way", f"case when concat({_node('c')}, '>', {_node('e')}) in ({known}) then 1 when concat({_node('e')}, '>', {_node('c')}) in ({known}) then -1 else 0 end"),
            ("late", late),
            ("dull", f"not {has_metric('c')} and not {has_metric('e')}"),
        ],
        f"if(c = '' or e = '', null, named_struct('cause', if(way = -1, e, c), 'effect', if(way = -1, c, e), 'mechanism', mech, "
        f"'confidence', round({strength('c', 'e', 's', 'mech')} * if(late, 0.05D, 1D) * if(dull, 0.1D, 1D) * if(way = 0, 0.7D, 1D), 6), "
        f"'lag', {lag_hint('s')}, 'polarity', {polarity("lower(concat(c, ' ', e))")}, 'flags', filter(array(if(late, 'temporal_violation', null), if(dull, 'low_relevance', null), if(way = -1, 'flipped', null), if(way = 0, 'unverified', null)), x -> x is not null)))",
    )
    return X.lets([("s", sentence), ("k", which), ("p", f"get({patterns}, k)")], f"if(k is null, null, {body})")


def relations(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sentence, cause, effect, mechanism, confidence, lag, polarity, flags) of every sentence with a pattern."""
    # a generator and not a filter, which would have the expression computed twice
    return sentences.select(*keys, "sentence", F.expr(f"inline(filter(array({relation('sentence')}), r -> r is not null))"))


def multi_hop(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hop, cause, effect): the two links of sentences that tell a chain of three."""
    # words that every pattern needs are looked for first, without backtracking
    joint = quoted(r"(?i)\b(?:in turn|then|subsequently|thereby|thus|ultimately|eventually)\s")
    hop = " ".join(f"when sentence rlike {quoted('(?i)' + p)} then {i}" for i, p in enumerate(HOPS))
    which = f"case when not (sentence rlike {joint} and sentence rlike {quoted('(?i)' + _VERBS)}) then null {hop} end"
    patterns = f"array({', '.join(quoted('(?i)' + p) for p in HOPS)})"
    s = sentences.select(*keys, "sentence", F.expr(which).alias("k")).filter("k is not null").withColumn("p", F.expr(f"get({patterns}, k)"))
    a, b, c = (span(f"regexp_extract(sentence, p, {i})") for i in (1, 2, 3))
    return s.select(*keys, F.expr(f"inline(array(named_struct('hop', 1, 'cause', {a}, 'effect', {b}), named_struct('hop', 2, 'cause', {b}, 'effect', {c})))"))


def nested(sentences: DataFrame, keys: list[str], depth: int = 3) -> DataFrame:
    """(keys, depth, cause, effect, mechanism, confidence): relations of sentences, and of their spans of four words or more.

    Confidence falls by a tenth at each depth; a relation found at a lower depth isn't repeated. ``depth`` passes are
    unrolled, each over the spans of the one before.
    """
    level, found = sentences.select(*keys, "sentence"), None
    for d in range(depth):
        r = relations(level, keys).select(*keys, F.lit(d).alias("depth"), "cause", "effect", "mechanism", F.round(F.col("confidence") * 0.9**d, 6).alias("confidence"))
        found = r if found is None else found.unionByName(r)
        level = r.select(*keys, F.explode(F.array("cause", "effect")).alias("sentence")).filter(F.size(F.split("sentence", r"\s+")) >= 4)
    w = Window.partitionBy(*keys, F.lower("cause"), F.lower("effect")).orderBy("depth", F.desc("confidence"))
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def jaccard(a: str, b: str) -> str:
    x, y = X.words3(a), X.words3(b)
    return f"(size(array_intersect({x}, {y})) / greatest(size(array_union({x}, {y})), 1))"


def linked(left: str, right: str, least: float = 0.3) -> str:
    """Whether an effect and a cause tell of the same: one holds the other, or a Jaccard index of words of ``least``."""
    a, b = f"lower({left})", f"lower({right})"
    return f"(contains({a}, {b}) or contains({b}, {a}) or {jaccard(left, right)} >= {least})"


def chains(rels: DataFrame, keys: list[str], most: int = 4, decay: float = 0.92) -> DataFrame:
    """(keys, path, length, confidence) of chains of two to ``most`` relations (keys, rid, cause, effect, confidence) of one document.

    Relations meet where ``linked`` holds, which joins on the document's keys; no relation is used twice. Confidence is
    the product of the links' and of ``decay`` for each link after the first.
    """
    one = rels.select(*keys, "rid", "cause", "effect", "confidence")
    level = one.select(*keys, F.array("rid").alias("ids"), F.expr("array(cause, effect)").alias("path"), F.col("effect").alias("end"), "confidence")
    nxt = one.select(*keys, F.col("rid").alias("r"), F.col("cause").alias("c"), F.col("effect").alias("e"), F.col("confidence").alias("k"))
    out = None
    for _ in range(most - 1):
        level = level.join(nxt, keys).filter(F.expr(f"not array_contains(ids, r) and {linked('end', 'c')}"))
        level = level.select(*keys, F.expr("array_append(ids, r)").alias("ids"), F.expr("array_append(path, e)").alias("path"), F.col("e").alias("end"), F.expr(f"round(confidence * k * {decay}D, 6)").alias("confidence"))
        out = level if out is None else out.unionByName(level)
    return out.select(*keys, F.expr("array_join(path, ' > ')").alias("path"), F.expr("size(ids)").alias("length"), "confidence")


def transitive(rels: DataFrame, keys: list[str], least: float = 0.4) -> DataFrame:
    """(keys, cause, effect, confidence) that follow from two linked relations of ``least`` confidence and aren't there yet; the most confident way wins."""
    good = rels.filter(F.col("confidence") >= least)
    a = good.select(*keys, F.col("rid").alias("r1"), "cause", F.col("effect").alias("mid"), F.col("confidence").alias("k1"))
    b = good.select(*keys, F.col("rid").alias("r2"), F.col("cause").alias("mid2"), "effect", F.col("confidence").alias("k2"))
    made = a.join(b, keys).filter(F.expr(f"r1 <> r2 and lower(cause) <> lower(effect) and {linked('mid', 'mid2')}"))
    made = made.groupBy(*keys, "cause", "effect").agg(F.max(F.expr("round(k1 * k2 * 0.85D, 6)")).alias("confidence"))
    have = rels.select(*keys, F.lower("cause").alias("lc"), F.lower("effect").alias("le")).distinct()
    return made.withColumn("lc", F.lower("cause")).withColumn("le", F.lower("effect")).join(have, [*keys, "lc", "le"], "left_anti").drop("lc", "le")


def priors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cause, effect, confidence 0.58) of the known pairs whose two phrases stand in a text (keys, text)."""
    pairs = ", ".join(f"named_struct('cause', '{c}', 'effect', '{e}')" for c, es in PRIORS.items() for e in es)
    t = texts.select(*keys, F.lower("text").alias("t"), F.expr(f"explode(array({pairs}))").alias("p"))
    return t.filter("contains(t, p.cause) and contains(t, p.effect)").select(*keys, "p.cause", "p.effect", F.lit(0.58).alias("confidence"))


def merged(rels: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """One row per lower-case (keys, cause, effect) with the highest confidence, kept from ``least`` on; a column granger is blended in at 0.4."""
    blend = F.expr("if(granger is null, confidence, 0.6D * confidence + 0.4D * granger)") if "granger" in rels.columns else F.col("confidence")
    r = rels.withColumn("confidence", F.round(blend, 6))
    g = r.groupBy(*keys, F.lower(F.trim("cause")).alias("cause"), F.lower(F.trim("effect")).alias("effect")).agg(F.max("confidence").alias("confidence"))
    return g.filter(F.col("confidence") >= least)


def _any_of(patterns: list[str]) -> str:
    return quoted(rf"(?i)\b(?:{'|'.join(patterns)})\b")


def _verb_score(words: str, table: dict[str, float]) -> str:
    by_weight: dict[float, list[str]] = {}
    for v, k in table.items():
        by_weight.setdefault(k, []).append(v)
    whens = " ".join(f"when w in ({', '.join(map(repr, vs))}) then {k}D" for k, vs in by_weight.items())
    return f"coalesce(array_max(transform({words}, w -> case {whens} else 0D end)), 0D)"


def discourse(s1: str, s2: str) -> str:
    """struct(relation, explicit, connective, is_causal, confidence, score, direction) of two neighbouring sentences.

    The longest connective found gives the sense at 0.85; without one a logistic score over eight features decides.
    """
    found = "case " + " ".join(f"when t rlike {quoted(chr(92) + 'b' + c + chr(92) + 'b')} then {i}" for i, (c, _) in enumerate(BY_LENGTH)) + " end"
    names, senses = (f"array({', '.join(repr(x[j]) for x in BY_LENGTH)})" for j in (0, 1))
    low1, low2 = "regexp_extract_all(lower(a), r'\\b[a-z]+\\b', 0)", "regexp_extract_all(lower(b), r'\\b[a-z]+\\b', 0)"
    names_in = r"regexp_extract_all({0}, r'\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b', 0)"
    nouns = f"filter({names_in.format('a')}, n -> not n in ('The','This','That','These','Those','A','An','In','On','At','For','But','And','Or','It','Its'))"
    shared = f"size(array_intersect({names_in.format('a')}, {names_in.format('b')})) > 0"
    terms = f"least(1D, ({_count(TERMS, 'lower(a)')} + {_count(TERMS, 'lower(b)')}) / 4D)"
    contrast = r"if(exists(slice(split(lower(ltrim(b)), r'\s+'), 1, 3), w -> regexp_replace(w, r'[,.:;]', '') in ('however','but','although','despite','nevertheless')), 1D, 0D)"
    logit = (
        f"ln(0.25D / 0.75D) + 2.5D * if(a rlike {_any_of(CAUSE_TOPICS)} and b rlike {_any_of(OUTCOMES)}, 1D, 0D) + 1.8D * v[0] + 1.6D * v[3] "
        f"+ 0.8D * if(b rlike {quoted(CONTINUITY)} or exists({nouns}, n -> contains(b, n)), 1D, 0D) + 1.0D * if(t rlike {quoted(ADJACENCY)}, 1D, 0D) + 0.7D * {terms} + 0.3D - 2.0D * {contrast}"
    )
    way = "case when v[0] + v[3] > v[1] + v[2] + 0.2D then 'forward' when v[1] + v[2] > v[0] + v[3] + 0.2D then 'backward' else 'ambiguous' end"
    sense = f"case when k is not null then get({senses}, k) when score >= 0.5 then 'contingency.cause' when t rlike {quoted(ADJACENCY)} then 'temporal' when {contrast} > 0 then 'comparison.contrast' else 'entity relation' end"
    return X.lets(
        [
            ("a", s1),
            ("b", s2),
            ("t", "lower(concat(a, ' ', b))"),
            ("k", found),
            ("v", f"array({_verb_score(low1, CAUSE_VERBS)}, {_verb_score(low2, CAUSE_VERBS)}, {_verb_score(low1, EFFECT_VERBS)}, {_verb_score(low2, EFFECT_VERBS)})"),
            ("score", f"1D / (1D + exp(-({logit})))"),
            ("sense", sense),
        ],
        f"if(t is null, null, named_struct('relation', sense, 'explicit', k is not null, 'connective', get({names}, k), 'is_causal', startswith(sense, 'contingency.cause'), "
        f"'confidence', round(if(k is not null, 0.85D, if(sense = 'contingency.cause', least(1D, score * if({shared}, 1.05D, 1D)), 1D - score)), 4), 'score', round(score, 4), 'direction', {way}))",
    )


def label(relation_of: str) -> str:
    """The sense of a relation as one of causal, temporal, contrast and elaboration."""
    return f"case when startswith({relation_of}, 'contingency') then 'causal' when startswith({relation_of}, 'temporal') then 'temporal' when startswith({relation_of}, 'comparison') then 'contrast' else 'elaboration' end"


def pairs(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, relation, …) of every two neighbouring sentences of (keys, pos, sentence)."""
    nxt = F.lead("sentence").over(Window.partitionBy(*keys).orderBy("pos"))
    p = sentences.select(*keys, "pos", "sentence", nxt.alias("s2")).filter("s2 is not null")
    return p.select(*keys, "pos", F.expr(discourse("sentence", "s2")).alias("d")).select(*keys, "pos", "d.*", F.expr(label("d.relation")).alias("label"))


def counterfactual_question(cause: str, effect: str) -> str:
    return f"format_string('If %s had not happened, would %s still have changed?', {cause}, {effect})"
