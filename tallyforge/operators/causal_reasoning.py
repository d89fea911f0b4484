"""Causal reasoning over whole documents: chains of a document's graph, overlap with time, series of its table, ranked paths of the model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import expressions as X
from tallyforge.functions.arrowmap import flat_map
from tallyforge.functions.expressions import quoted
from tallyforge.operators import causal_text as C
from tallyforge.operators import evaluation as E
from tallyforge.operators import scm as S
from tallyforge.operators import series as I
from tallyforge.operators import table_ops as T
from tallyforge.operators import temporal as M
from tallyforge.session import cut_lineage

DECAY = 0.92
WHY = r"why did ([a-z_\s]+?)(?:\?|$)"


def graph_chains(rels: DataFrame, keys: list[str], most: int = 3, least: float = 0.0) -> DataFrame:
    """(keys, path, length, confidence) of chains of the graph of relations (keys, cause, effect, confidence) of each document.

    Nodes are lower-case texts, so a chain goes on where an effect is word for word a cause. From every cause, a chain ends
    at ``most`` relations or where nothing leads on, and visits no node twice; relations under ``least`` aren't followed.
    A link's confidence is weakened by 0.92 for each link before it. As many joins as a chain has links, on document and node.
    """
    e = rels.select(*keys, F.lower(F.trim("cause")).alias("a"), F.lower(F.trim("effect")).alias("b"), F.col("confidence").alias("c"))
    starts = e.select(*keys, "a").distinct()
    step = e.filter(F.col("c") >= least)
    path = starts.select(*keys, F.array("a").alias("path"), F.col("a").alias("end"), F.lit(1.0).alias("confidence"))
    leads = starts.withColumnRenamed("a", "end").withColumn("_on", F.lit(True))
    out = None
    for n in range(1, most + 1):
        path = path.join(step.withColumnRenamed("a", "end"), [*keys, "end"]).filter("not array_contains(path, b)")
        path = path.select(*keys, F.expr("array_append(path, b)").alias("path"), F.col("b").alias("end"), (F.col("confidence") * F.col("c") * F.lit(DECAY ** (n - 1))).alias("confidence"))
        ended = path if n == most else path.join(leads, [*keys, "end"], "left_anti")
        ended = ended.select(*keys, F.array_join("path", " > ").alias("path"), F.lit(n).alias("length"), F.round("confidence", 6).alias("confidence"))
        out = ended if out is None else out.unionByName(ended)
    return out


def time_overlap(rels: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, overlap): relations (keys, cause, effect) whose spans hold one of the document's labels of time (keys, labels)."""
    j = rels.select(*keys, F.lower(F.concat_ws(" ", "cause", "effect")).alias("s")).join(labels, keys)
    return j.groupBy(*keys).agg(F.count_if(F.expr("exists(labels, l -> contains(s, lower(l)))")).alias("overlap"))


def granger_from_tables(rels: DataFrame, tables: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """(keys, cause, effect, analysis columns) of relations whose first words of cause and effect each name a table row of four years or more.

    The series are read in the row; pairs without both give no row.
    """
    pairs = rels.select(*keys, "cause", "effect", F.expr(r"lower(split(trim(cause), r'\s+')[0])").alias("_c"), F.expr(r"lower(split(trim(effect), r'\s+')[0])").alias("_e")).filter("_c <> '' and _e <> ''")
    both = pairs.join(tables.filter("table_cells is not null"), keys).select(*keys, "cause", "effect", F.expr(T.table_series("_c")).alias("x"), F.expr(T.table_series("_e")).alias("y")).filter("x is not null and y is not null")
    names = ["lag", "f", "p_value", "significant", "gain", "reverse_f", "reverse_p", "asymmetry", "entropy", "dominant", "strength", "n"]

    def make() -> Callable[..., Iterator[tuple]]:
        def each(*v: Any) -> Iterator[tuple]:
            got = I.analysis(np.array(v[-2], float), np.array(v[-1], float), most)
            yield *v[:-2], *(got[n] for n in names)

        return each

    kinds = ", ".join(f"`{k}` {rels.schema[k].dataType.simpleString()}" for k in keys)
    return flat_map(both, [*keys, "cause", "effect", "x", "y"], make, f"{kinds}, cause string, effect string, {I.RESULT}")


def document_edges(table: str = T.TABLE) -> str:
    """Array of (src, tgt): edges that the headers of a table add to the model, by their names; a header the model has adds none."""
    known = ", ".join(f"'{n}'" for n in sorted(S.NODES))
    base = "trim(BOTH '_' FROM regexp_replace(n, '_?growth_?', ''))"
    parents = (
        f"case when contains(n, 'margin') then array('revenue', 'operating_income') when contains(n, 'growth') then array(if({base} in ({known}), {base}, 'revenue')) "
        "when (contains(n, 'expense') or contains(n, 'cost')) and contains(n, 'interest') then cast(array() as array<string>) "
        "when (contains(n, 'expense') or contains(n, 'cost')) and n rlike 'sga|selling|general|admin' then array('sga_expense') when contains(n, 'expense') or contains(n, 'cost') then array('gross_profit') "
        "when contains(n, 'income') then array('ebit') when contains(n, 'earnings') or contains(n, 'profit') then array('net_income') when contains(n, 'per_share') or contains(n, 'eps') then array('eps') else cast(array() as array<string>) end"
    )
    names = f"array_distinct(transform({table}[0], h -> trim(BOTH '_' FROM regexp_replace(lower(trim(coalesce(h, ''))), '[^a-z0-9]+', '_'))))"
    fresh = f"filter({names}, n -> n <> '' and not n in ({known}))"
    return f"if(size({table}) > 0, flatten(transform({fresh}, n -> transform({parents}, p -> named_struct('src', p, 'tgt', n)))), array())"


def ranked_paths(questions: DataFrame, rels: DataFrame, most: int = 8) -> DataFrame:
    """(row_id, target, path, support, length, rank) of the model's ways to what a question asks the why of.

    Ways begin at variables nothing leads to; support is the share of a way's variables that the document's relations name.
    The model's ways are a table of fixed size.
    """
    spark = questions.sparkSession
    roots = [n for n in S.NODES if not S.ANCESTORS[n]]
    ways = [(p[-1], p) for r in roots for t in S.NODES if t != r for p in S.paths(r, t)]
    table = spark.createDataFrame(ways, "target string, path array<string>")
    target = f"translate(trim(regexp_extract(lower(question), {quoted(WHY)}, 1)), ' ', '_')"
    asked = questions.select("row_id", F.expr(target).alias("target")).filter("target <> ''")
    told = rels.groupBy("row_id").agg(F.lower(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "cause", "effect"))), " ")).alias("told"))  # the relations of one document
    j = asked.join(F.broadcast(table), "target").join(told, "row_id", "left").withColumn("told", F.coalesce("told", F.lit("")))
    j = j.withColumn("support", F.expr("round(size(filter(path, n -> contains(told, translate(n, '_', ' ')))) / size(path), 4)")).withColumn("length", F.size("path"))
    one = j.groupBy("row_id", "target").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("s"), "length", "path"))), 1, most).alias("p"))  # at most the model's ways
    return one.select("row_id", "target", F.posexplode("p").alias("at", "x")).selectExpr("row_id", "target", "array_join(x.path, ' > ') AS path", "-x.s AS support", "x.length", "at + 1 AS rank")


# How a question names what didn't happen, and what is set against what.
RETROSPECTIVE = [
    r"(?:had\s+(?:the\s+)?)?(\w[\w\s]*?)\s+(?:not\s+)?(?:occurred|happened|taken place|changed)",
    r"without\s+(?:the\s+)?(\w[\w\s]+?)(?:,|\?|$)",
    r"in the absence of\s+(?:the\s+)?(\w[\w\s]+?)(?:,|\?|$)",
]
CONTRASTIVE = [
    r"why\s+(?:did\s+)?(.+?)\s+instead of\s+(.+?)(?:\?|$)",
    r"why\s+(.+?)\s+rather than\s+(.+?)(?:\?|$)",
    r"(.+?)\s+instead of\s+(.+?)(?:\?|$)",
]


def asked_counterfactual(question: str = "question", observed: str = "observed") -> str:
    """struct(kind, var, val, other) of a question: an intervention on an observed variable, what was taken away (0), or a contrast; null without one."""
    q, kind = f"lower({question})", S.counterfactual_kind(question)

    def first(patterns: list[str], group: int) -> str:
        return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({q}, {quoted(p)}, {group})), '')" for p in patterns) + ")"

    name = lambda x: S.resolved(f"translate({x}, ' ', '_')")
    return X.lets(
        [("kind_", kind), ("done_", S.intervention(question, observed)), ("gone_", first(RETROSPECTIVE, 1)), ("this_", first(CONTRASTIVE, 1)), ("that_", first(CONTRASTIVE, 2))],
        f"case when done_ is not null then named_struct('kind', kind_, 'var', done_.var, 'val', cast(done_.val as double), 'other', cast(null as string)) "
        f"when kind_ = 'retrospective' and gone_ is not null and {observed}[{name('gone_')}] is not null then named_struct('kind', kind_, 'var', {name('gone_')}, 'val', 0D, 'other', cast(null as string)) "
        f"when kind_ = 'contrastive' and this_ is not null then named_struct('kind', kind_, 'var', {name('this_')}, 'val', cast(null as double), 'other', that_) end",
    )


def reasoned(examples: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row per example: everything its text, table and question tell of causes, as counts, means and flags.

    ``sentences`` are (row_id, para, pos, sentence) of the examples' contexts. Relations are found once and written; each
    part is counted by row and joined.
    """
    key = ["row_id"]
    rels = cut_lineage(C.relations(sentences, ["row_id", "para", "pos"]).selectExpr("row_id", "concat(para, '.', pos) AS rid", "cause", "effect", "confidence", "lag", "polarity"))
    chains = cut_lineage(graph_chains(rels, key)).groupBy(*key).agg(F.count("*").alias("n_chains"), F.round(F.avg("confidence"), 6).alias("mean_chain_confidence"), F.avg("length").alias("mean_chain_length"))
    linked = C.chains(rels, key).groupBy(*key).agg(F.max("length").alias("max_linked_chain_length"))
    nested = C.nested(sentences.select("row_id", "sentence"), key).filter("depth > 0").groupBy(*key).agg(F.count("*").alias("n_nested"), F.max("depth").alias("max_depth"))
    hops = C.multi_hop(sentences.select("row_id", "sentence"), key).groupBy(*key).agg(F.count("*").alias("n_multi_hop"))
    more = C.transitive(rels, key).groupBy(*key).agg(F.count("*").alias("n_transitive"))
    labels = examples.select("row_id", F.expr(f"array_distinct(transform({M.entities("concat_ws(' ', question, array_join(pre_text, ' '), array_join(post_text, ' '))")}, e -> e.label))").alias("labels"))
    overlap = time_overlap(rels, labels, key)
    talk = C.pairs(sentences, ["row_id", "para"]).filter("is_causal").groupBy(*key).agg(F.count_if("explicit").alias("n_explicit"), F.count_if(~F.col("explicit")).alias("n_implicit"), F.round(F.avg("confidence"), 6).alias("discourse_confidence"))
    series = granger_from_tables(rels, examples.select("row_id", "table_cells"), key).groupBy(*key).agg(F.count("*").alias("granger_tested"), F.count_if("significant").alias("granger_significant"), F.round(F.avg("strength"), 6).alias("granger_strength"))
    paths = ranked_paths(examples, rels).groupBy(*key).agg(F.count("*").alias("scm_paths"), F.round(F.avg("support"), 6).alias("scm_support"), F.max("target").alias("scm_target"))
    seen = examples.select("row_id", "question", F.expr(T.observed_variables()).alias("observed"))
    asked = seen.select("row_id", F.expr(f"coalesce(question rlike {quoted(C.CAUSAL_QUESTION)}, false)").alias("is_causal"), F.size("observed").alias("n_observed"), F.expr(asked_counterfactual()).alias("cf"))
    strength = rels.groupBy(*key).agg(F.round(F.avg("confidence"), 6).alias("causal_strength"))
    out = asked
    for part in (E.graph_metrics(rels, key), strength, chains, linked, nested, hops, more, overlap, talk, series, paths):
        out = out.join(part, "row_id", "left")
    counts = [c for c in out.columns if c not in ("row_id", "is_causal", "cf", "scm_target")]
    return out.na.fill(0, counts)


def measured(reason: DataFrame) -> DataFrame:
    """One row per example of the measures of chains, counterfactuals, depth, model, discourse and series, from ``reasoned`` rows."""
    able = F.col("cf").isNotNull()
    return reason.select(
        "row_id", "is_causal", (F.col("num_edges") > 0).alias("detected"), "overlap", F.col("density").alias("graph_density"), F.col("mean_confidence").alias("edge_confidence"),
        "mean_chain_confidence", "mean_chain_length", F.expr("least(1D, n_chains / 5D)").alias("chain_coverage"), F.expr("cast(num_edges > 0 as double)").alias("counterfactual_readiness"),
        "n_nested", "n_multi_hop", "n_transitive", "max_depth", "max_linked_chain_length", "scm_paths", "scm_support", F.expr("cast(scm_target is not null as double)").alias("backdoor"),
        able.cast("double").alias("intervention"), F.expr("if(scm_target is not null, n_observed, 0)").alias("sensitivity_vars"), F.expr("cast(cf.var is not null as double)").alias("cf_query"),
        F.expr("cast(cf.var is not null and n_observed > 1 as double)").alias("cf_robustness"), F.expr("n_explicit + n_implicit").alias("discourse_total"), "n_implicit", "n_explicit", "discourse_confidence",
        F.expr("cast(n_explicit + n_implicit > 0 as double)").alias("discourse_features"), "granger_tested", "granger_significant", "granger_strength", F.expr("cast(granger_tested > 0 as double)").alias("granger_rate"),
    )


def batch(measures: DataFrame) -> DataFrame:
    """(measure, mean): the mean of every measure over all examples; the detection rate over questions about causes only."""
    names = [c for c in measures.columns if c not in ("row_id", "is_causal", "detected")]
    one = measures.agg(F.avg(F.expr("if(is_causal, cast(detected as double), null)")).alias("detection_rate"), *[F.avg(c).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), F.round(F.coalesce(F.col(n), F.lit(0.0)), 6).alias("mean")) for n in ("detection_rate", *names)])
    return one.select(F.inline(pairs))
