"""Answering questions as a whole: routes, retrieval, reasoning by active module, the loop of retrieval and reasoning, and the answer.

All questions go through each step together; a round of the loop runs over the questions that are still open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyforge.functions import expressions as X
from tallyforge.operators import causal_reasoning as K
from tallyforge.operators import causal_text as C
from tallyforge.operators import evidence as V
from tallyforge.operators import programs as P
from tallyforge.operators import retrieval as R
from tallyforge.operators import routing as G
from tallyforge.operators import table_ops as T
from tallyforge.operators import temporal as M
from tallyforge.session import cut_lineage
from tallyforge.sources.tables import spread



def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written and read again over all cores: what follows computes much for each row."""
    return spread(cut_lineage(df), 0)


BASE = ["row_id", "question", "table_cells", "pre_text", "post_text", "answer"]
CONTEXT_MOST = 2500  #: characters of the first context
MODULES = ("numerical", "temporal", "causal")


def retrieved(examples: DataFrame, query: str = "question", k: int = 5) -> DataFrame:
    """(row_id, passages, retrieval_score): the ``k`` best text passages of every example for its query, best first."""
    hits = R.fused(R.scored_passages(examples, query), "text", k)
    picked = hits.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_idx"))).alias("_h"), F.max("score").alias("retrieval_score"))  # at most k a row
    docs = examples.select("row_id", F.expr(R.passage_array()).alias("_d"))
    return docs.join(picked, "row_id", "left").select("row_id", F.expr("transform(coalesce(_h, array()), h -> _d[h.doc_idx].text)").alias("passages"), "retrieval_score")


def cascade(rows: DataFrame) -> DataFrame:
    """(row_id, op, program, method, success, result_num, result_str, implausible) of rows (row_id, question, table_cells, context).

    A program that rules induce holds if it runs and its result is plausible and dimensionally sound; else the method is
    program_of_thought, without a result, for a model to go on from ``programs.pot_prompt``.
    """
    e = P.induced(rows.select("row_id", "question", "table_cells", "context").filter("question is not null"), "context")
    ready = kept(e.select("row_id", "question", "table_cells", "op", F.col("induced").alias("program")))
    done = P.executed(T.prepared(ready))
    fit = X.plausible("result_num", "question")
    gated = done.select("row_id", "op", "program", "result_num", "result_str", F.expr(f"success and (result_str is not null or {fit}.ok) and {P.dimensional()} = 'ok'").alias("success"), F.expr(f"success and result_str is null and not {fit}.ok").alias("implausible"))
    keep = lambda c: F.when(F.col("success"), F.col(c)).alias(c)
    return gated.select("row_id", "op", "program", F.expr("if(success, 'induced_program', 'program_of_thought')").alias("method"), "success", keep("result_num"), keep("result_str"), "implausible")


def question_trends(examples: DataFrame) -> DataFrame:
    """(row_id, trend) of the table row under years whose label shares most words with the question; the first of equals."""
    rows = M.table_trends(examples).join(examples.select("row_id", "question"), "row_id")
    shared = f"size(array_intersect({X.words3('label')}, {X.words3('question')}))"
    best = rows.groupBy("row_id").agg(F.max_by("values", F.expr(f"struct({shared} AS s, -row_idx AS i)")).alias("v"))
    return best.select("row_id", F.expr(f"{M.trend('v')}.trend").alias("trend"))


def reasoned(rows: DataFrame, trends: DataFrame) -> DataFrame:
    """The evidence of each active module for rows (row_id, question, table_cells, modules, context): evidence.SIGNALS and what they rest on.

    Every example's reasoners see its question, table and context only; each runs over the rows where its module is
    active, and what it finds is counted by row.
    """
    numbers = cascade(rows.filter("array_contains(modules, 'numerical')"))
    s = rows.filter("arrays_overlap(modules, array('temporal', 'causal'))").select("row_id", "modules", F.expr(f"posexplode({X.sentences("coalesce(context, '')")}) AS (pos, sentence)"))
    s = kept(s)
    causal = s.filter("array_contains(modules, 'causal')").drop("modules")
    relations = cut_lineage(C.merged(C.relations(causal, ["row_id"]), ["row_id"], 0.3))
    found = relations.groupBy("row_id").agg(F.count("*").alias("n_relations"), F.avg("confidence").alias("causal_strength"), F.sort_array(F.collect_set(F.expr("split(cause, ' ')[0]"))).alias("causes"))
    talk = C.pairs(causal, ["row_id"]).filter("is_causal").groupBy("row_id").agg(F.count("*").alias("n_discourse"))
    series = K.granger_from_tables(relations, rows.select("row_id", "table_cells"), ["row_id"]).groupBy("row_id").agg(F.count("*").alias("n_granger"))
    order = M.relations(s.filter("array_contains(modules, 'temporal')").drop("modules", "pos"), ["row_id"]).groupBy("row_id").agg(F.count("*").alias("n_events"))
    labels = f"array_distinct(transform({M.entities("concat(coalesce(question, ''), ' ', coalesce(context, ''))")}, e -> e.label))"
    out = rows.withColumn("labels", F.expr(f"if(array_contains(modules, 'temporal'), {labels}, cast(array() as array<string>))"))
    for part in (numbers, trends, found, talk, series, order):
        out = out.join(part, "row_id", "left")
    out = out.na.fill(0, ["n_relations", "n_discourse", "n_granger", "n_events", "causal_strength"]).na.fill(False, ["success", "implausible"])
    return out.select(
        "*",
        F.expr("result_num is not null or result_str is not null").alias("has_result"),
        F.expr("success and size(program) > 0").alias("has_program"),
        F.expr("coalesce(method = 'program_of_thought', false)").alias("is_pot"),
        F.size("labels").alias("n_entities"),
        F.expr("coalesce(trend <> 'insufficient_data', false)").alias("has_trend"),
        F.expr("size(labels) > 0 or coalesce(trend <> 'insufficient_data', false)").alias("has_temporal_context"),
        F.expr("n_events > 0").alias("has_constraints"),
        F.expr("n_relations > 0").alias("has_causal_context"),
        F.expr("n_discourse > 0").alias("has_discourse"),
        F.expr("n_granger > 0").alias("has_granger"),
    )


def generated(rows: DataFrame, prompt: str, generate: Callable[[list[str]], list[str]] | None = None, column: str = "generated") -> DataFrame:
    """``rows`` with a model's reply to the expression ``prompt``; null without a model. ``generate`` takes a batch of prompts."""
    if generate is None:
        return rows.withColumn(column, F.lit(None).cast("string"))
    asked = rows.withColumn("_prompt", F.expr(prompt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array(generate([x or "" for x in b.column("_prompt").to_pylist()]), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], names=[*b.schema.names[:-1], column])

    return asked.mapInArrow(run, StructType([*rows.schema.fields, StructField(column, StringType())]))


def answer_prompt(context: str = "context") -> str:
    """Prompt for a model where no program answers: the sub-table that matters, the evidence found and the question."""
    return (
        f"concat('Answer the financial question from the table and the text.\\n\\nTable:\\n', {T.markdown()}, '\\n\\nText:\\n', left(coalesce({context}, ''), 2000), "
        "'\\n\\nPeriods: ', array_join(labels, ', '), '\\nTrend: ', coalesce(trend, 'unknown'), '\\nCausal relations: ', cast(n_relations as string), '\\n\\nQuestion: ', coalesce(question, ''), '\\nAnswer:')"
    )


def refined(rows: DataFrame, generate: Callable[[list[str]], list[str]] | None = None, attempts: int = 3) -> DataFrame:
    """``rows`` with refined: the vote over up to ``attempts`` programs a model writes where rules gave none, each held by the same gates.

    A later attempt is asked with the reply before it. Without a model refined is null.
    """
    if generate is None:
        return rows.withColumn("refined", F.lit(None).cast("string"))
    left = rows.filter("is_pot").select("row_id", "question", "table_cells", "context", F.lit("").alias("before"))
    tries = None
    for i in range(attempts):
        prompt = f"concat({P.pot_prompt(context='context')}, if(before = '', '', concat('\\nThis program failed:\\n', before, '\\nCorrect it.')))"
        replied = cut_lineage(generated(left, prompt, generate, "reply"))
        ready = replied.select("row_id", "question", "table_cells", "context", "reply", F.expr(P.constrained(X.code_block("reply"))).alias("program"))
        done = P.executed(T.prepared(ready))
        value = F.expr(f"coalesce(result_str, {X.format_answer('result_num')})").alias("value")
        plausible = F.expr(f"coalesce(result_str is not null or {X.plausible('result_num', 'question')}.ok, false)").alias("plausible")
        got = cut_lineage(done.select("row_id", "question", "table_cells", "context", F.coalesce("reply", F.lit("")).alias("before"), "success", "result_num", value, plausible))
        ok = got.filter("success").select("row_id", F.lit(i).alias("at"), "result_num", "value", "plausible")
        tries = ok if tries is None else tries.unionByName(ok)
        left = got.filter("not (success and plausible)").select("row_id", "question", "table_cells", "context", "before")
    return rows.join(voted(tries), "row_id", "left")


def voted(tries: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(row_id, refined) of tries (row_id, at, result_num, value, plausible): the first plausible member of the largest cluster, or its first.

    A number belongs to the first cluster whose first member it is within ``tolerance`` of, a text to its equals. A row
    has as many tries as the loop made.
    """
    near = f"if(c.ref is null or v.x is null, c.value = v.value, if(abs(c.ref) < 1e-9D, abs(v.x) < 1e-9D, abs(c.ref - v.x) / abs(c.ref) < {tolerance}D))"
    kind = "array<struct<ref: double, value: string, n: bigint, best: string>>"
    hit = f"get(filter(transform(acc, (c, i) -> if({near}, i, null)), i -> i is not null), 0)"
    new = "named_struct('ref', v.x, 'value', v.value, 'n', 1L, 'best', if(v.plausible, v.value, null))"
    add = "named_struct('ref', c.ref, 'value', c.value, 'n', c.n + 1, 'best', coalesce(c.best, if(v.plausible, v.value, null)))"
    fold = f"aggregate(vs, cast(array() as {kind}), (acc, v) -> if({hit} is null, concat(acc, array({new})), transform(acc, (c, i) -> if(i = {hit}, {add}, c))))"
    grouped = tries.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("at", F.col("result_num").alias("x"), "value", "plausible"))).alias("vs"))
    largest = f"transform(array({fold}), k -> get(filter(k, c -> c.n = array_max(transform(k, x -> x.n))), 0))[0]"
    return grouped.select("row_id", F.expr(f"transform(array({largest}), c -> coalesce(c.best, c.value))[0]").alias("refined"))


def answered(examples: DataFrame, generate: Callable[[list[str]], list[str]] | None = None, threshold: float = 0.7, most: int = 3) -> DataFrame:
    """One row per example with a question: routes, evidence, loop, answer and whether it matches.

    Columns: row_id, primary_type, modules, op, program, method, success, iterations, final_confidence, termination,
    converged, improvement, gaps, predicted, matched, attention, backward, context. The first context is the best three
    passages, after those for the table's years that they lack where they cover less than half of them; every round asks
    for what the first gap lacks, adds the passages found to the context, and reasons anew. Examples without table or
    texts run with empty ones; an example given twice counts twice only if its row_id differs.
    """
    base = kept(G.routed(examples.select(*BASE).filter("trim(question) <> ''")).select(*BASE, "primary_type", "modules", "joint"))
    first = base.join(retrieved(base), "row_id")
    first = kept(first.withColumn("context", F.expr(f"left(array_join(slice(passages, 1, 3), ' '), {CONTEXT_MOST})")))
    off = first.withColumn("_a", F.expr(T.alignment("context"))).filter("_a.mismatched and size(passages) > 0")
    lacking = f"array_except({T.header_years()}, transform({X.years('context')}, y -> cast(y as string)))"
    off = off.select("row_id", F.expr(lacking).cast("array<string>").alias("_years")).filter("size(_years) > 0")
    more = retrieved(base.join(off, "row_id").withColumn("_q", F.expr("concat(question, ' ', array_join(_years, ' '))")), "_q").select("row_id", F.expr("slice(passages, 1, 2)").alias("_more"))
    first = first.join(more, "row_id", "left").withColumn("passages", F.expr("concat(coalesce(_more, array()), passages)")).drop("_more")
    first = kept(first.withColumn("context", F.expr(f"left(array_join(slice(passages, 1, 3), ' '), {CONTEXT_MOST})")))
    trends = cut_lineage(question_trends(base.filter("array_contains(modules, 'temporal')")))

    def assess(rows: DataFrame) -> DataFrame:
        return V.assessed(reasoned(rows, trends))

    def again(open_rows: DataFrame, i: int) -> DataFrame:
        asked = open_rows.withColumn("widened", F.expr(V.reformulated("question", "get(gaps, 0)", "labels", "coalesce(causes, cast(array() as array<string>))", i)))
        found = retrieved(asked.select(*BASE, "widened"), "widened").select("row_id", F.col("passages").alias("_found"))
        more = asked.select(*first.columns, "first", "previous").join(found, "row_id")
        # what stands in the context counts as seen: the passages it was made of
        more = more.withColumn("context", F.expr(R.merged_context("slice(passages, 1, 3)", "_found"))).withColumn("passages", F.expr("array_union(slice(passages, 1, 3), _found)"))
        return cut_lineage(assess(kept(more.drop("_found"))))

    looped = V.rounds(cut_lineage(assess(first)), again, threshold, most)
    asked = refined(cut_lineage(looped), generate)
    out = generated(asked, answer_prompt(), generate).withColumn("predicted", F.expr(V.aggregated_answer()))
    return out.select(
        "row_id", "primary_type", "modules", "op", "program", "method", "success", "iterations", "final_confidence", "termination", "converged", "improvement", "gaps", "predicted",
        F.expr(X.answers_match("predicted", "answer")).alias("matched"), F.expr(V.attention()).alias("attention"), F.expr(V.backward_check("predicted", "context")).alias("backward"), "context",
    )
