"""Evaluation: answer accuracy, errors, program and context measures, and the full report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import expressions as X


def scored(predictions: DataFrame, examples: DataFrame) -> DataFrame:
    """Predictions with answered, matched, relative_error and the question's gold answer.

    answered: both predicted and gold are non-empty; matched: they match (two empty ones do); relative_error: only where
    both are plain numbers. A prediction of an unknown row counts as one without a gold answer. One join on row_id.
    """
    gold = examples.select("row_id", F.col("answer").alias("gold"), F.col("program").alias("gold_program"))
    p = predictions.join(gold, "row_id", "left")
    a, b = X.plain_float(X.normalize_answer("predicted")), X.plain_float(X.normalize_answer("gold"))
    return p.select(
        "*",
        F.expr("coalesce(predicted, '') <> '' and coalesce(gold, '') <> ''").alias("answered"),
        F.expr(X.answers_match("predicted", "gold")).alias("matched"),
        F.expr(f"if({b} = 0, abs({a}), abs({a} - {b}) / abs({b}))").alias("relative_error"),
    )


def exact_median(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """(keys, name): the exact median of a column, without gathering a group in one task.

    A quantile sketch gives each group bounds that hold its median; values within them, about a thousandth of the group,
    are counted by value and added up to the middle places. Nulls are left out; keys may be null.
    """
    v = rows.select(*keys, F.col(column).alias("_v")).filter("_v is not null")
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    bounds = v.groupBy(*keys).agg(F.percentile_approx("_v", F.array(F.lit(0.4995), F.lit(0.5005)), F.lit(10000)).alias("_q"), F.count("*").alias("_n"))
    near = v.alias("v").join(bounds.alias("b"), same).select(*[F.col(f"v.{k}").alias(k) for k in keys], "_v", "_q", "_n")
    counted = near.groupBy(*keys, "_n", F.when(F.col("_v") < F.col("_q")[0], F.lit(None)).otherwise(F.least("_v", F.col("_q")[1])).alias("_at")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_at")))
    placed = counted.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c"))
    lower, upper = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_from") <= place) & (place < F.col("_upto")), F.col("_at")))

    return placed.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias(name))


def accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Execution accuracy and errors by ``keys``: total and correct over answered rows, count and all_correct over all."""
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.sum(F.expr("cast(matched as int)")).alias("all_correct"),
        F.sum(F.expr("cast(answered as int)")).alias("total"),
        F.sum(F.expr("cast(answered and matched as int)")).alias("correct"),
        F.round(F.avg(F.expr("if(answered, cast(matched as double), null)")), 6).alias("accuracy"),
        F.round(F.avg(F.expr("if(answered, relative_error, null)")), 4).alias("mean_relative_error"),
    )
    median = exact_median(rows.filter("answered"), keys, "relative_error", "_median").select(*[F.col(k).alias(f"_{k}") for k in keys], F.round("_median", 6).alias("median_relative_error"))
    return counts.join(median, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def report(rows: DataFrame) -> DataFrame:
    """Accuracy overall, by primary_type and by run in one pass of grouping sets; the level tells which.

    Partial counts are made before the shuffle, so a hot type costs one row per task.
    """
    wanted = rows.select("run_name", "primary_type", "answered", "matched", "relative_error", "confidence", "n_iterations", "time_seconds")
    return rows.sparkSession.sql(
        """
        SELECT CASE grouping_id(run_name, primary_type) WHEN 3 THEN 'overall' WHEN 2 THEN 'type' WHEN 1 THEN 'run' ELSE 'run and type' END AS level,
               run_name, primary_type, count(*) AS count, sum(cast(answered AS int)) AS total, sum(cast(answered AND matched AS int)) AS correct,
               round(avg(if(answered, cast(matched AS double), NULL)), 6) AS accuracy, round(avg(confidence), 9) AS mean_confidence,
               round(avg(n_iterations), 9) AS mean_iterations, round(avg(time_seconds), 9) AS mean_seconds
        FROM {wanted} GROUP BY GROUPING SETS ((), (run_name), (primary_type), (run_name, primary_type))
        """,
        wanted=wanted,
    )


def normalized_step(step: str) -> str:
    """A program step in lower case with every number to 4 decimals."""
    parts = f"transform(regexp_extract_all(concat(lower(trim({step})), '\\u0001'), r'(-?[0-9]+\\.?[0-9]*)|([^0-9-]+|-)', 0), x -> if(x rlike r'^-?[0-9]+\\.?[0-9]*$', format_string('%.4f', cast(x as double)), x))"
    return f"replace(array_join({parts}, ''), '\\u0001', '')"


def step_match(predicted: str, gold: str) -> str:
    """Share of the gold program's steps that the predicted one has at the same place; 0 if either is empty, null if null."""
    hits = f"aggregate(zip_with({predicted}, {gold}, (p, g) -> if(p is not null and g is not null and {normalized_step('p')} = {normalized_step('g')}, 1, 0)), 0, (s, x) -> s + x)"
    return f"case when {predicted} is null or {gold} is null then null when size({predicted}) = 0 or size({gold}) = 0 then 0D else {hits} / size({gold}) end"


def evidence_tokens(text: str) -> str:
    """Distinct words of three or more letters, and numbers, of a text."""
    return f"array_distinct(concat(regexp_extract_all(lower({text}), r'[a-z]{{3,}}', 0), regexp_extract_all({text}, r'-?[0-9][0-9,.]*', 0)))"


def context_quality(rows: DataFrame, retrieved: str = "retrieved", gold: str = "gold_evidence") -> DataFrame:
    """``rows`` with precision, recall and f1 of an array of passages against an array of gold passages.

    A passage is relevant if it has 0.4 of the tokens of some gold passage; all 0 without gold. Computed within the row.
    """
    staged = rows.select(
        "*",
        F.expr(f"transform(filter(coalesce({gold}, array()), g -> coalesce(g, '') <> ''), g -> {evidence_tokens('g')})").alias("_gold"),
        F.expr(f"transform(coalesce({retrieved}, array()), d -> {evidence_tokens('d')})").alias("_docs"),
    )
    near = "size(array_intersect(d, g)) / greatest(1, size(g)) >= 0.4"
    staged = staged.select(
        "*",
        F.expr(f"if(size(_docs) = 0 or size(_gold) = 0, 0D, size(filter(_docs, d -> exists(_gold, g -> {near}))) / size(_docs))").alias("precision"),
        F.expr(f"if(size(_gold) = 0, 0D, size(filter(_gold, g -> exists(_docs, d -> {near}))) / size(_gold))").alias("recall"),
    )
    f1 = "if(precision + recall > 0, 2 * precision * recall / (precision + recall), 0D)"
    return staged.withColumn("f1", F.expr(f1)).drop("_gold", "_docs")


def sufficiency(context: str, question: str, answer: str) -> str:
    """Half the share of question tokens, half the share of answer tokens, that the context holds; 0 without context."""
    c, q, a = (evidence_tokens(f"coalesce({x}, '')") for x in (context, question, answer))
    return f"if(coalesce({context}, '') = '', 0D, least(1D, 0.5D * size(array_intersect({c}, {q})) / greatest(1, size({q})) + 0.5D * size(array_intersect({c}, {a})) / greatest(1, size({a}))))"


def error_attribution(rows: DataFrame) -> DataFrame:
    """(cause, errors, share) of answered predictions that don't match: no retrieval, no program, failed execution, or reasoning.

    Expects has_context, has_program and success beside answered and matched.
    """
    wrong = rows.filter("answered and not matched").select(
        F.expr("case when not has_context then 'retrieval_failure' when not has_program then 'program_generation_failure' when not success then 'execution_failure' else 'reasoning_error' end").alias("cause")
    )
    counts = wrong.groupBy("cause").agg(F.count("*").alias("errors"))
    total = counts.agg(F.sum("errors")).scalar()
    return counts.select("cause", "errors", F.round(F.col("errors") / total, 6).alias("share"))


def method_rates(rows: DataFrame) -> DataFrame:
    """(method, count, share, success_rate) of a column method (null is 'unknown') and a boolean success."""
    counts = rows.groupBy(F.coalesce("method", F.lit("unknown")).alias("method")).agg(F.count("*").alias("count"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("method", "count", F.round(F.col("count") / total, 4).alias("share"), "success_rate")


def induction_rates(rows: DataFrame) -> DataFrame:
    """Generation rate, execution rate (per generated program, so it may pass 1) and mean attempts."""
    return rows.agg(
        F.round(F.avg(F.col("has_program").cast("double")), 6).alias("program_generation_rate"),
        F.round(F.sum(F.col("success").cast("int")) / F.greatest(F.lit(1), F.sum(F.col("has_program").cast("int"))), 6).alias("execution_success_rate"),
        F.round(F.avg("attempts"), 6).alias("mean_attempts"),
    )


def iteration_metrics(rows: DataFrame) -> DataFrame:
    """Iterations, confidence, convergence and improvement by termination reason and overall (null reason)."""
    agg = [
        F.count("*").alias("count"),
        F.round(F.avg("iterations"), 6).alias("mean_iterations"),
        F.round(F.avg("final_confidence"), 6).alias("mean_confidence"),
        F.round(F.avg(F.col("converged").cast("double")), 6).alias("convergence_rate"),
        F.round(F.avg("improvement"), 6).alias("mean_improvement"),
        F.round(F.avg((F.col("iterations") > 1).cast("double")), 6).alias("retrieval_rate"),
    ]
    return rows.rollup("termination").agg(*agg)


def entity_richness(labels: str) -> str:
    """min(1, (years + quarters) / 4) of an array of entity labels."""
    return f"least(1D, (size(filter({labels}, l -> l rlike r'\\b(?:19|20)[0-9]{{2}}\\b')) + size(filter({labels}, l -> lower(l) rlike 'q[1-4]'))) / 4D)"


def temporal_metrics(rows: DataFrame) -> DataFrame:
    """Mean richness, trend rate, alignment and their mean; deictic expressions found and resolved.

    Expects labels (array), trend (text), overlap, joint, deictic_found and deictic_resolved per row.
    """
    aligned = "least(1D, 0.5D * joint + 0.5D * least(1D, overlap / 2D))"
    detected = "coalesce(trend not in ('', 'insufficient_data'), false)"
    one = rows.agg(
        F.avg(F.expr(entity_richness("labels"))).alias("r"),
        F.avg(F.expr(f"cast({detected} as double)")).alias("t"),
        F.avg(F.expr(aligned)).alias("a"),
        F.sum("deictic_found").alias("f"),
        F.sum("deictic_resolved").alias("d"),
    )
    return one.selectExpr(
        "round(r, 6) AS mean_richness", "round(t, 6) AS trend_rate", "round(a, 6) AS mean_alignment", "round((r + t + a) / 3, 6) AS mean_score", "f AS deictic_found", "round(d / greatest(1, f), 6) AS deictic_resolution_rate"
    )


def module_accuracy(rows: DataFrame) -> DataFrame:
    """(module, count, correct, accuracy) over an array column modules: a row counts for each of its modules."""
    e = rows.select(F.explode("modules").alias("module"), "answered", "matched")
    return e.groupBy("module").agg(F.count("*").alias("count"), F.sum(F.expr("cast(answered and matched as int)")).alias("correct"), F.round(F.avg(F.expr("if(answered, cast(matched as double), null)")), 6).alias("accuracy"))


def graph_metrics(relations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, num_edges, num_nodes, density, mean_confidence) of relations (keys, cause, effect, confidence)."""
    ends = relations.select(*keys, "confidence", F.expr("lower(trim(cause))").alias("c"), F.expr("lower(trim(effect))").alias("e"))
    nodes = ends.select(*keys, F.explode(F.array("c", "e")).alias("n")).filter("n <> ''").groupBy(*keys).agg(F.countDistinct("n").alias("num_nodes"))
    edges = ends.groupBy(*keys).agg(F.count("*").alias("num_edges"), F.round(F.avg("confidence"), 8).alias("mean_confidence"))
    return edges.join(nodes, keys, "left").na.fill(0, ["num_nodes"]).withColumn("density", F.expr("round(num_edges / greatest(1, num_nodes * (num_nodes - 1)), 6)"))
