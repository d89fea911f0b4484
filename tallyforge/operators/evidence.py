"""Control of the answering loop: confidence, gaps, query rewriting, attention and aggregation of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import expressions as X

# Words that widen a query for each gap.
EXPANSIONS = {
    "execution_failure": ["formula", "calculation", "compute"],
    "no_result": ["table", "data", "values"],
    "insufficient_entities": ["year", "quarter", "period"],
    "no_trend": ["increase", "decrease", "change"],
    "no_relations": ["because", "caused", "due to"],
}
REWRITES = ["what factors explain", "what evidence shows", "how does the data indicate"]

#: Columns that an assessment reads: booleans unless said.
SIGNALS = "success has_result has_program is_pot implausible n_entities(int) has_trend has_temporal_context has_constraints n_relations(int) has_causal_context has_discourse has_granger modules(array)"


def assessed(rows: DataFrame) -> DataFrame:
    """``rows`` (with SIGNALS) with confidence, the mean over active modules (0.5 without any), and gaps in order."""
    num = "0.40D * cast(success as int) + 0.30D * cast(has_result as int) + 0.15D * cast(has_program as int) + 0.15D * cast(is_pot as int) - 0.25D * cast(implausible as int)"
    tem = "0.25D * cast(n_entities > 0 as int) + 0.20D * cast(n_entities >= 2 as int) + 0.25D * cast(has_trend as int) + 0.15D * cast(has_temporal_context as int) + 0.15D * cast(has_constraints as int)"
    cau = "0.30D * cast(n_relations > 0 as int) + 0.15D * cast(n_relations >= 2 as int) + 0.20D * cast(has_causal_context as int) + 0.15D * cast(has_discourse as int) + 0.20D * cast(has_granger as int)"
    parts = [("numerical", num), ("temporal", tem), ("causal", cau)]
    scores = ", ".join(f"if(array_contains(modules, '{m}'), {e}, null)" for m, e in parts)
    gaps = [
        ("numerical", "not success", "execution_failure"),
        ("numerical", "not has_result", "no_result"),
        ("numerical", "implausible", "implausible_result"),
        ("temporal", "n_entities < 2", "insufficient_entities"),
        ("temporal", "not has_trend", "no_trend"),
        ("causal", "n_relations = 0", "no_relations"),
    ]
    listed = ", ".join(f"if(array_contains(modules, '{m}') and {w}, '{g}', null)" for m, w, g in gaps)
    mean = X.lets([("s", f"filter(array({scores}), x -> x is not null)")], "if(size(s) = 0, 0.5D, aggregate(s, 0D, (t, x) -> t + x) / size(s))")
    return rows.withColumn("confidence", F.expr(f"round({mean}, 6)")).withColumn("gaps", F.expr(f"filter(array({listed}), g -> g is not null)"))


def reformulated(question: str, gap: str, entities: str, terms: str, iteration: int) -> str:
    """A query of the question, up to five entities, three words for the gap, three trace terms, and from the second round a rewrite."""
    widen = " ".join(f"when '{g}' then '{' '.join(ws)}'" for g, ws in EXPANSIONS.items())
    unique = f"transform(filter({entities}, (e, i) -> trim(e) <> '' and not exists(slice({entities}, 1, i), o -> lower(trim(o)) = lower(trim(e)))), e -> trim(e))"
    core = rf"left(regexp_replace(lower({question}), r'^(?:what|how|why|when|which)\b\s*', ''), 60)"
    rewrite = f"concat('{REWRITES[(iteration - 2) % 3]} ', {core})" if iteration >= 2 else "null"
    return f"concat_ws(' ', {question}, nullif(array_join(slice({unique}, 1, 5), ' '), ''), case {gap} {widen} end, nullif(array_join(slice(array_distinct({terms}), 1, 3), ' '), ''), {rewrite})"


def attention() -> str:
    """struct of four weights that sum to 1, from success, has_result, n_entities, n_relations, causal_strength and retrieval_score."""
    raw = (
        "named_struct('numerical', if(success and has_result, 0.9D, 0D), 'temporal', least(0.85D, 0.2D + 0.08D * n_entities), "
        "'causal', greatest(causal_strength, if(n_relations > 0, 0.35D, 0D)), 'retrieval', least(0.8D, coalesce(retrieval_score, 0D)))"
    )
    total = "if(r.numerical + r.temporal + r.causal + r.retrieval = 0, 1D, r.numerical + r.temporal + r.causal + r.retrieval)"
    fields = ", ".join(f"'{k}', round(r.{k} / {total}, 6)" for k in ("numerical", "temporal", "causal", "retrieval"))
    return X.lets([("r", raw)], f"named_struct({fields})")


def aggregated_answer() -> str:
    """The executed result, else a refined one, else a model's answer, else ''; columns result_str, result_num, refined, generated."""
    return f"coalesce(if(success, coalesce(result_str, {X.format_answer('result_num')}), null), refined, {X.reply_answer('generated')}, '')"


def backward_check(answer: str, evidence: str) -> str:
    """struct(supports, overlap, reconstructed, confidence) of an answer against its evidence text; columns success, has_temporal_context, n_relations."""
    supports = "filter(array(if(success, 'numerical', null), if(has_temporal_context, 'temporal', null), if(n_relations > 0, 'causal', null)), s -> s is not null)"
    overlap = f"size(filter(regexp_extract_all(lower({answer}), r'[a-z0-9.%-]+', 0), t -> length(t) > 2 and contains(lower(coalesce({evidence}, '')), t)))"
    return X.lets([("s", supports), ("o", overlap)], "named_struct('supports', s, 'overlap', o, 'reconstructed', size(s) > 0 and (o > 0 or success), 'confidence', round(least(1D, 0.22D * size(s) + if(o > 0, 0.2D, 0D)), 6))")


def gap_query(question: str) -> str:
    """The older rewrite of a question by its first gap; null without one. Columns modules, n_relations, n_entities, is_pot, success."""
    return (
        f"case when array_contains(modules, 'causal') and n_relations = 0 then concat({question}, ' why caused drivers impact') "
        f"when array_contains(modules, 'temporal') and n_entities < 2 then concat({question}, ' before after since timeline') "
        f"when array_contains(modules, 'numerical') and is_pot and not success then concat({question}, ' table values formula') end"
    )


def rounds(rows: DataFrame, again, threshold: float = 0.7, most: int = 3, least_gain: float = 0.02) -> DataFrame:
    """The iterative loop over all rows at once: final confidence, iterations, termination, converged and improvement.

    ``rows`` hold an assessment; ``again(open_rows, i)`` returns those still open, assessed anew. Each round runs over
    the rows that haven't met the threshold or a plateau (a gain under ``least_gain`` from the second round on), so the
    work shrinks with every round.
    """
    state = rows.withColumn("first", F.col("confidence")).withColumn("iterations", F.lit(1))
    met = F.col("confidence") >= threshold
    done = state.filter(met).withColumn("termination", F.lit("threshold_met_initial"))
    left = state.filter(~met)
    for i in range(1, most + 1):
        before = left.withColumnRenamed("confidence", "previous")
        left = again(before, i).withColumn("iterations", F.lit(i + 1))
        flat = (F.col("confidence") - F.col("previous") < least_gain) & F.lit(i >= 2)
        ended = left.withColumn("termination", F.when(met, "threshold_met").when(flat, "plateau").when(F.lit(i == most), "max_iterations"))
        done = done.unionByName(ended.filter("termination is not null").drop("previous"), allowMissingColumns=True)
        left = ended.filter("termination is null").drop("previous", "termination")
    return done.withColumn("converged", F.col("termination").startswith("threshold")).withColumn("improvement", F.round(F.col("confidence") - F.col("first"), 6)).withColumnRenamed("confidence", "final_confidence")
