"""Question routing: lexical features, a fixed linear probe, softmax, and the active modules."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import expressions as X
from tallyforge.functions.expressions import quoted

ROUTES = ("numerical", "temporal", "causal", "factual")

# Patterns of each route; a feature counts how many of a route's patterns are found.
PATTERNS = {
    "numerical": [
        r"\b(total|sum|difference|ratio|percentage|average|net|gross|cagr|eps|roe|roa)\b",
        r"\b(calculate|compute|determine|how much|how many|by how much)\b",
        r"\b(increase|decrease|change|grew|declined|rose|fell)\s+by\b",
        r"\b(percent|percentage|fraction|proportion|share|basis points?)\b",
    ],
    "temporal": [
        r"\b(19\d{2}|20\d{2})\b",
        r"\b(year|quarter|month|fiscal|annual|quarterly|yoy|qoq|trend|historically)\b",
        r"\b(previous|prior|last|next|following|subsequent|current)\s+(year|quarter|period)\b",
        r"\b(before|after|since|until|between|during)\b",
    ],
    "causal": [
        r"^why\b",
        r"\b(caused|led to|drove|contributed to|resulted in|because|due to|reason|driver|factor)\b",
        r"\b(impact|effect|influence|consequence)\b",
        r"\b(explain|account for)\b",
    ],
    "factual": [
        r"^(what|which)\s+(is|was|were|are)\s+the\s+(company|segment|name|category|type|item|product|unit)\b",
        r"^(list|name|identify)\b",
        r"\b(company|segment|category|item|product|entity)\s+(name|type|called)\b",
    ],
}
NUMBER = r"\b\d[\d,.]*\b"
MARKER = r"\b(q[1-4]|fy\d{2,4}|year-over-year|quarter-over-quarter|yoy|qoq)\b"
PERCENT = r"\b(percent|percentage|%)\b"
CAUSE = r"\b(why|due to|because|impact|caused)\b"
TIME = r"\b(year|quarter|q[1-4]|yoy|qoq|before|after|since)\b"
COMPARISON = r"\b(compared? to|versus|vs|relative to|higher|lower|more|less)\b"

# Weights of the twelve lexical features, then of the four embedding similarities (0 without an encoder).
WEIGHTS = {
    "numerical": [1.0, 0.0, -0.3, -0.4, 0.5, 0.0, -0.4, 0.0, 0.7, -0.2, -0.1, 0.1, 0.4, 0.0, -0.1, -0.1],
    "temporal": [0.0, 1.2, 0.0, -0.3, 0.0, 0.6, -0.2, 0.5, 0.0, 0.2, 0.0, 0.4, 0.0, 0.4, 0.0, -0.1],
    "causal": [-0.2, 0.0, 1.2, -0.3, -0.1, 0.0, 0.9, 0.0, -0.1, 0.3, 0.0, 0.0, -0.1, 0.0, 0.4, -0.1],
    "factual": [-0.4, -0.3, -0.3, 1.2, -0.2, -0.2, -0.4, -0.2, -0.3, -0.2, 0.1, -0.2, -0.1, -0.1, -0.1, 0.4],
}


def features(question: str = "question") -> str:
    """Array of the sixteen features of a question; the last four are left to an encoder."""
    q = f"trim({question})"

    def has(pattern: str, text: str = f"lower({q})") -> str:
        return f"cast({text} rlike {quoted(pattern)} as int)"

    counts = [" + ".join(has(p) for p in PATTERNS[r]) for r in ROUTES]
    parts = [
        *counts,
        has(NUMBER),
        has(MARKER),
        f"cast(startswith(lower({q}), 'why') as int)",
        f"least(regexp_count({q}, {quoted(PATTERNS['temporal'][0])}), 4)",
        has(PERCENT),
        f"{has(CAUSE)} * {has(TIME)}",
        f"least(1D, size(split({q}, r'\\s+')) / 20D)",
        has(COMPARISON),
        *["0"] * 4,
    ]
    return f"array({', '.join(f'cast({p} as double)' for p in parts)})"


def probe(question: str = "question", mean: list[float] | None = None, std: list[float] | None = None, weights: dict[str, list[float]] | None = None, bias: list[float] | None = None) -> str:
    """struct(p, joint, primary_type, modules) of a question; p has the routes in order."""
    mean, std = mean or [0.0] * 16, std or [1.0] * 16
    scaled = [f"((f[{i}] - {m}D) / {s + 1e-8}D)" for i, (m, s) in enumerate(zip(mean, std))]
    logits = ", ".join(" + ".join([f"({w}D * {x})" for w, x in zip((weights or WEIGHTS)[r], scaled) if w] + ([f"{b}D"] if b else [])) or "0D" for r, b in zip(ROUTES, bias or [0.0] * len(ROUTES)))
    names = ", ".join(f"'{r}'" for r in ROUTES)
    active = f"filter(transform(array({names}), (r, i) -> if(p[i] >= greatest(0.15D, 0.5D * array_max(p)), r, null)), r -> r is not null)"
    return X.lets(
        [
            ("f", features(question)),
            ("l", f"array({logits})"),
            ("e", "transform(l, x -> exp(x - array_max(l)))"),
            ("p", f"if(coalesce(trim({question}), '') = '', array(0.25D, 0.25D, 0.25D, 0.25D), transform(e, x -> x / (aggregate(e, 0D, (s, y) -> s + y) + 1e-10D)))"),
            ("joint", f"if(coalesce(trim({question}), '') = '', 0D, greatest(least(1D, p[1] * p[2] * 16), if(f[9] > 0.5, 0.6D, 0D)))"),
            ("base", active),
        ],
        f"named_struct('p', p, 'joint', joint, 'primary_type', array({names})[array_position(p, array_max(p)) - 1], 'modules', if(joint >= 0.3, concat(array_union(base, array('temporal', 'causal')), array('temporal_causal_joint')), if(size(base) = 0, array('factual'), base)))",
    )


def routed(questions: DataFrame, mean: list[float] | None = None, std: list[float] | None = None, weights: dict[str, list[float]] | None = None, bias: list[float] | None = None) -> DataFrame:
    """Columns p_numerical … p_factual, joint, primary_type and modules for every row with a question.

    A null or blank question has 0.25 for each route and a joint score of 0. Ties go to the first route.
    """
    r = questions.withColumn("_r", F.expr(probe("question", mean, std, weights, bias)))
    return r.select("*", *[F.expr(f"_r.p[{i}]").alias(f"p_{x}") for i, x in enumerate(ROUTES)], "_r.joint", "_r.primary_type", "_r.modules").drop("_r")


def fit_router(labelled: DataFrame, most: int = 100_000) -> object:
    """A multinomial logistic model of (question, label) for the features; rows beyond ``most`` are sampled by hash of the question.

    Returns the fitted pyspark.ml pipeline model, whose output column is ``prediction``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    known = labelled.filter("question is not null and label is not null")
    share = most / max(1, known.count())
    if share < 1:
        known = known.filter(F.expr(f"pmod(xxhash64(question), 1000000) < {int(share * 1_000_000)}"))
    rows = known.withColumn("features", array_to_vector(F.expr(features())))
    return Pipeline(stages=[StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), LogisticRegression(featuresCol="features", labelCol="y", maxIter=30, regParam=0.001)]).fit(rows)


def save_weights(path: str, mean: list[float] | None = None, std: list[float] | None = None, weights: dict[str, list[float]] | None = None, bias: list[float] | None = None) -> None:
    """The probe's weights as one JSON object: W (a row per route, in order), b, mean and std."""
    w = weights or WEIGHTS
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"W": [w[r] for r in ROUTES], "b": bias or [0.0] * len(ROUTES), "mean": mean or [0.0] * 16, "std": std or [1.0] * 16}, f)


def load_weights(path: str) -> dict:
    """What ``save_weights`` wrote, checked for its shape: weights by route, bias, mean and std."""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    if len(got["W"]) != len(ROUTES) or any(len(r) != 16 for r in [*got["W"], got["mean"], got["std"]]) or len(got["b"]) != len(ROUTES):
        raise ValueError(f"{path} doesn't hold the weights of {len(ROUTES)} routes and 16 features")
    return {"weights": dict(zip(ROUTES, got["W"])), "bias": got["b"], "mean": got["mean"], "std": got["std"]}


def prototypes(labelled: DataFrame, encode: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """(label, prototype): the mean embedding of the questions of each label, for (question, label) rows."""
    from tallyforge.operators.retrieval import encoded

    e = encoded(labelled.filter("question is not null and label is not null"), "question", encode)
    means = e.select("label", F.posexplode("embedding").alias("at", "v")).groupBy("label", "at").agg(F.avg("v").alias("v"))
    # a label has as many means as an embedding has places
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("p")).select("label", F.expr("transform(p, x -> x.v)").alias("prototype"))
