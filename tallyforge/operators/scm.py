"""The structural model of a company's accounts: its graph, interventions, counterfactuals and sensitivities.

The model is a constant graph, so an intervention is one projection over all rows: a column per variable in topological
order, each recomputed only where the intervened variable is above it.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Edges of the model from cause to effect.
EDGES = [
    ("interest_rate", "loan_demand"), ("interest_rate", "nim"), ("interest_rate", "asset_values"), ("interest_rate", "interest_expense"),
    ("inflation", "input_costs"), ("inflation", "pricing_power"), ("inflation", "real_revenue"),
    ("loan_demand", "revenue"), ("pricing_power", "revenue"), ("real_revenue", "revenue"),
    ("revenue", "gross_profit"), ("input_costs", "gross_profit"), ("gross_profit", "operating_income"), ("depreciation", "operating_income"), ("sga_expense", "operating_income"),
    ("operating_income", "ebit"), ("ebit", "net_income"), ("interest_expense", "net_income"), ("tax_rate", "net_income"), ("net_income", "eps"), ("share_count", "eps"),
    ("capex", "depreciation"), ("debt", "interest_expense"), ("net_income", "retained_earnings"), ("retained_earnings", "equity"), ("debt", "total_assets"), ("equity", "total_assets"),
    ("net_income", "roe"), ("equity", "roe"), ("net_income", "roa"), ("total_assets", "roa"), ("revenue", "operating_margin"), ("operating_income", "operating_margin"),
]
NODES = list(dict.fromkeys(x for e in EDGES for x in e))
PARENTS = {n: [a for a, b in EDGES if b == n] for n in NODES}


def _reach(node: str, step: dict[str, list[str]]) -> set[str]:
    seen: set[str] = set()
    todo = list(step.get(node, []))
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += step.get(x, [])
    return seen


CHILDREN = {n: [b for a, b in EDGES if a == n] for n in NODES}
DESCENDANTS = {n: _reach(n, CHILDREN) for n in NODES}
ANCESTORS = {n: _reach(n, PARENTS) for n in NODES}


@cache
def order() -> tuple[str, ...]:
    """Variables with every cause before its effects; of those that are ready the first by name comes first."""
    out: list[str] = []
    left = sorted(NODES)
    while left:
        ready = next(n for n in left if all(p in out for p in PARENTS[n]))
        out.append(ready)
        left.remove(ready)
    return tuple(out)


def paths(source: str, target: str, most: int = 6) -> list[list[str]]:
    """Directed paths of at most ``most`` variables."""
    out, todo = [], [[source]]
    while todo:
        p = todo.pop()
        if p[-1] == target and len(p) > 1:
            out.append(p)
        elif len(p) < most:
            todo += [[*p, c] for c in CHILDREN.get(p[-1], []) if c not in p]
    return sorted(out)


def separated(x: str, y: str, given: set[str]) -> bool:
    """Whether ``given`` blocks every trail between two variables."""
    above = set(given).union(*(ANCESTORS[g] for g in given)) if given else set()
    todo, seen = [(x, "up")], set()
    while todo:
        n, way = todo.pop()
        if (n, way) in seen:
            continue
        seen.add((n, way))
        if n == y and n not in given:
            return False
        if way == "up" and n not in given:
            todo += [(p, "up") for p in PARENTS[n]] + [(c, "down") for c in CHILDREN[n]]
        elif way == "down":
            if n not in given:
                todo += [(c, "down") for c in CHILDREN[n]]
            if n in above:
                todo += [(p, "up") for p in PARENTS[n]]
    return True


def backdoor(x: str, y: str) -> tuple[list[str], bool]:
    """The parents of x that aren't its descendants, and whether they block all trails into x from y."""
    chosen = {p for p in PARENTS[x] if p not in DESCENDANTS[x]}
    valid = all(separated(p, y, {x}) or p in chosen for p in PARENTS[x]) and not chosen & DESCENDANTS[x]
    return sorted(chosen), valid


def frontdoor(x: str, y: str) -> tuple[list[str], bool]:
    """Variables between x and y on directed paths, and whether every directed path passes one."""
    found = paths(x, y)
    inner = sorted({n for p in found for n in p[1:-1]})
    return inner, bool(inner) and all(len(p) > 2 for p in found)


def graph_table(spark: SparkSession) -> DataFrame:
    """(node, relation, other) of every ancestor and descendant: a few hundred rows, whatever the data."""
    rows = [(n, k, o) for n in NODES for k, of in (("ancestor", ANCESTORS), ("descendant", DESCENDANTS)) for o in sorted(of[n])]
    return spark.createDataFrame(rows, "node string, relation string, other string")


def paths_table(spark: SparkSession) -> DataFrame:
    """(source, target, path, length) of every directed path of at most six variables."""
    rows = [(a, b, " > ".join(p), len(p)) for a in NODES for b in DESCENDANTS[a] for p in paths(a, b)]
    return spark.createDataFrame(rows, "source string, target string, path string, length int")


def structure(spark: SparkSession) -> DataFrame:
    """Counts of variables, edges, equations and variables without a cause."""
    outer = sum(not PARENTS[n] for n in NODES)
    return spark.createDataFrame([(len(NODES), len(EDGES), len(EQUATIONS), outer)], "num_nodes int, num_edges int, num_equations int, num_exogenous int")


# Equations over a prefix of column names; a variable that is missing counts as 0.
EQUATIONS = {
    "loan_demand": "-{interest_rate} * 100",
    "revenue": "if({loan_demand} <> 0 or {pricing_power} <> 0 or {real_revenue} <> 0, {loan_demand} + {pricing_power} + {real_revenue}, {revenue})",
    "gross_profit": "{revenue} - {input_costs}",
    "depreciation": "{capex} * 0.2D",
    "operating_income": "{gross_profit} - {depreciation} - {sga_expense}",
    "ebit": "{operating_income}",
    "interest_expense": "{debt} * {interest_rate}",
    "net_income": "({ebit} - {interest_expense}) * (1 - {tax_rate})",
    "eps": "{net_income} / greatest({share_count}, 1e-10D)",
    "roe": "{net_income} / greatest(abs({equity}), 1e-10D)",
    "roa": "{net_income} / greatest(abs({total_assets}), 1e-10D)",
    "operating_margin": "{operating_income} / greatest(abs({revenue}), 1e-10D)",
}


def equation(node: str, prefix: str) -> str:
    return EQUATIONS[node].format(**{n: f"coalesce({prefix}{n}, 0D)" for n in NODES})


def observed_columns(rows: DataFrame, observed: str = "observed") -> DataFrame:
    """``rows`` with a column o_<variable> of each variable of a map column."""
    return rows.select("*", *[F.expr(f"cast({observed}['{n}'] as double)").alias(f"o_{n}") for n in NODES])


def intervened(rows: DataFrame, given: str = "o_", made: str = "d_", do_var: str = "do_var", do_val: str = "do_val", shift: str | None = None) -> DataFrame:
    """Rows with columns ``made``<variable>: values after setting do_var to do_val.

    Only variables below do_var are recomputed, in topological order, from columns ``given``<variable>; the others keep
    their value. With ``shift``, every equation is recomputed and its column shift<variable> is added (a counterfactual).
    An unknown or null do_var leaves all as given.
    """
    out = rows
    for n in order():
        same = F.col(f"{given}{n}")
        value: Column = same
        if n in EQUATIONS:
            eq = F.expr(equation(n, made).replace(f"{made}{n}", f"{given}{n}"))
            if shift:
                value = eq + F.coalesce(F.col(f"{shift}{n}"), F.lit(0.0))
            else:
                above = sorted(ANCESTORS[n])
                value = F.when(F.col(do_var).isin(above), eq).otherwise(same)
        out = out.withColumn(f"{made}{n}", F.when(F.col(do_var) == n, F.col(do_val)).otherwise(value))
    return out


def abducted(rows: DataFrame, given: str = "o_", made: str = "u_") -> DataFrame:
    """Rows with ``made``<variable>: what the observed value differs by from its equation; null where it isn't observed."""
    return rows.select("*", *[F.expr(f"if({given}{n} is null, null, {given}{n} - ({equation(n, given)}))").alias(f"{made}{n}") for n in EQUATIONS])


def counterfactual(rows: DataFrame, do_var: str = "do_var", do_val: str = "do_val") -> DataFrame:
    """Rows with c_<variable>: residuals are kept, do_var is set, and all equations are computed again."""
    return intervened(abducted(rows), "o_", "c_", do_var, do_val, shift="u_")


def sensitivity(rows: DataFrame, target: str, keys: list[str], step: float = 0.10) -> DataFrame:
    """(keys, variable, elasticity, base_value, target_base, target_moved) of every non-zero ancestor of a target raised by ``step``."""
    names = F.array(*[F.lit(a) for a in sorted(ANCESTORS[target])])
    e = rows.withColumn("variable", F.explode(names))
    value = F.expr("case variable " + " ".join(f"when '{a}' then o_{a}" for a in sorted(ANCESTORS[target])) + " end")
    e = e.withColumn("base_value", value).filter("base_value <> 0").withColumn("moved", F.col("base_value") * (1 + step))
    base = intervened(e, "o_", "b_", "variable", "base_value")
    both = intervened(base, "o_", "m_", "variable", "moved").filter(f"b_{target} <> 0")
    elastic = F.round((F.col(f"m_{target}") - F.col(f"b_{target}")) / F.col(f"b_{target}") / step, 4)
    return both.select(*keys, "variable", elastic.alias("elasticity"), "base_value", F.round(f"b_{target}", 4).alias("target_base"), F.round(f"m_{target}", 4).alias("target_moved"))


def sweep(rows: DataFrame, variable: str, outcome: str, keys: list[str], steps: int = 5) -> DataFrame:
    """(keys, delta, outcome) of an intervention from -50 to +50 percent in ``steps`` steps on a non-zero variable."""
    deltas = F.array(*[F.lit(round(-0.5 + i / max(steps - 1, 1), 6)) for i in range(steps)])
    e = rows.filter(f"o_{variable} <> 0").withColumn("delta", F.explode(deltas)).withColumn("v", F.lit(variable)).withColumn("x", F.expr(f"o_{variable} * (1 + delta)"))
    return intervened(e, "o_", "d_", "v", "x").select(*keys, "delta", F.round(f"d_{outcome}", 6).alias("outcome"))


def fragile(swept: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, base_outcome, fragile): whether neighbouring outcomes of a sweep differ by more than half of the one at 0."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("delta")
    jumps = swept.withColumn("jump", F.abs(F.col("outcome") - F.lag("outcome").over(w)))
    g = jumps.groupBy(*keys).agg(F.max(F.expr("if(delta = 0, outcome, null)")).alias("base_outcome"), F.max("jump").alias("jump"))
    return g.select(*keys, "base_outcome", F.expr("base_outcome <> 0 and coalesce(jump, 0) > 0.5 * abs(base_outcome)").alias("fragile"))


def necessity(rows: DataFrame, treatment: str, outcome: str, keys: list[str]) -> DataFrame:
    """(keys, necessity): by how much of itself the outcome changes without the treatment, at most 1; 0 where the treatment is 0."""
    e = rows.filter(f"o_{outcome} is not null").withColumn("do_var", F.lit(treatment)).withColumn("do_val", F.lit(0.0))
    c = counterfactual(e)
    score = f"case when coalesce(o_{treatment}, 0D) = 0 then 0D when o_{outcome} = 0 then if(c_{outcome} = 0, 1D, 0D) else least(1D, abs(o_{outcome} - c_{outcome}) / abs(o_{outcome})) end"
    return c.select(*keys, F.round(F.expr(score), 6).alias("necessity"))


def sufficiency(rows: DataFrame, treatment: str, outcome: str, keys: list[str]) -> DataFrame:
    """(keys, sufficiency): how near the treatment brings the outcome to its value from a model in which it was 0, in topological order."""
    e = rows.filter(f"o_{outcome} is not null").withColumn("do_var", F.lit(treatment)).withColumn("do_val", F.lit(0.0))
    base = intervened(e, "o_", "z_", "do_var", "do_val")
    moved = base.select(*keys, F.col(f"o_{outcome}").alias("target"), F.col(f"o_{treatment}").alias("treated"), *[F.col(f"z_{n}").alias(f"o_{n}") for n in NODES])
    c = counterfactual(moved.withColumn("do_var", F.lit(treatment)).withColumn("do_val", F.coalesce("treated", F.lit(0.0))))
    gap = f"abs(target - o_{outcome})"
    score = f"case when target = 0 then if(c_{outcome} = o_{outcome}, 1D, 0D) when {gap} = 0 then 1D else 1D - least(1D, abs(target - c_{outcome}) / {gap}) end"
    return c.select(*keys, F.round(F.expr(score), 6).alias("sufficiency"))


def robustness(rows: DataFrame, treatment: str, outcome: str, keys: list[str], steps: int = 5) -> DataFrame:
    """(keys, sign_consistent, monotonic, robust) of the outcome's direction over -20 to +20 percent of the treatment."""
    deltas = F.array(*[F.lit(round(-0.2 + 0.4 * i / max(steps - 1, 1), 6)) for i in range(steps)])
    e = rows.filter(f"o_{treatment} <> 0 and o_{outcome} is not null").withColumn("delta", F.explode(deltas)).withColumn("v", F.lit(treatment)).withColumn("x", F.expr(f"o_{treatment} * (1 + delta)"))
    signs = intervened(e, "o_", "d_", "v", "x").select(*keys, "delta", F.expr(f"cast(signum(d_{outcome} - o_{outcome}) as int)").alias("sign"))
    g = signs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("delta", "sign"))).alias("s"))  # as many as there are steps
    g = g.select(*keys, F.expr("transform(s, x -> x.sign)").alias("s"))
    up = "forall(sequence(1, size(s) - 1), i -> s[i] >= s[i - 1])"
    down = "forall(sequence(1, size(s) - 1), i -> s[i] <= s[i - 1])"
    g = g.select(*keys, F.expr("size(array_distinct(s)) <= 2 and (not array_contains(s, 0) or size(array_distinct(s)) = 1)").alias("sign_consistent"), F.expr(f"{up} or {down}").alias("monotonic"))
    return g.withColumn("robust", F.expr("sign_consistent and monotonic"))


def scenario(rows: DataFrame, changes: dict[str, Column], made: str = "s_") -> DataFrame:
    """Rows with ``made``<variable> after setting several variables at once; only what lies below one of them is recomputed.

    Missing variables above are filled from their equations first, in topological order.
    """
    out = rows
    for n in order():
        filled = F.expr(equation(n, "f_").replace(f"f_{n}", f"o_{n}")) if n in EQUATIONS else F.lit(None).cast("double")
        out = out.withColumn(f"f_{n}", F.coalesce(F.col(f"o_{n}"), filled))
    below = set().union(*(DESCENDANTS[v] for v in changes))
    for n in order():
        value = changes[n] if n in changes else F.expr(equation(n, made).replace(f"{made}{n}", f"f_{n}")) if n in below and n in EQUATIONS else F.col(f"f_{n}")
        out = out.withColumn(f"{made}{n}", value)
    return out


def effects(rows: DataFrame, keys: list[str], before: str = "o_", after: str = "d_") -> DataFrame:
    """(keys, variable, baseline, counterfactual, change_pct) of the variables below do_var that were observed and not 0."""
    each = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(f"{before}{n}").alias("baseline"), F.col(f"{after}{n}").alias("counterfactual"), F.array(*[F.lit(a) for a in sorted(ANCESTORS[n])]).alias("above")) for n in NODES if ANCESTORS[n]])
    e = rows.select(*keys, "do_var", F.explode(each).alias("e")).filter("e.baseline <> 0 and array_contains(e.above, do_var)")
    pct = "round((e.counterfactual - e.baseline) / abs(e.baseline) * 100, 2)"
    return e.select(*keys, "e.variable", F.round("e.baseline", 4).alias("baseline"), F.round("e.counterfactual", 4).alias("counterfactual"), F.expr(pct).alias("change_pct"))


def explained(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, explanation): the intervention and its three largest effects in words."""
    e = effects(rows, keys)
    # at most as many effects as the model has variables
    g = e.groupBy(*keys).agg(F.sort_array(F.collect_list(F.expr("struct(-abs(change_pct) AS o, variable, change_pct)"))).alias("x"))
    told = "array_join(transform(slice(x, 1, 3), y -> format_string('%s by %.2f%%', y.variable, y.change_pct)), ', ')"
    said = rows.select(*keys, "do_var", "do_val").join(g, keys, "left")
    return said.select(*keys, F.expr(f"concat(format_string('Setting %s to %.4f ', do_var, do_val), if(x is null, 'changes nothing observed', concat('changes ', {told})))").alias("explanation"))


def contrast(rows: DataFrame, actual: str, other: str, keys: list[str], most: int = 5) -> DataFrame:
    """(keys, variable, factual, without_actual, with_other): the variables that tell two causes apart most, at most ``most`` a row.

    One cause is set to 0, the other raised by a fifth.
    """
    a = intervened(rows.withColumn("v", F.lit(actual)).withColumn("x", F.lit(0.0)), "o_", "a_", "v", "x")
    b = intervened(a.withColumn("v", F.lit(other)).withColumn("x", F.col(f"o_{other}") * 1.2), "o_", "b_", "v", "x")
    names = sorted(DESCENDANTS[actual] | DESCENDANTS[other])
    each = ", ".join(f"if(o_{n} is null, null, named_struct('d', -abs(o_{n} - coalesce(a_{n}, 0D)), 'variable', '{n}', 'factual', round(o_{n}, 4), 'without_actual', round(a_{n}, 4), 'with_other', round(b_{n}, 4)))" for n in names)
    x = b.select(*keys, F.expr(f"explode(slice(array_sort(filter(array({each}), e -> e is not null)), 1, {most}))").alias("e"))
    return x.select(*keys, "e.variable", "e.factual", "e.without_actual", "e.with_other")


def marginal(rows: DataFrame, treatment: str, outcome: str, keys: list[str], delta: float = 0.01) -> DataFrame:
    """(keys, marginal): the change of an outcome per unit of a treatment, by a finite difference of ``delta`` of its size, at least ``delta``."""
    e = rows.withColumn("v", F.lit(treatment)).withColumn("x0", F.coalesce(f"o_{treatment}", F.lit(0.0))).withColumn("step", F.expr(f"{delta}D * greatest(1D, abs(x0))")).withColumn("x1", F.expr("x0 + step"))
    both = intervened(intervened(e, "o_", "b_", "v", "x0"), "o_", "m_", "v", "x1")
    return both.select(*keys, F.round((F.coalesce(f"m_{outcome}", F.lit(0.0)) - F.coalesce(f"b_{outcome}", F.lit(0.0))) / F.col("step"), 4).alias("marginal"))


def identification_table(spark: SparkSession) -> DataFrame:
    """(treatment, outcome, backdoor, backdoor_valid, frontdoor, frontdoor_valid, separated) of every pair of variables: 702 rows."""
    rows = []
    for x in NODES:
        for y in NODES:
            if x != y:
                (b, bv), (f, fv) = backdoor(x, y), frontdoor(x, y)
                rows.append((x, y, ",".join(b), bv, ",".join(f), fv, separated(x, y, set())))
    return spark.createDataFrame(rows, "treatment string, outcome string, backdoor string, backdoor_valid boolean, frontdoor string, frontdoor_valid boolean, separated boolean")


def resolved(name: str) -> str:
    """The variable whose words overlap most with a name; the name itself if none does. Ties go to the first by name."""
    words = f"array_distinct(split(translate(lower({name}), '_', ' '), r'\\s+'))"
    nodes = ", ".join(f"'{n}'" for n in sorted(NODES))
    parts = f"split(n, '_')"
    score = f"size(array_intersect(w, {parts})) / greatest(size(array_union(w, {parts})), 1)"
    best = f"array_max(transform(array({nodes}), (n, i) -> named_struct('s', round({score}, 9), 'at', -i, 'n', n)))"
    return f"transform(array({words}), w -> transform(array({best}), b -> if(b.s > 0, b.n, {name}))[0])[0]"


# How a question states an intervention.
INTERVENTIONS = [
    (r"(?:what if|suppose|if)\s+(?:we\s+)?(?:cut|reduc\w*|lower\w*)\s+([a-z_\s]+?)\s+by\s+(\d+(?:\.\d+)?)%", "cut"),
    (r"(?:what if|suppose|if)\s+(?:we\s+)?(?:increas\w*|rais\w*|boost\w*)\s+([a-z_\s]+?)\s+by\s+(\d+(?:\.\d+)?)%", "increase"),
    (r"(?:what if|suppose|if)\s+([a-z_\s]+?)\s+(?:increas\w*|ros\w*|grew)\s+by\s+(\d+(?:\.\d+)?)%", "increase"),
    (r"(?:what if|suppose|if)\s+([a-z_\s]+?)\s+(?:declin\w*|fell|drop\w*|decreas\w*)\s+by\s+(\d+(?:\.\d+)?)%", "cut"),
    (r"(?:what if|suppose|if)\s+([a-z_\s]+?)\s+(?:were?|was|is)\s+(\d+(?:\.\d+)?)\b", "set"),
    (r"(?:what if|suppose|if)\s+([a-z_\s]+?)\s+(?:doubled)\b", "double"),
    (r"(?:what if|suppose|if)\s+([a-z_\s]+?)\s+(?:halved)\b", "halve"),
]
# Questions of each kind of counterfactual.
KINDS = [
    (r"\b(?:what if|suppose|imagine)\s+(?:we\s+)?(?:had\s+)?(?:not\s+)?(?:cut|reduc|lower)", "interventional"),
    (r"\b(?:what if|suppose|imagine)\s+(?:we\s+)?(?:increas|rais|boost|grew|expand)", "interventional"),
    (r"\b(?:what if|suppose)\s+(.+?)\s+(?:were?|was|is)\s+\d", "interventional"),
    (r"\b(?:had\s+(?:not\s+)?(?:the\s+)?|if\s+(?:the\s+)?\w+\s+had\s+not)\b", "retrospective"),
    (r"\b(?:without\s+the|in the absence of|absent)\b", "retrospective"),
    (r"\b(?:instead of|rather than|as opposed to|not\s+\w+\s+but)\b", "contrastive"),
    (r"\bwhy\s+(?:did\s+)?(.+?)\s+(?:instead|rather)\b", "contrastive"),
    (r"\b(?:necessary|needed|required|essential)\s+(?:for|to)\b", "necessity"),
    (r"\b(?:sufficient|enough|adequate)\s+(?:to|for)\b", "sufficiency"),
    (r"\b(?:would\s+(?:have\s+)?(?:still|also))\b", "necessity"),
]


def counterfactual_kind(question: str = "question") -> str:
    from tallyforge.functions.expressions import quoted

    whens = " ".join(f"when {question} rlike {quoted('(?i)' + p)} then '{k}'" for p, k in KINDS)
    return f"(case {whens} else 'interventional' end)"


def intervention(question: str = "question", observed: str = "observed") -> str:
    """struct(var, val, action) of a question's intervention on an observed variable (a map); null without one.

    The first pattern that is found decides; its variable is resolved to the model's names.
    """
    from tallyforge.functions.expressions import lets, quoted

    q = f"lower({question})"
    whens = " ".join(
        f"when {q} rlike {quoted(p)} then named_struct('raw', regexp_extract({q}, {quoted(p)}, 1), 'num', {f'try_cast(regexp_extract({q}, {quoted(p)}, 2) as double)' if a in ('cut', 'increase', 'set') else 'cast(null as double)'}, 'action', '{a}')"
        for p, a in INTERVENTIONS
    )
    value = "case m.action when 'cut' then b * (1 - m.num / 100) when 'increase' then b * (1 + m.num / 100) when 'set' then m.num when 'double' then b * 2 else b * 0.5D end"
    return lets(
        [("m", f"case {whens} end"), ("v", f"{resolved('translate(trim(m.raw), chr(32), chr(95))')}"), ("b", f"{observed}[v]")],
        f"if(m is null or b is null, null, named_struct('var', v, 'val', {value}, 'action', m.action))",
    )
