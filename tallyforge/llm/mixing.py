"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length; the budget of each source is met by whole passes over it and one further
part, whose number of documents of each length comes from a bounded knapsack; the documents of a length are then chosen
in the order of a seeded hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import cut_lineage

#: Tokens of a budget up to which the knapsack may grow to cover them all; a larger budget is filled in proportion before.
WINDOW = 1 << 26


def _reach(parts: list[int], rest: int) -> list[int]:
    """Which of ``parts`` to take for the largest sum not above ``rest``: sums are bits, kept at every root-th part.

    The sums before a part are made again from the last kept ones when the way back is sought, so memory grows with the
    root of the number of parts.
    """
    step, mask = max(1, math.isqrt(len(parts))), (1 << (rest + 1)) - 1
    reach, kept, done = 1, [], 0
    for i, w in enumerate(parts):
        if i % step == 0:
            kept.append(reach)
        reach |= (reach << w) & mask
        done = i + 1
        if reach >> rest & 1:
            break
    at, taken = reach.bit_length() - 1, []
    for block in range(len(kept) - 1, -1, -1):
        first = block * step
        before = [kept[block]]
        for w in parts[first : min(first + step, done) - 1]:
            before.append(before[-1] | (before[-1] << w) & mask)
        for i in range(min(first + step, done) - 1, first - 1, -1):
            if not before[i - first] >> at & 1:
                taken.append(i)
                at -= parts[i]
    return taken


def _within(lengths: list[int], counts: list[int], budget: int, total: int, window: int) -> list[int]:
    """A choice whose last ``window`` tokens a bounded knapsack fits; ``window`` is at least four of the longest items."""
    base = max(0, budget - window)
    take = [c * base // total for c in counts]
    rest = budget - sum(a * b for a, b in zip(lengths, take))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest <= window:
            break
        more = min(counts[i] - take[i], (rest - window // 2) // lengths[i])
        take[i] += more
        rest -= more * lengths[i]
    parts, of = [], []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        left, power = min(counts[i] - take[i], rest // lengths[i]), 1
        while left > 0:  # counts are split into powers of two
            n = min(power, left)
            parts.append(n * lengths[i])
            of.append((i, n))
            left -= n
            power *= 2
    for at in _reach(parts, rest):
        i, n = of[at]
        take[i] += n
    return take


def fit(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many items of each length to take so that they sum to ``budget``, or come as near below it as they can.

    Lengths are positive. They are divided by their common divisor first. A bounded knapsack fits the last tokens of the
    budget, what is before them being filled in proportion; its span begins at four of the longest items and grows until
    the budget is met, or the span is the whole budget and no choice comes nearer. Only a budget of more than ``window``
    units of the common divisor that no span up to ``window`` meets may end below the best choice; what is missing shows
    in ``shares``.
    """
    if budget >= sum(a * b for a, b in zip(lengths, counts)):
        return list(counts)
    if budget <= 0:
        return [0] * len(lengths)
    divisor = math.gcd(*lengths)
    lengths, budget = [x // divisor for x in lengths], budget // divisor
    total = sum(a * b for a, b in zip(lengths, counts))
    span, best, most = max(4096, 4 * max(lengths)), None, -1
    while True:
        take = _within(lengths, counts, budget, total, span)
        got = sum(a * b for a, b in zip(lengths, take))
        if got > most:
            best, most = take, got
        if most == budget or span >= budget or 4 * span > max(window, 4096):
            break
        span *= 4
    if most < budget <= window and span < budget:
        best = _within(lengths, counts, budget, total, budget)
    return best


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, budget): the most tokens each source may give to the mix.

    The mix is as large as its scarcest source allows: the least of max_repeats * tokens / share. A source without a
    token can't take part; the others keep their shares relative to each other, so its share is reached as 0. The frames
    have a row per target source.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("tokens"))
    t = targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    b = t.join(per, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    able = b.filter("tokens > 0").agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).scalar()
    return b.withColumn("budget", F.when(F.col("tokens") > 0, F.floor(F.coalesce(able, F.lit(0.0)) * F.col("target_share") + 1e-6)).otherwise(0).cast("bigint"))


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = [int(x) for x in pdf["n_tokens"]], [int(x) for x in pdf["n"]]
    passes, rest = divmod(int(pdf["budget"].iloc[0]), int(pdf["tokens"].iloc[0]))
    return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "n": pdf["n"], "passes": passes, "take": fit(lengths, counts, rest)})


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of the documents in the mix, from ``sizes`` (doc_id, source, n_tokens).

    uses is at least 1 and at most the source's max_repeats. Documents without tokens, without a source or of a source
    without a target aren't in the mix; repeated doc_ids count as documents of their own. The same seed gives the same mix
    on any partitioning. Only counts by (source, length) reach the knapsack, a row per length; the documents of a length
    are ranked in as many hash ranges as it has ten thousands, so one length may hold most of a source.
    """
    able = sizes.filter("n_tokens > 0 and source is not null")
    counts = able.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    plan = counts.join(budgets(sizes, targets).filter("budget > 0").select("source", "tokens", "budget"), "source")
    # a row per length, used three times below: fitted once and written
    fitted = cut_lineage(plan.groupBy("source").applyInPandas(_fit_source, "source string, n_tokens int, n bigint, passes int, take bigint"))
    u = (F.xxhash64(F.lit(seed), "doc_id") / F.lit(2.0**64)) + F.lit(0.5)
    docs = (
        able.select("doc_id", "source", "n_tokens")
        .join(fitted, ["source", "n_tokens"])
        .withColumn("u", u)
        .withColumn("range", F.floor(F.col("u") * F.ceil(F.col("n") / 10000)).cast("int"))
    )
    partial = docs.filter("take > 0 and take < n")
    ranges = partial.groupBy("source", "n_tokens", "range").agg(F.count("*").alias("in_range"))
    before = Window.partitionBy("source", "n_tokens").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0))).drop("in_range")
    within = Window.partitionBy("source", "n_tokens", "range").orderBy("u", "doc_id")
    chosen = partial.withColumn("rank", F.row_number().over(within)).join(ranges, ["source", "n_tokens", "range"])
    chosen = chosen.withColumn("uses", F.col("passes") + F.when(F.col("before") + F.col("rank") <= F.col("take"), 1).otherwise(0))
    whole = docs.filter("take <= 0 or take >= n").withColumn("uses", F.col("passes") + F.when(F.col("take") > 0, 1).otherwise(0))
    columns = ["doc_id", "source", "n_tokens", "uses"]
    return chosen.select(columns).unionByName(whole.select(columns)).filter("uses > 0")


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, budget, tokens_used, missing, actual_share, docs_used, most_uses) of every target source; missing is budget less tokens_used."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("uses")).alias("tokens_used"), F.count("*").alias("docs_used"), F.max("uses").alias("most_uses"))
    out = budgets(sizes, targets).join(used, "source", "left").na.fill(0, ["tokens_used", "docs_used", "most_uses"])
    total = out.agg(F.sum("tokens_used")).scalar()
    return out.select("source", "target_share", "budget", "tokens_used", (F.col("budget") - F.col("tokens_used")).alias("missing"), F.when(total > 0, F.round(F.col("tokens_used") / total, 6)).otherwise(0.0).alias("actual_share"), "docs_used", "most_uses")
