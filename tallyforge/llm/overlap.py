"""Same or near-same records across splits: an edit-distance segment join on canonical word strings.

Agreement counts words with multiplicity and no order, so every field is put in canonical order first. On two canonical
strings of n and m words the insert/delete distance is n + m less twice the number of common words; agreement of 0.75 is
therefore a distance of at most a quarter of n + m, and banded dynamic programming decides it.

Candidates come from segments of a whole field: the table, or the text where a page's table has no words. Its words, each
repetition for itself, are ordered by how many pairs of pages they would link, fewest first, over the whole corpus, and the
string is cut into as many segments as words can be missing and one more: the first words are a segment each, all the
frequent ones behind them make up the last, which is matched by its first word. At least one segment then stands unchanged
in an agreeing string, and the first one that does so stands at an allowed position: where p and q words are before it,
p + q + |(n - p) - (m - q)| is at most the distance. No pair is lost whatever the pages hold. A fingerprint of 128 bits
that never overstates the distance leaves out most pairs where they are joined.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.arrowmap import flat_map
from tallyforge.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
HOT = 20_000_000  #: pairs of pages that one word links in one piece of the join; words that link more are salted
COPIES = 10_000  #: rows of a class that one task writes out against another class; larger classes are salted
BLOCK = 16  #: words of a piece that the dynamic program aligns at a time
GROUPS = 32  #: word groups of a field's outline


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower().replace(",", "")) if text else []


def field_words(value: Any) -> list[str]:
    """Words of a text, a list of texts or a table; nulls have none."""
    if value is None:
        return []
    if isinstance(value, str):
        return words(value)
    return words("\n".join("\n".join(c for c in x if c) if isinstance(x, list) else x for x in value if x))


def elements(counts: Counter, tag: str) -> list[int]:
    """Numbers of the words of a field, each repetition for itself: fields share as many numbers as words with multiplicity."""
    return [_signed(xxhash.xxh64_intdigest(f"{tag}{i}:{w}".encode("utf-8", "surrogatepass"))) for w, n in counts.items() for i in range(n)]


def fingerprint(counts: Counter) -> tuple[int, int]:
    """Which of 64 word groups hold a word, and which hold two: differing bits are never more than the distance of the fields."""
    once = twice = 0
    for w, n in counts.items():
        bit = 1 << zlib.crc32(w.encode("utf-8", "surrogatepass")) % 64
        twice |= bit if n > 1 or once & bit else 0
        once |= bit
    return _signed(once), _signed(twice)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def outline(counts: Counter) -> list[int]:
    """Words per group; the distance of two outlines is never above that of the fields."""
    out = [0] * GROUPS
    for w, n in counts.items():
        out[zlib.crc32(w.encode("utf-8", "surrogatepass")) % GROUPS] += n
    return [x if x < 127 else 127 for x in out]


def banded_distance(a: list[str], b: list[str], k: int) -> int | None:
    """Insert/delete distance of two sequences if at most k, else None: furthest-reaching points within a band of k diagonals."""
    n, m = len(a), len(b)
    gap = n - m
    if abs(gap) > k:
        return None
    x = 0
    while x < n and x < m and a[x] == b[x]:
        x += 1
    if x == n == m:
        return 0
    middle = k + 1
    reach = [-1] * (2 * k + 3)
    reach[middle] = x
    for d in range(1, k + 1):
        # a diagonal that can't get back to that of the end within what is left of k is out of the band
        for diagonal in range(max(-d, gap - k + d, -m), min(d, gap + k - d, n) + 1):
            if (diagonal - d) & 1:
                continue
            at = middle + diagonal
            x, y = reach[at - 1] + 1, reach[at + 1]
            if x < y:
                x = y
            y = x - diagonal
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            reach[at] = x
            if diagonal == gap and x >= n:
                return d
    return None


def distance(a: list[str], b: list[str], k: int) -> int | None:
    """Insert/delete distance of two sorted sequences if at most k, else None.

    Sorted strings are cut at the same words, which lie in the same piece of both, so the distances of the pieces add up
    and the time grows with the length and not with its square.
    """
    cuts = sorted({*a[BLOCK::BLOCK], *b[BLOCK::BLOCK]}) if len(a) + len(b) > 2 * BLOCK else []
    i = j = total = 0
    for w in [*cuts, None]:
        x, y = (len(a), len(b)) if w is None else (bisect_left(a, w, i), bisect_left(b, w, j))
        d = banded_distance(a[i:x], b[j:y], min(k - total, x - i + y - j))
        if d is None:
            return None
        i, j, total = x, y, total + d
    return total


def agree(a: list[str], b: list[str], least: float = 0.75) -> bool:
    """Whether two canonical (sorted) sequences agree to ``least``; two empty ones agree fully."""
    return distance(a, b, int((1 - least) * (len(a) + len(b)) + 1e-9)) is not None


def outlines(examples: DataFrame) -> DataFrame:
    """One row per example of a split: its page's digest, sizes, outlines, fingerprint and elements, and its question's canonical words."""

    def make() -> Callable[..., Iterator[tuple]]:
        def each(row: int, split: str, question: str | None, table: Any, pre: Any) -> Iterator[tuple]:
            t, p = field_words(table), field_words(pre)
            t.sort()
            p.sort()
            digest = hashlib.blake2b("\n".join((" ".join(t), " ".join(p))).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            ct, cp = Counter(t), Counter(p)
            c, tag = (ct, "t") if t else (cp, "p")
            yield row, split == "train", digest, len(t), len(p), outline(ct), outline(cp), *fingerprint(c), elements(c, tag), " ".join(sorted(words(question)))

        return each

    known = examples.filter(F.col("split").isin("train", "dev", "test"))
    return flat_map(
        known,
        ["row_id", "split", "question", "table_cells", "pre_text"],
        make,
        "row_id bigint, train boolean, page binary, nt int, np int, ot array<tinyint>, op array<tinyint>, once bigint, twice bigint, tokens array<bigint>, q string",
    )


def _segments(n: str, least: float) -> str:
    """Segments of a string of n words: one more than words of it that can be missing in any string that agrees with it."""
    return f"(cast({(2 - 2 * least) / (2 - least)} * {n} + 1e-9 as int) + 1)"


def _allowed(p: str, n: str, q: str, m: str, least: float) -> str:
    """Whether the first segment common to strings of n and m words may stand behind p and q words."""
    return f"{p} + {q} + abs(({n} - {p}) - ({m} - {q})) <= {1 - least} * ({n} + {m}) + 1e-9"


def _candidates(pages: DataFrame, least: float, hot: int) -> DataFrame:
    """(pid_e, pid_t) of an evaluation and a training page whose tables (texts where tables are empty) may agree."""
    # a page's number and its two flags travel as one integer: postings are the bulk of what is shuffled
    postings = pages.select((F.col("pid") * 4 + F.col("train").cast("int") * 2 + F.col("eval").cast("int")).alias("pf"), F.explode("tokens").alias("token"))
    df = postings.groupBy("token").agg(F.sum(F.expr("pf & 1")).alias("e"), F.sum(F.expr("shiftright(pf & 2, 1)")).alias("t"))
    # words of one side come first in the order: they need not be gathered, only counted
    ranked = postings.join(df.selectExpr("token", "e * t AS links").filter("links > 0"), "token")
    # a group is the words of one page's field
    shared = ranked.groupBy("pf").agg(F.sort_array(F.collect_list(F.struct("links", "token"))).alias("words"))
    sizes = pages.select("pid", F.expr("if(nt > 0, nt, np)").alias("n"), "nt", "np", "once", "twice")
    shared = shared.withColumn("pid", F.expr("shiftright(pf, 2)")).join(sizes, "pid").withColumn("alone", F.expr("n - size(words)"))
    shared = shared.withColumn("heads", F.expr(f"slice(words, 1, greatest(0, {_segments('n', least)} - alone))"))

    def side(flag: int, name: str, salt: str) -> DataFrame:
        rows = shared.filter(F.expr(f"(pf & {flag}) > 0")).select("pid", "n", "nt", "np", "once", "twice", "alone", F.posexplode("heads").alias("at", "w"))
        rows = rows.select("w.token", F.expr("cast(alone + at as int)").alias("p"), "pid", "n", "nt", "np", "once", "twice", F.expr(f"1 + w.links div {hot}").alias("pieces"))
        return rows.withColumn("salt", F.expr(salt)).drop("pieces").select("token", "salt", *[F.col(c).alias(f"{c}_{name}") for c in ("p", "pid", "n", "nt", "np", "once", "twice")])

    e, t = side(1, "e", "pmod(hash(pid), pieces)"), side(2, "t", "explode(sequence(0L, pieces - 1))")
    most = 1 - least
    may = (
        f"pid_e <> pid_t and {_allowed('p_e', 'n_e', 'p_t', 'n_t', least)}"
        f" and bit_count(once_e ^ once_t) + bit_count(twice_e ^ twice_t) <= {most} * (n_e + n_t)"
        f" and abs(nt_e - nt_t) <= {most} * (nt_e + nt_t) and abs(np_e - np_t) <= {most} * (np_e + np_t)"
    )
    return e.join(t, ["token", "salt"]).filter(may).select("pid_e", "pid_t").distinct()


def _distance(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> abs(cast(x as int) - cast(y as int))), 0, (s, x) -> s + x)"


def page_pairs(pages: DataFrame, texts: DataFrame, least: float = 0.75, hot: int = HOT) -> DataFrame:
    """(pid_e, pid_t) of different pages that agree in table and text; a page's number is its least row_id."""
    found = _candidates(pages, least, hot)
    outline_e = pages.filter("eval").select(F.col("pid").alias("pid_e"), F.struct("nt", "np", "ot", "op").alias("e"))
    outline_t = pages.filter("train").select(F.col("pid").alias("pid_t"), F.struct("nt", "np", "ot", "op").alias("t"))
    near = (
        found.join(outline_e, "pid_e")
        .join(outline_t, "pid_t")
        .filter(F.expr(f"abs(e.nt - t.nt) <= {1 - least} * (e.nt + t.nt) and abs(e.np - t.np) <= {1 - least} * (e.np + t.np)"))
        .filter(F.expr(f"{_distance('e.ot', 't.ot')} <= {1 - least} * (e.nt + t.nt) and {_distance('e.op', 't.op')} <= {1 - least} * (e.np + t.np)"))
        .select("pid_e", "pid_t")
    )
    near = cut_lineage(near)
    wanted = near.select(F.col("pid_e").alias("row_id")).union(near.select("pid_t")).distinct()
    read = cut_lineage(texts.select("row_id", "table_cells", "pre_text").join(wanted, "row_id"))
    pairs = near.join(read.select(F.col("row_id").alias("pid_e"), F.col("table_cells").alias("t_e"), F.col("pre_text").alias("p_e")), "pid_e").join(
        read.select(F.col("row_id").alias("pid_t"), F.col("table_cells").alias("t_t"), F.col("pre_text").alias("p_t")), "pid_t"
    )

    def make() -> Callable[..., Iterator[tuple]]:
        def each(pid_e: int, pid_t: int, t_e: Any, t_t: Any, p_e: Any, p_t: Any) -> Iterator[tuple]:
            if agree(sorted(field_words(t_e)), sorted(field_words(t_t)), least) and agree(sorted(field_words(p_e)), sorted(field_words(p_t)), least):
                yield pid_e, pid_t

        return each

    return flat_map(pairs, ["pid_e", "pid_t", "t_e", "t_t", "p_e", "p_t"], make, "pid_e bigint, pid_t bigint")


def overlap_classes(examples: DataFrame, least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (cid_e, cid_t) of an evaluation and a training class that agree to ``least``, and members (cid, row_id).

    A class holds the rows of one side with the same words in question, table and text; its number is its least row_id.
    Agreement is asked of question, table_cells and pre_text each; fields that are null or without words agree fully
    with each other and not at all with others. Rows without one of the three splits take no part. row_id must be unique.
    Exact copies and repeated pages are compared once. No agreeing pair is left out, however many pages hold its words and
    wherever they differ, and every pair returned has been verified.
    """
    rows = cut_lineage(outlines(examples))
    pages = cut_lineage(
        rows.groupBy("page").agg(
            F.min("row_id").alias("pid"),
            F.max("train").alias("train"),
            F.max(~F.col("train")).alias("eval"),
            *[F.first(c).alias(c) for c in ("nt", "np", "ot", "op", "once", "twice", "tokens")],
        )
    )
    other = page_pairs(pages, examples, least)
    same = pages.filter("train and eval").select(F.col("pid").alias("pid_e"), F.col("pid").alias("pid_t"))
    linked = cut_lineage(same.unionByName(other))
    concerned = linked.select(F.col("pid_e").alias("pid")).union(linked.select("pid_t")).distinct().join(pages.select("pid", "page"), "pid")
    asked = cut_lineage(rows.select("row_id", "train", "page", "q").join(concerned, "page").select("row_id", "train", "pid", "q"))
    classes = asked.groupBy("pid", "train", "q").agg(F.min("row_id").alias("cid"))
    # the questions of two pages are joined by their segments in the same way
    keyed = classes.select("pid", "train", "cid", "q", F.expr("size(filter(split(q, ' '), x -> x <> ''))").alias("n"), F.posexplode(question_segments("q", least)).alias("p", "key"))
    e = keyed.filter("not train").select(*[F.col(c).alias(f"{c}_e") for c in ("pid", "cid", "q", "n", "p")], "key").join(linked, "pid_e")
    t = keyed.filter("train").select(*[F.col(c).alias(f"{c}_t") for c in ("pid", "cid", "q", "n", "p")], "key")
    matched = e.join(t, ["pid_t", "key"]).filter(_allowed("p_e", "n_e", "p_t", "n_t", least)).select("cid_e", "cid_t", "q_e", "q_t").distinct()

    def make() -> Callable[..., Iterator[tuple]]:
        def each(cid_e: int, cid_t: int, q_e: str, q_t: str) -> Iterator[tuple]:
            if agree(q_e.split(), q_t.split(), least):
                yield cid_e, cid_t

        return each

    similar = flat_map(matched, ["cid_e", "cid_t", "q_e", "q_t"], make, "cid_e bigint, cid_t bigint")
    return cut_lineage(similar), asked.join(classes, ["pid", "train", "q"]).select("cid", "row_id")


def cross_split_overlaps(examples: DataFrame, least: float = 0.75, copies: int = COPIES) -> DataFrame:
    """(row_id_a, row_id_b) of every pair of a dev or test row and a train row that agree to ``least``, smaller first.

    The classes of ``overlap_classes`` written out by rows; classes of more than ``copies`` rows are salted on both sides.
    """
    similar, members = overlap_classes(examples, least)
    pieces = members.groupBy("cid").agg((F.lit(1) + F.expr(f"count(*) div {copies}")).alias("pieces"))
    salted = members.join(pieces, "cid").select("cid", "row_id", F.expr("pmod(hash(row_id), pieces)").alias("salt"))
    out = similar
    for side in ("e", "t"):
        out = out.join(pieces.select(F.col("cid").alias(f"cid_{side}"), F.explode(F.expr("sequence(0L, pieces - 1)")).alias(f"salt_{side}")), f"cid_{side}")
    for side in ("e", "t"):
        out = out.join(salted.select(F.col("cid").alias(f"cid_{side}"), F.col("salt").alias(f"salt_{side}"), F.col("row_id").alias(side)), [f"cid_{side}", f"salt_{side}"])
    return out.select(F.least("e", "t").alias("row_id_a"), F.greatest("e", "t").alias("row_id_b"))


def question_segments(q: str, least: float = 0.75) -> Any:
    """First words of the segments of a canonical question, in the order long words first; one without words has a blank."""
    parts = f"filter(split({q}, ' '), x -> x <> '')"
    order = f"array_sort(transform({parts}, x -> struct(-length(x) as l, x as w)))"
    heads = f"transform(slice({order}, 1, {_segments(f'size({parts})', least)}), x -> x.w)"
    return F.expr(f"case when size({parts}) = 0 then array(' ') else {heads} end")


def overlap_counts(examples: DataFrame, least: float = 0.75) -> DataFrame:
    """(split, source, rows, overlapping, pairs): how many rows of each evaluation split and source overlap with train.

    Counted by classes; the pairs of rows aren't written out.
    """
    similar, members = overlap_classes(examples, least)
    sizes = members.groupBy(F.col("cid").alias("cid_t")).agg(F.count("*").alias("rows_t"))
    links = similar.join(sizes, "cid_t").groupBy(F.col("cid_e").alias("cid")).agg(F.sum("rows_t").alias("links"))
    of_row = members.join(links, "cid").select("row_id", "links")
    e = examples.filter(F.col("split").isin("dev", "test")).select("row_id", "split", "source")
    return e.join(of_row, "row_id", "left").groupBy("split", "source").agg(F.count("*").alias("rows"), F.count("links").alias("overlapping"), F.coalesce(F.sum("links"), F.lit(0)).alias("pairs"))
