"""Texts cut off by field limits: a structural completeness check against the baseline of each source.

A stack automaton runs over every whole text and leaves what is still open at its end: brackets, quotes, markup. The last
line adds broken characters or escapes, an unfinished table row, or a sentence without a terminator. What a source does as
a rule is no cut: a last line without a terminator whose like closes or heads texts of its source that differ in more than
names and numbers (closing lines, headings), and symbols that the source leaves open in many texts. Both are counted over
the whole corpus, from one reading of the texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.arrowmap import flat_map
from tallyforge.session import cut_lineage

MARKUP = re.compile(r"<(?:br|p|/p|b|/b|i|/i|div|/div|span|/span|li|/li|hr)\s*/?>", re.I)
INVISIBLE = re.compile("[​‌﻿­⁠\x00-\x08\x0b\x0c\x0e-\x1f]")
BROKEN_TAIL = re.compile(r"(?:�+|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#?\w{0,6})?|<[/\w]{0,10})$")
MARKER = re.compile(r"\s*(?:…|\.{2,}|[\[(](?:…|\.{3})[\])]|-->?|>>)$")
TERMINATOR = re.compile("[.!?。！？؟][\"'”’»)\\]」』]*$")
ADDRESS = re.compile(r"@|://|www\.|\.example\b")
LETTER = re.compile(r"[^\W\d_]")
PAIRS = dict(zip(")]}”»」』）", "([{“«「『（"))
SYMBOL = re.compile(r"""\\.|[()\[\]{}"“”«»「」『』（）]|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]{0,400}(/?)>""", re.S)
# HTML elements that must be closed.
CLOSED_TAGS = frozenset("a abbr b blockquote body code div em font h1 h2 h3 h4 h5 h6 html i ol pre s section small span strong sub sup table u ul".split())
END = 80  #: characters of a line's end that patterns look at; likes longer than that are told apart by a hash
USUAL = 0.05  #: share of a source's texts with a symbol left open from which that is its manner
UNIT = re.compile("[⺀-￿]|[^\\W\\d_⺀-￿]+|\\d+")
SKETCH = 16  #: places of a text's sketch
ALIKE = 0.4  #: texts that agree in so many places of their sketches are one text with other names
CLASSES = 32  #: of the texts with a line; two sketches of each are kept


def repaired(line: str) -> str:
    """The line with UTF-8 that was read as Windows-1252 put right, where that is possible."""
    if not re.search("[ÃÂâãåæçèé][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]", line):
        return line
    try:
        raw = b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in line)
        return raw.decode("utf-8")
    except (UnicodeError, ValueError):
        return line


def lines_of(text: str) -> list[str]:
    """Its lines without white space, markup and invisible characters; those left empty are gone."""
    out = []
    for line in re.split("\r\n|\n|\r| | ", MARKUP.sub("\n", text) if "<" in text else text):
        line = INVISIBLE.sub("", line.replace("\xa0", " ")).strip()
        if line:
            out.append(line)
    return out


def likeness(line: str) -> str:
    """What a closing line or heading has in common with its like: addresses and numbers are alike."""
    like = re.sub(r"\S+", lambda m: "<address>" if ADDRESS.search(m[0]) else m[0], repaired(line))
    like = re.sub(r"\d+", "9", like)
    return like if len(like) <= END else f"{like[:16]}…{xxhash.xxh64_hexdigest(like.encode('utf-8', 'surrogatepass'))}"


def still_open(text: str) -> list[str]:
    """Brackets, quotes and tags that the stack still holds at the end of a text, the outermost first.

    A closing symbol takes with it what was opened within its pair; one without its partner means nothing, as in ``1)``.
    A straight quote opens where none is open, unless it follows a digit (inches), and an escaped one is plain text.
    """
    stack: list[str] = []
    for m in SYMBOL.finditer(text):
        c = m[0]
        if c[0] == "\\":
            continue
        if c[0] == "<":
            name = m[2].lower()
            if name not in CLOSED_TAGS or m[3]:
                continue
            partner, opens = f"<{name}>", not m[1]
        elif c == '"':
            partner, opens = c, c not in stack
            if opens and m.start() and text[m.start() - 1].isdigit():
                continue
        else:
            partner, opens = PAIRS.get(c, c), c not in PAIRS
        if opens:
            stack.append(partner)
        elif partner in stack:
            while stack.pop() != partner:
                pass
    return stack


def _row_state(lines: list[str], at: int) -> str:
    """Whether the table row at ``at`` is finished: as many cells as the first row of its table."""
    first = at
    while first and lines[first - 1].startswith("|"):
        first -= 1
    line = lines[at]
    whole = line.endswith("|") and (len(line) > 1 or first == at)
    return "complete" if whole and line.count("|") >= lines[first].count("|") else "row"


def line_state(lines: list[str], at: int) -> str:
    """complete, open (no terminator), row, broken (characters or escapes) or marked (an ellipsis)."""
    line = repaired(lines[at])
    end = line[-END:]  # what tells of the end stands there; patterns don't run over long lines
    if BROKEN_TAIL.search(end) and not re.search(r"&\w+;$", end):
        return "broken"
    if line.startswith("|"):
        return _row_state(lines, at)
    if not LETTER.search(line) and not line[-1].isdigit():
        return "complete"
    if MARKER.search(end) and LETTER.search(line[: -len(end)] + MARKER.sub("", end)):
        return "marked"
    if TERMINATOR.search(end):
        return "complete"
    if line[0] == "{" and line[-1] == "}" or line[0] in "([" and line[-1] in ")]" and not still_open(line):
        return "complete"
    return "open"


def _sentence_like(line: str) -> bool:
    return len(line.split()) > 5 or any(ord(c) > 0x2E80 for c in line) and len(line) > 12


def tail(lines: list[str]) -> list[tuple[int, str, str]]:
    """(depth, state, likeness) of the last lines of a text, back to the first complete one; [] if it has none."""
    out = []
    for depth in range(len(lines)):
        at = len(lines) - 1 - depth
        state = line_state(lines, at)
        if depth and state == "open" and not _sentence_like(lines[at]):
            break  # a heading, name or label over lines that are known to close texts
        out.append((depth, state, likeness(lines[at]) if state == "open" else ""))
        if state != "open":
            break
    return out


def sketch(text: str) -> list[int]:
    """The least hash of its triples of words (numbers are alike, CJK goes by character) in each of SKETCH classes, -1 for none.

    The share of equal places estimates the share of common triples, so texts of one template have like sketches.
    """
    units = ["9" if u[0].isdecimal() else u for u in UNIT.findall(text.lower())]
    out = [-1] * SKETCH
    for triple in set(zip(units, units[1:], units[2:])) if len(units) > 2 else {tuple(units)}:
        h = zlib.crc32(" ".join(triple).encode("utf-8", "surrogatepass"))
        at, h = h % SKETCH, h // SKETCH
        if out[at] < 0 or h < out[at]:
            out[at] = h
    return out


def kinds(sketches: list[list[int]], most: int) -> int:
    """How many of the texts differ from each other in more than names and numbers, counted up to ``most``."""
    taken: list[list[int]] = []
    for x in sketches:
        if len(taken) >= most:
            break
        if all(sum(p == q >= 0 for p, q in zip(x, y)) < ALIKE * sum(p >= 0 or q >= 0 for p, q in zip(x, y)) for y in taken):
            taken.append(x)
    return len(taken)


def standing(lines: list[str]) -> dict[str, bool]:
    """Likeness of the lines without a terminator, and whether the text shows the line to stand by itself.

    It does if it follows a finished line, or labels over one, or heads the text, and the next line doesn't go on in lower
    case. A line that goes on anywhere in the text, as hard-wrapped lines do, doesn't stand by itself.
    """
    out: dict[str, bool] = {}
    wrapped: set[str] = set()
    after = False  # whether a finished line came, and nothing but labels since
    for i, line in enumerate(lines):
        state = line_state(lines, i)
        if state == "open":
            if not line.startswith("|"):
                goes_on = i + 1 < len(lines) and lines[i + 1][0].islower() and _sentence_like(lines[i + 1])
                stands = not goes_on and (after or i == 0 and len(lines) > 1)
                like = likeness(line)
                if goes_on:
                    wrapped.add(like)
                out[like] = stands or out.get(like, False)
            after = after and not _sentence_like(line)
        else:
            after = state == "complete"
    return {like: stands and like not in wrapped for like, stands in out.items()}


def read_texts(docs: DataFrame) -> DataFrame:
    """One row per non-null text: (doc_id, source, key, blank, open, tail, lines, sketch), the one reading of the texts.

    key is a hash of the text, open what its stack still holds, tail its last lines if the last isn't complete, lines its
    lines without a terminator with whether they stand by themselves, sketch that of the text if it has such lines.
    """

    def make() -> Callable[..., Iterator[tuple]]:
        def each(doc: int, source: str | None, key: int, text: str) -> Iterator[tuple]:
            lines = lines_of(text)
            last, alone = tail(lines), list(standing(lines).items())
            if last and last[0][1] == "complete":
                last = []
            yield doc, source, key, not lines, sorted(set(still_open(text))), last, alone, sketch(text) if alone else []

        return each

    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "source", F.xxhash64("text").alias("key"), "text")
    return flat_map(
        texts,
        ["doc_id", "source", "key", "text"],
        make,
        "doc_id bigint, source string, key bigint, blank boolean, open array<string>, tail array<struct<depth: int, state: string, like: string>>,"
        " lines array<struct<like: string, stands: boolean>>, sketch array<bigint>",
    )


def usual_symbols(texts: DataFrame, usual: float = USUAL) -> DataFrame:
    """(source, symbol) of the brackets, quotes and tags left open in at least ``usual`` of the source's texts, and in two."""
    s = texts.select(F.coalesce("source", F.lit("")).alias("source"), F.explode_outer("open").alias("symbol"))
    n = s.filter("symbol is not null").groupBy("source", "symbol").agg(F.count("*").alias("n")).filter("n > 1")
    total = texts.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("texts"))
    return n.join(total, "source").filter(F.col("n") >= usual * F.col("texts")).select("source", "symbol")


def closing_lines(texts: DataFrame, rate: float = 0.003, least: int = 2) -> DataFrame:
    """(source, like) of the lines without a terminator that stand by themselves in at least ``rate`` of the source's different texts.

    ``texts`` are those of ``read_texts``. ``least`` of these texts must differ in more than names and numbers, so that
    near copies of one cut text never make its cut a closing line, and lines that go on in more texts than they stand by
    themselves in are left out. At most about 1 / ``rate`` such lines per source and line of a text exist, however large
    the corpus.
    """

    def make_kinds() -> Callable[..., Iterator[tuple]]:
        def each(source: str, like: str, sketches: list) -> Iterator[tuple]:
            if kinds([list(x) for x in sketches], least) >= least:
                yield source, like

        return each

    by_text = texts.select(F.coalesce("source", F.lit("")).alias("source"), "key", "lines", "sketch")
    seen = by_text.select("source", "key", "sketch", F.explode("lines").alias("line")).select("source", "line.like", "key", "line.stands", "sketch")
    # texts of one template meet in few classes of their sketches: others keep their places beside them
    classes = seen.dropDuplicates(["source", "like", "key"]).groupBy("source", "like", F.expr(f"pmod(xxhash64(array_max(sketch)), {CLASSES})").alias("class")).agg(
        F.count_if("stands").alias("n"), F.count_if(~F.col("stands")).alias("others"), F.min_by("sketch", "key").alias("one"), F.max_by("sketch", "key").alias("two")
    )
    counts = classes.groupBy("source", "like").agg(F.sum("n").alias("n"), F.sum("others").alias("others"), F.sort_array(F.flatten(F.collect_list(F.array("one", "two")))).alias("sketches"))
    total = by_text.select("source", "key").distinct().groupBy("source").agg(F.count("*").alias("texts"))
    often = counts.filter((F.col("n") >= least) & (F.col("n") > F.col("others"))).join(total, "source").filter(F.col("n") >= rate * F.col("texts"))
    return flat_map(often, ["source", "like", "sketches"], make_kinds, "source string, like string")


def _cut(texts: DataFrame, rate: float, least: int) -> DataFrame:
    """(doc_id, source, reason) of the cut ones among ``texts`` of ``read_texts``."""
    known = cut_lineage(closing_lines(texts, rate, least))
    known = known.union(known.select(F.lit("").alias("source"), "like")).distinct().withColumnRenamed("source", "at").withColumn("known", F.lit(True))
    at = F.coalesce("source", F.lit("")).alias("at")
    tails = texts.select("doc_id", "source", "key", at, F.explode("tail").alias("t")).select("doc_id", "source", "key", "at", "t.*")
    judged = tails.join(known, ["at", "like"], "left")
    cut = judged.filter((F.col("state") != "complete") & F.col("known").isNull()).select("doc_id", "source", "key", "depth", "state", "like")
    # a copy under another source is closed by what closes the text in its own
    copies = judged.filter("known").select("key", "like").distinct()
    cut = cut.join(copies, ["key", "like"], "left_anti").select("doc_id", "source", "depth", "state")
    usual = usual_symbols(texts).select(F.col("source").alias("at"), "symbol")
    left = texts.select("doc_id", "source", at, F.explode("open").alias("symbol")).join(usual, ["at", "symbol"], "left_anti")
    left = left.select("doc_id", "source", F.lit(1 << 30).alias("depth"), F.lit("unclosed").alias("state"))
    return cut.unionByName(left).groupBy("doc_id", "source").agg(F.min_by("state", "depth").alias("reason"))


def truncated(docs: DataFrame, rate: float = 0.003, least: int = 2) -> DataFrame:
    """(doc_id, source, reason) of every document whose text stops inside a sentence or table row.

    reason is row, broken, marked, open, or unclosed where only the stack of brackets, quotes and markup isn't empty. Null,
    empty and blank texts are never cut, nor are texts complete up to closing lines, headings or a finished table. Repeated
    documents are each reported; a null source counts as a source of its own. The texts are read once, into a table in the
    shared folder. The lines that close or head texts are counted over all documents (``closing_lines``) and hold for
    their source, for copies of its texts under other sources, and for texts without a source; so are the symbols that a
    source leaves open as a rule (``usual_symbols``). The joins with them are equi-joins that Spark broadcasts where they
    are below its threshold.
    """
    return _cut(cut_lineage(read_texts(docs)), rate, least)


def truncation_rates(docs: DataFrame, rate: float = 0.003, least: int = 2) -> DataFrame:
    """(source, texts, cut, share): how often each source truncates, over its texts that aren't blank."""
    read = cut_lineage(read_texts(docs))
    texts = read.filter("not blank").groupBy("source").agg(F.count("*").alias("texts"))
    cut = _cut(read, rate, least).groupBy("source").agg(F.count("*").alias("cut"))
    both = texts.join(cut, texts["source"].eqNullSafe(cut["source"]), "left").select(texts["source"], "texts", F.coalesce("cut", F.lit(0)).alias("cut"))
    return both.withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
