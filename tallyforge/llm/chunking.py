"""Splitting oversized items at natural boundaries by content-defined chunking.

A rolling hash over the last few units (words or code points) marks landmarks; the cut of a piece is the natural
boundary of the best kind at hand (sentence, clause, word) that lies nearest to the landmark with the least hash between
the minimum and the maximum size. As landmarks depend on nearby content only, an edit changes the pieces around it and
the cuts fall into step again after it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.arrowmap import flat_map

WORD = re.compile("[^ \t\n\xa0]+")
SENTENCE_END = re.compile("[.!?…][\"'”’)\\]]*$|[。！？][」”]*$")
CLAUSE_END = re.compile("[,;:)\\]–—，；：、]$")
WINDOW, BASE = 8, np.uint64(0x9E3779B97F4A7C15)
KINDS = ("hard", "word", "clause", "sentence")


def rolling_hash(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Polynomial hash of the last ``window`` codes before each position 0..n; its high bits are mixed."""
    h = np.zeros(len(codes) + 1, dtype=np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(1, window + 1):
            if back > len(codes):
                break
            h[back:] += codes[: len(codes) - back + 1] * power
            power *= BASE
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _levels_words(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Kind of the boundary before word i (and at the end): a word gap at least."""
    out = np.ones(len(spans) + 1, dtype=np.int8)
    for i, (a, b) in enumerate(spans):
        w = text[a:b]
        if SENTENCE_END.search(w):
            out[i + 1] = 3
        elif CLAUSE_END.search(w):
            out[i + 1] = 2
        elif i + 1 < len(spans) and "\n" in text[b : spans[i + 1][0]]:
            out[i + 1] = 3
    return out


def _levels_chars(text: str) -> np.ndarray:
    """Kind of the boundary before code point i: within a word it is a hard cut."""
    out = np.zeros(len(text) + 1, dtype=np.int8)
    for m in WORD.finditer(text):
        w, end = m[0], m.end()
        out[m.start()] = max(out[m.start()], 1)
        out[end] = 3 if SENTENCE_END.search(w) else 2 if CLAUSE_END.search(w) else 1
    for m in re.finditer("[。！？][」”]*|\n", text):
        out[m.end()] = 3
    for m in re.finditer("[，；：、]", text):
        out[m.end()] = max(out[m.end()], 2)
    return out


def cut_points(hashes: np.ndarray, levels: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the pieces, in units."""
    n = len(hashes) - 1
    overlap = max(0, min(overlap, limit - 1))
    least = max(overlap + 1, limit // 2)
    start = 0
    while n - start > limit:
        lo, hi = start + least, start + limit
        landmark = lo + int(np.argmin(hashes[lo : hi + 1]))
        window = levels[lo : hi + 1]
        best = int(window.max())
        at = np.flatnonzero(window == best) + lo
        end = int(at[np.argmin(np.abs(at - landmark))])
        yield start, end, best
        start = end - overlap
    yield start, n, 4


def pieces(text: str | None, limit: int | None, overlap: int | None, unit: str | None) -> list[tuple[int, int, int, int, str, str]]:
    """(piece_idx, start_char, end_char, units, kind, piece) of one item; see split_oversized for the cases."""
    if text is None:
        return []
    if limit is None or limit < 1:
        return [(0, 0, len(text), -1, "end", text)]
    if unit == "chars":
        n, spans = len(text), None
    else:
        spans = [m.span() for m in WORD.finditer(text)]
        n = len(spans)
    if n <= limit:
        return [(0, 0, len(text), n, "end", text)]
    if spans is None:
        codes, levels = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), _levels_chars(text)
    else:
        codes, levels = np.array([zlib.crc32(text[a:b].encode("utf-8", "surrogatepass")) for a, b in spans], dtype=np.uint64), _levels_words(text, spans)
    out = []
    for k, (s, e, kind) in enumerate(cut_points(rolling_hash(codes), levels, limit, overlap or 0)):
        a, b = (s, e) if spans is None else (spans[s][0], spans[e - 1][1])
        out.append((k, a, b, e - s, "end" if kind == 4 else KINDS[kind], text[a:b]))
    return out


def limits(configs: DataFrame) -> DataFrame:
    """One row per source: the least config_id's sizes."""
    return configs.groupBy("source").agg(F.min_by(F.struct("chunk_size", "chunk_overlap", "size_unit"), "config_id").alias("cfg")).select("source", "cfg.*")


def paragraphs(examples: DataFrame, configs: DataFrame) -> DataFrame:
    """Non-null paragraphs with the limit of their source, or that of the row ``default``.

    The configuration joins as an equi-join, which Spark broadcasts only below its size threshold.
    """
    e = examples.select(
        "row_id",
        F.col("source").alias("src"),
        F.explode(F.array(F.struct(F.lit("pre").alias("side"), F.col("pre_text").alias("paras")), F.struct(F.lit("post").alias("side"), F.col("post_text").alias("paras")))).alias("x"),
    ).select("row_id", "src", "x.side", F.posexplode("x.paras").alias("para_idx", "text"))
    c = limits(configs)
    fallback = c.filter("source = 'default'").agg(F.first(F.struct("chunk_size", "chunk_overlap", "size_unit"))).scalar()
    own = c.filter("source <> 'default'").select(F.col("source").alias("src"), F.struct("chunk_size", "chunk_overlap", "size_unit").alias("own"))
    return (
        e.filter(F.col("text").isNotNull())
        .join(own, "src", "left")
        .withColumn("cfg", F.coalesce("own", fallback))
        .select("row_id", "side", "para_idx", "text", F.col("cfg.chunk_size").alias("chunk_size"), F.col("cfg.chunk_overlap").alias("chunk_overlap"), F.col("cfg.size_unit").alias("size_unit"))
    )


def split_oversized(items: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of every item of (``keys``, text, chunk_size, chunk_overlap, size_unit) larger than its limit.

    A row per piece: keys, piece_idx INT from 0, start_char, end_char (code points of the item), units, boundary
    (sentence, clause, word, hard, or end for the last piece), piece. No piece is longer than chunk_size; each but the
    first begins chunk_overlap units before the end of the one before; every unit of the item is in some piece.
    size_unit ``chars`` counts code points, anything else words. Null items, items within the limit and those without a
    limit (null or below 1) give no rows; an overlap that isn't below the limit counts as the limit less 1.
    Equal items give equal pieces. Items are cut where they lie, without a shuffle; those too short to hold more than
    the limit never reach Python.
    """
    at_least = F.when(F.col("size_unit") == "chars", F.col("chunk_size")).otherwise(2 * F.col("chunk_size"))
    long = items.filter((F.col("chunk_size") >= 1) & (F.length("text") > at_least))

    def make() -> Callable[..., Iterator[tuple]]:
        def each(*v: object) -> Iterator[tuple]:
            *key, text, limit, overlap, unit = v
            got = pieces(text, limit, overlap, unit)
            if len(got) > 1:
                for p in got:
                    yield (*key, *p)

        return each

    kinds = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)
    return flat_map(long, [*keys, "text", "chunk_size", "chunk_overlap", "size_unit"], make, f"{kinds}, piece_idx int, start_char int, end_char int, units int, boundary string, piece string", 512)
