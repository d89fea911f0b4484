"""Encoding of a corpus with a public byte-level BPE vocabulary.

Within a pre-token, a segment tree over adjacent pairs holds each pair's rank; its root is the leftmost pair of lowest
rank. A merge changes three leaves, so a pre-token of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.arrowmap import flat_map

# Fixed value of the public vocabulary: its pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = 1 << 62
CACHE_ENTRIES = 200_000


TOKENIZERS = "/opt/tokenizers"  #: where vocabularies lie unless a folder is given


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> str:
    """Place of a public vocabulary file in ``folder``; an error if it isn't there."""
    path = Path(folder, name)
    if not path.is_file():
        raise FileNotFoundError(f"no vocabulary {path}: give the folder of public tokenizers")
    return str(path)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PairTree:
    """Minimum segment tree over the pairs (i, next of i) of one pre-token; a leaf is rank * n + i, or NO_PAIR."""

    def __init__(self, leaves: list[int]) -> None:
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.tree = [NO_PAIR] * self.size + leaves + [NO_PAIR] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if a < b else b

    def set(self, i: int, value: int) -> None:
        tree = self.tree
        i += self.size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, the leftmost of equals, is merged until none is left."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    start, end = list(range(n)), list(range(1, n + 1))  # bytes of the symbol that begins at i
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(i: int) -> int:
        j = after[i]
        r = ranks.get(piece[start[i] : end[j]]) if j < n else None
        return NO_PAIR if r is None else r * n + i

    tree = PairTree([leaf(i) for i in range(n)])
    while (least := tree.tree[1]) != NO_PAIR:
        i = least % n
        j = after[i]
        end[i] = end[j]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        tree.set(j, NO_PAIR)
        tree.set(i, leaf(i))
        if before[i] >= 0:
            tree.set(before[i], leaf(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[start[i] : end[i]]])
        i = after[i]
    return out


class Encoder:
    """Encoder of one task; a bounded cache keeps the ids of pre-tokens seen before."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.cache = ranks, {}
        self.split = regex.compile(PATTERN).findall

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache, ranks = self.cache, self.ranks
        for word in self.split(text):
            ids = cache.get(word)
            if ids is None:
                piece = word.encode("utf-8", "replace")
                whole = ranks.get(piece)
                ids = [whole] if whole is not None else merge(piece, ranks)
                if len(word) <= 64:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out


def _encoder(df: DataFrame, vocabulary: str | None) -> Callable[[], Encoder]:
    """The vocabulary file (about 1 MB, of fixed size) goes to the executors once as bytes."""
    data = df.sparkSession.sparkContext.broadcast(Path(vocabulary or vocabulary_path()).read_bytes())
    return lambda: Encoder(read_ranks(data.value))


def encode_corpus(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every row of ``docs``; empty and null texts have an empty list.

    Special tokens are never made; their strings are ordinary text. Repeated rows stay repeated, other columns don't
    matter. One pass where the documents lie, without a shuffle.
    """
    new = _encoder(docs, vocabulary)

    def make() -> Callable[..., Iterator[tuple]]:
        encode = new().encode

        def each(doc: int, text: str | None) -> Iterator[tuple]:
            yield doc, encode(text)

        return each

    return flat_map(docs, ["doc_id", "text"], make, "doc_id bigint, ids array<int>", 512)


def token_counts(docs: DataFrame, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """``keep`` and n_tokens INT of every row; 0 for null and empty texts."""
    new = _encoder(docs, vocabulary)

    def make() -> Callable[..., Iterator[tuple]]:
        encode = new().encode

        def each(*v: object) -> Iterator[tuple]:
            yield *v[:-1], len(encode(v[-1]))  # type: ignore[arg-type]

        return each

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return flat_map(docs, [*keep, "text"], make, f"{kinds}, n_tokens int")


def token_summary(encoded: DataFrame) -> DataFrame:
    """Documents, tokens and empty documents of an encoded corpus."""
    return encoded.agg(F.count("*").alias("docs"), F.sum(F.size("ids").cast("bigint")).alias("tokens"), F.sum(F.when(F.size("ids") == 0, 1).otherwise(0)).alias("empty_docs"))
