"""Retrieval: BM25, cosine, rank fusion and context merging, over all questions at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tallyforge.functions import arrowmap  # noqa: F401  registers the package to travel by value
from tallyforge.functions import expressions as X
from tallyforge.operators import table_ops as T
from tallyforge.session import cut_lineage

K1, B = 1.5, 0.75
DENSE_WEIGHT, BM25_WEIGHT, FUSION_K, NUMBER_BOOST = 0.7, 0.3, 20, 1.3


def tokens(text: str) -> str:
    """Words of a text: lower-case runs of letters, digits and underscores."""
    return f"regexp_extract_all(lower({text}), r'[\\p{{L}}\\p{{N}}_]+', 0)"


def counted_terms(words: str) -> str:
    """Array of (term, tf) of an array of words: in sorted order a term's count is the distance to the next term's place."""
    return X.lets(
        [("srt", f"sort_array({words})"), ("dst", "array_distinct(srt)"), ("pos", "transform(dst, w -> array_position(srt, w))")],
        "transform(dst, (w, i) -> named_struct('term', w, 'tf', cast(coalesce(get(pos, i + 1), size(srt) + 1) - pos[i] as int)))",
    )


def postings(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_len, term, tf) of documents (keys, text): terms are counted within the row, before anything is shuffled."""
    staged = docs.select(*keys, F.expr(tokens("coalesce(text, '')")).alias("t"))
    return staged.select(*keys, F.size("t").alias("doc_len"), F.expr(f"explode({counted_terms('t')})").alias("p")).select(*keys, "doc_len", "p.term", "p.tf")


def query_terms(queries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, qtf) of queries (keys, text); repeated terms count again."""
    return postings(queries, keys).select(*keys, "term", F.col("tf").alias("qtf"))


def _best(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of scores (rows: queries, columns: ids) together with those found before; ties to the lower id."""
    s, i = np.hstack([best[0], scores]), np.hstack([best[1], np.broadcast_to(ids, scores.shape)])
    if s.shape[1] > 4 * k:  # those below the k-th best can't come in, and needn't be sorted
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        s = np.where(s >= least, s, -np.inf)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _emit(names: list[int], best: tuple[np.ndarray, np.ndarray], id_name: str) -> pa.Table:
    n = best[0].shape[1]
    return pa.table({"query_id": pa.array(np.repeat(names, n), pa.int64()), id_name: pa.array(best[1].ravel(), pa.int64()), "score": pa.array(best[0].ravel(), pa.float64())})


def _grid(queries: DataFrame, items: DataFrame, q_key: str, i_key: str, q_block: int, i_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells (_q, _i) of a grid of hash buckets they belong to: a row of one side meets each block of the other once.

    A cell holds about ``q_block`` queries and ``i_block`` items, so every task is of bounded size; the copies grow with
    the number of blocks of the other side, as a query set against all rows in blocks must.
    """
    nq, ni = max(1, -(-queries.count() // q_block)), max(1, -(-items.count() // i_block))
    q = queries.withColumn("_q", F.pmod(F.xxhash64(q_key), F.lit(nq)).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(ni - 1))))
    i = items.withColumn("_i", F.pmod(F.xxhash64(i_key), F.lit(ni)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    # a cell computes much for its bytes, so that the number of tasks goes by cells and not by size
    tasks = min(nq * ni, max(200, 4 * queries.sparkSession.sparkContext.defaultParallelism))
    return q.repartition(tasks, "_q", "_i"), i.repartition(tasks, "_q", "_i")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, q_block: int = 4096, d_block: int = 512) -> DataFrame:
    """(query_id, doc_id, score, rank) of the ``k`` best of documents (doc_id, text) for each query (query_id, text).

    Documents are read into term counts once; queries with the weights of their terms and documents meet in the cells of
    a grid (``_grid``), and each cell sends its k best of each query, so that what is shuffled doesn't grow with the
    postings and nothing passes the driver. Documents without a term of the query score 0 and fill the places that are
    left; empty and null texts count as documents of length 0, null queries as empty ones. Ties go to the lower doc_id.
    """
    counted = docs.select("doc_id", F.expr(tokens("coalesce(text, '')")).alias("t"))
    counted = cut_lineage(counted.select("doc_id", F.size("t").alias("doc_len"), F.expr(counted_terms("t")).alias("terms")))
    size = counted.agg(F.count("*").cast("double").alias("n"), F.avg("doc_len").alias("avg")).collect()[0]
    n, avg = size.n, float(size.avg or 0)
    wanted = query_terms(queries, ["query_id"])
    df = counted.select(F.explode("terms.term").alias("term")).join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("df"))
    weights = wanted.join(df, "term").select("query_id", F.struct("term", (F.col("qtf") * F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)).alias("w")).alias("t"))
    weights = weights.groupBy("query_id").agg(F.sort_array(F.collect_list("t")).alias("weights"))  # a query has as many terms as words
    weights = cut_lineage(queries.select("query_id").distinct().join(weights, "query_id", "left"))

    def near(q: pa.Table, d: pa.Table) -> pa.Table:
        names = q.column("query_id").to_pylist()
        ids = d.column("doc_id").to_numpy()
        by_term: dict[str, tuple[list[int], list[float]]] = {}
        for at, terms in enumerate(q.column("weights").to_pylist()):
            for t in terms or ():
                to = by_term.setdefault(t["term"], ([], []))
                to[0].append(at)
                to[1].append(t["w"])
        weight = {t: (np.array(i), np.array(w)) for t, (i, w) in by_term.items()}
        best = np.zeros((len(names), 0)), np.zeros((len(names), 0), dtype=np.int64)
        lengths = d.column("doc_len").to_pylist()
        for start in range(0, len(ids), 256):
            piece = d.slice(start, 256)
            scores = np.zeros((piece.num_rows, len(names)))
            for j, terms in enumerate(piece.column("terms").to_pylist()):
                norm = K1 * (1 - B + B * lengths[start + j] / avg) if avg else K1
                for t in terms:
                    if (hit := weight.get(t["term"])) is not None:
                        scores[j, hit[0]] += hit[1] * (t["tf"] * (K1 + 1) / (t["tf"] + norm))
            best = _best(best, np.round(scores.T, 6), ids[start : start + 256], k)
        return _emit(names, best, "doc_id")

    q, d = _grid(weights, counted, "query_id", "doc_id", q_block, d_block)
    found = q.groupBy("_q", "_i").cogroup(d.groupBy("_q", "_i")).applyInArrow(near, "query_id bigint, doc_id bigint, score double")
    return _ranked(found, "doc_id", k)


def _ranked(found: DataFrame, id_name: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_name)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def passage_array() -> str:
    """Array of (type, text) of an example: structured form and rows of its table, then its non-blank paragraphs."""
    rows = T._pairs(T.TABLE, "concat({h}, ': ', {v})", "'-', '—'", 0)
    row_texts = f"transform(filter({rows}, p -> size(p.pairs) > 0), p -> concat(p.label, ' - ', array_join(p.pairs, ', ')))"
    tables = f"if(size({T.TABLE}) > 0, concat(array({T.linearize_structured()}), {row_texts}), cast(array() as array<string>))"
    paragraphs = "filter(transform(concat(coalesce(pre_text, array()), coalesce(post_text, array())), p -> trim(p)), p -> p <> '')"
    return f"concat(transform({tables}, t -> named_struct('type', 'table', 'text', t)), transform({paragraphs}, t -> named_struct('type', 'text', 'text', t)))"


def passages(examples: DataFrame) -> DataFrame:
    """(row_id, doc_idx, type, text) of every passage of every example, numbered from 0 within the row."""
    return examples.selectExpr("row_id", f"posexplode({passage_array()}) AS (doc_idx, d)").selectExpr("row_id", "doc_idx", "d.type", "d.text")


def number_boost(question: str = "question") -> str:
    return f"if({question} rlike r'\\d[\\d,.]+', {NUMBER_BOOST}D, 1D)"


def scored_passages(examples: DataFrame, query: str = "question") -> DataFrame:
    """(row_id, boost, scored): for every example an array of (i, type, bm25, cosine) of its passages for its query.

    Each example is an index of its own that lies in one row, so nothing is shuffled: term counts, document frequencies
    and scores are array expressions over the row. The dense score is the cosine of term counts, the place where an
    encoder plugs in. A null query scores 0 everywhere.
    """

    def tf(words: str, w: str) -> str:
        return f"(size({words}) - size(array_remove({words}, {w})))"

    read = examples.select(
        "row_id",
        F.expr(number_boost(query)).alias("boost"),
        F.expr(f"coalesce({tokens(query)}, array())").alias("q"),
        F.expr(f"transform({passage_array()}, d -> named_struct('type', d.type, 'toks', {tokens('d.text')}))").alias("docs"),
    )
    terms = f"transform(array_distinct(q), w -> named_struct('w', w, 'n', {tf('q', 'w')}, 'df', size(filter(docs, d -> array_contains(d.toks, w)))))"
    read = read.select("row_id", "boost", "docs", F.expr(terms).alias("terms"), F.expr("aggregate(docs, 0D, (s, d) -> s + size(d.toks)) / greatest(size(docs), 1)").alias("avg_len"))
    counts = f"transform(terms, t -> named_struct('t', t, 'tf', {tf('d.toks', 't.w')}))"
    idf = "ln((size(docs) - c.t.df + 0.5D) / (c.t.df + 0.5D) + 1)"
    bm = f"aggregate(cs, 0D, (s, c) -> s + if(c.tf = 0, 0D, c.t.n * {idf} * c.tf * {K1 + 1}D / (c.tf + {K1}D * ({1 - B}D + {B}D * if(avg_len = 0, 0D, size(d.toks) / avg_len)))))"
    dot = "aggregate(cs, 0D, (s, c) -> s + c.t.n * c.tf)"
    norm = f"sqrt(aggregate({counted_terms('d.toks')}, 0D, (s, x) -> s + x.tf * x.tf) * aggregate(terms, 0D, (s, t) -> s + t.n * t.n))"
    one = X.lets([("cs", counts), ("nm", norm)], f"named_struct('i', i, 'type', d.type, 'bm25', round({bm}, 6), 'cosine', if(nm = 0, 0D, round({dot} / nm, 6)))")
    return read.select("row_id", "boost", F.expr(f"transform(docs, (d, i) -> {one})").alias("scored"))


def fused(scored: DataFrame, kind: str, k: int) -> DataFrame:
    """(row_id, doc_idx, type, score, rank): the ``k`` best passages of a type by weighted reciprocal ranks.

    Both rankings run over all types first and count from 0; candidates are the first max(5 k, passages of the type) of
    each. The word ranking is boosted where the query holds a number. Ties go to the lower doc_idx.
    """
    by = "transform(array_sort(transform(scored, s -> named_struct('v', -s.{0}, 'i', s.i))), x -> x.i)"
    ranked = scored.select(
        "row_id", "boost", "scored", F.expr(by.format("cosine")).alias("d"), F.expr(by.format("bm25")).alias("b"), F.expr(f"greatest({5 * k}, size(filter(scored, s -> s.type = '{kind}')))").alias("most")
    )
    part = "if(array_position({0}, s.i) <= most, {1} / ({2} + array_position({0}, s.i) - 1), 0D)"
    score = f"round({part.format('d', f'{DENSE_WEIGHT}D', FUSION_K)} + {part.format('b', f'{BM25_WEIGHT}D * boost', FUSION_K)}, 9)"
    best = f"slice(array_sort(filter(transform(filter(scored, s -> s.type = '{kind}'), s -> named_struct('v', -{score}, 'i', s.i)), x -> x.v < 0)), 1, {k})"
    out = ranked.selectExpr("row_id", f"posexplode({best}) AS (at, x)")
    return out.selectExpr("row_id", "x.i AS doc_idx", f"'{kind}' AS type", "-x.v AS score", "at + 1 AS rank")


def retrieve(examples: DataFrame, query: str = "question", k_table: int = 3, k_text: int = 5) -> DataFrame:
    """The best table and text passages of every example for its query column."""
    scored = scored_passages(examples, query)
    return fused(scored, "table", k_table).unionByName(fused(scored, "text", k_text))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, q_block: int = 4096, v_block: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` nearest of (vec_id, embedding) for each query (query_id, embedding), exactly.

    Queries and vectors meet in the cells of a grid (``_grid``) by a matrix product; each cell sends its k best of each
    query and not all pairs. Null and zero vectors are left out. A query's own vector counts as any other. Ties go to the
    lower vec_id.
    """
    able = "embedding is not null and exists(embedding, x -> x <> 0)"

    def unit(t: pa.Table) -> np.ndarray:
        v = np.array(t.column("embedding").to_pylist(), dtype=np.float64)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def near(q: pa.Table, v: pa.Table) -> pa.Table:
        names = q.column("query_id").to_pylist()
        best = np.zeros((len(names), 0)), np.zeros((len(names), 0), dtype=np.int64)
        if names and v.num_rows:
            mine, ids = unit(q), v.column("vec_id").to_numpy()
            for start in range(0, v.num_rows, 2048):
                best = _best(best, np.round(mine @ unit(v.slice(start, 2048)).T, 6), ids[start : start + 2048], k)
        return _emit(names, best, "vec_id")

    q, v = _grid(queries.filter(able).select("query_id", "embedding"), vectors.filter(able).select("vec_id", "embedding"), "query_id", "vec_id", q_block, v_block)
    found = q.groupBy("_q", "_i").cogroup(v.groupBy("_q", "_i")).applyInArrow(near, "query_id bigint, vec_id bigint, score double")
    return _ranked(found, "vec_id", k)


def reranked(hits: DataFrame, score: Callable[[list[str], list[str]], list[float]] | None = None) -> DataFrame:
    """``hits`` (query_id, question, text, rank) with rerank_score and the rank it gives.

    ``score`` is a cross-encoder: it takes questions and passages of a batch and returns a number for each. Without one
    every score is 0 and the order stays.
    """
    if score is None:
        scored = hits.withColumn("rerank_score", F.lit(0.0))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = pa.array([float(x) for x in score(b.column("question").to_pylist(), b.column("text").to_pylist())], pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, "rerank_score"])

        scored = hits.mapInArrow(run, StructType([*hits.schema.fields, StructField("rerank_score", DoubleType())]))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "_before")
    return scored.withColumnRenamed("rank", "_before").withColumn("rank", F.row_number().over(order)).drop("_before")


def encoded(texts: DataFrame, column: str, encode: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 64) -> DataFrame:
    """``texts`` with a column embedding: by ``encode``, which takes a batch of texts, or else hashed term counts."""
    if encode is None:
        return texts.withColumn("embedding", F.expr(hashed_vector(f"coalesce({column}, '')", dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array(encode([x or "" for x in b.column(column).to_pylist()]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, "embedding"])

    return texts.mapInArrow(run, StructType([*texts.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


def hashed_vector(text: str, dim: int = 64) -> str:
    """A text's hashed term counts as an array of ``dim`` numbers of length 1: the dense encoder where no model is given."""
    counts = f"aggregate({tokens(text)}, transform(sequence(1, {dim}), x -> 0D), (acc, w) -> transform(acc, (v, i) -> v + if(i = pmod(xxhash64(w), {dim}), 1D, 0D)))"
    return f"transform(array({counts}), c -> transform(c, v -> v / greatest(sqrt(aggregate(c, 0D, (s, x) -> s + x * x)), 1e-10D)))[0]"


def merged_context(existing: str, found: str, most: int = 3500) -> str:
    """Context text with new passages appended until ``most`` characters; the last is cut if over 50 remain.

    Passages that are blank or whose first 200 lower-case characters were seen, in the existing passages (an array) or
    among the new ones, are left out.
    """
    key = "left(lower(trim({0})), 200)"
    seen = f"transform({existing}, e -> {key.format('e')})"
    fresh = f"filter({found}, (f, i) -> trim(f) <> '' and not array_contains({seen}, {key.format('f')}) and not exists(slice({found}, 1, i), o -> {key.format('o')} = {key.format('f')}))"
    step = f"if(a.full, a, if(length(a.text) + length(trim(f)) + 1 > {most}, named_struct('text', if({most} - length(a.text) - 1 > 50, concat(a.text, ' ', left(trim(f), {most} - length(a.text) - 1)), a.text), 'full', true), named_struct('text', concat(a.text, ' ', trim(f)), 'full', false)))"
    return f"trim(aggregate({fresh}, named_struct('text', array_join({existing}, ' '), 'full', false), (a, f) -> {step}).text)"
