"""Hooks with and without a model, weights on disk, and removal of written tables."""

import os

import pytest
from tallyforge.operators import retrieval as R
from tallyforge.operators import routing as G
from tallyforge.session import cut_lineage, written_tables


def test_reranking_keeps_the_order_without_a_model(spark):
    hits = spark.createDataFrame([(1, "q", "long passage", 1), (1, "q", "x", 2), (2, "q", None, 1)], "query_id long, question string, text string, rank int")
    assert sorted((r.query_id, r.rank, r.rerank_score) for r in R.reranked(hits).collect()) == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0)]
    got = R.reranked(hits, lambda q, t: [-len(x or "") for x in t]).collect()
    assert {(r.query_id, r.text): r.rank for r in got} == {(1, "x"): 1, (1, "long passage"): 2, (2, None): 1}


def test_encoding_and_prototypes(spark):
    df = spark.createDataFrame([("why", "causal"), ("how much", "numerical"), ("why not", "causal"), (None, "causal")], "question string, label string")
    assert all(len(r.embedding) == 64 for r in R.encoded(df, "question").collect())
    got = {r.label: r.prototype for r in G.prototypes(df, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()}
    assert got == {"causal": [5.0, 1.0], "numerical": [8.0, 1.0]}


def test_weights_come_back(spark, tmp_path):
    path = str(tmp_path / "weights.json")
    G.save_weights(path, std=[2.0] * 16, bias=[0.0, 5.0, 0.0, 0.0])
    got = G.load_weights(path)
    assert got["weights"] == G.WEIGHTS and got["std"] == [2.0] * 16
    q = spark.createDataFrame([("how many depots",)], "question string")
    assert G.routed(q, got["mean"], got["std"], got["weights"], got["bias"]).collect()[0].primary_type == "temporal"
    (tmp_path / "bad.json").write_text('{"W": [[1]], "b": [], "mean": [], "std": []}')
    with pytest.raises(ValueError):
        G.load_weights(str(tmp_path / "bad.json"))


def test_written_tables_are_removed(spark):
    with written_tables(spark) as mine:
        assert cut_lineage(spark.range(5)).count() == 5 and all(os.path.isdir(f.removeprefix("file:")) for f in mine)
    assert len(mine) == 1 and not os.path.exists(mine[0].removeprefix("file:"))


def test_top_k_fills_with_documents_that_share_nothing(spark):
    docs = spark.createDataFrame([(1, "net sales rose"), (2, None), (3, ""), (4, "sales"), (5, "other")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "sales"), (11, None), (12, "zzz")], "query_id long, text string")
    got = {}
    for r in R.bm25(docs, asked, 3, q_block=1, d_block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score > 0))
    assert got == {10: [(4, True), (1, True), (2, False)], 11: [(1, False), (2, False), (3, False)], 12: [(1, False), (2, False), (3, False)]}
    assert R.bm25(docs.limit(0), asked, 3).count() == 0 and R.bm25(docs, asked.limit(0), 3).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "vec_id long, embedding array<float>")
    near = R.cosine_topk(vectors, vectors.selectExpr("vec_id AS query_id", "embedding"), 2, 1, 1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in near] == [(1, 1), (1, 4), (4, 4), (4, 1)]
