"""Registered queries of the language-model operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import chunking, mixing, overlap, tokens, truncation
from tallyforge.session import cut_lineage
from tallyforge.sources.tables import table


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    paras = chunking.paragraphs(table(spark, folder, "finqa_examples"), table(spark, folder, "retrieval_configs"))
    return chunking.split_oversized(paras, ["row_id", "side", "para_idx"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that the chunker had to cut: those with a second piece."""
    return p1_pieces(spark, folder).filter("piece_idx = 1").select("row_id", "side", "para_idx")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split_overlaps(table(spark, folder, "finqa_examples"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_counts(table(spark, folder, "finqa_examples"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p6_summary(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_summary(p6_ids(spark, folder))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts are cut off the lineage: they are read several times and cost the most."""
    return cut_lineage(tokens.token_counts(table(spark, folder, "documents"), ["doc_id", "source"]))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "mixture_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    sizes, targets = _sizes(spark, folder), table(spark, folder, "mixture_targets")
    return mixing.shares(mixing.mix(sizes, targets), sizes, targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents")).select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_counts, p6_ids, p6_summary, p7_mix, p7_shares, p8_found, p8_rates)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
            WITH cfg AS (
                SELECT source, arg_min(chunk_size, config_id) AS chunk_size, arg_min(size_unit, config_id) AS size_unit
                FROM retrieval_configs GROUP BY source),
            paras AS (
                SELECT row_id, source, 'pre' AS side, unnest(range(len(pre_text))) AS para_idx, unnest(pre_text) AS text FROM finqa_examples
                UNION ALL
                SELECT row_id, source, 'post', unnest(range(len(post_text))), unnest(post_text) FROM finqa_examples)
            SELECT p.row_id, p.side, CAST(p.para_idx AS INTEGER) AS para_idx
            FROM paras p
            LEFT JOIN cfg c ON c.source = p.source AND c.source <> 'default'
            CROSS JOIN (SELECT chunk_size, size_unit FROM cfg WHERE source = 'default') d
            WHERE p.text IS NOT NULL
              AND CASE WHEN CASE WHEN c.source IS NULL THEN d.size_unit ELSE c.size_unit END = 'chars' THEN length(p.text)
                       ELSE len(regexp_extract_all(p.text, '[^ \t\n\x{A0}]+')) END
                  > CASE WHEN c.source IS NULL THEN d.chunk_size ELSE c.chunk_size END
        """,
    }
