"""Registered queries of the core training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.operators import nested_records, packed_values, unit_conversion
from tallyforge.sources.tables import table


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    return packed_values.packed_values(table(spark, folder, "program_annotations"), "annotation_id", "program")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of the programs that hold two or more."""
    got = p3_values(spark, folder).filter("n_values >= 2")
    return got.selectExpr("annotation_id", "pos", "value AS step")


def p3_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the programs between delimiters, whatever it is."""
    return packed_values.packed_values(table(spark, folder, "program_annotations"), "annotation_id", "program", "values")


def p4_amounts(spark: SparkSession, folder: str) -> DataFrame:
    return unit_conversion.convert_units(table(spark, folder, "finqa_examples"), table(spark, folder, "metric_units"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers recorded in another unit than the common one."""
    return p4_amounts(spark, folder).filter("converted and amount is not null").select("row_id", "field", "row_idx", "col_idx", "amount")


def p5_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nested_records.nested_nodes(table(spark, folder, "raw_records"))


def p5_every_node(spark: SparkSession, folder: str) -> DataFrame:
    return nested_records.every_node(table(spark, folder, "raw_records"))


def p5_arguments(spark: SparkSession, folder: str) -> DataFrame:
    """The table of arguments, with the operation and question they belong to by containment of intervals."""
    t = nested_records.node_tables(table(spark, folder, "raw_records"))
    keys = ["record_no", "page_idx", "qa_idx"]
    steps = t["step"].select(*keys, "step", "operation")
    return t["arg"].join(steps, [*keys, "step"]).join(t["question"].select(*keys, "question"), keys, "left").drop("pre", "post")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested_records.flatten_records(table(spark, folder, "raw_records")).drop("page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_values, p3_plain, p4_found, p4_amounts, p5_found, p5_nodes, p5_every_node, p5_arguments)}
