"""The question dataset as JSON: splits from files, programs, and sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.programs import split_program

#: A page of the published dataset; numbers and texts of answers alike are read as text.
SCHEMA = "id string, pre_text array<string>, post_text array<string>, `table` array<array<string>>, qa struct<question: string, program: string, exe_ans: string, answer: string, gold_inds: map<string, string>>"


def shaped(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Pages of SCHEMA as examples: id, question, table, pre_text, post_text, program, answer, table_header, gold_evidence.

    The executed answer comes before the written one; a missing part is null, a missing program an empty array.
    """
    return pages.select(
        *(keep or []),
        "id",
        F.col("qa.question").alias("question"),
        F.col("table").alias("table_cells"),
        "pre_text",
        "post_text",
        F.expr(f"coalesce({split_program('qa.program')}, array())").alias("program"),
        F.expr("coalesce(qa.exe_ans, qa.answer)").alias("answer"),
        F.expr("get(`table`, 0)").alias("table_header"),
        F.expr("map_values(qa.gold_inds)").alias("gold_evidence"),
    )


def load_split(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Examples of one split file (a JSON array or lines); ids that are missing are numbered by their place in the read."""
    pages = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    e = shaped(pages).withColumn("id", F.coalesce("id", F.concat(F.lit("finqa_"), F.monotonically_increasing_id())))
    return e.limit(most) if most else e


def load_dataset(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """All split files that exist in a folder, with their split."""
    found = [load_split(spark, str(p)).withColumn("split", F.lit(s)) for s in splits if (p := Path(folder, f"{s}.json")).exists()]
    if not found:
        return spark.createDataFrame([], shaped(spark.createDataFrame([], SCHEMA)).schema).withColumn("split", F.lit(None).cast("string"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def from_payloads(records: DataFrame) -> DataFrame:
    """(record_no, example columns) of records whose payload (JSON text) is a page in the published shape; broken ones are left out."""
    parsed = records.filter("payload is not null").select("record_no", F.from_json("payload", SCHEMA).alias("p")).filter("p.id is not null")
    return shaped(parsed.select("record_no", "p.*"), ["record_no"])


def training_records(examples: DataFrame) -> DataFrame:
    """(row_id, prompt, target) of examples with a question and a program: the program's steps joined by ' ; ' without blanks."""
    steps = "array_join(transform(filter(program, s -> trim(s) <> ''), s -> regexp_replace(lower(trim(s)), r'\\s+', '')), ' ; ')"
    e = examples.filter("trim(question) <> '' and size(program) > 0")
    return e.selectExpr("row_id", "concat('Question: ', question, '\\nProgram:') AS prompt", f"{steps} AS target").filter("target <> ''")


def contrastive_pairs(examples: DataFrame) -> DataFrame:
    """(anchor, other, label): a positive is kept if its years meet the anchor's or either has none; of up to three negatives, those whose years don't.

    Expects anchor, positive and negatives (an array).
    """
    years = "array_distinct(regexp_extract_all({0}, r'\\b((?:19|20)\\d{{2}})\\b', 1))"
    a, p, n = years.format("anchor"), years.format("positive"), years.format("n")
    pos = f"if(positive is not null and (size({a}) = 0 or size({p}) = 0 or arrays_overlap({a}, {p})), array(named_struct('other', positive, 'label', 1)), array())"
    neg = f"transform(filter(slice(coalesce(negatives, array()), 1, 3), n -> not arrays_overlap({a}, {n})), n -> named_struct('other', n, 'label', 0))"
    return examples.selectExpr("anchor", f"inline(concat({pos}, {neg}))")


def write_report(report: DataFrame, path: str) -> None:
    """A report as one JSON file per task."""
    report.write.mode("overwrite").json(path)
