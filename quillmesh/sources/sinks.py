"""Saved models, text renderings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.config import Options

FIGURES = ("f1", "precision", "recall", "cluster_f1", "cluster_precision", "cluster_recall", "vi")


def save(rows: DataFrame, path: str) -> None:
    """Keep prepared questions for a later run."""
    rows.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Questions that :func:`save` kept."""
    return spark.read.parquet(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents from JSON lines, with a given schema; a broken line gives nulls."""
    return spark.read.schema(schema).json(path)


def sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Any SQL over the parquet tables of a folder, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
        name = status.getPath().getName()
        if name.endswith(".parquet"):
            spark.read.parquet(status.getPath().toString()).createOrReplaceTempView(name.removesuffix(".parquet"))
    return spark.sql(text)


def rendered(rows: DataFrame) -> DataFrame:
    """``(value)``: each row as one line of JSON."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def header(options: Options) -> str:
    """Names of the columns of a CSV report."""
    return ",".join([*FIGURES, *(k for k, _ in options.relevant())])


def report_text(report: DataFrame, options: Options) -> str:
    """The one-row report in the output format of the options; empty for NONE, and for MERGE-CSV, whose lines are the trace."""
    if options.output_format in ("NONE", "MERGE-CSV"):
        return ""
    row = report.first()
    if options.output_format == "CSV":
        return ",".join([*(f"{row[k]:f}" for k in FIGURES), *(str(v) for _, v in options.relevant())])
    return "\n".join(f"{k.replace('_', ' ')}: {row[k]:f}" for k in FIGURES)


def trace_lines(trace: DataFrame) -> DataFrame:
    """``(threshold, precision, recall, f1)`` of a merge trace or curve, for a CSV file, highest threshold first."""
    return trace.select("threshold", "precision", "recall", "f1").orderBy(F.desc("threshold"))
