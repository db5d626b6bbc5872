"""Table, document and model sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import COEF_SCHEMA, LogisticModel, logistic_from_table


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                fmt: str = "parquet") -> str:
    """Overwrite a table; CSV gets a header."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_documents(df: DataFrame, path: str) -> str:
    """One JSON document per row, one row per line; nulls are written out."""
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(body.alias("value")).write.mode("overwrite").text(path)
    return path


def save_model(model: LogisticModel, metadata: DataFrame, path: str) -> str:
    """Coefficient table and metadata document under one folder."""
    spark = metadata.sparkSession
    model.coefficients(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")
    write_documents(metadata, f"{path}/metadata")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[LogisticModel, DataFrame]:
    """(model, metadata row as written)."""
    coef = spark.read.schema(COEF_SCHEMA).parquet(f"{path}/coefficients")
    return logistic_from_table(coef), spark.read.json(f"{path}/metadata")
