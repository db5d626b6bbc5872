"""Scans of landed files: series CSV, wide CSV, observation and envelope JSON, documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import clean_number, clean_values, lenient_double
from ..storage import literal_table

OBSERVATIONS = "observations array<struct<date:string,value:string>>"
RECORD = "array<struct<countryiso3code:string,date:string,value:string>>"


def _renamed(name, columns: Mapping[str, str]):
    pairs = [F.lit(x) for kv in columns.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[name], name)


def read_series(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str] = (),
                columns: Mapping[str, str] = fixed.SERIES_COLUMNS) -> DataFrame:
    """All series files in one scan -> (keys, series, date, value).

    The series is the `series=` folder where the layout has one, else the file name.
    """
    schema = T.StructType([T.StructField("date", T.DateType()),
                           T.StructField("value", T.DoubleType())])
    df = spark.read.schema(schema).option("header", True).csv(path)
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, r"/series=([^/]+)/", 1)
    stem = F.regexp_extract(file, r"([^/]+?)\.csv[^/]*$", 1)
    name = F.when(folder != "", folder).otherwise(stem)
    # Paths are URL-encoded, e.g. the blanks of key folders.
    entity = [F.url_decode(F.regexp_extract(file, f"/{k}=([^/]+)/", 1)).alias(k) for k in keys]
    return df.select(*entity, _renamed(name, columns).alias("series"), "date",
                     clean_number(F.col("value")).alias("value"))


def read_wide(spark: SparkSession, path: str, keys: Sequence[str] = (),
              series: Sequence[str] = fixed.SERIES) -> DataFrame:
    """The mixed-frequency table from CSV with an explicit schema."""
    fields = [*[f"{k} string" for k in keys], "date date", *[f"{s} double" for s in series]]
    return clean_values(spark.read.schema(", ".join(fields)).option("header", True).csv(path))


def read_observation_json(spark: SparkSession, path: str, ids: Sequence[str] = (),
                          whole_files: bool = False) -> DataFrame:
    """Observation documents -> (ids, date, value); "." marks a missing value."""
    schema = ", ".join([*[f"{c} string" for c in ids], OBSERVATIONS])
    docs = spark.read.schema(schema).option("multiLine", whole_files).json(path)
    rows = docs.select(*ids, F.explode("observations").alias("o")).where(F.col("o.value") != ".")
    return rows.select(*ids, F.to_date("o.date").alias("date"),
                       lenient_double(F.col("o.value")).alias("value"))


def validate_envelopes(docs: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(accepted documents with their `records` text, rejected ones with a `reason`).

    An envelope is a list of metadata and records. The tests run in this order: a list,
    two items or more, no message in the metadata, records absent (none) or a list.
    """
    p = F.col(payload)
    parts = F.from_json(p, "array<string>")  # nested values stay JSON text
    size, meta, records = F.json_array_length(p), F.get(parts, 0), F.get(parts, 1)
    told = F.array_contains(F.json_object_keys(meta), "message")
    reason = (F.when(size.isNull(), "unexpected response type")
              .when(size < 2, "response did not contain data")
              .when(F.coalesce(told, F.lit(False)), F.concat(
                  F.lit("error: "), F.coalesce(F.get_json_object(meta, "$.message"), F.lit(""))))
              .when(records.isNotNull() & F.json_array_length(records).isNull(),
                    "observation data has an invalid structure"))
    checked = docs.withColumns({"records": records, "reason": reason})
    good = checked.where(F.col("reason").isNull()).drop("reason", payload)
    return good, checked.where(F.col("reason").isNotNull()).drop("records", payload)


def explode_envelopes(good: DataFrame, countries: DataFrame,
                      ids: Sequence[str] = ("indicator_code", "indicator")) -> DataFrame:
    """Records of accepted envelopes -> long rows of the configured countries.

    The country table has one row per code, so one hash join both filters and names.
    Rows whose year is no whole number are skipped; other text values become NULL.
    """
    rows = good.select(*ids, F.explode(F.from_json("records", RECORD)).alias("r")).select(
        *ids, F.col("r.countryiso3code").alias("country_code"),
        F.trim("r.date").try_cast("int").alias("year"),
        lenient_double(F.col("r.value")).alias("value"))
    rows = rows.where(F.col("year").isNotNull()).join(countries, "country_code")
    return rows.select("country_code", "country", "year", *ids, "value")


def read_envelopes(spark: SparkSession, path: str, countries: DataFrame,
                   indicators: Mapping[str, str] = fixed.PANEL_INDICATORS
                   ) -> tuple[DataFrame, DataFrame]:
    """(long rows, rejected files) of envelope files named <indicator code>.json."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.json[^/]*$", 1)
    docs = spark.read.option("wholetext", True).text(path).select(
        stem.alias("indicator_code"), F.col("value").alias("payload"))
    docs = docs.withColumn("indicator", _renamed(F.col("indicator_code"), indicators))
    good, rejected = validate_envelopes(docs)
    return explode_envelopes(good, countries), rejected


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Documents written by `write_documents`; broken JSON fails the job.

    A missing path is a FileNotFoundError when the plan is built.
    """
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no snapshot is available at {path}") from e
        raise


def snapshot_status(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row: whether snapshots can be read at the path, how many, and what is wrong if none."""
    kinds = "snapshot_available boolean, documents bigint, detail string"
    try:
        docs = read_documents(spark, path, schema)
    except FileNotFoundError as e:
        return literal_table(spark, [(False, 0, str(e))], kinds)
    n = F.count("*")
    return docs.agg((n > 0).alias("snapshot_available"), n.alias("documents"),
                    F.when(n == 0, "no documents").alias("detail"))


def series_catalogue(spark: SparkSession) -> DataFrame:
    """(series_id, label, column, rule): what each source series is and becomes."""
    rows = [(s, label, fixed.SERIES_COLUMNS[s], fixed.MONTHLY_RULES[fixed.SERIES_COLUMNS[s]])
            for s, label in fixed.SERIES_LABELS.items()]
    return literal_table(spark, rows, "series_id string, label string, column string, rule string")
