"""Reading panels and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Any path that Spark reads (files, s3a://, hdfs://); columns are pruned in the scan."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.limit(rows) if rows else df


def read_matching(spark: SparkSession, path: str, ids: DataFrame, id_col: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a parquet table whose id is in `ids`: a semi join, whose side Spark broadcasts if it is small enough."""
    return read_parquet(spark, path, columns).join(ids.select(id_col), id_col, "left_semi")


def read_csv(spark: SparkSession, path: str, schema: str, timestamp_format: str | None = None, timestamps: list[str] = ()) -> DataFrame:
    """With a header and a stated schema; .gz is read too. Columns in `timestamps` are parsed leniently: what does not parse is null."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df.withColumns({c: F.try_to_timestamp(F.col(c), F.lit(timestamp_format)) if timestamp_format else F.try_to_timestamp(F.col(c)) for c in timestamps}) if timestamps else df


def from_pandas(spark: SparkSession, pdf) -> DataFrame:
    return spark.createDataFrame(pdf)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder with one CSV file with a header: for results, which are small. Arrays are written as JSON."""
    arrays = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    df.withColumns(arrays).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_text(df: DataFrame, path: str) -> None:
    """key: value lines of a one-row result."""
    lines = F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns))
    df.select(F.explode(lines).alias("value")).coalesce(1).write.mode("overwrite").text(path)
