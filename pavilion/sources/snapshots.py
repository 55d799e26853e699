"""Landed feed snapshots: raw JSON text per endpoint and fetch time, and CSV export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ``endpoint`` is the kind of feed (live, upcoming, recent, scard, squad);
# ``subject`` the match or team a scorecard or squad belongs to.
LANDED = "subject STRING, fetched_at TIMESTAMP_NTZ, status_code INT, body STRING, endpoint STRING, ingest_date DATE"


def is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def land_snapshots(df: DataFrame, path: str, dealt: bool = False) -> None:
    """Append ``(endpoint, subject, fetched_at, status_code, body)`` rows as compressed JSON lines per endpoint
    and day.

    A body that is not JSON is kept as an object of its status code and text.
    Rows are rebalanced by folder first: small folders get one file, big ones
    are split, and no task writes into every folder. Rows that are ``dealt``,
    as those of a few folders after a grouping, are written where they are.
    """
    kept = F.to_json(F.struct("status_code", F.col("body").alias("text")))
    subject = F.col("subject") if "subject" in df.columns else F.lit(None).cast("string")
    rows = df.select(
        subject.alias("subject"), "fetched_at", "status_code",
        F.when(is_json(F.col("body")), F.col("body")).otherwise(kept).alias("body"),
        "endpoint", F.to_date("fetched_at").alias("ingest_date"),
    )
    rows = rows if dealt else rows.hint("rebalance", "endpoint", "ingest_date")
    rows.write.mode("append").partitionBy("endpoint", "ingest_date").json(path, compression="gzip")


def read_snapshots(spark: SparkSession, path: str, endpoint: str | None = None) -> DataFrame:
    """Landed snapshots with their endpoint, fetch time and file; other endpoints' folders are not listed."""
    df = spark.read.schema(LANDED).json(path)
    df = df.select(
        "endpoint", "subject", "fetched_at", "status_code", "body", F.col("_metadata.file_path").alias("source_file")
    )
    return df if endpoint is None else df.where(F.col("endpoint") == endpoint)


def read_documents(spark: SparkSession, path: str, endpoint: str | None = None) -> DataFrame:
    """Saved response files, one JSON document each, named after their endpoint.

    ``live.json`` gives endpoint live; ``scard_40.json`` endpoint scard, subject 40.
    """
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1)
    df = spark.read.text(path, wholetext=True).select(
        F.substring_index(stem, "_", 1).alias("endpoint"),
        F.nullif(F.regexp_extract(stem, "^[^_]*_(.*)$", 1), F.lit("")).alias("subject"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("fetched_at"),
        F.lit(None).cast("int").alias("status_code"),
        F.col("value").alias("body"),
        F.col("_metadata.file_path").alias("source_file"),
    )
    return df if endpoint is None else df.where(F.col("endpoint") == endpoint)


def corrupt(df: DataFrame) -> DataFrame:
    """Snapshots whose body is not JSON."""
    return df.where(~is_json(F.col("body")))


def export_csv(df: DataFrame, folder: str, name: str) -> str:
    """Write a result as CSV with header into a folder named after the query; gives back its path."""
    path = f"{folder}/{re.sub(r'[^A-Za-z0-9]+', '_', name).strip('_').lower()}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
