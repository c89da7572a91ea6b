"""Where rows come from and go to."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from paperloom.operators.storage import accepted_pdfs
from paperloom.schemas import schema


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """PDFs below a path: path, length, content, file_hash. Files that aren't PDFs, are empty or too large are left out."""
    return accepted_pdfs(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).select("path", "length", "content", "file_hash")


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the data model from Parquet; columns that an older file lacks are null."""
    return spark.read.schema(schema(name)).parquet(path)


def json_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the data model from JSON lines; broken lines are dropped."""
    return spark.read.schema(schema(name)).option("mode", "DROPMALFORMED").json(path)


def csv_rows(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Rows of a CSV file with a head and given types."""
    return spark.read.schema(columns).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def jdbc_rows(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A table of a database, read in ``parts`` ranges of a key. Its driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return reader.load()


def columns_of(df: DataFrame) -> DataFrame:
    """(name, type) of a table's columns: the catalogue as rows."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "name string, type string")


def is_public_host(host: str | None) -> bool:
    """Whether a host may be fetched from: no literal address of a private, loopback, link-local, reserved, multicast or unspecified kind, no local name."""
    host = (host or "").strip("[]").lower()
    if not host or host == "localhost" or host.endswith((".local", ".internal", ".localhost")):
        return False
    try:
        return ipaddress.ip_address(host).is_global and not ipaddress.ip_address(host).is_multicast
    except ValueError:
        return "." in host


@F.pandas_udf(BooleanType())
def is_public_url(urls: pd.Series) -> pd.Series:
    """The same of URLs: http or https, and a public host."""

    def public(u: str | None) -> bool:
        try:
            parts = urlsplit(u or "")
            return parts.scheme in ("http", "https") and is_public_host(parts.hostname)
        except ValueError:
            return False

    return urls.map(public)
