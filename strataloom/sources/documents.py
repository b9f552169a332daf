"""Files as documents, and golden cases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ACCEPTED = ("pdf", "md", "txt")


@F.pandas_udf(StringType())
def decode_utf8(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """UTF-8 without what cannot be decoded."""
    for part in parts:
        yield part.map(lambda x: x and bytes(x).decode("utf-8", "ignore"))


def _kind(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, kind, bytes, accepted) of the files below a folder; other kinds are marked, not dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), _kind("path").alias("kind"), F.col("content").alias("bytes"), _kind("path").isin(*ACCEPTED).alias("accepted"))


def text_documents(files: DataFrame) -> DataFrame:
    """(document_id, filename, path, text) of Markdown and text files; the id is a hash of the path."""
    return files.where(F.col("kind").isin("md", "txt")).select(F.xxhash64("path").alias("document_id"), "filename", "path", decode_utf8("bytes").alias("text"))


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    schema = "document_id bigint, query string, expect_any array<string>, forbid_any array<string>, expected_node_ids array<bigint>, model_name string"
    return spark.read.schema(schema).option("multiLine", True).json(path)
