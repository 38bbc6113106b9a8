"""Typed files: CSV under a fixed schema, optional and empty inputs, upload checks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.config import Config, UserFacingError

def read_csv_typed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV under a schema: only the empty field is null; 007 and None stay text. An empty file gives no rows."""
    if os.path.exists(path) and os.path.isfile(path) and not os.path.getsize(path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, header=True, nullValue="", emptyValue="", multiLine=True, escape='"')


def optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """None where a side input is missing."""
    return read_csv_typed(spark, path, schema) if os.path.exists(path) else None


def required(spark: SparkSession, path: str, schema: StructType, hint: str) -> DataFrame:
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} is missing: {hint}")
    return read_csv_typed(spark, path, schema)


def pre_validate(data: bytes, filename: str, config: Config) -> str:
    """The text of an upload, or UserFacingError with a code."""
    if not filename.lower().endswith(".txt"):
        raise UserFacingError("wrong_type", "Only .txt exports are read.")
    if not data:
        raise UserFacingError("empty", "The file is empty.")
    if len(data) > config.max_upload_bytes:
        raise UserFacingError("too_large", f"The file is larger than {config.max_upload_mb} MB.")
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise UserFacingError("not_utf8", "The file is not UTF-8 text.") from None
    if not text.strip():
        raise UserFacingError("empty", "The file holds white space only.")
    return text
