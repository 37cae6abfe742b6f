"""Other inputs: lists, indexes, gazetteers, DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORY_COLUMNS = {"story_id", "headline", "text", "source"}


def read_list(spark: SparkSession, path: str, column: str = "text", missing_ok: bool = False) -> DataFrame:
    """Lines of a text file that are not blank and don't start with #; a missing file is empty if ``missing_ok``."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], f"{column} string")
    return lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.col("value").alias(column))


def read_index(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(id, value) of a Parquet or JSON table of ids with arrays: surface forms or tickers."""
    rows = spark.read.json(path, schema=f"id long, {value}s array<string>") if path.endswith(".json") else spark.read.parquet(path)
    return rows.select("id", F.explode(f"{value}s").alias(value)).distinct()


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, code) with keys in lower case; kinds are name and city."""
    return spark.read.parquet(path).select("kind", F.lower("key").alias("key"), "code")


def from_df(rows: DataFrame, needed: set[str] = STORY_COLUMNS) -> DataFrame:
    """``rows``, if all needed columns are there."""
    if missing := needed - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return rows
