"""Sinks: processed datasets, the label layouts and run tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": '""',
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_processed(df: DataFrame, folder: str, name: str, fmt: str = "parquet") -> str:
    """Save a processed dataset as ``<folder>/<name>_processed``."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported format: {fmt}")
    path = f"{folder.rstrip('/')}/{name}_processed"
    writer = df.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    else:
        writer.options(**CSV).csv(path)
    return path


def read_processed(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """Every processed dataset of a folder as one table."""
    pattern = f"{folder.rstrip('/')}/*_processed"
    try:
        if fmt == "parquet":
            return spark.read.parquet(pattern)
        return spark.read.options(header=True, multiLine=True, quote='"', escape='"', enforceSchema=False).csv(pattern)
    except AnalysisException as e:
        raise FileNotFoundError(f"no processed dataset in {folder}") from e


def integrate(spark: SparkSession, folder: str, out: str, fmt: str = "parquet") -> str:
    """Merge all processed datasets into one table of ``title, text`` partitioned by label.

    One write; readers of one class prune to its partition.
    """
    merged = read_processed(spark, folder, fmt).filter(F.col("label").isin("fake", "real"))
    merged.select("title", "text", "label").write.mode("overwrite").partitionBy("label").parquet(out)
    return out


def write_two_file(df: DataFrame, folder: str) -> None:
    """The two-file layout ``Fake.csv`` / ``True.csv`` with ``title, text`` (folders of part files)."""
    for name, label in (("Fake.csv", "fake"), ("True.csv", "real")):
        df.filter(F.col("label") == label).select("title", "text").write.mode("overwrite").options(**CSV).csv(
            f"{folder.rstrip('/')}/{name}"
        )


def write_splits(splits: DataFrame, path: str) -> None:
    """Split table, one directory per seed, so a run reads one seed only."""
    splits.write.mode("overwrite").partitionBy("seed").parquet(path)


def read_splits(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    splits = spark.read.parquet(path)
    return splits if seed is None else splits.filter(F.col("seed") == seed)


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Save every named table of a run below ``folder``."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths
