"""From files to processed, combined and profiled datasets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from newslens.config import DATASETS, Cleaning, DatasetSpec
from newslens.operators.corpus import balance, combine
from newslens.operators.standardize import ROW, clean, require_valid, standardize
from newslens.sources.readers import read_dataset
from newslens.sources.writers import write_processed

STATUS = "dataset string, status string, rows bigint, error string"


def process_dataset(
    spark: SparkSession,
    spec: DatasetSpec,
    folder: str,
    out: str | None = None,
    fmt: str = "parquet",
    multiline: bool = True,
) -> DataFrame:
    """Read, standardise, clean and, with ``out``, save one dataset."""
    raw = read_dataset(spark, spec, folder, multiline)
    df = standardize(raw, spec, keep_row=True)
    if spec.cleaning is not None:
        df = clean(df, spec.cleaning, ROW)
        df = require_valid(df, spec.cleaning)
    df = df.drop(ROW)
    if out is None:
        return df
    path = write_processed(df, out, spec.name, fmt)
    return spark.read.schema(df.schema).parquet(path) if fmt == "parquet" else df


def process_custom(
    spark: SparkSession,
    folder: str,
    text_columns: Iterable[str],
    label_column: str,
    title_column: str | None = None,
    patterns: Iterable[str] = ("*.csv",),
    fmt: str = "csv",
    name: str = "custom",
    cleaning: Cleaning | None = None,
    out: str | None = None,
    stored_as: str = "parquet",
    multiline: bool = True,
) -> DataFrame:
    """A local or shared folder with a column mapping given by the caller.

    ``multiline=False`` lets one large file be read by many tasks; it must hold no line breaks inside quotes.
    """
    spec = DatasetSpec(name, tuple(patterns), fmt, tuple(text_columns), label_column, title_column, None, cleaning)
    return process_dataset(spark, spec, folder, out, stored_as, multiline=multiline)


def process_many(
    spark: SparkSession,
    names: Iterable[str] | str,
    folders: Mapping[str, str],
    out: str,
    registry: Mapping[str, DatasetSpec] = DATASETS,
    combined: bool = False,
    balanced: bool = True,
    stored_as: str = "parquet",
    multiline: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Process several datasets; one that fails does not stop the others.

    ``names`` is a list, a comma-separated string or ``"all"``. Returns the
    status table and, when asked for, the combined dataset.
    """
    if isinstance(names, str):
        names = list(registry) if names == "all" else [n.strip() for n in names.split(",")]
    done, status = [], []
    for name in names:
        if name not in registry:
            status.append((name, "skipped", None, "unknown dataset"))
            continue
        try:
            df = process_dataset(spark, registry[name], folders[name], out, stored_as, multiline=multiline)
            status.append((name, "ok", df.count(), None))
            done.append(df)
        except Exception as e:
            status.append((name, "failed", None, f"{type(e).__name__}: {e}"))
    table = spark.createDataFrame(status, STATUS)
    if not combined or not done:
        return table, None
    merged = combine(done)
    return table, balance(merged) if balanced else merged
