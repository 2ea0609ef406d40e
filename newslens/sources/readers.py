"""Readers of labelled text files. All columns are read as strings."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.config import DatasetSpec
from newslens.functions.scalars import LABEL_CODE, strict_label_code, stripped
from newslens.operators.ordering import dense_index

SUFFIX = {"csv": ".csv", "tsv": ".tsv", "json": ".json"}


def matching_files(spark: SparkSession, folder: str, pattern: str, suffix: str) -> list[str]:
    """Paths below ``folder`` that match a glob pattern and end with ``suffix``. Reads no content."""
    try:
        listed = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{pattern}")
    except AnalysisException:
        return []
    paths = sorted(r.path for r in listed.select("path").collect())
    return [p for p in paths if p.lower().endswith(suffix)]


def _delimited(spark: SparkSession, sep: str, multiline: bool):
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _with_file(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_name").alias("_file"))


def headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Paths by their header line, found in one distributed pass over any number of files."""
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at")
    )
    first = lines.filter("begin = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    by_header = first.groupBy("header").agg(F.collect_list("path").alias("paths")).orderBy("header")
    return {r.header: sorted(unquote(p) for p in r.paths) for r in by_header.collect()}


def _read_delimited(spark, folder, patterns, kind, sep, multiline, keep_file) -> DataFrame:
    frames = []
    for pattern in patterns:
        paths = matching_files(spark, folder, pattern, SUFFIX[kind])
        if not paths:
            continue
        reader = _delimited(spark, sep, multiline)
        for group in headers(spark, paths).values():
            df = reader.csv(group)
            frames.append(_with_file(df) if keep_file else df)
    if not frames:
        raise FileNotFoundError(f"no {kind} file in {folder} matches {list(patterns)}")
    return _union(frames)


def read_csv(spark: SparkSession, folder: str, patterns, multiline: bool = True, keep_file: bool = False) -> DataFrame:
    """All matching .csv files, concatenated by column name.

    ``multiline`` allows line breaks inside quotes; such a file is one task, so
    switch it off for very large files without them.
    """
    return _read_delimited(spark, folder, patterns, "csv", ",", multiline, keep_file)


def read_tsv(spark: SparkSession, folder: str, patterns, multiline: bool = True, keep_file: bool = False) -> DataFrame:
    return _read_delimited(spark, folder, patterns, "tsv", "\t", multiline, keep_file)


def read_json(spark: SparkSession, folder: str, patterns, multiline: bool = True, keep_file: bool = False) -> DataFrame:
    """All matching .json files: arrays of records, or one record per line with ``multiline=False``."""
    paths = [p for pattern in patterns for p in matching_files(spark, folder, pattern, SUFFIX["json"])]
    if not paths:
        raise FileNotFoundError(f"no json file in {folder} matches {list(patterns)}")
    df = spark.read.option("multiLine", multiline).option("primitivesAsString", True).json(paths)
    return _with_file(df) if keep_file else df


READERS = {"csv": read_csv, "tsv": read_tsv, "json": read_json}


def read_dataset(spark: SparkSession, spec: DatasetSpec, folder: str, multiline: bool = True) -> DataFrame:
    """Raw rows of a dataset by its declared format; an unknown format is a ValueError."""
    if spec.format not in READERS:
        raise ValueError(f"unsupported format: {spec.format}")
    return READERS[spec.format](spark, folder, spec.patterns, multiline, spec.label_by_file is not None)


def read_two_file(spark: SparkSession, folder: str, multiline: bool = True) -> DataFrame:
    """``Fake.csv`` and ``True.csv`` as articles; ids are ``fake_i`` and ``real_i`` in file order."""
    frames = []
    for file, name in (("Fake.csv", "fake"), ("True.csv", "real")):
        raw = _delimited(spark, ",", multiline).csv(f"{folder.rstrip('/')}/{file}")
        for column in ("title", "text"):
            if column not in raw.columns:
                raw = raw.withColumn(column, F.lit(""))
        numbered = dense_index(raw.select("title", "text"), "_i")
        frames.append(
            numbered.select(
                F.concat(F.lit(f"{name}_"), "_i").alias("id"),
                "title",
                "text",
                F.lit(LABEL_CODE[name]).alias("label"),
                F.lit(None).cast("string").alias("source"),
            )
        )
    return frames[0].unionByName(frames[1])


def read_sample(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One file ``id,title,text,label``; a label other than fake or real fails the job."""
    raw = _delimited(spark, ",", multiline).csv(path)
    return raw.select("id", "title", "text", strict_label_code(F.col("label")).alias("label"), F.lit(None).cast("string").alias("source"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, trimmed and lowered, blank lines skipped; a missing file is an empty lexicon."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], "word string")
    return lines.select(F.lower(stripped(F.col("value"))).alias("word")).filter("word <> ''").distinct()


def lexicon_words(lexicon: DataFrame, at_most: int = 20_000) -> tuple[str, ...]:
    """A small lexicon as literals. A larger one stays a table (see ``lexicon_hits``)."""
    rows = lexicon.limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} words: keep the lexicon as a table")
    return tuple(sorted(r.word for r in rows))
