"""From raw columns to (text, title, label, source, id), and row-level quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.config import Cleaning, DatasetSpec
from newslens.functions.scalars import standard_label
from newslens.operators.ordering import dense_index

STANDARD = ("text", "title", "label", "source", "id")
ROW = "_row"


def standardize(df: DataFrame, spec: DatasetSpec, order_by: str | None = None, keep_row: bool = False) -> DataFrame:
    """Project to the five standard columns; ids are ``<name>_<i>`` in row order.

    NULL text, title and label stay NULL (they do not become a word), so the
    missing-value rule can see them. Several text columns are joined by one blank.
    """
    if spec.label_by_file is not None:
        branches = [(F.col("_file") == f, label) for f, label in spec.label_by_file.items()]
        first, *rest = branches
        label = reduce(lambda c, b: c.when(b[0], b[1]), rest, F.when(first[0], first[1]))
    elif spec.label_column in df.columns:
        label = standard_label(F.col(spec.label_column))
    else:
        raise KeyError(f"label column {spec.label_column!r} not found")
    parts = [F.col(c).cast("string") for c in spec.text_columns]
    text = parts[0] if len(parts) == 1 else F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(" ", *parts))
    title = F.col(spec.title_column).cast("string") if spec.title_column in df.columns else F.lit("")
    key = [F.col(order_by).alias("_order")] if order_by else []
    narrow = df.select(text.alias("text"), title.alias("title"), label.alias("label"), *key)
    numbered = dense_index(narrow, ROW, "_order" if order_by else None)
    out = numbered.withColumn("source", F.lit(spec.name)).withColumn("id", F.concat(F.lit(f"{spec.name}_"), F.col(ROW)))
    return out.select(*STANDARD, *([ROW] if keep_row else []))


def drop_duplicate_texts(df: DataFrame, order_by: str, text: str = "text") -> DataFrame:
    """Keep the first row (by ``order_by``) of every distinct text.

    Rows meet by the SHA-256 of their text. The minimum is taken before the
    shuffle as well, so a text copied into a third of all rows leaves each map
    task as one row.
    """
    columns = df.columns
    kept = df.groupBy(F.sha2(F.col(text), 256).alias("_digest")).agg(F.min_by(F.struct(*columns), order_by).alias("_first"))
    return kept.select("_first.*")


def keep_lengths(df: DataFrame, low: int | None = 10, high: int | None = None, text: str = "text") -> DataFrame:
    if low is not None:
        df = df.filter(F.length(text) >= low)
    if high is not None:
        df = df.filter(F.length(text) <= high)
    return df


def drop_missing(df: DataFrame, columns: tuple[str, ...] = ("text", "label")) -> DataFrame:
    return df.dropna(subset=list(columns))


def keep_language(df: DataFrame, language: str, column: str = "lang") -> DataFrame:
    return df.filter(F.col(column) == language)


def apply_filters(df: DataFrame, filters) -> DataFrame:
    """User filters, DataFrame to DataFrame, in order."""
    return reduce(lambda d, f: d.transform(f), filters, df)


def clean(df: DataFrame, rules: Cleaning, order_by: str = ROW) -> DataFrame:
    """Duplicates, then length, then missing values, then language and user filters."""
    if rules.remove_duplicates:
        df = drop_duplicate_texts(df, order_by)
    df = keep_lengths(df, rules.min_text_length, rules.max_text_length)
    if rules.remove_missing:
        df = drop_missing(df)
    if rules.language is not None:
        df = keep_language(df, rules.language)
    return apply_filters(df, rules.filters)


def validation_report(df: DataFrame, min_samples: int = 0, allowed: tuple[str, ...] | None = None, label: str = "label") -> DataFrame:
    """Per label: row count, whether there are enough rows, whether the label is in the domain."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    known = F.coalesce(F.col("label").isin(*allowed), F.lit(False)) if allowed else F.lit(True)
    return counts.withColumn("enough", F.col("n") >= min_samples).withColumn("known", known)


def require_valid(df: DataFrame, rules: Cleaning) -> DataFrame:
    """Fail when a class is too small or a label is outside the domain."""
    if rules.min_samples_per_class is None and rules.allowed_labels is None:
        return df
    report = validation_report(df, rules.min_samples_per_class or 0, rules.allowed_labels)
    bad = report.filter(~F.col("enough") | ~F.col("known")).collect()
    if bad:
        raise ValueError(f"labels failed validation: {[(r.label, r.n) for r in bad]}")
    return df
