"""Classification metrics, each from one small aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.operators.ordering import running_total


def _count(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0))


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1), b)


def binary_metrics(df: DataFrame, y: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 with class 1 as positive."""
    t, p = F.col(y), F.col(pred)
    counts = df.groupBy(*by).agg(
        _count((t == 1) & (p == 1)).alias("tp"),
        _count((t == 0) & (p == 0)).alias("tn"),
        _count((t == 0) & (p == 1)).alias("fp"),
        _count((t == 1) & (p == 0)).alias("fn"),
    )
    tp, tn, fp, fn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "tn", "fp", "fn"))
    total = F.col("precision") + F.col("recall")
    return (
        counts.withColumns({"tp": tp, "tn": tn, "fp": fp, "fn": fn})
        .withColumn("accuracy", _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
        .withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))))
    )


def roc_auc(df: DataFrame, y: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, one row (per ``by`` value); NaN when a class is absent.

    Rows are first counted per score, so ties cost nothing and get half credit.
    The running number of negatives is built per score range, not in one window.
    """
    per_score = df.groupBy(*by, F.col(score).alias("_score")).agg(
        _count(F.col(y) == 1).alias("_pos"), _count(F.col(y) == 0).alias("_neg")
    )
    ranked = running_total(per_score, "_score", "_neg", "_below", by)
    sums = ranked.groupBy(*by).agg(
        F.sum("_pos").alias("p"),
        F.sum("_neg").alias("n"),
        F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2)).alias("wins"),
    )
    both = F.col("p").cast("double") * F.col("n")
    return sums.select(*by, F.when(both > 0, F.col("wins") / both).otherwise(float("nan")).alias("auc"))


def classification_report(df: DataFrame, y: str = "label", pred: str = "pred", digits: int = 4) -> DataFrame:
    """Rows fake, real, accuracy, macro avg and weighted avg with precision, recall, f1 and support."""
    counts = binary_metrics(df, y, pred).select("tp", "tn", "fp", "fn", "accuracy")

    def safe(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))

    def block(hit: str, wrong: str, missed: str, tag: str) -> dict[str, Column]:
        h, w, m = F.col(hit), F.col(wrong), F.col(missed)
        return {
            f"p_{tag}": safe(h, h + w),
            f"r_{tag}": safe(h, h + m),
            f"f_{tag}": safe(2 * h, 2 * h + w + m),
            f"s_{tag}": h + m,
        }

    wide = counts.withColumns({**block("tn", "fn", "fp", "fake"), **block("tp", "fp", "fn", "real")})
    total = F.col("s_fake") + F.col("s_real")

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("row"),
            *[F.round(x, digits).alias(n) for n, x in (("precision", p), ("recall", r), ("f1", f))],
            s.cast("bigint").alias("support"),
        )

    def pooled(name: str, mean) -> Column:
        return row(name, *[mean(F.col(f"{m}_fake"), F.col(f"{m}_real")) for m in ("p", "r", "f")], total)

    acc = F.col("accuracy")
    rows = [row(c, *[F.col(f"{m}_{c}") for m in ("p", "r", "f", "s")]) for c in ("fake", "real")]
    rows.append(row("accuracy", acc, acc, acc, total))
    rows.append(pooled("macro avg", lambda a, b: (a + b) / 2))
    rows.append(pooled("weighted avg", lambda a, b: (a * F.col("s_fake") + b * F.col("s_real")) / F.greatest(F.lit(1), total)))
    return wide.select(F.inline(F.array(*rows)))


def pca_coordinates(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """First two principal coordinates of mean-centred features.

    Each axis points to where its largest loading is positive, so the sign is
    reproducible.
    """
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    centred = StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False).fit(ready).transform(ready)
    model = PCA(k=2, inputCol="_c", outputCol="_pc").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    at = vector_to_array("_pc")
    return model.transform(centred).select(*keep, (at[0] * signs[0]).alias("pc1"), (at[1] * signs[1]).alias("pc2"))
