"""Label maps and numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens.functions.text import SPACE

# Label vocabulary and its binary code.
FAKE_LABELS = ("fake", "false", "0", "f", "hoax", "rumor", "fabricated")
REAL_LABELS = ("real", "true", "1", "t", "genuine", "authentic", "verified")
LABEL_CODE = {"fake": 0, "real": 1}


def stripped(value: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def standard_label(label: Column) -> Column:
    """Free-form verdict to ``fake`` / ``real``; unknown verdicts stay, NULL stays NULL.

    Exact words win over contained words, and fake wins over real.
    """
    v = stripped(F.lower(label.cast("string")))
    return (
        F.when(v.isin(*FAKE_LABELS), "fake")
        .when(v.isin(*REAL_LABELS), "real")
        .when(v.contains("fake") | v.contains("false"), "fake")
        .when(v.contains("real") | v.contains("true"), "real")
        .otherwise(v)
    )


def label_code(label: Column) -> Column:
    """fake -> 0, real -> 1, anything else NULL."""
    return F.when(label == "fake", 0).when(label == "real", 1)


def label_name(code: Column) -> Column:
    return F.when(code == 0, "fake").when(code == 1, "real")


def strict_label_code(label: Column) -> Column:
    """As :func:`label_code`, but an unknown label fails the job."""
    v = F.lower(stripped(label))
    return F.coalesce(label_code(v), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(v, F.lit("NULL")))).cast("int"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, also inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(udf):
    """Keep the optimiser from copying a costly task function.

    ``explode`` and filters on its result would otherwise push a second copy of
    the call below the first one.
    """
    return udf.asNondeterministic()


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a 1e-12 guard, so a zero vector gives 0."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-12))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
