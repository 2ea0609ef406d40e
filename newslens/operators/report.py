"""The record an expert reads about one text: decision, margin, what every feature added to it, and where in the text it shows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions.scalars import let
from newslens.operators.classify import Classifier
from newslens.operators.evidence import SPAN

MARKS = ("[[", "]]")
MARKED_FEATURES = ("SR", "UL")  # whose spans are single words of the text
NAMED_FEATURE = "FC"  # whose spans name sources that can be asked


def contributions(model: Classifier) -> Column:
    """``map<feature, weight * value>`` over calibrated columns; with the intercept they add up to the margin of a linear model."""
    if model.kind == "rbf_svm":
        raise ValueError("contributions of single features need a linear model")
    pairs = [x for c, w in zip(model.features, model.weights) for x in (F.lit(c), F.col(c).cast("double") * F.lit(float(w)))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


def merged_spans(spans: Column) -> Column:
    """Spans in order of their start, those that overlap joined into one; empty spans go."""

    def add(done: Column, s: Column) -> Column:
        def joined(last: Column) -> Column:
            longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
            kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
            return F.when(last.isNull() | (s["start"] >= last["end"]), F.concat(done, F.array(s))).otherwise(F.concat(kept, F.array(longer))).cast(SPAN)

        return let(F.get(done, F.size(done) - 1), joined)

    fine = F.filter(spans.cast(SPAN), lambda s: s["end"] > s["start"])
    return F.aggregate(F.array_sort(fine), F.array().cast(SPAN), add)


def highlighted(text: Column, spans: Column, marks: tuple[str, str] = MARKS) -> Column:
    """``text`` with ``marks`` around every span of a merged list; without the marks it is ``text`` again."""
    before, after = (F.lit(m) for m in marks)

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
        gap, word = F.substring(text, begin + 1, s["start"] - begin), F.substring(text, s["start"] + 1, s["end"] - s["start"])
        return F.concat(gap, before, word, after)

    end = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, end + 1, F.length(text)))


def report_records(scored: DataFrame, evidence: DataFrame, texts: DataFrame, model: Classifier, provenance: Mapping[str, str] | None = None, id_col: str = "id") -> DataFrame:
    """``(id, decision, features, annotated, sources, provenance)``, one row per scored id that has evidence and a text.

    ``scored`` holds calibrated feature columns, ``evidence`` the entries of :func:`with_evidence` as ``features``, ``texts``
    the ``text``. ``decision`` is (pred, margin, intercept); a feature entry is (name, value, calibrated, contribution, spans, notes),
    the measured value next to the calibrated one, and its contribution null if the model does not use it. ``annotated`` marks the words behind
    SR and UL, ``sources`` are the source phrases found in the text, to be asked. Ids must be unique; a null text is an empty one. The three tables
    meet by id, one row each, so no key is hot.
    """
    model_side = scored.select(id_col, F.struct(*[F.col(c).cast("double").alias(c) for c in model.features]).alias("_x"), contributions(model).alias("_c"), model.margin().alias("_m"))
    both = model_side.join(evidence.select(id_col, "features"), id_col).join(texts.select(id_col, F.coalesce("text", F.lit("")).alias("_text")), id_col)
    calibrated = F.create_map(*[x for c in model.features for x in (F.lit(c), F.col("_x")[c])])
    table = F.transform(
        "features",
        lambda f: F.struct(
            f["name"].alias("name"),
            f["value"].alias("value"),
            F.try_element_at(F.col("_k"), f["name"]).alias("calibrated"),
            F.try_element_at(F.col("_c"), f["name"]).alias("contribution"),
            f["evidence"]["spans"].alias("spans"),
            f["evidence"]["notes"].alias("notes"),
        ),
    )
    spans_of = lambda names: F.flatten(F.transform(F.filter("features", lambda f: f["name"].isin(*names)), lambda f: f["evidence"]["spans"]))
    named = F.transform(spans_of((NAMED_FEATURE,)), lambda s: F.lower(F.substring(F.col("_text"), s["start"] + 1, s["end"] - s["start"])))
    facts = [x for k, v in sorted((provenance or {}).items()) for x in (F.lit(k), F.lit(str(v)))]
    decision = F.struct((F.col("_m") > 0).cast("int").alias("pred"), F.col("_m").alias("margin"), F.lit(float(model.intercept)).alias("intercept"))
    return both.withColumns({"_k": calibrated, "_spans": merged_spans(spans_of(MARKED_FEATURES))}).select(
        id_col,
        decision.alias("decision"),
        table.alias("features"),
        highlighted(F.col("_text"), F.col("_spans")).alias("annotated"),
        F.array_distinct(named).alias("sources"),
        (F.create_map(*facts) if facts else F.create_map().cast("map<string,string>")).alias("provenance"),
    )
