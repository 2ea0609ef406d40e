"""Evidence spans and the per-article evidence record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.config import FACT_KEYWORDS, Lexicons
from newslens.functions import text as tx
from newslens.functions.scalars import let
from newslens.operators.features import in_lexicon, is_subjective, keyword_hits, quote_count

SPAN = "array<struct<start:int,end:int>>"
# How many spans a record keeps by default, and the notes of each feature.
MAX_TOKEN_SPANS, MAX_KEYWORD_SPANS = 30, 10
NOTES = {
    "PR": "pairwise cosine mean",
    "SR": "lexicon+suffix heuristic",
    "HS": "cosine(title, lead)",
    "UL": "lexicon match",
    "SP": "lexicon polarity mean",
    "NC": "1 - var(sentiment)",
    "SQ": "quote share + count",
    "FC": "keyword match",
}


def spaced_words(text: Column, squeezed: Column) -> Column:
    """Words together with the white space in front of them; joined they are the text.

    Text whose words are one character apart splits like its squeezed form.
    """
    regular = F.split(squeezed, "(?= )")
    irregular = F.split(text, f"(?<=[^{tx.SPACE[1:-1]}])(?={tx.SPACE})")
    return F.when(F.length(text) == F.length(squeezed), regular).otherwise(irregular)


def token_spans(cleaned: Column, spaced: Column, test, limit: int | None = MAX_TOKEN_SPANS) -> Column:
    """Character offsets of the first ``limit`` words (None: of all) whose cleaned form passes ``test``.

    Offsets are exact for any spacing: a word ends where the text up to it ends.
    """
    numbered = F.transform(cleaned, lambda w, i: F.when(test(w), i))
    return spans_at(F.filter(numbered, lambda i: i.isNotNull()), spaced, limit)


def spans_at(hits: Column, spaced: Column, limit: int | None = MAX_TOKEN_SPANS) -> Column:
    """Character offsets of the words at the first ``limit`` of the ascending places ``hits``.

    Every slice reads its whole array, so the words after the last of those places are cut off first.
    """
    hits = hits if limit is None else F.slice(hits, 1, limit)
    begin = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def walk(places: Column, pieces: Column) -> Column:
        def advance(state: Column, i: Column) -> Column:
            passed = F.slice(pieces, state["seen"] + 1, i + 1 - state["seen"])
            end = state["at"] + F.length(F.array_join(passed, ""))

            def step(end: Column) -> Column:
                start = end - F.length(tx.squeeze(F.get(pieces, i)))
                span = F.array(F.struct(start.alias("start"), end.alias("end")))
                spans = F.concat(state["spans"], span).cast(SPAN)
                return F.struct((i + 1).alias("seen"), end.alias("at"), spans.alias("spans"))

            return let(end, step)

        return F.aggregate(places, begin, advance, lambda state: state["spans"])

    def reached(places: Column) -> Column:
        return F.slice(spaced, 1, F.coalesce(F.get(places, F.size(places) - 1), F.lit(-1)) + 1)

    return let(hits, lambda places: let(reached(places), lambda pieces: walk(places, pieces)))


def keyword_spans(text: Column, limit: int | None = MAX_KEYWORD_SPANS) -> Column:
    """First place of every keyword that occurs, in keyword order."""

    def places(lowered: Column) -> Column:
        return F.array(*[F.struct((F.instr(lowered, k) - 1).alias("start"), F.lit(len(k)).alias("n")) for k in FACT_KEYWORDS])

    found = F.filter(let(F.lower(text), places), lambda p: p["start"] >= 0)
    spans = F.transform(found, lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["n"]).alias("end")))
    return spans if limit is None else F.slice(spans, 1, limit)


def _entry(name: str, spans: Column | None = None, notes: Column | None = None, **meta: Column) -> Column:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(name).alias("name"),
        F.col(name).cast("double").alias("value"),
        F.struct(
            (F.array() if spans is None else spans).cast(SPAN).alias("spans"),
            (F.lit(NOTES[name]) if notes is None else notes).alias("notes"),
            F.array().cast("array<string>").alias("links"),
        ).alias("evidence"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("meta"),
    )


def with_evidence(
    df: DataFrame,
    text: str = "text",
    lex: Lexicons | None = None,
    fact: bool = True,
    subjectivity_threshold: float = 0.5,
    max_token_spans: int | None = MAX_TOKEN_SPANS,
    max_keyword_spans: int | None = MAX_KEYWORD_SPANS,
    table_size: int | None = None,
) -> DataFrame:
    """Add ``evidence``, one entry per feature, to a frame that holds the feature columns, ``_squeezed``,
    ``_sents`` and ``_words``.

    ``subjectivity_threshold`` is only echoed into the record. With ``table_size``, the number of unusual words of a
    verdict table, the places come from ``_subjective`` and ``_unusual`` (see ``table_features``) instead of ``lex``.
    """
    lex = lex or Lexicons()
    if table_size is None:
        subjective = token_spans(F.col("_words"), F.col("_spaced"), lambda w: is_subjective(w, lex), max_token_spans)
        unusual = token_spans(F.col("_words"), F.col("_spaced"), lambda w: in_lexicon(w, lex.unusual), max_token_spans)
        table_size = len({w.strip().lower() for w in lex.unusual if w.strip()})
    else:
        subjective = spans_at(F.col("_subjective"), F.col("_spaced"), max_token_spans)
        unusual = spans_at(F.col("_unusual"), F.col("_spaced"), max_token_spans)
    raw = F.coalesce(F.col(text), F.lit(""))
    n = F.size("_sents")
    empty = F.when(n == 0, "empty text")
    entries = [
        _entry("PR", notes=F.when(n < 2, "single sentence").otherwise(NOTES["PR"]), pairs=F.expr("size(_sents) * (size(_sents) - 1) div 2")),
        _entry(
            "SR",
            subjective,
            threshold=F.lit(str(subjectivity_threshold)),
        ),
        _entry("HS"),
        _entry(
            "UL",
            unusual,
            lexicon_size=F.lit(table_size),
        ),
        _entry("SP", notes=F.coalesce(empty, F.lit(NOTES["SP"])), n_sents=n),
        _entry("NC", notes=F.coalesce(empty, F.lit(NOTES["NC"]))),
        _entry("SQ", n_quotes=quote_count(raw)),
    ]
    if fact:
        entries.append(
            _entry("FC", keyword_spans(raw, max_keyword_spans), keywords_checked=F.lit(len(FACT_KEYWORDS)), hits=keyword_hits(raw))
        )
    spaced = df.withColumn("_spaced", spaced_words(raw, F.col("_squeezed")))
    return spaced.withColumn("evidence", F.array(*entries)).drop("_spaced")
