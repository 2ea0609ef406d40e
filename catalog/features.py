"""Embedding space, interpretable features and evidence."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from catalog.common import (
    ARTICLES,
    DOCS,
    LEX,
    SETTINGS,
    SPACE,
    articles,
    documents,
    first_sentence,
    sql_clean,
    sql_in,
    sql_sentences,
    sql_squeeze,
    sql_words,
    table,
)
from newslens.config import FACT_KEYWORDS, FEATURE_ORDER
from newslens.functions import text as tx
from newslens.functions.encoders import pick_encoder
from newslens.functions.scalars import cosine
from newslens.operators.classify import Classifier
from newslens.operators.embedding import text_vectors, with_document_vectors
from newslens.operators.features import lexical_features, lexicon_hits, with_text_parts
from newslens.operators.lexicon_tables import store_verdicts, table_features, verdict_table
from newslens.operators.report import report_records
from newslens.plans.training import article_evidence, article_features
from newslens.runtime import materialize, scratch_path, spread

FEATURES = (*FEATURE_ORDER, "FC")


def _docs(spark, sf):
    return spread(documents(spark, sf).select("doc_id", "text", "lang", "source"), "doc_id")


def _nonzero(df, vector="A"):
    """Long form of a vector column."""
    pos = df.select("doc_id", F.posexplode(vector).alias("dim", "v")).filter("v <> 0")
    return pos.select("doc_id", "dim", F.round(F.col("v").cast("double"), 6).alias("value"))


def hash_vectors(spark, sf):
    return _nonzero(_docs(spark, sf).select("doc_id", text_vectors()("text").alias("A")))


def shape_model():
    """A stand-in for a pretrained encoder: words, characters and one, normalised."""

    def encode(texts):
        raw = np.array([[len(t.split()), len(t), 1.0] for t in texts], dtype=float)
        return raw / np.linalg.norm(raw, axis=1, keepdims=True)

    return encode


def model_vectors(spark, sf):
    encoder = pick_encoder("auto", shape_model)
    return _nonzero(_docs(spark, sf).select("doc_id", text_vectors(encoder)("text").alias("A")))


def vector_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


def _document_vectors(spark, sf, weights):
    parts = with_text_parts(_docs(spark, sf))
    titled = parts.withColumn("_title", F.get("_sents", 0)).withColumn("_lead", tx.lead(F.col("_sents")))
    return with_document_vectors(titled, "_title", "_lead", "_sents", weights=weights)


def body_vectors(spark, sf):
    return _nonzero(_document_vectors(spark, sf, (0.0, 0.0, 1.0)))


def document_vectors(spark, sf):
    return _nonzero(_document_vectors(spark, sf, SETTINGS.weights))


def similarity_feature(name):
    def query(spark, sf):
        return _document_vectors(spark, sf, SETTINGS.weights).select("doc_id", F.round(name, 6).alias(name))

    return query


def lexical_feature(name):
    def query(spark, sf):
        return lexical_features(_docs(spark, sf), "text", LEX).select("doc_id", F.round(name, 9).alias(name))

    return query


def lexicon_table_share(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", r"[ \n]")).alias("word"))
    hits = lexicon_hits(_docs(spark, sf), words, "doc_id")
    return hits.select("doc_id", "hits", "tokens", F.round("share", 6).alias("share"))


# Lexicon tables made of the words of the corpus: the first hex digit of a word's md5 says which lexicons hold it.
DIGITS = {"positive": "0123", "negative": "34567", "unusual": "789a"}


def _verdicts(spark, sf):
    words = documents(spark, sf).select(F.explode(tx.clean_words(tx.squeeze("text"))).alias("word")).filter("word <> ''").distinct()
    digit = F.substring(F.md5("word"), 1, 1)
    words = materialize(words, "corpus-words")
    return verdict_table(*[words.filter(digit.isin(*DIGITS[k])) for k in ("positive", "negative", "unusual")])


def table_feature(name):
    def query(spark, sf):
        return table_features(_docs(spark, sf), _verdicts(spark, sf), "doc_id").select("doc_id", F.round(name, 9).alias(name))

    return query


def table_spans(spark, sf):
    """Spans of a run whose lexicons are a stored table."""
    settings = replace(SETTINGS, lexicon_table=store_verdicts(_verdicts(spark, sf), scratch_path(spark, "lexicons")))
    return _unfold(materialize(article_evidence(articles(spark, sf), settings), "evidence"))


def _evidence(spark, sf):
    """The evidence table as a run stores it; readers unfold the stored table."""
    return materialize(article_evidence(articles(spark, sf), SETTINGS), "evidence")


def evidence_spans(spark, sf):
    return _unfold(_evidence(spark, sf))


def _unfold(evidence):
    entries = evidence.select("id", F.explode("features").alias("f"))
    spans = entries.select("id", F.col("f.name").alias("name"), F.posexplode("f.evidence.spans").alias("pos", "s"))
    return spans.select("id", "name", "pos", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def evidence_records(spark, sf):
    entries = _evidence(spark, sf).select("id", F.posexplode("features").alias("pos", "f"))
    return entries.select(
        "id",
        "pos",
        F.col("f.name").alias("name"),
        F.round("f.value", 6).alias("value"),
        F.col("f.evidence.notes").alias("notes"),
        F.size("f.evidence.spans").alias("n_spans"),
        F.array_join(F.transform(F.sort_array(F.map_entries("f.meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("meta"),
    )


def feature_means(spark, sf):
    feats = article_features(articles(spark, sf), SETTINGS)
    return feats.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in FEATURES]
    )


# A stated linear rule over raw features.
RULE = Classifier("linear_svm", ("SR", "SP", "SQ", "FC"), (2.0, 1.0, -1.5, 0.5), -0.75)


def report(spark, sf):
    """Report records unfolded: decision, contributions, digest of the marked text, named sources."""
    rows = articles(spark, sf)
    features = materialize(article_features(rows, SETTINGS, evidence=True), "evidence")
    records = report_records(features, features.select("id", F.col("evidence").alias("features")), rows, RULE, {"settings": SETTINGS.digest()})
    of = lambda n: F.filter("features", lambda f: f["name"] == n)[0]["contribution"]
    added = [(F.round(of(n), 6) + F.lit(0.0)).alias(f"add_{n}") for n in RULE.features]
    return records.select("id", "decision.pred", F.round("decision.margin", 6).alias("margin"), *added, F.md5("annotated").alias("annotated_md5"), F.array_join("sources", ",").alias("sources"))


QUERIES = {
    "e1_hash_vectors": hash_vectors,
    "e2_model_vectors": model_vectors,
    "e3_cosine": vector_cosine,
    "e4_body_mean": body_vectors,
    "e5_document_vectors": document_vectors,
    "f1_paraphrasing": similarity_feature("PR"),
    "f2_subjectivity": lexical_feature("SR"),
    "f3_headline_coherence": similarity_feature("HS"),
    "f4_unusual_language": lexical_feature("UL"),
    "f4_lexicon_table_share": lexicon_table_share,
    "f2_table_subjectivity": table_feature("SR"),
    "f4_table_unusual_language": table_feature("UL"),
    "f5_table_polarity": table_feature("SP"),
    "f6_table_consistency": table_feature("NC"),
    "f9_table_spans": table_spans,
    "f5_sentiment_polarity": lexical_feature("SP"),
    "f6_narrative_consistency": lexical_feature("NC"),
    "f7_selective_quoting": lexical_feature("SQ"),
    "f8_fact_confirmation": lexical_feature("FC"),
    "f9_evidence_spans": evidence_spans,
    "f10_evidence_records": evidence_records,
    "x9_report_records": report,
    "f10_feature_means": feature_means,
}

_BUCKET = "(('0x' || substr(md5(t), 17, 16))::UBIGINT & 511)::INT"


def _unit_buckets(source: str) -> str:
    """SQL: (keys, dim, v) of unit vectors from (keys..., text); keys are doc_id, part, no."""
    return f"""SELECT doc_id, part, no, dim, c / (sqrt(sum(c * c) OVER (PARTITION BY doc_id, part, no)) + 1e-12) AS v FROM (
      SELECT doc_id, part, no, {_BUCKET} AS dim, count(*)::DOUBLE AS c FROM (
        SELECT doc_id, part, no, unnest({sql_words('sq')}) AS t FROM (
          SELECT doc_id, part, no, {sql_squeeze('lower(text)')} AS sq FROM {source})) GROUP BY ALL)"""


def vector_ctes(docs: str = "parts", key: str = "doc_id") -> str:
    """CTEs sent, pieces, unit, docvec inputs over a relation with (key, sents)."""
    return f"""base AS (SELECT {key} AS doc_id, sents, len(sents) AS n FROM {docs}),
sent AS (SELECT doc_id, n, unnest(sents) AS text, generate_subscripts(sents, 1) AS no FROM base),
pieces AS (SELECT doc_id, 'title' AS part, 0 AS no, sents[1] AS text FROM base
  UNION ALL SELECT doc_id, 'lead', 0, array_to_string(sents[1:2], ' ') FROM base
  UNION ALL SELECT doc_id, 'body', no, text FROM sent),
unit AS MATERIALIZED ({_unit_buckets('pieces')})"""


def document_vector_sql(wt: float, wl: float, wb: float) -> str:
    return f"""WITH {DOCS}, {vector_ctes()},
z AS (SELECT u.doc_id, u.dim, sum(CASE part WHEN 'title' THEN {wt} * v WHEN 'lead' THEN {wl} * v
    ELSE {wb} * CASE WHEN u.no <= 80 THEN v ELSE 0 END / least(n, 80) END) AS z
  FROM unit u JOIN base b USING (doc_id) GROUP BY u.doc_id, u.dim)
SELECT doc_id, dim, round(CAST(z / (sqrt(sum(z * z) OVER (PARTITION BY doc_id)) + 1e-12) AS FLOAT)::DOUBLE, 6) AS value
FROM z WHERE z <> 0"""


_PR = """pr AS (SELECT b.doc_id, CASE WHEN n < 2 THEN 0.0 ELSE greatest(0.0, least(1.0,
    (coalesce(q.q, 0) - coalesce(k.k, 0)) / (n * (n - 1)))) END AS PR FROM base b
  LEFT JOIN (SELECT doc_id, sum(s * s) AS q FROM (SELECT doc_id, dim, sum(v) AS s FROM unit WHERE part = 'body' GROUP BY ALL) GROUP BY doc_id) q USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(DISTINCT no) AS k FROM unit WHERE part = 'body' GROUP BY doc_id) k USING (doc_id))"""
_HS = """hs AS (SELECT b.doc_id, greatest(0.0, least(1.0, coalesce(s.d, 0))) AS HS FROM base b LEFT JOIN (
    SELECT t.doc_id, sum(t.v * l.v) AS d FROM unit t JOIN unit l ON t.doc_id = l.doc_id AND t.dim = l.dim AND t.part = 'title' AND l.part = 'lead'
    GROUP BY t.doc_id) s USING (doc_id))"""


def lexical_ctes(docs: str = "parts", key: str = "doc_id") -> str:
    """CTE lex(doc_id, SR, UL, SP, NC, SQ, FC) over a relation with (key, text, sents, words)."""
    pos, neg, unusual = sql_in(LEX.positive), sql_in(LEX.negative), sql_in(LEX.unusual)
    score = lambda s: (
        f"list_transform({s}, lambda ws: 0.5 * ((len(list_filter(ws, lambda x: x IN {pos})) - len(list_filter(ws, lambda x: x IN {neg})))::DOUBLE"
        f" / greatest(1, len(list_filter(ws, lambda x: x IN {pos} OR x IN {neg}))) + 1.0))"
    )
    hits = " + ".join(f"contains(lower(text), '{k}')::INT" for k in FACT_KEYWORDS)
    return f"""tok AS (SELECT {key} AS doc_id, text, sents, words, {sql_clean('words')} AS cw,
    list_transform(sents, lambda s: {sql_clean("string_split(s, ' ')")}) AS sw FROM {docs}),
scored AS (SELECT *, {score('sw')} AS sc,
    length(text) - length(replace(text, '"', '')) AS q1, length(text) - length(replace(text, '“', '')) AS q2,
    length(text) - length(replace(text, '”', '')) AS q3 FROM tok),
lex AS (SELECT doc_id,
  len(list_filter(cw, lambda x: x IN {pos} OR x IN {neg} OR x LIKE '%ly' OR x LIKE '%ive' OR x LIKE '%ous'))::DOUBLE / greatest(1, len(cw)) AS SR,
  len(list_filter(cw, lambda x: x IN {unusual}))::DOUBLE / greatest(1, len(cw)) AS UL,
  coalesce(list_avg(sc), 0.0) AS SP,
  coalesce(1.0 - list_var_pop(sc), 1.0) AS NC,
  greatest(0.0, least(1.0, 0.7 * len(list_filter(words, lambda x: starts_with(x, '"') OR ends_with(x, '"') OR contains(x, '“') OR contains(x, '”')))::DOUBLE
    / greatest(1, len(words)) + 0.3 * (1.0 - exp(-(q1 // 2 + q2 // 2 + q3 // 2)::DOUBLE)))) AS SQ,
  CASE WHEN {hits} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS FC,
  {hits} AS fc_hits, q1 // 2 + q2 // 2 + q3 // 2 AS n_quotes FROM scored)"""


def _lex(name: str) -> str:
    return f"WITH {DOCS}, {lexical_ctes()} SELECT doc_id, round({name}, 9) AS {name} FROM lex"


ART_PARTS = f"{ARTICLES}, aparts AS (SELECT *, {sql_sentences('sq')} AS sents, {sql_words('sq')} AS words FROM art)"
ART_FEATURES = f"""{ART_PARTS}, {vector_ctes('aparts', 'id')}, {_PR}, {_HS}, {lexical_ctes('aparts', 'id')},
feat AS (SELECT l.doc_id AS id, a.label, a.source, PR, SR, HS, UL, SP, NC, l.SQ AS SQ, FC, fc_hits, n_quotes, len(a.sents) AS n
  FROM lex l JOIN pr USING (doc_id) JOIN hs USING (doc_id) JOIN aparts a ON a.id = l.doc_id)"""

_SPACED = f"regexp_extract_all(text, '{SPACE}*[^{SPACE[1:-1]}]+')"
_SPANS = f"""{ART_PARTS}, w AS (SELECT id, text, unnest({_SPACED}) AS p, generate_subscripts({_SPACED}, 1) AS i FROM aparts),
ends AS (SELECT id, i, trim(regexp_replace(p, '{SPACE}+', ' ', 'g')) AS t,
  sum(length(p)) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING)::INT AS e FROM w),
cleaned AS (SELECT id, i, length(t) AS len, e, lower(trim(t, '.,!?;:''"()[]{{}}')) AS c FROM ends),
hit AS (SELECT id, 'SR' AS name, i, len, e FROM cleaned WHERE c IN {sql_in(LEX.positive)} OR c IN {sql_in(LEX.negative)}
    OR c LIKE '%ly' OR c LIKE '%ive' OR c LIKE '%ous'
  UNION ALL SELECT id, 'UL', i, len, e FROM cleaned WHERE c IN {sql_in(LEX.unusual)}),
tokspan AS (SELECT id, name, (row_number() OVER (PARTITION BY id, name ORDER BY i) - 1)::INT AS pos, (e - len)::INT AS s, e FROM hit QUALIFY pos < 30),
kw AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(FACT_KEYWORDS))}) k(ki, k)),
kwspan AS (SELECT id, 'FC' AS name, (row_number() OVER (PARTITION BY id ORDER BY ki) - 1)::INT AS pos,
  (instr(lower(text), k) - 1)::INT AS s, (instr(lower(text), k) - 1 + length(k))::INT AS e FROM aparts, kw WHERE contains(lower(text), k)),
spans AS (SELECT * FROM tokspan UNION ALL SELECT * FROM kwspan)"""

_RECORD = f"""{ART_FEATURES}, {_SPANS[len(ART_PARTS) + 2:]},
counted AS (SELECT id, name, count(*)::INT AS c FROM spans GROUP BY id, name),
long AS (
  SELECT id, 0 AS pos, 'PR' AS name, PR AS value, CASE WHEN n < 2 THEN 'single sentence' ELSE 'pairwise cosine mean' END AS notes, 'pairs=' || (n * (n - 1) // 2) AS meta FROM feat
  UNION ALL SELECT id, 1, 'SR', SR, 'lexicon+suffix heuristic', 'threshold=0.5' FROM feat
  UNION ALL SELECT id, 2, 'HS', HS, 'cosine(title, lead)', '' FROM feat
  UNION ALL SELECT id, 3, 'UL', UL, 'lexicon match', 'lexicon_size={len(LEX.unusual)}' FROM feat
  UNION ALL SELECT id, 4, 'SP', SP, CASE WHEN n = 0 THEN 'empty text' ELSE 'lexicon polarity mean' END, 'n_sents=' || n FROM feat
  UNION ALL SELECT id, 5, 'NC', NC, CASE WHEN n = 0 THEN 'empty text' ELSE '1 - var(sentiment)' END, '' FROM feat
  UNION ALL SELECT id, 6, 'SQ', SQ, 'quote share + count', 'n_quotes=' || n_quotes FROM feat
  UNION ALL SELECT id, 7, 'FC', FC, 'keyword match', 'hits=' || fc_hits || ';keywords_checked={len(FACT_KEYWORDS)}' FROM feat)"""



def _held(kind: str) -> str:
    return f"(c <> '' AND substr(md5(c), 1, 1) IN {sql_in(tuple(DIGITS[kind]))})"


_TABLE_WORDS = f"""WITH {DOCS}, s AS (SELECT doc_id, unnest(sents) AS s, generate_subscripts(sents, 1) AS no FROM parts),
w AS (SELECT doc_id, no, unnest({sql_clean("string_split(s, ' ')")}) AS c FROM s),
v AS (SELECT doc_id, no, {_held('positive')} AS pos, {_held('negative')} AS neg, {_held('unusual')} AS odd,
  c LIKE '%ly' OR c LIKE '%ive' OR c LIKE '%ous' AS suffix FROM w),
score AS (SELECT doc_id, no, 0.5 * ((sum(pos::INT) - sum(neg::INT))::DOUBLE / greatest(1, sum(pos::INT) + sum(neg::INT)) + 1.0) AS s
  FROM v GROUP BY doc_id, no)"""


def _table_share(name: str, test: str) -> str:
    return f"""{_TABLE_WORDS} SELECT doc_id, round(coalesce(x, 0.0), 9) AS {name} FROM docs
      LEFT JOIN (SELECT doc_id, sum(({test})::INT)::DOUBLE / count(*) AS x FROM v GROUP BY doc_id) USING (doc_id)"""


def _table_scores(name: str, value: str, none: float) -> str:
    return f"""{_TABLE_WORDS} SELECT doc_id, round(coalesce(x, {none}), 9) AS {name} FROM docs
      LEFT JOIN (SELECT doc_id, {value} AS x FROM score GROUP BY doc_id) USING (doc_id)"""


_TABLE_SPANS = _SPANS.replace(f"c IN {sql_in(LEX.positive)} OR c IN {sql_in(LEX.negative)}", f"{_held('positive')} OR {_held('negative')}").replace(
    f"c IN {sql_in(LEX.unusual)}", _held("unusual")
)

ORACLE = {
    "f2_table_subjectivity": _table_share("SR", "pos OR neg OR suffix"),
    "f4_table_unusual_language": _table_share("UL", "odd"),
    "f5_table_polarity": _table_scores("SP", "avg(s)", 0.0),
    "f6_table_consistency": _table_scores("NC", "1.0 - var_pop(s)", 1.0),
    "f9_table_spans": f"""WITH {_TABLE_SPANS} SELECT id, name, pos, s AS "start", e AS "end" FROM spans""",
    "e1_hash_vectors": f"""WITH one AS (SELECT doc_id, 'all' AS part, 0 AS no, text FROM documents), unit AS ({_unit_buckets('one')})
      SELECT doc_id, dim, round(CAST(v AS FLOAT)::DOUBLE, 6) AS value FROM unit""",
    "e2_model_vectors": f"""WITH raw AS (SELECT doc_id, len({sql_words(sql_squeeze('text'))})::DOUBLE AS w, length(text)::DOUBLE AS c FROM documents),
      n AS (SELECT *, sqrt(w * w + c * c + 1.0) AS norm FROM raw)
      SELECT doc_id, dim, round(CAST(x / norm AS FLOAT)::DOUBLE, 6) AS value FROM (
        SELECT doc_id, norm, 0 AS dim, w AS x FROM n UNION ALL SELECT doc_id, norm, 1, c FROM n UNION ALL SELECT doc_id, norm, 2, 1.0 FROM n)
      WHERE x <> 0""",
    "e3_cosine": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
      SELECT a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-12), 6) AS cosine
      FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    "e4_body_mean": document_vector_sql(0.0, 0.0, 1.0),
    "e5_document_vectors": document_vector_sql(0.2, 0.3, 0.5),
    "f1_paraphrasing": f"WITH {DOCS}, {vector_ctes()}, {_PR} SELECT doc_id, round(PR, 6) AS PR FROM pr",
    "f2_subjectivity": _lex("SR"),
    "f3_headline_coherence": f"WITH {DOCS}, {vector_ctes()}, {_HS} SELECT doc_id, round(HS, 6) AS HS FROM hs",
    "f4_unusual_language": _lex("UL"),
    "f4_lexicon_table_share": rf"""WITH {DOCS}, voc AS (SELECT DISTINCT lower(trim(w)) AS c FROM (
        SELECT unnest(string_split_regex(text, '[ \n]')) AS w FROM benchmark) WHERE trim(w) <> ''),
      w AS (SELECT doc_id, unnest({sql_clean('words')}) AS c FROM parts)
      SELECT doc_id, sum(CASE WHEN v.c IS NULL THEN 0 ELSE 1 END)::BIGINT AS hits, count(*) AS tokens,
        round(sum(CASE WHEN v.c IS NULL THEN 0 ELSE 1 END)::DOUBLE / count(*), 6) AS share
      FROM w LEFT JOIN voc v USING (c) GROUP BY doc_id""",
    "f5_sentiment_polarity": _lex("SP"),
    "f6_narrative_consistency": _lex("NC"),
    "f7_selective_quoting": _lex("SQ"),
    "f8_fact_confirmation": _lex("FC"),
    "f9_evidence_spans": f"""WITH {_SPANS} SELECT id, name, pos, s AS "start", e AS "end" FROM spans""",
    "x9_report_records": f"""WITH {ART_FEATURES}, {_SPANS[len(ART_PARTS) + 2:]},
      added AS (SELECT id, {', '.join(f'{w} * {c} AS add_{c}' for c, w in zip(RULE.features, RULE.weights))} FROM feat),
      marked AS (SELECT id, s, e, lag(e, 1, 0) OVER (PARTITION BY id ORDER BY s) AS b FROM (SELECT DISTINCT id, s, e FROM tokspan)),
      body AS (SELECT m.id, string_agg(substr(text, b + 1, s - b) || '[[' || substr(text, s + 1, e - s) || ']]', '' ORDER BY s) AS head, max(e) AS e
        FROM marked m JOIN art USING (id) GROUP BY m.id),
      named AS (SELECT id, string_agg(k, ',' ORDER BY ki) AS sources FROM aparts, kw WHERE contains(lower(text), k) GROUP BY id),
      total AS (SELECT *, {RULE.intercept} + {' + '.join(f'add_{c}' for c in RULE.features)} AS m FROM added)
      SELECT t.id, (m > 0)::INT AS pred, round(m, 6) AS margin, {', '.join(f'round(add_{c}, 6) + 0.0 AS add_{c}' for c in RULE.features)},
        md5(coalesce(b.head, '') || substr(a.text, coalesce(b.e, 0) + 1)) AS annotated_md5, coalesce(n.sources, '') AS sources
      FROM total t JOIN art a USING (id) LEFT JOIN body b USING (id) LEFT JOIN named n USING (id)""",
    "f10_evidence_records": f"""WITH {_RECORD} SELECT l.id, l.pos, l.name, round(l.value, 6) AS value, l.notes,
      coalesce(c.c, 0)::INT AS n_spans, l.meta FROM long l LEFT JOIN counted c USING (id, name)""",
    "f10_feature_means": f"""WITH {ART_FEATURES} SELECT label, count(*) AS n,
      {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in FEATURES)} FROM feat GROUP BY label""",
}
