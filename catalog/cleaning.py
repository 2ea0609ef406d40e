"""Sources, sinks, standardising, cleaning and corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    ARTICLES,
    DOCS,
    articles,
    documents,
    named_articles,
    sql_clean,
    sql_sentences,
    sql_squeeze,
    table,
    first_sentence,
)
from newslens.config import Cleaning, DatasetSpec
from newslens.functions import text as tx
from newslens.functions.scalars import clip01, label_code, label_name, standard_label
from newslens.operators import corpus, standardize as st
from newslens.plans.datasets import process_custom, process_dataset, process_many
from newslens.runtime import scratch_path, spread
from newslens.sources import readers, writers


def _digests(*columns: str):
    return [F.md5(F.coalesce(c, F.lit("<null>"))).alias(f"{c}_md5") for c in columns]


def _files(spark, df, fmt: str) -> str:
    """Land a frame as text files, the state in which a user finds a dataset."""
    path = scratch_path(spark, f"land-{fmt}")
    if fmt == "json":
        df.write.json(path)
    else:
        df.write.options(**writers.CSV, sep="\t" if fmt == "tsv" else ",", extension=fmt).csv(path)
    return path


# ---- sources and sinks ----------------------------------------------------


def csv_source(spark, sf):
    path = _files(spark, documents(spark, sf).select("doc_id", "lang", "text"), "csv")
    df = readers.read_csv(spark, path, ["*.csv"])
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", *_digests("text"))


def tsv_source(spark, sf):
    path = _files(spark, table(spark, sf, "conversations"), "tsv")
    df = readers.read_tsv(spark, path, ["*.tsv"])
    return df.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", *_digests("text"))


def json_source(spark, sf):
    path = _files(spark, documents(spark, sf).select("doc_id", "lang", "text"), "json")
    df = readers.read_json(spark, path, ["*.json"], multiline=False)
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", *_digests("text"))


def two_file_source(spark, sf):
    path = scratch_path(spark, "two-file")
    writers.write_two_file(named_articles(spark, sf), path)
    df = readers.read_two_file(spark, path)
    return df.select(F.substring_index("id", "_", 1).alias("id_class"), "label", *_digests("title", "text"))


def sample_source(spark, sf):
    rows = named_articles(spark, sf).select("id", "title", "text", F.concat(F.lit(" "), F.upper("label")).alias("label"))
    path = _files(spark, rows, "csv")
    return readers.read_sample(spark, path).select(F.col("id").cast("bigint").alias("id"), "label", *_digests("title", "text"))


def format_dispatch(spark, sf):
    out = []
    for fmt in ("csv", "tsv", "json"):
        path = _files(spark, documents(spark, sf).select("doc_id", "text"), fmt)
        df = readers.read_dataset(spark, DatasetSpec("d", (f"*.{fmt}",), fmt), path, multiline=fmt != "json")
        out.append(df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).withColumn("format", F.lit(fmt)))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _spec(name="docs", **kw):
    return DatasetSpec(name, ("*.csv",), "csv", ("text",), "label", "title", None, **kw)


def processed_sink(spark, sf):
    raw = _files(spark, named_articles(spark, sf).select("title", "text", "label"), "csv")
    out = scratch_path(spark, "processed")
    process_dataset(spark, _spec(cleaning=Cleaning(min_text_length=50)), raw, out)
    return writers.read_processed(spark, out).select("source", "label", *_digests("title", "text"))


def integrate(spark, sf):
    out = scratch_path(spark, "processed")
    df = named_articles(spark, sf).select("title", "text", "label")
    writers.write_processed(df, out, "first")
    writers.write_processed(df.filter("label = 'real'"), out, "second")
    merged = writers.integrate(spark, out, scratch_path(spark, "merged"))
    return spark.read.parquet(merged).select(F.col("label").cast("string").alias("label"), *_digests("title", "text"))


def lexicon_source(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", r"[ \n]")).alias("w"))
    lines = words.select(F.concat(F.lit("  "), "w", F.lit(" ")).alias("value"))
    path = scratch_path(spark, "lexicon")
    lines.unionByName(lines.select(F.lit("   ").alias("value"))).write.text(path)
    return readers.read_lexicon(spark, path)


# ---- projections ----------------------------------------------------------


def standardize(spark, sf):
    raw = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    spec = DatasetSpec("docs", (), "csv", ("text", "lang"), "toxic")
    df = st.standardize(raw, spec, order_by="doc_id")
    return df.select("id", "source", "title", "label", *_digests("text"))


VERDICTS = (" FAKE ", "False", "0", "f", "hoax", "Rumor", "fabricated", "REAL", "true", "1", "T", "genuine", "authentic",
            "verified", "barely-true", "mostly-false", "pants-fire", "Unreal", "not fake but real", "half")


def _verdicts(spark, sf):
    pick = F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), (F.col("doc_id") % len(VERDICTS) + 1).cast("int"))
    return documents(spark, sf).select("doc_id", pick.alias("verdict"))


def standard_labels(spark, sf):
    return _verdicts(spark, sf).select("doc_id", standard_label(F.col("verdict")).alias("label"))


def label_codes(spark, sf):
    df = _verdicts(spark, sf).select("doc_id", label_code(standard_label(F.col("verdict"))).alias("code"))
    return df.withColumn("name", label_name(F.col("code")))


def _texts(spark, sf):
    return spread(documents(spark, sf).select("doc_id", "text"), "doc_id")


def _sents(text="text"):
    return tx.pieces(tx.mark_sentences(tx.squeeze(F.col(text))), "\n")


def sentence_split(spark, sf):
    df = _texts(spark, sf).select("doc_id", _sents().alias("s"))
    return df.select("doc_id", F.size("s").alias("n_sents"), F.md5(F.array_join("s", "\n")).alias("sents_md5"))


def lead_body(spark, sf):
    df = _texts(spark, sf).select("doc_id", _sents().alias("s"))
    return df.select(
        "doc_id", F.md5(tx.lead(F.col("s"))).alias("lead_md5"), F.size(tx.body(F.col("s"))).alias("n_body"),
        F.md5(F.array_join(tx.body(F.col("s")), "\n")).alias("body_md5"),
    )


def clean_words(spark, sf):
    df = _texts(spark, sf).select("doc_id", tx.clean_words(tx.squeeze(F.col("text"))).alias("w"))
    return df.select(
        "doc_id", F.size("w").alias("n_words"), tx.count_where(F.col("w"), lambda w: w == "").alias("n_empty"),
        F.md5(F.array_join("w", " ")).alias("words_md5"),
    )


def lower_words(spark, sf):
    df = _texts(spark, sf).select("doc_id", tx.lower_words(F.col("text")).alias("w"))
    return df.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


def clip_unit(spark, sf):
    return documents(spark, sf).select("doc_id", F.round(clip01((F.col("n_chars") - 1000) / 2000), 6).alias("clipped"))


# ---- row-level quality ----------------------------------------------------


def first_of_duplicates(spark, sf):
    return st.drop_duplicate_texts(documents(spark, sf), "doc_id").select("doc_id", "source", "n_chars")


def min_length(spark, sf):
    return st.keep_lengths(documents(spark, sf), 200).select("doc_id", "n_chars")


def missing_rows(spark, sf):
    joined = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").withColumn("label", F.col("quality"))
    return st.drop_missing(joined).select("doc_id", "label")


def user_filters(spark, sf):
    filters = (lambda d: d.filter("n_chars % 2 = 0"), lambda d: d.filter(F.col("source") != "src3"))
    return st.apply_filters(documents(spark, sf), filters).select("doc_id", "source")


def cleaning_order(spark, sf):
    joined = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").withColumn("label", F.col("quality"))
    rules = Cleaning(remove_duplicates=True, min_text_length=200, filters=(lambda d: d.filter("lang <> 'de'"),))
    return st.clean(joined, rules, "doc_id").select("doc_id", "label", "lang")


def quality_settings(spark, sf):
    joined = documents(spark, sf).withColumn("label", F.col("source"))
    rules = Cleaning(min_text_length=100, max_text_length=5000, language="en")
    return st.clean(joined, rules, "doc_id").select("doc_id", "lang", "n_chars")


def label_validation(spark, sf):
    return st.validation_report(documents(spark, sf), 50, ("src1", "src2", "src8"), "source")


# ---- corpus ---------------------------------------------------------------


def _three(spark, sf):
    docs = documents(spark, sf).select("text", F.lit("documents").alias("source"))
    talk = table(spark, sf, "conversations").select("text", F.lit("conversations").alias("source"))
    bench = table(spark, sf, "benchmark").select("text", F.lit("benchmark").alias("source"))
    return corpus.combine([docs, talk, bench])


def combine(spark, sf):
    return _three(spark, sf).select("source", *_digests("text"))


def balance(spark, sf):
    return corpus.balance(named_articles(spark, sf)).select("id", "label")


def statistics(spark, sf):
    """All documents; those without a label count everywhere but in the label histogram."""
    quality = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "real").when(F.col("quality") == 0, "fake").alias("label"))
    every = documents(spark, sf).join(quality, "doc_id", "left")
    titled = every.select("text", "source", "label", first_sentence(F.col("text")).alias("title"))
    return corpus.statistics(titled).withColumn("value", F.round("value", 6))


def many_datasets(spark, sf):
    df = named_articles(spark, sf).select("title", "text", "label")
    registry = {n: _spec(n) for n in ("a", "b", "lost")}
    folders = {"a": _files(spark, df, "csv"), "b": _files(spark, df.filter("label = 'fake'"), "csv"), "lost": scratch_path(spark, "none")}
    status, merged = process_many(spark, "all", folders, scratch_path(spark, "processed"), registry, combined=True, balanced=False)
    counts = merged.groupBy("source", "label").agg(F.count(F.lit(1)).alias("rows"))
    failed = status.filter("status = 'failed'").select(F.col("dataset").alias("source"), F.col("status").alias("label"), F.lit(0).cast("bigint").alias("rows"))
    return counts.unionByName(failed)


def custom_dataset(spark, sf):
    raw = named_articles(spark, sf).select(F.col("text").alias("content"), F.col("title").alias("headline"), F.upper("label").alias("veracity"))
    df = process_custom(spark, _files(spark, raw, "csv"), ["content"], "veracity", "headline", name="mine")
    return df.select("source", "label", *_digests("title", "text"))


QUERIES = {
    "s1_csv_source": csv_source,
    "s2_tsv_source": tsv_source,
    "s3_json_source": json_source,
    "s4_two_file_source": two_file_source,
    "s5_sample_source": sample_source,
    "s6_format_dispatch": format_dispatch,
    "s7_processed_sink": processed_sink,
    "s8_integrate": integrate,
    "s11_lexicon_source": lexicon_source,
    "p1_standardize": standardize,
    "p2_standard_label": standard_labels,
    "p3_label_code": label_codes,
    "p4_sentences": sentence_split,
    "p5_lead_body": lead_body,
    "p6_clean_words": clean_words,
    "p7_lower_words": lower_words,
    "p9_clip_unit": clip_unit,
    "q1_first_of_duplicates": first_of_duplicates,
    "q2_min_length": min_length,
    "q3_drop_missing": missing_rows,
    "q4_user_filters": user_filters,
    "q5_cleaning_order": cleaning_order,
    "q6_quality_settings": quality_settings,
    "q6_label_validation": label_validation,
    "u1_combine": combine,
    "u2_balance": balance,
    "u3_statistics": statistics,
    "u5_many_datasets": many_datasets,
    "u6_custom_dataset": custom_dataset,
}

_ART = f"""{ARTICLES}, named AS (
  SELECT id, text, source, CASE WHEN label = 1 THEN 'real' ELSE 'fake' END AS label, {sql_sentences('sq')}[1] AS title, sq FROM art)"""
_VERDICT = "CASE doc_id % {n} {whens} END".format(
    n=len(VERDICTS), whens=" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VERDICTS))
)
_LABELLED = f"""v AS (SELECT doc_id, lower(trim({_VERDICT})) AS v FROM documents), lab AS (SELECT doc_id, CASE
  WHEN v IN ('fake','false','0','f','hoax','rumor','fabricated') THEN 'fake'
  WHEN v IN ('real','true','1','t','genuine','authentic','verified') THEN 'real'
  WHEN contains(v, 'fake') OR contains(v, 'false') THEN 'fake'
  WHEN contains(v, 'real') OR contains(v, 'true') THEN 'real' ELSE v END AS label FROM v)"""

ORACLE = {
    "s1_csv_source": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "s2_tsv_source": "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations",
    "s3_json_source": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "s4_two_file_source": f"""WITH {_ART} SELECT label AS id_class, CASE label WHEN 'real' THEN 1 ELSE 0 END AS label,
      md5(title) AS title_md5, md5(text) AS text_md5 FROM named""",
    "s5_sample_source": f"""WITH {_ART} SELECT id, CASE label WHEN 'real' THEN 1 ELSE 0 END AS label,
      md5(title) AS title_md5, md5(text) AS text_md5 FROM named""",
    "s6_format_dispatch": """SELECT count(*) AS n, sum(length(text))::BIGINT AS chars, 'csv' AS format FROM documents
      UNION ALL SELECT count(*), sum(length(text))::BIGINT, 'tsv' FROM documents
      UNION ALL SELECT count(*), sum(length(text))::BIGINT, 'json' FROM documents""",
    "s7_processed_sink": f"""WITH {_ART} SELECT 'docs' AS source, label, md5(title) AS title_md5, md5(text) AS text_md5
      FROM named WHERE length(text) >= 50""",
    "s8_integrate": f"""WITH {_ART} SELECT label, md5(title) AS title_md5, md5(text) AS text_md5 FROM named
      UNION ALL SELECT label, md5(title), md5(text) FROM named WHERE label = 'real'""",
    "s11_lexicon_source": r"""SELECT DISTINCT lower(trim(w)) AS word FROM (
      SELECT unnest(string_split_regex(text, '[ \n]')) AS w FROM benchmark) WHERE trim(w) <> ''""",
    "p1_standardize": """SELECT 'docs_' || (row_number() OVER (ORDER BY d.doc_id) - 1) AS id, 'docs' AS source, '' AS title,
      CASE l.toxic WHEN 0 THEN 'fake' WHEN 1 THEN 'real' END AS label, md5(d.text || ' ' || d.lang) AS text_md5
      FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "p2_standard_label": f"WITH {_LABELLED} SELECT doc_id, label FROM lab",
    "p3_label_code": f"""WITH {_LABELLED} SELECT doc_id, CASE label WHEN 'fake' THEN 0 WHEN 'real' THEN 1 END AS code,
      CASE WHEN label IN ('fake', 'real') THEN label END AS name FROM lab""",
    "p4_sentences": f"""WITH {DOCS} SELECT doc_id, len(sents) AS n_sents, md5(array_to_string(sents, chr(10))) AS sents_md5 FROM parts""",
    "p5_lead_body": f"""WITH {DOCS} SELECT doc_id, md5(array_to_string(sents[1:2], ' ')) AS lead_md5, len(sents[1:80]) AS n_body,
      md5(array_to_string(sents[1:80], chr(10))) AS body_md5 FROM parts""",
    "p6_clean_words": f"""WITH {DOCS}, w AS (SELECT doc_id, {sql_clean('words')} AS w FROM parts)
      SELECT doc_id, len(w) AS n_words, len(list_filter(w, lambda x: x = '')) AS n_empty, md5(array_to_string(w, ' ')) AS words_md5 FROM w""",
    "p7_lower_words": f"""WITH w AS (SELECT doc_id, string_split({sql_squeeze('lower(text)')}, ' ') AS w FROM documents)
      SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM w""",
    "p9_clip_unit": "SELECT doc_id, round(greatest(0.0, least(1.0, (n_chars - 1000) / 2000.0)), 6)::DOUBLE AS clipped FROM documents",
    "q1_first_of_duplicates": """SELECT doc_id, source, n_chars FROM documents
      QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "q2_min_length": "SELECT doc_id, n_chars FROM documents WHERE length(text) >= 200",
    "q3_drop_missing": "SELECT doc_id, quality AS label FROM documents JOIN labels USING (doc_id)",
    "q4_user_filters": "SELECT doc_id, source FROM documents WHERE n_chars % 2 = 0 AND source <> 'src3'",
    "q5_cleaning_order": """SELECT d.doc_id, l.quality AS label, d.lang FROM (
        SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) d
      JOIN labels l USING (doc_id) WHERE length(d.text) >= 200 AND d.lang <> 'de'""",
    "q6_quality_settings": """SELECT doc_id, lang, n_chars FROM documents
      WHERE length(text) BETWEEN 100 AND 5000 AND lang = 'en'""",
    "q6_label_validation": """SELECT source AS label, count(*) AS n, count(*) >= 50 AS enough,
      source IN ('src1', 'src2', 'src8') AS known FROM documents GROUP BY source""",
    "u1_combine": """SELECT 'documents' AS source, md5(text) AS text_md5 FROM documents
      UNION ALL SELECT 'conversations', md5(text) FROM conversations
      UNION ALL SELECT 'benchmark', md5(text) FROM benchmark""",
    "u2_balance": f"""WITH {_ART} SELECT id, label FROM named
      QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id))
        <= (SELECT min(n) FROM (SELECT count(*) AS n FROM named GROUP BY label))""",
    "u3_statistics": f"""WITH art AS (SELECT text, source, {sql_squeeze('text')} AS sq, CASE quality WHEN 1 THEN 'real' WHEN 0 THEN 'fake' END AS label
        FROM documents LEFT JOIN labels USING (doc_id)),
      named AS (SELECT *, {sql_sentences('sq')}[1] AS title FROM art)
      SELECT 'total_samples' AS metric, '' AS key, count(*)::DOUBLE AS value FROM named
      UNION ALL SELECT 'avg_text_length', '', round(avg(length(text)), 6) FROM named
      UNION ALL SELECT 'avg_word_count', '', round(avg(len(string_split(sq, ' '))), 6) FROM named
      UNION ALL SELECT 'has_title', '', count(*) FILTER (length(title) > 0)::DOUBLE FROM named
      UNION ALL SELECT 'label_distribution', label, count(*)::DOUBLE FROM named WHERE label IS NOT NULL GROUP BY label
      UNION ALL SELECT 'source_distribution', source, count(*)::DOUBLE FROM named GROUP BY source""",
    "u5_many_datasets": f"""WITH {_ART} SELECT 'a' AS source, label, count(*) AS rows FROM named GROUP BY label
      UNION ALL SELECT 'b', label, count(*) FROM named WHERE label = 'fake' GROUP BY label
      UNION ALL SELECT 'lost', 'failed', 0""",
    "u6_custom_dataset": f"""WITH {_ART} SELECT 'mine' AS source, label, md5(title) AS title_md5, md5(text) AS text_md5 FROM named""",
}
