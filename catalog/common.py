"""Shared frames over the supplied tables, and the SQL building blocks of the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.config import Lexicons, RunSettings
from newslens.functions import text as tx
from newslens.runtime import spread

# Words that occur in the supplied corpus; the default lexicons do not.
LEX = Lexicons(("the", "of", "la", "der"), ("and", "with", "et", "und"), ("to", "in", "que", "zu"))
SETTINGS = RunSettings(lexicons=LEX)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


HEAD = 500  # characters that hold the first sentence of nearly every text


def first_sentence(text: Column) -> Column:
    """The head of a text is enough if a sentence ends in it: white space behind it changes nothing before that end."""
    head = tx.mark_sentences(tx.squeeze(F.substring(text, 1, HEAD)))
    whole = F.get(tx.pieces(tx.mark_sentences(tx.squeeze(text)), "\n"), 0)
    return F.when(head.contains("\n"), F.substring_index(head, "\n", 1)).otherwise(whole)


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as articles: quality is the 0/1 label, the first sentence the title."""
    joined = spread(documents(spark, sf), "doc_id").join(table(spark, sf, "labels"), "doc_id")
    return joined.select(
        F.col("doc_id").alias("id"),
        first_sentence(F.col("text")).alias("title"),
        "text",
        F.col("quality").alias("label"),
        "source",
    )


def named_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with string labels, as raw datasets carry them."""
    return articles(spark, sf).withColumn("label", F.when(F.col("label") == 1, "real").otherwise("fake"))


# ---- SQL side -------------------------------------------------------------

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))"


def sql_sentences(squeezed: str) -> str:
    marked = f"regexp_replace({squeezed}, '([.!?]) ([A-Z0-9])', '\\1' || chr(10) || '\\2', 'g')"
    return f"(CASE WHEN {squeezed} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({marked}, chr(10)) END)"


def sql_words(squeezed: str) -> str:
    return f"(CASE WHEN {squeezed} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({squeezed}, ' ') END)"


def sql_clean(words: str) -> str:
    return f"""list_transform({words}, lambda w: lower(trim(w, '.,!?;:''"()[]{{}}')))"""


DOCS = f"""docs AS (
  SELECT doc_id, text, lang, source, n_chars, {sql_squeeze('text')} AS sq FROM documents
), parts AS (
  SELECT *, {sql_sentences('sq')} AS sents, {sql_words('sq')} AS words FROM docs
)"""

ARTICLES = f"""art AS (
  SELECT d.doc_id AS id, d.text, l.quality AS label, d.source, {sql_squeeze('d.text')} AS sq
  FROM documents d JOIN labels l USING (doc_id)
)"""


def sql_in(lexicon: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in lexicon) + ")"


def sql_simhash(source: str, id_col: str, text: str) -> str:
    """CTE body: (id, sig) with sig as signed BIGINT."""
    ones = ", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64))
    bits = " + ".join(f"CASE WHEN 2 * b{i} > n THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))
    return f"""
  SELECT id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS sig
  FROM (SELECT id, {bits} AS u FROM (
    SELECT id, count(*) AS n, {ones} FROM (
      SELECT id, ('0x' || substr(md5(t), 17, 16))::UBIGINT AS h FROM (
        SELECT {id_col} AS id, unnest(string_split({sql_squeeze(f'lower({text})')}, ' ')) AS t FROM {source})
    ) GROUP BY id))"""


def sql_groups(source: str, id_col: str, text: str, bits: int = 3) -> str:
    """CTEs sigs, nodes, edges, reach, comp, grp(id, group_id). Needs WITH RECURSIVE."""
    return f"""sigs AS MATERIALIZED ({sql_simhash(source, id_col, text)}),
nodes AS MATERIALIZED (SELECT sig, min(id) AS rep, count(*) AS n FROM sigs GROUP BY sig),
edges AS MATERIALIZED (SELECT a.sig AS u, b.sig AS v FROM nodes a, nodes b
  WHERE a.sig <> b.sig AND bit_count(xor(a.sig, b.sig)) <= {bits}),
reach AS (SELECT sig AS u, sig AS v FROM nodes UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
comp AS (SELECT r.u AS sig, min(n.rep) AS group_id FROM reach r JOIN nodes n ON n.sig = r.v GROUP BY r.u),
grp AS (SELECT s.id, c.group_id FROM sigs s JOIN comp c USING (sig))"""


def sql_splits(members: str, seeds: tuple[int, ...], a: float = 0.64, b: float = 0.16, c: float = 0.20) -> str:
    """CTEs that end in spl(seed, id, group_id, split) from members(id, group_id, label)."""
    seed_rows = ", ".join(f"({s})" for s in seeds)
    share = lambda n, draws, total, own, other: (
        f"(({n} * {draws}) // {total} + CASE WHEN {draws} - ({own} * {draws}) // {total} - ({other} * {draws}) // {total} = 1 "
    )
    return f"""glab AS (SELECT group_id, CASE WHEN avg(label) > 0.5 THEN 1 ELSE 0 END AS label FROM {members} GROUP BY group_id),
c0 AS (SELECT CAST(count(*) FILTER (label = 0) AS BIGINT) AS n0, CAST(count(*) FILTER (label = 1) AS BIGINT) AS n1, CAST(count(*) AS BIGINT) AS n FROM glab),
c1 AS (SELECT *, n - CAST(ceil({c}::DOUBLE * n) AS BIGINT) AS d FROM c0),
c2 AS (SELECT *,
  {share('n0', 'd', 'n', 'n0', 'n1')} AND (n0 * d) % n >= (n1 * d) % n THEN 1 ELSE 0 END) AS k0,
  {share('n1', 'd', 'n', 'n0', 'n1')} AND (n1 * d) % n > (n0 * d) % n THEN 1 ELSE 0 END) AS k1 FROM c1),
c3 AS (SELECT *, d - CAST(ceil((1 - {a}::DOUBLE / ({a}::DOUBLE + {b}::DOUBLE)) * d) AS BIGINT) AS e FROM c2),
c4 AS (SELECT *,
  {share('k0', 'e', 'd', 'k0', 'k1')} AND (k0 * e) % d >= (k1 * e) % d THEN 1 ELSE 0 END) AS t0,
  {share('k1', 'e', 'd', 'k0', 'k1')} AND (k1 * e) % d > (k0 * e) % d THEN 1 ELSE 0 END) AS t1 FROM c3),
ranked AS (SELECT seed, group_id, label,
  row_number() OVER (PARTITION BY seed, label ORDER BY md5(seed || ':' || group_id)) AS rn
  FROM glab, (VALUES {seed_rows}) s(seed)),
gspl AS (SELECT seed, group_id, CASE
    WHEN rn <= CASE label WHEN 0 THEN n0 - k0 ELSE n1 - k1 END THEN 'test'
    WHEN rn <= CASE label WHEN 0 THEN n0 - t0 ELSE n1 - t1 END THEN 'val'
    ELSE 'train' END AS split FROM ranked, c4),
spl AS (SELECT g.seed, m.id, m.group_id, g.split FROM {members} m JOIN gspl g USING (group_id))"""
