"""Benchmark decontamination with DataFrame functions only.

The 13-word windows of the benchmark (an item with fewer words is one window) are a broadcast hash
table. Training texts are scanned window by window: a map of window hashes of 256 kB, the same
size for any benchmark, rules out most windows; only the text of the others leaves the row
and meets the table, and equality of the whole window text verifies the hit. A benchmark with
more than ``BROADCAST_BYTES`` is joined by a shuffle instead; the result is the same.

Defined results: a null or empty text, and one without words, has no words and no hits; so has a
text shorter than every window. Several benchmark rows with one item_id are one item; null items and
items without words never match, and an empty benchmark hits nothing. Rows are told apart by id and
text, repeated rows give repeated results. Only ``id_col`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.functions.scalars import let
from newslens.runtime import materialize

WINDOW = 13
SHARE = 20  # contaminated if at least one word in so many is hit
MAP_BITS = 18
BROADCAST_BYTES = 64 << 20
# The characters that separate words, for text in lower case and as written.
BETWEEN_LOWER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does just that where all is ASCII, and is faster."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN_LOWER), "")


def _places(words: Column, length: int) -> Column:
    """1, 2, ... for every window of ``length`` words."""
    last = F.size(words) - (length - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _slot(words: Column) -> Column:
    return F.pmod(F.xxhash64(words), F.lit(1 << MAP_BITS)).cast("int")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(gram, length, slot, items)``: every distinct window of the benchmark and the items it occurs in."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    items = items.filter(F.col("item").isNotNull() & (F.size("words") > 0))
    items = items.withColumn("length", F.least(F.lit(window), F.size("words")))
    last = F.size("words") - F.col("length") + 1
    grams = items.select("item", "length", "words", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    grams = grams.select("item", "length", F.slice("words", F.col("at"), F.col("length")).alias("gram_words"))
    return grams.groupBy(F.array_join("gram_words", " ").alias("gram"), "length", _slot(F.col("gram_words")).alias("slot")).agg(
        F.collect_set("item").alias("items")
    )


def slot_map(windows: DataFrame) -> bytearray:
    """A byte per slot, 1 where some window has that slot. The set of slots has a fixed size."""
    taken = windows.agg(F.collect_set("slot")).first()[0]
    table = bytearray(1 << MAP_BITS)
    for slot in taken:
        table[slot] = 1
    return table


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, text_hash, n_rows, n_words, hits, items)`` per distinct id and text.

    ``hits`` are the sorted ``(at, length)`` of the windows found, ``items`` the ids of their items.
    """
    windows = materialize(benchmark_windows(benchmark, window=window), "benchmark-windows")
    held = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i.cast("string")) + 16)
    sizes = {r["length"]: r["bytes"] for r in windows.groupBy("length").agg(F.sum(held).alias("bytes")).collect()}
    known = F.lit(slot_map(windows))

    def found_of(words: Column, slots: Column, length: int) -> Column:
        """The windows of one length whose slot is taken, with their text."""

        def gram(i: Column) -> Column:
            return F.slice(words, i, F.lit(length))

        def seen(i: Column) -> Column:
            return F.substring(slots, _slot(gram(i)) + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))

        def entry(i: Column) -> Column:
            return F.struct(i.alias("at"), F.lit(length).alias("length"), F.array_join(gram(i), " ").alias("gram"))

        return F.transform(F.filter(_places(words, length), seen), entry)

    def candidates(words: Column, slots: Column) -> Column:
        # the first entry stands for the row itself and carries its number of words
        marker = F.struct(F.lit(0).alias("at"), F.size(words).alias("length"), F.lit(None).cast("string").alias("gram"))
        return F.concat(F.array(marker), *[found_of(words, slots, n) for n in sorted(sizes)])

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("text_hash"),
        F.explode(let(words_of(F.col(text)), lambda w: let(known, lambda m: candidates(w, m)))).alias("c"),
    )
    rows = rows.select("id", "text_hash", "c.at", "c.length", "c.gram")
    table = windows.select("gram", "length", "items")
    if sum(sizes.values()) <= BROADCAST_BYTES:  # beyond it the few candidates are shuffled to the windows, with the same result
        table = F.broadcast(table)
    met = rows.join(table, ["gram", "length"], "left").filter((F.col("at") == 0) | F.col("items").isNotNull())
    hit = F.when(F.col("at") > 0, F.struct("at", "length"))
    return met.groupBy("id", "text_hash").agg(
        F.max(F.when(F.col("at") == 0, F.col("length"))).cast("bigint").alias("n_words"),
        F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("n_rows"),
        F.sort_array(F.collect_set(hit)).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )


def words_hit(hits: Column) -> Column:
    """How many words lie in at least one hit; ``hits`` are sorted by place."""
    start = F.struct(F.lit(0).alias("until"), F.lit(0).cast("bigint").alias("n"))

    def add(acc: Column, h: Column) -> Column:
        end = h["at"] + h["length"]
        new = end - F.greatest(h["at"], acc["until"])
        return F.struct(F.greatest(acc["until"], end).alias("until"), (acc["n"] + F.greatest(new, F.lit(0))).alias("n"))

    return F.aggregate(hits, start, add, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, a row for each row of ``docs``."""
    found = scan(docs, benchmark, id_col, text, window).withColumn("n_hit", words_hit(F.col("hits")))
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _with_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text: str, window: int) -> DataFrame:
    """``row`` (all columns of ``docs``), ``hits`` and ``n_words``; only texts with hits are on the other side of the join."""
    found = scan(docs, benchmark, id_col, text, window).filter(F.size("hits") > 0).select("id", "text_hash", "n_words", "hits")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(text).alias("own_hash")
    )
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash"))
    return keyed.join(found, same, "left").select("row", "n_words", "hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``docs`` without the contaminated rows, columns unchanged."""
    marked = _with_hits(docs, benchmark, id_col, text, window)
    bad = F.coalesce(share * words_hit(F.col("hits")) >= F.col("n_words"), F.lit(False))
    return marked.filter(~bad).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with every hit word, and what separates it from the next word, cut out of the text."""
    marked = _with_hits(docs, benchmark, id_col, text, window)

    def cut(value: Column) -> Column:
        between = F.regexp_extract_all(value, F.lit(f"({BETWEEN})"), F.lit(0))
        pieces = F.split(value, BETWEEN)
        shift = F.when(F.get(pieces, F.lit(0)) == "", 0).otherwise(1)  # a text may begin with a separator

        def kept(p: Column, s: Column, b: Column) -> Column:
            inside = lambda i: F.exists("hits", lambda h: (h["at"] <= i + s) & (i + s < h["at"] + h["length"]))
            return F.transform(p, lambda w, i: F.when((w != "") & inside(i), "").otherwise(F.concat(w, F.coalesce(F.get(b, i), F.lit("")))))

        return F.array_join(let(pieces, lambda p: let(shift, lambda s: let(between, lambda b: kept(p, s, b)))), "")

    value = F.col(f"row.{text}")
    cleaned = F.when(F.col("hits").isNotNull(), cut(value)).otherwise(value)
    return marked.select(
        *[cleaned.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )


def op10_query(spark: SparkSession, sf: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, gram)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
