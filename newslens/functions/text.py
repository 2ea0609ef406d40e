"""Sentence and token expressions. All stay inside the row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as white space, and the
# punctuation stripped from both ends of a token.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PUNCTUATION = ".,!?;:'\"()[]{}"
# Both patterns begin with what is rare in a text, so that most places are passed after one look: runs of white space other than
# one blank, and a punctuation mark that begins a word or, with those after it, ends one.
LOOSE_SPACE = rf"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{SPACE}*| {SPACE}+"
EDGE_PUNCTUATION = r"""[.,!?;:'"()\[\]{}](?:(?<![^ \n][.,!?;:'"()\[\]{}])[.,!?;:'"()\[\]{}]*|[.,!?;:'"()\[\]{}]*(?![^ \n]))"""
SENTENCE_BREAK = r"(?<=[.!?]) (?=[A-Z0-9])"


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, LOOSE_SPACE, " "))


def mark_sentences(squeezed: Column) -> Column:
    """Put a newline where a sentence ends: after ``.!?`` when a capital or digit follows.

    Squeezed text holds no other newline, so one string carries both the
    sentence and the word boundaries.
    """
    return F.regexp_replace(squeezed, SENTENCE_BREAK, "\n")


def mark_clean(marked: Column) -> Column:
    """Lower the marked text and strip punctuation from both ends of every word."""
    return F.regexp_replace(F.lower(marked), EDGE_PUNCTUATION, "")


def pieces(text: Column, separator: str) -> Column:
    """Split at a separator; empty pieces stay, empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, separator))


def words(squeezed: Column) -> Column:
    return pieces(squeezed, " ")


def clean_words(squeezed: Column) -> Column:
    """Words stripped of edge punctuation and lowered; a pure punctuation word stays as ''."""
    return F.when(squeezed == "", F.array().cast("array<string>")).otherwise(F.split(mark_clean(squeezed), " "))


def lower_words(text: Column) -> Column:
    """Lower-cased words with punctuation kept, the unit of hashing."""
    return words(squeeze(F.lower(text)))


def lead(sents: Column) -> Column:
    """The first two sentences as one string."""
    return F.array_join(F.slice(sents, 1, 2), " ")


def body(sents: Column, limit: int = 80) -> Column:
    """The sentences that enter the body mean (at most ``limit`` by rule)."""
    return F.slice(sents, 1, limit)


def count_where(array: Column, test) -> Column:
    return F.size(F.filter(array, test))
