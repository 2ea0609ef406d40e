"""Typed settings. Defaults equal the documented defaults of the method."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

# Small default lexicons and the fact-confirmation keywords.
POSITIVE_WORDS = ("good", "great", "excellent", "positive", "success", "benefit", "improve", "safe", "effective")
NEGATIVE_WORDS = ("bad", "terrible", "awful", "negative", "risk", "danger", "fail", "unsafe", "ineffective")
UNUSUAL_WORDS = ("fake", "hoax", "clickbait", "rumor", "bogus", "scandal", "shocking", "unbelievable")
FACT_KEYWORDS = ("source:", "according to", "reuters", "associated press", "ap", "fact check")

# Seeds, ratios and weights of the default run.
SEEDS = (13, 17, 19, 23, 29, 31, 37)
SPLIT_RATIO = (0.64, 0.16, 0.20)
PART_WEIGHTS = (0.2, 0.3, 0.5)
FEATURE_ORDER = ("PR", "SR", "HS", "UL", "SP", "NC", "SQ")


@dataclass(frozen=True)
class Cleaning:
    """Row-level quality settings; ``None`` switches a step off."""

    remove_duplicates: bool = False
    min_text_length: int | None = 10
    max_text_length: int | None = None
    remove_missing: bool = True
    language: str | None = None
    min_samples_per_class: int | None = None
    allowed_labels: tuple[str, ...] | None = None
    filters: tuple[Callable[[DataFrame], DataFrame], ...] = ()


@dataclass(frozen=True)
class DatasetSpec:
    """Where a labelled dataset lies and which columns carry what."""

    name: str
    patterns: tuple[str, ...]
    format: str = "csv"
    text_columns: tuple[str, ...] = ("text",)
    label_column: str | None = "label"
    title_column: str | None = None
    label_by_file: dict[str, str] | None = None
    cleaning: Cleaning | None = None


# Column layout of the public corpora the method was made for.
DATASETS = {
    s.name: s
    for s in (
        DatasetSpec("isot", ("Fake.csv", "True.csv"), title_column="title", label_column=None,
                    label_by_file={"Fake.csv": "fake", "True.csv": "real"}),
        DatasetSpec("liar", ("train.tsv", "test.tsv", "valid.tsv"), "tsv", ("statement",)),
        DatasetSpec("fakenewsnet", ("*.csv",), title_column="title"),
        DatasetSpec("covid19_fake", ("*.csv",), text_columns=("text", "title"), title_column="title"),
        DatasetSpec("fake_news_corpus", ("*.csv",), text_columns=("content",), title_column="title"),
        DatasetSpec("buzzfeed_news", ("*.csv",), label_column="rating", title_column="title"),
        DatasetSpec("mendeley_fake_news", ("*.csv",), title_column="title"),
        DatasetSpec("fever", ("*.csv",), text_columns=("claim",)),
        DatasetSpec("multi_fc", ("*.csv",)),
        DatasetSpec("politifact", ("*.json",), "json", ("statement",), "ruling"),
    )
}


@dataclass(frozen=True)
class Lexicons:
    positive: tuple[str, ...] = POSITIVE_WORDS
    negative: tuple[str, ...] = NEGATIVE_WORDS
    unusual: tuple[str, ...] = UNUSUAL_WORDS


@dataclass(frozen=True)
class RunSettings:
    """Everything a training run depends on; its digest addresses stage tables."""

    seeds: tuple[int, ...] = SEEDS
    n_splits: int = 7
    ratio: tuple[float, float, float] = SPLIT_RATIO
    dedupe: bool = True
    max_bits: int = 3
    weights: tuple[float, float, float] = PART_WEIGHTS
    max_body_sentences: int = 80
    lexicons: Lexicons = field(default_factory=Lexicons)
    lexicon_table: str | None = None  # path of a stored verdict table; then ``lexicons`` is not used
    fact_confirmation: bool = True
    encoder: str = "hash"  # name of the encoder: tables of another encoder are other tables
    max_token_spans: int | None = 30  # spans an evidence record keeps; None keeps all
    max_keyword_spans: int | None = 10
    svd_tolerance: float = 1.0e-8
    centre: bool = False  # subtract the mean of the training vectors before the transition
    classifier: str = "linear_svm"
    C: float = 1.0
    gamma: float = 0.5
    drop_features: tuple[str, ...] = ()

    @property
    def features(self) -> tuple[str, ...]:
        names = FEATURE_ORDER + (("FC",) if self.fact_confirmation else ())
        return tuple(n for n in names if n not in self.drop_features)

    def digest(self, *fields: str) -> str:
        """Ten hex digits over the named settings (all of them by default)."""
        values = asdict(self)
        chosen = {k: values[k] for k in (fields or values)}
        return hashlib.sha256(json.dumps(chosen, sort_keys=True).encode()).hexdigest()[:10]
