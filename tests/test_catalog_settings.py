"""Registered runs use the default seeds, splits and classifiers."""

import pytest

from catalog import common, modelling, neardup
from newslens.config import RunSettings
from newslens.operators.classify import KINDS
from newslens.plans import sweeps


def test_default_seeds_and_splits():
    assert (common.SETTINGS.seeds, common.SETTINGS.n_splits) == (RunSettings().seeds, 7)
    assert common.SETTINGS.lexicons == common.LEX
    assert neardup.SEEDS == RunSettings().seeds


@pytest.mark.parametrize("query", ["r4_feature_drops", "r3_ablations"])
def test_ablations_run_every_classifier(spark, monkeypatch, query):
    seen = []

    class Seen(Exception):
        pass

    def sweep(features, splits, settings, seed, kinds):
        seen.append(tuple(kinds))
        raise Seen

    monkeypatch.setattr(sweeps, "_sweep", sweep)
    monkeypatch.setattr(sweeps, "stage_tables", lambda *a: (None, None))
    monkeypatch.setattr(sweeps, "corpus_digest", lambda a: "")
    monkeypatch.setattr(modelling, "articles", lambda spark, sf: None)
    monkeypatch.setattr(modelling, "scratch_path", lambda spark, name: "")
    with pytest.raises(Seen):
        modelling.QUERIES[query](spark, "")
    assert seen == [tuple(KINDS)]
