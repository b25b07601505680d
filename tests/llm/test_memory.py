"""Executors' memory between the pipeline's stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tideframe.llm import common


def test_executors_collect_garbage(spark):
    old = lambda: sum(x.getCollectionCount() for x in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in x.getName())
    before = old()
    common.relieved(spark)
    assert old() > before


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_each_stage_begins_by_giving_back_memory(spark, monkeypatch, name, stage):
    class Called(Exception):
        pass

    def called(session):
        raise Called

    monkeypatch.setattr(corpus_pipeline, "relieved", called)
    with pytest.raises(Called):
        stage(spark, None, "")
