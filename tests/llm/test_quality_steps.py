"""Training takes as many optimiser steps on a small sample as on a large one."""

import pytest

from llm.cases import documents
from tessera.llm import quality


@pytest.mark.parametrize("labelled", [40, 300])
def test_steps_do_not_depend_on_the_sample(spark, labelled, monkeypatch):
    steps, gradients = [], quality.GatedAttention.gradients
    monkeypatch.setattr(quality.GatedAttention, "gradients", lambda self, *own: steps.append(1) or gradients(self, *own))
    docs = documents(spark, [(i, f"{'good words' if i % 2 else '## 12'} {i}", "s") for i in range(labelled)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(labelled)], "doc_id long, quality int, toxic int")
    quality.score_quality(docs, labels)
    assert len(steps) == 1280
