"""The base of the language model: add-one over the training words and one unknown word."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest

from postella.llm.lm_score import lm_score

from .test_language_models import pytestmark  # noqa: F401


def test_base_probabilities_sum_to_one(spark):
    rows = [(i, f"w{i % 5} w{i % 3} w{i % 7}") for i in range(60)]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in t.split())
    n, v = sum(count.values()) + len(train), len(count) + 1
    asked = [*count, "unseen"]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = rows + list(zip(held, ["", *asked], strict=False))
    got = {r.doc_id: r.base_score for r in lm_score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    end = got[held[0]]
    assert 10**end == pytest.approx((len(train) + 1) / (n + v + 1))
    assert sum(10 ** (got[i] - end) for i in held[1 : len(asked) + 1]) + 10**end == pytest.approx(1)
