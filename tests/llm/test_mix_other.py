"""Categories that the mixture does not name are drawn at the rate of their words."""

import pytest

from sievelight.llm import mix

TARGETS = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 1.0}}


def test_unnamed_and_null_categories_are_drawn(spark):
    rows = [("a", "en", 300), ("b", "en", 300), ("hot", "en", 300), (None, None, 100)]
    counted = spark.createDataFrame(rows, "source string, lang string, words long")
    fit = mix.fit(counted, TARGETS, 0.5)
    assert fit.achieved["source"] == {"a": pytest.approx(0.3), "b": pytest.approx(0.3), mix.OTHER: pytest.approx(0.4)}
    assert fit.achieved["lang"] == {"en": pytest.approx(0.9), mix.OTHER: pytest.approx(0.1)}
    assert all(p == pytest.approx(0.5) for _, _, p in fit.cells)


def test_a_stated_share_of_other_holds(spark):
    counted = spark.createDataFrame([("a", 400), ("x", 400)], "source string, words long")
    fit = mix.fit(counted, {"source": {"a": 0.8, mix.OTHER: 0.2}}, 0.5)
    assert fit.achieved["source"] == {"a": pytest.approx(0.8), mix.OTHER: pytest.approx(0.2)}
