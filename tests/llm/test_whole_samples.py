"""Labelled texts are learnt from to their ends."""

import numpy as np
import pytest

from sievelight.llm import compress, crf

BODY = ["The quiet river runs past the old mill and the town sleeps well."] * 250
TAIL = ["# 12 | 34 | $$$ !!!"] * 150


def test_lines_at_the_end_of_long_texts_are_learnt():
    good, bad = "\n".join(BODY).encode(), "\n".join(BODY + TAIL).encode()
    assert len("\n".join(BODY)) > 10_000
    labels = np.array([1, 0] * 3)
    field = crf.train(crf.measure([good, bad] * 3), labels, rounds=30)
    score = field.state[crf.measure([TAIL[0].encode()]).features].sum(axis=1)[0]
    assert score[0] > score[1] + 0.5  # the tail stands in bad texts only


def test_gradient_of_unequal_lengths():
    """One step of the ascent has the signs of the likelihood's own slope, found by all labellings."""
    texts = [b"Good line here.\nAnother good line.\nThird one.", b"$$$ | 1\n### | 2", b"Lone."]
    lines, labels = crf.measure(texts), np.array([1, 0, 1])

    def likelihood(step):
        total = 0.0
        for k, (a, b) in enumerate(zip(lines.offsets, lines.offsets[1:], strict=False)):
            paths = np.array(np.meshgrid(*[[0, 1]] * (b - a))).reshape(b - a, -1).T
            weights = np.array([sum(step[p, q] for p, q in zip(path, path[1:], strict=False)) for path in paths])
            own = sum(step[labels[k], labels[k]] for _ in range(b - a - 1))
            total += own - np.log(np.exp(weights).sum())
        return total

    slope = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            up = np.zeros((2, 2))
            up[i, j] = 1e-5
            slope[i, j] = (likelihood(up) - likelihood(-up)) / 2e-5
    assert crf.train(lines, labels, rounds=1).step == pytest.approx(0.1 * np.sign(slope), abs=1e-3)


def test_samples_are_collected_whole(spark, monkeypatch):
    long = "x" * 9_990 + " the end of it"
    docs = spark.createDataFrame([(i, f"{i} {long}") for i in range(4)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, quality int")
    seen = []
    measure = crf.measure
    monkeypatch.setattr(crf, "measure", lambda texts: (seen.extend(texts), measure(texts))[1])
    monkeypatch.setattr(crf, "train", lambda lines, y: crf.Field.neutral())
    crf.fit(docs, labels)
    assert len(seen) == 4 and all(t.endswith(b"the end of it") for t in seen)
    monkeypatch.setattr(compress, "cut", lambda raw, n: seen.append(raw) or [raw])
    seen.clear()
    compress.fit(docs, labels)
    assert seen and all(t.endswith(b"the end of it") for t in seen)
