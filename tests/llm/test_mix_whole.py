"""Topics are learnt from every row."""

import collections
import re

import numpy as np
import pytest

from sievelight.llm import mix


@pytest.fixture(scope="module")
def many(spark):
    """2,600 texts of three vocabularies, and rows without long words."""
    rng = np.random.RandomState(1)
    vocabulary = [[f"word{k}{i:03d}" for i in range(60)] for k in range(3)]
    rows = [(i, " ".join(rng.choice(vocabulary[2 if i >= 2200 else i % 2], 25)) + f" i{i}") for i in range(2600)]
    rows += [(2600, None), (2601, ""), (2602, "a b c")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string")


def test_document_frequencies_are_of_all_rows(many):
    rows, df = many
    seen, n = collections.Counter(), 0
    for _, t in rows:
        _, _, slot, _ = mix.terms([(t or "").encode()])
        seen.update(slot.tolist())
        n += len(slot) > 0
    assert n == 2600
    want = [np.log((n + 1) / (seen[s] + 1)) + 1e-3 for s in range(mix.TOPIC_SLOTS)]
    assert np.allclose(mix.fit_topics(df, topics=3).idf, want, rtol=1e-12)


def test_centres_are_those_of_all_rows(many):
    """Each centre is the direction of the sum of all texts that are nearest to it."""
    rows, df = many
    model = mix.fit_topics(df, topics=3)
    texts = [t.encode() for _, t in rows if re.search(r"\S{6}", t or "")]
    x = np.zeros((len(texts), mix.TOPIC_SLOTS))
    _, of, slot, weight = mix.terms(texts)
    x[of, slot] = weight * model.idf[slot]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = (x @ model.centres.T).argmax(axis=1)
    assert np.bincount(own).tolist() == [1100, 1100, 400]
    sums = np.stack([x[own == k].sum(axis=0) for k in range(3)])
    assert np.allclose(sums / np.linalg.norm(sums, axis=1, keepdims=True), model.centres, atol=1e-6)


def test_partitions_and_order_do_not_matter(many):
    _, df = many
    a, b = mix.fit_topics(df.coalesce(1), topics=5), mix.fit_topics(df.orderBy("text").repartition(7), topics=5)
    assert np.array_equal(a.idf, b.idf) and np.array_equal(a.centres, b.centres)


def test_stored_vectors_give_the_topics_of_texts(many):
    _, df = many
    model = mix.fit_topics(df, topics=3)
    stored = mix.vectors(df, keep=("doc_id",))
    got = {tuple(r) for r in mix.assigned(stored, model).collect()}
    assert got == {tuple(r) for r in mix.with_topics(df, model).collect()}


def test_pipeline_mixes_by_topics_of_all_rows(spark, many, monkeypatch):
    import corpus_pipeline

    rows, df = many
    docs = df.selectExpr("doc_id", "text", "'en' lang", "'src0' source", "length(text) n_chars")
    models, with_topics = [], mix.with_topics
    monkeypatch.setattr(mix, "with_topics", lambda docs, model, *a, **k: models.append(model) or with_topics(docs, model, *a, **k))
    kept = {r.doc_id for r in corpus_pipeline.mixing(spark, docs, "").collect()}
    seen = collections.Counter(s for _, t in rows for s in mix.terms([(t or "").encode()])[2].tolist())
    want = [np.log(2601 / (seen[s] + 1)) + 1e-3 for s in range(mix.TOPIC_SLOTS)]
    assert models and all(np.allclose(m.idf, want, rtol=1e-12) for m in models)
    sampled = mix.sample(docs, corpus_pipeline.MIXTURE, corpus_pipeline.SAMPLE_SHARE)
    assert kept == {r.doc_id for r in sampled.where("kept").collect()}


def test_fewer_texts_than_topics(spark):
    df = spark.createDataFrame([(1, "lonely wording"), (2, "lonely wording"), (3, "another sentence")], "doc_id bigint, text string")
    topics = {r.doc_id: r.topic for r in mix.with_topics(df, mix.fit_topics(df)).collect()}
    assert topics[1] == topics[2] != topics[3]
