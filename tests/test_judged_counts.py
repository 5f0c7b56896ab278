"""Metrics read counts of judgements and those of the run, not the product of documents and topics."""

import math

from pyspark.sql import functions as F

from sievelight.operators import evaluate
from sievelight.plans.queries import judged, qrels


def test_metrics_without_the_product(spark, small):
    j = judged(spark, small)
    table = qrels(spark, small).cache()
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    topics = j.names.count()
    assert j.counts().count() <= 3 * topics < table.count()
    assert key(j.counts()) == key(table.groupBy("qid", "rel").count())
    run = table.where(F.pmod(F.xxhash64("qid", "doc"), F.lit(7)) == 0).select("qid", "doc", F.expr("row_number() over (partition by qid order by doc)").alias("rank"))
    run = run.union(run.select("qid", F.lit(-1), F.lit(500))).cache()
    assert j.of(run.select("qid", "doc")).count() == run.count() - run.where("doc = -1").count()
    assert key(evaluate.metrics(run, j)) == key(evaluate.metrics(run, table))
    assert key(evaluate.condensed(run, j)) == key(evaluate.condensed(run, table))


def test_ideal_of_counts(spark):
    rows = [("q", d, 2) for d in range(3)] + [("q", d, 1) for d in range(3, 20)] + [("r", 0, 0)] + [("s", d, 2) for d in range(12)]
    got = {r.qid: (round(r.idcg, 9), r.n_eligible) for r in evaluate.ideal(spark.createDataFrame(rows, "qid string, doc long, rel int")).collect()}
    dcg = lambda rels: round(sum(g / math.log2(i + 2) for i, g in enumerate(rels)), 9)
    assert got == {"q": (dcg([2] * 3 + [1] * 7), 3), "r": (0.0, 0), "s": (dcg([2] * 10), 12)}
