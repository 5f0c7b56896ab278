"""Tuning, tables and tests of systems, by hand and against plain reckoning."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.operators import evaluate as E
from sievelight.operators import index as I
from sievelight.plans.queries import _index, index, notes, qrels
from sievelight.schema import Config
from sievelight.sources import topics, trials


def test_cascade_takes_the_best_of_every_step():
    """A score that rewards known settings: each step finds its own, equal ones keep the first."""
    want = {"abbrev": True, "negation": False, "params": "soft", "soft": 0.25, "prf_docs": 10, "prf_terms": 20, "exc_w": 0.6, "neg_w": 0.2}
    seen = []

    def score(c):
        seen.append(c)
        return sum(getattr(c, k) == v for k, v in want.items()) - abs(c.zone_w[3] - 3.0)

    out = E.cascade(score, rounds=1)
    full = out["full"]
    assert all(getattr(full, k) == v for k, v in want.items()) and full.zone_w == (0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0)
    assert full.prf_w == 0.5 and full.pen_ratio == 0.05 and not full.family
    assert len(seen) == 7 * 5 + 8 + 1 + 4 + 2 + 12 + 12 + 5
    tie = E.cascade(lambda c: 0.0, rounds=1)
    assert tie["params"] == tie["hard"] and tie["profile"].abbrev is False
    assert len(E.points(E.FUSION_GRID)) == 288 and E.points(E.FUSION_GRID)[1]["elig_w"] == 0.2
    assert [n for n, _ in E.systems(out)][-1] == "full" and len(E.systems(out)) == len(E.ablations(full)) == 8


def test_trial_scores_settings(spark, small):
    t = E.Trial(notes(spark, small), index(spark, small), qrels(spark, small))
    a, b = t.many([Config(), Config(params="hard")])
    assert 0 <= a <= 1 and t(Config()) == a and len(t.known) == 2
    curves = E.penalty_curves(t, Config())
    assert curves["exc_w"][0] == pytest.approx(a) and len(curves["neg_w"]) == len(E.NEG_GRID) and 0 <= b <= 1


def test_significance(spark):
    rng = np.random.RandomState(0)
    x, y = rng.rand(12), rng.rand(12)
    rows = [("a", str(i), float(v)) for i, v in enumerate(x)] + [("b", str(i), float(v)) for i, v in enumerate(y)] + [("c", str(i), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "system string, qid string, ndcg10 double")
    got = {(r.a, r.b): r for r in E.significance(df, [("a", "b"), ("a", "c")]).collect()}
    d = y - x
    t = d.mean() / (d.std(ddof=1) / 12**0.5)
    assert got["a", "b"].t_p == pytest.approx(E.t_pvalue(t, 12)) and got["a", "b"].delta == pytest.approx(d.mean())
    # all signings of the ranks
    ranks = np.argsort(np.argsort(abs(d))) + 1
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    sums = [sum(r for k, r in enumerate(range(1, 13)) if n >> k & 1) for n in range(1 << 12)]
    assert got["a", "b"].wilcoxon_p == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / 4096))
    assert (got["a", "c"].t_p, got["a", "c"].wilcoxon_p, got["a", "c"].wins) == (1.0, 1.0, 0)


def test_folds_and_tables(spark, tmp_path):
    folds = E.permuted_folds([str(i) for i in range(12)])
    order = np.random.RandomState(0).permutation(12)
    assert [folds[str(i)] for i in order] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 4, 4]
    curve = spark.createDataFrame([(1, "m=10", 1.0, 0.5), (2, "m=20", 2.0, 0.6), (3, "m=40", 2.0, 0.6), (4, "all", 1.0, 0.5)], "n int, label string, x double, y double")
    assert [(r.label, r.x) for r in E.merged_points(curve).orderBy("n").collect()] == [("m=10", 1.0), ("m=20 = m=40", 2.0), ("all", 1.0)]
    table = spark.createDataFrame([("full", 0.5, 0.1), ("same", 0.5, 0.1), ("a_b", 0.25, 0.05)], "system string, ndcg10 double, excluded10 double")
    assert sorted(r.system for r in E.shown(table, "full", ("ndcg10", "excluded10")).collect()) == ["a_b", "full"]
    rows = E.latex_rows(table, ("ndcg10", "excluded10"))
    assert {r.system: r.line for r in rows.collect()}["a_b"] == "a\\_b & 0.250 & \\textbf{0.050} \\\\"
    E.write_latex(rows, ["nDCG", "Excl"], f"{tmp_path}/t.tex")
    assert open(f"{tmp_path}/t.tex").read().splitlines()[3] == "\\midrule"
    E.write_results(table, f"{tmp_path}/t.json")
    assert {r["system"] for r in json.load(open(f"{tmp_path}/t.json"))} == {"full", "same", "a_b"}
    p = spark.createDataFrame([(0.0123,), (1.3e-6,), (0.0004,)], "p double").select(E.p_text(F.col("p")).alias("t")).collect()
    assert [r.t for r in p] == ["0.012", "1.3\\times 10^{-6}", "4.0\\times 10^{-4}"]


def test_walkthrough_by_hand(spark):
    run = lambda rows: spark.createDataFrame(rows, "qid string, doc long, rank int")
    before, after = run([("1", 1, 1), ("2", 2, 1), ("3", 5, 11)]), run([("1", 3, 1), ("2", 4, 1), ("3", 6, 1)])
    judged = spark.createDataFrame([("1", 3, 2), ("2", 2, 1), ("2", 4, 2), ("3", 6, 2)], "qid string, doc long, rel int")
    n = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c" * 700)], "qid string, note string")
    assert tuple(E.walkthrough(before, after, judged, n).first()) == ("2", 2)


def test_stored_index_searches_alike(spark, small):
    ix, folder = _index(spark, small, True)
    again = I.load(spark, folder)
    assert (again.n, again.avg, again.stemmed) == (ix.n, ix.avg, ix.stemmed)
    assert again.champion.count() == ix.champion.count() and again.posting.schema == ix.posting.schema


def test_years_unite(spark):
    a = spark.createDataFrame([("2021-1", "x")], "qid string, note string")
    b = spark.createDataFrame([("2022-1", "y", 3.0)], "qid string, note string, age double")
    assert sorted(map(str, topics.union_years(a, b).select("qid", "age").collect())) == ["Row(qid='2021-1', age=None)", "Row(qid='2022-1', age=3.0)"]


def test_golden_records(spark):
    """Criteria and ages by hand."""
    cases = [
        ("Inclusion Criteria: - Age over 18 - No prior chemotherapy - Signed consent Exclusion Criteria: - Pregnant - HIV", "Age over 18 Signed consent", "- Pregnant - HIV prior chemotherapy"),
        ("- No prior stroke - Diabetes", "- No prior stroke Diabetes", ""),
        ("Exclusion criteria: smoker Inclusion criteria: adult", "", "smoker Inclusion criteria: adult"),
        ("Inclusion criteria 1. Asthma 2) Patients with no COPD", "1. Asthma", "COPD"),
        ("Notable fever - Nonsmoker", "Notable fever Nonsmoker", ""),
        ("", "", ""),
    ]
    df = spark.createDataFrame(cases, "c string, i string, e string")
    inc, exc = trials.split_criteria(F.col("c"))
    assert all((r.x, r.y) == (r.i, r.e) for r in df.select("*", inc.alias("x"), exc.alias("y")).collect())
    assert tuple(trials.criteria_stats(df.withColumnRenamed("c", "criteria")).first()) == (6, 5, 2, 1, 3)
    ages = {"18 Years": 18.0, "6 Months": 0.5, "2 Weeks": 0.038, "1 Day": 0.003, "12 Hours": 0.001, "N/A": -1.0, "": -1.0, "30 Fortnights": 30.0, " 65.5 year": 65.5}
    got = spark.createDataFrame([(a,) for a in ages], "a string").select("a", trials.age_years(F.col("a"), -1.0).alias("y")).collect()
    assert {r.a: r.y for r in got} == ages


def test_golden_notes(spark):
    from sievelight.functions import notes as N

    cases = [
        ("0", "A 45-year-old woman with HTN denies chest pain. Her mother had breast cancer.", 45.0, "female", "hypertens old woman year", "chest pain", "breast cancer mother"),
        ("1", "60 yo M, HIV test negative, no fever but cough", 60.0, "male", "cough yo", "fever hiv infect test", ""),
        ("2", "18-month-old boy", 1.5, "male", "boi month old", "", ""),
        ("3", "aged 130, 62 years old", 62.0, None, "ag old year", "", ""),
    ]
    got = {r.qid: r for r in N.profiles(spark.createDataFrame([c[:2] for c in cases], "qid string, note string")).collect()}
    for qid, _, age, sex, *maps in cases:
        r = got[qid]
        assert (r.age, r.sex, *(" ".join(sorted(m)) for m in (r.pos, r.neg, r.family))) == (age, sex, *maps)
