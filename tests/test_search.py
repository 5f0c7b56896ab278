import math

import pytest
from pyspark.sql import functions as F

from sievelight.operators import evaluate, rerank, search
from sievelight.operators import index as I
from sievelight.plans.queries import index, notes, qterms
from sievelight.schema import Config
from sievelight.sources import trials

ROW = dict(id="x", title="", official="", summary="", description="", conditions=[], interventions=[], inclusion="", exclusion="", gender="All", min_age=0.0, max_age=999.0, status="", phase="", type="")
KINDS = "doc bigint, id string, title string, official string, summary string, description string, conditions array<string>, interventions array<string>, inclusion string, exclusion string, gender string, min_age double, max_age double, status string, phase string, type string"


def records(spark, *rows):
    names = [c.split()[0] for c in KINDS.split(", ")]
    return spark.createDataFrame([tuple({**ROW, "doc": i, **r}[n] for n in names) for i, r in enumerate(rows)], KINDS)


def test_positions_leave_a_gap(spark):
    t = records(spark, {"conditions": ["Breast Cancer", "of the", "HER2 Positive"]})
    got = {r.term: r.pos for r in I.terms(I.positioned(I.kept_words(t))).collect()}
    assert got == {"breast": 30000000, "cancer": 30000001, "her2": 30000065, "posit": 30000066}


def test_bm25f_value(spark, tmp_path):
    ix = I.build(records(spark, *({"title": f"word{i}"} for i in range(4))), str(tmp_path))
    terms = spark.createDataFrame([("q", "word1", 2.0, 0)], "qid string, term string, qtf double, first_pos int")
    out = search.lexical(search.select_terms(terms, ix, Config()), ix, Config()).collect()
    assert [(r.doc, round(r.score, 6)) for r in out] == [(1, 2.979833)]


def test_brute_force_bm25f(spark, small):
    """A plain scorer over Python dicts agrees with the joined plan."""
    ix, c = index(spark, small), Config()
    lens = {r.doc: [r[f"zlen{z}"] for z in range(7)] for r in ix.doc_stat.collect()}
    post = {}
    for r in ix.posting.drop("positions").collect():
        post.setdefault(r.term, []).append((r.doc, [r[f"tf{z}"] for z in range(7)]))
    n, want = len(lens), {}
    for q in qterms(spark, small).where("qid < '13'").collect():
        got = post.get(q.term, [])
        idf = math.log(1 + (n - len(got) + 0.5) / (len(got) + 0.5)) if got else 0
        for doc, tf in got:
            f = sum(w * x / (1 - b + b * z / a) for w, x, b, z, a in zip(c.zone_w, tf, c.zone_b, lens[doc], ix.avg, strict=True))
            want[q.qid, doc] = want.get((q.qid, doc), 0) + idf * (c.k3 + 1) * q.qtf / (c.k3 + q.qtf) * f * (c.k1 + 1) / (f + c.k1)
    out = search.lexical(search.select_terms(qterms(spark, small).where("qid < '13'"), ix, c), ix, c).collect()
    assert {(r.qid, r.doc): pytest.approx(r.score) for r in out} == want


def test_elimination_and_champions_read_less(spark, small):
    ix, q = index(spark, small), qterms(spark, small)
    all_terms = search.select_terms(q, ix, Config()).where("kept").count()
    assert search.select_terms(q, ix, Config(max_terms=10_000)).where("kept").count() == all_terms
    assert search.select_terms(q, ix, Config(max_terms=3)).where("kept").count() < all_terms
    kept = search.select_terms(q, ix, Config()).where("kept")
    assert search.hits(kept, ix, Config(champions=True)).count() <= search.hits(kept, ix, Config()).count()


def test_eligibility_without_known_age_admits(spark):
    t = records(spark, {"min_age": 18.0, "max_age": 40.0, "gender": "Female"})
    ok = lambda a, s: t.select(search.eligible(F.lit(a).cast("double"), F.lit(s).cast("string")).alias("ok")).first().ok
    assert ok(None, None) and ok(18.0, "female") and ok(40.0, None)
    assert not ok(17.9, None) and not ok(30.0, "male")


def test_fuse_example(spark):
    rows = spark.createDataFrame([("q", 0, 1.0, True, 2.0, 0.0, 1.0), ("q", 1, 0.5, False, 4.0, 0.0, 3.0)], "qid string, doc long, final double, ok boolean, ce0 double, ce1 double, ce2 double")
    assert [round(r.fused, 6) for r in rerank.fuse(rows, Config()).orderBy("doc").collect()] == [0.7, 0.4]


def test_model_scorer_and_cache(spark, small):
    ix, n = index(spark, small), notes(spark, small).where("qid in ('1', '2')")
    best = search.ranked(search.candidates(qterms(spark, small).where("qid in ('1', '2')"), n, ix, Config()), 3)
    scorer = rerank.model_scorer(lambda: lambda note, texts: [float(len(t)) for t in texts])
    first = rerank.score_candidates(best, n, ix, scorer)
    known = first.select("qid", "doc", "ce0", "ce1", "ce2").limit(2)
    again = rerank.score_candidates(best, n, ix, scorer, known)
    key = lambda df: sorted((r.qid, r.doc, r.ce0) for r in df.collect())
    assert key(first) == key(again)


def test_metrics_example(spark):
    run = spark.createDataFrame([("q", 1, 1), ("q", 9, 2), ("q", 3, 3)], "qid string, doc long, rank int")
    qrel = spark.createDataFrame([("q", 1, 2), ("q", 2, 2), ("q", 3, 1), ("q", 4, 0)], "qid string, doc long, rel int")
    m = evaluate.metrics(run, qrel).first()
    assert (round(m.ndcg10, 6), m.p10, m.p10_lenient, m.rr, m.excluded10) == (0.664565, 0.1, 0.2, 1.0, 0.1)


def test_pvalues():
    assert evaluate.t_pvalue(2.0, 11) == pytest.approx(0.0733880, abs=1e-6)
    assert evaluate.wilcoxon_pvalue([1, 2, 3, 4, 5]) == pytest.approx(0.0625)
    assert evaluate.wilcoxon_pvalue([0.0, 0.0]) == 1.0


def test_tuning_keeps_the_first_of_equals():
    best = evaluate.tune_zones(lambda c: -abs(c.zone_w[0] - 1.0), Config())
    assert best.zone_w[0] == 1.0 and best.zone_w[1:] == (0.0,) * 6


def test_topics_and_qrels(spark, tmp_path):
    from sievelight.sources import topics

    (tmp_path / "t.xml").write_text('<topics><topic number="1">A  note</topic><topic number="2">B</topic></topics>')
    (tmp_path / "q.txt").write_text("1 0 NCT1 2\n1 0 NCT9 1\n2 0 NCT1 0\n2 0 NCT1 1\n")
    assert sorted(map(tuple, topics.read_topics(spark, str(tmp_path / "t.xml"), 2021).collect())) == [("2021-1", 2021, "A note"), ("2021-2", 2021, "B")]
    known = spark.createDataFrame([("NCT1", 0)], "id string, doc long")
    assert sorted(map(tuple, topics.read_qrels(spark, str(tmp_path / "q.txt"), 2021, known).collect())) == [("2021-1", 0, 2), ("2021-2", 0, 1)]


def test_zip_scan(spark, tmp_path):
    import zipfile

    from sievelight.plans.queries import _XML

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1.xml", _XML % (7, 7))
        z.writestr("readme.txt", "no")
        z.writestr("2.xml", "<broken")
    got = trials.parse_xml(trials.read_zips(spark, f"{tmp_path}/*.zip")).select("id", "min_age", "entry").collect()
    assert [tuple(r) for r in got] == [("NCT7", 0.5, 0)]
