"""criteria_split against its SQL on texts that ASCII and Unicode rules read differently."""

import duckdb

from sievelight.plans.queries import ORACLES, QUERIES
from sievelight.sources import trials

TEXTS = [
    "Noñietamente do\nb\nsummary", "Noé\nb\nNotü x", "a - no x - No y 12. not z\nb\n no\u000bmore", "a\nb\nc\nd\nin ١. x\nExclusion  criteria: one exclusion criteria two",
    "No_one\nb\nno more\nd\nPatientſ with no x - patients who have no y\nz", "must not\nb\nwithout\nd\nnone of us * Absence of x\ny",
]


def test_criteria_agree_with_sql(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("criteria_split", "criteria_stats"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall())


def test_records_are_read_in_unicode(spark):
    """parse_xml keeps the rules of the records themselves: a letter of any script goes on with a word."""
    df = spark.createDataFrame([("Inclusion Criteria: - Noñez - no x Exclusion Criteria: y",)], "c string")
    inc, exc = trials.split_criteria(df.c)
    assert tuple(df.select(inc, exc).first()) == ("Noñez", "y x")
