import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.functions.porter import stem, stem_columns
from sievelight.functions.text import analyze, fold, fold_word, tokens

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi",
    "sky": "sky", "relational": "relat", "rational": "ration", "digitizer": "digit", "sensitiviti": "sensit", "triplicate": "triplic",
    "goodness": "good", "revival": "reviv", "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "metastases": "metastas", "pregnancy": "pregnanc", "eligibility": "elig",
    "carcinoma": "carcinoma", "t2dm": "t2dm", "at": "at",
}
FOLDED = {
    "18–65 years": ["1865", "years"],
    "Crohn’s disease": ["crohns", "disease"],
    "Naïve β-cells": ["naive", "cells"],
    "ﬁbrosis ½": ["fibrosis", "12"],
    "T2DM stage-3b": ["t2dm", "stage", "3b"],
    "Straße": ["strae"],
    "": [],
}


def test_stems_of_single_words():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_stems_as_columns(spark):
    words = [*STEMS, "syzygy", "flying", "eeyyee", "dying", "oed", "bling", "ion", "sion"]
    df = spark.createDataFrame(pd.DataFrame({"word": words}))
    assert {r.word: r.term for r in stem_columns(df).collect()} == {w: stem(w) for w in words}


def test_folding(spark):
    rows = spark.createDataFrame(pd.DataFrame({"t": list(FOLDED)})).select("t", tokens(F.col("t")).alias("x")).collect()
    assert {r.t: list(r.x) for r in rows} == FOLDED


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x24F), max_size=20), min_size=1, max_size=20, unique=True))
def test_folding_agrees_with_unicode_rules(spark, texts):
    rows = spark.createDataFrame(pd.DataFrame({"t": texts})).select("t", fold(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [fold_word(r.t) for r in rows]


def test_positions_count_all_tokens():
    assert analyze("history of asthma 12 x") == [("histori", 0), ("asthma", 2)]
