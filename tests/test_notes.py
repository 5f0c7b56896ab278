"""Note reading against a plain word-by-word reader of the same rules, and folding of all code points."""

import random
import re

from pyspark.sql import functions as F

from sievelight.functions import notes as N
from sievelight.functions.text import fold, fold_word


def plain_tags(words):
    """Walks a note as the rules are told: cues forward, late cues back."""
    out, clause = [], []
    for at, w in [*enumerate(words), (len(words), ".")]:
        if w not in N.CLAUSE_ENDS:
            clause.append((at, w))
            continue
        own = [x for _, x in clause]
        tags = ["pos"] * len(own)
        i = 0
        while i < len(own):
            cue = max((c.split() for c in N.CUES if own[i : i + len(c.split())] == c.split()), key=len, default=[])
            if cue:
                tags[i : i + len(cue)] = ["cue"] * len(cue)
                for k in range(i + len(cue), min(len(own), i + len(cue) + N.SCOPE)):
                    tags[k] = "neg"
            elif own[i] in N.AFTER_CUES:
                for k in range(max(0, i - N.BACK), i):
                    tags[k] = "neg"
                tags[i] = "cue"
            i += max(1, len(cue))
        if set(own) & set(N.FAMILY):
            tags = ["family"] * len(own)
        out += [(at, x, t) for (at, x), t in zip(clause, tags)]
        clause = []
    return out


def test_tags_agree_with_a_plain_reader(spark):
    rng = random.Random(5)
    parts = ["no", "not", "denies", "history", "of", "negative", "for", "unremarkable", "absent", "ruled", "out", "free", "evidence", "fever", "cough", "pain", "mother", ",", ".", "but", "without", "signs"]
    notes = [(str(i), " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    got = {}
    for r in N.tagged_words(spark.createDataFrame(notes, "qid string, note string")).collect():
        got.setdefault(r.qid, []).append((r.at, r.word, r.tag))
    for qid, note in notes:
        words = re.findall(N.NOTE_WORDS, note)
        assert sorted(got.get(qid, [])) == plain_tags(words), note


def test_settings_and_empty_notes(spark):
    df = spark.createDataFrame([("a", "Denies w/o HTN; sister had DM, either/or"), ("b", None), ("c", ""), ("d", "[** Name 12/3 **] 30 yo M")], "qid string, note string")
    rows = {r.qid: r for r in N.profiles(df).collect()}
    assert rows["a"].neg == {"hypertens": 1} and rows["a"].family == {"sister": 1, "diabet": 1, "mellitu": 1}
    assert [(x.short, x.long) for x in rows["a"].abbrev] == [("w/o", "without"), ("htn", "hypertension"), ("dm", "diabetes mellitus")]
    assert rows["a"].surface["hypertens"] == "hypertension"
    assert rows["b"].pos == {} and rows["c"].tagged == [] and rows["d"].pos == {"yo": 1} and rows["d"].age == 30.0
    plain = {r.qid: r for r in N.profiles(df, abbrev=False, negation=False, family=False).collect()}["a"]
    assert plain.neg == {} == plain.family and "htn" in plain.pos and plain.abbrev == []


def test_every_code_point_folds_as_unicode_says(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(i, "a" + "b".join(map(chr, codes[i : i + 500])) + "z") for i in range(0, 0x34000, 500)]
    out = spark.createDataFrame(rows, "i int, t string").select("t", fold(F.col("t")).alias("x")).collect()
    assert all(r.x == fold_word(r.t) for r in out)
    squared = spark.createDataFrame([("5㎏ 𝐀bc … ½ ﬁ 🄀",)], "t string").select(fold(F.col("t")).alias("x")).first().x
    assert squared == fold_word("5㎏ 𝐀bc … ½ ﬁ 🄀") and squared.startswith("5kg abc")
