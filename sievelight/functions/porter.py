"""Porter stemming (the published 1980 rules), for columns and for single words.

A word's letters are written as a pattern of v (vowel) and c (consonant).  A
letter's class depends only on what stands left of it, so the pattern of a stem is
a prefix of its word's pattern, and the measure of a stem is the number of "vc" in
that prefix.  Each step is one CASE over (word, pattern); the same text runs in
Spark and in DuckDB.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffix rules of the published algorithm (suffix, replacement).
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

LETTERS, CLASSES = "abcdefghijklmnopqrstuvwxz", "vcccvcccvcccccvcccccvcccc"


def pattern_sql(word: str, duck: bool = False) -> str:
    """v/c pattern of a word; y is a vowel after a consonant and else a consonant."""
    g = ", 'g'" if duck else ""
    out = f"regexp_replace(translate({word}, '{LETTERS}', '{CLASSES}'), '^y', 'c')"
    for _ in range(4):
        out = f"regexp_replace(regexp_replace({out}, 'vy', 'vc'{g}), 'cy', 'cv'{g})"
    return out


def _measure(n: str) -> str:
    stem = f"substr(p, 1, {n})"
    return f"((length({stem}) - length(replace({stem}, 'vc', ''))) / 2)"


def _less(k: int) -> str:
    return f"length(w) - {k}"


def _table(rules: list[tuple[str, str]], least: int) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[0]))
    arms = " ".join(f"WHEN w LIKE '%{s}' THEN CASE WHEN {_measure(_less(len(s)))} > {least} THEN concat(substr(w, 1, {_less(len(s))}), '{r}') ELSE w END" for s, r in ordered)
    return f"CASE {arms} ELSE w END"


def _cvc(n: str) -> str:
    return f"({n} >= 3 AND substr(p, {n} - 2, 3) = 'cvc' AND substr(w, {n}, 1) NOT IN ('w', 'x', 'y'))"


def _double(n: str) -> str:
    return f"({n} > 1 AND substr(w, {n}, 1) = substr(w, {n} - 1, 1) AND substr(p, {n}, 1) = 'c')"


def steps() -> list[str]:
    """New word of each step, in terms of w and its pattern p."""
    step1a = "CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN substr(w, 1, length(w) - 2) WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN substr(w, 1, length(w) - 1) ELSE w END"

    def mend(k: int) -> str:
        n = _less(k)
        stem = f"substr(w, 1, {n})"
        return (
            f"CASE WHEN {stem} LIKE '%at' OR {stem} LIKE '%bl' OR {stem} LIKE '%iz' THEN concat({stem}, 'e') "
            f"WHEN {_double(n)} AND substr(w, {n}, 1) NOT IN ('l', 's', 'z') THEN substr(w, 1, {n} - 1) "
            f"WHEN {_measure(n)} = 1 AND {_cvc(n)} THEN concat({stem}, 'e') ELSE {stem} END"
        )

    step1b = (
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {_measure(_less(3))} > 0 THEN substr(w, 1, {_less(1)}) ELSE w END "
        f"WHEN w LIKE '%ed' AND contains(substr(p, 1, {_less(2)}), 'v') THEN {mend(2)} "
        f"WHEN w LIKE '%ing' AND contains(substr(p, 1, {_less(3)}), 'v') THEN {mend(3)} ELSE w END"
    )
    step1c = f"CASE WHEN w LIKE '%y' AND contains(substr(p, 1, {_less(1)}), 'v') THEN concat(substr(w, 1, {_less(1)}), 'i') ELSE w END"
    arms = []
    for s in sorted(STEP4, key=len, reverse=True):
        n = _less(len(s))
        also = f" AND substr(w, {n}, 1) IN ('s', 't')" if s == "ion" else ""
        arms.append(f"WHEN w LIKE '%{s}' THEN CASE WHEN {_measure(n)} > 1{also} THEN substr(w, 1, {n}) ELSE w END")
    step4 = f"CASE {' '.join(arms)} ELSE w END"
    n = _less(1)
    step5a = f"CASE WHEN w LIKE '%e' AND ({_measure(n)} > 1 OR {_measure(n)} = 1 AND NOT {_cvc(n)}) THEN substr(w, 1, {n}) ELSE w END"
    step5b = f"CASE WHEN w LIKE '%l' AND {_measure('length(w)')} > 1 AND {_double('length(w)')} THEN substr(w, 1, {n}) ELSE w END"
    return [step1a, step1b, step1c, _table(STEP2, 0), _table(STEP3, 0), step4, step5a, step5b]


def stem_words(words: DataFrame) -> DataFrame:
    """(word, term) of a table of distinct words in column ``word``.

    Words cross to Python once each, in Arrow batches.  The steps as columns
    (``stem_columns``) agree, but their plan takes longer to optimise than a
    vocabulary takes to stem.
    """
    return words.select("word", stemmed(F.col("word")).alias("term"))


def stemmed(word: Column) -> Column:
    """The stem of a column of words; each worker remembers the stems it has made, so tokens cross to Python but are never shuffled for it."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return stems(word)


def stem_columns(words: DataFrame) -> DataFrame:
    """The same by column expressions, one projection a step."""
    able = F.expr("length(word) > 2 AND NOT word RLIKE '[^a-z]'")
    out = words.select("word", F.col("word").alias("w"), F.expr(pattern_sql("word")).alias("p"))
    for step in steps():
        out = out.select("word", F.expr(step).alias("w")).select("word", "w", F.expr(pattern_sql("w")).alias("p"))
    return out.select("word", F.when(able, F.col("w")).otherwise(F.col("word")).alias("term"))


def stem_cte(source: str, name: str = "stem") -> str:
    """DuckDB CTEs that end in ``name(word, term)`` for the words of ``source``."""
    parts = [f"{name}0 AS (SELECT word, word AS w, {pattern_sql('word', True)} AS p FROM {source})"]
    for i, step in enumerate(steps()):
        parts.append(f"{name}{i + 1} AS (SELECT word, w, {pattern_sql('w', True)} AS p FROM (SELECT word, {step} AS w FROM {name}{i}))")
    parts.append(f"{name} AS (SELECT word, CASE WHEN length(word) > 2 AND NOT regexp_matches(word, '[^a-z]') THEN w ELSE word END AS term FROM {name}{len(steps())})")
    return ",\n".join(parts)


#: For single words: classes of letters, and rules by suffix with the suffixes' last two letters and lengths, longest first.
_CLASS = str.maketrans(LETTERS, CLASSES)
_RULES2, _RULES3, _RULES4 = (({*(x[-2:] for x in d)}, sorted({*map(len, d)}, reverse=True), d) for d in (dict(STEP2), dict(STEP3), dict.fromkeys(STEP4, "")))


def _pattern(w: str) -> str:
    """v/c pattern of a word of letters."""
    p = w.translate(_CLASS)
    if "y" in p:
        out = []
        for i, c in enumerate(p):
            out.append(c if c != "y" else "v" if i > 0 and out[-1] == "c" else "c")
        p = "".join(out)
    return p


def _hit(w: str, rules: tuple) -> str | None:
    """The longest suffix of a rule that the word ends with."""
    ends, sizes, by = rules
    if w[-2:] in ends:
        for n in sizes:
            if w[-n:] in by:
                return w[-n:]
    return None


def _m(w: str) -> int:
    return _pattern(w).count("vc")


def _ends_cvc(w: str) -> bool:
    return len(w) > 2 and w[-1] not in "wxy" and _pattern(w).endswith("cvc")


def _ends_double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _pattern(w)[-1] == "c"


def _swap(w: str, rules: tuple) -> str:
    hit = _hit(w, rules)
    return w if hit is None or _m(w[: -len(hit)]) < 1 else w[: -len(hit)] + rules[2][hit]


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one folded word."""
    if len(word) <= 2 or not word.isalpha():
        return word
    w = word
    if w[-1] == "s":
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) else w
    elif w.endswith(("ed", "ing")):
        s = w[:-2] if w[-1] == "d" else w[:-3]
        if "v" in _pattern(s):
            if s[-2:] in ("at", "bl", "iz"):
                w = s + "e"
            elif _ends_double(s) and s[-1] not in "lsz":
                w = s[:-1]
            else:
                w = s + "e" if _m(s) == 1 and _ends_cvc(s) else s
    if w.endswith("y") and "v" in _pattern(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _RULES2), _RULES3)
    hit = _hit(w, _RULES4)
    if hit and _m(w[: -len(hit)]) > 1 and (hit != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(hit)]
    if w.endswith("e") and ((m := _m(w[:-1])) > 1 or m == 1 and not _ends_cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("l") and _ends_double(w) and _m(w) > 1 else w
