"""Folding, tokens and stop words, as column functions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words.
STOPWORDS = """
a about above after again against all also am an and any are as at be
because been before being below between both but by can could did do does
doing down during each few for from further had has have having he her
here hers herself him himself his how however i if in into is it its
itself just may me might more most must my myself no nor not now of off
on once only or other our ours ourselves out over own same she should so
some such than that the their theirs them themselves then there these
they this those through thus to too under until up upon us very via was
we were what when where which while who whom why will with within without
would yet you your yours yourself yourselves et al eg ie etc
""".split()

#: Blocks whose characters of several ASCII letters, digits or marks are common in prose (ligatures, fractions, dots, letter-like signs).
_COMMON = [(0x80, 0x250), (0x2010, 0x2060), (0xFB00, 0xFB07)]


def _ascii(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters that become one ASCII character, what they become, and those that become several, over all code points."""
    source, target, several = [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        a = _ascii(c)
        if len(a) == 1:
            source.append(c)
            target.append(a)
        elif a:
            several[c] = a
    return "".join(source), "".join(target), several


ONE, TO_ONE, SEVERAL = _tables()
COMMON = [c for c in SEVERAL if any(lo <= ord(c) < hi for lo, hi in _COMMON)]
RARE = [c for c in SEVERAL if c not in set(COMMON)]


def fold_word(text: str) -> str:
    """The same folding for one string."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()


def _any_of(chars: list[str]) -> str:
    """A regular expression's class of characters, in ranges: a long list of single ones is slow to test."""
    codes, spans = sorted(map(ord, chars)), []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"


def fold(text: Column) -> Column:
    """Compatibility decomposition, without what is not ASCII then, in lower case.

    Single characters go through one ``translate``.  Characters that become several
    are replaced one by one where they are common; texts that hold a rare one (squared
    units and the like) are mapped character by character.
    """
    holds = lambda chars: text.rlike(_any_of(chars))
    spread = text
    for c in COMMON:
        spread = F.replace(spread, F.lit(c), F.lit(SEVERAL[c]))
    becomes = F.create_map(*[F.lit(x) for c in SEVERAL for x in (c, SEVERAL[c])])
    each = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(becomes, c), c))
    # only texts with a character beyond the letters of European languages are tested any further
    wide = F.when(~text.rlike(f"[{chr(0xA8)}-{chr(0xBE)}{chr(0x130)}-{chr(0x10FFFF)}]"), text).when(holds(RARE), F.array_join(each, "")).when(holds(COMMON), spread).otherwise(text)
    ascii_only = ~text.rlike("[^\\x00-\\x7F]")
    return F.lower(F.when(ascii_only, text).otherwise(F.regexp_replace(F.translate(wide, ONE, TO_ONE), "[^\\x00-\\x7F]", "")))


def tokens(text: Column) -> Column:
    """All runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def is_kept(word: Column) -> Column:
    """Not a stop word, two characters or more, and not all digits."""
    return ~word.isin(STOPWORDS) & (F.length(word) >= 2) & word.rlike("[a-z]")


def words_of(text: str) -> list[tuple[str, int]]:
    """(kept word, position among all tokens) of one string."""
    stop = set(STOPWORDS)
    found = re.findall("[a-z0-9]+", fold_word(text))
    return [(w, i) for i, w in enumerate(found) if w not in stop and len(w) > 1 and not w.isdigit()]


def analyze(text: str, stemmed: bool = True) -> list[tuple[str, int]]:
    """(term, position) of one string: notes and query strings."""
    from sievelight.functions.porter import stem

    return [(stem(w) if stemmed else w, i) for w, i in words_of(text)]


def collapse(text: Column) -> Column:
    """White space of any script to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))
