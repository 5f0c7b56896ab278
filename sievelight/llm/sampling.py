"""Bounded samples of whole texts, chosen by hash, so that neither order nor copies matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` ids of each label (0 and 1), ordered by the hash of the id.

    Ids with labels of both kinds, null ids and empty texts are left out; of rows that
    share an id the text of the smallest hash is taken.  So at most twice ``per_class``
    texts reach the driver, however often an id is repeated.
    """
    usable = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("q")).where(F.col("q").isin(0, 1) & F.col("i").isNotNull())
    once = usable.groupBy("i").agg(F.min("q").alias("q"), F.max("q").alias("most")).where("q = most").select("i", "q", F.xxhash64("i").alias("h"))
    picked = [once.where(F.col("q") == q).orderBy("h", "i").limit(per_class) for q in (0, 1)]
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    rows = texts.join(F.broadcast(picked[0].union(picked[1])), "i").groupBy("i", "q", "h").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")).collect()
    return [(r["t"], int(r["q"])) for r in sorted(rows, key=lambda r: (r["h"], r["t"]))]


def texts(docs: DataFrame, most: int, text_col: str) -> list[str]:
    """At most ``most`` different texts that are not empty: those of the smallest hashes, in that order."""
    hashed = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    chosen = hashed.select("h").distinct().orderBy("h").limit(most)
    rows = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("t").alias("t")).collect()
    return [r["t"] for r in sorted(rows, key=lambda r: r["h"])]
