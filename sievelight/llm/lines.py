"""Line dedup (operator 6), in DataFrame functions only.

Every run of ``window`` consecutive lines is hashed; a window that occurred
before, in order of (id, text hash, line), covers its lines, and covered lines
are removed.  Overlapping windows merge, so a repeated passage of any length goes
as a whole and its first occurrence stays.

Windows without a visible character are not compared.  Texts of fewer lines than
a window keep them all.  Null texts stay null, with no lines.  Rows repeated as a
whole (equal id and text) count as one row.  All other columns are kept as they
are; names used inside cannot clash with them, for only the id and text take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.scratch import unused

BREAK = "\n"


def _lines(text: Column) -> Column:
    return F.split(text, BREAK, -1)


def windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, t, pos, a, b): two 64-bit hashes of each window, by its first line from 0."""
    text = F.col(text_col)
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), _lines(text).alias("lines"))
    lines = lines.where(F.size("lines") >= window)
    starts = F.sequence(F.lit(0), F.size("lines") - window)
    cut = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("lines", i + 1, window), BREAK).alias("w")))
    cut = lines.select("id", "t", F.explode(cut).alias("x")).select("id", "t", "x.pos", "x.w")
    cut = cut.where(F.length(F.trim(F.translate("w", "\n\r\t", "   "))) > 0)
    return cut.select("id", "t", "pos", F.xxhash64("w").alias("a"), F.xxhash64(F.lit(1), F.col("w")).alias("b"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``docs`` with the text shortened, and n_lines and n_removed (lines before, and removed)."""
    cut = windows(docs, id_col, text_col, window)
    # a hot window is one row a task after map-side aggregation
    first = cut.groupBy("a", "b").agg(F.min(F.struct("id", "t", "pos")).alias("first"), F.max(F.struct("id", "t", "pos")).alias("last"))
    first = first.where(F.col("first") != F.col("last")).select("a", "b", "first")
    later = cut.join(first, ["a", "b"]).where(F.struct("id", "t", "pos") != F.col("first"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + window - 1))))
    docs = docs.drop("n_lines", "n_removed")
    i, t, c = unused(docs.columns, "covered_id", "covered_text", "covered")
    covered = later.groupBy(F.col("id").alias(i), F.col("t").alias(t)).agg(covered.alias(c))
    text = F.col(text_col)
    joined = docs.join(covered, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(t)), "left")
    lines, gone = _lines(text), F.coalesce(c, F.array().cast("array<int>"))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(F.size(gone) > 0, F.array_join(F.transform(places, lambda p: F.element_at(lines, p + 1)), BREAK)).otherwise(text)
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    return joined.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], n_lines.alias("n_lines"), F.size(gone).cast("bigint").alias("n_removed"))


ORACLE = """
WITH l AS (
  SELECT doc_id, md5(coalesce(text, '')) AS t, string_split(text, chr(10)) AS ls FROM documents
), w AS (
  SELECT doc_id, t, i, array_to_string(ls[i : i + 2], chr(10)) AS k
  FROM (SELECT doc_id, t, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, t, i) AS rn
  FROM w WHERE length(trim(translate(k, chr(10) || chr(13) || chr(9), '   '))) > 0
), c AS (
  SELECT doc_id, list(DISTINCT p) AS gone
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM f WHERE rn > 1) GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY p) AS text
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM l) l
  LEFT JOIN c ON c.doc_id = l.doc_id WHERE NOT coalesce(list_contains(c.gone, p), false) GROUP BY l.doc_id
)
SELECT l.doc_id, CASE WHEN l.ls IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(len(l.ls), 0)::BIGINT AS n_lines,
       coalesce(len(c.gone), 0)::BIGINT AS n_removed
FROM l LEFT JOIN kept ON kept.doc_id = l.doc_id LEFT JOIN c ON c.doc_id = l.doc_id
"""
