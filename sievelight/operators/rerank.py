"""Second stage: score three views of the best candidates and fuse the scores.

A scorer is any function of a DataFrame (qid, doc, note, view0, view1, view2) that
adds ce0, ce1 and ce2.  ``overlap_scorer`` needs no model; ``model_scorer`` wraps a
cross-encoder that each worker loads once.  No model's quality is claimed here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.text import tokens
from sievelight.operators.index import Index
from sievelight.operators.search import ranked, small
from sievelight.schema import Config

Scorer = Callable[[DataFrame], DataFrame]
VIEWS = ("view0", "view1", "view2")
BATCH = 50


def views(trials: DataFrame) -> DataFrame:
    """(doc, view0, view1, view2): topic, inclusion and exclusion as a scorer reads them."""
    conditions = F.array_join(F.slice("conditions", 1, 8), "; ")
    topic = F.concat(F.col("title"), F.lit(". Conditions: "), conditions, F.lit(". "), F.col("summary"))
    return trials.select("doc", topic.alias("view0"), F.coalesce(F.nullif("inclusion", F.lit("")), F.col("title")).alias("view1"), F.coalesce(F.nullif("exclusion", F.lit("")), F.lit("none")).alias("view2"))


def overlap_scorer(pairs: DataFrame) -> DataFrame:
    """Share of the note's distinct tokens that a view has."""
    said = F.array_distinct(tokens(F.col("note")))
    pairs = pairs.withColumn("said", said)
    size = F.greatest(F.size("said"), F.lit(1)).cast("double")
    scores = {f"ce{i}": F.size(F.array_intersect("said", tokens(F.col(v)))) / size for i, v in enumerate(VIEWS)}
    return pairs.withColumns(scores).drop("said")


def model_scorer(load: Callable[[], Callable[[str, list[str]], list[float]]]) -> Scorer:
    """A scorer from ``load()``, which returns a function (note, texts) -> scores; texts come in batches of ``BATCH``."""

    def scorer(pairs: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score = load()
            for frame in frames:
                for i, v in enumerate(VIEWS):
                    out = pd.Series(0.0, index=frame.index)
                    for note, group in frame.groupby("note", sort=False):
                        for at in range(0, len(group), BATCH):
                            part = group.iloc[at : at + BATCH]
                            out.loc[part.index] = list(score(note, part[v].tolist()))
                    frame[f"ce{i}"] = out
                yield frame

        return pairs.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + ", ce0 double, ce1 double, ce2 double")

    return scorer


def minmax(col: str, by: str = "qid") -> Column:
    """Scaled to 0..1 among a query's candidates; all zero where they are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return F.when(high > low, (F.col(col) - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.0)


def fuse(scored: DataFrame, cfg: Config) -> DataFrame:
    """Adds ``fused`` to candidates with final, ok, ce0, ce1, ce2."""
    fused = (1 - cfg.alpha) * minmax("final") + cfg.alpha * minmax("ce0") + cfg.inc_view * minmax("ce1") - cfg.exc_view * minmax("ce2") + cfg.elig_w * F.col("ok").cast("double")
    return scored.withColumn("fused", fused)


def score_candidates(best: DataFrame, notes: DataFrame, ix: Index, scorer: Scorer, known: DataFrame | None = None) -> DataFrame:
    """Candidates with view scores; pairs in ``known`` (qid, doc, ce0, ce1, ce2) are not scored again."""
    if known is not None:  # of all known pairs those of this batch, stored, since they are read twice
        known = small(known.select("qid", "doc", "ce0", "ce1", "ce2").join(small(best.select("qid", "doc")), ["qid", "doc"], "left_semi"))
    todo = best if known is None else best.join(known, ["qid", "doc"], "left_anti")
    pairs = views(ix.trial).join(small(todo.select("qid", "doc").join(small(notes.select("qid", "note")), "qid")), "doc")
    fresh = scorer(pairs).select("qid", "doc", "ce0", "ce1", "ce2")
    return best.join(fresh if known is None else fresh.unionByName(known), ["qid", "doc"])


def rerank(candidates: DataFrame, notes: DataFrame, ix: Index, cfg: Config, scorer: Scorer = overlap_scorer, known: DataFrame | None = None) -> DataFrame:
    """The best k records: the first ``rerank_k`` by fused score, then the others as they were.

    The cut to ``rerank_k`` stands before the scorer, so it sees no other pairs.
    """
    first = ranked(candidates, max(cfg.k, cfg.rerank_k))
    best = fuse(score_candidates(first.where(F.col("rank") <= cfg.rerank_k), notes, ix, scorer, known), cfg)
    scored = best.select("qid", "doc", "ce0", "ce1", "ce2", "fused")
    both = first.join(scored, ["qid", "doc"], "left")
    order = Window.partitionBy("qid").orderBy(F.col("rank") > cfg.rerank_k, F.desc(F.round("fused", 9)), "rank")
    return both.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= cfg.k).drop("rank").withColumnRenamed("new_rank", "rank")
