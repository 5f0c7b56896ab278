"""Ranking metrics, parameter grids and paired tests, over many queries and systems at once."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.operators.search import candidates, ranked, read, scanned, select_terms
from sievelight.schema import Config
from sievelight.session import new_folder, save, small
from sievelight.sources.topics import Judged

METRICS = ("ndcg10", "p10", "p10_lenient", "rr", "r1000", "excluded10", "judged10")
DEPTH = 1000


def _gain() -> Column:
    return F.col("rel") / F.log2(F.col("rank") + 1)


def ideal(qrels: DataFrame | Judged) -> DataFrame:
    """(qid, idcg, n_eligible) of the judgements, from how many of each grade a query has: those of one grade are worth the same."""
    counts = qrels.counts() if isinstance(qrels, Judged) else qrels.groupBy("qid", "rel").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("qid").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1)
    places = F.when(F.col("first") <= 10, F.sequence("first", F.least(F.col("first") + F.col("n") - 1, F.lit(10)))).otherwise(F.array().cast("array<bigint>"))
    gain = F.aggregate(places, F.lit(0.0), lambda s, r: s + F.col("rel") / F.log2(r + 1))
    return ranks.groupBy("qid").agg(F.sum(gain).alias("idcg"), F.coalesce(F.sum(F.when(F.col("rel") == 2, F.col("n"))), F.lit(0)).alias("n_eligible"))


def _beside(run: DataFrame, qrels: DataFrame | Judged) -> tuple[DataFrame, DataFrame]:
    """A run and the judgements (qid, doc, rel) of its records, at least; the run is stored where it is read twice for that."""
    if not isinstance(qrels, Judged):
        return run, qrels.select("qid", "doc", "rel")
    run = save(run, new_folder(run.sparkSession))
    return run, small(qrels.of(run.select("qid", "doc").distinct()))


def metrics(run: DataFrame, qrels: DataFrame | Judged, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Metrics of each query of a run (qid, doc, rank); records without a judgement count as not relevant.

    ``by`` may name more columns that tell systems apart.
    """
    run, grades = _beside(run.where(F.col("rank") <= DEPTH), qrels)
    judged = run.join(grades.withColumnRenamed("rel", "grade"), ["qid", "doc"], "left")
    judged = judged.withColumn("rel", F.coalesce("grade", F.lit(0)))
    top = F.col("rank") <= 10
    sums = judged.groupBy(*by).agg(
        F.sum(F.when(top, _gain()).otherwise(0.0)).alias("dcg"),
        (F.count_if(top & (F.col("rel") == 2)) / 10).alias("p10"),
        (F.count_if(top & (F.col("rel") >= 1)) / 10).alias("p10_lenient"),
        F.coalesce(1 / F.min(F.when(F.col("rel") == 2, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.count_if(F.col("rel") == 2).alias("found"),
        (F.count_if(top & (F.col("rel") == 1)) / 10).alias("excluded10"),
        (F.count_if(top & F.col("grade").isNotNull()) / 10).alias("judged10"),
    )
    joined = sums.join(ideal(qrels), "qid", "left")
    ratio = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    return joined.select(*by, ratio(F.col("dcg"), F.col("idcg")).alias("ndcg10"), "p10", "p10_lenient", "rr", ratio(F.col("found").cast("double"), F.col("n_eligible").cast("double")).alias("r1000"), "excluded10", "judged10")


def condensed(run: DataFrame, qrels: DataFrame | Judged, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The run's judged records only, numbered anew."""
    w = Window.partitionBy(*by).orderBy("rank")
    run, grades = _beside(run, qrels)
    return run.join(grades.select("qid", "doc"), ["qid", "doc"], "left_semi").withColumn("rank", F.row_number().over(w))


def means(per_query: DataFrame, by: tuple[str, ...] = ("system",)) -> DataFrame:
    names = [c for c in per_query.columns if c not in by and c != "qid"]
    return per_query.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names])


def best(scored: DataFrame, score: str, order: str) -> DataFrame:
    """The row of the best score; of equals the first of the grid."""
    return scored.orderBy(F.desc(F.round(score, 9)), order).limit(1)


def grid(spark, points: Iterable[dict[str, float]]) -> DataFrame:
    """A table of parameter points, numbered from 0."""
    entries = [F.struct(F.lit(i).alias("point"), *[F.lit(float(v)).alias(k) for k, v in p.items()]) for i, p in enumerate(points)]
    return spark.range(1).select(F.inline(F.array(*entries)))


def fusion_runs(cached: DataFrame, points: DataFrame) -> DataFrame:
    """(point, qid, doc, rank) of candidates (qid, doc, final, ok, ce0, ce1, ce2) under every point (alpha, inc_view, exc_view, elig_w): one job for the whole grid.

    Scaling does not depend on the point, so it is done once.
    """
    from sievelight.operators.rerank import minmax

    scaled = cached.select("qid", "doc", minmax("final").alias("f"), minmax("ce0").alias("c0"), minmax("ce1").alias("c1"), minmax("ce2").alias("c2"), F.col("ok").cast("double").alias("e"))
    fused = (1 - F.col("alpha")) * F.col("f") + F.col("alpha") * F.col("c0") + F.col("inc_view") * F.col("c1") - F.col("exc_view") * F.col("c2") + F.col("elig_w") * F.col("e")
    every = scaled.crossJoin(points)  # a grid has a few hundred rows, which Spark broadcasts by their measured size
    w = Window.partitionBy("point", "qid").orderBy(F.desc(F.round(fused, 9)), F.desc(F.round("f", 9)), "doc")
    return every.withColumn("rank", F.row_number().over(w)).select("point", "qid", "doc", "rank")


def hashed_folds(queries: DataFrame, k: int = 5) -> DataFrame:
    """Adds ``fold`` by a hash of the query id."""
    digest = F.md5(F.col("qid").cast("string"))
    return queries.withColumn("fold", ((F.ascii(F.substring(digest, 1, 1)) * 7 + F.ascii(F.substring(digest, 2, 1))) % k).cast("int"))


def cross_validate(per_point: DataFrame, k: int = 5, score: str = "ndcg10", folds: DataFrame | None = None) -> DataFrame:
    """(fold, point, train, test): for each fold the point that is best on the other folds, and its mean on this one.

    ``per_point`` has (point, qid, score); ``folds`` (qid, fold), by default a hash of the id.
    """
    placed = hashed_folds(per_point, k) if folds is None else per_point.join(folds, "qid")
    sums = placed.groupBy("point", "fold").agg(F.sum(score).alias("s"), F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("point")
    parts = sums.select("point", "fold", (F.col("s") / F.col("c")).alias("test"), ((F.sum("s").over(whole) - F.col("s")) / F.nullif(F.sum("c").over(whole) - F.col("c"), F.lit(0))).alias("train"))
    w = Window.partitionBy("fold").orderBy(F.desc(F.round("train", 9)), "point")
    return parts.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def paired(per_query: DataFrame, a: str, b: str, score: str = "ndcg10") -> DataFrame:
    """One row: n, mean difference b - a, t, wins and losses of b."""
    x = per_query.where(F.col("system") == a).select("qid", F.col(score).alias("x"))
    y = per_query.where(F.col("system") == b).select("qid", F.col(score).alias("y"))
    d = F.col("y") - F.col("x")
    out = x.join(y, "qid").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))
    t = F.when(F.col("sd") > 0, F.col("delta") / (F.nullif(F.col("sd"), F.lit(0.0)) / F.sqrt("n")))
    return out.select("n", "delta", t.alias("t"), "wins", "losses")


def judgement_stats(qrels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return qrels.groupBy(*by).agg(F.count_if(F.col("rel") == 0).alias("not_relevant"), F.count_if(F.col("rel") == 1).alias("excluded"), F.count_if(F.col("rel") == 2).alias("eligible"), F.count_distinct("qid").alias("topics"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / (d or tiny), c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_pvalue(t: float, n: int) -> float:
    """Two-sided p-value of a paired t statistic over n pairs."""
    return beta_cdf((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


def wilcoxon_pvalue(differences: list[float]) -> float:
    """Two-sided signed-rank p-value: exact for at most 50 differences without ties or zeros, else normal; 1 if all are zero."""
    d = [x for x in differences if x]
    if not d:
        return 1.0
    order = sorted(range(len(d)), key=lambda i: abs(d[i]))
    rank, ties, i = [0.0] * len(d), 0.0, 0
    while i < len(order):
        j = i
        while j < len(order) and abs(d[order[j]]) == abs(d[order[i]]):
            j += 1
        for k in range(i, j):
            rank[order[k]] = (i + 1 + j) / 2
        ties += (j - i) ** 3 - (j - i)
        i = j
    n = len(d)
    w = min(sum(r for r, x in zip(rank, d, strict=True) if x > 0), sum(r for r, x in zip(rank, d, strict=True) if x < 0))
    if n <= 50 and not ties and n == len(differences):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var)) if var > 0 else 1.0


def significance(per_query: DataFrame, pairs: list[tuple[str, str]], score: str = "ndcg10") -> DataFrame:
    """(a, b, n, delta, t_p, wilcoxon_p, wins, losses) of pairs of systems.  A group has a row a query."""
    wanted = per_query.sparkSession.createDataFrame(pairs, "a string, b string")
    x = per_query.select(F.col("system").alias("a"), "qid", F.col(score).alias("x"))
    y = per_query.select(F.col("system").alias("b"), "qid", F.col(score).alias("y"))

    def test(frame):
        import pandas as pd

        d = (frame["y"] - frame["x"]).to_numpy(dtype=float)
        n, sd = len(d), float(d.std(ddof=1)) if len(d) > 1 else 0.0
        t_p = t_pvalue(d.mean() / (sd / math.sqrt(n)), n) if sd > 0 else (1.0 if not d.any() else 0.0)
        row = (frame["a"].iloc[0], frame["b"].iloc[0], n, float(d.mean()), t_p, wilcoxon_pvalue(d.tolist()), int((d > 0).sum()), int((d < 0).sum()))
        return pd.DataFrame([row], columns=["a", "b", "n", "delta", "t_p", "wilcoxon_p", "wins", "losses"])

    joined = wanted.join(x, "a").join(y, ["b", "qid"])
    return joined.groupBy("a", "b").applyInPandas(test, "a string, b string, n bigint, delta double, t_p double, wilcoxon_p double, wins bigint, losses bigint")


def permuted_folds(qids: list[str], k: int = 5, seed: int = 0) -> dict[str, int]:
    """Fold of each query: a seeded permutation of the given order, cut into ``k`` parts of nearly equal size."""
    import numpy as np

    order = np.random.RandomState(seed).permutation(len(qids))
    return {qids[i]: fold for fold, part in enumerate(np.array_split(order, k)) for i in part}


def shown(table: DataFrame, focus: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Systems of a table of means, without those that equal ``focus`` in every metric."""
    own = table.where(F.col("system") == focus).select(*[F.col(m).alias(f"own_{m}") for m in metrics])
    same = F.lit(True)
    for m in metrics:
        same = same & F.col(m).eqNullSafe(F.col(f"own_{m}"))
    return table.crossJoin(own).where((F.col("system") == focus) | ~same).select(*table.columns)


def merged_points(points: DataFrame) -> DataFrame:
    """(label, x, y, n) of a curve (n, label, x, y) in order of n: neighbours at the same place are one point, its labels joined by " = "."""
    order = Window.orderBy("n")  # a curve has a few points
    moved = F.when(F.lag("n").over(order).isNull() | (F.lag("x").over(order) != F.col("x")) | (F.lag("y").over(order) != F.col("y")), 1).otherwise(0)
    runs = points.withColumn("moved", moved).withColumn("run", F.sum("moved").over(order))
    labels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda p: p["label"]), " = ")
    return runs.groupBy("run", "x", "y").agg(F.min("n").alias("n"), labels.alias("label")).select("label", "x", "y", "n")


def relative_gain(a: Column, b: Column) -> Column:
    """How many percent a exceeds b, as whole number text."""
    return F.format_string("%.0f", (a / b - 1) * 100)


def p_text(p: Column) -> Column:
    """A p-value as text: three decimals, or powers of ten below 0.001."""
    e = F.floor(F.log10(F.greatest(p, F.lit(1e-300))))
    return F.when(p >= 1e-3, F.format_string("%.3f", p)).otherwise(F.format_string("%.1f\\times 10^{%d}", p / F.pow(F.lit(10.0), e), e))


#: Characters that TeX reads in its own way, and how they are written.
TEX = [("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\^{}")]


def tex(text: Column) -> Column:
    """Text for TeX: backslashes become blanks, special characters are escaped; the braces of an escape stay as they are."""
    by = F.create_map(*[F.lit(x) for pair in TEX for x in pair])
    chars = F.regexp_extract_all(F.replace(text, F.lit("\\"), F.lit(" ")), F.lit("(?s)."), F.lit(0))
    return F.array_join(F.transform(chars, lambda c: F.coalesce(F.try_element_at(by, c), c)), "")


def html(text: Column) -> Column:
    out = text
    for c, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(to))
    return out


def latex_rows(table: DataFrame, metrics: tuple[str, ...], lower_is_better: tuple[str, ...] = ("excluded10",)) -> DataFrame:
    """(system, line): rows of a LaTeX table, the best value of every column in bold."""
    best = table.agg(*[(F.min(m) if m in lower_is_better else F.max(m)).alias(f"best_{m}") for m in metrics])
    cell = lambda m: F.when(F.col(m) == F.col(f"best_{m}"), F.format_string("\\textbf{%.3f}", m)).otherwise(F.format_string("%.3f", m))
    line = F.concat(F.concat_ws(" & ", tex(F.col("system")), *[cell(m) for m in metrics]), F.lit(" \\\\"))
    return table.crossJoin(best).select("system", line.alias("line"))


def write_latex(rows: DataFrame, heads: list[str], path: str) -> None:
    """A whole LaTeX table as a text file; tables of systems have a few rows."""
    lines = ["\\begin{tabular}{l" + "r" * len(heads) + "}", "\\toprule", "System & " + " & ".join(heads) + " \\\\", "\\midrule", *[r.line for r in rows.orderBy("system").collect()], "\\bottomrule", "\\end{tabular}"]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def write_results(table: DataFrame, path: str) -> None:
    """A table of results as one JSON document."""
    import json

    with open(path, "w") as f:
        json.dump([r.asDict(recursive=True) for r in table.collect()], f, indent=1, default=list)


def walkthrough(before: DataFrame, after: DataFrame, qrels: DataFrame, notes: DataFrame, most_chars: int = 700) -> DataFrame:
    """(qid, gain) of the short note that gains most between two runs: eligible records won plus excluded ones lost in the first ten; of equals the first."""
    side = lambda run, sign: run.where(F.col("rank") <= 10).select("qid", "doc", F.lit(sign).alias("sign"))
    run, grades = _beside(side(before, -1).union(side(after, 1)), qrels)
    both = run.join(grades, ["qid", "doc"])
    worth = F.when(F.col("rel") == 2, 1).when(F.col("rel") == 1, -1).otherwise(0)
    gains = both.groupBy("qid").agg(F.sum(worth * F.col("sign")).alias("gain"))
    short = notes.where(F.length("note") < most_chars).select("qid").join(gains, "qid", "left").na.fill(0, ["gain"])
    return short.orderBy(F.desc("gain"), F.length("qid"), "qid").limit(1)


# The grids of the tuning cascade and of fusion.
ZONE_GRID = (0.0, 0.5, 1.0, 2.0, 3.0)
EXC_GRID = (0.0, 0.2, 0.4, 0.6, 1.0, 1.5)
NEG_GRID = (0.0, 0.2, 0.4, 0.6, 1.0)
PEN_RATIOS = (0.05, 0.1)
SOFT_GRID = (0.1, 0.25, 0.5, 1.0)
PRF_GRID = {"prf_docs": (5, 10, 20), "prf_terms": (10, 20), "prf_w": (0.5, 1.0)}
FUSION_GRID = {"alpha": (0.0, 0.3, 0.5, 0.7, 0.85, 1.0), "inc_view": (0.0, 0.1, 0.2, 0.4), "exc_view": (0.0, 0.1, 0.2, 0.4), "elig_w": (0.0, 0.2, 0.5)}
ELIMINATION = (10, 20, 40, 80, 0)
UNREAD = {"abbrev": False, "negation": False, "family": False}


def points(grid: dict[str, tuple]) -> list[dict]:
    """Every combination of a grid's values, the last name running fastest."""
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def ladder(best: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """Fusion systems that take up one view after the other."""
    none = dict.fromkeys(FUSION_GRID, 0.0)
    steps = [("topic view alone", {"alpha": 1.0}), ("with topic view", {"alpha": best["alpha"]})]
    for name, key in (("with inclusion view", "inc_view"), ("with exclusion view", "exc_view"), ("all", "elig_w")):
        steps.append((name, {**steps[-1][1], key: best[key]}))
    return [(name, none | step) for name, step in steps]


class Readings:
    """Notes read once for each choice of note settings, and stored."""

    def __init__(self, notes: DataFrame, ix):
        self.notes, self.ix, self.stored = notes, ix, {}

    def __call__(self, c: Config) -> tuple[DataFrame, ...]:
        key = (c.abbrev, c.negation, c.family)
        if key not in self.stored:
            self.stored[key] = tuple(save(part, new_folder(part.sparkSession)) for part in read(self.notes, self.ix, c))
        return self.stored[key]


class Trial:
    """Mean nDCG@10 of settings over notes; every new setting's run is stored, and their metrics are one job."""

    def __init__(self, notes: DataFrame, ix, qrels: DataFrame):
        self.readings, self.ix, self.known = Readings(notes, ix), ix, {}
        self.qrels = qrels if isinstance(qrels, Judged) else save(qrels, new_folder(qrels.sparkSession))

    def many(self, settings: list[Config]) -> list[float]:
        new = [c for c in dict.fromkeys(settings) if c not in self.known]
        if new:
            runs = _runs([(str(i), c) for i, c in enumerate(new)], self.readings, self.ix, 10)
            scored = means(metrics(runs, self.qrels, ("system", "qid")).select("system", "qid", "ndcg10"))
            found = {r["system"]: r["ndcg10"] for r in scored.collect()}
            self.known |= {c: found.get(str(i), 0.0) for i, c in enumerate(new)}
        return [self.known[c] for c in settings]

    def __call__(self, cfg: Config) -> float:
        return self.many([cfg])[0]


def _runs(named: list[tuple[str, Config]], readings: Readings, ix, depth: int) -> DataFrame:
    """(system, qid, doc, rank) of named settings, one stored after the other, so that no plan holds more than one search."""
    folder = new_folder(ix.trial.sparkSession)
    for i, (name, c) in enumerate(named):
        terms, negated, who = readings(c)
        run = ranked(candidates(terms, who, ix, c, negated), depth).select(F.lit(name).alias("system"), "qid", "doc", F.col("rank").cast("int").alias("rank"))
        run.write.parquet(f"{folder}/run={i}")
    return ix.trial.sparkSession.read.parquet(folder).drop("run")


def _best(score, options: list[Config]) -> Config:
    """The option of the best score; of equals the first."""
    scores = score.many(options) if hasattr(score, "many") else [score(c) for c in options]
    return options[scores.index(max(scores))]


def tune_zones(score, cfg: Config, rounds: int = 2) -> Config:
    """Coordinate ascent over zone weights; ``score(cfg)`` is a mean metric, equal scores keep the earlier weight of the grid."""
    for _ in range(rounds):
        for z in range(len(cfg.zone_w)):
            cfg = _best(score, [cfg.but(zone_w=(*cfg.zone_w[:z], w, *cfg.zone_w[z + 1 :])) for w in ZONE_GRID])
    return cfg


def cascade(score, start: Config = Config(), rounds: int = 2) -> dict[str, Config]:
    """Tunes one part of search after the other, each on top of the best so far, and gives the settings of every step."""
    out = {"raw": tune_zones(score, start.but(**UNREAD), rounds)}

    def step(name: str, base: str, grid: dict[str, tuple]) -> None:
        out[name] = _best(score, [out[base].but(**p) for p in points(grid)])

    step("profile", "raw", dict.fromkeys(UNREAD, (False, True)))
    step("hard", "profile", {"params": ("hard",)})
    step("soft", "profile", {"params": ("soft",), "soft": SOFT_GRID})
    out["params"] = _best(score, [out["hard"], out["soft"]])
    step("prf", "params", PRF_GRID)
    step("exclusion", "prf", {"exc_w": EXC_GRID, "pen_ratio": PEN_RATIOS})
    step("full", "exclusion", {"neg_w": NEG_GRID})
    return out


def penalty_curves(score: Trial, full: Config) -> dict[str, list[float]]:
    """Scores along the weight of each penalty, all else as in ``full``."""
    return {"exc_w": score.many([full.but(exc_w=w) for w in EXC_GRID]), "neg_w": score.many([full.but(neg_w=w) for w in NEG_GRID])}


def systems(tuned: dict[str, Config]) -> list[tuple[str, Config]]:
    """Baselines on the plain note, and the steps of the cascade."""
    plain = [("TF-IDF", Config(model="tfidf", **UNREAD)), ("BM25", Config(model="bm25", **UNREAD)), ("BM25F", tuned["raw"])]
    steps = {"notes read": "profile", "eligibility": "params", "feedback": "prf", "exclusion penalty": "exclusion", "full": "full"}
    return plain + [(name, tuned[key]) for name, key in steps.items()]


def ablations(full: Config, soft: float | None = None) -> list[tuple[str, Config]]:
    """Named systems, each with one operator taken away or another filter."""
    without = {
        "no note processing": UNREAD, "no eligibility": {"params": "off"}, "no feedback": {"prf_docs": 0}, "no exclusion penalty": {"exc_w": 0.0},
        "no negation penalty": {"neg_w": 0.0}, "hard filter": {"params": "hard"}, "soft filter": {"params": "soft", "soft": full.soft if soft is None else soft},
    }
    return [("full", full), *((name, full.but(**change)) for name, change in without.items())]


def compare(named: list[tuple[str, Config]], notes: DataFrame, ix, qrels: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(system, qid, metrics, the condensed ndcg10 and p10, scanned) of named settings, as one plan."""
    readings = Readings(notes, ix)
    runs, work = _runs(named, readings, ix, depth), None
    for name, c in named:
        kept = select_terms(readings(c)[0], ix, c).where("kept")
        seen = scanned(kept, c).select(F.lit(name).alias("system"), "qid", "scanned")
        work = seen if work is None else work.union(seen)
    by = ("system", "qid")
    own = metrics(runs, qrels, by)
    judged = metrics(condensed(runs, qrels, by), qrels, by).select(*by, F.col("ndcg10").alias("ndcg10_judged"), F.col("p10").alias("p10_judged"))
    return own.join(judged, list(by), "left").join(work, list(by), "left").na.fill(0.0)
