"""Mixing sources to target weights (operator 3) by iterative proportional fitting.

Documents are counted in words by cell (source, language, topic).  The cells'
weights are raked to the target share of each margin in turn until they settle;
no cell may be drawn more than once a document, so a share that a margin cannot
give is spread over the others.  Each document is then kept if a hash of its id
falls below its cell's probability.

Categories that a target does not name share the weight under ``OTHER``, so the
table of cells is bounded by the targets, however many sources there are.  A target
without ``OTHER`` leaves them the share of all words that they have, and its named
shares divide the rest.  Null categories count as not named.  Null and empty texts
weigh one word.  Rows with equal ids share their draw; a null id is an id.

Topics are clusters: spherical k-means of ``TOPICS`` centres over hashed words of
``LONG_WORD`` bytes or more, weighted by tf-idf, fitted on all rows (copies count as
often as they stand) and numbered from the largest.  The rows' counts of such words are
stored once, then their unit vectors; each round is a pass over these.  Vectors and
centres are whole numbers of parts of one, so sums and products are exact and neither
order nor partitions matter.  Every text is assigned by its own whole content; one
without such words has topic 0.

The columns that ``sample`` adds replace those of the same name; ``keep`` returns the
columns of its input whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.hashing import U, Words, batches
from sievelight.llm.hashing import mix as scramble
from sievelight.llm.scratch import Scratch, unused

SLICE_BYTES = 500_000
OTHER = "*"
TOPICS = 8
LONG_WORD = 6
TOPIC_SLOTS = 1024
#: Texts drawn for each first centre, of which the best is taken.
DRAWS = 4
#: Parts of one that vectors are counted in: products of two of length one stay below 2**53, so doubles hold them.
ONE = 1 << 26
#: Rows that are laid out by slot at once.
ROWS = 256
#: No cell is drawn with less than this part of the whole share, so weights stay bounded where targets cannot be met.
FLOOR = 0.001


@dataclass(frozen=True)
class Fit:
    cells: list[tuple[tuple[str, ...], int, float]]  # categories, words, probability
    achieved: dict[str, dict[str, float]]
    rounds: int


def counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; text, slot and count of each of its long words)."""
    w = Words(texts, lower=True)
    long = np.flatnonzero(w.ends - w.starts >= LONG_WORD)
    of = np.repeat(np.arange(len(texts)), w.counts)[long]
    slot = (w.hashes()[long] >> np.uint64(40)).astype(np.int64) % TOPIC_SLOTS
    key, count = np.unique(of * TOPIC_SLOTS + slot, return_counts=True)
    return w.counts, key // TOPIC_SLOTS, key % TOPIC_SLOTS, count


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; text, slot and weight 1 + ln(count) of each of its long words)."""
    n_words, of, slot, count = counts(texts)
    return n_words, of, slot, 1 + np.log(count)


def products(n: int, of: np.ndarray, slot: np.ndarray, weight: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Product of each of ``n`` texts with each centre."""
    return np.stack([np.bincount(of, weights=weight * c[slot], minlength=n) for c in centres], axis=1)


@dataclass(frozen=True)
class Topics:
    """Centres of unit length, over slots that are weighted by ``idf``."""

    idf: np.ndarray
    centres: np.ndarray

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words, topic) of each text; of equally near centres the first."""
        n_words, of, slot, weight = terms(texts)
        return n_words, products(len(texts), of, slot, weight * self.idf[slot], self.centres).argmax(axis=1)


def fit_topics(docs: DataFrame, text_col: str = "text", topics: int = TOPICS, rounds: int = 25) -> Topics:
    """Fits on all rows of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    stored = scratch.save(vectors(docs, text_col))
    model = cluster(stored, topics, rounds)
    scratch.drop(stored)
    return model


#: Columns of a row's vector: hash of the text, and slots and counts (of words, or of parts of one) as arrays of SLOT and COUNT.
VECTOR = ("hash", "slots", "counts")
SLOT, COUNT = np.dtype("<u2"), np.dtype("<u4")


def packed(size: np.ndarray, values: np.ndarray, kind: np.dtype) -> pa.Array:
    """A column of arrays of these sizes, laid end to end in ``values``."""
    ends = np.append(0, np.cumsum(size)) * kind.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.astype(kind))])


def vectors(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), words: str = "words") -> DataFrame:
    """The columns ``keep``, words and vector of every row; the vector's columns are the last."""
    kinds = dict(docs.dtypes)
    *vector, text = unused([*keep, words], *VECTOR, "text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(stream, SLICE_BYTES):
            n, of, slot, count = counts(texts)
            size = np.bincount(of, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n), batch.columns[-2], packed(size, slot, SLOT), packed(size, count, COUNT)], [*keep, words, *vector])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{words}` bigint, `{vector[0]}` bigint, `{vector[1]}` binary, `{vector[2]}` binary"])
    return docs.select(*keep, F.xxhash64(text_col).alias(vector[0]), F.col(text_col).alias(text)).mapInArrow(run, schema)


def numbers(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(length of each array, their elements) of a column of packed arrays without nulls."""
    column = column.cast(pa.binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return np.diff(ends) // kind.itemsize, data[ends[0] : ends[-1]].view(kind)


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot and weight 1 + ln(count)) of each long word; the vector's columns are the last."""
    size, slot = numbers(batch.column(batch.num_columns - 2), SLOT)
    _, count = numbers(batch.column(batch.num_columns - 1), COUNT)
    return np.repeat(np.arange(batch.num_rows), size), slot.astype(np.int64), 1 + np.log(count)


def units(stored: DataFrame, idf: np.ndarray) -> DataFrame:
    """The vectors that are not empty, by tf-idf and of length one, in parts of one."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            batch = batch.filter(pa.array(numbers(batch.column(1), SLOT)[0] > 0))
            of, slot, weight = unpacked(batch)
            x = weight * idf[slot]
            x /= np.sqrt(np.bincount(of, weights=x * x, minlength=batch.num_rows))[of]
            part = packed(np.bincount(of, minlength=batch.num_rows), np.rint(x * ONE), COUNT)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], part], batch.schema.names)

    vector = stored.select(*stored.columns[-3:])
    return vector.mapInArrow(run, vector.schema)


def laid_out(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the rows, with their vectors by slot."""
    for at in range(0, batch.num_rows, ROWS):
        rows = batch.slice(at, ROWS)
        size, slot = numbers(rows.column(1), SLOT)
        x = np.zeros(rows.num_rows * TOPIC_SLOTS)
        x[np.repeat(np.arange(rows.num_rows) * TOPIC_SLOTS, size) + slot] = numbers(rows.column(2), COUNT)[1]
        yield rows, x.reshape(-1, TOPIC_SLOTS)


#: What a task tells of its rows: whole numbers to be summed, and rows of which the one of the smallest key is wanted.
FOUND = "a int, b int, total bigint, best struct<key: double, hash: bigint, slots: binary, counts: binary>"


class Found:
    """Numbers and rows that a task has found, under pairs of numbers."""

    SCHEMA = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("total", pa.int64()), ("best", pa.struct([("key", pa.float64()), ("hash", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary())]))])

    def __init__(self):
        self.totals: dict[int, np.ndarray] = {}
        self.best: dict[tuple[int, int], tuple] = {}

    def add(self, a: int, totals: np.ndarray) -> None:
        totals = totals.astype(np.int64)
        self.totals[a] = self.totals[a] + totals if a in self.totals else totals

    def offer(self, a: int, b: int, batch: pa.RecordBatch, keys: np.ndarray) -> None:
        """The row of the smallest key; of equals that of the smallest hash."""
        least = np.flatnonzero(keys == keys.min())
        h = batch.column(0).to_numpy()[least]
        i, place = int(least[h.argmin()]), (float(keys.min()), int(h.min()))
        if (a, b) not in self.best or place < self.best[a, b][:2]:
            self.best[a, b] = (*place, batch.column(1)[i].as_py(), batch.column(2)[i].as_py())

    def batches(self) -> Iterator[pa.RecordBatch]:
        for a, totals in self.totals.items():
            b = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a), pa.int32()), pa.array(b, pa.int32()), pa.array(totals[b]), pa.nulls(len(b), self.SCHEMA.field("best").type)], schema=self.SCHEMA)
        rows = [{"a": a, "b": b, "best": dict(zip(("key", *VECTOR), row, strict=True))} for (a, b), row in self.best.items()]
        yield pa.RecordBatch.from_pylist(rows, self.SCHEMA)


def gather(stored: DataFrame, look: Callable[[Found, pa.RecordBatch], None]) -> tuple[dict, dict]:
    """Sums and best rows over all of a table of vectors."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found()
        for batch in stream:
            if batch.num_rows:
                look(found, batch)
        yield from found.batches()

    rows = stored.select(*stored.columns[-3:]).mapInArrow(run, FOUND).groupBy("a", "b").agg(F.sum("total").alias("total"), F.min("best").alias("best")).collect()
    return {(r.a, r.b): r.total for r in rows if r.total is not None}, {(r.a, r.b): r.best for r in rows if r.best is not None}


def draw(found: Found, a: int, batch: pa.RecordBatch, rate: np.ndarray) -> None:
    """Offers rows for ``DRAWS`` draws by ``rate``: the first of exponential times that are set by the text's hash."""
    h = batch.column(0).to_numpy().view(np.uint64)
    for b in range(DRAWS):
        u = ((scramble(h ^ scramble(U(b + 1))) >> U(11)).astype(float) + 0.5) / (1 << 53)
        found.offer(a, b, batch, -np.log(u) / rate)


def point(row) -> np.ndarray:
    """A found unit vector, by slot."""
    out = np.zeros(TOPIC_SLOTS)
    out[np.frombuffer(row.slots, SLOT)] = np.frombuffer(row.counts, COUNT)
    return out


def cluster(stored: DataFrame, topics: int = TOPICS, rounds: int = 25) -> Topics:
    """Spherical k-means over a table of vectors of counts.

    For each first centre texts are drawn by their squared distance from those before, and
    the one that leaves the least distance is taken; an empty cluster takes the worst
    placed text.
    """

    def frequencies(found, batch):
        size, slot = numbers(batch.column(1), SLOT)
        found.add(0, np.bincount(slot, minlength=TOPIC_SLOTS))
        found.add(1, np.array([np.count_nonzero(size)]))

    total, _ = gather(stored, frequencies)
    n = total.get((1, 0), 0)
    idf = np.log((n + 1) / (np.array([total.get((0, s), 0) for s in range(TOPIC_SLOTS)]) + 1)) + 1e-3
    if not n:
        return Topics(idf, np.zeros((topics, TOPIC_SLOTS)))
    scratch = Scratch(stored.sparkSession)
    unit = scratch.save(units(stored, idf))
    _, best = gather(unit, lambda found, batch: draw(found, 0, batch, np.ones(batch.num_rows)))
    centres = np.zeros((0, TOPIC_SLOTS))
    for k in range(topics):
        drawn = np.stack([point(best[key]) for key in sorted(best)])

        def choose(found, batch, tried=np.concatenate([centres, drawn]), k=k):
            near = np.concatenate([x @ tried.T for _, x in laid_out(batch)]) / ONE**2
            for i in range(k, len(tried)):
                far = np.maximum(1 - near[:, [*range(k), i]].max(axis=1), 1e-9)
                found.add(i - k, np.array([np.rint(far * ONE).astype(np.int64).sum()]))
                draw(found, i - k, batch, far**2)

        total, following = gather(unit, choose)
        taken = min(range(len(drawn)), key=lambda i: (total.get((i, 0), 0), i))
        centres = np.concatenate([centres, drawn[[taken]]])
        best = {key: row for key, row in following.items() if key[0] == taken}

    def assign(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Size of each cluster, and the centres that its texts make."""

        def look(found, batch):
            for rows, x in laid_out(batch):
                near = x @ centres.T
                member = near.argmax(axis=1) == np.arange(topics)[:, None]
                found.add(0, (member.astype(float) @ x).ravel())
                found.add(1, member.sum(axis=1))
                found.offer(2, 0, rows, near.max(axis=1))

        total, best = gather(unit, look)
        sums = np.zeros(topics * TOPIC_SLOTS)
        for (a, b), x in total.items():
            if a == 0:
                sums[b] = x
        sums = sums.reshape(topics, TOPIC_SLOTS)
        sizes = np.array([total.get((1, k), 0) for k in range(topics)])
        sums[sizes == 0] = point(best[2, 0])
        return sizes, np.rint(sums / np.linalg.norm(sums, axis=1, keepdims=True) * ONE)

    settled = False
    for _ in range(rounds):
        sizes, moved = assign(centres)
        if settled := np.array_equal(moved, centres):
            break
        centres = moved
    if not settled:
        sizes, _ = assign(centres)
    scratch.drop(unit)
    return Topics(idf, centres[np.argsort(-sizes, kind="stable")] / ONE)


def assigned(stored: DataFrame, model: Topics, topic: str = "topic") -> DataFrame:
    """A table of vectors with the topic of every row in place of its vector."""
    shared = stored.sparkSession.sparkContext.broadcast(model)
    kinds = dict(stored.dtypes)
    own = stored.columns[:-3]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            of, slot, weight = unpacked(batch)
            near = products(batch.num_rows, of, slot, weight * shared.value.idf[slot], shared.value.centres).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array([f"t{k}" for k in near])], [*own, topic])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + f", `{topic}` string"
    return stored.select(*own, *stored.columns[-2:]).mapInArrow(run, schema)


def fitted(docs: DataFrame, text_col: str, keep: tuple[str, ...], topics: Topics | None = None) -> tuple[Topics, DataFrame]:
    """The topics, fitted on all rows if none are given, and a stored table of the columns ``keep``, words and topic of every row."""
    scratch = Scratch(docs.sparkSession)
    stored = scratch.save(vectors(docs, text_col, keep))
    model = topics or cluster(stored)
    out = scratch.save(assigned(stored, model))
    scratch.drop(stored)
    return model, out


def with_topics(docs: DataFrame, model: Topics, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("words", "topic")) -> DataFrame:
    """``id_col``, the columns ``keep``, and words and topic (under ``names``) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    own = [id_col, *keep]
    (text,) = unused(own, "text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(stream, SLICE_BYTES):
            n, topic = shared.value.of(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array([f"t{k}" for k in topic])], [*own, *names])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + f", `{names[0]}` bigint, `{names[1]}` string"
    return docs.select(*own, F.col(text_col).alias(text)).mapInArrow(run, schema)


def category(col: str, target: Mapping[str, float]) -> Column:
    """The category of a row as the target names it."""
    named, value = [k for k in target if k != OTHER], F.col(f"`{col}`").cast("string")
    return F.when(value.isin(named), value).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def rake(words: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], share: float, most_rounds: int = 500, tol: float = 1e-9) -> tuple[np.ndarray, int]:
    """Probability of each cell.

    ``margins`` has (category index of each cell, target share of each category).
    Categories without words give their share to the others of their margin.
    Raking and clipping at one alternate; the drawn words come to ``share`` of all
    as far as the clipped cells allow.
    """
    p = np.full(len(words), share)
    total = words.sum()
    for r in range(most_rounds):
        old = p.copy()
        for index, target in margins:
            has = np.bincount(index, weights=words, minlength=len(target)) > 0
            want = np.where(has, target, 0.0)
            want = want / want.sum() if want.sum() > 0 else has / max(has.sum(), 1)
            got = np.bincount(index, weights=words * p, minlength=len(target))
            p = p * np.where(got > 0, want * total * share / np.maximum(got, 1e-300), 1.0)[index]
        p = np.clip(p, FLOOR * share, 1.0)
        if np.abs(p - old).max(initial=0) < tol:
            return p, r + 1
    return p, most_rounds


def margin(index: np.ndarray, words: np.ndarray, names: list[str], target: Mapping[str, float]) -> np.ndarray:
    """Target share of each of ``names``; an ``OTHER`` that the target does not state has its part of the words."""
    want = np.array([float(target.get(n, 0.0)) for n in names])
    if OTHER not in target and want.sum() > 0:
        other = names.index(OTHER)
        part = words[index == other].sum() / max(words.sum(), 1.0)
        want = want / want.sum() * (1 - part)
        want[other] = part
    return want


def fit(counted: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float, names: tuple[str, str] = ("words", "topic")) -> Fit:
    """Fits the cells of a table with the targets' columns and words; ``names`` are those of its words and topic."""
    cols = list(targets)
    place = {c: names[1] if c == "topic" else c for c in cols}
    weight = F.greatest(F.col(names[0]), F.lit(1))
    cells = counted.groupBy(*[category(place[c], targets[c]).alias(f"c{i}") for i, c in enumerate(cols)]).agg(F.sum(weight).alias("words"))
    rows = cells.collect()
    rows = sorted((tuple(r[:-1]), int(r[-1])) for r in rows)
    words = np.array([w for _, w in rows], dtype=np.float64)
    margins = []
    for i, c in enumerate(cols):
        names = sorted({*targets[c], OTHER})
        index = np.array([names.index(k[i]) for k, _ in rows], dtype=np.int64)
        margins.append((index, margin(index, words, names, targets[c])))
    p, rounds = rake(words, margins, share)
    drawn = max(float((words * p).sum()), 1e-300)
    achieved = {c: {} for c in cols}
    for (k, w), q in zip(rows, p, strict=True):
        for i, c in enumerate(cols):
            achieved[c][k[i]] = achieved[c].get(k[i], 0.0) + w * q / drawn
    return Fit([(k, w, float(q)) for (k, w), q in zip(rows, p.tolist(), strict=True)], achieved, rounds)


def _drawn(counted: DataFrame, targets: Mapping[str, Mapping[str, float]], cells: list, seed: int, id_col: str, names: tuple[str, str], added: tuple[str, str]) -> DataFrame:
    """Adds probability and kept, under the names ``added``."""
    probability, kept = added
    keys = unused([*counted.columns, *added], *["cell"] * len(targets))
    if cells:  # a row a cell, so bounded by the targets
        entries = [F.struct(*[F.lit(x).alias(n) for x, n in zip(k, keys, strict=True)], F.lit(p).alias(probability)) for k, _, p in cells]
        table = counted.sparkSession.range(1).select(F.inline(F.array(*entries)))
        named = counted.withColumns({n: category(names[1] if c == "topic" else c, targets[c]) for n, c in zip(keys, targets, strict=True)})
        counted = named.join(F.broadcast(table), keys).drop(*keys)
    else:
        counted = counted.withColumn(probability, F.lit(0.0))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")), 11) / F.lit(float(1 << 53))
    return counted.withColumn(kept, draw < F.col(probability))


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float = 0.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", topics: Topics | None = None) -> DataFrame:
    """``id_col``, the margins' columns, words, topic, probability, weight (of a kept row) and kept, of every row.

    ``targets`` maps columns of ``docs`` (or "topic") to shares.
    """
    own = tuple(c for c in targets if c != "topic")
    names = ("words", "topic")
    _, counted = fitted(docs, text_col, (id_col, *own), topics)
    out = _drawn(counted, targets, fit(counted, targets, share).cells, seed, id_col, names, ("probability", "kept"))
    return out.withColumn("weight", F.when(F.col("kept"), 1 / F.col("probability")))


def keep(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float = 0.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", topics: Topics | None = None) -> DataFrame:
    """The rows of ``docs`` that ``sample`` keeps: texts pass through the draw, so none is shuffled."""
    own = tuple(c for c in targets if c != "topic")
    topics, counted = fitted(docs, text_col, own, topics)
    cells = fit(counted, targets, share).cells
    words, topic, probability, kept = unused(docs.columns, "words", "topic", "probability", "kept")
    carried = with_topics(docs, topics, id_col, text_col, tuple(c for c in docs.columns if c != id_col), (words, topic))
    return _drawn(carried, targets, cells, seed, id_col, (words, topic), (probability, kept)).where(kept).select(*docs.columns)
