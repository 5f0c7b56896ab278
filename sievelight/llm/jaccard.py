"""N-gram Jaccard join (operator 2).

Every text becomes its set of word n-grams (64-bit hashes).  Equal sets are one
class.  A class posts its rarest n-grams, as many as two sets over the threshold
must share one of; the classes that post the same n-gram form a tile, sorted by
size and cut into bands of bounded length.  Within a tile each class has a hashed
bitmap: every bit that one has and the other lacks is an n-gram outside the
intersection, so bit counts bound the overlap from above.  Pairs that pass give a
spanning forest of candidates; its components are small clusters, in which the
sorted arrays themselves are intersected.  Nothing is dropped on the way: what a
bound rejects cannot be a link, so the result is exact (up to 64-bit collisions).

Rarity is read from a counting sketch of fixed size; whatever its counts, all
texts are ordered alike, so it only affects speed.

Nulls, empty texts and texts without words have the empty set, which is linked
with nothing.  Texts of fewer than n words have one n-gram, their whole sequence.
Ids of any type may repeat, also with different texts.  A row with a null id has the
component of its group, which is null if no row of the group has an id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm import bloom
from sievelight.llm.graph import components
from sievelight.llm.hashing import U, Words, batches, grams, mix
from sievelight.llm.scratch import Scratch, unused

SLICE_BYTES = 500_000
#: Counters of the sketch (16 MB).
SKETCH = 1 << 22
SKETCH_BLOCKS = 64
#: Classes of a band (a tile has two at most), and n-grams of the classes of a band in exact tasks.
TILE = 2048
EXACT_GRAMS = 6_000_000


@dataclass(frozen=True)
class Threshold:
    """Two sets link when 100 * intersection >= percent * union."""

    percent: int = 75

    def overlap(self, total):
        """Least intersection of two sets with ``total`` members together."""
        return -(-self.percent * total // (100 + self.percent))

    def probe(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def index(self, n: int) -> int:
        """Shorter prefix, enough against sets that are no smaller."""
        return n - self.overlap(2 * n) + 1


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    words = Words(texts, lower=True)
    h = words.hashes()
    g = grams(h, n)
    out = []
    for a, b in zip(words.offsets.tolist(), words.offsets[1:].tolist(), strict=False):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(grams(h[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> int:
    """Class of a set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        x = mix(s).sum(dtype=np.uint64) ^ (mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return int(mix(np.array([x + U(len(s))]))[0].astype(np.int64))


def width(n: int) -> int:
    """64-bit words of the bitmap of a set of n: two to four bits a member."""
    return 1 << max(0, (n - 1) // 32).bit_length()


def bitmap(s: np.ndarray) -> np.ndarray:
    words = width(len(s))
    bits = s & U(64 * words - 1)
    out = np.zeros(words, dtype=np.uint64)
    np.bitwise_or.at(out, (bits >> U(6)).astype(np.int64), U(1) << (bits & U(63)))
    return out


class Forest:
    """Spanning forest of the graph of sets whose bitmaps allow a link (or, given the sets, that do link)."""

    def __init__(self, t: Threshold, sizes: np.ndarray, maps: list[np.ndarray], sets: list[np.ndarray] | None = None, sides: np.ndarray | None = None):
        self.t, self.sizes, self.sets, self.sides = t, sizes, sets, sides
        self.bands: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        widths = np.array([len(m) for m in maps])
        self.maps = maps
        for w in np.unique(widths):
            rows = np.flatnonzero(widths == w)
            self.bands[int(w)] = (rows, np.stack([maps[i] for i in rows]))

    def neighbours(self, i: int, free: np.ndarray) -> np.ndarray:
        n, out = int(self.sizes[i]), []
        own = self.maps[i]
        for w, (rows, matrix) in self.bands.items():
            sel = free[rows] & (100 * self.sizes[rows] >= self.t.percent * n) & (self.t.percent * self.sizes[rows] <= 100 * n)
            if self.sides is not None:
                sel &= self.sides[rows] != self.sides[i]
            if not sel.any():
                continue
            ids = rows[sel]
            for at in range(0, len(ids), 1 << 14):
                part = ids[at : at + (1 << 14)]
                m = matrix[np.searchsorted(rows, part)]
                a = own
                while len(a) > w:
                    a = a[: len(a) // 2] | a[len(a) // 2 :]
                while m.shape[1] > len(a):
                    half = m.shape[1] // 2
                    m = m[:, :half] | m[:, half:]
                only_i = np.bitwise_count(a & ~m).sum(axis=1, dtype=np.int64)
                only_j = np.bitwise_count(m & ~a).sum(axis=1, dtype=np.int64)
                most = np.minimum(n - only_i, self.sizes[part] - only_j)
                out.append(part[most >= self.t.overlap(n + self.sizes[part])])
        found = np.concatenate(out) if out else np.zeros(0, np.int64)
        if self.sets is None:
            return found
        return np.array([j for j in found if self.linked(i, j)], dtype=np.int64)

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        return int(np.count_nonzero(b[at] == a)) >= self.t.overlap(len(a) + len(b))

    def edges(self) -> list[tuple[int, int]]:
        free, out = np.ones(len(self.sizes), dtype=bool), []
        for root in range(len(self.sizes)):
            if not free[root]:
                continue
            free[root] = False
            todo = [root]
            while todo:
                i = todo.pop()
                for j in self.neighbours(i, free):
                    free[j] = False
                    todo.append(int(j))
                    out.append((i, int(j)))
                if not free.any():
                    return out
        return out


def _members(docs: DataFrame, id_col: str, text_col: str, n: int, scratch: Scratch) -> DataFrame:
    """Class, size and text hash of every row; and, in rows of kind 1, each task's counts for the sketch."""
    kind = dict(docs.dtypes)[id_col]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.uint32)
        names = ["kind", "id", "t", "size", "class", "counts"]
        id_type = None
        for batch, texts in batches(stream, SLICE_BYTES):
            sets = shingles(texts, n)
            id_type = batch.column(0).type
            slots, times = np.unique(np.concatenate(sets) & U(SKETCH - 1), return_counts=True)
            counts[slots.astype(np.int64)] += times.astype(np.uint32)
            size = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * size, pa.int32()), batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(size, pa.binary())], names)
        if id_type is not None:
            parts = np.split(counts, SKETCH_BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(parts), pa.int32()), pa.nulls(len(parts), id_type), pa.nulls(len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names)

    rows = docs.select(id_col, F.xxhash64(text_col), text_col)
    return scratch.save(rows.mapInArrow(run, f"kind int, id {kind}, t bigint, size bigint, class bigint, counts binary"), ["kind"])


def _sketch(members: DataFrame) -> np.ndarray:
    """Sum of the tasks' counts, added up as a stream; its size is fixed."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in stream:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), dtype=np.uint32).astype(np.int64)
                total[block] = total[block] + part if block in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in total.values()], pa.binary())], ["size", "counts"])

    out = np.zeros((SKETCH_BLOCKS, SKETCH // SKETCH_BLOCKS), dtype=np.uint32)
    for r in members.where("kind = 1").select("size", "counts").repartition(SKETCH_BLOCKS, "size").mapInArrow(run, "size bigint, counts binary").collect():
        out[r["size"]] = np.frombuffer(r["counts"], dtype=np.uint32)
    return out.ravel()


def _postings(docs: DataFrame, text_col: str, n: int, t: Threshold, shared: Broadcast, only: Broadcast | None = None) -> DataFrame:
    """(gram, class, size, index) of the rarest n-grams of each class, once a task; of those that a filter lets through, if given."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for _, texts in batches(stream, SLICE_BYTES):
            gram, cls, size, index = [], [], [], []
            for s in shingles(texts, n):
                d = digest(s) if t.probe(len(s)) and len(s) > 1 else None
                if d is None or d in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(d)
                order = np.lexsort((s, counts[(s & U(SKETCH - 1)).astype(np.int64)]))[: t.probe(len(s))]
                first = np.arange(len(order)) < t.index(len(s))
                if only is not None:
                    passed = bloom.contains(only.value, s[order].astype(np.int64))
                    order, first = order[passed], first[passed]
                gram.append(s[order].astype(np.int64))
                index.append(first)
                cls.append(np.full(len(order), d, dtype=np.int64))
                size.append(np.full(len(order), len(s), dtype=np.int32))
            if gram:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (gram, cls, size, index)], ["gram", "class", "size", "index"])

    return docs.select(text_col).mapInArrow(run, "gram bigint, class bigint, size int, index boolean")


def _common(postings: DataFrame) -> DataFrame:
    """The n-grams that different classes post, one of them in its index prefix; tasks aggregate before the one shuffle of all postings."""
    ends = postings.groupBy("gram").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max("index").alias("index"))
    return ends.where((F.col("lo") != F.col("hi")) & F.col("index")).select("gram")


def _partnered(postings: DataFrame, t: Threshold, scratch: Scratch) -> DataFrame:
    """The postings, once a class, that some other class of the n-gram could be linked through: one whose size allows it, the smaller of the two having the n-gram in its index prefix.

    What the classes of an n-gram have in common is kept by size, so the window
    holds sizes and no classes, however many post the n-gram.
    """
    by_size = postings.groupBy("gram", "size").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max("index").alias("indexed"))
    w = Window.partitionBy("gram").orderBy("size")
    smaller = F.max(F.when(F.col("indexed"), F.col("size"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    sizes = by_size.select("gram", "size", ((F.col("lo") != F.col("hi")) & F.col("indexed")).alias("several"), smaller.alias("smaller"), F.lead("size").over(w).alias("larger"))
    below = F.coalesce(F.col("smaller") * 100 >= F.col("size") * t.percent, F.lit(False)) | F.col("several")
    above = F.coalesce(F.col("size") * 100 >= F.col("larger") * t.percent, F.lit(False))
    sizes = sizes.select("gram", "size", below.alias("below"), above.alias("above")).where("below OR above")
    rows = scratch.save(postings.join(sizes, ["gram", "size"]).where("below OR (above AND index)").select("gram", "class", "size").distinct())
    # N-grams with the same classes make the same tile, which is looked at once: its
    # key is a digest of its members (two tiles under one key would only be joined).
    digests = rows.groupBy("gram").agg(F.xxhash64(F.count(F.lit(1)), F.bit_xor(F.xxhash64("class")), F.bit_xor(F.xxhash64(F.lit(1), "class"))).alias("key"))
    return rows.join(digests, "gram").select(F.col("key").alias("gram"), "class", "size").distinct()


def _sets(docs: DataFrame, text_col: str, n: int, classes: DataFrame) -> DataFrame:
    """(class, size, map, grams) of the classes that share a posting; the filter lets a few others through, which no join meets."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom.build(classes))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for _, texts in batches(stream, SLICE_BYTES):
            rows = []
            sets = [s for s in shingles(texts, n) if len(s) > 1]
            digests = [digest(s) for s in sets]
            passed = bloom.contains(shared.value, np.array(digests, dtype=np.int64))
            for s, d, ok in zip(sets, digests, passed.tolist(), strict=True):
                if not ok or d in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(d)
                rows.append((d, len(s), bitmap(s).tobytes(), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["class", "size", "map", "grams"])

    return docs.select(text_col).mapInArrow(run, "class bigint, size int, map binary, grams binary")


def _tiles(rows: DataFrame, key: str, most: int, t: Threshold, weight: Column) -> DataFrame:
    """Deals the rows of each key into tiles of at most two bands, so that every two rows of a key whose sizes allow a link meet in one.

    A key of no more than ``most`` weight is one tile.  A larger one is cut into
    bands of about as much (twice that at most, but for chance), by size and, where
    one size is too many, by a hash of the class; each band meets itself and the later
    bands whose smallest set is not too large.  Bands are cut from the weights by size,
    so no task holds the rows of a key.
    """
    by_size = rows.groupBy(key, "size").agg(F.sum(weight).alias("weight"))
    large = by_size.groupBy(key).agg(F.sum("weight").alias("total")).where(F.col("total") > most).select(key)
    upto = F.sum("weight").over(Window.partitionBy(key).orderBy("size"))
    cuts = by_size.join(large, key, "left_semi").withColumn("upto", upto)
    cuts = cuts.select(key, "size", F.floor((F.col("upto") - F.col("weight")) / most).cast("int").alias("start"), F.floor(F.col("upto") / most).cast("int").alias("stop"))
    part = F.col("start") + F.pmod(F.xxhash64("class"), F.col("stop") - F.col("start") + 1)
    banded = rows.join(cuts, [key, "size"], "left").withColumn("band", F.coalesce(part, F.lit(0)).cast("int")).select(*rows.columns, "band")
    spans = cuts.select(key, "size", F.explode(F.sequence("start", "stop")).alias("band")).groupBy(key, "band").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    left, right = spans.select(key, F.col("band").alias("x"), F.col("hi").alias("hi_x")), spans.select(key, F.col("band").alias("y"), F.col("lo").alias("lo_y"))
    pairs = left.join(right, key).where((F.col("x") < F.col("y")) & (F.col("lo_y") * t.percent <= F.col("hi_x") * 100))
    more = pairs.select(key, "x", "y", F.explode(F.array("x", "y")).alias("band"))
    own = banded.withColumns({"x": F.col("band"), "y": F.col("band")})
    return own.unionByName(banded.join(more, [key, "band"]).select(*own.columns))


def _forests(rows: DataFrame, key: str, t: Threshold, exact: bool, extra: str) -> DataFrame:
    """Edges (a, b) of each tile's spanning forest; tiles are read as a stream of sorted rows."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, group, out = None, [], []

        def solve() -> None:
            classes = {}
            for g in group:
                classes[g[0]] = g
            items = sorted(classes.values(), key=lambda g: (g[1], g[0]))
            if len(items) < 2:
                return
            sides = np.array([g[4] for g in items]) if tile[1] != tile[2] else None
            sets = [np.frombuffer(g[3], dtype=np.uint64) for g in items] if exact else None
            forest = Forest(t, np.array([g[1] for g in items], dtype=np.int64), [np.frombuffer(g[2], dtype=np.uint64) for g in items], sets, sides)
            out.extend((items[i][0], items[j][0]) for i, j in forest.edges())

        for batch in stream:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, "x", "y", "class", "size", "map", extra, "band")]
            for k, x, y, c, size, m, g, band in zip(*cols, strict=True):
                if (k, x, y) != tile:
                    if group:
                        solve()
                    tile, group = (k, x, y), []
                group.append((c, size, m, g, band))
            if len(out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])
                out = []
        if group:
            solve()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])

    dealt = rows.repartition(key, "x", "y").sortWithinPartitions(key, "x", "y", "size")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """``id_col``, n_shingles, class_id (of equal sets) and component_id (smallest id reachable by links) of every row."""
    out = _groups(docs, id_col, text_col, words, percent, Scratch(docs.sparkSession))
    component = F.coalesce("least.id", F.when(F.col("class").isNull(), F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("class").alias("class_id"), component.alias("component_id"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """One row of each group of ``docs``: that of the smallest (id, hash of the text), null ids last.

    Rows are told apart by id and text, so different texts under one id are
    different documents, and of rows that are alike in both one stays (the smallest
    by its other columns).  Rows without words are in no group and all stay.  Texts
    are only shuffled where a filter of the rows to remove or to unite lets them through.
    """
    scratch = Scratch(docs.sparkSession)
    own = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("t") == F.col("least.t"))
    found = _groups(docs, id_col, text_col, words, percent, scratch).where(F.col("class").isNotNull())
    touched = found.groupBy("id", "t").agg(F.max(own).alias("stays"), F.count(F.lit(1)).alias("n")).where(~F.col("stays") | (F.col("n") > 1))
    touched = scratch.save(touched.select("id", "t", "stays", bloom.row_key("id", "t").alias("key")))
    tid, tt, stays, t = unused(docs.columns, "touched_id", "touched_text", "stays", "text_hash")
    clear, others = bloom.split(docs, F.xxhash64(F.col(id_col), F.xxhash64(text_col)), touched.select("key"))
    touched = touched.select(F.col("id").alias(tid), F.col("t").alias(tt), F.col("stays").alias(stays))
    others = others.withColumn(t, F.xxhash64(text_col)).join(touched, F.col(id_col).eqNullSafe(F.col(tid)) & (F.col(t) == F.col(tt)), "left")
    once = others.where(stays).groupBy(id_col, t).agg(F.min(F.struct(*docs.columns)).alias(stays)).select(f"{stays}.*")
    return clear.unionByName(others.where(F.col(stays).isNull()).select(*docs.columns)).unionByName(once)


def _groups(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(id, t, size, class, least) of every row; ``t`` is the hash of the text and ``least`` the smallest (id, t) of the row's group."""
    t = Threshold(percent)
    members = _members(docs, id_col, text_col, words, scratch)
    spread = docs.sparkSession.sparkContext.broadcast
    sketch = spread(_sketch(members))
    common = scratch.save(_common(_postings(docs, text_col, words, t, sketch)))
    postings = scratch.save(_postings(docs, text_col, words, t, sketch, spread(bloom.build(common))))
    shared = scratch.save(_partnered(postings, t, scratch))
    wanted = scratch.save(shared.select("class").distinct())
    sets = scratch.save(_sets(docs, text_col, words, wanted))
    maps = sets.select("class", "map").dropDuplicates(["class"])
    tiles = _tiles(shared, "gram", TILE, t, F.lit(1))
    candidates = scratch.save(_forests(tiles.join(maps, "class").withColumn("none", F.lit(None).cast("binary")), "gram", t, False, "none").distinct())
    clusters = components(candidates, scratch)
    # the bands of exact tasks are cut by the n-grams they hold
    sizes = sets.select("class", "size").dropDuplicates(["class"])
    light = clusters.select(F.col("node").alias("class"), "root").join(sizes, "class").select("root", "class", "size")
    exact = _tiles(light, "root", EXACT_GRAMS, t, F.col("size")).join(sets.select("class", "map", "grams"), "class")
    links = _forests(exact, "root", t, True, "grams")
    roots = scratch.save(components(links, scratch).select(F.col("node").alias("class"), "root"))
    rows = members.where("kind = 0")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    first = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(place).alias("first"))
    first = first.join(roots, "class", "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    least = first.groupBy("root").agg(F.min("first").alias("least"))
    by_class = first.join(least, "root").select("class", "least")
    return rows.select("id", "t", "size", "class").join(by_class, "class", "left")
