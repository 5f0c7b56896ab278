"""SimHash fingerprints and search within a Hamming radius (operator 5).

Every distinct word and word pair of a text is a term of weight 1 + ln(count);
its hash votes with that weight on each of ``bits`` signed bits, and the signs
are the fingerprint.  A null or empty text has the fingerprint of no votes (all
zero); equal texts have equal fingerprints.

The search deals fingerprints into block tables.  A bucket that many share is cut
into tiles, every two of which meet in one task, so no bucket is too large for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.hashing import U, Words, batches, grams, mix
from sievelight.llm.scratch import Scratch, parts_for

BITS = 128
#: Fingerprints of a bucket that one task compares with as many others.
TILE = 4096
#: Bytes of the input for each range of ids.
RANGE_BYTES = 4_000_000
SLICE_BYTES = 2_000_000


def fingerprints(texts: list[bytes], bits: int = BITS) -> list[bytes]:
    """Fingerprint of each text."""
    words = Words(texts, lower=True)
    one = words.hashes()
    two = grams(one, 2)
    out = []
    for a, b in zip(words.offsets, words.offsets[1:], strict=False):
        if a == b:
            out.append(bytes(bits // 8))
            continue
        terms, counts = np.unique(np.concatenate([one[a:b], two[a : b - 1]]), return_counts=True)
        lanes = np.stack([mix(terms + U(i * 0x9E3779B97F4A7C15 & (2**64 - 1))) for i in range(bits // 64)], axis=1)
        votes = np.unpackbits(lanes.view(np.uint8), axis=1)
        weight = (1 + np.log(counts)).astype(np.float32)
        # whole numbers, so that the sums are exact
        weight = np.round(weight * 1024)
        total = weight.sum(dtype=np.float64)
        exact = np.float32 if total < 2**24 else np.float64
        ones = weight.astype(exact) @ votes.astype(exact)
        out.append(np.packbits(2 * ones.astype(np.float64) > total).tobytes())
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    n = len(a) * 8
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / n


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``id_col`` and ``fingerprint`` (lowercase hex) of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(stream, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.hex() for f in fingerprints(texts, bits)])], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def _bits(hex_col: Column, start: int, n: int) -> Column:
    return F.substring(hex_col, start // 4 + 1, n // 4)


def _numbers(hexes: pa.Array, bits: int) -> np.ndarray:
    raw = bytes.fromhex("".join(hexes.to_pylist()))
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, bits // 64)


class Tables:
    """Block tables: a fingerprint is cut into ``blocks`` equal blocks (whole hex digits).

    Two within the radius agree on ``blocks - radius`` blocks at least, so with a
    table for each choice of that many blocks, keyed by their value, every such pair
    meets in one or more.  It counts in the first of them.
    """

    def __init__(self, radius: int, blocks: int, bits: int):
        if not 0 <= radius < blocks or bits % (4 * blocks) or bits % 64:
            raise ValueError("blocks must exceed the radius and cut the fingerprint at hex digits")
        self.radius, self.width, self.bits = radius, bits // blocks, bits
        self.choices = list(combinations(range(blocks), blocks - radius))
        self.masks = [self.mask(c) for c in self.choices]

    def mask(self, choice: tuple[int, ...]) -> np.ndarray:
        ones = sum(((1 << self.width) - 1) << (self.bits - (b + 1) * self.width) for b in choice)
        return np.frombuffer(ones.to_bytes(self.bits // 8, "big"), dtype=">u8").astype(np.uint64)

    def keys(self) -> Column:
        cut = lambda b: _bits(F.col("fingerprint"), b * self.width, self.width)
        return F.array(*[F.struct(F.lit(i).alias("table"), F.concat(*[cut(b) for b in c]).alias("value")) for i, c in enumerate(self.choices)])

    def pairs(self, table: int, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of left, rows of right, distance) of the pairs that count in this table; with ``same`` each once."""
        step = max(1, (1 << 20) // max(1, len(right)))
        for at in range(0, len(left), step):
            apart = left[at : at + step, None, :] ^ right[None, :, :]
            distance = np.bitwise_count(apart).sum(axis=2, dtype=np.int64)
            ok = distance <= self.radius
            if same:
                ok &= np.arange(at, min(at + step, len(left)))[:, None] < np.arange(len(right))[None, :]
            i, j = np.nonzero(ok)
            for m in self.masks[:table]:  # met before
                if len(i):
                    new = ((apart[i, j] & m) != 0).any(axis=1)
                    i, j = i[new], j[new]
            if len(i):
                yield i + at, j, distance[i, j]


def _tiles(prints: DataFrame, t: Tables, tile: int) -> DataFrame:
    """(table, value, x, y, side, fingerprint): the different fingerprints of every key that two or more share, dealt so that every two of a key meet in one (x, y)."""
    keyed = prints.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct().select("fingerprint", F.explode(t.keys()).alias("key")).select("fingerprint", "key.*")
    shared = keyed.groupBy("table", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keyed.join(shared, ["table", "value"]).withColumn("n", F.ceil(F.col("n") / tile).cast("int"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    return rows.withColumn("own", own).withColumn("other", other).select("table", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("side"), "fingerprint")


def _met(prints: DataFrame, t: Tables, tile: int, schema: str, emit) -> DataFrame:
    """Runs ``emit(names, pairs)`` on each tile's pairs; ``names`` are the tile's fingerprints, the left ones first."""
    dealt = _tiles(prints, t, tile)
    keys = ["table", "value", "x", "y"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "side")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, side, names = None, [], []

        def solve() -> Iterator[pa.RecordBatch]:
            if len(names) < 2:
                return
            numbers = _numbers(pa.array(names), t.bits)
            table, _, x, y = now
            n = len(names) if x == y else side.count(False)
            right = numbers if x == y else numbers[n:]
            for i, j, d in t.pairs(table, numbers[:n], right, x == y):
                yield emit(names, i, j if x == y else j + n, d)

        for batch in stream:
            for *key, s, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    yield from solve()
                    now, side, names = key, [], []
                side.append(s)
                names.append(name)
        yield from solve()

    return dealt.mapInArrow(run, schema)


def near(prints: DataFrame, radius: int = 3, blocks: int | None = None, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """All pairs of different fingerprints within ``radius`` bits: (a, b, distance), a < b.

    Equal fingerprints are one, however many texts have them; null ones are left out.
    ``prints`` has a column fingerprint.  More blocks than the radius plus one make
    more tables of smaller buckets.
    """

    def emit(names: list[str], i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        both = [sorted((names[x], names[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in both]), pa.array([p[1] for p in both]), pa.array(d, pa.int32())], ["a", "b", "distance"])

    return _met(prints, Tables(radius, blocks or radius + 1, bits), tile, "a string, b string, distance int", emit)


def neighbours(prints: DataFrame, radius: int = 3, blocks: int | None = None, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """(fingerprint, n_near): how many other fingerprints lie within ``radius`` bits, of those that have any.

    Pairs are counted where they meet and never leave their task.
    """

    def emit(names: list[str], i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        count = np.bincount(np.concatenate([i, j]), minlength=len(names))
        has = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in has.tolist()]), pa.array(count[has], pa.int64())], ["fingerprint", "n_near"])

    return _met(prints, Tables(radius, blocks or radius + 1, bits), tile, "fingerprint string, n_near bigint", emit).groupBy("fingerprint").agg(F.sum("n_near").alias("n_near"))


def with_neighbours(rows: DataFrame, radius: int = 3) -> DataFrame:
    """``rows`` (which have a fingerprint) with n_near."""
    rows = Scratch(rows.sparkSession).save(rows)
    return rows.join(neighbours(rows, radius), "fingerprint", "left").select(*rows.columns, F.coalesce("n_near", F.lit(0)).alias("n_near"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, parts: int | None = None) -> DataFrame:
    """Fingerprints each text, and the text with its second half replaced by the start of the next one.

    The next document is the one of the next smaller id (after the smallest: the
    largest; null ids come last; of equal ids that of the next smaller text hash).
    Ids must be whole numbers.  Rows are dealt into ranges of (id, text hash), so an
    id of many rows has many ranges; each range also gets a copy of the row that
    follows its last, so that one pass over sorted ranges sees every neighbour.  Rows
    repeated as a whole travel once a batch, with their number.  Texts cross the
    shuffle compressed.  Returns id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids must be whole numbers, not {kind}")
    parts = parts or parts_for(docs.select(id_col, text_col), RANGE_BYTES)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)))
    places = docs.select(key.alias("k"), F.xxhash64(text_col).alias("t"))
    cuts = {(int(b), 2**63 - 1) for b in (places.approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else [])}
    # ids of more rows than a range should have (fewer than there are ranges) are cut by text hash, too
    hot = places.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * parts > F.lit(places.count())).collect()
    for k, n in hot:
        pieces = -(-n * parts // max(1, sum(h.n for h in hot)))
        cuts |= {(k, -(2**63) + i * (2**64 // pieces)) for i in range(1, pieces)}
    own = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(t).cast("bigint").alias("t")) for k, t in sorted(cuts)]) if cuts else F.array().cast("array<struct<k:bigint,t:bigint>>")
    bucket = F.size(F.filter(own, lambda c: c < F.struct("k", "t")))
    # a row for each range, so bounded by the number of ranges
    tops = {r.bucket: (r.top.k, r.top.t) for r in places.groupBy(bucket.alias("bucket")).agg(F.max(F.struct("k", "t")).alias("top")).collect()}
    order = sorted(tops)
    follow = [(tops[b], order[(i + 1) % len(order)]) for i, b in enumerate(order)]

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch, texts in batches(stream, SLICE_BYTES):
            first: dict[tuple, int] = {}
            times: list[int] = []
            for i, at in enumerate(zip(batch.column(1).to_pylist(), texts, strict=True)):
                if at in first:
                    times[first[at]] += 1
                else:
                    first[at] = len(times)
                    times.append(1)
            rows = np.zeros(len(times), dtype=np.int64)
            seen: set[int] = set()
            for i, at in enumerate(zip(batch.column(1).to_pylist(), texts, strict=True)):
                if first[at] not in seen:
                    seen.add(first[at])
                    rows[first[at]] = i
            kept = batch.take(pa.array(rows))
            packed = pa.array([z.compress(texts[i]) for i in rows.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(times, pa.int64()), packed], ["id", "k", "t", "n", "packed"])

    rows = docs.select(F.col(id_col).alias("id"), key.alias("k"), F.xxhash64(text_col).alias("t"), F.col(text_col)).mapInArrow(pack, f"id {kind}, k bigint, t bigint, n bigint, packed binary")
    extra = F.struct(F.lit(None).cast("int").alias("bucket"), F.lit(1).alias("copy"))
    if follow:
        places_ = F.create_map(*[x for (k, t), b in follow for x in (F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(t).cast("bigint").alias("t")), F.lit(b))])
        extra = F.struct(F.try_element_at(places_, F.struct("k", "t")).alias("bucket"), F.lit(1).alias("copy"))
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("copy"))
    dealt = rows.select("*", F.explode(F.filter(F.array(own, extra), lambda x: x["bucket"].isNotNull())).alias("at")).select("id", "k", "t", "n", "at.bucket", "at.copy", "packed")
    dealt = dealt.repartition(max(1, len(tops)), "bucket").sortWithinPartitions("bucket", "copy", F.desc("k"), F.desc("t"), "packed")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        held = None  # (id, text) of the last document, until its next one comes

        def flush(todo):
            n = len(todo)
            prints = fingerprints([t for _, t, *_ in todo] + [e.encode() for _, _, _, e, _ in todo] + [x for *_, x in todo], bits)
            fp, ed, nx = prints[:n], prints[n : 2 * n], prints[2 * n :]
            cols = [
                pa.array([r[0] for r in todo], kinds),
                pa.array([r[2] for r in todo], pa.int64()),
                pa.array([hashlib.sha256(r[3].encode()).hexdigest() for r in todo], pa.string()),
                pa.array([f.hex() for f in fp], pa.string()),
                pa.array([f.hex() for f in ed], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(fp, ed, strict=True)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(fp, nx, strict=True)], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(cols, [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        todo, size, kinds = [], 0, None
        for batch in stream:
            kinds = batch.schema.field("id").type
            for i, copy, n, packed in zip(*(batch.column(c).to_pylist() for c in ("id", "copy", "n", "packed")), strict=True):
                if copy and held is None:
                    continue
                raw = z.decompress(packed)
                for _ in range(1 if copy else n):  # the next of a repeated row is the row again
                    if held is None:
                        held = (i, raw)
                        continue
                    text, after = held[1].decode(), raw.decode()
                    half = len(text) // 2
                    todo.append((held[0], held[1], len(text), text[: len(text) - half] + after[:half], raw))
                    size += 2 * len(held[1]) + len(raw)
                    held = None if copy else (i, raw)
                    if size > SLICE_BYTES:
                        yield flush(todo)
                        todo, size = [], 0
        if todo:
            yield flush(todo)

    return dealt.mapInArrow(run, f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
