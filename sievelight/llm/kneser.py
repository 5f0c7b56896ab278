"""Language-model scoring (operator 4): interpolated modified Kneser-Ney bigrams.

Counting runs in Spark: tasks aggregate their word pairs before the shuffle, deal
them by the hash of the pair (so a frequent word's pairs spread over all shards),
and a second, smaller shuffle gathers each word's continuation and context
counts.  Every shard is written once to the shared folder as sorted hash arrays;
workers memory-map them and look tokens up by binary search, sorted first.

A text's tokens are its words (A-Z lower-cased) and one end token; the first word
follows a start mark.  Null and empty texts are the end token alone.  Without
training tokens every token has probability one over one (the uniform share of an
empty vocabulary).  Words and pairs are 64-bit hashes, counts 64-bit numbers.  There
are as many shards as the input has parts of ``SHARD_BYTES``, so a shard's size does
not grow with the input, and a task holds one at a time.  Where the shared folder is
no file system, a worker reads one shard after the other and keeps none.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.hashing import U, Words, batches, mix
from sievelight.llm.scratch import Scratch, parts_for

SLICE_BYTES = 2_000_000
#: Pairs that a counting task holds before it sends them on.
HELD_PAIRS = 2_000_000
#: Bytes of the stored input for each shard.
SHARD_BYTES = 4_000_000
START, END = U(1), U(2)
COLUMNS = ("cont", "total", "context", "n1", "n2", "n3")


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * U(0x9E3779B97F4A7C15) + mix(w))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous, word, index of each text's first token and the end) of texts laid end to end."""
    words = Words(texts, lower=True)
    h = words.hashes()
    first = words.offsets + np.arange(len(words.offsets))
    out = np.full(len(h) + len(texts), END, dtype=np.uint64)
    own = np.ones(len(out), dtype=bool)
    own[first[1:] - 1] = False
    out[own] = h
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[first[:-1]] = START
    return before, out, first


def planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, first all lowest ones and so on; planes of zeros compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def columns_blob(ids: list[np.ndarray], sort: list[bool], numbers: list[np.ndarray]) -> bytes:
    """Arrays of one length, compressed together; sorted ids as differences."""
    body = b"".join(planes(np.diff(a, prepend=U(0)) if s else a) for a, s in zip(ids, sort, strict=True)) + b"".join(map(planes, numbers))
    return len(ids[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def blob_columns(blob: bytes, sort: list[bool], numbers: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), dtype=np.uint8).reshape(-1, 8, n)
    out = [np.ascontiguousarray(p.T).view("<u8").ravel().astype(np.uint64) for p in body]
    ids = [np.cumsum(x, dtype=np.uint64) if s else x for x, s in zip(out, sort, strict=False)]
    return ids + [x.astype(np.int64) for x in out[len(sort) : len(sort) + numbers]]


def least(x: np.ndarray) -> np.ndarray:
    """The same counts in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array; a repeated task writes the same bytes and replaces the file at once."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        os.makedirs(url.path, exist_ok=True)
        part = f"{url.path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, f"{url.path}/{name}.npy")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{name}.npy") as f:
        np.save(f, array)


def get(folder: str, name: str) -> np.ndarray | None:
    """Memory-maps an array, or reads it where the folder is no file system of this machine."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        path = f"{url.path}/{name}.npy"
        return np.load(path, mmap_mode="r") if os.path.exists(path) else None
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{path}/{name}.npy").type == fs.FileType.NotFound:
        return None
    with store.open_input_file(f"{path}/{name}.npy") as f:
        return np.load(f)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts one, two, and three or more; missing counts of counts give the plain ones."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3), strict=True))


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int  # log2 of the number of shards
    n: int  # training tokens
    v: int  # distinct training tokens
    pairs: int  # distinct pairs
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_counts: tuple[int, int, int]  # words of one, two, and more different predecessors


def count(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts the pairs of every text of ``docs`` and writes the model."""
    spark = docs.sparkSession
    folder = Scratch(spark).path()
    bits = max(4, (parts_for(docs.select(text_col), SHARD_BYTES, 4) - 1).bit_length())
    shards = 1 << bits

    def send(key: np.ndarray, columns: list[np.ndarray], order_by: np.ndarray, ids: int, sort: list[bool]) -> pa.RecordBatch:
        """Rows of one array set, cut by the top bits of ``key``."""
        shard = (key >> U(64 - bits)).astype(np.int64)
        order = np.lexsort((order_by, shard))
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [(s, columns_blob([c[order[a:b]] for c in columns[:ids]], sort, [c[order[a:b]] for c in columns[ids:]])) for s, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.nulls(len(rows), pa.list_(pa.int64()))], ["shard", "blob", "stats"])

    def merge(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Adds up (v, w, count) sets by pair: (key, v, w, count) sorted by key."""
        v, w, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
        key = pair_key(v, w)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.zeros(0, np.int64)
        return [key[first], v[order[first]], w[order[first]], np.add.reduceat(c[order], first) if len(first) else c]

    def tally(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, texts in batches(stream, SLICE_BYTES):
            before, word, _ = tokens(texts)
            got = merge([[before, word, np.ones(len(word), dtype=np.int64)]])
            held.append(got[1:])
            size += len(got[0])
            if size > HELD_PAIRS:
                key, v, w, c = merge(held)
                held, size = [], 0
                yield send(key, [v, w, c], v, 2, [True, False])
        if held:
            key, v, w, c = merge(held)
            yield send(key, [v, w, c], v, 2, [True, False])

    def by_shard(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes] | list[list[int]]]]:
        """Blobs of each shard in turn; statistics come as shard -1."""
        now, held = None, []
        for batch in stream:
            for s, blob, stats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if held:
                        yield now, held
                    now, held = s, []
                held.append(stats if s < 0 else blob)
        if held:
            yield now, held

    def stats_batch(stats: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([-1] * len(stats), pa.int32()), pa.nulls(len(stats), pa.binary()), pa.array(stats, pa.list_(pa.int64()))], ["shard", "blob", "stats"])

    def totals(ids: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.diff(ids, prepend=~ids[:1]) != 0)
        return [ids[first]] + [np.add.reduceat(x[order], first) for x in weights]

    def pair_shards(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, blobs in by_shard(stream):
            key, v, w, c = merge([blob_columns(b, [True, False], 1) for b in blobs])
            put(folder, f"pair-key-{s}", key)
            put(folder, f"pair-count-{s}", least(c))
            one, zero = np.ones(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
            as_word = totals(w, [one, c, zero, zero, zero, zero])
            as_context = totals(v, [zero, zero, c, (c == 1) * 1, (c == 2) * 1, (c > 2) * 1])
            ids, *numbers = totals(np.concatenate([as_word[0], as_context[0]]), [np.concatenate(x) for x in zip(as_word[1:], as_context[1:], strict=True)])
            yield send(mix(ids), [ids, *numbers], ids, 1, [True])
            yield stats_batch([[len(c)] + [int((c == k).sum()) for k in (1, 2, 3, 4)] + [0] * 6])

    def word_shards(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in by_shard(stream):
            if s < 0:
                yield stats_batch(rows)
                continue
            parts = [blob_columns(b, [True], len(COLUMNS)) for b in rows]
            ids, *numbers = totals(np.concatenate([p[0] for p in parts]), [np.concatenate([p[i] for p in parts]) for i in range(1, len(COLUMNS) + 1)])
            order = np.argsort(mix(ids))
            put(folder, f"word-key-{s}", mix(ids)[order])
            for name, x in zip(COLUMNS, numbers, strict=True):
                put(folder, f"word-{name}-{s}", least(x[order]))
            cont, total = numbers[0], numbers[1]
            yield stats_batch([[0] * 5 + [int((total > 0).sum()), int(total.sum())] + [int((cont == k).sum()) for k in (1, 2, 3, 4)]])

    schema = "shard int, blob binary, stats array<bigint>"
    pairs = docs.select(text_col).mapInArrow(tally, schema).repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(pair_shards, schema)
    words = pairs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(word_shards, schema)
    sums = words.where(F.col("stats").isNotNull()).agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(11)]).first()
    n, v = sums[6], sums[5]
    more = v - sums[7] - sums[8]
    return Model(folder, bits, n, v, sums[0], discounts(*sums[1:5]), discounts(*sums[7:11]), (sums[7], sums[8], more))


class Reader:
    """A worker's view of the model's files: memory maps, or one shard's arrays at a time."""

    def __init__(self, model: Model):
        self.m = model
        self.maps: dict[str, np.ndarray | None] = {}

    def file(self, name: str) -> np.ndarray | None:
        if name in self.maps:
            return self.maps[name]
        found = get(self.m.folder, name)
        if found is None or isinstance(found, np.memmap):
            self.maps[name] = found
        return found

    def look_up(self, kind: str, keys: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """Values of sorted distinct keys, 0 where there is none."""
        out = [np.zeros(len(keys), dtype=np.int64) for _ in columns]
        shard = (keys >> U(64 - self.m.bits)).astype(np.int64)
        ends = np.searchsorted(shard, np.arange((1 << self.m.bits) + 1))
        for s in np.unique(shard):
            a, b = ends[s], ends[s + 1]
            have = self.file(f"{kind}-key-{s}")
            if have is None or not len(have):
                continue
            at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
            hit = np.flatnonzero(have[at] == keys[a:b])
            for name, o in zip(columns, out, strict=True):
                o[a + hit] = self.file(f"{kind}-{name}-{s}")[at[hit]]
        return out

    def score(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, base log10 probability, known) of each token."""
        m = self.m
        ids, where = np.unique(np.concatenate([before, word]), return_inverse=True)
        key = mix(ids)
        order = np.argsort(key)
        numbers = [np.empty(len(ids), dtype=np.int64) for _ in COLUMNS]
        for o, x in zip(numbers, self.look_up("word", key[order], COLUMNS), strict=True):
            o[order] = x
        cont, total, context, n1, n2, n3 = numbers
        of_v, of_w = where[: len(before)], where[len(before) :]
        d, dw = m.pair_discounts, m.word_discounts
        uniform = 1 / (m.v + 1)
        if m.pairs:
            left = sum(x * k for x, k in zip(dw, m.word_counts, strict=True)) / m.pairs
            taken = np.select([cont == 0, cont == 1, cont == 2], [0.0, dw[0], dw[1]], dw[2])
            p_word = np.maximum(cont - taken, 0) / m.pairs + left * uniform
        else:
            p_word = np.full(len(ids), uniform)
        pk, pw = np.unique(pair_key(before, word), return_inverse=True)
        (c,) = self.look_up("pair", pk, ("count",))
        c = c[pw]
        size = context[of_v]
        taken = np.select([c == 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2])
        rest = (d[0] * n1 + d[1] * n2 + d[2] * n3)[of_v]
        known_context = size > 0
        safe = np.maximum(size, 1)
        p = np.where(known_context, np.maximum(c - taken, 0) / safe + rest / safe * p_word[of_w], p_word[of_w])
        base = np.log10((total[of_w] + 0.5) / (m.n + 0.5 * (m.v + 1)))
        return np.log10(p), base, total[of_w] > 0


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    kind = dict(docs.dtypes)[id_col]
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch, texts in batches(stream, SLICE_BYTES):
            before, word, first = tokens(texts)
            logp, base, known = reader.score(before, word)
            at = first[:-1]
            n = np.diff(first)
            total = np.add.reduceat(logp, at)
            cols = [n, np.add.reduceat(known.astype(np.int64), at), np.full(len(n), model.n, dtype=np.int64), np.add.reduceat(base, at), total, 10 ** np.minimum(-total / n, 300)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in cols)], [id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string")) % folds
