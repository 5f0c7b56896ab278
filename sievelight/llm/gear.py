"""Substring dedup (operator 8) by content-defined chunking.

A gear rolling hash over the last 32 bytes cuts a text wherever its top bits are
zero, so cuts depend on the content nearby and come back after an insertion.
Chunks are compared by a 128-bit digest over all texts; a chunk that occurred
before, in order of (id, text hash, position), is a repeat, and runs of
neighbouring repeats of ``min_run`` bytes or more are removed, and so is a shorter run
that is the whole text (an exact copy of a short text).

The first pass sends a row a chunk to be counted; the second cuts the texts again
and sends on only what a fixed-size filter of the repeated digests lets through
(false positives are removed by the exact join).  Null and empty texts have no
chunks.  Rows repeated as a whole (equal id and text) count as one row.  Cuts fall
between code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import bloom
from sievelight.llm.hashing import TABLE, batches
from sievelight.llm.scratch import Scratch

SLICE_BYTES = 2_000_000
GEAR = (TABLE >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Chunking:
    """A cut follows a byte where the top ``bits`` of the hash are zero, ``least`` bytes or more after the last one, and in any case after ``most`` bytes."""

    bits: int = 5
    least: int = 16
    most: int = 4096


def gear_hashes(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte; a text's hash does not reach into the text before."""
    owner = np.searchsorted(first, np.arange(len(buf)), side="right") - 1
    inside = np.arange(len(buf)) - first[owner]
    h = GEAR[buf]
    for step in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step)
        h = h + np.where(inside >= step, older, np.uint32(0))
    return h


def cuts(texts: list[bytes], c: Chunking = Chunking()) -> list[list[int]]:
    """Ends of the chunks of each text."""
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(lens) - lens
    if not len(buf):
        return [[] for _ in texts]
    full = np.flatnonzero(lens)
    at = np.flatnonzero(gear_hashes(buf, first[full]) < np.uint32(1 << (32 - c.bits))) + 1
    for _ in range(3):  # not inside a code point
        ok = at < len(buf)
        at[ok] += (buf[at[ok]] & 0xC0) == 0x80
    bounds = np.searchsorted(at, np.append(first, len(buf)), side="right")
    out = []
    for i, n in enumerate(lens.tolist()):
        ends, last = [], 0
        for e in (at[bounds[i] : bounds[i + 1]] - first[i]).tolist() + [n]:
            while e - last > c.most:
                stop = last + c.most
                while stop > last + 1 and texts[i][stop] & 0xC0 == 0x80:
                    stop -= 1
                ends.append(stop)
                last = stop
            if e - last >= c.least or e == n and e > last:
                ends.append(e)
                last = e
        out.append(ends)
    return out


def _digests(texts: list[bytes], c: Chunking) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, stop, digest as two numbers) of every chunk."""
    ends = cuts(texts, c)
    of = np.repeat(np.arange(len(texts)), [len(e) for e in ends])
    stop = np.array([e for x in ends for e in x], dtype=np.int64)
    start = np.where(np.diff(of, prepend=-1) != 0, 0, np.roll(stop, 1)) if len(stop) else stop
    make = hashlib.blake2b
    raw = b"".join(make(texts[i][a:b], digest_size=16).digest() for i, a, b in zip(of.tolist(), start.tolist(), stop.tolist(), strict=True))
    pair = np.frombuffer(raw, dtype="<i8").reshape(-1, 2).astype(np.int64)
    return of, start, stop, pair[:, 0], pair[:, 1]


def _row_keys(texts: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts], dtype=np.int64)


def _chunks(docs: DataFrame, id_col: str, text_col: str, c: Chunking, keep: np.ndarray | None = None) -> DataFrame:
    """(id, t, start, stop, a, b) of the chunks; with a filter only of those it lets through."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(stream, SLICE_BYTES):
            of, start, stop, a, b = _digests(texts, c)
            if shared is not None:
                hit = np.flatnonzero(bloom.contains(shared.value, a))
                of, start, stop, a, b = of[hit], start[hit], stop[hit], a[hit], b[hit]
            ids = batch.column(0).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([ids, pa.array(_row_keys(texts)[of]), *(pa.array(x) for x in (start, stop, a, b))], ["id", "t", "start", "stop", "a", "b"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, t bigint, start bigint, stop bigint, a bigint, b bigint")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 100, chunking: Chunking = Chunking()) -> DataFrame:
    """(id, t, spans): runs of repeated chunks of the rows that have one of ``min_run`` bytes or that might be repeated as a whole; ``t`` is the hash of the text."""
    scratch = Scratch(docs.sparkSession)
    place = F.struct("id", "t", "start")
    counted = _chunks(docs, id_col, text_col, chunking).groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    twice = scratch.save(counted.where(F.col("first") != F.col("last")).select("a", "b", "first"))
    again = _chunks(docs, id_col, text_col, chunking, bloom.build(twice.select("a")))
    later = again.join(twice, ["a", "b"]).where(F.struct("id", "t", "start") != F.col("first"))
    spans = later.groupBy("id", "t").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    merged = F.aggregate(
        "spans",
        empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] == s["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), s["stop"].alias("stop")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    spans = spans.select("id", "t", merged.alias("spans"))
    whole = (F.size("spans") == 1) & (F.col("spans")[0]["start"] == 0)
    return spans.where(whole | F.exists("spans", lambda s: s["stop"] - s["start"] >= min_run))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 100, chunking: Chunking = Chunking(), with_text: bool = True) -> DataFrame:
    """``id_col``, n_bytes, n_chunks, removed_bytes, spans and, if asked for, the text that stays, of every row."""
    kind = dict(docs.dtypes)[id_col]
    found = repeats(docs, id_col, text_col, min_run, chunking)
    span = "array<struct<start: bigint, stop: bigint>>"

    def sizes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(stream, SLICE_BYTES):
            n = [len(e) for e in cuts(texts, chunking)]
            cols = [batch.column(0), pa.array(_row_keys(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [batch.column(1)] * with_text, ["id", "t", "n_bytes", "n_chunks"] + ["text"] * with_text)

    rows = docs.select(id_col, text_col).mapInArrow(sizes, f"id {kind}, t bigint, n_bytes bigint, n_chunks bigint" + ", text string" * with_text)
    found = found.select(F.col("id").alias("fid"), F.col("t").alias("ft"), "spans")
    out = rows.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("t") == F.col("ft")), "left")
    taken = F.filter("spans", lambda s: (s["stop"] - s["start"] >= min_run) | ((s["start"] == 0) & (s["stop"] == F.col("n_bytes"))))
    out = out.withColumn("spans", taken)
    removed = F.aggregate(F.coalesce("spans", F.array().cast(span)), F.lit(0).cast("bigint"), lambda x, s: x + s["stop"] - s["start"])
    out = out.select(F.col("id").alias(id_col), "n_bytes", "n_chunks", removed.alias("removed_bytes"), F.coalesce("spans", F.array().cast(span)).alias("spans"), *(["text"] if with_text else []))
    if not with_text:
        return out

    def strip(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = []
            for raw, spans in zip(batch.column(5).cast(pa.binary()).to_pylist(), batch.column(4).to_pylist(), strict=True):
                raw, at, parts = raw or b"", 0, []
                for s in spans:
                    parts.append(raw[at : s["start"]])
                    at = s["stop"]
                texts.append((b"".join(parts) + raw[at:]).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(texts, pa.string())], [id_col, "n_bytes", "n_chunks", "removed_bytes", "spans", "text"])

    return out.mapInArrow(strip, out.schema)
