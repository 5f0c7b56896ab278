"""Byte-level BPE encoding and decoding (operator 1).

Each Spark partition opens its own in-process DuckDB database.  The pieces of a
text (matches of the pre-tokenizer pattern) become token-position rows, one row
a byte.  A recursive query joins neighbouring rows with the merge table and
contracts, in every piece, the leftmost pair of the lowest rank until no pair is
left.  Decoding joins the ids of a slice of texts, with an end mark after each text,
with the vocabulary and concatenates them by an ordered aggregation.

The recursion is keyed by position, so a round replaces rows instead of adding
some, and memory is that of the rows at the start.  Long pieces contract in
several places at once: a piece is cut into blocks of three times the longest
token, and a pair contracts when it comes before all pairs of its own block and
of the two beside it.  Until then nothing farther away can reach it, for no token
is longer than a third of a block; so the ids are those of one contraction after
the other, and a piece of one block has exactly one a round.

Nulls and empty texts give no ids (digest of the empty string).  A piece that is
itself in the vocabulary keeps that one id, as byte-pair libraries do.  Other
columns of the input take no part; repeated rows are encoded once each.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
import threading
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievelight.llm.hashing import batches

#: Bytes of pieces contracted by one recursive query (a longer piece has one of its
#: own), pieces remembered between slices (in each of two generations), and bytes of text
#: handled at once: they bound a worker's memory.
CHUNK_BYTES = 80_000
CACHE_PIECES = 400_000
SLICE_BYTES = 1_500_000
#: Memory of the database: a base, and what a byte of the chunk takes on top.
BASE_MB, BYTES_A_ROW = 160, 600

#: Rows are (position, token); a token of -1 is gone.  Positions are bytes, every piece
#: starting with a block of its own and leaving one empty behind it.  One round: look
#: at the next row, find each block's lowest (rank, position), and where that is before
#: those of the blocks beside it, write the merged token there and strike out the row
#: after it.
CONTRACT = """
WITH RECURSIVE state(k, tok) USING KEY (k) AS (
  SELECT k, tok FROM start
  UNION
  (WITH live AS (
    SELECT k, tok, lead((k << 20) | tok) OVER (ORDER BY k) AS n FROM recurring.state WHERE tok >= 0
  ), lowest AS (
    SELECT k // {block} AS b, min((merged << 43) | (k << 10) | ((n >> 20) - k)) AS best
    FROM live JOIN merges ON pair = (tok << 20) | (n & 1048575) WHERE (n >> 20) - k < {block} GROUP BY 1
  ), beside AS (
    SELECT best, CASE WHEN lag(b) OVER o = b - 1 THEN lag(best) OVER o END AS l,
           CASE WHEN lead(b) OVER o = b + 1 THEN lead(best) OVER o END AS r
    FROM lowest WINDOW o AS (ORDER BY b)
  ), chosen AS (
    SELECT (best >> 10) & 8589934591 AS k, best & 1023 AS step, best >> 43 AS merged
    FROM beside WHERE (l IS NULL OR best < l) AND (r IS NULL OR best < r)
  )
  SELECT k + i * step, CASE i WHEN 0 THEN merged ELSE -1 END FROM chosen, (VALUES (0), (1)) two(i))
)
SELECT k, tok FROM state WHERE tok >= 0 ORDER BY k
"""

#: The database has one thread, so the aggregate meets the rows in their order.
DECODE = """
SELECT string_agg(chars, '') AS chars FROM (SELECT v.chars FROM ids JOIN vocabulary v ON v.id = ids.id ORDER BY i)
"""
#: Id and character of the end of a text in decoding; bytes are the characters U+0000 to U+00FF.
END_ID, END_CHAR = -1, "\u0100"


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Splitter:
    """Finds the pattern's matches.

    The standard ``re`` module is faster but knows no ``\\p{..}``; its classes
    agree with them except for the characters in ``odd``, so only texts that hold
    one of those go through the ``regex`` module.
    """

    #: The one pattern (fixed value) for which ``FAST`` is an equivalent.
    KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

    def __init__(self, pattern: str):
        import regex

        self.slow = regex.compile(pattern).findall
        self.fast = re.compile(self.FAST).findall if pattern == self.KNOWN else None
        self.odd = {c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")} | set("\x1c\x1d\x1e\x1f")

    def __call__(self, text: str) -> list[str]:
        if self.fast is None or not self.odd.isdisjoint(set(text)):
            return self.slow(text)
        return self.fast(text)


class Bpe:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb

        self.ranks, self.split = ranks, Splitter(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append((left << 20) | right)
                    merged.append(rank)
        self.con = duckdb.connect(":memory:")
        self.con.execute("SET threads = 1")
        self.con.execute("SET temp_directory = ''")  # nothing goes to the worker's own disk
        self.memory(0)
        self.con.register("m", pa.table({"pair": pairs, "merged": merged}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        # one character a byte, so that any bytes are valid text
        chars = [token.decode("latin-1") for token in ranks]
        self.con.register("v", pa.table({"id": [*ranks.values(), END_ID], "chars": [*chars, END_CHAR]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT id::INTEGER AS id, chars FROM v")
        self.con.unregister("m")
        self.con.unregister("v")
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.block = 3 * max(map(len, ranks))
        self.query = CONTRACT.format(block=self.block)

    def memory(self, rows: int) -> None:
        self.con.execute(f"SET memory_limit = '{BASE_MB + rows * BYTES_A_ROW // 1_000_000}MB'")

    def contract(self, pieces: list[bytes]) -> list[str]:
        """Decimal ids of each piece, by the recursive query."""
        lens = np.array([len(p) for p in pieces], dtype=np.int64)
        blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        blocks = -(-lens // self.block) + 1
        starts = (np.cumsum(blocks) - blocks) * self.block
        k = np.arange(len(blob), dtype=np.int64) + np.repeat(starts - (np.cumsum(lens) - lens), lens)
        self.memory(len(blob))
        self.con.register("start", pa.table({"k": k, "tok": self.byte_id[blob]}))
        out = self.con.execute(self.query).fetchnumpy()
        self.con.unregister("start")
        ends = [*np.searchsorted(out["k"], starts).tolist(), len(out["k"])]
        ids = list(map(str, out["tok"].tolist()))
        return [",".join(ids[i:j]) for i, j in zip(ends, ends[1:], strict=False)]

    def learn(self, pieces: set[str]) -> None:
        """Fills the cache for these pieces: ids as decimal text."""
        todo = []
        for p in pieces:
            raw = p.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[p] = str(rank)
            else:
                todo.append((len(raw), raw, p))
        todo.sort()  # pieces of like length need like numbers of rounds
        at = 0
        while at < len(todo):
            stop, size = at, 0
            while stop < len(todo) and (stop == at or size + todo[stop][0] <= CHUNK_BYTES):
                size += todo[stop][0]
                stop += 1
            for (_, _, p), ids in zip(todo[at:stop], self.contract([raw for _, raw, _ in todo[at:stop]]), strict=True):
                self.cache[p] = ids
            at = stop

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas."""
        split = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.older, self.cache = self.cache, {}
        new = set().union(*split).difference(self.cache)
        known = new.intersection(self.older)
        self.cache.update((p, self.older[p]) for p in known)
        self.learn(new - known)
        get = self.cache.__getitem__
        return [",".join(map(get, pieces)) for pieces in split]

    def decode(self, texts: list[str]) -> list[bytes]:
        """Bytes of each list of decimal ids."""
        if not any(texts):
            return [b""] * len(texts)
        flat = np.fromstring(",".join(f"{t},{END_ID}" if t else str(END_ID) for t in texts), dtype=np.int32, sep=",")
        self.con.register("ids", pa.table({"i": np.arange(len(flat), dtype=np.int32), "id": flat}))
        ((chars,),) = self.con.execute(DECODE).fetchall()
        self.con.unregister("ids")
        return [c.encode("latin-1") for c in chars.split(END_CHAR)[:-1]]


#: Seconds without a task after which a worker gives up its encoder: the process lives on for whatever runs next.
IDLE_S = 5.0
#: The encoder of this worker process, and what it was made for; tasks that follow each other share it.
_held: tuple[str, Bpe] | None = None
_rest: threading.Timer | None = None
_lock = threading.Lock()


def encoder(key: str, ranks: dict[bytes, int], pattern: str) -> Bpe:
    global _held
    if _held is None or _held[0] != key:
        _held = (key, Bpe(ranks, pattern))
    return _held[1]


def take_up() -> None:
    """A task begins: what is held stays."""
    global _rest
    with _lock:
        _rest = None


def put_down() -> None:
    """A task has ended: what is held goes, unless another one begins in time."""
    global _rest
    with _lock:
        _rest = threading.Timer(IDLE_S, _give_up)
        _rest.daemon = True
        _rest.start()


def _give_up() -> None:
    global _held, _rest
    with _lock:
        if _rest is threading.current_thread():
            _held = _rest = None
            gc.collect()


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns ``id_col``, n_tokens, n_bytes, ids_sha256 (of the decimal ids joined
    by commas), decoded_sha256 (of the decoded bytes), round_trip (the bytes are
    those of the text) and, if asked for, the decimal ids as ``ids``.  The
    vocabulary file is read on the driver once: it has a fixed size, and workers
    get it by broadcast, so they need no path of their own.
    """
    spark = docs.sparkSession
    table = load_ranks(vocabulary)
    key = hashlib.sha256(repr((pattern, sorted(table.items()))).encode()).hexdigest()
    ranks = spark.sparkContext.broadcast(table)
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens bigint, n_bytes bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids string" * with_ids

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_up()
        try:
            yield from encoded(stream)
        finally:
            put_down()

    def encoded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in batches(stream, SLICE_BYTES):
            bpe = encoder(key, ranks.value, pattern)
            ids = bpe.encode([t.decode() for t in raw])
            back = bpe.decode(ids)
            cols = [
                batch.column(0),
                pa.array([t.count(",") + 1 if t else 0 for t in ids], pa.int64()),
                pa.array([len(r) for r in raw], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in ids]),
                pa.array([hashlib.sha256(t).hexdigest() for t in back]),
                pa.array([x == y for x, y in zip(raw, back, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids)] * with_ids, [id_col, "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256", "round_trip"] + ["ids"] * with_ids)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
