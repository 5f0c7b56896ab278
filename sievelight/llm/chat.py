"""Chat formatting of reply trees (operator 9).

Messages name the message they reply to.  Iterative self-joins by doubling (each
round joins the table of jumps with itself, so a path of length n takes log2 n
rounds) give every message its path's score and depth; the branches of a tree,
root to leaf, are ranked by score, and each chosen one becomes one conversation.

Scores add up along a branch; ties go to the deeper branch, then to the smaller
leaf.  A message whose parent is null or missing is a root.  Messages on a cycle
reach no root and belong to no branch.  Null roles and texts are empty.  Messages
with a null tree are one tree more; a null node is a node like others, so one tree
may have one.  Only the named columns of a table are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.scratch import Scratch


@dataclass(frozen=True)
class Template:
    """``<s>role, line feed, text</s>`` for each turn.

    Control strings inside roles and texts get a backslash after their first
    character, and backslashes are doubled, so no text can end its turn and every
    text is read back as it was.
    """

    begin: str = "<s>"
    end: str = "</s>"
    others: tuple[str, ...] = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: tuple[str, ...] = ("assistant",)
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def _control(self) -> re.Pattern:
        if "control" not in self._cache:
            names = "|".join(re.escape(c) for c in (self.begin, self.end, *self.others))
            self._cache["control"] = re.compile(f"(?=(?:{names}))(.)", re.S)
            self._cache["turn"] = re.compile(re.escape(self.begin) + r"((?:[^\\\n]|\\.)*)\n((?:[^\\]|\\.)*?)" + re.escape(self.end), re.S)
        return self._cache["control"]

    def escape(self, text: str) -> str:
        return self._control().sub(r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """The turn as text, and where the escaped message stands in it."""
        head = f"{self.begin}{self.escape(role).replace(chr(10), chr(92) + chr(10))}\n"
        body = self.escape(text)
        return head + body + self.end, len(head), len(head) + len(body)

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of a formatted conversation."""
        self._control()
        out, at = [], 0
        while at < len(formatted):
            m = self._cache["turn"].match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            out.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return out

    def __getstate__(self):
        return {"begin": self.begin, "end": self.end, "others": self.others, "learned": self.learned, "_cache": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)


def branches(messages: DataFrame, top: int | None = 1, tree: str = "tree", node: str = "node", parent: str = "parent", score: str | None = None) -> DataFrame:
    """Messages of the chosen root-to-leaf branches.

    Returns (tree, leaf, branch_rank, branch_score, depth, node); ``depth`` counts
    from 1 at the root.  ``top`` branches of each tree are chosen, None for all.
    ``(tree, node)`` must be a key.  Inside, both are wrapped in a struct, which makes
    every join null-safe.
    """
    scratch = Scratch(messages.sparkSession)
    value: Column = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    wrap = lambda c: F.struct(F.col(f"`{c}`").alias("v"))
    base = messages.select(wrap(tree).alias("t"), wrap(node).alias("n"), F.when(F.col(f"`{parent}`").isNotNull(), wrap(parent)).alias("p"), value.alias("s"))
    known = base.select("t", F.col("n").alias("p"), F.lit(True).alias("known"))
    first = base.join(known, ["t", "p"], "left").select("t", "n", F.when(F.col("known"), F.col("p")).alias("up"), "s", F.lit(1).cast("bigint").alias("d"))
    levels = [scratch.save(first)]
    total = levels[0].count()
    while levels[-1].where(F.col("up").isNotNull()).limit(1).count() and 2 ** (len(levels) - 1) <= total:
        # only messages that have not reached their root are joined; the others stay as they are
        state = levels[-1]
        there = state.select("t", F.col("n").alias("up"), F.col("up").alias("up2"), F.col("s").alias("s2"), F.col("d").alias("d2"))
        moved = state.where(F.col("up").isNotNull()).join(there, ["t", "up"]).select("t", "n", F.col("up2").alias("up"), (F.col("s") + F.col("s2")).alias("s"), (F.col("d") + F.col("d2")).alias("d"))
        levels.append(scratch.save(moved.unionByName(state.where(F.col("up").isNull()))))
    done = levels[-1].where(F.col("up").isNull())
    parents = levels[0].where(F.col("up").isNotNull()).select("t", F.col("up").alias("n"))
    order = Window.partitionBy("t").orderBy(F.desc("s"), F.desc("d"), "n")
    chosen = done.join(parents, ["t", "n"], "left_anti").withColumn("branch_rank", F.row_number().over(order))
    if top is not None:
        chosen = chosen.where(F.col("branch_rank") <= top)
    marked = chosen.select("t", F.col("n").alias("leaf"), "branch_rank", F.col("s").alias("branch_score"), F.col("d").alias("depth"), "n")
    for k in range(len(levels) - 2, -1, -1):  # what is 2**k above a marked message is marked too
        up = levels[k].where(F.col("up").isNotNull()).select("t", "n", "up")
        marked = scratch.save(marked)
        marked = marked.unionByName(marked.join(up, ["t", "n"]).select("t", "leaf", "branch_rank", "branch_score", (F.col("depth") - 2**k).alias("depth"), F.col("up").alias("n")))
    return marked.select(F.col("t.v").alias(tree), F.col("leaf.v").alias("leaf"), "branch_rank", "branch_score", "depth", F.col("n.v").alias(node))


def format_branches(rows: DataFrame, template: Template = Template(), keys: tuple[str, ...] = ("tree", "leaf"), order: str = "depth", role: str = "role", text: str = "text") -> DataFrame:
    """One conversation of each branch: keys, formatted, and loss, the spans (code points, from and up to) of learned messages.

    Rows are sorted within partitions and read as a stream, so memory holds one
    conversation at a time.
    """
    kinds = dict(rows.dtypes)
    n_keys = len(keys)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, spans, size = None, [], [], 0
        done: list[tuple] = []
        held = 0
        types = [pa.int64()] * n_keys
        loss_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

        def flush():
            cols = [pa.array([k[i] for k, _, _ in done], types[i]) for i in range(n_keys)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([f for _, f, _ in done]), pa.array([s for *_, s in done], loss_type)], [*keys, "formatted", "loss"])

        for batch in stream:
            types = [batch.column(i).type for i in range(n_keys)]
            for *k, r, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, "".join(parts), spans))
                        held += size
                    key, parts, spans, size = k, [], [], 0
                    if held > 4_000_000:
                        yield flush()
                        done, held = [], 0
                turn, start, stop = template.turn(r or "", x or "")
                parts.append(turn)
                if (r or "") in template.learned:
                    spans.append({"start": size + start, "stop": size + stop})
                size += len(turn)
        if key is not None:
            done.append((key, "".join(parts), spans))
        if done:
            yield flush()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, role, text)
    return dealt.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", formatted string, loss array<struct<start: bigint, stop: bigint>>")


def with_messages(path: DataFrame, messages: DataFrame, tree: str = "tree", node: str = "node", role: str = "role", text: str = "text") -> DataFrame:
    """The branches' rows with role and text of their messages; null trees and nodes meet too."""
    said = messages.select(F.struct(F.col(tree).alias("t"), F.col(node).alias("n")).alias("at"), role, text)
    return path.withColumn("at", F.struct(F.col(tree).alias("t"), F.col(node).alias("n"))).join(said, "at").drop("at")


def linear(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as trees of one branch: (tree, node, parent, role, text); turns in order, equal ones by role and text."""
    by = Window.partitionBy("tree").orderBy(turn, role, text)
    out = conversations.withColumn("tree", F.col(conv)).select("tree", turn, role, text, F.row_number().over(by).cast("bigint").alias("node"))
    return out.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), role, text)


def read_back(formatted: DataFrame, template: Template = Template(), key: str = "tree") -> DataFrame:
    """Digests of what the formatted conversations and their loss spans hold."""
    kind = dict(formatted.dtypes)[key]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in stream:
            rows = []
            for f, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = template.read(f)
                loss = "".join(template.unescape(f[s["start"] : s["stop"]]) for s in spans)
                digest = hashlib.sha256()
                for r, t in turns:
                    digest.update(f"{r}\n{t}\n".encode())
                rows.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(f)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return formatted.select(key, "formatted", "loss").mapInArrow(run, f"`{key}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
