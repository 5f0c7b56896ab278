"""Quality rules by line labelling (operator 10).

The lines of a text are a sequence; a linear-chain conditional random field marks
each as content or boilerplate (Viterbi decoding), and a document is kept if the
share of its words that stand in content lines is large enough.  Plain counts
(words, symbols, repeated lines and word windows) reject the hopeless ones first.

The field is fitted on a bounded sample of labelled documents, each of them whole.
Supervision is by line: a line is boilerplate in a document of label 0, and also in
one of label 1 where the same line stands in ``COMMON`` or more unlike documents of
the sample (licences, menus); every other line is content.  Documents whose SimHash
fingerprints lie within ``ALIKE`` bits of each other count once, so a good text does
not turn into boilerplate by being copied.  A line is seen as classes of measures of
its form, and as its words, hashed into ``LEXICON`` weights.

Null and empty texts have no words and are not kept.  Without labels of both kinds
every line counts as content.  Ids labelled more than once, and labels of both kinds
for one id, are as in ``sampling.labelled``.  Rows repeated are judged once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import sampling, simhash
from sievelight.llm.hashing import U, Words, batches, grams, mix, span_hashes
from sievelight.llm.scratch import unused

SLICE_BYTES = 500_000
#: Unlike documents that make a line common, and bits that alike ones may differ by.
COMMON, ALIKE = 3, 32
LEXICON = 4096

#: Upper bounds of the classes into which each measure of a line falls.
CLASSES = {
    "words": (0, 1, 4, 9, 29),
    "symbols": (0.0, 0.02, 0.05, 0.1, 0.2),
    "bars": (0.0, 0.03, 0.1),
    "marks": (0.0, 0.03, 0.08),
    "upper": (0.02, 0.1, 0.3, 0.6),
    "digits": (0.0, 0.05, 0.2),
    "word_length": (2.0, 4.0, 6.0, 9.0),
    "repeated": (0.0, 0.2, 0.5),
    "duplicate": (0.0,),
    "ends_sentence": (0.0,),
}
STARTS = np.cumsum([0] + [len(c) + 1 for c in CLASSES.values()])
N_FEATURES = int(STARTS[-1])


def table_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SYMBOL, BAR, MARK, DIGIT = table_of(b"#*$%&|<>"), table_of(b"|"), table_of(b"!?"), table_of(b"0123456789")
UPPER, ASCII_LETTER, STOP = table_of(bytes(range(65, 91))), table_of(bytes([*range(65, 91), *range(97, 123)])), table_of(b".!?:;\"')")


@dataclass
class Lines:
    """Counts of each text, and the features of its lines."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    offsets: np.ndarray  # of each text's first line, and the end
    line_words: np.ndarray
    features: np.ndarray  # one class of each measure a line
    keys: np.ndarray  # hash of each line
    at: np.ndarray  # of each line's first word
    lexicon: np.ndarray  # place of each word's weight

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of each line's words."""
        sums = np.append(0.0, np.cumsum(weights[self.lexicon]))
        return (sums[self.at + self.line_words] - sums[self.at]) / np.maximum(self.line_words, 1)


def measure(texts: list[bytes]) -> Lines:
    w = Words(texts, lower=False)
    n, buf = len(texts), w.buf

    def total(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[ends] - sums[starts]

    ends = np.flatnonzero(buf == 10)
    starts = np.append(0, ends[:-1] + 1)
    owner = np.searchsorted(w.first, starts, side="right") - 1
    offsets = np.append(np.searchsorted(owner, np.arange(n)), len(owner))
    text_ends = np.append(w.first[1:], len(buf)) - 1
    at = np.searchsorted(w.starts, starts)
    line_words = np.diff(np.append(at, len(w.starts)))
    lead = ((buf & 0xC0) != 0x80) & ~w.gap

    line_keys = span_hashes(buf, starts, ends)
    key = mix(line_keys ^ mix(owner.astype(np.uint64) + U(1)))
    key = np.where(line_words > 0, key, U(0))
    _, first = np.unique(key, return_index=True)
    duplicate = line_words > 0
    duplicate[first] = False

    repeated = np.zeros(len(w.starts), dtype=bool)
    hashes = w.hashes()
    windows = grams(hashes, 3)
    if len(windows):
        of = np.repeat(np.arange(n), w.counts)
        inside = of[:-2] == of[2:]
        where = np.flatnonzero(inside)
        _, inverse, counts = np.unique(mix(windows[where] ^ mix(of[where].astype(np.uint64) + U(7))), return_inverse=True, return_counts=True)
        for i in range(3):
            repeated[where[counts[inverse] > 1] + i] = True

    chars = np.maximum(total(lead, starts, ends), 1)
    letters = np.maximum(total(ASCII_LETTER[buf], starts, ends), 1)
    last_word = at + line_words - 1
    final = np.where(line_words > 0, buf[np.maximum(w.ends[np.maximum(last_word, 0)] - 1, 0)] if len(w.ends) else 0, 0)
    measures = {
        "words": line_words,
        "symbols": total(SYMBOL[buf] & ~BAR[buf], starts, ends) / chars,
        "bars": total(BAR[buf], starts, ends) / chars,
        "marks": total(MARK[buf], starts, ends) / chars,
        "upper": total(UPPER[buf], starts, ends) / letters,
        "digits": total(DIGIT[buf], starts, ends) / chars,
        "word_length": chars / np.maximum(line_words, 1),
        "repeated": total(repeated, at, at + line_words) / np.maximum(line_words, 1),
        "duplicate": duplicate,
        "ends_sentence": STOP[final],
    }
    features = np.stack([np.searchsorted(bounds, measures[name], side="left") + s for (name, bounds), s in zip(CLASSES.items(), STARTS, strict=False)], axis=1)
    line_ends = offsets[1:]
    return Lines(
        w.counts,
        total(lead, w.first, text_ends),
        total(SYMBOL[buf], w.first, text_ends),
        total(duplicate, offsets[:-1], line_ends),
        total(repeated, w.offsets[:-1], w.offsets[1:]),
        offsets,
        line_words,
        features,
        line_keys,
        at,
        (hashes >> U(32)).astype(np.int64) % LEXICON,
    )


@dataclass(frozen=True)
class Field:
    """Weights: state (feature, label), transition (label, next label), start (label), and of words for content; label 1 is content."""

    state: np.ndarray
    step: np.ndarray
    start: np.ndarray
    words: np.ndarray

    @staticmethod
    def neutral() -> Field:
        return Field(np.tile([0.0, 1.0], (N_FEATURES, 1)), np.zeros((2, 2)), np.zeros(2), np.zeros(LEXICON))

    def emit(self, lines: Lines) -> np.ndarray:
        """Score of each line for either label."""
        out = self.state[lines.features].sum(axis=1)
        out[:, 1] += lines.spread(self.words)
        return out

    def labels(self, lines: Lines) -> np.ndarray:
        """Most likely label of every line, text by text."""
        emit = self.emit(lines)
        label = np.zeros(len(emit), dtype=np.int64)
        for a, b in zip(lines.offsets, lines.offsets[1:], strict=False):
            label[a:b] = self.viterbi(emit[a:b])
        return label

    def viterbi(self, emit: np.ndarray) -> list[int]:
        """Most likely labels of one sequence; of equals the content label."""
        (s00, s01), (s10, s11) = self.step.tolist()
        rows = emit.tolist()
        a, b = rows[0][0] + self.start[0], rows[0][1] + self.start[1]
        back = []
        for e0, e1 in rows[1:]:
            to0, to1 = b + s10 >= a + s00, b + s11 >= a + s01
            a, b = (b + s10 if to0 else a + s00) + e0, (b + s11 if to1 else a + s01) + e1
            back.append((to0, to1))
        label = int(b >= a)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]

    def content_words(self, lines: Lines) -> np.ndarray:
        """Words in content lines, by text."""
        sums = np.append(0, np.cumsum(self.labels(lines) * lines.line_words))
        return sums[lines.offsets[1:]] - sums[lines.offsets[:-1]]


def families(texts: list[bytes]) -> np.ndarray:
    """A number for each text, equal for texts that are linked by fingerprints within ``ALIKE`` bits."""
    prints = np.frombuffer(b"".join(simhash.fingerprints(texts)), dtype=np.uint64).reshape(len(texts), -1)
    of = np.arange(len(texts))
    for i in range(len(texts)):
        near = np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]).sum(axis=1) <= ALIKE)
        for j in np.unique(of[near]):
            of[of == j] = i
    return of


def line_labels(lines: Lines, quality: np.ndarray, family: np.ndarray) -> np.ndarray:
    """1 (content) for the lines of good texts that are not common, else 0."""
    owner = np.repeat(np.arange(len(quality)), np.diff(lines.offsets))
    seen = np.unique(np.stack([lines.keys, family[owner].astype(np.uint64)]), axis=1)[0]
    keys, times = np.unique(seen, return_counts=True)
    common = (times >= COMMON)[np.searchsorted(keys, lines.keys)] & (lines.line_words > 0)
    return ((quality[owner] == 1) & ~common).astype(np.int64)


def train(lines: Lines, labels: np.ndarray, rounds: int = 200, ridge: float = 1e-3, word_ridge: float = 1e-4) -> Field:
    """Gradient ascent (Adam) on the conditional likelihood, by forward-backward over all whole sequences at once.

    ``labels`` has one of each line, or one of each text for all its lines.

    Lines are laid out by their place in the text, longest texts first, so the texts
    that have an i-th line are the first ones and nothing is padded.
    """
    order = np.argsort(-np.diff(lines.offsets), kind="stable")
    lens = np.diff(lines.offsets)[order]
    n, longest = len(lens), int(lens.max())
    if len(labels) == n:
        labels = np.repeat(labels, np.diff(lines.offsets))
    text = np.repeat(np.arange(n), lens)
    place = np.arange(len(text)) - np.repeat(np.cumsum(lens) - lens, lens)
    by_place = np.argsort(place, kind="stable")
    text, place = text[by_place], place[by_place]
    base = np.searchsorted(place, np.arange(longest + 1))
    line = lines.offsets[:-1][order][text] + place
    feats = lines.features[line]
    # the words of the lines, in this order of lines
    count = lines.line_words[line]
    of_line = np.repeat(np.arange(len(line)), count)
    word = lines.lexicon[np.repeat(lines.at[line] - (np.cumsum(count) - count), count) + np.arange(len(of_line))]
    part = 1 / np.maximum(count, 1)
    here = np.flatnonzero(place)
    before = base[place[here] - 1] + text[here]
    last = base[lens - 1] + np.arange(n)
    ends = np.cumsum([N_FEATURES * 2, 4, 2, LEXICON])
    theta, m1, m2 = np.zeros(ends[-1]), np.zeros(ends[-1]), np.zeros(ends[-1])
    pull = np.where(np.arange(ends[-1]) < ends[2], ridge, word_ridge)
    unpack = lambda t: (t[: ends[0]].reshape(-1, 2), t[ends[0] : ends[1]].reshape(2, 2), t[ends[1] : ends[2]], t[ends[2] :])
    lse = lambda x, axis: np.logaddexp(np.take(x, 0, axis), np.take(x, 1, axis))
    y = labels[line]
    onehot = np.stack([y == 0, y == 1], axis=1).astype(float)
    seen_steps = onehot[before].T @ onehot[here]
    for t in range(1, rounds + 1):
        state, step, start, words = unpack(theta)
        emit = state[feats].sum(axis=1)
        emit[:, 1] += np.bincount(of_line, weights=words[word], minlength=len(line)) * part
        alpha, beta = emit.copy(), np.zeros_like(emit)
        alpha[:n] += start
        for i in range(1, longest):
            now = slice(base[i], base[i + 1])
            alpha[now] += lse(alpha[base[i - 1] : base[i - 1] + base[i + 1] - base[i]][:, :, None] + step, 1)
        for i in range(longest - 2, -1, -1):
            after = slice(base[i + 1], base[i + 2])
            beta[base[i] : base[i] + base[i + 2] - base[i + 1]] = lse(step + (emit[after] + beta[after])[:, None, :], 2)
        z = lse(alpha[last], 1)
        off = onehot - np.exp(alpha + beta - z[text][:, None])
        g_state = np.zeros((N_FEATURES, 2))
        for k in range(2):
            g_state[:, k] = np.bincount(feats.ravel(), weights=np.repeat(off[:, k], feats.shape[1]), minlength=N_FEATURES)
        pair = np.exp(alpha[before][:, :, None] + step + (emit + beta)[here][:, None, :] - z[text[here]][:, None, None])
        g_step = seen_steps - pair.sum(axis=0)
        g_words = np.bincount(word, weights=(off[:, 1] * part)[of_line], minlength=LEXICON)
        grad = np.concatenate([g_state.ravel(), g_step.ravel(), off[:n].sum(axis=0), g_words]) / n - pull * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Field(*unpack(theta))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 400, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fits on at most ``per_class`` documents of each label, each of them whole."""
    rows = sorted(sampling.labelled(docs, labels, per_class, id_col, text_col, label_col))
    y = np.array([q for _, q in rows])
    if len(set(y.tolist())) < 2:
        return Field.neutral()
    texts = [t.encode() for t, _ in rows]
    lines = measure(texts)
    return train(lines, line_labels(lines, y, families(texts)))


def verdicts(lines: Lines, field: Field, min_words: int, most_repeated: float, min_content: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, content_words, kept) of each text."""
    content = field.content_words(lines)
    failed = (lines.n_words < min_words) | (100 * lines.n_repeat_words > round(100 * most_repeated) * lines.n_words)
    return failed, content, ~failed & (content >= min_content * lines.n_words)


def keep(docs: DataFrame, field: Field, text_col: str = "text", min_words: int = 50, most_repeated: float = 0.5, min_content: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, in one pass and without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names, (last,) = docs.columns, unused(docs.columns, "text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(stream, SLICE_BYTES):
            *_, kept = verdicts(measure(texts), shared.value, min_words, most_repeated, min_content)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(kept))

    return docs.select("*", F.col(text_col).alias(last)).mapInArrow(run, docs.schema)


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, most_repeated: float = 0.5, min_content: float = 0.5) -> DataFrame:
    """Counts and verdict of every row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, kept."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_words", "kept"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(stream, SLICE_BYTES):
            lines = measure(texts)
            failed, content, kept = verdicts(lines, shared.value, min_words, most_repeated, min_content)
            cols = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, failed, content, kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in cols)], [id_col, *names])

    schema = ", ".join([f"`{id_col}` {kind}"] + [f"{c} {'boolean' if c in ('base_failed', 'kept') else 'bigint'}" for c in names])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
