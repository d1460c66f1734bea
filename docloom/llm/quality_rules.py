"""Quality rules: figures of each text, and a linear-chain CRF over its lines.

Figures (the base rules) are counted over the whole text.  The method's verdict
labels every line that has a word as content or boilerplate: a conditional
random field with binary line features is fitted by maximum likelihood on a
bounded sample of labelled documents, and Viterbi decoding finds the best labelling
of every text.  The share of words in content lines decides.

Only documents have labels, so the lines' are latent (``line_labels``): they are
estimated by the field itself, first without transitions, under the constraint that
a good document has MIN_CONTENT_SHARE of its words in content lines and a poor one
less.  So a menu in a good document is boilerplate and a sentence in a poor one is
content, and the field learns how labels follow each other inside a document.

Defined cases: a null or empty text has no word and fails the base rules;
without any labelled row every line is content; repeated rows are judged one by
one, alike.  Memory: a slice of rows at a time (see kernel).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from . import kernel
from .shared import map_batches, with_text_columns

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Most labelled documents that the field is fitted on (those whose hashed id is smallest).
SAMPLE_DOCUMENTS = 4000
MIN_CONTENT_SHARE = 0.5
#: Most lines of a chain that the field is fitted on; a longer labelled text is several chains there, and one when it is decoded.
CHAIN_LINES = 512
#: Rounds of estimating the lines' labels and fitting the field on them.
ROUNDS = 2

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MADE = StructType(
    [StructField(c, LongType()) for c in FIGURES]
    + [StructField("base_failed", BooleanType()), StructField("content_share", DoubleType()), StructField("kept", BooleanType())]
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_IS_SYMBOL = _table(SYMBOLS)
_IS_UPPER = _table(bytes(range(65, 91)))
_IS_LOWER = _table(bytes(range(97, 123)))
_IS_DIGIT = _table(bytes(range(48, 58)))
_IS_SHOUT = _table(b"!?")
_IS_END = _table(b".!?:;\"'")

#: Cut points of the real-valued line features; each interval is a binary feature.
_CUTS = {
    "words": [2, 4, 8, 16, 32, 64],
    "mean_length": [2, 4, 6, 8, 12, 20],
    "symbols": [0.001, 0.02, 0.05, 0.1, 0.2],
    "upper": [0.05, 0.2, 0.5, 0.8],
    "digits": [0.01, 0.05, 0.2, 0.5],
    "shouts": [0.001, 0.02, 0.05, 0.1],
    "echoes": [0.001, 0.05, 0.2, 0.5],
}
_FLAGS = ["repeated", "ends", "first"]
N_FEATURES = sum(len(c) + 1 for c in _CUTS.values()) + len(_FLAGS)


@dataclass(frozen=True)
class LineField:
    """Weights of the field: emission[feature, label], transition[from, to]; label 1 is content."""

    emission: np.ndarray
    transition: np.ndarray


def _running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


@dataclass
class Lines:
    """Lines with a word: row, active features, words; in the order of the text."""

    row: np.ndarray
    active: np.ndarray
    n_words: np.ndarray


def figures_and_lines(words: kernel.Words) -> tuple[dict[str, np.ndarray], Lines]:
    """The base figures of each row of a slice, and its lines."""
    data, off, n = words.data, words.offsets, words.rows
    counts = words.counts()
    row_of_word = words.row_of_word()
    hashes = words.hashes()
    out = {"n_words": counts}

    points = _running((data & 0xC0) != 0x80)
    spaces = _running(kernel._SPACE[data])
    symbols = _running(_IS_SYMBOL[data])
    out["word_chars"] = np.diff(points[off]) - np.diff(spaces[off])
    out["n_symbols"] = np.diff(symbols[off])

    first, h = words.windows(hashes, WINDOW)
    key = h ^ kernel.mix(row_of_word[first].astype(np.uint64))
    found = _recurring(key)
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, first[found], 1)
    np.add.at(edges, first[found] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(row_of_word[np.cumsum(edges[:-1]) > 0], minlength=n)

    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([off[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, off[1:]]))
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, off)) + 1)
    w0 = np.searchsorted(words.starts, begin)
    n_words = np.searchsorted(words.starts, end) - w0
    solid = n_words > 0
    begin, end, row, w0, n_words = (x[solid] for x in (begin, end, row, w0, n_words))
    key = words.span_hashes(begin, end) ^ kernel.mix(row.astype(np.uint64))
    repeated = _later(key)
    out["n_dup_lines"] = np.bincount(row[repeated], minlength=n)

    chars = np.maximum(points[end] - points[begin], 1)
    upper, lower = (_running(t[data]) for t in (_IS_UPPER, _IS_LOWER))
    ups = upper[end] - upper[begin]
    echo = np.zeros(len(hashes), bool)
    echo[1:] = hashes[1:] == hashes[:-1]
    echoes = _running(echo)
    values = {
        "words": n_words,
        "mean_length": (points[end] - points[begin]) / np.maximum(n_words, 1),
        "symbols": (symbols[end] - symbols[begin]) / chars,
        "upper": ups / np.maximum(ups + lower[end] - lower[begin], 1),
        "digits": np.diff(_running(_IS_DIGIT[data])[np.stack([begin, end])], axis=0)[0] / chars,
        "shouts": np.diff(_running(_IS_SHOUT[data])[np.stack([begin, end])], axis=0)[0] / chars,
        "echoes": (echoes[w0 + n_words] - echoes[w0]) / np.maximum(n_words, 1),
    }
    columns, at = [], 0
    for name, cuts in _CUTS.items():
        columns.append(at + np.searchsorted(cuts, values[name], side="right"))
        at += len(cuts) + 1
    last_word = words.ends[np.maximum(w0 + n_words - 1, 0)] - 1 if len(words.ends) else np.zeros(0, np.int64)
    flags = [repeated, _IS_END[data[last_word]], np.r_[True, row[1:] != row[:-1]][: len(row)]]
    for k, f in enumerate(flags):
        columns.append(np.where(f, at + k, -1))
    return out, Lines(row, np.stack(columns, axis=1) if len(row) else np.zeros((0, len(_CUTS) + len(_FLAGS)), np.int64), n_words)


def _recurring(key: np.ndarray) -> np.ndarray:
    """Whether a key occurs twice or more."""
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    out = np.zeros(len(key), bool)
    out[order[same]] = out[order[same + 1]] = True
    return out


def _later(key: np.ndarray) -> np.ndarray:
    """Whether an equal key stands before."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][key[order][1:] == key[order][:-1]]] = True
    return out


def _scores(emission: np.ndarray, active: np.ndarray) -> np.ndarray:
    padded = np.vstack([emission, np.zeros((1, 2))])  # -1: no feature
    return padded[active].sum(axis=1)


class _Ragged:
    """Sequences side by side, longest first: step t holds the first width(t) of them."""

    def __init__(self, row: np.ndarray):
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        length = np.diff(np.r_[start, len(row)])
        order = np.argsort(-length, kind="stable")
        self.start, self.length = start[order], length[order]

    def steps(self):
        for t in range(int(self.length[0]) if len(self.length) else 0):
            n = int(np.searchsorted(-self.length, -t, side="left"))
            yield t, n, self.start[:n] + t


def viterbi(field: LineField, lines: Lines) -> np.ndarray:
    """The likeliest label of every line, each row's lines being one chain; ties go to boilerplate."""
    score = _scores(field.emission, lines.active)
    chains = _Ragged(lines.row)
    best = np.zeros_like(score)
    back = np.zeros(score.shape, np.int8)
    for t, _, at in chains.steps():
        if t == 0:
            best[at] = score[at]
            continue
        via = best[at - 1][:, :, None] + field.transition[None]
        back[at] = via.argmax(axis=1)
        best[at] = via.max(axis=1) + score[at]
    label = np.zeros(len(score), np.int8)
    last = chains.start + chains.length - 1
    label[last] = best[last].argmax(axis=1)
    for t, _, at in reversed(list(chains.steps())):
        if t:
            label[at - 1] = back[at, label[at]]
    return label


def _through(x: np.ndarray, step: np.ndarray) -> np.ndarray:
    """x @ step, for products this narrow."""
    return x[:, :1] * step[0] + x[:, 1:] * step[1]


def _expected(score: np.ndarray, transition: np.ndarray, steps: list, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward, scaled at every line: (marginal probability of each label of every line, expected number of transitions).

    inner: lines that have one before them in their row.
    """
    own = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
    step = np.exp(transition - transition.max())
    ahead, behind = own.copy(), np.ones_like(score)
    for t, _, at in steps:
        here = own[at] * _through(ahead[at - 1], step) if t else own[at]
        ahead[at] = here / (here[:, :1] + here[:, 1:])
    for t, _, at in reversed(steps):
        if t:
            here = _through(own[at] * behind[at], step.T)
            behind[at - 1] = here / (here[:, :1] + here[:, 1:])
    joint = ahead[inner - 1][:, :, None] * step * (own[inner] * behind[inner])[:, None, :]
    pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = ahead * behind
    return both / both.sum(axis=1, keepdims=True), pairs


def _inner(lines: Lines) -> np.ndarray:
    return np.flatnonzero(lines.row[1:] == lines.row[:-1]) + 1


def marginals(field: LineField, lines: Lines) -> np.ndarray:
    """Probability that a line is content, given all lines of its row."""
    return _expected(_scores(field.emission, lines.active), field.transition, list(_Ragged(lines.row).steps()), _inner(lines))[0][:, 1]


def fit(lines: Lines, gold: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> LineField:
    """Maximum likelihood by forward-backward and Adam; gold holds a label for each line."""
    emission, transition = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    steps = list(_Ragged(lines.row).steps())
    n = max(len(gold), 1)
    target = np.zeros((len(gold), 2))
    target[np.arange(len(gold)), gold] = 1
    inner = _inner(lines)
    pairs = np.bincount(2 * gold[inner - 1] + gold[inner], minlength=4).reshape(2, 2)
    moments = [np.zeros((N_FEATURES, 2)), np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros((2, 2))]
    for k in range(1, rounds + 1):
        marginal, expected = _expected(_scores(emission, lines.active), transition, steps, inner)
        gap = target - marginal
        slope = np.zeros((N_FEATURES + 1, 2))  # the last: no feature
        for column in (lines.active % (N_FEATURES + 1)).T:
            for label in (0, 1):
                slope[:, label] += np.bincount(column, weights=gap[:, label], minlength=N_FEATURES + 1)
        for w, g, m, v in ((emission, slope[:-1] / n - decay * emission, *moments[:2]), (transition, (pairs - expected) / n - decay * transition, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return LineField(emission, transition)


def line_labels(lines: Lines, good: np.ndarray, content: np.ndarray, share: float = MIN_CONTENT_SHARE) -> np.ndarray:
    """The likelier label of every line that its document's label admits.

    good: whether the line's document is; content: probability that the line is.  Of
    a good document the likeliest lines are content up to ``share`` of its words at
    least, of a poor one less than that are; lines that are equally likely go in order.
    """
    order = np.lexsort((-content, lines.row))
    n_words = lines.n_words[order]
    begin = np.searchsorted(lines.row, lines.row)  # first line of each line's row, in either order
    running = np.cumsum(n_words)
    until = running - (running - n_words)[begin]
    limit = share * np.bincount(lines.row, weights=lines.n_words)[lines.row]
    likely = content[order] > 0.5
    out = np.zeros(len(order), np.int64)
    out[order] = np.where(good[order], likely | (until - n_words < limit), likely & (until < limit))
    return out


def fit_latent(lines: Lines, good: np.ndarray, rounds: int = ROUNDS) -> LineField:
    """The field, from lines whose documents alone are labelled; good: whether each line's document is."""
    apart = Lines(np.arange(len(lines.row)), lines.active, lines.n_words)
    content = marginals(fit(apart, good.astype(np.int64)), apart)
    place = np.arange(len(lines.row)) - np.searchsorted(lines.row, lines.row)
    chains = Lines(np.cumsum(place % CHAIN_LINES == 0), lines.active, lines.n_words)
    for _ in range(rounds):
        field = fit(chains, line_labels(lines, good, content))
        content = marginals(field, chains)
    return field


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> LineField | None:
    """The field, from at most ``sample`` labelled documents; None without any.

    The sample is the labelled ids whose hash is smallest, so it is the same
    whatever the partitioning; only line features reach the driver, and the
    broadcast side has at most ``sample`` rows.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    made = StructType([StructField("doc_id", LongType()), StructField("quality", LongType()), StructField("features", BinaryType()), StructField("words", BinaryType())])

    def run(batches):
        for batch in batches:
            ids, quality = (batch.column(i).cast(pa.int64()) for i in (0, 1))
            blobs: list[bytes] = []
            sizes: list[bytes] = []
            for _, _, words in kernel.word_slices(batch.column(2)):
                _, lines = figures_and_lines(words)
                cut = np.searchsorted(lines.row, np.arange(words.rows + 1))
                blobs += [lines.active[a:b].astype(np.int16).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                sizes += [lines.n_words[a:b].astype(np.int64).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([ids, quality, pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], names=made.fieldNames())

    rows = found.select("doc_id", "quality", "text").transform(map_batches, run, made).orderBy("doc_id").collect()
    width = len(_CUTS) + len(_FLAGS)
    parts = [np.frombuffer(r["features"], np.int16).reshape(-1, width) for r in rows]
    if not sum(map(len, parts)):
        return None
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    good = np.repeat([r["quality"] > 0 for r in rows], [len(p) for p in parts])
    n_words = np.concatenate([np.frombuffer(r["words"], np.int64) for r in rows])
    return fit_latent(Lines(row, np.concatenate(parts).astype(np.int64), n_words), good)


def judge(field: LineField | None, min_share: float = MIN_CONTENT_SHARE):
    """fn for with_text_columns: the columns of MADE."""

    def fn(texts: pa.Array) -> list[pa.Array]:
        parts: dict[str, list[np.ndarray]] = {c: [] for c in MADE.fieldNames()}
        for _, _, words in kernel.word_slices(texts):
            out, lines = figures_and_lines(words)
            label = viterbi(field, lines) if field is not None else np.ones(len(lines.row), np.int8)
            good = np.bincount(lines.row, weights=lines.n_words * label, minlength=words.rows)
            n = out["n_words"]
            out["base_failed"] = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
            out["content_share"] = good / np.maximum(n, 1)
            out["kept"] = ~out["base_failed"] & (out["content_share"] >= min_share)
            for c, v in out.items():
                parts[c].append(v)
        kinds = [pa.int64()] * len(FIGURES) + [pa.bool_(), pa.float64(), pa.bool_()]
        return [pa.array(np.concatenate(parts[c]) if parts[c] else [], kind) for c, kind in zip(parts, kinds)]

    return fn


def apply_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", keep: list[str] | None = None, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``docs`` with the figures, ``base_failed``, ``content_share`` and ``kept``."""
    return with_text_columns(docs, text_col, MADE, judge(fit_on_labels(docs, labels, sample)), keep)
