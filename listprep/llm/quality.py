"""Document quality by a linear-chain conditional random field over lines.

Every line is a place in a chain with two states, bad and good. Its inputs are measures of the
line itself (shares of letters, capitals, digits, marks and repeated words, lengths, and what
is common in it) and of its neighbours on both sides; two states in a row have a weight of
their own. The field is fitted on labelled documents by its likelihood, every document weighing
the same, the state of every line of a document being the document's label; the sums of each step
are taken where the documents' inputs lie. A document's score is the mean of its lines' marginal
probabilities of being good, from the forward-backward pass, weighed by their lengths in bytes.

The fit uses ``SAMPLE`` labelled documents at most, as many of either label as there are up to
half of it, taken by a hash of ``doc_id``, and of each all its lines. Only the text is an
input. Null and empty texts are one empty line. Labels that are null count as missing; of
several labels for one document the smaller counts. Without labels of both kinds the score is
the share of good labels, 0.5 without any. Rows that repeat a ``doc_id``, or have none, are
scored each by its own text. A table without rows gives none; columns beside those named are not
looked at, whatever their names. A chain is as long as its document. Scores have no ties to break.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import words
from .tables import arrow_map

SAMPLE = 4000
#: Most steps of the fit, and steps it remembers; the fit ends when the loss hardly falls.
STEPS = 60
MEMORY = 8
PENALTY = 1e-3
FIT_TASKS = 8
#: Lines of chains that are worked out in one go; only the memory depends on it.
GROUP_LINES = 1 << 16

_CLASSES = np.zeros((6, 256), dtype=bool)
_CLASSES[0, [*range(97, 123)]] = True
_CLASSES[1, [*range(65, 91)]] = True
_CLASSES[2, [*range(48, 58)]] = True
_CLASSES[3] = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-?!" for b in range(256)])
_CLASSES[4] = np.array([chr(b) in ".,;:'\"-?!" for b in range(256)])
_CLASSES[5, 128:] = True
OWN = 15
WIDTH = 3 * OWN + 3


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of all lines (rows), where each text's lines begin, and their lengths in bytes."""
    data, text_start = words.text_bytes(texts)
    ends = np.flatnonzero(data == 10)
    text_end = text_start[1:]
    # a line ends at a line feed or with its text
    owner_first = np.concatenate([[0], np.cumsum(1 + np.searchsorted(ends, text_end) - np.searchsorted(ends, text_start[:-1]))])
    starts, stops = np.empty(owner_first[-1], dtype=np.int64), np.empty(owner_first[-1], dtype=np.int64)
    first, last = owner_first[:-1], owner_first[1:] - 1
    breaks = np.ones(owner_first[-1], dtype=bool)
    breaks[last] = False
    stops[last], stops[breaks] = text_end, ends
    begins = np.ones(owner_first[-1], dtype=bool)
    begins[first] = False
    starts[first], starts[begins] = text_start[:-1], ends + 1
    length = stops - starts

    def per_line(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[stops] - sums[starts]

    counts = [per_line(kind[data]) for kind in _CLASSES]
    found = words.split_words(data, text_start)
    line_first = np.searchsorted(found.start, starts)
    n_words = np.searchsorted(found.start, stops) - line_first
    same = np.zeros(len(found.hashes), dtype=bool)
    same[1:] = found.hashes[1:] == found.hashes[:-1]
    word_sums = np.concatenate([[0], np.cumsum(same)])
    repeats = word_sums[line_first + n_words] - word_sums[line_first]
    long = np.concatenate([[0], np.cumsum(found.end - found.start > 20)])
    marked = np.zeros(len(found.start), dtype=bool)
    if len(found.start):
        marked = _CLASSES[3][data[found.end - 1]] | ((data[found.end - 1] == 33) & (data[np.maximum(found.end - 2, 0)] == 33))
    marks = np.concatenate([[0], np.cumsum(marked)])
    # words of a line met earlier in it, over windows of 64 words
    window = np.arange(len(found.hashes)) - np.repeat(line_first, n_words)
    line_of = np.repeat(np.arange(len(starts)), n_words)
    key = words.mix(found.hashes ^ (line_of.astype(np.uint64) << np.uint64(20)) ^ (window // 64).astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    agains = np.concatenate([[0], np.cumsum(again)])
    whole, some = np.maximum(length, 1), np.maximum(n_words, 1)
    own = np.column_stack(
        [
            *[count / whole for count in counts],
            repeats / some,
            (agains[line_first + n_words] - agains[line_first]) / some,
            (long[line_first + n_words] - long[line_first]) / some,
            (marks[line_first + n_words] - marks[line_first]) / some,
            np.log1p(length) / 8,
            np.log1p(n_words) / 6,
            length / some / 20,
            length == 0,
            n_words < 4,
        ]
    ).astype(np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    edge = np.zeros((len(own), 2))
    edge[first, 0], edge[last, 1] = 1, 1
    return np.hstack([own, before, after, edge, np.ones((len(own), 1))]), owner_first, length


@dataclass
class Field:
    """``weights``: of the inputs for the good state; ``between``: [from, to] of two states in a row."""

    weights: np.ndarray
    between: np.ndarray
    constant: float | None = None


def _products(factors: np.ndarray, place: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of each place's 2 x 2 factor with those before it in its chain, over spans that double:
    ``place`` counts from 0 in the chain. The logarithm of what was divided out is kept aside."""
    cells, scale, reach = [factors[:, i, j].copy() for i in (0, 1) for j in (0, 1)], scale.copy(), 1
    far = np.flatnonzero(place >= reach)
    while len(far):
        a, b, c, d = (cell[far - reach] for cell in cells)
        e, f, g, h = (cell[far] for cell in cells)
        joined = [a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h]
        top = np.maximum.reduce(joined)
        scale[far] = scale[far - reach] + scale[far] + np.log(top)
        for cell, product in zip(cells, joined):
            cell[far] = product / top
        reach *= 2
        far = far[place[far] >= reach]
    return np.stack(cells, axis=1).reshape(-1, 2, 2), scale


def marginals(
    score: np.ndarray, first: np.ndarray, between: np.ndarray, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of the good state per line, expected counts of [from, to], and the sum of the
    chains' log partition functions, both weighed per chain; ``score`` is the good state's, the bad
    one has 0.

    Messages forward and backward are products of a 2 x 2 matrix per line, taken over spans that
    double, so that a chain of any length takes as many steps as its length has binary digits.
    """
    lengths = np.diff(first)
    weights = np.ones(len(lengths)) if weights is None else weights
    n = len(score)
    if n == 0:
        return np.empty(0), np.zeros((2, 2)), 0.0
    score = np.clip(score, -300, 300)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - first[owner]
    moves = between[None] + np.stack([np.zeros(n), score], axis=1)[:, None, :]
    opening = place == 0
    # the first line has no line before it: both rows are its own scores
    moves[opening] = np.stack([np.zeros(opening.sum()), score[opening]], axis=1)[:, None, :]
    top = moves.max(axis=(1, 2))
    factors = np.exp(moves - top[:, None, None])
    ahead, scale = _products(factors, place, top)
    ahead = ahead[:, 0, :]
    # from the end: the line after, transposed, so that the products run the same way
    behind = np.ones((n, 2))
    left = np.flatnonzero(place < lengths[owner] - 1)
    turned = np.repeat(np.eye(2)[None], n, axis=0)
    turned[left] = np.transpose(factors[left + 1], (0, 2, 1))
    back, _ = _products(turned[::-1], (lengths[owner] - 1 - place)[::-1], np.zeros(n))
    behind = back[::-1].sum(axis=1)
    joint = ahead * behind
    good = joint[:, 1] / joint.sum(axis=1)
    inner = np.flatnonzero(~opening)
    pair = ahead[inner - 1][:, :, None] * factors[inner] * behind[inner][:, None, :]
    pair *= (weights[owner[inner]] / pair.sum(axis=(1, 2)))[:, None, None]
    ends = first[1:] - 1
    total = float(weights @ (scale[ends] + np.log(ahead[ends].sum(axis=1))))
    return good, pair.sum(axis=0), total


def objective(theta: np.ndarray, x: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The chains' negative log-likelihood, weighed per chain, and its gradient; without penalty."""
    score, between = x @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    lines = np.diff(first)
    good, pairs, total = marginals(score, first, between, weights)
    state, weight = np.repeat(labels, lines).astype(float), np.repeat(weights, lines)
    stays = np.zeros((2, 2))
    for mark in (0, 1):
        stays[mark, mark] = weights[labels == mark] @ (lines[labels == mark] - 1)
    loss = total - float(weight @ (state * score)) - float((stays * between).sum())
    return loss, np.concatenate([x.T @ (weight * (good - state)), (pairs - stays).ravel()])


def minimise(measure: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """The weights of least loss (with a small penalty), by limited-memory BFGS; ``measure`` is
    called about once a step."""

    def whole(theta):
        loss, gradient = measure(theta)
        return loss + penalty / 2 * float(theta @ theta), gradient + penalty * theta

    theta, pasts = np.zeros(size), []
    loss, gradient = whole(theta)
    for _ in range(steps):
        direction, held = -gradient, []
        for moved, turned, rho in reversed(pasts):
            held.append(rho * float(moved @ direction))
            direction = direction - held[-1] * turned
        if pasts:
            moved, turned, _ = pasts[-1]
            direction = direction * (float(moved @ turned) / float(turned @ turned))
        else:
            direction = direction / max(1.0, float(np.linalg.norm(direction)))
        for (moved, turned, rho), share in zip(pasts, reversed(held)):
            direction = direction + (share - rho * float(turned @ direction)) * moved
        slope, length = float(gradient @ direction), 1.0
        while True:
            new_loss, new_gradient = whole(theta + length * direction)
            if new_loss <= loss + 1e-4 * length * slope or length < 1e-6:
                break
            length /= 2
        moved, turned = length * direction, new_gradient - gradient
        gained = loss - new_loss
        theta, loss, gradient = theta + moved, new_loss, new_gradient
        if float(moved @ turned) > 1e-12:
            pasts = [*pasts[-(MEMORY - 1) :], (moved, turned, 1 / float(moved @ turned))]
        if gained < 1e-6 * max(1.0, abs(loss)):
            break
    return theta


def _field(theta: np.ndarray) -> Field:
    return Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def chain_weights(lines: np.ndarray, labels: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Every document of a label, and either label, weighs the same, whatever its lines."""
    return np.where(labels == 1, 0.5 / max(n_good, 1), 0.5 / max(n_bad, 1)) / lines


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Field:
    """The field of highest likelihood for chains that lie in memory."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), float(labels.mean()) if len(labels) else 0.5)
    weights = chain_weights(np.diff(first), labels, int((labels == 0).sum()), int((labels == 1).sum()))
    return _field(minimise(lambda theta: objective(theta, x, first, labels, weights), WIDTH + 4))


def document_scores(texts: pa.Array, field: Field) -> np.ndarray:
    if field.constant is not None:
        return np.full(len(texts), field.constant)
    x, first, length = line_features(texts)
    good, _, _ = marginals(x @ field.weights, first, field.between)
    weight = np.maximum(length, 1).astype(float)
    sums = np.concatenate([[0.0], np.cumsum(good * weight)])
    weights = np.concatenate([[0.0], np.cumsum(weight)])
    return np.clip((sums[first[1:]] - sums[first[:-1]]) / (weights[first[1:]] - weights[first[:-1]]), 0, 1)


def train(documents: DataFrame, labels: DataFrame, sample_size: int = SAMPLE) -> Field:
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.min("quality").cast("int").alias("quality"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = None
    for mark in (0, 1):
        part = marks.filter(F.col("quality") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_size // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most ``sample_size`` rows of two numbers
    sample = texts.join(F.broadcast(materialise(chosen, "quality-labels")), "doc_id")

    counts = {row.quality: row.n for row in sample.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), float(next(iter(counts), 0.5)))

    def inputs(batch):
        for i, j in words.slices(batch.column("text")):
            x, first, _ = line_features(batch.column("text").slice(i, j - i))
            held = [x[a:b].astype(np.float32).tobytes() for a, b in zip(first, first[1:])]
            parts = [batch.column(name).slice(i, j - i) for name in ("doc_id", "quality")]
            yield pa.RecordBatch.from_arrays([*parts, pa.array(held, pa.binary())], names=["doc_id", "quality", "held"])

    rows = materialise(arrow_map(sample, "doc_id long, quality int, held binary", inputs).repartition(FIT_TASKS, "doc_id"), "quality-inputs")

    def measure(theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss and gradient, summed in the tasks; of each batch some numbers come to the driver."""

        def per_batch(batch):
            labels, held = batch.column("quality").to_numpy(), batch.column("held")
            chains = [np.frombuffer(h.as_buffer(), dtype=np.float32).reshape(-1, WIDTH) for h in held]
            bounds = np.cumsum([0, *map(len, chains)])
            total, begin = np.zeros(1 + len(theta)), 0
            while begin < len(chains):
                # chains of some lines together, one at least
                end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + GROUP_LINES, side="right")) - 1)
                first = bounds[begin : end + 1] - bounds[begin]
                weights = chain_weights(np.diff(first), labels[begin:end], counts[0], counts[1])
                loss, gradient = objective(theta, np.concatenate(chains[begin:end]).astype(np.float64), first, labels[begin:end], weights)
                total += np.concatenate([[loss], gradient])
                begin = end
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(0, 1), pa.array([total.tolist()])], names=["doc_id", "sums"])

        sums = arrow_map(rows, "doc_id long, sums array<double>", per_batch).collect()
        total = np.sum([row.sums for row in sorted(sums, key=lambda row: row.doc_id)], axis=0)
        return float(total[0]), total[1:]

    return _field(minimise(measure, WIDTH + 4))


def score(documents: DataFrame, field: Field) -> DataFrame:
    """``doc_id``, ``copy`` and ``score`` per row."""

    def per_batch(batch):
        for i, j in words.slices(batch.column("text")):
            scores = document_scores(batch.column("text").slice(i, j - i), field)
            ids = [batch.column(name).slice(i, j - i) for name in ("doc_id", "copy")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(scores)], names=["doc_id", "copy", "score"])

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.coalesce("text", F.lit("")).alias("text")
    )
    return arrow_map(rows, "doc_id long, copy long, score double", per_batch)
