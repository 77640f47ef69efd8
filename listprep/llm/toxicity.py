"""Toxicity by a chain of linear classifiers.

``labels`` marks documents as toxic or not, without saying how. The categories are families of
markers learnt from it: word forms and word beginnings that occur in toxic documents far more
often than elsewhere are grouped by the documents they occur in, and a toxic document belongs to
the categories whose markers it holds. The classifiers are fitted one after the other, the
families first and ``toxic`` last; each has the presence of word forms and the probabilities of
all earlier categories as inputs, the latter predicted out of fold for the rows they are fitted
on, so that a later model meets the earlier ones as they are on new documents. Forms, families
and models of a fold are chosen and fitted without the fold's labels; its families are named
after those of all rows that they share most markers with.

Models are fitted on ``SAMPLE`` labelled documents at most, taken by a hash of ``doc_id``;
everything else covers whole texts of all documents. Words are as in ``words`` without
punctuation; a form is the word or its first 4, 5 or 6 bytes. Null and empty texts have no
forms and get what the models give for none. Labels that are null count as missing; of several
labels for one document the larger counts. Without labelled documents every probability is 0.
Rows that repeat a ``doc_id``, or have none, are scored each by its own text. A table without rows
gives none; columns beside those named are not looked at, whatever their names. Texts come in
slices of a few MB, a longer one by itself. Of equally good forms those of the smaller hash count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import linear, words
from .tables import arrow_map

SAMPLE = 12_000
FORMS = 1536
PREFIXES = (4, 5, 6)
FAMILIES = 3
FOLDS = 5
LEAST_DOCUMENTS = 8
_FILTER_BITS = 20


@dataclass
class Chain:
    """``forms``: sorted hashes of the inputs; one weight vector per category, ``toxic`` last."""

    forms: np.ndarray
    names: list[str]
    weights: list[np.ndarray]

    def __post_init__(self):
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[(self.forms >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def known(self, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``forms`` of those that are inputs, and their numbers."""
        place = np.flatnonzero(self.maybe[(forms >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if len(self.forms) == 0:
            return place[:0], place[:0]
        number = np.minimum(np.searchsorted(self.forms, forms[place]), len(self.forms) - 1)
        same = self.forms[number] == forms[place]
        return place[same], number[same]

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """One row per text and one column per category, each fed to those after it."""
        row, number = _presence(self, texts)
        x = linear.Inputs(row, number, len(self.forms), np.zeros((len(texts), 0)))
        for weights in self.weights:
            x = x.beside(linear.predict(x, weights))
        return x.dense


def _forms(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of forms of all words, and the text of each; one pair per kind of form."""
    found = words.words_of(texts, breaks=words.NO_LETTER)
    owner = np.repeat(np.arange(len(texts)), np.diff(found.first))
    out = [(found.hashes, owner)]
    if len(found.data):
        sums = words.prefix_sums(words.lowered(found.data))
        for n in PREFIXES:
            longer = found.end - found.start > n
            start = found.start[longer]
            out.append((words.span_hashes(sums, start, start + n) ^ np.uint64(n), owner[longer]))
    return out


def _sample(documents: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # at most ``size`` rows of two numbers
    chosen = F.broadcast(materialise(marks, "toxic-labels"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")
    return materialise(texts.join(chosen, "doc_id").select("doc_id", "text", "toxic", fold), "toxic-sample")


def _chosen_forms(sample: DataFrame) -> list[np.ndarray]:
    """The ``FORMS`` forms that tell toxic documents best, of all forms in the sample, and the same
    for the rows outside each fold: their labels alone decide."""

    def per_batch(batch):
        texts, toxic = batch.column("text"), batch.column("toxic").to_numpy()
        folds = batch.column("fold").to_numpy()
        for i, j in words.slices(texts):
            hashes, owners = (np.concatenate(x) for x in zip(*_forms(texts.slice(i, j - i))))
            once = np.unique(np.rec.fromarrays([hashes, folds[i + owners], owners]))
            key = np.rec.fromarrays([once.f0, once.f1])
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            marked = np.add.reduceat(toxic[i + once.f2].astype(np.int64), at) if len(at) else np.empty(0, dtype=np.int64)
            columns = [pa.array(once.f0[at].view(np.int64)), pa.array(once.f1[at], pa.int32()), pa.array(n, pa.int64()), pa.array(marked, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["form", "fold", "n", "marked"])

    counts = arrow_map(sample, "form long, fold int, n long, marked long", per_batch)
    totals = sample.select("toxic", "fold")
    measures = {"n": F.lit(1), "marked": F.col("toxic")}
    inside = totals.agg(*[F.coalesce(F.sum(F.when(_outside(k), v)), F.lit(0)).alias(f"{m}_{k}") for k in range(-1, FOLDS) for m, v in measures.items()]).first()
    counts = counts.groupBy("form").agg(
        *[F.coalesce(F.sum(F.when(_outside(k), F.col(m))), F.lit(0)).alias(f"{m}_{k}") for k in range(-1, FOLDS) for m in measures]
    )
    counts = materialise(counts.filter(F.col("n_-1") >= LEAST_DOCUMENTS), "form-counts")
    chosen = []
    for k in range(-1, FOLDS):
        n, marked, total, all_marked = F.col(f"n_{k}"), F.col(f"marked_{k}"), inside[f"n_{k}"], inside[f"marked_{k}"]
        rate = (marked + 0.5) / F.lit(all_marked + 1.0) / ((n - marked + 0.5) / F.lit(total - all_marked + 1.0))
        # documents reached, weighed by how much more often toxic ones have the form
        weight = F.abs(F.log(rate)) * F.sqrt(n)
        best = counts.filter(n >= LEAST_DOCUMENTS).orderBy(weight.desc(), "form").limit(FORMS).select("form")
        chosen.append(np.sort(best.toArrow().column("form").to_numpy().astype(np.int64).view(np.uint64)))
    return chosen


def _outside(fold: int) -> Column:
    """Rows that the models of a fold are fitted on; -1 stands for all."""
    return F.col("fold") != fold


def _presence(chain: Chain, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each input present, each once."""
    rows, numbers = [], []
    for hashes, owner in _forms(texts):
        place, number = chain.known(hashes)
        rows.append(owner[place])
        numbers.append(number)
    width = max(len(chain.forms), 1)
    cells = np.unique(np.concatenate(rows) * width + np.concatenate(numbers))
    return cells // width, cells % width


def families(x: linear.Inputs, toxic: np.ndarray, count: int) -> list[np.ndarray]:
    """Markers (columns far more frequent in toxic rows) in ``count`` groups by where they occur."""
    inside, outside = (np.bincount(x.column[toxic[x.row] == mark], minlength=x.width) for mark in (1, 0))
    rate = (inside / max((toxic == 1).sum(), 1)) / ((outside + 0.5) / max((toxic == 0).sum(), 1))
    markers = np.flatnonzero((rate > 10) & (inside >= LEAST_DOCUMENTS))
    if len(markers) < count:
        return [markers] * bool(len(markers))
    number = np.full(x.width, -1)
    number[markers] = np.arange(len(markers))
    cells = (toxic[x.row] == 1) & (number[x.column] >= 0)
    seen = np.zeros((len(markers), len(toxic)), dtype=np.float32)
    seen[number[x.column[cells]], x.row[cells]] = 1
    seen = seen / np.linalg.norm(seen, axis=1, keepdims=True)
    centres = [seen[int(np.argmax(inside[markers]))]]
    while len(centres) < count:  # the marker least like those chosen, among the frequent ones
        near = np.max(seen @ np.array(centres).T, axis=1)
        centres.append(seen[int(np.argmin(near - 1e-3 * np.log1p(inside[markers])))])
    group = np.zeros(len(markers), dtype=int)
    for _ in range(10):
        group = np.argmax(seen @ np.array(centres).T, axis=1)
        for k in range(count):
            if (group == k).any():
                centre = seen[group == k].mean(axis=0)
                centres[k] = centre / np.linalg.norm(centre)
    return [markers[group == k] for k in range(count) if (group == k).any()]


def _aligned(own: list[np.ndarray], of_all: list[np.ndarray]) -> list[np.ndarray]:
    """The families of a fold in the order of those of all rows, each with what it shares most
    markers with; one that is left has no markers."""
    shared = np.array([[len(np.intersect1d(a, b)) for b in own] for a in of_all]).reshape(len(of_all), len(own))
    out = [np.empty(0, dtype=np.uint64)] * len(of_all)
    while shared.size and shared.max() > 0:
        i, j = np.unravel_index(int(np.argmax(shared)), shared.shape)
        out[i] = own[j]
        shared[i, :] = shared[:, j] = -1
    return out


def _targets(x: linear.Inputs, forms: np.ndarray, markers: list[np.ndarray], toxic: np.ndarray) -> list[np.ndarray]:
    """Per family of markers the toxic rows that hold one, and at last all toxic rows."""
    out = []
    for family in markers:
        held = np.zeros(len(toxic), dtype=bool)
        held[x.row[np.isin(forms[x.column], family)]] = True
        out.append((held & (toxic == 1)).astype(float))
    return [*out, (toxic == 1).astype(float)]


def train(documents: DataFrame, labels: DataFrame, sample_size: int = SAMPLE) -> Chain:
    """The chain for all labelled rows. What its later models know of the earlier ones comes, for
    each fold, from forms, families and models that the fold's own labels had no part in."""
    sample = _sample(documents, labels, sample_size)
    chosen = _chosen_forms(sample)
    every = Chain(np.unique(np.concatenate(chosen)), [], [])

    def per_batch(batch):
        texts = batch.column("text")
        for i, j in words.slices(texts):
            row, number = _presence(every, texts.slice(i, j - i))
            first = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(first), pa.array(number.astype(np.int32)))
            parts = [batch.column(name).slice(i, j - i) for name in ("doc_id", "toxic", "fold")]
            yield pa.RecordBatch.from_arrays([*parts, held], names=["doc_id", "toxic", "fold", "held"])

    # at most the sample's rows, each of at most FORMS small numbers for each fold and for all
    rows = arrow_map(sample, "doc_id long, toxic int, fold int, held array<int>", per_batch).toArrow().sort_by("doc_id")
    toxic, fold = rows.column("toxic").to_numpy(), rows.column("fold").to_numpy()
    held = rows.column("held").combine_chunks()
    row = np.repeat(np.arange(len(toxic)), held.value_lengths().to_numpy(zero_copy_only=False))
    cells = linear.Inputs(row, held.flatten().to_numpy(zero_copy_only=False).astype(int), len(every.forms), np.zeros((len(toxic), 0)))
    sides = []  # of all rows, then of each fold: the inputs, the rows to fit on, the targets
    for k, forms in enumerate(chosen, -1):
        x = _restricted(cells, np.searchsorted(every.forms, forms))
        fitted = fold != k
        markers = [forms[family] for family in families(x.take(fitted), toxic[fitted], FAMILIES)]
        if k < 0:
            of_all = markers
        sides.append((x, fitted, _targets(x, forms, markers if k < 0 else _aligned(markers, of_all), toxic)))
    chain = Chain(chosen[0], [f"category_{k + 1}" for k in range(len(of_all))] + ["toxic"], [])
    for place in range(len(chain.names)):
        out_of_fold = np.zeros(len(toxic))
        for k, (x, fitted, targets) in enumerate(sides[1:]):
            weights = linear.fit_logistic(x.take(fitted), targets[place][fitted])
            out_of_fold[fold == k] = linear.predict(x.take(~fitted), weights)
        x, _, targets = sides[0]
        chain.weights.append(linear.fit_logistic(x, targets[place]))
        sides = [(x.beside(out_of_fold), fitted, targets) for x, fitted, targets in sides]
    return chain


def _restricted(x: linear.Inputs, columns: np.ndarray) -> linear.Inputs:
    """The inputs with these columns alone, in this order."""
    number = np.full(x.width, -1)
    number[columns] = np.arange(len(columns))
    held = number[x.column] >= 0
    return linear.Inputs(x.row[held], number[x.column[held]], len(columns), x.dense)


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, ``copy``, ``categories`` (name to probability) and ``toxic_probability`` per row."""

    def per_batch(batch):
        texts, names = batch.column("text"), chain.names[:-1]
        for i, j in words.slices(texts):
            p = chain.probabilities(texts.slice(i, j - i))
            first = pa.array(np.arange(0, (j - i) * len(names) + 1, max(len(names), 1))[: j - i + 1] if names else np.zeros(j - i + 1), pa.int32())
            held = pa.MapArray.from_arrays(first, pa.array(names * (j - i), pa.string()), pa.array(p[:, :-1].ravel()))
            ids = [batch.column(name).slice(i, j - i) for name in ("doc_id", "copy")]
            yield pa.RecordBatch.from_arrays([*ids, held, pa.array(p[:, -1])], names=["doc_id", "copy", "categories", "toxic_probability"])

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.coalesce("text", F.lit("")).alias("text")
    )
    return arrow_map(rows, "doc_id long, copy long, categories map<string,double>, toxic_probability double", per_batch)


def clean(documents: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that are not toxic, all their columns as they are."""

    def per_batch(batch):
        texts = batch.column(batch.schema.get_field_index("text")).fill_null("")
        for i, j in words.slices(texts):
            kept = chain.probabilities(texts.slice(i, j - i))[:, -1] < threshold
            if kept.any():
                yield batch.slice(i, j - i).filter(pa.array(kept))

    return arrow_map(documents, documents.schema, per_batch)
