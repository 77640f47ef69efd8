"""Toxicity chain, quality field, packing."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from listprep.llm import entries, linear, packing, quality, tokens, toxicity
from listprep.llm.tables import table

WIDE = "doc_id long, text string, copy string, toxic string, quality int, length int, bin int, part string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "c", "t", 1, 1, 1, "p") for i, t in rows], WIDE)


# --- toxicity ----------------------------------------------------------------------------


def toxic_rows(n):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        own = [f"plain{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        mark = k % 5 == 0
        if mark:
            own.insert(rng.randrange(len(own)), rng.choice(["Moron", "scum!", "grubling" + "abcdef"[k % 6]]))
        rows.append((k, " ".join(own)))
        labels.append((k, 1, int(mark)))
    return rows, labels


def labels_of(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_the_chain_finds_toxic_documents_and_leaves_the_others(spark):
    rows, labels = toxic_rows(1200)
    chain = toxicity.train(documents(spark, rows), labels_of(spark, labels[:900]), sample_size=700)
    assert chain.names[-1] == "toxic" and len(chain.weights) == len(chain.names) > 1
    # each model has the earlier categories' probabilities among its inputs
    assert [len(w) for w in chain.weights] == [len(chain.forms) + k + 1 for k in range(len(chain.names))]
    found = {r.doc_id: r.toxic_probability for r in toxicity.score(documents(spark, rows), chain).collect()}
    marks = {k: t for k, _, t in labels}
    assert np.mean([(found[k] >= 0.5) == marks[k] for k in range(900, 1200)]) > 0.98
    kept = toxicity.clean(documents(spark, rows), chain)
    assert kept.columns == documents(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {k for k, p in found.items() if p < 0.5}


def test_the_chains_probabilities_recomputed_plainly(spark):
    """Word by word in dictionaries, with the models' weights."""
    from listprep.llm import words

    rows, labels = toxic_rows(400)
    chain = toxicity.train(documents(spark, rows), labels_of(spark, labels))
    place = {int(form): k for k, form in enumerate(chain.forms)}

    def number(text, n=None):
        found = words.words_of(pa.array([text]))
        return int(found.hashes[0]) if n is None else int(words.span_hashes(words.prefix_sums(words.lowered(found.data)), np.array([0]), np.array([n]))[0]) ^ n

    for row in toxicity.score(documents(spark, rows[:40]), chain).collect():
        held = set()
        for word in "".join(c if c.isalnum() else " " for c in dict(rows)[row.doc_id].lower()).split():
            forms = [number(word), *[number(word, n) for n in toxicity.PREFIXES if len(word) > n]]
            held |= {place[f] for f in forms if f in place}
        earlier = []
        for weights in chain.weights:
            inputs = sum(weights[k] for k in held) + sum(w * p for w, p in zip(weights[len(place) :], earlier)) + weights[-1]
            earlier.append(1 / (1 + np.exp(-inputs)))
        assert np.allclose([*(row.categories[name] for name in chain.names[:-1]), row.toxic_probability], earlier)


def test_a_folds_labels_have_no_part_in_its_forms(spark, monkeypatch):
    """Other labels for one fold change the forms of the other folds alone."""
    monkeypatch.setattr(toxicity, "FORMS", 40)
    rows, labels = toxic_rows(300)

    def chosen(turned):
        docs, marks = documents(spark, rows), labels_of(spark, [(k, q, 1 - t if k in turned else t) for k, q, t in labels])
        sample = toxicity._sample(docs, marks, 300)
        return sample, toxicity._chosen_forms(sample)

    sample, before = chosen(())
    first_fold = {r.doc_id for r in sample.filter("fold = 0").collect()}
    after = chosen(first_fold)[1]
    assert len(first_fold) > 30 and np.array_equal(before[1], after[1])
    assert not np.array_equal(before[0], after[0]) and not np.array_equal(before[2], after[2])
    a, b = np.array([1, 2, 3], dtype=np.uint64), np.array([7, 8], dtype=np.uint64)
    assert [m.tolist() for m in toxicity._aligned([np.array([8], dtype=np.uint64), a[:2]], [a, b, b[:1]])] == [[1, 2], [8], []]


def test_toxicity_of_odd_tables(spark):
    rows, labels = toxic_rows(300)
    chain = toxicity.train(documents(spark, rows), labels_of(spark, [*labels, (None, 1, 1), (5, 1, None), (0, 1, 0), (0, 1, 1)]))
    odd = [(1, None), (2, ""), (None, "scum"), (3, "word " * 200000), (3, "word")]
    found = toxicity.score(documents(spark, odd), chain).collect()
    assert len(found) == 5 and all(0 <= r.toxic_probability <= 1 for r in found)
    by = {r.doc_id: r.toxic_probability for r in found}
    assert by[None] > 0.5 > by[2] == by[1]
    assert toxicity.score(documents(spark, []), chain).count() == 0
    for none in (toxicity.train(documents(spark, rows), labels_of(spark, [])), toxicity.train(documents(spark, []), labels_of(spark, labels))):
        assert all(r.toxic_probability < 1e-9 for r in toxicity.score(documents(spark, odd), none).collect())
        assert toxicity.clean(documents(spark, odd), none).count() == 5


def test_logistic_weights_are_where_the_gradient_vanishes():
    rng = np.random.default_rng(1)
    dense = (rng.random((400, 6)) < 0.3).astype(float)
    y = (rng.random(400) < linear.sigmoid(dense @ np.array([3, -2, 0, 0, 1, 0]) - 0.5)).astype(float)
    row, column = np.nonzero(dense[:, :4])
    x = linear.Inputs(row, column, 4, dense[:, 4:])
    weights = linear.fit_logistic(x, y, penalty=1e-2, steps=3000)
    gradient = x.back(linear.predict(x, weights) - y) / 400
    gradient[:-1] += 1e-2 * weights[:-1]
    assert np.abs(gradient).max() < 1e-6
    assert np.allclose(x.times(weights), dense @ weights[:-1] + weights[-1])


# --- quality -----------------------------------------------------------------------------


def test_marginals_are_those_of_all_state_sequences():
    rng = np.random.default_rng(2)
    first = np.array([0, 1, 5, 8])
    score, between = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, total = quality.marginals(score, first, between)
    expected, expected_pairs, log_z = np.zeros(8), np.zeros((2, 2)), 0.0
    for a, b in zip(first, first[1:]):
        z, mass, moved = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(score[a:b] @ np.array(states) + sum(between[x, y] for x, y in zip(states, states[1:])))
            z += weight
            mass += weight * np.array(states)
            for x, y in zip(states, states[1:]):
                moved[x, y] += weight
        expected[a:b], log_z = mass / z, log_z + np.log(z)
        expected_pairs += moved / z
    assert np.allclose(good, expected) and np.allclose(pairs, expected_pairs) and np.isclose(total, log_z)


def test_the_gradient_is_that_of_the_weighed_likelihood():
    rng = np.random.default_rng(3)
    first, labels, weights = np.array([0, 1, 20, 45, 60]), np.array([0, 1, 1, 0]), np.array([0.3, 0.1, 0.02, 0.2])
    x, theta = rng.normal(size=(60, quality.WIDTH)), rng.normal(size=quality.WIDTH + 4) * 0.3
    _, gradient = quality.objective(theta, x, first, labels, weights)
    steps = np.eye(len(theta)) * 1e-6
    plain = [(quality.objective(theta + s, x, first, labels, weights)[0] - quality.objective(theta - s, x, first, labels, weights)[0]) / 2e-6 for s in steps]
    assert np.allclose(gradient, plain, atol=1e-7)
    best = quality.minimise(lambda t: quality.objective(t, x, first, labels, weights), len(theta), steps=300)
    assert np.abs(quality.objective(best, x, first, labels, weights)[1] + quality.PENALTY * best).max() < 1e-3


def test_chains_of_any_length_have_finite_marginals():
    rng = np.random.default_rng(4)
    score, between = rng.normal(size=100_001) * 30, rng.normal(size=(2, 2)) * 5
    good, pairs, total = quality.marginals(score, np.array([0, 100_000, 100_001]), between)
    assert np.isfinite(good).all() and np.isfinite(total) and np.isclose(pairs.sum(), 99_999)
    weighed = quality.marginals(score[:50], np.array([0, 30, 50]), between, np.array([2.0, 0.5]))
    parts = [quality.marginals(score[a:b], np.array([0, b - a]), between) for a, b in ((0, 30), (30, 50))]
    assert np.allclose(weighed[1], 2 * parts[0][1] + 0.5 * parts[1][1]) and np.isclose(weighed[2], 2 * parts[0][2] + 0.5 * parts[1][2])


def test_the_fit_over_tasks_is_that_in_memory(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(80):
        bad = k % 3 == 0
        own = ["!!! ### BUY $$$ 99" if bad and rng.random() < 0.7 else "a plain line of words that goes on" for _ in range(rng.randint(1, 30))]
        rows.append((k, "\n".join(own)))
        labels.append((k, int(not bad), 0))
    spread = quality.train(documents(spark, rows), labels_of(spark, labels))
    x, first, _ = quality.line_features(pa.array([text for _, text in rows]))
    whole = quality.fit(x.astype(np.float32).astype(float), first, np.array([q for _, q, _ in labels]))
    assert np.allclose(spread.weights, whole.weights, atol=1e-2) and np.allclose(spread.between, whole.between, atol=1e-2)


def test_line_features_of_one_text_do_not_depend_on_the_others():
    texts = ["One line\n\nTHREE!! THREE!!\n", "", "x", None, "a a a a a\nb"]
    x, first, length = quality.line_features(pa.array(texts))
    assert np.diff(first).tolist() == [4, 1, 1, 1, 2] and length.tolist() == [8, 0, 15, 0, 0, 1, 0, 9, 1]
    for k, text in enumerate(texts):
        assert np.allclose(x[first[k] : first[k + 1]], quality.line_features(pa.array([text], pa.string()))[0])
    assert np.isfinite(x).all()


def test_quality_of_held_out_documents(spark):
    found = {r.doc_id: r for r in entries.op8_quality(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == 1000
    labels = table(spark, "/root/testdata/sf0.01", "labels").collect()
    held = [r for r in labels if found[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.values())
    assert len(held) > 50 and np.mean([found[r.doc_id].predicted == r.quality for r in held]) > 0.97


def test_quality_of_odd_tables(spark):
    odd = [(1, None), (2, ""), (None, "text"), (3, "many words\n" * 50000), (3, "x")]
    for field in (quality.train(documents(spark, odd), labels_of(spark, [])), quality.train(documents(spark, []), labels_of(spark, [(1, 1, 0)]))):
        assert {r.score for r in quality.score(documents(spark, odd), field).collect()} == {0.5}
    one = quality.train(documents(spark, odd), labels_of(spark, [(1, 1, 0), (2, None, 0), (None, 0, 0)]))
    assert {r.score for r in quality.score(documents(spark, odd), one).collect()} == {1.0}
    both = quality.train(documents(spark, odd), labels_of(spark, [(3, 1, 0), (2, 0, 0)]))
    assert all(0 <= r.score <= 1 for r in quality.score(documents(spark, odd), both).collect())
    assert quality.score(documents(spark, []), both).count() == 0


# --- packing -----------------------------------------------------------------------------


def fewest(lengths, capacity):
    """Bins needed, by trying all ways."""
    best = len(lengths)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for b in range(len(free)):
            if free[b] >= lengths[k]:
                place(k + 1, [*free[:b], free[b] - lengths[k], *free[b + 1 :]])
        place(k + 1, [*free, capacity - lengths[k]])

    place(0, [])
    return best


def test_bounds_hold_and_bins_are_packed_without_gaps():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = rng.integers(1, 33, rng.integers(1, 8))
        bins, offsets = packing.best_fit(lengths, 32)
        optimum = fewest(sorted(lengths.tolist(), reverse=True), 32)
        assert packing.lower_bound(lengths, 32) <= optimum <= len(set(bins)) <= optimum + 1
        for b in set(bins):
            own = sorted((offsets[n], lengths[n]) for n in np.flatnonzero(bins == b))
            assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:])) and sum(own[-1]) <= 32
    assert packing.lower_bound(np.full(9, 17), 32) == 9 and packing.lower_bound(np.array([], dtype=int), 32) == 0


@pytest.mark.parametrize("partition", [4096, 40])
def test_packed_pieces_are_the_documents(spark, partition):
    rng = random.Random(6)
    rows = [(k, " ".join(f"tok{rng.randrange(99)}" for _ in range(rng.choice([0, 3, 30, 300, 1500])))) for k in range(300)]
    rows += [(900, None), (901, ""), (None, "no id"), (5, "again"), (5, "again"), (902, "very long text " * 9000)]
    got = packing.pack(documents(spark, rows), partition=partition).toPandas()
    encoder = tokens.Encoder(tokens.vocabulary_path(tokens.BYTE_BPE), False)
    expected, total = [], 0
    for doc_id, text in rows:
        ids = np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        total += len(ids)
        bounds = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        expected += [(str(doc_id), n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    ids = got.doc_id.map(lambda i: "None" if i != i or i is None else str(int(i)))
    assert sorted(zip(ids, got.piece, got.start, got.length, got.ids_crc32)) == sorted(expected)
    ordered = got.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum()
    assert (ends <= 1024).all() and (ends - ordered.length == ordered.offset).all()
    assert total == got.length.sum() and (got.bound <= got.bins).all()
    # few more than no packing can do without
    assert got.sequence_id.nunique() <= packing.lower_bound(got.length.to_numpy(), 1024) + 3


def test_no_documents_are_packed_into_nothing(spark):
    assert packing.pack(documents(spark, [])).count() == 0
