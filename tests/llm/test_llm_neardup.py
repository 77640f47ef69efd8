import itertools
import random

import pytest

from listprep.llm import components, neardup
from test_llm_words import plain


def sets(texts, size):
    out = []
    for text in texts:
        own = plain(text or "")
        out.append({tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set())
    return out


def brute(rows, size, percent):
    """(doc_id, number of shingles, smallest id reachable) per row; ids are unique."""
    ids, own = [i for i, _ in rows], sets([t for _, t in rows], size)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations(zip(ids, own), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((i, len(x), find(i)) for i, x in zip(ids, own))


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, node int")
    found = neardup.near_duplicates(docs, **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in found)


def copies(rng, n, start, words=90, most=9):
    base = [f"w{start}x{k}" for k in range(words)]
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        rows.append((start + k, " ".join(own)))
    return rows


@pytest.mark.parametrize("limit,block", [(32, 1024), (4, 16)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, limit, block):
    monkeypatch.setattr(neardup, "LIST", limit)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(7)
    rows = copies(rng, 120, 1000, most=7) + copies(rng, 6, 2000, most=3) + copies(rng, 2, 3000, most=1)
    rows += [(4000 + k, f"common line of words all over again u{k} v{k} w{k} x{k} y{k}") for k in range(60)]
    rows += [(5000 + k, text) for k, (_, text) in enumerate(rows[:40])]
    rng.shuffle(rows)
    assert got(spark, rows, shingle=3, percent=85) == brute(rows, 3, 85)


def test_default_is_five_words_and_eight_tenths(spark):
    base = [f"w{k}" for k in range(104)]
    near, far = list(base), list(base)
    near[50:52] = ["a", "b"]  # 6 of 100 shingles change: 94 / 106
    far[20], far[50], far[80] = "a", "b", "c"  # 15 change: 85 / 115
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    assert got(spark, rows) == [(1, 100, 1), (2, 100, 1), (3, 100, 3)]


def test_nulls_short_and_long_texts(spark):
    long = " ".join(f"l{k}" for k in range(60000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + " more"), (9, "two one")]
    assert got(spark, rows, shingle=3, percent=85) == brute(rows, 3, 85)
    assert got(spark, [], shingle=3) == []
    with_null = got(spark, [(1, "same words here"), (None, "same words here")][:1], shingle=3)
    assert with_null == [(1, 1, 1)]


def test_rows_without_or_with_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (3, "other words of the text"), (8, "a b c d e")], "doc_id long, text string")
    found = sorted(map(tuple, neardup.near_duplicates(docs).select("doc_id", "component_id").collect()), key=str)
    assert found == [(3, 3), (3, 3), (3, 3), (8, 3), (None, None)]
    kept = sorted(map(tuple, neardup.dedup(docs).collect()), key=str)
    assert kept == [(3, "a b c d e"), (3, "other words of the text"), (None, "a b c d e")]


def brute_rows(rows, size, percent):
    """As ``brute``, with the rows as documents, whatever their ids."""
    own = sets([t for _, t in rows], size)
    edges = [
        (a, b) for a, b in itertools.combinations(range(len(rows)), 2)
        if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])
    ]
    root = groups(edges)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root.get(k, k)] = min(i, least.get(root.get(k, k), i))
    return sorted((i, len(own[k]), least[root.get(k, k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_of_texts_under_one_id(spark, seed):
    rng = random.Random(seed)
    rows = copies(rng, 25, 100, most=6) + copies(rng, 25, 300, most=6) + [(900, "alone with these words"), (900, "and with these")]
    rows = [(rng.randint(1, 14) if rng.random() < 0.8 else i, text) for i, text in rows] + [rows[0], rows[30]]
    a, b = "a b c d e f g h i j k l m n o p", "q r s t u v w x y z 1 2 3 4 5 6"
    rows += [(-1, a), (-1, b), (50, a + " more"), (60, b + " more")]
    assert got(spark, rows, shingle=3, percent=80) == brute_rows(rows, 3, 80)
    kept = neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert {r.doc_id for r in kept} == {i for i, _, c in brute_rows(rows, 3, 80) if i == c}
    assert (50, a + " more") not in map(tuple, kept) and len(kept) == len(set(map(tuple, kept)))


def test_forest_connects_what_links_connect():
    import numpy as np

    rng = random.Random(2)
    universe = np.arange(40, dtype=np.uint64)
    own = [np.sort(np.array(rng.sample(universe.tolist(), rng.randint(20, 36)), dtype=np.uint64)) for _ in range(40)]
    nodes, signatures = np.arange(40), np.zeros((40, 2))
    for side in (np.zeros(40, dtype=np.int8), (np.arange(40) % 3 == 0).astype(np.int8)):
        edges = neardup.forest(nodes, side, signatures, own, 1, 60)
        assert len(edges) < 40
        pairs = [(a, b) for a, b in itertools.combinations(range(40), 2) if (not side.any() or side[a] != side[b])
                 and neardup.linked(len(np.intersect1d(own[a], own[b])), len(own[a]), len(own[b]), 60)]
        assert groups(edges) == groups(pairs)


def groups(edges):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {int(i): int(find(i)) for i in list(root)}


def test_matches_needed():
    assert neardup.matches_needed(1.0, 10) == 10
    assert neardup.matches_needed(0.85, 10, 1e-5) == 3
    assert neardup.matches_needed(0.05, 4) == 1


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in found} == {i: c for i, c in groups([e for e in edges if None not in e]).items() if i != c}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
