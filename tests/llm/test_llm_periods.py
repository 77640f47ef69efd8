import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from listprep.llm import entries, periods, words


def plain_runs(own, least):
    """All maximal stretches of every period, those of the smallest period kept."""
    n, found = len(own), {}
    for p in range(n // 2, 0, -1):
        k = 0
        while k + p < n:
            if own[k] != own[k + p]:
                k += 1
                continue
            begin = k
            while k + p < n and own[k] == own[k + p]:
                k += 1
            if k + p - begin >= max(least, 2 * p):
                found[begin, k + p] = p
    return sorted((begin, end - begin, p) for (begin, end), p in found.items())


def found_runs(texts, least):
    first, *columns = periods.runs_of(words.words_of(pa.array(texts), lower=False), least)
    rows = list(zip(*(column.tolist() for column in columns)))
    return [sorted(rows[a:b], key=lambda r: (r[0], r[2])) for a, b in zip(first, first[1:])]


def some_texts(rng, count, letters, most):
    texts = []
    for _ in range(count):
        own = [rng.choice(letters) for _ in range(rng.randint(0, most))]
        for _ in range(rng.randint(0, 3)):
            at, p = rng.randint(0, len(own)), rng.randint(1, 40)
            unit = [rng.choice(letters) for _ in range(p)]
            own[at:at] = (unit * 9)[: rng.randint(p, 6 * p)]
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("least", [1, 2, 5, 12, 13, 40])
@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_runs_are_those_of_all_stretches(least, letters, monkeypatch):
    rng = random.Random(f"{least}{letters}")
    monkeypatch.setattr(periods, "PIECE", rng.choice([1, 17, 300, 1 << 18]))
    texts = some_texts(rng, 40, letters, 130) + ["", None, " \n"]
    plain = [sorted(plain_runs((t or "").split(), least), key=lambda r: (r[0], r[2])) for t in texts]
    assert found_runs(texts, least) == plain


def test_words_without_chance_of_a_name_clash():
    thue = "a"
    for _ in range(12):
        thue += thue.translate(str.maketrans("ab", "ba"))
    fibonacci, following = "a", "ab"
    while len(following) < 1500:
        fibonacci, following = following, following + fibonacci
    texts = [" ".join(thue[:1500]), " ".join(following)]
    assert found_runs(texts, 12) == [plain_runs(t.split(), 12) for t in texts]


def test_every_period_has_one_size_that_cannot_miss_it():
    for least in (1, 5, 12, 64):
        for p in range(1, 300):
            sizes = [1 << k for k in range(12) if any(a <= p <= b for a, b in periods.period_ranges(1 << k, least))]
            assert len(sizes) == 1 and 2 * sizes[0] - 1 <= max(least, 2 * p) - p < 4 * sizes[0] - 1


def test_a_long_text_of_one_word():
    n = 300_000
    assert found_runs(["x " * n, "y"], 12) == [[(0, n, 1)], []]


def expected_row(doc_id, text):
    import hashlib

    own = (text or "").encode().split()
    drawn = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if drawn % 10 == 0 and own:
        g = drawn // 10
        a = g % len(own)
        p = 1 + (len(own) - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(len(own))]
    runs = sorted(plain_runs(own, 12), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(own) if i not in dropped)).hexdigest(),
    )


def test_the_query_against_the_plain_version(spark, tmp_path):
    rng = random.Random(4)
    texts = some_texts(rng, 120, ["a", "b", "ü", "Wort", "x\ty"], 90) + [None, "", "  ", "one", "a\x0bb\x0cc\r\n"]
    rows = [(k, text, "x") for k, text in enumerate(texts)] + [(3, texts[3], "x"), (None, "a " * 30, "y"), (12, "b " * 13, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = entries.op13_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    plain = [expected_row(doc_id, text) for doc_id, text, _ in rows]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, plain))
    assert [t for n, t in got.dtypes if n in names[:6]] == ["bigint"] * 6
    assert periods.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
