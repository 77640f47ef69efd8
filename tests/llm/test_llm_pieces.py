import random

import numpy as np
import pyarrow as pa
import pytest

from listprep.llm import entries, pieces, tokens

PATH = tokens.vocabulary_path(pieces.PIECE_BPE)
PARTS = ["a", "the", " the", "in", " ", "  ", "   ", "\n", "\n\n", "\t", ".", "ing", "é", "é", "▁", "▁▁", "漢字", "😀", "ﬁ", "<s>", "</s>",
         "<unk>", "<0x0A>", "http", "://", "0", "12", "\x00", "\xa0", "　", "Ω", "aaaa", "ab", "\r\n", "!", "...", "==", "--", "ß", "ская"]


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(PATH)


def same(encoder, texts):
    ids, first = encoder.encode(pa.array(texts))
    whole = encoder.model.library.encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == whole
    assert encoder.decode(ids, first) == [encoder.model.library.decode(w) for w in whole]


def test_ids_and_texts_are_those_of_the_library(encoder):
    rng = random.Random(1)
    same(encoder, ["", None, " ", "▁", "a", " a", "  a", "\n"])
    for size in (3, 12, 60):
        same(encoder, ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, size))) for _ in range(3000)])


@pytest.mark.parametrize("letters", ["ab", "the", "ation s", "aeinrst", "= -", "0123 .", "▁ e", "еиност"])
def test_words_of_few_letters(encoder, letters):
    rng = random.Random(letters)
    same(encoder, ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(1500)])


def test_long_runs(encoder):
    same(encoder, [" " * k + "x" * (k % 2) for k in range(1, 100)] + [" " * 20_000 + "x", "a" * 20_000, "the" * 9_000, "=" * 5_000, "\n" * 5_000, "ab" * 3_000 + " " * 33])


def test_a_new_memory(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    for k in range(15):
        same(encoder, [f"word{k} x{j}  common ß{j}" for j in range(k, k + 30)])


def test_ids_that_no_text_gives(encoder):
    library, rng = encoder.model.library, np.random.default_rng(2)
    runs = [rng.integers(0, 600, rng.integers(0, 12)) for _ in range(2000)] + [np.array([1, 450, 2]), np.array([0]), np.array([35, 450])]
    first = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    assert encoder.decode(np.concatenate(runs), first) == [library.decode(r.tolist()) for r in runs]


def test_rounds_are_the_one_by_one_merges():
    """Also for scores under which a merge makes a better pair than its own."""
    rng = random.Random(9)
    for _ in range(300):
        letters = "abc"
        found = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(2, 14))}
        names = [*letters, *sorted(found)]
        scores = [0.0] * 3 + [float(rng.randint(0, 12)) for _ in found]
        model = pieces.Model.__new__(pieces.Model)
        model.n, model.runs, model.ids = len(names), set(), {t: k for k, t in enumerate(names)}
        model._pairs(scores)
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(20)]
        symbols = model.of_char[np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)]
        flat, counts = pieces.merge_rounds(model, symbols, np.cumsum([0, *map(len, texts[:-1])]))
        ends = np.cumsum(counts)
        for text, a, b in zip(texts, ends - counts, ends):
            parts = list(text)
            while True:
                best = max(((scores[names.index(x + y)], -k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in found), default=None)
                if best is None:
                    break
                parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]
            assert [names[k] for k in flat[a:b]] == parts


def test_tables(spark, encoder):
    rows = [(1, "Some text\n", 0), (1, "Some text\n", 1), (None, None, 2), (3, "", 3)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, ids int")
    got = sorted(pieces.decode(pieces.encode(frame)).collect(), key=repr)
    ids = [*encoder.model.library.encode("Some text\n"), 2]
    assert got == sorted([(1, ids, "Some text\n")] * 2 + [(None, [2], ""), (3, [2], "")], key=repr)
    assert pieces.decode(pieces.encode(frame.limit(0))).count() == 0


def test_the_query_against_the_library(spark, sf_dir, encoder):
    import hashlib

    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = []
    for row in rows:
        ids = [*encoder.model.library.encode(row["text"] or ""), 2]
        texts = (" ".join(map(str, ids)), encoder.model.library.decode(ids))
        expected.append((row["doc_id"], len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in texts)))
    got = entries.op12_sentencepiece(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(expected)
