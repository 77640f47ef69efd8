"""Line dedup, passages, licences and decontamination."""

import itertools
import random
import re

import duckdb
import pandas as pd
import pytest

from listprep.llm import decontaminate, licenses, linededup, passages
from test_llm_neardup import brute

LINES = "doc_id long, text string, lang string, n_lines int, place string, _places string"


def documents(spark, rows, schema=LINES):
    width = len(schema.split(","))
    return spark.createDataFrame([(*row, *["x", 7, "y", "z"][: width - 2]) for row in rows], schema)


def sentence(rng, n, tag="w"):
    return " ".join(f"{tag}{rng.randrange(10**7)}" for _ in range(n - 1)) + f" {tag}end{rng.randrange(10**7)}."


# --- line dedup --------------------------------------------------------------------------


def line_rows(rng):
    pool = [f"line {k}" for k in range(12)] + ["", "  ", " line 3 "]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "a\nb"), (63, "a\nb\nc"), (64, "a\nb\nc"), (None, "a\nb\nc\n"), (65, "same\n" * 9), (66, "é\n\nü\nß"), (67, "é\nü\n\nß")]
    rows += [(70, "\n".join(f"row {k % 4000}" for k in range(9000)))]
    return rows


def test_line_dedup_gives_the_rows_of_its_sql(spark):
    rows = line_rows(random.Random(4))
    got = linededup.dedup_lines(documents(spark, rows, "doc_id long, text string, lang string, other int")).collect()
    table = pd.DataFrame([(i, t, "x", 7) for i, t in rows], columns=["doc_id", "text", "lang", "other"]).astype({"doc_id": "Int64"})
    link = duckdb.connect()
    link.register("documents", table)
    expected = link.execute(f"SELECT doc_id, text, n_lines, n_removed FROM ({linededup.SQL.format(documents='documents')})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=key) == sorted(expected, key=key)


def test_later_windows_go_and_overlapping_ones_together(spark):
    rows = [(1, "a\nb\nc\nd\nend"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb\nz")]
    found = {r.doc_id: r for r in linededup.dedup_lines(documents(spark, rows)).collect()}
    assert [found[k].text for k in (1, 2, 3)] == ["a\nb\nc\nd\nend", "x\ny", "a\nb\nz"]
    assert found[2].n_removed == 4 and found[2].n_lines == 6 and found[2].place == "y"


def test_rows_that_agree_are_treated_alike_and_no_rows_give_none(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")]
    assert sorted(r.text for r in linededup.dedup_lines(documents(spark, rows)).collect()) == ["a\nb\nc", "a\nb\nc", "d"]
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


# --- passages ----------------------------------------------------------------------------


def test_a_passage_inside_lines_is_found_in_all_later_documents(spark):
    rng = random.Random(1)
    shared = " ".join(sentence(rng, 12) for _ in range(5))
    rows = []
    for k in range(30):
        own = [sentence(rng, 9, f"d{k}") for _ in range(6)]
        rows.append((k, f"{own[0]} {own[1]} pre{k} fix{k} of{k} its{k} own{k} {shared} {own[2]}\n{own[3]}" if k % 3 == 0 else " ".join(own)))
    docs = documents(spark, rows)
    found = passages.repeats(docs).collect()
    assert sorted(r.doc_id for r in found) == [k for k in range(3, 30, 3)]
    texts = dict(rows)
    for r in found:
        assert texts[r.doc_id][r.start : r.end] in shared and r.n_words >= 48 and r.first_doc_id == 0
    left = {r.doc_id: r for r in passages.dedup_passages(docs).collect()}
    assert len(left) == 30 and left[0].text == texts[0] and left[1].text == texts[1] and left[1].place == "y"
    one = next(r for r in found if r.doc_id == 9)
    assert left[9].text == texts[9][: one.start] + texts[9][one.end :]


def test_near_copies_of_paragraphs_are_joined_as_all_pairs_would(spark):
    rng = random.Random(3)
    lines = []
    for g in range(25):
        base = [f"g{g}x{k}" for k in range(70)]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(70)] = f"n{rng.randrange(10**6)}"
            lines.append(" ".join(own))
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    expected = {i for i, _, c in brute(rows, 5, 80) if i != c}
    got = {r.doc_id for r in passages.repeats(documents(spark, rows), recall=0.9999).collect()}
    assert got == expected


def test_passages_of_odd_tables(spark):
    rng = random.Random(9)
    long = " ".join(sentence(rng, 15) for _ in range(3000))
    rows = [(1, None), (2, ""), (3, "short"), (None, long), (4, long), (4, long), (5, "x\n" + long)]
    found = passages.repeats(documents(spark, rows)).collect()
    assert {r.doc_id for r in found} == {4, 5}
    assert passages.repeats(documents(spark, [])).count() == 0
    assert passages.dedup_passages(documents(spark, rows)).count() == 7


def test_bands_reach_the_recall():
    for similarity, recall in itertools.product((0.5, 0.8, 0.95), (0.9, 0.995)):
        bands, rows = passages.tuned_bands(similarity, recall)
        assert bands * rows <= passages.MOST_HASHES
        assert rows == 1 or 1 - (1 - similarity**rows) ** bands >= recall


def test_the_recall_in_use_misses_few_pairs_at_the_similarity(spark):
    """Pairs of paragraphs at Jaccard 0.8 exactly (16 of 20 shingles), against comparing each with its own."""
    rows = []
    for g in range(4000):
        own = [f"g{g}x{k}" for k in range(22)]
        rows += [(2 * g, " ".join(own)), (2 * g + 1, " ".join([*own[:20], f"g{g}y", f"g{g}z"]))]
    assert all(c == i - i % 2 for i, _, c in brute(rows[:40], 5, 80))
    got = {r.doc_id for r in passages.repeats(documents(spark, rows)).collect()}
    assert got <= set(range(1, 8000, 2)) and len(got) >= 0.995 * 4000
    bands, per_band = passages.tuned_bands(passages.PERCENT / 100, passages.RECALL)
    assert (1 - (passages.PERCENT / 100) ** per_band) ** bands <= 0.005


def test_passages_of_short_lines_and_in_long_stretches_are_found(spark):
    rng = random.Random(21)
    word = lambda tag: f"{tag}{rng.randrange(10**7)}"
    shared = [word("s") for _ in range(60)]
    shapes = {
        "verse": "\n".join(" ".join(shared[k : k + 3]) for k in range(0, 60, 3)),
        "cries": " ".join(w + "!!" for w in shared),
        "stretch": " ".join(shared),
        "mixed": " ".join(" ".join(shared[k : k + n]) + "." for k, n in ((0, 6), (6, 5), (11, 9))),
    }
    rows, edge = [], {"verse": 15, "cries": 15, "stretch": 15, "mixed": 0}
    shapes = {name: text.replace("s", name[0]) for name, text in shapes.items()}
    for n, (name, text) in enumerate(shapes.items()):
        for k in range(2):
            around = [" ".join(word("o") for _ in range(90 + 7 * k)) for _ in range(2)]
            between = " " if name == "stretch" else "\n"
            rows.append((10 * n + k, around[0] + between + text + between + around[1]))
    found = {r.doc_id: r for r in passages.repeats(documents(spark, rows)).collect()}
    assert sorted(found) == [1, 11, 21, 31]
    for n, (name, text) in enumerate(shapes.items()):
        cut = dict(rows)[10 * n + 1][found[10 * n + 1].start : found[10 * n + 1].end]
        assert cut in text and len(cut.split()) >= len(text.split()) - 2 * edge[name]
        assert found[10 * n + 1].n_words == len(cut.split())


def test_a_long_paragraph_is_no_repeat_of_its_parts(spark):
    rng = random.Random(22)
    once = " ".join(f"u{rng.randrange(10**7)}" for _ in range(200))
    rows = [(1, once), (2, "na " * 300), (3, " ".join(f"v{k}" for k in range(90)))]
    assert passages.repeats(documents(spark, rows)).count() == 0
    again = passages.repeats(documents(spark, [*rows, (9, once)])).collect()
    assert [(r.doc_id, r.start, r.end, r.n_words, r.paragraphs) for r in again] == [(9, 0, len(once), 200, 1)]


# --- licences ----------------------------------------------------------------------------


def test_notices_and_texts_are_found_where_they_are(spark):
    text = dict(licenses.TEXTS)["MIT"]
    changed = text.replace("Software", "Program", 3)
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore prose here."),
        (2, "Prose with a notice. Licensed under CC BY-NC 4.0. Prose after it."),
        (3, "Foo\n" + changed + "\nbar baz"),
        (4, "The license of the bus driver was renewed under the bridge."),
        (5, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3!"),
    ]
    found = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert {k: r.license for k, r in found.items()} == {1: "MIT", 2: "CC-BY-NC-4.0", 3: "MIT", 5: "GPL-3.0"}
    assert rows[0][1][found[1].start : found[1].end] == "Released under the MIT License"
    assert rows[1][1][found[2].start : found[2].end] == "Licensed under CC BY-NC 4.0"
    assert found[1].dice == 1.0 and 0.8 <= found[3].dice < 1.0
    assert rows[2][1][found[3].start : found[3].end].startswith("Permission is hereby")


def test_coefficients_are_those_of_plain_sets():
    template = "alpha beta gamma delta epsilon zeta"
    matcher = licenses.Matcher([("T", template)], 0.5)
    for text in ("alpha beta gamma delta", "alpha beta gamma delta epsilon zeta eta theta", "beta alpha", template):
        import pyarrow as pa

        pairs = licenses._bigrams(pa.array([text]))[2].tolist()
        words_ = text.split(), template.split()
        a, b = (set(zip(w, w[1:])) for w in words_)
        dice = 2 * len(a & b) / (len(a) + len(b))
        assert [round(p[1], 9) for p in matcher.passages([pairs])] == ([round(dice, 9)] if dice >= 0.5 else [])


def test_licences_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "word"), (None, "Released under the MIT License."), (4, "Released under the MIT License. " * 3000), (5, "ß" * 5000)]
    found = licenses.scan(documents(spark, rows)).collect()
    assert {r.doc_id for r in found} == {None, 4}
    assert licenses.scan(documents(spark, [])).count() == 0
    assert licenses.scan(documents(spark, rows), templates=[]).count() == 0


def test_foreign_lines_and_longer_sentences_do_not_hide_a_licence(spark):
    first, second, third = dict(licenses.TEXTS)["MIT"].split("\n")
    notice = "It is a book which he wrote alone and released under the MIT License last year, they say."
    rows = [(1, f"Foo\n{first}\n{second}\nCopyright (c) 2001 by Some Body of Some Town\n{third}\nbar"), (2, notice)]
    found = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert {k: r.license for k, r in found.items()} == {1: "MIT", 2: "MIT"}
    assert rows[0][1][found[1].start : found[1].end] == f"{first}\n{second}\nCopyright (c) 2001 by Some Body of Some Town\n{third}".rstrip(".")
    assert notice[found[2].start : found[2].end] == "released under the MIT License" and found[2].dice == 1.0


def test_near_texts_get_their_own_names(spark):
    extra = [(k, name, text) for k, (name, text) in enumerate(licenses.TEXTS)]
    found = licenses.scan(documents(spark, [(k, f"Foo\n{text}\nbar") for k, _, text in extra])).collect()
    assert sorted((r.doc_id, r.license) for r in found) == [(k, name) for k, name, _ in extra]
    assert {"GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-3-Clause"} <= {name for _, name, _ in extra}


# --- decontamination ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def items():
    rng = random.Random(11)
    return [(k, " ".join(f"i{k}w{rng.randrange(10**6)}" for _ in range(rng.randint(14, 50)))) for k in range(40)]


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in items], "item_id long, text string, words string, seed int")


def test_passages_with_changed_words_are_found_and_others_left(spark, items):
    rng = random.Random(12)
    rows, leaked = [], {}
    for k in range(120):
        own = [f"d{k}w{j}" for j in range(60)]
        if k % 4 == 0:
            item = rng.randrange(40)
            passage = items[item][1].split()
            for _ in range(len(passage) // 12 if k % 8 == 0 else 0):
                passage[rng.randrange(len(passage))] = "changed"
            own[30:30] = [w.upper() + "," if k % 12 == 0 else w for w in passage]
            leaked[k] = item
        rows.append((k, " ".join(own)))
    found = decontaminate.overlaps(documents(spark, rows), bench(spark, items)).collect()
    exact = {k: i for k, i in leaked.items() if k % 8}
    got = {r.doc_id: r.item_id for r in found}
    assert set(got.items()) <= set(leaked.items()) and set(exact.items()) <= set(got.items())
    assert len(got) >= 0.9 * len(leaked)
    for r in found:
        if r.doc_id in exact:
            assert (r.doc_word, r.item_word, r.n_words, r.n_agree) == (30, 0, r.item_words, r.item_words)


def test_hits_are_those_of_a_plain_search(spark):
    """Every stretch of enough words that agrees well enough, found by trying all begin and end pairs."""
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(6)]
    small = [(k, " ".join(rng.choice(vocabulary) for _ in range(16))) for k in range(6)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(40))) for k in range(60)]
    for k in range(60, 100):
        own = rng.choice(small)[1].split()
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(16)] = "x"
        rows.append((k, " ".join(["y"] * rng.randint(0, 3) + own)))
    expected = set()
    for (d, text), (i, item) in itertools.product(rows, small):
        a, b = text.split(), item.split()
        for diagonal in range(-len(b), len(a)):
            low, high = max(0, -diagonal), min(len(b), len(a) - diagonal)
            agree = [a[k + diagonal] == b[k] for k in range(low, high)]
            for begin, end in itertools.combinations(range(len(agree) + 1), 2):
                if end - begin >= 11 and agree[begin] and agree[end - 1] and 4 * sum(agree[begin:end]) >= 3 * (end - begin):
                    expected.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(documents(spark, rows), bench(spark, small)).collect()}
    assert got == expected and len(expected) > 30


@pytest.mark.parametrize("n", range(11, 21))
def test_some_mask_hits_wherever_the_other_words_are(n):
    """All ways to place as many changed words as the agreement allows inside a stretch."""
    changed = n - -(-3 * n // 4)
    seen = [sum(1 << (o + j) for j, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for o in range(n - len(m) + 1)]
    missed = total = 0
    for places in itertools.combinations(range(1, n - 1), changed):
        at = sum(1 << k for k in places)
        total += 1
        missed += all(mask & at for mask in seen)
    assert missed <= 0.001 * total


def test_short_items_have_to_be_there_word_for_word(spark):
    items = [(n, " ".join(f"s{n}w{k}" for k in range(n))) for n in range(1, 11)] + [(20, "")]
    texts = {n: f"Before it, {text.upper()}! after it" for n, text in items}
    rows = [*texts.items(), (30, "s4w0 s4w1 x s4w3"), (31, "s10w0 s10w1 s10w2 s10w3 s10w4 s10w5 s10w6 s10w7 s10w8 x"), (32, "s2w0 and s2w1")]
    found = decontaminate.overlaps(documents(spark, rows), bench(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id, r.n_words, r.n_agree, r.doc_word) for r in found) == [(n, n, n, n, 2) for n in range(1, 11)]
    gone = decontaminate.contaminated(documents(spark, rows), bench(spark, items)).collect()
    assert sorted(r.doc_id for r in gone) == [n for n in range(1, 11) if n >= decontaminate.LEAST_WORDS]


def test_one_word_over_and_over(spark):
    item = " ".join(["word"] * 12 + [f"z{k}" for k in range(12)])
    rows = [(1, "word " * 100_000), (2, "word " * 50_000 + " ".join(f"z{k}" for k in range(12)))]
    found = decontaminate.overlaps(documents(spark, rows), bench(spark, [(1, item)])).collect()
    assert sorted((r.doc_id, r.doc_word, r.item_word, r.n_words, r.n_agree) for r in found) == [(1, 0, 0, 12, 12), (2, 49_988, 0, 24, 24)]


def test_decontamination_of_odd_tables(spark, items):
    passage = items[3][1]
    rows = [(1, None), (2, ""), (None, passage), (4, passage), (4, passage), (5, (passage + " . ") * 400), (6, "one two three")]
    odd = [*items, (None, passage), (50, None), (51, ""), (52, "one two three"), (3, items[3][1])]
    found = decontaminate.overlaps(documents(spark, rows), bench(spark, odd)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(4, 3), (5, 3), (6, 52)]
    assert decontaminate.contaminated(documents(spark, rows), bench(spark, odd)).count() == 2
    assert decontaminate.overlaps(documents(spark, []), bench(spark, items)).count() == 0
    assert decontaminate.overlaps(documents(spark, rows), bench(spark, [])).count() == 0
    assert re.fullmatch("[01]+", decontaminate.MASKS[0])


def test_the_longest_stretch_is_that_of_all_begin_and_end_pairs():
    import numpy as np

    rng = random.Random(31)
    for _ in range(400):
        agree = [rng.random() < rng.choice((0.6, 0.75, 0.9)) for _ in range(rng.randint(0, 40))]
        fit = [
            (b, e)
            for b in range(len(agree))
            for e in range(b + 11, len(agree) + 1)
            if agree[b] and agree[e - 1] and 4 * sum(agree[b:e]) >= 3 * (e - b)
        ]
        begin, end = decontaminate._best_stretch(np.array(agree, dtype=bool), 0.75, 11)
        assert (end > begin) == bool(fit)
        if fit:
            assert (begin, end) == min(fit, key=lambda p: (-(p[1] - p[0]), p[0]))


def test_a_short_clean_run_does_not_hide_a_longer_stretch(spark):
    item = [f"q{k}" for k in range(24)]
    passage = [*item[:10], "x", "x", "x", "x", *item[14:]]
    rows = [(1, " ".join(["own"] * 5 + passage)), (2, " ".join(["own"] * 5 + item))]
    found = decontaminate.overlaps(documents(spark, rows), bench(spark, [(7, " ".join(item))])).collect()
    assert sorted((r.doc_id, r.doc_word, r.item_word, r.n_words, r.n_agree) for r in found) == [(1, 5, 0, 24, 20), (2, 5, 0, 24, 24)]
