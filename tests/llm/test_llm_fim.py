import hashlib
import random
import re

import pytest

from listprep.llm import entries, fim

SETTING = fim.Setting()


def plain_version(doc_id, text, setting=SETTING):
    """The contract, word for word."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    drawn = hashlib.sha256(f"{setting.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= setting.percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < setting.spm_percent:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(3)
    parts = ["a", "é", "漢", "😀", "\n", "\n\n", "<", "<P", "S>", "<M", ">", " ", "\r\n", "\t", "line "]
    out = [None, "", "\n", "no line feed", "<P>", "x<S>y", "a\n<M>\nb", "<P\n>", "<\nS>\n"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400)]


@pytest.mark.parametrize("frame", [5, 64, fim.FRAME])
def test_outputs_are_those_of_the_plain_version(spark, frame):
    rows = list(enumerate(odd_texts())) + [(7, "again\nand\nagain\n"), (7, "again\nand\nagain\n"), (None, "a\nb\nc")]
    outputs = fim.transform(fim.store(spark.createDataFrame(rows, "doc_id long, text string"), frame), SETTING, frame)
    got = sorted(map(repr, (tuple(r) for r in fim.texts(outputs).collect())))
    assert got == sorted(repr((doc_id, *plain_version(doc_id, text))) for doc_id, text in rows)
    back = [(r["doc_id"], r["text"]) for r in fim.restore(outputs).collect()]
    assert sorted(map(repr, back)) == sorted(repr((doc_id, text or "")) for doc_id, text in rows)


def test_digests_of_long_texts_and_shares(spark):
    setting = fim.Setting(seed=3, percent=70, spm_percent=20)
    long_line = "ß" * 400_000
    rows = [(k, "\n".join(f"line {j} of {k}" for j in range(k * 50))) for k in range(40)] + [(99, long_line + "\nend"), (100, long_line)]
    outputs = fim.transform(fim.store(spark.createDataFrame(rows, "doc_id long, text string")), setting)
    for row in fim.digests(outputs, setting).collect():
        text = dict(rows)[row["doc_id"]]
        n, form, before, inside, output = plain_version(row["doc_id"], text, setting)
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"]) == (n, form, before, inside)
        assert row["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert row["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_a_place_decompresses_its_own_frame_only():
    writer = fim.FrameWriter(100)
    text = "".join(f"line {k} é\n" for k in range(500))
    writer.write(text.encode())
    reader, seen = fim.FrameReader(writer.close()), []
    whole = reader.frame
    reader.frame = lambda k: (seen.append(k), whole(k))[1]
    lines = text.splitlines(keepends=True)
    for count in (0, 1, 250, 499, 500):
        seen.clear()
        assert reader.place(count) == (len("".join(lines[:count]).encode()), len("".join(lines[:count])))
        assert len(seen) <= 1


def test_empty_table_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a\nb", "x", "y", 5)], "doc_id int, text string, frames string, form string, n int")
    assert fim.transform(fim.store(rows)).count() == 1
    assert fim.digests(fim.transform(fim.store(rows.limit(0)))).count() == 0


def test_the_query_against_the_plain_version(spark, sf_dir):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = entries.op11_fill_in_middle(spark, sf_dir)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    expected = []
    for row in rows:
        *facts, output = plain_version(row["doc_id"], row["text"])
        digests = [hashlib.sha256((t or "").encode()).hexdigest() for t in (output, row["text"])]
        expected.append((row["doc_id"], *facts, *digests))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
